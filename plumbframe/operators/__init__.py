"""The verbs of the algebra."""

from plumbframe.operators.frame import Frame, GroupedFrame, Row

__all__ = ["Frame", "GroupedFrame", "Row"]

"""Results as batches, and frames over unbounded sources."""

from plumbframe.streaming.incremental import batches, over_stream

__all__ = ["batches", "over_stream"]

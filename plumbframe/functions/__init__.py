"""Expressions, aggregates and sort keys."""

from plumbframe.functions.expr import Aggregate, Expr, Nulls, Order, SortKey, asc, count, desc, literal, max_, mean, min_, null_literal, stddev_pop, sum_, variance_pop

__all__ = ["Aggregate", "Expr", "Nulls", "Order", "SortKey", "asc", "count", "desc", "literal", "max_", "mean", "min_", "null_literal", "stddev_pop", "sum_", "variance_pop"]

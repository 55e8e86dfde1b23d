"""Logical plans and their lowering to Spark."""

"""Replicated-annotation analytics on Spark."""

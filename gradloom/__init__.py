"""Tensor preparation, local-SGD training and scoring as Spark DataFrame jobs."""

__version__ = "0.1.0"

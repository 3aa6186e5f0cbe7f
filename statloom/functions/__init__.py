"""Scalar functions: Python kernels for every name, native Spark columns where Spark has them."""

from statloom.functions.catalog import KERNELS, call, column, names, result_kind

__all__ = ["KERNELS", "call", "column", "names", "result_kind"]

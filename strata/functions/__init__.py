"""Column functions for graphs, and user functions in Python."""

from strata.functions.native import array_sum, clamp, conjunction, date_text, difference, elementwise_sum, ordinal_text, repeat, rms, square, square_sum, vector_add, vector_subtract
from strata.functions.python import Variant, python, spark_type

__all__ = ["Variant", "array_sum", "clamp", "conjunction", "date_text", "difference", "elementwise_sum", "ordinal_text", "python", "repeat", "rms", "spark_type", "square", "square_sum", "vector_add", "vector_subtract"]

"""User functions in Python, with types from their annotations."""

from __future__ import annotations

import ctypes
import datetime
import inspect
import types
import typing
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.errors import ConfigurationError

#: Fixed meanings of scalar annotations. Unsigned types are one size wider, as Spark has none.
SCALARS = {
    bool: T.BooleanType(), np.bool_: T.BooleanType(), int: T.IntegerType(), float: T.FloatType(), str: T.StringType(), bytes: T.BinaryType(), datetime.datetime: T.TimestampType(),
    np.int8: T.ByteType(), np.uint8: T.ShortType(), np.int16: T.ShortType(), np.uint16: T.IntegerType(), np.int32: T.IntegerType(), np.uint32: T.LongType(), np.int64: T.LongType(), np.uint64: T.DecimalType(20, 0), np.float32: T.FloatType(), np.float64: T.DoubleType(),
    ctypes.c_bool: T.BooleanType(), ctypes.c_int: T.IntegerType(), ctypes.c_uint: T.LongType(), ctypes.c_long: T.LongType(), ctypes.c_ulong: T.DecimalType(20, 0), ctypes.c_longlong: T.LongType(), ctypes.c_ulonglong: T.DecimalType(20, 0), ctypes.c_float: T.FloatType(), ctypes.c_double: T.DoubleType(),
}

#: The same by the names that annotations may be written as.
NAMES = {
    "bool": bool, "int": int, "int32_t": np.int32, "int64_t": np.int64, "uint32_t": np.uint32, "uint64_t": np.uint64, "unsigned int": np.uint32, "long": np.int64, "unsigned long": np.uint64, "float": float, "double": np.float64, "str": str, "std::string": str,
}
UNSIGNED = {np.uint8, np.uint16, np.uint32, np.uint64, ctypes.c_uint, ctypes.c_ulong, ctypes.c_ulonglong}


def spark_type(annotation) -> T.DataType | None:
    """The Spark type of an annotation; None for no value. Unions and pointers are refused."""
    if annotation in (None, type(None), "None", "void"):
        return None
    if isinstance(annotation, T.DataType):
        return annotation
    if isinstance(annotation, str):
        name = annotation.strip()
        for prefix in ("list[", "std::vector<", "vector<", "ndarray["):
            if name.startswith(prefix):
                return T.ArrayType(spark_type(name[len(prefix) : -1].strip()))
        if name not in NAMES:
            raise ConfigurationError(f"Unsupported type '{annotation}'")
        return spark_type(NAMES[name])
    if annotation in SCALARS:
        return SCALARS[annotation]
    origin, args = typing.get_origin(annotation), typing.get_args(annotation)
    if origin in (typing.Union, types.UnionType):
        raise ConfigurationError(f"Unions aren't supported: {annotation}")
    if origin is list and args:
        return T.ArrayType(spark_type(args[0]))
    if origin is np.ndarray:
        element = typing.get_args(args[1])[0] if len(args) > 1 and typing.get_args(args[1]) else args[-1]
        return T.ArrayType(spark_type(element))
    if isinstance(annotation, type) and issubclass(annotation, ctypes.Array):
        return T.ArrayType(spark_type(annotation._type_))
    if isinstance(annotation, type) and issubclass(annotation, ctypes._Pointer):
        raise ConfigurationError(f"Pointers aren't supported: {annotation}")
    raise ConfigurationError(f"Unsupported type {annotation!r}")


def strict(value, annotation):
    """The value, if it is exactly of the annotated kind: bools are 0 or 1, integers aren't floats, unsigned ones aren't negative."""
    if annotation in (bool, np.bool_, ctypes.c_bool, "bool"):
        if value not in (0, 1):
            raise ValueError("boolean value should be bool, or integer 1 or 0")
        return bool(value)
    kind = NAMES.get(annotation, annotation) if isinstance(annotation, str) else annotation
    if isinstance(SCALARS.get(kind) if isinstance(kind, type) else None, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DecimalType)):
        if isinstance(value, (float, np.floating)):
            raise TypeError(f"int expected, not the float {value}")
        if kind in UNSIGNED and value < 0:
            raise ValueError("can't convert a negative value to an unsigned integer")
        return int(value)
    return value


class Variant:
    """One callable under a signature of its own: the same function may be registered for several types."""

    def __init__(self, fn: Callable, annotations: dict, name: str):
        self.fn, self.__name__, self.annotations = fn, name, dict(annotations)

    def __call__(self, *args):
        return self.fn(*args)


def _signature(fn: Callable) -> tuple[list, object]:
    if isinstance(fn, Variant):
        notes, names = fn.annotations, list(inspect.signature(fn.fn).parameters)
    else:
        notes, names = typing.get_type_hints(fn) if not isinstance(fn, types.BuiltinFunctionType) else {}, list(inspect.signature(fn).parameters)
    if missing := [n for n in names if n not in notes]:
        raise ConfigurationError(f"Argument '{missing[0]}' of '{getattr(fn, '__name__', fn)}' has no type")
    return [notes[n] for n in names], notes.get("return")


def python(fn: Callable) -> Callable[..., Column]:
    """A Python function as a column function: called row by row on Arrow batches, with strict conversions; arrays arrive read-only."""
    takes, gives = _signature(fn)
    kinds = [spark_type(t) for t in takes]
    result = spark_type(gives)
    if result is None:
        raise ConfigurationError(f"'{getattr(fn, '__name__', fn)}' returns nothing; observe with it instead")
    arrays = [isinstance(k, T.ArrayType) for k in kinds]

    def run(*columns):
        out = []
        for row in zip(*columns):
            args = []
            for v, is_array, note in zip(row, arrays, takes):
                if is_array:
                    v = np.asarray(v)
                    v.flags.writeable = False
                else:
                    v = strict(v, note)
                args.append(v)
            made = fn(*args)
            out.append(list(made) if isinstance(result, T.ArrayType) else strict(made, gives))
        return pd.Series(out)

    run.__annotations__ = {"columns": pd.Series, "return": pd.Series}

    def call(*inputs: Column) -> Column:
        if len(inputs) != len(kinds):
            raise ConfigurationError(f"'{getattr(fn, '__name__', fn)}' takes {len(kinds)} inputs, not {len(inputs)}")
        return F.pandas_udf(run, result)(*(c.cast(k) for c, k in zip(inputs, kinds)))

    return call

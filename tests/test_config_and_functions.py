import ctypes
import json
import sys
import types

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata import cli
from strata.config import Configuration, build, run
from strata.errors import ConfigurationError
from strata.functions import Variant, array_sum, clamp, conjunction, elementwise_sum, python, spark_type, vector_add, vector_subtract
from strata.functions.native import unsigned_sum
from strata.functions.python import strict
from strata.names import Selector

JOB = {
    "max_concurrency": 2,
    "driver": {"plugin": "generate_layers", "layers": {"event": {"parent": "job", "total": 10, "starting_number": 1}}},
    "sources": {"provider": {"py": "sample_plugin"}},
    "modules": {"add": {"py": "sample_plugin", "offset": 5}},
}


@pytest.fixture
def plugin():
    m = types.ModuleType("sample_plugin")

    def register_providers(s, config):
        s.provide("provide_i", lambda c: c.number, creator="input", suffix="i", layer="event")

    def register_algorithms(m, config):
        offset = config.get("offset", int)
        m.predicate("even", lambda x: x % 2 == 0, inputs=[{"creator": "input", "suffix": "i", "layer": "event"}])
        m.transform("shift", lambda x: x + offset, inputs=[{"creator": "input", "suffix": "i", "layer": "event"}])
        m.fold("total", F.sum, inputs=[Selector("event", "add:shift")])

    m.register_providers, m.register_algorithms = register_providers, register_algorithms
    sys.modules["sample_plugin"] = m
    yield m
    del sys.modules["sample_plugin"]


def test_configured_job(spark, plugin):
    done = run(spark, JOB)
    assert done.result("add:total").first().value == 55 + 50
    assert done.execution_count("add:shift") == 10 and "event: 10" in done.hierarchy()


def test_gates_of_configuration(spark, plugin):
    job = JOB | {"modules": {"add": JOB["modules"]["add"] | {"experimental_when": ["add:even"], "gated": ["shift"]}}}
    assert run(spark, job).execution_count("add:shift") == 5
    whole = JOB | {"modules": {"add": JOB["modules"]["add"] | {"experimental_when": ["add:even"]}}}
    done = run(spark, whole)  # every node of the module but the predicate itself
    assert done.execution_count("add:shift") == 5 and done.execution_count("add:even") == 10
    assert done.result("add:total").first().value == 2 + 4 + 6 + 8 + 10 + 5 * 5


def test_configuration_errors(spark, plugin):
    with pytest.raises(ConfigurationError, match="No driver configured"):
        build(spark, Configuration({}))
    with pytest.raises(ConfigurationError, match="Unknown source with name: missing_source"):
        build(spark, Configuration(JOB | {"driver": JOB["driver"] | {"uses_sources": ["missing_source"]}}))
    for spec in ({}, {"py": "a", "cpp": "b"}):
        with pytest.raises(ConfigurationError, match="either 'cpp' or 'py'"):
            build(spark, Configuration(JOB | {"modules": {"m": spec}}))


def test_getters():
    c = Configuration({"a": "text", "b": 7, "e": [], "o": {"x": 1}, "l": [1, [2]], "s": {"creator": "t", "layer": "job"}, "malformed1": {"creator": 16, "layer": "job"}, "malformed2": {"creator": "t"}, "big": 2**64})
    assert c["e"] == () and c["l"] == (1, (2,)) and c["o"] == {"x": 1} and c.get("b", int) == 7 and c.get("b", float) == 7.0 and c["big"] == 2**64
    assert c.get("z", int, 3) == 3 and c.get("s", Selector) == Selector("job", "t")
    for key, kind, more in (("a", int, "'a'"), ("b", str, "'b'"), ("zz", int, "'zz'"), ("malformed1", Selector, "'malformed1'.*not a string"), ("malformed2", Selector, "'malformed2'.*'layer'")):
        with pytest.raises(ConfigurationError, match=f"Error retrieving parameter {more}"):
            c.get(key, kind)


def test_command_line(tmp_path, capsys, plugin, spark):
    assert cli.main(["--version"]) == 0 and cli.main(["-h"]) == 0
    assert cli.main([]) == 2 and cli.main(["-j", "x"]) == 1
    job = tmp_path / "job.json"
    job.write_text(json.dumps(JOB))
    assert cli.main(["-c", str(job), "-j", "4"]) == 0
    assert "event: 10" in capsys.readouterr().out
    assert cli.main(["-c", str(tmp_path / "none.json")]) == 2


def test_annotations():
    for a, t in ((int, T.IntegerType()), (float, T.FloatType()), (bool, T.BooleanType()), (str, T.StringType()), (np.int64, T.LongType()), (np.uint32, T.LongType()), (np.uint64, T.DecimalType(20, 0)), (ctypes.c_double, T.DoubleType()), ("unsigned int", T.LongType()), ("double", T.DoubleType())):
        assert spark_type(a) == t
    for a, t in ((list[int], T.IntegerType()), (list["double"], T.DoubleType()), (np.ndarray[tuple[int], np.dtype[np.float64]], T.DoubleType()), (ctypes.c_int * 3, T.IntegerType()), ("std::vector<double>", T.DoubleType())):
        assert spark_type(a) == T.ArrayType(t)
    assert spark_type(None) is None and spark_type("None") is None
    for bad in (int | None, ctypes.POINTER(ctypes.c_int), "odd", object):
        with pytest.raises(ConfigurationError):
            spark_type(bad)


def test_strict_values():
    assert strict(1, bool) is True and strict(5, int) == 5
    for value, kind in ((2, bool), (1.5, int), (-1, np.uint32)):
        with pytest.raises((TypeError, ValueError)):
            strict(value, kind)


def test_python_functions_and_variants(spark):
    df = spark.createDataFrame([(1, 2.5, [1, 2, 3], True)], "i int, d double, a array<long>, b boolean")
    total = Variant(lambda v: v.sum(), {"v": list[np.int64], "return": np.int64}, "total")
    twice = Variant(lambda v: v * 2, {"v": list[np.int64], "return": list[np.int64]}, "twice")
    r = df.select(python(total)(F.col("a")).alias("t"), python(twice)(F.col("a")).alias("w")).first()
    assert r.t == 6 and r.w == [2, 4, 6]

    def writes(v: list[np.int64]) -> np.int64:
        v[0] = 1
        return 0

    with pytest.raises(Exception, match="read-only"):
        df.select(python(writes)(F.col("a"))).collect()
    for bad in (lambda x: x, Variant(lambda x: None, {"x": int, "return": None}, "n")):
        with pytest.raises(ConfigurationError):
            python(bad)

    def one(x: int) -> int:
        return x

    with pytest.raises(ConfigurationError, match="takes 1 inputs"):
        python(one)(F.col("i"), F.col("i"))


def test_native_functions(spark):
    df = spark.createDataFrame([([1, 2, 3], [10, 20], (1, 2, 3), (4, 5, 6), 4294967295)], "a array<long>, b array<long>, v struct<x:int,y:int,z:int>, w struct<x:int,y:int,z:int>, u long")
    r = df.select(elementwise_sum(F.col("a"), F.col("b")).alias("e"), array_sum(F.col("a"), "long").alias("s"), vector_add(F.col("v"), F.col("w")).alias("p"), vector_subtract(F.col("v"), F.col("w")).alias("m"), unsigned_sum(F.col("u"), F.lit(2)).alias("u"), clamp(F.lit(40)).alias("c"), conjunction(F.lit(True), F.lit(False)).alias("n")).first()
    assert (r.e, r.s, tuple(r.p), tuple(r.m), r.u, r.c, r.n) == ([11, 22], 6, (5, 7, 9), (-3, -3, -3), 1, 10, False)

"""Small trees with results worked out by hand."""

from math import sqrt

import pytest
from pyspark.sql import functions as F

from strata.errors import ConfigurationError, ResolutionError, StrataError
from strata.functions import date_text, python, rms, square
from strata.graph import Graph
from strata.names import LayerPath, Selector, TypeTag
from strata.operators import chunks, iota, items, steps
from strata.operators.nodes import Bundle
from strata.sources import CellDriver, FixedHierarchy, LayerGenerator, TableDriver

S = Selector


def runs(events=5, count=2, start=0):
    return LayerGenerator().add_layer("run", count=count).add_layer("event", "run", events, start)


def numbered(graph, layer="event", creator="input", suffix="number"):
    graph.provide(f"provide_{creator}_{suffix}_{layer}", lambda c: c.number, creator=creator, suffix=suffix, layer=layer)
    return S(layer, creator, suffix)


def values(df, column="value"):
    return sorted(r[column] for r in df.collect())


def test_job_only(spark):
    g = Graph.with_default_driver(spark)
    g.provide("number", lambda c: F.lit(42), creator="input", layer="job")
    g.observe("see", check=lambda n: n == 42, inputs=[S("job", "input")])
    run = g.execute()
    assert run.execution_count("number") == run.execution_count("see") == 1


def test_folds_over_runs_and_the_job(spark):
    g = Graph(spark, runs())
    n = numbered(g)
    g.fold("run_sum", F.sum, inputs=[n], partition="run")
    g.fold("job_sum", F.sum, inputs=[n])
    g.fold("two_layers", F.sum, inputs=[S("run", "run_sum")])
    g.fold("all", F.collect_list, inputs=[n], partition="run", initial=[])
    run = g.execute()
    assert values(run.result("run_sum")) == [10, 10]
    assert values(run.result("job_sum")) == values(run.result("two_layers")) == [20]
    assert [run.execution_count(k) for k in ("run_sum", "job_sum", "two_layers")] == [10, 10, 2]
    assert [(len(r.value), sum(r.value)) for r in run.result("all").collect()] == [(5, 10)] * 2


def test_fold_counts_a_layer_name_on_every_path(spark):
    driver = LayerGenerator().add_layer("run", count=2).add_layer("event", "run", 5).add_layer("event", "job", 10)
    g = Graph(spark, driver)
    n = numbered(g)
    g.fold("per_run", F.sum, inputs=[n], partition="run")
    g.fold("per_job", F.sum, inputs=[n])
    run = g.execute()
    assert values(run.result("per_run")) == [10, 10] and values(run.result("per_job")) == [65]
    assert run.execution_count("per_run") == 10 and run.execution_count("per_job") == 20
    with pytest.raises(StrataError, match="Ambiguous"):
        run.seen_cell_count("event")
    assert run.seen_cell_count("run/event") == 10 and run.seen_cell_count("nothing", missing_ok=True) == 0


def test_hierarchical_root_mean_square(spark):
    g = Graph(spark, runs())
    g.provide("number", lambda c: c.number + c.key("run"), creator="input", layer="event")
    g.provide("time", lambda c: F.timestamp_seconds(c.number), creator="clock", layer="run")
    g.transform("squared", square, inputs=[S("event", "input")])
    g.fold("sums", lambda x: {"total": F.sum(x), "number": F.count(x)}, inputs=[S("event", "squared")], partition="run", initial={"total": 15, "number": 0})
    g.transform("rms", lambda s: rms(s["total"], s["number"]), inputs=[S("run", "sums")])
    g.transform("text", date_text, inputs=[S("run", "clock")])
    run = g.execute()
    assert values(run.result("rms")) == pytest.approx([3.0, sqrt(14)])
    assert [run.execution_count(k) for k in ("squared", "sums", "rms", "text")] == [10, 10, 2, 2]
    assert values(run.result("text"))[0] == "Thu Jan 01 00:00:00 1970"


def test_partitions_without_cells_get_the_initial_value(spark):
    driver = CellDriver(lambda job: [job.yield_child("run", 0).yield_child("event", 7), job.yield_child("run", 1)] and None)
    g = Graph(spark, driver)
    n = numbered(g)
    g.fold("total", F.sum, inputs=[n], partition="run", initial=3)
    g.fold("most", F.max, inputs=[n], partition="run", initial=None)
    run = g.execute()
    assert values(run.result("total")) == [3, 10]
    assert {r.k_run: r.value for r in run.result("most").collect()} == {0: 7, 1: None}


def test_values_of_parents_repeat(spark):
    driver = LayerGenerator().add_layer("run", count=1).add_layer("subrun", "run", 2).add_layer("event", "subrun", 50)
    g = Graph(spark, driver)
    r, s, e = numbered(g, "run", "r"), numbered(g, "subrun", "s"), numbered(g, "event", "e")
    g.transform("a1", lambda x: 2 * x, inputs=[r])
    g.transform("a2", lambda x: x, inputs=[S("run", "a1")])
    g.transform("b1", lambda x, y: x + 3 * y, inputs=[S("run", "a2"), s])
    g.transform("c", lambda x, y, z: x + y + 4 * z, inputs=[S("run", "a2"), S("subrun", "b1"), e])
    run = g.execute()
    assert [run.execution_count(k) for k in ("a1", "a2", "b1", "c")] == [1, 1, 2, 100]
    assert sum(values(run.result("c"))) == sum(3 * i + 4 * j for i in range(2) for j in range(50))


def gated(spark, make):
    g = Graph(spark, LayerGenerator().add_layer("event", count=10, start_at=1))
    g.provide("num", lambda c: c.number - 1, creator="input", suffix="num", layer="event")
    g.provide("other", lambda c: 99 + c.number, creator="input", suffix="other_num", layer="event")
    num, other = S("event", "input", "num"), S("event", "input", "other_num")
    g.predicate("evens_only", lambda n: n % 2 == 0, inputs=[num])
    g.predicate("odds_only", lambda n: n % 2 != 0, inputs=[num])
    make(g, num, other)
    return g.execute()


def test_two_gates(spark):
    def make(g, num, other):
        g.fold("sum_evens", F.sum, inputs=[num], when=["evens_only"])
        g.fold("sum_odds", F.sum, inputs=[num], when=["odds_only"])

    run = gated(spark, make)
    assert values(run.result("sum_evens")) == [20] and values(run.result("sum_odds")) == [25]
    assert run.execution_count("sum_evens") == run.execution_count("sum_odds") == 5


def test_gates_in_series_and_in_parallel(spark):
    def make(g, num, other):
        g.predicate("odd_evens", lambda n: n % 2 != 0, inputs=[num], when=["evens_only"])
        g.observe("series", check=lambda n: n < 0, inputs=[num], when=["odd_evens"])
        g.observe("parallel", check=lambda n: n < 0, inputs=[num], when=["evens_only", "odds_only"])

    run = gated(spark, make)
    assert run.execution_count("series") == run.execution_count("parallel") == 0


def test_gates_of_three_exclusions(spark):
    def make(g, num, other):
        for name, low, high in (("a", 0, 4), ("b", 6, 7), ("c", 8, 10**9)):
            g.predicate(name, lambda n, low=low, high=high: ~((n >= low) & (n < high)), inputs=[num])
        g.transform("kept", lambda n: n, inputs=[num], when=["a", "b", "c"])

    assert values(gated(spark, make).result("kept")) == [4, 5, 7]


def test_gate_keeps_the_order_of_inputs(spark):
    def make(g, num, other):
        g.transform("even", lambda a, b: b - a, inputs=[num, other], when=["evens_only"])
        g.transform("odd", lambda a, b: b - a, inputs=[num, other], when=["odds_only"])
        g.transform("free", lambda a: a, inputs=[num])
        g.transform("after", lambda a: a, inputs=[S("event", "even")])

    run = gated(spark, make)
    assert values(run.result("even")) == values(run.result("odd")) == [100] * 5
    assert run.execution_count("free") == 10 and run.execution_count("after") == 5


def test_gate_of_a_parent_and_of_an_unfold(spark):
    g = Graph(spark, runs(3))
    r, e = numbered(g, "run", "r"), numbered(g)
    g.predicate("first", lambda n: n == 0, inputs=[r])
    g.transform("both", lambda a, b: a + b, inputs=[r, e], when=["first"])
    g.unfold("split", lambda n: iota(n + 2), inputs=[r], layer="part", when=["first"])
    g.fold("parts", F.count, inputs=[S("part", "split")], partition="run")
    run = g.execute()
    assert run.execution_count("both") == 3
    assert sorted((x.k_run, x.value) for x in run.result("parts").collect()) == [(0, 2), (1, 0)]


def test_unfolds(spark):
    g = Graph(spark, LayerGenerator().add_layer("event", count=2))
    g.provide("max", lambda c: 10 * (c.number + 1), creator="input", suffix="max_number", layer="event")
    g.provide("ten", lambda c: F.array_repeat(c.number + 1, 10), creator="input", suffix="ten_numbers", layer="event")
    most, ten = S("event", "input", "max_number"), S("event", "input", "ten_numbers")
    g.unfold("count_up", iota, inputs=[most], layer="lower1")
    g.unfold("each", items, inputs=[ten], layer="lower2")
    g.unfold("loop", steps(lambda n: 0, lambda v: v < 3, lambda v: (v + 1, v * v), "long"), inputs=[most], layer="lower3")
    g.unfold("chunked", lambda n: chunks(n, 7), inputs=[most], layer="lower4")
    g.unfold("pairs", lambda n: F.transform(iota(n), lambda x: F.struct(x.alias("x"), (x * x).alias("y"))), inputs=[most], layer="lower5", outputs=["x", "y"])
    g.unfold("none", lambda n: iota(n - n), inputs=[most], layer="lower6")
    g.fold("add", F.sum, inputs=[S("lower1", "count_up")], partition="event")
    g.fold("add_numbers", F.sum, inputs=[S("lower2", "each")], partition="event")
    g.fold("add_none", F.sum, inputs=[S("lower6", "none")], partition="event", initial=8)
    g.transform("with_parent", lambda c, m: c - m, inputs=[S("lower1", "count_up"), most])
    run = g.execute()
    assert values(run.result("add")) == [45, 190] and values(run.result("add_numbers")) == [10, 20]
    assert run.execution_count("add") == 30 and run.execution_count("add_numbers") == 20 and run.execution_count("with_parent") == 30
    assert run.execution_count("count_up") == 2
    assert values(run.result("loop")) == [0, 0, 1, 1, 4, 4]
    assert values(run.result("chunked")) == [3, 6, 7, 7, 7]
    assert values(run.result("pairs"), "y")[-1] == 19 * 19
    assert values(run.result("add_none")) == [8, 8] and run.seen_cell_count("lower6") == 0 and run.seen_cell_count("lower1") == 30


def test_chained_unfolds_and_cycles(spark):
    g = Graph(spark, LayerGenerator().add_layer("spill", count=20))
    g.provide("wires", lambda c: F.lit(5120), creator="input", layer="spill")
    g.unfold("apas", lambda n: chunks(n, 256), inputs=[S("spill", "input")], layer="apa")
    g.unfold("pieces", lambda n: chunks(n, 128), inputs=[S("apa", "apas")], layer="piece")
    g.fold("back", F.sum, inputs=[S("piece", "pieces")], partition="spill")
    run = g.execute()
    assert run.seen_cell_count("apa") == 400 and run.seen_cell_count("piece") == 800 and set(values(run.result("back"))) == {5120}
    g = Graph(spark, LayerGenerator().add_layer("a"))
    g.unfold("x", iota, inputs=[S("c", "y")], layer="b")
    g.unfold("y", iota, inputs=[S("b", "x")], layer="c")
    with pytest.raises(ConfigurationError, match="cycle"):
        g.execute()


def test_python_fold_and_observer(spark):
    g = Graph(spark, runs())
    n = numbered(g)
    g.fold("product", None, inputs=[n], partition="run", python=(lambda: 1, lambda a, x: a * (x + 1), lambda a, b: a * b, float), type="double", initial=None)
    g.fold("whole", None, inputs=[n], python=(int, lambda a, x: a + x, lambda a, b: a + b, float), initial=None)

    def small(x):
        if x > 4:
            raise ValueError(x)

    g.observe("small", small, inputs=[n])
    run = g.execute()
    assert values(run.result("product")) == [120.0, 120.0] and values(run.result("whole")) == [20.0]
    g = Graph(spark, runs())
    g.observe("bad", check=lambda x: x < 3, inputs=[numbered(g)])
    with pytest.raises(StrataError, match="Observer 'bad' failed on cell"):
        g.execute()


def test_products_are_selected_by_creator_suffix_type_and_stage(spark):
    g = Graph(spark, LayerGenerator().add_layer("event", count=10, start_at=1))
    for creator, made, tag in (("a", lambda c: c.number, "int"), ("b", lambda c: c.number * 100.0, "double")):
        g.provide(f"provide_{creator}", made, creator=creator, suffix="n", layer="event", type=TypeTag(tag))
    g.provide("old", lambda c: -c.number, creator="a", suffix="n", layer="event", stage="previous", type=TypeTag("int"))
    g.transform("t1", lambda x: x, inputs=[S("event", suffix="n", type=TypeTag("double"))])
    g.transform("t2", lambda x: x, inputs=[S("event", "a", "n", "previous")])
    g.transform("p:t3", lambda x: (x, x + 1), inputs=[S("event", "a", "n", "CURRENT")], outputs=["same", "same"], types=[TypeTag("int"), TypeTag("long")])
    g.transform("t4", lambda x: x, inputs=[S("event", "p", "same", type=TypeTag("long"))])
    run = g.execute()
    assert values(run.result("t1"))[-1] == 1000.0 and values(run.result("t2"))[0] == -10 and values(run.result("t4"))[0] == 2


def test_unused_providers_never_run(spark):
    g = Graph(spark, LayerGenerator().add_layer("event"))
    g.provide("never", lambda c: 1 / 0, creator="x", layer="event")
    g.transform("t", lambda x: x, inputs=[numbered(g)])
    assert g.execute().execution_count("t") == 1


def test_outputs_get_every_product(spark):
    seen = []
    g = Graph(spark, LayerGenerator().add_layer("spill"))
    g.provide("provide_name", lambda c: F.lit("Brahms"), creator="provide_name", layer="spill")
    g.provide("provide_number", lambda c: F.lit(17), creator="input", suffix="number", layer="spill")
    g.transform("square_number", square, inputs=[S("spill", "input", "number")], outputs=["squared_number"])
    g.transform("name", lambda x: x, inputs=[S("spill", "provide_name")])
    g.output("record", lambda name, path, df: seen.append((name, path, df.columns[-1], df.collect()[0][-1])))
    g.execute()
    assert sorted(x[0] for x in seen) == ["name", "provide_name", "provide_number", "square_number"]
    assert ("square_number", LayerPath("spill"), "squared_number", 289) in seen


def test_sources_provide_what_is_missing(spark):
    asked = []

    def offer(want):
        asked.append(want)
        return [Bundle(lambda c: c.number * 7, "maker", want.layer, "x")] if want.creator == "maker" else []

    g = Graph(spark, LayerGenerator().add_layer("spill", count=3, start_at=1))
    g.source("src", offer)
    for name in ("one", "two"):
        g.transform(name, lambda x: x, inputs=[S("spill", "maker", "x")])
    assert values(g.execute().result("one")) == [7, 14, 21] and len(asked) == 1
    g = Graph(spark, LayerGenerator().add_layer("spill"))
    g.source("s1", offer)
    g.source("s2", offer)
    g.transform("passer", lambda x: x, inputs=[S("spill", "maker", "happy")])
    with pytest.raises(ResolutionError, match="Multiple implicit providers found for product .*happy.* by creator maker in layer spill.*'passer'"):
        g.execute()


def test_errors_of_graphs(spark):
    g = Graph(spark, LayerGenerator())
    g.transform("t", lambda x: x, inputs=[S("job", "nonexistent_creator")])
    with pytest.raises(ResolutionError, match="No provider found for the following required products:(?s:.*)nonexistent_creator(?s:.*)job"):
        g.execute()
    g = Graph(spark, LayerGenerator())
    g.provide("duplicate_name", lambda c: c.number, creator="a", layer="job")
    g.provide("duplicate_name", lambda c: c.number, creator="b", layer="job")
    g.source("s", list)
    g.source("s", list)
    with pytest.raises(ConfigurationError, match="Configuration errors(?s:.*)duplicate_name(?s:.*)Source with name 's' already exists"):
        g.execute()
    with pytest.raises(ConfigurationError, match="No driver configured"):
        Graph(spark).execute()
    with pytest.raises(ConfigurationError, match="empty driver"):
        Graph(spark).add_driver(None)
    with pytest.raises(ConfigurationError, match="Driver has already been configured"):
        Graph(spark, LayerGenerator()).add_driver(LayerGenerator())
    with pytest.raises(ConfigurationError, match="empty name"):
        Graph(spark).provide("", lambda c: c.number, creator="a", layer="job")
    g = Graph(spark, runs())
    g.transform("t", lambda x: x, inputs=[numbered(g)], when=["nobody"])
    with pytest.raises(ConfigurationError, match="non-existent filter with the name 'nobody'"):
        g.execute()
    g = Graph(spark, LayerGenerator().add_layer("a").add_layer("b"))
    g.transform("t", lambda x, y: x, inputs=[numbered(g, "a", "x"), numbered(g, "b", "y")])
    with pytest.raises(ConfigurationError, match="never meet"):
        g.execute()
    run = Graph(spark, runs()).execute()
    with pytest.raises(StrataError):
        run.execution_count("nothing")
    g = Graph(spark, runs())
    g.fold("two", F.sum, inputs=[numbered(g)], outputs=["a", "b"])
    with pytest.raises(ConfigurationError, match="one output"):
        g.execute()
    g = Graph(spark, runs())
    e = numbered(g)
    g.transform("x", lambda a: a, inputs=[e], outputs=["s"])
    g.transform("y", lambda a: a, inputs=[e], outputs=["s"])
    g.transform("z", lambda a: a, inputs=[S("event", suffix="s")])
    with pytest.raises(ResolutionError, match="Multiple producers"):
        g.execute()


def test_module_names_and_gates_of_configuration(spark):
    g = Graph(spark, runs())
    e = numbered(g)
    m = g.proxy("mod", {"t": ["even"]})
    m.predicate("even", lambda n: n % 2 == 0, inputs=[e])
    m.transform("t", lambda n: n, inputs=[e])
    assert g.execute().execution_count("mod:t") == 6


def test_python_functions(spark):
    def add(i: int, j: int) -> int:
        return i + j

    g = Graph(spark, LayerGenerator().add_layer("event", count=10, start_at=1))
    g.provide("i", lambda c: c.number % 2, creator="input", suffix="i", layer="event")
    g.provide("j", lambda c: 1 - c.number % 2, creator="input", suffix="j", layer="event")
    g.transform("iadd", python(add), inputs=[S("event", "input", "i"), S("event", "input", "j")])
    assert values(g.execute().result("iadd")) == [1] * 10


def test_handles_carry_their_cells_keys(spark):
    g = Graph(spark, runs(3))
    r, e = numbered(g, "run", "r"), numbered(g)
    g.transform("where", lambda a, b: a["k_run"] * 100 + b["k_event"] * 10 + b["value"], inputs=[S("run", "r", "number", handle=True), S("event", "input", "number", handle=True)])
    assert values(g.execute().result("where")) == [0, 11, 22, 100, 111, 122]
    assert r == S("run", "r", "number", handle=True) and e.handle is False


def test_bound_methods(spark):
    class Scaler:
        def __init__(self, by):
            self.by = by

        def scale(self, x):
            return x * self.by

    g = Graph(spark, LayerGenerator().add_layer("event", count=3))
    g.transform("scaled", Scaler(7).scale, inputs=[numbered(g)])
    assert values(g.execute().result("scaled")) == [0, 7, 14]


def test_layer_generator_counts():
    assert LayerGenerator().add_layer("spill", count=16).emitted_cell_count() == 17
    g = LayerGenerator().add_layer("spill", count=16).add_layer("APA", "spill", 16)
    assert g.emitted_cell_count() == 1 + 16 + 256 and g.emitted_cell_count("/job/spill/APA") == 256
    late = LayerGenerator().add_layer("APA", "spill", 16).add_layer("spill", "run", 16).add_layer("run", count=16)
    late.add_layer("spill", count=16)
    assert late.emitted_cell_count() == 1 + 16 + 256 + 4096 + 16
    with pytest.raises(ConfigurationError, match="Ambiguous: two parent layers found for data layer 'chip'.*/job/run/spill.*/job/spill"):
        late.add_layer("chip", "spill", 16)
    with pytest.raises(ConfigurationError, match="No emitted cells corresponding to layer path '/job/spill/APA'"):
        late.emitted_cell_count("/job/spill/APA")


def test_generated_cells(spark):
    frames = LayerGenerator().add_layer("a", count=2, start_at=5).add_layer("b", "a", 3).add_layer("c", "b", 0).frames(spark)
    assert sorted(map(tuple, frames[LayerPath("a/b")].collect())) == [(a, b) for a in (5, 6) for b in range(3)]
    assert frames[LayerPath("a/b/c")].count() == 0


def test_fixed_hierarchy():
    h = FixedHierarchy(["run/event", "run", "run"])
    assert list(map(str, h.paths)) == ["/job/run", "/job/run/event"]
    with pytest.raises(ConfigurationError, match="Layer /job/unknown is not part of the fixed hierarchy"):
        h.validate(LayerPath("unknown"))
    h.update(FixedHierarchy(["unknown"])).validate(LayerPath("unknown"))
    FixedHierarchy().validate(LayerPath("anything"))


def test_cell_drivers(spark):
    class Builder:
        def hierarchy(self):
            return FixedHierarchy(["run"])

        def driver_function(self):
            def walk(job):
                yield job
                for i in range(3):
                    yield job.child("run", i)

            return walk

    assert Graph(spark, CellDriver(Builder())).execute().seen_cell_count("run") == 3
    with pytest.raises(ConfigurationError, match="empty driver builder"):
        CellDriver(None)
    with pytest.raises(ConfigurationError, match="not part of the fixed hierarchy"):
        Graph(spark, CellDriver(lambda job: job.yield_child("event", 1) and None, FixedHierarchy(["run"]))).execute()


def test_parents_without_a_table(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "u long, e long")
    g = Graph(spark, TableDriver().add("user/event", df, ["u", "e"]))
    g.fold("n", F.count, inputs=[numbered(g)], partition="user")
    assert sorted(map(tuple, g.execute().result("n").collect())) == [(1, 2), (2, 1)]
    with pytest.raises(ConfigurationError, match="needs 2 key columns"):
        TableDriver().add("a/b", df, ["u"])


def test_layer_parents_may_be_paths(spark):
    for path in ("run/spill", "/job/run/spill", "job/run/spill"):
        made = LayerGenerator().add_layer("run", count=2).add_layer("spill", "run", 3).add_layer("spill", "job", 5).add_layer("chip", path, 4)
        assert made.emitted_cell_count("/job/run/spill/chip") == 24
    later = LayerGenerator().add_layer("chip", "run/spill", 4).add_layer("spill", "run", 3).add_layer("run", count=2)
    assert later.emitted_cell_count("/job/run/spill/chip") == 24
    with pytest.raises(ConfigurationError, match="No parent layer found with the name 'run/spill'"):
        LayerGenerator().add_layer("run", count=2).add_layer("chip", "run/spill", 4).counts()

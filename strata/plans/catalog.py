"""Named queries over the test tables, each built with the graph, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions import array_sum, clamp, date_text, elementwise_sum, ordinal_text, python, repeat, rms, square, square_sum, vector_add
from strata.graph import Graph
from strata.names import Selector
from strata.operators import chunks, iota, items, steps
from strata.plans.lower import Execution
from strata.sources import LayerGenerator, ProductStore, StoredSource, TableDriver
from strata.sources.drivers import number_rows

S = Selector
_found: dict[str, tuple[Callable, str | None]] = {}


def _query(sql: str | None):
    def keep(fn):
        _found[fn.__name__] = fn, sql
        return fn

    return keep


def _tables(spark: SparkSession, sf_dir: str):
    return lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _orders(spark: SparkSession, sf_dir: str, numbered: bool = False) -> Graph:
    """job -> order -> line. Lines have a number of their own only where it matters, as that takes a shuffle."""
    t = _tables(spark, sf_dir)
    lines = t("lineitem").join(t("orders").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi") if numbered else t("lineitem")
    lines = number_rows(lines, ["l_orderkey"], "line_no") if numbered else lines.withColumn("line_no", F.col("l_linenumber").cast("long"))
    driver = TableDriver().add("order", t("orders"), ["o_orderkey"]).add("order/line", lines, ["l_orderkey", "line_no"])
    g = Graph(spark, driver)
    g.provide("line_quantity", lambda c: c.column("l_quantity").cast("long"), creator="lines", suffix="quantity", layer="line")
    g.provide("line_cents", lambda c: F.round(c.column("l_extendedprice") * 100).cast("long"), creator="lines", suffix="cents", layer="line")
    g.provide("line_discount", lambda c: F.round(c.column("l_discount") * 100).cast("long"), creator="lines", suffix="discount", layer="line")
    g.provide("order_cents", lambda c: F.round(c.column("o_totalprice") * 100).cast("long"), creator="orders", suffix="cents", layer="order")
    g.provide("order_customer", lambda c: c.column("o_custkey"), creator="orders", suffix="customer", layer="order")
    g.provide("order_date", lambda c: c.column("o_orderdate"), creator="orders", suffix="date", layer="order")
    g.provide("order_number", lambda c: c.number, creator="orders", suffix="number", layer="order")
    return g


def _line(suffix: str) -> Selector:
    return S("line", "lines", suffix)


def _order(suffix: str) -> Selector:
    return S("order", "orders", suffix)


def _events(spark: SparkSession, sf_dir: str) -> Graph:
    """job -> user -> event; users are what events name."""
    events = _tables(spark, sf_dir)("events")
    driver = TableDriver().add("user/event", events, ["user_id", "event_id"])
    g = Graph(spark, driver)
    g.provide("event_value", lambda c: F.round(c.column("value") * 100).cast("long"), creator="events", suffix="value", layer="event")
    g.provide("event_number", lambda c: c.number, creator="events", suffix="number", layer="event")
    g.provide("event_type", lambda c: c.column("event_type"), creator="events", suffix="type", layer="event")
    return g


def _event(suffix: str) -> Selector:
    return S("event", "events", suffix)


def _vectors(spark: SparkSession, sf_dir: str) -> Graph:
    g = Graph(spark, TableDriver().add("vector", _tables(spark, sf_dir)("embeddings"), ["vec_id"]))
    whole = lambda c: F.transform(c.column("embedding"), lambda x: F.round(x.cast("double") * 1000).cast("long"))
    g.provide("vector_elements", whole, creator="vectors", suffix="elements", layer="vector")
    g.provide("vector_label", lambda c: c.column("label").cast("long"), creator="vectors", suffix="label", layer="vector")
    return g


def _vector(suffix: str) -> Selector:
    return S("vector", "vectors", suffix)


def _with_lines(sql: str) -> str:
    return "with l as (select l_orderkey, cast(l_quantity as bigint) as quantity, cast(round(l_extendedprice * 100) as bigint) as cents, cast(round(l_discount * 100) as bigint) as discount from lineitem)" + sql


# --- cells and providers ---


@_query("select r.range as k_run, e.range + 1 as k_event from range(0, 20) r, range(0, 50) e")
def layer_generate(spark, sf_dir):
    driver = LayerGenerator().add_layer("run", count=20).add_layer("event", "run", 50, 1)
    return Graph(spark, driver).execute().cells("event")


@_query("select user_id as k_user, event_id as k_event, cast(round(value * 100) as bigint) as value from events")
def provide_event_value(spark, sf_dir):
    return _events(spark, sf_dir).execute_provider("event_value")


@_query("select o_orderkey as k_order, concat('[order:', cast(o_orderkey as varchar), ']') as value from orders")
def cell_id_order(spark, sf_dir):
    g = _orders(spark, sf_dir)
    g.provide("order_text", lambda c: c.text, creator="texts", layer="order")
    return g.execute_provider("order_text")


@_query("""with n as (select l_orderkey, row_number() over (partition by l_orderkey order by l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 as line_no from lineitem)
select l_orderkey as k_order, line_no as k_line, concat('[order:', cast(l_orderkey as varchar), ', line:', cast(line_no as varchar), ']') as value from n""")
def cell_id_string(spark, sf_dir):
    g = _orders(spark, sf_dir, numbered=True)
    g.provide("line_text", lambda c: c.text, creator="texts", layer="line")
    return g.execute_provider("line_text")


@_query("""select 'order' as layer, count(*) as cells from orders union all select 'line', count(*) from lineitem
union all select 'event', count(*) from events union all select 'user', count(distinct user_id) from events""")
def seen_counts(spark, sf_dir):
    orders, events = _orders(spark, sf_dir).execute(), _events(spark, sf_dir).execute()
    rows = [e.cells(layer).agg(F.lit(layer).alias("layer"), F.count(F.lit(1)).alias("cells")) for e, layer in ((orders, "order"), (orders, "line"), (events, "event"), (events, "user"))]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


# --- transforms and joins ---


@_query(_with_lines("select l_orderkey as k_order, cents * (100 - discount) as value from l"))
def transform_discounted(spark, sf_dir):
    g = _orders(spark, sf_dir)
    g.transform("discounted", lambda c, d: c * (100 - d), inputs=[_line("cents"), _line("discount")])
    return g.execute().result("discounted").drop("k_line")


@_query(_with_lines("select l_orderkey as k_order, quantity * quantity as square, 3 * quantity as triple from l"))
def transform_multi_output(spark, sf_dir):
    g = _orders(spark, sf_dir)
    g.transform("powers", lambda q: (square(q), q * 3), inputs=[_line("quantity")], outputs=["square", "triple"])
    return g.execute().result("powers").drop("k_line")


@_query("select user_id as k_user, event_id as k_event, cast(round(value * 100) as bigint) - event_id as value from events")
def same_layer_pair(spark, sf_dir):
    g = _events(spark, sf_dir)
    g.transform("less", lambda a, b: a - b, inputs=[_event("value"), _event("number")])
    return g.execute().result("less")


@_query(_with_lines("select l_orderkey as k_order, cast(round(o_totalprice * 100) as bigint) - cents as value from l join orders on l_orderkey = o_orderkey"))
def parent_child_join(spark, sf_dir):
    g = _orders(spark, sf_dir)
    g.transform("rest", lambda o, c: o - c, inputs=[_order("cents"), _line("cents")])
    return g.execute().result("rest").drop("k_line")


@_query("""select n_nationkey as k_nation, c_custkey as k_customer, o_orderkey as k_order, concat(n_name, '/', c_mktsegment, '/', o_orderstatus) as value
from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey""")
def grandparent_join(spark, sf_dir):
    t = _tables(spark, sf_dir)
    orders = t("orders").join(t("customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    driver = TableDriver().add("nation", t("nation"), ["n_nationkey"]).add("nation/customer", t("customer"), ["c_nationkey", "c_custkey"])
    g = Graph(spark, driver.add("nation/customer/order", orders, ["c_nationkey", "o_custkey", "o_orderkey"]))
    for layer, column in (("nation", "n_name"), ("customer", "c_mktsegment"), ("order", "o_orderstatus")):
        g.provide(f"{layer}_text", lambda c, column=column: c.column(column), creator=layer, layer=layer)
    g.transform("joined", lambda a, b, c: F.concat_ws("/", a, b, c), inputs=[S("nation", "nation"), S("customer", "customer"), S("order", "order")])
    return g.execute().result("joined")


# --- folds ---


@_query(_with_lines("select o_orderkey as k_order, cast(coalesce(sum(quantity), 0) as bigint) as value from orders left join l on o_orderkey = l_orderkey group by 1"))
def fold_order_sum(spark, sf_dir):
    g = _orders(spark, sf_dir)
    g.fold("total", F.sum, inputs=[_line("quantity")], partition="order")
    return g.execute().result("total")


@_query("select cast(sum(cast(l_quantity as bigint)) as bigint) as value from lineitem")
def fold_job_sum(spark, sf_dir):
    g = _orders(spark, sf_dir)
    g.fold("total", F.sum, inputs=[_line("quantity")])
    return g.execute().result("total")


@_query(_with_lines("select o_orderkey as k_order, cast(15 + coalesce(sum(quantity), 0) as bigint) as value from orders left join l on o_orderkey = l_orderkey group by 1"))
def fold_with_init(spark, sf_dir):
    g = _orders(spark, sf_dir)
    g.fold("total", F.sum, inputs=[_line("quantity")], partition="order", initial=15)
    return g.execute().result("total")


@_query(_with_lines(", s as (select o_orderkey, coalesce(sum(cents * (100 - discount)), 0) as v from orders left join l on o_orderkey = l_orderkey group by 1) select cast(sum(v) as bigint) as value from s"))
def fold_of_fold(spark, sf_dir):
    g = _orders(spark, sf_dir)
    g.transform("discounted", lambda c, d: c * (100 - d), inputs=[_line("cents"), _line("discount")])
    g.fold("order_total", F.sum, inputs=[S("line", "discounted")], partition="order")
    g.fold("job_total", F.sum, inputs=[S("order", "order_total")])
    return g.execute().result("job_total")


@_query(_with_lines("select o_orderkey as k_order, round(sqrt((15 + coalesce(sum(quantity * quantity), 0)) / nullif(count(quantity), 0)), 6) as value from orders left join l on o_orderkey = l_orderkey group by 1"))
def fold_rms(spark, sf_dir):
    g = _orders(spark, sf_dir)
    g.transform("squared", square, inputs=[_line("quantity")])
    g.fold("sums", lambda x: {"total": F.sum(x), "number": F.count(x)}, inputs=[S("line", "squared")], partition="order", initial={"total": 15, "number": 0})
    g.transform("rms", lambda s: F.round(rms(s["total"], s["number"]), 6), inputs=[S("order", "sums")])
    return g.execute().result("rms")


@_query("select user_id as k_user, cast(count(*) as bigint) as number, cast(sum(cast(round(value * 100) as bigint)) as bigint) as total, cast(min(event_id) as bigint) as first_event from events group by 1")
def fold_collect(spark, sf_dir):
    g = _events(spark, sf_dir)
    g.fold("all", lambda v, n: F.array_sort(F.collect_list(F.struct(n.alias("n"), v.alias("v")))), inputs=[_event("value"), _event("number")], partition="user", initial=None)
    g.transform("summary", lambda a: (F.size(a).cast("long"), F.aggregate(a, F.lit(0).cast("long"), lambda t, x: t + x["v"]), F.get(a, 0)["n"]), inputs=[S("user", "all")], outputs=["number", "total", "first_event"])
    return g.execute().result("summary")


@_query("""select cast(sum(n) as bigint) as value from (
  select count(*) as n from customer union all select count(*) from supplier)""")
def fold_two_paths(spark, sf_dir):
    """Cells named ``party`` below two different layers count together."""
    t = _tables(spark, sf_dir)
    driver = TableDriver().add("buyers/party", t("customer").withColumn("g", F.col("c_nationkey")), ["g", "c_custkey"]).add("sellers/party", t("supplier").withColumn("g", F.col("s_nationkey")), ["g", "s_suppkey"])
    g = Graph(spark, driver)
    g.provide("one", lambda c: F.lit(1).cast("long"), creator="parties", layer="party")
    g.fold("parties_total", F.sum, inputs=[S("party", "parties")])
    return g.execute().result("parties_total")


@_query("select user_id as k_user, cast(bit_xor(cast(round(value * 100) as bigint)) as bigint) as value from events group by 1")
def fold_grouped_python(spark, sf_dir):
    g = _events(spark, sf_dir)
    g.fold("mixed", None, inputs=[_event("value")], partition="user", python=(lambda: 0, lambda a, x: a ^ int(x), lambda a, b: a ^ b, lambda a: a), type="long", initial=None)
    return g.execute().result("mixed")


@_query("select user_id as k_user, cast(max(case when event_id % 2 = 0 then event_id end) as bigint) as value from events group by 1")
def fold_gated_max(spark, sf_dir):
    g = _events(spark, sf_dir)
    g.predicate("even", lambda n: n % 2 == 0, inputs=[_event("number")])
    g.fold("highest", F.max, inputs=[_event("number")], partition="user", initial=None, when=["even"])
    return g.execute().result("highest")


@_query("select event_type, k_user_count, total from (select event_type, cast(count(distinct user_id) as bigint) as k_user_count, cast(sum(cast(round(value * 100) as bigint)) as bigint) as total from events group by 1)")
def fold_by_type(spark, sf_dir):
    """A fold may feed relational operations as well: its result is a DataFrame."""
    run = _events(spark, sf_dir)
    run.transform("kind", lambda t, v: (t, v), inputs=[_event("type"), _event("value")], outputs=["event_type", "cents"])
    df = run.execute().result("kind")
    return df.groupBy("event_type").agg(F.countDistinct("k_user").alias("k_user_count"), F.sum("cents").alias("total"))


@_query(_with_lines("select o_orderkey as k_order, cast(2 * coalesce(sum(quantity), 0) + 1 as bigint) as value from orders left join l on o_orderkey = l_orderkey group by 1"))
def fold_finish(spark, sf_dir):
    g = _orders(spark, sf_dir)
    g.fold("total", F.sum, inputs=[_line("quantity")], partition="order", finish=lambda v: v * 2 + 1)
    return g.execute().result("total")


@_query(_with_lines("select o_orderkey as k_order, cast(coalesce(sum(quantity), 0) as bigint) as total, cast(coalesce(max(cents), 0) as bigint) as largest, count(quantity) as number from orders left join l on o_orderkey = l_orderkey group by 1"))
def fold_array_valued(spark, sf_dir):
    g = _orders(spark, sf_dir)
    g.fold("three", lambda q, c: F.array(F.sum(q), F.max(c), F.count(q)), inputs=[_line("quantity"), _line("cents")], partition="order", initial=[0, 0, 0])
    g.transform("parts", lambda a: tuple(F.get(a, k).cast("long") for k in range(3)), inputs=[S("order", "three")], outputs=["total", "largest", "number"])
    return g.execute().result("parts")


@_query("""with c as (select c_nationkey as n, c_custkey as c, count(o_orderkey) as orders from customer left join orders on o_custkey = c_custkey group by 1, 2)
select n_nationkey as k_nation, cast(coalesce(sum(orders * orders), 0) as bigint) as value from nation left join c on n = n_nationkey group by 1""")
def fold_tree(spark, sf_dir):
    """Reduction layer by layer: orders of a customer, then squares of those numbers over a nation."""
    t = _tables(spark, sf_dir)
    orders = t("orders").join(t("customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    driver = TableDriver().add("nation", t("nation"), ["n_nationkey"]).add("nation/customer", t("customer"), ["c_nationkey", "c_custkey"])
    g = Graph(spark, driver.add("nation/customer/order", orders, ["c_nationkey", "o_custkey", "o_orderkey"]))
    g.provide("one", lambda c: F.lit(1).cast("long"), creator="orders", layer="order")
    g.fold("number", F.sum, inputs=[S("order", "orders")], partition="customer")
    g.transform("squared", square, inputs=[S("customer", "number")])
    g.fold("squares", F.sum, inputs=[S("customer", "squared")], partition="nation")
    return g.execute().result("squares")


@_query("select c_nationkey as k_buyers, count(*) as value from customer group by 1")
def fold_excluded_cells(spark, sf_dir):
    """Cells of the folded layer's name that aren't below the partition don't count."""
    t = _tables(spark, sf_dir)
    driver = TableDriver().add("buyers/party", t("customer").withColumn("g", F.col("c_nationkey")), ["g", "c_custkey"]).add("sellers/party", t("supplier").withColumn("g", F.col("s_nationkey")), ["g", "s_suppkey"])
    g = Graph(spark, driver)
    g.provide("one", lambda c: F.lit(1).cast("long"), creator="parties", layer="party")
    g.fold("parties_total", F.sum, inputs=[S("party", "parties")], partition="buyers")
    return g.execute().result("parties_total")


@_query("select user_id as k_user, event_id as k_event, cast(sum(cast(round(value * 100) as bigint)) over (partition by user_id) - cast(round(value * 100) as bigint) as bigint) as value from events")
def fold_back_to_members(spark, sf_dir):
    """What a fold made of a layer meets that layer's own cells again."""
    g = _events(spark, sf_dir)
    g.fold("total", F.sum, inputs=[_event("value")], partition="user")
    g.transform("rest", lambda t, v: t - v, inputs=[S("user", "total"), _event("value")])
    return g.execute().result("rest")


# --- predicates and gates ---


def _gated(spark, sf_dir, *gates, predicates=()):
    g = _events(spark, sf_dir)
    for name, fn, suffix, when in predicates:
        g.predicate(name, fn, inputs=[_event(suffix)], when=when)
    g.transform("kept", lambda v: v, inputs=[_event("value")], when=gates)
    return g.execute().result("kept")


_EVEN = ("even", lambda n: n % 2 == 0, "number", ())
_ODD = ("odd", lambda n: n % 2 != 0, "number", ())
_EVENTS = "select user_id as k_user, event_id as k_event, cast(round(value * 100) as bigint) as value from events where "


@_query(_EVENTS + "event_id % 2 = 0")
def gate_even(spark, sf_dir):
    return _gated(spark, sf_dir, "even", predicates=[_EVEN])


@_query(_EVENTS + "event_id % 2 <> 0")
def gate_odd(spark, sf_dir):
    return _gated(spark, sf_dir, "odd", predicates=[_EVEN, _ODD])


@_query("select cast(0 as bigint) as n")
def gate_series(spark, sf_dir):
    kept = _gated(spark, sf_dir, "odd", predicates=[_EVEN, ("odd", _ODD[1], "number", ("even",))])
    return kept.agg(F.count(F.lit(1)).alias("n"))


@_query("select cast(0 as bigint) as n")
def gate_parallel(spark, sf_dir):
    return _gated(spark, sf_dir, "even", "odd", predicates=[_EVEN, _ODD]).agg(F.count(F.lit(1)).alias("n"))


@_query(_EVENTS + "not (event_id >= 0 and event_id < 40) and not (event_id >= 60 and event_id < 70) and not (event_id >= 800)")
def gate_three_ranges(spark, sf_dir):
    def outside(name, a, b):
        return name, lambda n: ~((n >= a) & (n < b)) if b else ~(n >= a), "number", ()

    ranges = [outside("low", 0, 40), outside("middle", 60, 70), outside("high", 800, None)]
    return _gated(spark, sf_dir, "low", "middle", "high", predicates=ranges)


@_query(_EVENTS + "event_id in (0, 1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144, 233, 377, 610, 987)")
def gate_set_member(spark, sf_dir):
    numbers = [0, 1]
    while numbers[-1] + numbers[-2] < 1000:
        numbers.append(numbers[-1] + numbers[-2])
    return _gated(spark, sf_dir, "member", predicates=[("member", lambda n: n.isin(sorted(set(numbers))), "number", ())])


@_query(_with_lines("select l_orderkey as k_order, cast(round(o_totalprice * 100) as bigint) - cents as value from l join orders on l_orderkey = o_orderkey where quantity > 25 and o_orderkey % 2 = 0"))
def gate_two_inputs(spark, sf_dir):
    g = _orders(spark, sf_dir)
    g.predicate("large", lambda q: q > 25, inputs=[_line("quantity")])
    g.predicate("even", lambda n: n % 2 == 0, inputs=[_order("number")])
    g.transform("rest", lambda o, c: o - c, inputs=[_order("cents"), _line("cents")], when=["large", "even"])
    return g.execute().result("rest").drop("k_line")


@_query(_with_lines("select o_orderkey as k_order, cast(coalesce(sum(case when quantity > 25 then quantity end), 0) as bigint) as value from orders left join l on o_orderkey = l_orderkey group by 1"))
def gated_fold(spark, sf_dir):
    g = _orders(spark, sf_dir)
    g.predicate("large", lambda q: q > 25, inputs=[_line("quantity")])
    g.fold("total", F.sum, inputs=[_line("quantity")], partition="order", when=["large"])
    return g.execute().result("total")


_THIRD = ("third", lambda n: n % 3 == 0, "number")


@_query(_EVENTS + "event_id % 6 = 0")
def gate_series_some(spark, sf_dir):
    return _gated(spark, sf_dir, "third", predicates=[_EVEN, (*_THIRD, ("even",))])


@_query(_EVENTS + "event_id % 6 = 0")
def gate_parallel_some(spark, sf_dir):
    return _gated(spark, sf_dir, "even", "third", predicates=[_EVEN, (*_THIRD, ())])


@_query("select user_id as k_user, event_id as k_event, event_id % 3 = 0 as decision from events where event_id % 2 = 0")
def gate_decisions(spark, sf_dir):
    """A gated predicate decides only where its gate holds."""
    g = _events(spark, sf_dir)
    g.predicate("even", _EVEN[1], inputs=[_event("number")])
    g.predicate("third", _THIRD[1], inputs=[_event("number")], when=["even"])
    return g.execute().result("third")


@_query("select 'kept' as node, count(*) as runs from events where event_id % 2 = 0 union all select 'even', count(*) from events union all select 'total', count(*) from events where event_id % 2 = 0")
def counted_executions(spark, sf_dir):
    g = _events(spark, sf_dir)
    g.predicate("even", _EVEN[1], inputs=[_event("number")])
    g.transform("kept", lambda v: v, inputs=[_event("value")], when=["even"])
    g.fold("total", F.sum, inputs=[_event("value")], partition="user", when=["even"])
    run = g.execute()
    return spark.createDataFrame([(n, run.execution_count(n)) for n in ("kept", "even", "total")], "node string, runs long")


# --- selection ---


@_query("select user_id as k_user, event_id as k_event, cast(round(value * 100) as bigint) - 3 * event_id as value from events")
def select_by_creator(spark, sf_dir):
    """Products of one suffix and layer, told apart by their creators."""
    g = _events(spark, sf_dir)
    g.provide("tripled", lambda c: c.number * 3, creator="others", suffix="value", layer="event")
    g.transform("less", lambda a, b: a - b, inputs=[_event("value"), S("event", "others", "value")])
    return g.execute().result("less")


@_query("select user_id as k_user, event_id as k_event, concat(cast(user_id as varchar), '/', cast(event_id as varchar), '=', cast(cast(round(value * 100) as bigint) as varchar)) as value from events")
def argument_handle(spark, sf_dir):
    """An argument taken as a handle brings its cell's keys."""
    g = _events(spark, sf_dir)
    g.transform("told", lambda h: F.concat(h["k_user"].cast("string"), F.lit("/"), h["k_event"].cast("string"), F.lit("="), h["value"].cast("string")), inputs=[S("event", "events", "value", handle=True)])
    return g.execute().result("told")


# --- unfolds ---


@_query("select vec_id as k_vector, i.i as k_step, i.i as value from embeddings, lateral (select unnest(range(0, label)) as i) i")
def unfold_iota(spark, sf_dir):
    g = _vectors(spark, sf_dir)
    g.unfold("count_up", iota, inputs=[_vector("label")], layer="step")
    return g.execute().result("count_up")


_ELEMENTS = "select vec_id, i - 1 as n, cast(round(cast(embedding[i] as double) * 1000) as bigint) as x, label from embeddings, range(1, 65) t(i)"


@_query(f"select vec_id as k_vector, n as k_element, x as value from ({_ELEMENTS})")
def unfold_array(spark, sf_dir):
    g = _vectors(spark, sf_dir)
    g.unfold("elements", items, inputs=[_vector("elements")], layer="element")
    return g.execute().result("elements")


@_query("select o_orderkey as k_order, c.c as k_chunk, least(50, cast(round(o_totalprice) as bigint) % 997 - 50 * c.c) as value from orders, lateral (select unnest(range(0, (cast(round(o_totalprice) as bigint) % 997 + 49) // 50)) as c) c")
def unfold_chunks(spark, sf_dir):
    g = _orders(spark, sf_dir)
    g.provide("size", lambda c: F.round(c.column("o_totalprice")).cast("long") % 997, creator="sizes", layer="order")
    g.unfold("chunk", lambda n: chunks(n, 50), inputs=[S("order", "sizes")], layer="chunk")
    return g.execute().result("chunk")


@_query("select vec_id as k_vector, cast(label * (label - 1) // 2 as bigint) as value from embeddings")
def unfold_empty_fold(spark, sf_dir):
    g = _vectors(spark, sf_dir)
    g.unfold("count_up", iota, inputs=[_vector("label")], layer="step")
    g.fold("sum_up", F.sum, inputs=[S("step", "count_up")], partition="vector")
    return g.execute().result("sum_up")


@_query(f"select vec_id as k_vector, n as k_element, x * label as value from ({_ELEMENTS})")
def unfold_parent_join(spark, sf_dir):
    g = _vectors(spark, sf_dir)
    g.unfold("elements", items, inputs=[_vector("elements")], layer="element")
    g.transform("scaled", lambda x, label: x * label, inputs=[S("element", "elements"), _vector("label")])
    return g.execute().result("scaled")


@_query(f"select vec_id as k_vector, cast(sum(greatest(-500, least(500, x))) as bigint) as value from ({_ELEMENTS}) group by 1")
def unfold_fold_pipeline(spark, sf_dir):
    g = _vectors(spark, sf_dir)
    g.unfold("elements", items, inputs=[_vector("elements")], layer="element")
    g.transform("clamped", lambda x: clamp(x, -500, 500), inputs=[S("element", "elements")])
    g.fold("clamped_sum", F.sum, inputs=[S("element", "clamped")], partition="vector")
    return g.execute().result("clamped_sum")


@_query("select doc_id as k_document, i.i as k_line, length(string_split(text, chr(10))[i.i + 1]) as value from documents, lateral (select unnest(range(0, len(string_split(text, chr(10))))) as i) i")
def unfold_document_lines(spark, sf_dir):
    g = Graph(spark, TableDriver().add("document", _tables(spark, sf_dir)("documents"), ["doc_id"]))
    g.provide("text", lambda c: c.column("text"), creator="documents", layer="document")
    g.unfold("lines", lambda t: F.split(t, "\n"), inputs=[S("document", "documents")], layer="line")
    g.transform("line_length", lambda x: F.length(x).cast("long"), inputs=[S("line", "lines")])
    return g.execute().result("line_length")


@_query("select vec_id as k_vector, i.i as k_step, (label - i.i) * 10 as value from embeddings, lateral (select unnest(range(0, label)) as i) i")
def unfold_python(spark, sf_dir):
    """A general loop: counts down from the label."""
    g = _vectors(spark, sf_dir)
    g.unfold("count_down", steps(lambda n: n, lambda v: v > 0, lambda v: (v - 1, v * 10), "long"), inputs=[_vector("label")], layer="step")
    return g.execute().result("count_down")


@_query(f"select vec_id as k_vector, n as k_element, x, x * x as square from ({_ELEMENTS})")
def unfold_multi_output(spark, sf_dir):
    g = _vectors(spark, sf_dir)
    g.unfold("both", lambda e: F.transform(e, lambda x: F.struct(x.alias("x"), (x * x).alias("square"))), inputs=[_vector("elements")], layer="element", outputs=["x", "square"])
    return g.execute().result("both")


@_query(f"select vec_id as k_vector, n as k_element, x + label as value from ({_ELEMENTS}) where n < label")
def unfold_multi_input(spark, sf_dir):
    g = _vectors(spark, sf_dir)
    g.unfold("first", lambda e, n: F.transform(F.slice(e, 1, n.cast("int")), lambda x: x + n), inputs=[_vector("elements"), _vector("label")], layer="element")
    return g.execute().result("first")


@_query(f"with m as (select vec_id, ((x % 4) + 4) % 4 as m from ({_ELEMENTS})) select vec_id as k_vector, cast(sum(m * (m - 1) // 2) as bigint) as value from m group by 1")
def unfold_chained(spark, sf_dir):
    g = _vectors(spark, sf_dir)
    g.unfold("elements", items, inputs=[_vector("elements")], layer="element")
    g.unfold("count_up", lambda x: iota(F.pmod(x, F.lit(4))), inputs=[S("element", "elements")], layer="step")
    g.fold("sum_up", F.sum, inputs=[S("step", "count_up")], partition="vector")
    return g.execute().result("sum_up")


@_query(f"select vec_id as k_vector, cast(sum(x) - any_value(label * (label - 1) // 2) as bigint) as value from ({_ELEMENTS}) group by 1")
def unfold_siblings(spark, sf_dir):
    """Two unfolds of one layer, folded back and compared there."""
    g = _vectors(spark, sf_dir)
    g.unfold("count_up", iota, inputs=[_vector("label")], layer="step")
    g.unfold("elements", items, inputs=[_vector("elements")], layer="element")
    g.fold("sum_up", F.sum, inputs=[S("step", "count_up")], partition="vector")
    g.fold("sum_elements", F.sum, inputs=[S("element", "elements")], partition="vector")
    g.transform("less", lambda a, b: a - b, inputs=[S("vector", "sum_elements"), S("vector", "sum_up")])
    return g.execute().result("less")


# --- functions ---


@_query("""with v as (select vec_id, list_transform(embedding, lambda x: cast(round(cast(x as double) * 1000) as bigint)) as e from embeddings)
select vec_id as k_vector, e[1] + e[4] as x, e[2] + e[5] as y, e[3] + e[6] as z from v""")
def struct_vector_add(spark, sf_dir):
    g = _vectors(spark, sf_dir)
    three = lambda e, at: F.struct(*(F.get(e, at + k).alias(n) for k, n in enumerate("xyz")))
    g.transform("points", lambda e: (three(e, 0), three(e, 3)), inputs=[_vector("elements")], outputs=["a", "b"])
    g.transform("summed", vector_add, inputs=[S("vector", "points", "a"), S("vector", "points", "b")])
    g.transform("parts", lambda s: (s["x"], s["y"], s["z"]), inputs=[S("vector", "summed")], outputs=["x", "y", "z"])
    return g.execute().result("parts")


@_query("""with v as (select vec_id, list_transform(embedding, lambda x: cast(round(cast(x as double) * 1000) as bigint)) as e from embeddings)
select vec_id as k_vector, list_sum(list_transform(range(1, 65), lambda i: e[i] + e[65 - i]))::bigint as value from v""")
def array_zip_add(spark, sf_dir):
    g = _vectors(spark, sf_dir)
    g.transform("both_ways", lambda e: array_sum(elementwise_sum(e, F.reverse(e)), "long"), inputs=[_vector("elements")])
    return g.execute().result("both_ways")


@_query("select vec_id as k_vector, cast(label as bigint) * 3 as total, 3 as n from embeddings")
def array_repeat(spark, sf_dir):
    g = _vectors(spark, sf_dir)
    g.transform("thrice", lambda x: repeat(x, 3), inputs=[_vector("label")])
    g.transform("summed", lambda a: (F.aggregate(a, F.lit(0).cast("long"), lambda t, x: t + x), F.size(a)), inputs=[S("vector", "thrice")], outputs=["total", "n"])
    return g.execute().result("summed")


@_query(f"select vec_id as k_vector, cast(sum(x * x) as bigint) as value from ({_ELEMENTS}) group by 1")
def array_square_sum(spark, sf_dir):
    g = _vectors(spark, sf_dir)
    g.transform("squares", lambda e: square_sum(e, "long"), inputs=[_vector("elements")])
    return g.execute().result("squares")


@_query("select o_orderkey as k_order, concat('John the ', cast(o_orderkey as varchar), 'th') as value from orders")
def string_format(spark, sf_dir):
    g = _orders(spark, sf_dir)
    g.transform("named", ordinal_text, inputs=[_order("number")])
    return g.execute().result("named")


@_query("select o_orderkey as k_order, strftime(o_orderdate, '%a %b %d %H:%M:%S %Y') as value from orders")
def date_format_ctime(spark, sf_dir):
    g = _orders(spark, sf_dir)
    g.transform("dated", date_text, inputs=[_order("date")])
    return g.execute().result("dated")


def _add(i: np.int64, j: np.int64) -> np.int64:
    return i + j


@_query("select user_id as k_user, event_id as k_event, cast(round(value * 100) as bigint) + event_id as value from events")
def python_scalar_udf(spark, sf_dir):
    g = _events(spark, sf_dir)
    g.transform("added", python(_add), inputs=[_event("value"), _event("number")])
    return g.execute().result("added")


@_query(f"select vec_id as k_vector, cast(sum(x * x) as bigint) as value from ({_ELEMENTS}) group by 1")
def python_array_udf(spark, sf_dir):
    from strata.functions import Variant

    g = _vectors(spark, sf_dir)
    fn = Variant(lambda values: int((values * values).sum()), {"values": list[np.int64], "return": np.int64}, "square_sum")
    g.transform("squares", python(fn), inputs=[_vector("elements")])
    return g.execute().result("squares")


# --- storage ---


@_query(_with_lines("select o_orderkey as k_order, concat('[order:', cast(o_orderkey as varchar), ']') as cell_id, cast(coalesce(sum(quantity), 0) as bigint) as value from orders left join l on o_orderkey = l_orderkey group by o_orderkey"))
def store_roundtrip(spark, sf_dir):
    store = ProductStore(spark, _folder(spark))
    g = _orders(spark, sf_dir)
    g.fold("total", F.sum, inputs=[_line("quantity")], partition="order")
    run = g.execute()
    for path, df in run.node_frames("total").items():
        store.write("total", path, df)
    return store.read("total")


@_query("select o_orderkey as k_order, cast(round(o_totalprice * 100) as bigint) * 2 as value from orders")
def stored_source(spark, sf_dir):
    """Products stored by one graph are another's implicit providers."""
    from strata.sources import SourceDriver

    store = ProductStore(spark, _folder(spark))
    first = _orders(spark, sf_dir)
    first.transform("doubled", lambda c: c * 2, inputs=[_order("cents")])
    for path, df in first.execute().node_frames("doubled").items():
        store.write("doubled", path, df)
    stored = StoredSource(store, "doubled")
    g = Graph(spark)
    source = g.source("earlier", stored.create_providers, stored.indices)
    g.add_driver(SourceDriver([source]))
    g.transform("again", lambda x: x, inputs=[S("order", "doubled")])
    return g.execute().result("again")


def _folder(spark: SparkSession) -> str:
    """A new folder that all executors share: below spark.checkpoint.dir, or a temporary one in local tests."""
    import atexit
    import shutil
    import tempfile
    import uuid

    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return f"{given.rstrip('/')}/strata/store-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="strata-store-")
    atexit.register(shutil.rmtree, made, True)
    return f"file://{made}/store"


def _stored_totals(spark: SparkSession, sf_dir: str) -> ProductStore:
    """Order prices, as an output stored them."""
    store = ProductStore(spark, _folder(spark))
    g = _orders(spark, sf_dir)
    g.transform("price", lambda c: c, inputs=[_order("cents")])
    g.output("keep", lambda name, path, frame: store.sink(name, path, frame) if name == "price" else None)
    g.execute()
    return store


@_query("select o_orderkey as k_order, concat('[order:', cast(o_orderkey as varchar), ']') as cell_id, cast(round(o_totalprice * 100) as bigint) as value from orders")
def output_stored(spark, sf_dir):
    return _stored_totals(spark, sf_dir).read("price")


@_query("select concat('[order:', cast(o_orderkey as varchar), ']') as cell_id from orders")
def stored_indices(spark, sf_dir):
    return _stored_totals(spark, sf_dir).indices("price")


@_query("select o_orderkey as k_order, concat('[order:', cast(o_orderkey as varchar), ']') as cell_id, cast(round(o_totalprice * 100) as bigint) as value from orders where o_orderkey = 7")
def stored_row(spark, sf_dir):
    return _stored_totals(spark, sf_dir).row_of("price", "[order:7]")


@_query("select 'value' as product, count(*) as row_number from orders where o_orderkey < 7")
def stored_token(spark, sf_dir):
    token = _stored_totals(spark, sf_dir).token("price", "value", "[order:7]")
    return spark.createDataFrame([(token.product, token.row)], "product string, row_number long")


# --- streaming ---


@_query("select strftime(date_trunc('hour', ts), '%Y-%m-%d %H') as hour, event_type, count(*) as n from events group by 1, 2")
def windowed_event_counts(spark, sf_dir):
    from strata.streaming.fold import windowed_counts

    counts = windowed_counts(_tables(spark, sf_dir)("events"))
    return counts.select(F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n")


@_query("select user_id, cast(sum(cast(round(value * 100) as bigint)) as double) as total, count(*) as number from events group by 1")
def streaming_fold(spark, sf_dir):
    """The event values of each user, folded as a stream that announces each user's number of events."""
    from strata.streaming.replay import replayed_user_fold

    return replayed_user_fold(spark, sf_dir, _folder(spark))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: fn for k, (fn, _) in _found.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _found.items() if sql}


__all__ = ["Execution", "oracle_sql", "queries"]

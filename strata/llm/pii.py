"""Personal data: candidates of high recall, scored by boosted trees. DataFrame functions only.

Patterns propose spans of four kinds; checked patterns (the base) always stay.
Looser patterns propose more, and so do parts of refused matches: a number that
runs on into an address or a card is also cut before that, a phone of more than
15 digits after at most 15, a card at its last separator that leaves 12 to 19.
Each candidate has format and context features, small whole numbers, and a label
that no feature holds: whether its value is sound (octets, check digit, e-mail
with its disguise removed, numbering plan) and clear of the base. One native
aggregate counts all candidates of the corpus by feature values and label;
boosted trees are fitted on that table, whose size is bounded by the product of
the features' ranges, and become CASE expressions. Sound candidates outside the
base are added where the score of their format and context reaches the threshold
of their kind; an addition that overlaps a likelier one (of equal ones: an earlier,
then a longer one) goes. Spans are placed and compared by running totals in
blocks and by bisection, so that a text of very many matches costs little more
than in proportion.

Positions are code points, end exclusive. Null text counts as empty, without
spans; repeated rows get equal results; an empty table gives an empty result
(and a model without trees, which adds nothing). ``find_personal_data`` ignores
extra columns, ``redacted`` keeps them.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.common import stored

KINDS = ("email", "ip", "card", "phone")
TREES = 25
RATE = 0.3
#: Code points of the pages that redaction cuts a text into, so as not to count from its beginning for every span.
PAGE = 4096
#: Elements whose running totals are computed one by one.
BLOCK = 64
#: Additions of a kind need a score at which at least this share of all candidates that reach it are sound.
PRECISION = 0.9

# Possessive quantifiers and the look-behind keep each pattern linear; they find what the plain forms find.
_LOCAL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++"
EMAIL = _LOCAL + r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
LOOSE_EMAIL = _LOCAL + r"(?:@|\x20?(?:\(at\)|\[at\])\x20?)[A-Za-z0-9-]++(?:(?:\.|\x20?(?:\(dot\)|\[dot\])\x20?)[A-Za-z0-9-]++)++"
LOOSE_PHONE = r"(?<![0-9+])\+?[0-9(][\x20()./0-9-]{5,28}[0-9](?![0-9])"
#: Words before a span that speak for or against it, by group.
CONTEXT = (r"(?i)(tel|phone|fon|call|móvil|mobile|fax)\W*$", r"(?i)(card|visa|carte|karte|tarjeta)\W*$", r"(?i)(mail|contact|@)\W*$", r"(?i)(version|v|no|isbn|token|password|key|id)\W*=?\W*$")

#: Features and their numbers of values.
FEATURES = {"kind": 4, "digits": 21, "marks": 5, "dots": 5, "plus": 2, "before": 3, "after": 3, "context": 5, "lead": 10}
#: Parts of refused matches: at most 15 digits of a phone, 12 to 19 of a card, without splitting a run of digits.
SHORT_PHONE = r"^([^0-9]*+[0-9](?:[^0-9]*+[0-9]){8,14})(?![0-9])"
SHORT_CARD = r"^([0-9](?:[\x20-]?[0-9]){11,18})[\x20-]"
#: National numbers without a plus: North American, or with a trunk prefix.
PLAN = r"^(?:1?[2-9][0-9]{2}[2-9][0-9]{6}|0[1-9][0-9]{7,10})$"


def _none() -> Column:
    return F.array().cast("array<struct<start:int,end:int,value:string,before:string,after:string>>")


def _let(value: Column, fn) -> Column:
    """``fn`` of a value that is computed once, however often ``fn`` uses it, even for each element of an array."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def _before(values: Column, merge, zero: int) -> Column:
    """For each element of an integer array, what all elements before it merge to; in blocks, so that the cost is BLOCK for each."""

    def fold(some: Column) -> Column:
        return F.aggregate(some, F.lit(zero), merge)

    def each(v: Column, heads: Column) -> Column:
        return F.transform(v, lambda x, i: merge(F.get(heads, F.floor(i / BLOCK).cast("int")), fold(F.slice(v, i - i % BLOCK + 1, i % BLOCK))))

    def whole(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda b: fold(F.slice(v, b * BLOCK + 1, F.lit(BLOCK))))
        return _let(blocks, lambda sums: _let(F.transform(sums, lambda x, b: fold(F.slice(sums, F.lit(1), b))), lambda heads: each(v, heads)))

    return _let(values, lambda v: F.when(F.size(v) > 0, whole(v)).otherwise(F.array().cast("array<int>")))


def _below(ascending: Column, bound: Column) -> Column:
    """How many elements of an ascending array are under ``bound``, by bisection."""
    steps = F.expr(f"array({','.join(str(1 << k) for k in range(26, -1, -1))})")
    return F.aggregate(steps, F.lit(0), lambda at, k: F.when(F.get(ascending, at + k - 1) < bound, at + k).otherwise(at))


def _starts(spans: Column) -> Column:
    return F.transform(spans, lambda s: s["start"])


def _others(spans: Column, known: Column) -> Column:
    """Those of ``spans`` that begin or end otherwise than all of ``known``, which don't overlap and ascend."""

    def new(x: Column, starts: Column) -> Column:
        same = F.get(known, _below(starts, x["start"]))
        return F.coalesce((same["start"] != x["start"]) | (same["end"] != x["end"]), F.lit(True))

    return _let(_starts(known), lambda starts: F.filter(spans, lambda x: new(x, starts)))


def _matched(df: DataFrame, patterns: dict[str, tuple[str, Column]]) -> DataFrame:
    """Adds the matches of each (pattern, condition) as a column; a pattern runs once for the pieces and once for the values, only where its condition holds."""
    text = F.col("__text")
    df = df.withColumns({f"__m{k}": F.when(when, F.regexp_extract_all(text, F.lit(p), F.lit(0))) for k, (p, when) in enumerate(patterns.values())})
    df = df.withColumns({f"__p{k}": F.when(F.size(f"__m{k}") > 0, F.split(text, p, -1)) for k, (p, _) in enumerate(patterns.values())})

    def spans(values: Column, pieces: Column) -> Column:
        def placed(p: Column, gaps: Column) -> Column:
            lengths = F.transform(values, lambda v, i: F.get(gaps, i) + F.length(v))
            at = _before(lengths, lambda a, b: a + b, 0)
            return _let(at, lambda past: F.transform(values, lambda v, i: _placed(v, F.get(past, i) + F.get(gaps, i), F.right(F.get(p, i), F.lit(24)), F.substring(F.get(p, i + 1), 1, 1))))

        return F.when(F.size(values) > 0, _let(pieces, lambda p: _let(F.transform(p, F.length), lambda gaps: placed(p, gaps)))).otherwise(_none())

    df = df.withColumns({name: spans(F.col(f"__m{k}"), F.col(f"__p{k}")) for k, name in enumerate(patterns)})
    return df.drop(*(f"__{c}{k}" for k in range(len(patterns)) for c in "mp"))


def _placed(value: Column, start: Column, before: Column, after: Column) -> Column:
    return F.struct(start.alias("start"), (start + F.length(value)).alias("end"), value.alias("value"), before.alias("before"), after.alias("after"))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)))
    return F.aggregate(each, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda x: F.when(F.length(F.ltrim(x, F.lit("0"))) <= 3, F.right(x, F.lit(3)).cast("int") <= 255).otherwise(False))
    d = _digits(value)
    if kind == "card":
        return F.when(F.length(d).between(12, 19), _luhn(d)).otherwise(False)
    return F.length(d).between(9, 15)


def _sound(kind: int, value: Column) -> Column:
    """Whether the value itself holds, however it is written."""
    if KINDS[kind] == "email":
        plain = F.regexp_replace(F.regexp_replace(value, r"\x20?(?:\(at\)|\[at\])\x20?", "@"), r"\x20?(?:\(dot\)|\[dot\])\x20?", ".")
        return plain.rlike(r"^[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+(?<=\.[A-Za-z]{2,24})$")
    if KINDS[kind] != "phone":
        return _valid(KINDS[kind], value)
    return F.when(value.startswith("+"), _valid("phone", value)).otherwise(_digits(value).rlike(PLAN))


def _part(x: Column, value: Column) -> Column:
    """The span of the first characters of ``x`` that ``value`` holds."""
    own = F.length(value)
    return F.struct(x["start"].alias("start"), (x["start"] + own).alias("end"), value.alias("value"), x["before"].alias("before"), F.substring(x["value"], own + 1, F.lit(1)).alias("after"))


def _before_next(x: Column, starts: Column) -> Column:
    """The part of ``x`` before the first of ``starts`` (addresses and cards of the base) inside it."""
    inside = F.get(starts, _below(starts, x["start"] + 1))
    cut = F.when(inside < x["end"], inside - x["start"]).otherwise(0)
    return _part(x, F.regexp_extract(F.substring(x["value"], F.lit(1), cut), "^(.*[0-9])", 1))


def _hits(ends: Column, starts: Column, x: Column) -> Column:
    """Whether ``x`` overlaps a span of those that ``starts`` has, in order, and ``ends``, the largest end up to each."""
    return F.coalesce(F.get(ends, _below(starts, x["end"]) - 1) > x["start"], F.lit(False))


def _largest_ends(spans: Column) -> Column:
    """The largest end up to each of ``spans``."""
    ends = F.transform(spans, lambda s: s["end"])
    return _let(_before(ends, lambda a, b: F.greatest(a, b), 0), lambda past: F.transform(ends, lambda e, i: F.greatest(e, F.get(past, i))))


def _class(ch: Column) -> Column:
    return F.when(ch.rlike(r"^[\p{L}_=\"]"), 1).when(ch.rlike("^[0-9]"), 2).otherwise(0)


def _candidate(kind: int, x: Column, accepted: Column, base: Column) -> Column:
    value, d = x["value"], F.length(_digits(x["value"]))
    context = reduce(lambda out, k: out.when(x["before"].rlike(CONTEXT[k]), k + 1), range(1, len(CONTEXT)), F.when(x["before"].rlike(CONTEXT[0]), 1)).otherwise(0)
    return F.struct(
        x["start"].alias("start"), x["end"].alias("end"), F.lit(kind).alias("kind"),
        F.least(d, F.lit(20)).alias("digits"), F.least(F.length(F.regexp_replace(value, r"[^\x20()/-]", "")), F.lit(4)).alias("marks"),
        F.least(F.length(F.regexp_replace(value, r"[^.]", "")), F.lit(4)).alias("dots"), F.when(value.startswith("+"), 1).otherwise(0).alias("plus"),
        _class(F.right(x["before"], F.lit(1))).alias("before"), _class(x["after"]).alias("after"), context.alias("context"),
        F.coalesce(F.regexp_extract(value, "([0-9])", 1).try_cast("int"), F.lit(0)).alias("lead"),
        accepted.alias("accepted"), (_sound(kind, value) & (accepted | ~_hits(base["ends"], base["starts"], x))).alias("sound"),
    )


def with_candidates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with __base (start, kind number, end of the checked patterns' spans) and __cand (all candidates with features)."""
    df = docs.withColumn("__text", F.coalesce(F.col(text_col), F.lit("")))
    df = df.withColumn("__digit", F.col("__text").rlike("[0-9]"))
    at, plus, digit = F.contains("__text", F.lit("@")), F.contains("__text", F.lit("+")), F.col("__digit")
    hidden = F.col("__text").rlike(r"(?:\(at\)|\[at\])")
    strict = {"__email": (EMAIL, at), "__ip": (IP, digit), "__card": (CARD, digit), "__phone": (PHONE, plus & digit)}
    df = _matched(df, strict | {"__loose_email": (LOOSE_EMAIL, hidden), "__loose_phone": (LOOSE_PHONE, digit)})

    def checked(k: int, kind: str) -> Column:
        good = F.filter(f"__{kind}", lambda x: _valid(kind, x["value"]))
        return F.transform(good, lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("kind"), x["end"].alias("end")))

    def proposed(k: int, spans: Column, strict: bool) -> Column:
        return F.transform(spans, lambda x: _candidate(k, x, _valid(KINDS[k], x["value"]) if strict else F.lit(False), F.col("__ahead")))

    df = df.withColumn("__base", F.array_sort(F.concat(*(checked(k, kind) for k, kind in enumerate(KINDS)))))
    # A loose form that the strict pattern also proposes would count twice.
    ahead = F.struct(_largest_ends(F.col("__base")).alias("ends"), _starts(F.col("__base")).alias("starts"))
    df = df.withColumns({"__ahead": ahead} | {f"__loose_{kind}": _others(F.col(f"__loose_{kind}"), F.col(f"__{kind}")) for kind in ("email", "phone")})
    refused = F.concat(F.filter("__phone", lambda x: ~_valid("phone", x["value"])), F.col("__loose_phone"))
    long = F.filter("__phone", lambda x: F.length(_digits(x["value"])) > 15)
    numbers = _starts(F.filter("__base", lambda s: s["kind"].isin(1, 2)))
    parts = F.concat(_let(numbers, lambda starts: F.transform(refused, lambda x: _before_next(x, starts))), F.transform(long, lambda x: _part(x, F.regexp_extract(x["value"], SHORT_PHONE, 1))))
    parts = F.array_sort(F.filter(parts, lambda x: F.length(_digits(x["value"])) >= 7))
    once = _let(parts, lambda p: F.filter(p, lambda x, i: (i == 0) | (x != F.get(p, i - 1))))
    whole = F.filter("__card", lambda x: (F.length(_digits(x["value"])) > 12) & ~_valid("card", x["value"]))
    short = F.filter(F.transform(whole, lambda x: _part(x, F.regexp_extract(x["value"], SHORT_CARD, 1))), lambda x: x["end"] > x["start"])
    df = df.withColumns({"__phone_part": F.when(F.size(refused) > 0, once).otherwise(_none()), "__card_part": short})
    wide = F.filter("__card", lambda x: F.length(_digits(x["value"])) >= 7)
    strict = [proposed(k, wide if kind == "card" else F.col(f"__{kind}"), True) for k, kind in enumerate(KINDS)]
    fresh = F.concat("__loose_phone", _others(F.col("__phone_part"), F.col("__loose_phone")))
    loose = [proposed(k, spans, False) for k, spans in ((0, F.col("__loose_email")), (2, F.col("__card_part")), (3, fresh))]
    df = df.withColumn("__cand", F.concat(*strict, *loose))
    return df.drop("__text", "__digit", "__loose_email", "__loose_phone", "__phone_part", "__card_part", "__ahead", *(f"__{k}" for k in KINDS))


@dataclass
class Trees:
    """Boosted trees over the features, as (feature, bound, (feature, bound, low, high), (feature, bound, low, high)); a feature at most its bound goes low."""

    start: float = -5.0
    trees: list[tuple] = field(default_factory=list)
    thresholds: tuple[float, ...] = (2.0,) * len(KINDS)

    def margin(self, rows: np.ndarray) -> np.ndarray:
        names = list(FEATURES)
        out = np.full(len(rows), self.start)
        for f, b, low, high in self.trees:
            for side, mask in ((low, rows[:, names.index(f)] <= b), (high, rows[:, names.index(f)] > b)):
                g, c, x, y = side
                out[mask] += np.where(rows[mask][:, names.index(g)] <= c, x, y)
        return out

    def score(self, c: Column) -> Column:
        total = F.lit(self.start)
        for f, b, (g, gb, gx, gy), (h, hb, hx, hy) in self.trees:
            total = total + F.when(c[f] <= b, F.when(c[g] <= gb, gx).otherwise(gy)).otherwise(F.when(c[h] <= hb, hx).otherwise(hy))
        return 1 / (1 + F.exp(-total))


def _best_split(rows: np.ndarray, gradient: np.ndarray, weight: np.ndarray) -> tuple[int, int, float, float]:
    """(feature, bound, low step, high step) of the split that gains most; ties go to the first."""
    best = (-1.0, 0, 0, 0.0, 0.0)
    for f in range(rows.shape[1]):
        size = int(rows[:, f].max(initial=0)) + 1
        g, h = np.bincount(rows[:, f], gradient, size).cumsum(), np.bincount(rows[:, f], weight, size).cumsum()
        for b in range(size):
            gl, hl, gr, hr = g[b], h[b] + 1, g[-1] - g[b], h[-1] - h[b] + 1
            gain = gl * gl / hl + gr * gr / hr
            if gain > best[0] + 1e-9:
                best = (gain, f, b, gl / hl, gr / hr)
    return best[1:]


def fit_trees(table: list[tuple], trees: int = TREES, rate: float = RATE) -> Trees:
    """``table``: feature values in the order of FEATURES, then counts of sound and of other candidates."""
    model, names = Trees(), list(FEATURES)
    if not table:
        return model
    a = np.array(sorted(table), dtype=np.int64)
    rows, yes, no = a[:, : len(names)], a[:, -2].astype(float), a[:, -1].astype(float)
    model.start = float(np.log((yes.sum() + 0.5) / (no.sum() + 0.5)))
    margin = np.full(len(rows), model.start)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        gradient, weight = yes - (yes + no) * p, (yes + no) * p * (1 - p)
        f, b, *_ = _best_split(rows, gradient, weight)
        sides = []
        for mask in (rows[:, f] <= b, rows[:, f] > b):
            g, c, x, y = _best_split(rows[mask], gradient[mask], weight[mask]) if mask.any() else (0, 0, 0.0, 0.0)
            sides.append((names[g], int(c), round(rate * float(np.clip(x, -4, 4)), 6), round(rate * float(np.clip(y, -4, 4)), 6)))
        model.trees.append((names[f], int(b), *sides))
        margin = model.margin(rows)
    p, bounds = 1 / (1 + np.exp(-margin)), []
    for k in range(len(KINDS)):
        mine = np.flatnonzero(rows[:, 0] == k)
        order, bound, got, all_ = mine[np.argsort(-p[mine], kind="stable")], 2.0, 0.0, 0.0
        for i in order:
            got, all_ = got + yes[i], all_ + yes[i] + no[i]
            if got / all_ >= PRECISION:
                bound = max(0.5, float(p[i]) - 1e-9)
        bounds.append(bound)
    model.thresholds = tuple(bounds)
    return model


def train_trees(candidates: DataFrame) -> Trees:
    """Counts all candidates (column __cand) by feature values and fits; the table's size is bounded by the features' ranges."""
    # the outer form: for the plain one, Spark would compute the candidates once more, for a filter on their number
    each = candidates.select(F.explode_outer("__cand").alias("c")).where(F.col("c").isNotNull())
    names = [F.col("c")[f].alias(f) for f in FEATURES]
    counts = each.groupBy(*names).agg(F.sum(F.col("c.sound").cast("long")), F.sum((~F.col("c.sound")).cast("long")))
    return fit_trees([tuple(r) for r in counts.collect()])


def with_spans(candidates: DataFrame, model: Trees) -> DataFrame:
    """Adds __spans: (start, kind number, end) of the base and of the additions, in order."""
    bounds = F.array(*map(F.lit, model.thresholds))
    scored = F.transform(F.filter("__cand", lambda c: ~c["accepted"] & c["sound"]), lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"), (-model.score(c)).alias("rank")))
    over = F.array_sort(F.filter(scored, lambda c: -c["rank"] >= F.get(bounds, c["kind"])))

    def order(c: Column) -> Column:
        return F.struct(c["rank"], c["start"], -c["end"], c["kind"])

    def kept(all_: Column) -> Column:
        def stays(spans: Column, ends: Column, starts: Column) -> Column:
            def near(x: Column) -> Column:  # all that overlap x lie in this range
                first = _below(ends, x["start"] + 1)
                return F.slice(spans, first + 1, F.greatest(F.lit(0), _below(starts, x["end"]) - first))

            return F.filter(spans, lambda x: ~F.exists(near(x), lambda y: (y["end"] > x["start"]) & (order(y) < order(x))))

        return _let(_largest_ends(all_), lambda ends: _let(_starts(all_), lambda starts: stays(all_, ends, starts)))

    added = _let(over, lambda all_: F.transform(kept(all_), lambda c: F.struct(c["start"], c["kind"], c["end"])))
    return candidates.withColumn("__over", F.exists("__cand", lambda c: ~c["accepted"] & c["sound"])).withColumn("__spans", F.when(F.col("__over"), F.array_sort(F.concat("__base", added))).otherwise(F.col("__base"))).drop("__over")


def _listed(spans: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, base and all spans (arrays of start, kind, end) of every document."""
    candidates = stored(with_candidates(docs.select(id_col, text_col), text_col).select(id_col, "__base", "__cand"), "candidates")
    found = with_spans(candidates, train_trees(candidates))
    return found.select(id_col, F.col("__base").alias("base"), F.col("__spans").alias("spans"))


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every document."""
    found = find_personal_data(docs)

    def number(k: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")

    counts = [number(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(_listed("base"), 256).alias("base_sha256"), _listed("spans").alias("spans"))


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets; overlapping spans are replaced together, under the first one's kind."""
    kept = docs.columns
    candidates = stored(with_candidates(docs, text_col), "candidates")
    found = with_spans(candidates, train_trees(candidates))
    names, text = F.array(*map(F.lit, KINDS)), F.col(text_col)

    def cut(pages: Column, start: Column, past: Column) -> Column:
        """Characters from ``start`` up to ``past``, from the few pages that have them."""
        first = F.floor(start / PAGE).cast("int")
        some = F.slice(pages, first + 1, F.floor(past / PAGE).cast("int") - first + 1)
        return F.substring(F.array_join(some, ""), start - first * PAGE + 1, past - start)

    def pieces(pages: Column, spans: Column, ends: Column) -> Column:
        """What is between the spans, each time with the kind of the one behind it; then the rest."""

        def piece(s: Column, i: Column) -> Column:
            past = F.coalesce(F.get(ends, i - 1), F.lit(0))
            return F.when(s["start"] >= past, F.concat(cut(pages, past, s["start"]), F.lit("<"), F.get(names, s["kind"]), F.lit(">"))).otherwise("")

        return F.concat(F.array_join(F.transform(spans, piece), ""), cut(pages, F.get(ends, F.size(ends) - 1), F.length(text)))

    pages = F.transform(F.sequence(F.lit(0), F.floor(F.length(text) / PAGE).cast("int")), lambda k: F.substring(text, k * PAGE + 1, F.lit(PAGE)))
    new = _let(pages, lambda p: _let(_largest_ends(F.col("__spans")), lambda ends: pieces(p, F.col("__spans"), ends)))
    return found.withColumn(text_col, F.when(F.size("__spans") > 0, new).otherwise(text)).select(*kept)

"""Toxicity by maximum-scoring segments.

Every word has a log-odds weight, toxic against clean text, under an
informative Dirichlet prior; a word seen too rarely falls back to the weight of
its first letters. Words that tell nothing get a small negative score. One
linear scan (all maximal scoring segments) finds the toxic passages of a whole
text; Karlin-Altschul statistics of the scores turn each segment's score into an
expected number of chance segments, and those below a bound are significant.
The text's score is a logistic calibration of its segments' bit scores.

Null and empty texts have no segments and get the score of such texts. Ties and
repeated rows get equal results; extra columns are ignored; an empty table gives
an empty result. Without labels of both kinds no word weighs anything. In the
calibration the labels weigh as they do among all labelled rows, whatever the
sample's bounds leave of them.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from math import exp, log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import fold_of, logistic, lowest_by_hash, sample_of, sigmoid, small_batches

#: Labelled texts of each label that may be fetched to fit the model, and code points (from the middle) of each. Texts are scored whole.
SAMPLE_PER_LABEL = 1500
SAMPLE_CHARS = 20_000
#: Total weight of the Dirichlet prior, spread as the words of all sampled text are.
PRIOR_WEIGHT = 500.0
#: Log-odds count only beyond so many standard deviations; weaker words score BACKGROUND.
LEAST_Z = 2.5
LEAST_LOG_ODDS = 1.0
LEAST_SEEN = 3
BACKGROUND = -0.12
PREFIXES = (6, 5, 4)
#: A prefix weighs only if it stands for at least so many different toxic words.
PREFIX_WORDS = 3
#: Segments are significant below this expected number of chance segments.
MOST_EXPECTED = 1e-2
#: Most words whose weights a worker remembers.
CACHED_WORDS = 400_000

WORDS = re.compile(r"[^\W_]+")


@dataclass
class ToxicityModel:
    words: dict[str, float] = field(default_factory=dict)
    prefixes: dict[str, float] = field(default_factory=dict)
    #: Karlin-Altschul parameters of the word scores in clean text.
    decay: float = 1.0
    factor: float = 0.1
    weights: tuple[float, ...] = (0.0, 0.0, 0.0)

    def __post_init__(self):
        self.cache: dict[str, float] = {}

    def token_weight(self, token: str) -> float:
        """Of a token as it stands between white space: what its toxic words weigh together."""
        found = [w for x in WORDS.findall(token.lower()) if (w := self.weight(x)) > 0]
        return sum(found) if found else BACKGROUND

    def weight(self, word: str) -> float:
        w = self.words.get(word)
        if w is None:
            for n in PREFIXES:
                if len(word) > n and (w := self.prefixes.get(word[:n])) is not None:
                    return w
            return BACKGROUND
        return w


def log_odds(toxic: Counter, clean: Counter, prior_weight: float = PRIOR_WEIGHT) -> dict[str, tuple[float, float]]:
    """(log-odds, z) of every key under a Dirichlet prior proportional to the overall counts."""
    both = toxic + clean
    total, nt, nc = sum(both.values()), sum(toxic.values()), sum(clean.values())
    out = {}
    for k, n in both.items():
        a = prior_weight * n / total
        yt, yc = toxic[k] + a, clean[k] + a
        d = log(yt / (nt + prior_weight - yt)) - log(yc / (nc + prior_weight - yc))
        out[k] = d, d / sqrt(1 / yt + 1 / yc)
    return out


def maximal_segments(positions: list[int], scores: list[float], background: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments as (first, last, score), in linear time.

    ``positions`` ascend and hold every word whose score isn't ``background``.
    """
    kept: list[list[float]] = []  # first, last, left sum, right sum
    total, at = 0.0, -1
    for p, s in zip(positions, scores):
        total += background * (p - at - 1)
        at, before = p, total
        total += s
        if s <= 0:
            continue
        new = [p, p, before, total]
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= new[2]:
                j -= 1
            if j < 0 or kept[j][3] >= new[3]:
                kept.append(new)
                break
            new = [kept[j][0], new[1], kept[j][2], new[3]]
            del kept[j:]
    return [(int(a), int(b), r - left) for a, b, left, r in kept]


def _scored(model: ToxicityModel, tokens: list[str]) -> tuple[list[int], list[float]]:
    cache = model.cache
    if len(cache) > CACHED_WORDS:
        cache.clear()
    values = list(map(cache.get, tokens))
    if None in values:
        for i, v in enumerate(values):
            if v is None:
                values[i] = cache[tokens[i]] = model.token_weight(tokens[i])
    a = np.array(values)
    at = np.flatnonzero(a != BACKGROUND)
    return at.tolist(), a[at].tolist()


def _significant(model: ToxicityModel, tokens: list[str]) -> list[tuple[int, int, float, float]]:
    if not tokens or not (model.words or model.prefixes):
        return []
    positions, scores = _scored(model, tokens)
    found = []
    for a, b, s in maximal_segments(positions, scores, BACKGROUND):
        expected = model.factor * len(tokens) * exp(-min(600.0, model.decay * s))
        if expected <= MOST_EXPECTED:
            found.append((a, b, s, expected))
    return found


def segments_of(model: ToxicityModel, text: str | None) -> list[tuple[int, int, float, float]]:
    """Significant passages (first, last token between white space, score, expected number by chance) of a whole text."""
    return _significant(model, text.split()) if text else []


def _features(found: list[tuple[int, int, float, float]]) -> tuple[float, float]:
    """Bits of the least likely segment, and of all."""
    bits = [-log(max(e, 1e-300)) for *_, e in found]
    return log(1 + max(bits, default=0.0)), log(1 + sum(bits))


def toxicity_of(model: ToxicityModel, text: str | None) -> tuple[float, int, float]:
    """Score 0 to 1, number of significant passages, and the best passage's score."""
    found = segments_of(model, text)
    w0, w1, w2 = model.weights
    a, b = _features(found)
    return float(sigmoid(w0 + w1 * a + w2 * b)), len(found), max((s for *_, s, _ in found), default=0.0)


def _karlin(values: Counter) -> tuple[float, float]:
    """Decay and factor for scores drawn as ``values`` counts them: the positive root of E[exp(x s)] = 1."""
    total = sum(values.values())
    s, p = np.array(list(values)), np.array(list(values.values())) / total
    if s.max(initial=-1.0) <= 0 or (s * p).sum() >= 0:
        return 1.0, 1.0
    low, high = 1e-6, 1.0
    f = lambda x: float((p * np.exp(np.clip(x * s, -700, 700))).sum()) - 1
    while f(high) < 0 and high < 1e3:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    decay = (low + high) / 2
    slope = float((p * s * np.exp(np.clip(decay * s, -700, 700))).sum())
    return decay, min(1.0, abs(float((p * s).sum())) ** 2 * decay / max(slope, 1e-9)) or 1e-6


def _contexts(texts: list[list[str]]) -> set[tuple[str, str, str]]:
    """Each word between its neighbours, once: copies of a passage, in one text or in many, count as one."""
    return {x for t in texts for x in zip(["", *t], t, [*t[1:], ""])}


def _fit_words(texts: dict[int, list[list[str]]]) -> ToxicityModel:
    model = ToxicityModel()
    found = {y: _contexts(texts[y]) for y in (0, 1)}
    toxic, clean = (Counter(w for _, w, _ in found[y]) for y in (1, 0))
    model.words = {w: d for w, (d, z) in log_odds(toxic, clean).items() if d > LEAST_LOG_ODDS and z >= LEAST_Z and toxic[w] >= LEAST_SEEN}
    for n in PREFIXES:
        heads = [Counter(w[:n] for _, w, _ in found[y] if len(w) > n) for y in (1, 0)]
        kinds = Counter(w[:n] for w in toxic if len(w) > n)
        for h, (d, z) in log_odds(*heads).items():
            if d > LEAST_LOG_ODDS and z >= LEAST_Z and kinds[h] >= PREFIX_WORDS:
                model.prefixes[h] = d
    values = Counter()
    for w, n in clean.items():
        values[round(model.weight(w), 2)] += n
    top = max([1.0, *model.words.values(), *model.prefixes.values()])
    values[round(top, 2)] += 1  # a chance hit that the sample may lack
    model.decay, model.factor = _karlin(values)
    return model


def fit_toxicity(sample: list[tuple[str, int]], share: float | None = None) -> ToxicityModel:
    """The model of a bounded list of (text, label 0 or 1); ``share``: of label 1 where the sample comes from (None: as in the sample). Each half of the texts calibrates the words learned from the other."""
    texts = {y: [WORDS.findall(t.lower()) for t, label in sample if label == y and t] for y in (0, 1)}
    if len(texts[0]) < 2 or len(texts[1]) < 2:
        return ToxicityModel()
    rows, labels = [], []
    for half in (0, 1):
        part = _fit_words({y: texts[y][half::2] for y in (0, 1)})
        for y in (0, 1):
            for t in texts[y][1 - half :: 2]:
                rows.append(_features(_significant(part, t)))
                labels.append(y)
    model = _fit_words(texts)
    model.weights = tuple(map(float, logistic(np.array(rows), np.array(labels, dtype=float), ridge=1e-2, share=float(np.mean(labels)) if share is None else share)))
    return model


def train_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", keep=None) -> ToxicityModel:
    """Fits on at most SAMPLE_PER_LABEL labelled texts of each label; ``keep`` is a condition on the labels' rows."""
    lab = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    lab = lab.where(keep) if keep is not None else lab
    lab = lab.select(F.col(id_col), F.col(label_col)).groupBy(id_col).agg(F.max(label_col).alias(label_col))
    n = {r[0]: r[1] for r in lab.groupBy(label_col).count().collect()}
    share = (n.get(1, 0) + 0.5) / (sum(n.values()) + 1)
    picked = [lowest_by_hash(lab.where(F.col(label_col) == y), id_col, SAMPLE_PER_LABEL) for y in (0, 1)]
    return fit_toxicity(sample_of(docs, picked[0].unionByName(picked[1]), id_col, text_col, SAMPLE_CHARS), share)


def with_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text", out: str = "toxicity") -> DataFrame:
    """``docs`` with a struct column ``out``: score, segments, best; a column of that name is replaced."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("score double, segments long, best double")
    def score(texts):
        import pandas as pd

        return pd.DataFrame([toxicity_of(shared.value, t) for t in texts], columns=["score", "segments", "best"])

    return docs.withColumn(out, score(F.col(text_col)))


def toxic_passages(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per significant passage: id, first and last word number, score, expected number by chance."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            rows = [(i, *s) for i, t in enumerate(texts) for s in segments_of(shared.value, t)]
            at, *cols = map(list, zip(*rows)) if rows else ([], [], [], [], [])
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.float64())))], names=["id", "first_word", "last_word", "score", "expected"])

    kind = dict(docs.select(id_col).dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(scan, f"id {kind}, first_word long, last_word long, score double, expected double").withColumnRenamed("id", id_col)


def score_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted, segments of every document; labels of the held-out fold are never read."""
    model = train_toxicity(docs, labels, keep=fold_of("doc_id", folds) != held)
    scored = with_toxicity(docs.select("doc_id", "text"), model)
    s = F.col("toxicity")
    return scored.select("doc_id", F.coalesce(fold_of("doc_id", folds) == held, F.lit(False)).alias("held_out"), s["score"].alias("score"), (s["score"] >= threshold).cast("int").alias("predicted"), s["segments"].alias("n_segments"))

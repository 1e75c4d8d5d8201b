"""Quality classifier by compression.

Two zstandard dictionaries are built, one from well-rated and one from badly
rated text. A text is compressed with both, in blocks, whole; the normalised
difference of the two sizes, with the text's own redundancy, goes through a
logistic calibration fitted on labelled texts that built no dictionary.

Both labels weigh alike in the fit, however many rows each has: the score is
calibrated for as many good as bad texts. Null and empty texts compress to
nothing: their score says how much commoner such texts are among the good ones
than among the bad ones of the sample (0.5 if it has none). Ties and repeated
rows get equal scores. An empty table gives an empty result; extra columns are
ignored by ``score_quality`` and kept by ``with_quality``. With fewer than four
texts of either label every score is that of an empty text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from strata.llm.common import fold_of, logistic, lowest_by_hash, sample_of, sigmoid, small_batches

#: Labelled texts of each label that may be fetched to fit the model, and code points (from the middle) of each. Texts are scored whole.
SAMPLE_PER_LABEL = 1500
SAMPLE_CHARS = 50_000
#: Every second sampled text of a label gives an equal share of its dictionary, from its middle.
DICTIONARY_BYTES = 1 << 16
BLOCK = 1024
LEVEL = 6


@dataclass
class QualityModel:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]
    centre: tuple[float, ...]
    scale: tuple[float, ...]
    empty: float


class _Sizes:
    """Sums of compressed block sizes under both dictionaries."""

    def __init__(self, model: QualityModel):
        self.by = []
        for content in (model.good, model.bad):
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.by.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))

    def features(self, text: str) -> tuple[float, ...] | None:
        raw = text.encode("utf-8", "replace")
        if not raw:
            return None
        sizes = []
        for c in self.by:
            compress = c.compress
            sizes.append(sum(len(compress(raw[i : i + BLOCK])) for i in range(0, len(raw), BLOCK)))
        good, bad = sizes
        difference = (bad - good) / (bad + good)
        redundancy = float(np.log(min(good, bad) / len(raw)))
        return difference, redundancy, redundancy * redundancy, difference * redundancy, difference * difference


def _dictionary(texts: list[str]) -> bytes:
    """Raw dictionary content: equal shares of the texts, in turn, up to DICTIONARY_BYTES."""
    share = max(256, DICTIONARY_BYTES // max(1, len(texts)))
    parts, total = [], 0
    for t in texts:
        raw = t.encode("utf-8", "replace")
        middle = max(0, (len(raw) - share) // 2)
        parts.append(raw[middle : middle + share])
        total += len(parts[-1])
        if total >= DICTIONARY_BYTES:
            break
    return b"".join(parts)[-DICTIONARY_BYTES:]


def fit_quality(sample: list[tuple[str, int]]) -> QualityModel:
    """The model of a bounded list of (text, label 0 or 1). Every second text of a label builds its dictionary, the others calibrate."""
    by = {y: [t for t, label in sample if label == y and t] for y in (0, 1)}
    bad, good = ((sum(label == y for _, label in sample) - len(by[y]) + 0.5) / (sum(label == y for _, label in sample) + 1) for y in (0, 1))
    model = QualityModel(b"", b"", (), (), (), good / (good + bad))
    if min(len(by[0]), len(by[1])) < 4:
        return model
    model.good, model.bad = (_dictionary(by[y][::2]) for y in (1, 0))
    sizes = _Sizes(model)
    rows = [(sizes.features(t), y) for y in (0, 1) for t in by[y][1::2]]
    x, y = np.array([r for r, _ in rows]), np.array([v for _, v in rows], dtype=float)
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    w = logistic((x - centre) / scale, y)
    model.weights, model.centre, model.scale = tuple(w), tuple(centre), tuple(scale)
    return model


def quality_of(model: QualityModel, texts) -> np.ndarray:
    """Scores 0 to 1 of texts (None: empty)."""
    out = np.full(len(texts), model.empty)
    if not model.weights:
        return out
    sizes, w = _Sizes(model), np.array(model.weights)
    for i, t in enumerate(texts):
        if t and (f := sizes.features(t)):
            out[i] = sigmoid(w[0] + w[1:] @ ((np.array(f) - model.centre) / model.scale))
    return out


def train_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", keep=None) -> QualityModel:
    """Fits on at most SAMPLE_PER_LABEL labelled texts of each label; ``keep`` is a condition on the labels' rows."""
    lab = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    lab = lab.where(keep) if keep is not None else lab
    lab = lab.select(F.col(id_col), F.col(label_col)).groupBy(id_col).agg(F.max(label_col).alias(label_col))
    picked = [lowest_by_hash(lab.where(F.col(label_col) == y), id_col, SAMPLE_PER_LABEL) for y in (0, 1)]
    return fit_quality(sample_of(docs, picked[0].unionByName(picked[1]), id_col, text_col, SAMPLE_CHARS))


def with_quality(docs: DataFrame, model: QualityModel, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with its columns and the score; a column named ``out`` is replaced."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(DoubleType())
    def score(texts):
        import pandas as pd

        return pd.Series(quality_of(shared.value, texts.tolist()))

    return docs.withColumn(out, score(F.col(text_col)))


def score_quality(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; labels of the held-out fold are never read."""
    model = train_quality(docs, labels, keep=fold_of("doc_id", folds) != held)
    scored = with_quality(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", F.coalesce(fold_of("doc_id", folds) == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

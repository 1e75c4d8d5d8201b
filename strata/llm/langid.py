"""Language identification by error-correcting output codes.

Each language gets a codeword; one binary classifier per bit weighs hashed byte
n-grams (naive-Bayes log-odds between the languages on either side of the bit).
A text's margins, one per bit, are averaged over the whole text (fenced: no
n-gram crosses from one text into another), and the codeword of least exponential loss wins. The score is the winner's share of
exp(-loss); a small lead over the runner-up flags ambiguity.

Every language that a labelled text has is learned, each from at most
SAMPLE_PER_LANGUAGE texts, those of smallest hashed id; languages beyond
MOST_LANGUAGES are an error, as the weights would outgrow a worker.

Null texts and texts without a letter are ``und`` with score 0. Ties go to the
alphabetically first language; repeated rows get equal results; extra columns
are ignored; an empty table gives an empty result. Without labelled text every
text is ``und``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import BLOCK_BYTES, fold_of, lowest_by_group, sample_of, small_batches, spans_of_rows, stored, text_buffers

#: Texts fetched to fit, of each language. Of each, SAMPLE_CHARS code points from its middle are learned from (not a bound on predictions).
SAMPLE_PER_LANGUAGE = 600
SAMPLE_CHARS = 20_000
#: More are refused: a table of TABLE_BITS and a bit for each language would be too large to share.
MOST_LANGUAGES = 300
TABLE_BITS = 16
ORDERS = (2, 3, 4)
#: Added to each n-gram count.
SMOOTHING = 0.5
#: Sharpness of the loss: margins are log-odds an n-gram.
SHARPNESS = 4.0
AMBIGUOUS = 0.2

LETTER = regex.compile(r"\p{L}")
_MULTIPLIERS = {2: np.uint32(0x9E3779B1), 3: np.uint32(0x85EBCA77), 4: np.uint32(0xC2B2AE3D)}
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32
_FOLD[:65] = 32
_FOLD[91:97] = 32
_FOLD[123:128] = 32


@dataclass
class LanguageModel:
    languages: list[str]
    codes: np.ndarray  # languages x bits, of -1 and 1
    weights: np.ndarray  # table x bits
    sharpness: float = SHARPNESS


def codewords(k: int) -> np.ndarray:
    """k rows of -1 and 1. Up to 7 languages: the exhaustive code; more: rows of a Hadamard matrix without its constant column."""
    if k < 2:
        return np.ones((k, 1))
    if k <= 7:
        columns = range(1, 2 ** (k - 1))
        rows = [[1] * len(columns)]
        rows += [[-1 if c >> i & 1 else 1 for c in columns] for i in range(k - 1)]
        return np.array(rows, dtype=float)
    h = np.array([[1.0]])
    while len(h) < k + 1:
        h = np.block([[h, h], [h, -h]])
    return h[1 : k + 1, 1:]


PAD = max(ORDERS) - 1


def grams(data: np.ndarray) -> list[np.ndarray]:
    """For each order, the table slot of the n-gram that starts at each byte of one text; zero bytes pad the end."""
    return _grams(np.concatenate([_FOLD[data], np.zeros(PAD, np.uint32)]))


def _grams(b: np.ndarray) -> list[np.ndarray]:
    """The same for folded bytes with PAD more behind them."""
    n = len(b) - PAD
    packed, out = b[:n].copy(), []
    for order in range(2, max(ORDERS) + 1):
        packed = packed << np.uint32(8) | b[order - 1 : order - 1 + n]
        if order in ORDERS:
            out.append((packed + np.uint32(order)) * _MULTIPLIERS[order] >> np.uint32(32 - TABLE_BITS))
    return out


def fit_language(sample: list[tuple[str, str]]) -> LanguageModel:
    """The model of a bounded list of (text, language)."""
    names = sorted({y for _, y in sample})
    size = 1 << TABLE_BITS
    counts = np.zeros((len(names), size))
    for t, y in sample:
        raw = np.frombuffer(t.encode("utf-8", "replace"), dtype=np.uint8)
        for g in grams(raw):
            counts[names.index(y)] += np.bincount(g, minlength=size)
    rates = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
    codes = codewords(len(names))
    weights = np.zeros((size, codes.shape[1]), dtype=np.float32)
    if len(names) > 1:
        least = SMOOTHING / max(1.0, counts.sum() / len(names))
        for bit in range(codes.shape[1]):
            up, down = rates[codes[:, bit] > 0].mean(axis=0), rates[codes[:, bit] < 0].mean(axis=0)
            weights[:, bit] = np.log((up + least) / (down + least))
    return LanguageModel(names, codes, weights)


def margins_of(model: LanguageModel, column: pa.Array) -> np.ndarray:
    """Mean margin of each row and bit, over all n-grams of the whole text."""
    data, offsets = text_buffers(column)
    out = np.zeros((len(column), model.weights.shape[1]))
    for a, b in spans_of_rows(offsets):
        part = data[offsets[a] : offsets[b]]
        lengths = np.diff(offsets[a : b + 1])
        # each text with PAD zero bytes behind it, so that its last n-grams end with it
        fenced = np.zeros(len(part) + PAD * (b - a), np.uint32)
        own = np.arange(len(part)) + PAD * np.repeat(np.arange(b - a), lengths)
        fenced[own] = _FOLD[part]
        full = np.flatnonzero(lengths)
        if not len(full):
            continue
        for i in range(0, len(fenced) - PAD, BLOCK_BYTES) if b - a == 1 else [0]:  # a very long text in pieces
            at = slice(None) if b - a == 1 else own
            rows = sum(model.weights.take(g[at], axis=0) for g in _grams(fenced[i : i + BLOCK_BYTES + PAD] if b - a == 1 else fenced))
            out[a + full] += np.add.reduceat(rows, (offsets[a:b] - offsets[a])[full] if b - a > 1 else [0], axis=0, dtype=np.float64)
        out[a + full] /= lengths[full][:, None] * len(ORDERS)
    return out


def decode(model: LanguageModel, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the best language, its share of exp(-loss), and its lead over the next."""
    if len(model.languages) == 1:
        n = len(margins)
        return np.zeros(n, int), np.ones(n), np.ones(n)
    loss = np.stack([np.exp(np.clip(-model.sharpness * margins * c, -30, 30)).mean(axis=1) for c in model.codes], axis=1)
    share = np.exp(-(loss - loss.min(axis=1, keepdims=True)) * model.sharpness)
    share /= share.sum(axis=1, keepdims=True)
    best = loss.argmin(axis=1)
    top = np.sort(share, axis=1)
    return best, share[np.arange(len(share)), best], top[:, -1] - top[:, -2]


def train_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep=None) -> LanguageModel:
    """Fits on at most SAMPLE_PER_LANGUAGE texts of each language."""
    known = docs.where(F.col(lang_col).isNotNull() & (F.length(text_col) > 0))
    known = known.where(keep) if keep is not None else known
    known = known.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"))
    picked = stored(lowest_by_group(known, "id", "lang", SAMPLE_PER_LANGUAGE), "sample")
    if (n := picked.agg(F.countDistinct("lang")).first()[0]) > MOST_LANGUAGES:
        raise ValueError(f"{n} languages; at most {MOST_LANGUAGES} can be learned")
    return fit_language(sample_of(docs, picked, id_col, text_col, SAMPLE_CHARS))


def with_language(docs: DataFrame, model: LanguageModel, text_col: str = "text", out: str = "language") -> DataFrame:
    """``docs`` with a struct column ``out``: lang, score, ambiguous; a column of that name is replaced."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double, ambiguous boolean")
    def predict(texts):
        import pandas as pd

        m = shared.value
        letters = np.array([bool(t) and LETTER.search(t) is not None for t in texts], dtype=bool)
        if not m.languages:
            letters[:] = False
        lang, score, lead = np.full(len(texts), "und", dtype=object), np.zeros(len(texts)), np.zeros(len(texts))
        if letters.any():
            best, share, gap = decode(m, margins_of(m, pa.array(texts[letters].tolist(), pa.large_string())))
            lang[letters], score[letters], lead[letters] = np.array(m.languages, dtype=object)[best], share, gap
        return pd.DataFrame({"lang": lang, "score": score, "ambiguous": lead < AMBIGUOUS})

    return docs.withColumn(out, predict(F.col(text_col)))


def score_language(docs: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous of every document; only text and lang outside the held-out fold are learned from."""
    model = train_language(docs, keep=fold_of("doc_id", folds) != held)
    s = F.col("language")
    scored = with_language(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", F.coalesce(fold_of("doc_id", folds) == held, F.lit(False)).alias("held_out"), s["lang"].alias("lang_pred"), s["score"].alias("score"), s["ambiguous"].alias("ambiguous"))

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from strata.llm import packing as pk
from strata.llm import token_files as tf
from strata.llm.tokens import encoder, vocabulary


_library = {}


def plain(name, text):
    if name not in _library:
        _library[name] = Tokenizer.from_file(vocabulary(name))
    return _library[name].encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_the_library(name, rows):
    e = encoder(vocabulary(name))
    odd = ["don't  's 're", "a <|endoftext|> b", "<|ENDOFTEXT|>x <|startoftext|>", "<|endoftext|", "\u037e <|endof text|>", "ΑΣ ΑΣ. Σ", "x　 y \x85 z", "e ́x", "1 234,5 -- a-b ...", "éclair", "tab \t\n\r x ", "a​b", "İstanbul Ǆ"]
    for text in [t for _, t in rows[:60]] + [t for _, t in rows[200:]] + odd:
        assert np.frombuffer(e.encode_one(text), "<u4").tolist() == plain(name, text), text


def test_packing(docs, rows):
    got = pk.packed_documents(docs).collect()
    by_doc, by_bin = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_bin.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == {i for i, _ in rows}
    for i, text in rows:
        ids = plain("word_bpe_49k.json", text) + [0]
        parts = sorted(by_doc[i], key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length, r.ids_crc32) for r in parts] == [(k, a, len(ids[a : a + 2048]), crc(ids[a : a + 2048])) for k, a in enumerate(range(0, len(ids), 2048))]
    for members in by_bin.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert len(by_bin) <= -(-sum(r.length for r in got) // 2048) + 2


def test_best_fit_keeps_every_capacity():
    r = np.random.default_rng(3)
    lengths = r.integers(1, 101, 3000)
    for rule in ("norm", "dot"):
        for most, attention in ((1000, None), (3, None), (1000, 3000.0)):
            lens = np.minimum(lengths, 50) if attention else lengths
            bins, offsets = pk.best_fit(lens, 100, most, attention, rule=rule)
            for b in np.unique(bins):
                own = lens[bins == b]
                assert own.sum() <= 100 and len(own) <= most and (len(own) == 1 or (own.astype(float) ** 2).sum() <= (attention or 9375) + 1e-6)
                o = np.sort(offsets[bins == b])
                assert o[0] == 0 and sorted((offsets[bins == b] + own).tolist())[:-1] == o[1:].tolist()
    bins, _ = pk.best_fit(np.array([60, 50, 40, 50]), 100)
    assert len(set(bins.tolist())) == 2
    with pytest.raises(ValueError):
        pk.best_fit(np.array([101]), 100)


def test_default_capacities_bind(spark):
    assert len(set(pk.best_fit(np.array([1900, 148]))[0].tolist())) == 1
    assert len(set(pk.best_fit(np.array([2000, 48]))[0].tolist())) == 2  # attention cost
    assert len(set(pk.best_fit(np.array([2048, 1]))[0].tolist())) == 2
    df = spark.createDataFrame([(i, "") for i in range(300)] + [(300, "some words here " * 100)], "doc_id long, text string")
    by_bin = {}
    for r in pk.packed_documents(df).collect():
        by_bin.setdefault(r.sequence_id, []).append(r.length)
    assert len(by_bin) == 3 and max(map(len, by_bin.values())) == pk.PIECES  # tokens alone would take one


def test_packing_stays_near_the_token_bound():
    g = np.random.default_rng(8)
    for lengths in (g.integers(1, 2049, 6000), np.minimum(2048, g.lognormal(5.5, 1.2, 6000).astype(int) + 1)):
        bins, _ = pk.best_fit(lengths)
        assert len(set(bins.tolist())) <= 1.02 * lengths.sum() / 2048 + 1


def test_sequences_hold_the_ids(docs, rows):
    texts = dict(rows)
    for r in pk.sequences(docs.where("doc_id >= 10000")).collect():
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length <= 2048 and ids[-1] == 0 or len(ids) == 2048
        if len(r.doc_ids) == 1 and r.doc_ids[0] == 10_000:
            assert ids == plain("word_bpe_49k.json", texts[10_000]) + [0]


def test_token_files_round_trip(spark, docs, rows, tmp_path):
    path = f"file://{tmp_path}/tokens"
    tf.write_tokens(docs, path, range_bytes=100_000)
    got = {r.id: r for r in tf.read_tokens(spark, path).collect()}
    start = 0
    for i, text in sorted(rows):
        ids = plain("byte_bpe_50k.json", text) + [2]
        r = got[i]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), crc(ids)) and np.frombuffer(r.ids, "<u4").tolist() == ids
        start += len(ids)
    assert spark.read.parquet(f"{path}/manifest").count() > 1
    sizes = [f.stat().st_size for f in tmp_path.rglob("*.ids")]
    assert len(sizes) > 1 and sum(sizes) == 2 * start


def test_empty_tables_null_and_repeated_ids(spark, no_docs, tmp_path):
    assert pk.packed_documents(no_docs).count() == 0
    assert tf.token_file_digests(no_docs, f"file://{tmp_path}/none").count() == 0
    df = spark.createDataFrame([(None, "b"), (5, "y"), (5, "x"), (5, "x"), (1, None)], "doc_id long, text string")
    got = tf.token_file_digests(df, f"file://{tmp_path}/some").orderBy("start").collect()
    assert [(r.doc_id, r.start, r.n_tokens) for r in got] == [(None, 0, 2), (1, 2, 1), (5, 3, 2), (5, 5, 2), (5, 7, 2)]
    assert pk.packed_documents(df).count() == 5
    same = spark.createDataFrame([(7, "the same")] * 400 + [(None, "null")] * 300, "doc_id long, text string").repartition(3)
    many = tf.token_file_digests(same, f"file://{tmp_path}/same").orderBy("start").collect()
    assert [r.start for r in many[1:]] == [r.start + r.n_tokens for r in many[:-1]] and [r.doc_id for r in many] == [None] * 300 + [7] * 400
    sizes = [r.n_docs for r in spark.read.parquet(f"file://{tmp_path}/same/manifest").collect()]
    assert max(sizes) < 400  # an id with most rows lies in several ranges

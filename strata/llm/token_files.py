"""Token ids as flat binary files.

``write_tokens`` finds bounds of ranges of document ids, encodes documents where
they are, sends their narrow ids to their range, and writes, for each, a file of little-endian unsigned integers (as narrow as the
vocabulary allows) and a file of 64-bit document offsets within it. Each
range's place in the whole corpus comes from prefix sums over the ranges' totals;
only those totals, one row a range, reach the driver. ``read_tokens`` maps the
files into memory and gives each document's ids and global start.

A range's files are written under names of their own attempt; the manifest, a
Parquet table written when all ranges are done, names the ones that count, so a
lost executor or a repeated attempt leaves nothing half-written in use.

Null and empty texts are the end id alone. Rows that share an id follow each
other, in the order of a hash of their text, and may lie in several ranges, even
equal rows, so that an id of very many rows is no hot one; null ids come first. An empty table gives an empty
manifest and an empty result. Extra columns are ignored. Ids that the unsigned
type can't hold raise an error.
"""

from __future__ import annotations

import uuid
import zlib
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.common import scratch_path, small_batches
from strata.llm.tokens import encoder, vocabulary

END = 2
#: Bytes of text that a range is meant to have.
RANGE_BYTES = 64 << 20
_FLUSH = 8 << 20


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:/") else "file://" + uri)


def _key(id_: object, hash_: int) -> tuple:
    """Sorts as Spark does, null ids first."""
    return (id_ is not None, id_ if id_ is not None else 0, hash_)


def width_for(largest_id: int) -> str:
    """The narrowest little-endian unsigned type that holds the id."""
    return next(t for t in ("<u1", "<u2", "<u4", "<u8") if largest_id <= np.iinfo(t).max)


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", end: int = END, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Writes the files below ``path`` and returns the manifest: part, base_doc, base_token, n_docs, n_tokens, width, data, index, ids."""
    spark = docs.sparkSession
    small_batches(spark)
    vocab = tokenizer or vocabulary("byte_bpe_50k.json")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["id"]
    width = width_for(max(encoder(vocab).tokenizer.get_vocab_size() - 1, end))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(1, -(-int(size) // range_bytes), spark.sparkContext.defaultParallelism)
    # only ids and hashes are sorted to find the bounds, one row a range; equal rows are parted by their place
    narrow = rows.select("id", "hash").withColumn("row", F.monotonically_increasing_id()).repartitionByRange(ranges, "id", "hash", "row")
    found = narrow.groupBy(F.spark_partition_id()).agg(F.min(F.struct("id", "hash", "row")).alias("low")).select("low.id", "low.hash").collect()
    bounds = spark.sparkContext.broadcast(sorted(_key(r["id"], r["hash"]) for r in found)[1:])

    def encode(batches):
        enc, stop, n = encoder(vocab), np.array([end], width).tobytes(), 0
        for batch in batches:
            texts, at = batch.column(2).to_pylist(), 0
            keys = list(map(_key, batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            while at < len(texts):
                held, parts, size, first = [], [], 0, at
                while at < len(texts) and size < _FLUSH:
                    raw = enc.encode_one(texts[at])
                    held.append((raw if width == "<u4" else np.frombuffer(raw, "<u4").astype(width).tobytes()) + stop)
                    # a key that bounds several ranges may go to any of them
                    low, high = bisect_left(bounds.value, keys[at]), bisect_right(bounds.value, keys[at])
                    parts.append(low + n % (high - low + 1))
                    n += 1
                    size += len(held[-1])
                    at += 1
                own = slice(first, at)
                yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), batch.column(0)[own], batch.column(1)[own], pa.array(held, pa.binary())], names=["part", "id", "hash", "ids"])

    encoded = rows.mapInArrow(encode, f"part int, id {kind}, hash long, ids binary")

    def write(batches):
        filesystem, root = _opened(path)
        filesystem.create_dir(root, recursive=True)
        stem = f"{root}/{uuid.uuid4().hex}"
        offsets, ids, total, lowest = [0], [], 0, None
        data, held, bytes_held = None, [], 0
        each = np.dtype(width).itemsize
        for batch in batches:
            if lowest is None and batch.num_rows:
                data = filesystem.open_output_stream(stem + ".ids")
                lowest = batch.column("part").slice(0, 1)
            for raw in batch.column("ids").to_pylist():
                held.append(raw)
                bytes_held += len(raw)
                total += len(raw) // each
                offsets.append(total)
                if bytes_held > _FLUSH:
                    data.write(b"".join(held))
                    held.clear()
                    bytes_held = 0
            ids.append(batch.column("id"))
        if data is None:
            return
        data.write(b"".join(held))
        data.close()
        with filesystem.open_output_stream(stem + ".offsets") as out:
            out.write(np.array(offsets, "<u8").tobytes())
        with filesystem.open_output_stream(stem + ".docs") as out, pa.ipc.new_file(out, pa.schema([("id", ids[0].type)])) as sink:
            for a in ids:
                sink.write_batch(pa.RecordBatch.from_arrays([a], names=["id"]))
        name = stem.rsplit("/", 1)[1]
        yield pa.RecordBatch.from_arrays([lowest, pa.array([len(offsets) - 1]), pa.array([total]), pa.array([width]), pa.array([name])], names=["part", "n_docs", "n_tokens", "width", "name"])

    dealt = encoded.repartitionById(len(bounds.value) + 1, F.col("part")).sortWithinPartitions("part", "id", "hash")
    done = dealt.mapInArrow(write, "part int, n_docs long, n_tokens long, width string, name string").collect()
    parts, doc, token = [], 0, 0
    for k, r in enumerate(sorted(done, key=lambda r: r["part"])):
        parts.append((k, doc, token, r["n_docs"], r["n_tokens"], r["width"], r["name"]))
        doc, token = doc + r["n_docs"], token + r["n_tokens"]
    manifest = spark.createDataFrame(parts, "part int, base_doc long, base_token long, n_docs long, n_tokens long, width string, name string")
    manifest.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")
    return spark.read.parquet(f"{path}/manifest")


def _mapped(filesystem: fs.FileSystem, name: str) -> pa.Buffer:
    if isinstance(filesystem, fs.LocalFileSystem):
        with pa.memory_map(name) as f:
            return f.read_buffer()
    with filesystem.open_input_file(name) as f:
        return f.read_buffer()


def read_tokens(spark: SparkSession, path: str, id_type: str = "bigint", with_ids: bool = True) -> DataFrame:
    """id, start (tokens of all documents before it), n_tokens, ids_crc32 and (``with_ids``) ids as little-endian unsigned 32-bit integers."""
    manifest = spark.read.parquet(f"{path}/manifest")
    n = manifest.count()

    def read(batches):
        filesystem, root = _opened(path)
        for batch in batches:
            for r in batch.to_pylist():
                stem = f"{root}/{r['name']}"
                data = np.frombuffer(_mapped(filesystem, stem + ".ids"), r["width"])
                offsets = np.frombuffer(_mapped(filesystem, stem + ".offsets"), "<u8").astype(np.int64)
                docs = pa.ipc.open_file(pa.BufferReader(_mapped(filesystem, stem + ".docs"))).read_all().column(0).combine_chunks()
                at = 0
                while at < len(docs):
                    past = min(len(docs), max(at + 1, int(np.searchsorted(offsets, offsets[at] + (2 << 20)))))
                    raw = data[offsets[at] : offsets[past]].astype("<u4").tobytes()
                    cuts = ((offsets[at : past + 1] - offsets[at]) * 4).tolist()
                    view = memoryview(raw)
                    cols = [docs.slice(at, past - at), pa.array(offsets[at:past] + r["base_token"]), pa.array(np.diff(offsets[at : past + 1])), pa.array([zlib.crc32(view[a:b]) for a, b in zip(cuts, cuts[1:])], pa.int64())]
                    names = ["id", "start", "n_tokens", "ids_crc32"]
                    if with_ids:
                        cols.append(pa.array([raw[a:b] for a, b in zip(cuts, cuts[1:])], pa.binary()))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in cols], names=names)
                    at = past

    return manifest.repartition(max(1, n), "part").mapInArrow(read, f"id {id_type}, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def token_file_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from files written first."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "tokens")
    write_tokens(docs, path)
    return read_tokens(spark, path, dict(docs.dtypes)["doc_id"], with_ids=False).withColumnRenamed("id", "doc_id")

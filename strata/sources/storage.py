"""A product store on Parquet (or ORC): a table for each creator and layer path.

Each table has the path's key columns, the cell's index as text, and a column for
each product. Reading selects by creator and product, joins on real keys, and
takes added or missing structure fields by name.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from strata.errors import StrataError
from strata.names import LayerPath, Selector, normal_cell_text
from strata.operators.nodes import Bundle
from strata.sources.drivers import JOB_CELL

TECHNOLOGIES = ("parquet", "orc", "noop", "hdf5")
COMPRESSIONS = ("none", "snappy", "gzip", "lz4", "zstd")
CELL = "cell_id"


def cell_id(path: LayerPath) -> Column:
    """``[run:0, event:5]`` from the key columns."""
    parts = [F.concat(F.lit(f"{n}:"), F.col(k).cast("string")) for n, k in zip(path[1:], path.keys)]
    return F.concat(F.lit("["), F.concat_ws(", ", *parts), F.lit("]")) if parts else F.lit("[]")


def _safe(text: str) -> str:
    return re.sub(r"[^0-9A-Za-z_.-]", lambda m: f"%{ord(m[0]):02x}", text)


@dataclass(frozen=True)
class Token:
    """Where one stored row is: table, product, technology, and its row from 0 in key order."""

    table: str
    product: str
    technology: str
    row: int


class ProductStore:
    """Writes and reads products below a folder.

    ``products`` limits what is stored; a product that reaches the sink without
    being listed is an error. Attributes: ``compression``.
    """

    def __init__(self, spark: SparkSession, folder: str, technology: str = "parquet", products: Iterable[str] | None = None, **attributes: str):
        if technology == "hdf5":
            raise StrataError("HDF5 storage is not yet implemented")
        if technology not in TECHNOLOGIES:
            raise StrataError(f"Unknown storage technology '{technology}'")
        if unknown := set(attributes) - {"compression"}:
            raise StrataError(f"Unknown storage attribute '{sorted(unknown)[0]}'")
        self.spark, self.folder, self.technology = spark, folder.rstrip("/"), technology
        self.products = None if products is None else set(products)
        compression = attributes.get("compression", "zstd")
        self.compression = compression if compression in COMPRESSIONS else "zstd"

    def _table(self, creator: str, path: LayerPath) -> str:
        return f"{self.folder}/{_safe(creator)}/{'.'.join(path)}"

    def write(self, creator: str, path: LayerPath, frame: DataFrame) -> None:
        """Stores a node's result; its columns beside the keys are the products."""
        own = [c for c in frame.columns if c not in path.keys and c != JOB_CELL]
        if self.products is not None and (extra := [c for c in own if c not in self.products and f"{creator}/{c}" not in self.products]):
            raise StrataError(f"No configuration for product '{creator}/{extra[0]}' in the store")
        if not own:
            return
        rows = frame.select(*path.keys, cell_id(path).alias(CELL), *own)
        writer = rows.write.mode("overwrite").format(self.technology)
        if self.technology == "noop":
            writer.save()
            return
        writer.option("compression", self.compression).save(self._table(creator, path))

    def sink(self, name: str, path: LayerPath, frame: DataFrame) -> None:
        """For ``Graph.output``."""
        self.write(name, path, frame)

    def paths(self, creator: str) -> list[LayerPath]:
        """Layer paths that the creator has tables for, by Spark's own file system."""
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{_safe(creator)}")
        fs = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if self.technology == "noop" or not fs.exists(at):
            return []
        return sorted(LayerPath(s.getPath().getName().split(".")) for s in fs.listStatus(at) if s.isDirectory())

    def read(self, creator: str, products: Iterable[str] | None = None, path: LayerPath | str | None = None, schema: StructType | None = None) -> DataFrame:
        """Keys, cell text and products; only the columns asked for are read. An unknown product is an error; ``schema`` may add fields, which are null."""
        found = self.paths(creator)
        if path is not None:
            found = [p for p in found if p == path or p.ends_with(str(path))]
        if len(found) != 1:
            raise StrataError(f"Creator '{creator}' has {len(found)} stored layer paths that fit")
        reader = self.spark.read.format(self.technology)
        df = (reader.schema(schema) if schema else reader).load(self._table(creator, found[0]))
        wanted = list(products) if products is not None else [c for c in df.columns if c != CELL and c not in found[0].keys]
        if missing := [p for p in wanted if p not in df.columns]:
            raise StrataError(f"No product '{creator}/{missing[0]}' in the store")
        return df.select(*found[0].keys, CELL, *wanted)

    def indices(self, creator: str, path: LayerPath | str | None = None) -> DataFrame:
        """The stored cells' texts in key order; none stored is an error."""
        df = self.read(creator, [], path)
        if df.isEmpty():
            raise StrataError(f"No indices stored by '{creator}'")
        return df.orderBy(*[c for c in df.columns if c != CELL]).select(CELL)

    def row_of(self, creator: str, text: str, path: LayerPath | str | None = None) -> DataFrame:
        """The stored row of one cell: by its text as written, or in any order and spelling of its parts."""
        df = self.read(creator, None, path)
        keys = {k.removeprefix("k_").lower(): k for k in df.columns if k.startswith("k_")}
        parts = normal_cell_text(text)
        if {n for n, _ in parts} != set(keys):
            raise StrataError(f"No stored cell {text}")
        found = df
        for n, number in parts:
            found = found.where(F.col(keys[n]) == number)
        if found.isEmpty():
            raise StrataError(f"No stored cell {text}")
        return found

    def token(self, creator: str, product: str, text: str, path: LayerPath | str | None = None) -> Token:
        """A stored product's place: its row number counts the cells before it in key order."""
        row = self.row_of(creator, text, path).first()
        df = self.read(creator, [product], path)
        keys = [c for c in df.columns if c.startswith("k_")]
        if self.technology == "noop":
            raise StrataError("This storage has no rows")
        before = F.struct(*keys) < F.struct(*(F.lit(row[k]).cast("long").alias(k) for k in keys)) if keys else F.lit(False)
        return Token(f"{self.folder}/{_safe(creator)}", product, self.technology, df.where(before).count())


class StoredSource:
    """Gives a store's products to a graph: as implicit providers and as cells."""

    def __init__(self, store: ProductStore, creator: str, stored_as: str | None = None):
        self.store, self.creator, self.stored_as = store, creator, stored_as or creator

    def create_providers(self, want: Selector) -> list[Bundle]:
        out = []
        if want.creator not in (None, self.creator):
            return out
        for path in self.store.paths(self.stored_as):
            if path.name != want.layer:
                continue
            columns = [c for c in self.store.read(self.stored_as, None, path).columns if c != CELL and c not in path.keys]
            for c in columns:
                suffix = "" if c == "value" else c
                if want.suffix in (None, suffix):
                    out.append(Bundle(lambda cell, c=c: cell.column(self.column(c)), self.creator, path.name, suffix, want.stage or "CURRENT", want.type))
        return out

    def column(self, product: str) -> str:
        return f"{_safe(self.creator)}.{product}".replace(".", "_")

    def indices(self, spark: SparkSession):
        """Path and frame pairs; the frames carry the products' columns, which unread ones are pruned from."""
        for path in self.store.paths(self.stored_as):
            df = self.store.read(self.stored_as, None, path)
            yield path, df.select(*path.keys, *(F.col(c).alias(self.column(c)) for c in df.columns if c != CELL and c not in path.keys))


def describe(store: ProductStore, creator: str) -> str:
    """The stored schema of each path, as JSON."""
    return json.dumps({str(p): store.read(creator, None, p).schema.jsonValue() for p in store.paths(creator)})

"""Tables under one folder of any file system Spark knows: snapshots of all tables, and writes that touch only some buckets.

A manifest names the parts of every table. Writers put new parts into new folders and move one pointer at the end, by one
rename; a reader holds the manifest it began with, so it sees all tables of one ingest or none of it. Parts that no kept
manifest names go. One writer at a time: the engine's ingests run one after another.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKET = "__bucket"


def bucket_of(keys: Sequence[str], buckets: int) -> Column:
    """The bucket of a row by its keys' text (``zlib.crc32`` gives the same number on the driver)."""
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])
    return (F.crc32(text.cast("binary")) % buckets).cast("int")


def merged_schema(old: StructType, new: StructType) -> StructType:
    """Columns of ``old``, then those that only ``new`` has: what parts of either are read by."""
    return StructType([*old.fields, *[f for f in new.fields if f.name not in old.names]])


@dataclass(frozen=True)
class Snapshot:
    """All tables as they were at one moment."""

    spark: SparkSession
    tables: dict

    def read(self, name: str, buckets: Sequence[int] | None = None) -> DataFrame | None:
        """A table, or of a bucketed one the asked buckets alone: no other file is listed or opened."""
        table = self.tables.get(name)
        if table is None:
            return None
        asked = None if buckets is None or not table["keys"] else {str(b) for b in buckets}
        schema = StructType.fromJson(table["schema"])
        paths = [p for b, p in sorted(table["parts"].items()) if asked is None or b in asked]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)


class Store:
    def __init__(self, spark: SparkSession, folder: str, keep: int = 3):
        """keep: snapshots whose parts stay; a reader may be so many writes behind."""
        self.spark, self.folder, self.keep = spark, folder.rstrip("/"), keep
        self._pending: dict | None = None
        self._written: list[str] = []

    # ---------- files ----------

    def _fs(self, path: str):
        jpath = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return jpath.getFileSystem(self.spark._jsc.hadoopConfiguration()), jpath

    def _text(self, path: str) -> str | None:
        fs, jpath = self._fs(path)
        if not fs.exists(jpath):
            return None
        stream = fs.open(jpath)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _put(self, path: str, text: str) -> None:
        fs, jpath = self._fs(path)
        stream = fs.create(jpath, True)
        stream.write(bytearray(text.encode()))
        stream.close()

    def _move(self, source: str, target: str) -> None:
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        over = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        (_, a), (_, b) = self._fs(source), self._fs(target)
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(a.toUri(), self.spark._jsc.hadoopConfiguration()).rename(a, b, over)

    def _delete(self, path: str) -> None:
        fs, jpath = self._fs(path)
        fs.delete(jpath, True)

    # ---------- snapshots ----------

    def _manifests(self) -> list[str]:
        """Names of the kept manifests, the newest first."""
        return (self._text(f"{self.folder}/current") or "").split()

    def _tables(self) -> dict:
        if self._pending is not None:
            return self._pending
        names = self._manifests()
        return json.loads(self._text(f"{self.folder}/manifests/{names[0]}")) if names else {}

    def snapshot(self) -> Snapshot:
        return Snapshot(self.spark, dict(self._tables()))

    @contextmanager
    def transaction(self) -> Iterator[Store]:
        """All writes inside become visible together at the end; after an error none does. Reads inside see them at once."""
        if self._pending is not None:  # part of the one around it
            yield self
            return
        self._pending, self._written = dict(self._tables()), []
        try:
            yield self
            self._commit(self._pending)
        except BaseException:
            for path in self._written:
                self._delete(path)
            raise
        finally:
            self._pending = None

    def _commit(self, tables: dict) -> None:
        before, name = self._manifests(), f"m-{uuid.uuid4().hex}.json"
        self._put(f"{self.folder}/manifests/{name}", json.dumps(tables))
        kept = [name, *before][: self.keep]
        self._put(f"{self.folder}/next", "\n".join(kept))
        self._move(f"{self.folder}/next", f"{self.folder}/current")
        gone = before[self.keep - 1 :]
        if not gone:
            return
        read = lambda m: {p for t in json.loads(self._text(f"{self.folder}/manifests/{m}") or "{}").values() for p in t["parts"].values()}
        used = set().union(*map(read, kept))
        for old in gone:
            for path in read(old) - used:
                self._delete(path)
            self._delete(f"{self.folder}/manifests/{old}")

    # ---------- tables ----------

    def has(self, name: str) -> bool:
        return name in self._tables()

    def read(self, name: str, buckets: Sequence[int] | None = None) -> DataFrame | None:
        return self.snapshot().read(name, buckets)

    def parts(self, name: str) -> dict[str, str]:
        """Folders of a table by bucket."""
        return dict(self._tables().get(name, {"parts": {}})["parts"])

    def _write_parts(self, name: str, df: DataFrame, keys: Sequence[str], buckets: int) -> dict[str, str]:
        path = f"{self.folder}/{name}/v-{uuid.uuid4().hex}"
        self._written.append(path)
        if not keys:
            df.write.parquet(path)
            return {"0": path}
        df.withColumn(BUCKET, bucket_of(keys, buckets)).repartition(BUCKET).write.partitionBy(BUCKET).parquet(path)
        fs, jpath = self._fs(path)
        found = [x.getPath().getName() for x in fs.listStatus(jpath) if x.isDirectory()]
        return {x.split("=")[1]: f"{path}/{x}" for x in found if x.startswith(f"{BUCKET}=")}

    def write(self, name: str, df: DataFrame, keys: Sequence[str] = (), buckets: int = 16) -> DataFrame:
        """The whole table anew, by buckets of its keys where it has some."""
        with self.transaction():
            parts = self._write_parts(name, df, keys, buckets)
            self._pending[name] = {"schema": json.loads(df.schema.json()), "keys": list(keys), "buckets": buckets, "parts": parts}
            return self.snapshot().read(name)

    def rewrite(self, name: str, touched: DataFrame, make, keys: Sequence[str] = (), buckets: int = 16) -> DataFrame:
        """The table with only those buckets anew that the keys of ``touched`` fall into: ``make`` gets the old rows of these
        buckets (None if there is no table) and gives the new ones. All other parts stay the files they are."""
        with self.transaction():
            old = self._pending.get(name)
            if old is None:
                return self.write(name, make(None), keys, buckets)
            keys, buckets = old["keys"], old["buckets"]
            asked = sorted(r[0] for r in touched.select(bucket_of(keys, buckets)).distinct().collect())  # as many as buckets
            if asked:
                rows = make(self.snapshot().read(name, asked))
                parts = {b: p for b, p in old["parts"].items() if int(b) not in asked} | self._write_parts(name, rows, keys, buckets)
                self._pending[name] = old | {"schema": json.loads(merged_schema(StructType.fromJson(old["schema"]), rows.schema).json()), "parts": parts}
            return self.snapshot().read(name)

    def upsert(self, name: str, rows: DataFrame, keys: Sequence[str], buckets: int = 16) -> DataFrame:
        """Rows of the same keys replaced, others added; a second run of the same rows changes nothing."""
        from lumenfold.operators.graph import upsert

        return self.rewrite(name, rows, lambda old: rows if old is None else upsert(old, rows, list(keys)), keys, buckets)

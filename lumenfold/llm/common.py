"""Helpers the operators share: the shared folder, written intermediate tables, size-based partition counts."""

from __future__ import annotations

import atexit
import ctypes
import ctypes.util
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor and the driver can reach.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset and all tasks run inside the driver (tests, a
    laptop), a local one is made; a cluster without it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="lumenfold-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: it cuts the lineage and outlives any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def written_so_far() -> int:
    return len(_written)


def drop_written(after: int = 0, only: str = "") -> None:
    """Deletes tables that ``written`` made from position ``after`` on, or those of one name; at exit all of them go."""
    for spark, path in [x for x in _written[after:] if f"/tables/{only}" in x[1]]:
        _written.remove((spark, path))
        try:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001  the session may have ended before the interpreter
            return


atexit.register(drop_written)


_resident: dict[tuple, object] = {}


def resident(key: tuple, make: Callable[[], object]):
    """The one large helper (a tokenizer, an automaton, a vocabulary) that a worker process keeps between tasks. Asking for
    another one lets the last go, so that stages that follow each other don't pile theirs up."""
    if key not in _resident:
        _resident.clear()
        _resident[key] = make()
    return _resident[key]


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    """UTF-8 bytes of all texts: what block and partition counts are derived from."""
    return int(docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text_col)).cast("long")), F.lit(0))).first()[0])


def blocks_for(n_bytes: int, per_block: int) -> int:
    return max(1, -(-n_bytes // per_block))


def fold(doc_id: str, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus


def chunks_of(batches: Iterator[pa.RecordBatch], size: Callable[[dict], int], most: int) -> Iterator[list[dict]]:
    """Rows of Arrow batches as dicts, regrouped so that one group weighs ``most`` or holds a single row."""
    held, weight = [], 0
    for batch in batches:
        for row in batch.to_pylist():
            held.append(row)
            weight += size(row)
            if weight >= most:
                yield held
                held, weight = [], 0
    if held:
        yield held
    trim()


def text_groups(batches: Iterator[pa.RecordBatch], most_chars: int = 4_000_000) -> Iterator[list[dict]]:
    return chunks_of(batches, lambda r: len(r["text"] or "") + 64, most_chars)


def text_slices(batches: Iterator[pa.RecordBatch], column: str, most_chars: int = 4_000_000) -> Iterator[tuple[pa.RecordBatch, list]]:
    """The batches cut so that a slice's texts hold ``most_chars`` or are a single row: the slice with all its columns, and
    its texts."""
    for batch in batches:
        texts, lo, weight = batch.column(batch.schema.get_field_index(column)).to_pylist(), 0, 0
        for hi, t in enumerate(texts, 1):
            weight += len(t or "") + 64
            if weight >= most_chars or hi == len(texts):
                yield batch.slice(lo, hi - lo), texts[lo:hi]
                lo, weight = hi, 0
    trim()


def trim() -> None:
    """Gives freed memory back to the system: an idle worker shares its machine with those of the next stage."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.util.find_library("c")
    if libc and hasattr(found := ctypes.CDLL(libc), "malloc_trim"):
        found.malloc_trim(0)

"""Removes every byte that is covered by a long string which stands elsewhere too.

Which strings of ``least`` bytes repeat is found without sorting the whole corpus in one place:

1. Every such string has an anchor, its k-gram of smallest hash. Equal strings have equal anchors at equal places, so only
   starts whose anchor's hash occurs twice can repeat. Neighbouring starts share their anchor; they and the bytes they
   reach form one context.
2. Equal contexts are counted as one. One that occurs twice repeats as a whole.
3. Contexts that differ but share an anchor meet in one task, which joins them into a text, builds its Burrows-Wheeler
   transform and expands common prefixes backwards by rising length, up to ``least`` (``bwt``).
4. Where an anchor has more differing contexts than one task may hold, they are split by anchors of longer k-grams, as if
   they were the corpus, until each part fits; the longest anchor is the string itself, and then equal contexts are all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lumenfold.llm.bwt import repeated_starts
from lumenfold.llm.common import drop_written, written, written_so_far

_B = np.uint64(0x9E3779B97F4A7C15)
_M = np.uint64(0xC2B2AE3D27D4EB4F)
_PLACE = 24  # bits of an anchor's key that hold its place, so that ties go to the first
SEGMENT = 4_000_000  # starts worked on at a time


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _B, dtype=np.uint64)]))


_power_cache = _powers(1024)


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """h with h[j] - h[i] * B**(j - i) the polynomial hash of data[i:j].

    h[i + 1] = h[i] * B + x[i] is summed as x[i] * B**-i and scaled back: B is odd, so it has an inverse."""
    n = len(data)
    out = np.zeros(n + 1, dtype=np.uint64)
    out[1:] = data.astype(np.uint64) + np.uint64(1)
    inverse = np.uint64(pow(int(_B), -1, 1 << 64))
    down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, inverse, dtype=np.uint64)]))
    up = _powers(n)
    return np.cumsum(out * down, dtype=np.uint64) * up


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _M
    return x ^ (x >> np.uint64(29))


def _least_of(keys: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` neighbours: from the smallest to each block's start and from its end."""
    n = len(keys)
    pad = -n % width
    blocks = np.concatenate([keys, np.full(pad, np.iinfo(np.uint64).max, dtype=np.uint64)]).reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def contexts_of(data: np.ndarray, least: int, k: int) -> tuple[np.ndarray, ...]:
    """Of one text: anchor hash, context hash, first start and number of starts of each run of starts with one anchor."""
    cols: list[list[np.ndarray]] = [[], [], [], []]
    for at in range(0, max(0, len(data) - least + 1), SEGMENT):
        part = data[at : at + SEGMENT + least - 1]
        h = prefix_hashes(part)
        grams = _mixed(h[k:] - h[:-k] * _power_cache[k])
        keys = (grams >> np.uint64(_PLACE) << np.uint64(_PLACE)) | np.arange(len(grams), dtype=np.uint64)
        best = _least_of(keys, least - k + 1)
        heads = np.flatnonzero(np.append(True, best[1:] != best[:-1]))
        counts = np.diff(np.append(heads, len(best)))
        place = (best[heads] & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
        reach = heads + counts - 1 + least
        body = h[reach] - h[heads] * _power_cache[reach - heads]
        context = _mixed(_mixed(body) + (place - heads).astype(np.uint64) * _B + counts.astype(np.uint64))
        for col, x in zip(cols, (grams[place].view(np.int64), context.view(np.int64), heads + at, counts), strict=True):
            col.append(x)
    return tuple(np.concatenate(c) if c else np.empty(0, np.int64) for c in cols)


def _runs(mask: np.ndarray) -> list[int]:
    """First and last + 1 of each run of true values, in one list."""
    return np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))).tolist()


def _slices(batch: pa.RecordBatch, column: str, most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """A batch cut so that the values of a column hold ``most`` bytes or are a single row."""
    sizes = pc.binary_length(batch.column(batch.schema.get_field_index(column))).to_pylist()
    lo, weight = 0, 0
    for hi, size in enumerate(sizes, 1):
        weight += size + 64
        if weight >= most or hi == len(sizes):
            yield batch.slice(lo, hi - lo)
            lo, weight = hi, 0


def _bytes_of(value: pa.BinaryScalar) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), dtype=np.uint8)


_KEY = ["k1", "k2"]


def _repeats(source: DataFrame, distinct: DataFrame, least: int, grams: tuple[int, ...], task_bytes: int, most_contexts: int) -> DataFrame:
    """``k1, k2, spans`` (array of start and runs, which count from there): the starts of repeated strings in each key's
    ``data``. ``source`` has k1, k2 and data, equal rows counting as often as they stand; ``distinct`` has each key once.
    Keys are 128 bits."""
    mark = written_so_far()
    k, longer = grams[0], grams[1:]

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (x for batch in batches for x in _slices(batch, "data")):
            found = [contexts_of(_bytes_of(d), least, k) for d in part.column(2)]
            times = [len(f[0]) for f in found]
            keys = [pa.array(np.repeat(part.column(i).to_numpy(), times)) for i in (0, 1)]
            a, c, s, n = (np.concatenate([f[i] for f in found]) for i in range(4))
            yield pa.RecordBatch.from_arrays([*keys, pa.array(a), pa.array(c), pa.array(s.astype(np.int32)), pa.array(n.astype(np.int16))], [*_KEY, "anchor", "context", "start", "n"])

    every = written(source.select(*_KEY, "data").mapInArrow(anchors, "k1 long, k2 long, anchor long, context long, start int, n smallint"), "suffix-anchors")
    # a table of its own, so that a frequent anchor's rows can be split in the join
    twice = written(every.groupBy("anchor").agg(F.count("*").alias("times")).filter("times > 1").select("anchor"), "suffix-twice")
    shared = written(every.join(twice, "anchor"), "suffix-shared")
    drop_written(only="suffix-anchors", after=mark)  # most anchors occur once: their table is large
    own = written(shared.groupBy("anchor", "context").agg(F.count("*").alias("copies"), F.min(F.struct(*_KEY, "start", "n")).alias("at")), "suffix-contexts")
    # a context that occurs twice repeats as a whole
    whole = own.filter("copies > 1").select("anchor", "context", F.array(F.lit(0), F.col("at.n").cast("int")).alias("runs"))
    verdicts = whole
    if k < least:
        groups = own.groupBy("anchor").agg(F.count("*").alias("contexts")).filter("contexts > 1")
        many = own.join(groups, "anchor").select("anchor", "context", "contexts", "at.*")
        # the bytes of one example of each context
        wanted = many.groupBy(*_KEY).agg(F.collect_list(F.struct("anchor", "context", "contexts", "start", "n")).alias("parts"))

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cols: list[list] = [[], [], [], []]
                for data, parts in zip(batch.column(0), batch.column(1), strict=True):
                    data = data.as_py()
                    for p in parts.as_py():
                        for col, x in zip(cols, (p["anchor"], p["context"], p["contexts"], data[p["start"] : p["start"] + p["n"] + least - 1]), strict=True):
                            col.append(x)
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.binary())], ["anchor", "context", "contexts", "bytes"])

        bytes_ = written(distinct.join(wanted, _KEY).select("data", "parts").mapInArrow(cut, "anchor long, context long, contexts long, bytes binary"), "suffix-bytes")
        fits = F.col("contexts") <= most_contexts
        sizes = bytes_.agg(F.coalesce(F.sum(F.when(fits, F.octet_length("bytes"))), F.lit(0)).alias("fit"), F.count_if(~fits).alias("hot")).first()
        bins = max(1, -(-sizes["fit"] // task_bytes))

        def expand(table: pa.Table) -> pa.Table:
            strings = table["bytes"].to_pylist()
            runs = [_runs(m[: len(x) - least + 1]) for m, x in zip(repeated_starts(strings, least), strings, strict=True)]
            return pa.Table.from_arrays([table["anchor"], table["context"], pa.array(runs, pa.list_(pa.int32()))], ["anchor", "context", "runs"])

        schema = "anchor long, context long, runs array<int>"
        usual = bytes_.filter(fits).withColumn("bin", F.pmod(F.xxhash64("anchor"), F.lit(bins))).select("bin", "anchor", "context", "bytes")
        partial = usual.groupBy("bin").applyInArrow(expand, schema)
        if sizes["hot"]:
            hot = bytes_.filter(~fits).select(F.col("anchor").alias("k1"), F.col("context").alias("k2"), F.col("bytes").alias("data"))
            inner = _repeats(hot, hot, least, longer, task_bytes, most_contexts)
            moved = F.flatten(F.transform("spans", lambda s: F.transform(s["runs"], lambda x: x + s["start"])))
            partial = partial.union(inner.select("k1", "k2", moved))
        partial = partial.filter(F.size("runs") > 0)
        verdicts = partial.join(whole.select("anchor", "context"), ["anchor", "context"], "left_anti").union(whole)
    verdicts = written(verdicts, "suffix-verdicts")
    return shared.join(verdicts, ["anchor", "context"]).groupBy(*_KEY).agg(F.collect_list(F.struct("start", "runs")).alias("spans"))


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 200, k: int = 24, task_bytes: int = 1_000_000, most_contexts: int = 4096) -> DataFrame:
    """One row per row of ``docs``: id, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept`` (the remaining bytes).

    A byte goes if some string of ``least`` bytes that covers it starts anywhere else in the table, the same document
    included; strings never cross documents and are judged on the input. Null and empty texts have no bytes; equal rows
    count as two documents; null ids are kept; an empty table gives no rows; other columns aren't read. Very long texts are
    worked through in segments of SEGMENT starts. Texts, and anchors with contexts, are told apart by 128 bits of hashes.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("data")).withColumn("k1", F.xxhash64("id", "data")).withColumn("k2", F.xxhash64(F.lit(1), "data", "id"))
    long_enough = source.filter(F.octet_length("data") >= least).select(*_KEY, "data")
    repeated = long_enough.groupBy(*_KEY).count().filter("count > 1").limit(1).count()
    grams = tuple(dict.fromkeys((min(k, least), min(4 * k, least), least)))
    spans = _repeats(long_enough, long_enough.dropDuplicates(_KEY) if repeated else long_enough, least, grams, task_bytes, most_contexts)

    id_type = source.schema["id"].dataType
    kind = to_arrow_type(id_type)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(4)]
            for data, spans_ in zip(batch.column(1), batch.column(2), strict=True):
                data = data.as_py() or b""
                if not spans_.is_valid:
                    found = (len(data), 0, 0, data)
                else:
                    edge = np.zeros(len(data) + 1, dtype=np.int32)
                    for span in spans_.as_py():
                        runs = np.asarray(span["runs"], dtype=np.int64) + span["start"]
                        np.add.at(edge, runs[::2], 1)
                        np.add.at(edge, runs[1::2] - 1 + least, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    kept = np.frombuffer(data, dtype=np.uint8)[~gone].tobytes()
                    found = (len(data), len(data) - len(kept), len(_runs(gone)) // 2, kept)
                for col, x in zip(out, found, strict=True):
                    col.append(x)
            cols = [batch.column(0).cast(kind), *(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["id", "n_bytes", "n_removed", "n_spans", "kept"])

    schema = f"id {id_type.simpleString()}, n_bytes long, n_removed long, n_spans long, kept binary"
    out = source.join(spans, _KEY, "left").select("id", "data", "spans").mapInArrow(remove, schema)
    return out.withColumnRenamed("id", id_col)

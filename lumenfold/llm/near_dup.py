"""Near-duplicate documents: MinHash with banding, signatures, confirmed links, connected components.

1. Documents with equal shingle sets form a class; only classes go on. Each gets its minima, a signature and band keys.
2. In each band bucket one member, drawn by a hash, is the centre; members whose signatures agree with it join its family.
   Buckets that still hold several families compare those outside their largest one with all members.
3. Links are confirmed on full sets within families: small families as a whole; large ones (by members or shingles) first against a few centres
   and then, for what is left outside the largest component, against every chunk. Tasks emit no more links than they hold
   documents: enough to connect what is linked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.llm.common import blocks_for, resident, text_groups, written
from lumenfold.llm.components import connected_components
from lumenfold.llm.minhash import Minima, Shingler, equal_minima

def shingler(width: int) -> Shingler:
    """One per worker process and width."""
    return resident(("shingles", width), lambda: Shingler(width, 200_000))


class _Forest:
    """Joins items; keeps the joins that connected something new."""

    def __init__(self, n: int):
        self.up, self.links = list(range(n)), []

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, a: int, b: int) -> None:
        x, y = self.find(a), self.find(b)
        if x != y:
            self.up[x] = y
            self.links.append((a, b))


def _features(docs: DataFrame, width: int, minima: Minima) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        own = shingler(width)
        for rows in text_groups(batches, 2_000_000):
            sets = [own.sets(r["text"]) for r in rows]
            least = [minima.of(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r["id"] for r in rows], pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                    pa.array([minima.signature(m) for m in least], pa.binary()),
                    pa.array([minima.keys(m).tolist() for m in least], pa.list_(pa.int64())),
                ],
                ["id", "n", "fp", "sig", "keys"],
            )

    return docs.select(F.col("id"), "text").mapInArrow(work, "id long, n long, fp binary, sig binary, keys array<bigint>")


def _agreeing(pairs: DataFrame, least: int) -> DataFrame:
    """Of pairs a, b with signatures sa, sb those with enough equal bytes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=np.uint8).reshape(batch.num_rows, -1) for i in (2, 3))
            at = pa.array(np.flatnonzero((a == b).sum(1) >= least))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], ["a", "b"])

    return pairs.select("a", "b", "sa", "sb").mapInArrow(work, "a long, b long")


def _salted(rows: DataFrame, keyed: DataFrame, key: str, by: str, weight: str, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``keyed`` (a written table: one row a key, ``weight`` of its rows each). Keys that hold over a 64th
    of all rows, 64 at most, are dealt over 64 salts by the hash of ``by``."""
    total = keyed.agg(F.sum(weight)).first()[0] or 0
    hot = F.broadcast(keyed.filter(F.col(weight) * 64 > total).select(key, F.lit(64).alias("salts")))
    salts = F.coalesce("salts", F.lit(1))
    left = rows.join(hot, key, "left").withColumn("salt", F.pmod(F.xxhash64(by), salts).cast("int")).drop("salts")
    right = keyed.join(hot, key, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts", weight)
    return left.join(right, [key, "salt"], how).drop("salt")


def _bucket_rest(rows: DataFrame, least: int, chunk: int) -> DataFrame:
    """Agreeing pairs (enough to connect them) between families that share a bucket.

    ``rows``: key, cid, sig, family. Those outside a bucket's largest family meet all of its members, chunk by chunk."""
    size = rows.groupBy("key", "family").agg(F.count("*").alias("n"))
    top = size.groupBy("key").agg(F.max_by("family", F.struct("n", "family")).alias("top"), F.max("n").alias("most"), F.sum("n").alias("total")).filter("total > most")
    top = written(top.withColumn("chunks", F.ceil(F.col("total") / chunk)), "near-mixed")
    minority = F.col("total") - F.col("most")
    n_dealt = top.agg(F.sum(minority * F.col("chunks") + F.col("total") * F.least(minority, "chunks"))).first()[0] or 0
    mixed = _salted(rows, top, "key", "cid", "total").withColumn("mine", F.pmod(F.xxhash64("cid"), F.col("chunks")))
    # a chunk of the minority is dealt to each chunk of all: the key names both
    every = F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)
    left = mixed.filter("family <> top").select("key", F.col("mine").alias("i"), F.explode(every).alias("j"), "cid", "sig", "family", F.lit(True).alias("minority"))
    lone = mixed.filter("family <> top").select("key", F.col("mine").alias("i"), "chunks").distinct()
    right = mixed.join(lone.select("key", "i"), "key").select("key", "i", F.col("mine").alias("j"), "cid", "sig", "family", F.lit(False).alias("minority"))

    def work(group: pd.DataFrame) -> pd.DataFrame:
        links = []
        for _, g in group.groupby(["key", "i", "j"], sort=False):
            few, all_ = g[g.minority], g[~g.minority]
            if not len(few) or not len(all_):
                continue
            a = np.frombuffer(b"".join(few.sig), dtype=np.uint8).reshape(len(few), -1)
            b = np.frombuffer(b"".join(all_.sig), dtype=np.uint8).reshape(len(all_), -1)
            fa, fb, ca, cb = few.family.to_numpy(), all_.family.to_numpy(), few.cid.to_numpy(), all_.cid.to_numpy()
            place = {f: i for i, f in enumerate(dict.fromkeys([*fa, *fb]))}
            forest = _Forest(len(place))
            for x in range(len(a)):
                for y in np.flatnonzero((fb != fa[x]) & ((a[x] == b).sum(1) >= least)):
                    before = len(forest.links)
                    forest.join(place[fa[x]], place[fb[y]])
                    if len(forest.links) > before:
                        links.append((ca[x], cb[y]))
        return pd.DataFrame(links, columns=["a", "b"]).astype("int64")

    dealt = left.unionByName(right).withColumn("bin", F.xxhash64("key", "i", "j"))
    bins = F.pmod(F.col("bin"), F.lit(blocks_for(n_dealt, 16_384)))
    return dealt.withColumn("bin", bins).groupBy("bin").applyInPandas(work, "a long, b long")


def linked_pairs(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int, width: int = 4096) -> Iterator[tuple[int, int]]:
    """Index pairs with 100 * intersection >= percent * union, over left x right (None: left x left). Exact: counts of
    common shingles are summed over blocks of ``width`` shingles that at least two of the sets hold."""
    sets = left if right is None else [*left, *right]
    sizes = np.asarray([len(s) for s in sets])
    flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    fresh = np.append(True, flat[1:] != flat[:-1]) if len(flat) else np.empty(0, bool)
    column = np.cumsum(fresh) - 1
    shared = (np.bincount(column) > 1)[column] if len(flat) else np.empty(0, bool)
    column, owner = np.unique(column[shared], return_inverse=True)[1], owner[shared]
    n = len(left)
    common = np.zeros((n, len(sets) if right is None else len(right)), dtype=np.float32)
    for at in range(0, int(column.max()) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, [at, at + width])
        grid = np.zeros((len(sets), width), dtype=np.float32)
        grid[owner[lo:hi], column[lo:hi] - at] = 1
        common += grid[:n] @ (grid if right is None else grid[n:]).T
    other = sizes if right is None else sizes[n:]
    union = sizes[:n, None] + other[None, :] - common
    hit = (100 * common >= percent * union) & (common > 0)
    for i, j in zip(*np.nonzero(np.triu(hit, 1) if right is None else hit), strict=True):
        yield int(i), int(j)


def _confirmed(rows: DataFrame, width: int, percent: int) -> DataFrame:
    """Links of groups: ``rows`` has bin, grp, cid, text and side (0: left, 1: right; a group without a right side is
    compared within itself)."""

    def work(part: pd.DataFrame) -> pd.DataFrame:
        own, links = shingler(width), []
        for _, g in part.groupby("grp", sort=False):
            left, right = g[g.side == 0], g[g.side == 1]
            ids = [*left.cid, *right.cid]
            place = {c: i for i, c in enumerate(dict.fromkeys(ids))}  # a centre can stand on both sides
            forest = _Forest(len(place))
            sets = [own.sets(t) for t in g.text.loc[[*left.index, *right.index]]]
            pairs = linked_pairs(sets[: len(left)], sets[len(left) :] if len(right) else None, percent)
            off = len(left) if len(right) else 0
            for i, j in pairs:
                forest.join(place[ids[i]], place[ids[off + j]])
            names = list(place)
            links += [(names[a], names[b]) for a, b in forest.links]
        return pd.DataFrame(links, columns=["a", "b"]).astype("int64")

    return rows.groupBy("bin").applyInPandas(work, "a long, b long")


def near_duplicates(
    docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", bands: int = 32, rows: int = 4, sigmas: float = 4.5, chunk: int = 512, centres: int = 8, heaviest: int = 4_000_000
) -> DataFrame:
    """One row per row of ``docs``: id, ``n_shingles``, ``component_id`` (the smallest id that links reach) and ``kept``.

    Two documents are linked if 100 * |A and B| >= percent * |A or B| over their sets of ``width``-word shingles. Banding
    finds a pair at the threshold but for (1 - s**rows)**bands, 5e-8 at 0.8, and the signature passes it but for
    ``sigmas`` deviations; every link is confirmed on full sets. Texts that are null, empty or without words have no
    shingles and are linked with nothing; rows with a null id take no part (component and kept null, unless a reader
    fills them); repeated rows of one id have one component; an empty table gives no rows. Ids must be integers; other
    columns aren't read. Large buckets, families and classes of copies are worked through in chunks of ``chunk``, families
    of long texts in more of them, of ``heaviest`` shingles; a single very long text is taken whole.
    """
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    minima = Minima(bands, rows)
    least = equal_minima(percent / 100, bands * rows, sigmas)
    feats = written(_features(source, width, minima), "near-features")
    classes = feats.filter("n > 0 AND id IS NOT NULL").groupBy("fp").agg(F.count("*").alias("copies"), F.first("n").alias("n"), F.min("id").alias("cid"), F.first("sig").alias("sig"), F.first("keys").alias("keys"))
    # one id with several texts stands for several sets: classes are told apart by their own number
    classes = written(classes.withColumn("set", F.xxhash64("fp")), "near-classes")
    buckets = classes.select(F.explode("keys").alias("key"), F.col("set").alias("cid"))
    centre = buckets.groupBy("key").agg(F.count("*").alias("n"), F.min_by("cid", F.xxhash64("cid", "key")).alias("centre")).filter("n > 1")
    members = written(buckets.join(centre, "key").select("key", "cid", "centre"), "near-buckets")
    sig = classes.select(F.col("set").alias("cid"), "sig")
    star = members.filter("cid <> centre").select(F.col("centre").alias("a"), F.col("cid").alias("b")).distinct()
    star = star.join(sig.select(F.col("cid").alias("a"), F.col("sig").alias("sa")), "a").join(sig.select(F.col("cid").alias("b"), F.col("sig").alias("sb")), "b")
    likely = written(_agreeing(star, least), "near-star")
    first = written(connected_components(likely), "near-family")
    placed = members.join(first.select(F.col("node").alias("cid"), F.col("component").alias("family")), "cid", "left").withColumn("family", F.coalesce("family", "cid"))
    rest = written(_bucket_rest(placed.select("key", "cid", "family").join(sig, "cid"), least, chunk), "near-rest")
    families = written(connected_components(likely.union(rest)), "near-families").withColumnRenamed("node", "cid").withColumnRenamed("component", "family")

    # full sets are rebuilt from the texts of the documents that stand for their classes
    of_family = written(families.join(classes.select(F.col("set").alias("cid"), "fp", "n"), "cid"), "near-members")
    chunks = F.greatest(F.ceil(F.count("*") / chunk), F.ceil(F.sum("n") / heaviest))
    size = written(of_family.groupBy("family").agg(F.count("*").alias("members"), chunks.alias("chunks")), "near-sizes")
    wanted = _salted(of_family, size, "family", "cid", "members")
    stands = feats.filter("n > 0 AND id IS NOT NULL").join(classes.select("fp", F.col("cid").alias("id")), ["fp", "id"]).select("fp", "id").distinct()
    texts = source.filter("id IS NOT NULL").join(wanted.join(stands, "fp").select("cid", "family", "chunks", "id").distinct(), "id")
    if feats.groupBy("id").count().filter("count > 1").limit(1).count():
        # repeated ids: keep the text that has the class's set
        texts = _matching(texts, width)
    texts = written(texts.select("cid", "family", "chunks", "text").dropDuplicates(["cid"]), "near-texts")
    bins = blocks_for(of_family.agg(F.sum("n")).first()[0] or 0, 300_000)
    small = texts.filter("chunks = 1").select(F.pmod(F.xxhash64("family"), F.lit(bins)).alias("bin"), F.col("family").alias("grp"), "cid", "text", F.lit(0).alias("side"))
    links = written(_confirmed(small, width, percent), "near-links-small")
    large = texts.filter("chunks > 1").withColumn("mine", F.pmod(F.xxhash64("cid"), F.col("chunks")))
    every = F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)
    order = Window.partitionBy("family").orderBy(F.xxhash64(F.lit(1), "cid"))
    middle = large.select("family", "cid", "chunks", F.col("text")).withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= centres)
    group = F.xxhash64("family", "i", "j")
    round1 = large.select("family", F.col("mine").alias("i"), F.lit(-1).cast("long").alias("j"), "cid", "text", F.lit(0).alias("side")).union(
        middle.select("family", F.explode(every).alias("i"), F.lit(-1).cast("long").alias("j"), "cid", "text", F.lit(1).alias("side"))
    )
    links1 = written(_confirmed(round1.withColumn("grp", group).withColumn("bin", F.col("grp")), width, percent), "near-links-centres")
    part = connected_components(links1).select(F.col("node").alias("cid"), "component")
    state = written(large.join(part, "cid", "left").withColumn("component", F.coalesce("component", "cid")), "near-large")
    top = state.groupBy("family", "component").count().groupBy("family").agg(F.max_by("component", F.struct("count", "component")).alias("top"), F.sum("count").alias("members"))
    state = _salted(state, written(top, "near-tops"), "family", "cid", "members")
    lone = state.filter("component <> top")
    sides = lone.select("family", F.col("mine").alias("i"), F.explode(every).alias("j"), "cid", "text", F.lit(0).alias("side")).union(
        state.join(lone.select("family", F.col("mine").alias("i")).distinct(), "family").select("family", "i", F.col("mine").alias("j"), "cid", "text", F.lit(1).alias("side"))
    )
    links2 = _confirmed(sides.withColumn("grp", group).withColumn("bin", F.col("grp")), width, percent)
    final = connected_components(links.union(links1).union(links2))

    ids = classes.select(F.col("set").alias("node"), "fp", "cid", "copies").join(final, "node", "left").withColumn("component", F.coalesce("component", "node"))
    ids = written(ids, "near-components")
    smallest = written(ids.groupBy("component").agg(F.min("cid").alias("component_id"), F.count("*").alias("members")), "near-smallest")
    of_class = written(_salted(ids, smallest, "component", "node", "members").select("fp", "component_id", "copies"), "near-ids")
    # texts without words have no class: their ids spread them
    spread = F.when(F.col("n") > 0, F.col("fp")).otherwise(F.encode(F.col("id").cast("string"), "utf-8"))
    out = _salted(feats.select("id", "n", spread.alias("fp")), of_class, "fp", "id", "copies", "left")
    alone = F.when(F.col("id").isNotNull(), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")))
    out = out.select("id", F.col("n").alias("n_shingles"), alone.alias("component_id"))
    return out.withColumn("kept", F.col("id") == F.col("component_id")).withColumnRenamed("id", id_col)


def _matching(texts: DataFrame, width: int) -> DataFrame:
    """Of several texts of one id those whose set is the class they were picked for."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        own = shingler(width)
        for batch in batches:
            fps = [hashlib.blake2b(own.sets(t).tobytes(), digest_size=16).digest() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fps, pa.binary())], [*batch.schema.names, "found"])

    picked = texts.select("text", "cid", "family", "chunks")
    marked = picked.mapInArrow(work, "text string, cid long, family long, chunks long, found binary")
    return marked.filter(F.xxhash64("found") == F.col("cid"))

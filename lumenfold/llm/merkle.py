"""A Merkle manifest of a table: leaf digests, a tree for each part, a root over the parts' roots, a proof for each row.

Leaves of a part are numbered by range partitions and their sizes, then cut into aligned blocks of ``2 ** levels``. Blocks give
their roots, which are the leaves of the next round, until one node remains. On the way down every block walks its leaves by
fractal traversal (stacked subtrees, an existing and a desired one at each height) and puts the path of its own root behind
the paths inside. The roots of the parts go through the same rounds as one more tree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.llm.common import written

LONE = "-"  # a level at which a node has no sibling


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value: Column) -> Column:
    """A value as it enters a leaf: its UTF-8 byte count, a colon, the value; a null as a dash."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(values: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def levels_of(n: int) -> int:
    """Levels above ``n`` nodes until one remains."""
    return max(0, n - 1).bit_length()


class Subtree:
    """The nodes at heights ``low`` up to below ``high`` under node ``at`` of height ``high``, grown by one leaf a step; a stack
    holds what isn't joined yet. Leaves behind the last one are absent, and so is a node without a leaf."""

    def __init__(self, leaves: list[str], low: int, high: int, at: int):
        self.leaves, self.low, self.high = leaves, low, high
        self.next, self.end = at << high, (at + 1) << high
        self.stack: list[tuple[int, str | None]] = []
        self.nodes: dict[tuple[int, int], str] = {}

    def step(self) -> None:
        if self.next >= self.end:
            return
        node, height, at = self.leaves[self.next] if self.next < len(self.leaves) else None, 0, self.next
        self.next += 1
        while True:
            if node is not None and self.low <= height < self.high:
                self.nodes[height, at] = node
            if not self.stack or self.stack[-1][0] != height or height == self.high:
                break
            left = self.stack.pop()[1]
            node = None if left is None else digest(left) if node is None else digest(left, node)
            height, at = height + 1, at >> 1
        self.stack.append((height, node))

    def whole(self) -> Subtree:
        while self.next < self.end:
            self.step()
        return self

    @property
    def root(self) -> str | None:
        return self.stack[-1][1]


def block_root(leaves: list[str], levels: int) -> str:
    return Subtree(leaves, levels, levels, 0).whole().root


def traverse(leaves: list[str], levels: int, band: int = 2) -> Iterator[list[str]]:
    """The path of each leaf in order, from the bottom up: ``<digest`` for a sibling on the left, ``>digest`` for one on the
    right, ``-`` for none. At each band of heights one subtree exists and the next one to its right grows by a leaf a step,
    so it is whole when the walk leaves the first; a band holds two subtrees and a stack, whatever the number of leaves."""
    bands = [(low, min(low + band, levels)) for low in range(0, levels, band)]
    exist = [Subtree(leaves, low, high, 0).whole() for low, high in bands]
    desired = [Subtree(leaves, low, high, 1) for low, high in bands]
    for t in range(len(leaves)):
        path = []
        for (low, high), tree in zip(bands, exist, strict=True):
            for height in range(low, high):
                at = t >> height
                sibling = tree.nodes.get((height, at ^ 1))
                path.append(LONE if sibling is None else ("<" if at & 1 else ">") + sibling)
        yield path
        for i, (low, high) in enumerate(bands):
            desired[i].step()
            if (t + 1) % (1 << high) == 0:
                exist[i], desired[i] = desired[i], Subtree(leaves, low, high, ((t + 1) >> high) + 1)


def fold_path(node: str, path: list[str]) -> str:
    """The root that a node and its path lead to."""
    for step in path:
        node = digest(node) if step == LONE else digest(step[1:], node) if step[0] == "<" else digest(node, step[1:])
    return node


def numbered(rows: DataFrame, part: str, order: list[str], name: str) -> DataFrame:
    """``rows`` with ``at`` (from 0 within the part, in order) and ``size`` (of the part).

    Rows are dealt by ranges of part and order, so a large part lies in many tasks; what tells their numbers is the count of
    each part in each task. Rows alike in every key are told apart by where they were read, so they spread as well."""
    keys = [F.col(c).asc_nulls_first() for c in (part, *order)]
    dealt = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*keys, "row").sortWithinPartitions(*keys, "row").drop("row")
    dealt = written(dealt.withColumn("row", F.monotonically_increasing_id()).withColumn("task", F.shiftright("row", 33)), f"merkle-{name}")
    each = dealt.groupBy(part, "task").agg(F.count("*").alias("n"), F.min("row").alias("first"))
    before = F.sum("n").over(Window.partitionBy(part).orderBy("task")) - F.col("n")
    each = each.withColumns({"before": before, "size": F.sum("n").over(Window.partitionBy(part))}).drop("n")
    return dealt.join(each, [part, "task"]).withColumn("at", F.col("row") - F.col("first") + F.col("before")).drop("row", "task", "first", "before")


def _roots(nodes: DataFrame, levels: int, name: str) -> DataFrame:
    """Nodes of the next round: the root of each block of (part, at, digest, size)."""

    def root(key: tuple, rows: pa.Table) -> pa.Table:
        at, digests, size = rows["at"].to_pylist(), rows["digest"].to_pylist(), rows["size"][0].as_py()
        leaves = [d for _, d in sorted(zip(at, digests, strict=True))]
        top = block_root(leaves, min(levels, levels_of(size)))
        return pa.table({"part": pa.array([key[0].as_py()], pa.string()), "at": pa.array([key[1].as_py()], pa.int64()), "digest": [top], "size": pa.array([-(-size >> levels)], pa.int64())})

    blocks = nodes.select("part", "at", "digest", "size", F.shiftright("at", levels).alias("block")).groupBy("part", "block")
    return written(blocks.applyInArrow(root, "part string, at long, digest string, size long"), f"merkle-{name}")


def _paths(nodes: DataFrame, above: DataFrame, levels: int) -> DataFrame:
    """The path of each node (part, at, digest, size) behind the path of its block's root (part, block, path, subroot, root)."""
    blocks = nodes.select("part", "at", "digest", "size", F.shiftright("at", levels).alias("block")).groupBy("part", "block")

    def walk(key: tuple, rows: pa.Table, top: pa.Table) -> pa.Table:
        top = top.to_pylist()[0]
        rows = rows.sort_by("at")
        paths = [" ".join([*path, *filter(None, [top["path"]])]) for path in traverse(rows["digest"].to_pylist(), min(levels, levels_of(rows["size"][0].as_py())))]
        n = len(rows)
        return pa.table({"part": rows["part"], "block": rows["at"], "path": paths, "subroot": pa.array([top["subroot"]] * n, pa.string()), "root": pa.array([top["root"]] * n, pa.string())})

    return blocks.cogroup(above.groupBy("part", "block")).applyInArrow(walk, "part string, block long, path string, subroot string, root string")


def _climb(nodes: DataFrame, levels: int, name: str) -> list[DataFrame]:
    """The nodes of every round; in the last one each part has one node."""
    rounds = [nodes]
    while (rounds[-1].agg(F.max("size")).first()[0] or 0) > 1:
        rounds.append(_roots(rounds[-1], levels, f"{name}-{len(rounds)}"))
    return rounds


def authenticated(docs: DataFrame, fields: list[str], part_col: str, id_col: str, presented: dict[str, Column] | None = None, paths: bool = False, levels: int = 10) -> DataFrame:
    """One row a row of ``docs``: ``id`` (the id column), ``part``, ``at``, ``leaf``, ``subroot``, ``root``, ``proof_sha256``
    (of the siblings from the bottom up), ``folded_root`` (from the presented row's leaf and the stored row's siblings),
    ``verified`` (the roots are equal), and ``path`` where asked for (``traverse``'s steps, by spaces).

    fields: the columns of a leaf in order; part_col: a string column; presented: values that are presented for verification
    in place of those columns; levels: a block holds ``2 ** levels`` leaves, what one task sees together.

    Nulls are values of their own: parts and ids ascend with null first. Rows with one id stand in the order of their digests;
    repeated rows are leaves of their own with paths of their own. An empty text is a value of no bytes, a very long one is
    hashed where it is read. An empty table gives no rows. Other columns take no part, whatever their names.
    """
    changed = [(presented or {}).get(c, F.col(c)) for c in fields]
    stored, given = leaf([F.col(c) for c in fields]), leaf(changed)
    part = F.when(F.col(part_col).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(part_col).cast("string")))
    told = written(docs.select(F.col(id_col).alias("id"), part.alias("part"), stored.alias("digest"), given.alias("given")).withColumn("given", F.when(F.col("given") != F.col("digest"), F.col("given"))), "merkle-leaves")
    leaves = written(numbered(told, "part", ["id", "digest"], "dealt"), "merkle-numbered")
    trees = _climb(leaves.select("part", "at", "digest", "size"), levels, "round")
    tops = trees[-1].select(F.lit("").alias("all"), F.col("part").alias("name"), "digest")
    tops = written(numbered(tops, "all", ["name"], "parts").select(F.col("all").alias("part"), "name", "at", "digest", "size"), "merkle-tops")
    upper = _climb(tops.select("part", "at", "digest", "size"), levels, "top")
    none = F.lit("").alias("path")
    above = upper[-1].select("part", F.lit(0).cast("long").alias("block"), none, F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    for nodes in reversed(upper[:-1]):
        above = written(_paths(nodes, above, levels), "merkle-upper")
    ends = above.select(F.col("block").alias("at"), "path", "root")
    above = tops.join(ends, "at").select(F.col("name").alias("part"), F.lit(0).cast("long").alias("block"), "path", F.col("digest").alias("subroot"), "root")
    for nodes in reversed(trees[1:-1]):
        above = written(_paths(nodes, above, levels), "merkle-path")

    def prove(key: tuple, rows: pa.Table, top: pa.Table) -> pa.Table:
        top = top.to_pylist()[0]
        tail, rows = top["path"].split(), rows.sort_by("at")
        digests, given = rows["digest"].to_pylist(), rows["given"].to_pylist()
        proof, folded, whole = [], [], []
        for own, other, path in zip(digests, given, traverse(digests, min(levels, levels_of(rows["size"][0].as_py()))), strict=True):
            path += tail
            proof.append(digest(*[step[1:] for step in path if step != LONE]))
            folded.append(fold_path(other or own, path))
            whole.append(" ".join(path))
        out = {c: rows[c] for c in ("id", "part", "at", "digest")} | {"subroot": [top["subroot"]] * len(rows), "root": [top["root"]] * len(rows), "proof_sha256": proof, "folded_root": folded}
        return pa.table(out | ({"path": whole} if paths else {}))

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, part string, at long, digest string, subroot string, root string, proof_sha256 string, folded_root string" + ", path string" * paths
    blocks = leaves.withColumn("block", F.shiftright("at", levels)).groupBy("part", "block")
    proofs = blocks.cogroup(above.groupBy("part", "block")).applyInArrow(prove, schema)
    named = proofs.withColumns({"part": F.when(F.col("part") != "", F.substring("part", 2, 2**31 - 1)), "verified": F.col("folded_root") == F.col("root")})
    return named.withColumnRenamed("digest", "leaf")


#: The same trees, proofs and folds by recursion over nodes. CRC-32 by its bitwise definition over the id's decimal digits.
ORACLE = """
WITH RECURSIVE d AS (
  SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n,
    concat(coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR), '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-')) AS head,
    coalesce(strlen(text) || ':' || text, '-') AS tail, n_chars,
    xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT)),
      lambda crc, b: list_reduce([0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[], lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END, xor(crc, b)), 4294967295::BIGINT), 4294967295::BIGINT) AS crc
  FROM documents),
leaves AS (
  SELECT doc_id, coalesce('=' || lang, '') AS part, i, n, sha256(head || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
    sha256(head || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(CAST(n_chars + CAST(crc % 7 = 0 AS INT) AS VARCHAR)) || ':' || (n_chars + CAST(crc % 7 = 0 AS INT)) END || tail) AS given
  FROM d),
nodes(part, level, i, n, h) AS (
  SELECT part, 0, i, n, leaf FROM leaves
  UNION ALL
  SELECT part, level + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY part, level, i // 2, n),
sub AS (SELECT part, h, row_number() OVER (ORDER BY part) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops(level, i, n, h) AS (
  SELECT 0, i, n, h FROM sub
  UNION ALL
  SELECT level + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM tops WHERE n > 1 GROUP BY level, i // 2, n),
steps AS (
  SELECT l.doc_id, 0 AS phase, a.level, a.i, s.h FROM leaves l JOIN nodes a ON a.part = l.part AND a.n > 1 AND a.i = l.i >> a.level LEFT JOIN nodes s ON s.part = a.part AND s.level = a.level AND s.i = xor(a.i, 1)
  UNION ALL
  SELECT l.doc_id, 1, a.level, a.i, s.h FROM leaves l JOIN sub USING (part) JOIN tops a ON a.n > 1 AND a.i = sub.i >> a.level LEFT JOIN tops s ON s.level = a.level AND s.i = xor(a.i, 1)),
paths AS (
  SELECT doc_id, list(CASE WHEN h IS NULL THEN '-' WHEN i % 2 = 1 THEN '<' || h ELSE '>' || h END ORDER BY phase, level) AS path, coalesce(string_agg(h, '' ORDER BY phase, level), '') AS siblings FROM steps GROUP BY doc_id),
found AS (
  SELECT l.doc_id, l.leaf, sub.h AS subroot, (SELECT h FROM tops WHERE n = 1) AS root, sha256(coalesce(siblings, '')) AS proof_sha256,
    list_reduce(coalesce(path, []), lambda a, s: CASE WHEN s = '-' THEN sha256(a) WHEN s[1] = '<' THEN sha256(s[2:] || a) ELSE sha256(a || s[2:]) END, l.given) AS folded_root
  FROM leaves l JOIN sub USING (part) LEFT JOIN paths p ON p.doc_id = l.doc_id)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM found"""

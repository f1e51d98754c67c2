"""Line deduplication by pairwise alignment: a later document loses the blocks it shares, in order, with an earlier one.

Overlapping documents are found through hashes that few documents share: of lines that fill a block by themselves, and of
runs of adjacent lines that just fill one. Each names the earliest document that has it, and the later holders are paired
with that one. Every line of a shared block stands in such a run, so its pair is found wherever its lines stand singly
before; none makes more pairs than its holders, however many they are; equal documents are paired with the first of them.
Pairs are aligned by patience diff over the lines. Where it finds no order to go by, the heaviest shared runs are taken, and
passages that either side repeats go wherever they stand.

Two blocks can cross between a document and the earliest holder, so that one of them stays. A run that stays is held against
its other holders before the document, from the nearest backwards, twice as many a round, until one has it in order.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import written
from lumenfold.llm.merkle import numbered

_PRIME, _BASE = (1 << 61) - 1, 0x9E3779B97F4A7C1


def block_spans(hashes: list[int], words: list[int], min_words: int) -> Iterator[tuple[int, int, int]]:
    """The hash and the ends of each run of two lines or more that reaches ``min_words`` and would not without its last or its
    first line, which are not blank: the shortest from each line on and the shortest up to each line."""
    n = len(hashes)
    sums, rolled, powers = [0], [0], [1]
    for h, w in zip(hashes, words, strict=True):
        sums.append(sums[-1] + w)
        rolled.append((rolled[-1] * _BASE + h) % _PRIME)
        powers.append(powers[-1] * _BASE % _PRIME)
    spans = set()
    hi = 0
    for lo in range(n):  # the shortest from lo on
        while hi < n and sums[hi] - sums[lo] < min_words:
            hi += 1
        if sums[hi] - sums[lo] < min_words:
            break
        if words[lo] and hi > lo + 1:
            spans.add((lo, hi))
    lo = 0
    for hi in range(1, n + 1):  # the shortest up to hi
        while sums[hi] - sums[lo + 1] >= min_words and lo + 1 < hi:
            lo += 1
        if words[hi - 1] and hi > lo + 1 and sums[hi] - sums[lo] >= min_words:
            spans.add((lo, hi))
    for lo, hi in spans:
        yield (rolled[hi] - rolled[lo] * powers[hi - lo]) % _PRIME, lo, hi


def block_runs(hashes: list[int], words: list[int], min_words: int) -> set[int]:
    return {h for h, _, _ in block_spans(hashes, words, min_words)}


def left_over(a: list[int], words_a: list[int], b: list[int], words: list[int], cut: list[int], min_words: int) -> set[int]:
    """Hashes of the lines and runs of b that fill a block, that a holds too, and that aren't cut whole: those that cross."""
    gone, known = set(cut), set(a)
    if all(j in gone or not w or x not in known for j, (x, w) in enumerate(zip(b, words, strict=True))):
        return set()
    single = {x for j, (x, w) in enumerate(zip(b, words, strict=True)) if w >= min_words and x in known and j not in gone}
    runs = {h for h, lo, hi in block_spans(b, words, min_words) if any(words[j] and j not in gone for j in range(lo, hi))}
    return single | (runs & block_runs(a, words_a, min_words) if runs else runs)


class Runs:
    """A suffix automaton of a sequence: finds where the runs of another one stand in it."""

    def __init__(self, a: list[int]):
        self.next, self.link, self.length, self.end = [{}], [-1], [0], [0]
        last = 0
        for p, x in enumerate(a, 1):
            state = self._add({}, 0, self.length[last] + 1, p)
            while last != -1 and x not in self.next[last]:
                self.next[last][x] = state
                last = self.link[last]
            if last != -1:
                to = self.next[last][x]
                if self.length[last] + 1 < self.length[to]:
                    twin = self._add(dict(self.next[to]), self.link[to], self.length[last] + 1, self.end[to])
                    self.link[to] = twin
                    while last != -1 and self.next[last].get(x) == to:
                        self.next[last][x] = twin
                        last = self.link[last]
                    to = twin
                self.link[state] = to
            last = state

    def _add(self, following: dict[int, int], link: int, length: int, end: int) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        self.end.append(end)
        return len(self.next) - 1

    def longest(self, b: list[int]) -> Iterator[tuple[int, int]]:
        """For each position of ``b``: the length of the longest run up to it that the sequence holds, and where one ends."""
        state = n = 0
        for x in b:
            while state and x not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            if x in self.next[state]:
                state, n = self.next[state][x], n + 1
            yield n, self.end[state]


def _can_hold(a: list[int], b: list[int], words: list[int], least: int) -> bool:
    """Whether lines of ``b`` that ``a`` has too stand together with ``least`` words."""
    known, total = set(a), 0
    for x, w in zip(b, words, strict=True):
        total = total + w if x in known else 0
        if total >= least:
            return True
    return False


def heaviest_run(a: list[int], b: list[int], words: list[int], least: int) -> tuple[int, int, int] | None:
    """Starts in both and length of the shared run of most words, if that is ``least``; ``words`` are those of ``b``."""
    if not _can_hold(a, b, words, least):
        return None
    sums = [0]
    for w in words:
        sums.append(sums[-1] + w)
    weight, n, end, j = max((sums[j] - sums[j - n], n, -end, -j) for j, (n, end) in enumerate(Runs(a).longest(b), 1))
    return (-end - n, -j - n, n) if weight >= least else None


def patience_pairs(a: list[int], b: list[int], words: list[int] | None = None, least: int = 1) -> list[tuple[int, int]]:
    """Aligned equal positions of two sequences, rising in both. Equal heads and tails are taken first, then the longest
    rising run of elements that each side holds once, or where there is none the shared run of most ``words`` (of b's
    elements, one each by default) that has ``least``, and the stretches between go the same way."""
    out: list[tuple[int, int]] = []
    words = [1] * len(b) if words is None else words
    todo = [(0, len(a), 0, len(b))]
    while todo:
        lo_a, hi_a, lo_b, hi_b = todo.pop()
        while lo_a < hi_a and lo_b < hi_b and a[lo_a] == b[lo_b]:
            out.append((lo_a, lo_b))
            lo_a, lo_b = lo_a + 1, lo_b + 1
        while lo_a < hi_a and lo_b < hi_b and a[hi_a - 1] == b[hi_b - 1]:
            hi_a, hi_b = hi_a - 1, hi_b - 1
            out.append((hi_a, hi_b))
        if lo_a == hi_a or lo_b == hi_b:
            continue
        times_a, times_b = Counter(a[lo_a:hi_a]), Counter(b[lo_b:hi_b])
        where = {b[j]: j for j in range(lo_b, hi_b) if times_b[b[j]] == 1}
        once = [(i, where[a[i]]) for i in range(lo_a, hi_a) if times_a[a[i]] == 1 and a[i] in where]
        if once:
            run = _rising(once)
        elif found := heaviest_run(a[lo_a:hi_a], b[lo_b:hi_b], words[lo_b:hi_b], least):
            run = [(lo_a + found[0] + k, lo_b + found[1] + k) for k in range(found[2])]
        else:
            continue
        out += run
        edges = [(lo_a - 1, lo_b - 1), *run, (hi_a, hi_b)]
        todo += [(p + 1, q, r + 1, s) for (p, r), (q, s) in zip(edges, edges[1:], strict=False) if q > p + 1 and s > r + 1]
    return sorted(out)


def _rising(once: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs that rises in the second place too."""
    tails: list[int] = []  # the smallest end of a rising run of each length
    ends: list[int] = []
    before: list[int] = []
    for k, (_, j) in enumerate(once):
        at = bisect_left(tails, j)
        before.append(ends[at - 1] if at else -1)
        if at == len(tails):
            tails.append(j)
            ends.append(k)
        else:
            tails[at], ends[at] = j, k
    run, k = [], ends[-1]
    while k >= 0:
        run.append(once[k])
        k = before[k]
    run.reverse()
    return run


def common_blocks(a: list[int], b: list[int], words: list[int], min_words: int) -> list[int]:
    """Positions of b in runs of ``min_words`` words or more that a holds unbroken too: those that can be aligned in order,
    and those of lines that a or b repeats wherever they stand. What is left of such runs crosses an aligned one and has a
    line that each side holds once."""
    blocks: list[tuple[int, int, int]] = []  # starts in both, length
    for i, j in patience_pairs(a, b, words, min_words):
        if blocks and (i, j) == (blocks[-1][0] + blocks[-1][2], blocks[-1][1] + blocks[-1][2]):
            blocks[-1] = (*blocks[-1][:2], blocks[-1][2] + 1)
        else:
            blocks.append((i, j, 1))
    blocks = [x for x in blocks if sum(words[x[1] : x[1] + x[2]]) >= min_words]
    # aligned lines that fill no block stand in no block's way: what lies between the blocks is searched without them
    edges = [(0, 0, 0), *blocks, (len(a), len(b), 0)]
    todo = [(i + n, p, j + n, q) for (i, j, n), (p, q, _) in zip(edges, edges[1:], strict=False)]
    while todo:
        lo_a, hi_a, lo_b, hi_b = todo.pop()
        if found := heaviest_run(a[lo_a:hi_a], b[lo_b:hi_b], words[lo_b:hi_b], min_words):
            i, j, n = lo_a + found[0], lo_b + found[1], found[2]
            blocks.append((i, j, n))
            todo += [(lo_a, i, lo_b, j), (i + n, hi_a, j + n, hi_b)]
    blocks.sort()
    edges = [(0, 0, 0), *blocks, (len(a), len(b), 0)]
    cut = set()
    for (i, j, n), (p, q, m), (r, s, _) in zip(edges, edges[1:], edges[2:], strict=False):
        lo = hi = 0  # lines that the block grows by
        while p - lo > i + n and q - lo > j + n and a[p - lo - 1] == b[q - lo - 1]:
            lo += 1
        while p + m + hi < r and q + m + hi < s and a[p + m + hi] == b[q + m + hi]:
            hi += 1
        cut.update(range(q - lo, q + m + hi))
    times_a, times_b = Counter(a), Counter(b)
    free = [None if j in cut or words[j] and times_a[x] == times_b[x] == 1 else x for j, x in enumerate(b)]
    if _can_hold(a, free, words, min_words):
        sums, done = [0], 0
        for j, (n, _) in enumerate(Runs(a).longest(free), 1):
            sums.append(sums[-1] + words[j - 1])
            if sums[j] - sums[j - n] >= min_words:
                cut.update(range(max(j - n, done), j))
                done = j
    return sorted(cut)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 20, part_pairs: int = 1000) -> DataFrame:
    """``docs`` with the shared blocks taken out of ``text_col``, and ``lines_total`` and ``lines_removed`` beside it.

    A block is a run of lines, equal but for outer spaces, of ``min_words`` words in all. The smaller id is the earlier
    document (among rows of one id, the smaller text hash), and the earliest holder of a line keeps it. Null texts stay
    null; empty texts and texts without a shared block stay as they are; rows with a null id are neither read nor changed;
    equal rows of one id stay equal. Very long texts are aligned whole; time and memory grow with their lines. A text that
    goes as a whole becomes empty. Lines are compared by 96 bits of hashes. All columns come back, whatever
    their names. A block that crosses another one between a document and every earlier holder stays. The partner of many
    documents is dealt over tasks of about ``part_pairs`` pairs.
    """
    lines = F.split(F.col(text_col), "\n")
    plain = F.transform(lines, lambda x: F.trim(x))
    free = next(i for i in range(len(docs.columns) + 1) if not any(c.lower().startswith(f"__ld{i}_") for c in docs.columns))
    own = lambda name: f"__ld{free}_{name}"
    marked = docs.withColumn(own("mark"), F.xxhash64(F.col(text_col)))
    counted = F.transform("plain", lambda x: F.when(x == "", 0).otherwise(F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1).cast("int"))
    keyed = marked.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(own("mark")).alias("th"), plain.alias("plain")).select(
        "id", "th", F.transform("plain", lambda x: F.xxhash64(x)).alias("hashes"), F.transform("plain", lambda x: F.hash(x)).alias("checks"), counted.alias("words")
    )
    keyed = written(keyed, "lines")
    id_type = docs.schema[id_col].dataType.simpleString()

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [block_runs(h, w, min_words) for h, w in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            at = pa.array([k for k, x in enumerate(own) for _ in x], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array([h for x in own for h in x], pa.int64())], ["id", "th", "h"])

    # what fills no block can't be all that two documents share, so it makes no pair
    filled = F.filter(F.arrays_zip("hashes", "words"), lambda x: x["words"] >= min_words)
    held = keyed.select("id", "th", F.explode(F.array_distinct(F.transform(filled, lambda x: x["hashes"]))).alias("h"))
    several = keyed.filter(F.size("hashes") > 1)
    whole = several.filter(F.aggregate("words", F.lit(0), lambda s, w: s + w) >= min_words).select("id", "th", F.xxhash64("hashes").alias("h"))
    held = held.union(several.select("id", "th", "hashes", "words").mapInArrow(runs, f"id {id_type}, th long, h long")).union(whole).distinct()
    first = held.groupBy("h").agg(F.min(F.struct("id", "th")).alias("first"), F.count("*").alias("df")).filter("df > 1")
    pairs = held.join(first, "h").filter((F.col("first.id") != F.col("id")) | (F.col("first.th") != F.col("th")))
    sequences = keyed.dropDuplicates(["id", "th"])

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joined = lambda hs, cs: [x << 32 | y & 0xFFFFFFFF for x, y in zip(hs, cs, strict=True)]
        for batch in batches:
            h0, c0, w0, h, c, words = (batch.column(i).to_pylist() for i in range(4, 10))
            cut = [common_blocks(joined(h0[i], c0[i]), joined(h[i], c[i]), words[i], min_words) for i in range(batch.num_rows)]
            left = [list(left_over(h0[i], w0[i], h[i], words[i], cut[i], min_words)) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(cut, pa.list_(pa.int32())), pa.array(left, pa.list_(pa.int64()))], ["id", "th", "id0", "th0", "cut", "left"])

    def aligned(pairs: DataFrame) -> DataFrame:
        """Pairs (id, th, id0, th0) with what the first loses to the second, and what they share but can't align."""
        # a frequent line makes one document the partner of many: only such ones are copied, once for each part of their pairs
        busy = pairs.groupBy("id0", "th0").agg(F.count("*").alias("n")).filter(F.col("n") > part_pairs).select("id0", "th0", F.ceil(F.col("n") / part_pairs).cast("int").alias("parts"))
        salted = pairs.join(busy, ["id0", "th0"], "left").withColumn("salt", F.pmod(F.xxhash64("id", "th"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
        later = salted.join(sequences, ["id", "th"])
        earlier = sequences.select(F.col("id").alias("id0"), F.col("th").alias("th0"), *[F.col(c).alias(f"{c}0") for c in ("hashes", "checks", "words")])
        owners = salted.select("id0", "th0", "salt").distinct().join(earlier, ["id0", "th0"])
        both = later.join(owners, ["id0", "th0", "salt"]).select("id", "th", "id0", "th0", "hashes0", "checks0", "words0", "hashes", "checks", "words")
        return written(both.mapInArrow(align, f"id {id_type}, th long, id0 {id_type}, th0 long, cut array<int>, left array<long>"), "line-cuts")

    pairs = written(pairs.select("id", "th", F.col("first.id").alias("id0"), F.col("first.th").alias("th0")).distinct(), "line-pairs")
    cuts = [aligned(pairs)]
    open_ = written(cuts[0].select("id", "th", F.explode("left").alias("h")).distinct(), "line-left")
    if not open_.isEmpty():
        holders = written(numbered(held.join(open_.select("h").distinct(), "h", "left_semi").withColumn("part", F.col("h").cast("string")), "part", ["id", "th"], "line-holders").select("h", "id", "th", "at"), "line-holders")
        open_ = open_.join(holders, ["h", "id", "th"])
        back = 0
    while not open_.isEmpty():
        # from the nearest holder before the document backwards, twice as many in each round; holder 0 came first of all
        reach = 2 * back + 2
        steps = F.explode(F.sequence(F.greatest(F.lit(1).cast("long"), F.col("at") - reach), F.col("at") - back - 1)).alias("at0")
        asked = open_.filter(F.col("at") > back + 1).select("h", "id", "th", "at", steps)
        asked = written(asked.join(holders.select("h", F.col("at").alias("at0"), F.col("id").alias("id0"), F.col("th").alias("th0")), ["h", "at0"]), "line-asked")
        cuts.append(aligned(asked.select("id", "th", "id0", "th0").distinct()))
        still = asked.join(cuts[-1], ["id", "th", "id0", "th0"]).groupBy("h", "id", "th", "at").agg(F.min(F.array_contains("left", F.col("h"))).alias("open"))
        open_, back = written(still.filter("open").drop("open"), "line-left"), reach

    every = reduce(DataFrame.union, [c.select("id", "th", "cut") for c in cuts]).filter(F.size("cut") > 0)
    every = every.groupBy(F.col("id").alias(own("id")), F.col("th").alias(own("hash"))).agg(F.array_distinct(F.flatten(F.collect_list("cut"))).alias(own("cut")))
    # small or large, the cuts meet the texts by a shuffle: a table that is broadcast while it is small moves nothing at first
    joined = marked.join(every.hint("merge"), (F.col(id_col) == F.col(own("id"))) & (marked[own("mark")] == every[own("hash")]), "left")

    def rest(parts: Column) -> Column:
        """The lines that stay; the split text is a lambda's argument, so that it is made once."""
        at = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(own("cut")))
        return F.array_join(F.transform(at, lambda i: F.get(parts, i)), "\n")

    text = F.when(F.col(own("cut")).isNull(), F.col(text_col)).otherwise(F.element_at(F.transform(F.array(lines), rest), 1))
    columns = [text.alias(text_col) if c == text_col else F.col(c) for c in docs.columns]
    total = F.when(F.col(text_col).isNull(), 0).otherwise(F.size(lines)).cast("long")
    return joined.select(*columns, total.alias("lines_total"), F.coalesce(F.size(own("cut")), F.lit(0)).cast("long").alias("lines_removed"))

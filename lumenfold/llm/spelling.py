"""Spelling variants: words of a corpus that are one edit apart, and the frequent form each rare one stands for.

Two words one edit apart share what stands before the edit and what stands behind it. So for each edit position the words that
share the front are an interval in forward order, those that share the back an interval in reverse order, and the near ones
are the points in both: a range report on a wavelet tree over the reverse ranks in forward order.

Words meet by half a word: an edit in the second half leaves the first as it is. Groups that are too large are cut by halving
the range of edit positions, which lengthens what their words share, down to a single position.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import trim, written

LETTERS = re.compile(rb"[a-z\xc0-\xff]+")  # of texts in Latin-1, lower-cased


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 6, min_count: int = 5, slip: int | None = None, held_words: int = 300_000) -> DataFrame:
    """``word`` and ``n``, its occurrences in all whole texts, for words of ``min_length`` code points and ``min_count``
    occurrences or more. Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, of which A-Z are lower-cased; a null text
    has none.

    slip: the checksum of a document's id and a run that it divides takes one code point out of that run, a planted slip
    that doesn't depend on how rows are dealt (None: runs stay as they are). A null id counts as an empty one. A task adds up
    ``held_words`` different words before it passes them on."""
    runs = re.compile(LETTERS.pattern.replace(b"+", b"{%d,}" % min_length))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def passed() -> pa.RecordBatch:
            words = pa.array([w.decode("latin-1") for w in held], pa.string())
            out = pa.RecordBatch.from_arrays([words, pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                found = Counter(runs.findall((text.as_py() or "").encode("latin-1", "replace").lower()))
                if slip:
                    start = zlib.crc32(f"{'' if key.as_py() is None else key.as_py()}:".encode())
                    for run in [r for r in found if zlib.crc32(r if r.isascii() else r.decode("latin-1").encode(), start) % slip == 0]:
                        at = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start) % len(run)
                        n, shorter = found.pop(run), run[:at] + run[at + 1 :]
                        if len(shorter) >= min_length:
                            held[shorter] += n
                for run, n in found.items():
                    held[run] += n
                if len(held) >= held_words:
                    yield passed()
        yield passed()
        trim()

    counted = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


class WaveletTree:
    """A permutation of 0 .. n-1, level by level from the highest bit, with counts of the zeros before each place."""

    def __init__(self, values: np.ndarray):
        values = values.astype(np.int64)
        self.bits = max(1, max(0, len(values) - 1).bit_length())
        self.zeros = []
        for bit in reversed(range(self.bits)):
            high = (values >> bit & 1).astype(bool)
            self.zeros.append(np.concatenate([[0], np.cumsum(~high)]))
            values = np.concatenate([values[~high], values[high]])

    def report(self, left: np.ndarray, right: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For queries of places [left, right) and values [low, high): the query and the value of every point in both."""
        query, node = np.arange(len(left)), np.zeros(len(left), dtype=np.int64)
        for bit, zeros in zip(reversed(range(self.bits)), self.zeros, strict=True):
            span = 1 << bit
            l0, r0 = zeros[left], zeros[right]
            l1, r1 = zeros[-1] + left - l0, zeros[-1] + right - r0
            first = (r0 > l0) & (node < high[query]) & (node + span > low[query])
            second = (r1 > l1) & (node + span < high[query]) & (node + 2 * span > low[query])
            left, right = np.concatenate([l0[first], l1[second]]), np.concatenate([r0[first], r1[second]])
            query, node = np.concatenate([query[first], query[second]]), np.concatenate([node[first], node[second] + span])
        return query, node


class _Order:
    """Rows of code points in one reading direction: ranks, and the interval of those that begin alike."""

    def __init__(self, codes: np.ndarray, short: np.ndarray):
        n, width = codes.shape
        self.by = np.argsort(np.ascontiguousarray(codes).view(f"U{width}").ravel(), kind="stable") if n else np.empty(0, np.int64)
        self.rank = np.empty(n, dtype=np.int64)
        self.rank[self.by] = np.arange(n)
        rows = codes[self.by]
        differ = rows[1:] != rows[:-1]
        self.alike = np.concatenate([[0], np.where(differ.any(1), differ.argmax(1), width)]) if n else np.empty(0, np.int64)
        self.shorts = np.concatenate([[0], np.cumsum(short[self.by])])  # short words before each place
        self.of_short = np.cumsum(short[self.by]) - 1

    def interval(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """For each word the places of those that share its first ``length`` code points."""
        begins = self.alike < length
        begins[:1] = True
        first = np.flatnonzero(begins)
        own = (np.cumsum(begins) - 1)[self.rank]
        return first[own], np.append(first[1:], len(begins))[own]


def near_pairs(words: np.ndarray, length: int, low: int, up: int, slice_words: int = 50_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (word, near word) of places in ``words``, which have ``length`` code points or one more: from the shorter words to
    those of their length (both ways) and to the longer ones (one way), for edits at positions ``low`` to ``up`` of the shorter
    word. The position of an edit is where the two first differ, so a pair comes at one position alone."""
    width, short = length + 1, np.char.str_len(words) == length
    codes = words.astype(f"U{width}").view(np.uint32).reshape(len(words), width)
    back = np.where(short[:, None], np.roll(codes[:, ::-1], -1, axis=1), codes[:, ::-1])
    ahead, behind = _Order(codes, short), _Order(back, short)
    asks = np.flatnonzero(short)
    trees = {}
    for same in (True, False):
        chosen = ahead.by[short[ahead.by] == same]
        places = behind.rank[chosen]
        trees[same] = WaveletTree(behind.shorts[places] if same else places - behind.shorts[places]), behind.by[short[behind.by] == same]
    for at in range(low, up + 1):
        f0, f1 = (x[asks] for x in ahead.interval(at))
        for same in (True, False):
            rest = length - at - same
            if rest < 0:
                continue
            b0, b1 = (x[asks] for x in behind.interval(rest))
            places = (ahead.shorts if same else np.arange(len(ahead.shorts)) - ahead.shorts), (behind.shorts if same else np.arange(len(behind.shorts)) - behind.shorts)
            left, right, under, over = places[0][f0], places[0][f1], places[1][b0], places[1][b1]
            open_ = np.flatnonzero((right - left > same) & (over - under > same))  # a word finds itself among its length
            tree, named = trees[same]
            for s in range(0, len(open_), slice_words):
                part = open_[s : s + slice_words]
                query, value = tree.report(left[part], right[part], under[part], over[part])
                word, near = asks[part[query]], named[value]
                keep = word != near if same else (codes[word, at] != codes[near, at])
                yield word[keep], near[keep]


def _summed(words: list[str], counts: np.ndarray, size: int, low: int, up: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of words with near ones: their places, how many, and the place of the near word of largest count, of ties the first."""
    array = np.array(words)
    order = np.empty(len(words), dtype=np.int64)
    order[np.argsort(array, kind="stable")] = np.arange(len(words))
    sizes, best = np.zeros(len(words), dtype=np.int64), np.full(len(words), -1)
    lengths = np.char.str_len(array)
    for word, near in near_pairs(array, size, low, up):
        longer = lengths[near] != lengths[word]
        a, b = np.concatenate([word, near[longer]]), np.concatenate([near, word[longer]])
        sizes += np.bincount(a, minlength=len(words))
        held = np.flatnonzero(best >= 0)
        a, b = np.concatenate([a, held]), np.concatenate([b, best[held]])
        first = np.lexsort((order[b], -counts[b], a))
        a, b = a[first], b[first]
        lead = np.concatenate([[True], a[1:] != a[:-1]]) if len(a) else np.zeros(0, bool)
        best[a[lead]] = b[lead]
    found = np.flatnonzero(sizes)
    return found, sizes[found], best[found]


def _entry(size: Column, low: Column, up: Column) -> Column:
    """The group of a word for pairs whose shorter word has ``size`` code points, edited from ``low`` to ``up``: what all its
    words share in front and behind."""
    behind = F.greatest(F.lit(0), size - 1 - up)
    key = F.concat(F.col("word").substr(F.lit(1), low), F.lit(" "), F.col("word").substr(F.length("word") - behind + 1, behind))
    return F.struct(size.cast("int").alias("size"), low.cast("int").alias("low"), up.cast("int").alias("up"), key.alias("key"))


def _halves(size: Column, low: Column, up: Column) -> Column:
    middle = F.floor((low + up + 1) / 2).cast("int")
    return F.explode(F.array(_entry(size, low, middle - 1), _entry(size, middle, up)))


def grouped(words: DataFrame, most_words: int) -> DataFrame:
    """``word``, ``n`` and ``size``, ``low``, ``up``, ``key`` of each group it is in. A pair one edit apart is together in
    exactly one group whose range has its position; groups have ``most_words`` at most, or one position."""
    length = F.length("word")
    sizes = words.withColumn("size", F.explode(F.array(length, length - 1)))
    open_ = sizes.select("word", "n", _halves(F.col("size"), F.lit(0), F.col("size")).alias("g")).select("word", "n", "g.*")
    group, done = ["size", "low", "up", "key"], []
    while True:
        large = open_.groupBy(group).agg(F.count("*").alias("held")).filter((F.col("held") > most_words) & (F.col("low") < F.col("up"))).drop("held")
        large = written(large, "spelling-large")
        if large.isEmpty():
            break
        done.append(open_.join(large, group, "left_anti"))
        again = open_.join(large, group, "left_semi").select("word", "n", _halves(F.col("size"), F.col("low"), F.col("up")).alias("g"))
        open_ = written(again.select("word", "n", "g.*"), "spelling-open")
    for x in done:
        open_ = open_.unionByName(x)
    return open_


def near_words(words: DataFrame, most_words: int = 100_000, most_signs: int = 4_000_000) -> DataFrame:
    """For each of the different ``words`` (``word``, ``n``) that has words one inserted, deleted or replaced code point away:
    ``n_near``, their number, and ``best``, the one of largest ``n`` (of ties the first in code-point order), as (n, word).

    A task takes groups of one size and range together, up to ``most_words`` words and ``most_signs`` code points, and passes
    on sums, no pairs."""
    group = ["size", "low", "up", "key"]

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def passed() -> pa.RecordBatch:
            names, counts = [r[0] for r in held], np.array([r[1] for r in held], dtype=np.int64)
            at, near, best = _summed(names, counts, *held[0][2:5]) if held else (np.empty(0, int),) * 3
            out = [pa.array([names[i] for i in at], pa.string()), pa.array(near, pa.int64()), pa.array(counts[best] if held else [], pa.int64()), pa.array([names[i] for i in best], pa.string())]
            held.clear()
            return pa.RecordBatch.from_arrays(out, ["word", "n_near", "best_n", "best_word"])

        for batch in batches:
            for row in zip(*[batch.column(i).to_pylist() for i in range(batch.num_columns)], strict=True):
                if held and (row[2:5] != held[-1][2:5] or row[5] != held[-1][5] and (len(held) >= most_words or len(held) * row[2] >= most_signs)):
                    yield passed()
                held.append(row)
        yield passed()
        trim()

    dealt = grouped(words, most_words).select("word", "n", *group).repartition(*group).sortWithinPartitions(*group)
    found = dealt.mapInArrow(report, "word string, n_near long, best_n long, best_word string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best_word").alias("word")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", F.struct((-F.col("best.less")).alias("n"), F.col("best.word").alias("word")).alias("best"))


def roots(links: DataFrame) -> DataFrame:
    """``word`` and ``root``, the last word behind (``word``, ``form``) links without circles; each round doubles the steps."""
    at = written(links.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = at.join(at.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left")
        after = written(further.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        if after.filter("moved").isEmpty():
            return after.drop("moved")
        at = after.drop("moved")


def spelling_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 6, min_count: int = 5, ratio: int = 5, slip: int | None = None, most_words: int = 100_000) -> DataFrame:
    """Each word of ``word_counts`` with ``n``, ``n_near`` (words one edit away), ``form`` and ``form_n`` (the near word of
    largest n, of ties the first, where it occurs ``ratio`` times as often or more; else null) and ``root`` (the end of the
    chain of forms; the word itself without a form). ``ratio`` is over 1, so chains end.

    Null and empty texts have no words, an empty table gives no rows, repeated rows count as often as they stand, a very long
    run of letters is a word like others. Other columns take no part, whatever their names."""
    if ratio < 2:
        raise ValueError("chains of forms end only if a form is more frequent than its word")
    words = written(word_counts(docs, id_col, text_col, min_length, min_count, slip), "spelling-words")
    near = words.join(near_words(words, most_words), "word", "left")
    has = F.col("best.n") >= ratio * F.col("n")
    near = near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("best.word")).alias("form"), F.when(has, F.col("best.n")).alias("form_n"))
    near = written(near, "spelling-near")
    ends = roots(near.filter(F.col("form").isNotNull()).select("word", "form"))
    return near.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word")).select("word", "form", "root", "n", "n_near", "form_n")


#: The same by keys: words alike but for one place, and words that give another one when a place is taken out. CRC-32 by its
#: bitwise definition over UTF-8 bytes; code points here are below 256.
ORACLE = """
WITH RECURSIVE runs AS (
  SELECT doc_id, r, count(*) AS k FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{C0}-\\x{FF}]+')) AS r FROM documents)
  WHERE length(r) >= 6 GROUP BY doc_id, r),
bytes AS (
  SELECT r, k, flatten(list_transform(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || r, ''), lambda s: CAST(unicode(s) AS BIGINT)),
    lambda c: CASE WHEN c < 128 THEN [c] ELSE [192 + (c >> 6), 128 + (c & 63)] END)) AS b FROM runs),
summed AS (
  SELECT r, k, xor(list_reduce(b, lambda crc, x: list_reduce([0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[], lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END, xor(crc, x)), 4294967295::BIGINT), 4294967295::BIGINT) AS h FROM bytes),
w AS (
  SELECT word, CAST(sum(k) AS BIGINT) AS n FROM (SELECT k, CASE WHEN h % 199 = 0 THEN left(r, CAST(h % length(r) AS BIGINT)) || substr(r, CAST(h % length(r) AS BIGINT) + 2) ELSE r END AS word FROM summed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
cut AS (SELECT word, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM w, LATERAL (SELECT unnest(range(1, length(word) + 1)) AS i)),
near AS (
  SELECT a.word, b.word AS other FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word AND length(a.word) = length(b.word)
  UNION SELECT c.word, w.word FROM cut c JOIN w ON c.rest = w.word
  UNION SELECT w.word, c.word FROM cut c JOIN w ON c.rest = w.word),
ranked AS (
  SELECT near.word, other, w.n, count(*) OVER (PARTITION BY near.word) AS n_near, row_number() OVER (PARTITION BY near.word ORDER BY w.n DESC, other) AS place FROM near JOIN w ON w.word = other),
forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN r.n >= 5 * w.n THEN other END AS form, CASE WHEN r.n >= 5 * w.n THEN r.n END AS form_n FROM w LEFT JOIN ranked r ON r.word = w.word AND place = 1),
chain(word, last, step) AS (
  SELECT word, word, 0 FROM forms
  UNION ALL SELECT c.word, f.form, c.step + 1 FROM chain c JOIN forms f ON f.word = c.last AND f.form IS NOT NULL)
SELECT word, form, (SELECT arg_max(last, step) FROM chain c WHERE c.word = forms.word) AS root, n, n_near, form_n FROM forms"""

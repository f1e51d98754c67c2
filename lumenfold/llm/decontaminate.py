"""Benchmark decontamination by latent semantic retrieval.

Passages (overlapping windows of words) are TF-IDF vectors over the benchmark's terms, with document frequencies counted
over the whole corpus. A randomised SVD of all passages of the corpus and of all items, computed in parallel parts, gives
one latent space for all items; every passage of every document is projected into it and compared with the items by cosine.
Candidates that hold enough of an item's words are confirmed by the longest common subsequence of words and by a check of
the item's answer, its last sentence.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lumenfold.llm.common import resident, trim, written

_EDGES = b".,;:!?\"'()[]{}<>|*#-_"
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII spaces, A-Z lower-cased, without punctuation at their edges."""
    return [x for w in (text or "").encode().lower().split() if (x := w.strip(_EDGES))]


def answer_of(text: str) -> str:
    """What an item asks for: its last sentence."""
    return _SENTENCE.split(text.strip())[-1]


def common_subsequence(masks: dict[int, int], length: int, ids: list[int]) -> int:
    """Length of the longest common subsequence of a sequence, given as position masks of its elements, and ``ids``."""
    full = (1 << length) - 1
    row = full
    for x in ids:
        if m := masks.get(x):
            u = row & m
            row = (row + u | row - u) & full
    return length - row.bit_count()


def masks_of(ids: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, x in enumerate(ids):
        out[x] = out.get(x, 0) | 1 << i
    return out


_BITS = 4096
_BUCKETS = 1 << 18  # terms are told apart by 18 bits of a hash in the space, by 64 bits in the confirmation


def word_hashes(text: str | None) -> list[int]:
    return [xxhash.xxh3_64_intdigest(w) for w in words_of(text)]


_MIX = np.uint64(0x9E3779B97F4A7C15)
_HEADS = np.asarray([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)  # the first n bytes of eight


def _buckets_of(words: pa.Array) -> np.ndarray:
    """A hash bucket of each word, eight bytes a step; -1 for empty ones."""
    edge = np.frombuffer(words.buffers()[1], dtype="<i4")[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2] or b"", dtype=np.uint8)[edge[0] : edge[-1]]
    data = np.append(data, np.zeros(8, dtype=np.uint8))
    blocks = np.ndarray(len(data) - 7, dtype="<u8", buffer=data, strides=(1,))
    at, left = edge[:-1] - edge[0], np.diff(edge)
    hashes, some, of = left.astype(np.uint64), left > 0, None
    while len(at):
        h = ((hashes if of is None else hashes[of]) ^ blocks[at] & _HEADS[np.minimum(left, 8)]) * _MIX
        h ^= h >> np.uint64(32)
        if of is None:
            hashes = h
        else:
            hashes[of] = h
        longer = np.flatnonzero(left > 8)
        of = longer if of is None else of[longer]
        at, left = at[longer] + 8, left[longer] - 8
    return np.where(some, (hashes * _MIX >> np.uint64(46)).astype(np.int64), -1)


def _split(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hash buckets of all words of some texts (-1: punctuation alone), and how many words each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.string())))
    words, counts = lists.flatten(), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    empty = pc.equal(words, "")  # before and after spaces at a text's edges
    if pc.any(empty).as_py():
        gone = np.repeat(np.arange(len(counts)), counts)[empty.to_numpy(zero_copy_only=False)]
        words, counts = words.filter(pc.invert(empty)), counts - np.bincount(gone, minlength=len(counts))
    return _buckets_of(pc.ascii_trim(words, characters=_EDGES.decode())), counts


def _slices(batches: Iterator[pa.RecordBatch], most: int = 1_500_000) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the texts of a slice hold ``most`` bytes or are a single row."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64
        ends, lo = np.cumsum(size), 0
        while lo < len(size):
            hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] - size[lo] + most, side="right")))
            yield batch.slice(lo, hi - lo)
            lo = hi
    trim()


class Terms:
    """The benchmark's terms as numbers 0 .. n - 1, of at most ``_BUCKETS`` hash buckets, so that what tasks hold is bounded."""

    def __init__(self, buckets: np.ndarray):
        self.buckets = np.sort(buckets)
        self.number = np.full(_BUCKETS + 1, -1, dtype=np.int32)  # the last one: no word
        self.number[self.buckets] = np.arange(len(buckets), dtype=np.int32)

    def __len__(self) -> int:
        return len(self.buckets)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Term numbers of all words of some texts, -1 for words that no item has, and how many words each text has. A word
        of punctuation alone is one that no item has."""
        buckets, counts = _split(texts)
        return self.number[buckets], counts

    def of_texts(self, texts: list[str]) -> list[np.ndarray]:
        """Term numbers of each text's words, without words that have none."""
        codes, counts = self.encode(pa.array(texts, pa.string()))
        return [c[c >= 0] for c in np.split(codes, np.cumsum(counts)[:-1])] if texts else []


def terms_of(texts: DataFrame) -> Terms:
    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            found = np.unique(_split(batch.column(0))[0])
            yield pa.RecordBatch.from_arrays([pa.array(found[found >= 0], pa.int32())], ["bucket"])

    rows = texts.select("text").mapInArrow(buckets, "bucket int").distinct().collect()  # _BUCKETS rows at most
    return Terms(np.asarray([r["bucket"] for r in rows], dtype=np.int64))


def _terms(buckets: np.ndarray) -> Terms:
    """One per worker process."""
    return resident(("terms", buckets.tobytes()), lambda: Terms(buckets))


@dataclass
class Items:
    """One block of benchmark items: their ids and texts, and the hashes of their words and of their answers' words."""

    ids: list
    texts: list[str]
    words: list[list[int]]
    answers: list[list[int]]

    @classmethod
    def of(cls, rows: list[tuple]) -> Items:
        return cls([i for i, _ in rows], [t for _, t in rows], [word_hashes(t) for _, t in rows], [word_hashes(answer_of(t)) for _, t in rows])


def _chunks(codes: np.ndarray, counts: np.ndarray, step: int, weighs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of several texts: the distinct terms that weigh of each chunk and their chunk, each chunk's text, and if the next
    chunk is of the same text. A word that a chunk repeats counts once: it would outweigh all others."""
    chunks, starts = np.maximum(1, -(-counts // step)), np.cumsum(counts) - counts
    base = np.cumsum(chunks) - chunks
    owner = np.repeat(np.arange(len(counts)), chunks)
    at = np.flatnonzero(np.append(weighs, False)[codes])  # -1: a word without a term
    text = np.searchsorted(starts, at, side="right") - 1
    place, flat = np.divmod(np.unique((base[text] + (at - starts[text]) // step) * len(weighs) + codes[at]), len(weighs))
    return flat, place, owner, np.append(owner[1:] == owner[:-1], False)


def _summed(rows: np.ndarray, by: np.ndarray, n: int, table: np.ndarray) -> np.ndarray:
    """For each row of ``table``: sums of its values at ``rows``, by ``by``."""
    out = np.empty((len(table), n), dtype=np.float32)
    for line, values in zip(out, table, strict=True):
        line[:] = np.bincount(by, values.take(rows), n)
    return out


def _windows(chunks: np.ndarray, goes_on: np.ndarray) -> np.ndarray:
    """Each chunk (along the last axis) with the next one of its text."""
    out = chunks.copy()
    out[..., :-1] += chunks[..., 1:] * goes_on[:-1]
    return out


def document_frequencies(docs: DataFrame, terms: Terms) -> tuple[np.ndarray, int]:
    """Documents that hold each term, and documents, over the whole table."""
    size, buckets = len(terms), terms.buckets

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = _terms(buckets), np.zeros(size + 1, dtype=np.int64)
        for rows in _slices(batches):
            codes, counts = own.encode(rows.column("text"))
            at = np.repeat(np.arange(len(counts)) * size, counts) + codes
            seen[:size] += np.bincount(np.unique(at[codes >= 0]) % size, minlength=size)
            seen[size] += len(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(seen), pa.int32()), pa.array(seen[seen > 0])], ["term", "n"])

    out = np.zeros(size + 1, dtype=np.int64)
    for r in docs.select("text").mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():  # one row a term of the items
        out[r["term"]] = r["n"]
    return out[:size], int(out[size])


def term_weights(texts: DataFrame, terms: Terms, frequency: np.ndarray, n_docs: int, max_df: float, least: int = 4) -> np.ndarray:
    """Inverse document frequencies. Terms of more than ``max_df`` of all documents weigh nothing, as stop words, but for
    the terms of an item that would keep fewer than ``least`` words."""
    idf = np.log((2 + n_docs) / (1 + frequency))
    stop, buckets = frequency > max_df * n_docs, terms.buckets

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _terms(buckets)
        for batch in _slices(batches):
            coded = own.of_texts(batch.column(0).to_pylist())
            found = sorted({int(k) for c in coded if (~stop[c]).sum() < least for k in c})
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32())], ["term"])

    for r in texts.select("text").mapInArrow(needed, "term int").distinct().collect():  # one row a term at most
        stop[r["term"]] = False
    return np.where(stop, 0.0, idf)


def latent_space(texts: DataFrame, terms: Terms, idf: np.ndarray, rank: int, step: int, extra: int = 10, seed: int = 11, slab: int = 64) -> np.ndarray:
    """Right singular vectors (terms x rank) of the TF-IDF passages of all ``texts`` (text, weight: how often its passages
    count) by a randomised range finder with one power step: two passes. Each task sums its passages up to one terms x rank
    matrix; slabs of these are added up in tasks, and one matrix is gathered."""
    d, buckets = len(idf), terms.buckets
    width = min(d, rank + extra)

    def applied(basis: np.ndarray) -> np.ndarray:
        """A' A basis for all passages, over their words alone."""
        table = (basis * idf[:, None]).T.astype(np.float32)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, lines, total = _terms(buckets), table.astype(np.float64), np.zeros((width, d))
            for rows in _slices(batches):
                flat, place, owner, goes_on = _chunks(*own.encode(rows.column("text")), step, idf > 0)
                squares = _windows(np.bincount(place, idf[flat] ** 2, len(owner)), goes_on)
                back = _windows(_summed(flat, place, len(owner), lines), goes_on)
                back *= rows.column("weight").to_numpy(zero_copy_only=False)[owner] / np.where(squares > 0, squares, 1)  # both factors of A are normalised
                back[:, 1:] += back[:, :-1] * goes_on[:-1]  # a chunk's words stand in its own window and in the one before
                used, at = np.unique(flat, return_inverse=True)
                total[:, used] += _summed(place, at, len(used), back)
            total = (total * idf).T.astype("<f4")
            part, held = TaskContext.get().partitionId(), [k for k in range(0, d, slab) if total[k : k + slab].any()]
            cols = [pa.array(held, pa.int32()), pa.array([part] * len(held), pa.int32()), pa.array([total[k : k + slab].tobytes() for k in held], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["slab", "part", "y"])

        def add(held: pa.Table) -> pa.Table:
            held = held.sort_by("part")  # sums of one table come out alike each time
            y = sum(np.frombuffer(x.as_py(), dtype="<f4").astype(np.float64) for x in held["y"])
            return pa.Table.from_arrays([held["slab"][:1].cast(pa.int32()), pa.array([y.astype("<f4").tobytes()], pa.binary())], ["slab", "y"])

        total = np.zeros((d, width))
        for r in texts.mapInArrow(work, "slab int, part int, y binary").groupBy("slab").applyInArrow(add, "slab int, y binary").toLocalIterator():
            total[r["slab"] : r["slab"] + slab] = np.frombuffer(r["y"], dtype="<f4").reshape(-1, width)
        return total

    start = np.random.default_rng(seed).standard_normal((d, width))
    q, _ = np.linalg.qr(applied(start))
    z = applied(q)
    values, vectors = np.linalg.eigh((q.T @ z + z.T @ q) / 2)
    return (q @ vectors[:, np.argsort(-values)[:rank]]).astype(np.float32)


def _table(space: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Each term's weighted place in the space."""
    return (space * idf[:, None]).astype(np.float32)


def _passages(coded: list[np.ndarray], table: np.ndarray, idf: np.ndarray, step: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
    """Passages of items, as long items are compared by theirs: each one's item, its distinct terms, its direction in the
    space (a column), and the share of its length that the space keeps."""
    found = [(k, np.unique(c[at : at + 2 * step])) for k, c in enumerate(coded) for at in range(0, max(1, len(c) - step), step)]
    pieces = [c for _, c in found]
    places = np.stack([table[c].sum(0) for c in pieces])
    norm = np.linalg.norm(places, axis=1, keepdims=True)
    whole = np.sqrt([(idf[c] ** 2).sum() for c in pieces])
    kept = np.clip(norm[:, 0] / np.where(whole > 0, whole, 1), 0.05, 1)
    return np.asarray([k for k, _ in found]), pieces, (places / np.where(norm > 0, norm, 1)).T.copy(), kept


def usual_share(texts: DataFrame, terms: Terms, idf: np.ndarray, space: np.ndarray, step: int) -> float:
    """The median share of its length that the space keeps of a passage, over all passages of all items; to five digits, so
    that the values counted for it are bounded."""
    table, buckets = _table(space, idf), terms.buckets

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _terms(buckets)
        for batch in _slices(batches):
            if coded := [c for c in own.of_texts(batch.column(0).to_pylist()) if len(c)]:
                yield pa.RecordBatch.from_arrays([pa.array(_passages(coded, table, idf, step)[3].astype(np.float64))], ["kept"])

    return texts.select("text").mapInArrow(shares, "kept double").agg(F.median(F.round("kept", 5))).first()[0]


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rank: int = 96, step: int = 24, cosine: float = 0.6, share: float = 0.6,
    answer_share: float = 0.5, fit_documents: int = 8000, block_chars: int = 4_000_000, max_df: float = 0.05,
) -> DataFrame:
    """One row for each document and item found in it: id, item, ``cosine`` (of the best passage), ``lcs_share`` (of the
    item's words in common order) and ``answer_share`` (of its answer's).

    Null and empty texts, items without words, and an empty table or benchmark give no rows; repeated items and rows give
    one row each; null ids stay null; of passages with equal shares the higher cosine is given. Very long texts are searched
    whole, very long items by their passages. Counts, the fit of the space and the search cover every word of every document
    and item; in the fit items weigh as much as they do beside ``fit_documents`` documents, so that a larger corpus doesn't
    push them out of the space. ``cosine`` is what a passage full of an item must reach; shorter items need less, by the root of their share of a passage, and so do items of which the space keeps less,
    by the share of their length it keeps, held against the median over all items. Items are searched for in blocks of
    ``block_chars``, which bounds what the driver and each task hold: terms, weights, space and thresholds are those of all
    items, so the blocks don't change which items are found.
    """
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text")).filter("text IS NOT NULL").distinct()
    item_type = benchmark.schema[item_col].dataType
    none = picked.filter("false").select("id", F.lit(None).cast(item_type).alias("item"), *[F.lit(0.0).alias(c) for c in ("cosine", "lcs_share", "answer_share")])
    terms = terms_of(items)
    if not len(terms):
        return none.withColumnRenamed("id", id_col).withColumnRenamed("item", item_col)
    frequency, n_docs = document_frequencies(picked, terms)
    idf = term_weights(items, terms, frequency, n_docs, max_df)
    weight = max(1.0, n_docs / fit_documents)
    fitted = picked.select("text", F.lit(1.0).alias("weight")).union(items.select("text", F.lit(weight)))
    space = latent_space(fitted, terms, idf, rank, step)
    usual = usual_share(items, terms, idf, space, step)

    out, block, size = None, [], 0
    for r in items.orderBy("item", "text").toLocalIterator():
        if size > block_chars:  # one block is held at a time
            found = written(_search(picked, Items.of(block), item_type, terms, idf, space, usual, step, cosine, share, answer_share), "leaks")
            out, block, size = found if out is None else out.union(found), [], 0
        if words_of(r["text"]):
            block.append((r["item"], r["text"]))
            size += len(r["text"])
    if block:
        found = _search(picked, Items.of(block), item_type, terms, idf, space, usual, step, cosine, share, answer_share)
        out = found if out is None else out.union(found)
    return (none if out is None else out).withColumnRenamed("id", id_col).withColumnRenamed("item", item_col)


def _search(picked: DataFrame, items: Items, item_type, terms: Terms, idf: np.ndarray, space: np.ndarray, usual: float, step: int, cosine: float, share: float, answer_share: float) -> DataFrame:
    table, buckets = _table(space, idf), terms.buckets
    of_piece, pieces, goal, kept = _passages(terms.of_texts(items.texts), table, idf, step)
    # a passage that holds all of a short item has mostly other terms: its cosine falls with the root of their share
    least = cosine * np.sqrt([min(1.0, len(c) / (2 * step)) for c in pieces])
    least = (least * np.minimum(1, kept / max(usual, 1e-9))).astype(np.float32)
    # terms of the pieces, as 4096 bits each, and how many of a passage's terms have to be among them: half of what the
    # confirmation asks for
    has = np.zeros((len(pieces), _BITS // 8 + 1), dtype=np.uint8)
    for p, c in enumerate(pieces):
        c = c[idf[c] > 0] % _BITS
        np.bitwise_or.at(has[p], c >> 3, (1 << (c & 7)).astype(np.uint8))
    enough = np.asarray([max(1, int(share * (idf[c] > 0).sum() / 2)) for c in pieces])
    masks = [masks_of(w) for w in items.words]
    answer_masks = [masks_of(w) for w in items.answers]
    id_kind, item_kind = to_arrow_type(picked.schema["id"].dataType), to_arrow_type(item_type)

    def confirm(ids: list[int], k: int, chunk: int) -> tuple[float, float]:
        """Shares of an item and of its answer in common order around a passage."""
        words = items.words[k]
        lo, hi = max(0, chunk * step - len(words)), (chunk + 2) * step + len(words)
        around = ids[lo:hi]
        got = common_subsequence(masks[k], len(words), around) / len(words)
        if got < share or not items.answers[k]:
            return got, 1.0
        return got, common_subsequence(answer_masks[k], len(items.answers[k]), around) / len(items.answers[k])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, lines = _terms(buckets), table.T.astype(np.float64)
        rows_at_once = max(256, 8_000_000 // len(pieces))
        for rows in _slices(batches):
            texts = rows.column("text")
            flat, place, owner, goes_on = _chunks(*own.encode(texts), step, idf > 0)
            windows = _windows(_summed(flat, place, len(owner), lines), goes_on)
            norms = np.linalg.norm(windows, axis=0)
            windows /= np.where(norms > 0, norms, 1)
            first = np.searchsorted(owner, np.arange(len(rows)))
            held = _padded(flat % _BITS, place, goes_on, step, _BITS)
            # a passage with fewer terms than any piece asks for can't share enough with one
            live = np.flatnonzero((held < _BITS).sum(1) >= enough.min())
            exact: dict[int, list[int]] = {}
            best: dict[tuple[int, int], tuple[float, float, float]] = {}
            for lo in range(0, len(live), rows_at_once):
                some = live[lo : lo + rows_at_once]
                like = windows[:, some].T @ goal
                at, piece = np.nonzero(like >= least)
                for cut in range(0, len(at), 100_000):
                    a, p = at[cut : cut + 100_000], piece[cut : cut + 100_000]
                    t = held[some[a]]
                    shared = (has[p[:, None], t >> 3] >> (t & 7).astype(np.uint8) & 1).sum(1)
                    ok = shared >= enough[p]
                    for w, q, x in zip(some[a[ok]].tolist(), p[ok].tolist(), like[a[ok], p[ok]].tolist(), strict=True):
                        doc, k = int(owner[w]), int(of_piece[q])
                        if doc not in exact:
                            exact[doc] = _placed_hashes(texts[doc].as_py())
                        got, answer = confirm(exact[doc], k, w - int(first[doc]))
                        if got >= share and answer >= answer_share:
                            new = (got, answer, round(x, 4))
                            best[doc, k] = max(best.get((doc, k), new), new)
            keys = sorted(best)
            cols = [rows.column("id").take(pa.array([d for d, _ in keys], pa.int64())).cast(id_kind), pa.array([items.ids[k] for _, k in keys], item_kind)]
            cols += [pa.array([best[key][j] for key in keys], pa.float64()) for j in (2, 0, 1)]
            yield pa.RecordBatch.from_arrays(cols, ["id", "item", "cosine", "lcs_share", "answer_share"])

    schema = f"id {picked.schema['id'].dataType.simpleString()}, item {item_type.simpleString()}, cosine double, lcs_share double, answer_share double"
    return picked.mapInArrow(search, schema)


def _placed_hashes(text: str | None) -> list[int]:
    """Hashes of a text's words by their places; a word of punctuation alone is 0."""
    return [xxhash.xxh3_64_intdigest(x) if (x := w.strip(_EDGES)) else 0 for w in (text or "").encode().lower().split()]


def _padded(flat: np.ndarray, place: np.ndarray, goes_on: np.ndarray, step: int, none: int) -> np.ndarray:
    """The weighing terms of each chunk and of the next one of its text, as rows filled up with ``none``."""
    n = len(goes_on)
    rank = np.arange(len(place)) - np.searchsorted(place, place)  # place rises
    own = np.full((n, step), none, dtype=np.int32)
    own[place, rank] = flat
    after = np.full((n, step), none, dtype=np.int32)
    after[:-1][goes_on[:-1]] = own[1:][goes_on[:-1]]
    return np.concatenate([own, after], axis=1)

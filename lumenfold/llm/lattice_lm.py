"""Language-model scores from a subword lattice.

A word's spelling is the sum over all ways to cut it into pieces of an existing public vocabulary. The pieces' weights
start from the vocabulary's own scores and are re-estimated on the training words by expected counts; each piece also has
its own chance to end a word. What the counts of training words leave over (absolute discounting) is spelled, so a seen
word has an arc of its own beside its spellings. A document's probability is the log-space forward sum over all paths; with
labelled training documents it is also summed over the labels, each with its own weights.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lumenfold.llm.common import blocks_for, resident, text_bytes, written
from lumenfold.llm.pieces import PieceTable

_LN10 = math.log(10)
_LONG_WORD = 48


def tokens(text: str | None) -> list[bytes]:
    """Words between ASCII spaces and controls 9-13, A-Z lower-cased."""
    return (text or "").encode().lower().split()


def vocabulary_pieces(model_path: str) -> list[bytes]:
    """The pieces of a sentencepiece model in the order of its scores, the mark as a space, then any single byte it lacks."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    own = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    own.sort(key=lambda i: (-sp.get_score(i), i))
    spelt = [sp.id_to_piece(i).replace("▁", " ").encode() for i in own]
    return list(dict.fromkeys([*(p for p in spelt if b" " not in p[1:]), *(bytes([b]) for b in range(256))]))


def first_pieces(pieces: list[bytes]) -> np.ndarray:
    """Which pieces begin a word."""
    return np.asarray([p[:1] == b" " for p in pieces])


class Lattice:
    """Forward and backward sums over the segmentations of words, for several classes of documents at once. A word is read
    behind one space, which its first piece holds; a piece is used inside a word or at its end."""

    def __init__(self, pieces: list[bytes], weights: np.ndarray):
        """weights: natural logarithms, a row for each class; columns are the pieces inside words, then those at the end."""
        self.inner, self.final = np.split(np.ascontiguousarray(weights), 2, axis=1)
        self.classes, self.size = len(weights), len(pieces)
        self.longest = max(map(len, pieces))
        self.place = {p: i for i, p in enumerate(pieces)}
        self.table = PieceTable(pieces)

    @staticmethod
    def start(pieces: list[bytes], classes: int) -> np.ndarray:
        """Weights from the scores' order alone, as Zipf's law has them: merge vocabularies store that, not probabilities."""
        counts = 1.0 / (np.arange(len(pieces)) + 30.0)
        return np.tile(Lattice.normalised(np.concatenate([0.75 * counts, 0.25 * counts]), first_pieces(pieces)), (classes, 1))

    @staticmethod
    def normalised(counts: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Two distributions over pieces and whether the word ends with them, of pieces that begin a word and of the others.
        Every piece has a little mass, and its chance to end a word leans on that of all."""
        inside, at_end = np.split(counts, 2)
        out = np.empty(len(counts))
        for part in (first, ~first):
            c, e = inside[part] + at_end[part], at_end[part]
            total = max(c.sum(), 1e-300)
            share = c + 1e-4 * total / max(1, part.sum()) + 1e-12
            stop = (e + 2 * e.sum() / total) / (c + 2)
            stop = np.clip(stop, 1e-9, 1 - 1e-9)
            out[: len(first)][part] = np.log(share / share.sum() * (1 - stop))
            out[len(first) :][part] = np.log(share / share.sum() * stop)
        return out

    def _grids(self, words: list[bytes]) -> Iterator[tuple[list[int], list[tuple[int, int, np.ndarray]] | None]]:
        """Words of one length together with their arcs; long words by themselves, without."""
        by_length: dict[int, list[int]] = {}
        for i, word in enumerate(words):
            by_length.setdefault(len(word), []).append(i)
        for length, at in by_length.items():
            step = max(1, 2_000_000 // (length + 1) ** 2)
            for lo in range(0, len(at), step) if length <= _LONG_WORD else ():
                part = at[lo : lo + step]
                grid = np.frombuffer(b"".join([b" " + words[i] for i in part]), dtype=np.uint8).reshape(len(part), -1)
                yield part, list(self.table.arcs(grid))
            if length > _LONG_WORD:
                yield from (([i], None) for i in at)

    def log_probabilities(self, words: list[bytes]) -> np.ndarray:
        """Natural logarithms of the words' marginals: a row for each word, a column for each class."""
        k = self.classes
        out = np.empty((len(words), k))
        none = np.full((k, 1), -np.inf)  # -1: no piece
        inner, final = np.append(self.inner, none, axis=1), np.append(self.final, none, axis=1)
        for at, arcs in self._grids(words):
            if arcs is None:
                for c in range(k):
                    out[at[0], c] = self._long_sum(b" " + words[at[0]], c, None)
                continue
            length = len(words[at[0]]) + 1
            forward = np.full((length + 1, k, len(at)), -np.inf)
            forward[0] = 0
            for start, end, piece in arcs:
                some = np.flatnonzero(piece >= 0)
                if len(some):
                    w = final if end == length else inner
                    forward[end][:, some] = np.logaddexp(forward[end][:, some], forward[start][:, some] + w[:, piece[some]])
            out[at] = forward[length].T
        return out

    def expect(self, words: list[bytes], member: np.ndarray, expected: np.ndarray) -> None:
        """Adds the pieces' expected counts over the words of each class (``member``: words x classes)."""
        for at, arcs in self._grids(words):
            for c in range(self.classes):
                own = np.flatnonzero(member[at, c])
                if not len(own):
                    continue
                if arcs is None:
                    self._long_sum(b" " + words[at[0]], c, expected[c])
                    continue
                length, n = len(words[at[0]]) + 1, len(own)
                w = np.concatenate([self.inner[c], self.final[c]])
                mine = [(s, e, at_, p[own[at_]] + (self.size if e == length else 0)) for s, e, p in arcs if len(at_ := np.flatnonzero(p[own] >= 0))]
                forward, backward = np.full((length + 1, n), -np.inf), np.full((length + 1, n), -np.inf)
                forward[0], backward[length] = 0, 0
                for s, e, i, p in mine:
                    forward[e, i] = np.logaddexp(forward[e, i], forward[s, i] + w[p])
                total = forward[length]
                for s, e, i, p in reversed(mine):
                    backward[s, i] = np.logaddexp(backward[s, i], backward[e, i] + w[p])
                pieces = np.concatenate([p for _, _, _, p in mine])
                shares = np.concatenate([np.exp(forward[s, i] + w[p] + backward[e, i] - total[i]) for s, e, i, p in mine])
                expected[c] += np.bincount(pieces, shares, expected.shape[1])

    def _long_sum(self, word: bytes, c: int, expected: np.ndarray | None) -> float:
        """The same for one long word, position by position."""
        n, place = len(word), self.place
        arcs = [[(s, k) for s in range(max(0, e - self.longest), e) if (k := place.get(word[s:e])) is not None] for e in range(n + 1)]
        weight = lambda e, k: self.final[c, k] if e == n else self.inner[c, k]
        forward = [0.0] * (n + 1)
        for e in range(1, n + 1):
            xs = [forward[s] + weight(e, k) for s, k in arcs[e]]
            m = max(xs)
            forward[e] = m + math.log(sum(math.exp(x - m) for x in xs))
        if expected is not None:
            backward = [-math.inf] * n + [0.0]
            for e in range(n, 0, -1):
                for s, k in arcs[e]:
                    backward[s] = float(np.logaddexp(backward[s], backward[e] + weight(e, k)))
                    expected[k + (self.size if e == n else 0)] += math.exp(forward[s] + weight(e, k) + backward[e] - forward[n])
        return forward[n]


def _lean(counts: np.ndarray) -> np.ndarray:
    """Expected counts by class, each with a little of all classes' for classes with few words."""
    return counts + 0.01 * counts.sum(0) / len(counts)


class WordModel:
    """Probabilities of words and of the end, by class: discounted counts, and what they leave over for words of any class
    and, most of it, for spellings."""

    def __init__(self, n_of: np.ndarray, types_of: np.ndarray, n_all: int, discount: float, shared: float):
        self.n_of, self.n_all, self.discount, self.shared = np.maximum(n_of, 1), max(1, n_all), discount, shared
        self.left = np.where(n_of > 0, discount * types_of / self.n_of, 1.0)

    def logs(self, counts: np.ndarray, spelled: np.ndarray) -> np.ndarray:
        """Natural logarithms for each word (rows) and class (columns), from its counts and the log of its spelling."""
        own = np.maximum(counts - self.discount, 0) / self.n_of
        everywhere = np.maximum(counts.sum(1, keepdims=True) - self.discount, 0) / self.n_all
        with np.errstate(divide="ignore"):
            return np.logaddexp(np.log(own + self.left * self.shared * everywhere), np.log(self.left * (1 - self.shared)) + spelled)


def _word_groups(batches: Iterator[pa.RecordBatch], rows: int = 60_000) -> Iterator[pa.Table]:
    """Batches joined to groups large enough for work by word length."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def _lattice(model_path: str, weights: bytes) -> Lattice:
    """One per worker process, model and weights."""

    def make() -> Lattice:
        pieces = vocabulary_pieces(model_path)
        return Lattice(pieces, np.frombuffer(weights).reshape(-1, 2 * len(pieces)))

    return resident(("lattice", model_path, weights), make)


def _classes(docs: DataFrame, most: int) -> dict[str, int]:
    """The most frequent labels of the training documents, numbered; any other label and null share the next number."""
    counts = docs.filter("train AND label IS NOT NULL").groupBy("label").count().orderBy(F.desc("count"), "label").limit(most - 1)
    return {r["label"]: i for i, r in enumerate(counts.collect())}


def score_documents(
    docs: DataFrame, is_training: Column, model_path: str, id_col: str = "doc_id", text_col: str = "text", label_col: str | None = "lang", block_bytes: int = 16_000_000, rounds: int = 3, max_classes: int = 16, discount: float = 0.75, shared: float = 0.03
) -> DataFrame:
    """One row per document: id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` (add-one word
    unigram) and ``score`` (the model), both log10 probabilities of the whole text with its end.

    Word counts are taken over all training documents and never leave the executors as a whole: each block of documents
    receives the counts of its own words. Null and empty texts are the end alone; null ids and repeated rows are kept; a
    condition that is null counts as held out; with no training document the model is the spelling alone. Very long texts and
    words are summed whole; repeated words share one look-up. Only the named columns are read. ``max_classes`` bounds the
    labels told apart, the most frequent ones; other labels and null are one class more, learned from all their documents.
    """
    label = F.col(label_col).cast("string") if label_col and label_col in docs.columns else F.lit(None).cast("string")
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(is_training, F.lit(False)).alias("train"), label.alias("label"))
    id_type = picked.schema["id"].dataType
    kind = to_arrow_type(id_type)
    classes = _classes(picked, max_classes)
    k = len(classes) + 1
    number = F.create_map(*[F.lit(x) for pair in classes.items() for x in pair])[F.col("label")] if classes else F.lit(None).cast("int")
    blocks = blocks_for(text_bytes(picked), block_bytes)
    dealt = picked.select("id", "text", "train", F.coalesce(number, F.lit(k - 1)).alias("class"), F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).alias("block"))
    tasks = blocks if blocks <= 1024 else max(1024, blocks // 8)  # a task holds one block at a time
    dealt = dealt.repartition(tasks, "block")
    names = [f"c{i}" for i in range(k)]

    def count(table: pa.Table) -> pa.Table:
        seen = [Counter() for _ in range(k)]
        rest: set[bytes] = set()
        for text, train, c in zip(table["text"], table["train"], table["class"], strict=True):
            words = tokens(text.as_py())
            if train.as_py():
                seen[c.as_py()].update(words)
            else:
                rest.update(words)
        words = list(rest.union(*seen))
        block = table["block"][0].as_py()
        cols = [pa.array([s[w] for w in words], pa.int64()) for s in seen]
        return pa.Table.from_arrays([pa.array([block] * len(words), pa.int64()), pa.array(words, pa.binary()), *cols], ["block", "word", *names])

    count_schema = "block long, word binary, " + ", ".join(f"{n} long" for n in names)
    pairs = written(dealt.groupBy("block").applyInArrow(count, count_schema), "lm-block-words")
    words = written(pairs.groupBy("word").agg(*[F.sum(n).alias(n) for n in names]), "lm-words")
    total = sum(F.col(n) for n in names)
    stats = words.agg(*[F.sum(n).alias(n) for n in names], *[F.count_if(F.col(n) > 0).alias(f"t{n}") for n in names], F.count_if(total > 0).alias("types")).first()
    ends = {r["class"]: r["n"] for r in dealt.filter("train").groupBy("class").agg(F.count("*").alias("n")).collect()}
    end_of = np.asarray([ends.get(i, 0) for i in range(k)], dtype=float)
    n_of = np.asarray([stats[n] or 0 for n in names], dtype=float) + end_of
    types_of = np.asarray([stats[f"t{n}"] or 0 for n in names], dtype=float) + (end_of > 0)
    n_all, v_all = int(n_of.sum()), int((stats["types"] or 0) + (end_of.sum() > 0))
    # the pieces' weights: expected counts over each class's distinct training words
    pieces = vocabulary_pieces(model_path)
    size, first = 2 * len(pieces), first_pieces(pieces)
    weights = Lattice.start(pieces, k).tobytes()
    for _ in range(rounds if stats["types"] else 0):

        def expect(batches: Iterator[pa.RecordBatch], weights: bytes = weights) -> Iterator[pa.RecordBatch]:
            lattice, expected = _lattice(model_path, weights), np.zeros((k, size))
            for table in _word_groups(batches):
                member = np.stack([table.column(i + 1).to_numpy() > 0 for i in range(k)], 1)
                lattice.expect(table.column(0).to_pylist(), member, expected)
            c, at = np.nonzero(expected)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(at, pa.int32()), pa.array(expected[c, at], pa.float64())], ["class", "piece", "n"])

        learned = words.filter(total > 0).select("word", *names).mapInArrow(expect, "class int, piece int, n double").groupBy("class", "piece").agg(F.sum("n").alias("n"))
        counts = np.zeros((k, size))
        for r in learned.collect():  # at most one row for each class and piece of the vocabulary
            counts[r["class"], r["piece"]] = r["n"]
        weights = np.stack([Lattice.normalised(c, first) for c in _lean(counts)]).tobytes()

    prior = np.log((end_of + 1e-9) / (end_of.sum() + 1e-9 * k)) if n_all else np.full(k, -math.log(k))

    model = WordModel(n_of, types_of, n_all, discount, shared)

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = _lattice(model_path, weights)
        for table in _word_groups(batches):
            c = np.stack([table.column(i + 1).to_numpy() for i in range(k)], 1)
            logs = model.logs(c.astype(float), lattice.log_probabilities(table.column(0).to_pylist())).astype("<f4")
            for lo in range(0, len(c), 10_000):
                part = slice(lo, lo + 10_000)
                yield pa.RecordBatch.from_arrays([table.column(0)[part].combine_chunks(), pa.array(c[part].sum(1), pa.int64()), pa.array([r.tobytes() for r in logs[part]], pa.binary())], ["word", "c", "logs"])

    known = words.mapInArrow(spell, "word binary, c long, logs binary")
    fetched = pairs.select("block", "word").join(known, "word").repartition(tasks, "block")

    end_weights = model.logs(end_of[None, :], np.full((1, k), -np.inf))[0] if n_all else np.full(k, math.log(0.5))
    end_weights = np.maximum(end_weights, -60.0)
    base_of = lambda c: np.log10((c + 1) / (n_all + v_all + 1))

    def score(docs_: pa.Table, words_: pa.Table) -> pa.Table:
        place = {w: i for i, w in enumerate(words_["word"].to_pylist())}
        all_c = words_["c"].to_numpy().astype(float)
        table = np.frombuffer(b"".join(words_["logs"].to_pylist()), dtype="<f4").reshape(-1, k).astype(float)
        base, end_base = base_of(all_c), float(base_of(end_of.sum()))
        out: list[list] = [[] for _ in range(4)]
        for text in docs_["text"]:
            at = np.asarray(list(map(place.__getitem__, tokens(text.as_py()))), dtype=np.int64)
            logs = prior + end_weights + table[at].sum(0)
            m = logs.max()
            for col, x in zip(out, (len(at) + 1, int((all_c[at] > 0).sum()) + int(end_of.sum() > 0), float(base[at].sum()) + end_base, float(m + np.log(np.exp(logs - m).sum())) / _LN10), strict=True):
                col.append(x)
        held = [not x for x in docs_["train"].to_pylist()]
        cols = [docs_["id"].cast(kind), pa.array(held), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array([n_all] * len(held), pa.int64()), pa.array(out[2], pa.float64()), pa.array(out[3], pa.float64())]
        return pa.Table.from_arrays(cols, ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    schema = f"id {id_type.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    out = dealt.select("block", "id", "text", "train").groupBy("block").cogroup(fetched.groupBy("block")).applyInArrow(score, schema)
    return out.withColumnRenamed("id", id_col)

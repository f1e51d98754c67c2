"""Language identification by cross-parsing against suffix automata of labelled text.

A text is cut greedily into the longest phrases that occur in a language's sample; a text in that language needs few. The
phrase counts, divided by the text's length, are compared over languages.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from lumenfold.llm.common import resident, text_slices, written

UNKNOWN = "und"
_BREAKS = re.compile(r"[\W\d_]+")


def normalised(text: str) -> str:
    """Lower case, with every run of other signs than letters as one space, and a space at either end."""
    return f" {_BREAKS.sub(' ', text.lower()).strip()} "


def suffix_automaton(text: str) -> list[dict[str, int]]:
    """Transitions of the smallest automaton that reads exactly the substrings of ``text``; state 0 is its start."""
    move, link, length, last = [{}], [-1], [0], 0
    for sign in text:
        state = len(move)
        move.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and sign not in move[p]:
            move[p][sign] = state
            p = link[p]
        if p >= 0:
            q = move[p][sign]
            if length[q] == length[p] + 1:
                link[state] = q
            else:
                twin = len(move)
                move.append(dict(move[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and move[p].get(sign) == q:
                    move[p][sign] = twin
                    p = link[p]
                link[q] = link[state] = twin
        last = state
    return move


class _Edges:
    """Transitions as a hash table: few of all pairs of states and signs have one."""

    _FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)

    def __init__(self, keys: np.ndarray, to: np.ndarray):
        """keys: state * width + sign, each once; 0 is none of them."""
        keys = keys.astype(np.uint64)
        self.levels, left = [], np.arange(len(keys))
        for factor in map(np.uint64, self._FACTORS):
            bits = max(4, int(4 * len(left)).bit_length())
            shift = np.uint64(64 - bits)
            slot = (keys[left] * factor >> shift).astype(np.int64)
            _, at = np.unique(slot, return_index=True)
            held, of = np.zeros(1 << bits, dtype=np.uint64), np.zeros(1 << bits, dtype=np.int32)
            held[slot[at]], of[slot[at]] = keys[left[at]], to[left[at]]
            self.levels.append((factor, shift, held, of))
            left = np.delete(left, at)
            if not len(left):
                return
        raise ValueError("the transitions don't fit their table")

    def __call__(self, key: np.ndarray) -> np.ndarray:
        """The state behind each key, or 0."""
        key, out = key.astype(np.uint64), None
        for factor, shift, held, of in self.levels:
            slot = (key * factor >> shift).astype(np.int64)
            found = np.where(held[slot] == key, of[slot], 0)
            out = found if out is None else out + found
        return out


class CrossParser:
    """Parses many texts against all samples in step, one state for each text and language. The transitions are one dense
    table while it has at most ``dense_entries``, else a hash table; both give the same phrases."""

    def __init__(self, samples: dict[str, str], dense_entries: int = 48_000_000):
        self.labels = sorted(samples)
        signs = sorted(set("".join(samples.values())))
        self.width = len(signs) + 1  # class 0: a sign that no sample has
        self.codes = np.zeros(0x110000, dtype=np.uint32)
        for i, s in enumerate(signs, 1):
            self.codes[ord(s)] = i
        place = {s: i for i, s in enumerate(signs, 1)}
        keys, targets, base = [], [], 1  # state 0: none
        self.root_next = np.zeros((len(self.labels), self.width), dtype=np.int32)
        self.roots = np.zeros(len(self.labels), dtype=np.int32)
        for n, label in enumerate(self.labels):
            moves = suffix_automaton(samples[label])
            self.roots[n] = base
            self.root_next[n] = base + len(moves)  # an unknown sign is a phrase of its own: it leads into a state without exits
            for s, to in moves[0].items():
                self.root_next[n, place[s]] = base + to
            lacking = np.flatnonzero(self.root_next[n] == base + len(moves))
            keys.append(base * self.width + lacking)
            targets.append(self.root_next[n, lacking])
            sizes = np.fromiter(map(len, moves), dtype=np.int64, count=len(moves))
            edges = int(sizes.sum())
            own = np.repeat(np.arange(base, base + len(moves), dtype=np.int64), sizes) * self.width
            keys.append(own + np.fromiter((place[s] for out in moves for s in out), dtype=np.int64, count=edges))
            targets.append(np.fromiter((base + to for out in moves for to in out.values()), dtype=np.int32, count=edges))
            base += len(moves) + 1
        if base > np.iinfo(np.int32).max:
            raise ValueError("the samples have too many states")
        every, to = np.concatenate([np.empty(0, np.int64), *keys]), np.concatenate([np.empty(0, np.int32), *targets])
        if base * self.width <= dense_entries:
            table = np.zeros(base * self.width, dtype=np.int32)
            table[every] = to
            self.next = table.__getitem__
        else:
            self.next = _Edges(every, to)

    def _run(self, coded: list[np.ndarray], start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases that end within each sequence, read on from a start state, and the states at its end; a row a language."""
        count, end = np.zeros(start.shape, dtype=np.int64), start.copy()
        sizes = np.asarray([len(c) for c in coded])
        order = np.argsort(-sizes, kind="stable")
        for at in range(0, len(order), 1024):
            group = order[at : at + 1024]
            lengths = sizes[group]
            grid = np.zeros((lengths[0], len(group)), dtype=np.uint32)
            for j, i in enumerate(group):
                grid[: lengths[j], j] = coded[i]
            state, ends = start[:, group], np.zeros((len(self.labels), len(group)), dtype=np.int32)
            running = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")  # texts longer than each position
            for step in range(lengths[0]):
                active = running[step]
                signs, now = grid[step, :active], state[:, :active]
                then = self.next(now.astype(np.int64) * self.width + signs)
                ended = then == 0
                ends[:, :active] += ended
                state[:, :active] = np.where(ended, self.root_next[:, signs], then)
            count[:, group], end[:, group] = ends, state
        return count, end

    def phrases(self, texts: list[str], piece: int = 4096, lead: int = 256) -> np.ndarray:
        """Phrase counts, one row a text and one column a language. Long texts are read in pieces at once: each begins in
        the state that the last ``lead`` signs before it lead to, and is read again where the piece before ends in another
        state. So the counts are those of the whole text."""
        coded = [self.codes[np.frombuffer(t.encode("utf-32-le"), dtype="<u4")] for t in texts]
        owner = np.asarray([i for i, c in enumerate(coded) for _ in range(0, max(1, len(c)), piece)], dtype=np.int64)
        parts = [c[at : at + piece] for c in coded for at in range(0, max(1, len(c)), piece)]
        later = np.flatnonzero(owner[1:] == owner[:-1]) + 1
        root = self.roots[:, None]
        start = np.repeat(root, len(parts), axis=1)
        if len(later):
            start[:, later] = self._run([parts[i - 1][-lead:] for i in later], np.repeat(root, len(later), axis=1))[1]
        count, end = self._run(parts, start)
        while len(wrong := later[(end[:, later - 1] != start[:, later]).any(0)]):
            start[:, wrong] = end[:, wrong - 1]
            count[:, wrong], end[:, wrong] = self._run([parts[i] for i in wrong], start[:, wrong])
        out = np.zeros((len(texts), len(self.labels)), dtype=np.int64)
        np.add.at(out, owner, count.T)
        last = np.flatnonzero(np.append(owner[1:] != owner[:-1], True))
        return out + (end[:, last] != root).T


def training_samples(docs: DataFrame, is_training: Column, label_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", max_chars: int = 30_000, max_rows: int = 48, max_total: int = 3_000_000) -> dict[str, str]:
    """The bounded sample: for each label, up to ``max_rows`` training texts by a hash order, up to ``max_chars`` signs, and
    fewer where that would pass ``max_total`` signs for all labels together.

    Rows are first thinned by that hash to a few times the bound (from a count over all rows), so what is moved and ranked
    for one label stays small however many rows it has."""
    marked = docs.filter(F.coalesce(is_training, F.lit(False)) & F.col(label_col).isNotNull() & F.col(text_col).rlike("\\p{L}"))
    rows = marked.select(F.col(label_col).alias("label"), F.col(text_col).alias("text"), F.xxhash64(F.lit("sample"), F.col(id_col), F.col(text_col)).alias("h"))
    share = written(rows.groupBy("label").agg(F.count("*").alias("n")), "language-labels")
    most = min(max_chars, max_total // max(1, share.count()))
    near = F.lit(2.0**63) * F.least(F.lit(1.0), F.lit(6.0 * max_rows) / F.col("n")) * 2 - F.lit(2.0**63)
    thin = rows.join(share, "label").filter(F.col("h").cast("double") <= near)
    first = thin.withColumn("rn", F.row_number().over(Window.partitionBy("label").orderBy("h", "text"))).filter(F.col("rn") <= max_rows)
    out: dict[str, str] = {}
    for r in first.select("label", "rn", F.substring("text", 1, most).alias("text")).orderBy("label", "rn").toLocalIterator():
        held = out.get(r["label"], "")
        if len(held) < most:
            out[r["label"]] = (held + normalised(r["text"]))[:most]
    return out


def _parser(samples: dict[str, str]) -> CrossParser:
    return resident(("languages", tuple(sorted(samples.items()))), lambda: CrossParser(samples))


def identify(docs: DataFrame, samples: dict[str, str], text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``phrases_per_sign`` of the best language (replacing columns so named).

    ``score`` is the lead over the second language, 1 - best / second, in 0 .. 1 (1 with a single language). A text that is
    null or has no letter gets ``und`` and 0; so does every text if there are no samples. Ties go to the first label in
    order. Whole texts are parsed, and nothing else is looked at; all rows and columns pass through, nulls and repeated
    rows included.
    """
    added = ("lang_pred", "score", "phrases_per_sign")
    kept = docs.select(*[c for c in docs.columns if c not in added])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _parser(samples) if samples else None
        for batch, raw in text_slices(batches, text_col, 2_000_000):
            label, score, rate = [UNKNOWN] * len(raw), [0.0] * len(raw), [None] * len(raw)
            texts = [(i, n) for i, t in enumerate(raw) if t and any(map(str.isalpha, n := normalised(t)))]
            if parser and texts:
                counts = parser.phrases([t for _, t in texts])
                for (i, text), c in zip(texts, counts, strict=True):
                    best = int(np.argmin(c))
                    second = np.partition(c, 1)[1] if len(c) > 1 else math.inf
                    label[i], score[i], rate[i] = parser.labels[best], float(1 - c[best] / second), float(c[best] / len(text))
            cols = [*batch.columns, pa.array(label, pa.string()), pa.array(score, pa.float64()), pa.array(rate, pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, [*batch.schema.names, *added])

    schema = StructType([*kept.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("phrases_per_sign", DoubleType())])
    return kept.mapInArrow(predict, schema)

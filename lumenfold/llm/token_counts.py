"""Exact token counts at every prefix of a text, by dynamic programming over prefixes.

For a merge-based vocabulary the last token of each prefix is unique: it is the only token that ends there and may stand
behind the last token of the prefix before it. Whether two tokens may stand side by side depends on those two alone, so
one pass from left to right, with a memo of token pairs, gives the count of every prefix without encoding any of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import LongType, StructField, StructType

from lumenfold.llm.common import resident, text_groups
from lumenfold.llm.pieces import PieceTable

MARK = "▁"
_SEGMENT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class PrefixCounter:
    """Counts for one sentencepiece merge model. Tokens never hold a mark behind another sign (checked when it loads), so
    texts fall into segments that are counted apart; ``cache_entries`` bounds what is kept of segments."""

    def __init__(self, model_path: str, cache_entries: int = 600_000):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(model_path, "rb") as f:
            proto.ParseFromString(f.read())
        spec, kind = proto.normalizer_spec, sentencepiece_model_pb2.ModelProto.SentencePiece
        if spec.name != "identity" or spec.remove_extra_whitespaces or not spec.add_dummy_prefix:
            raise ValueError("prefix counts need a model that keeps its text as it is, behind one mark")
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type in (kind.NORMAL, kind.USER_DEFINED)}
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("prefix counts need tokens whose marks come first")
        spec.add_dummy_prefix = False
        self.bare = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.cache_entries = cache_entries
        self.names = list(self.ids)
        self.number = np.asarray([self.ids[p] for p in self.names])
        self.table = PieceTable([[ord(c) for c in p] for p in self.names])
        # whether a piece may stand behind another: the last answers, each under its full key
        self.keys, self.answers = np.zeros(1 << 20, dtype=np.uint64), np.zeros(1 << 20, dtype=bool)
        self.segments: dict[str, tuple[bytes, int]] = {}

    def _joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """For pairs of pieces (left -1: nothing, -2: a sign outside the vocabulary): do they stay as they are?"""
        key = ((left + 2).astype(np.uint64) << np.uint64(32)) + right.astype(np.uint64) + np.uint64(1)
        slot = (key * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)).astype(np.int64)
        out = self.answers[slot]
        missed = np.flatnonzero(self.keys[slot] != key)
        if len(missed):
            new, at, back = np.unique(key[missed], return_index=True, return_inverse=True)
            pairs = [(int(left[j]), int(right[j])) for j in missed[at]]
            got = self.bare.encode([(self.names[a] if a >= 0 else "") + self.names[b] for a, b in pairs], num_threads=1)  # a task has one core
            right_ = [ids == [self.number[x] for x in pair if x >= 0] for ids, pair in zip(got, pairs, strict=True)]
            fits = np.asarray(right_, dtype=bool)
            out[missed] = fits[back]
            self.keys[slot[missed[at]]], self.answers[slot[missed[at]]] = new, fits
        return out

    def _grid(self, segs: list[str]) -> np.ndarray:
        """Counts at every prefix of segments of one length: one row each."""
        grid = np.frombuffer("".join(segs).encode("utf-32-le"), dtype="<u4").reshape(len(segs), -1)
        n, length = grid.shape
        last = np.full((length + 1, n), -1, dtype=np.int64)
        count = np.zeros((length + 1, n), dtype="<i4")
        unset = np.ones((length + 1, n), dtype=bool)
        unset[0] = False
        for start, end, piece in self.table.arcs(grid):
            at = np.flatnonzero((piece >= 0) & unset[end])
            if len(at):
                at = at[self._joined(last[start, at], piece[at])]
                last[end, at], count[end, at], unset[end, at] = piece[at], count[start, at] + 1, False
            if start == end - 1 and unset[end].any():  # a sign outside the vocabulary costs its bytes
                at = np.flatnonzero(unset[end])
                if (piece[at] >= 0).any():
                    raise ValueError(f"no token ends a prefix of {segs[at[0]]!r}")
                last[end, at], unset[end, at] = -2, False
                count[end, at] = count[start, at] + [len(chr(c).encode()) for c in grid[at, start]]
        return count[1:].T

    def learn(self, segs: list[str]) -> dict[str, tuple[bytes, int]]:
        """Counts of new segments, worked out together by their lengths."""
        out, by_length = {}, {}
        for s in segs:
            by_length.setdefault(len(s), []).append(s)
        for length, same in by_length.items():
            step = max(1, 400_000 // length)
            for lo in range(0, len(same), step):
                part = same[lo : lo + step]
                found = np.ascontiguousarray(self._grid(part))
                out.update((s, (row.tobytes(), int(row[-1]))) for s, row in zip(part, found, strict=True))
        return out

    def all_counts(self, texts: list[str]) -> list[np.ndarray]:
        """``counts`` of several texts; their new segments are learnt together."""
        split = [_SEGMENT.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        held = self.segments
        found = [list(map(held.get, segs)) for segs in split]
        got = self.learn(list({s for segs, f in zip(split, found, strict=True) if None in f for s, x in zip(segs, f, strict=True) if x is None}))
        if len(held) >= self.cache_entries:  # only what these texts use stays, frequent segments among it
            used = {s: x for segs, f in zip(split, found, strict=True) for s, x in zip(segs, f, strict=True) if x is not None}
            held.clear()
            held.update(used)
        held.update((s, x) for s, x in got.items() if len(s) <= 64)
        return [self._assembled([got[s] if x is None else x for s, x in zip(segs, f, strict=True)] if None in f else f) for segs, f in zip(split, found, strict=True)]

    def _assembled(self, found: list[tuple[bytes, int]]) -> np.ndarray:
        if not found:
            return np.zeros(1, dtype="<i4")
        inner = np.frombuffer(b"".join([x[0] for x in found]), dtype="<i4")
        totals = np.fromiter((x[1] for x in found), dtype="<i4", count=len(found))
        lengths = np.fromiter((len(x[0]) >> 2 for x in found), dtype=np.int64, count=len(found))
        out = inner + np.repeat(np.cumsum(totals, dtype="<i4") - totals, lengths)
        out[0] = 0  # what stands for the empty prefix: the mark before the text is no token yet
        return out

    def counts(self, text: str) -> np.ndarray:
        """Tokens of ``text[:k]`` for k = 0 .. len(text)."""
        return self.all_counts([text])[0]


def counter(model_path: str) -> PrefixCounter:
    """One per worker process and model."""
    return resident(("prefixes", model_path), lambda: PrefixCounter(model_path))


def prefix_token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the id, ``n_bytes``, ``n_tokens`` and ``prefix_tokens``.

    ``prefix_tokens`` holds len(text) + 1 little-endian 32-bit numbers: at k, the tokens of the first k characters. A null
    or empty text has the single number 0. Repeated rows give repeated rows; null ids stay null; other columns of ``docs``
    are not read, so their names can't clash. Every batch is worked through in groups of bounded text, no row is cut.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(model_path)
        for rows in text_groups(batches, 2_000_000):
            found = own.all_counts([r["text"] or "" for r in rows])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r["id"] for r in rows], kind),
                    pa.array([len((r["text"] or "").encode()) for r in rows], pa.int64()),
                    pa.array([int(x[-1]) for x in found], pa.int64()),
                    pa.array([x.tobytes() for x in found], pa.binary()),
                ],
                ["id", "n_bytes", "n_tokens", "prefix_tokens"],
            )

    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = to_arrow_type(picked.schema["id"].dataType)
    out = picked.mapInArrow(count, f"id {picked.schema['id'].dataType.simpleString()}, n_bytes long, n_tokens long, prefix_tokens binary")
    return out.withColumnRenamed("id", id_col)


def tokens_at(prefix_tokens: np.ndarray | bytes, k: int) -> int:
    """Tokens of the first k characters."""
    return int(np.frombuffer(prefix_tokens, dtype="<i4")[k])


def longest_prefix(counts: DataFrame, budget: int, out_col: str = "prefix_chars") -> DataFrame:
    """Adds the most characters of each text whose tokens fit ``budget``, read off the stored counts."""

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stored = batch.column(batch.schema.get_field_index("prefix_tokens")).to_pylist()
            cut = [None if b is None else int(np.flatnonzero(np.frombuffer(b, dtype="<i4") <= budget)[-1]) for b in stored]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cut, pa.int64())], [*batch.schema.names, out_col])

    return counts.mapInArrow(fit, StructType([*counts.schema.fields, StructField(out_col, LongType())]))

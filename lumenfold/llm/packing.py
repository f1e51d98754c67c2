"""Hierarchical packing of tokenized documents into sequences of several context sizes.

Documents are routed to the smallest tier that holds them; longer ones first give off whole windows of the largest tier.
Each tier is packed from its own pieces, and the gaps of long windows are filled from shorter tiers: first by whole pieces
that fit, then by the head of a piece that is cut. Sequences go to step groups of equal token counts: full ones of one tier
each, and at the end of a partition evenly loaded ones of what all tiers have left.
"""

from __future__ import annotations

import heapq
import json
import os
import re
from array import array
from bisect import bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lumenfold.llm.common import resident, text_groups

# Letters that any engine calls letters; a text with other signs beyond ASCII goes to the library as a whole.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿŒœ"
_PLAIN = re.compile(f"[ -~\\n\\t\\r{_LETTERS}]*")
_CHUNK = re.compile(rf" ?[{_LETTERS}]+|'(?:[stmd]|re|ve|ll)| ?[0-9]+| ?[^\s{_LETTERS}0-9]+|\s+(?!\S)|\s+")


def splits_by_chunk(path: str) -> bool:
    """Whether a tokenizer file cuts texts as ``_CHUNK`` does and no other step reads over the cuts: byte-level merges behind
    the usual byte-level split, without a normalizer, added space or truncation of its own."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    split, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    plain = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
    added = spec.get("added_tokens") or []
    return bool(plain) and spec.get("normalizer") is None and model.get("type") == "BPE" and not model.get("dropout") and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix") and not any(t.get("lstrip") or t.get("rstrip") for t in added)


class ChunkEncoder:
    """Token ids of texts as the tokenizers library gives them, with a bounded memo of the chunks it splits texts into.

    A byte-level vocabulary never merges over a chunk's edge. Texts with special strings, or with signs that engines may
    class differently, go to the library whole; so does every text if the file describes another way to split them.
    """

    def __init__(self, path: str, cache_entries: int = 800_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.by_chunk = splits_by_chunk(path)
        self.token_bytes = np.zeros(self.library.get_vocab_size(with_added_tokens=True), dtype=np.int64)
        for token, k in self.library.get_vocab(with_added_tokens=False).items():
            self.token_bytes[k] = len(token)  # a byte-level token has one sign a byte
        self.held: dict[str, bytes] = {}
        self.cache_entries = cache_entries

    def _encode(self, texts: list[str]) -> list[bytes]:
        out = []
        for at in range(0, len(texts), 4096):  # the library's results are many times the ids
            out += [array("I", x.ids).tobytes() for x in self.library.encode_batch_fast(texts[at : at + 4096], add_special_tokens=False)]
        return out

    def _encode_chunks(self, chunks: list[str], at_once: int = 4096) -> list[bytes]:
        """Ids of single chunks. Those that begin with a space before another sign stay chunks when they follow each other:
        many are one text for the library, and the bytes of its tokens tell where each ends."""
        spaced = [c[0] == " " and c[1:2].strip() != "" for c in chunks]
        rows = [c for c, s in zip(chunks, spaced, strict=True) if s]
        found: list[bytes] = []
        for lo in range(0, len(rows), at_once):
            block = rows[lo : lo + at_once]
            text = "".join(block)
            (ids,) = self._encode([text])
            ends = np.cumsum(self.token_bytes[np.frombuffer(ids, dtype="<u4")])
            wanted = np.cumsum([len(c.encode()) for c in block])
            cuts = np.searchsorted(ends, wanted)
            if any(s in text for s in self.special) or len(ends) != cuts[-1] + 1 or (ends[cuts] != wanted).any():
                found += self._encode(block)
                continue
            edges = [0, *(4 * (cuts + 1)).tolist()]
            found += [ids[a:b] for a, b in zip(edges, edges[1:])]
        together, alone = iter(found), iter(self._encode([c for c, s in zip(chunks, spaced, strict=True) if not s]))
        return [next(together if s else alone) for s in spaced]

    def encode(self, texts: list[str], end_id: int) -> list[np.ndarray]:
        end = np.asarray([end_id], dtype="<u4").tobytes()
        held = self.held
        split: list[list[str] | None] = [_CHUNK.findall(t) if self.by_chunk and _PLAIN.fullmatch(t) and not any(s in t for s in self.special) else None for t in texts]
        own = set(chain.from_iterable(filter(None, split)))
        if len(held) >= self.cache_entries:  # only what these texts use stays, frequent chunks among it
            used = {c: held[c] for c in own if c in held}
            held.clear()
            held.update(used)
        new = list(own.difference(held))
        held.update(zip(new, self._encode_chunks(new), strict=True))
        whole = iter(self._encode([t for t, c in zip(texts, split, strict=True) if c is None]))
        out = [np.frombuffer((next(whole) if c is None else b"".join(map(held.__getitem__, c))) + end, dtype="<u4") for c in split]
        for c in new:
            if len(c) > 64:
                del held[c]
        return out


def encoder_of(path: str) -> ChunkEncoder:
    """One per worker process and tokenizer file."""
    return resident(("chunks", path), lambda: ChunkEncoder(path))


@dataclass
class Piece:
    """ids[start : start + len(ids)] of a document."""

    doc_id: object
    start: int
    ids: np.ndarray
    doc_tokens: int


@dataclass
class Pool:
    """Pieces of one tier by length."""

    lengths: list[int] = field(default_factory=list)
    by_length: dict[int, list[Piece]] = field(default_factory=dict)

    def add(self, p: Piece) -> None:
        insort(self.lengths, n := len(p.ids))
        self.by_length.setdefault(n, []).append(p)

    def take(self, most: int) -> Piece | None:
        """The longest piece of at most ``most`` tokens."""
        k = bisect_right(self.lengths, most) - 1
        return None if k < 0 else self.by_length[self.lengths.pop(k)].pop()


class TierPacker:
    """Packs a stream of documents; what is open between calls stays below ``slack`` tokens a tier."""

    def __init__(self, tiers: tuple[int, ...], step_tokens: int, first_id: int):
        if any(t & (t - 1) for t in tiers) or list(tiers) != sorted(set(tiers)):
            raise ValueError("tiers are rising powers of two")
        self.tiers, self.step_tokens = tiers, step_tokens
        self.pools = {t: Pool() for t in tiers}
        self.next_id = self.next_group = first_id
        self.waiting: dict[int, list[list[tuple]]] = {}
        self.out: list[tuple] = []

    def route(self, p: Piece) -> None:
        top = self.tiers[-1]
        while len(p.ids) >= top:
            self._emit([Piece(p.doc_id, p.start, p.ids[:top], p.doc_tokens)], top)
            p = Piece(p.doc_id, p.start + top, p.ids[top:], p.doc_tokens)
        if len(p.ids):
            self.pools[next(t for t in self.tiers if t >= len(p.ids))].add(p)

    def _emit(self, pieces: list[Piece], tier: int) -> None:
        rows, offset = [], 0
        for p in pieces:
            rows.append((p.doc_id, p.start, len(p.ids), p.ids.tobytes(), p.doc_tokens, self.next_id, offset, tier))
            offset += len(p.ids)
        self.next_id += 1
        waiting = self.waiting.setdefault(tier, [])
        waiting.append(rows)
        full = max(1, self.step_tokens // tier)
        if len(waiting) > full:  # one more stays back, so that the end has something to even out
            self._group(waiting[:full])
            del waiting[:full]

    def _group(self, sequences: list[list[tuple]]) -> None:
        self.out += [(*row, self.next_group) for rows in sequences for row in rows]
        self.next_group += 1

    def _close_groups(self) -> None:
        """Deals the sequences left over, the longest first, each to the group with the fewest tokens."""
        left = sorted(((tier, rows) for tier, held in self.waiting.items() for rows in held), key=lambda x: (-x[0], x[1][0][5]))
        total = sum(tier for tier, _ in left)
        loads = [(0, g) for g in range(-(-total // self.step_tokens))]
        groups: list[list] = [[] for _ in loads]
        for tier, rows in left:
            load, g = heapq.heappop(loads)
            groups[g].append(rows)
            heapq.heappush(loads, (load + tier, g))
        for g in groups:
            self._group(g)
        self.waiting.clear()

    def _fill(self, held: list[Piece], gap: int, below: tuple[int, ...]) -> int:
        """Fills a gap from shorter tiers; returns what stays open."""
        for t in reversed(below):
            while gap and (p := self.pools[t].take(gap)):
                held.append(p)
                gap -= len(p.ids)
        if gap:
            for t in below:  # nothing fits whole any more: cut the head of a piece of the shortest tier
                if p := self.pools[t].take(t):
                    held.append(Piece(p.doc_id, p.start, p.ids[:gap], p.doc_tokens))
                    self.route(Piece(p.doc_id, p.start + gap, p.ids[gap:], p.doc_tokens))
                    return 0
        return gap

    def pack(self) -> None:
        """Closes every sequence that the pools can fill; pieces that can't be placed wait for more documents."""
        for k in range(len(self.tiers) - 1, -1, -1):
            tier, waiting = self.tiers[k], []
            while p := self.pools[tier].take(tier):
                held = [p]
                if gap := self._fill(held, tier - len(p.ids), self.tiers[: k + 1]):
                    waiting.append((held, gap))
                    break
                self._emit(held, tier)
            for held, _ in waiting:
                for p in held:
                    self.pools[next(t for t in self.tiers if t >= len(p.ids))].add(p)

    def close(self) -> None:
        """The last pieces, cut into sequences whose lengths are powers of two: no padding is left anywhere."""
        self.pack()
        left = [p for t in self.tiers for held in self.pools[t].by_length.values() for p in held]
        total = sum(len(p.ids) for p in left)
        while total:
            want = min(self.tiers[-1], 1 << (total.bit_length() - 1))
            held, gap = [], want
            while gap:
                p = left.pop()
                held.append(Piece(p.doc_id, p.start, p.ids[:gap], p.doc_tokens))
                if len(p.ids) > gap:
                    left.append(Piece(p.doc_id, p.start + gap, p.ids[gap:], p.doc_tokens))
                gap -= len(held[-1].ids)
            self._emit(held, want)
            total -= want
        self._close_groups()


def pack_documents(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, tiers: tuple[int, ...] = (256, 512, 1024, 2048), step_tokens: int = 65_536
) -> DataFrame:
    """One row per piece: id, ``start``, ``length``, ``ids`` (little-endian unsigned 32-bit), ``doc_tokens``,
    ``sequence_id``, ``offset``, ``tier`` (the sequence's length) and ``step_group``.

    Each input partition is packed by itself in one pass, without a shuffle; open pieces are bounded, so is memory. Every
    sequence is filled to a power of two, the last ones of a partition by cutting them down, so nothing is padded.
    A step group holds at most ``step_tokens`` tokens: exactly that many of one tier, or at the end of a partition an equal
    share of what its tiers have left, about half or more where a partition has that much. A null or empty text is the
    end id alone; very long texts give off windows of the largest tier as they are read; null ids and repeated rows are
    packed like others; an empty table gives no rows; other columns aren't read, so their names can't clash.
    """
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = picked.schema["id"].dataType
    kind = to_arrow_type(id_type)
    names = ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "tier", "step_group"]
    kinds = [kind, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer_path)
        packer = TierPacker(tiers, step_tokens, TaskContext.get().partitionId() << 36)

        def rows() -> pa.RecordBatch:
            out, packer.out = packer.out, []
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)

        for group in text_groups(batches, 2_000_000):
            for r, ids in zip(group, encoder.encode([r["text"] or "" for r in group], end_id), strict=True):
                packer.route(Piece(r["id"], 0, ids, len(ids)))
            packer.pack()
            yield rows()
        packer.close()
        yield rows()

    schema = f"id {id_type.simpleString()}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, tier long, step_group long"
    return picked.mapInArrow(pack, schema).withColumnRenamed("id", id_col)

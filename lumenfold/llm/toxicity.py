"""Toxicity scores by a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

A word enters as what the labelled sample says of it and of its character n-grams (shrunk log odds, for a training text taken
from the texts of the other fold), beside trained vectors of both. The network reads windows of words,
which overlap; a text's score is that of its worst window, and so is what training changes.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from lumenfold.llm.common import resident, text_slices

WORD = re.compile(r"[^\W\d_]+")
WINDOW, STRIDE = 48, 32  # words of a window, and from one window's start to the next one's
HIDDEN, ATTENTION, VECTOR, SAID = 8, 8, 6, 4
INPUTS = SAID + 2 * VECTOR + 1  # what is said of a word, its two vectors, and 1
KEPT = 30.0  # at a gate that lets nothing in: what stands at places without a word


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def grams_of(word: str) -> list[str]:
    """Character n-grams of 4 and 5 signs with the word's ends marked, each once."""
    marked = f"^{word}$"
    return list(dict.fromkeys(marked[i : i + n] for n in (4, 5) for i in range(len(marked) - n + 1)))


def windows_of(n: int) -> list[tuple[int, int]]:
    """Places of the windows over ``n`` words: they cover all words, and neighbours overlap."""
    starts = range(0, max(1, n - (WINDOW - STRIDE)), STRIDE)
    return [(s, min(n, s + WINDOW)) for s in starts]


def evidence(toxic: np.ndarray, clean: np.ndarray, toxic_all: int, clean_all: int, shrink: float = 4.0) -> np.ndarray:
    """Log odds of toxic documents among those with a feature, against those of all; ``shrink`` documents of the overall kind are
    added, so rare features say little. 0 says nothing."""
    share = min(max(toxic_all / max(1, toxic_all + clean_all), 1e-3), 1 - 1e-3)
    return np.log((toxic + shrink * share) / (clean + shrink * (1 - share)) * (1 - share) / share)


@dataclass
class Lookup:
    """Table rows of some words: of each its own (0: none), and those of its n-grams, one word's behind another's."""

    word: np.ndarray
    grams: np.ndarray
    count: np.ndarray

    def of(self, chosen: np.ndarray) -> Lookup:
        first, count = (np.cumsum(self.count) - self.count)[chosen], self.count[chosen]
        within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return Lookup(self.word[chosen], self.grams[np.repeat(first, count) + within], count)


@dataclass
class Network:
    """Parameters, and what a word and an n-gram say. ``words`` and ``grams`` give rows of the tables; row 0 is any other."""

    words: dict[str, int]
    grams: dict[str, int]
    said_words: np.ndarray
    said_grams: np.ndarray
    parts: dict[str, np.ndarray]

    def lookup(self, names: list[str]) -> Lookup:
        own = [[at for x in grams_of(name) if (at := self.grams.get(x))] for name in names]
        return Lookup(np.array([self.words.get(name, 0) for name in names], dtype=np.int64), np.array([g for x in own for g in x], dtype=np.int64), np.array([len(x) for x in own], dtype=np.int64))

    def inputs(self, found: Lookup, said_words: np.ndarray | None = None, said_grams: np.ndarray | None = None) -> np.ndarray:
        said_words, said_grams = (self.said_words if said_words is None else said_words), (self.said_grams if said_grams is None else said_grams)
        out = np.zeros((len(found.word), INPUTS), dtype=np.float32)
        out[:, -1] = 1
        out[:, 0] = said_words[found.word] / 2
        out[:, SAID : SAID + VECTOR] = self.parts["word"][found.word]
        has = np.flatnonzero(found.count)
        if len(has):
            first, said = (np.cumsum(found.count) - found.count)[has], said_grams[found.grams] / 2
            out[has, 1], out[has, 2] = np.maximum.reduceat(said, first), np.minimum.reduceat(said, first)
            out[has, 3] = np.add.reduceat(said, first) / found.count[has]
            out[has, SAID + VECTOR : -1] = np.add.reduceat(self.parts["gram"][found.grams], first) / found.count[has, None]
        return out

    def gates(self, x: np.ndarray) -> np.ndarray:
        """What inputs give to the gates, a row more in front for places without a word."""
        both = np.concatenate([x @ self.parts["in0"], x @ self.parts["in1"]], axis=1)
        pad = np.zeros((1, both.shape[1]), dtype=np.float32)
        pad[0, :HIDDEN] = pad[0, 3 * HIDDEN : 4 * HIDDEN] = KEPT
        return np.concatenate([pad, both.astype(np.float32)])

    def forward(self, gates: np.ndarray, places: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Logits of windows (rows of ``places``, which are rows of ``gates``; 0 where there is no word)."""
        n, width = places.shape
        states = np.zeros((width, n, 2 * HIDDEN), dtype=np.float32)
        for way in (0, 1):
            state, rec = np.zeros((n, HIDDEN), dtype=np.float32), self.parts[f"rec{way}"]
            own = gates[:, 3 * HIDDEN * way : 3 * HIDDEN * (way + 1)]
            for t in range(width)[:: 1 - 2 * way]:
                got, back = own[places[:, t]], state @ rec
                zr = 0.5 + 0.5 * np.tanh(0.5 * (got[:, : 2 * HIDDEN] + back[:, : 2 * HIDDEN]))
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                new = np.tanh(got[:, 2 * HIDDEN :] + r * back[:, 2 * HIDDEN :])
                after = new + z * (state - new)
                if keep is not None:
                    keep.append((way, t, state, z, r, new, back[:, 2 * HIDDEN :]))
                states[t, :, HIDDEN * way : HIDDEN * (way + 1)] = state = after
        look = np.tanh(states @ self.parts["look"])
        score = look @ self.parts["ask"] - 1e9 * (places.T == 0)
        weight = np.exp(score - score.max(0))
        weight /= weight.sum(0)
        pooled = np.einsum("tb,tbh->bh", weight, states)
        if keep is not None:
            keep.append((states, look, weight, pooled))
        return pooled @ self.parts["out"] + self.parts["bias"][0]

    def backward(self, places: np.ndarray, keep: list, dlogit: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the parameters behind the gates, and of what each place gives to the gates (width, windows, gates)."""
        p, grad = self.parts, {}
        states, look, weight, pooled = keep.pop()
        grad["bias"], grad["out"] = dlogit.sum(keepdims=True), pooled.T @ dlogit
        dpooled = np.outer(dlogit, p["out"])
        dweight = np.einsum("bh,tbh->tb", dpooled, states)
        dscore = weight * (dweight - (weight * dweight).sum(0))
        grad["ask"] = np.einsum("tb,tbk->k", dscore, look)
        dlook = dscore[..., None] * p["ask"] * (1 - look**2)
        grad["look"] = np.einsum("tbh,tbk->hk", states, dlook)
        dstates = weight[..., None] * dpooled + dlook @ p["look"].T
        dgates = np.zeros((*states.shape[:2], 6 * HIDDEN), dtype=np.float32)
        for way in (1, 0):
            rec, carry = p[f"rec{way}"], np.zeros((states.shape[1], HIDDEN), dtype=np.float32)
            grad[f"rec{way}"] = np.zeros_like(rec)
            while keep and keep[-1][0] == way:
                _, t, before, z, r, new, back = keep.pop()
                d = carry + dstates[t, :, HIDDEN * way : HIDDEN * (way + 1)]
                dnew = d * (1 - z) * (1 - new**2)
                dz, dr = d * (before - new) * z * (1 - z), dnew * back * r * (1 - r)
                dback = np.concatenate([dz, dr, dnew * r], axis=1)
                grad[f"rec{way}"] += before.T @ dback
                carry = d * z + dback @ rec.T
                dgates[t, :, 3 * HIDDEN * way : 3 * HIDDEN * (way + 1)] = np.concatenate([dz, dr, dnew], axis=1)
        dgates[places.T == 0] = 0
        return grad, dgates


def fresh(words: dict[str, int], grams: dict[str, int], said_words: np.ndarray, said_grams: np.ndarray, seed: int = 7) -> Network:
    rnd = np.random.default_rng(seed)
    shape = {"in0": (INPUTS, 3 * HIDDEN), "in1": (INPUTS, 3 * HIDDEN), "rec0": (HIDDEN, 3 * HIDDEN), "rec1": (HIDDEN, 3 * HIDDEN), "look": (2 * HIDDEN, ATTENTION), "ask": (ATTENTION,), "out": (2 * HIDDEN,)}
    parts = {k: (rnd.normal(size=s) / np.sqrt(s[0])).astype(np.float32) for k, s in shape.items()} | {"bias": np.zeros(1, dtype=np.float32)}
    parts |= {"word": rnd.normal(scale=0.1, size=(len(words) + 1, VECTOR)).astype(np.float32), "gram": rnd.normal(scale=0.1, size=(len(grams) + 1, VECTOR)).astype(np.float32)}
    parts["word"][0] = parts["gram"][0] = 0
    return Network(words, grams, said_words, said_grams, parts)


def probability(logits: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * logits)


class _Adam:
    def __init__(self, parts: dict[str, np.ndarray], rate: float):
        self.parts, self.rate, self.n = parts, rate, 0
        self.mean, self.square = ({k: np.zeros_like(v) for k, v in parts.items()} for _ in range(2))

    def step(self, grad: dict[str, np.ndarray]) -> None:
        self.n += 1
        size = np.sqrt(sum(float((g**2).sum()) for g in grad.values()))
        for k, g in grad.items():
            g = g * min(1, 5 / max(size, 1e-9)) + 1e-4 * self.parts[k]
            self.mean[k] += 0.1 * (g - self.mean[k])
            self.square[k] += 0.01 * (g**2 - self.square[k])
            self.parts[k] -= (self.rate * (self.mean[k] / (1 - 0.9**self.n)) / (np.sqrt(self.square[k] / (1 - 0.99**self.n)) + 1e-6)).astype(np.float32)


def _tables(texts: list[list[str]], label: np.ndarray, fold: np.ndarray, least: int) -> tuple[dict, dict, list, list]:
    """Rows of words and n-grams that tell something, and what they say by all texts and without either fold."""
    out: list = []
    for of in (lambda w: (w,), grams_of):
        counts, memo = [[Counter(), Counter()] for _ in range(2)], {}
        for words, y, f in zip(texts, label, fold, strict=True):
            found = {g for w in set(words) for g in memo.setdefault(w, of(w))}
            counts[f][y].update(found)
        names = sorted(g for g in set().union(*counts[0], *counts[1]) if sum(c[g] for x in counts for c in x) >= least)
        array = np.array([[[c[g] for c in x] for x in counts] for g in names], dtype=float).reshape(len(names), 2, 2)
        totals = np.array([[((fold == f) & (label == y)).sum() for y in (0, 1)] for f in (0, 1)])
        whole = evidence(array[:, :, 1].sum(1), array[:, :, 0].sum(1), totals[:, 1].sum(), totals[:, 0].sum())
        tells = np.flatnonzero(np.abs(whole) >= 0.7)
        without = [evidence(array[tells, 1 - f, 1], array[tells, 1 - f, 0], totals[1 - f, 1], totals[1 - f, 0]) for f in (0, 1)]
        rows = {names[i]: at for at, i in enumerate(tells, 1)}
        out.append((rows, [np.concatenate([[0.0], x]) for x in (whole[tells], *without)]))
    return out[0][0], out[1][0], out[0][1], out[1][1]


def train(texts: list[str], label: list[int], max_words: int = 1000, rounds: int = 4, passes: int = 4, batch: int = 64, rate: float = 0.015, least: int = 4, clean_weight: float = 4.0) -> Network:
    """A network fitted on labelled texts, of each its first ``max_words`` words. A round picks each text's worst window, then
    passes over these windows ``passes`` times; at the end the bias is set so that a score of 0.5 makes the lightest errors on the
    worst windows (``best_cut``). Texts alike are one fold, so a copy doesn't tell of its own label. The same
    texts in the same order give the same network. Without texts of both labels, it knows the one label, or nothing."""
    seen: dict[str, int] = {}
    fold = np.array([seen.setdefault(t, len(seen)) % 2 for t in texts], dtype=int)
    read, labels = [words_of(t)[:max_words] for t in texts], np.asarray(label, dtype=int)
    if len(set(label)) < 2:
        net = fresh({}, {}, np.zeros(1), np.zeros(1))
        net.parts["out"][:], net.parts["bias"][:] = 0, 4.0 * (2 * labels[0] - 1) if len(labels) else 0
        return net
    words, grams, said_words, said_grams = _tables(read, labels, fold, least)
    net = fresh(words, grams, said_words[0], said_grams[0])
    names = [sorted({w for r, f in zip(read, fold, strict=True) if f == k for w in r}) for k in (0, 1)]
    at = [{w: i for i, w in enumerate(x, 1)} for x in names]
    found = [net.lookup(x) for x in names]
    spans = [(i, a, b) for i, r in enumerate(read) for a, b in windows_of(len(r))]
    owner = np.array([i for i, _, _ in spans])
    places = np.array([[at[fold[i]][w] for w in read[i][a:b]] + [0] * (WINDOW - b + a) for i, a, b in spans])
    adam, rnd = _Adam(net.parts, rate), np.random.default_rng(11)
    for turn in range(rounds + 1):
        worst = np.zeros(len(owner))
        for f in (0, 1):
            own, x = np.flatnonzero(fold[owner] == f), net.inputs(found[f], said_words[1 + f], said_grams[1 + f])
            told = np.concatenate([[0.0], x[:, :2].max(1)])
            worst[own] = told[places[own]].max(1) if turn == 0 else net.forward(net.gates(x), places[own])
        order = np.lexsort((-worst, owner))
        chosen = order[np.concatenate([[True], owner[order][1:] != owner[order][:-1]])]
        if turn == rounds:
            net.parts["bias"] -= best_cut(worst[chosen], labels[owner[chosen]], clean_weight)
        for _ in range(passes if turn < rounds else 0):
            for f in (0, 1):
                mine = rnd.permutation(chosen[fold[owner[chosen]] == f])
                for s in range(0, len(mine), batch):
                    part = mine[s : s + batch]
                    target = labels[owner[part]]
                    adam.step(_gradient(net, found[f], places[part], target, said_words[1 + f], said_grams[1 + f]))
    return net


def best_cut(logits: np.ndarray, labels: np.ndarray, clean_weight: float = 1.0) -> np.float32:
    """Where to part logits so that those on the wrong side weigh least, a clean one ``clean_weight`` times a toxic one; the
    middle of the widest gap of those that do so."""
    order = np.argsort(logits, kind="stable")
    x, y = logits[order], labels[order]
    missed, spared = np.concatenate([[0], np.cumsum(y)]), np.concatenate([[0], np.cumsum(1 - y)])
    wrong = missed + clean_weight * ((y == 0).sum() - spared)
    gap = np.diff(np.concatenate([[x[0] - 1], x, [x[-1] + 1]]))
    at = np.lexsort((-gap, wrong))[0]
    return np.float32((x[max(0, at - 1)] + x[min(at, len(x) - 1)]) / 2)


def _gradient(net: Network, found: Lookup, places: np.ndarray, target: np.ndarray, said_words: np.ndarray, said_grams: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean cross-entropy over windows whose places are rows of ``found``, from 1."""
    used, local = np.unique(np.append(places, 0), return_inverse=True)
    local, own = local.ravel()[:-1].reshape(places.shape), found.of(used[1:] - 1)
    x, keep = net.inputs(own, said_words, said_grams), []
    logit = net.forward(net.gates(x), local, keep)
    grad, dgates = net.backward(local, keep, ((probability(logit) - target) / len(places)).astype(np.float32))
    summed = np.zeros((len(used), 6 * HIDDEN), dtype=np.float32)
    np.add.at(summed, local.T.ravel(), dgates.reshape(-1, 6 * HIDDEN))
    half = 3 * HIDDEN
    grad["in0"], grad["in1"] = x.T @ summed[1:, :half], x.T @ summed[1:, half:]
    dx = summed[1:, :half] @ net.parts["in0"].T + summed[1:, half:] @ net.parts["in1"].T
    grad["word"], grad["gram"] = np.zeros_like(net.parts["word"]), np.zeros_like(net.parts["gram"])
    np.add.at(grad["word"], own.word, dx[:, SAID : SAID + VECTOR])
    np.add.at(grad["gram"], own.grams, np.repeat(dx[:, SAID + VECTOR : -1] / np.maximum(1, own.count)[:, None], own.count, axis=0))
    grad["word"][0] = 0
    return grad


def _segments(text: str | None, most: int) -> Iterator[tuple[int, list[str]]]:
    """The words of a text, in order, as parts whose windows together are those of the whole text: the place of a part's first
    word, and its words. A part takes ``most`` words from the text; neighbours share those that their windows share."""
    matches = WORD.finditer(text.lower() if text else "")
    held, at = [m.group() for m in islice(matches, most)], 0
    while True:
        further = [m.group() for m in islice(matches, most)]
        if not further:
            break
        done = (len(held) - WINDOW) // STRIDE * STRIDE + STRIDE if len(held) >= WINDOW else 0
        if done:
            yield at, held[: done + WINDOW - STRIDE]
        at, held = at + done, held[done:] + further
    if at == 0 or len(held) > WINDOW - STRIDE:
        yield at, held


class Scorer:
    """Scores whole texts. What words give to the gates is kept between calls, for up to ``most_words`` words; windows are read
    together, those of ``group`` words at a time."""

    def __init__(self, net: Network, most_words: int = 250_000, group: int = 60_000):
        self.net, self.most_words, self.group = net, most_words, group
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.gates = self.net.gates(np.zeros((0, INPUTS), np.float32))

    def _places(self, words: list[str]) -> np.ndarray:
        new = list(dict.fromkeys(w for w in words if w not in self.known))
        if len(self.known) + len(new) > self.most_words:
            self._forget()
            new = list(dict.fromkeys(words))
        if new:
            self.known.update(zip(new, range(len(self.gates), len(self.gates) + len(new)), strict=True))
            self.gates = np.concatenate([self.gates, self.net.gates(self.net.inputs(self.net.lookup(new)))[1:]])
        return np.fromiter(map(self.known.__getitem__, words), dtype=np.int32, count=len(words))

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text its worst window's probability, that window's first word (of ties the first; from 0), and the number
        of windows. A text without words has one window without any."""
        best, first, count = np.full(len(texts), -np.inf), np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
        held: list[tuple[int, int, int, int]] = []
        words: list[str] = []

        def read() -> None:
            if not held:
                return
            flat, spans = np.append(self._places(words), 0), np.array(held)
            at = spans[:, 2:3] + np.arange(WINDOW)
            places = np.where(at < spans[:, 3:4], flat[np.minimum(at, len(flat) - 1)], 0)
            for s in range(0, len(spans), 4096):
                logits = self.net.forward(self.gates, places[s : s + 4096])
                for (text, start, _, _), logit in zip(held[s : s + 4096], logits.tolist(), strict=True):
                    count[text] += 1
                    if logit > best[text]:
                        best[text], first[text] = logit, start
            held.clear()
            words.clear()

        for i, text in enumerate(texts):
            for start, part in _segments(text, self.group):
                held.extend((i, start + a, len(words) + a, len(words) + b) for a, b in windows_of(len(part)))
                words.extend(part)
                if len(words) >= self.group:
                    read()
        read()
        return probability(best), first, count


def labelled_sample(docs: DataFrame, labels: DataFrame, is_training: Column, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", max_toxic: int = 800, max_clean: int = 1600, max_chars: int = 7000) -> tuple[list[str], list[int]]:
    """The bounded sample: the first ``max_chars`` signs of up to ``max_toxic`` and ``max_clean`` training texts, by a hash
    order of their texts, of equal texts with one label one. An id with several labels counts as toxic if one says so; null
    ids, texts and labels take no part."""
    told = labels.filter(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    rows = docs.filter(F.coalesce(is_training, F.lit(False)) & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(F.lit("toxic"), text_col).alias("order"), F.col(text_col).alias("text"))
    distinct = rows.drop("text").join(told, "id").groupBy("order", "label").agg(F.min("id").alias("id"))
    first = [distinct.filter(F.col("label") == y).orderBy("order", "id").limit(n) for y, n in ((1, max_toxic), (0, max_clean))]
    chosen = F.broadcast(first[0].unionByName(first[1]))  # max_toxic + max_clean rows at most
    found = rows.join(chosen, ["id", "order"]).select("label", "order", F.substring("text", 1, max_chars).alias("text")).distinct()
    got = sorted((r["order"], r["label"], r["text"]) for r in found.toLocalIterator())
    return [t for _, _, t in got], [y for _, y, _ in got]


def score_documents(docs: DataFrame, net: Network, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1, of the worst window of the whole text), ``predicted`` (1 from 0.5 on, else 0),
    ``worst_word`` (where the worst window begins, in words) and ``n_windows``, replacing columns so named.

    A null text, an empty one and one without letters have one window without words. Nothing but the text is looked at; all
    rows and columns pass through, repeated rows included, and an empty table gives no rows."""
    added = [StructField("score", DoubleType()), StructField("predicted", IntegerType()), StructField("worst_word", LongType()), StructField("n_windows", LongType())]
    kept = docs.select(*[c for c in docs.columns if c not in {f.name for f in added}])
    key = ("toxicity", zlib.crc32(b"".join(np.ascontiguousarray(v).tobytes() for v in net.parts.values())), len(net.words), len(net.grams))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = resident(key, lambda: Scorer(net))
        for batch, texts in text_slices(batches, text_col, 2_000_000):
            got, first, count = scorer(texts)
            cols = [*batch.columns, pa.array(got, pa.float64()), pa.array((got >= 0.5).astype(np.int32), pa.int32()), pa.array(first, pa.int64()), pa.array(count, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, [*batch.schema.names, *(f.name for f in added)])

    return kept.mapInArrow(score, StructType([*kept.schema.fields, *added]))

"""Spelling variants against comparisons of all words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lumenfold.llm.spelling import WaveletTree, grouped, near_pairs, near_words, spelling_groups

SCHEMA = "doc_id long, text string, word string, n long, size int, key string"


def is_near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def direct(rows, slip=None, least=6):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            if slip and (h := zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())) % slip == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= least and n >= 5}
    near = {w: [v for v in counts if is_near(w, v)] for w in counts}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-counts[v], v), default=None)
        if best and counts[best] >= 5 * counts[w]:
            form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return sorted((w, str(form.get(w)), root(w), n, len(near[w]), str(counts.get(form.get(w)))) for w, n in counts.items())


def vocabulary(n, letters="abÿ", lengths=(6, 10), seed=1):
    rnd = random.Random(seed)
    return sorted({"".join(rnd.choice(letters) for _ in range(rnd.randint(*lengths))) for _ in range(n)})


@pytest.mark.parametrize("n", [0, 1, 2, 3, 17, 64])
def test_range_reports(n):
    rnd = np.random.default_rng(n)
    values = rnd.permutation(n)
    ends = np.sort(rnd.integers(0, n + 1, (200, 2)), axis=1), np.sort(rnd.integers(0, n + 1, (200, 2)), axis=1)
    query, value = WaveletTree(values).report(ends[0][:, 0], ends[0][:, 1], ends[1][:, 0], ends[1][:, 1])
    want = [(q, int(v)) for q in range(200) for v in values[ends[0][q, 0] : ends[0][q, 1]] if ends[1][q, 0] <= v < ends[1][q, 1]]
    assert sorted(zip(query.tolist(), value.tolist(), strict=True)) == sorted(want)


def test_each_pair_at_one_position():
    words = [w for w in vocabulary(500, "ab", (6, 7))]
    got = [(words[a], words[b]) for low in (0, 3) for x, y in near_pairs(np.array(words), 6, low, 2 if low == 0 else 6, 7) for a, b in zip(x, y, strict=True)]
    assert sorted(got) == sorted((a, b) for a in words if len(a) == 6 for b in words if is_near(a, b))
    longer = np.array([w for w in words if len(w) == 7])
    assert not [x for x, _ in near_pairs(longer, 6, 0, 6) if len(x)]


@pytest.mark.parametrize("most_words", [1, 8, 100_000])
def test_near_words_in_groups_of_any_size(spark, most_words):
    words = vocabulary(400)
    frame = spark.createDataFrame([(w, 5 + i % 7) for i, w in enumerate(words)], "word string, n long").repartition(4)
    counts = {w: 5 + i % 7 for i, w in enumerate(words)}
    got = {r["word"]: (r["n_near"], r["best"]["n"], r["best"]["word"]) for r in near_words(frame, most_words).collect()}
    near = {w: [v for v in words if is_near(w, v)] for w in words}
    assert got == {w: (len(v), *min(((counts[x], x) for x in v), key=lambda t: (-t[0], t[1]))) for w, v in near.items() if v}
    if most_words == 1:
        groups = grouped(frame, most_words).groupBy("size", "low", "up", "key").count()
        assert groups.filter("count > 1 and low < up").isEmpty() and groups.selectExpr("max(low)").first()[0] > 5


@pytest.mark.parametrize("slip", [None, 3])
def test_groups_as_by_brute_force(spark, slip):
    rnd, words = random.Random(4), vocabulary(120, "abÉé", (5, 9), 7)
    weights = [30 if i % 9 == 0 else 1 for i in range(len(words))]
    rows = [(i, " ".join(rnd.choices(words, weights, k=60)) + rnd.choice([" Ab×÷ÀB", "_x9abcdef-ghijkl", " 你好abaabb"])) for i in range(60)]
    rows += [(None, rows[0][1].upper()), rows[3], rows[3], (70, None), (71, ""), (72, " ".join(["ab" * 1500] * 6 + ["ab" * 1500 + "c"] * 40))]
    frame = spark.createDataFrame([(i, t, "x", 1, 2, "k") for i, t in rows], SCHEMA).repartition(3)
    got = sorted((r["word"], str(r["form"]), r["root"], r["n"], r["n_near"], str(r["form_n"])) for r in spelling_groups(frame, slip=slip, most_words=50).collect())
    want = direct(rows, slip)
    assert got == want and any(r[1] != "None" for r in want)


def test_chains_and_ties(spark):
    texts = ["abcdef " * 5, "abcdeg " * 30, "abcdex " * 30, "abcdegh " * 200, "abcdeghi " * 1500]
    frame = spark.createDataFrame([(i, t, "", 0, 0, "") for i, t in enumerate(texts)], SCHEMA)
    got = {r["word"]: (r["form"], r["root"], r["n_near"]) for r in spelling_groups(frame).collect()}
    assert got == {"abcdef": ("abcdeg", "abcdeghi", 2), "abcdeg": ("abcdegh", "abcdeghi", 3), "abcdex": (None, "abcdex", 2), "abcdegh": ("abcdeghi", "abcdeghi", 2), "abcdeghi": (None, "abcdeghi", 1)}
    assert spelling_groups(frame.limit(0)).count() == 0
    with pytest.raises(ValueError):
        spelling_groups(frame, ratio=1)

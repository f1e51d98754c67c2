"""The Merkle manifest against a direct construction."""

import hashlib
import random
import tracemalloc

import pytest
from pyspark.sql import functions as F

from lumenfold.llm.merkle import authenticated, block_root, fold_path, levels_of, traverse

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, part string, at long, digest string"
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def levels_up(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i : i + 2])) for i in range(0, len(out[-1]), 2)])
    return out


def siblings(tree, at):
    out = []
    for level in tree[:-1]:
        out.append(level[at ^ 1] if at ^ 1 < len(level) else "")
        at //= 2
    return out


def leaf_of(row, **changed):
    row = row | changed
    return h("".join("-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in FIELDS))


def direct(rows):
    """Rows of the whole manifest by building every level."""
    parts = {}
    for r in rows:
        parts.setdefault(r["lang"], []).append(r)
    names = sorted(parts, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for name in names:
        parts[name].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r)))
        trees[name] = levels_up([leaf_of(r) for r in parts[name]])
    top = levels_up([trees[n][-1][0] for n in names])
    return sorted((str(r["doc_id"]), leaf_of(r), trees[n][-1][0], top[-1][0], h("".join(siblings(trees[n], i) + siblings(top, k)))) for k, n in enumerate(names) for i, r in enumerate(parts[n]))


def make(counts, seed=3):
    rnd, out = random.Random(seed), []
    for lang, n in counts.items():
        out += [{"doc_id": len(out) + i, "text": rnd.choice(["", "words here", None, "ünï 🙂 " * 9]), "lang": lang, "source": rnd.choice(["a", None]), "n_chars": rnd.choice([None, 3, 12])} for i in range(n)]
    rnd.shuffle(out)
    return out


def frame(spark, rows):
    return spark.createDataFrame([(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"], "x", 9, "y") for r in rows], SCHEMA).repartition(5)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 13, 64, 100])
@pytest.mark.parametrize("band", [1, 2, 3])
def test_traversal_gives_every_path(n, band):
    leaves = [h(str(i)) for i in range(n)]
    tree = levels_up(leaves)
    assert block_root(leaves, levels_of(n)) == tree[-1][0]
    paths = list(traverse(leaves, levels_of(n), band))
    for i, path in enumerate(paths):
        assert [p.lstrip("<>-") for p in path] == siblings(tree, i) and fold_path(leaves[i], path) == tree[-1][0]
    assert len(paths) == n
    higher = tree[-1][0]
    for _ in range(2):
        higher = h(higher)
    assert block_root(leaves, levels_of(n) + 2) == higher == fold_path(leaves[-1], list(traverse(leaves, levels_of(n) + 2))[-1])


def test_traversal_keeps_few_nodes():
    leaves = ["%064x" % i for i in range(4096)]
    tracemalloc.start()
    for _ in traverse(leaves, 12):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60_000  # the whole tree has 4095 inner nodes of over 100 bytes


@pytest.mark.parametrize("levels", [1, 2, 10])
def test_manifest_as_built_directly(spark, levels):
    rows = make({"en": 37, "de": 8, None: 5, "": 1, "zz": 2, "ö": 3})
    rows += [rows[0], rows[0], rows[3] | {"text": "same id, other text"}, rows[5] | {"doc_id": None}]
    got = authenticated(frame(spark, rows), FIELDS, "lang", "doc_id", levels=levels, paths=True).collect()
    assert sorted((str(r["id"]), r["leaf"], r["subroot"], r["root"], r["proof_sha256"]) for r in got) == direct(rows)
    assert all(r["verified"] and r["folded_root"] == r["root"] == fold_path(r["leaf"], r["path"].split()) for r in got)


def test_changed_rows_fail(spark):
    rows = make({"en": 20, "de": 9})
    shown = {"n_chars": F.col("n_chars") + (F.col("doc_id") % 3 == 0).cast("int")}
    for r in authenticated(frame(spark, rows), FIELDS, "lang", "doc_id", shown, levels=2).join(frame(spark, rows).select(F.col("doc_id").alias("id"), "n_chars"), "id").collect():
        assert r["verified"] == (r["id"] % 3 != 0 or r["n_chars"] is None)


def test_small_and_long(spark):
    assert authenticated(frame(spark, []), FIELDS, "lang", "doc_id").count() == 0
    one = [{"doc_id": 4, "text": "long " * 400_000, "lang": None, "source": "s", "n_chars": 1}]
    (r,) = authenticated(frame(spark, one), FIELDS, "lang", "doc_id").collect()
    assert r["leaf"] == r["subroot"] == r["root"] == leaf_of(one[0]) and r["proof_sha256"] == h("") and r["part"] is None

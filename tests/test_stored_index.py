"""The stored index against a direct BM25, and what it reads and writes."""

import math
import time
from collections import Counter

from pyspark.sql import functions as F

from lumenfold.functions.text import plain_search_words
from lumenfold.operators.extraction import entity_key
from lumenfold.operators.fulltext import StoredIndex, near_best, resolve
from lumenfold.plans.store import Store

TEXTS = [("a", "s1", "Die Brücke über den Fluss, über alles"), ("b", "s1", "the bridge of the river"), ("c", "s2", "Uber the river: a bridge"), ("d", "s2", ""), ("e", "s3", None), ("f", "s3", "नदी का पुल river")]


def direct(rows, query):
    words = {i: plain_search_words(t or "") for i, _, t in rows}
    mean, asked = sum(map(len, words.values())) / len(words), list(dict.fromkeys(plain_search_words(query)))
    df = {t: sum(t in w for w in words.values()) for t in asked}
    out = {}
    for i, w in words.items():
        tf = Counter(w)
        if any(tf[t] for t in asked):
            out[i] = round(sum(math.log(1 + (len(rows) - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t in asked if tf[t]), 6)
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "id string, source string, text string")


def scores(index, query):
    return {r["id"]: r["score"] for r in index.search([query]).collect()}


def test_scores_follow_every_update(spark, tmp_path):
    index = StoredIndex(Store(spark, f"file://{tmp_path}/s"), "t", 8)
    assert scores(index, "river") == {}
    index.replace(frame(spark, TEXTS))
    for q in ("river bridge", "ÜBER", "brucke", "पुल", "nothing", ""):
        assert scores(index, q) == direct(TEXTS, q)
    changed = [r for r in TEXTS if r[1] != "s2"] + [("c", "s2", "the river river"), ("g", "s2", "uber")]
    for _ in range(2):  # a second run changes nothing
        index.replace(frame(spark, [r for r in changed if r[1] == "s2"]))
        for q in ("river bridge", "uber", "alles"):
            assert scores(index, q) == direct(changed, q)
    index.replace(frame(spark, []), spark.createDataFrame([("s1",)], "source string"))
    left = [r for r in changed if r[1] != "s1"]
    assert scores(index, "river bridge uber") == direct(left, "river bridge uber")
    assert {r["id"] for r in near_best(index.search(["river"])).collect()} <= {"c", "f"}


def test_a_long_text_takes_time_by_its_words(spark, tmp_path):
    """60,000 different words, some twice: counted one against all others they took minutes."""
    rows = [("long", "s1", " ".join(f"w{i}" for i in [*range(60_000), *range(100)])), ("short", "s1", "w7 w7 w7 other"), ("none", "s2", "")]
    index = StoredIndex(Store(spark, f"file://{tmp_path}/s"), "t", 4)
    began = time.monotonic()
    index.replace(frame(spark, rows))
    assert time.monotonic() - began < 60
    for q in ("w7", "w59999 other", "w99 w100"):
        assert scores(index, q) == direct(rows, q)


def test_a_question_reads_its_buckets_and_an_update_writes_few(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    index = StoredIndex(store, "t", 64)
    index.replace(frame(spark, [(str(i), f"s{i}", f"common word{chr(97 + i % 26)} other{chr(97 + i % 7)}") for i in range(60)]))
    assert len(index.search(["wordc"]).inputFiles()) < 0.2 * len(store.parts("t_postings"))
    before = store.parts("t_postings")
    index.replace(frame(spark, [("1", "s1", "wordb fresh")]))
    after = store.parts("t_postings")
    assert 0 < sum(after.get(b) != p for b, p in before.items()) <= 5 and scores(index, "fresh").keys() == {"1"}


def test_names_resolve_by_type_order(spark, tmp_path):
    rows = [("person:ganga", "Ganga", "Person", "Ganga"), ("org:ganga", "Ganga Ltd", "Organization", "Ganga Ltd"), ("loc:ganga", "Ganga", "Location", "Ganga Gange")]
    entities = spark.createDataFrame(rows, "id string, name string, type string, names string")
    index = StoredIndex(Store(spark, f"file://{tmp_path}/s"), "e", 8)
    index.replace(entities.select("id", F.col("id").alias("source"), F.col("names").alias("text")))
    for types, want in ((("Location", "Person", "Organization"), "loc:ganga"), (("Organization", "Person"), "org:ganga"), ((), "loc:ganga")):
        assert resolve(entities, "Ganga", entity_key, types, index=index)["id"] == resolve(entities, "Ganga", entity_key, types)["id"] == want

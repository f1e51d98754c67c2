"""Line deduplication where blocks cross: the same as pair by pair over all earlier documents."""

import random

import pytest

from lumenfold.llm.line_dedup import block_runs, common_blocks, dedup_lines, left_over


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(f"{r.choice(['alpha', 'beta', 'gamma', 'delta', 'omega'])}{r.randrange(60)}" for _ in range(n))


def over_all_pairs(texts, min_words=20):
    split = [[x.strip(" ") for x in t.split("\n")] for t in texts]
    words = [[x.count(" ") + 1 if x else 0 for x in s] for s in split]
    out = []
    for j, b in enumerate(split):
        cut = {k for a in split[:j] for k in common_blocks(a, b, words[j], min_words)}
        out.append("\n".join(x for k, x in enumerate(texts[j].split("\n")) if k not in cut))
    return out


def frame(spark, texts, extra=()):
    rows = [(i, t, *[9] * len(extra)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", *(f"`{c}` int" for c in extra)])).repartition(3)


def lines_left(spark, texts, **options):
    got = {r["doc_id"]: r["text"] for r in dedup_lines(frame(spark, texts), **options).collect()}
    return [got[i] for i in range(len(texts))]


X, Y = "\n".join([prose(12, 1), prose(12, 2)]), "\n".join([prose(12, 3), prose(12, 4)])


def test_an_earlier_crossed_document_hides_nothing(spark):
    texts = [f"{Y}\nown line\n{X}", f"{X}\nown two\n{Y}", f"{X}\nother line\n{Y}"]
    got = lines_left(spark, texts)
    assert got[0] == texts[0] and got[1] in (f"{X}\nown two", f"own two\n{Y}") and got[2] == "other line"
    assert lines_left(spark, texts[1:]) == [texts[1], "other line"]


def test_more_documents_never_give_lines_back(spark):
    r = random.Random(3)
    blocks = ["\n".join(prose(r.choice([7, 12, 25]), 10 * i + k) for k in range(r.randrange(2, 4))) for i in range(4)]
    texts = []
    for i in range(24):
        r.shuffle(blocks)
        texts.append("\n".join(f"own {i} {k}\n{b}" for k, b in enumerate(blocks[: r.randrange(2, 5)])))
    before = lines_left(spark, texts[4:])
    after = lines_left(spark, texts)
    assert all(set(x.split("\n")) <= set(y.split("\n")) for x, y in zip(after[4:], before, strict=True)) and after != [*texts[:4], *before]


@pytest.mark.parametrize("seed", [1, 2])
def test_as_pair_by_pair(spark, seed):
    """Crossed blocks, repeated ones, one line in half of all documents, and a block that each of many holders has crossed."""
    r = random.Random(seed)
    blocks = [[prose(r.choice([5, 9, 12, 25]), 1000 * i + k) for k in range(r.randrange(2, 5))] for i in range(8)]
    hot = prose(30, 77)
    texts = []
    for i in range(60):
        picked = r.sample(blocks, r.randrange(1, 6)) + ([r.choice(blocks)] if r.random() < 0.2 else [])
        r.shuffle(picked)
        rows = [x for b in picked for x in [*b, f"own {i} {r.randrange(10**6)}"]]
        rows.insert(r.randrange(len(rows)), hot) if i % 2 else None
        texts.append("\n".join(rows))
    texts += [f"{X}\nh {i}\n{Y}" for i in range(9)] + [f"{Y}\nz\n{X}", f"{Y}\nzz\n{X}"]
    assert lines_left(spark, texts) == over_all_pairs(texts)


def test_what_is_left_over():
    a, b, words = [1, 2, 9, 3, 4], [3, 4, 8, 1, 2], [12, 12, 2, 12, 12]
    cut = common_blocks(a, b, words, 20)
    assert len(cut) == 2 and left_over(a, [12, 12, 2, 12, 12], b, words, cut, 20) == block_runs([b[j] for j in range(5) if j not in cut and b[j] != 8], [12, 12], 20)
    assert left_over(a, [12, 12, 2, 12, 12], b, words, [0, 1, 3, 4], 20) == set() == left_over([7], [30], b, words, [], 20)
    assert left_over([5], [30], [5], [30], [], 20) == {5}


def test_names_that_clash(spark):
    texts = [f"{X}\nfirst", f"{X}\nsecond"]
    extra = ["__ld_hash", "__ld_cut", "__ld_id", "__ld0_mark", "__LD1_cut", "hashes", "th"]
    got = dedup_lines(frame(spark, texts, extra))
    assert got.columns == ["doc_id", "text", *extra, "lines_total", "lines_removed"]
    assert {r["doc_id"]: r["text"] for r in got.collect()} == {0: texts[0], 1: "second"}

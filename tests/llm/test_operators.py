"""Each training-data operator against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and
columns whose names clash with inner ones."""

import json
import math
import random
import re
import textwrap
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenfold.llm import queries
from lumenfold.llm.common import fold

random.seed(5)
WORDS = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa", "theta", "zeta", "iota"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, block int, unit int, c0 long"


def prose(n, seed, words=WORDS):
    r = random.Random(seed)
    return " ".join(f"{r.choice(words)}{r.randrange(40)}" for _ in range(n))


BASE = [prose(120, i) for i in range(6)]
TEXTS = [
    *BASE, None, "", "   \n\t", "one", BASE[0], BASE[0] + " tail", BASE[1].replace(" ", "  ", 3), BASE[2][:300] + BASE[3][300:], "Ünïcode " + prose(30, 9) + " naïve ½ 你好", prose(3000, 10), "a" * 2500, "🙂 " * 90, BASE[4].upper(),
    "\n".join([prose(25, 20), prose(25, 21), prose(25, 22)]), "\n".join([prose(25, 20), "own line", prose(25, 22), ""]), prose(15, 30) + "\n" + prose(25, 21),
]
IDS = list(range(len(TEXTS)))


def table(spark, texts=TEXTS, ids=None, langs=None):
    ids = IDS[: len(texts)] if ids is None else ids
    rows = [(i, t, langs[k] if langs else "en" if k % 2 else None, "s", None, 7, "x", 3, 1, 2) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def odd_table(spark):
    """Null ids and repeated rows beside the rest."""
    return table(spark, [*TEXTS, TEXTS[0], TEXTS[1]], [*IDS, None, 1])


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def saved(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    table(spark).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(0, BASE[5][100:300]), (1, "never " + prose(30, 77)), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    vectors = [(i, [random.uniform(-1, 1) for _ in range(8)]) for i in range(300)] + [(300, [0.5] * 8), (350, [0.5] * 8), (400, [0.5] * 8), (401, None), (450, [float("nan")] * 8), (451, [None] * 8), (500, []), (None, [1.0] * 8)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


# ---------- 1 ----------


def brute_removed(texts, least):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[s : s + least] for b in data for s in range(len(b) - least + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - least + 1):
            if seen[b[s : s + least]] > 1:
                gone[s : s + least] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(b), int(gone.sum()), spans, bytes(np.frombuffer(b, np.uint8)[~gone])))
    return out


@pytest.mark.parametrize("most_contexts", [4096, 1])
def test_substrings_as_by_brute_force(spark, most_contexts):
    from lumenfold.llm.suffix_dedup import dedup_substrings

    texts = [*TEXTS, "ab" * 300, "xab" + "ab" * 200, BASE[0][40:330] + BASE[1][:250] + "!", *[f"{i} " * 20 + BASE[5][100:340] + f" {i}" * 30 for i in range(8)]]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in dedup_substrings(table(spark, texts, list(range(len(texts)))), most_contexts=most_contexts).collect()}
    assert [got[i] for i in range(len(texts))] == brute_removed(texts, 200)


def test_substrings_across_the_segments_of_a_long_text(spark, monkeypatch):
    from lumenfold.llm import suffix_dedup

    monkeypatch.setattr(suffix_dedup, "SEGMENT", 500)
    text = prose(700, 44)
    for at in (0, 301, 499, 900):
        whole = b"x" + text.encode() + text.encode()[at : at + 700]
        data = np.frombuffer(whole, np.uint8)
        strings = {}
        anchors, _, starts, counts = suffix_dedup.contexts_of(data, 200, 24)
        for a, s, n in zip(anchors.tolist(), starts.tolist(), counts.tolist(), strict=True):
            for i in range(s, s + n):
                strings.setdefault(whole[i : i + 200], set()).add(a)
        assert sorted(starts.tolist()) == starts.tolist() and counts.sum() == len(whole) - 199 and all(len(a) == 1 for a in strings.values())


def test_substrings_of_odd_tables(spark):
    from lumenfold.llm.suffix_dedup import dedup_substrings

    rows = dedup_substrings(odd_table(spark)).collect()
    want = brute_removed([*TEXTS, TEXTS[0], TEXTS[1]], 200)
    assert Counter((r["n_bytes"], r["n_removed"]) for r in rows) == Counter(w[:2] for w in want)
    assert dedup_substrings(empty(spark)).count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_transform_finds_repeated_starts(seed):
    from lumenfold.llm.bwt import repeated_starts

    r = random.Random(seed)
    strings = [bytes(r.choice(b"ab") for _ in range(r.randrange(120))) for _ in range(6)]
    strings += [strings[0][10:90], b"", b"a" * 50]
    least = r.choice([5, 8, 13, 31])
    seen = Counter(s[i : i + least] for s in strings for i in range(len(s) - least + 1))
    for s, mask in zip(strings, repeated_starts(strings, least), strict=True):
        assert mask.tolist() == [i + least <= len(s) and seen[s[i : i + least]] > 1 for i in range(len(s))]


# ---------- 2 ----------


def brute_dice(text, templates, threshold):
    from lumenfold.llm.license_scan import plain_bigrams

    units = [] if text is None else [(0, text)] + ([(i, x) for i, x in enumerate(text.split("\n"), 1)] if "\n" in text else [])
    blocks = [[]]
    for line in (text or "").split("\n"):
        if any(c.isascii() and c.isalnum() for c in line):
            blocks[-1].append(line)
        elif blocks[-1]:
            blocks.append([])
    found = ["\n".join(b) for b in blocks if len(b) > 1]
    out = {}
    for unit, part in units:
        own = plain_bigrams(part)
        for name, texts in templates.items():
            for t in texts:
                other = plain_bigrams(t)
                if own and other and (dice := 2 * len(own & other) / (len(own) + len(other))) >= threshold:
                    out[unit, name] = max(out.get((unit, name), 0), round(dice, 6))
    in_blocks = sorted((name, round(d, 6)) for part in found if len(found) > 1 or "\n".join(blocks[0]) != text for own in [plain_bigrams(part)] for name, texts in templates.items() if (d := max((2 * len(own & g) / (len(own) + len(g)) for t in texts if (g := plain_bigrams(t))), default=0)) >= threshold)
    return out, in_blocks


def test_licenses_as_by_brute_force(spark):
    from lumenfold.llm.license_scan import TEMPLATES, scan_licenses

    mit = TEMPLATES["MIT"][3]
    texts = [None, "", "MIT", "Released under the MIT License.", "x\nLICENSED under the Apache-License, version 2.0\ny", mit, mit.replace("Software", "Program"), f"Copyright 2020 A\n\n{mit}", "all rights\nreserved", "A.\nAll rights reserved.", "Licensed under CC BY-NC 4.0!", *BASE]
    code = "\n".join(f"x{i} = compute(x{i - 1}, {i})" for i in range(1, 60))
    wrapped = "\n\n".join(textwrap.fill(p, 70) for p in TEMPLATES["MIT"][4:7])
    header = "\n".join("# " + x for x in textwrap.wrap(TEMPLATES["GPL-3.0"][1], 60))
    texts += [f"Copyright 2020 A\n\n{wrapped}\n\n{code}", f"#!/usr/bin/tool\n#\n{header}\n#\n{code}", "All rights reserved."]
    got = defaultdict(dict)
    for r in scan_licenses(table(spark, texts, list(range(len(texts))))).collect():
        got[r["doc_id"]][r["unit"], r["license_id"]] = r["dice"]
    for i, t in enumerate(texts):
        lines, blocks = brute_dice(t, TEMPLATES, 0.8)
        assert {k: v for k, v in got[i].items() if k[0] >= 0} == lines, t
        if t and re.search("\n[^A-Za-z0-9\n]*\n", t):
            assert sorted((name, d) for (unit, name), d in got[i].items() if unit < 0) == blocks, t
    # a wrapped licence above code is found by its blocks; rows that repeat give a finding once
    assert {n for u, n in got[len(texts) - 3] if u < 0} == {"MIT"} and max((d, n) for (u, n), d in got[len(texts) - 2].items() if u < 0) == (1.0, "GPL-3.0")
    assert got[len(texts) - 1][0, "Proprietary"] and scan_licenses(table(spark, ["All rights reserved."] * 3, [1, 1, 2])).count() == 2
    assert scan_licenses(empty(spark)).count() == 0 and scan_licenses(odd_table(spark)).count() == 0
    with pytest.raises(ValueError, match="templates"):
        scan_licenses(empty(spark), max_templates=3)


# ---------- 3 ----------


@pytest.fixture(scope="module")
def encoder():
    from lumenfold.llm.packing import ChunkEncoder

    return ChunkEncoder(queries.tokenizer_path(queries.BYTE_TOKENIZER))


def test_chunk_ids_are_the_library_s(encoder):
    texts = [t or "" for t in TEXTS] + ["it's we'll 'S\n\n  a  b\t\tc \n d", "x²½ ٣", "<|endoftext|>hi", "a\x1cb \x85c", "123 456,789.. __a_b"]
    want = [x.ids + [1] for x in encoder.library.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in encoder.encode(texts, 1)] == want


def test_new_chunks_are_encoded_together(encoder, monkeypatch):
    r, sent = random.Random(3), []
    chunks = list({r.choice([" ", " ", " ", "", "\n"]) + "".join(r.choices("abcdeéßÿœ", k=r.randrange(1, 12))) for _ in range(3000)}) + [" 12", " --", "  ", " ", "\n\n", " <", "'s", " '", " s"]
    want = [np.asarray(x.ids, dtype="<u4").tobytes() for x in encoder.library.encode_batch(chunks, add_special_tokens=False)]
    plain = encoder._encode
    monkeypatch.setattr(encoder, "_encode", lambda texts: sent.extend(texts) or plain(texts))
    for at_once in (1, 7, 4096):
        assert encoder._encode_chunks(chunks, at_once) == want
    sent.clear()
    encoder.held.clear()
    encoder.encode(["".join(c for c in chunks if c[0] == " " and c[1:].isalpha())], 1)
    assert len(sent) < 10  # one text for all, not one a chunk
    monkeypatch.setattr(encoder, "token_bytes", np.ones_like(encoder.token_bytes))  # a file whose tokens' bytes aren't known
    assert encoder._encode_chunks(chunks) == want


def test_packing_round_trip(spark, encoder):
    from lumenfold.llm.packing import pack_documents

    texts = [*TEXTS, *[prose(n, n) for n in (700, 90, 40, 41, 42, 43, 10, 2500)]]
    rows = pack_documents(table(spark, texts, list(range(len(texts)))), queries.tokenizer_path(queries.BYTE_TOKENIZER)).collect()
    want = [x.tolist() for x in encoder.encode([t or "" for t in texts], 1)]
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = np.frombuffer(bytes(r["ids"]), "<u4").tolist()
        assert len(ids) == r["length"] > 0 and r["doc_tokens"] == len(want[r["doc_id"]])
        docs[r["doc_id"]].append((r["start"], ids))
        sequences[r["sequence_id"]].append((r["offset"], len(ids), r["tier"], r["step_group"]))
    assert {d: [x for _, ids in sorted(p) for x in ids] for d, p in docs.items()} == dict(enumerate(want))
    for pieces in sequences.values():
        at = 0
        for offset, n, tier, _ in sorted(pieces):
            assert offset == at
            at += n
        assert at == tier <= 2048 and tier & (tier - 1) == 0
    assert pack_documents(empty(spark), queries.tokenizer_path(queries.BYTE_TOKENIZER)).count() == 0
    assert sum(r["length"] for r in pack_documents(odd_table(spark), queries.tokenizer_path(queries.BYTE_TOKENIZER)).collect()) == sum(len(x) for x in encoder.encode([t or "" for t in [*TEXTS, TEXTS[0], TEXTS[1]]], 1))


def test_step_groups_are_even():
    from lumenfold.llm.packing import Piece, TierPacker

    r = random.Random(12)
    for n in (0, 3, 40, 900):
        packer = TierPacker((256, 512, 1024, 2048), 8192, 7)
        for i in range(n):
            size = r.choice([r.randrange(1, 300), r.randrange(1, 3000), 9000 if i == 5 else 40])
            packer.route(Piece(i, 0, np.zeros(size, "<u4"), size))
            if i % 50 == 0:
                packer.pack()
        packer.close()
        loads, tiers, at = Counter(), defaultdict(set), {}
        for row in packer.out:
            loads[row[8]] += row[2]
            tiers[row[8]].add(row[7])
            assert at.setdefault(row[5], row[8]) == row[8]  # a sequence is in one group
        some = [x for x in loads.values() if x < 8192]
        assert max(loads.values(), default=0) <= 8192 and (len(loads) < 2 or min(loads.values()) >= 4096 - 2048)
        assert max(some, default=0) - min(some, default=0) <= 2048 and all(loads[g] == 8192 or len(tiers[g]) >= 1 for g in loads)
        assert sorted(loads) == list(range(7, 7 + len(loads)))


def test_other_tokenizer_files_go_to_the_library(tmp_path):
    from lumenfold.llm.packing import ChunkEncoder, splits_by_chunk

    source = queries.tokenizer_path(queries.BYTE_TOKENIZER)
    with open(source, encoding="utf-8") as f:
        spec = json.load(f)
    assert splits_by_chunk(source)
    for name, change in {"lower": {"normalizer": {"type": "Lowercase"}}, "space": {"pre_tokenizer": {**spec["pre_tokenizer"], "add_prefix_space": True}}, "other": {"pre_tokenizer": {"type": "Whitespace"}}}.items():
        path = tmp_path / f"{name}.json"
        path.write_text(json.dumps({**spec, **change}), encoding="utf-8")
        encoder = ChunkEncoder(str(path))
        texts = ["Some Words, it's 2031!", " a  b\nC", ""]
        assert not encoder.by_chunk and [x.tolist() for x in encoder.encode(texts, 1)] == [x.ids + [1] for x in encoder.library.encode_batch(texts, add_special_tokens=False)]


def test_packing_query_digests(spark, saved, encoder):
    for r in queries.op3_packing(spark, saved).collect():
        ids = encoder.encode([TEXTS[r["doc_id"]] or ""], 1)[0][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(ids.tobytes())


# ---------- 4 ----------


@pytest.mark.parametrize("seed", range(30))
def test_patience_pairs_are_a_common_subsequence(seed):
    from lumenfold.llm.line_dedup import patience_pairs

    r = random.Random(seed)
    a = [r.randrange(12) for _ in range(r.randrange(30))]
    b = a[: r.randrange(20)] + [r.randrange(12) for _ in range(r.randrange(10))] + a[r.randrange(20) :]
    pairs = patience_pairs(a, b)
    assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))
    assert patience_pairs(a, a) == [(i, i) for i in range(len(a))]


def test_later_documents_lose_aligned_blocks(spark):
    from lumenfold.llm.line_dedup import dedup_lines

    x, y, z = prose(25, 20), prose(25, 21), prose(25, 22)
    texts = ["\n".join([x, y, z]), "\n".join([x, "own", z]), "\n".join([z, y]), "short line\nother", "short line\nmore", None, "", "\n".join([x, y, z]), f"  {x}  "]
    got = {r["doc_id"]: r for r in dedup_lines(table(spark, texts, list(range(len(texts))))).collect()}
    assert [got[i]["text"] for i in range(9)] == [texts[0], "own", got[2]["text"], "short line\nother", "short line\nmore", None, "", "", ""]
    assert got[2]["text"] in (y, z)  # the two lines are crossed: one of them can be aligned
    assert got[7]["lines_removed"] == 3 and got[0]["lines_removed"] == 0 and got[5]["lines_total"] == 0
    assert got[0]["key"] == "x" and got[0]["id"] == 7
    assert dedup_lines(empty(spark)).count() == 0 and dedup_lines(odd_table(spark)).count() == len(TEXTS) + 2


@pytest.mark.parametrize("seed", range(20))
def test_every_line_of_a_shared_block_stands_in_a_shared_run(seed):
    from lumenfold.llm.line_dedup import block_runs

    r = random.Random(seed)
    block = [(r.randrange(50), r.choice([0, 1, 3, 9, 12])) for _ in range(r.randrange(4, 12))]
    runs = block_runs(*map(list, zip(*block, strict=True)), 20)
    assert bool(runs) == (sum(w for _, w in block) >= 20)
    a, b = ([(100 * k + r.randrange(50), 5) for _ in range(8)] + block + [(100 * k + r.randrange(50), 5) for _ in range(8)] for k in (1, 2))
    assert block_runs(*map(list, zip(*a, strict=True)), 20) & block_runs(*map(list, zip(*b, strict=True)), 20) == runs


def test_blocks_whose_lines_all_stand_singly_before(spark):
    from lumenfold.llm.line_dedup import dedup_lines

    l1, l2, l3, l4 = (prose(n, 40 + n) for n in (10, 9, 11, 3))
    block = [l1, "", l2, l3, l4]
    early = [f"{l1}\nown a", f"{l2}\nown b", f"own c\n{l3}", f"{l4}\nown d"]
    late = ["\n".join([f"head {i}", *block, f"tail {i}"]) for i in range(6)]
    got = {r["doc_id"]: r for r in dedup_lines(table(spark, early + late, list(range(10)))).collect()}
    assert [got[i]["text"] for i in range(5)] == early + late[:1]
    assert [got[i]["text"] for i in range(5, 10)] == [f"head {i}\ntail {i}" for i in range(1, 6)]


def test_repeated_passages_and_copies_of_crossed_documents_go(spark):
    from lumenfold.llm.line_dedup import dedup_lines, patience_pairs

    assert patience_pairs([1, 9, 2, 9, 3], [4, 9, 5]) == [(1, 1)] and patience_pairs([4, 9, 5], [1, 9, 2, 9, 3]) == [(1, 1)]
    p, q, x, y, z = (prose(25, 50 + i) for i in range(5))
    s, t = prose(6, 60), prose(6, 61)
    texts = [f"u\n{p}\nv\n{p}\nw", f"k\n{p}\nm", f"k2\n{p}\nm2", f"b\n{q}\nc", f"d\n{q}\ne\n{q}\nf", "\n".join([x, y, z]), f"{z}\n{y}", f"{z}\n{y}", f"{s}\ng\n{t}\n{prose(25, 62)}", f"{prose(25, 62)}\n{s}\nh\n{t}"]
    got = {r["doc_id"]: r["text"] for r in dedup_lines(table(spark, texts, list(range(len(texts))))).collect()}
    assert [got[i] for i in (0, 1, 2, 3, 4, 5, 7)] == [texts[0], "k\nm", "k2\nm2", texts[3], "d\ne\nf", texts[5], ""]
    assert got[6] in (y, z) and got[9] == f"{s}\nh\n{t}"  # short lines in order don't stand in a block's way


def removed_over_all_pairs(texts, min_words=20):
    """What each document loses to any earlier one, pair by pair."""
    from lumenfold.llm.line_dedup import common_blocks

    split = [[x.strip(" ") for x in t.split("\n")] for t in texts]
    words = [[x.count(" ") + 1 if x else 0 for x in s] for s in split]
    out = []
    for j, b in enumerate(split):
        cut = {k for a in split[:j] for k in common_blocks(a, b, words[j], min_words)}
        out.append("\n".join(x for k, x in enumerate(texts[j].split("\n")) if k not in cut))
    return out


@pytest.mark.parametrize("part_pairs", [1000, 3])
def test_lines_as_by_all_pairs(spark, part_pairs):
    from lumenfold.llm.line_dedup import dedup_lines

    r = random.Random(8)
    blocks = [[prose(r.choice([3, 7, 12, 25]), 1000 * i + k) for k in range(r.randrange(2, 6))] for i in range(12)]
    hot = prose(30, 99)
    texts = []
    for i in range(70):
        own = [x for b in blocks if r.random() < 0.25 for x in [*b, f"own {i} {r.randrange(10**6)}"]]
        single = [r.choice([x for b in blocks for x in b if x.count(" ") < 19])]  # a block's line that stands alone
        texts.append("\n".join([f"head {i}", *own, f"mid {i}", *single, f"tail {i}", *([hot] if i % 2 else [])]))
    l1, l2, l3 = prose(10, 901), prose(10, 902), prose(9, 903)
    texts += [f"{l1}\na", f"b\n{l2}", f"c\n{l1}\n{l2}\n{l3}", f"d\n{l1}\n{l2}\ne"]
    got = {x["doc_id"]: x["text"] for x in dedup_lines(table(spark, texts, list(range(len(texts)))), part_pairs=part_pairs).collect()}
    assert [got[i] for i in range(len(texts))] == removed_over_all_pairs(texts)  # blocks stand in one order here: none is crossed


def test_documents_of_many_lines(spark):
    import time

    from lumenfold.llm.line_dedup import dedup_lines

    many = [f"line {i} of a long list" for i in range(32_000)]
    texts = ["\n".join(many), "\n".join(many[:16_000] + ["cut here"] + many[16_000:]), "\n".join(x for i, x in enumerate(many) if i % 50)]
    began = time.perf_counter()
    got = {x["doc_id"]: (x["lines_total"], x["lines_removed"]) for x in dedup_lines(table(spark, texts, [0, 1, 2])).collect()}
    assert got == {0: (32_000, 0), 1: (32_001, 32_000), 2: (31_360, 31_360)} and time.perf_counter() - began < 60


@pytest.mark.parametrize("seed", range(300))
def test_common_blocks_leave_only_crossed_ones(seed):
    from lumenfold.llm.line_dedup import common_blocks

    r = random.Random(seed)
    lines = r.choice([4, 12, 40])
    weight = [0, *(r.choice([2, 7, 12, 25]) for _ in range(lines))]
    a = [r.randrange(lines + 1) for _ in range(r.randrange(30))]
    b = [r.randrange(lines + 1) for _ in range(r.randrange(10))]
    for _ in range(r.randrange(4)):
        lo = r.randrange(len(a) + 1)
        b += a[lo : lo + r.randrange(9)] + [r.randrange(lines + 1)]
    words = [weight[x] for x in b]
    cut = set(common_blocks(a, b, words, 20))
    shared = {(lo, hi) for lo in range(len(b)) for hi in range(lo + 1, len(b) + 1) if sum(words[lo:hi]) >= 20 and any(a[i : i + hi - lo] == b[lo:hi] for i in range(len(a)))}
    assert cut <= {j for lo, hi in shared for j in range(lo, hi)} and (cut or not shared)
    for lo, hi in shared:
        assert cut & set(range(lo, hi)) or any(words[j] and a.count(b[j]) == b.count(b[j]) == 1 for j in range(lo, hi))


# ---------- 5 ----------


def test_top_k_as_by_brute_force(spark, saved):
    rows = spark.read.parquet(f"{saved}/embeddings.parquet").collect()
    own = {r["vec_id"]: [math.floor(256 * float(x)) for x in r["embedding"]] for r in rows if r["vec_id"] is not None and r["embedding"] is not None and all(x is not None and math.isfinite(x) for x in r["embedding"])}
    want = {}
    for q in (v for v in own if v % 50 == 0):
        scores = sorted(((-sum(a * b for a, b in zip(own[q], v, strict=False)), c) for c, v in own.items() if c != q))[:5]
        want |= {(q, i): (c, -s) for i, (s, c) in enumerate(scores, 1)}
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in queries.op5_exact_top_k(spark, saved).collect()}
    assert got == want


@pytest.mark.parametrize(("block", "stride"), [(8, 1), (8, 3), (40, 2), (1000, 4)])
def test_top_k_passes_over_low_norms_only(spark, block, stride):
    """Norms from 0 to large, equal vectors, negative scores: the same rows for every size of blocks."""
    from lumenfold.llm.topk import exact_top_k

    r = random.Random(5)
    own = {i: [r.randrange(-9, 10) * (i % 7) ** 2 for _ in range(6)] for i in range(150)}
    own |= {i: [3, -4, 0, 5, 1, 2] for i in range(150, 190)}
    want = {}
    for q in (i for i in own if i % 10 == 0):
        scores = sorted((-sum(a * b for a, b in zip(own[q], v, strict=True)), c) for c, v in own.items() if c != q)[:5]
        want |= {(q, i): (c, -s) for i, (s, c) in enumerate(scores, 1)}
    vectors = spark.createDataFrame(list(own.items()), "vec_id long, v array<bigint>")
    got = exact_top_k(vectors, F.col("vec_id") % 10 == 0, candidate_block=block, query_block=7, stride=stride).collect()
    assert {(x["query_id"], x["rank"]): (x["vec_id"], x["score"]) for x in got} == want


@pytest.mark.parametrize("block", [2, 1000])
def test_top_k_of_repeated_rows_as_its_sql(spark, tmp_path, block):
    """Repeated candidates, repeated queries, an id with several vectors: the operator and the registered SQL agree."""
    import duckdb

    from lumenfold.llm.topk import exact_top_k, quantised

    r = random.Random(2)
    rows = [(50, [1.0, 0.0]), (1, [3.0, 0.0]), (1, [3.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 1.0])]
    rows += [(i, [r.randrange(3), r.randrange(3)]) for i in range(90, 130) for _ in range(r.randrange(1, 4))] + [(100, [float(i), 1.0]) for i in range(9)] + [(150, [2.0, 2.0])] * 7
    frame = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<double>").repartition(3)
    frame.coalesce(1).write.parquet(f"{tmp_path}/e")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/e/*.parquet'")
    want = sorted(con.execute(queries.OP5_SQL).fetchall())
    got = exact_top_k(quantised(frame), F.col("vec_id") % 50 == 0, candidate_block=block, query_block=block).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, got)) == want and len([x for x in want if x[0] == 50]) == 5


def test_top_k_small_tables(spark):
    from lumenfold.llm.topk import exact_top_k

    schema = "vec_id long, v array<bigint>, q boolean, key string, cid long"
    few = spark.createDataFrame([(1, [1, 2], True, "a", 0), (2, [3, 4], False, "b", 0), (2, [3, 4], False, "b", 0), (3, None, True, "c", 0), (4, [5], None, "d", 0)], schema)
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in exact_top_k(few, F.col("q")).orderBy("query_id", "rank").collect()]
    assert got == [(1, 1, 2, 11), (1, 2, 2, 11), (1, 3, 4, 5)]  # a row that stands twice is two candidates
    assert exact_top_k(spark.createDataFrame([], schema), F.col("q")).count() == 0


# ---------- 6 ----------

LANGS = {"xx": ["tharo", "venli", "quomat", "drisk", "ombel"], "yy": ["sivane", "lorpi", "ketmun", "abdra", "fintu"]}


def test_languages_of_held_out_texts(spark):
    from lumenfold.llm.language_id import identify, training_samples

    rows = [(lang, " ".join(random.choice(words) for _ in range(60))) for i in range(120) for lang, words in [random.choice(list(LANGS.items()))]]
    extra = [(None, None), ("xx", ""), ("xx", "123 ½²456 "), (None, "tharo venli drisk"), ("yy", " ".join(LANGS["yy"] * 9000))]
    all_ = rows + extra
    docs = table(spark, [t for _, t in all_], list(range(len(all_))), [lang for lang, _ in all_])
    samples = training_samples(docs, fold("doc_id", 3) != 1)
    assert set(samples) == {"xx", "yy"} and all(len(s) <= 30_000 for s in samples.values())
    got = {r["doc_id"]: r for r in identify(docs, samples).collect()}
    assert all(got[i]["lang_pred"] == lang for i, (lang, _) in enumerate(rows))
    n = len(rows)
    assert [got[n + k]["lang_pred"] for k in range(5)] == ["und", "und", "und", "xx", "yy"] and got[n]["score"] == 0.0
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[0]["key"] == "x"
    assert identify(docs, {}).filter("lang_pred <> 'und'").count() == 0
    assert identify(empty(spark), samples).count() == 0 and training_samples(empty(spark), fold("doc_id", 3) != 1) == {}


def greedy_phrases(text, sample):
    at = count = 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at : at + size + 1] in sample:
            size += 1
        at, count = at + size, count + 1
    return count


@pytest.mark.parametrize("dense", [48_000_000, 0])
@pytest.mark.parametrize("seed", range(10))
def test_phrases_are_greedy_longest_matches(seed, dense):
    from lumenfold.llm.language_id import CrossParser

    r = random.Random(seed)
    samples = {k: "".join(r.choice("abc ") for _ in range(60)) for k in ("p", "q")}
    texts = ["".join(r.choice("abcd ") for _ in range(r.randrange(1, 80))) for _ in range(20)] + [samples["p"][3:50] * 4]
    for piece, lead in ((4096, 256), (7, 3), (1, 1), (13, 2)):
        got = CrossParser(samples, dense).phrases(texts, piece, lead)
        assert got.tolist() == [[greedy_phrases(t, samples[k]) for k in ("p", "q")] for t in texts]


def test_large_alphabets_stay_small():
    import tracemalloc

    from lumenfold.llm.language_id import CrossParser

    r = random.Random(3)
    samples = {"han": "".join(chr(0x4E00 + r.randrange(3000)) for _ in range(30_000)), "en": prose(4000, 3)[:30_000]}
    tracemalloc.start()
    parser = CrossParser(samples)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    texts = [samples["han"][100:400], prose(60, 4), samples["han"][5000:9000] + samples["en"][:900]]
    assert peak < 400_000_000 and parser.phrases(texts, 500).tolist() == [[greedy_phrases(t, samples[k]) for k in parser.labels] for t in texts]


def test_every_label_is_learned(spark):
    from lumenfold.llm.language_id import identify, training_samples

    rows = [(f"l{i}", f"{chr(97 + i % 26)}{chr(97 + i // 26)}qu " * 40) for i in range(60)]
    docs = table(spark, [t for _, t in rows], list(range(60)), [lang for lang, _ in rows])
    samples = training_samples(docs, F.lit(True), max_total=6000)
    assert set(samples) == {lang for lang, _ in rows} and all(len(x) == 100 for x in samples.values())
    tied = identify(docs.limit(3), {"b": " same ", "a": " same "}).collect()
    assert {r["lang_pred"] for r in tied} == {"a"} and {r["score"] for r in tied} == {0.0}


# ---------- 7 ----------


def test_leaks_are_found_and_clean_documents_left_alone(spark):
    from lumenfold.llm.decontaminate import contaminated

    words = [f"{a}{b}" for a in WORDS for b in WORDS]
    items = [prose(n, 900 + n, words) + "." for n in (15, 24, 40, 60, 150)]
    clean = [prose(200, i, words) for i in range(60)]
    planted = {100 + k: clean[k][: 100 * k] + " " + item + " " + clean[k + 1] for k, item in enumerate(items)}
    shuffled = {200: clean[7] + " " + " ".join(w for i, w in enumerate(items[2].split()) if i % 6), 201: items[3]}
    docs = table(spark, [*clean, *planted.values(), *shuffled.values(), None, ""], [*range(60), *planted, *shuffled, 300, 301])
    bench = spark.createDataFrame([*enumerate(items), (50, None), (51, ""), (1, items[1])], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in contaminated(docs, bench).collect()}
    assert got == {(100 + k, k) for k in range(5)} | {(200, 2), (201, 3)}
    assert contaminated(empty(spark), bench).count() == 0 and contaminated(docs, bench.limit(0)).count() == 0
    assert {(r["doc_id"], r["item_id"]) for r in contaminated(docs, bench, block_chars=200).collect()} == got


def test_words_of_texts_have_the_terms_of_the_benchmark(spark):
    from lumenfold.llm.decontaminate import Terms, _buckets_of, words_of

    texts = [" Ab, (cd)\n\tÜber-x. ", None, "", " \x0b", "-- ab " + "long" * 9 + "! \x1cab longlong", "longlonglong", "日本 ab"]
    known = ["ab", "Über-x", "long" * 9, "longlong", "日本"]
    terms = Terms(_buckets_of(pa.array(known)))
    codes, counts = terms.encode(pa.array(["pad ab", *texts]).slice(1))
    number = {w.encode(): int(terms.number[_buckets_of(pa.array([w]))[0]]) for w in known}
    assert set(number.values()) == set(range(5)) and counts.tolist() == [len((t or "").encode().split()) for t in texts]
    assert codes[codes >= 0].tolist() == [number[w] for t in texts for w in words_of(t) if w in number]


def test_the_latent_space_is_fitted_on_every_passage(spark, monkeypatch):
    from lumenfold.llm import decontaminate

    words, r, step = [f"w{i}" for i in range(12)], random.Random(5), 4
    texts = [" ".join(r.choices(words, range(1, 13), k=r.randrange(1, 30))) for _ in range(80)] + [None, ""]
    items, fit, seen = [(0, " ".join(words[:7])), (1, " ".join(words[5:]))], decontaminate.latent_space, {}

    def spied(fitted, terms, idf, *args, **options):
        seen.update(terms=terms, idf=idf, space=fit(fitted, terms, idf, *args, **options))
        return seen["space"]

    monkeypatch.setattr(decontaminate, "latent_space", spied)
    docs = table(spark, texts, list(range(len(texts)))).repartition(5)
    decontaminate.contaminated(docs, spark.createDataFrame(items, "item_id long, text string"), rank=3, step=step, max_df=1.0, fit_documents=10)
    gram = np.zeros((12, 12))
    for text, weight in [(t, 1.0) for t in texts] + [(t, len(texts) / 10) for _, t in items]:
        coded = (text or "").split()
        chunks = [np.zeros(12) for _ in range(0, max(1, len(coded)), step)]
        for i, w in enumerate(coded):
            k = seen["terms"].of_texts([w])[0]
            chunks[i // step][k] = seen["idf"][k]
        for a, b in zip(chunks, [*chunks[1:], np.zeros(12)], strict=True):
            if length := (a @ a + b @ b):
                gram += weight * np.outer(a + b, a + b) / length
    best = np.linalg.eigh(gram)[1][:, -3:]
    assert np.allclose(seen["space"] @ seen["space"].T, best @ best.T, atol=1e-3)


@pytest.mark.parametrize("block_chars", [1, 100_000])
def test_thresholds_are_those_of_all_items_whatever_the_blocks(spark, block_chars):
    from lumenfold.llm.decontaminate import contaminated

    topics, rare, r = [[f"t{i}x{j}" for j in range(24)] for i in range(3)], [f"r{j}" for j in range(48)], random.Random(7)
    about = [" ".join(r.choices(t, k=60)) for t in topics for _ in range(30)]
    mixed = [" ".join(w for x in rare for w in (x, r.choice(t))) for t in topics]  # three directions keep little of the rare words
    docs = table(spark, about + mixed, [*range(90), 100, 101, 102])
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate([*topics, rare])], "item_id long, text string")
    found = contaminated(docs, bench, rank=3, max_df=1.0, block_chars=block_chars).filter("item_id = 3").collect()
    assert {r["doc_id"] for r in found} == {100, 101, 102}


@pytest.mark.parametrize("seed", range(20))
def test_common_subsequence(seed):
    from lumenfold.llm.decontaminate import common_subsequence, masks_of

    r = random.Random(seed)
    a, b = ([r.randrange(5) for _ in range(r.randrange(1, 70))] for _ in range(2))
    grid = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            grid[i + 1][j + 1] = grid[i][j] + 1 if x == y else max(grid[i][j + 1], grid[i + 1][j])
    assert common_subsequence(masks_of(a), len(a), b) == grid[-1][-1]


# ---------- 8 ----------


def shingles(text, width):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def brute_components(texts, width, percent=80):
    sets, up = [shingles(t, width) for t in texts], list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return [len(s) for s in sets], [find(i) for i in range(len(sets))]


@pytest.mark.parametrize(("width", "chunk", "heaviest"), [(2, 512, 4_000_000), (5, 512, 4_000_000), (2, 8, 4_000_000), (2, 512, 100)])
def test_near_duplicates_as_by_brute_force(spark, width, chunk, heaviest):
    from lumenfold.llm.near_dup import near_duplicates

    def changed(text, n, seed):
        r, w = random.Random(seed), text.split()
        for _ in range(n):
            w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
        return " ".join(w)

    texts = [*TEXTS, *[changed(BASE[0], i % 12, i) for i in range(40)], *[changed(BASE[1], 3, i) for i in range(15)], BASE[3], BASE[3]]
    got = {r["doc_id"]: r for r in near_duplicates(table(spark, texts, list(range(len(texts)))), width=width, chunk=chunk, centres=2, heaviest=heaviest).collect()}
    sizes, roots = brute_components(texts, width)
    assert [got[i]["n_shingles"] for i in range(len(texts))] == sizes
    assert [got[i]["component_id"] for i in range(len(texts))] == roots
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.values())


def test_near_duplicates_of_odd_tables(spark):
    from lumenfold.llm.near_dup import near_duplicates

    rows = near_duplicates(odd_table(spark)).collect()
    assert len(rows) == len(TEXTS) + 2 and [r["component_id"] for r in rows if r["doc_id"] is None] == [None]
    assert near_duplicates(empty(spark)).count() == 0


def test_components_of_paths_and_stars(spark):
    from lumenfold.llm.components import connected_components

    links = [(i, i + 1) for i in range(0, 70)] + [(200, 300 + i) for i in range(30)] + [(5, 5), (None, 1), (301, 200), (900, 901)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(71), 0), 200: 200, **{300 + i: 200 for i in range(30)}, 900: 900, 901: 900}


# ---------- 9 ----------


@pytest.fixture(scope="module")
def pieces():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path(queries.PIECE_TOKENIZER))


def test_counts_at_every_prefix(pieces):
    from lumenfold.llm.token_counts import PrefixCounter

    own = PrefixCounter(queries.tokenizer_path(queries.PIECE_TOKENIZER))
    texts = ["", " ", "  two  spaces ", "\tA\n\nb", "<s> a</s>", "é ﬁ ½ ​ a b", "▁x ▁▁y", "你好世界 𝄞𝄞", "\x00a", "a" * 120, "ab " * 5 + " " * 40 + "x"] + ["".join(random.choice("abcdeth  \n.,'▁é世\t0129ingon") for _ in range(40)) for _ in range(60)]
    for text, got in zip(texts, own.all_counts(texts), strict=True):
        assert got.tolist() == [len(pieces.encode(text[:k])) for k in range(len(text) + 1)], repr(text)


def test_counts_truncation_and_odd_tables(spark, pieces):
    from lumenfold.llm.token_counts import longest_prefix, prefix_token_counts, tokens_at

    model = queries.tokenizer_path(queries.PIECE_TOKENIZER)
    counts = prefix_token_counts(odd_table(spark), model)
    assert Counter((r["n_bytes"], r["n_tokens"]) for r in counts.collect()) == Counter((len((t or "").encode()), len(pieces.encode(t or ""))) for t in [*TEXTS, TEXTS[0], TEXTS[1]])
    for r in longest_prefix(counts.filter("doc_id IS NOT NULL"), 50).collect():
        text = TEXTS[r["doc_id"]] or ""
        k = r["prefix_chars"]
        assert tokens_at(r["prefix_tokens"], k) == len(pieces.encode(text[:k])) <= 50
        assert all(len(pieces.encode(text[:j])) > 50 for j in range(k + 1, min(len(text), k + 12) + 1))
    assert prefix_token_counts(empty(spark), model).count() == 0


# ---------- 10 ----------


def segmentations(word, place, at=0):
    """All ways to cut a word: piece numbers."""
    if at == len(word):
        yield ()
    for end in range(at + 1, len(word) + 1):
        if (k := place.get(word[at:end])) is not None:
            yield from ((k, *rest) for rest in segmentations(word, place, end))


def path_weight(path, w, size):
    return math.prod(math.exp(w[k]) for k in path[:-1]) * math.exp(w[size + path[-1]])


def test_lattice_sums_all_segmentations():
    from lumenfold.llm.lattice_lm import Lattice, first_pieces

    pieces = [b" a", b" ab", b" ", b"b", b"a", b"ab", b"ba", b"bab", b"abababababababababababa"]
    place, size = {p: i for i, p in enumerate(pieces)}, len(pieces)
    weights = np.stack([Lattice.normalised(c, first_pieces(pieces)) for c in (np.arange(1.0, 2 * size + 1), np.arange(2 * size, 0.0, -1))])
    for first in (first_pieces(pieces), ~first_pieces(pieces)):
        assert np.exp(weights[:, np.tile(first, 2)]).sum(1) == pytest.approx([1, 1])
    lattice = Lattice(pieces, weights)
    words = [b"a", b"ab", b"abab", b"babab", b"ab" * 12, b"ba" * 40]
    got = lattice.log_probabilities(words)
    expected, wanted = np.zeros((2, 2 * size)), np.zeros((2, 2 * size))
    lattice.expect(words[:4], np.ones((4, 2), bool), expected)
    for i, word in enumerate(words[:5]):
        paths = list(segmentations(b" " + word, place)) if i < 4 else []
        for c, w in enumerate(weights):
            if paths:
                total = sum(path_weight(p, w, size) for p in paths)
                assert got[i, c] == pytest.approx(math.log(total))
                for p in paths:
                    for j, k in enumerate(p):
                        wanted[c, k + size * (j == len(p) - 1)] += path_weight(p, w, size) / total
            else:
                assert got[i, c] == pytest.approx(lattice._long_sum(b" " + word, c, None))  # with a piece of 23 bytes
    assert expected == pytest.approx(wanted)
    long = np.zeros((2, 2 * size))
    lattice.expect(words[5:], np.ones((1, 2), bool), long)
    sizes = np.tile([len(p) for p in pieces], 2)
    assert long @ sizes == pytest.approx([81, 81]) and long[:, size:].sum(1) == pytest.approx([1, 1])


def brute_scores(texts, langs, model, discount=0.75, shared=0.03):
    """The whole model over, by enumeration: one round of expected counts, then each document's sum over its labels."""
    from lumenfold.llm.lattice_lm import Lattice, _lean, first_pieces, vocabulary_pieces

    pieces = vocabulary_pieces(model)
    place, size, first = {p: i for i, p in enumerate(pieces)}, len(pieces), first_pieces(pieces)
    labels = sorted({x for i, x in enumerate(langs) if x and zlib.crc32(str(i).encode()) % 7 != 2}, key=lambda x: (-sum(x == y and zlib.crc32(str(i).encode()) % 7 != 2 for i, y in enumerate(langs)), x))
    k = len(labels) + 1
    of = lambda i: labels.index(langs[i]) if langs[i] in labels else k - 1
    split = [(t or "").encode().lower().split() for t in texts]
    seen = [Counter() for _ in range(k)]
    for i, words in enumerate(split):
        if zlib.crc32(str(i).encode()) % 7 != 2:
            seen[of(i)].update([*words, None])
    cuts = {w: list(segmentations(b" " + w, place)) for words in split for w in words}
    start = Lattice.start(pieces, k)
    counts = np.zeros((k, 2 * size))
    for c in range(k):
        for w in filter(None, seen[c]):
            total = sum(path_weight(p, start[c], size) for p in cuts[w])
            for p in cuts[w]:
                for j, x in enumerate(p):
                    counts[c, x + size * (j == len(p) - 1)] += path_weight(p, start[c], size) / total
    weights = np.stack([Lattice.normalised(x, first) for x in _lean(counts)])
    n_all = sum(sum(s.values()) for s in seen)

    def probability(w, c):
        n = sum(seen[c].values())
        left = discount * len(seen[c]) / n if n else 1
        spelt = sum(path_weight(p, weights[c], size) for p in cuts[w]) if w else 0
        return max(seen[c][w] - discount, 0) / max(1, n) + left * (shared * max(sum(s[w] for s in seen) - discount, 0) / n_all + (1 - shared) * spelt)

    docs = [s[None] for s in seen]
    out = []
    for words in split:
        logs = [math.log(docs[c] / sum(docs)) + max(math.log(probability(None, c)), -60) + sum(math.log(probability(w, c)) for w in words) for c in range(k) if docs[c]]
        out.append((max(logs) + math.log(sum(math.exp(x - max(logs)) for x in logs))) / math.log(10))
    return out


def test_scores_as_by_enumeration(spark):
    from lumenfold.llm.lattice_lm import score_documents

    r = random.Random(2)
    word = lambda s: "".join(r.choice(s) for _ in range(r.randrange(1, 4)))
    langs = [r.choice(["xx", "yy", None]) for _ in range(40)]
    texts = [" ".join(word(["th", "er", "on", "Ä", "!"] if x == "xx" else ["la", "qu", "en", "zz"]) for _ in range(r.randrange(0, 12))) for x in langs] + [None, "er" * 8]
    langs += ["zz", None]
    model = queries.tokenizer_path(queries.PIECE_TOKENIZER)
    got = {x["doc_id"]: x["score"] for x in score_documents(table(spark, texts, list(range(42)), langs), fold("doc_id", 7) != 2, model, rounds=1, block_bytes=200).collect()}
    assert [got[i] for i in range(42)] == pytest.approx(brute_scores(texts, langs, model), rel=1e-5, abs=1e-5)


def test_scores(spark):
    from lumenfold.llm.lattice_lm import score_documents

    model = queries.tokenizer_path(queries.PIECE_TOKENIZER)
    texts = [*TEXTS, *[prose(100, 500 + i) for i in range(80)]]
    docs = table(spark, texts, list(range(len(texts))))
    rows = {r["doc_id"]: r for r in score_documents(docs, fold("doc_id", 7) != 2, model, block_bytes=20_000).collect()}
    counts = Counter()
    for i, t in enumerate(texts):
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update([*(t or "").encode().lower().split(), b"\n"])
    n, v = sum(counts.values()), len(counts)
    for i, t in enumerate(texts):
        own = [*(t or "").encode().lower().split(), b"\n"]
        r = rows[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(counts[w] > 0 for w in own), n) and r["held_out"] == (zlib.crc32(str(i).encode()) % 7 == 2)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own))
        assert -math.inf < r["score"] <= 0
    held = [r for r in rows.values() if r["held_out"] and r["n_known"] == r["n_tokens"]]
    # words drawn evenly from a closed list, where the base has the truth: what is held back for new words may cost a little
    assert held and sum(r["score"] for r in held) > sum(r["base_score"] for r in held) - 0.05 * sum(r["n_tokens"] for r in held)
    odd = score_documents(odd_table(spark), fold("doc_id", 7) != 2, model).collect()
    assert len(odd) == len(TEXTS) + 2
    assert score_documents(empty(spark), fold("doc_id", 7) != 2, model).count() == 0
    none = score_documents(docs, F.lit(False), model, label_col=None).collect()
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 and math.isfinite(r["score"]) for r in none)


def test_words_probabilities_sum_below_one():
    """One-word texts over a small alphabet: their probabilities are those of different texts, so they can't pass one."""
    from lumenfold.llm.lattice_lm import Lattice, first_pieces, vocabulary_pieces

    pieces = vocabulary_pieces(queries.tokenizer_path(queries.PIECE_TOKENIZER))
    lattice = Lattice(pieces, Lattice.start(pieces, 1))
    words = [bytes([a]) for a in range(33, 127)] + [bytes([a, b]) for a in range(97, 123) for b in range(97, 123)]
    assert np.exp(lattice.log_probabilities(words)).sum() < 1
    assert len(first_pieces(pieces)) == len(pieces) and max(map(len, pieces)) > 16

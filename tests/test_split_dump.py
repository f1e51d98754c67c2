"""Dumps read by many tasks give the rows that one pass gives, wherever the shares begin."""

import random

import pytest
from test_posts_and_ingest import DUMP

from lumenfold.sources.mysqldump import BETWEEN, OUTSIDE, DumpError, Lexer, block_starts, dump_lines, parse, read_dump

ODD = """-- it's a comment with an apostrophe (
/*!40101 SET NAMES 'utf8' */;
CREATE TABLE `t` (`a` int, `b` text COMMENT 'x;(y');
INSERT INTO `t` (`a`, `b`) VALUES (1,'one line'),(2,'two
lines, with (parens); and ''quotes'' and \\\\'),(3,'a \\' b
INSERT INTO `u` (`x`) VALUES (9);
still three'),
(4,
 NULL),(5,'');
INSERT INTO `u` (`x`, `y`, `z`) VALUES
(1.5, -2, 'é🙂 \\n \\Z'),(NULL,0x1F,')');
INSERT INTO `t` (`a`, `b`) VALUES (6,'tail''');
"""


def ordered(df):
    return [(r["table"], r["row"]) for r in df.orderBy("seq").collect()]


def test_every_edge_of_lines():
    """Cut before any line, each piece read from the state the part before leaves it in."""
    lines = [x + b"\n" for x in ODD.encode().split(b"\n")]
    want = list(parse(ODD.encode()))
    for cut in range(len(lines) + 1):
        lexer, got = Lexer(OUTSIDE), []
        for part in (lines[:cut], lines[cut:]):
            if part is not lines[:cut] or cut == 0:
                before, lexer = lexer, Lexer(lexer.state, lexer.head)
                lexer.held = before.held
            for line in part:
                got += [(h[0], raw) for h, raw in lexer.feed(line)]
        assert [t for t, _ in got] == [t for t, _ in want] and lexer.state == OUTSIDE


@pytest.mark.parametrize(("text", "size"), [(ODD, 1), (DUMP, 1), (ODD, 100_000), ("", 1)])
def test_one_file_over_many_tasks(spark, tmp_path, size, text):
    (tmp_path / "d.sql").write_text(text, encoding="utf-8")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", max(size, len(text) // 25))
        spark.conf.set("spark.sql.files.openCostInBytes", 1)
        path = f"file://{tmp_path}/d.sql"
        assert ordered(read_dump(spark, path)) == list(parse(text.encode()))
        assert ordered(read_dump(spark, path, ["t", "keywords"])) == list(parse(text.encode(), {"t", "keywords"}))
        if text and size == 1:
            assert dump_lines(spark, path).select("block").distinct().count() > 8
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_a_large_file_and_several_files(spark, tmp_path):
    r = random.Random(1)
    folder = tmp_path / "dumps"
    folder.mkdir()
    for name in "ab":
        rows = [f"({i},'{'x' * r.randrange(60)}{r.choice(['', chr(10), '(', ');', chr(39) * 2])}{name}')" for i in range(3000)]
        text = "".join(f"INSERT INTO `t` (`a`, `b`) VALUES {r.choice([',', ',' + chr(10)]).join(rows[i : i + 50])};\n" for i in range(0, 3000, 50))
        (folder / f"{name}.sql").write_text(text, encoding="utf-8")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", 20_000)
        got = read_dump(spark, f"file://{folder}/*.sql")
        want = [x for name in "ab" for _, x in parse((folder / f"{name}.sql").read_bytes())]
        key = lambda rows: sorted((r["b"][-1:], int(r["a"]), r["b"]) for r in rows)
        assert key(r["row"] for r in got.collect()) == key(want)
        assert block_starts(dump_lines(spark, f"file://{folder}/*.sql")).filter(f"state <> {OUTSIDE} AND state <> {BETWEEN}").count() > 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_what_can_not_be_read(spark, tmp_path):
    for text in ("INSERT INTO `t` (`a`) VALUES (1) oops (2);", "INSERT INTO `t` (`a`,\n`b`) VALUES (1,2);", "INSERT INTO `t` (`a`) VALUES (1,2);"):
        (tmp_path / "d.sql").write_text(text, encoding="utf-8")
        with pytest.raises(Exception, match="can't be read|one line|DumpError|values for"):
            read_dump(spark, f"file://{tmp_path}/d.sql").collect()
    with pytest.raises(DumpError):
        list(Lexer(BETWEEN, ("t", ["a"])).feed(b"x\n"))

"""Rows of a MySQL dump as a Spark data source.

``spark.read.format("mysqldump").option("path", p).option("tables", "a,b").load()`` gives table, row (column -> text, null
for NULL) and seq (the row's place among all rows of its file). There a file is one task, mapped and not loaded; rows leave
one by one, so memory is bounded by a row. ``read_dump`` reads through Spark's own file reader, from any store, and deals one
file over many tasks. Statements of other tables are passed over without keeping a value. Numbers keep their text; casts
belong to the reader of the rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.scratch import written

SCHEMA = "table string, row map<string,string>, seq long"

#: What an INSERT begins with, and what follows a backslash.
HEAD = re.compile(rb"INSERT INTO `(\w+)` \(([^)]*)\) VALUES\s*", re.DOTALL)
ESCAPES = {"0": "\0", "b": "\b", "n": "\n", "r": "\r", "t": "\t", "Z": "\x1a"}

_QUOTED = rb"'[^'\\]*(?:(?:\\.|'')[^'\\]*)*'"
_VALUE = re.compile(rb"\s*(?:(" + _QUOTED + rb")|([^,()';]*))\s*([,)])", re.DOTALL)
_OPEN = re.compile(rb"[\s,]*(?:(\()|(;))")
_UNESCAPE = re.compile(r"\\(.)|''", re.DOTALL)


class DumpError(ValueError):
    """A statement that can't be read."""


def _unquoted(raw: bytes) -> str:
    text = raw[1:-1].decode("utf-8", "replace")
    return _UNESCAPE.sub(lambda m: "'" if m[1] is None else ESCAPES.get(m[1], m[1]), text) if "\\" in text or "''" in text else text


def statement_rows(data: bytes, at: int) -> Iterator[tuple[list[str | None] | None, int]]:
    """Rows of a VALUES list that begins at a place, each with the place behind it; last, None with the statement's end."""
    while True:
        opened = _OPEN.match(data, at)
        if not opened:
            raise DumpError(f"neither a row nor an end at byte {at}")
        at = opened.end()
        if opened[2]:
            yield None, at
            return
        row: list[str | None] = []
        while True:
            value = _VALUE.match(data, at)
            if not value:
                raise DumpError(f"no value at byte {at}")
            at = value.end()
            bare = None if value[1] is not None else value[2].strip().decode("utf-8", "replace")
            row.append(_unquoted(value[1]) if value[1] is not None else None if bare.upper() == "NULL" else bare)
            if value[3] == b")":
                break
        yield row, at


def numbered_rows(data, tables: set[str] | None = None) -> Iterator[tuple[int, str, dict[str, str | None]]]:
    """(place among all rows, table, row) for the rows of the INSERT statements in bytes or a mapped file."""
    at, seq = 0, -1
    while head := HEAD.search(data, at):
        table = head[1].decode()
        columns = [c.strip().strip("`") for c in head[2].decode("utf-8", "replace").split(",")]
        at = head.end()
        for row, behind in statement_rows(data, at):
            at = behind
            if row is None:
                continue
            seq += 1
            if tables is not None and table not in tables:
                continue
            if len(row) != len(columns):
                raise DumpError(f"{table}: {len(row)} values for {len(columns)} columns")
            yield seq, table, dict(zip(columns, row, strict=True))


def parse(data, tables: set[str] | None = None) -> Iterator[tuple[str, dict[str, str | None]]]:
    """(table, row) for every row of the INSERT statements in bytes or a mapped file."""
    return ((table, row) for _, table, row in numbered_rows(data, tables))


# ---------- one file over many tasks ----------

#: Where a line can begin: outside of INSERT statements, in one between its rows, in a row, in a quoted value of a row.
OUTSIDE, BETWEEN, ROW, QUOTED = range(4)
_STARTED = re.compile(rb"INSERT INTO `")
_GAP = re.compile(rb"[\s,]*")
_TO_ROW_END = re.compile(rb"[^')]*")
_IN_QUOTES = re.compile(rb"[^'\\]*(?:(?:\\.|'')[^'\\]*)*", re.DOTALL)


class Lexer:
    """Reads a dump line by line from any state. ``rows`` counts the row ends it has passed, ``head`` is the last statement
    head (table, columns) it saw, ``held`` the bytes of a row that has begun."""

    def __init__(self, state: int, head: tuple[str, list[str]] | None = None, keep: bool = True):
        self.state, self.head, self.keep, self.rows, self.held = state, head, keep, 0, bytearray()

    def feed(self, line: bytes) -> Iterator[tuple[tuple[str, list[str]] | None, bytes]]:
        """The rows that end in a line (with its line end): their head, and their bytes without the outer parentheses."""
        at, size = 0, len(line)
        while at < size:
            if self.state == OUTSIDE:
                found = HEAD.search(line, at)
                if not found:
                    if _STARTED.search(line, at):
                        raise DumpError("the head of an INSERT statement has to stand on one line")
                    return
                self.head = found[1].decode(), [c.strip().strip("`") for c in found[2].decode("utf-8", "replace").split(",")]
                self.state, at = BETWEEN, found.end()
            elif self.state == BETWEEN:
                at = _GAP.match(line, at).end()
                if at < size:
                    if line[at : at + 1] not in (b"(", b";"):
                        raise DumpError(f"neither a row nor an end: {line[at : at + 40]!r}")
                    self.state = ROW if line[at : at + 1] == b"(" else OUTSIDE
                    at += 1
            else:
                end = (_TO_ROW_END if self.state == ROW else _IN_QUOTES).match(line, at).end()
                closed = line[end : end + 1]
                done = self.state == ROW and closed == b")"
                if self.keep:
                    self.held += line[at:end] if done else line[at : end + 1]
                at = end + 1
                if done:
                    self.rows += 1
                    yield self.head, bytes(self.held)
                    self.held.clear()
                    self.state = BETWEEN
                elif closed:
                    self.state = QUOTED if self.state == ROW else ROW


def _map_blocks(batches, begin, end):
    """Runs over lines (file, block, line as bytes) in order: ``begin`` gives what takes the lines of a block, ``end`` its
    rows."""
    now, taker = None, None
    for batch in batches:
        for file, block, line in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
            if (file, block) != now:
                if now is not None:
                    yield from end(now, taker)
                now, taker = (file, block), begin((file, block))
            yield from taker(line + b"\n")
    if now is not None:
        yield from end(now, taker)


def _row(table: str, columns: list[str], raw: bytes) -> dict[str, str | None]:
    values, _ = next(statement_rows(b"(" + raw + b");", 0))
    if len(values) != len(columns):
        raise DumpError(f"{table}: {len(values)} values for {len(columns)} columns")
    return dict(zip(columns, values, strict=True))


def dump_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of dump files as file, block (the place in bytes where a task's share begins) and line, through Spark's own
    reader, so any store will do and a large file is dealt over many tasks."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("line"))


def block_starts(lines: DataFrame) -> DataFrame:
    """``file``, ``block``, ``state``, ``head`` (table, columns) and ``rows`` (that end before it) at the start of each block.

    Only what stands before a block tells whether it begins inside quotes. So each block is read from all four states it can
    begin in; from each it ends in some state, with some rows and perhaps a statement head. Such steps compose, and a running
    composition over a file's blocks (one row each) gives every block's start. Lexers that meet go on as one."""

    def summed(batches):
        import pyarrow as pa

        def begin(_):
            lexers = {s: Lexer(s, keep=False) for s in range(4)}
            broken: set[int] = set()
            same = {s: (s, 0) for s in range(4)}  # the lexer that stands for each start, and how many rows it lacks
            running, lines_ = [0, 1, 2, 3], 0

            def take(line):
                nonlocal running, lines_
                for s in running:
                    try:
                        for _ in lexers[s].feed(line):
                            pass
                    except DumpError:
                        broken.add(s)
                        running = [r for r in running if r != s]
                lines_ += 1
                if len(running) < 2 or lines_ & lines_ - 1 and lines_ % 64:
                    return ()
                # whether lexers have met: asked now and then, as it costs more than a line does
                leads: dict[tuple, int] = {}
                for s, (at, lack) in same.items():
                    x = lexers[at]
                    lead = leads.setdefault((x.state, str(x.head), at in broken), at)
                    same[s] = (lead, lack + x.rows - lexers[lead].rows)
                running = sorted({at for at, _ in same.values()} - broken)
                return ()

            take.result = lambda: [(s, lexers[at].state, lexers[at].rows + lack, lexers[at].head, at in broken) for s, (at, lack) in same.items()]
            return take

        def end(now, take):
            for s, state, rows, head, bad in take.result():
                yield {"file": now[0], "block": now[1], "from": s, "to": -1 if bad else state, "rows": rows, "head": None if head is None else {"table": head[0], "columns": head[1]}}

        schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("from", pa.int32()), ("to", pa.int32()), ("rows", pa.int64()), ("head", pa.struct([("table", pa.string()), ("columns", pa.list_(pa.string()))]))])
        found = list(_map_blocks(batches, begin, end))
        yield pa.RecordBatch.from_pylist(found, schema)

    head = "head struct<table:string,columns:array<string>>"
    steps = lines.mapInArrow(summed, f"file string, block long, `from` int, `to` int, rows long, {head}")
    whole = steps.groupBy("file", "block").agg(F.sort_array(F.collect_list(F.struct("from", "to", "rows", "head"))).alias("steps"))
    state = f"struct<block:long,state:int,rows:long,{head.replace(' ', ':', 1)}>"
    first = F.struct(F.lit(None).cast("long").alias("block"), F.lit(OUTSIDE).alias("state"), F.lit(0).cast("long").alias("rows"), F.lit(None).cast(head.split(" ", 1)[1]).alias("head"))
    begun = F.struct(first.cast(state).alias("now"), F.array().cast(f"array<{state}>").alias("out"))

    def compose(s, block):
        now = s["now"]
        step = F.element_at(block["steps"], now["state"] + 1)
        here = F.struct(block["block"].alias("block"), now["state"].alias("state"), now["rows"].alias("rows"), now["head"].alias("head"))
        after = F.struct(block["block"].alias("block"), F.when(step["to"] < 0, F.raise_error(F.lit("a statement of the dump can't be read"))).otherwise(step["to"]).cast("int").alias("state"), (now["rows"] + step["rows"]).alias("rows"), F.coalesce(step["head"], now["head"]).alias("head"))
        return F.struct(after.cast(state).alias("now"), F.array_append(s["out"], here.cast(state)).alias("out"))

    blocks = whole.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("block", "steps"))).alias("blocks"))
    return blocks.select("file", F.explode(F.aggregate("blocks", begun, compose)["out"]).alias("b")).select("file", "b.*")


def read_dump(spark: SparkSession, path: str, tables: list[str] | None = None, batch_rows: int = 2000) -> DataFrame:
    """The dump's rows: table, row, seq (the row's place in its file, of all its rows). A file is dealt over many tasks by
    lines; three passes read it, one for how each task's share begins (``block_starts``), one for the rows inside of shares, one
    for the pieces of rows over their edges. A row over the edge
    of two shares or more is put together from its pieces. Rows of other tables are passed over without keeping a value.
    Memory is bounded by ``batch_rows`` rows and by the longest line; the head of a statement has to stand on one line."""
    wanted = set(tables) if tables else None
    lines = dump_lines(spark, path)
    starts = written(block_starts(lines), "dump-starts")
    # one row a share of a file: bounded by the file's bytes over spark.sql.files.maxPartitionBytes
    known = {(r["file"], r["block"]): (r["state"], (r["head"]["table"], r["head"]["columns"]) if r["head"] else None, r["rows"]) for r in starts.toLocalIterator()}

    def rows(batches, edges):
        """The rows inside of shares, or (``edges``) the pieces of those over their edges: no row is parsed for these."""
        import pyarrow as pa

        schema = pa.schema([("table", pa.string()), ("row", pa.map_(pa.string(), pa.string())), ("seq", pa.int64()), ("file", pa.string()), ("block", pa.int64()), ("piece", pa.binary()), ("columns", pa.list_(pa.string()))])
        out: list[tuple] = []

        def passed():
            made = pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema) if out else pa.RecordBatch.from_pylist([], schema)
            out.clear()
            return made

        def begin(now):
            state, head, before = known[now]
            lexer = Lexer(state, head)
            cut = state in (ROW, QUOTED)  # the first row's beginning lies in an earlier block

            def take(line):
                nonlocal cut
                for at, raw in lexer.feed(line):
                    seq = before + lexer.rows - 1
                    if edges == cut and (wanted is None or at[0] in wanted):
                        yield (at[0], None, seq, *now, raw, at[1]) if cut else (at[0], list(_row(*at, raw).items()), seq, *now, None, None)
                    cut = False

            take.lexer, take.seq = lexer, lambda: before + lexer.rows
            return take

        def end(now, take):
            if edges and take.lexer.state in (ROW, QUOTED) and take.lexer.head and (wanted is None or take.lexer.head[0] in wanted):
                yield (take.lexer.head[0], None, take.seq(), *now, bytes(take.lexer.held), take.lexer.head[1])

        for found in _map_blocks(batches, begin, end):
            out.append(found)
            if len(out) >= batch_rows:
                yield passed()
        yield passed()

    schema_ = f"{SCHEMA}, file string, block long, piece binary, columns array<string>"
    inside, over = (lines.mapInArrow(partial(rows, edges=edges), schema_) for edges in (False, True))
    pieces = over.groupBy("file", "seq").agg(F.first("table").alias("table"), F.first("columns").alias("columns"), F.sort_array(F.collect_list(F.struct("block", "piece"))).alias("pieces"))

    def joined(batches):
        import pyarrow as pa

        for batch in batches:
            table, columns, pieces_, seq = (batch.column(i).to_pylist() for i in range(4))
            made = [list(_row(t, c, b"".join(x["piece"] for x in p)).items()) for t, c, p in zip(table, columns, pieces_, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.map_(pa.string(), pa.string())), batch.column(3)], ["table", "row", "seq"])

    edges = pieces.select("table", "columns", "pieces", "seq").mapInArrow(joined, SCHEMA)
    return inside.select("table", "row", "seq").unionByName(edges)


def register(spark: SparkSession) -> None:
    """Registers the format "mysqldump" for files that the executors can open by path."""
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    class Dump(InputPartition):
        def __init__(self, path: str):
            self.path = path

    class Reader(DataSourceReader):
        def __init__(self, options: dict):
            self.path, self.tables = options["path"], options.get("tables")

        def partitions(self):
            import glob

            return [Dump(p) for p in sorted(glob.glob(self.path))]

        def read(self, part):
            import mmap
            import os

            if not os.path.getsize(part.path):
                return
            with open(part.path, "rb") as f, mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as data:
                for seq, table, row in numbered_rows(data, set(self.tables.split(",")) if self.tables else None):
                    yield table, row, seq

    class MysqlDump(DataSource):
        @classmethod
        def name(cls):
            return "mysqldump"

        def schema(self):
            return SCHEMA

        def reader(self, schema):
            return Reader(dict(self.options))

    spark.dataSource.register(MysqlDump)


def one_table(dump: DataFrame, table: str, columns: list[str]) -> DataFrame:
    """A table's rows as text columns; columns the dump lacks are null."""
    return dump.filter(F.col("table") == table).select(*[F.col("row").getItem(c).alias(c) for c in columns])

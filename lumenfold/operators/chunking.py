"""Chunks of pages: recursive splitting by separators, measured in tokens, with an overlap."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import deque
from collections.abc import Callable, Iterator
from itertools import pairwise

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions.dates import chunk_dates, date_spans
from lumenfold.functions.text import chunk_id, detect_language, plain_token_count, plain_token_starts, token_count

#: Separators in the order they are tried; they stay at the end of the piece before (a bullet begins one).
SEPARATORS = (r"\n\n", r"\n", r"।\s*", r"(?=[⏩•▪➤►])", r"\.\s", r"\?\s", r"!\s", r";\s", r",\s", r"\s", "")


_PATTERNS = [re.compile(s) for s in SEPARATORS]


def _cut(text: str, a: int, b: int, level: int) -> Iterator[tuple[int, int]]:
    ends = [m.end() for m in _PATTERNS[level].finditer(text, a, b)]
    edges = [a, *(e for e in ends if a < e < b), b]
    return ((lo, hi) for lo, hi in pairwise(edges) if lo < hi)


def _pieces(text: str, a: int, b: int, level: int, most: int, between: Callable[[int, int], int], count: Callable[[str], int]) -> Iterator[tuple[int, int, int]]:
    """text[a:b] in pieces of at most ``most`` tokens, by the first separator that does, each further one inside: their
    places and tokens. ``between`` gives the tokens between places that no token stands over."""
    n = between(a, b)
    if n <= most:
        yield a, b, n
        return
    while level < len(SEPARATORS) - 1 and not _PATTERNS[level].search(text, a, b):
        level += 1
    if not SEPARATORS[level]:  # signs, which may lie inside a token
        yield from ((i, i + 1, count(text[i])) for i in range(a, b))
        return
    for lo, hi in _cut(text, a, b, level):
        yield from _pieces(text, lo, hi, level + 1, most, between, count)


def split_text(text: str, most: int = 512, overlap: int = 50, count: Callable[[str], int] = plain_token_count) -> list[str]:
    """Chunks of at most ``most`` tokens; each begins with the last pieces, up to ``overlap`` tokens, of the one before.

    Separators end or begin tokens, so with the own count a text's tokens are found once and counted by their places."""
    if count is plain_token_count:
        starts = plain_token_starts(text)
        between = lambda a, b: bisect_left(starts, b) - bisect_left(starts, a)
    else:
        between = lambda a, b: count(text[a:b])
    out: list[str] = []
    held: deque[tuple[int, int, int]] = deque()
    total = 0
    for piece in _pieces(text, 0, len(text), 0, most, between, count):
        n = piece[2]
        if held and total + n > most:
            out.append(text[held[0][0] : held[-1][1]].strip())
            while held and (total > overlap or total + n > most):
                total -= held.popleft()[2]
        held.append(piece)
        total += n
    if held:
        out.append(text[held[0][0] : held[-1][1]].strip())
    return [c for c in out if c]


def chunk_pages(pages: DataFrame, most: int = 512, overlap: int = 50) -> DataFrame:
    """Chunks with ids that depend on document, number and text alone. Numbers run through a document's pages in order."""

    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_text(t or "", most, overlap))

    by_page = pages.withColumn("parts", split("text"))
    # one branch, so that the splitter runs once; equal places of a document go by their texts
    order = [F.coalesce("page", F.lit(0)), F.coalesce("section", F.lit("")), F.xxhash64("text")]
    before = Window.partitionBy("doc_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    numbered = by_page.withColumn("first", F.coalesce(F.sum(F.size("parts")).over(before), F.lit(0)))
    rows = numbered.select(*[c for c in pages.columns if c != "text"], "first", F.posexplode("parts").alias("pos", "text")).withColumn("chunk_index", (F.col("first") + F.col("pos")).cast("int"))
    dated = rows.withColumn("spans", date_spans(F.col("text")))
    return dated.select(chunk_id(F.col("doc_id"), F.col("chunk_index"), F.col("text")).alias("chunk_id"), *[c for c in pages.columns if c != "text"], "chunk_index", "text", token_count(F.col("text")).alias("token_count"), detect_language(F.col("text")).alias("language"), *chunk_dates(F.col("spans")))

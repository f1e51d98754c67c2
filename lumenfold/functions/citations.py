"""Checks of citations in answers: ids that the evidence lacks go, uncited sentences are listed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A group of citations, one id, a marker, the end of a sentence, and the shortest sentence that is a claim.
GROUP = r"\[\s*[CG]\d+(?:\s*[,;]\s*[CG]\d+)*\s*\]"
ID = r"[CG]\d+"
MARKER = r"\[[CG]\d+\]"
SENTENCE_END = r"(?<=[.!?।])\s+|\n+"
LEAST_SENTENCE = 25


def once(value: Column, use) -> Column:
    """``use`` of a value that is worked out one time, however often it is looked at."""
    return F.element_at(F.transform(F.array(value), use), 1)


def groups(answer: Column) -> Column:
    """The ids of each citation group, in order."""
    found = F.regexp_extract_all(answer, F.lit(f"({GROUP})"), F.lit(1))
    return F.transform(found, lambda g: F.regexp_extract_all(g, F.lit(f"({ID})"), F.lit(1)))


def _spelt(answer: Column, kept: Column) -> Column:
    """The answer with each group spelt as single markers of the ids that are kept of it."""
    marks = F.transform(kept, lambda ids: F.array_join(F.transform(ids, lambda c: F.concat(F.lit("["), c, F.lit("]"))), ""))
    joined = once(marks, lambda m: F.array_join(F.transform(F.split(answer, GROUP, -1), lambda part, i: F.concat(part, F.coalesce(F.get(m, i), F.lit("")))), ""))
    return F.trim(F.regexp_replace(joined, "[ \\t]+([.,;:!?।])", "$1"))


def checked(answer: Column, known: Column) -> Column:
    """A struct of the answer with known citations alone, the ids it uses, those that the evidence lacks, and its sentences
    without a citation. The citation groups are found once for all four."""

    def told(found: Column) -> Column:
        kept = F.transform(found, lambda ids: F.filter(ids, lambda c: F.array_contains(known, c)))
        return F.struct(kept.alias("kept"), F.array_except(F.flatten(found), known).alias("invalid"))

    def parts(x: Column) -> Column:
        return F.struct(_spelt(answer, x["kept"]).alias("answer"), F.array_distinct(F.flatten(x["kept"])).alias("used"), x["invalid"].alias("invalid"))

    whole = lambda x: F.struct(x["answer"].alias("answer"), x["used"].alias("used"), x["invalid"].alias("invalid"), uncited(x["answer"]).alias("uncited"))
    return once(once(once(groups(answer), told), parts), whole)


def invalid(answer: Column, known: Column) -> Column:
    return F.array_except(F.flatten(groups(answer)), known)


def used(answer: Column, known: Column) -> Column:
    return F.array_distinct(F.filter(F.flatten(groups(answer)), lambda c: F.array_contains(known, c)))


def cleaned(answer: Column, known: Column) -> Column:
    """The answer with each group spelt as single markers of known ids."""
    return _spelt(answer, F.transform(groups(answer), lambda ids: F.filter(ids, lambda c: F.array_contains(known, c))))


def uncited(clean: Column) -> Column:
    """Sentences of a cleaned answer that state something without a citation. One written behind the full stop belongs to
    the sentence before it; headings and labels state nothing."""
    moved = F.regexp_replace(clean, f"([.!?।])\\s*((?:{MARKER})+)", " $2$1")
    sentences = F.transform(F.split(moved, SENTENCE_END), lambda s: F.trim(s))
    bare = lambda s: F.btrim(s, F.lit("*_#>- "))
    return F.filter(sentences, lambda s: (F.length(s) >= LEAST_SENTENCE) & ~s.rlike(MARKER) & ~F.endswith(bare(s), F.lit(":")) & ~F.startswith(s, F.lit("#")))

"""Documents from files: dispatch by suffix, decoding, Markdown sections, and the interfaces for page images."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenfold.functions.text import doc_id

#: Kinds by suffix, upload limits, first bytes, and font-name parts of Hindi fonts without Unicode text.
KINDS = {".pdf": "pdf", ".md": "md", ".markdown": "md", ".txt": "txt"}
MOST_BYTES = 50 * 1024 * 1024
MOST_DUMP_BYTES = 300 * 1024 * 1024
PDF_HEAD = b"%PDF-"
LEGACY_FONTS = (
    "kruti", "devlys", "chanakya", "shusha", "susha", "aps-dv", "akruti", "shree-dev", "shree_dev", "agra", "walkman", "kundli", "marathi-saral", "shivaji", "amar ujala", "aman", "naidunia",
)


def kind_of(name: Column) -> Column:
    """pdf, md or txt by a file name's suffix; anything else is an error."""
    suffix = F.lower(F.regexp_extract(name, "(\\.[^./]+)$", 1))
    found = F.lit(None).cast("string")
    for s, kind in KINDS.items():
        found = F.when(suffix == s, kind).otherwise(found)
    return F.coalesce(found, F.raise_error(F.concat(F.lit("unsupported file: "), name)).cast("string"))


def decoded(content: Column) -> Column:
    """UTF-8 without its mark, or Latin-1 where it isn't UTF-8."""
    text = F.when(F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8")).otherwise(F.decode(content, "ISO-8859-1"))
    return F.regexp_replace(text, "^﻿", "")


def problems(files: DataFrame) -> DataFrame:
    """What is wrong with each upload (path, content): empty, too large, no PDF inside; rows without a problem are absent."""
    size = F.octet_length("content")
    pdf = F.lower("path").endswith(".pdf")
    why = F.when(size == 0, "empty").when(size > F.when(F.lower("path").endswith(".sql"), MOST_DUMP_BYTES).otherwise(MOST_BYTES), "too large").when(pdf & ~F.startswith("content", F.lit(PDF_HEAD)), "not a PDF")
    return files.select("path", why.alias("problem")).filter("problem IS NOT NULL")


def load_files(spark: SparkSession, path: str, pages_of: Callable[[bytes], list[str]] | None = None) -> DataFrame:
    """Pages of all files under a path: doc_id, source, doc_type, text, page, section, extraction_method.

    Markdown comes by sections, text as one page, PDF by whatever ``pages_of`` makes of its bytes (no reader is built in).
    Empty pages give no rows."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    named = files.withColumn("source", F.element_at(F.split("path", "/"), -1)).withColumn("doc_type", kind_of(F.col("source"))).withColumn("doc_id", doc_id(F.col("content")))
    base = ["doc_id", "source", "doc_type"]
    plain = named.filter("doc_type = 'txt'").select(*base, decoded(F.col("content")).alias("text"), F.lit(None).cast("int").alias("page"), F.lit(None).cast("string").alias("section"))
    marked = markdown_sections(named.filter("doc_type = 'md'").select(*base, decoded(F.col("content")).alias("text")))
    out = plain.unionByName(marked.withColumn("page", F.lit(None).cast("int")))
    if pages_of is not None:
        out = out.unionByName(pdf_pages(named.filter("doc_type = 'pdf'").select(*base, "content"), pages_of).withColumn("section", F.lit(None).cast("string")))
    return out.withColumn("extraction_method", F.lit("text")).filter(F.trim("text") != "")


def markdown_sections(files: DataFrame) -> DataFrame:
    """Sections of Markdown texts: a heading of up to three # begins one, named by its path ``h1 > h2 > h3``; headings stay
    in the text, and empty sections go. The columns besides text are kept."""
    keys = [c for c in files.columns if c != "text"]
    lines = files.select(*keys, F.posexplode(F.split("text", "\r?\n")).alias("pos", "line"))
    level = F.length(F.regexp_extract("line", "^(#{1,3})\\s+\\S", 1))
    title = F.trim(F.regexp_replace("line", "^#+\\s+|\\s+#*\\s*$", ""))
    lines = lines.withColumn("fence", F.col("line").rlike("^\\s*```").cast("int"))
    run = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lines = lines.withColumn("fenced", F.sum("fence").over(run) % 2 == 1)
    lines = lines.withColumn("level", F.when(~F.col("fenced"), level).otherwise(0)).withColumn("title", F.when(F.col("level") > 0, title))
    lines = lines.withColumn("part", F.sum(F.when(F.col("level") > 0, 1).otherwise(0)).over(run))
    # the last heading of each level counts unless a higher one came after it
    at = lambda n: F.max(F.when(F.col("level") == n, F.col("pos"))).over(run)
    name = lambda n: F.last(F.when(F.col("level") == n, F.col("title")), ignorenulls=True).over(run)
    for n in (1, 2, 3):
        lines = lines.withColumn(f"at{n}", at(n)).withColumn(f"h{n}", name(n))
    none = F.lit(-1)
    h2 = F.when(F.coalesce("at2", none) > F.coalesce("at1", none), F.col("h2"))
    h3 = F.when(F.coalesce("at3", none) > F.greatest(F.coalesce("at1", none), F.coalesce("at2", none)), F.col("h3"))
    lines = lines.withColumn("section", F.concat_ws(" > ", "h1", h2, h3))
    text = F.trim(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n"))
    body = F.max(F.when((F.col("level") == 0) & (F.trim("line") != ""), 1).otherwise(0))
    parts = lines.groupBy(*keys, "part").agg(text.alias("text"), F.max("section").alias("section"), body.alias("body")).filter("body = 1")
    return parts.select(*keys, "text", F.nullif("section", F.lit("")).alias("section"))


def pdf_pages(files: DataFrame, pages_of: Callable[[bytes], list[str]]) -> DataFrame:
    """Pages, numbered from 1, as a given reader extracts them."""
    import pandas as pd

    def read(batches):
        for part in batches:
            rows = [(r.doc_id, r.source, r.doc_type, t, i) for r in part.itertuples() for i, t in enumerate(pages_of(bytes(r.content)), 1)]
            yield pd.DataFrame(rows, columns=["doc_id", "source", "doc_type", "text", "page"])

    return files.mapInPandas(read, "doc_id string, source string, doc_type string, text string, page int")


def routed(pages: DataFrame, least_chars: int = 50) -> DataFrame:
    """Adds ``route``: text, or ocr for pages with little text or with a legacy Hindi font (fonts: array of names)."""
    legacy = F.exists("fonts", lambda f: F.lower(f).rlike("|".join(LEGACY_FONTS)))
    short = F.length(F.trim(F.coalesce("text", F.lit("")))) < least_chars
    return pages.withColumn("route", F.when(short | F.coalesce(legacy, F.lit(False)), "ocr").otherwise("text"))


def ocr_lines(words: DataFrame, least_confidence: float = 60.0) -> DataFrame:
    """Text and mean confidence of pages from recognised words (page, block, par, line, pos, word, conf)."""
    sure = words.filter((F.col("conf") >= least_confidence) & (F.trim("word") != ""))
    joined = lambda c, *by: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*by, c))), lambda x: x[c]), " " if c == "word" else "\n")
    lines = sure.groupBy("page", "block", "par", "line").agg(joined("word", "pos").alias("text"), F.sum("conf").alias("conf"), F.count("*").alias("n"))
    return lines.groupBy("page").agg(joined("text", "block", "par", "line").alias("text"), F.round(F.sum("conf") / F.sum("n"), 1).alias("confidence"))


def distinct_images(images: DataFrame, least_px: int = 100) -> DataFrame:
    """Embedded images (doc_id, page, content, width, height) that are large enough, each once a document, at its first page."""
    large = images.filter((F.col("width") >= least_px) & (F.col("height") >= least_px)).withColumn("sha1", F.sha1("content"))
    return large.groupBy("doc_id", "sha1").agg(F.min_by(F.struct("page", "content"), "page").alias("first")).select("doc_id", "sha1", "first.*")



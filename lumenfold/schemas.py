"""Column contracts of the engine's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import (
    ArrayType,
    DateType,
    DoubleType,
    FloatType,
    IntegerType,
    LongType,
    MapType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)


def _struct(**fields) -> StructType:
    return StructType([StructField(n, t) for n, t in fields.items()])


TEXT, LONG, INT, REAL, WHEN = StringType(), LongType(), IntegerType(), DoubleType(), TimestampType()
TEXTS = ArrayType(TEXT)
NAMED = _struct(id=TEXT, name=TEXT, kind=TEXT)
DATE_SPAN = _struct(start=DateType(), end=DateType(), text=TEXT)

PAGES = _struct(doc_id=TEXT, source=TEXT, doc_type=TEXT, text=TEXT, page=INT, section=TEXT, extraction_method=TEXT, ocr_confidence=REAL)
CHUNKS = _struct(
    chunk_id=TEXT, doc_id=TEXT, source=TEXT, doc_type=TEXT, chunk_index=INT, text=TEXT, token_count=INT, page=INT, section=TEXT, language=TEXT, extraction_method=TEXT, ocr_confidence=REAL, date_start=TEXT, date_end=TEXT, dates=TEXTS,
    metadata=MapType(TEXT, TEXT), embedding=ArrayType(FloatType()),
)
VERTICES = _struct(id=TEXT, label=TEXT, name=TEXT, kind=TEXT, aliases=TEXTS)
EDGES = _struct(src=TEXT, dst=TEXT, rel=TEXT, stance=TEXT, confidence=REAL)
RELATIONS = _struct(subject_id=TEXT, predicate=TEXT, object_id=TEXT, chunk_id=TEXT, evidence=TEXT, confidence=REAL)
FACTS = _struct(subject_id=TEXT, predicate=TEXT, object_id=TEXT, hops=INT, confidence=REAL, chunk_ids=TEXTS, sources=TEXTS, evidence=TEXT, template=TEXT)
POSTS = _struct(
    post_id=TEXT, row_id=LONG, text=TEXT, summary=TEXT, url=TEXT, platform=TEXT, author=TEXT, author_name=TEXT, posted_at=WHEN, language=TEXT, sentiment=TEXT, emotion=TEXT, topic=NAMED, account=NAMED, districts=ArrayType(NAMED),
    thanas=ArrayType(NAMED), categories=ArrayType(NAMED), sub_categories=ArrayType(NAMED), entities=ArrayType(NAMED), hashtags=ArrayType(NAMED), mentions=ArrayType(NAMED),
)


def assert_schema(df: DataFrame, contract: StructType) -> DataFrame:
    """``df`` with the contract's columns in its order; a missing column or another type is an error."""
    have = {f.name: f.dataType for f in df.schema.fields}
    wrong = [f"{f.name}: {have.get(f.name)} instead of {f.dataType}" for f in contract.fields if have.get(f.name) != f.dataType]
    if wrong:
        raise ValueError("schema mismatch: " + "; ".join(wrong))
    return df.select(contract.fieldNames())

"""Text functions as column expressions. Unicode normal forms, which SQL lacks, run in Arrow batches, and only where a text
is not plain ASCII."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
ZERO_WIDTH = "[\u200b\u2060\ufeff]"
PHONE = r"(?<!\d)(?:\+?91[\s-]?|0)?[6-9]\d{4}[\s-]?\d{5}(?!\d)"
PHONE_MARK = "[phone removed]"
ORG_SUFFIXES = ("ltd", "limited", "pvt", "private", "inc", "llp", "llc", "corp", "corporation", "co", "plc")
ENTITY_TYPES = ("Person", "Organization", "Location", "Event", "Concept")
PREDICATES = (
    "WORKS_FOR", "LEADS", "SUBSIDIARY_OF", "OWNS", "SUPPLIES", "CONTRACTED_BY", "SUBCONTRACTS_TO", "PARTNER_OF", "LOCATED_IN", "IMPACTS", "PARTICIPATED_IN", "CAUSED", "OCCURRED_AT", "MEMBER_OF", "PRODUCES", "HAS_SKILL", "USES", "STUDIED_AT",
    "RELATED_TO",
)
PERSON_SUBJECT = ("LEADS", "WORKS_FOR", "HAS_SKILL", "STUDIED_AT")
LOCATION_OBJECT = ("LOCATED_IN", "OCCURRED_AT")
NAME_CHARS = 80
_STRIP = " ,.;:-'\""


def _changed(change: Callable[[str], str], text: Column, plain: Column) -> Column:
    """``change`` of texts that are not plain ASCII, ``plain`` of the others: those never leave the JVM. A batch is changed in
    slices, as Python's strings take up to four bytes a sign."""

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        slices = (texts.slice(at, 64).to_pylist() for at in range(0, len(texts), 64))
        return pa.concat_arrays([pa.array([], pa.string()), *(pa.array([None if t is None else change(t) for t in part], pa.string()) for part in slices)])

    return F.coalesce(run(F.when(F.octet_length(text) > F.length(text), text)), plain)


def composed(text: Column, form: str = "NFC") -> Column:
    """Unicode normal form. ASCII text is its own and stays where it is."""
    return _changed(lambda t: unicodedata.normalize(form, t), text, text)


def tidy(text: Column) -> Column:
    """Ligatures spelt out, zero-width signs dropped, one kind of line end, single spaces, stripped lines, at most one empty
    line in a row. Zero-width joiners stay: Indic scripts need them."""
    for sign, plain in LIGATURES.items():
        text = F.replace(text, F.lit(sign), F.lit(plain))
    text = F.regexp_replace(F.regexp_replace(text, ZERO_WIDTH, ""), "\r\n?", "\n")
    text = F.regexp_replace(text, "[ \\t\u00a0]+", " ")
    text = F.regexp_replace(text, "(?m)^[\\s&&[^\\n]]+|[\\s&&[^\\n]]+$", "")
    return F.regexp_replace(F.regexp_replace(text, "\n{3,}", "\n\n"), "^\\s+|\\s+$", "")


def normalize_text(text: Column) -> Column:
    return tidy(composed(text))


def key_of_folded(text: Column) -> Column:
    """Letters, marks and digits of case-folded text, other signs as single underscores."""
    return F.regexp_replace(F.trim(F.regexp_replace(text, "[^\\p{L}\\p{M}\\p{N}]+", " ")), " ", "_")


def name_key(text: Column) -> Column:
    return key_of_folded(_changed(lambda t: unicodedata.normalize("NFC", t).casefold(), text, F.lower(text)))


def plain_key(name: str) -> str:
    """``name_key`` on the driver."""
    kept = (c if unicodedata.category(c)[0] in "LMN" else " " for c in unicodedata.normalize("NFC", name).casefold())
    return "_".join("".join(kept).split())


def words(text: Column) -> Column:
    """Lower-case words; punctuation, symbols, spaces and underscores part them, combining marks stay."""
    return F.filter(F.split(F.lower(text), "[\\p{P}\\p{S}\\p{Z}\\s]+"), lambda w: w != "")


def plain_words(text: str) -> list[str]:
    """``words`` on the driver."""
    folded = unicodedata.normalize("NFC", text).casefold()
    return "".join(" " if c == "_" or unicodedata.category(c)[0] in "PSZ" else c for c in folded).split()


def _accents() -> dict[str, str]:
    """Latin letters with marks to the letter alone, by their decomposition."""
    parts = ((chr(c), unicodedata.normalize("NFKD", chr(c))) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)))
    return {sign: form[0] for sign, form in parts if len(form) > 1 and form[0].isascii() and form[0].isalpha() and all(unicodedata.combining(x) for x in form[1:])}


def search_words(text: Column) -> Column:
    """``words`` without the accents of Latin letters; marks of other scripts stay."""
    bare = _accents()
    return words(F.translate(F.lower(text), "".join(bare), "".join(bare.values())))


def plain_search_words(text: str) -> list[str]:
    """``search_words`` on the driver."""
    return plain_words(text.lower().translate(str.maketrans(_accents())))


def entity_key(text: Column, keep_marks: bool = True) -> Column:
    """Key of an organisation or other entity: folded words without trailing company suffixes (one word always stays)."""
    parts = F.regexp_replace(text, "[^\\p{L}\\p{M}\\p{N}_]+" if keep_marks else "[^\\p{L}\\p{N}_]+", "_")
    parts = F.regexp_replace(parts, "^_+|_+$", "")
    return F.regexp_replace(parts, f"(?<=[^_])(_({'|'.join(ORG_SUFFIXES)}))+$", "")


def clean_name(text: Column) -> Column:
    """Single spaces, no punctuation at the ends; null if empty, too long or without a letter or digit."""
    name = F.btrim(F.regexp_replace(text, "\\s+", " "), F.lit(_STRIP))
    return F.when((F.length(name) > 0) & (F.length(name) <= NAME_CHARS) & name.rlike("[\\p{L}\\p{M}\\p{N}]"), name)


def mask_phones(text: Column) -> Column:
    """Indian mobile numbers, with or without their prefix, replaced; longer digit runs stay."""
    return F.regexp_replace(text, PHONE, F.lit(PHONE_MARK))


def cut_at_word(text: Column, limit: int) -> Column:
    """The first ``limit`` signs, back to a space, with an ellipsis; shorter texts as they are."""
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.regexp_replace(F.substring(text, 1, limit), " [^ ]*$", ""), F.lit(" …")))


def clean_text(text: Column, limit: int) -> Column:
    spaced = F.regexp_replace(F.regexp_replace(mask_phones(text), "[ \\t]+", " "), "\n{3,}", "\n\n")
    return cut_at_word(F.regexp_replace(spaced, "^\\s+|\\s+$", ""), limit)


def json_names(text: Column) -> Column:
    """A JSON array kept as text as an array of clean names, the first spelling of each key. Null and empty text give no
    names; text that is no array is one name."""
    items = F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.coalesce(F.from_json(text, "array<string>"), F.array(text)))
    names = F.filter(F.transform(items, clean_name), lambda n: n.isNotNull())
    keyed = F.transform(names, lambda n: F.struct(key_of_folded(F.lower(n)).alias("key"), n.alias("name")))
    once = F.filter(keyed, lambda x, i: F.array_position(F.transform(keyed, lambda y: y["key"]), x["key"]) == i + 1)
    return F.transform(once, lambda x: x["name"])


def chunk_id(doc_id: Column, index: Column, text: Column) -> Column:
    return F.concat(F.lit("chunk:"), F.substring(F.sha2(F.concat(doc_id, F.lit("|"), index.cast("string"), F.lit("|"), text), 256), 1, 24))


def doc_id(content: Column) -> Column:
    return F.concat(F.lit("doc:"), F.substring(F.sha2(content, 256), 1, 16))


def point_id(chunk: Column) -> Column:
    """UUID of version 5 in the URL namespace, from SHA-1 alone."""
    h = F.sha1(F.concat(F.unhex(F.lit("6ba7b8119dad11d180b400c04fd430c8")), F.encode(chunk, "UTF-8")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def cache_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def normalize_predicate(text: Column) -> Column:
    """One of the known relations, or RELATED_TO."""
    name = F.regexp_replace(F.regexp_replace(F.upper(text), "[^A-Z0-9]+", "_"), "^_+|_+$", "")
    return F.when(name.isin(*PREDICATES), name).otherwise(F.lit("RELATED_TO"))


def token_count(text: Column) -> Column:
    """Stand-in for a model's tokenizer: words and single other signs."""
    return F.size(F.regexp_extract_all(text, F.lit("[\\p{L}\\p{M}\\p{N}_]+|[^\\p{L}\\p{M}\\p{N}_\\s]"), F.lit(0)))


def orient(predicate: Column, subject: Column, object_: Column) -> Column:
    """subject and object (structs with a type) as (s, o), swapped where their types show that a fact was put backwards."""
    person = predicate.isin(*PERSON_SUBJECT) & (subject["type"] != "Person") & (object_["type"] == "Person")
    place = predicate.isin(*LOCATION_OBJECT) & (object_["type"] != "Location") & (subject["type"] == "Location")
    return F.when(person | place, F.struct(object_.alias("s"), subject.alias("o"))).otherwise(F.struct(subject.alias("s"), object_.alias("o")))


_TOKEN = re.compile(r"[\w\u0900-\u0963\u0966-\u097f]+|[^\w\s]")


def plain_token_count(text: str) -> int:
    return len(_TOKEN.findall(text))


def plain_token_starts(text: str) -> list[int]:
    """Where each token of ``plain_token_count`` begins."""
    return [m.start() for m in _TOKEN.finditer(text)]


def fact_text(subject: Column, predicate: Column, object_: Column) -> Column:
    return F.concat(subject, F.lit(" -["), predicate, F.lit("]-> "), object_)


def fact_sentence(subject: Column, predicate: Column, object_: Column) -> Column:
    return F.concat(subject, F.lit(" "), F.lower(F.replace(predicate, F.lit("_"), F.lit(" "))), F.lit(" "), object_)


def _once(value: Column, make) -> Column:
    """``make`` of a value that is worked out once, however often it is used."""
    return F.element_at(F.transform(F.array(value), make), 1)


def script_language(text: Column) -> Column:
    """hi for mostly Devanagari, en for Latin letters, unknown without letters."""
    without = lambda signs: F.length(text) - F.length(F.regexp_replace(text, signs, ""))  # noqa: E731  by runs: a match a sign is slow
    named = lambda c: F.when((c["dev"] == 0) & (c["latin"] == 0), "unknown").when(c["dev"] > c["latin"], "hi").otherwise("en")
    return _once(F.struct(without("\\p{InDevanagari}+").alias("dev"), without("[A-Za-z]+").alias("latin")), named)


#: Frequent words that the other languages here lack.
STOP_WORDS = {
    "en": ("the", "of", "and", "to", "is", "that", "it", "for", "was", "with", "are", "this", "by", "from"),
    "fr": ("le", "les", "des", "et", "une", "est", "que", "dans", "pour", "sur", "pas", "qui", "du", "avec", "au"),
    "de": ("der", "die", "und", "das", "ist", "nicht", "ein", "den", "von", "mit", "auf", "zu", "dem", "sich", "eine"),
    "es": ("el", "los", "las", "una", "por", "con", "para", "se", "del", "al", "su", "y", "como", "lo"),
}


def detect_language(text: Column) -> Column:
    """``script_language``, and for Latin letters the language whose stop words stand there most often (of ties the first of
    en, fr, de, es; en without any)."""

    def voted(found: Column) -> Column:
        count = lambda own: F.size(F.filter(found, lambda w: w.isin(*own)))
        votes = F.array(*[F.struct(count(own).alias("n"), F.lit(-i).alias("order"), F.lit(kind).alias("language")) for i, (kind, own) in enumerate(STOP_WORDS.items())])
        return F.array_max(votes)["language"]

    every = [w for own in STOP_WORDS.values() for w in own]
    said = F.filter(words(text), lambda w: w.isin(*every))
    return _once(script_language(text), lambda script: F.when(script == "en", _once(said, voted)).otherwise(script))

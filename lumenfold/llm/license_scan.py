"""Licence scans: normalised text against licence templates by the Dice coefficient over word bigrams.

DataFrame functions only. A unit of text (each line, each block of lines between lines without words, and each whole
document) is compared with those templates whose
bigram counts its own allow: with a smaller set of a and a larger of b bigrams the coefficient is at most 2a / (a + b).
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Notices by which texts state a licence, and some short public licence texts (MIT, ISC), whole and by their
# paragraphs, as a wrapped text stands in a file. Only these are recognised.
TEMPLATES: dict[str, list[str]] = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ],
    "LGPL-3.0": [
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    ],
    "AGPL-3.0": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License."],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License."],
    "ISC": [
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "Proprietary": ["All rights reserved."],
}


#: Lines without a word between two blocks of lines.
BLOCK_END = "\n(?:[^A-Za-z0-9\n]*\n)+"


def plain_words(text: str) -> list[str]:
    """``words_of`` for a template on the driver."""
    return "".join(c.lower() if c.isascii() and c.isalnum() else " " for c in text).split()


def plain_bigrams(text: str) -> set[tuple[str, str]]:
    words = plain_words(text)
    return set(zip(words, words[1:], strict=False))


def telling_signs(templates: dict[str, list[str]], threshold: float, least: int = 5) -> tuple[list[str], list[tuple[str, str]]]:
    """Words and bigrams of which every text that reaches the threshold with some template holds one at least.

    A coefficient t takes s >= t * n / (2 - t) of a template's n bigrams. So any n - s + 1 of them hold a common one: words
    of ``least`` letters or more, the longest first, are chosen until that many bigrams contain one; where they don't
    suffice, bigrams without such a word are added."""
    words: set[str] = set()
    pairs: set[tuple[str, str]] = set()
    for text in (t for texts in templates.values() for t in texts):
        grams = plain_bigrams(text)
        may_lack = len(grams) - math.ceil(threshold * len(grams) / (2 - threshold) - 1e-9)
        held = lambda: {g for g in grams if g in pairs or any(w in words for w in g)}
        for word in sorted({w for w in plain_words(text) if len(w) >= least}, key=lambda w: (w not in words, -len(w), w)):
            if len(held()) > may_lack:
                break
            words.add(word)
        for g in sorted(grams - held(), key=lambda g: (-len(g[0] + g[1]), g))[: max(0, may_lack + 1 - len(held()))]:
            pairs.add(g)
    return sorted(words), sorted(pairs)


def _may_match(text: Column, templates: dict[str, list[str]], threshold: float) -> Column:
    """Whether a text holds a telling word or bigram. The lower-cased text is a lambda's argument, so that it is made once
    and not for each word."""
    words, pairs = telling_signs(templates, threshold)

    def tests(low: Column) -> Column:
        found = [F.contains(low, F.lit(w)) for w in words if not any(v != w and v in w for v in words)]
        if pairs:
            found.append(low.rlike("|".join(f"{a}[^a-z0-9]+{b}" for a, b in pairs)))
        return reduce(lambda a, b: a | b, found, F.lit(False))

    return F.element_at(F.transform(F.array(F.lower(text)), tests), 1)


def words_of(text: Column) -> Column:
    """Lower-case ASCII words; every other sign parts words."""
    plain = F.trim(F.lower(F.regexp_replace(text, "[^A-Za-z0-9]+", " ")))
    return F.filter(F.split(plain, " "), lambda w: w != "")


def bigrams_of(words: Column) -> Column:
    """Distinct pairs of neighbouring words."""
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(pairs)


def template_table(spark, templates: dict[str, list[str]]) -> DataFrame:
    """``license_id, template_no, grams, size``; templates without two words can't be compared and are left out."""
    rows = [(name, i, t) for name, texts in sorted(templates.items()) for i, t in enumerate(texts)]
    table = spark.createDataFrame(rows, "license_id string, template_no int, text string")
    table = table.withColumn("grams", bigrams_of(words_of(F.col("text")))).withColumn("size", F.size("grams"))
    return table.filter("size > 0").select("license_id", "template_no", "grams", "size")


def scan_licenses(docs: DataFrame, templates: dict[str, list[str]] | None = None, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", max_templates: int = 1000) -> DataFrame:
    """One row for each unit and licence that reach ``threshold``: id, ``unit`` (0: the whole document, n: its n-th line,
    -n: its n-th block of lines), ``license_id``, ``dice`` (its best template's) and ``n_bigrams`` of the unit.

    Blocks are parted by lines without a word, so a text wrapped over several lines is compared as one. A document of one
    line is compared once, as the document; one of a single block has no block units, and blocks of one line are lines.
    Null and empty texts, and units of fewer than two words, match nothing. Equal templates of two licences give a row for
    each. Rows that repeat an id and its text give each finding once, null ids stay null and count as one id; only the two
    named columns are read. Very long texts are compared like others; what is no unit (a notice inside a longer line, or
    in a block with other text) is not found. The template table is broadcast; ``max_templates`` bounds it.
    """
    templates = TEMPLATES if templates is None else templates
    if sum(map(len, templates.values())) > max_templates:
        raise ValueError(f"more than {max_templates} templates")
    spark = docs.sparkSession
    table = template_table(spark, templates)
    every = [g for texts in templates.values() for t in texts if (g := plain_bigrams(t))]
    sizes = [len(g) for g in every] or [1]
    factor = (2 - threshold) / threshold + 1e-9  # a bound that rounding can't tighten
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = rows.filter(F.col("text").isNotNull() & _may_match(F.col("text"), templates, threshold))
    lines = F.transform(F.split("text", "\n"), lambda line, i: F.struct((i + 1).alias("unit"), line.alias("part")))
    whole = F.array(F.struct(F.lit(0).alias("unit"), F.col("text").alias("part")))
    cut = F.filter(F.transform(F.split("text", BLOCK_END), lambda b, i: F.struct((-i - 1).alias("unit"), b.alias("part"))), lambda b: F.instr(b["part"], "\n") > 0)
    blocks = F.when(F.col("text").rlike(BLOCK_END), cut).otherwise(F.slice(whole, 1, 0))
    units = F.when(F.instr("text", "\n") > 0, F.concat(whole, lines, blocks)).otherwise(whole)
    # a unit of n words has at most n - 1 bigrams, so one too short for the smallest template goes before it is split
    spaces = F.length(F.col("u.part")) >= 3
    parts = rows.select("id", F.explode(units).alias("u")).filter(spaces).select("id", F.col("u.unit").alias("unit"), words_of(F.col("u.part")).alias("words"))
    parts = parts.filter(F.size("words") - 1 >= min(sizes) / factor)
    grams = parts.select("id", "unit", bigrams_of(F.col("words")).alias("own")).withColumn("n", F.size("own")).filter((F.col("n") >= min(sizes) / factor) & (F.col("n") <= max(sizes) * factor))
    known = F.array(*[F.lit(" ".join(g)) for g in sorted(set().union(*every))]).cast("array<string>")
    grams = grams.filter(F.arrays_overlap("own", known))
    fits = (F.col("size") <= F.col("n") * factor) & (F.col("size") * factor >= F.col("n"))
    paired = grams.join(F.broadcast(table), fits)
    dice = 2 * F.size(F.array_intersect("own", "grams")) / (F.col("n") + F.col("size"))
    found = paired.withColumn("dice", dice).filter(F.col("dice") >= threshold)
    best = found.groupBy("id", "unit", "license_id", "n").agg(F.max("dice").alias("dice"))
    return best.select(F.col("id").alias(id_col), F.col("unit").cast("long").alias("unit"), "license_id", F.round("dice", 6).alias("dice"), F.col("n").cast("long").alias("n_bigrams"))


def oracle(threshold: float = 0.8, templates: dict[str, list[str]] | None = None) -> str:
    """The same findings in SQL."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({quote(name)}, {quote(t)})" for name, texts in sorted((templates or TEMPLATES).items()) for t in texts)

    def grams(text: str) -> str:
        words = f"list_filter(string_split(trim(lower(regexp_replace({text}, '[^A-Za-z0-9]+', ' ', 'g'))), ' '), lambda w: w <> '')"
        return f"(SELECT list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM (SELECT {words} AS w))"

    return f"""
WITH templates AS (SELECT license_id, {grams('text')} AS grams FROM (VALUES {values}) t(license_id, text)),
parts AS (
  SELECT doc_id, 0 AS unit, text AS part FROM documents WHERE text IS NOT NULL
  UNION ALL
  SELECT doc_id, i AS unit, lines[i] AS part FROM (
    SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE contains(text, chr(10))))
  UNION ALL
  SELECT doc_id, -i AS unit, blocks[i] AS part FROM (
    SELECT doc_id, blocks, unnest(range(1, len(blocks) + 1)) AS i FROM (SELECT doc_id, string_split_regex(text, '{BLOCK_END}') AS blocks FROM documents WHERE regexp_matches(text, '{BLOCK_END}')))
  WHERE contains(blocks[i], chr(10))
),
units AS (SELECT doc_id, unit, {grams('part')} AS own FROM parts),
scored AS (
  SELECT doc_id, unit, license_id, len(own) AS n, 2.0::DOUBLE * len(list_intersect(own, grams)) / (len(own) + len(grams)) AS dice
  FROM units JOIN templates ON len(grams) > 0 AND len(own) > 0 AND len(own) <= 2 * len(grams) AND len(grams) <= 2 * len(own))
SELECT doc_id, CAST(unit AS BIGINT) AS unit, license_id, round(max(dice), 6) AS dice, CAST(max(n) AS BIGINT) AS n_bigrams
FROM scored WHERE dice >= {threshold} GROUP BY doc_id, unit, license_id"""

"""License scans: MinHash bands over overlapping windows of a text retrieve templates, shingle containment verifies.

Native columns only. A word is a run of letters and digits in lower case, so punctuation, line ends and comment marks around
a notice don't count. A text and the templates are sets of five-word shingles. A template is cut into windows at every
shingle, a text into windows that overlap by half. A band is the least or the largest shingle hash of a window (one
MinHash row each, of two permutations that are each other's reverse). If at least 0.8 of a template's shingles stand in
a text, edits leave a run of untouched shingles that is at least as long as one text window plus its step (a changed
word costs up to five shingles, so m shingles with 0.2 m lost hold a run of 0.8 m / (0.04 m + 1)); that window is also
a template window, and both bands collide for certain. Templates under 8 shingles have windows of one shingle. The exact
check then counts the template's shingle texts within the stretch of the text where the template lies.

The templates are a given list, collected and checked against `most_windows`; their bands are broadcast.

Defined cases: a null or empty text matches nothing; a template without words is left out; templates under five words
are one shingle, matched where the text has the same words in a window of that many. Repeated rows give repeated
results. Very long texts are searched whole, inside their row; a template met at several places with equal containment has
the earliest as its start. An empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot.llm.common import let, literal_array, shingle_hashes, whole

#: Sentences of common licenses and of the notices that name them. Where families share a sentence, the part
#: is chosen so that another version or variant loses more than a fifth of its shingles.
TEMPLATES = (
    ("apache-notice", "Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-terms", "Apache-2.0", "you may not use this file except in compliance with the License. "
     "You may obtain a copy of the License at"),
    ("apache-basis", "Apache-2.0", "software distributed under the License is distributed on an \"AS IS\" BASIS, "
     "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("bsd-terms", "BSD", "Redistribution and use in source and binary forms, with or without modification, "
     "are permitted provided that the following conditions are met:"),
    ("bsd-disclaimer", "BSD", "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, "
     "INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES"),
    ("bsd-names", "BSD-3-Clause", "may be used to endorse or promote products derived from this software without specific "
     "prior written permission."),
    ("boost-notice", "BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("cc-by", "CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-sa", "CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc", "CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nd", "CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("cc-by-nc-sa", "CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("cc-by-nc-nd", "CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("cc-by-name", "CC-BY-4.0", "Creative Commons Attribution 4.0 International"),
    ("cc-by-sa-name", "CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International"),
    ("cc-by-nc-name", "CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International"),
    ("cc-by-nd-name", "CC-BY-ND-4.0", "Creative Commons Attribution-NoDerivatives 4.0 International"),
    ("cc-by-nc-sa-name", "CC-BY-NC-SA-4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International"),
    ("cc-by-nc-nd-name", "CC-BY-NC-ND-4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International"),
    ("cc0-name", "CC0-1.0", "CC0 1.0 Universal"),
    ("epl-notice", "EPL-2.0", "under the terms of the Eclipse Public License 2.0"),
    ("gpl-notice", "GPL-3.0", "GNU General Public License, version 3"),
    ("gpl2-notice", "GPL-2.0", "GNU General Public License, version 2"),
    ("gpl-header", "GPL-3.0", "the terms of the GNU General Public License as published by the Free Software Foundation, "
     "either version 3 of the License, or (at"),
    ("gpl2-header", "GPL-2.0", "the terms of the GNU General Public License as published by the Free Software Foundation; "
     "either version 2 of the License, or (at"),
    ("lgpl-notice", "LGPL-3.0", "GNU Lesser General Public License, version 3"),
    ("lgpl-header", "LGPL-3.0", "the terms of the GNU Lesser General Public License as published by the Free Software "
     "Foundation, either version 3 of the License, or (at"),
    ("lgpl21-header", "LGPL-2.1", "the terms of the GNU Lesser General Public License as published by the Free Software "
     "Foundation; either version 2.1 of the License, or (at"),
    ("agpl-notice", "AGPL-3.0", "GNU Affero General Public License, version 3"),
    ("agpl-header", "AGPL-3.0", "the terms of the GNU Affero General Public License as published by the Free Software "
     "Foundation, either version 3 of the License, or (at"),
    ("isc-terms", "ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without "
     "fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mit-notice", "MIT", "Released under the MIT License."),
    ("mit-licensed", "MIT", "Licensed under the MIT License."),
    ("mit-terms", "MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
     "software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
     "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or "
     "sell copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("mpl-header", "MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy "
     "of the MPL was not distributed with this file, You can obtain one at"),
    ("ofl-notice", "OFL-1.1", "This Font Software is licensed under the SIL Open Font License, Version 1.1."),
    ("python-notice", "PSF-2.0", "under the terms of the Python Software Foundation License"),
    ("reserved", "proprietary", "All rights reserved."),
    ("unlicense-terms", "Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to "
     "copy, modify, publish, use, compile, sell, or distribute this software"),
    ("wtfpl-name", "WTFPL", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE"),
    ("zlib-terms", "Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the "
     "authors be held liable for any damages arising from the use of this software."),
)
#: Identifiers whose tag line is a template too.
TAGGED = ("AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC0-1.0", "CC-BY-4.0",
          "CC-BY-SA-4.0", "EPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "ISC",
          "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MPL-2.0", "Unlicense", "Zlib")
TEMPLATES += tuple((f"tag-{name.lower()}", name, f"SPDX-License-Identifier: {name}") for name in TAGGED)
#: A word of a notice: letters and digits, without punctuation and comment marks.
NOTICE_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SHINGLE = 5
#: Window lengths in shingles, each with the least number of shingles of a template that uses it.
WINDOWS = ((1, 0), (4, 8), (8, 100))


def notice_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(NOTICE_WORD), F.lit(0))


def template_table(spark, templates=TEMPLATES) -> DataFrame:
    return spark.createDataFrame(list(templates), "template_id string, license string, template string")


def _spans(words: Column, width: int | Column) -> Column:
    """The shingles of a short list of words as texts."""
    return F.when(F.size(words) >= width, F.transform(
        F.sequence(F.lit(0), F.size(words) - width),
        lambda i: F.array_join(F.slice(words, i + 1, F.lit(width) if isinstance(width, int) else width), " "))) \
        .otherwise(F.array().cast("array<string>"))


def _windows(hashes: Column, window: int, step: int, pick) -> Column:
    """One band key per window: the least or the largest of its shingle hashes."""
    if window == 1:
        return hashes
    starts = F.sequence(F.lit(0), F.size(hashes) - window, F.lit(step))
    return F.when(F.size(hashes) >= window, F.transform(starts, lambda i: pick(
        *[F.get(hashes, i + k) for k in range(window)]))).otherwise(F.array().cast("array<bigint>"))


def _hits(bands: Column, keys: list[int], kind: int, step: int) -> Column:
    """Array of (kind, at, band) of the text windows whose band is a template's; hashed search, inside the row."""
    def positions(values: Column) -> Column:
        return let(F.array_intersect(values, literal_array(keys, "bigint")), lambda hit: F.when(
            F.size(hit) > 0, F.filter(F.transform(values, lambda x, i: F.struct(
                F.lit(kind).alias("kind"), (i * step).alias("at"), x.alias("band"))),
                lambda s: F.array_contains(hit, s["band"]))).otherwise(F.array().cast(HIT)))

    return let(bands, positions)


HIT = "array<struct<kind:int,at:int,band:bigint>>"
#: MinHash rows of a window: the two permutations and how they pick.
PICKS = (F.least, F.greatest)


def _template_bands(spark, templates: DataFrame, most_windows: int) -> list[dict]:
    """Template windows by width of shingle, window length and permutation, with the band key of each."""
    known = (templates.where(F.col("template").isNotNull())
             .select("template_id", "license", notice_words(F.col("template")).alias("words"))
             .where(F.size("words") > 0).limit(most_windows + 1))
    listed = known.select("template_id", "license", "words").collect()
    classes = []
    for width in sorted({min(SHINGLE, len(r["words"])) for r in listed}):
        own = known.where(F.least(F.size("words"), F.lit(SHINGLE)) == width).select(
            "template_id", "license", shingle_hashes(F.col("words"), width).alias("hashes"),
            F.array_distinct(_spans(F.col("words"), width)).alias("t_shingles"))
        for window, least in WINDOWS:
            most = min((w[1] for w in WINDOWS if w[1] > least), default=1 << 30)
            for pick in PICKS[:1 if window == 1 else 2]:
                rows = (own.where((F.size("hashes") >= least) & (F.size("hashes") < most))
                        .select("template_id", "license", "t_shingles", F.size("hashes").alias("m"),
                                F.posexplode(_windows(F.col("hashes"), window, 1, pick)).alias("t_at", "t_band"))
                        .collect())
                if rows:
                    classes.append({"width": width, "window": window, "pick": pick, "rows": rows})
    if len(listed) + sum(len(c["rows"]) for c in classes) > most_windows:
        raise ValueError("more template windows than `most_windows`")
    return classes


def scan(docs: DataFrame, templates: DataFrame, doc_id: str = "doc_id", text: str = "text",
         containment: float = 0.8, most_windows: int = 200_000) -> DataFrame:
    """One row per document row and template found: doc_id, template_id, license, containment, start_word.

    `containment` is the share of the template's distinct shingles in the best stretch of the text, `start_word` the
    place (from 0, in words of NOTICE_WORD) of the first word of these shingles, in the earliest such stretch.
    """
    spark = docs.sparkSession
    classes = _template_bands(spark, templates, most_windows)
    source = docs.select(F.col(doc_id).alias("doc_id"), notice_words(whole(text)).alias("words"))
    schema = ("kind int, t_band bigint, template_id string, license string, t_shingles array<string>, m int, "
              "t_at int, width int")
    table = spark.createDataFrame(
        [(k, r["t_band"], r["template_id"], r["license"], r["t_shingles"], r["m"], r["t_at"], c["width"])
         for k, c in enumerate(classes) for r in c["rows"]], schema).distinct()
    hits = [F.array().cast(HIT)]
    for width in sorted({c["width"] for c in classes}):
        def of_width(hashes: Column, width=width) -> Column:
            parts = []
            for k, c in enumerate(classes):
                if c["width"] == width:
                    step = max(1, c["window"] // 2)
                    parts.append(_hits(_windows(hashes, c["window"], step, c["pick"]),
                                       sorted({r["t_band"] for r in c["rows"]}), k, step))
            return F.concat(*parts)

        full = F.when(F.size("words") >= width, shingle_hashes(F.col("words"), width)) \
            .otherwise(F.array().cast("array<bigint>"))
        hits.append(let(full, lambda h: of_width(h)))
    # The number of the row is made beside the hits: a filter isn't pushed below it, so hits are searched once.
    met = (source.select("*", F.monotonically_increasing_id().alias("row"), F.concat(*hits).alias("hits"))
           .select("doc_id", "row", "words", F.explode("hits").alias("hit"))
           .select("doc_id", "row", "words", F.col("hit.kind").alias("hit_kind"), F.col("hit.at").alias("at"),
                   F.col("hit.band").alias("band"))
           .join(F.broadcast(table), (F.col("hit_kind") == F.col("kind")) & (F.col("band") == F.col("t_band"))))
    start, slack = F.col("at") - F.col("t_at"), F.ceil(F.col("m") * (1 - containment)).cast("int")
    low = F.greatest(start - slack, F.lit(0))
    stretch = F.slice("words", low + 1,
                      F.col("m") + F.col("width") - 1 + slack + F.least(slack, F.greatest(start, F.lit(0))))
    # A band meets a template window up to a window's length off; the first of the template's shingles is the start.
    checked = (met.select("doc_id", "row", "template_id", "license", "t_shingles", low.alias("low"), let(
        stretch, lambda w: _spans(w, F.col("width"))).alias("there"))
        .select("doc_id", "row", "template_id", "license",
                (F.size(F.array_intersect("t_shingles", "there")) / F.size("t_shingles")).alias("containment"),
                (F.col("low") + F.array_position(F.transform("there", lambda s: F.array_contains("t_shingles", s)), True)
                 .cast("int") - 1).alias("start_word")))
    return (checked.where(F.col("containment") >= containment)
            .groupBy("doc_id", "row", "template_id", "license")
            .agg(F.max("containment").alias("containment"),
                 F.max_by("start_word", F.struct("containment", -F.col("start_word"))).alias("start_word"))
            .drop("row"))

"""License scan: an ordered table of signature rules over normalised words, with overlap suppression.

Texts become lower-case words separated by single spaces. Rules are hand-written signatures (passages of license texts
and notices, identifiers with versions) and forms of naming each family: regular expressions over that form,
each with its family's keywords; a document pays for a family's rules only if one of the keywords occurs in it.
Detections carry a priority. One is suppressed when another of at least its priority contains its interval, or
contains it strictly; what is left gives the labels. Everything happens inside the row: no shuffle.

Defined cases: NULL or empty text has no words, no labels and score 0; first and last word are NULL. Repeated
rows and NULL ids each get their own row; very long texts are scanned whole; other columns are ignored by ``scan`` and kept if asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortwise.llm.common import matches, scanned, spaces, whole

#: Base phrases and labels, and everything that separates words after lower-casing.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"

#: Families: label, gating keywords, name pattern, identifier pattern (all over normalised words). Every match of either
#: pattern must hold one of the keywords.
FAMILIES = (
    ("gpl", "gnu|gpl", "gnu general public licen[sc]e", "gpl"),
    ("lgpl", "gnu|lgpl", "gnu (?:lesser|library) general public licen[sc]e", "lgpl"),
    ("agpl", "gnu|agpl", "gnu affero general public licen[sc]e", "agpl"),
    ("gfdl", "gnu|gfdl", "gnu free documentation licen[sc]e", "gfdl"),
    ("apache", "apache", "apache(?: software)? licen[sc]e", "apache"),
    ("mit", "mit", "mit licen[sc]e", "mit"),
    ("mit", "expat", "expat licen[sc]e", "expat"),
    ("bsd", "bsd", "bsd(?: style)? licen[sc]e", "bsd"),
    ("bsd-2-clause", "bsd", "(?:bsd 2 clause|2 clause bsd|simplified bsd) licen[sc]e", "bsd 2 clause"),
    ("bsd-3-clause", "bsd", "(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd) licen[sc]e", "bsd 3 clause"),
    ("mpl", "mozilla|mpl", "mozilla public licen[sc]e", "mpl"),
    ("epl", "eclipse|epl", "eclipse public licen[sc]e", "epl"),
    ("cddl", "common development|cddl", "common development and distribution licen[sc]e", "cddl"),
    ("cc0", "cc0", "(?:creative commons )?cc0", "cc0"),
    ("cc-by", "cc", "(?:creative commons )?cc by", "cc by"),
    ("cc-by-sa", "cc", "(?:creative commons )?cc by sa", "cc by sa"),
    ("cc-by-nc", "cc", "(?:creative commons )?cc by nc", "cc by nc"),
    ("cc-by-nd", "cc", "(?:creative commons )?cc by nd", "cc by nd"),
    ("cc-by-nc-sa", "cc", "(?:creative commons )?cc by nc sa", "cc by nc sa"),
    ("cc-by-nc-nd", "cc", "(?:creative commons )?cc by nc nd", "cc by nc nd"),
    ("cc-by", "creative", "creative commons attribution(?: licen[sc]e)?", "creative commons attribution"),
    ("cc-by-sa", "creative", "creative commons attribution share ?alike(?: licen[sc]e)?", "creative commons attribution sharealike"),
    ("isc", "isc", "isc licen[sc]e", "isc"),
    ("zlib", "zlib", "zlib licen[sc]e", "zlib"),
    ("boost", "boost|bsl", "boost software licen[sc]e", "bsl 1 0"),
    ("unlicense", "unlicense", "(?:the )?unlicense", "unlicense"),
    ("artistic", "artistic", "artistic licen[sc]e", "artistic"),
    ("eupl", "european|eupl", "european union public licen[sc]e", "eupl"),
    ("ofl", "sil|ofl", "sil open font licen[sc]e", "ofl"),
    ("psf", "python|psf", "python software foundation licen[sc]e", "psf"),
    ("php", "php", "php licen[sc]e", "php"),
    ("postgresql", "postgresql", "postgresql licen[sc]e", "postgresql"),
    ("proprietary", "reserved|proprietary", "all rights reserved", "proprietary"),
)
#: Forms of a rule, best evidence first: confidence and template; {n} is the family's name, {i} its identifier.
FORMS = (
    (1.00, "spdx license identifier {i}(?: \\d+)*(?: only| or later)?"),
    (0.95, "licen[sc]ed under (?:the terms of )?(?:the |a )?(?:{n}|{i})(?: (?:version |v)?\\d+(?: \\d+)?)?"),
    (0.90, "(?:re)?distributed under (?:the terms of )?(?:the |a )?(?:{n}|{i})(?: (?:version |v)?\\d+(?: \\d+)?)?"),
    (0.90, "released under (?:the terms of )?(?:the |a )?(?:{n}|{i})(?: (?:version |v)?\\d+(?: \\d+)?)?"),
    (0.85, "(?:subject to|governed by|available under) (?:the terms of )?(?:the |a )?(?:{n}|{i})"),
    (0.80, "{n} (?:version |v)?\\d+(?: \\d+)?(?: only| or (?:any )?later(?: version)?)?"),
    (0.75, "(?:terms|conditions) of (?:the |a )?{n}"),
    (0.60, "under (?:the |a )?(?:{n}|{i}(?= (?:licen[sc]es?|terms|versions?|v?\\d\\S*|only|or|and|with|see|for|in|as|$)))"),
    (0.50, "{n}"),
)

#: Passages that only the text or the notice of a license has, and identifiers with their version, over
#: normalised words. Label, gating keywords, place among the forms (0 is best), confidence, pattern.
SIGNATURES = (
    ("mit", "granted", 1, 0.95, "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "substantial", 2, 0.85, "copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("bsd", "redistribution", 1, 0.90, "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistributions", 2, 0.85, "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-3-clause", "endorse", 1, 0.95, "(?:neither the names? of|the names? of) (?:\\S+ ){1,16}?may (?:not )?be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", "advertising", 1, 0.95, "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("isc", "fee", 1, 0.95, "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("postgresql", "fee", 1, 0.95, "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("zlib", "plainly", 1, 0.95, "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("boost", "organization", 1, 0.95, "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("unlicense", "unencumbered", 1, 0.95, "this is free and unencumbered software released into the public domain"),
    ("apache", "apache", 1, 0.95, "you may obtain a copy of the license at https? www apache org licenses license 2 0"),
    ("apache", "apache", 1, 0.95, "licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("gpl", "redistribute", 1, 0.95, "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "redistribute", 1, 0.95, "you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license as published by the free software foundation"),
    ("agpl", "redistribute", 1, 0.95, "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation"),
    ("gfdl", "invariant", 1, 0.95, "with no invariant sections no front cover texts and no back cover texts"),
    ("mpl", "mozilla", 1, 0.95, "this source code form is subject to the terms of the mozilla public license"),
    ("mpl", "mozilla", 2, 0.90, "the contents of this file are subject to the mozilla public license"),
    ("epl", "eclipse", 1, 0.95, "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("cddl", "common development", 1, 0.95, "the contents of this file are subject to the terms of (?:either )?(?:\\S+ ){0,16}?common development and distribution license"),
    ("ofl", "font", 1, 0.95, "this font software is licensed under the sil open font license"),
    ("artistic", "artistic", 1, 0.95, "the intent of this document is to state the conditions under which a package may be copied such that the copyright holder maintains some semblance of artistic control"),
    ("psf", "psf", 1, 0.95, "psf hereby grants licensee a nonexclusive royalty free world ?wide license"),
    ("php", "php", 1, 0.95, "this product includes php software freely available from"),
    ("openssl", "openssl", 1, 0.95, "this product includes software developed by the openssl project"),
    ("cc0", "deed", 1, 0.95, "the person who associated a work with this deed has dedicated the work to the public domain"),
    ("cc-by", "creativecommons", 1, 0.95, "creativecommons org licenses by(?: \\d \\d)?"),
    ("cc-by-sa", "creativecommons", 1, 0.95, "creativecommons org licenses by sa(?: \\d \\d)?"),
    ("cc-by-nc", "creativecommons", 1, 0.95, "creativecommons org licenses by nc(?: \\d \\d)?"),
    ("cc-by-nd", "creativecommons", 1, 0.95, "creativecommons org licenses by nd(?: \\d \\d)?"),
    ("cc-by-nc-sa", "creativecommons", 1, 0.95, "creativecommons org licenses by nc sa(?: \\d \\d)?"),
    ("cc-by-nc-nd", "creativecommons", 1, 0.95, "creativecommons org licenses by nc nd(?: \\d \\d)?"),
    ("cc0", "creativecommons", 1, 0.95, "creativecommons org publicdomain zero(?: \\d \\d)?"),
    ("proprietary", "unauthorized", 1, 0.90, "unauthorized copying of this file via any medium is strictly prohibited"),
    ("proprietary", "confidential", 1, 0.90, "this (?:software|file|document|program|code) is (?:the )?confidential and proprietary"),
    ("gpl", "gpl|gplv2|gplv3|gpl2|gpl3", 6, 0.70, "(?:gpl ?v?[23]|gpl version [23])(?: 0)?(?: only| or (?:any )?later(?: version)?)?"),
    ("lgpl", "lgpl|lgplv2|lgplv3|lgpl2|lgpl3", 6, 0.70, "(?:lgpl ?v?[23]|lgpl version [23])(?: [01])?(?: only| or (?:any )?later(?: version)?)?"),
    ("agpl", "agpl|agplv3|agpl3", 6, 0.70, "(?:agpl ?v?3|agpl version 3)(?: 0)?(?: only| or (?:any )?later(?: version)?)?"),
    ("apache", "apache|apache2", 6, 0.70, "(?:apache ?v?2|apache version 2)(?: 0)?"),
    ("bsd-2-clause", "bsd", 6, 0.70, "bsd 2 clause"),
    ("bsd-3-clause", "bsd", 6, 0.70, "bsd 3 clause"),
    ("mpl", "mpl|mplv2|mpl2", 6, 0.70, "mpl ?v?[12](?: [01])?"),
    ("epl", "epl|eplv1|eplv2", 6, 0.70, "epl ?v?[12](?: 0)?"),
    ("cddl", "cddl", 6, 0.70, "cddl ?v?1 [01]"),
    ("eupl", "eupl", 6, 0.70, "eupl ?v?1 [012]"),
    ("ofl", "ofl", 6, 0.70, "ofl ?v?1 1"),
    ("boost", "bsl", 6, 0.70, "bsl ?v?1 0"),
    ("cc0", "cc0", 6, 0.70, "cc0 ?v?1 0"),
)


def rules() -> list[tuple[str, str, int, float, str]]:
    """All signature rules in order: label, keywords, priority (0 is best), confidence, regular expression."""
    written = [(label, keywords, rank, confidence, f"(?<= )(?:{pattern})(?= )") for label, keywords, rank, confidence, pattern in SIGNATURES]
    return sorted(written + [(label, keyword, rank, confidence, f"(?<= )(?:{form.format(n=name, i=ident)})(?= )")
            for rank, (confidence, form) in enumerate(FORMS) for label, keyword, name, ident in FAMILIES], key=lambda rule: rule[2])


def normalised(text: Column) -> Column:
    """Words in lower case with one space before, between and after them; empty without words."""
    body = F.trim(F.regexp_replace(F.lower(text), SEPARATORS, " "))
    return F.when(body == "", F.lit("")).otherwise(F.concat(F.lit(" "), body, F.lit(" ")))


def _spans(text: Column, pattern: Column) -> Column:
    """(start, end) of all matches."""
    def step(at: Column, r: Column) -> tuple[Column, Column, Column]:
        return at + r["gap"] + r["n"], F.lit(True), F.struct((at + r["gap"]).alias("start"), (at + r["gap"] + r["n"]).alias("end"))

    return scanned(matches(text, pattern), F.lit(0), step, "array<struct<start:int,end:int>>")


DETECTION = "array<struct<start:int,end:int,rank:int,label:string,confidence:double>>"


def detections(text: Column) -> Column:
    """All matches of all rules that have a keyword in the text; the array is empty for other documents."""
    by_words: dict[str, list] = {}
    for label, keywords, rank, confidence, pattern in rules():
        by_words.setdefault(keywords, []).append(F.struct(
            F.lit(rank).alias("rank"), F.lit(label).alias("label"), F.lit(confidence).alias("confidence"), F.lit(pattern).alias("pattern")))
    table = F.array(*[F.struct(F.array(*[F.lit(f" {word} ") for word in words.split("|")]).alias("keywords"), F.array(*own).alias("rules"))
                      for words, own in by_words.items()])
    of_rule = lambda r: F.transform(_spans(text, r["pattern"]), lambda s: F.struct(
        s["start"], s["end"], r["rank"], r["label"], r["confidence"]))
    present = F.filter(table, lambda f: F.exists(f["keywords"], lambda k: F.contains(text, k)))
    matching = F.flatten(F.transform(present, lambda f: F.filter(f["rules"], lambda r: F.rlike(text, r["pattern"]))))
    gate = F.lit(" (?:" + "|".join(sorted({word for words in by_words for word in words.split("|")})) + ") ")
    return F.when(F.rlike(text, gate), F.flatten(F.transform(matching, of_rule)).cast(DETECTION)).otherwise(F.array().cast(DETECTION))


def surviving(found: Column) -> Column:
    """Drop detections that a longer one, or an equally long one of better rank, contains.

    Sorted by start, then longest first, then rank, a detection is contained exactly if the largest end so
    far reaches its own.
    """
    ordered = F.array_sort(F.transform(found, lambda d: F.struct(
        d["start"].alias("start"), (-d["end"]).alias("back"), d["rank"].alias("rank"), d["label"].alias("label"), d["confidence"].alias("confidence"))))
    def step(reach: Column, d: Column) -> tuple[Column, Column, Column]:
        end = -d["back"]
        return F.greatest(reach, end), end > reach, F.struct(d["start"].alias("start"), end.alias("end"), *[d[c].alias(c) for c in ("rank", "label", "confidence")])

    return scanned(ordered, F.lit(-1), step, DETECTION)


def scan(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns plus normalised words, base counts and the surviving detections of every row."""
    out = docs.select(*keep, normalised(whole()).alias("words"))
    out = out.withColumn("n_words", F.greatest(spaces(F.col("words")) - 1, F.lit(0)).cast("bigint"))
    lookaround = "(?<= ){}(?= )"
    for k, (phrase, _) in enumerate(BASE):
        out = out.withColumn(f"_p{k}", F.when(F.contains("words", F.lit(f" {phrase} ")), F.split("words", lookaround.format(phrase), -1)))
    pieces = [F.col(f"_p{k}") for k in range(len(BASE))]
    counts = [F.coalesce(F.size(p) - 1, F.lit(0)) for p in pieces]
    first = [spaces(p[0]) - 1 for p in pieces]
    last = [spaces(F.col("words")) - 1 - spaces(F.element_at(p, -1)) - phrase.count(" ") for p, (phrase, _) in zip(pieces, BASE)]
    labels = F.array_compact(F.array(*[F.when(p.isNotNull(), F.lit(label)) for p, (_, label) in zip(pieces, BASE)]))
    return out.select(
        *keep, "n_words", sum(counts[1:], counts[0]).cast("bigint").alias("n_base"),
        F.least(*first).cast("bigint").alias("first_word"), F.greatest(*last).cast("bigint").alias("last_word"),
        labels.alias("base"), surviving(detections(F.col("words"))).alias("detections"))


def license_rows(docs: DataFrame) -> DataFrame:
    """One row per document with the digest columns of the query."""
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    own = F.transform("detections", lambda d: d["label"])
    return scan(docs, "doc_id").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", joined(F.col("base")).alias("base_labels"),
        joined(F.concat("base", own)).alias("labels"),
        F.coalesce(F.array_max(F.transform("detections", lambda d: d["confidence"])), F.lit(0.0)).alias("score"))

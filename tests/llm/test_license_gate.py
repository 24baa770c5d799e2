"""License rules on texts that hold only the identifier or only the name of a family."""

import re

from cohortwise.llm import license_scan

SCHEMA = "doc_id bigint, text string"


def literals(pattern):
    """All texts of a pattern made of words, alternatives, optional parts and [sc]."""
    group = re.search(r"\(\?:([^()]*)\)(\??)", pattern)
    if group:
        choices = group[1].split("|") + ([""] if group[2] else [])
        return [t for c in choices for t in literals(pattern[:group.start()] + c + pattern[group.end():])]
    return [pattern.replace("[sc]", "c").replace(" ?", " "), pattern.replace("[sc]", "s").replace(" ?", "")]


def test_every_name_and_identifier_passes_its_gate():
    for label, keywords, name, ident in license_scan.FAMILIES:
        for text in literals(name) + literals(ident):
            assert re.fullmatch(f"{name}|{ident}", text)
            assert any(f" {k} " in f" {text} " for k in keywords.split("|")), (label, text)


def test_rules_on_identifiers_alone(spark):
    forms = ("SPDX-License-Identifier: {}", "licensed under the {}", "distributed under {}", "released under the terms of the {}", "available under {}", "under {}")
    asked = [(label, form.format(ident)) for label, _, _, ident in license_scan.FAMILIES for form in forms]
    asked += [(label, f"terms of the {literals(name)[0]}") for label, _, name, _ in license_scan.FAMILIES]
    asked += [("gpl", "SPDX-License-Identifier: GPL-2.0-only"), ("lgpl", "licensed under the LGPL 2.1"), ("mpl", "released under the MPL 2.0")]
    docs = spark.createDataFrame([(k, text) for k, (_, text) in enumerate(asked)], SCHEMA)
    got = {r.doc_id: r for r in license_scan.license_rows(docs).collect()}
    assert [a for k, a in enumerate(asked) if a[0] not in got[k].labels.split(",") or got[k].score == 0] == []


BODIES = [
    ("mit", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software")'),
    ("bsd", "Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following conditions are met:"),
    ("bsd-3-clause", "Neither the name of the Example Corp. nor the names of its contributors may be used to endorse or promote products derived from this software"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("gpl", "GPLv3"), ("apache", "Apache-2.0"), ("lgpl", "LGPL-2.1-or-later"), ("cc-by-nc-sa", "https://creativecommons.org/licenses/by-nc-sa/4.0/"),
]


def test_license_bodies_and_short_identifiers(spark):
    texts = [t for _, t in BODIES] + ["under the MIT umbrella", "released under MIT", "a permission granted for redistribution of fonts"]
    got = {r.doc_id: r for r in license_scan.license_rows(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()}
    assert [(label, got[k].labels) for k, (label, _) in enumerate(BODIES) if label not in got[k].labels.split(",") or got[k].score < 0.7] == []
    assert [got[len(BODIES) + k].labels for k in range(3)] == ["", "mit", ""]


def test_every_signature_holds_a_keyword():
    for label, keywords, _, _, pattern in license_scan.SIGNATURES:
        fixed = re.sub(r"\(\?:[^()]*\)\??", " ", pattern)
        assert any(re.search(rf"\b{k[:3]}", fixed + pattern) for k in keywords.split("|")), (label, keywords)


def test_surviving_detections_equal_pairwise_comparison(spark):
    text = "gnu general public license version 2 or later licensed under the mit license mit license apache license 2 0 " * 40
    rows = license_scan.scan(spark.createDataFrame([(1, text)], SCHEMA), "doc_id").first().detections
    words = f" {text.strip()} "
    found = {(m.start(), m.end(), rank, label) for label, _, rank, _, pattern in license_scan.rules() for m in re.finditer(pattern, words)}
    inside = lambda a, b: b[0] <= a[0] and a[1] <= b[1] and ((a[0], a[1]) != (b[0], b[1]) or (b[2], b[3]) < (a[2], a[3]))
    assert {(d.start, d.end, d.rank, d.label) for d in rows} == {a for a in found if not any(inside(a, b) for b in found)}

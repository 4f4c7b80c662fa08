from __future__ import annotations

import os
import random
import re

import duckdb
import pytest

from tidebook.llm import licence_scan, queries

PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: The base columns, which SQL can express.
BASE_SQL = """WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
p(phrase, label) AS (VALUES (['gnu', 'general', 'public', 'license'], 'gpl'), (['apache', 'license'], 'apache'), (['cc', 'by'], 'cc-by'), (['mit', 'license'], 'mit')),
h AS (SELECT doc_id, label, i - 1 AS start FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w), p WHERE w[i : i + len(phrase) - 1] = phrase),
g AS (SELECT doc_id, COUNT(*) AS n, MIN(start) AS a, MAX(start) AS b, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM h GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, COALESCE(n, 0) AS n_base, a AS first_word, b AS last_word, COALESCE(labels, '') AS base_labels FROM w LEFT JOIN g USING (doc_id)"""


def plain(text):
    """The base by looking at every word."""
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    places = [(i, label) for i in range(len(words)) for phrase, label in PHRASES.items() if words[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({label for _, label in places}))


def test_base_matches_a_plain_search(spark, make, docs):
    rng = random.Random(3)
    pool = "gnu general public license apache license cc by mit license MIT License GNU-GENERAL a b é_x 9".split(" ")
    texts = ["".join(rng.choice(pool) + rng.choice([" ", "-", "\n", ", ", "\x00", "\t"]) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    texts += [None, "", " ", "mit license", "mit license", "MIT LICENSE mit", "ﬁ", "x" * 200_000 + " cc by " + "y " * 100_000 + "apache license", "ccby", "CC BY", "CC BY."]
    got = {r["doc_id"]: r for r in queries.op12_licence_scan(spark, make(documents=docs(texts))).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == plain(text), text
        labels = set(r["labels"].split(",")) - {""}
        assert set(r["base_labels"].split(",")) - {""} <= labels and 0 <= r["score"] <= 1 and bool(labels) == (r["score"] > 0)
        assert r["labels"] == ",".join(sorted(labels))


def test_base_matches_sql(spark):
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("needs the test tables")
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    cursor = duck.execute(BASE_SQL)
    names = [c[0] for c in cursor.description]
    got = queries.op12_licence_scan(spark, sf)
    assert sorted(map(str, map(tuple, got.select(names).collect()))) == sorted(map(str, cursor.fetchall()))


@pytest.mark.parametrize(
    ("text", "postfix", "kind", "labels"),
    [
        ("SPDX-License-Identifier: MIT", "mit", "permissive", ["mit"]),
        ("# SPDX-License-Identifier: MIT OR Apache-2.0 AND GPL-2.0-only\nimport mit", "mit apache gpl AND OR", "permissive", ["apache", "gpl", "mit"]),
        ("SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-only", "mit apache OR gpl AND", "copyleft", ["apache", "gpl", "mit"]),
        ("SPDX-License-Identifier: GPL-2.0-or-later WITH Classpath-exception-2.0 AND MIT", "gpl classpath-exception WITH mit AND", "weak", ["gpl", "mit"]),
        ("spdx-license-identifier: ((AGPL-3.0))", "agpl", "network", ["agpl"]),
        ("SPDX-License-Identifier: (MIT OR\n  BSD-3-Clause)", "mit bsd OR", "permissive", ["bsd", "mit"]),
        ("SPDX-License-Identifier: LicenseRef-Own AND MIT", "licenseref mit AND", "reserved", ["licenseref", "mit"]),
        ('{"license": "MIT/Apache-2.0", "files": []}', "mit apache OR", "permissive", ["apache", "mit"]),
        ("license = ISC and more", "isc", "permissive", ["isc"]),
        ("Licensed under either of the Apache License, Version 2.0 or\nthe MIT license at your option.", "apache mit OR", "permissive", ["apache", "mit"]),
        ("is released under the terms of the GNU General Public License, version 2 or (at your option) any later version.", "gpl", "copyleft", ["gpl"]),
        ("available under CC BY-NC-SA 4.0", "cc-by-nc-sa", "restricted", ["cc-by", "cc-by-nc-sa"]),
        ("License: MIT or whatever", "mit", "permissive", ["mit"]),
    ],
)
def test_expressions(text, postfix, kind, labels):
    _, _, _, expressions, found, score = licence_scan.scan(text)
    assert [(e["postfix"], e["class"]) for e in expressions] == [(postfix, kind)] and found == labels and score >= 0.8


@pytest.mark.parametrize("text", ["", "Er kam mit dem Bus.", "the license plate", "License: see the file", "mit", "licensed under. MIT", "isc and bsd", "a licence for fishing"])
def test_what_names_no_licence(text):
    assert licence_scan.scan(text)[4:] == ([], 0.0)


def test_names_and_notices():
    text = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"
    assert licence_scan.scan(text)[4] == ["mit"] and licence_scan.scan(text)[5] == pytest.approx(0.9)
    places = licence_scan.scan("creative commons attribution noncommercial sharealike")[2]
    assert [p["label"] for p in places] == ["cc-by-nc-sa"]


def test_evaluation_against_truth_tables():
    """An expression's class is the mildest way of meeting it: over every choice at its ors, the strictest licence needed."""
    rng = random.Random(8)
    ids = {"MIT": "permissive", "GPL-3.0": "copyleft", "MPL-2.0": "weak", "CC0-1.0": "public", "AGPL-3.0": "network"}

    def make(depth):
        if depth == 0 or rng.random() < 0.3:
            name = rng.choice(list(ids))
            return name, [licence_scan.CLASSES.index(ids[name])]
        (a, x), (b, y) = make(depth - 1), make(depth - 1)
        if rng.random() < 0.5:
            return f"({a} OR {b})", x + y
        return f"({a} AND {b})", [max(p, q) for p in x for q in y]

    for _ in range(300):
        text, ways = make(3)
        expressions = licence_scan.scan(f"SPDX-License-Identifier: {text}")[3]
        assert expressions[0]["class"] == licence_scan.CLASSES[min(ways)], text


def test_ids_empty_tables_and_clashing_columns(spark):
    rows = spark.createDataFrame([("a", "MIT License", "x", 1), (None, None, "y", 2), ("a", "MIT License", "z", 3)], "doc_id string, text string, labels string, _text int")
    got = licence_scan.find_licences(rows).collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["None", "a", "a"] and [r["labels"] for r in got if r["doc_id"]] == [["mit"], ["mit"]]
    assert licence_scan.find_licences(rows.limit(0)).collect() == []

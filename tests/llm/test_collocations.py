from __future__ import annotations

import random
import re
import tracemalloc
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tidebook.llm import collocations, queries


def plain(rows, least=10, longest=3, top=2_000):
    """The contract word by word, with Python's own numbers."""
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        candidates = {p: c for p, c in counts.items() if len(p) > 1 and c >= least}
        kept = []
        for p, a in candidates.items():
            if any(len(q) > len(p) and 100 * b >= 50 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in candidates.items()):
                continue
            score, _, l, r = min((1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(kept)[:top])]
    return sorted(out)


COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def rows_of(df):
    return sorted(tuple(r) for r in df.select(COLUMNS).collect())


def some_texts(seed, n):
    rng = random.Random(seed)
    words = ["a", "b", "C", "dé", "ê", "f\x00", "日本", "The", "the", "x-y", "z'"]
    texts = []
    for _ in range(n):
        text = "".join(rng.choices(words, weights=[9, 7, 5, 5, 3, 2, 2, 9, 9, 1, 1])[0] + rng.choice([" ", " ", " ", "  ", "\t", ". ", ", ", "\n", "\x0b", "!?", " \x00 "]) for _ in range(rng.randint(0, 60)))
        texts.append((text, rng.choice(["en", "en", "en", "de", None])))
    return texts


@pytest.mark.parametrize("n", [0, 1, 120])
def test_matches_a_plain_count(spark, make, n):
    texts = some_texts(n, n) + ([(None, "en"), ("", "xx"), ("...", "yy"), ("a b " * 30, "en"), ("a b " * 30, "en")] if n else [])
    rows = [(i, t, lang, None, None) for i, (t, lang) in enumerate(texts)]
    d = make(documents=rows)
    got = rows_of(queries.op13_collocations(spark, d))
    assert got == plain(texts) and bool(got) == (n > 0)
    if n:
        duck = duckdb.connect()
        duck.execute(f"create view documents as select * from '{d}/documents.parquet/*.parquet'")
        cursor = duck.execute(queries.PHRASES_SQL)
        assert sorted(tuple(r[[c[0] for c in cursor.description].index(k)] for k in COLUMNS) for r in cursor.fetchall()) == got


@pytest.mark.parametrize(("cells", "depth"), [(1 << 12, 1), (1 << 12, 2), (1 << 16, 4)])
def test_no_width_loses_a_phrase(spark, cells, depth):
    """A sketch that is far too narrow lets everything pass, and changes nothing."""
    texts = some_texts(5, 150) + [(" ".join(f"w{i * 7 % 900}" for i in range(s, s + 400)), "en") for s in range(0, 4_000, 11)]
    docs = spark.createDataFrame([(t, lang, "clash", 1) for t, lang in texts], "text string, lang string, phrase string, words int").repartition(7)
    assert rows_of(collocations.mine(docs, least=4, most_cells=cells, depth=depth)) == plain(texts, least=4)


def test_longer_phrases_and_top(spark):
    texts = [("one two three four five, one two three four", "en")] * 6 + some_texts(2, 40)
    docs = spark.createDataFrame(texts, "text string, lang string")
    assert rows_of(collocations.mine(docs, least=5, longest=5)) == plain(texts, least=5, longest=5)
    assert rows_of(collocations.mine(docs, least=2, top=3)) == plain(texts, least=2, top=3)


def test_a_very_long_text(spark):
    text = "alpha beta gamma " * 400_000
    got = rows_of(collocations.mine(spark.createDataFrame([(text, "en")], "text string, lang string")))
    assert [(r[2], r[3], r[6]) for r in got] == [("alpha beta gamma", 400_000, 1_200_000), ("beta gamma alpha", 399_999, 1_200_000), ("gamma alpha beta", 399_999, 1_200_000)]


def test_scores_past_64_bits(spark):
    big = 3 * 10**12
    counts = spark.createDataFrame([("en", "a b", 2, big), ("en", "a", 1, big + 7), ("en", "b", 1, 2 * big + 1)], "lang string, phrase string, words int, f long")
    row = collocations.scored(counts).collect()[0]
    assert row["score"] == 1_000_000 * big * big // ((big + 7) * (2 * big + 1)) and (row["l"], row["r"]) == (big + 7, 2 * big + 1)


def test_estimates_are_never_too_low():
    texts = pa.array(["a b a b c a", "c c c c", None, "a. b a"])
    grams = collocations.Grams(texts, pa.array(["x", "x", "x", None]), 3)
    assert grams.words.to_pylist() == ["a", "b", "c"] and grams.reach.tolist() == [3, 3, 3, 3, 2, 1, 3, 3, 2, 1, 1, 2, 1]
    h = grams.hashes(3)
    assert h[0][0] == h[0][2] != h[0][10] and h[1][0] == h[1][2] and h[2][6] == h[2][7]
    kind = collocations.kind_of(10)
    table = np.zeros(1 << 12, kind)
    for _ in range(40):
        at, n = np.unique(collocations.cells(h[0], 0, 12), return_counts=True)
        table[at] = np.minimum(table[at] + np.minimum(n, 10).astype(kind), 10)
    assert table.max() == 10 and (table[collocations.cells(h[0], 0, 12)] == 10).all()


def test_a_slice_is_tallied_in_little_memory():
    """All lengths' hashes at once, beside those of the slice before, took 35 bytes a byte of text; it is 24 now."""
    rng = np.random.default_rng(1)
    words = rng.integers(0, 30_000, 150_000).astype(str)
    batch = pa.RecordBatch.from_arrays([pa.array([" ".join(words)]), pa.array(["en"])], names=["text", "lang"])
    table = np.zeros((2, 1 << 16), np.uint8)
    collocations.tally(table, batch, 16, 10, 3)
    once = table.copy()
    tracemalloc.start()
    for _ in range(2):
        collocations.tally(table, batch, 16, 10, 3)
    held, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert held < 1 << 20 and peak < 30 * batch.nbytes and (table >= once).all() and table.max() == 10

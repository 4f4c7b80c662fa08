from __future__ import annotations

import random
import re

import numpy as np

from tidebook.llm import near_dedup, queries


def plain(rows):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for i, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    part = {i: i for i in sets}

    def root(x):
        while part[x] != x:
            x = part[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            s, t = sets[a], sets[b]
            if s and t and 100 * len(s & t) >= 75 * len(s | t):
                x, y = root(a), root(b)
                part[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def corpus(seed, n):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6)))
    base = [[word() for _ in range(rng.randint(1, 120))] for _ in range(n)]
    texts = []
    for words in base:
        texts.append(" ".join(words))
        for _ in range(rng.randint(0, 4)):
            copy = list(words)
            for _ in range(rng.randint(0, max(1, len(copy) // 25))):
                copy[rng.randrange(len(copy))] = word()
            texts.append(rng.choice(["  ", "\n"]).join(copy).upper() if rng.random() < 0.3 else " ".join(copy))
    return texts


def test_matches_brute_force(spark, make, docs):
    rows = docs([None, "", " \t\n", "one", "one", "ONE two", "one two", "a b c d e", "A B C D E", "ü Ü", *corpus(5, 60)])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.op9_near_dedup(spark, make(documents=rows)).collect()}
    assert got == plain(rows)


def test_one_group_of_near_copies(spark, make, docs):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(100)]
    texts = []
    for _ in range(120):
        copy = list(words)
        for _ in range(rng.randint(0, 6)):
            copy[rng.randrange(100)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    rows = docs(texts + texts[:30])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.op9_near_dedup(spark, make(documents=rows)).collect()}
    assert got == plain(rows)


def test_empty_table(spark, make):
    assert queries.op9_near_dedup(spark, make(documents=[])).count() == 0


def test_repeated_rows_and_clashing_columns(spark):
    rows = [(1, "a b c d e f g", 9), (1, "a b c d e f g", 9), (2, "a b c d e f g", 9), (3, None, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, node int")
    got = sorted((r["doc_id"], r["component_id"]) for r in near_dedup.near_duplicates(df).collect())
    assert got == [(1, 1), (1, 1), (2, 1), (3, 3)]


def test_signature_estimates_similarity():
    rng = np.random.default_rng(0)
    both = rng.integers(0, 1 << 63, 600).astype(np.uint64)
    a, b = np.unique(np.append(both, rng.integers(0, 1 << 63, 100).astype(np.uint64))), np.unique(np.append(both, rng.integers(0, 1 << 63, 100).astype(np.uint64)))
    est = (near_dedup.signature(a, 1200) == near_dedup.signature(b, 1200)).mean()
    assert abs(est - 600 / 800) < 0.06


def test_components_of_a_long_path(spark):
    nodes = [bytes([i]) for i in range(40)]
    links = spark.createDataFrame(list(zip(nodes[1:], nodes)), "a binary, b binary")
    got = {bytes(r["node"]): bytes(r["component"]) for r in near_dedup.components(links).collect()}
    assert got == {n: nodes[0] for n in nodes}


def test_rows_without_an_id_link_with_nothing(spark):
    text = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(None, text, "n"), (5, text, "n"), (None, text + " x", "n"), (3, text + " y", "n")], "doc_id long, text string, node string")
    got = sorted((r["doc_id"] or 0, r["component_id"] or 0, r["n_shingles"]) for r in near_dedup.near_duplicates(df).collect())
    assert got == [(0, 0, 36), (0, 0, 37), (3, 3, 37), (5, 3, 36)]

from __future__ import annotations

import hashlib
import math
import os
import random

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from tidebook.llm import queries, vector_codes


def lloyd(rows, parts=4, entries=256, rounds=4, scale=1024):
    """(id -> (codes, error), codebooks) by adding everything anew in every round, in Python's own numbers."""
    whole = [(i, [math.floor(scale * x) for x in v]) for i, v in sorted(rows)]
    width = len(whole[0][1]) // parts
    cut = {i: [v[p * width : (p + 1) * width] for p in range(parts)] for i, v in whole}
    books = [[cut[i][p] for i, _ in whole[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            met: dict[int, list] = {}
            for i, _ in whole:
                met.setdefault(nearest(cut[i][p], books[p])[1], []).append(cut[i][p])
            for e, xs in met.items():
                books[p][e] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    final = {i: [nearest(cut[i][p], books[p]) for p in range(parts)] for i, _ in whole}
    digest = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    return {i: ("".join(f"{e:02x}" for _, e in f), sum(d for d, _ in f)) for i, f in final.items()}, digest


@pytest.mark.parametrize(("n", "scale"), [(700, 1.0), (300, 90_000.0), (40, 1.0)])
def test_codes_are_those_of_plain_lloyd(spark, make, n, scale):
    rng = random.Random(n)
    middles = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(9)]
    rows = [(i * 3, [np.float32(scale * (m + rng.gauss(0, 0.2))).item() for m in middles[i % 9]], None if i % 5 == 0 else i % 3) for i in range(n)]
    rows += [(3 * n + i, rows[0][1], 7) for i in range(n // 3)]  # a crowd of equal vectors
    rng.shuffle(rows)
    want, digest = lloyd([(i, v) for i, v, _ in rows])
    got = queries.op11_vector_codes(spark, make(embeddings=rows)).collect()
    assert {r["vec_id"]: (r["code"], r["error"]) for r in got} == want and len(got) == len(rows)
    by_label: dict = {}
    for i, _, label in rows:
        by_label[label] = by_label.get(label, 0) + want[i][1]
    labels = {i: label for i, _, label in rows}
    assert all(r["label_error"] == by_label[labels[r["vec_id"]]] and r["codebooks_sha256"] == digest for r in got)


def test_odd_vectors(spark, make):
    good = [(i, [float(i), 1.0, -2.0, 0.25], i % 2) for i in range(20)]
    odd = [(100, None, 1), (101, [1.0, None, 0.0, 0.0], 1), (102, [float("nan"), 0.0, 0.0, 0.0], 1), (103, [float("inf"), 0.0, 0.0, 0.0], 1)]
    stay = [(104, [1.0, 2.0], 1), (105, [], 0), (106, [3e30, 0.0, 0.0, 0.0], 0), (None, [0.5, 0.5, 0.5, 0.5], None), (3, [3.0, 1.0, -2.0, 0.25], 1)]
    got = queries.op11_vector_codes(spark, make(embeddings=good + odd + stay)).collect()
    assert sorted(-1 if r["vec_id"] is None else r["vec_id"] for r in got) == sorted([i for i, *_ in good] + [104, 105, 106, -1, 3])
    assert all((r["code"] is None) == (r["vec_id"] in (104, 105, 106)) == (r["error"] is None) for r in got)
    assert len({r["code"] for r in got if r["vec_id"] == 3}) == 1


@pytest.mark.parametrize("rows", [[], [(1, None, 1)], [(1, [1.0, 2.0, 3.0], 1)]])
def test_few_rows(spark, make, rows):
    got = queries.op11_vector_codes(spark, make(embeddings=rows)).collect()
    assert [(r["vec_id"], r["code"]) for r in got] == ([(1, None)] if rows and rows[0][1] else [])


def test_clashing_columns_and_text_ids(spark):
    rows = [(f"v{i:03d}", [float(i % 7), float(i % 5)], "x", "y") for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id string, embedding array<double>, kind string, v string")
    coded, books = vector_codes.encode(df, parts=2, entries=4)
    want, digest = lloyd([(i, v) for i, v, *_ in rows], parts=2, entries=4)
    assert {r["id"]: "".join(f"{c:02x}" for c in r["codes"]) for r in coded.collect()} == {i: c for i, (c, _) in want.items()}
    assert books.digest() == digest


def test_only_changes_are_sent(spark):
    """The second kind of rows holds what moved: nothing at all once the assignments stand still."""
    rows = spark.createDataFrame([(i, [float(i % 2 * 50), 0.0, 0.0, 0.0]) for i in range(64)], "vec_id long, embedding array<float>")
    used = vector_codes.usable(rows, "embedding", "vec_id", None)
    state, books = vector_codes.fit(used, 4, entries=2, rounds=2)
    later = vector_codes.delta_round(state, books, 4, 1024, True)
    assert later.where("kind = 1").count() == 0 and later.where("kind = 0").count() == 64


def test_nearest_is_exact_beyond_doubles():
    x = np.array([[2**40 + 1, 0], [2**40, 0]], np.int64)
    entries = np.array([[2**40, 0], [2**40 + 1, 0], [2**40, 0]], np.int64)
    index, square = vector_codes.nearest(x, entries)
    assert index.tolist() == [1, 0] and square.tolist() == [0, 0]


def test_oracle_on_a_fixture(spark, make):
    rng = random.Random(5)
    d = make(embeddings=[(i, [rng.gauss(0, 0.3) for _ in range(8)], i % 4 or None) for i in range(330)])
    duck = duckdb.connect()
    duck.execute(f"create view embeddings as select * from '{d}/embeddings.parquet/*.parquet'")
    cursor = duck.execute(queries.codes_sql())
    names = [c[0] for c in cursor.description]
    got = queries.op11_vector_codes(spark, d)
    assert sorted(map(tuple, got.select(names).collect())) == sorted(cursor.fetchall())


def test_oracle_on_the_smallest_tables(spark):
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("needs the test tables")
    assert set(entry.oracle_sql()) >= {"op1_suffix_dedup", "op9_near_dedup", "op11_vector_codes", "op13_collocations"}
    duck = duckdb.connect()
    duck.execute(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    cursor = duck.execute(queries.vector_oracle_sql()["op11_vector_codes"])
    names = [c[0] for c in cursor.description]
    got = queries.op11_vector_codes(spark, sf)
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(tuple, got.select(names).collect())) == sorted(cursor.fetchall())

from __future__ import annotations

import os
import random
import shutil
from concurrent.futures import ThreadPoolExecutor

import corpus_pipeline
import duckdb
import pytest
from tokenizers import Tokenizer

from tidebook.llm import common, decontaminate, near_dedup, queries, secret_scan


@pytest.fixture
def folder(make, docs):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    say = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(i, " ".join(say(15))) for i in range(4)]
    texts, labels = [], []
    for i in range(160):
        body, bad = say(rng.randint(10, 60)), i % 4 == 0
        if i % 11 == 5:
            body += ["token", "=", "04dbebab91ab85687d33eeaaf9ac699e1188f962"]
        if i % 13 == 6:
            body += [items[i % 4][1]]
        texts.append(" ".join(w + "###" if bad else w for w in body))
        labels.append((i, 0 if bad else 1, 0))
    texts += [texts[1] + " more", texts[3], None, ""]
    return make(documents=docs(texts), labels=labels, benchmark=items), texts, items


def test_rows_match_a_plain_version(spark, folder):
    d, texts, items = folder
    good = {r["doc_id"] for r in queries.op2_quality(spark, d).collect() if r["predicted"]}
    left = {i: t for i, t in enumerate(texts) if i in good}
    sets = {i: set(near_dedup.shingles(t).tolist()) for i, t in left.items()}
    part = {i: i for i in left}

    def root(x):
        return x if part[x] == x else root(part[x])

    for a in left:
        for b in left:
            if b < a and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                part[max(x, y)] = min(x, y)
    left = {i: t for i, t in left.items() if root(i) == i}
    index = decontaminate.Items([(i, decontaminate.normal(t)) for i, t in items])
    left = {i: t for i, t in left.items() if not decontaminate.search([t], index)[0]}
    left = {i: secret_scan.redact(t) for i, t in left.items()}
    t = Tokenizer.from_file(queries.VOCABULARY)
    want = {i: t.encode(x or "", add_special_tokens=False).ids for i, x in left.items()}
    got = {r["doc_id"]: list(r["token_ids"]) for r in corpus_pipeline.run(spark, d).collect()}
    assert got == want and 60 < len(got) < 130


def test_stages_keep_the_columns(spark, folder):
    d, _, _ = folder
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes


def test_empty_documents(spark, make):
    d = make(documents=[], labels=[(1, 0, 0), (2, 1, 0)], benchmark=[(1, "x" * 80)])
    assert corpus_pipeline.run(spark, d).count() == 0


def test_oracle_sql_of_operators(spark):
    """The operators that SQL can express, on the smallest tables."""
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("needs the test tables")
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    for name, sql in queries.oracle_sql().items():
        df = queries.queries()[name](spark, sf)
        columns = sorted(df.columns)
        found = duck.execute(sql)
        names = [d[0] for d in found.description]
        assert sorted(names) == columns
        assert sorted(map(tuple, df.select(columns).collect())) == sorted(tuple(r[names.index(c)] for c in columns) for r in found.fetchall()), name


def test_scratch_tables_go_and_the_result_stays(spark, tmp_path):
    with common.scratch(spark):
        one = common.cut_lineage(spark.range(10))
        gone = one.inputFiles()[0].removeprefix("file://")
        two = common.cut_lineage(one.where("id > 4"))
    assert two.count() == 5 and not os.path.exists(gone)
    common.remove(two)
    outside = tmp_path / "kept.parquet"
    spark.range(3).write.parquet(str(outside))
    common.remove(spark.read.parquet(str(outside)))  # an input is never deleted
    assert spark.read.parquet(str(outside)).count() == 3


def test_the_input_stays_whatever_its_folder_is_called(spark, folder, tmp_path):
    d, _, _ = folder
    inside = tmp_path / "tidebook-data" / "tidebook-x"
    shutil.copytree(d, inside, ignore=shutil.ignore_patterns("tidebook-*"))
    files = {f: f.stat().st_size for f in inside.rglob("*.parquet") if f.is_file()}
    assert corpus_pipeline.run(spark, str(inside)).count() > 0
    assert {f: f.stat().st_size for f in inside.rglob("*.parquet") if f.is_file()} == files
    mine = common.cut_lineage(spark.range(3))
    common.remove(spark.read.parquet(f"{inside}/documents.parquet"))
    common.remove(mine)
    assert files.keys() == {f for f in inside.rglob("*.parquet") if f.is_file()}
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist|No such file"):
        mine.count()


def test_tables_of_another_thread_stay(spark):
    def own():
        with common.scratch(spark):
            return common.cut_lineage(spark.range(4))

    with common.scratch(spark):
        first = common.cut_lineage(spark.range(7))
        with ThreadPoolExecutor(1) as pool:
            other = pool.submit(own).result()
        assert first.count() == 7
        common.cut_lineage(spark.range(1))
    assert other.count() == 4

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tidebook.llm import common, language_model, quality, queries, toxicity

WORDS = "the of and to in that is was for on with as it by from at have this not are".split()


def held(i, m, r):
    return zlib.crc32(str(i).encode()) % m == r


@pytest.fixture
def labelled(docs):
    rng = random.Random(0)
    say = lambda n: [rng.choice(WORDS) + rng.choice(["", "ing", "ed", "s"]) for _ in range(n)]
    texts, labels = [], []
    for i in range(400):
        words = say(rng.randint(5, 60))
        bad, toxic = rng.random() < 0.35, rng.random() < 0.3
        if toxic:
            for _ in range(rng.randint(2, 5)):
                words.insert(rng.randrange(len(words)), rng.choice(["grobnard", "grobnik", "vilewort"]) + rng.choice(["", ".", ","]))
        if bad:
            words = [w + rng.choice(["###", "$$$"]) for w in words]
        texts.append(" ".join(words))
        labels.append((i, 0 if bad else 1, 1 if toxic else 0))
    return docs([*texts, None, "", " "]), labels


@pytest.mark.parametrize(("name", "target", "cut"), [("op2_quality", 1, 0.5), ("op3_toxicity", 2, 0.7)])
def test_held_out_accuracy(spark, make, labelled, name, target, cut):
    rows, labels = labelled
    got = {r["doc_id"]: r for r in queries.queries()[name](spark, make(documents=rows, labels=labels)).collect()}
    assert len(got) == len(rows)
    out = [(got[x[0]]["predicted"], x[target]) for x in labels if held(x[0], 3, 1)]
    assert sum(a == b for a, b in out) / len(out) > 0.95
    for i, r in got.items():
        assert r["held_out"] == held(i, 3, 1) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= cut)
    assert got[400]["score"] == got[401]["score"] == got[402]["score"]


@pytest.mark.parametrize("name", ["op2_quality", "op3_toxicity"])
def test_held_out_labels_change_nothing(spark, make, labelled, name):
    rows, labels = labelled
    first = {r["doc_id"]: r["score"] for r in queries.queries()[name](spark, make(documents=rows, labels=labels)).collect()}
    turned = [(i, 1 - q, 1 - t) if held(i, 3, 1) else (i, q, t) for i, q, t in labels]
    again = {r["doc_id"]: r["score"] for r in queries.queries()[name](spark, make(documents=rows, labels=turned)).collect()}
    assert all(abs(first[i] - again[i]) < 1e-9 for i in first)


@pytest.mark.parametrize("labels", [[], [(0, 1, 1), (2, 1, 1)], [(0, None, None)]])
@pytest.mark.parametrize("name", ["op2_quality", "op3_toxicity"])
def test_labels_of_one_class_or_none(spark, make, docs, labels, name):
    d = make(documents=docs(["a b", None, "c"]), labels=labels)
    assert len({r["score"] for r in queries.queries()[name](spark, d).collect()}) == 1


@pytest.mark.parametrize("name", ["op2_quality", "op3_toxicity", "op7_language_model"])
def test_empty_documents(spark, make, name):
    assert queries.queries()[name](spark, make(documents=[], labels=[(1, 0, 1), (2, 1, 0)])).count() == 0


def test_dual_descent_separates():
    rng = np.random.default_rng(0)
    rows = [np.unique(np.append(rng.integers(0, 50, 8), 60 + y)).astype(np.int32) for y in (0, 1) * 40]
    y = np.array([0, 1] * 40)
    model = quality.fit(rows, y)
    score = model.score(np.array([model.margin(r) for r in rows]))
    assert ((score > 0.5) == (y == 1)).all()


def grammar(**stems):
    return toxicity.Model({k: (toxicity.INSULT, w) for k, w in (stems or {"grob": 3.0}).items()} | {"blok": (toxicity.EPITHET, 2.0)}, toxicity.PRIOR.tolist(), [0, 0, 0])


def weight(text):
    return sum(w for *_, w in grammar().clauses(text))


def test_grammar_scores_clauses():
    assert weight("the weather is fine") == 0
    assert weight("you are a grobnard") > weight("a grobnard walks by") > 0
    assert weight("you are not a grobnard") < weight("you are a grobnard")
    assert 0 < weight("he said you are a grobnard") < weight("you are a grobnard")
    assert weight("i will kill you") > 0 and weight("kill the lights") == 0 and weight("kill. you") == 0
    assert weight("you idle. a grobnard") == weight("a grobnard")
    assert len(grammar().clauses("grobnard. grobnard! fine; grobnard")) == 3
    assert grammar().clauses(None) == [] and grammar().clauses("") == []


def test_epithets_and_menaces_need_a_person():
    assert weight("a blok walks by") == 0 and weight("you blok") == weight("blok he is") == 3.0
    assert weight("not you blok") < weight("you blok")
    assert weight("killing them") == weight("he destroys you") == weight("ich zerstörte dich") == weight("il la frappait, vous") == weight("i will kill you")
    assert weight("skill you") == weight("kills time") == 0
    assert weight("never kill him") < weight("kill him")


def test_machine_equals_a_scorer_of_paths():
    """The composed machine against the rules read off word by word, looking back and ahead."""
    t = toxicity
    rng = random.Random(9)
    kinds = [0, 0, 0, t.INSULT, t.EPITHET, t.MENACE, t.PERSON, t.DENIAL, t.REPORT]
    model = grammar()
    for _ in range(3_000):
        read = [(k, float(rng.randint(1, 5)) if k & (t.INSULT | t.EPITHET) else 0.0) for k in rng.choices(kinds, k=rng.randint(1, 14))]
        want = np.zeros(t.ARCS)

        def near(i, kind, span):
            return any(read[j][0] & kind for j in range(max(0, i - span), i))

        def marks(i):
            return near(i, t.DENIAL, t.REACH), near(i, t.REPORT, len(read))

        def add(own, insult, aimed, threat, i):
            denied, told = marks(i)
            want[:] += own * np.array([insult, aimed and not denied and not told, threat, denied, told])

        for i, (k, own) in enumerate(read):
            aimed = near(i, t.PERSON, t.NEAR)
            if k & t.INSULT or (k & t.EPITHET and aimed):
                add(own, 1, aimed, 0, i)
            if not k & t.PERSON:
                continue
            # the latest insult before, not aimed and with no person between, and the same of a menace
            last = next((j for j in range(i - 1, max(i - t.NEAR, 0) - 1, -1) if read[j][0] & (t.INSULT | t.EPITHET | t.PERSON)), None)
            if last is not None and not read[last][0] & t.PERSON and not near(last, t.PERSON, t.NEAR):
                if read[last][0] & t.INSULT:
                    want[1] += read[last][1] * (not any(marks(last)))
                else:
                    add(read[last][1], 1, 1, 0, last)
            last = next((j for j in range(i - 1, max(i - t.NEAR, 0) - 1, -1) if read[j][0] & (t.MENACE | t.PERSON)), None)
            if last is not None and read[last][0] & t.MENACE:
                add(1.0, 0, 0, 1, last)
        assert np.allclose(model.clause(read), want)


def test_labels_that_only_the_grammar_tells_apart(spark, make, docs):
    """The same words are in clean documents: there without a person, denied or reported."""
    rng = random.Random(3)
    fill = lambda n: [rng.choice(WORDS[:6]) + str(rng.randrange(300)) for _ in range(n)]
    texts, labels = [], []
    for i in range(600):
        toxic = i % 2
        word = rng.choice(["zorg", "quibnik"])
        core = [["you", word], [word, *fill(1), "you"]] if toxic else [[word], ["you", "are", "not", word], ["alleged", "x", "you", word]]
        texts.append(" ".join([*fill(rng.randint(6, 12)), *(["."] if rng.random() < 0.5 else []), *fill(5), *rng.choice(core), ".", *fill(6)]))
        labels.append((i, 1, toxic))
    d = make(documents=docs(texts), labels=labels)
    got = {r["doc_id"]: r["predicted"] for r in queries.op3_toxicity(spark, d).collect()}
    out = [got[i] == y for i, _, y in labels if held(i, 3, 1)]
    assert sum(out) / len(out) > 0.97
    model = toxicity.train(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"))
    of = lambda text: sum(w for *_, w in model.clauses(text))
    assert of("you zorg") > 2 * of("a zorg") and of("you not zorg") < of("you zorg") / 2
    blind = toxicity.Model({s: (toxicity.INSULT, w) for s, (_, w) in model.stems.items()}, [1.0, 0.0, 0.0, 0.0, 0.0], model.curve)
    out = [(blind.score(texts[i]) >= 0.7) == y for i, _, y in labels if held(i, 3, 1)]
    assert sum(out) / len(out) < 0.7


def test_odd_rows_and_columns(spark):
    rows = [("a", "you grob " * 3, 1.0, 2.0)] * 3 + [("b", None, 1.0, 2.0), ("c", "grob. " + "fine words " * 100_000, 1.0, 2.0)]
    table = spark.createDataFrame(rows, "doc_id string, text string, toxic_score double, quality_score double")
    model = grammar()
    model.curve = [-2.0, 1.0, 1.0]
    got = toxicity.score(table, model)
    assert got.columns == ["doc_id", "text", "quality_score", "toxic_score", "toxic_clauses"]
    score = {r["doc_id"]: r["toxic_score"] for r in got.collect()}
    assert score["a"] > score["c"] > score["b"] and got.count() == 5
    labels = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0)], "doc_id string, quality int")
    learnt = quality.train(table, labels)
    got = quality.score(table, learnt)
    assert got.columns == ["doc_id", "text", "toxic_score", "quality_score"] and got.count() == 5
    assert len({r["quality_score"] for r in got.where("doc_id = 'a'").collect()}) == 1


def test_whole_word_stems():
    model = grammar(**{"ass ": 2.0})
    assert model.clauses("an ass") and not model.clauses("an assembly")


def test_base_counts_are_exact(spark, make, docs):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(80)]
    texts = [None, "", "  ", "A\x0bB\x85C", *[" ".join(rng.choices(words, k=rng.randint(1, 200))).title() for _ in range(120)], "w" * 5000]
    rows = docs(texts)
    got = {r["doc_id"]: r for r in queries.op7_language_model(spark, make(documents=rows)).collect()}
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    toks = {i: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower)) for i, t, *_ in rows}
    count = Counter(w for i in toks if not held(i, 7, 2) for w in toks[i])
    ends = sum(not held(i, 7, 2) for i in toks)
    total, distinct = sum(count.values()) + ends, len(count) + 1
    log = lambda c: math.log10((c + 1) / (total + distinct + 1))
    for i, w in toks.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(i, 7, 2), len(w) + 1, sum(x in count for x in w) + 1, total)
        assert r["base_score"] == pytest.approx(sum(log(count[x]) for x in w) + log(ends), rel=1e-9)
        assert r["score"] < 0
    assert sum(r["score"] for r in got.values()) > sum(r["base_score"] for r in got.values())


def test_many_homes_give_the_same_base(spark, make, docs):
    rows = docs([" ".join(WORDS[k % 20 :] + WORDS[: k % 7]) for k in range(60)])
    df = spark.read.parquet(f"{make(documents=rows)}/documents.parquet")
    one, many = ({r["doc_id"]: (r["n_known"], round(r["base_score"], 9)) for r in language_model.score(df, common.crc_mod("doc_id", 7) == 2, home_bytes=n).collect()} for n in (1 << 20, 300))
    assert one == many


def test_spelling_is_a_distribution():
    words = [b"the", b"then", b"there", b"a", b"an", b"and"] * 3
    symbols, context, begins = language_model.spell(words)
    cells, n = np.unique(context.astype(np.int64) * language_model.SYMBOLS + symbols, return_counts=True)
    model = language_model.Spelling(cells, n.astype(float), 0)
    for shown in model.shown:
        assert np.allclose(shown.sum(axis=1), 1, atol=1e-4)
    p = 10 ** model.log10([b"the", b"zqx", b""])
    assert p[0] > 50 * p[1] > 0


def test_seating_keeps_its_bounds():
    c = np.array([0.0, 1, 2, 5, 100, 10_000])
    t = language_model.seat(c, np.full(6, 0.5), 0.5, np.random.default_rng(0))
    assert t[0] == 0 and t[1] == 1 and (t <= c).all() and (t[1:] >= 1).all()


def test_short_words_equal_a_plain_reading():
    rng = random.Random(4)
    texts = ["".join(rng.choice("aB é\x0b\n\x00cd") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    words, of = language_model.short_words([t.encode() for t in texts])
    got = [((w >> 3).to_bytes(4, "big")[: w & 7], int(i) - 1) for w, i in zip(words.tolist(), of, strict=True)]
    assert got == [(w, i) for i, t in enumerate(texts) for w in t.encode().lower().split() if len(w) <= 4]
    assert len(language_model.short_words([])[0]) == 0


def test_restaurants_of_preceding_words_are_distributions():
    """A bucket's restaurants: what the dishes keep and what the parent gets add up to one; one context alone equals the formula."""
    rng = np.random.default_rng(5)
    context = np.sort(rng.integers(0, 40, 600))
    counts = rng.integers(1, 9, 600).astype(float)
    own, left = language_model.seat_pairs(context, rng.integers(0, 50, 600).astype(np.uint32), counts, 40, 1)
    assert np.allclose(np.bincount(context, weights=own, minlength=40) + left, 1)
    own, left = language_model.seat_pairs(np.array([0, 0]), np.array([1, 2], np.uint32), np.array([1.0, 1.0]), 1, 0)
    d = language_model.discount_of(2, 0)
    assert np.allclose(own, (1 - d) / (language_model.PAIR_STRENGTH + 2)) and np.allclose(left, (language_model.PAIR_STRENGTH + 2 * d) / (language_model.PAIR_STRENGTH + 2))


def test_scores_equal_a_plain_sum_over_tokens(spark, make, docs, monkeypatch):
    """Texts of one context class and words that occur once: the model's formula token by token, given its own parent probabilities."""
    rng = random.Random(6)
    words = [f"longword{i}" for i in range(400)]
    texts = [" ".join(rng.sample(words, 60)) for _ in range(40)] * 2
    rows = docs([*texts, "longword1 unseenword"])
    got = {r["doc_id"]: r for r in queries.op7_language_model(spark, make(documents=rows)).collect()}
    # a copy of a training text is far likelier than the same words in another order
    inside = [i for i in range(40) if not held(i, 7, 2) and held(i + 40, 7, 2)]
    other = [" ".join(rng.sample(t.split(), 60)) for t in texts[:40]]
    d = make(documents=[*rows, *docs(other, 100)])
    again = {r["doc_id"]: r for r in queries.op7_language_model(spark, d).collect()}
    mixed = [i for i in range(100, 140) if held(i, 7, 2)]
    assert inside and mixed
    assert min(again[i + 40]["score"] for i in inside) > max(again[i]["score"] for i in mixed) + 20
    assert all(r["perplexity"] == pytest.approx(10 ** (-r["score"] / r["n_tokens"])) for r in got.values())


def test_language_model_odd_rows_and_columns(spark):
    rows = [("a", "one two three", 1, "w")] * 3 + [("b", None, 1, "w"), (None, "x " * 100_000, 1, "w")]
    df = spark.createDataFrame(rows, "doc_id string, text string, home int, words string")
    got = language_model.score(df, common.crc_mod("doc_id", 7) == 2).collect()
    assert len(got) == 5 and len({r["score"] for r in got if r["doc_id"] == "a"}) == 1
    assert {r["n_tokens"] for r in got} == {4, 1, 100_001}
    nothing = language_model.score(df, common.crc_mod("doc_id", 7) >= 0).where("doc_id = 'b'").collect()  # all held out but the row without an id
    assert nothing[0]["held_out"] and nothing[0]["n_known"] == 1
    every = spark.createDataFrame([("a", "one two", True)], "doc_id string, text string, h boolean")
    from pyspark.sql import functions as F

    assert language_model.score(every, F.col("h")).collect()[0]["base_score"] == 0

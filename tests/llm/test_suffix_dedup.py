from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from tidebook.llm import queries, suffix_dedup


def plain(rows):
    """Brute force over all 50-byte strings."""
    out, seen = {}, {}
    data = [(i, (t or "").encode()) for i, t, *_ in rows]
    for i, b in data:
        for p in range(len(b) - 49):
            key = b[p : p + 50]
            seen[key] = min(seen.get(key, i), i)
    for i, b in data:
        hit = bytearray(len(b))
        for p in range(len(b) - 49):
            if seen[b[p : p + 50]] < i:
                hit[p : p + 50] = b"\x01" * 50
        kept = bytes(x for x, h in zip(b, hit) if not h)
        out[i] = (len(b), sum(hit), sum(1 for k in range(len(b)) if hit[k] and (k == 0 or not hit[k - 1])), hashlib.sha256(kept).hexdigest())
    return out


def passages(seed, n):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé ") for _ in range(rng.randint(2, 9))) for _ in range(60)]
    say = lambda k: " ".join(rng.choice(words) for _ in range(k))
    shared = [say(rng.randint(5, 40)) for _ in range(6)]
    texts = []
    for _ in range(n):
        parts = [say(rng.randint(0, 20))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(shared), say(rng.randint(0, 10))]
        texts.append("".join(parts))
    return texts


def test_matches_brute_force(spark, make, docs):
    rows = docs([None, "", "a" * 49, "a" * 50, "a" * 300, "b" + "a" * 120, *passages(1, 60), "x" * 5000, "x" * 4000 + "y" * 200])
    rows += [(1000 + i, r[1], *r[2:]) for i, r in enumerate(rows[6:20])]
    d = make(documents=rows)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in queries.op1_suffix_dedup(spark, d).collect()}
    assert got == plain(rows)


def test_many_homes(spark, docs, make):
    rows = docs(passages(2, 80))
    df = spark.read.parquet(f"{make(documents=rows)}/documents.parquet")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in suffix_dedup.remove_repeats(df, home_bytes=2_000).collect()}
    assert got == plain(rows)


def test_empty_table(spark, make):
    assert queries.op1_suffix_dedup(spark, make(documents=[])).count() == 0


def test_equal_ids_keep_their_bytes(spark):
    df = spark.createDataFrame([(1, "q" * 80), (1, "q" * 80), (2, "q" * 80)], "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_removed"]) for r in suffix_dedup.remove_repeats(df).collect())
    assert got == [(1, 0), (1, 0), (2, 80)]


@pytest.mark.parametrize("seed", range(5))
def test_sort_finds_all_equal_windows(seed):
    rng = random.Random(seed)
    text = "".join(rng.choice("ab") for _ in range(40)) * 8 + "".join(rng.choice("abcd") for _ in range(300))
    text = text.encode() + text.encode()[50:250]
    starts = np.arange(len(text) - 49)
    want = {}
    for p in starts.tolist():
        want.setdefault(text[p : p + 50], []).append(p)
    got = [sorted(x) for x in suffix_dedup.equal_windows(text, starts)]
    assert sorted(got) == sorted(v for v in want.values() if len(v) > 1)
    order = [text[x[0] : x[0] + 50] for x in got]
    assert order == sorted(order)


@pytest.mark.parametrize("together", [1, 4, 10_000])
def test_three_way_split_gives_the_same_groups(together):
    rng = np.random.default_rng(together)
    text = rng.integers(97, 99, 3_000).astype(np.uint8)
    text = np.concatenate([text, text[500:1_500], np.zeros(50, np.uint8)])
    starts = rng.permutation(3_900)
    got = [sorted(g.tolist()) for g in suffix_dedup.shallow_sort(text, starts, together=together)]
    want = {}
    for p in starts.tolist():
        want.setdefault(text[p : p + suffix_dedup.SHALLOW].tobytes(), []).append(p)
    assert got == [sorted(want[k]) for k in sorted(want) if len(want[k]) > 1]


@pytest.mark.parametrize("bits", [0, 4, 64])
def test_equal_strings_do_not_rest_on_their_hash(bits, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "COMPARED", 64)
    rng = np.random.default_rng(bits)
    text = rng.integers(97, 100, 4_000).astype(np.uint8)
    begin, length = rng.integers(0, 3_900, 900), rng.integers(1, 6, 900)
    hashes = suffix_dedup.string_hashes(text, begin, length) & np.uint64((1 << bits) - 1)
    first, where = suffix_dedup.same_strings(text, begin, length, hashes)
    of = [text[b : b + n].tobytes() for b, n in zip(begin, length, strict=True)]
    assert all(of[first[c]] == s for c, s in zip(where, of, strict=True)) and len({of[f] for f in first}) == len(first) == len(set(of))


def test_windows_of_hot_anchors(spark, docs, make, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT_RUNS", 2)
    rows = docs([*passages(4, 50), *["x" * 200 + t for t in passages(5, 20)]])
    df = spark.read.parquet(f"{make(documents=rows)}/documents.parquet")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in suffix_dedup.remove_repeats(df, home_bytes=3_000).collect()}
    assert got == plain(rows)


def test_texts_longer_than_a_chunk_and_clashing_columns(spark):
    rng = random.Random(8)
    long = "".join(rng.choice("abcdefgh") for _ in range(suffix_dedup.CHUNK + 5_000))
    part = long[suffix_dedup.CHUNK // 2 - 300 : suffix_dedup.CHUNK // 2 + 300]
    rows = [(1, long, 7, "m"), (2, "q" + part + "q", 7, "m"), (3, long, 7, "m"), (None, part, 7, "m")]
    df = spark.createDataFrame(rows, "doc_id long, text string, home int, mask string")
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffix_dedup.remove_repeats(df).collect()}
    assert got == {1: (0, 0, long.encode()), 2: (600, 1, b"qq"), 3: (len(long), 1, b""), None: (600, 1, b"")}

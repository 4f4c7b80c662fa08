"""Phrase collocation mining: merged count-min sketches first, exact counts of the survivors second.

Texts are split into pieces at punctuation and pieces into words; a phrase is a run of words of one piece.  In the first pass
every task counts all its phrases of up to ``longest`` words into a count-min sketch, and the sketches are merged block by
block.  A sketch never counts too little, so a phrase whose estimate is below ``least`` is rare for certain.  In the
second pass only the others are counted exactly, added up in each task before they are shuffled: nothing frequent is lost,
whatever the sketch's width.  A phrase also goes if a shorter one inside it is rare.  Cells stop at ``least``, so one byte holds them.

A candidate is cut after each of its words; the cut with the lowest score, a*a / (l*r) in millionths, counts.  The
counts l and r of the two sides are looked up in the table of frequent phrases, to which both sides belong.  A candidate that
stands in a longer one at least half as often goes.

Contract.  Null and empty texts have no words.  A null language is ``und``.  Repeated rows count once each.  Ties: the lowest score after
flooring at the smallest cut; equal scores by the count, then by the phrase's bytes.  Texts of any length are read whole; one
text and ``SLICE`` bytes of others are held at a time.  No document: no rows.  Other columns, whatever their names, are not
read.  Arithmetic is in whole numbers of 38 digits.

Width.  The sketch has ``DEPTH`` rows of as many cells as the text has eighths of a byte, a power of two and ``MOST_CELLS`` at most: that
many bytes are broadcast.  Beyond about 8 bytes of text a cell it lets more rare phrases pass to the second pass, which then
shuffles more; raise ``most_cells`` as executors allow.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebook.llm import common

LEAST, LONGEST, TOP, SUBSUMED = 10, 3, 2_000, 50
DEPTH, MOST_CELLS, BLOCK = 2, 1 << 25, 4_096
#: Text of a slice, and of a task that sketches, in bytes.
SLICE, TASK = 2 << 20, 4 << 30

#: Odd multipliers of the sketch's rows, and of the words of a phrase.
ROWS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)
STEP = np.uint64(0xFF51AFD7ED558CCD)

#: 0 in a word, 1 between words, 2 between pieces; and A-Z in lower case.
CLASS = np.zeros(256, np.uint8)
CLASS[[0x20, 0x09]] = 1
CLASS[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = 2
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Grams:
    """The words of some texts, in order: dictionary numbers, languages, and how far a phrase may reach from each."""

    def __init__(self, texts: pa.Array, langs: pa.Array, longest: int):
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        ends = offsets - offsets[0]
        kind = CLASS[data]
        inside = kind == 0
        # a word begins where a word's byte follows another kind, or a text begins
        first = np.zeros(len(data) + 1, bool)
        first[ends[:-1]] = True
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | first[1:-1]
        starts = np.flatnonzero(begins)
        self.n = len(starts)
        text = np.searchsorted(ends, starts, "right") - 1
        piece = np.cumsum(kind == 2)[starts] if self.n else np.zeros(0, np.int64)
        joined = (np.diff(piece) == 0) & (np.diff(text) == 0)
        # reach[i]: words from i on that are in its piece, up to ``longest``
        self.reach = np.ones(self.n, np.int64)
        for k in range(1, longest):
            on = np.zeros(self.n, bool)
            if self.n > k:
                on[:-k] = joined[: self.n - k]
                for j in range(1, k):
                    on[:-k] &= joined[j : self.n - k + j]
            self.reach += on
        lengths = np.add.reduceat(inside, starts, dtype=np.int64) if self.n else np.zeros(0, np.int64)
        at = np.concatenate(([0], np.cumsum(lengths)))
        letters = pa.LargeStringArray.from_buffers(self.n, pa.py_buffer(at), pa.py_buffer(LOWER[data[inside]].tobytes())).dictionary_encode()
        self.words = letters.dictionary
        tongue = pc.fill_null(langs.cast(pa.string()), "und").dictionary_encode()
        self.langs = tongue.dictionary
        self.lang = tongue.indices.to_numpy(zero_copy_only=False)[text]
        self.word = letters.indices.to_numpy(zero_copy_only=False)

    def hashes(self, longest: int) -> list[np.ndarray]:
        return list(self.each_hash(longest))

    def each_hash(self, longest: int) -> Iterator[np.ndarray]:
        """For each length, the hash of the phrase of that length that begins at each word, whether or not it reaches so far."""
        own = np.fromiter((xxhash.xxh64_intdigest(w) for w in self.words.to_pylist()), np.uint64, len(self.words))[self.word]
        tongue = np.fromiter((xxhash.xxh64_intdigest(w, 1) for w in self.langs.to_pylist()), np.uint64, len(self.langs))[self.lang]
        h = mixed(own ^ tongue)
        del tongue
        yield h
        for k in range(1, longest):
            rest = np.zeros(self.n, np.uint64)
            rest[: max(self.n - k, 0)] = own[k:]
            h = mixed(h * STEP + rest)
            yield h


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * STEP
    return h ^ (h >> np.uint64(29))


def cells(h: np.ndarray, row: int, bits: int) -> np.ndarray:
    return ((h * np.uint64(ROWS[row])) >> np.uint64(64 - bits)).astype(np.uint32)


def slices(batches: Iterator[pa.RecordBatch], limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds ``limit`` bytes of text, or one text."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(0)), 0).to_numpy(zero_copy_only=False)
        upto = np.cumsum(size)
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def kind_of(least: int) -> np.dtype:
    """Cells that hold two counts of up to ``least`` added."""
    return np.dtype(np.uint8 if least < 128 else np.uint16 if least < 1 << 15 else np.uint32)


def tally(table: np.ndarray, batch: pa.RecordBatch, bits: int, least: int, longest: int) -> None:
    """Adds the phrases of some texts to a sketch, one length after the other; nothing of them is held on return."""
    grams = Grams(batch.column(0), batch.column(1), longest)
    for k, h in enumerate(grams.each_hash(longest) if grams.n else ()):
        h = h[grams.reach > k]
        for row in range(len(table)):
            at, n = np.unique(cells(h, row, bits), return_counts=True)
            table[row, at] = np.minimum(table[row, at] + np.minimum(n, least).astype(table.dtype), least)


def sketch(rows: DataFrame, bits: int, least: int, longest: int, depth: int) -> DataFrame:
    """row, block, cells: the merged sketch of all phrases."""
    kind, block = kind_of(least), min(BLOCK, 1 << bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None
        for batch in slices(batches):
            if table is None:
                table = np.zeros((depth, 1 << bits), kind)
            tally(table, batch, bits, least, longest)
        if table is not None:
            blocks = table.reshape(depth, -1, block)
            for row in range(depth):
                used = np.flatnonzero(blocks[row].any(1))
                for at in range(0, len(used), 1_024):
                    some = used[at : at + 1_024]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), row, np.int32)), pa.array(some.astype(np.int32)), pa.array([blocks[row, b].tobytes() for b in some], pa.binary())], names=["row", "block", "cells"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, None

        def out():
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["row", "block", "cells"])

        for batch in batches:
            for row, at, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                new = np.frombuffer(values.as_buffer(), kind)
                if key == (row, at):
                    total = np.minimum(total + new, least).astype(kind)
                    continue
                if key is not None:
                    yield out()
                key, total = (row, at), new
        if key is not None:
            yield out()

    schema = "row int, block int, cells binary"
    return rows.mapInArrow(count, schema).repartition(common.parts(rows.sparkSession), "row", "block").sortWithinPartitions("row", "block").mapInArrow(merge, schema)


def frequent(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, depth: int = DEPTH, most_cells: int = MOST_CELLS) -> DataFrame:
    """lang, phrase, words, f: every phrase of up to ``longest`` words that occurs ``least`` times; and each language's count of words, with a null phrase and words = 0."""
    spark = docs.sparkSession
    rows = docs.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    size = rows.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    bits = max(12, min(most_cells.bit_length() - 1, (size // 8).bit_length()))
    tasks = max(spark.sparkContext.defaultParallelism, -(-size // TASK))
    table = np.zeros((depth, 1 << bits), kind_of(least))
    width = min(BLOCK, 1 << bits)
    for r in sketch(rows.coalesce(tasks), bits, least, longest, depth).toLocalIterator():  # depth x most_cells bytes at most
        table[r["row"], r["block"] * width : (r["block"] + 1) * width] = np.frombuffer(r["cells"], table.dtype)
    shared = spark.sparkContext.broadcast(table)
    del table

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        estimates = shared.value
        for batch in slices(batches):
            yield from exact(Grams(batch.column(0), batch.column(1), longest), estimates, bits, least, longest)

    counted = rows.mapInArrow(count, "lang string, phrase string, words int, c long")
    total = counted.groupBy("lang", "phrase", "words").agg(F.sum("c").alias("f"))
    kept = common.cut_lineage(total.where((F.col("f") >= least) | (F.col("words") == 0)))
    shared.destroy()  # the counts are written; executors would hold the sketch as long as the session
    return kept


def exact(grams: Grams, estimates: np.ndarray, bits: int, least: int, longest: int) -> Iterator[pa.RecordBatch]:
    """Exact counts in these texts of the phrases that the sketch lets pass."""
    if not grams.n:
        return
    size = len(grams.langs)
    n = np.bincount(grams.lang, minlength=size)
    yield out_batch(grams.langs.take(pa.array(np.flatnonzero(n))), pa.nulls(int((n > 0).sum()), pa.string()), 0, n[n > 0])
    # (language, word) pairs by number: phrases of such numbers are told apart exactly
    own, unit = np.unique(grams.word.astype(np.int64) * size + grams.lang, return_inverse=True)
    known, names = unit, None
    alive = None
    for k, h in enumerate(grams.each_hash(longest)):
        ok = grams.reach > k
        for row in range(len(estimates)):
            at = np.flatnonzero(ok)
            ok[at] = estimates[row][cells(h[at], row, bits)] >= least
        if alive is not None:  # both phrases that are one word shorter pass too
            ok[:-1] &= alive[:-1] & alive[1:]
            ok[-1] = False
        alive = ok
        at = np.flatnonzero(ok)
        if k == 0:
            keys, dense, c = np.unique(unit[at], return_inverse=True, return_counts=True)
            names = grams.words.take(pa.array(own[keys] // size))
            tongue = own[keys] % size
        else:
            # the phrase one word shorter and the word after it
            pairs = known[at] * np.int64(len(own)) + unit[at + k]
            keys, dense, c = np.unique(pairs, return_inverse=True, return_counts=True)
            before, last = keys // len(own), keys % len(own)
            names = pc.binary_join_element_wise(names.take(pa.array(before)), grams.words.take(pa.array(own[last] // size)), pa.scalar(" ", pa.large_string()))
            tongue = tongue[before]
        known = np.zeros(grams.n, np.int64)
        known[at] = dense
        if len(keys):
            yield out_batch(grams.langs.take(pa.array(tongue)), names, k + 1, c)


def out_batch(langs: pa.Array, phrases: pa.Array, words: int, c: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([langs.cast(pa.string()), phrases.cast(pa.string()), pa.array(np.full(len(c), words, np.int32)), pa.array(c.astype(np.int64))], names=["lang", "phrase", "words", "c"])


def scored(counts: DataFrame, longest: int = LONGEST) -> DataFrame:
    """lang, phrase, words, a, l, r, score of every candidate, by its worst cut."""
    found = counts.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    cuts = F.filter(F.transform(F.sequence(F.lit(1), F.lit(longest - 1)), lambda k: F.struct(k.alias("k"))), lambda x: x["k"] < F.col("words"))
    sides = found.withColumn("k", F.explode(F.transform(cuts, lambda x: x["k"])))
    left = F.array_join(F.slice("w", F.lit(1), F.col("k")), " ")
    right = F.array_join(F.slice("w", F.col("k") + 1, F.col("words") - F.col("k")), " ")
    asked = sides.select("lang", "phrase", "words", "a", "k", F.explode(F.array(F.struct(F.lit(True).alias("first"), left.alias("side")), F.struct(F.lit(False).alias("first"), right.alias("side")))).alias("s"))
    asked = common.cut_lineage(asked.select("lang", "phrase", "words", "a", "k", "s.first", "s.side"))
    answers = common.lookup(asked, counts.where("words > 0").select("lang", F.col("phrase").alias("side"), "f"), ["lang", "side"])
    side = lambda k, first: F.max(F.when((F.col("k") == k) & (F.col("first") == first), F.col("f")))
    whole = answers.groupBy("lang", "phrase", "words", "a").agg(*(side(k, first).alias(f"{'l' if first else 'r'}{k}") for k in range(1, longest) for first in (True, False)))
    big = lambda c: F.col(c).cast("decimal(19,0)")
    for k in range(1, longest):
        whole = whole.withColumn(f"_n{k}", F.lit(1_000_000).cast("decimal(7,0)") * big("a") * big("a")).withColumn(f"_d{k}", big(f"l{k}") * big(f"r{k}"))
    options = F.array(*(F.when(F.col(f"l{k}").isNotNull(), F.struct(F.expr(f"_n{k} div _d{k}").alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))) for k in range(1, longest)))
    return whole.withColumn("best", F.array_min(F.array_compact(options))).select("lang", "phrase", "words", "a", "best.l", "best.r", "best.score")


def subsumed(found: DataFrame, percent: int = SUBSUMED, longest: int = LONGEST) -> DataFrame:
    """Candidates that no longer candidate holds in ``percent`` or more of their places."""
    w = F.split("phrase", " ")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.greatest(F.col("words") - 1, F.lit(2))), lambda m: F.transform(F.sequence(F.lit(1), F.greatest(F.col("words") - m + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, m), " "))))
    longer = found.where("words > 2").select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), F.col("a").alias("b")).groupBy("lang", "phrase").agg(F.max("b").alias("b"))
    return found.join(longer, ["lang", "phrase"], "left").where(F.col("b").isNull() | (100 * F.col("b") < percent * F.col("a"))).drop("b")


def best(found: DataFrame, top: int = TOP, salts: int = 16) -> DataFrame:
    """The first ``top`` of each language by score, count and phrase, with their ``rank``; a language's rows are ranked in ``salts`` groups first."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    few = found.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
    few = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).where(F.col("rank") <= top).drop("rank", "_salt")
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)


def mine(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, top: int = TOP, **widths) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score."""
    counts = frequent(docs, text, lang, least, longest, **widths)
    found = common.cut_lineage(scored(counts, longest))
    n = counts.where("words = 0").select("lang", F.col("f").alias("n"))
    return best(subsumed(found, longest=longest), top).join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

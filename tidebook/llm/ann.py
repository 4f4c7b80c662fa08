"""Approximate nearest neighbours by a permutation index.

Every vector is described by the order of its ``ORDER`` nearest pivots.  Pivot inverted files post the vector
under each of them with the pivot's rank; a search reads the files of the query's own nearest pivots and sums the
footrule distance of both orders (a pivot that one side lacks counts as one past the last rank).  The
``SHARE`` of each block of entries that ranks best is measured exactly, with all that tie with the last of them.

Orders say little inside a crowd of near-equal vectors.  So an entry within half the usual distance of its nearest pivot
is a crowd's, and is measured too unless the triangle inequality over that pivot rules it out: none of these is lost.

The pivots are ``PIVOTS`` vectors that stand apart, from a bounded sample (``SAMPLE`` vectors, the head of a hash order), so
that a crowd of near-equal vectors can't take up the orders; every vector is indexed.  The
queries are a stated set: they go to the tasks in blocks of ``QUERIES`` at most, against all entries.
Vectors that are equal in every component are one entry, so a very common vector has one posting; its
ids are put back after the search.

Vectors that are null, empty, zero, of another length than most, or hold null or non-finite components take
no part.  Without vectors or queries the result is empty.  Ties go to the smaller id; repeated rows of
one id are one row.  Columns besides the id and the vector are left out.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebook.llm import common

#: Vectors to choose pivots from, pivots, and how many of them are in a vector's order.
SAMPLE, PIVOTS, ORDER = 4_096, 256, 64
#: Of the entries of a block, the share that is measured; ``LEAST`` at least.
SHARE, LEAST = 0.12, 400
#: Entries of a block, and queries that are broadcast at once.
BLOCK, QUERIES = 16_384, 4_096


def usable(vectors: DataFrame, id_column: str, vector: str) -> DataFrame:
    """id, v (array of doubles) of the vectors that take part."""
    v = F.col("v")
    rows = vectors.select(vectors[id_column].cast("long").alias("id"), vectors[vector].cast("array<double>").alias("v")).where(F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.where(fine).withColumn("v", F.transform("v", lambda x: x + F.lit(0.0))).distinct()  # -0 becomes 0


def apart(sample: np.ndarray) -> tuple[np.ndarray, float]:
    """The first PIVOTS of the sample that are no nearer to an earlier one than half the usual distance; then others.  And that half."""
    square = (sample * sample).sum(axis=1)
    head = sample[:512]
    usual = np.median(np.maximum(square[:512, None] + square[None, :512] - 2 * head @ head.T, 0))
    free = np.ones(len(sample), bool)
    chosen: list[int] = []
    for i in range(len(sample)):
        if free[i] and len(chosen) < PIVOTS:
            chosen.append(i)
            free &= square + square[i] - 2 * sample @ sample[i] > usual / 4
    rest = sorted(set(range(len(sample))) - set(chosen))
    return sample[[*chosen, *rest[: PIVOTS - len(chosen)]]], float(np.sqrt(usual / 4))


def order_of(x: np.ndarray, pivots: np.ndarray, length: int) -> np.ndarray:
    """For each vector the numbers of its nearest pivots, nearest first."""
    far = (pivots * pivots).sum(axis=1)[None, :] - 2 * x @ pivots.T
    return np.argsort(far, axis=1, kind="stable")[:, :length].astype(np.int32)


class PivotFiles:
    """Inverted files of a block of entries: for each pivot the entries that have it in their order, with its rank."""

    def __init__(self, order: np.ndarray, pivots: int):
        n, self.length = order.shape
        by_pivot = np.argsort(order.ravel(), kind="stable")
        self.entry, self.rank = by_pivot // self.length, (by_pivot % self.length).astype(np.int32)
        self.first = np.searchsorted(order.ravel()[by_pivot], np.arange(pivots + 1))
        self.n = n

    def footrule(self, query: np.ndarray) -> np.ndarray:
        """Distance between the query's order and each entry's, up to a constant."""
        total = np.zeros(self.n, np.int32)
        for at, pivot in enumerate(query):
            rows = slice(self.first[pivot], self.first[pivot + 1])
            rank = self.rank[rows]
            # an entry stands once in a file; a shared pivot replaces two misses by the difference of ranks
            total[self.entry[rows]] += np.abs(rank - at) - (self.length - rank) - (self.length - at)
        return total


class Block:
    """A block of entries: its inverted files, and which of the entries are in crowds."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, pivots: np.ndarray, reach: float):
        self.ids, self.x, self.pivots = ids, x, pivots
        order = order_of(x, pivots, min(ORDER, len(pivots)))
        self.files = PivotFiles(order, len(pivots))
        self.home = order[:, 0]
        self.far = np.sqrt(((x - pivots[self.home]) ** 2).sum(axis=1))
        self.crowd = np.flatnonzero(self.far <= reach)

    def nearest(self, point: np.ndarray, order: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of the ``k`` nearest found."""
        n = len(self.ids)
        many = min(n, max(LEAST, k, int(SHARE * n)))
        near = np.arange(n)
        if many < n:
            rank = self.files.footrule(order)
            taken = rank <= np.partition(rank, many - 1)[many - 1]
            near = np.flatnonzero(taken)
        score = self.measure(near, point)
        if len(near) < n and len(self.crowd):
            last = np.partition(score, min(k, len(score)) - 1)[min(k, len(score)) - 1]
            to_pivot = np.sqrt(((self.pivots - point) ** 2).sum(axis=1))[self.home[self.crowd]]
            slack = 1e-9 * (to_pivot + self.far[self.crowd])  # for rounding
            more = self.crowd[~taken[self.crowd] & (np.abs(to_pivot - self.far[self.crowd]) <= last + slack)]
            near, score = np.append(near, more), np.append(score, self.measure(more, point))
        best = np.lexsort((self.ids[near], score))[:k]
        return self.ids[near[best]], score[best]

    def measure(self, rows: np.ndarray, point: np.ndarray) -> np.ndarray:
        return np.sqrt(((self.x[rows] - point) ** 2).sum(axis=1))


def search(entries: DataFrame, pivots: np.ndarray, reach: float, asks: list[tuple[int, list[float]]], k: int) -> DataFrame:
    """query, entry, score: of each block of entries the ``k`` nearest found for each query."""
    context = entries.sparkSession.sparkContext
    names = np.array([a for a, _ in asks], dtype=np.int64)
    points = np.array([v for _, v in asks], dtype=np.float64)
    length = min(ORDER, len(pivots))
    shared = context.broadcast((pivots, names, points, order_of(points, pivots, length)))

    def block(ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        p, who, q, orders = shared.value
        held = Block(ids, x, p, reach)
        out: tuple[list, list, list] = ([], [], [])
        for name, point, order in zip(who, q, orders, strict=True):
            near, score = held.nearest(point, order, k)
            out[0].append(np.full(len(near), name))
            out[1].append(near)
            out[2].append(score)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(out[0])), pa.array(np.concatenate(out[1])), pa.array(np.concatenate(out[2]))], ["query", "entry", "score"])

    def run(batches):
        ids, vectors, held = [], [], 0
        for batch in batches:
            ids.append(batch.column(0).to_numpy())
            vectors.append(batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1))
            held += batch.num_rows
            if held >= BLOCK:
                yield block(np.concatenate(ids), np.concatenate(vectors))
                ids, vectors, held = [], [], 0
        if held:
            yield block(np.concatenate(ids), np.concatenate(vectors))

    return entries.select("entry", "v").mapInArrow(run, "query long, entry long, score double")


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest other vectors found for each row that ``is_query`` (over ``id``) holds for."""
    spark = vectors.sparkSession
    rows = usable(vectors, id_column, vector)
    width = rows.groupBy(F.size("v").alias("w")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if width is None:
        return empty
    rows = rows.where(F.size("v") == width["w"])
    is_query = F.coalesce(is_query, F.lit(False))
    # equal vectors are one entry, named by their smallest id; of its ids only the k + 1 smallest can be answers, so a very common
    # vector sends k + 1 ids from each task
    first = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    member = rows.withColumn("place", first).where(F.col("place") <= k + 1).withColumn("entry", F.min("id").over(Window.partitionBy("v")))
    member = common.cut_lineage(member.select("v", "id", "entry", "place"))
    entries = member.where("place = 1").select("entry", "v")
    queries = common.cut_lineage(rows.where(is_query).join(entries, "v").select(F.col("id").alias("query_id"), F.col("entry").alias("query")))
    asks = entries.join(queries.select(F.col("query").alias("entry")).distinct(), "entry", "left_semi")
    number = asks.count()
    if not number:
        return empty
    pivots, reach = apart(np.array([r["v"] for r in entries.orderBy(F.xxhash64("entry"), "entry").limit(SAMPLE).collect()], dtype=np.float64))
    turns = -(-number // QUERIES)
    turn = F.pmod(F.xxhash64("entry"), F.lit(turns))
    # k + 1 entries, the query's own among them, hold at least k other ids
    found = [search(entries, pivots, reach, [(r["entry"], r["v"]) for r in asks.where(turn == t).collect()], k + 1) for t in range(turns)]
    near = Window.partitionBy("query").orderBy("score", "entry")
    top = functools.reduce(DataFrame.unionByName, found).withColumn("place", F.row_number().over(near)).where(F.col("place") <= k + 1).drop("place")
    last = Window.partitionBy("query_id").orderBy("score", "id")
    answers = queries.join(top, "query").join(member.select("id", "entry"), "entry").where("id <> query_id").withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k)
    return answers.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")

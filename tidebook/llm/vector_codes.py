"""Vector code compression: product codes by delta-maintained Lloyd rounds.

Components become whole numbers, vectors are cut into consecutive parts, and each part position has a codebook
of ``ENTRIES`` entries.  A round gives every part to its nearest entry and moves each entry to the floor of its
parts' mean.  The assignments of the round before are kept in the table, and so are the running whole-number
sums of every entry: a round sends through the exchange only what changed, a plus for the new entry and a minus
for the old one, added up inside each task first.  Sums are whole numbers, so they never drift and the
result is that of adding everything anew.

Contract.  Rows whose vector is null or holds null, NaN or infinite components are dropped.  The dimension is that
of most other rows (ties: the larger one, of those that divide into the parts); a vector of another length, or with a
component beyond the reach of 64-bit distances (``reach``), stays as a row whose code and error are null, and
takes no part in the codebooks.  Repeated ids are rows of their own; the first codebook takes the rows of the smallest ids (null ids
last, equal ids by their vectors).  Ties go to the lower entry; unused entries stay.  Fewer rows than entries: so many
entries.  No row at all: an empty result.  Other columns of the table, whatever their names, are not read.

Codebooks are ``PARTS`` x ``ENTRIES`` rows, bounded by these parameters and the dimension; only they and the running sums
reach the driver.
"""

from __future__ import annotations

import dataclasses
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.llm import common

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Rows measured against a codebook at a time.
BLOCK = 4_096


@dataclasses.dataclass
class Codebooks:
    """Entries (parts, entries, width) as whole numbers, with the running sums and counts of the parts given to each."""

    entries: np.ndarray
    sums: np.ndarray
    counts: np.ndarray

    @classmethod
    def of(cls, first: np.ndarray, parts: int) -> Codebooks:
        """From the first rows (entries, dimension)."""
        n, dimension = first.shape
        entries = np.ascontiguousarray(first.reshape(n, parts, dimension // parts).transpose(1, 0, 2))
        return cls(entries, np.zeros_like(entries), np.zeros(entries.shape[:2], np.int64))

    def add(self, part: int, entry: int, change: list[int], count: int) -> None:
        self.sums[part, entry] += np.array(change, np.int64)
        self.counts[part, entry] += count

    def move(self) -> None:
        """Every used entry to the floor of its mean."""
        used = self.counts > 0
        self.entries[used] = self.sums[used] // self.counts[used][:, None]

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def reach(dimension: int) -> int:
    """Largest whole component whose squared distances, summed over a vector, stay within 64 bits."""
    return math.isqrt((1 << 62) // max(dimension, 1)) // 2


def whole(vectors: pa.Array, dimension: int, scale: int) -> np.ndarray:
    """(rows, dimension) of floor(scale * x)."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(flat.reshape(len(vectors), dimension) * scale).astype(np.int64)


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the entry nearest to each row, the lowest index of equal ones; exact.

    While every product is a whole number below 2**53, doubles hold it exactly and a matrix product does the work.
    """
    n, width = x.shape
    if width == 0:
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    index, square = np.empty(n, np.int64), np.empty(n, np.int64)
    if 4 * width * most * most < 1 << 53:
        c = entries.astype(np.float64)
        norms = (c * c).sum(1)
        for at in range(0, n, BLOCK):
            y = x[at : at + BLOCK].astype(np.float64)
            d = norms - 2.0 * (y @ c.T)
            best = d.argmin(1)
            index[at : at + BLOCK] = best
            square[at : at + BLOCK] = (d[np.arange(len(y)), best] + (y * y).sum(1)).astype(np.int64)
        return index, square
    step = max(1, (1 << 20) // (len(entries) * width))
    for at in range(0, n, step):
        d = ((x[at : at + step, None, :] - entries[None]) ** 2).sum(2)
        index[at : at + step] = d.argmin(1)
        square[at : at + step] = d.min(1)
    return index, square


def usable(df: DataFrame, vector: str, id_column: str, label: str | None) -> DataFrame:
    """id, label, v (floats as they are, others as doubles): the rows whose vector is whole and finite."""
    v = F.col(vector) if df.schema[vector].dataType.simpleString() == "array<float>" else F.col(vector).cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.select(F.col(id_column).alias("id"), (F.col(label) if label else F.lit(None).cast("string")).alias("label"), v.alias("v"))
    return rows.where(F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(True)))


def delta_round(rows: DataFrame, books: Codebooks, dimension: int, scale: int, changes: bool) -> DataFrame:
    """Every row with its parts' nearest entries; with ``changes`` also what each task adds to and takes from the sums.

    kind 0: id, label, v, codes, error.  kind 1: part, entry, change, n, one row for each entry that a task touched.
    """
    entries = rows.sparkSession.sparkContext.broadcast(books.entries)
    parts, size, width = books.entries.shape
    own = {c: rows.schema[c].dataType.simpleString() for c in ("id", "label", "v")}
    schema = f"kind int, id {own['id']}, label {own['label']}, v {own['v']}, codes array<int>, error long, part int, entry int, change array<long>, n long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = entries.value
        sums, counts = np.zeros((parts * size, width), np.int64), np.zeros(parts * size, np.int64)
        touched, names, kinds = np.zeros(parts * size, bool), None, None
        for batch in batches:
            names, kinds = batch.schema.names, batch.schema.types
            n = batch.num_rows
            x = whole(batch.column(names.index("v")), dimension, scale).reshape(n, parts, width)
            codes, error = np.empty((n, parts), np.int32), np.zeros(n, np.int64)
            for p in range(parts):
                index, square = nearest(x[:, p], table[p])
                codes[:, p] = index
                error += square
            if changes:
                before = batch.column(names.index("codes"))
                known, old = before.is_valid().to_numpy(zero_copy_only=False), np.zeros((n, parts), np.int32)
                old[known] = before.flatten().to_numpy(zero_copy_only=False).reshape(-1, parts)
                for p in range(parts):
                    moved = ~known | (old[:, p] != codes[:, p])
                    gone = moved & known
                    for rows_, place, sign in ((moved, codes[moved, p], 1), (gone, old[gone, p], -1)):
                        place = place.astype(np.int64) + p * size
                        np.add.at(sums, place, sign * x[rows_, p])
                        np.add.at(counts, place, sign)
                        touched[place] = True
            none = lambda kind, m: pa.nulls(m, kind)
            packed = pa.ListArray.from_arrays(np.arange(0, (n + 1) * parts, parts, dtype=np.int32), codes.ravel())
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), *(batch.column(names.index(c)) for c in ("id", "label", "v")), packed, pa.array(error), none(pa.int32(), n), none(pa.int32(), n), none(pa.list_(pa.int64()), n), none(pa.int64(), n)], names=OUT)
        if changes and touched.any():
            at = np.flatnonzero(touched)
            m = len(at)
            mine = [kinds[names.index(c)] for c in ("id", "label", "v")]
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(m, np.int32)), *(pa.nulls(m, k) for k in mine), pa.nulls(m, pa.list_(pa.int32())), pa.nulls(m, pa.int64()), pa.array((at // size).astype(np.int32)), pa.array((at % size).astype(np.int32)), pa.array(sums[at].tolist(), pa.list_(pa.int64())), pa.array(counts[at])], names=OUT)

    return rows.mapInArrow(run, schema)


OUT = ["kind", "id", "label", "v", "codes", "error", "part", "entry", "change", "n"]


def fit(rows: DataFrame, dimension: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, Codebooks]:
    """(rows with the codes of the last round, codebooks after it) of usable rows of one dimension.

    Each round writes its assignments and its tasks' changes in one pass, as one table of two kinds; the changes alone are then
    grouped, and the table of the round before goes.
    """
    head = [r["v"] for r in rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()]
    books = Codebooks.of(np.floor(np.array(head, np.float64).reshape(len(head), dimension) * scale).astype(np.int64), parts)
    state, last = rows.withColumn("codes", F.lit(None).cast("array<int>")), None
    for _ in range(rounds):
        table = common.cut_lineage(delta_round(state, books, dimension, scale, True))
        sums = table.where("kind = 1").select("part", "entry", "n", F.posexplode("change").alias("place", "x")).groupBy("part", "entry", "place").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
        by_entry = sums.groupBy("part", "entry").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "x"))), lambda s: s["x"]).alias("change"), F.max("n").alias("n"))
        for r in by_entry.collect():  # parts x entries rows at most
            books.add(r["part"], r["entry"], r["change"], r["n"])
        books.move()
        state = table.where("kind = 0").select("id", "label", "v", "codes")
        if last is not None:
            common.remove(last)
        last = table
    return state, books


def encode(df: DataFrame, vector: str = "embedding", id_column: str = "vec_id", label: str | None = None, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, Codebooks | None]:
    """(id, label, codes (array of int, null for odd rows), error) of every usable row, and the final codebooks (None without rows)."""
    rows = usable(df, vector, id_column, label)
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).where((F.col("d") > 0) & (F.col("d") % parts == 0))
    common_one = sizes.orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    odd = lambda r: r.select("id", "label", F.lit(None).cast("array<int>").alias("codes"), F.lit(None).cast("long").alias("error"))
    if not common_one:
        return odd(rows), None
    dimension = common_one[0]["d"]
    fits = (F.size("v") == dimension) & F.forall("v", lambda x: F.abs(x.cast("double") * scale) < reach(dimension))
    good = rows.where(fits)
    if not good.head(1):
        return odd(rows), None
    state, books = fit(good, dimension, parts, entries, rounds, scale)
    done = delta_round(state, books, dimension, scale, False)
    coded = done.select("id", "label", "codes", "error")
    return coded.unionByName(odd(rows.where(~fits))), books


def totals_by_label(coded: DataFrame, value: str) -> DataFrame:
    """Adds ``total``: ``value`` summed over the rows with an equal label, nulls together; ``coded`` should be a written table."""
    key = F.when(F.col("label").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("label").cast("string")))
    rows = coded.withColumn("_key", key)
    return common.lookup(rows, rows.groupBy("_key").agg(F.sum(value).alias("total")), ["_key"]).drop("_key")

"""Near-duplicate documents by circulant MinHash, with every link confirmed on full shingle sets.

A document's set holds the hashes of its distinct five-word shingles (words split at ASCII white space,
A-Z lowered).  Two permutations make the whole signature: the first scatters the universe, the second
is shifted circularly once for each coordinate.  Signatures are cut into bands.

The work is arranged so that no group of copies, however large, meets in one task as pairs:

1. Equal sets are one node (copies never become pairs).
2. In each bucket of a band every node is checked against the bucket's smallest node only (a star).
3. Connected components of the confirmed links; buckets left with one component need nothing more.
4. In the other buckets members of different components are compared by signature, in blocks of bounded
   size and only where they first meet; likely ones are confirmed on full sets, until their components are one.

After step 4 every pair that shares a band is confirmed, ruled out by its signature or connected already,
so no link between components is lost to a cap.  With BANDS x ROWS = 30 x 4 a pair at the threshold misses
every band with a chance of 1e-5; its signature rules it out with one under 1e-6.

Null or empty texts, and texts without words, have an empty set and link with nothing; a text of fewer words
than a shingle has one, its whole sequence.  Texts of any length count whole.  Rows that repeat id and text get the same result; of texts
that tie the smallest id names the component.  Rows without an id link with nothing and have no component.  Other columns are left out; an
empty table gives an empty one.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.llm import common

WORDS, NUMERATOR, DENOMINATOR = 5, 75, 100
BANDS, ROWS = 30, 4
COORDINATES = BANDS * ROWS
#: A pair whose share of equal coordinates is this far under the threshold is ruled out: 5 standard deviations.
MARGIN = 0.2
#: Members of a block in step 4.
BLOCK = 1_000
MIX = np.uint64(0x9E3779B97F4A7C15)


def scramble(x: np.ndarray) -> np.ndarray:
    """A permutation of the 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, size: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only ASCII space splits
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = min(size, len(words))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out = scramble(out * MIX + h[k : len(h) - n + 1 + k])
    return np.unique(out)


def first_permutation(x: np.ndarray) -> np.ndarray:
    return (scramble(x * MIX + np.uint64(1)) >> np.uint64(32)).astype(np.uint32)


def second_permutation(x: np.ndarray) -> np.ndarray:
    """A permutation of the 32-bit universe."""
    x = x ^ (x >> np.uint32(16))
    x = x * np.uint32(0x7FEB352D)
    x = x ^ (x >> np.uint32(15))
    x = x * np.uint32(0x846CA68B)
    return x ^ (x >> np.uint32(16))


def signature(found: np.ndarray, coordinates: int = COORDINATES) -> np.ndarray:
    """Coordinate k is the least of the second permutation, shifted circularly by k, over the scattered set."""
    at = first_permutation(found)
    out = np.empty(coordinates, np.uint32)
    step = max(1, (1 << 18) // max(len(at), 1))
    for k in range(0, coordinates, step):
        shift = np.arange(k, min(k + step, coordinates), dtype=np.uint32)
        out[k : k + step] = second_permutation(at[None, :] - shift[:, None]).min(axis=1)
    return out


def describe(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, node (hash of the set, null for an empty one), signature (one 16-bit number a coordinate), bands."""
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches):
        for batch in common.small(batches):
            n, node, sig, bands = [], [], [], []
            for t in batch.column(1).to_pylist():
                found = shingles(t)
                n.append(len(found))
                if len(found):
                    s = signature(found)
                    node.append(blake2b(found.tobytes(), digest_size=12).digest())
                    sig.append(s.astype(np.uint16).tobytes())
                    rows = s.reshape(BANDS, ROWS).astype(np.uint64)
                    key = np.arange(1, BANDS + 1, dtype=np.uint64)
                    for k in range(ROWS):
                        key = scramble(key * MIX + rows[:, k])
                    bands.append(key.astype(np.int64))
                else:
                    node.append(None)
                    sig.append(None)
                    bands.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(node, pa.binary()), pa.array(sig, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "node", "signature", "bands"])

    return docs.select(docs[id_column].alias("doc_id"), docs[text]).mapInArrow(run, f"doc_id {kind}, n_shingles long, node binary, signature binary, bands array<long>")


def similar(s: np.ndarray, t: np.ndarray) -> bool:
    """The threshold on full sets, in whole numbers."""
    both = len(np.intersect1d(s, t, assume_unique=True))
    return DENOMINATOR * both >= NUMERATOR * (len(s) + len(t) - both)


def confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes whose full sets are similar enough."""

    def run(batches):
        memo: dict[bytes, np.ndarray] = {}

        def of(node: bytes, text: str) -> np.ndarray:
            if node not in memo:
                if len(memo) >= 256:
                    memo.clear()
                memo[node] = shingles(text)
            return memo[node]

        for batch in common.small(batches):
            keep = []
            for a, b, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                s, t = of(a, x), of(b, y)
                keep.append(similar(s, t))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = texts.select(F.col("node").alias("a"), F.col("text").alias("x"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """node, component for every node of ``links`` (a, b): alternating large and small stars until nothing changes.

    Each round is two joins on the node; nothing but two numbers a round comes to the driver.
    """
    star = common.cut_lineage(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before, last = None, star
    while True:
        both = star.unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        star = common.cut_lineage(small)
        now = star.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        common.remove(last)
        if now == before:
            break
        before, last = now, star
    return star.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(star.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def cross_links(buckets: DataFrame, texts: DataFrame) -> DataFrame:
    """Confirmed links (a, b) that join different components of a bucket, each pair tried where it first meets.

    ``buckets``: key, band, node, component, n_shingles, signature.  The members outside a bucket's most
    common component are compared with all members, block against block; a block gives a link for each two
    components it joins, so its output is shorter than its input.
    """
    size = buckets.groupBy("key", "component").agg(F.count("*").alias("n"))
    most = size.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("most"), F.sum("n").alias("total"), F.max("n").alias("top")).where("total > top")
    rows = buckets.join(most, "key").withColumn("minor", F.col("component") != F.col("most")).join(texts, "node")
    blocks = lambda n: F.greatest(F.ceil(n / F.lit(BLOCK)), F.lit(1)).cast("int")
    mine, theirs = blocks(F.col("total") - F.col("top")), blocks(F.col("total"))
    deal = lambda n: F.pmod(F.xxhash64("node"), n.cast("long")).cast("int")
    span = lambda n: F.sequence(F.lit(0), n - 1)
    cell = lambda i, j: F.struct(i.alias("i"), j.alias("j"))
    # a minor member asks along its row of cells, every member answers along its column
    asks = F.when(F.col("minor"), F.transform(span(theirs), lambda j: cell(deal(mine), j))).otherwise(F.array().cast("array<struct<i:int,j:int>>"))
    answers = F.transform(span(mine), lambda i: cell(i, deal(theirs)))
    columns = ["key", "i", "j", "asks", "answers", "band", "node", "component", "minor", "n_shingles", "signature", "text"]
    dealt = rows.withColumn("asked", asks).withColumn("answered", answers).withColumn("cell", F.explode(F.array_distinct(F.concat("asked", "answered"))))
    dealt = dealt.select("*", F.col("cell.i").alias("i"), F.col("cell.j").alias("j"), F.array_contains("asked", F.col("cell")).alias("asks"), F.array_contains("answered", F.col("cell")).alias("answers")).select(columns)

    def run(table: pa.Table) -> pa.Table:
        d = {c: table.column(c).to_pylist() for c in columns[3:-1]}
        asks = [r for r, x in enumerate(d["asks"]) if x]
        answers = [r for r, x in enumerate(d["answers"]) if x]
        out: list[tuple[bytes, bytes]] = []
        if asks and answers:
            texts = table.column("text")
            sets: dict[int, np.ndarray] = {}
            above: dict[bytes, bytes] = {}

            def root(c: bytes) -> bytes:
                while c in above:
                    c = above[c]
                return c

            def full(r: int) -> np.ndarray:
                if r not in sets:
                    sets[r] = shingles(texts[r].as_py())
                return sets[r]

            sig = np.frombuffer(b"".join([d["signature"][r] for r in answers]), np.uint16).reshape(len(answers), COORDINATES)
            n = np.array([d["n_shingles"][r] for r in answers], dtype=np.int64)
            for r in asks:
                node, own = d["node"][r], d["n_shingles"][r]
                same = sig == np.frombuffer(d["signature"][r], np.uint16)
                likely = (same.mean(axis=1) >= NUMERATOR / DENOMINATOR - MARGIN) & (DENOMINATOR * np.minimum(n, own) >= NUMERATOR * np.maximum(n, own))
                likely &= ~same[:, : d["band"][r] * ROWS].reshape(len(n), -1, ROWS).all(axis=2).any(axis=1)  # else they met in an earlier band
                for k in np.flatnonzero(likely):
                    q = answers[k]
                    if d["minor"][q] and d["node"][q] < node:
                        continue  # two minor members ask each other
                    c, e = root(d["component"][r]), root(d["component"][q])
                    if c != e and similar(full(r), full(q)):
                        above[c] = e
                        out.append((max(node, d["node"][q]), min(node, d["node"][q])))
        return pa.table({"a": pa.array([x for x, _ in out], pa.binary()), "b": pa.array([y for _, y in out], pa.binary())})

    return dealt.groupBy("key", "i", "j").applyInArrow(run, "a binary, b binary").distinct()


def near_duplicates(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id that links reach) for every row of ``docs``."""
    rows = common.cut_lineage(describe(docs, text, id_column))
    nodes = rows.where("node is not null and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("signature").alias("signature"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"))
    nodes = common.cut_lineage(nodes)
    placed = nodes.select("node", "rep", F.posexplode("bands").alias("band", "key"))
    hubs = placed.groupBy("key").agg(F.min(F.struct("rep", "node")).getField("node").alias("hub"), F.count("*").alias("n")).where("n > 1").drop("n")
    met = common.cut_lineage(placed.drop("rep").join(hubs, "key"))
    pairs = met.where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    # the texts of nodes that meet any other
    wanted = nodes.join(met.select("node").distinct(), "node", "left_semi").select("node", "rep")
    source = docs.select(docs[id_column].alias("rep"), docs[text].alias("text"))
    # an id that repeats with other texts could bring a text of another node, so nodes are read from the texts again
    texts = _texts(source, wanted)
    links = common.cut_lineage(confirm(pairs, texts))
    parts = components(links)
    buckets = met.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = buckets.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    mixed = buckets.join(mixed, "key", "left_semi").join(nodes.select("node", "n_shingles", "signature"), "node")
    more = common.cut_lineage(cross_links(mixed.select("key", "band", "node", "component", "n_shingles", "signature"), texts))
    parts = components(links.unionByName(more))
    smallest = parts.join(nodes.select("node", "rep"), "node").groupBy("component").agg(F.min("rep").alias("component_id"))
    of_node = parts.join(smallest, "component").select("node", "component_id")
    whole = nodes.select("node", "rep").join(of_node, "node", "left").select("node", F.coalesce("component_id", "rep").alias("component_id"))
    return rows.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("node")).alias("node")).join(whole, "node", "left").select(F.col("doc_id").alias(id_column), "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _texts(source: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, text for the wanted nodes: only texts whose id is wanted move."""

    def check(batches):
        for batch in common.small(batches):
            same = [blake2b(shingles(t).tobytes(), digest_size=12).digest() == n for n, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield batch.filter(pa.array(same, pa.bool_()))

    found = source.join(wanted, "rep").select("node", "text").mapInArrow(check, "node binary, text string")
    return common.cut_lineage(found.dropDuplicates(["node"]))

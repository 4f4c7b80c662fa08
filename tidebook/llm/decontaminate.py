"""Benchmark decontamination by q-gram lemma filtering.

A document leaks an item when a region of it is within the item's edit budget (``BUDGET`` of its length, on
texts in lower case with single spaces), or within ``PASSAGE_EDITS`` of a passage of the item.  Passages of
``PASSAGE`` characters begin every ``STEP`` characters and at the item's end, so a verbatim part of
PASSAGE + STEP - 1 characters always holds one; passages that mostly repeat their own q-grams are no evidence.
The edits of a leak are those of the whole item, or of the passage where no whole one is found.

k edits leave at least m + 1 - q - k*q of an item's q-grams
intact, all within 2k + 1 neighbouring diagonals.  So shared q-grams are counted in overlapping bands of
diagonals, bands under that bound are dropped, and the rest are verified by banded alignment.

The benchmark is a stated query set: it goes to the tasks in blocks of bounded size, all against every document in one
narrow pass.  With more than one block a task holds HELD_BYTES of documents and looks them up in one block's index after the other, so
an index is built once for so many documents.  Every executor gets all blocks: a benchmark of some gigabytes at most.

Null or empty documents leak nothing; null or empty items are in nothing.  For items under ``SHORT`` characters the bound isn't
positive: those of two words and more are looked up exactly, where no letter or digit touches either end; a single short word would be in
most documents by chance, so it leaks only into documents that equal it.  Repeated items count once each, an
item id with two texts for both.  Texts of any length are looked up whole, in windows that overlap by more than an item.  Repeated rows get equal leaks, all
items that tie are listed, in order of their ids; other columns pass through, ``leaks`` is replaced; an empty table gives an empty one.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tidebook.llm import common

Q, BUDGET, SHORT = 6, 0.12, 18
PASSAGE_Q, PASSAGE, STEP, PASSAGE_EDITS = 10, 60, 15, 3
#: Characters of the benchmark that go to the tasks at once, and of the documents that are looked up at once.
BLOCK_CHARS, CHUNK_CHARS = 8 << 20, 1 << 19
HELD_BYTES = 64 << 20
PRIME = np.uint64(0x9E3779B97F4A7C15)
FILTER_BITS = 24
#: Shared q-grams that are held at once, where more than one document is looked up.
HITS = 4 << 20


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def grams(c: np.ndarray, q: int = Q) -> np.ndarray:
    """A 64-bit hash of the q characters from each position on, by doubling."""
    n = len(c) - q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    power, span, width, p = c.astype(np.uint64) + np.uint64(1), 1, 1, PRIME
    out, done = None, 0
    while width <= q:
        if q & width:
            piece = power[done : done + n]
            out = piece.copy() if out is None else out * p + piece
            done += width
        width *= 2
        if width <= q:
            power = power[: len(power) - span] * p + power[span:]
            span *= 2
            p = np.uint64(int(p) ** 2 % (1 << 64))
    out ^= out >> np.uint64(29)
    return out * PRIME


def packed(*columns: np.ndarray) -> np.ndarray:
    """Rows of whole numbers from 0 on as one number each, in the same order."""
    out = np.zeros(len(columns[0]), np.int64)
    for c in columns:
        out = out * (int(c.max(initial=0)) + 1) + c
    return out


def passages(c: np.ndarray) -> list[np.ndarray]:
    """The passages of a longer item."""
    if len(c) <= PASSAGE:
        return []
    begins = [*range(0, len(c) - PASSAGE, STEP), len(c) - PASSAGE]
    every = [c[b : b + PASSAGE] for b in begins]
    return [w for w in every if 2 * len(np.unique(grams(w, PASSAGE_Q))) > PASSAGE + 1 - PASSAGE_Q]


class Index:
    """From q-gram to (text, position) for texts with their edits."""

    def __init__(self, texts: list[np.ndarray], edits: np.ndarray, q: int):
        self.text, self.edits, self.q = texts, edits, q
        self.length = np.array([len(t) for t in texts], dtype=np.int64)
        self.least = self.length + 1 - q - edits * q
        self.stride = 2 * edits + 1
        self.segment = max(256, int((self.length + edits).max(initial=0)))
        hashes = [grams(t, q) for t in texts]
        every = np.concatenate([np.empty(0, np.uint64), *hashes])
        item = np.repeat(np.arange(len(texts)), [len(g) for g in hashes]).astype(np.int64)
        place = np.concatenate([np.empty(0, np.int64), *(np.arange(len(g), dtype=np.int64) for g in hashes)])
        order = np.argsort(every, kind="stable")
        self.item, self.place = item[order], place[order]
        self.gram, self.first = np.unique(every[order], return_index=True)
        self.count = np.diff(np.append(self.first, len(every)))
        self.shift = np.uint64(64 - min(max(len(self.gram).bit_length() + 4, 16), FILTER_BITS))  # a small one stays in the cache
        self.filter = np.zeros(1 << (64 - int(self.shift)), np.bool_)
        self.filter[(self.gram >> self.shift).astype(np.int64)] = True

    def regions(self, c: np.ndarray, begin: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(document, text, lowest, highest diagonal) of bands that meet the bound; ``begin``: where each document begins."""
        if not len(self.gram):
            return []
        g = grams(c, self.q)
        at = np.flatnonzero(self.filter[(g >> self.shift).astype(np.int64)])
        g = g[at]
        k = np.minimum(np.searchsorted(self.gram, g), len(self.gram) - 1)
        same = self.gram[k] == g
        at, k = at[same], k[same]
        doc = np.repeat(np.arange(len(begin)), np.diff(np.append(np.searchsorted(at, begin), len(at))))
        upto = np.cumsum(self.count[k])
        found: list[tuple[int, int, int, int]] = []
        a = 0
        while a < len(at):  # whole documents, of HITS together or one alone
            b = int(np.searchsorted(upto, (upto[a - 1] if a else 0) + HITS, side="right"))
            if b < len(at):
                b = int(np.searchsorted(doc, doc[b]))
                if b <= a:
                    b = int(np.searchsorted(doc, doc[a], side="right"))
            found += self.bands(at[a:b], k[a:b], doc[a:b])
            a = b
        return found

    def bands(self, at: np.ndarray, k: np.ndarray, doc: np.ndarray) -> list[tuple[int, int, int, int]]:
        n = self.count[k]
        upto = np.cumsum(n)
        rows = np.repeat(self.first[k] - upto + n, n) + np.arange(upto[-1])
        # a region's hits stand in two neighbouring segments
        segment = (at - at[0]) // self.segment
        item = self.item[rows]
        if (int(segment[-1]) + 1) * len(self.text) <= HITS:
            cell = np.repeat(segment * len(self.text), n) + item
            own = np.zeros((int(segment[-1]) + 3, len(self.text)), np.int64)
            own[1:-1] = np.bincount(cell, minlength=(int(segment[-1]) + 1) * len(self.text)).reshape(-1, len(self.text))
            near = own[1:-1] + np.maximum(own[:-2], own[2:]) >= self.least
            enough = np.flatnonzero(near.ravel()[cell])
        else:
            _, where, total = np.unique(packed(np.repeat(doc, n), item), return_inverse=True, return_counts=True)
            enough = np.flatnonzero(total[where] >= self.least[item])
        source = np.searchsorted(upto, enough, side="right")
        at, doc, item, place = at[source], doc[source], item[enough], self.place[rows[enough]]
        if not len(at):
            return []
        band = (at - place) // self.stride[item]
        doc, item, band = np.tile(doc, 2), np.tile(item, 2), np.concatenate([band, band - 1])  # band b spans strides b and b + 1
        # each place of a text counts once in a band
        _, once = np.unique(packed(doc, item, band - band.min(), np.tile(place, 2)), return_index=True)
        doc, item, band = doc[once], item[once], band[once]
        _, one, total = np.unique(packed(doc, item, band - band.min()), return_index=True, return_counts=True)
        one = one[total >= self.least[item[one]]]
        low, stride = band[one] * self.stride[item[one]], self.stride[item[one]]
        return list(zip(doc[one].tolist(), item[one].tolist(), low.tolist(), (low + 2 * stride - 1).tolist(), strict=True))


class Items:
    """A block of items: single short words, which count only as whole documents, short phrases, an index of the others and one of their passages."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids = [i for i, _ in items]
        self.equal: dict[str, list[int]] = {}
        for k, (_, t) in enumerate(items):
            if 0 < len(t) < SHORT:
                self.equal.setdefault(t, []).append(k)
        self.phrases = ahocorasick.Automaton()
        for t in self.equal:
            if " " in t:
                self.phrases.add_word(t, t)
        self.phrases.make_automaton()
        longer = [k for k, (_, t) in enumerate(items) if len(t) >= SHORT]
        text = [codes(items[k][1]) for k in longer]
        parts = [(k, w) for k, t in zip(longer, text, strict=True) for w in passages(t)]
        self.whole = longer, Index(text, np.array([int(len(t) * BUDGET) for t in text], dtype=np.int64), Q)
        self.parts = [k for k, _ in parts], Index([w for _, w in parts], np.full(len(parts), PASSAGE_EDITS, np.int64), PASSAGE_Q)
        self.overlap = max((len(t) + int(len(t) * BUDGET) for t in text), default=0) + 1


    def short(self, text: str) -> set[int]:
        """Short items in a text: equal to it, or phrases that stand free in it."""
        found = set(self.equal.get(text, ()))
        if len(self.phrases):
            for last, t in self.phrases.iter(text):
                first = last + 1 - len(t)
                if not (first and text[first - 1].isalnum() and t[0].isalnum()) and not (last + 1 < len(text) and text[last + 1].isalnum() and t[-1].isalnum()):
                    found.update(self.equal[t])
        return found


def align(item: np.ndarray, doc: np.ndarray, low: int, high: int, edits: int) -> int:
    """Fewest edits that turn the item into some region of the document, within the band of diagonals."""
    low, high = low - edits, high + edits
    slope, big = np.arange(high - low + 1), len(item) + 1
    # row i of the table meets the document's characters low + i ... high + i; outside it nothing matches
    padded = np.full(len(slope) + len(item), 0xFFFFFFFF, np.uint32)
    first, last = max(low, 0), min(low + len(padded), len(doc))
    if first < last:
        padded[first - low : last - low] = doc[first:last]
    best = np.zeros(len(slope), np.int64)  # the region may begin anywhere
    for i, c in enumerate(item):
        window = padded[i : i + len(slope)]
        step = best + (window != c)
        step[:-1] = np.minimum(step[:-1], best[1:] + 1)
        best = np.minimum.accumulate(step - slope) + slope
        if best.min() > edits:
            return big
    return int(best.min())


def search(texts: list[str | None], items: Items) -> list[list[tuple[int, int]]]:
    """For each text, (item id, edits) of the items that it leaks."""
    ready = [normal(t) for t in texts]
    whole: list[dict[int, int]] = [dict.fromkeys(items.short(t), 0) for t in ready]
    parts: list[dict[int, int]] = [{} for _ in ready]

    def look(part: list[tuple[int, str]]) -> None:
        c = codes("\x00".join(t for _, t in part))
        begin = np.cumsum([0] + [len(t) + 1 for _, t in part])[:-1]
        for (owner, index), found in ((items.whole, whole), (items.parts, parts)):
            for d, i, low, high in index.regions(c, begin):
                row, k = part[d][0], owner[i]
                if found is parts and (k in whole[row] or parts[row].get(k) == 0):
                    continue
                own = c[begin[d] : begin[d] + len(part[d][1])]
                edits = int(index.edits[i])
                if (cost := align(index.text[i], own, low - int(begin[d]), high - int(begin[d]), edits)) <= edits:
                    found[row][k] = min(cost, found[row].get(k, cost))

    part: list[tuple[int, str]] = []
    size = 0
    for row, t in enumerate(ready):
        for at in range(0, max(len(t) - items.overlap, 1), CHUNK_CHARS):  # windows of a very long text overlap by more than an item
            piece = t[at : at + CHUNK_CHARS + items.overlap]
            if part and size + len(piece) > CHUNK_CHARS:
                look(part)
                part, size = [], 0
            part.append((row, piece))
            size += len(piece)
    if part:
        look(part)
    return [sorted((items.ids[k], e) for k, e in f.items()) for f in ({**p, **w} for p, w in zip(parts, whole, strict=True))]


def blocks(benchmark: DataFrame, item_id: str, text: str) -> list[list[tuple[int, str]]]:
    """The query set, cut so that no block has more than BLOCK_CHARS characters in the mean."""
    items = benchmark.where(F.col(text).isNotNull() & F.col(item_id).isNotNull()).select(F.col(item_id).alias("i"), F.col(text).alias("t"))
    size = items.agg(F.sum(F.length("t"))).first()[0] or 0
    n = -(-size // BLOCK_CHARS) or 1
    return [sorted({(r["i"], normal(r["t"])) for r in items.where(F.pmod(F.xxhash64("i"), F.lit(n)) == k).collect()}) for k in range(n)]


def find_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", id_column: str = "doc_id", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` with a last column ``leaks``, array of (item, edits); a column of that name is replaced."""
    out = docs.drop("leaks")
    place = out.columns.index(text)
    item = benchmark.schema[item_id].dataType
    kind = T.ArrayType(T.StructType([T.StructField("item", item), T.StructField("edits", T.LongType())]))
    context = docs.sparkSession.sparkContext
    shared = [context.broadcast(b) for b in blocks(benchmark, item_id, item_text)]
    arrow = pa.list_(pa.struct([("item", to_arrow_type(item)), ("edits", pa.int64())]))

    def run(batches):
        if len(shared) == 1:
            index = Items(shared[0].value)
            for batch in common.small(batches):
                yield with_leaks(batch, search(batch.column(place).to_pylist(), index))
            return
        held, size = [], 0
        for batch in common.small(batches):
            held.append(batch)
            size += batch.column(place).nbytes
            if size >= HELD_BYTES:
                yield from of_all(held)
                held, size = [], 0
        yield from of_all(held)

    def of_all(held):
        found: list[list[list]] = [[[] for _ in range(b.num_rows)] for b in held]
        for block in shared if held else ():
            index = Items(block.value)
            for batch, rows in zip(held, found, strict=True):
                for row, leaks in zip(rows, search(batch.column(place).to_pylist(), index), strict=True):
                    row += leaks
        for batch, rows in zip(held, found, strict=True):
            yield with_leaks(batch, rows)

    def with_leaks(batch, found):
        column = pa.array([[{"item": i, "edits": e} for i, e in sorted(f)] for f in found], arrow)
        return pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, "leaks"])

    return out.mapInArrow(run, T.StructType([*out.schema.fields, T.StructField("leaks", kind)]))

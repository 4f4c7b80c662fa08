"""Language-model scores by a hierarchical Pitman-Yor model.

A word is served by the restaurant of the word before it (the first one by that of the text's end, which begins each
text).  Parent of it is the restaurant of the word's class; all of these share one parent, the restaurant of words without
context, whose base measure spells a word: the bytes of a word and its end come from restaurants named by the last
three, two, one and no letters before them, each sharing its parent with every context that ends alike, down
to a uniform measure.  The end of a text is a word like others.

The class of a place is that of the latest anchor word before it.  Anchors are the most frequent short
words; their classes come from spectral clustering of how often they follow each other over all
training texts, so they tell languages and styles apart.  Contexts by preceding word are all that training texts have; none is left out.

Seatings are sampled by Gibbs sweeps: given the other levels, the number of tables of every dish is drawn
by seating its customers one after another; far customers are seated in doubling blocks.  Predictive probabilities
are averaged over the sweeps after the first, and a text's score is the sum of the log10 probabilities of its tokens.  In
the restaurants of spelling and of words a table is a customer of the parent.  Restaurants of preceding words are seated in the
buckets of their contexts, where the parent's probability of a dish is its share of the bucket's customers; classes count tokens.

All training texts are counted.  Documents are packed to homes (about HOME_BYTES of text each) as they are read, and their words and
pairs go to buckets by a hash of the word, or of the pair's first word; a home sends each bucket one packed list, and gets
totals and probabilities back in the same order.  So a frequent word is one entry a home, and no task holds more than a home's
texts or a bucket's words.  Only sums of bounded size are gathered: ANCHORS squared pairs, and spelling contexts, three of 40 letter
classes, 64,000 at most.  Contexts are known by 48 bits of a hash and their dishes by 32: a collision joins two of a kind; words themselves are exact.

Null or empty texts have one token, the end; texts of any length are read whole.  Without training rows the base score of every token is 0 and the
model is the uniform spelling.  Repeated rows are scored alike, and counted as often as they occur.  Rows are scored alone, so ties need no
order; other columns are left out, an empty table gives an empty one.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.llm import common

#: Text of a home in bytes, homes of a bucket.
HOME_BYTES, HOMES_A_BUCKET = 6 << 20, 4
SWEEPS, LETTER_SWEEPS = 3, 4
#: Letter classes of contexts, and symbols: 256 bytes and the end of a word.
CLASSES, SYMBOLS, END = 40, 257, 256
PAIR_STRENGTH, CONTEXT_STRENGTH, WORD_STRENGTH, LETTER_STRENGTH = 1.0, 10.0, 10.0, 1.0
#: The end of a text as a word; no word of a text holds white space.
STOP = b"\n"
#: Anchors are so many of the words of so many bytes at most; context 0 has no anchor before it.
ANCHORS, ANCHOR_BYTES, CONTEXTS = 256, 4, 9
#: Customers that are seated one by one before blocks begin.
SINGLY = 64


def letter_classes() -> np.ndarray:
    """Class of each symbol as a context: 0 where a word begins, letters apart, other bytes in groups."""
    out = np.full(SYMBOLS, 37, np.int32)
    out[ord("a") : ord("z") + 1] = np.arange(1, 27)
    out[ord("0") : ord("9") + 1] = 27
    out[128:256] = 29 + np.arange(128) % 8
    out[0xC3] = 28
    out[END] = 0
    return out


CLASS = letter_classes()


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


# -- seating -------------------------------------------------------------------------------


def seat(customers: np.ndarray, fresh: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of each dish: a customer opens one with weight ``fresh``, against customers seated less the discounts."""
    order = np.argsort(-customers, kind="stable")
    c, f = customers[order], np.maximum(fresh[order], 1e-300)
    t = (c > 0).astype(np.float64)
    at, most = 1, int(c[0]) if len(c) else 0
    while at < most:
        n = int(np.searchsorted(-c, -at, side="left"))  # dishes with more than ``at`` customers
        if at < SINGLY:
            t[:n] += rng.random(n) < f[:n] / (f[:n] + at - discount * t[:n])
            at += 1
        else:
            upto = np.minimum(2 * at, c[:n])
            mean = f[:n] * np.log((f[:n] + upto - discount * t[:n]) / (f[:n] + at - discount * t[:n]))
            t[:n] = np.minimum(t[:n] + rng.poisson(mean), c[:n])
            at *= 2
    out = np.empty(len(c))
    out[order] = t
    return out


def discount_of(once: float, twice: float) -> float:
    return float(min(max(once / (once + 2 * twice), 0.1), 0.95)) if once + twice else 0.5


# -- spelling ------------------------------------------------------------------------------


def spell(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all words with their ends, the context code of each, and where each word begins."""
    s = np.frombuffer(b"".join(words), np.uint8)
    length = np.fromiter(map(len, words), np.int64, len(words))
    symbols = np.full(len(s) + len(words), END, np.int32)
    ends = np.cumsum(length + 1) - 1
    inside = np.ones(len(symbols), bool)
    inside[ends] = False
    symbols[inside] = s
    k = np.concatenate([np.zeros(3, np.int32), CLASS[symbols]])
    one, two, three = k[2:-1], k[1:-2], k[:-3]
    two = two * (one > 0)
    three = three * (two > 0)
    return symbols, one + CLASSES * two + CLASSES**2 * three, np.append(0, ends[:-1] + 1)


class Spelling:
    """The letter restaurants: predictive probabilities by context length, ``row`` of each long context or -1."""

    def __init__(self, cells: np.ndarray, customers: np.ndarray, seed: int):
        """``cells``: context * SYMBOLS + symbol, sorted and distinct, with their customers."""
        rng = np.random.default_rng(seed)
        levels = [(cells, customers.astype(np.float64))]
        links = []
        for digits in (2, 1, 0):
            context, symbol = np.divmod(levels[-1][0], SYMBOLS)
            up, link = np.unique(context % CLASSES**digits * SYMBOLS + symbol, return_inverse=True)
            links.append(link)
            levels.append((up, np.ones(len(up))))
        contexts = [np.unique(c // SYMBOLS) for c, _ in levels]
        n = [x for _, x in levels]
        t = [np.ones(len(x)) for x in n]
        self.tables: list[np.ndarray] = []
        for _ in range(LETTER_SWEEPS):
            for k in range(3):  # tables are the parent's customers
                n[k + 1] = np.bincount(links[k], weights=t[k], minlength=len(n[k + 1]))
                t[k + 1] = np.minimum(t[k + 1], n[k + 1])
            p = np.full((1, SYMBOLS), 1 / SYMBOLS)
            shown, above = [], None
            for k in (3, 2, 1, 0):
                place = np.searchsorted(contexts[k], levels[k][0] // SYMBOLS)
                symbol = levels[k][0] % SYMBOLS
                if above is not None:
                    p = p[np.searchsorted(above, contexts[k] % CLASSES ** (2 - k))]
                else:
                    p = np.repeat(p, len(contexts[k]), axis=0)
                d = discount_of((n[k] == 1).sum(), (n[k] == 2).sum())
                total, tables = np.bincount(place, weights=n[k], minlength=len(p)), np.bincount(place, weights=t[k], minlength=len(p))
                fresh = (LETTER_STRENGTH + d * tables)[place] * p[place, symbol]
                p = p * ((LETTER_STRENGTH + d * tables) / (LETTER_STRENGTH + total))[:, None]
                p[place, symbol] += (n[k] - d * t[k]) / (LETTER_STRENGTH + total)[place]
                t[k] = seat(n[k], fresh, d, rng)
                above = contexts[k]
                shown.append(p.astype(np.float32))
        # contexts that were never seen are served by their parents
        self.rows, self.shown = contexts[::-1], shown[-4:]

    def log10(self, words: list[bytes], chunk: int = 60_000) -> np.ndarray:
        """log10 probability of spelling each word."""
        out = []
        for at in range(0, len(words), chunk):
            symbols, context, begins = spell(words[at : at + chunk])
            p = np.full(len(symbols), 1 / SYMBOLS, np.float32)
            for k, (rows, shown) in enumerate(zip(self.rows, self.shown, strict=True)):  # short contexts first
                if not len(rows):
                    continue
                c = context % CLASSES**k
                row = np.minimum(np.searchsorted(rows, c), len(rows) - 1)
                known = rows[row] == c
                p[known] = shown[row[known], symbols[known]]
            out.append(np.add.reduceat(np.log10(p.astype(np.float64)), begins))
        return np.concatenate(out) if out else np.empty(0)


def no_words() -> Spelling:
    return Spelling(np.empty(0, np.int64), np.empty(0), 0)


# -- anchors -------------------------------------------------------------------------------


def short_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The words of ANCHOR_BYTES bytes at most, as letters and length in one number, and the text of each."""
    joined = np.frombuffer(b" ".join(texts).lower() + b" " * (ANCHOR_BYTES + 1), np.uint8)
    space = (joined == 32) | ((joined >= 9) & (joined <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space]).astype(np.int8)))  # a word begins, a word ends, ...
    begin, length = edge[::2], edge[1::2] - edge[::2]
    begin, length = begin[length <= ANCHOR_BYTES], length[length <= ANCHOR_BYTES]
    word = np.zeros(len(begin), np.int64)
    for k in range(ANCHOR_BYTES):
        word = word << 8 | np.where(k < length, joined[begin + k], 0)
    first = np.cumsum([0] + [len(t) + 1 for t in texts])
    return word << 3 | length, np.searchsorted(first, begin, side="right")


def anchor_pairs(rows: DataFrame) -> DataFrame:
    """left, right, n: how often one short word is the next short word after another in training texts."""

    def count(batches):
        kept, size = [], 0
        for batch in common.small(batches):
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(0).to_pylist()]
            kept, size = kept + texts, size + sum(map(len, texts))
            if size >= HOME_BYTES:
                yield pairs_of(kept)
                kept, size = [], 0
        yield pairs_of(kept)

    def pairs_of(texts: list[bytes]) -> pa.RecordBatch:
        words, of = short_words(texts)
        kinds, kind = np.unique(words, return_inverse=True)
        same = of[1:] == of[:-1]
        pairs, n = np.unique((kind[:-1] * max(len(kinds), 1) + kind[1:])[same], return_counts=True)
        named = pa.array([(w >> 3).to_bytes(ANCHOR_BYTES, "big")[: w & 7] for w in kinds.tolist()], pa.binary())
        left, right = np.divmod(pairs, max(len(kinds), 1))
        return pa.RecordBatch.from_arrays([named.take(pa.array(left)), named.take(pa.array(right)), pa.array(n, pa.int64())], ["left", "right", "n"])

    return rows.where(~F.col("held")).select("text").mapInArrow(count, "left binary, right binary, n long").groupBy("left", "right").agg(F.sum("n").alias("n"))


def anchor_classes(rows: DataFrame) -> dict[bytes, int]:
    """Anchor to its class, 1 ... CONTEXTS - 1."""
    pairs = common.cut_lineage(anchor_pairs(rows))
    top = pairs.groupBy("left").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "left").limit(ANCHORS).select("left")
    anchors = sorted(bytes(r["left"]) for r in top.collect())
    if len(anchors) < 2:
        return {w: 1 for w in anchors}
    near = F.broadcast(top)  # ANCHORS rows
    kept = pairs.join(near, "left", "left_semi").join(near.withColumnRenamed("left", "right"), "right", "left_semi").collect()
    place = {w: k for k, w in enumerate(anchors)}
    m = np.zeros((len(anchors), len(anchors)))
    for r in kept:
        m[place[bytes(r["left"])], place[bytes(r["right"])]] += r["n"]
    m = m + m.T + 1e-3
    scale = 1 / np.sqrt(m.sum(axis=1))
    values, vectors = np.linalg.eigh(m * scale[:, None] * scale[None, :])
    classes = min(CONTEXTS - 1, len(anchors))
    x = vectors[:, np.argsort(-values)[:classes]]
    x = x / np.maximum(np.linalg.norm(x, axis=1), 1e-12)[:, None]
    centre = [int(np.argmax(m.sum(axis=1)))]
    while len(centre) < classes:  # farthest first, then means
        centre.append(int(np.argmin((x @ x[centre].T).max(axis=1))))
    c = x[centre]
    for _ in range(20):
        own = np.argmax(x @ c.T, axis=1)
        c = np.stack([x[own == k].mean(axis=0) if (own == k).any() else c[k] for k in range(classes)])
    return {w: 1 + int(k) for w, k in zip(anchors, np.argmax(x @ c.T, axis=1), strict=True)}


# -- the distributed passes ----------------------------------------------------------------


def pack(words: list[bytes]) -> bytes:
    return b" ".join(words)


def unpack(blob: bytes) -> list[bytes]:
    return blob.split(b" ") if blob else []


class Numbers(dict):
    """Words numbered as they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class HomeTexts(NamedTuple):
    """Codes (place of the word * CONTEXTS + context) of all tokens, tokens of each text, distinct words by their hash, the hashes, and the place of the word before each token."""

    codes: np.ndarray
    length: np.ndarray
    words: list[bytes]
    hashes: np.ndarray
    before: np.ndarray

    def pairs(self) -> np.ndarray:
        """Place of the word before and place of the word of each token, as one number."""
        return self.before * len(self.words) + self.codes // CONTEXTS


def read_home(texts, classes: dict[bytes, int]) -> HomeTexts:
    number = Numbers()
    stop = number[STOP]
    parts, length = [], []
    for text in texts:
        found = tokens(text)
        found.append(STOP)
        length.append(len(found))
        parts.append(np.fromiter(map(number.__getitem__, found), np.int32, len(found)))
    length = np.array(length, dtype=np.int64)
    flat = np.concatenate(parts) if parts else np.empty(0, np.int32)
    words = list(number)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    order = np.argsort(hashes)
    if len(words) > 1 and (np.diff(hashes[order]) == 0).any():  # the order must not depend on that of the rows
        order = np.array(sorted(range(len(words)), key=lambda i: (int(hashes[i]), words[i])))
    place, kind = np.empty(len(words), np.int64), np.zeros(len(words), np.int64)
    place[order] = np.arange(len(words))
    for w, k in classes.items():
        if w in number:
            kind[number[w]] = k
    k, at = kind[flat], np.arange(1, len(flat) + 1)
    latest = np.append(0, np.maximum.accumulate(np.where(k > 0, at, 0)))[:-1] if len(flat) else at
    begin = np.repeat(np.cumsum(length) - length, length)
    before = np.where(latest > begin, k[latest - 1], 0)  # an anchor of this text, or none
    own = place[flat]
    # every text ends with a stop, so the token before a text's first one is a stop too
    previous = np.append(place[stop], own[:-1]) if len(own) else own
    return HomeTexts(own * CONTEXTS + before, length, [words[i] for i in order.tolist()], hashes[order], previous)


def text_sums(values: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Sum of the values of each text's tokens."""
    out = np.zeros(len(length))
    some = np.flatnonzero(length)
    if len(some):
        out[some] = np.add.reduceat(values, (np.cumsum(length) - length)[some])
    return out


def by_bucket(bucket: np.ndarray):
    """(bucket, rows of it in order) for each bucket that has any."""
    order = np.argsort(bucket, kind="stable")
    found, edges = np.unique(bucket[order], return_index=True)
    yield from zip(found.tolist(), np.split(order, edges[1:]), strict=False)


def parcels(codes: np.ndarray, hashes: np.ndarray, buckets: int):
    """(bucket, places of its words, rows of its codes, codes counted within the bucket's words) for each bucket that has any."""
    bucket = (hashes % np.uint64(buckets)).astype(np.int64)
    inside = np.empty(len(hashes), np.int64)
    rows_of = dict(by_bucket(bucket[codes // CONTEXTS]))
    for b, mine in by_bucket(bucket):
        rows = rows_of[b]  # every word has a code
        inside[mine] = np.arange(len(mine))
        yield b, mine, rows, inside[codes[rows] // CONTEXTS] * CONTEXTS + codes[rows] % CONTEXTS


def pair_parcels(pairs: np.ndarray, hashes: np.ndarray, buckets: int):
    """(bucket, rows of its pairs, places of their contexts, pairs of each context) by the hash of the word before."""
    context = pairs // len(hashes)
    bucket = (hashes % np.uint64(buckets)).astype(np.int64)
    for b, rows in by_bucket(bucket[context]):
        of, n = np.unique(context[rows], return_counts=True)
        yield b, rows, of, n


def press(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).tobytes())


def loose(blob: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), kind)


def short(x: np.ndarray) -> np.ndarray:
    """The upper half of 32-bit floats, rounded."""
    return ((x.astype(np.float32).view(np.uint32) + np.uint32(0x8000)) >> np.uint32(16)).astype(np.uint16)


def long(x: np.ndarray) -> np.ndarray:
    return (x.astype(np.uint32) << np.uint32(16)).view(np.float32)


def seat_pairs(context: np.ndarray, dish: np.ndarray, counts: np.ndarray, contexts: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(share of its own customers, share left to the parent) of distinct pairs, sorted by context, and of contexts; averaged over the sweeps after the first."""
    customers = np.bincount(context, weights=counts, minlength=contexts)
    d = discount_of((counts == 1).sum(), (counts == 2).sum())
    tables = (counts > 0).astype(np.float64)
    many = np.flatnonzero(counts > 1)  # one customer has one table
    kinds, kind = np.unique(dish[many], return_inverse=True)
    near = np.searchsorted(kinds, dish)
    has = near < len(kinds)
    has[has] = kinds[near[has]] == dish[has]
    parent = (np.bincount(near[has], weights=counts[has], minlength=len(kinds)) / max(counts.sum(), 1))[kind]
    rng = np.random.default_rng(seed)
    own, left, taken = np.zeros(len(counts)), np.zeros(contexts), 0
    for sweep in range(SWEEPS):
        opened = np.bincount(context, weights=tables, minlength=contexts)
        if sweep:
            own += (counts - d * tables) / (PAIR_STRENGTH + customers)[context]
            left += (PAIR_STRENGTH + d * opened) / (PAIR_STRENGTH + customers)
            taken += 1
        tables[many] = seat(counts[many], (PAIR_STRENGTH + d * opened)[context[many]] * parent, d, rng)
    return own / max(taken, 1), left / max(taken, 1)


class Sums(NamedTuple):
    """What the sweeps share: the spelling, tables of each context, customers and tables of the parent."""

    spelling: Spelling | None
    context_tables: np.ndarray
    customers: float
    tables: float


class Seating:
    """Tables of one bucket's words, drawn anew from the same seeds wherever they are needed."""

    def __init__(self, bucket: int, words: list[bytes], counts: np.ndarray, discounts: tuple[float, float], totals: np.ndarray):
        self.bucket, self.words, self.counts, self.totals = bucket, words, counts.reshape(-1, CONTEXTS), totals
        self.inner, self.outer = discounts

    def sweeps(self, past: list[Sums]):
        """Start and then one state for each entry of ``past``: (tables by context, customers, tables) of the words."""
        t = (self.counts > 0).astype(np.float64)
        c, s = t.sum(axis=1), (self.counts.sum(axis=1) > 0).astype(np.float64)
        yield t, c, s
        for k, sums in enumerate(past):
            rng = np.random.default_rng([k, self.bucket])
            spelt = 10 ** sums.spelling.log10(self.words)
            parent = self.parent(sums, c, s, spelt)
            row, col = np.nonzero(self.counts)
            t[row, col] = seat(self.counts[row, col].astype(np.float64), (CONTEXT_STRENGTH + self.inner * sums.context_tables[col]) * parent[row], self.inner, rng)
            c = t.sum(axis=1)
            s = seat(c, (WORD_STRENGTH + self.outer * sums.tables) * spelt, self.outer, rng)
            yield t, c, s

    def parent(self, sums: Sums, c: np.ndarray, s: np.ndarray, spelt: np.ndarray) -> np.ndarray:
        return (c - self.outer * s + (WORD_STRENGTH + self.outer * sums.tables) * spelt) / (WORD_STRENGTH + sums.customers)


def pack_homes(rows: DataFrame, home_bytes: int) -> DataFrame:
    """home, body: documents (doc_id, text, held) as they are read, so many that their texts have ``home_bytes``, compressed."""

    def run(batches):
        kept, size, number = [], 0, 0
        part = TaskContext.get().partitionId()

        def home():
            sink = pa.BufferOutputStream()
            table = pa.Table.from_batches(kept).combine_chunks()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(table)
            return pa.RecordBatch.from_arrays([pa.array([part << 32 | number], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["home", "body"])

        for batch in common.small(batches, 256):
            kept.append(batch)
            size += batch.column(1).nbytes
            if size >= home_bytes:
                yield home()
                kept, size, number = [], 0, number + 1
        if kept and sum(b.num_rows for b in kept):
            yield home()

    return rows.mapInArrow(run, "home long, body binary")


def unpack_home(body: bytes) -> pa.Table:
    return pa.ipc.open_stream(body).read_all()


SENT = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("home", pa.int64()), ("words", pa.binary()), ("codes", pa.binary()), ("counts", pa.binary())])
SENT_SQL = "kind int, bucket int, home long, words binary, codes binary, counts binary"
#: Of a bucket of words: words, counts by context, sums, and what each home asked.  Of a bucket of pairs: an answer for each home.
MERGED = "kind int, bucket int, home long, words binary, counts binary, sums array<long>, asked array<struct<home:long,words:binary,codes:binary>>, own binary, rest binary"
ASKED = pa.list_(pa.struct([("home", pa.int64()), ("words", pa.binary()), ("codes", pa.binary())]))
CELLS = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("home", pa.int64()), ("words", pa.binary()), ("counts", pa.binary()), ("sums", pa.list_(pa.int64())), ("asked", ASKED), ("own", pa.binary()), ("rest", pa.binary())])
WORDS_KIND, PAIRS_KIND = 0, 1


def send_home(home: int, body: bytes, classes: dict[bytes, int], buckets: int) -> list[dict]:
    """What a home sends: distinct words with counts by context, and distinct pairs with counts."""
    table = unpack_home(body)
    texts = read_home(table.column("text").to_pylist(), classes)
    learnt = np.repeat(~np.array(table.column("held").to_pylist(), dtype=bool), texts.length)
    size = len(texts.words) * CONTEXTS
    codes = np.flatnonzero(np.bincount(texts.codes, minlength=size))
    count = np.bincount(texts.codes[learnt], minlength=size)[codes].astype(np.int32)
    out = [
        {"kind": WORDS_KIND, "bucket": b, "home": home, "words": zstandard.ZstdCompressor(level=1).compress(pack([texts.words[i] for i in mine.tolist()])), "codes": press(own.astype(np.int32)), "counts": press(count[at])}
        for b, mine, at, own in parcels(codes, texts.hashes, buckets)
    ]
    both, n = np.unique(texts.pairs() * 2 + learnt, return_counts=True)
    pairs, first = np.unique(both >> 1, return_index=True)
    last = np.append(first[1:], len(both)) - 1
    count = np.where(both[last] & 1, n[last], 0).astype(np.uint32)
    dish = texts.hashes[pairs % len(texts.words)].astype(np.uint32)
    for b, rows, of, n in pair_parcels(pairs, texts.hashes, buckets):
        names = texts.hashes[of].view(np.uint8).reshape(-1, 8)[:, 2:]
        out.append({"kind": PAIRS_KIND, "bucket": b, "home": home, "words": names.tobytes(), "codes": press(n.astype(np.uint32)) + b"|" + dish[rows].tobytes(), "counts": press(count[rows])})
    return out


def merge_words(bucket: int, table: pa.Table) -> pa.Table:
    """Trained words of a bucket in order, with counts by context, and what the totals and discounts need."""
    codes, counts = [], []
    number: dict[bytes, int] = {}
    for blob, code, count in zip(table.column("words"), table.column("codes"), table.column("counts"), strict=True):
        code, count = loose(code.as_py(), np.int32).astype(np.int64), loose(count.as_py(), np.int32)
        code, count = code[count > 0], count[count > 0]
        words = unpack(zstandard.ZstdDecompressor().decompress(blob.as_py()))
        own = np.array([number.setdefault(words[k], len(number)) for k in (code // CONTEXTS).tolist()], dtype=np.int64)
        codes.append(own * CONTEXTS + code % CONTEXTS)
        counts.append(count)
    lists = sorted(number)
    matrix = np.bincount(np.concatenate(codes), weights=np.concatenate(counts), minlength=len(number) * CONTEXTS).astype(np.int64)
    matrix = matrix.reshape(-1, CONTEXTS)[[number[w] for w in lists]] if lists else matrix.reshape(-1, CONTEXTS)
    contexts = (matrix > 0).sum(axis=1)
    stops = int(matrix[lists.index(STOP)].sum()) if STOP in number else 0
    sums = [matrix.sum(axis=0), (matrix > 0).sum(axis=0), [(matrix == 1).sum(), (matrix == 2).sum(), (contexts == 1).sum(), (contexts == 2).sum(), len(lists), stops]]
    asked = pa.array([[{"home": h, "words": w, "codes": c} for h, w, c in zip(*(table.column(x).to_pylist() for x in ("home", "words", "codes")), strict=True)]], ASKED)
    cells = [[WORDS_KIND], [bucket], [None], [press(np.frombuffer(pack(lists), np.uint8))], [press(matrix)], [[int(v) for x in sums for v in x]], asked, [None], [None]]
    return pa.Table.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(cells, CELLS, strict=True)], schema=CELLS)


def merge_pairs(bucket: int, table: pa.Table) -> pa.Table:
    """Restaurants of a bucket's contexts, seated; for each home the shares of its pairs and contexts."""
    homes = table.column("home").to_pylist()
    names, sizes, dishes, counts = [], [], [], []
    for w, c, n in zip(table.column("words"), table.column("codes"), table.column("counts"), strict=True):
        raw = np.frombuffer(w.as_py(), np.uint8).reshape(-1, 6)
        name = np.zeros((len(raw), 8), np.uint8)
        name[:, :6] = raw
        names.append(name.view(np.uint64).ravel())
        counts.append(loose(n.as_py(), np.uint32))
        code = c.as_py()
        dishes.append(np.frombuffer(code[len(code) - 4 * len(counts[-1]) :], np.uint32))
        sizes.append(loose(code[: len(code) - 4 * len(counts[-1]) - 1], np.uint32).astype(np.int64))
    known, context = np.unique(np.concatenate(names), return_inverse=True)
    key = np.repeat(context, np.concatenate(sizes)).astype(np.uint64) << np.uint64(32) | np.concatenate(dishes)
    pairs, where = np.unique(key, return_inverse=True)
    count = np.bincount(where, weights=np.concatenate(counts), minlength=len(pairs))
    own, left = seat_pairs((pairs >> np.uint64(32)).astype(np.int64), pairs.astype(np.uint32), count, len(known), bucket)
    own, left = short(own), short(left)
    edges, outer = np.cumsum([len(d) for d in dishes])[:-1], np.cumsum([len(n) for n in names])[:-1]
    answers = [(press(own[a]), press(left[b])) for a, b in zip(np.split(where, edges), np.split(context, outer), strict=True)]
    n = len(homes)
    cells = [[PAIRS_KIND] * n, [bucket] * n, homes, *[[None] * n] * 4, [a for a, _ in answers], [b for _, b in answers]]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(cells, CELLS, strict=True)], schema=CELLS)


def score(docs: DataFrame, held: Column, text: str = "text", id_column: str = "doc_id", home_bytes: int = HOME_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity for every row; rows that ``held`` holds for are not learned from."""
    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(docs[id_column].alias("doc_id"), F.coalesce(docs[text], F.lit("")).alias("text"), F.coalesce(held, F.lit(False)).alias("held"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    homes = common.homes_for(docs.sparkSession, size, home_bytes)
    buckets = max(1, -(-homes // HOMES_A_BUCKET))
    context = docs.sparkSession.sparkContext
    classes = anchor_classes(rows)
    packed = common.cut_lineage(pack_homes(rows, max(-(-size // homes), 1)), "none", **{"parquet.block.size": 1 << 20, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1})

    def send(batches):
        for batch in batches:
            for home, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield pa.RecordBatch.from_pylist(send_home(home, body.as_py(), classes, buckets), SENT)

    def merge(key, table):
        return (merge_words if key[0].as_py() == WORDS_KIND else merge_pairs)(key[1].as_py(), table)

    merged = common.cut_lineage(packed.mapInArrow(send, SENT_SQL).groupBy("kind", "bucket").applyInArrow(merge, MERGED), "none")
    vocabulary = merged.where(F.col("kind") == WORDS_KIND)
    sums = vocabulary.select(F.posexplode("sums")).groupBy("pos").agg(F.sum("col").alias("n")).collect()
    flat = np.zeros(2 * CONTEXTS + 6)
    for r in sums:
        flat[r["pos"]] = r["n"]
    in_context, (once, twice, alone, pair, n_words, _) = flat[:CONTEXTS], flat[2 * CONTEXTS :]
    discounts = discount_of(once, twice), discount_of(alone, pair)
    n_all, v_all = int(in_context.sum()), int(n_words)

    past: list = []  # a broadcast for each sweep
    for sweep in range(SWEEPS):

        def letters(batches, past=tuple(past)):
            for batch in batches:
                for bucket, blob, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    words = unpack(loose(blob, np.uint8).tobytes())
                    *_, (t, c, s) = Seating(bucket, words, loose(counts, np.int64), discounts, in_context).sweeps([x.value for x in past])
                    kept: dict[int, float] = {-1 - k: float(x) for k, x in enumerate([*t.sum(axis=0), c.sum(), s.sum()])}
                    for at in range(0, len(words), 100_000):
                        symbols, code, begins = spell(words[at : at + 100_000])
                        weight = np.repeat(s[at : at + 100_000], np.diff(np.append(begins, len(symbols))))
                        cells, where = np.unique(code.astype(np.int64) * SYMBOLS + symbols, return_inverse=True)
                        for cell, x in zip(cells.tolist(), np.bincount(where, weights=weight).tolist(), strict=True):
                            kept[cell] = kept.get(cell, 0.0) + x
                    yield pa.RecordBatch.from_arrays([pa.array(list(kept), pa.int64()), pa.array(list(kept.values()), pa.float64())], ["cell", "n"])

        got = vocabulary.select("bucket", "words", "counts").mapInArrow(letters, "cell long, n double").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
        cell, n = got.column("cell").to_numpy(), got.column("n").to_numpy()
        order = np.argsort(cell)
        cell, n = cell[order], n[order]
        tail = np.zeros(CONTEXTS + 2)
        tail[-1 - cell[cell < 0]] = n[cell < 0]
        common.release(docs.sparkSession)  # the pairs' shuffle; the session holds on to the latest plan, so not before this one
        past.append(context.broadcast(Sums(Spelling(cell[cell >= 0], n[cell >= 0], sweep), tail[:CONTEXTS], tail[-2], tail[-1])))

    def answer(bucket: int, blob: bytes, matrix: bytes, asked: list[dict]):
        """For each home its words' counts, and the probabilities of its codes under the averaged seatings."""
        vocabulary_words = unpack(loose(blob, np.uint8).tobytes())
        counts = loose(matrix, np.int64).reshape(-1, CONTEXTS)
        seating = Seating(bucket, vocabulary_words, counts, discounts, in_context)
        known = {w: k for k, w in enumerate(vocabulary_words)}
        every = counts.sum(axis=1)
        states = []
        for k, (t, c, s) in enumerate(seating.sweeps([x.value for x in past[:-1]])):
            if k:
                sums = past[k].value
                states.append((sums, t.copy(), seating.parent(sums, c, s, 10 ** sums.spelling.log10(vocabulary_words))))
        for ask in asked:
            words = unpack(zstandard.ZstdDecompressor().decompress(ask["words"]))
            place = np.fromiter((known.get(w, -1) for w in words), np.int64, len(words))
            has = place >= 0
            count = np.zeros(len(words), np.int64)
            count[has] = every[place[has]]
            word, ctx = np.divmod(loose(ask["codes"], np.int32).astype(np.int64), CONTEXTS)
            p = np.zeros(len(word))
            new = np.flatnonzero(~has)
            for sums, t, served_known in states:
                parent = np.empty(len(words))
                parent[has] = served_known[place[has]]
                parent[new] = seating.parent(sums, 0.0, 0.0, 10 ** sums.spelling.log10([words[i] for i in new]))
                seen = has[word]
                served = np.zeros(len(word))
                served[seen] = counts[place[word[seen]], ctx[seen]] - seating.inner * t[place[word[seen]], ctx[seen]]
                p += (served + (CONTEXT_STRENGTH + seating.inner * sums.context_tables[ctx]) * parent[word]) / (CONTEXT_STRENGTH + in_context[ctx])
            yield ask["home"], press(count), press((p / len(states)).astype(np.float32))

    def reply(batches):
        for batch in common.small(batches, 1):
            found = [(WORDS_KIND, b, h, c, p) for b, w, m, asked in zip(*(batch.column(x).to_pylist() for x in range(4)), strict=True) for h, c, p in answer(b, w, m, asked)]
            kinds, at, home, own, rest = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(at, pa.int32()), pa.array(home, pa.int64()), pa.array(own, pa.binary()), pa.array(rest, pa.binary())], ["kind", "bucket", "home", "own", "rest"])

    answers = "kind int, bucket int, home long, own binary, rest binary"
    replies = vocabulary.select("bucket", "words", "counts", "asked").mapInArrow(reply, answers).unionByName(merged.where(F.col("kind") == PAIRS_KIND).select("kind", "bucket", "home", "own", "rest"))
    norm = n_all + v_all + 1

    def finish(left, got):
        table = unpack_home(left.column("body")[0].as_py())
        texts = read_home(table.column("text").to_pylist(), classes)
        size = len(texts.words) * CONTEXTS
        codes = np.flatnonzero(np.bincount(texts.codes, minlength=size))
        count, p = np.zeros(len(texts.words), np.int64), np.zeros(size)
        pairs, where = np.unique(texts.pairs(), return_inverse=True)
        own, rest = np.zeros(len(pairs)), np.zeros(len(texts.words))
        back = {(k, b): (x.as_py(), y.as_py()) for k, b, x, y in zip(got.column("kind").to_pylist(), got.column("bucket").to_pylist(), got.column("own"), got.column("rest"), strict=True)}
        for b, mine, at, _ in parcels(codes, texts.hashes, buckets):
            x, y = back[WORDS_KIND, b]
            count[mine], p[codes[at]] = loose(x, np.int64), loose(y, np.float32)
        for b, at, of, _ in pair_parcels(pairs, texts.hashes, buckets):
            x, y = back[PAIRS_KIND, b]
            own[at], rest[of] = long(loose(x, np.uint16)), long(loose(y, np.uint16))
        word, n = texts.codes // CONTEXTS, texts.length
        chance = own[where] + rest[texts.before] * p[texts.codes]
        scores = text_sums(np.log10(np.maximum(chance, 1e-300)), n)
        return pa.table({
            "doc_id": table.column("doc_id"),
            "held_out": table.column("held"),
            "n_tokens": pa.array(n, pa.int64()),
            "n_known": pa.array(text_sums((count > 0).astype(np.float64)[word], n).astype(np.int64), pa.int64()),
            "train_tokens": pa.array([n_all] * len(n), pa.int64()),
            "base_score": pa.array(text_sums(np.log10((count + 1) / norm)[word], n), pa.float64()),
            "score": pa.array(scores, pa.float64()),
            "perplexity": pa.array(10 ** np.minimum(-scores / n, 300), pa.float64()),
        })

    out = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"
    return packed.groupBy("home").cogroup(replies.groupBy("home")).applyInArrow(finish, out).withColumnRenamed("doc_id", id_column)

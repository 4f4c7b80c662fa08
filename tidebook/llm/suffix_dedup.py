"""Removal of repeated 50-byte strings with a suffix array sorted deep-shallow.

A byte goes if a 50-byte string that covers it also starts in a document with a smaller id.  Every window of
``WINDOW`` bytes is named by its anchor, the seed of ``SEED`` bytes in it with the least hash; equal
windows have equal anchors, so windows meet in the bucket of their anchor and neighbouring windows with one anchor
travel as one string of 50 to 80 bytes.

1. Documents are dealt over homes (about HOME_BYTES of text each).  A home sends each bucket the fingerprints
   of its anchors; those that stand in one document only are left out of all that follows (a collision only keeps more).
2. A home sends its strings with other anchors, each distinct string once with its smallest document.  Windows of a hot
   anchor, one with over HOT_RUNS runs, are strings of their own, dealt by their bytes instead of the anchor.
3. A bucket sorts the suffixes of its distinct strings (those of 50 bytes and more): three-way multikey quicksort over
   eight-byte characters down to a shallow depth, then a blind trie for each group that is still tied.  Suffixes that
   end in one leaf are one 50-byte string, whose smallest document is known then.
4. Homes get back which windows of each string are taken, and cut the bytes.

Strings are grouped by hash before the sort, and every group is compared byte by byte, so no result rests on a hash.
A passage of any number of copies is one string a home, no task holds more than a home's texts or a
bucket's strings, and homes and buckets grow in number with the input.  A home sends a record only to buckets that it has strings for, so
records are no more than strings.

Null and empty texts, and texts under 50 bytes, keep all bytes.  Rows with one id never take bytes from each other;
rows without an id count as the largest.  Copies, and ties of any kind, keep the bytes of the smallest id.  Texts of any length are looked
at whole, in pieces that overlap by a window.  Other columns are left out; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.llm import common

WINDOW, SEED = 50, 20
#: Text of a home in bytes, and bytes that are looked at at once (a power of two).
HOME_BYTES, CHUNK = 8 << 20, 1 << 20
#: Parts of a bucket that are sorted one after another.
PARTS = 8
#: Depth in bytes at which the blind tries take over, a multiple of eight.
SHALLOW = 32
#: Suffixes that are split three ways no further, and runs of an anchor past which its windows go by their own bytes.
TOGETHER, HOT_RUNS = 1 << 14, 1 << 20
LAST_ID = (1 << 63) - 1
FINGERPRINT = 5
NONE = 255


# -- anchors -------------------------------------------------------------------------------


def eights(text: np.ndarray, big: bool = False) -> np.ndarray:
    """The eight bytes from each position on as one number."""
    x = text.astype(np.uint64)
    for step in (1, 2, 4):
        low, high, bits = x[:-step], x[step:], np.uint64(8 * step)
        x = (low << bits) | high if big else low | (high << bits)
    return x


def seed_hashes(text: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the SEED bytes from each position on."""
    w = eights(text)
    n = len(text) - SEED + 1
    h = w[:n] * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h += w[8 : n + 8] * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    h += w[SEED - 8 : SEED - 8 + n] * np.uint64(0x165667B19E3779F9)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def anchors(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of seeds, anchor of each window); the leftmost of equal seeds wins."""
    h = seed_hashes(text)
    bits = np.uint64(CHUNK - 1)
    v = (h & ~bits) | np.arange(len(h), dtype=np.uint64)
    span, width = WINDOW - SEED + 1, 1
    while 2 * width <= span:
        v = np.minimum(v[:-width], v[width:])
        width *= 2
    if width < span:
        v = np.minimum(v[: len(v) - (span - width)], v[span - width :])
    return h, (v & bits).astype(np.int64)


def runs(texts: list[bytes]) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Chunk by chunk: (bytes, text number, first window, last window, offset of window 0 in its text, anchor hash) of each run of windows with one anchor."""

    def look(pieces: list[tuple[int, int, bytes]]):
        joined = b"".join(p for _, _, p in pieces)
        length = np.array([len(p) for _, _, p in pieces])
        h, anchor = anchors(np.frombuffer(joined, np.uint8))
        begin = np.cumsum(length) - length
        piece = np.repeat(np.arange(len(pieces)), length)[: len(anchor)]
        fits = np.arange(len(anchor)) + WINDOW <= (begin + length)[piece]
        first = np.flatnonzero(fits & np.append(True, (anchor[1:] != anchor[:-1]) | (piece[1:] != piece[:-1])))
        ends = np.append(~fits[1:] | (anchor[1:] != anchor[:-1]) | (piece[1:] != piece[:-1]), True) & fits
        last = np.flatnonzero(ends)
        of = piece[first]
        rows = np.array([r for r, _, _ in pieces])
        start = np.array([o for _, o, _ in pieces])
        yield joined, rows[of], first, last, (start - begin)[of], h[anchor[first]]

    pieces, size = [], 0
    for row, text in enumerate(texts):
        if len(text) < WINDOW:
            continue
        at = 0
        while at == 0 or at + WINDOW <= len(text):  # pieces of a long text overlap by a window less one
            piece = text[at : at + CHUNK // 2]
            if size + len(piece) > CHUNK:
                yield from look(pieces)
                pieces, size = [], 0
            pieces.append((row, at, piece))
            size += len(piece)
            at += len(piece) - WINDOW + 1
    if pieces:
        yield from look(pieces)


# -- the sort ------------------------------------------------------------------------------


def shallow_sort(text: np.ndarray, starts: np.ndarray, depth: int = SHALLOW, together: int | None = None) -> Iterator[np.ndarray]:
    """Multikey quicksort by eight-byte characters: groups of starts that agree in ``depth`` bytes, in order; suffixes that stand alone are left out.

    A group is split into those before a pivot, those that have it as their character, which go on with the next
    one, and those after it.  Groups of ``together`` suffixes and fewer are finished character by character.
    """
    words = eights(np.append(text, np.zeros(8, np.uint8)), big=True)
    together = TOGETHER if together is None else together
    todo = [(starts, 0)]
    while todo:
        group, at = todo.pop()
        if at >= depth:
            if len(group) > 1:
                yield group
        elif len(group) <= together:
            yield from finish(words, group, at, depth)
        else:
            key = words[group + at]
            some = np.sort(key[:: max(len(key) // 9, 1)])
            pivot = some[len(some) // 2]
            todo += [(group[key > pivot], at), (group[key == pivot], at + 8), (group[key < pivot], at)]


def finish(words: np.ndarray, starts: np.ndarray, at: int, depth: int) -> Iterator[np.ndarray]:
    """A small group in order of its characters from ``at`` on."""
    if len(starts) < 2:
        return
    tied, group, first = starts, np.zeros(len(starts), np.int64), at
    for at in range(first, depth, 8):
        key = words[tied + at]
        order = np.argsort(key, kind="quicksort") if at == first else np.lexsort((key, group))
        tied, group, key = tied[order], group[order], key[order]
        fresh = np.append(True, (key[1:] != key[:-1]) | (group[1:] != group[:-1]))
        alone = fresh & np.append(fresh[1:], True)
        tied, group = tied[~alone], np.cumsum(fresh)[~alone]
        if not len(tied):
            return
    yield from np.split(tied, np.flatnonzero(group[1:] != group[:-1]) + 1)


class BlindTrie:
    """Orders suffixes that share a long beginning by the few places where they differ.

    An inner node holds only the place of a difference and its branching bytes.  An insertion goes down blindly, compares
    once with the leaf it comes to, and branches off where the first difference lies.
    """

    def __init__(self, text: bytes, depth: int, length: int):
        self.text, self.depth, self.length = text, depth, length
        self.root: list | None = None

    def insert(self, start: int) -> None:
        text = self.text
        own = text[start : start + self.length]
        if self.root is None:
            self.root = [own, [start]]  # a leaf: string, starts
            return
        node = self.root
        while len(node) == 3:  # an inner node: place, branches, None
            branches = node[1]
            node = branches.get(own[node[0]]) or next(iter(branches.values()))
        if node[0] == own:
            node[1].append(start)
            return
        other = node[0]
        place = self.depth
        while own[place] == other[place]:
            place += 1
        above, key, node = None, None, self.root
        while len(node) == 3 and node[0] < place:
            above, key = node, own[node[0]]
            node = node[1][key]
        leaf = [own, [start]]
        if len(node) == 3 and node[0] == place:
            node[1][own[place]] = leaf
            return
        branch = [place, {other[place]: node, own[place]: leaf}, None]
        if above is None:
            self.root = branch
        else:
            above[1][key] = branch

    def leaves(self) -> Iterator[list[int]]:
        """Starts of each distinct string, in order."""
        todo = [self.root] if self.root else []
        while todo:
            node = todo.pop()
            if len(node) == 3:
                todo += [node[1][k] for k in sorted(node[1], reverse=True)]
            else:
                yield node[1]


def equal_windows(text: bytes, starts: np.ndarray, length: int = WINDOW) -> Iterator[list[int]]:
    """Classes, of two and more, of suffixes that agree in ``length`` bytes, in order."""
    for group in shallow_sort(np.frombuffer(text, np.uint8), starts):
        trie = BlindTrie(text, SHALLOW, length)
        for start in group.tolist():
            trie.insert(start)
        yield from (leaf for leaf in trie.leaves() if len(leaf) > 1)


def least_documents(text: np.ndarray, begin: np.ndarray, length: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(smallest document of every window of distinct strings, string of each window); windows in order of strings."""
    windows = length - WINDOW + 1
    first = np.cumsum(windows) - windows
    owner = np.repeat(np.arange(len(begin)), windows)
    starts = np.arange(len(owner)) + np.repeat(begin - first, windows)
    least = docs[owner]
    for leaf in equal_windows(text.tobytes(), starts):
        at = np.array(leaf)
        who = np.searchsorted(begin, at, side="right") - 1
        least[first[who] + at - begin[who]] = docs[who].min()
    return least, owner


# -- strings as arrays ---------------------------------------------------------------------

BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse, modulo 2^64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, CHUNK)
        _POWERS[:] = [np.multiply.accumulate(np.append(np.uint64(1), np.full(size - 1, x, np.uint64))) for x in (BASE, pow(BASE, -1, 1 << 64))]
    return _POWERS[0][:n], _POWERS[1][:n]


def string_hashes(text: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each string, from sums over prefixes."""
    up, down = powers(len(text) + 1)
    total = np.append(np.uint64(0), np.cumsum((text.astype(np.uint64) + np.uint64(1)) * up[:-1]))
    h = (total[begin + length] - total[begin]) * down[begin] + length.astype(np.uint64)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def same_strings(text: np.ndarray, begin: np.ndarray, length: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first string of each class, class of each string) of equal strings: met by hash, then compared byte by byte."""
    _, first, where = np.unique(hashes, return_index=True, return_inverse=True)
    rest = np.flatnonzero(first[where] != np.arange(len(where)))
    lead = first[where[rest]]
    differ = length[rest] != length[lead]
    alike = np.flatnonzero(~differ)
    rest_same, lead_same = rest[alike], lead[alike]
    for at in range(0, len(rest_same), COMPARED):
        mine, its = rest_same[at : at + COMPARED], lead_same[at : at + COMPARED]
        n = length[mine]
        unequal = gather(text, begin[mine], n) != gather(text, begin[its], n)
        if unequal.any():
            differ[alike[at : at + COMPARED]] = np.add.reduceat(unequal, np.cumsum(n) - n) > 0
    if differ.any():  # strings that only their hash takes for another
        extra: dict[bytes, int] = {}
        added = []
        for i in rest[differ].tolist():
            own = text[begin[i] : begin[i] + length[i]].tobytes()
            if own not in extra:
                extra[own] = len(first) + len(added)
                added.append(i)
            where[i] = extra[own]
        first = np.append(first, np.array(added, dtype=first.dtype))
    return first, where


#: Strings that are compared at once.
COMPARED = 1 << 16


def gather(text: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The strings one after another."""
    shift = begin - (np.cumsum(length) - length)
    return text[np.repeat(shift, length) + np.arange(int(length.sum()))]


# -- the distributed passes ----------------------------------------------------------------


def squeeze(data: bytes) -> bytes:
    """Short data as they are, behind a zero byte."""
    return b"\0" + data if len(data) < 200 else zstandard.ZstdCompressor(level=3).compress(data)


def open_up(data: bytes) -> bytes:
    return data[1:] if data[:1] == b"\0" else zstandard.ZstdDecompressor().decompress(data)


class Home:
    """A home's texts by document, the runs of their windows, and its anchors."""

    def __init__(self, table: pa.Table, buckets: int, strings: bool = True):
        docs = np.array([LAST_ID if d is None else d for d in table.column("doc_id").to_pylist()], dtype=np.int64)
        self.order = np.argsort(docs, kind="stable")
        self.docs, self.buckets = docs[self.order], buckets
        texts = table.column("text").to_pylist()
        self.texts = [(texts[i] or "").encode("utf-8", "surrogatepass") for i in self.order.tolist()]
        parts: list[tuple] = []
        chunks, base = [], 0
        for joined, rows, first, last, shift, h in runs(self.texts):
            length = last - first + WINDOW
            own = string_hashes(np.frombuffer(joined, np.uint8), first, length) if strings else h
            parts.append((rows, first + base, length, first + shift, h, own))
            if strings:
                chunks.append(joined)
            base += len(joined)
        none = (np.empty(0, np.int64),) * 4 + (np.empty(0, np.uint64),) * 2
        self.row, self.begin, self.length, self.offset, self.anchor, self.string = (np.concatenate(x) for x in zip(*(parts or [none]), strict=True))
        self.whole = np.frombuffer(b"".join(chunks), np.uint8)
        doc = self.docs[self.row]
        self.hash, first, self.where = np.unique(self.anchor, return_index=True, return_inverse=True)
        high = np.full(len(self.hash), -LAST_ID - 1)
        np.maximum.at(high, self.where, doc)
        self.several = doc[first] != high  # rows are in order of documents, so the first is the smallest
        self.bucket = (self.hash % np.uint64(buckets)).astype(np.int64)
        self.load = np.minimum(np.ceil(np.log2(np.maximum(np.bincount(self.where, minlength=len(self.hash)), 1))), 63).astype(np.uint8)

    def by_bucket(self, bucket: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """Places of each bucket that has any, of the anchors or of others whose bucket is given."""
        bucket = self.bucket if bucket is None else bucket
        order = np.argsort(bucket, kind="stable")
        found, edges = np.unique(bucket[order], return_index=True)
        for b, rows in zip(found.tolist(), np.split(order, edges[1:]), strict=False):
            yield b, rows

    def keep_shared(self, masks: dict[int, bytes]) -> None:
        """Leaves out the runs whose anchor stands in one document only; runs of hot anchors become windows, equal strings one record."""
        shared, hot = np.zeros(len(self.hash), bool), np.zeros(len(self.hash), bool)
        for b, rows in self.by_bucket():
            both = np.unpackbits(np.frombuffer(masks[b], np.uint8), count=2 * len(rows)).astype(bool)
            shared[rows], hot[rows] = both[: len(rows)], both[len(rows) :]
        keep, split = np.flatnonzero((shared & ~hot)[self.where]), np.flatnonzero((shared & hot)[self.where])
        n = self.length[split] - WINDOW + 1
        at, run = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n), np.repeat(split, n)
        begin, window = self.begin[run] + at, np.full(len(run), WINDOW)
        own = string_hashes(self.whole, begin, window) if len(run) else np.empty(0, np.uint64)
        row, offset = self.row[run], self.offset[run] + at
        order = np.argsort(np.append(self.row[keep], row), kind="stable")
        join = lambda x, more: np.append(x[keep], more)[order]
        self.row, self.begin, self.length, self.offset, self.anchor, self.string = join(self.row, row), join(self.begin, begin), join(self.length, window), join(self.offset, offset), join(self.anchor, own), join(self.string, own)
        self.first, self.record = same_strings(self.whole, self.begin, self.length, self.string)
        self.record_bucket = (self.anchor[self.first] % np.uint64(self.buckets)).astype(np.int64)


def remove_repeats(docs: DataFrame, text: str = "text", id_column: str = "doc_id", home_bytes: int = HOME_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (bytes that stay) for every row of ``docs``."""
    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(docs[id_column].alias("doc_id"), docs[text].alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    homes = common.homes_for(docs.sparkSession, size, home_bytes)
    buckets, hot_runs = homes, HOT_RUNS
    homed = rows.withColumn("home", F.pmod(F.xxhash64("doc_id", F.substring("text", 1, 64)), F.lit(homes)).cast("int"))

    def fingerprints(key, table):
        home = Home(table, buckets, strings=False)
        out = [{"home": key[0].as_py(), "bucket": b, "prints": (home.hash[rows] // np.uint64(buckets)).view(np.uint8).reshape(-1, 8)[:, :FINGERPRINT].tobytes(), "several": np.packbits(home.several[rows]).tobytes(), "loads": squeeze(home.load[rows].tobytes())} for b, rows in home.by_bucket()]
        return pa.Table.from_pylist(out, pa.schema([("home", pa.int32()), ("bucket", pa.int32()), ("prints", pa.binary()), ("several", pa.binary()), ("loads", pa.binary())]))

    def mark(key, table):
        """Two bits for each fingerprint of each home: it stands in several documents, and it is hot."""
        lists, several = [], []
        for prints, bits in zip(table.column("prints"), table.column("several"), strict=True):
            p = np.frombuffer(prints.as_py(), np.uint8).reshape(-1, FINGERPRINT)
            whole = np.zeros((len(p), 8), np.uint8)
            whole[:, :FINGERPRINT] = p
            lists.append(whole.view(np.uint64).ravel())
            several.append(np.unpackbits(np.frombuffer(bits.as_py(), np.uint8), count=len(p)).astype(bool))
        every = np.concatenate(lists)
        values, where, n = np.unique(every, return_inverse=True, return_counts=True)
        shared = n > 1
        shared[where[np.concatenate(several)]] = True
        loads = np.concatenate([np.frombuffer(open_up(x.as_py()), np.uint8) for x in table.column("loads")])
        hot = np.bincount(where, weights=2.0**loads, minlength=len(values)) > hot_runs
        edges = np.cumsum([len(x) for x in lists])[:-1]
        bits = [np.append(s, h) for s, h in zip(np.split(shared[where], edges), np.split(hot[where], edges), strict=True)]
        return pa.table({"home": table.column("home"), "bucket": table.column("bucket"), "mask": pa.array([np.packbits(b).tobytes() for b in bits], pa.binary())})

    def send(key, left, right):
        home = Home(left, buckets)
        masks = dict(zip(right.column("bucket").to_pylist(), right.column("mask").to_pylist(), strict=True))
        home.keep_shared(masks)
        out = []
        for b, records in home.by_bucket(home.record_bucket):
            run = home.first[records]
            out.append({
                "home": left.column("home")[0].as_py(),
                "bucket": b,
                "strings": squeeze(gather(home.whole, home.begin[run], home.length[run]).tobytes()),
                "lengths": home.length[run].astype(np.uint8).tobytes(),
                "docs": squeeze(home.docs[home.row[run]].tobytes()),
                "parts": ((home.anchor[run] >> np.uint64(40)) % np.uint64(PARTS)).astype(np.uint8).tobytes(),
            })
        return pa.Table.from_pylist(out, pa.schema([("home", pa.int32()), ("bucket", pa.int32()), ("strings", pa.binary()), ("lengths", pa.binary()), ("docs", pa.binary()), ("parts", pa.binary())]))

    def sort(key, table):
        """First and last taken window of each string of each home, NONE and NONE where none is."""
        parts = [np.frombuffer(x.as_py(), np.uint8) for x in table.column("parts")]
        lengths = [np.frombuffer(x.as_py(), np.uint8).astype(np.int64) for x in table.column("lengths")]
        docs = [np.frombuffer(open_up(x.as_py()), np.int64) for x in table.column("docs")]
        texts = [np.frombuffer(open_up(x.as_py()), np.uint8) for x in table.column("strings")]
        answers = [np.full((len(p), 2), NONE, np.uint8) for p in parts]
        for part in range(PARTS):
            mine = [np.flatnonzero(p == part) for p in parts]
            n = [len(m) for m in mine]
            if not sum(n):
                continue
            length = np.concatenate([x[m] for x, m in zip(lengths, mine, strict=True)])
            doc = np.concatenate([x[m] for x, m in zip(docs, mine, strict=True)])
            text = np.concatenate([gather(t, (np.cumsum(x) - x)[m], x[m]) for t, x, m in zip(texts, lengths, mine, strict=True)])
            begin = np.cumsum(length) - length
            first, string = same_strings(text, begin, length, string_hashes(text, begin, length))
            low = np.full(len(first), LAST_ID)
            np.minimum.at(low, string, doc)
            own = length[first]
            least, owner = least_documents(gather(text, begin[first], own), np.cumsum(own) - own, own, low)
            taken = least < low[owner]
            at = np.arange(len(owner)) - np.repeat(np.cumsum(own - WINDOW + 1) - (own - WINDOW + 1), own - WINDOW + 1)
            edges = np.cumsum(own - WINDOW + 1) - (own - WINDOW + 1)
            head = np.minimum.reduceat(np.where(taken, at, NONE), edges)
            tail = np.maximum.reduceat(np.where(taken, at, -1), edges)
            # a larger document than the string's smallest loses every window
            all_of = doc > low[string]
            head, tail = np.where(all_of, 0, head[string]), np.where(all_of, length - WINDOW, np.where(tail < 0, NONE, tail)[string])
            for k, (m, h, t) in enumerate(zip(mine, np.split(head, np.cumsum(n)[:-1]), np.split(tail, np.cumsum(n)[:-1]), strict=True)):
                answers[k][m, 0], answers[k][m, 1] = h, t
        return pa.table({"home": table.column("home"), "bucket": table.column("bucket"), "taken": pa.array([squeeze(a.tobytes()) for a in answers], pa.binary())})

    def cut(left, right):
        home = Home(left, buckets)
        masked, answered = right.filter(pc.is_valid(right.column("mask"))), right.filter(pc.is_valid(right.column("taken")))
        home.keep_shared(dict(zip(masked.column("bucket").to_pylist(), masked.column("mask").to_pylist(), strict=True)))
        answers = dict(zip(answered.column("bucket").to_pylist(), answered.column("taken"), strict=True))
        taken = np.full((len(home.first), 2), NONE, np.int64)
        for b, records in home.by_bucket(home.record_bucket):
            taken[records] = np.frombuffer(open_up(answers[b].as_py()), np.uint8).reshape(-1, 2)
        # a run of a larger document than its record's loses every window
        whole = home.docs[home.row] != home.docs[home.row[home.first]][home.record]
        head, tail = np.where(whole, 0, taken[home.record, 0]), np.where(whole, home.length - WINDOW, taken[home.record, 1])
        hit = np.flatnonzero(whole | (head != NONE))
        far = max(map(len, home.texts), default=0) + 1
        begin, end = (home.row * far + home.offset + head)[hit], (home.row * far + home.offset + tail + WINDOW)[hit]
        order = np.argsort(begin, kind="stable")
        begin, end = begin[order], np.maximum.accumulate(end[order])
        fresh = np.append(True, begin[1:] > end[:-1]) if len(begin) else np.empty(0, bool)
        starts, ends = begin[fresh], end[np.append(fresh[1:], True)] if len(begin) else end
        spans: dict[int, list[tuple[int, int]]] = {}
        for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
            row = s // far
            spans.setdefault(row, []).append((s - row * far, e - row * far))
        n_removed, n_spans, kept = [], [], []
        for row, text in enumerate(home.texts):
            found = spans.get(row, [])
            rest = b"".join([text[a:b] for a, b in zip([0, *(e for _, e in found)], [*(s for s, _ in found), len(text)], strict=True)])
            n_removed.append(len(text) - len(rest))
            n_spans.append(len(found))
            kept.append(rest)
        return pa.table({"doc_id": left.column("doc_id").take(pa.array(home.order)), "n_bytes": pa.array([len(t) for t in home.texts], pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "n_spans": pa.array(n_spans, pa.int64()), "kept": pa.array(kept, pa.binary())})

    masks = common.cut_lineage(homed.groupBy("home").applyInArrow(fingerprints, "home int, bucket int, prints binary, several binary, loads binary").groupBy("bucket").applyInArrow(mark, "home int, bucket int, mask binary"))
    strings = homed.groupBy("home").cogroup(masks.groupBy("home")).applyInArrow(send, "home int, bucket int, strings binary, lengths binary, docs binary, parts binary")
    taken = strings.groupBy("bucket").applyInArrow(sort, "home int, bucket int, taken binary")
    replies = masks.withColumn("taken", F.lit(None).cast("binary")).unionByName(taken.withColumn("mask", F.lit(None).cast("binary")))
    return homed.groupBy("home").cogroup(replies.groupBy("home")).applyInArrow(cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary").withColumnRenamed("doc_id", id_column)

"""Scans of the raw archive: ``stream/date=YYYY-MM-DD/hour=HH/*.jsonl.gz`` and its torn relatives.

Spark's own text reader takes sealed files.  Files that its codec table does not know (``.part``,
``.orphan``), and files with damage, go through ``binaryFile`` and a zlib decoder, which keeps the readable
beginning.  Copies that a repair left (``.broken``) are never read.  Raw lines stay next to what is parsed.
"""

from __future__ import annotations

import itertools
import json
import re
import time
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebook import schemas
from tidebook.sources import documents

NAME = r".*\.(jsonl|txt)\.gz(\.part(\.orphan\d*)?|\.orphan\d*)?$"
GLOB = "*.gz*"


def files(spark: SparkSession, root: str, stream: str) -> DataFrame:
    """path, date, hour, length, modified of every archive file of a stream; contents are not read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", GLOB).load(f"{root}/{stream}")
    return listed.select("path", F.regexp_extract("path", r"date=([0-9-]+)", 1).alias("date"), F.regexp_extract("path", r"hour=(\d+)", 1).cast("int").alias("hour"), "length", F.col("modificationTime").alias("modified")).where(F.col("path").rlike(NAME))


def partitions(spark: SparkSession, root: str, stream: str) -> DataFrame:
    """date, hour, n_files, bytes in order of time."""
    return files(spark, root, stream).groupBy("date", "hour").agg(F.count("*").alias("n_files"), F.sum("length").alias("bytes")).orderBy("date", "hour")


def isolate(root: str, stale_s: float = 0.0) -> list[tuple[str, str]]:
    """Renames the unfinished files of a dead writer (``.part``, no change for ``stale_s`` seconds) to ``.part.orphan``, ``.part.orphan1`` ...

    A writer runs it before it opens files of its own, so it never goes on with a file that ends inside a member; the readers here take an orphan's
    readable beginning once, under its new name.  Only names and times are listed.  Gives (old, new) paths.
    """
    store, place = documents.store(root)
    found = store.get_file_info(fs.FileSelector(place, recursive=True, allow_not_found=True))
    taken, out = {f.path for f in found}, []
    for f in sorted(found, key=lambda f: f.path):
        if f.type == fs.FileType.File and f.path.endswith(".part") and f.size > 0 and time.time() - f.mtime_ns / 1e9 >= stale_s:
            names = (f"{f.path}.orphan{n or ''}" for n in itertools.count())
            new = next(n for n in names if n not in taken)
            store.move(f.path, new)
            taken.add(new)
            out.append((f.path, new))
    return out


def verify_some(spark: SparkSession, listed: DataFrame, state: str, most: int = 4) -> DataFrame:
    """One cycle of the check of sealed files: the first ``most`` by path that haven't been read at their present size.

    listed: path, length, modificationTime, content of a ``binaryFile`` scan (contents of other files stay unread) or the like.  What is found is
    added to the durable table at ``state`` (a folder a cycle) and returned: path, length, n_lines, whole.  Unsealed files are skipped.
    """
    known = verified(spark, state).select("path", "length")
    sealed = listed.where(F.col("path").rlike(r"\.gz$"))
    todo = sealed.select("path", "length").join(known, ["path", "length"], "left_anti").orderBy("path").limit(most)
    chosen = sealed.join(F.broadcast(todo), ["path", "length"], "left_semi")
    sizes = chosen.select("path", "length")
    found = readability_of(chosen).select("path", "n_lines", "whole").join(F.broadcast(sizes), "path").select("path", "length", "n_lines", "whole")
    cycle = len([n for n in documents.names(state) if n.startswith("cycle=")])
    place = f"{state}/cycle={cycle}"
    found.write.mode("overwrite").parquet(place)
    return spark.read.schema(VERIFIED).parquet(place)


VERIFIED = "path string, length long, n_lines long, whole boolean"


def verified(spark: SparkSession, state: str) -> DataFrame:
    """path, length, n_lines, whole, cycle of all files that were read so far."""
    cycles = [n for n in documents.names(state) if n.startswith("cycle=") and "_SUCCESS" in documents.names(f"{state}/{n}")]
    if not cycles:
        return spark.createDataFrame([], VERIFIED + ", cycle int")
    return spark.read.schema(VERIFIED + ", cycle int").option("basePath", state).parquet(*(f"{state}/{n}" for n in cycles))


#: Compressed bytes that are taken at once, and in a piece that holds a fault; bytes that come out at once.
PIECE, BITE, MOST = 1 << 16, 512, 1 << 22


class Member:
    """One gzip member from ``start`` on, decompressed piece by piece; then whether it is ``whole`` or ``broken`` (else it is cut off) and where it stops."""

    def __init__(self, raw: bytes | memoryview, start: int = 0):
        self.raw, self.start, self.stop, self.whole, self.broken = memoryview(raw), start, start, False, False

    def __iter__(self):
        machine, at = zlib.decompressobj(31), self.start
        while at < len(self.raw) and not machine.eof:
            rest = self.raw[at : at + PIECE]
            at += len(rest)
            while True:
                before = machine.copy()
                try:
                    data = machine.decompress(rest, MOST)
                except zlib.error:
                    self.broken, self.stop = True, at - len(rest)
                    yield from self.some(before, rest)
                    return
                if data:
                    yield data
                rest = machine.unconsumed_tail
                if machine.eof or not rest and len(data) < MOST:
                    break
        self.whole, self.stop = machine.eof, at - len(machine.unused_data)

    def some(self, machine, piece):
        """As much of a piece with a fault as comes out."""
        for at in range(0, len(piece), BITE):
            try:
                data = machine.decompress(piece[at : at + BITE])
            except zlib.error:
                return
            if data:
                yield data


class Readable:
    """The readable beginning of a file of gzip members, piece by piece; then whether all of it was read."""

    def __init__(self, raw: bytes):
        self.raw, self.whole = raw, False

    def __iter__(self):
        at = 0
        while at < len(self.raw):
            member = Member(self.raw, at)
            yield from member
            if not member.whole:
                return
            at = member.stop
        self.whole = True


def count_lines(raw: bytes) -> tuple[int, bool]:
    """Newlines in a file's members up to the first broken one, and whether all of it was read; nothing is kept."""
    n = at = 0
    while at < len(raw):
        member = Member(raw, at)
        own = sum(data.count(b"\n") for data in member)
        n += 0 if member.broken else own
        if not member.whole:
            return n, False
        at = member.stop
    return n, True


def parted(pieces) -> Iterator[tuple[list[str], bool]]:
    """Lines of pieces of text, some at a time, and at last what follows the last newline (True)."""
    held, size, rest = [], 0, b""
    for piece in pieces:
        *lines, rest = (rest + piece).split(b"\n")
        held += lines
        size += len(piece)
        if size >= MOST:
            yield [x.decode("utf-8", "replace") for x in held], False
            held, size = [], 0
    yield [x.decode("utf-8", "replace") for x in held], False
    yield [rest.decode("utf-8", "replace")], True


def read_lines(spark: SparkSession, root: str, stream: str) -> DataFrame:
    """value, path, line_no, date, hour of every line that can be read, damaged files up to their damage."""
    data = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", GLOB).load(f"{root}/{stream}").where(F.col("path").rlike(NAME))
    return lines_of(data)


def lines_of(data: DataFrame) -> DataFrame:
    """The lines of files given as (path, content); a file is one task's, as gzip can't be split, but only its compressed bytes are held at once."""

    def run(batches):
        for pdf in batches:
            for path, content in zip(pdf.path, pdf.content, strict=True):
                found, n = Readable(content), 0
                for lines, torn in parted(found):
                    if lines and not torn or torn and found.whole and lines[0]:  # what follows the last newline is whole only in a whole file
                        yield pd.DataFrame({"value": lines, "path": path, "line_no": range(n, n + len(lines))})
                    n += len(lines)

    rows = data.select("path", "content").mapInPandas(run, schemas.RAW)
    return rows.withColumn("date", F.regexp_extract("path", r"date=([0-9-]+)", 1)).withColumn("hour", F.regexp_extract("path", r"hour=(\d+)", 1).cast("int"))


def read_sealed(spark: SparkSession, root: str, stream: str) -> DataFrame:
    """The fast path for sealed files: Spark's text reader; a torn file gives its beginning."""
    rows = spark.read.option("ignoreCorruptFiles", "true").option("pathGlobFilter", "*.{jsonl,txt}.gz").text(f"{root}/{stream}")
    return rows.select("value", F.col("_metadata.file_path").alias("path"), F.col("date").cast("string").alias("date"), F.col("hour").cast("int").alias("hour"))


def readability(spark: SparkSession, root: str, stream: str, fresh_s: int = 300) -> DataFrame:
    """path, n_lines, whole, damaged; an unfinished file that changed within ``fresh_s`` seconds is not damage."""
    data = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", GLOB).load(f"{root}/{stream}").where(F.col("path").rlike(NAME))
    return readability_of(data, fresh_s)


def readability_of(data: DataFrame, fresh_s: int = 300) -> DataFrame:
    """The same of files given as (path, content, modificationTime)."""

    def run(batches):
        for pdf in batches:
            found = [count_lines(c) for c in pdf.content]
            yield pd.DataFrame({"path": pdf.path, "n_lines": [n for n, _ in found], "whole": [w for _, w in found], "modified": pdf.modificationTime})

    rows = data.select("path", "content", "modificationTime").mapInPandas(run, "path string, n_lines long, whole boolean, modified timestamp")
    fresh = F.col("path").endswith(".part") & (F.unix_timestamp() - F.unix_timestamp("modified") < fresh_s)
    return rows.withColumn("damaged", ~F.col("whole") & ~fresh)


def good_json(lines: DataFrame) -> DataFrame:
    return lines.where(F.try_parse_json("value").isNotNull())


def malformed(lines: DataFrame) -> DataFrame:
    """The quarantine: lines that are no JSON, as they came."""
    return lines.where(F.try_parse_json("value").isNull()).select("path", "line_no", F.col("value").alias("raw"))


LEVELS = T.ArrayType(T.ArrayType(T.StringType()))


def _at(path: str, kind: str):
    return F.get_json_object("value", f"$.{path}").cast(kind)


def _levels(path: str):
    return F.from_json(F.get_json_object("value", f"$.{path}"), LEVELS)


def parse_depth(lines: DataFrame) -> DataFrame:
    """Depth events of envelopes ``{"t":..,"m":{"stream":..,"data":..}}``; keys that differ by case are taken apart by path."""
    rows = lines.where(F.get_json_object("value", "$.m.data").isNotNull() & (F.get_json_object("value", "$.m.data.u").isNotNull()))
    at = "m.data."
    return rows.select(
        _at("t", "long").alias("recv_ns"), _at(at + "s", "string").alias("symbol"), _at(at + "E", "long").alias("event_ms"),
        _at(at + "U", "long").alias("first_id"), _at(at + "u", "long").alias("final_id"), _at(at + "pu", "long").alias("prev_id"),
        _levels(at + "b").alias("bids"), _levels(at + "a").alias("asks"), "path", "line_no",
    )


def parse_trades(lines: DataFrame) -> DataFrame:
    rows = lines.where(F.get_json_object("value", "$.m.stream").endswith("aggTrade"))
    at = "m.data."
    return rows.select(
        _at("t", "long").alias("recv_ns"), _at(at + "s", "string").alias("symbol"), _at(at + "E", "long").alias("event_ms"), _at(at + "a", "long").alias("trade_id"),
        _at(at + "p", "string").alias("price"), _at(at + "q", "string").alias("qty"), _at(at + "T", "long").alias("trade_ms"), _at(at + "m", "boolean").alias("buyer_is_maker"), "path", "line_no",
    )


def parse_snapshots(lines: DataFrame, symbol: str | None = None) -> DataFrame:
    rows = lines.where(F.get_json_object("value", "$.m.lastUpdateId").isNotNull())
    return rows.select(
        _at("t", "long").alias("recv_ns"), _at("sent", "long").alias("sent_ns"), _at("reason", "string").alias("reason"), F.lit(symbol).cast("string").alias("symbol"),
        _at("m.lastUpdateId", "long").alias("update_id"), _levels("m.bids").alias("bids"), _levels("m.asks").alias("asks"), "path", "line_no",
    )


def route(lines: DataFrame) -> DataFrame:
    """Adds ``stream``: malformed, snapshots, gaps, outages, trades or depth."""
    has = lambda path: F.get_json_object("value", f"$.{path}").isNotNull()
    stream = F.when(F.try_parse_json("value").isNull(), "malformed").when(has("m.lastUpdateId"), "snapshots").when(has("expected_pu"), "gaps").when(has("start_ns") & has("endpoint"), "outages")
    return lines.withColumn("stream", stream.when(F.get_json_object("value", "$.m.stream").endswith("aggTrade"), "trades").otherwise("depth"))


def in_order(rows: DataFrame, keys: list[str] | None = None, by_name: bool = False) -> DataFrame:
    """Adds ``seq``, the arrival order: by receive time, path and line; ``by_name`` takes file names first."""
    first = ["path", "line_no"] if by_name else ["recv_ns", "path", "line_no"]
    return rows.withColumn("seq", F.row_number().over(Window.partitionBy(*(keys or ["symbol"])).orderBy(*first)).cast("long"))


def first_hours(rows: DataFrame, hours: int) -> DataFrame:
    """Rows of the first ``hours`` (date, hour) partitions; all with 0."""
    if not hours:
        return rows
    return rows.join(F.broadcast(rows.select("date", "hour").distinct().orderBy("date", "hour").limit(hours)), ["date", "hour"], "left_semi")


def first_records(rows: DataFrame, n: int) -> DataFrame:
    return rows.orderBy("path", "line_no").limit(n)


def _content(spark: SparkSession, paths: list[str]) -> DataFrame:
    return lines_of(spark.read.format("binaryFile").load([re.sub(r"([\\\[\]{}*?])", r"\\\1", p) for p in paths]))


def read_first_records(spark: SparkSession, root: str, stream: str, n: int) -> DataFrame:
    """``first_records`` of ``read_lines``; files are opened in the order of their names until they hold ``n`` lines, later ones can hold none of them."""
    paths = [r["path"] for r in files(spark, root, stream).select("path").orderBy("path").collect()]  # names only
    upto = 1
    while upto < len(paths) and _content(spark, paths[:upto]).limit(n).count() < n:
        upto *= 4
    return first_records(_content(spark, paths[:upto]) if paths else read_lines(spark, root, stream), n)


def read_first_hours(spark: SparkSession, root: str, stream: str, hours: int) -> DataFrame:
    """``first_hours`` of ``read_lines``; only the files of as many hours are opened as are needed to find ``hours`` that hold lines."""
    if not hours:
        return read_lines(spark, root, stream)
    paths = files(spark, root, stream)
    listed = [(r["date"], r["hour"]) for r in paths.select("date", "hour").distinct().orderBy("date", "hour").collect()]  # hours only
    upto = hours
    while True:
        last = listed[: upto][-1:] or [("", 0)]
        chosen = paths.where((F.col("date") < last[0][0]) | ((F.col("date") == last[0][0]) & (F.col("hour") <= last[0][1])))
        names = [r["path"] for r in chosen.select("path").collect()]
        rows = _content(spark, names) if names else read_lines(spark, root, stream)
        if upto >= len(listed) or rows.select("date", "hour").distinct().count() >= hours:
            return first_hours(rows, hours)
        upto *= 2


def newest(spark: SparkSession, glob: str) -> DataFrame:
    """The run artifact that was written last, of JSON documents."""
    rows = spark.read.option("multiLine", "true").json(glob).withColumn("_at", F.col("_metadata.file_modification_time")).withColumn("_path", F.col("_metadata.file_path"))
    return rows.orderBy(F.desc("_at"), F.desc("_path")).limit(1).drop("_at", "_path")


# -- salvage ------------------------------------------------------------------------------

#: A member's head: magic number, deflate, known flags, extra flags and system, or as much of it as a file's end leaves; the first three bytes alone come
#: about by chance once in 16 MB.
MAGIC = re.compile(rb"\x1f\x8b\x08(?:[\x00-\x1f].{4}[\x00\x02\x04][\x00-\x0d\xff]|.{0,6}\Z)", re.DOTALL)


class Salvage:
    """Every gzip member from its head on, whatever lies between, piece by piece; then the members read and the damaged places.

    In a member that is cut off by the file's end a head may be its own data by chance; it counts if what follows it is sound.
    """

    def __init__(self, raw: bytes):
        self.raw, self.members, self.damaged = raw, 0, 0

    def __iter__(self):
        at = cut = self.members = self.damaged = 0
        while (m := MAGIC.search(self.raw, at)) is not None:
            if m.start() < cut:
                member = Member(self.raw, m.start())
                size = sum(len(data) for data in member)
                if member.broken or not size:
                    at = m.start() + 3
                    continue
            if m.start() > at:
                self.damaged += 1
            member, some = Member(self.raw, m.start()), False
            for data in member:
                some = True
                yield data
            self.members += some or member.whole
            if member.whole:
                at = member.stop
            else:
                self.damaged += 1
                at = m.start() + 3
                if not member.broken:
                    cut = len(self.raw)


def salvage(raw: bytes) -> tuple[bytes, int, int]:
    """(bytes, members read, damaged places) of a small file at once."""
    found = Salvage(raw)
    return b"".join(found), found.members, found.damaged


def salvage_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, line_no, value, members, damaged of all whole JSON lines that damaged files still hold; written anew, never in place."""
    return salvage_of(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))


def is_json(line: str) -> bool:
    try:
        json.loads(line)
    except ValueError:
        return False
    return True


def salvage_of(data: DataFrame) -> DataFrame:
    """The same of files given as (path, content)."""

    def run(batches):
        for pdf in batches:
            for name, content in zip(pdf.path, pdf.content, strict=True):
                found, n = Salvage(content), 0
                for _ in found:  # every row bears the figures of its whole file, so they come first
                    pass
                members, damaged = found.members, found.damaged
                for lines, _ in parted(found):
                    kept = [(name, n + i, line, members, damaged) for i, line in enumerate(lines) if is_json(line)]
                    n += len(lines)
                    yield pd.DataFrame(kept, columns=["path", "line_no", "value", "members", "damaged"])

    return data.select("path", "content").mapInPandas(run, "path string, line_no long, value string, members int, damaged int")

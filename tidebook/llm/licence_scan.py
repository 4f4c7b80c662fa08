"""License scans: an Aho-Corasick machine finds tags, names and notices; a shunting-yard parser reads licence expressions.

A text becomes its words (letters and digits of ASCII in lower case, all other characters above 127).  One machine over the
words finds every place of the phrases below, overlapping ones too.  Places of four plain phrases are the *base*.
The method adds to it: the longest names and notices, and the expressions that follow a tag (``SPDX-License-Identifier:``,
``"license":``) or a lead ("licensed under the"), such as ``(MIT OR Apache-2.0) AND GPL-2.0+ WITH Classpath-exception-2.0``.
Identifiers (``MIT``, ``ISC``) count inside expressions only, since as plain words they mean other things.

An expression is put in postfix order by precedence (with, and, or) and evaluated over classes of
obligation, mildest first: the reader of an "or" picks the mildest side, an "and" binds to the strictest, and an exception after
"with" lets a copyleft licence count as a weak one.  The score is one minus the product of what each kind of
evidence leaves open, a kind counting once for each label.

Contract.  Null and empty texts have no words, no places and a score of 0.  Every text is read whole, whatever its length; one
text is held at a time.  Repeated rows are rows of their own; ids are of any type and pass through as they are; other columns, whatever their
names, are not read.  Ties: of names that overlap, the one that starts first counts, then the longest.  An expression that
breaks off ("MIT or see below") counts up to its last whole operand.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.llm import common

#: The base: phrase and label.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Classes of obligation, mildest first.
CLASSES = ("public", "permissive", "weak", "copyleft", "network", "restricted", "reserved")

#: Label, class, identifiers (in expressions only), names (anywhere).
LICENCES = (
    ("mit", "permissive", ("mit", "x11", "expat", "mit 0"), ("mit license", "mit licence", "expat license", "x11 license")),
    ("bsd", "permissive", ("bsd", "0bsd", "bsd 2 clause", "bsd 3 clause", "bsd 4 clause"), ("bsd license", "bsd licence", "bsd 2 clause license", "bsd 3 clause license", "new bsd license", "simplified bsd license", "modified bsd license")),
    ("apache", "permissive", ("apache", "apache 2", "apache 2 0", "apache 1 1", "asl 2 0"), ("apache license", "apache licence", "apache software license")),
    ("isc", "permissive", ("isc",), ("isc license",)),
    ("zlib", "permissive", ("zlib",), ("zlib license", "zlib libpng license")),
    ("boost", "permissive", ("bsl 1 0",), ("boost software license",)),
    ("psf", "permissive", ("psf 2 0", "python 2 0"), ("python software foundation license",)),
    ("unlicense", "public", ("unlicense",), ()),
    ("wtfpl", "public", ("wtfpl",), ("do what the fuck you want to public license",)),
    ("cc0", "public", ("cc0", "cc0 1 0"), ("cc0 1 0 universal", "creative commons zero")),
    ("lgpl", "weak", ("lgpl", "lgpl 2", "lgpl 2 0", "lgpl 2 1", "lgpl 3", "lgpl 3 0", "lgplv2 1", "lgplv3"), ("gnu lesser general public license", "gnu library general public license", "gnu lgpl")),
    ("mpl", "weak", ("mpl", "mpl 1 1", "mpl 2 0"), ("mozilla public license",)),
    ("epl", "weak", ("epl 1 0", "epl 2 0"), ("eclipse public license",)),
    ("cddl", "weak", ("cddl 1 0", "cddl 1 1"), ("common development and distribution license",)),
    ("eupl", "weak", ("eupl 1 1", "eupl 1 2"), ("european union public licence",)),
    ("artistic", "weak", ("artistic 1 0", "artistic 2 0"), ("artistic license",)),
    ("ofl", "weak", ("ofl 1 1",), ("sil open font license", "open font license")),
    ("gpl", "copyleft", ("gpl", "gpl 1 0", "gpl 2", "gpl 2 0", "gpl 3", "gpl 3 0", "gplv2", "gplv3"), ("gnu general public license", "gnu general public licence", "gnu gpl")),
    ("gfdl", "copyleft", ("gfdl", "gfdl 1 2", "gfdl 1 3"), ("gnu free documentation license",)),
    ("agpl", "network", ("agpl", "agpl 3", "agpl 3 0", "agplv3"), ("gnu affero general public license", "gnu agpl")),
    ("sspl", "network", ("sspl 1 0",), ("server side public license",)),
    ("cc-by", "permissive", ("cc by",), ("cc by", "creative commons attribution")),
    ("cc-by-sa", "copyleft", (), ("cc by sa", "creative commons attribution sharealike", "creative commons attribution share alike")),
    ("cc-by-nc", "restricted", (), ("cc by nc", "creative commons attribution noncommercial", "creative commons attribution non commercial")),
    ("cc-by-nd", "restricted", (), ("cc by nd", "creative commons attribution noderivatives", "creative commons attribution noderivs")),
    ("cc-by-nc-sa", "restricted", (), ("cc by nc sa", "creative commons attribution noncommercial sharealike")),
    ("cc-by-nc-nd", "restricted", (), ("cc by nc nd", "creative commons attribution noncommercial noderivatives")),
    ("proprietary", "reserved", ("proprietary", "unlicensed", "commercial"), ("proprietary license", "commercial license")),
)

#: Phrases of the licences' own texts.
NOTICES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("gpl", "redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("agpl", "redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("zlib", "without any express or implied warranty in no event will the authors be held liable"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("proprietary", "unauthorized copying of this file via any medium is strictly prohibited"),
)

#: What opens an expression: identifier tags, keys (a colon or equals sign must follow), leads.
TAGS = ("spdx license identifier", "license identifier", "package license declared", "package license concluded")
KEYS = ("license", "licence", "licenses")
LEADS = ("licensed under", "licenced under", "released under", "distributed under", "available under", "published under", "provided under", "under the terms of", "covered by", "governed by")
#: Exceptions that may stand after "with".
EXCEPTIONS = ("classpath exception", "gcc exception", "llvm exception", "font exception", "linking exception", "autoconf exception", "bison exception", "openssl exception")

#: What each kind of evidence leaves open.
OPEN = {"tag": 0.05, "notice": 0.1, "lead": 0.2, "name": 0.5}
FILLERS = frozenset("the a an either both terms of license licence licenses version v software".split())
CLASS_OF = {label: CLASSES.index(kind) for label, kind, _, _ in LICENCES}
#: What may lie between the words of an expression; a line break too in running text, and inside brackets.
GAP, WRAPPED = re.compile(rb"[ \t,()/\"'`*+-]*\Z"), re.compile(rb"[ \t,()/\"'`*#+-]*(\r?\n[ \t,()/\"'`*#+-]*)?\Z")
#: What may lie before the first word.
FIRST_GAP = re.compile(rb"[ \t()/\"'`*#:=>,\[-]*(\r?\n[ \t()/\"'`*#:=>-]*)?\Z")
NUMBER = re.compile(rb"v?[0-9]+\Z")
LATER = ((b"or", b"later"), (b"or", b"newer"), (b"or", b"any", b"later", b"version"), (b"or", b"later", b"version"), (b"or", b"at", b"your", b"option", b"any", b"later", b"version"), (b"only",))

#: A-Z in lower case, ASCII letters and digits as they are, all else below 128 a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


@functools.cache
def machine() -> ahocorasick.Automaton:
    """Every phrase between spaces, with what it stands for: (kind, label, words)."""
    known: dict[str, list[tuple[str, str, int]]] = {}

    def add(phrase: str, kind: str, label: str) -> None:
        known.setdefault(phrase, []).append((kind, label, phrase.count(" ") + 1))

    for phrase, label in BASE.items():
        add(phrase, "base", label)
    for label, _, _, names in LICENCES:
        for phrase in names:
            add(phrase, "name", label)
    for label, phrase in NOTICES:
        add(phrase, "notice", label)
    for kind, phrases in (("tag", TAGS), ("key", KEYS), ("lead", LEADS)):
        for phrase in phrases:
            add(phrase, kind, phrase)
    found = ahocorasick.Automaton()
    for phrase, values in known.items():
        found.add_word(f" {phrase} ", values)
    found.make_automaton()
    return found


@functools.cache
def operands() -> dict[tuple[bytes, ...], str]:
    """Words of an operand to its label."""
    return {tuple(phrase.encode().split()): label for label, _, ids, names in LICENCES for phrase in (*ids, *names)}


@functools.cache
def exceptions() -> dict[tuple[bytes, ...], str]:
    return {tuple(phrase.encode().split()): phrase for phrase in EXCEPTIONS}


def longest(table: dict[tuple[bytes, ...], str], words, at: int) -> tuple[str | None, int]:
    """(value, words) of the longest phrase of ``table`` that begins at a word."""
    for n in range(min(8, words.n - at), 0, -1):
        value = table.get(tuple(words[at + k] for k in range(n)))
        if value is not None:
            return value, n
    return None, 0


class Words:
    """The words of a text: their bytes, and where they lie in it."""

    def __init__(self, raw: bytes):
        self.raw, self.folded = raw, raw.translate(FOLD)
        letters = np.frombuffer(self.folded, np.uint8) != 32
        edges = np.flatnonzero(np.diff(np.concatenate(([False], letters, [False])).view(np.int8)))
        self.starts, self.stops = edges[::2], edges[1::2]
        self.n = len(self.starts)
        self._letters = letters

    def joined(self) -> str:
        """All words with single spaces around, a character for each byte."""
        keep = self._letters.copy()
        keep[self.stops[:-1]] = True  # one space after each word but the last
        return f" {np.frombuffer(self.folded, np.uint8)[keep].tobytes().decode('latin-1')} "

    def places(self) -> np.ndarray:
        """Where each word begins in ``joined``."""
        return np.concatenate(([0], np.cumsum(self.stops - self.starts + 1)))[:-1] + 1 if self.n else np.zeros(0, np.int64)

    def __getitem__(self, i: int) -> bytes:
        return self.folded[self.starts[i] : self.stops[i]]

    def gap(self, i: int) -> bytes:
        """What lies before a word, since the word before it."""
        return self.raw[self.stops[i - 1] if i else 0 : self.starts[i]]


def tokens(words: Words, at: int, prose: bool = False) -> list[tuple[str, str, int]]:
    """(kind, value, word after it) of an expression that begins at a word: id, exception, and, or, with, open, close."""
    out: list[tuple[str, str, int]] = []
    i, depth, operand_next = at, 0, True
    while i < words.n:
        gap = words.gap(i)
        version = gap == b"." and i > at and NUMBER.match(words[i - 1]) and NUMBER.match(words[i])
        if not version and not (FIRST_GAP if i == at else WRAPPED if prose or depth else GAP).match(gap):
            break
        for c in gap.decode("latin-1"):
            if c == "(" and operand_next:
                out.append(("open", "(", i))
                depth += 1
            elif c == ")" and not operand_next:
                if not depth:
                    return out
                out.append(("close", ")", i))
                depth -= 1
            elif c == "/" and not operand_next and out and out[-1][0] not in ("and", "or", "with"):
                out.append(("or", "or", i))
                operand_next = True
        word = words[i]
        if operand_next:
            if out and out[-1][0] == "with":
                value, n = longest(exceptions(), words, i)
                if value is None and word in FILLER_BYTES:  # "with the Classpath exception"
                    i += 1
                    continue
                if value is None:
                    break
                out.append(("exception", value, i + n))
            else:
                value, n = longest(operands(), words, i)
                if value is None and word == b"licenseref" and i + 1 < words.n:
                    value, n = "licenseref", 2
                if value is None:
                    if word in FILLER_BYTES or (out and out[-1][0] in ("and", "or") and word == out[-1][0].encode()):
                        i += 1
                        continue
                    break
                out.append(("id", value, i + n))
            i += n
            operand_next = False
            continue
        later = next((l for l in LATER if i + len(l) <= words.n and tuple(words[i + k] for k in range(len(l))) == l), None)
        if later:
            i += len(later)
        elif word in (b"and", b"or", b"with"):
            kind = word.decode()
            if kind == "and" and i + 1 < words.n and words[i + 1] == b"or" and words.gap(i + 1) == b"/":
                kind, i = "or", i + 1
            out.append((kind, kind, i + 1))
            operand_next = True
            i += 1
        elif word in FILLER_BYTES or NUMBER.match(word):
            i += 1
        else:
            break
    else:
        # the text ends inside the expression; what closes it lies after the last word
        for c in words.raw[words.stops[-1] :].decode("latin-1") if words.n else "":
            if c == ")" and depth and not operand_next:
                out.append(("close", ")", words.n))
                depth -= 1
            elif c != ")" and not GAP.match(c.encode("latin-1")):
                break
    return out


FILLER_BYTES = frozenset(w.encode() for w in FILLERS)
PRECEDENCE = {"with": 3, "and": 2, "or": 1}


def postfix(found: list[tuple[str, str, int]]) -> list[tuple[str, str]]:
    """The expression's operands and operators in postfix order; brackets that stay open are closed at the end, an operator without a right side is left out."""
    found = list(found)
    while found and found[-1][0] in ("and", "or", "with", "open"):
        found.pop()
    out: list[tuple[str, str]] = []
    waiting: list[str] = []
    for kind, value, _ in found:
        if kind in ("id", "exception"):
            out.append((kind, value))
        elif kind == "open":
            waiting.append("(")
        elif kind == "close":
            while waiting and waiting[-1] != "(":
                out.append(("operator", waiting.pop()))
            if waiting:
                waiting.pop()
        else:
            while waiting and waiting[-1] != "(" and PRECEDENCE[waiting[-1]] >= PRECEDENCE[kind]:
                out.append(("operator", waiting.pop()))
            waiting.append(kind)
    out += [("operator", w) for w in reversed(waiting) if w != "("]
    return out


def evaluate(rpn: list[tuple[str, str]]) -> tuple[str, list[str]]:
    """(class of obligation, labels) of an expression in postfix order."""
    stack: list[tuple[int, frozenset[str]]] = []
    for kind, value in rpn:
        if kind == "id":
            stack.append((CLASS_OF.get(value, CLASSES.index("reserved")), frozenset([value])))
        elif kind == "exception":
            stack.append((-1, frozenset()))
        else:
            right, left = stack.pop(), stack.pop()
            if value == "with":
                kind_of = min(left[0], CLASSES.index("weak")) if left[0] in (CLASSES.index("copyleft"), CLASSES.index("network")) else left[0]
                stack.append((kind_of, left[1]))
            else:
                pick = max if value == "and" else min
                stack.append((pick(left[0], right[0]), left[1] | right[1]))
    rank, labels = stack[-1]
    return CLASSES[rank], sorted(labels)


def written(rpn: list[tuple[str, str]]) -> str:
    return " ".join(value.replace(" ", "-") if kind == "exception" else value.upper() if kind == "operator" else value for kind, value in rpn)


def scan(text: str | None) -> tuple[int, list[dict], list[dict], list[dict], list[str], float]:
    """(words, base places, the method's places, expressions, labels, score) of one text."""
    words = Words((text or "").encode())
    if not words.n:
        return 0, [], [], [], [], 0.0
    hits = list(machine().iter(words.joined()))
    if not hits:
        return words.n, [], [], [], [], 0.0
    begins = words.places()
    base, names, opens = [], [], []
    for end, values in hits:
        last = int(np.searchsorted(begins, end, "right")) - 1  # the hit's last character is the space after its last word
        for kind, label, n in values:
            start = last - n + 1
            if kind == "base":
                base.append({"label": label, "start": start, "words": n})
            elif kind in ("name", "notice"):
                names.append((start, -n, kind, label))
            elif start + n < words.n and (kind != "key" or re.search(rb"[:=]", words.gap(start + n))):
                opens.append((start, n, "lead" if kind == "lead" else "tag"))
    base.sort(key=lambda b: (b["start"], b["label"]))
    places, expressions, upto = [], [], -1
    for start, less, kind, label in sorted(names):
        if start >= upto:
            places.append({"kind": kind, "label": label, "start": start, "words": -less})
            upto = start - less
    done = -1
    for start, n, kind in sorted(opens, key=lambda o: (o[0] + o[1], o[0])):
        first = start + n
        if first < done:
            continue  # inside the expression before
        found = tokens(words, first, kind == "lead")
        rpn = postfix(found)
        if rpn:
            done = max(after for k, _, after in found if k in ("id", "exception"))
            kind_of, labels = evaluate(rpn)
            expressions.append({"kind": kind, "start": first, "stop": done, "postfix": written(rpn), "class": kind_of, "labels": labels})
    evidence = {(p["label"], p["kind"]) for p in places} | {(l, e["kind"]) for e in expressions for l in e["labels"]} | {(b["label"], "name") for b in base}
    left = 1.0
    for _, kind in sorted(evidence):
        left *= OPEN[kind]
    labels = sorted({label for label, _ in evidence})
    return words.n, base, places, expressions, labels, 1.0 - left


PLACE = pa.struct([("label", pa.string()), ("start", pa.int64()), ("words", pa.int64())])
NAMED = pa.struct([("kind", pa.string()), ("label", pa.string()), ("start", pa.int64()), ("words", pa.int64())])
EXPRESSION = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("postfix", pa.string()), ("class", pa.string()), ("labels", pa.list_(pa.string()))])
KINDS = [pa.int64(), pa.list_(PLACE), pa.list_(NAMED), pa.list_(EXPRESSION), pa.list_(pa.string()), pa.float64()]
FOUND = "n_words long, base array<struct<label:string,start:long,words:long>>, places array<struct<kind:string,label:string,start:long,words:long>>, expressions array<struct<kind:string,start:long,stop:long,postfix:string,class:string,labels:array<string>>>, labels array<string>, score double"


def find_licences(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """id_column, n_words, base, places, expressions, labels, score of every row, in one narrow pass; positions are in words from 0."""
    rows = docs.select(F.col(id_column).alias("_id"), F.col(text).alias("_text"))
    own = rows.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.small(batches, 256):
            found = [scan(t.as_py()) for t in batch.column(1)]
            columns = list(zip(*found, strict=True)) if found else [[] for _ in KINDS]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, KINDS, strict=True))], names=["_id", "n_words", "base", "places", "expressions", "labels", "score"])

    return rows.mapInArrow(run, f"_id {own}, {FOUND}").withColumnRenamed("_id", id_column)

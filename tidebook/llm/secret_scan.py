"""Secret scan: fixed patterns plus a battery of randomness tests.

Fixed patterns find assignments, access keys and hex runs.  Beyond them every token of ``MIN_TOKEN`` letters and more is put
to tests for the encoding its letters fit (hex, base32, base36, base62, base64):

* chi-squared uniformity of its letters over that alphabet,
* runs of lower case, upper case and digits, which are short in a random token, and runs of vowels and consonants, which are long,
* serial correlation of neighbouring letters, which is high in counters and alphabets in order.

The null hypothesis is that a token is an ordinary word, identifier or number, or a sequence in order.  Fisher's method joins the p-values
of the tests against the first (those that apply to the encoding); against the second stands the serial test.  A token is
random only if both are rejected, so its p-value is the larger one.  A false-discovery control over the tokens of a document, with weights in
proportion to token length, decides which tokens are reported as ``random`` spans.  A token with separators (``/ - _ +``) is tested
whole and in its parts, and the smaller p-value decides which it stands for.

Texts: null or empty texts have no spans.  Whole texts of any length are scanned; positions are
code points, the end is exclusive.  Rows are independent, so repeated rows get equal results; ties of p-values are kept or left together
by position; an empty table gives an empty one.  Columns besides the id and the text are left out of the spans and kept by the redaction.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from tidebook.llm import common

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
#: Tokens put to the tests have so many letters of the widest alphabet.
MIN_TOKEN = 16
TOKEN = re.compile(rf"[A-Za-z0-9+/_-]{{{MIN_TOKEN},}}={{0,2}}")
PART = re.compile(rf"[A-Za-z0-9]{{{MIN_TOKEN},}}")
#: False discoveries accepted among reported tokens of a document.
FALSE_DISCOVERY = 0.01
#: Departure from uniform letters (chi-squared a letter) that an ordinary token has at least, by encoding.
ORDINARY_SKEW = {"hex": 0.9, "HEX": 0.9, "base32": 1.1, "base36": 1.2, "BASE36": 1.2, "base62": 1.5, "base64": 1.5, "base64url": 1.5}
#: Shares of neighbours of an ordinary token that change between letters and digits (at most), or lower case, upper case and digits
#: where it has both cases, and between vowel and consonant (at least).
ORDINARY_CHANGES, MIXED_CHANGES, ORDINARY_VOWELS = 0.12, 0.24, 0.6
#: Serial correlation that a sequence in order has at least.
ORDERED = 0.75

ALPHABETS = {  # from narrow to wide
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "BASE36": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
SETS = {name: frozenset(letters) for name, letters in ALPHABETS.items()}


def phi(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def encoding_of(token: str) -> str | None:
    used = set(token.rstrip("="))
    return next((name for name, letters in SETS.items() if used <= letters), None)


def klass(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3


def fewer(seen: int, n: int, share: float) -> float:
    """The chance of so few of n, each with ``share``, by a normal approximation."""
    return phi((seen + 0.5 - share * n) / math.sqrt(n * share * (1 - share)))


def fisher(ps: list[float]) -> float:
    """Upper tail of chi-squared with two degrees a test."""
    x = -sum(math.log(max(p, 1e-300)) for p in ps)
    term = total = 1.0
    for k in range(1, len(ps)):
        term *= x / k
        total += term
    return math.exp(-x) * total


def uniformity_p(body: str, name: str) -> float:
    """The chance that an ordinary token's letters are so even: noncentral chi-squared, lower tail, by a normal approximation."""
    k, n = len(ALPHABETS[name]), len(body)
    counts: dict[str, int] = {}
    for c in body:
        counts[c] = counts.get(c, 0) + 1
    chi2 = k / n * sum(v * v for v in counts.values()) - n
    away = ORDINARY_SKEW[name] * n
    return phi((chi2 - (k - 1 + away)) / math.sqrt(2 * (k - 1 + 2 * away)))


def runs_ps(body: str) -> list[float]:
    """p-values of the tests of runs that apply: classes, where there is more than one; vowels, where there are enough letters."""
    joined = re.sub(r"[+/_-]", "", body)  # separators make no changes
    kinds = [klass(c) for c in joined]
    out = []
    if len(set(kinds)) > 1:
        n = len(kinds) - 1
        out.append(1 - fewer(sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) - 1, n, MIXED_CHANGES if {1, 2} <= set(kinds) else ORDINARY_CHANGES))
    vowels = [c in "aeiouyAEIOUY" for c in joined]
    pairs = [v != w for v, w, a, b in zip(vowels, vowels[1:], kinds, kinds[1:], strict=False) if a and b]
    if len(pairs) >= MIN_TOKEN // 2:
        out.append(fewer(sum(pairs), len(pairs), ORDINARY_VOWELS))
    return out


def serial_p(body: str, name: str) -> float:
    """The chance that a sequence in order has so little serial correlation."""
    letters = ALPHABETS[name]
    index = [letters.index(c) for c in body]
    n = len(index)
    centre = sum(index) / n
    total = sum((x - centre) ** 2 for x in index)
    serial = sum((a - centre) * (b - centre) for a, b in zip(index, index[1:], strict=False)) / total if total else 1.0
    return phi((abs(serial + 1 / n) - ORDERED) * math.sqrt(n / (1 - ORDERED**2)))


def ordinary_p(token: str) -> float:
    """The chance that an ordinary token, or a sequence in order, looks as random as this one."""
    name = encoding_of(token)
    body = token.rstrip("=")
    if name is None or body.isdecimal():
        return 1.0
    return max(fisher([uniformity_p(body, name), *runs_ps(body)]), serial_p(body, name))


def tested(token: str, at: int) -> list[tuple[int, int, float]]:
    """(start, end, p) of the token, or of its parts between separators if one of them looks more random."""
    whole = [(at, at + len(token), ordinary_p(token))]
    parts = [(at + m.start(), at + m.end(), ordinary_p(m.group())) for m in PART.finditer(token)]
    return parts if parts and min(p for *_, p in parts) < whole[0][2] else whole


def discoveries(tokens: list[tuple[int, int, float]]) -> list[tuple[int, int]]:
    """Weighted step-up control: (start, end, p) to the spans kept; longer tokens have more weight."""
    if not tokens:
        return []
    total = sum(e - s for s, e, _ in tokens)
    weighted = sorted((p * total / ((e - s) * len(tokens)), s, e) for s, e, p in tokens)
    keep = max((i for i, (p, _, _) in enumerate(weighted, 1) if p <= FALSE_DISCOVERY * i / len(weighted)), default=0)
    return [(s, e) for _, s, e in weighted[:keep]]


def scan(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind in the order of KINDS."""
    if not text:
        return []
    out = []
    if "=" in text or ":" in text:
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    out += [("random", s, e) for s, e in discoveries([x for m in TOKEN.finditer(text) for x in tested(m.group(), m.start())])]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def redact(text: str | None, mark: str = "[SECRET]") -> str | None:
    """The text with each maximal run of overlapping spans replaced by ``mark``."""
    spans = scan(text)
    if not spans:
        return text
    out, at, end = [], 0, -1
    for _, s, e in spans:
        if s > end:
            if end >= 0:
                at = end
            out += [text[at:s], mark]
            end = e
        else:
            end = max(end, e)
    return "".join([*out, text[end:]])


def find_secrets(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """``id_column`` and ``spans`` (array of kind, start, end) for every row; one pass, no exchange."""
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches):
        span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())])
        for batch in common.small(batches):
            found = [[{"kind": k, "start": s, "stop": e} for k, s, e in scan(t)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(span))], ["id", "spans"])

    return docs.select(docs[id_column].alias("id"), docs[text]).mapInArrow(run, f"id {kind}, spans array<struct<kind:string,start:long,stop:long>>").withColumnRenamed("id", id_column)


def redact_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the secrets of ``text`` replaced; every row and every column stays."""
    place = docs.columns.index(text)

    def run(batches):
        for batch in common.small(batches):
            clean = pa.array([redact(t) for t in batch.column(place).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([clean if i == place else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)

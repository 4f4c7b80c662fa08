"""BPE encoding and decoding by per-prefix dynamic programming.

For every prefix of a word exactly one vocabulary token can be the last one of that prefix's
encoding.  The encoder walks the word once; at each end position an automaton over reversed
tokens lists every token that ends there, and the one that is compatible with the last token
of the remaining prefix is stored.  Following the stored tokens backwards gives the exact ids.

Two tokens are compatible when no merge rule joins a piece of the right edge of the first
with a piece of the left edge of the second while both pieces exist.

Texts: null and empty texts give no ids and an empty decoded text.  Strings of special tokens
inside a text give their ids, as the public tokenizers library does.  Whole texts are encoded; a
word of any length takes time in proportion to its length.  Rows are independent: repeated rows and equal texts get equal
results, an empty table gives an empty one.
"""

from __future__ import annotations

import json
import os
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from tidebook.llm import common

#: Words kept in a worker's memo before it is emptied.
MEMO_WORDS = 150_000
#: Pair tests kept before they are emptied.
MEMO_PAIRS = 300_000
#: Letters that end a word are moved to this block, so each unit stays one character.
END_BLOCK = 0xF0000
#: Letters outside of these have other classes or lower cases in some versions of Unicode: there the library's own tables decide.
ODD = regex.compile("[^\x00-\u024f\u0391-\u03a1\u03a3-\u03c9\u0400-\u045f\u2010-\u2027\u20ac\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]")


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class PrefixBPE:
    """Encoder and decoder for a word-level BPE vocabulary file."""

    def __init__(self, path: str):
        self.path, self._library = path, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.text_of = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.specials.items()}
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"])
        self.mark = os.path.commonprefix(list(self.specials))  # what all special tokens begin with
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, self.specials)) + ")") if self.specials else None
        self.bytes_to_text = byte_alphabet()
        self.text_to_byte = {c: b for b, c in self.bytes_to_text.items()}
        self._learn(model["vocab"], model["merges"])
        self._pairs: dict[tuple[int, int], bool] = {}

    # -- vocabulary ------------------------------------------------------------------------
    def _units(self, token: str) -> str:
        """Token text with one character for each unit: the last one of a word stands in another block."""
        if self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix):
            body = token[: -len(self.suffix)]
            return body[:-1] + chr(END_BLOCK + ord(body[-1]))
        return token

    def _learn(self, vocab: dict[str, int], merges: list) -> None:
        units = {self._units(t): i for t, i in vocab.items()}
        self.rank: dict[tuple[int, int], int] = {}
        made: dict[int, tuple[int, int, int]] = {}  # token: rank of the rule that makes it, and its two parts
        for r, rule in enumerate(merges):
            left, right = rule if isinstance(rule, list) else rule.split(" ")
            a, b, whole = vocab[left], vocab[right], vocab[left + right]
            self.rank[a, b] = r
            made.setdefault(whole, (r, a, b))
        self._right: dict[int, list] = {}
        self._left: dict[int, list] = {}
        root: dict = {}
        for text, i in units.items():
            if i not in made and len(text) > 1:
                continue  # no rule makes it
            self._right[i], self._left[i] = self._edge(i, made, 2), self._edge(i, made, 1)
            node = root
            for c in reversed(text):
                node = node.setdefault(c, {})
            node[0] = i
        self._root = root

    @staticmethod
    def _edge(token: int, made: dict, side: int) -> list[tuple[int, int, float]]:
        """Pieces that stand at one edge of a token in turn: piece, rank at which it comes, rank at which it goes."""
        out, gone = [], float("inf")
        while True:
            rule = made.get(token)
            out.append((token, rule[0] if rule else -1, gone))
            if not rule:
                return out
            gone, token = rule[0], rule[side]

    def compatible(self, a: int, b: int) -> bool:
        known = self._pairs.get((a, b))
        if known is None:
            known = True
            for x, came_x, gone_x in self._right[a]:
                for y, came_y, gone_y in self._left[b]:
                    r = self.rank.get((x, y))
                    # rules of one rank run from the left, so the left token's own use of x comes first
                    if r is not None and came_x < r < gone_x and came_y < r <= gone_y:
                        known = False
            if len(self._pairs) >= MEMO_PAIRS:
                self._pairs.clear()
            self._pairs[a, b] = known
        return known

    # -- words -----------------------------------------------------------------------------
    def encode_word(self, word: str) -> list[int]:
        """Ids of one pre-token."""
        table = self.bytes_to_text
        text = "".join([table[b] for b in word.encode("utf-8", "surrogatepass")])
        if self.suffix:
            text = text[:-1] + chr(END_BLOCK + ord(text[-1]))
        n, root, test = len(text), self._root, self.compatible
        last, begins = [-1] * (n + 1), [0] * (n + 1)
        for end in range(1, n + 1):
            node, start = root, end
            while start:
                start -= 1
                node = node.get(text[start])
                if node is None:
                    break
                token = node.get(0)
                if token is not None and (start == 0 or (last[start] >= 0 and test(last[start], token))):
                    last[end], begins[end] = token, start
                    break
        out, end = [], n
        while end:
            if last[end] < 0:
                raise ValueError(f"no encoding of {word!r}")
            out.append(last[end])
            end = begins[end]
        return out[::-1]

    # -- texts -----------------------------------------------------------------------------
    def pretokens(self, text: str) -> list[str]:
        if not text.isascii():
            if ODD.search(text):
                return self.tabled(text)
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # letters are lowered one by one
        return self.words.findall(text.lower())

    def tabled(self, text: str) -> list[str]:
        """Pre-tokens by the library's normalizer and splitter."""
        if self._library is None:
            self._library = Tokenizer.from_file(self.path)
        split = self._library.pre_tokenizer.pre_tokenize_str(self._library.normalizer.normalize_str(text))
        back = self.text_to_byte
        return [bytes([back[c] for c in piece]).decode("utf-8") for piece, _ in split]

    def pieces(self, text: str) -> Iterator[tuple[bool, str]]:
        """(is a special token, text) in order."""
        if self.special_split is None or self.mark not in text or not any(s in text for s in self.specials):
            yield from ((False, p) for p in self.pretokens(text))
            return
        for part in self.special_split.split(text):
            if part in self.specials:
                yield True, part
            else:
                yield from ((False, p) for p in self.pretokens(part))

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        for special, piece in self.pieces(text or ""):
            out += [self.specials[piece]] if special else self.encode_word(piece)
        return out

    def decode(self, ids: list[int]) -> str:
        """The vocabulary file names no decoder: token texts joined by one space."""
        return " ".join([self.text_of[i] for i in ids])


class WordMemo(dict):
    """Word to (decimal ids joined by a space, token texts joined by a space, number of ids)."""

    def __init__(self, bpe: PrefixBPE):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, word: str) -> tuple[str, str, int]:
        ids = self.bpe.encode_word(word)
        if len(self) >= MEMO_WORDS:
            self.clear()
        self[word] = entry = (" ".join(map(str, ids)), self.bpe.decode(ids), len(ids))
        return entry

    def text(self, text: str) -> tuple[str, str, int]:
        if self.bpe.mark in text and any(s in text for s in self.bpe.specials):
            entries = [(str(self.bpe.specials[p]), p, 1) if special else self[p] for special, p in self.bpe.pieces(text)]
        else:
            entries = [self[p] for p in self.bpe.pretokens(text)]
        if not entries:
            return "", "", 0
        ids, texts, n = zip(*entries, strict=True)
        return " ".join(ids), " ".join(texts), sum(n)


_LOADED: dict[str, WordMemo] = {}


def memo(path: str) -> WordMemo:
    """One memo for each vocabulary file and worker process."""
    if path not in _LOADED:
        _LOADED[path] = WordMemo(PrefixBPE(path))
    return _LOADED[path]


def encode_documents(docs: DataFrame, vocabulary: str, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """``id_column``, ids (decimal, joined by a space), decoded, n_tokens for every row of ``docs``.

    Narrow: one pass, no exchange.  Other columns of ``docs`` are left out, so clashing names do no harm.
    """
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches):
        words = memo(vocabulary)
        for batch in common.small(batches):
            rows = [words.text(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())],
                ["id", "ids", "decoded", "n_tokens"],
            )

    return docs.select(docs[id_column].alias("id"), docs[text]).mapInArrow(run, f"id {kind}, ids string, decoded string, n_tokens long").withColumnRenamed("id", id_column)

"""Toxicity scores from a weighted finite-state pattern grammar.

A cascade of transducers reads the words of a clause; each one rewrites the symbols of the one before:

* lexical: a word becomes an insult, an epithet, a menace, a person, a denial, a report or nothing.  Endings are read here:
  induced stems take any ending, menacing verbs those of their language,
* target: an insult or epithet with a person at most ``NEAR`` words before it is aimed,
* negation: within ``REACH`` words after a denial, insults and menaces are denied,
* reported speech: after a report they are reported, to the end of the clause,
* insult: a person at most NEAR words after an insult that isn't aimed yet aims it late,
* threat: a menace with a person at most NEAR words after it is a threat; a menace alone is nothing.

They are composed to one deterministic machine, built state by state when a clause first needs it.  Its output symbols
carry the arc weights of the grammar: of an insult, of its being aimed, of a threat, and what a denial and a report take
away.  So an isolated insult has less than the full weight, an epithet or a menace without a person none.  A clause's weight is the sum
of its arcs; a logistic curve over the heaviest clause and the sum of clauses gives the score.

Learning uses a bounded sample of labelled rows (``TRAIN_ROWS`` of each class), near copies in it counting once.  Stems are word beginnings
(or whole words) whose documents are toxic too often for chance, with a bound over all candidates, counted where the grammar leaves them live:
neither denied nor reported.  A stem that leans so anywhere is an insult's; one that leans so only where it is aimed is an epithet's.  The arc weights are then fitted by
logistic regression around the grammar's own weights, with bounds that keep their order, and so is the curve.  Menaces, persons, denials and reports are fixed lists.

Null or empty texts match no clause and get the score of the bias.  Whole texts of any length are read.  Without toxic labels no
stem is known; with labels of one class only, every score is that class's share.  A document that is labelled both ways counts as toxic.
Repeated rows get equal scores, ties of stems go to the longer one, then in order of letters; other columns pass through, ``toxic_score`` and
``toxic_clauses`` are replaced; an empty table gives an empty one.
"""

from __future__ import annotations

import bisect
import math
import pickle
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebook.llm import common

#: The bound of the training sample, for each class.
TRAIN_ROWS = 5_000
#: A stem needs so many toxic documents; CHANCE bounds the expected number of stems that are kept by chance.
LEAST_SUPPORT, CHANCE, LEAST_WEIGHT = 5, 0.05, 0.5
SHORTEST_STEM, LONGEST_STEM = 3, 14
COPY_LOOKS = 4
MEMO_WORDS = 150_000
#: Words that a target stays near, and that a negation reaches.
NEAR, REACH = 4, 3

# Fixed word lists of the grammar, by symbol.
MENACES = {
    "en": "kill hurt destroy burn beat attack smash crush punish".split(),
    "de": "töten verletzen zerstören schlagen".split(),
    "fr": "tuer blesser détruire frapper".split(),
    "es": "matar herir destruir golpear".split(),
}
#: Endings of the infinitive, and the endings that may stand in its place.
ENDINGS = {
    "en": [("", "|s|es|ed|ing|er|ers".split("|"))],
    "de": [("en", "en e st est t et te ete ten eten end".split())],
    "fr": [("er", "er e es ons ez ent é ée és ées era erai eras ait ant".split()), ("re", "re s t sons sez sent sant t te".split())],
    "es": [("ar", "ar o as a amos an é ó aron ando ado ada aré ará".split()), ("ir", "ir o es e imos en í ió ieron iendo ido ida iré irá yo yes ye yen".split())],
}
TARGET = "you your yours u he him his she her they them their those du dich dir dein ihr euch sie tu te toi vous ton votre ils elles tú ti usted ustedes ellos ellas su".split()
NEGATION = "not no never isn't aren't wasn't don't doesn't nor nicht kein keine nie ne pas jamais non nunca jamás ni".split()
REPORTED = "said says wrote writes quoted called reported alleged claims claimed sagte schrieb berichtete dit écrit dijo escribió".split()

EDGE = re.compile(r"^\W+|\W+$")
#: Bits of a symbol: what the lexical transducer writes, and what the others add.
INSULT, EPITHET, MENACE, PERSON, DENIAL, REPORT, AIMED, DENIED, TOLD, LATE, THREAT = (1 << i for i in range(11))
MARKED = INSULT | EPITHET | MENACE


def menace_forms() -> set[str]:
    """Every form of the menacing verbs."""
    out = set()
    for language, verbs in MENACES.items():
        for verb in verbs:
            for ending, others in ENDINGS[language]:
                if verb.endswith(ending):
                    out |= {verb[: len(verb) - len(ending)] + e for e in others}
                    break
    return out


class Lexicon:
    """The lexical transducer: a trie of induced stems (a stem that ends in a blank is a whole word), then the fixed lists."""

    def __init__(self, stems: dict[str, tuple[int, float]]):
        self.trie: dict = {}
        for stem, (symbol, weight) in stems.items():
            node = self.trie
            for c in stem:
                node = node.setdefault(c, {})
            node[""] = symbol, weight
        self.fixed = dict.fromkeys(menace_forms(), MENACE) | {w: s for s, words in ((REPORT, REPORTED), (PERSON, TARGET), (DENIAL, NEGATION)) for w in words}

    def read(self, word: str) -> tuple[int, float, bool]:
        """(symbol, weight of a stem, the clause ends after it)."""
        ends = word[-1:] in ".!?;:\n"
        word = EDGE.sub("", word.lower())
        node, found = self.trie, (0, 0.0)
        for c in word + " ":
            node = node.get(c)
            if node is None:
                break
            found = max(found, node.get("", found), key=lambda x: x[1])
        if found[0]:
            return *found, ends
        return self.fixed.get(word, 0), 0.0, ends


# -- the transducers: (state, symbol) to (state, symbol) -----------------------------------


class Target:
    start = 0

    def step(self, state: int, symbol: int) -> tuple[int, int]:
        if symbol & (INSULT | EPITHET) and state:
            symbol |= AIMED
        return NEAR if symbol & PERSON else max(state - 1, 0), symbol


class Negation:
    start = 0

    def step(self, state: int, symbol: int) -> tuple[int, int]:
        if symbol & MARKED and state:
            symbol |= DENIED
        return REACH if symbol & DENIAL else max(state - 1, 0), symbol


class ReportedSpeech:
    start = False

    def step(self, state: bool, symbol: int) -> tuple[bool, int]:
        if symbol & MARKED and state:
            symbol |= TOLD
        return state or bool(symbol & REPORT), symbol


class Waiting:
    """A word of ``kinds`` that isn't aimed waits NEAR words for a person; the person then gets ``sign`` and the word's own marks."""

    start = (0, 0)

    def __init__(self, kinds: int, sign: int):
        self.kinds, self.sign = kinds, sign

    def step(self, state: tuple[int, int], symbol: int) -> tuple[tuple[int, int], int]:
        left, waits = state
        if symbol & self.kinds:
            return (NEAR, symbol & (self.kinds | DENIED | TOLD)) if not symbol & AIMED else self.start, symbol
        if symbol & PERSON and left:
            return self.start, symbol | self.sign | (waits << SHIFT[self.sign])
        return (left - 1, waits) if left > 1 else self.start, symbol


#: A late insult's and a threat's own bits stand above those of the word that completes them.
SHIFT = {LATE: 12, THREAT: 24}


class Composed:
    """Two transducers as one: the second reads what the first writes."""

    def __init__(self, first, second):
        self.first, self.second, self.start = first, second, (first.start, second.start)

    def step(self, state, symbol: int):
        a, written = self.first.step(state[0], symbol)
        b, written = self.second.step(state[1], written)
        return (a, b), written


class Event(NamedTuple):
    """What an output symbol adds to a clause: (weight of the word itself, of the insult that waited, of a threat) for each arc."""

    own: tuple[float, ...] | None
    waited: tuple[float, ...] | None
    threat: tuple[float, ...] | None


#: Arcs: an insult, its being aimed, a threat, a denial, a report.  The grammar's own weights, and bounds of the fitted ones.
ARCS = 5
PRIOR = np.array([1.0, 0.5, 1.5, -0.7, -0.4])
LOWER, UPPER = np.array([1.0, 0.25, 0.5, -1.0, -1.0]), np.array([1.0, 3.0, 3.0, -0.1, -0.1])


def arcs(insult: float, aimed: float, threat: float, bits: int) -> tuple[float, ...]:
    """What is denied or reported has no arc for its aim."""
    return insult, 0.0 if bits & (DENIED | TOLD) else aimed, threat, float(bool(bits & DENIED)), float(bool(bits & TOLD))


class Machine(dict):
    """The composed machine: (state, symbol) to (next state, event or None)."""

    def __init__(self):
        super().__init__()
        machine = Target()
        for more in (Negation(), ReportedSpeech(), Waiting(INSULT | EPITHET, LATE), Waiting(MENACE, THREAT)):
            machine = Composed(machine, more)
        self.machine, self.start = machine, machine.start

    def __missing__(self, key):
        after, out = self.machine.step(*key)
        own = waited = threat = None
        if out & INSULT or (out & EPITHET and out & AIMED):
            own = arcs(1.0, float(bool(out & AIMED)), 0.0, out)
        if out & LATE:
            late = out >> SHIFT[LATE]
            waited = (0.0, *arcs(0.0, 1.0, 0.0, late)[1:3], 0.0, 0.0) if late & INSULT else arcs(1.0, 1.0, 0.0, late)
        if out & THREAT:
            threat = arcs(0.0, 0.0, 1.0, out >> SHIFT[THREAT])
        self[key] = found = after, Event(own, waited, threat) if own or waited or threat else None
        return found


class Words(dict):
    def __init__(self, lexicon: Lexicon):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: str):
        if len(self) >= MEMO_WORDS:
            self.clear()
        self[word] = found = self.lexicon.read(word)
        return found


class Model:
    """Stems with their symbols and weights, the weights of the arcs, and the curve."""

    def __init__(self, stems: dict[str, tuple[int, float]], weights: list[float], curve: list[float] | None):
        self.stems, self.weights, self.curve = stems, weights, curve
        self.start()

    def start(self) -> None:
        self.words, self.machine = Words(Lexicon(self.stems)), Machine()

    def __getstate__(self):
        return self.stems, self.weights, self.curve

    def __setstate__(self, state):
        self.stems, self.weights, self.curve = state
        self.start()

    def matched(self, text: str | None) -> list[tuple[int, int, list[float]]]:
        """(first word, word after the last, arcs) of each clause that the grammar matches."""
        read = [self.words[w] for w in (text or "").split()]
        marked = [i for i, x in enumerate(read) if x[0] & MARKED]
        out: list[tuple[int, int, list[float]]] = []
        if not marked:
            return out
        ends = [i + 1 for i, x in enumerate(read) if x[2]]
        done = 0
        for i in marked:
            if i < done:
                continue
            k = bisect.bisect_right(ends, i)
            begin, done = ends[k - 1] if k else 0, ends[k] if k < len(ends) else len(read)
            found = self.clause([(s, w) for s, w, _ in read[begin:done]])
            if any(found):
                out.append((begin, done, found))
        return out

    def clause(self, read: list[tuple[int, float]]) -> list[float]:
        """Sums of the arcs of a clause, given its words' symbols and weights."""
        state, total, waits, machine = self.machine.start, [0.0] * ARCS, 0.0, self.machine
        for symbol, own in read:
            state, event = machine[state, symbol]
            if event is not None:
                for part, weight in ((event.own, own), (event.waited, waits), (event.threat, 1.0)):
                    if part is not None:
                        for a, x in enumerate(part):
                            total[a] += x * weight
            if symbol & (INSULT | EPITHET):
                waits = own
        return total

    def clauses(self, text: str | None) -> list[tuple[int, int, float]]:
        """(first word, word after the last, weight) of each clause with weight."""
        weighed = [(b, e, sum(x * w for x, w in zip(found, self.weights, strict=True))) for b, e, found in self.matched(text)]
        return [x for x in weighed if x[2] > 0]

    def sums(self, text: str | None) -> tuple[list[float], int]:
        """(constant, heaviest clause and total weight on log scales; number of clauses)."""
        found = [w for _, _, w in self.clauses(text)]
        return [1.0, math.log1p(max(found, default=0.0)), math.log1p(sum(found))], len(found)

    def score(self, text: str | None) -> float:
        z = sum(a * b for a, b in zip(self.curve, self.sums(text)[0], strict=True))
        return 1 / (1 + math.exp(-min(max(z, -30.0), 30.0)))


# -- learning ------------------------------------------------------------------------------


class Places(Words):
    """Reads a word for the search of stems: (symbol, word without marks, the clause ends); words of no list could be insults."""

    def __missing__(self, word: str):
        symbol, _, ends = self.lexicon.read(word)
        if len(self) >= MEMO_WORDS:
            self.clear()
        self[word] = found = symbol or INSULT, EDGE.sub("", word.lower()), ends
        return found


def beginnings(word: str) -> list[str]:
    """Candidate stems of a word: its beginnings, and itself with a blank at the end."""
    return [word + " ", *(word[:i] for i in range(SHORTEST_STEM, min(len(word), LONGEST_STEM) + 1))] if len(word) >= SHORTEST_STEM else []


def live_stems(text: str | None, words: Places, machine: Machine) -> tuple[set[str], set[str]]:
    """Candidate stems that stand neither denied nor reported in a text, and those that are aimed there; "" where there are any."""
    live, aimed = set(), set()
    state, waits = machine.start, None
    for written in (text or "").split():
        symbol, word, ends = words[written]
        state, event = machine[state, symbol]
        if event is not None:
            if event.own is not None and not event.own[3] and not event.own[4]:
                live.add(word)
                if event.own[1]:
                    aimed.add(word)
            if event.waited is not None and waits:
                aimed.add(waits)
        if symbol == INSULT:
            waits = word if event is not None and event.own is not None and not event.own[3] and not event.own[4] else None
        if ends:
            state, waits = machine.start, None
    stems = lambda words: {s for w in words for s in beginnings(w)} | ({""} if words else set())
    return stems(live), stems(aimed)


def evidence(toxic_docs: int, clean_docs: int, toxic: int, clean: int) -> float:
    """Minus the log of a bound of the chance that so many of a stem's documents are toxic (Chernoff); 0 where no more are than of all."""
    n, p = toxic_docs + clean_docs, toxic / (toxic + clean)
    q = toxic_docs / n
    return n * (q * math.log(q / p) + (math.log((1 - q) / (1 - p)) * (1 - q) if q < 1 else 0.0)) if q > p else 0.0


def stem_weight(toxic_docs: int, clean_docs: int, toxic: int, clean: int) -> float:
    """The log ratio of document shares, less its standard deviation."""
    ratio = math.log((toxic_docs + 0.5) / (toxic + 1)) - math.log((clean_docs + 0.5) / (clean + 1))
    return max(ratio - math.sqrt(1 / (toxic_docs + 0.5) + 1 / (clean_docs + 0.5)), LEAST_WEIGHT)


def induce(counts: list[tuple[str, int, int]], toxic: int, clean: int) -> dict[str, float]:
    """Stems by evidence, the longest of equals; no kept stem begins another."""
    rated = sorted((-evidence(t, c, toxic, clean), -len(s), s, t, c) for s, t, c in counts)
    kept: dict[str, float] = {}
    begun: set[str] = set()  # beginnings of kept stems
    for _, _, s, t, c in rated:
        if s not in begun and not any(s[:i] in kept for i in range(SHORTEST_STEM, len(s))):
            kept[s] = stem_weight(t, c, toxic, clean)
            begun.update(s[:i] for i in range(SHORTEST_STEM, len(s) + 1))
    return kept


def sketches(text: str | None) -> list[int]:
    """The least hashes of a text's runs of five words, for COPY_LOOKS hash functions: near copies mostly share one."""
    words = (text or "").lower().split()
    runs = [" ".join(words[i : i + 5]).encode("utf-8", "surrogatepass") for i in range(max(len(words) - 4, 1))]
    return [min(xxhash.xxh64_intdigest(r, seed) for r in runs) >> 1 for seed in range(COPY_LOOKS)]


def fit(x: np.ndarray, y: np.ndarray, prior: np.ndarray, tight: np.ndarray, lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """Logistic regression around ``prior`` (with precisions ``tight``) within bounds, by projected Newton steps."""
    beta = np.clip(prior, lower, upper)
    for _ in range(80):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        g = x.T @ (p - y) + tight * (beta - prior)
        free = ~(((beta <= lower) & (g > 0)) | ((beta >= upper) & (g < 0)))
        if not free.any():
            break
        h = ((x * np.maximum(p * (1 - p), 1e-9)[:, None]).T @ x + np.diag(tight))[np.ix_(free, free)]
        step = np.zeros(len(beta))
        step[free] = np.clip(np.linalg.solve(h, g[free]), -3, 3)
        new = np.clip(beta - step, lower, upper)
        moved, beta = np.abs(new - beta).max(), new
        if moved < 1e-9:
            break
    return beta


def fit_arcs(x: np.ndarray, y: np.ndarray) -> list[float]:
    """Weights of the arcs, that of an insult being 1, from the arcs of whole documents."""
    scale = 4.0  # about the weight of an insult on the scale of log odds
    beta = fit(np.column_stack([np.ones(len(x)), x]), y, np.append(-2.0, scale * PRIOR), np.append(0.01, np.full(ARCS, 0.5)), np.append(-20, np.where(LOWER < 0, -20.0, 0.1)), np.append(20, np.where(UPPER < 0, 0.0, 20.0)))
    return np.clip(beta[1:] / beta[1], LOWER, UPPER).tolist()


def train(docs: DataFrame, labels: DataFrame, target: str = "toxic", per_class: int = TRAIN_ROWS) -> Model:
    """Stem counts by a partial and a final aggregate; weights and curve over the arcs of the bounded sample."""

    def sketched(batches):
        for batch in common.small(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([sketches(t) for t in batch.column(1).to_pylist()], pa.list_(pa.int64()))], ["doc_id", "text", "y", "looks"])

    bounded = common.labelled_sample(docs, labels, target, per_class)
    kind = bounded.schema["doc_id"].dataType.simpleString()
    sample = bounded.select("doc_id", "text", "y").mapInArrow(sketched, f"doc_id {kind}, text string, y int, looks array<long>")
    for look in range(COPY_LOOKS):  # of rows with one sketch the first in a hash order stays
        one = F.min_by(F.struct("doc_id", "text", "looks"), F.struct(F.xxhash64("doc_id", "text"), "doc_id", "text")).alias("r")
        sample = sample.groupBy("y", F.element_at("looks", look + 1).alias("look")).agg(one).select("r.doc_id", "r.text", "y", "r.looks")
    sample = common.cut_lineage(sample.select("text", "y"))
    size = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    toxic, clean = size.get(1, 0), size.get(0, 0)
    if not toxic or not clean:
        p = min(max(toxic / (toxic + clean) if toxic + clean else 0.5, 1e-6), 1 - 1e-6)
        return Model({}, PRIOR.tolist(), [math.log(p / (1 - p)), 0.0, 0.0])

    def count(batches):
        words, machine = Places(Lexicon({})), Machine()
        for batch in common.small(batches):
            found: dict[str, list[int]] = {}
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for k, stems in enumerate(live_stems(text, words, machine)):
                    for s in stems:
                        found.setdefault(s, [0, 0, 0, 0])[2 * k + y] += 1
            columns = [pa.array(list(found), pa.string())] + [pa.array([v[i] for v in found.values()], pa.int64()) for i in (1, 0, 3, 2)]
            yield pa.RecordBatch.from_arrays(columns, ["stem", "t", "c", "at", "ac"])

    counts = sample.select("text", "y").mapInArrow(count, "stem string, t long, c long, at long, ac long").groupBy("stem").agg(*(F.sum(x).alias(x) for x in ("t", "c", "at", "ac")))
    counts = common.cut_lineage(counts.where((F.col("t") >= LEAST_SUPPORT) | (F.col("at") >= LEAST_SUPPORT)))
    least = math.log(max(counts.count(), 1) / CHANCE)
    # a stem that is aimed is compared with the documents where any word is
    with_aim = counts.where("stem = ''").select("at", "ac").first() or (0, 0)
    base = {"t": (toxic, clean), "at": (max(with_aim[0], 1), max(with_aim[1], 1))}

    def leans(t: str, c: str):
        share = base[t][0] / sum(base[t])
        q = F.col(t) / (F.col(t) + F.col(c))
        rest = F.when(F.col(c) > 0, (1 - q) * F.log((1 - q) / (1 - share))).otherwise(0.0)
        return (F.col(t) >= LEAST_SUPPORT) & (q > share) & ((F.col(t) + F.col(c)) * (q * F.log(q / share) + rest) >= least)

    top = counts.where("stem <> ''").where(leans("t", "c") | leans("at", "ac")).collect()  # the sample bounds their number
    rows = lambda t, c: [(r["stem"], r[t], r[c]) for r in top if r[t] >= LEAST_SUPPORT and evidence(r[t], r[c], *base[t]) >= least]
    insults = induce(rows("t", "c"), toxic, clean)
    known = {s[:i] for s in insults for i in range(SHORTEST_STEM, len(s) + 1)}
    epithets = {s: w for s, w in induce(rows("at", "ac"), *base["at"]).items() if s not in known and not any(s[:i] in insults for i in range(SHORTEST_STEM, len(s) + 1))}
    model = Model({s: (INSULT, w) for s, w in insults.items()} | {s: (EPITHET, w) for s, w in epithets.items()}, PRIOR.tolist(), None)

    def matched(batches):
        for batch in common.small(batches):
            rows = [pickle.dumps([found for _, _, found in model.matched(t)]) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), batch.column(1)], ["x", "y"])

    found = sample.select("text", "y").mapInArrow(matched, "x binary, y int").collect()
    y = np.array([r["y"] for r in found], dtype=float)
    by_clause = [np.array(pickle.loads(r["x"])).reshape(-1, ARCS) for r in found]
    whole = np.array([x.sum(axis=0) for x in by_clause])
    # log scales: of the sum of clauses, of which each arc has its share
    model.weights = fit_arcs(whole * (np.log1p(whole[:, [0, 2]].sum(axis=1)) / np.maximum(whole[:, [0, 2]].sum(axis=1), 1e-9))[:, None], y)
    weighed = [np.maximum(x @ np.array(model.weights), 0) for x in by_clause]
    x = np.array([[1.0, math.log1p(w.max(initial=0.0)), math.log1p(w.sum())] for w in weighed])
    model.curve = fit(x, y, np.zeros(3), np.full(3, 0.05), np.array([-30, 0.0, 0.0]), np.full(3, 30.0)).tolist()
    return model


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with last columns ``toxic_score`` and ``toxic_clauses`` (such columns in ``docs`` are replaced)."""
    docs = docs.drop("toxic_score", "toxic_clauses")
    place = docs.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField("toxic_score", T.DoubleType()), T.StructField("toxic_clauses", T.LongType())])

    def run(batches):
        m = shared.value
        for batch in common.small(batches):
            found = [m.sums(t) for t in batch.column(place).to_pylist()]
            z = np.clip(np.array([x for x, _ in found]).reshape(-1, 3) @ np.array(m.curve), -30, 30)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-z)), pa.float64()), pa.array([n for _, n in found], pa.int64())], names=[*batch.schema.names, "toxic_score", "toxic_clauses"])

    return docs.mapInArrow(run, schema)

"""Toxicity by a weighted finite-state pattern grammar.

Five transducers stand in a row; each reads the letters that the one before writes: insults (a weighted lexicon of words
and word beginnings, plain or faint, says what a word is), threats (phrases), targets (persons spoken of or to), negation
(for the words after it), reported speech (for the rest of the clause, from its word on).  They are composed into one
machine, whose arcs are made when they are first taken.  It reads a clause and adds up the weights of the arcs by what
was matched and how it stands: live, negated or reported.  That gives a clause its class: insult, insults, faint ones alone,
threat or both; at a target or plain, or, where nothing live was matched, negated or reported.  A document's score is
the logistic of its clauses' classes and of the lexicon weights of its live insults, so a matched clause counts by its
make-up, not by single words.

Insult lexicon and weights are learned from labels: of the labelled rows given for training, at most TRAIN (those with
the least hash of their id) are read; a greedy cover takes the words and beginnings that mark most toxic texts not yet
explained and hardly any others; a term's weight is its evidence in the labels.  Faint ones are those that other texts
may hold once but hardly ever twice.  Then logistic regression weighs the classes.  Equal texts count once, as toxic if
any of them is labelled so.  Labels, language, source and id are not inputs of a score.

Defined results: null and empty texts match nothing and get the score of a text without matched clauses; labels that
are null, of unknown ids, or null ids aren't learned from; with no toxic example, or no label, the lexicon is empty and
the scores are the (low) base rate; rows that repeat a doc_id are scored each; texts of any length are read whole, clause
by clause; columns of docs may have any names but that of the score.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, heaps_released, map_rows, slices, table, trimmed

TRAIN, AT_LEAST, MOST_TERMS, KNOWN, THRESHOLD = 24_000, 4, 2000, 1 << 16, 0.3
CLAUSE = re.compile(r"[.!?;:\n]+")
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
TARGETS = frozenset("you your yours u he she they them him her his their people these those du dich dir ihr euch sie tu toi te vous votre ton ils elles tú usted ustedes ellos ella".split())
NEGATION = frozenset("not no never isn't aren't wasn't don't nobody neither nicht kein keine nie niemals ne pas jamais aucun nunca ningún tampoco".split())
REPORT = frozenset("said says say told claims claimed quoted quote reported wrote called sagte sagt behauptet schrieb dit disait affirme écrit dijo dice afirma escribió".split())
THREATS = tuple(tuple(p.split()) for p in ("i will kill", "i'll kill", "kill you", "kill yourself", "hurt you", "find you", "burn you", "you will die", "you deserve to die", "hope you die", "ich bring dich um", "bringe dich um", "je vais te tuer", "te tuer", "voy a matarte", "te voy a matar"))
#: Each phrase's longest word, the last of equal ones.
THREAT_SIGNS = {p: max(p[::-1], key=len) for p in THREATS}
NEGATED_WORDS = 3
KINDS = ("insult", "insults", "faint", "threat", "both")
CLASSES = [f"{m}/{t}" for m in KINDS for t in ("plain", "target", "negated", "reported")]
AT = {c: i for i, c in enumerate(CLASSES)}
#: After the classes: weight of live insults, number of live faint ones, whether there are two and three of these.
N_FEATURES = len(CLASSES) + 4
#: Marks a term that stands in a text at least twice; how many clean texts may hold a term for each toxic one.
TWICE, CLEAN, CLEAN_TWICE = "*2", 0.02, 0.25
#: Clean texts without a match that are presumed besides the labelled ones: so few labels, or toxic ones alone, condemn nothing.
PRESUMED = 20
NO_INSULTS = TARGETS | NEGATION | REPORT
#: What a letter says of its word, and, as machines add to it, of the match that ends there.
INSULT, FAINT, THREAT, TARGET, NEGATOR, REPORTER, NEGATED, REPORTED = (1 << i for i in range(8))
MATCH = INSULT | FAINT | THREAT
THREAT_WORDS = {w for p in THREATS for w in p}


def terms_of(word: str) -> list[str]:
    """The word and its beginnings of 4 to 7 letters, which end in a star."""
    return [word, *(f"{word[:n]}*" for n in range(4, min(8, len(word))))]


class Insults:
    """One state; writes what the lexicon and the fixed lists say of a word, with the lexicon's weight for it."""

    start = ()

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon, self.known = lexicon, {}

    def letter(self, word: str) -> tuple[tuple[int, str], float]:
        """((what it is, the word if a threat may hold it), weight)."""
        hit = self.known.get(word)
        if hit is None:
            if len(self.known) > KNOWN:
                self.known.clear()
            terms, bits = terms_of(word), TARGET * (word in TARGETS) | NEGATOR * (word in NEGATION) | REPORTER * (word in REPORT)
            weight = max((self.lexicon.get(t, 0.0) for t in terms), default=0.0)
            if not weight and (weight := max((self.lexicon.get(t + TWICE, 0.0) for t in terms), default=0.0)):
                bits |= FAINT
            elif weight:
                bits |= INSULT
            hit = self.known[word] = (bits if not bits & (NEGATOR | REPORTER) else bits & ~MATCH, word if word in THREAT_WORDS else ""), weight
        return hit


class Threats:
    """Its state is the longest end of what was read that begins a phrase; a phrase that ends is marked."""

    start = ()
    begins = {p[:n] for p in THREATS for n in range(len(p) + 1)}

    def step(self, state: tuple, letter: tuple[int, str]) -> tuple[tuple, int]:
        bits, word = letter
        state = (*state, word)
        hit = any(state[-len(p) :] == p for p in THREATS)
        while state not in self.begins:
            state = state[1:]
        return state, bits | THREAT * hit


class Targets:
    """Its state is whether the clause has spoken of or to a person."""

    start = False

    def step(self, state: bool, bits: int) -> tuple[bool, int]:
        return state or bool(bits & TARGET), bits


class Negation:
    """Its state is how many words are still negated."""

    start = 0

    def step(self, state: int, bits: int) -> tuple[int, int]:
        if bits & NEGATOR:
            return NEGATED_WORDS, bits
        return max(0, state - 1), bits | NEGATED * bool(state and bits & MATCH)


class Report:
    """Its state is whether a word of saying was read."""

    start = False

    def step(self, state: bool, bits: int) -> tuple[bool, int]:
        return state or bool(bits & REPORTER), bits | REPORTED * bool(state and bits & MATCH)


class Composed:
    """Machines in a row as one; its arcs are kept once made (states and letters are few)."""

    def __init__(self, *machines):
        self.machines, self.start, self.arcs = machines, tuple(m.start for m in machines), {}

    def step(self, state: tuple, letter) -> tuple[tuple, int]:
        arc = self.arcs.get((state, letter))
        if arc is None:
            to, out = [], letter
            for m, s in zip(self.machines, state, strict=True):
                s, out = m.step(s, out)
                to.append(s)
            arc = self.arcs[state, letter] = tuple(to), out
        return arc


class Grammar:
    def __init__(self, lexicon: dict[str, float]):
        self.insults, self.rest = Insults(lexicon), Composed(Threats(), Targets(), Negation(), Report())
        self.heads = {t.removesuffix(TWICE).rstrip("*")[:4] for t in lexicon}
        self.dull, self.notable = set(), {}

    def notables(self, text: str) -> set[str]:
        """The words of a lower-cased text that a match may hold; stretches between white space are looked at once, not each time."""
        out = set()
        for t in {*text.split()} - self.dull:
            hit = self.notable.get(t)
            if hit is None:
                hit = [w for w in WORD.findall(t) if w in THREAT_WORDS or w[:4] in self.heads and self.insults.letter(w)[0][0] & MATCH]
                if len(self.dull) + len(self.notable) > KNOWN:
                    self.dull.clear()
                    self.notable.clear()
                if not hit:
                    self.dull.add(t)
                    continue
                self.notable[t] = hit
            out.update(hit)
        return out

    def read(self, words: list[str]) -> tuple[str | None, float, int]:
        """(class, weight of live insults, live faint ones) of a clause."""
        state, step, letter = self.rest.start, self.rest.step, self.insults.letter
        weight = 0.0
        n = {how: [0, 0, 0] for how in (0, NEGATED, REPORTED)}
        for w in words:
            x, worth = letter(w)
            state, out = step(state, x)
            if out & MATCH:
                how = REPORTED if out & REPORTED else out & NEGATED
                n[how][0] += bool(out & INSULT)
                n[how][1] += bool(out & FAINT)
                n[how][2] += bool(out & THREAT)
                weight += worth if out & INSULT and not how else 0.0
        for how in (0, NEGATED, REPORTED):
            strong, faint, threat = n[how]
            if strong or faint or threat:
                kind = "both" if strong and threat else "threat" if threat else "insult" if strong == 1 else "insults" if strong else "faint"
                stands = "negated" if how == NEGATED else "reported" if how else "target" if state[1] else "plain"
                return f"{kind}/{stands}", weight, n[0][1]
        return None, 0.0, 0

    def features(self, text: str) -> np.ndarray:
        """log(1 + number of clauses) of each class, log(1 + weight) of live insults, that of faint ones, and their steps."""
        out = np.zeros(N_FEATURES)
        insults, faints, text = 0.0, 0, text.lower()
        words = self.notables(text)
        marked = {w for w in words if self.insults.letter(w)[0][0] & MATCH}
        phrases = [p for p in THREATS if words.issuperset(p)]
        signs = [*marked, *{THREAT_SIGNS[p] for p in phrases}]
        for c in CLAUSE.split(text) if signs else ():
            if not any([x in c for x in signs]):
                continue
            words = WORD.findall(c)
            if not marked.isdisjoint(words) or any([{*words}.issuperset(p) for p in phrases]):
                k, n, faint = self.read(words)
                if k:
                    out[AT[k]] += 1
                insults, faints = insults + n, faints + faint
        out[len(CLASSES) :] = insults, faints, 0, 0
        out = np.log1p(out)
        out[-2:] = faints >= 2, faints >= 3
        return out


def terms_in(text: str, terms_of=terms_of) -> set[str]:
    """The terms of a text's words, and those that stand in it twice marked so."""
    n: Counter = Counter()
    for w, k in Counter(WORD.findall(text.lower())).items():
        if w not in NO_INSULTS:
            for t in terms_of(w):
                n[t] += k
    return {*n, *(t + TWICE for t, k in n.items() if k > 1)}


def cover(toxic: list[set], clean: Counter, n_clean: int) -> dict[str, float]:
    """Terms that, taken greedily, each explain AT_LEAST toxic texts more and hardly any clean one; by weight of evidence."""
    holds: dict[str, set] = {}
    for i, terms in enumerate(toxic):
        for t in terms:
            holds.setdefault(t, set()).add(i)
    evidence = lambda t, k: math.log((k + 0.5) / (len(toxic) + 1)) - math.log((clean[t] + 0.5) / (n_clean + 1))
    left = {t: s for t, s in holds.items() if len(s) >= AT_LEAST and evidence(t, len(s)) > 3 and clean[t] <= (CLEAN_TWICE if t.endswith(TWICE) else CLEAN) * len(s)}
    out: dict[str, float] = {}
    whole, odds = {t: len(s) for t, s in left.items()}, 3 * len(toxic) / max(1, n_clean)
    while left and len(out) < MOST_TERMS:
        best = max(left, key=lambda t: (len(left[t]) - odds * clean[t], whole[t], t[-1] != "*", t))
        gone = left.pop(best)
        if len(gone) < AT_LEAST:
            break
        out[best] = evidence(best, whole[best])
        for t in list(left):
            left[t] = left[t] - gone
            if len(left[t]) < AT_LEAST:
                del left[t]
    # words as telling as those taken, but hidden behind them in the same texts
    for t, n in whole.items():
        if "*" not in t and t not in out and len(out) < MOST_TERMS and n >= 0.02 * len(toxic) and not clean[t]:
            out[t] = evidence(t, n)
    return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Weights (bias last) by Newton's method."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def counts(found, terms):
    """(term, in how many texts of those found), some at a time."""
    held: Counter = Counter()
    for (text,) in found:
        held.update(terms(text))
        if len(held) > 4 * KNOWN:
            yield from held.items()
            held.clear()
    yield from held.items()


def summed(texts: DataFrame, run, least: int) -> dict[str, int]:
    """The terms with their counts from run(rows) added up, of at least so many; of a bounded sample."""
    got = map_rows(texts, run, [("term", pa.string()), ("n", pa.int64())], "term string, n long", 1 << 14).groupBy("term").agg(F.sum("n").alias("n")).where(f"n >= {least}").toArrow()
    return dict(zip(got.column("term").to_pylist(), got.column("n").to_pylist(), strict=True))


def fit(docs: DataFrame, labels: DataFrame, trains) -> tuple[dict[str, float], np.ndarray]:
    """(lexicon, weights) from labels (doc_id, toxic) of the ids for which the column expression trains holds."""
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    labels = labels.where(trains(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN)  # the documented bound
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    once = checkpointed(texts.groupBy(F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic")).select("toxic", "text"), release=True)
    toxic, others = once.where("toxic = 1").select("text"), once.where("toxic = 0").select("text")
    # a term must stand in AT_LEAST toxic texts: only such terms are counted in the others
    k = summed(toxic, lambda found: counts(found, terms_in), AT_LEAST)
    base = {t.removesuffix(TWICE) for t in k}

    def among(found):
        own = functools.lru_cache(KNOWN)(lambda w: [t for t in terms_of(w) if t in base])
        return counts(found, lambda text: [t for t in terms_in(text, own) if t in k])

    n = summed(others, among, 1)
    clean = Counter({t: n.get(t, 0) for t in k if n.get(t, 0) <= (CLEAN_TWICE if t.endswith(TWICE) else CLEAN) * k[t]})
    n_clean = others.count()
    kept = map_rows(toxic, lambda found: (([t for t in terms_in(text) if t in clean],) for (text,) in found), [("terms", pa.list_(pa.string()))], "terms array<string>")
    lexicon = cover([set(r.terms) for r in kept.collect()], clean, n_clean)

    def featured(found):
        g = Grammar(lexicon)
        for y, text in found:
            yield y, g.features(text).tolist()

    got = map_rows(once, featured, [("y", pa.int32()), ("x", pa.list_(pa.float64()))], "y int, x array<double>", 4096).groupBy("y", "x").count().collect()
    x, y, n = np.array([r.x for r in got] + [[0.0] * N_FEATURES]), np.array([*(r.y for r in got), 0], float), [*(r["count"] for r in got), PRESUMED]
    return lexicon, logistic(np.repeat(x, n, 0), np.repeat(y, n))


def scored(docs: DataFrame, lexicon: dict[str, float], weights: np.ndarray, column: str = "toxic_score", keep_text: bool = True) -> DataFrame:
    """docs with a score column (one of that name is replaced); without the texts if these aren't needed any more."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    docs = docs.drop(column)
    at = docs.columns.index("text")
    kept = [i for i in range(len(docs.columns)) if keep_text or i != at]

    def run(batches):
        g = Grammar(lexicon)
        for whole in batches:
            for b in slices(whole):
                score = [1 / (1 + math.exp(-float(g.features(t or "") @ weights[:-1] + weights[-1]))) for t in b.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in kept), pa.array(score, pa.float64())], names=[*(b.schema.names[i] for i in kept), column])
            del whole

    return docs.mapInArrow(trimmed(run), StructType([*(docs.schema.fields[i] for i in kept), StructField(column, DoubleType())]))


def held_out(doc_id):
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(4)) == 2


def toxicity(docs: DataFrame, labels: DataFrame, column: str = "toxic_score", keep_text: bool = True) -> DataFrame:
    learned = fit(docs, labels, lambda i: ~held_out(i))
    heaps_released(docs.sparkSession)
    return scored(docs, *learned, column, keep_text)


def op3(spark, sf_dir: str) -> DataFrame:
    out = toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"), "score", keep_text=False)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))

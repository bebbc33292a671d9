"""Personal data by weak supervision.

Base kinds (email, ip, card, phone) are found by fixed rules and always kept.  Further candidates (secret, iban,
national_id, local_phone) come from looser shapes.  Six labelers vote yes, no or nothing on each: its exact shape, a
gazetteer of known names and prefixes, words before it, its mix of characters, natural-word look, words that speak
against it.  Votes of all documents are counted by pattern; expectation-maximisation estimates how reliable each
labeler is and how likely each pattern is personal data; those probabilities train the final span classifier, a
logistic regression on votes, kind, length and make-up.  Candidates with a probability of at least 0.5 are added.

Only counts by pattern (a bounded number: kinds x votes x lengths) come to the driver.

Defined results: a null text is empty and has no spans; positions are code points, ends exclusive; a candidate that
overlaps a base span or an earlier candidate isn't one; without candidates nothing is learned or added; texts of any
length are searched whole, in time that grows with their length.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, slices, table, trimmed
from .toxicity import logistic

BASE, MORE = ("email", "ip", "card", "phone"), ("secret", "iban", "national_id", "local_phone")
KINDS = {k: i for i, k in enumerate(BASE + MORE)}
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")  # a start within a run of digits is never leftmost
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

ASSIGNED = re.compile(r"[=:][\x20]?[\"']?([A-Za-z0-9+/_.-]{8,}+)")
QUOTED = re.compile(r"[\"']([A-Za-z0-9+/_-]{20,}+)[\"']")
KEY = re.compile(r"\b(?:AKIA|ASIA|ghp_|gho_|sk-|xox[abp]-|AIza)[A-Za-z0-9_-]{12,}+")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
NATIONAL = re.compile(r"(?<![0-9.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
LOCAL_PHONE = re.compile(r"(?<![0-9+.)-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9-])")
NAMES = re.compile(r"(?:pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth|credential)s?[\x20\"']*$", re.I)
BEFORE = {"secret": re.compile(r"key|pass|secret|token|credential|login", re.I), "iban": re.compile(r"iban|account|konto|bank|compte|cuenta", re.I), "national_id": re.compile(r"ssn|social|security|tax|id\b", re.I), "local_phone": re.compile(r"tel|phone|call|fax|mobil|contact", re.I)}
AGAINST = re.compile(r"example|sample|version|isbn|sha\d|md5|hash|commit|order|figure|https?", re.I)
COUNTRIES = frozenset("AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IS IT LI LT LU LV MC MT NL NO PL PT RO SE SI SK SM".split())
LABELERS, THRESHOLD = 6, 0.5


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """By kind, then start."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        a = at
        while a > last and LOCAL.match(text, a - 1):
            a -= 1
        if a < at and (m := DOMAIN.match(text, at + 1)):
            out.append(("email", a, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", *m.span()))
    return out


def candidates(text: str, base: list) -> list[tuple[str, int, int]]:
    found = []
    if "=" in text or ":" in text:
        found += [("secret", *m.span(1)) for m in ASSIGNED.finditer(text)]
    if '"' in text or "'" in text:
        found += [("secret", *m.span(1)) for m in QUOTED.finditer(text)]
    for kind, shape in (("secret", KEY), ("iban", IBAN), ("national_id", NATIONAL), ("local_phone", LOCAL_PHONE)):
        found += [(kind, *m.span()) for m in shape.finditer(text)]
    # base spans as stretches that are apart; candidates come by start, so of those taken the last end is the furthest
    begins, ends = [], []
    for a, b in sorted((a, b) for _, a, b in base):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            begins.append(a)
            ends.append(b)
    out, last = [], 0
    for kind, a, b in sorted(set(found), key=lambda c: (c[1], c[2], KINDS[c[0]])):
        k = bisect_left(begins, b) - 1  # the last stretch that begins before the candidate ends
        if a >= last and (k < 0 or ends[k] <= a):
            out.append((kind, a, b))
            last = b
    return out


def votes(text: str, kind: str, a: int, b: int) -> tuple[int, ...]:
    """1 yes, -1 no, 0 nothing, by labeler."""
    s, left = text[a:b], text[max(0, a - 40) : a]
    plain = re.sub(r"[^A-Za-z0-9]", "", s)
    digits, letters = sum(c.isdigit() for c in s), sum(c.isalpha() for c in s)
    if kind == "secret":
        exact = 1 if KEY.fullmatch(s) or re.fullmatch(r"[0-9a-f]{16,}", s) else 0
        known = 1 if KEY.match(s) or NAMES.search(left.rstrip("=: \"'")) else 0
    elif kind == "iban":
        exact = 1 if int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1 else -1
        known = 1 if plain[:2] in COUNTRIES else -1
    elif kind == "national_id":
        exact, known = (-1 if s[:3] in ("000", "666") or s[0] == "9" or s[4:6] == "00" or s[7:] == "0000" else 1), 0
    else:
        exact, known = (1 if plain[0] in "23456789" and plain[3] in "23456789" else -1), 0
    before = 1 if BEFORE[kind].search(left) else 0
    mix = 1 if (kind != "secret" and digits >= 8) or (digits >= 3 and letters >= 3 and len(set(plain)) >= 8) else -1
    natural = -1 if digits == 0 or re.fullmatch(r"[A-Z]?[a-z.]+", s) else 0
    against = -1 if AGAINST.search(left) or AGAINST.search(s) else 0
    return exact, known, before, mix, natural, against


def pattern(text: str, kind: str, a: int, b: int) -> tuple:
    return kind, votes(text, kind, a, b), min(4, (b - a) // 10)


def posteriors(patterns: list[tuple], n: np.ndarray, rounds: int = 50) -> np.ndarray:
    """P(personal data) of each pattern by EM: labelers err independently given the truth; each kind has its own prior and
    its own reliabilities of the labelers, who are presumed better than chance."""
    out = np.zeros(len(patterns))
    kinds = np.array([KINDS[p[0]] for p in patterns])
    for k in np.unique(kinds):
        here = kinds == k
        v, m = np.array([p[1] for p in patterns])[here], n[here]
        p = np.clip(0.5 + 0.2 * v.sum(1), 0.05, 0.95)  # votes, to begin with
        for _ in range(rounds):
            log = np.zeros((len(v), 2))
            for y, w in ((0, m * (1 - p)), (1, m * p)):
                log[:, y] += np.log((w.sum() + 1) / (m.sum() + 2))
                for j in range(LABELERS):
                    for x in (-1, 0, 1):
                        prior = 3.0 if x == (1 if y else -1) else 1.0
                        log[v[:, j] == x, y] += np.log((w[v[:, j] == x].sum() + prior) / (w.sum() + 5))
            new = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -30, 30)))
            if np.abs(new - p).max() < 1e-6:
                break
            p = new
        out[here] = p
    return out


def features(p: tuple) -> list[float]:
    kind, v, length = p
    return [*(float(x == s) for x in v for s in (1, -1)), *(float(kind == k) for k in MORE), *(float(length == i) for i in range(5))]


def learn(docs: DataFrame) -> np.ndarray | None:
    """Weights of the span classifier; None without candidates."""
    def count(found):
        seen: Counter = Counter()
        for (text,) in found:
            for c in candidates(text, base_spans(text)):
                seen[pattern(text, *c)] += 1
        for (kind, v, length), n in seen.items():
            yield kind, list(v), length, n

    fields = [("kind", pa.string()), ("v", pa.list_(pa.int32())), ("length", pa.int32()), ("n", pa.int64())]
    counted = map_rows(docs.select(F.coalesce("text", F.lit(""))), count, fields, "kind string, v array<int>, length int, n long", 4096)
    got = counted.groupBy("kind", "v", "length").agg(F.sum("n").alias("n")).orderBy("kind", "v", "length").collect()
    if not got:
        return None
    patterns, n = [(r.kind, tuple(r.v), r.length) for r in got], np.array([r.n for r in got], float)
    p, x = posteriors(patterns, n), np.array([features(q) for q in patterns])
    # soft labels: each pattern counts as data with weight p and as none with 1 - p; large counts are tempered
    weight = np.maximum(1, np.round(20 * np.log1p(n))).astype(int)
    ones = np.round(weight * p).astype(int)
    return logistic(np.r_[np.repeat(x, ones, 0), np.repeat(x, weight - ones, 0)], np.r_[np.ones(ones.sum()), np.zeros((weight - ones).sum())])


class Finder:
    def __init__(self, weights: np.ndarray | None):
        self.weights = weights

    def added(self, text: str, base: list) -> list[tuple[str, int, int]]:
        if self.weights is None:
            return []
        return [c for c in candidates(text, base) if 1 / (1 + np.exp(-(np.dot(features(pattern(text, *c)), self.weights[:-1]) + self.weights[-1]))) >= THRESHOLD]

    def all(self, text: str) -> tuple[list, list]:
        """(base spans, all spans)."""
        base = base_spans(text)
        return base, sorted([*base, *self.added(text, base)], key=lambda s: (KINDS[s[0]], s[1]))


def told(spans: list) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str, spans: list) -> str:
    """Spans replaced by their kind in brackets; overlapping ones by that of the first."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame) -> DataFrame:
    """docs with personal data in column text replaced; null texts stay null."""
    find, at = Finder(learn(docs)), docs.columns.index("text")

    def run(batches):
        for b in (x for whole in batches for x in slices(whole)):
            texts = [t if t is None else redact(t, s) if (s := find.all(t)[1]) else t for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:at], pa.array(texts, b.schema.types[at]), *b.columns[at + 1 :]], schema=b.schema)

    return docs.mapInArrow(trimmed(run), docs.schema)


def op2(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    find = Finder(learn(docs))

    def run(found):
        for doc_id, text in found:
            base, spans = find.all(text)
            n = Counter(k for k, _, _ in base)
            yield doc_id, *(n[k] for k in BASE), hashlib.sha256(told(base).encode()).hexdigest(), told(spans)

    fields = [("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in BASE), ("base_sha256", pa.string()), ("spans", pa.string())]
    return map_rows(docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))), run, fields, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string", 1024)

"""Personal data by weak supervision.

Four labelers vote on every candidate span: a strict pattern, a gazetteer (domains,
calling codes, card issuers, reserved addresses), the context words before it, and its
shape (checksum, digit counts).  Expectation-maximisation over the counts of vote
patterns estimates how reliable each labeler is; the posteriors train a logistic span
classifier, which decides the candidates that the strict pattern does not settle.
Strict (base) spans always stay.

Only counts of vote patterns leave the tasks (at most ``4 * 3**4 * 4`` rows whatever the
input), so the fit sees every document and its size is bounded.

Null text: no spans.  Offsets are code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
THRESHOLD = 0.5
CONTEXT_CHARS = 40

# Base patterns of the four kinds (email is found from its @, see base_spans).
EMAIL_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
EMAIL_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Loose candidates, a superset in which the base form may fail.
LOOSE_EMAIL = re.compile(r"(?<![^\s<>()\[\],;:\"])[^\s@<>()\[\],;:\"]{1,64}@[^\s@<>()\[\],;:\"]{2,255}")
SPOKEN_EMAIL = re.compile(r"[A-Za-z0-9._-]{1,64} ?[(\[]at[)\]] ?[A-Za-z0-9-]{1,64}(?: ?[(\[]dot[)\]] ?[A-Za-z0-9-]{1,64}){1,4}", re.I)
LOOSE_PHONE = re.compile(r"(?<![0-9.+(-])\(?[0-9][0-9().\x20-]{5,22}[0-9](?![0-9])")
IP6 = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")

# Gazetteers.
DOMAINS = frozenset("com org net edu gov int info io dev de fr es it uk us eu ch at nl be pl se no jp cn in br ca au".split())
CALLING = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49",
           "52", "55", "61", "64", "65", "81", "82", "86", "90", "91")
ISSUERS = re.compile(r"4|5[1-5]|2[2-7]|3[47]|6011|65|35|30[0-5]|36|38")
CONTEXT = {
    "email": re.compile(r"e-?mail|contact|write to|correo|courriel", re.I),
    "ip": re.compile(r"\bip\b|host|server|address|login from", re.I),
    "card": re.compile(r"card|visa|payment|credit|karte|carte|tarjeta", re.I),
    "phone": re.compile(r"phone|tel\b|tel[.:]|call|fax|mobile|handy|\bt[ée]l", re.I),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Matches of the base patterns, leftmost and non-overlapping per kind; failing ones are dropped.

    An email is looked for from each @: its local part is the whole run of local
    characters before it (not before the last match's end), which is where the leftmost
    match starts; so a long text without @ costs nothing and none is quadratic.
    """
    out = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in EMAIL_LOCAL:
            start -= 1
        m = EMAIL_DOMAIN.match(text, at) if start < at else None
        if m:
            done = m.end()
            out.append((start, done, "email"))
        else:
            done = max(done, at + 1)
        at = text.find("@", done)
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m.group().split(".")):
            out.append((m.start(), m.end(), "ip"))
    for m in CARD.finditer(text):
        d = only_digits(m.group()) if m.end() - m.start() <= 37 else ""
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(only_digits(m.group())) <= 15:
                out.append((m.start(), m.end(), "phone"))
    return ordered(out)


def ordered(spans):
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def candidates(text: str) -> list[tuple[int, int, str, tuple[int, ...]]]:
    """Spans that some labeler may take for personal data, with their feature pattern.

    A loose span that overlaps a base span is settled by it and no candidate.
    """
    base = base_spans(text)
    found = set(base)
    if "@" in text:
        found |= {(m.start(), m.end(), "email") for m in LOOSE_EMAIL.finditer(text)}
    if "at" in text or "AT" in text:
        found |= {(m.start(), m.end(), "email") for m in SPOKEN_EMAIL.finditer(text)} if re.search(r"[(\[]at[)\]]", text, re.I) else set()
    if ":" in text:
        found |= {(m.start(), m.end(), "ip") for m in IP6.finditer(text)}
    for m in CARD.finditer(text):
        if 13 <= len(only_digits(m.group())) <= 19:
            found.add((m.start(), m.end(), "card"))
    for m in LOOSE_PHONE.finditer(text):
        if 7 <= len(only_digits(m.group())) <= 15:
            found.add((m.start(), m.end(), "phone"))
    strict, out, open_until, at = set(base), [], 0, 0
    for a, b, k in ordered(found):
        if (a, b, k) in strict:
            out.append((a, b, k, features(text, a, b, k, True)))
            continue
        while at < len(base) and base[at][0] < a:
            open_until = max(open_until, base[at][1])
            at += 1
        if open_until <= a and (at == len(base) or base[at][0] >= b):
            out.append((a, b, k, features(text, a, b, k, False)))
    return out


def features(text: str, a: int, b: int, kind: str, strict: bool) -> tuple[int, ...]:
    """Votes (1 for, 0 against, -1 abstains) of the four labelers, then two shape flags."""
    s = text[a:b]
    before = text[max(0, a - CONTEXT_CHARS):a]
    digits = only_digits(s)
    if kind == "email":
        last = re.split(r"[.\s\])]+", s.rstrip(".!?"))[-1].lower()
        gazetteer = int(last in DOMAINS)
        shape = int(bool(re.search(r"@[^@.]+\.[A-Za-z]{2,}", s)) or "dot" in s.lower())
    elif kind == "ip":
        gazetteer = int(not re.match(r"0\.|127\.|255\.", s))
        shape = int(":" in s or len(digits) >= 4)
    elif kind == "card":
        gazetteer = int(bool(ISSUERS.match(digits)))
        shape = int(luhn(digits) and len(digits) >= 14)
    else:
        gazetteer = int(s.startswith("+") and digits.startswith(CALLING)) if s.startswith("+") else -1
        shape = int(10 <= len(digits) <= 15 and bool(re.search(r"[ ().-]", s)))
    context = 1 if CONTEXT[kind].search(before) else (0 if any(p.search(before) for k, p in CONTEXT.items() if k != kind) else -1)
    joined = int((a > 0 and text[a - 1].isalnum()) or (b < len(text) and text[b].isalnum()))
    grouped = int(bool(re.search(r"[ .()-]", s)))
    return int(strict), gazetteer, context, shape, joined, grouped


class Classifier:
    """Per kind: labeler reliabilities from EM, then logistic weights over votes and flags."""

    def __init__(self, counts: dict[tuple, int]):
        self.reliability: dict[str, list[tuple[float, float]]] = {}
        self.weights: dict[str, np.ndarray] = {}
        for kind in KINDS:
            rows = sorted((k[1:], n) for k, n in counts.items() if k[0] == kind)
            if rows:
                votes = np.array([r[:4] for r, _ in rows])
                n = np.array([c for _, c in rows], float)
                post = self._em(kind, votes, n)
                self.weights[kind] = self._fit(np.array([self._vector(r) for r, _ in rows]), post, n)

    def _em(self, kind: str, votes: np.ndarray, n: np.ndarray, rounds: int = 50) -> np.ndarray:
        """Posterior of each vote pattern; starts from the majority of the votes cast."""
        post = ((votes == 1).sum(1) + 0.5) / ((votes >= 0).sum(1) + 1.0)
        for _ in range(rounds):
            w1, w0 = post * n, (1 - post) * n
            prior = (w1.sum() + 1) / (n.sum() + 2)
            odds = np.full(len(n), math.log(prior / (1 - prior)))
            rel = []
            for j in range(votes.shape[1]):
                cast, yes = votes[:, j] >= 0, votes[:, j] == 1
                # Beta(4, 1) priors keep a labeler from turning against its meaning
                sens = (w1[yes].sum() + 4) / (w1[cast].sum() + 5)
                spec = (w0[cast & ~yes].sum() + 4) / (w0[cast].sum() + 5)
                odds += np.where(yes, math.log(sens / (1 - spec)), np.where(cast, math.log((1 - sens) / spec), 0.0))
                rel.append((float(sens), float(spec)))
            post = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        self.reliability[kind] = rel
        return post

    @staticmethod
    def _vector(f: tuple[int, ...]) -> list[float]:
        return [1.0] + [x for v in f[:4] for x in (float(v == 1), float(v == 0))] + [float(v) for v in f[4:]]

    @staticmethod
    def _fit(x: np.ndarray, y: np.ndarray, n: np.ndarray, rounds: int = 40, ridge: float = 0.1) -> np.ndarray:
        """Weighted ridge logistic regression by Newton steps (soft labels)."""
        w = np.zeros(x.shape[1])
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            grad = x.T @ (n * (y - p)) - ridge * w
            hess = (x * (n * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge * np.eye(len(w))
            step = np.linalg.solve(hess, grad)
            w += np.clip(step, -4, 4)
            if np.abs(step).max() < 1e-8:
                break
        return w

    def probability(self, kind: str, f: tuple[int, ...]) -> float:
        w = self.weights.get(kind)
        return 0.0 if w is None else float(1 / (1 + math.exp(-max(-30.0, min(30.0, float(np.dot(self._vector(f), w)))))))

    def spans(self, text: str) -> tuple[list, list]:
        """(base spans, all spans): base ones, and accepted candidates that overlap none taken before."""
        cands = candidates(text)
        base = [(a, b, k) for a, b, k, f in cands if f[0]]
        taken = [(a, b) for a, b, _ in base]
        more = []
        scored = sorted(((-self.probability(k, f), a, b, k) for a, b, k, f in cands if not f[0]))
        for p, a, b, k in scored:
            if -p >= THRESHOLD and all(b <= x or a >= y for x, y in taken):
                taken.append((a, b))
                more.append((a, b, k))
        return base, ordered(base + more)


def has_candidates(text: str) -> bool:
    return re.search(r"[0-9@]|[(\[][aA][tT][)\]]|:", text) is not None


def fit(docs: DataFrame, text: str = "text") -> Classifier:
    """Labeler reliabilities and span classifier from every text of ``docs``."""
    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n: Counter = Counter()
            for x in pdf["t"]:
                if isinstance(x, str) and has_candidates(x):
                    n.update((k, *f) for _, _, k, f in candidates(x))
            yield pd.DataFrame([(k[0], list(k[1:]), v) for k, v in n.items()], columns=["kind", "f", "n"])

    rows = (docs.select(F.col(text).alias("t")).mapInPandas(tally, "kind string, f array<int>, n long")
            .groupBy("kind", "f").agg(F.sum("n").alias("n")).collect())
    return Classifier({(r["kind"], *r["f"]): r["n"] for r in rows})


def listed(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def find(docs: DataFrame, model: Classifier, text: str = "text", out: str = "pii") -> DataFrame:
    """``docs`` with struct ``out``: base and all spans as 'kind:start:end' lists, and the text with all spans masked.

    A masked span becomes ``[KIND]``; overlapping spans become one mask, of the first kind.
    """
    model_b = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("base string, spans string, masked string")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = model_b.value
        for s in batches:
            rows = []
            for x in s:
                if not isinstance(x, str) or not has_candidates(x):
                    rows.append(("", "", x if isinstance(x, str) else None))
                    continue
                base, spans = m.spans(x)
                rows.append((listed(base), listed(spans), mask(x, spans) if spans else x))
            yield pd.DataFrame(rows, columns=["base", "spans", "masked"])

    return docs.withColumn(out, of(F.col(text)))


def mask(text: str, spans) -> str:
    out, at, end = [], 0, -1
    for a, b, k in spans:
        if a >= end:
            out.append(text[at:a] + f"[{k.upper()}]")
            at = end = b
        elif b > end:
            at = end = b
    return "".join(out) + text[at:]


def sha256(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()

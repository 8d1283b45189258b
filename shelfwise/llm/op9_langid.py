"""Language identification by cross-parsing entropy.

A suffix automaton per language is built from a bounded sample of labelled text.  A
text is parsed greedily against each automaton: every phrase is the longest match in
that language's sample.  Cross-parsing estimates cross-entropy: a phrase costs the bits
of a place in the sample and of a symbol, so that samples of different size compare, and
the language in which the text costs least wins.

The automata are dense transition tables, so thousands of text segments are parsed in
lock-step with numpy, one symbol per step.

Text form: letters folded to lower case, every run of other characters one separator.  Up
to ``SINGLE`` letters are one symbol each; of a larger alphabet the rarer letters are two
to four symbols, so every letter of the training text keeps its own code.
A text is parsed in segments of ``SEGMENT`` symbols (at most one phrase more each), so
a very long text needs no more memory at a time than ``PIECE`` characters.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bounds of the training sample, per language: symbols in an automaton, texts drawn, longest piece of a text.
TRAIN_SYMBOLS = 40_000
TRAIN_ROWS = 400
TRAIN_MAX_CHARS = 20_000
SEGMENT = 1024
PIECE = 1 << 20
#: Above this many phrases per symbol a text resembles none of the languages.
MAX_PHRASE_RATE = 0.6


#: Letters of an alphabet that fits single symbols.  In a larger one: letters of one symbol,
#: lead symbols of two-symbol codes and of three-symbol codes, symbols that end or continue a code.
SINGLE = 250
ONE, LEAD_TWO, LEAD_THREE, TRAIL = 122, 48, 16, 64


def code(rank: int) -> int:
    """Symbols of the letter of a rank in a large alphabet, the first one in the low byte (up to four, room for a million letters)."""
    lead, trail = ONE + 1, ONE + 1 + LEAD_TWO + LEAD_THREE
    if rank < ONE:
        return rank + 1
    rank -= ONE
    if rank < LEAD_TWO * TRAIL:
        return lead + rank // TRAIL | trail + rank % TRAIL << 8
    rank -= LEAD_TWO * TRAIL
    three, rank = divmod(rank, TRAIL * TRAIL)
    if three < LEAD_THREE - 4:
        return lead + LEAD_TWO + three | trail + rank // TRAIL << 8 | trail + rank % TRAIL << 16
    four, high = divmod(three - (LEAD_THREE - 4), TRAIL)
    return lead + LEAD_TWO + LEAD_THREE - 4 + four | trail + high << 8 | trail + rank // TRAIL << 16 | trail + rank % TRAIL << 24


def fold_table(alphabet: str) -> np.ndarray:
    """code point -> symbol: 0 separator, 1.. the alphabet, last: a letter outside it.

    An alphabet of more than ``SINGLE`` letters gives the symbols of ``code`` as bytes of an integer.
    """
    large = len(alphabet) > SINGLE
    codes = {c: code(i) if large else i + 1 for i, c in enumerate(alphabet)}
    other = min(len(alphabet), SINGLE) + 1
    out = np.zeros(0x110000, "<u4" if large else np.uint8)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            out[i] = codes.get(c.lower()[0], other)
    return out


def symbols(text: str, table: np.ndarray) -> np.ndarray:
    """Symbols of a text, framed by separators, runs of separators collapsed."""
    cps = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    body = table[cps]
    if table.dtype != np.uint8:
        parts = body.view(np.uint8).reshape(-1, 4)
        body = parts[(parts != 0) | (np.arange(4) == 0)]
    s = np.zeros(len(body) + 2, np.uint8)
    s[1:-1] = body
    keep = np.empty(len(s), bool)
    keep[0] = True
    keep[1:] = (s[1:] != 0) | (s[:-1] != 0)
    return s[keep]


def suffix_automaton(seq: list[int], width: int) -> np.ndarray:
    """Transition table of the suffix automaton of ``seq``: row offsets, -1 where no match goes on."""
    nxt: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in seq:
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    out = np.full((len(nxt), width), -1, np.int32)
    for i, row in enumerate(nxt):
        for c, to in row.items():
            out[i, c] = to * width
    return out.ravel()


class Model:
    """Folding table and one automaton per language (languages in sorted order)."""

    def __init__(self, samples: dict[str, list[str]]):
        seen = Counter(ch for t in samples.values() for x in t for ch in x if ch.isalpha())
        often: Counter[str] = Counter()
        for ch, n in seen.items():
            often[ch.lower()[0]] += n
        letters = sorted(often)
        if len(letters) > SINGLE:
            letters.sort(key=lambda ch: (-often[ch], ch))
        self.table = fold_table("".join(letters))
        self.width = min(len(letters), SINGLE) + 2
        self.langs = sorted(samples)
        trained = [self._train(samples[k]) for k in self.langs]
        self.automata = [suffix_automaton(x, self.width) for x in trained]
        #: Bits of a phrase, per language: a place in the sample and the symbol after the match.
        self.bits = np.array([np.log2(max(len(x), 2)) + np.log2(self.width) for x in trained])

    def _train(self, texts: list[str]) -> list[int]:
        seq: list[int] = []
        for x in texts:
            seq += symbols(x, self.table)[:TRAIN_SYMBOLS - len(seq)].tolist()
        return seq

    def parse(self, pieces: list[np.ndarray]) -> np.ndarray:
        """Phrases needed by each symbol sequence (rows) in each language (columns)."""
        owner, parts = [], []
        for i, s in enumerate(pieces):
            for at in range(0, len(s), SEGMENT):
                owner.append(i)
                parts.append(s[at:at + SEGMENT])
        out = np.zeros((len(pieces), len(self.langs)), np.int64)
        if not parts:
            return out
        size = np.array([len(x) for x in parts])
        order = np.argsort(-size, kind="stable")
        grid = np.zeros((len(parts), int(size.max())), np.uint8)
        for row, k in enumerate(order):
            grid[row, :size[k]] = parts[k]
        grid = np.ascontiguousarray(grid.T)
        active = np.searchsorted(-size[order], -np.arange(grid.shape[0]), side="left")
        owner_a = np.array(owner)[order]
        for col, t in enumerate(self.automata):
            state = np.zeros(len(parts), np.int32)
            count = np.ones(len(parts), np.int64)
            for step in range(grid.shape[0]):
                k = active[step]
                c = grid[step, :k]
                to = t[state[:k] + c]
                miss = np.flatnonzero(to < 0)
                if len(miss):
                    count[miss] += step > 0
                    to[miss] = np.maximum(t[c[miss]], 0)
                state[:k] = to
            np.add.at(out[:, col], owner_a, count)
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float]]:
        """(language, score, phrases per symbol) of each text; no letters: ('und', 0, 1)."""
        total = np.zeros((len(texts), len(self.langs)), np.int64)
        n = np.zeros(len(texts), np.int64)
        letters = np.zeros(len(texts), bool)
        ids: list[int] = []
        pieces: list[np.ndarray] = []
        held = 0

        def flush():
            if pieces:
                np.add.at(total, ids, self.parse(pieces))
                ids.clear()
                pieces.clear()

        for i, x in enumerate(texts):
            for at in range(0, len(x or ""), PIECE):
                s = symbols(x[at:at + PIECE], self.table)
                if s.any():
                    letters[i] = True
                    n[i] += len(s)
                    ids.append(i)
                    pieces.append(s)
                    held += len(s)
                if held > 4 * PIECE:
                    flush()
                    held = 0
        flush()
        out = []
        for i in range(len(texts)):
            if not letters[i] or not self.langs:
                out.append(("und", 0.0, 1.0))
                continue
            cost = total[i] * self.bits
            best = int(np.argmin(cost))
            rest = np.delete(cost, best)
            score = float(rest.min() / (rest.min() + cost[best])) if len(rest) else 1.0
            out.append((self.langs[best], float(score), float(total[i][best] / n[i])))
        return out


def held_out(doc_id) -> Column:
    """crc32 of the id as text, modulo 4, is 2 (false for a null id)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Fit on a bounded sample of the labelled rows of ``docs``.

    Texts are drawn by their hash against a rate per language (``TRAIN_ROWS`` over its
    distinct texts; all where there are no more), so copies do not thin the draw, no
    language is sorted or gathered in one task, and about ``TRAIN_ROWS`` pieces of at most
    ``TRAIN_MAX_CHARS`` characters per language reach the driver.  A longer text gives the
    piece that begins at its first letter.  The draw depends on the texts alone, not on
    partitions.  If chance leaves a labelled language without a text, its least hash is drawn.
    """
    x = docs.select(F.col(text).alias("t"), F.col(lang).alias("l")).where(
        F.col("t").rlike(r"\p{L}") & F.col("l").isNotNull()).withColumn("h", F.pmod(F.xxhash64("t"), F.lit(1 << 30)))
    counts = {r["l"]: r for r in x.groupBy("l").agg(F.count_distinct(F.xxhash64("t")).alias("n"), F.min("h").alias("least")).collect()}
    if not counts:
        return Model({})
    want = F.lit(False)
    for k, r in counts.items():
        below = (1 << 30) if r["n"] <= TRAIN_ROWS else max((1 << 30) * TRAIN_ROWS // r["n"], r["least"] + 1)
        want = want | ((F.col("l") == k) & (F.col("h") < below))
    piece = F.when(F.length("t") <= TRAIN_MAX_CHARS, F.col("t")).otherwise(
        F.regexp_extract("t", rf"\p{{L}}[\s\S]{{0,{TRAIN_MAX_CHARS - 1}}}", 0))
    got: dict[str, list[str]] = {k: [] for k in counts}
    for r in x.where(want).select("l", piece.alias("t"), "h").distinct().orderBy("h", "t").collect():
        got[r["l"]].append(r["t"])
    return Model(got)


def predict(docs: DataFrame, model: Model, text: str = "text", out: str = "language") -> DataFrame:
    """``docs`` with struct ``out``: lang_pred, score (0.5 to 1: second best against best), phrase_rate.

    Null, empty or letterless text: ('und', 0, 1).  Only the text column goes to Python.
    """
    model_b = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, phrase_rate double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = model_b.value
        for s in batches:
            yield pd.DataFrame(m.predict([x if isinstance(x, str) else None for x in s]),
                               columns=["lang_pred", "score", "phrase_rate"])

    return docs.withColumn(out, of(F.col(text)))


def accepted(result: str = "language") -> Column:
    """A text in one of the learned languages: not ``und`` and matched in phrases, not letter by letter."""
    return (F.col(f"{result}.lang_pred") != "und") & (F.col(f"{result}.phrase_rate") <= MAX_PHRASE_RATE)

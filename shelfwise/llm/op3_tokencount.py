"""Token counts of a word-end BPE vocabulary by a finite-state transducer.

The transducer reads the bytes of a word and emits, on every transition, how much the
token count of the prefix changes; the sum over a word is its token count.  After a
prefix, merging leaves a unique last token, and a token may follow another exactly when
merging both strings together gives the two back.  So a state needs only the longest
suffix that can still grow into a token and the last tokens at its positions: finitely
many states, built when first reached and kept by identity (bounded, then rebuilt).

Between words the tokenizer has no memory across white space.  A chunk of text is
therefore a state map: text up to its first white space (read from whatever state
enters), the tokens counted inside, and the text after its last white space (the state
that leaves).  Maps compose associatively; a long text is cut into chunks whose maps
are folded as a balanced prefix-scan tree.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 1 << 16
#: Words and states kept before a table is started anew.
KEEP = 1_000_000

# White space of the tokenizer's patterns, and its split pattern.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_spaces = re.compile(f"[{SPACE}]+")
_control = re.compile("[\x1c-\x1f]")


class WordTransducer:
    """Counts the tokens of one word; ``merges`` in rank order over strings with a word-end mark."""

    def __init__(self, merges: list[tuple[str, str]], end: str):
        self.end = end
        self.merges = merges
        self.rank = {m: i for i, m in enumerate(merges)}
        self.made = {a + b: i for i, (a, b) in enumerate(merges)}
        self.tokens = set(self.made)
        self.prefixes = {t[:i] for t in self.tokens for i in range(len(t))} | {""}
        self.pair: dict[tuple[str | None, str], bool] = {}
        self.reset()

    def reset(self):
        self.ids: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.step: list[dict[str, tuple[int, int]]] = []
        self.start = self.state(("", (None,), (0,)))

    def state(self, key: tuple) -> int:
        k = self.ids.get(key)
        if k is None:
            k = self.ids[key] = len(self.states)
            self.states.append(key)
            self.step.append({})
        return k

    def merge(self, symbols: list[str]) -> list[str]:
        while len(symbols) > 1:
            best = min(range(len(symbols) - 1), key=lambda i: self.rank.get((symbols[i], symbols[i + 1]), 1 << 30))
            pair = (symbols[best], symbols[best + 1])
            if pair not in self.rank:
                break
            out, i = [], 0
            while i < len(symbols):
                if i + 1 < len(symbols) and (symbols[i], symbols[i + 1]) == pair:
                    out.append(pair[0] + pair[1])
                    i += 2
                else:
                    out.append(symbols[i])
                    i += 1
            symbols = out
        return symbols

    def letters(self, token: str) -> list[str]:
        if token.endswith(self.end) and token != self.end:
            body = token[:-len(self.end)]
            return [*body[:-1], body[-1] + self.end]
        return list(token)

    def whole(self, token: str) -> bool:
        """The token is what merging its own letters gives."""
        ok = self.pair.get((None, token))
        if ok is None:
            ok = self.pair[None, token] = self.merge(self.letters(token)) == [token]
        return ok

    def follows(self, before: str | None, token: str) -> bool:
        """Merging the letters of ``before`` and ``token`` together gives just the two.

        True unless some merge across the boundary would come first: both sides' merges
        are undone from the latest back, and each pair that then meets at the boundary
        must rank after the merge that consumed its left part, and not before or level
        with the one that consumed its right part (of equal merges the leftmost is first).
        """
        if before is None:
            return self.whole(token)
        ok = self.pair.get((before, token))
        if ok is not None:
            return ok
        if len(self.pair) > 4 * KEEP:
            self.pair.clear()
        ok = self.whole(token)
        x, y, x_gone, y_gone = before, token, 1 << 30, 1 << 30
        while ok:
            r = self.rank.get((x, y))
            if r is not None and r < x_gone and r <= y_gone:
                ok = False
                break
            made_x, made_y = self.made.get(x, -1), self.made.get(y, -1)
            if made_x < 0 and made_y < 0:
                break
            if made_x > made_y:
                x_gone, x = made_x, self.merges[made_x][1]
            else:
                y_gone, y = made_y, self.merges[made_y][0]
        self.pair[before, token] = ok
        return ok

    def compile(self, at: int, symbol: str) -> tuple[int, int]:
        """The transition from state ``at`` on ``symbol`` (one byte, or one byte with the end mark)."""
        suffix, last, counts = self.states[at]
        grown = suffix + symbol
        final = len(symbol) > 1
        size = len(suffix) + 1
        for take in range(size, 0, -1):  # bytes in the candidate token
            token = grown[size - take:]
            if (take == 1 or token in self.tokens) and self.follows(last[size - take], token):
                count = counts[size - take] + 1
                break
        if final:
            move = (self.start, count)
        else:
            # of the positions behind, only those where a token may yet start tell states apart
            live = [k for k in range(size, -1, -1) if grown[size - k:] in self.prefixes]
            keep = live[0]
            before, n = [""] * (keep + 1), [0] * (keep + 1)
            for k in live[:-1]:
                before[keep - k], n[keep - k] = last[size - k], counts[size - k] - count
            before[keep] = token
            move = (self.state((grown[size - keep:], tuple(before), tuple(n))), count)
        self.step[at][symbol] = move
        return move

    def count(self, word: str) -> int:
        """Tokens of a word given as byte letters."""
        if len(self.states) > KEEP:
            self.reset()
        at, total, step = self.start, 0, self.step
        for c in word[:-1]:
            move = step[at].get(c) or self.compile(at, c)
            at = move[0]
            total += move[1]
        c = word[-1] + self.end
        return total + (step[at].get(c) or self.compile(at, c))[1]


class Counter:
    """Token counts of whole texts for one vocabulary file."""

    def __init__(self, path: str):
        import regex
        j = json.load(open(path, encoding="utf-8"))
        m = j["model"]
        self.check(j)
        merges = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in m["merges"]]
        self.words = WordTransducer(merges, m["end_of_word_suffix"])
        self.byte = dict(enumerate(byte_letters()))
        self.split = regex.compile(SPLIT)
        self.special = [t["content"] for t in j["added_tokens"]]
        self.cut = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        self.known: dict[str, int] = {}
        self.span_known: dict[str, int] = {}

    @staticmethod
    def check(j: dict) -> None:
        """The settings this transducer reproduces; another kind of vocabulary is refused."""
        kinds = [n["type"] for n in j["normalizer"]["normalizers"]]
        parts = j["pre_tokenizer"]["pretokenizers"]
        if kinds != ["NFC", "Replace", "Lowercase"] or parts[0]["pattern"]["Regex"] != SPLIT or not j["model"]["end_of_word_suffix"]:
            raise ValueError("not a word-end BPE vocabulary of the supported form")

    def word(self, w: str) -> int:
        n = self.known.get(w)
        if n is None:
            if len(self.known) > KEEP:
                self.known.clear()
            n = self.known[w] = self.words.count(w.encode("utf-8", "replace").decode("latin-1").translate(self.byte))
        return n

    def span(self, s: str) -> int:
        """Tokens of a stretch without white space, read from the state after white space."""
        n = self.span_known.get(s)
        if n is None:
            if len(self.span_known) > KEEP:
                self.span_known.clear()
            pieces = self.cut.split(s) if self.cut else [s]
            n = len(pieces) - 1
            for p in pieces:
                low = unicodedata.normalize("NFC", p).replace("Σ", "σ").lower()
                n += sum(map(self.word, self.split.findall(low)))
            if len(s) <= 64:
                self.span_known[s] = n
        return n

    def chunk(self, text: str) -> tuple[str, int, str | None]:
        """State map of a chunk: (head, tokens inside, tail); tail None: no white space, all is head."""
        spans = _spaces.split(text) if _control.search(text) else None
        if spans is None:
            spans = text.split()
            if text[:1].isspace():
                spans.insert(0, "")
            if text[-1:].isspace() and len(text) > 0:
                spans.append("")
        if not spans:
            return "", 0, None
        first_space = _spaces.search(text)
        if first_space is None:
            return text, 0, None
        inside = spans[1:-1]
        counts = list(map(self.span_known.get, inside))
        if None in counts:
            counts = [self.span(s) if n is None else n for s, n in zip(inside, counts)]
        return spans[0], sum(counts), spans[-1]

    def compose(self, a, b):
        if b[2] is None:
            return (a[0] + b[0], 0, None) if a[2] is None else (a[0], a[1], a[2] + b[0])
        if a[2] is None:
            return a[0] + b[0], b[1], b[2]
        return a[0], a[1] + self.span(a[2] + b[0]) + b[1], b[2]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        maps = [self.chunk(text[i:i + CHUNK]) for i in range(0, len(text), CHUNK)]
        while len(maps) > 1:
            maps = [self.compose(*maps[i:i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        head, inside, tail = maps[0]
        return self.span(head) + inside + (self.span(tail) if tail else 0)


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if printable, else the next from U+0100."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in keep}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(keep))
    return [out[b] for b in range(256)]


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, path: str, limit: int = 2048, text: str = "text") -> DataFrame:
    """``docs`` with n_bytes, n_tokens and over_limit (n_tokens > limit).

    Null and empty texts have none.  ``path`` is a vocabulary file present on every
    executor.  One pass without a shuffle; only the text column goes to Python.
    """
    @F.pandas_udf("long")
    def n_tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = counter(path)
        for s in batches:
            yield pd.Series([c.count(x if isinstance(x, str) else None) for x in s], dtype="int64")

    return docs.withColumns({
        "n_bytes": F.coalesce(F.octet_length(text), F.lit(0)).cast("long"), "n_tokens": n_tokens(F.col(text)),
    }).withColumn("over_limit", F.col("n_tokens") > limit)

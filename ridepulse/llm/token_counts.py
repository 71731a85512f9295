"""Token counts (operator 2): exact counts at every prefix by dynamic programming.

Within a word, byte-pair encoding has a prefix recurrence: the encoding of a
prefix ends in the one token t for which the encoding of what is before t ends in
a token u such that (u, t) is *stable*, that is, merging the characters of u
followed by those of t gives just u and t again.  So count[j] = count[j - |t|] + 1,
with one token kept per prefix.  Across words the recurrence is a sum, because the
tokenizer never joins words.  ``token_counts`` takes the last entry of every word's
table (each distinct word is run once per worker, in a memo of bounded size), adds them
up to the counts at all word ends, and reads the budget's answer (the longest prefix within
a limit) from the table of the one word where it ends, so no prefix is encoded again.
``prefix_counts`` gives the whole table of a text, one exact count per prefix.  Chunks with
characters that only the library handles (see ``tokens``) are normalised and split by the
library once, and the recurrence runs inside each of the pieces.  No token is counted by encoding.

Whether a pair is stable is read off the tokens' own merges, backwards in time: the pair at the
border is merged across it if its merge comes before the ones that take its two sides away.

A null text counts as empty (0 tokens); repeated rows, null ids and extra columns
are kept apart by row; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridepulse.llm.tokens import _OTHER, PIECES, WordTokenizer, tokenizer

END = "</w>"
NEVER = 1 << 60
#: Entries of each half of a worker's memos.
MEMO = 300_000
#: Longer words are not kept in a memo, so that its size has a bound.
KEPT = 64


class Memo:
    """Counts by text in two halves of bounded size: when the new one is full, what was not used since its start goes."""

    def __init__(self):
        self.new: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def get(self, key: str) -> int | None:
        n = self.new.get(key)
        if n is None and (n := self.old.get(key)) is not None:
            self.keep(key, n)
        return n

    def keep(self, key: str, n: int) -> None:
        if len(key) <= KEPT:
            if len(self.new) >= MEMO:
                self.old, self.new = self.new, {}
            self.new[key] = n


class PrefixCounts:
    """Token counts of every prefix of a word, by the recurrence above."""

    def __init__(self, words: WordTokenizer):
        self.words = words
        model = json.load(open(words.path, encoding="utf-8"))["model"]
        self.ranks = {tuple(m.split(" ") if isinstance(m, str) else m): r for r, m in enumerate(model["merges"])}
        self.vocab = model["vocab"]
        self.longest = max(map(len, self.vocab))
        self.stable = lru_cache(500_000)(self._stable)
        self.born: dict[str, tuple[int, str, str] | None] = {}
        self.sure: set[str] = set()
        self.of_chunk, self.of_letters = Memo(), Memo()
        self.normal = lru_cache(20_000)(words.library.normalizer.normalize_str)
        self.split = words.library.pre_tokenizer.pre_tokenize_str
        self.special = re.compile("|".join(re.escape(t.content) for t in words.library.get_added_tokens_decoder().values()) or "(?!)")

    @staticmethod
    def symbols(token: str) -> list[str]:
        if token.endswith(END) and len(token) > len(END):
            body = token[: -len(END)]
            return [*body[:-1], body[-1] + END]
        return [*token]

    def last_merge(self, token: str) -> tuple[int, str, str] | None:
        """(rank, left, right) of the merge that completes a token from its characters, rank -1 for a character alone;
        None if its characters do not become it."""
        known = self.born.get(token, 0)
        if known != 0:
            return known
        parts, done = self.symbols(token), (-1, "", "")
        while len(parts) > 1:
            rank, i = min((self.ranks.get(p, NEVER), i) for i, p in enumerate(zip(parts, parts[1:])))
            if rank == NEVER:
                break
            done = rank, parts[i], parts[i + 1]
            parts = [*parts[:i], parts[i] + parts[i + 1], *parts[i + 2:]]
        self.born[token] = done if len(parts) == 1 else None
        return self.born[token]

    def _stable(self, u: str, t: str) -> bool:
        gone_u = gone_t = NEVER
        while True:
            across = self.ranks.get((u, t), NEVER)
            if across < gone_u and across <= gone_t and across < NEVER:  # of equal merges the left one goes first
                return False
            of_u, of_t = self.last_merge(u), self.last_merge(t)
            if of_t[0] >= of_u[0]:
                if of_t[0] < 0:
                    return True
                gone_t, t = of_t[0], of_t[1]
            else:
                gone_u, u = of_u[0], of_u[2]

    def _admit(self, token: str) -> bool:
        if self.last_merge(token):
            self.sure.add(token)
        return token in self.sure

    def word(self, letters: str) -> list[int]:
        """counts[j] for the first j letters (of the byte-level alphabet) standing as a word of their own."""
        last, inner, counts = [""], [0], [0]
        for j in range(1, len(letters) + 1):
            for kind in (END, ""):
                for i in range(max(0, j - self.longest), j):
                    t = letters[i:j] + kind
                    if t in self.vocab and (t in self.sure or self._admit(t)) and (not i or self.stable(last[i], t)):
                        break
                else:
                    raise ValueError(f"no token ends at {j} of {letters!r}")
                if kind:
                    counts.append(inner[i] + 1)
            last.append(t)
            inner.append(inner[i] + 1)
        return counts

    def last_count(self, letters: str) -> int:
        """``word(letters)[-1]``: the same recurrence from the end, so only the prefixes that it asks for are filled in."""
        if len(letters) > KEPT:
            return self.word(letters)[-1]
        vocab, sure, longest, stable = self.vocab, self.sure, self.longest, self.stable
        found: dict[int, tuple[str, int]] = {}

        def ending(j: int, kind: str) -> tuple[str, int]:
            for i in range(max(0, j - longest), j):
                t = letters[i:j] + kind if kind else letters[i:j]
                if t in vocab and (t in sure or self._admit(t)):
                    if not i:
                        return t, 1
                    before = found.get(i)
                    if before is None:
                        before = found[i] = ending(i, "")
                    if stable(before[0], t):
                        return t, before[1] + 1
            raise ValueError(f"no token ends at {j} of {letters!r}")

        return ending(len(letters), END)[1]

    def _letters_total(self, letters: str) -> int:
        n = self.of_letters.get(letters)
        if n is None:
            self.of_letters.keep(letters, n := self.last_count(letters))
        return n

    def totals(self, chunks: list[str]) -> list[int]:
        """The count of each chunk: the last entry of its table."""
        out = list(map(self.of_chunk.new.get, chunks))
        if None in out:
            for at, n in enumerate(out):
                if n is None:
                    n = out[at] = self.of_chunk.get(chunks[at])
                    if n is None:
                        n = out[at] = self._total(chunks[at])
                        self.of_chunk.keep(chunks[at], n)
        return out

    def _total(self, chunk: str) -> int:
        if _OTHER.search(chunk) or "<|" in chunk:
            plain = self.special.split(chunk)
            return len(plain) - 1 + sum(self._whole(self.normal(p)) for p in plain if p)
        if chunk.isascii() and chunk.isalpha():
            return self.last_count(chunk.lower())
        return sum(self._letters_total(self.words.letters(p)) for p in PIECES.findall(chunk.lower()))

    def chunk(self, chunk: str) -> list[int]:
        """Counts of every prefix of a chunk without blanks."""
        if _OTHER.search(chunk) or "<|" in chunk:
            return self._any(chunk)
        out = [0]
        for piece in PIECES.findall(chunk.lower()):
            out += [out[-1] + n for n in self.piece(piece)[1:]]
        return out

    def piece(self, piece: str) -> list[int]:
        """Counts of every prefix of a pre-token: one pass of the recurrence."""
        if piece[0] == "'" and piece[1:].isalpha():  # cut short, a contraction falls apart
            return [0] + [sum(self._letters_total(self.words.letters(x)) for x in PIECES.findall(piece[:j])) for j in range(1, len(piece) + 1)]
        counts = self.word(self.words.letters(piece))
        return counts if piece.isascii() else [counts[i] for i in accumulate((len(c.encode()) for c in piece), initial=0)]

    def _any(self, chunk: str) -> list[int]:
        """Counts of every prefix of any text: special tokens count from their last character on, the rest is plain."""
        out, base, at = [0], 0, 0
        for m in self.special.finditer(chunk):
            counts = self._plain(chunk[at:m.end() - 1])
            out += [base + n for n in counts[1:]]
            base, at = base + counts[m.start() - at] + 1, m.end()
            out.append(base)
        return out + [base + n for n in self._plain(chunk[at:])[1:]]

    def _plain(self, text: str) -> list[int]:
        """Counts of every prefix of a text without special tokens.

        Normalising works on clusters, a character and the marks behind it, one by one.  The library's pieces of the
        normalised text end where they do whatever follows, so a prefix has the pieces before its last one, and a part of that.
        """
        starts = [i for i, c in enumerate(text) if not i or _starts(c)] + [len(text)]
        normal = [self.normal(text[i:j]) for i, j in zip(starts, starts[1:])]
        whole, ends = "".join(normal), [*accumulate(map(len, normal), initial=0)]
        counts, firsts = [0], []
        for letters, (a, b) in self.split(whole):
            counts += [counts[-1]] * (a + 1 - len(counts))
            if whole[a] == "'" and whole[a + 1:b].isalpha():  # cut short, a contraction falls apart
                inside = [self._whole(whole[a:q]) for q in range(a + 1, b + 1)]
            else:
                table = self.word(letters)
                inside = [table[i] for i in accumulate(len(c.encode()) for c in whole[a:b])]
            firsts.append(a)
            counts += [counts[a] + n for n in inside]
        counts += [counts[-1]] * (len(whole) + 1 - len(counts))
        out = [0]
        for i, j, at, end in zip(starts, starts[1:], ends, ends[1:]):
            for cut in range(i + 1, j):
                last = firsts[bisect_left(firsts, at) - 1] if firsts and firsts[0] < at else 0
                out.append(counts[last] + self._whole(whole[last:at] + self.normal(text[i:cut])))
            out += [counts[end]] * (j > i)
        return out

    def _whole(self, normalised: str) -> int:
        return sum(self._letters_total(letters) for letters, _ in self.split(normalised))


@lru_cache(100_000)
def _starts(c: str) -> bool:
    """Whether normalising never joins or reorders a character with those before it."""
    return unicodedata.category(c)[0] != "M" and unicodedata.category(c) != "Cn" and unicodedata.is_normalized("NFC", c) \
        and not "\u1160" <= c <= "\u11ff"


_TABLES: dict[str, PrefixCounts] = {}


def _prefixes(path: str | None) -> PrefixCounts:
    words = tokenizer(path)
    if words.path not in _TABLES:
        _TABLES[words.path] = PrefixCounts(words)
    return _TABLES[words.path]


def prefix_counts(text: str, path: str | None = None) -> list[int]:
    """``table[i]`` is the token count of ``text[:i]``, for every i from 0 to ``len(text)``."""
    table, out = _prefixes(path), [0]
    for blank, chunk in _runs(text):
        out += [out[-1]] * blank
        base = out[-1]
        out += [base + c for c in table.chunk(chunk)[1:]]
    return out


def _runs(text: str) -> Iterator[tuple[int, str]]:
    """(blanks before, chunk) of each chunk, and a last one with the blanks at the end."""
    at = 0
    for c in tokenizer(None).chunks(text):
        start = _find(text, c, at)
        yield start - at, text[start:start + len(c)]
        at = start + len(c)
    yield len(text) - at, ""


def fit(text: str, limit: int, path: str | None = None) -> tuple[int, int]:
    """(tokens of the whole text, characters of its longest prefix with at most ``limit`` tokens)."""
    table = _prefixes(path)
    chunks = table.words.chunks(text)
    total = list(accumulate(table.totals(chunks), initial=0))
    if total[-1] <= limit:
        return total[-1], len(text)
    low, high = 0, len(total) - 1  # the last word end within the limit
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if total[mid] <= limit else (low, mid - 1)
    at = 0
    for c in chunks[:low + 1]:
        start = _find(text, c, at)
        at = start + len(c)
    inside = table.chunk(text[start:at])
    return total[-1], start + max(j for j, n in enumerate(inside) if total[low] + n <= limit)


def _find(text: str, chunk: str, at: int) -> int:
    """Where a (perhaps lower-cased) chunk stands: after the blanks that follow ``at``."""
    while text[at].lower() != chunk[0].lower():
        at += 1
    return at


def token_counts(docs: DataFrame, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text",
                 path: str | None = None) -> DataFrame:
    """Per row: id, n_bytes, n_tokens, over_limit and fit_chars (characters of the longest prefix within ``limit``)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [fit(t, limit, path) for t in b["__text"]]
            yield pd.DataFrame({"__id": b["__id"], "n_bytes": b["n_bytes"],
                                "n_tokens": pd.Series([n for n, _ in found], dtype="int64"),
                                "fit_chars": pd.Series([c for _, c in found], dtype="int64")})

    own = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    kind = own.schema["__id"].dataType.simpleString()
    return own.withColumn("n_bytes", F.octet_length("__text").cast("long")) \
        .mapInPandas(count, f"__id {kind}, n_bytes long, n_tokens long, fit_chars long") \
        .select(F.col("__id").alias(id_col), "n_bytes", "n_tokens",
                (F.col("n_tokens") > limit).alias("over_limit"), "fit_chars")


def prefix_tables(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  path: str | None = None) -> DataFrame:
    """Per row: id and ``prefix_tokens``, the exact count at every prefix (element i + 1: the first i characters).

    Stored once, it answers every truncation question: ``element_at(prefix_tokens, i + 1)``.
    """

    def table(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"__id": b["__id"], "prefix_tokens": [prefix_counts(t, path) for t in b["__text"]]})

    own = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    kind = own.schema["__id"].dataType.simpleString()
    return own.mapInPandas(table, f"__id {kind}, prefix_tokens array<int>").withColumnRenamed("__id", id_col)

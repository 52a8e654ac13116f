"""Token counts by prefix dynamic programming (operator 5).

For every text the table holds one signed byte per character of the normalised text: by how much the
exact token count of the prefix ending there differs from that of the prefix one character shorter.
A running sum therefore gives the token count of *every* prefix; counts, truncation points and budget
questions are answered from the table and the text is never encoded again.

The table is made by dynamic programming over prefixes.  Byte-pair merging has the property that a
sequence of tokens is the encoding of its concatenation exactly when each adjacent pair is the
encoding of that pair.  So the encoding of a prefix ends in the one vocabulary token ``t`` that can
follow the last token of the prefix before ``t``; its count is that prefix's count plus one.  Pieces
whose last symbol carries an end-of-word mark keep a second table for "the prefix ends here".

Rows: null text counts as empty; empty text has an empty table and zero tokens; repeated rows are
kept; an empty table gives an empty result; other columns pass through, and an input column with the
name of a result column is replaced; a text that has no table in one byte a character (none with the given vocabulary)
gets the library's count and a null table.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import accumulate, chain

import ahocorasick
import numpy as np
import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from evigraph.llm._store import spare
from evigraph.llm._worker import ENTRY, Generations, Memo, held

VOCABULARY = "word_bpe_49k.json"
#: Bytes of what a worker keeps: tables of words, of pieces of mixed words, and whether tokens follow each other.
WORD_BYTES, PIECE_BYTES, PAIR_BYTES = 256 << 20, 16 << 20, 96 << 20


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte value used by byte-level vocabularies."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class PrefixCounter:
    """Prefix tables for one vocabulary file with byte-level symbols and an end-of-word mark."""

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model.get("end_of_word_suffix") or ""
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.rank = {(a, b): i for i, (a, b) in enumerate(pairs)}
        self.vocab = model["vocab"]
        self.inside = ahocorasick.Automaton()  # every token found inside a word, open and closed
        closed = {t[: -len(self.end)] for t in self.vocab if self.end and t.endswith(self.end)}
        for body in {t for t in self.vocab if not (self.end and t.endswith(self.end))} | closed:
            if body:
                shut = body + self.end if body in closed else ""
                self.inside.add_word(body, (len(body), body if body in self.vocab else "", shut))
        self.inside.make_automaton()
        self.byte = byte_symbols()
        self.special = [a["content"] for a in spec["added_tokens"]]
        self._special = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        # The piece pattern of the vocabulary file, white space spelled out.
        self._piece = regex.compile(
            r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+"
        )
        self.made_of: dict[str, tuple[str, str]] = {}
        for pair in self.rank:
            self.made_of.setdefault(pair[0] + pair[1], pair)
        self._edges: tuple[dict, dict] = ({}, {})
        self._wholes: dict[str, bool] = {}
        self._follows: dict[tuple[str, str], bool] = Memo(PAIR_BYTES)
        size = lambda text, out: len(text) + len(out) + ENTRY
        self.pieces: dict[str, bytes] = Generations(self.piece, size, PIECE_BYTES)
        self.words: dict[str, bytes] = Generations(self.word, size, WORD_BYTES)
        self._later = self._later_letters()

    def _later_letters(self) -> dict[int, str]:
        """Letters that the library's lower-casing knows and Python's (of an older Unicode) does not."""
        normalizer = Tokenizer.from_file(self.path).normalizer
        signs = [c for c in map(chr, chain(range(0x250, 0xD800), range(0xE000, 0x20000))) if c.lower() == c and not c.isspace()]
        alone = [c for c in signs if normalizer and unicodedata.category(c) == "Cn"]
        made = normalizer.normalize_str(" ".join(alone)).split(" ") if alone else []
        return {ord(c): x for c, x in zip(alone, made, strict=True) if x != c} if len(made) == len(alone) else {}

    def merge(self, symbols: list[str]) -> list[str]:
        """Byte-pair merging of a short symbol list."""
        rank, none = self.rank, len(self.rank)
        while len(symbols) > 1:
            best = min(range(len(symbols) - 1), key=lambda i: rank.get((symbols[i], symbols[i + 1]), none))
            if (symbols[best], symbols[best + 1]) not in rank:
                break
            symbols = [*symbols[:best], symbols[best] + symbols[best + 1], *symbols[best + 2 :]]
        return symbols

    def _symbols(self, token: str) -> list[str]:
        if self.end and token.endswith(self.end):
            body = token[: -len(self.end)]
            return [*body[:-1], body[-1:] + self.end]
        return list(token)

    def _edge(self, token: str, side: int) -> list[tuple[str, float]]:
        """The symbols that stand at one edge of a token while it is merged, with the rank of the merge
        that takes each of them up (none for the token itself).  side: 0 the left edge, 1 the right."""
        got = self._edges[side].get(token)
        if got is None:
            got, at = [(token, float("inf"))], token
            while at in self.made_of:
                pair = self.made_of[at]
                at = pair[side]
                got.append((at, self.rank[pair]))
            self._edges[side][token] = got
        return got

    def _whole(self, token: str) -> bool:
        """Whether the token is the encoding of its own text."""
        got = self._wholes.get(token)
        if got is None:
            got = self._wholes[token] = self.merge(self._symbols(token)) == [token]
        return got

    def follows(self, left: str, right: str) -> bool:
        """Whether ``left right`` is the encoding of its concatenation (``left`` may be empty): no merge
        across the boundary comes before the merges that take up the symbols at it.  At equal rank the
        leftmost merge comes first."""
        got = self._follows.get((left, right))
        if got is None:
            self._follows.room(ENTRY)
            got = self._whole(right)
            if got and left:
                rank, none = self.rank, float("inf")
                edge = self._edge(right, 0)
                got = not any(
                    (r := rank.get((x, y), none)) < taken_x and r <= taken_y
                    for x, taken_x in self._edge(left, 1)
                    for y, taken_y in edge
                    if (x, y) in rank
                )
            self._follows[(left, right)] = got
        return got

    def piece(self, text: str) -> bytes:
        """The deltas of one piece (a word, a digit, a run of signs)."""
        mapped = text if text.isascii() and text.isprintable() else "".join(self.byte[b] for b in text.encode())
        # Last token and count of each prefix of the word, open (more follows) and closed (it ends here).
        n, known, follows = len(mapped), self._follows, self.follows
        last: list[str] = [""] + [""] * n
        opened, closed = [0] + [-1] * n, [0] + [-1] * n
        for end, (size, token, token_end) in self.inside.iter(mapped):  # the longest first at each place
            at = end + 1 - size
            left = last[at]
            if token and opened[end + 1] < 0 and (at == 0 or left):
                ok = known.get((left, token))
                if ok is None:
                    ok = follows(left, token)
                if ok:
                    last[end + 1], opened[end + 1] = token, opened[at] + 1
            if token_end and closed[end + 1] < 0 and (at == 0 or left):
                ok = known.get((left, token_end))
                if ok is None:
                    ok = follows(left, token_end)
                if ok:
                    closed[end + 1] = opened[at] + 1
        ends = (closed if self.end else opened)[1:]
        if min(ends) < 0:
            raise ValueError(f"no token ends a prefix of {text!r}")
        if n != len(text):  # several bytes a character: a prefix ends at a whole character
            ends = [ends[i - 1] for i in accumulate(len(ch.encode()) for ch in text)]
        steps = [ends[0], *map(int.__sub__, ends[1:], ends)]
        if max(steps) > 127 or min(steps) < -128:
            raise OverflowError("a prefix count changes by more than a signed byte holds")
        return bytes([x & 255 for x in steps])

    def word(self, text: str) -> bytes:
        """The deltas of a text between blanks: its pieces' one after another, 0 for what they leave out."""
        if text.isalpha():
            return self.piece(text)
        if text[:-1].isalpha() and text[-1] in ".,":
            return self.words[text[:-1]] + self.pieces[text[-1]]
        at, parts = 0, []
        for m in self._piece.finditer(text):
            parts.append(b"\0" * (m.start() - at) + self.pieces[m.group()])
            at = m.end()
        parts.append(b"\0" * (len(text) - at))
        return b"".join(parts)

    def _plain(self, text: str) -> bytes:
        known = self.words
        return b"\0".join([known[w] for w in text.replace("\n", " ").split(" ")])

    def normal(self, text: str) -> str:
        """The text that prefixes are counted on: NFC, lower case (special strings excepted)."""
        if text.isascii():
            return text.lower()
        low = unicodedata.normalize("NFC", text).lower()
        return low.translate(self._later) if self._later else low

    def deltas(self, text: str | None) -> bytes:
        """One signed byte per character of the normalised text."""
        if not text:
            return b""
        hits = list(self._special.finditer(text)) if "<|" in text and self._special else []
        at, out = 0, []
        for m in hits:
            # Inside a special string a prefix is ordinary text; the whole string is one token.
            before = self.normal(text[at : m.start()])
            run = self._plain(before + self.normal(m.group()[:-1]))
            values = np.frombuffer(run, dtype=np.int8)
            step = int(values[: len(before)].sum()) + 1 - int(values.sum())
            out.append(run + int(step).to_bytes(1, "little", signed=True))
            at = m.end()
        out.append(self._plain(self.normal(text[at:])))
        return b"".join(out)


    def table(self, text: str | None) -> bytes | None:
        """``deltas``, or None where a signed byte a character cannot hold them (with a vocabulary that leaves out bytes,
        or tokens of more than 127 characters)."""
        try:
            return self.deltas(text)
        except (ValueError, OverflowError):
            return None

    def plain_count(self, text: str) -> int:
        """The library's own count, for texts without a table."""
        return len(Tokenizer.from_file(self.path).encode(text, add_special_tokens=False).ids)


def count_at(deltas: bytes, n_chars: int | None = None) -> int:
    """Exact tokens of the first ``n_chars`` characters (all if None), from the stored table."""
    return int(np.frombuffer(deltas, dtype=np.int8)[:n_chars].sum(dtype=np.int64))


def longest_within(deltas: bytes, budget: int) -> int:
    """Characters of the longest prefix of at most ``budget`` tokens, from the stored table."""
    counts = np.cumsum(np.frombuffer(deltas, dtype=np.int8), dtype=np.int64)
    fits = np.flatnonzero(counts <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


def counter(vocabulary: str = VOCABULARY) -> PrefixCounter:
    """The worker's counter for a vocabulary, made at first use."""
    return held(f"counter {vocabulary}", lambda: PrefixCounter(public_tokenizers.path(vocabulary)))


def prefix_token_counts(
    df: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, keep_table: bool = True
) -> DataFrame:
    """``df`` with ``n_tokens`` (long) and, if ``keep_table``, ``prefix_deltas`` (binary).

    One pass, no shuffle.  ``count_at`` and ``longest_within`` read the table; ``truncate_to`` applies
    it to a whole column.
    """
    fields = [T.StructField("n_tokens", T.LongType())]
    if keep_table:
        fields.append(T.StructField("prefix_deltas", T.BinaryType()))

    @F.pandas_udf(T.StructType(fields))
    def table(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = counter(vocabulary)
        for texts in batches:
            deltas = [known.table(x) for x in texts]
            counts = [known.plain_count(x) if d is None else count_at(d) for x, d in zip(texts, deltas, strict=True)]
            out = {"n_tokens": np.array(counts, dtype=np.int64)}
            yield pd.DataFrame(out | ({"prefix_deltas": deltas} if keep_table else {}))

    made = spare(df, "tokens")
    out = df.withColumn(made, table.asNondeterministic()(F.col(text)))
    return out.withColumns({f.name: F.col(f"{made}.{f.name}") for f in fields}).drop(made)


def truncate_to(df: DataFrame, budget: int, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``df`` (with ``prefix_deltas``) plus ``fit_text``: the longest normalised prefix within ``budget``."""

    @F.pandas_udf(T.StringType())
    def cut(texts: pd.Series, tables: pd.Series) -> pd.Series:
        known = counter(vocabulary)
        whole = [t if "<|" in (t or "") else known.normal(t or "") for t in texts]
        return pd.Series([t[: longest_within(d or b"", budget)] for t, d in zip(whole, tables, strict=True)])

    return df.withColumn("fit_text", cut(F.col(text), F.col("prefix_deltas")))


def over_budget(df: DataFrame, budget: int) -> DataFrame:
    """Adds ``over_limit``: more than ``budget`` tokens."""
    return df.withColumn("over_limit", F.col("n_tokens") > F.lit(budget))

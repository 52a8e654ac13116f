"""Best-fit packing by linear grouping (operator 8).

Documents become pieces of at most ``capacity`` tokens; pieces are placed in sequences of that capacity,
few sequences being the aim.  The plan is made from the histogram of piece lengths alone, which has at
most ``capacity`` entries however large the corpus is:

1. Large lengths (over ``small``) are sorted and cut into ``groups`` groups of equal cardinality; each
   group is rounded up to its largest length.
2. Over these few sizes the configuration programme (how many sequences of each composition) is solved
   by column generation, a knapsack giving the next composition; whole multiples are kept and the rest
   is packed best-fit.
3. Actual lengths take the places of their group's rounded length, longest first, which splits a
   composition into runs of equal sequences.
4. Small lengths go, longest first, best-fit into the room left, run by run; what fits nowhere opens new
   sequences.

The plan is a bounded table of runs (composition, number of sequences).  Spark numbers the pieces of
each length (salted counts, so that one common length is not one task) and every piece finds its place
from its number by binary search in the plan: no piece list ever meets the driver or a single task.

Rows: null text counts as empty; an empty text is the single end token; a key that occurs more than once is
packed once per row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from evigraph.llm._store import spread, stage
from evigraph.llm._worker import ENTRY, Memo, held
from evigraph.llm.token_counts import byte_symbols

VOCABULARY = "byte_bpe_50k.json"
CAPACITY = 2048
END_ID = 0
#: Borders between small and large lengths that are tried, as parts of the capacity.
SHARES = (8, 4, 3, 2)
#: Bytes of the words' ids that a worker keeps; beyond it the memo starts anew.
MEMO_BYTES = 48 << 20


class WordEncoder:
    """Ids of whole texts, word by word with a memo; exact for the byte-level vocabulary.

    Its piece pattern never joins a sign to a blank on its right, so a text whose blanks stand alone
    falls into words that can be encoded one by one: a word after a blank carries the blank, a
    word at the start or after a line feed does not.  Texts with other white space go whole to the
    library.
    """

    _FIRST = "\x01"  # marks a word without a blank before it

    def __init__(self, path: str):
        # The library's own threads would fight with Spark's tasks over the cores.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        byte = {c: b for b, c in enumerate(byte_symbols())}
        ranks = {bytes(byte[c] for c in t): i for t, i in self.library.get_vocab(with_added_tokens=False).items() if t not in self.special}
        #: The same vocabulary for single words; it merges by rank as the library does, with less ado.
        self.words = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._odd = re.compile(r"[\s\x00-\x20\x7f-\xa0\u1680\u180e\u2000-\u206f\u3000\ufeff]")
        self.ids: dict[str, bytes | None] = Memo(MEMO_BYTES)

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn(self, words: set[str]) -> None:
        self.ids.room(5 * sum(map(len, words)) + ENTRY * len(words))
        for w in words:
            first = w[:1] == self._FIRST
            body = w[1:] if first else w
            if w == "\n":
                found = self.words.encode_ordinary(w)
            elif not body.isalpha() and (not body or self._odd.search(body) or any(x in body for x in self.special)):
                self.ids[w] = None
                continue
            else:
                found = self.words.encode_ordinary(body if first else " " + body)
            self.ids[w] = array("I", found).tobytes()

    def encode(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids of a whole text."""
        if not text:
            return b""
        words = (self._FIRST + text).replace("\n", " \n " + self._FIRST).split(" ")
        try:
            return b"".join(map(self.ids.__getitem__, words))
        except KeyError:
            self._learn({w for w in words if w not in self.ids})
        except TypeError:  # a word that depends on its surroundings
            return self._whole(text)
        if any(self.ids.get(w) is None for w in words):  # as above, or the memo was emptied meanwhile
            return self._whole(text)
        return b"".join(map(self.ids.__getitem__, words))


def encoder(vocabulary: str = VOCABULARY) -> WordEncoder:
    """The worker's encoder, made at first use."""
    return held(f"encoder {vocabulary}", lambda: WordEncoder(public_tokenizers.path(vocabulary)))


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens: whole ones, but for the first."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def token_pieces(
    df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY,
    capacity: int = CAPACITY, keep_ids: bool = False,
) -> DataFrame:
    """Pieces of every document: key, piece, start, length, ids_crc32 and, if asked for, the ids."""
    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    end = np.asarray([END_ID], dtype="<u4").tobytes()

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = encoder(vocabulary)
        for batch in batches:
            out = []
            for k, ids in zip(batch[key], map(known.encode, batch[text]), strict=True):
                ids += end
                for i, (start, n) in enumerate(cut(len(ids) // 4, capacity)):
                    part = ids[4 * start : 4 * (start + n)]
                    out.append((k, i, start, n, zlib.crc32(part), *([part] if keep_ids else [])))
            yield pd.DataFrame(out, columns=[key, "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])])

    return df.select(F.col(key), F.col(text)).mapInPandas(pieces, schema)


# --- The plan: histogram in, runs of equal sequences out -------------------------------------------------


@dataclass
class Run:
    """``count`` sequences, each holding ``lengths`` in this order."""

    count: int
    lengths: list[int]
    room: int


def _groups(hist: np.ndarray, small: int, groups: int) -> list[tuple[int, int, int]]:
    """(rounded length, lowest length, cardinality) of the groups of large lengths, longest first.  A
    length is not split between groups, so a group can hold more than its share."""
    total = int(hist[small + 1 :].sum())
    share, out, top, n = max(1, -(-total // groups)), [], 0, 0
    for length in range(len(hist) - 1, small, -1):
        if not hist[length]:
            continue
        top, n = top or length, n + int(hist[length])
        if n >= share:
            out.append((top, length, n))
            top = n = 0
    if n:
        out.append((top, small + 1, n))
    return out


def _knapsack(sizes: list[int], values: np.ndarray, most: list[int], capacity: int) -> tuple[float, list[int]]:
    """The most valuable composition of at most ``capacity`` (each size up to ``most`` times)."""
    best, taken = np.zeros(capacity + 1), []
    for size, value, limit in zip(sizes, values, most, strict=True):
        count = np.zeros(capacity + 1, dtype=np.int64)
        if value > 1e-12:
            base = best.copy()
            for k in range(1, min(limit, capacity // size) + 1):
                new = np.full(capacity + 1, -1.0)
                new[k * size :] = base[: capacity + 1 - k * size] + k * value
                better = new > best + 1e-12
                best, count = np.where(better, new, best), np.where(better, k, count)
        taken.append(count)
    room, out = capacity, [0] * len(sizes)
    for i in range(len(sizes) - 1, -1, -1):
        out[i] = int(taken[i][room])
        room -= out[i] * sizes[i]
    return float(best[capacity]), out


def _configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[list[int], int]]:
    """Compositions and how many sequences of each, by column generation over the sizes; what whole
    multiples leave over is packed best-fit, longest first."""
    n = len(sizes)
    base = np.diag([float(min(capacity // s, d)) for s, d in zip(sizes, demand, strict=True)])
    need = np.asarray(demand, dtype=float)
    for _ in range(60 * n):
        price = np.linalg.solve(base.T, np.ones(n))
        value, column = _knapsack(sizes, price, demand, capacity)
        if value <= 1 + 1e-7:
            break
        amount, enter = np.linalg.solve(base, need), np.linalg.solve(base, np.asarray(column, dtype=float))
        ratio = np.where(enter > 1e-9, np.maximum(amount, 0) / np.where(enter > 1e-9, enter, 1), np.inf)
        base[:, int(np.argmin(ratio))] = column
    amount = np.linalg.solve(base, need)
    out, left = [], list(demand)
    for j in np.argsort(-amount):
        column = [int(x) for x in base[:, j]]
        times = min([int(amount[j] + 1e-6), *(left[i] // c for i, c in enumerate(column) if c)])
        if times > 0:
            out.append((column, times))
            left = [x - times * c for x, c in zip(left, column, strict=True)]
    while any(left):
        column, room = [0] * n, capacity
        for i, size in enumerate(sizes):  # sizes fall
            column[i] = min(left[i], room // size)
            room -= column[i] * size
        times = min(left[i] // c for i, c in enumerate(column) if c)
        out.append((column, times))
        left = [x - times * c for x, c in zip(left, column, strict=True)]
    return out


def _substitute(configs: list[tuple[list[int], int]], groups: list[tuple[int, int, int]], hist: np.ndarray, capacity: int) -> list[Run]:
    """Actual lengths in the places of the rounded ones, each group's longest first."""
    stock = [[(x, int(hist[x])) for x in range(top, low - 1, -1) if hist[x]] for top, low, _ in groups]
    runs = []
    for column, times in configs:
        places = [g for g, c in enumerate(column) for _ in range(c)]
        done = 0
        while done < times:
            need = {g: places.count(g) for g in set(places)}
            # As many equal sequences as the current length of each group gives; at a seam, one by one.
            whole = min([times - done, *(stock[g][0][1] // c for g, c in need.items())])
            count, lengths = max(1, whole), []
            for g in places:
                length, n = stock[g][0]
                take = count
                lengths.append(length)
                stock[g][0] = (length, n - take)
                if n == take:
                    stock[g].pop(0)
            runs.append(Run(count, sorted(lengths, reverse=True), capacity - sum(lengths)))
            done += count
    return runs


def plan(hist: np.ndarray, capacity: int = CAPACITY, groups: int = 48, shares: tuple[int, ...] = SHARES) -> list[Run]:
    """Runs of equal sequences for a histogram of lengths (index: length).  A length is large over
    ``capacity / share``; of the plans for these shares the one of fewest sequences is returned.  Its
    size and cost depend on ``capacity`` and ``groups``, not on the number of pieces."""
    made = [plan_for(hist, capacity, capacity // x, groups) for x in shares]
    return min(made, key=lambda runs: sum(r.count for r in runs))


def plan_for(hist: np.ndarray, capacity: int, small: int, groups: int) -> list[Run]:
    """The plan for one border between small and large lengths.  Full pieces are their own sequences."""
    hist = np.asarray(hist, dtype=np.int64).copy()
    runs = [Run(int(hist[capacity]), [capacity], 0)] if hist[capacity] else []
    hist[capacity] = 0
    made = _groups(hist, small, groups)
    if made:
        configs = _configurations([g[0] for g in made], [g[2] for g in made], capacity)
        runs += _substitute(configs, made, hist, capacity)
    by_room: dict[int, list[Run]] = {}
    for r in runs:
        by_room.setdefault(r.room, []).append(r)
    done = by_room.pop(0, [])
    for length in range(min(small, capacity - 1), 0, -1):
        left = int(hist[length])
        room = length
        while left:
            while room < capacity and not by_room.get(room):
                room += 1
            if room >= capacity:  # new sequences
                by_room.setdefault(capacity, []).append(Run(-(-left // (capacity // length)), [], capacity))
                room = capacity
            r = by_room[room].pop()
            fit = room // length
            full = min(r.count, left // fit)
            if full < r.count:  # one sequence takes the rest, the others stay as they are
                by_room[room].append(Run(r.count - max(full, 1), list(r.lengths), room))
                if not by_room[room][-1].count:
                    by_room[room].pop()
            fit = fit if full else left
            r = Run(full or 1, [*r.lengths, *[length] * fit], room - fit * length)
            left -= r.count * fit
            (by_room.setdefault(r.room, []) if r.room else done).append(r)
    return done + [r for rs in by_room.values() for r in rs if r.lengths]


def places(runs: list[Run]) -> dict[int, dict[str, np.ndarray]]:
    """For each length: where its pieces go, by their number.  A row covers ``per`` pieces in each of a
    run's sequences, from number ``start`` on."""
    table: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for r in runs:
        offset, at = 0, 0
        while at < len(r.lengths):
            length, per = r.lengths[at], 1
            while at + per < len(r.lengths) and r.lengths[at + per] == length:
                per += 1
            start = used.get(length, 0)
            table.setdefault(length, []).append((start, per, sequence, offset))
            used[length] = start + per * r.count
            offset, at = offset + per * length, at + per
        sequence += r.count
    return {k: dict(zip(("start", "per", "sequence", "offset"), np.asarray(v, dtype=np.int64).T, strict=True)) for k, v in table.items()}


def pack(
    df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY,
    capacity: int = CAPACITY, groups: int = 48, keep_ids: bool = False,
) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``; see the module's text.

    Texts are encoded once (the pieces are written to the shared folder); one exchange of the small
    piece rows numbers the pieces of each length.
    """
    pieces = stage(token_pieces(df, key, text, vocabulary, capacity, keep_ids), "pieces")
    hist = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in pieces.groupBy("length").count().collect():  # at most `capacity` rows
        hist[length] = n
    table = places(plan(hist, capacity, groups=groups))
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(table)

    # A length's pieces are numbered within salts, and the salts' counts added up before them.
    salts = max(8, spread(df))
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(key, "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    counts = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("length", "_salt").orderBy(key, "piece")
    numbered = (
        salted.withColumn("_number", F.row_number().over(within).cast("long"))
        .join(counts, ["length", "_salt"])
        .withColumn("_number", F.col("_number") - 1 + F.col("_before"))
    )

    @F.pandas_udf("sequence_id long, offset long")
    def place(lengths: pd.Series, numbers: pd.Series) -> pd.DataFrame:
        lengths, numbers = lengths.to_numpy(), numbers.to_numpy()
        sequence, offset = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
        for length in np.unique(lengths):
            at, rows = np.flatnonzero(lengths == length), shared.value[int(length)]
            k = np.searchsorted(rows["start"], numbers[at], side="right") - 1
            past = numbers[at] - rows["start"][k]
            sequence[at] = rows["sequence"][k] + past // rows["per"][k]
            offset[at] = rows["offset"][k] + past % rows["per"][k] * length
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    return numbered.withColumn("_place", place("length", "_number")).select(
        key, "piece", "start", "length", "ids_crc32", "_place.sequence_id", "_place.offset", *(["ids"] if keep_ids else [])
    )

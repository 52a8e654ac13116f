"""Hidden Markov language model (operator 12).

Latent states emit words; each state prefers some words and some next states.  Baum-Welch: every task runs the scaled forward and backward
recursions over its documents and hands back expected counts, Spark sums them over all partitions, and the driver turns
the sums into the next parameters.  The scaled forward recursion then gives the exact likelihood of a whole text.

Tokens are the words between ASCII white space, A-Z in lower case, then one end.  Symbols of the model: the most frequent
words, the end, and ``CLASSES`` classes of all other words by their last three bytes; a word of a class is drawn within it by its
count, the same for every state, half a count being left for the words never seen.  So the model spreads its mass over all words, like the base.

What is counted covers every training document: words by a distributed count, expected counts in every round.  What is
broadcast is bounded: ``LOCAL`` words of at most ``WORD_BYTES`` bytes with their counts, and the parameters (65,536 symbols x states).
Counts of all other words come from a join by word.  The first parameters alone are fitted on a sample (``START_TOKENS``), since
equal states would stay equal; each round after it re-estimates all of them from all training documents.

Rows: a null text is empty and has one token, the end.  Repeated rows are rows of their own, in the counts too.  Columns of ``keep`` pass
through; others are left out, so that names can't clash.  Without training documents every word is as likely as any other.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evigraph.llm._store import stage

#: Words whose counts every worker holds, and the longest of them.
LOCAL, WORD_BYTES = 1 << 18, 64
CLASSES = 512
#: Symbols of the model (codes of two bytes): words of their own, classes, the end.
SYMBOLS = 1 << 16
OWN = SYMBOLS - CLASSES - 1
END = SYMBOLS - 1
#: Tokens of a training segment: a longer document is trained on in several, each with a start of its own kind.
SEGMENT = 1024
#: Tokens that the recursions work on at a time.
GROUP = 1 << 18
START_TOKENS = 400_000
#: Least probability of a symbol in a state, so that a few steps without scaling stay within a double.
LEAST = 1e-30
_FLUSH = 300_000
_TEXT_BYTES = 4 << 20


def words_of(text: bytes | None) -> list[bytes]:
    """The words of a text in UTF-8."""
    return text.lower().split() if text else []


def class_of(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % CLASSES


def _class_column(word: str):
    raw = F.encode(F.col(word), "UTF-8")
    return F.crc32(F.when(F.octet_length(word) <= 3, raw).otherwise(F.substring(raw, F.octet_length(word) - 2, F.lit(3)))) % CLASSES


def _binary(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.large_binary()).to_pylist()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of a task's texts, handed on whenever many different words are held."""
    found: Counter[bytes] = Counter()

    def out() -> pa.RecordBatch:
        made = pa.record_batch([pa.array(found.keys(), pa.binary()).cast(pa.string()), pa.array(found.values(), pa.int64())], ["word", "n"])
        found.clear()
        return made

    for batch in batches:
        for text in _binary(batch.column(0)):
            found.update(words_of(text))
            if len(found) > _FLUSH:
                yield out()
    if found:
        yield out()


@dataclass
class Lookup:
    """What workers hold of the vocabulary; ``words`` by falling count."""

    words: list[bytes]
    counts: np.ndarray
    class_size: np.ndarray  # occurrences of the words of each class, with the mass of unseen ones
    total: float  # the same for all words together
    ends: int

    @cached_property
    def ids(self) -> dict[bytes, int]:
        return {w: i for i, w in enumerate(self.words)}

    @cached_property
    def codes(self) -> np.ndarray:
        """Symbol of each local word: its own or its class."""
        own = np.arange(min(len(self.words), OWN))
        return np.concatenate([own, [OWN + class_of(w) for w in self.words[OWN:]]]).astype(np.uint16)

    @cached_property
    def logs(self) -> np.ndarray:
        return np.log10(self.counts + 0.5)

    def __getstate__(self):
        return {k: getattr(self, k) for k in ("words", "counts", "class_size", "total", "ends")}

    def prior(self) -> np.ndarray:
        """Share of each symbol in the training tokens, smoothed."""
        size = np.full(SYMBOLS, 0.5)
        own = self.counts[:OWN]
        size[: len(own)] += own
        size[OWN:END] = self.class_size
        size[END] += self.ends
        return size / size.sum()


@dataclass
class Vocabulary:
    """All words' counts (``word``, ``n``: a staged table), and what of them is broadcast."""

    counts: DataFrame
    lookup: Lookup
    tokens: int
    distinct: int


def vocabulary(docs: DataFrame, text: str = "text") -> Vocabulary:
    """Counts of the words of ``docs`` and of their ends."""
    counted = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(_count, "word string, n long")
    counts = stage(counted.groupBy("word").agg(F.sum("n").alias("n")), "lm-counts")
    ends = docs.count()
    totals = counts.groupBy(_class_column("word").alias("c")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).toPandas()
    occurrences, different = np.zeros(CLASSES), np.zeros(CLASSES)
    occurrences[totals["c"].to_numpy(dtype=int)], different[totals["c"].to_numpy(dtype=int)] = totals["n"], totals["v"]
    tokens, distinct = int(occurrences.sum()) + ends, int(different.sum()) + bool(ends)
    # The most frequent words: whole steps of a logarithmic scale of counts, as many as stay within the bound.
    short = counts.where(F.octet_length("word") <= WORD_BYTES)
    step = F.floor(F.log2("n") * 64).cast("int")
    sizes = sorted(short.groupBy(step.alias("s")).count().collect(), key=lambda r: -r["s"])
    least, held = None, 0
    for s, n in sizes:
        if held + n > LOCAL:
            break
        least, held = s, held + n
    frequent = short.where(step >= least).select("n", F.col("word").cast("binary")).toPandas() if held else pd.DataFrame({"n": [], "word": []})
    frequent = sorted(zip(frequent["n"], map(bytes, frequent["word"]), strict=True), key=lambda x: (-x[0], x[1]))
    for n, w in frequent[:OWN]:
        occurrences[class_of(w)] -= n
        different[class_of(w)] -= 1
    lookup = Lookup([w for _, w in frequent], np.array([n for n, _ in frequent], dtype=np.int64), occurrences + 0.5 * (different + 1), tokens + 0.5 * (distinct + 1), ends)
    return Vocabulary(counts, lookup, tokens, distinct)


def _encode(batches: Iterator[pa.RecordBatch], shared, keep: int) -> Iterator[pa.RecordBatch]:
    """Per text: symbols, tokens, those known so far, logarithms of counts, and the words that no worker holds."""
    look: Lookup = shared.value
    get, codes, logs, size = look.ids.get, look.codes, look.logs, np.log10(look.class_size)
    for batch in batches:
        texts = _binary(batch.column(keep))
        lengths = np.array([len(t) if t else 0 for t in texts])
        groups = np.flatnonzero(np.diff(np.cumsum(lengths) // _TEXT_BYTES, prepend=-1))
        for a, b in zip(groups, [*groups[1:], len(texts)], strict=True):
            split = [words_of(t) for t in texts[a:b]]
            n = np.array([len(s) for s in split])
            flat = list(chain.from_iterable(split))
            del split
            owner = np.repeat(np.arange(b - a), n)
            at = np.fromiter(map(get, flat, repeat(-1)), np.int64, len(flat))
            miss = np.flatnonzero(at < 0)
            symbol = codes[at] if len(codes) else np.zeros(len(at), dtype=np.uint16)
            symbol[miss] = [OWN + class_of(flat[i]) for i in miss]
            log = np.where(at < 0, 0, logs[at] if len(logs) else 0.0)
            classed = symbol >= OWN
            within = np.where(classed, log - size[np.where(classed, symbol - OWN, 0)], 0)
            rare = Counter(zip(owner[miss].tolist(), (flat[i] for i in miss), strict=True))
            whose = np.fromiter((k[0] for k in rare), np.int64, len(rare))
            of = np.concatenate([[0], np.cumsum(np.bincount(whose, minlength=b - a))]).astype(np.int32)
            lists = pa.StructArray.from_arrays([pa.array([k[1] for k in rare], pa.binary()).cast(pa.string()), pa.array(list(rare.values()), pa.int64())], ["word", "tf"])
            out = np.full(len(flat) + b - a, END, dtype="<u2")
            out[np.arange(len(flat)) + owner] = symbol
            ends = np.concatenate([[0], np.cumsum(n + 1)]).astype(np.int32) * np.int32(2)
            coded = pa.Array.from_buffers(pa.binary(), int(b - a), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(out.tobytes())])
            sums = [np.bincount(owner, weights=w, minlength=b - a) for w in (at >= 0, log, within)]
            yield pa.RecordBatch.from_arrays(
                [c.slice(a, b - a) for c in batch.columns[:keep]]
                + [coded, pa.array(n + 1, pa.int64()), pa.array(sums[0].astype(np.int64)), pa.array(sums[1].astype(float)), pa.array(sums[2].astype(float)), pa.ListArray.from_arrays(pa.array(of), lists)],
                [*batch.schema.names[:keep], "_codes", "_tokens", "_held", "_log", "_within", "_rare"],
            )


def encode(docs: DataFrame, known: Vocabulary, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep``, a row number and the symbols of every text, as a staged table."""
    row = "_row"
    while row in keep:
        row += "_"
    slim = docs.select(*keep, F.monotonically_increasing_id().alias(row), F.col(text).cast("string").alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(known.lookup)
    n = len(keep) + 1
    made = T.StructType.fromDDL("_codes binary, _tokens long, _held long, _log double, _within double, _rare array<struct<word:string,tf:long>>")
    schema = T.StructType(slim.drop("_text").schema.fields + made.fields)
    return stage(slim.mapInArrow(lambda it: _encode(it, shared, n), schema), "lm-coded")


@dataclass
class Lockstep:
    """Sequences side by side, longest first: step t works on the first ``active[t]`` of them; ``symbols`` are by step."""

    order: np.ndarray
    active: np.ndarray
    offset: np.ndarray
    symbols: np.ndarray

    @classmethod
    def of(cls, symbols: np.ndarray, lengths: np.ndarray) -> Lockstep:
        order = np.argsort(-lengths, kind="stable")
        sizes = lengths[order]
        begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])[order]
        active = len(sizes) - np.cumsum(np.bincount(sizes, minlength=sizes[0] + 1))[: sizes[0]]
        offset = np.concatenate([[0], np.cumsum(active)])
        step = np.arange(len(symbols)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        by_step = np.empty_like(symbols)
        by_step[offset[step] + np.repeat(np.arange(len(sizes)), sizes)] = symbols[np.repeat(begin, sizes) + step]
        return cls(order, active, offset, by_step)


@dataclass
class Sums:
    """Expected counts: starts (of documents, of later segments), transitions, emissions, and log10 of the likelihood."""

    starts: np.ndarray
    moves: np.ndarray
    emits: np.ndarray
    log: float = 0.0

    @classmethod
    def empty(cls, k: int) -> Sums:
        return cls(np.zeros((2, k)), np.zeros((k, k)), np.zeros((SYMBOLS, k)))

    def rows(self) -> tuple[np.ndarray, np.ndarray]:
        """Numbered rows: the emissions that are not zero, then moves, starts, and the likelihood."""
        k = len(self.moves)
        seen = np.flatnonzero(self.emits.any(axis=1))
        last = np.zeros((1, k))
        last[0, 0] = self.log
        return np.concatenate([seen, SYMBOLS + np.arange(k + 3)]), np.concatenate([self.emits[seen], self.moves, self.starts, last])

    @classmethod
    def of_rows(cls, at: np.ndarray, values: np.ndarray) -> Sums:
        k = values.shape[1]
        full = np.zeros((SYMBOLS + k + 3, k))
        full[at] = values
        return cls(full[SYMBOLS + k : SYMBOLS + k + 2], full[SYMBOLS : SYMBOLS + k], full[:SYMBOLS], float(full[-1, 0]))


@dataclass
class Model:
    """Parameters: starts (2 x states: documents, later segments), moves (states x states), emissions (symbols x states)."""

    starts: np.ndarray
    moves: np.ndarray
    emits: np.ndarray
    logs: list[float] = field(default_factory=list)  # log10 of the training likelihood under each round's start

    @classmethod
    def random(cls, prior: np.ndarray, states: int, seed: int = 12) -> Model:
        rng = np.random.default_rng(seed)
        emits = np.maximum(prior, LEAST)[:, None] * rng.uniform(0.5, 1.5, (len(prior), states))
        moves = np.full((states, states), 0.1 / max(1, states - 1))
        np.fill_diagonal(moves, 0.9 if states > 1 else 1.0)
        return cls(np.full((2, states), 1 / states), moves, emits / emits.sum(axis=0))

    def next(self, sums: Sums, prior: np.ndarray, weight: float = 20.0) -> Model:
        """Parameters from expected counts; emissions lean on the prior with ``weight`` tokens a state."""
        starts = (sums.starts + 0.5) / (sums.starts + 0.5).sum(axis=1, keepdims=True)
        moves = (sums.moves + 0.5) / (sums.moves + 0.5).sum(axis=1, keepdims=True)
        emits = sums.emits + weight * prior[:, None]
        return Model(starts, moves, np.maximum(emits / emits.sum(axis=0), LEAST), [*self.logs, sums.log])

    def expect(self, symbols: np.ndarray, lengths: np.ndarray, later: np.ndarray, sums: Sums) -> None:
        """Add the expected counts of sequences (``later``: not a document's first segment) to ``sums``."""
        k = len(self.moves)
        side = Lockstep.of(symbols, lengths)
        n, o, later = side.active, side.offset, later[side.order].astype(int)
        moves, back = self.moves.astype(np.float32), np.ascontiguousarray(self.moves.T, dtype=np.float32)
        emit = self.emits.astype(np.float32)[side.symbols]
        alpha, scale = np.empty_like(emit), np.empty(len(emit), dtype=np.float32)
        for t in range(len(n)):
            a, b = o[t], o[t + 1]
            now = alpha[a:b]
            if t:
                np.matmul(alpha[o[t - 1] : o[t - 1] + n[t]], moves, out=now)
            else:
                now[:] = self.starts[later]
            now *= emit[a:b]
            np.sum(now, axis=1, out=scale[a:b])
            now /= scale[a:b, None]
        ahead = np.ones((n[-1], k), dtype=np.float32)
        xi = np.zeros((k, k))
        for t in range(len(n) - 1, -1, -1):
            a, b = o[t], o[t + 1]
            if t:
                into = emit[a:b]
                into *= ahead
                into /= scale[a:b, None]
                xi += alpha[o[t - 1] : o[t - 1] + n[t]].T @ into
                before = np.ones((n[t - 1], k), dtype=np.float32)
                np.matmul(into, back, out=before[: n[t]])
            alpha[a:b] *= ahead
            ahead = before if t else ahead
        for i in range(k):
            sums.emits[:, i] += np.bincount(side.symbols, weights=alpha[:, i], minlength=SYMBOLS)
        sums.moves += xi * self.moves
        for i in (0, 1):
            sums.starts[i] += alpha[: n[0]][later == i].sum(axis=0)
        sums.log += float(np.log10(scale.astype(np.float64)).sum())

    def likelihoods(self, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """log10 of the probability of each whole sequence, by the forward recursion, scaled every eighth step."""
        side = Lockstep.of(symbols, lengths)
        n, o = side.active, side.offset
        out = np.zeros(len(lengths))
        state = np.repeat(self.starts[:1], len(lengths), axis=0)
        t = 0
        while t < len(n):
            u = max(t + 1, int(np.searchsorted(o, o[t] + GROUP, side="right")) - 1)  # steps of a bounded number of tokens
            emit = self.emits[side.symbols[o[t] : o[u]]]
            for s in range(t, u):
                ended = n[s] - (n[s + 1] if s + 1 < len(n) else 0)
                if s:
                    state = state[: n[s]] @ self.moves
                state *= emit[o[s] - o[t] : o[s + 1] - o[t]]
                if ended or s % 8 == 7:
                    total = state.sum(axis=1)
                    out[: n[s]] += np.log10(total)
                    state /= total[:, None]
            t = u
        back = np.empty_like(out)
        back[side.order] = out
        return back


def _groups(lengths: np.ndarray, most: int = GROUP) -> Iterator[tuple[int, int]]:
    """Ranges of sequences with about ``most`` tokens together, one sequence at least."""
    ends, a = np.cumsum(lengths), 0
    while a < len(lengths):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, side="right")))
        yield a, b
        a = b


def segments(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the training segments of documents one after the other, and which of them are not a document's first."""
    parts = -(-lengths // SEGMENT)
    later = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    sizes = np.full(len(later), SEGMENT)
    last = np.cumsum(parts) - 1
    sizes[last] = lengths - (parts - 1) * SEGMENT
    return sizes, later > 0


def _symbols(codes) -> tuple[np.ndarray, np.ndarray]:
    codes = list(codes)
    return np.frombuffer(b"".join(codes), dtype="<u2"), np.array([len(c) // 2 for c in codes], dtype=np.int64)


def _expect_all(model: Model, symbols: np.ndarray, lengths: np.ndarray, sums: Sums) -> None:
    sizes, later = segments(lengths)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    for a, b in _groups(sizes):
        model.expect(symbols[ends[a] : ends[b]], sizes[a:b], later[a:b], sums)


def _expected(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    model: Model = shared.value
    sums, seen = Sums.empty(len(model.moves)), False
    for batch in batches:
        texts = batch.column(0).to_pylist()
        for a, b in _groups(np.array([len(t) // 2 for t in texts]), 4 * GROUP):
            _expect_all(model, *_symbols(texts[a:b]), sums)
            seen = True
    if seen:
        at, values = sums.rows()
        yield pa.record_batch([pa.array(at, pa.int64()), *[pa.array(c) for c in values.T]], ["at", *[f"e{i}" for i in range(values.shape[1])]])


def baum_welch(coded: DataFrame, known: Vocabulary, states: int = 12, rounds: int = 3, start_rounds: int = 20, seed: int = 12) -> Model:
    """Train on the symbols of all rows of ``coded``: ``rounds`` rounds over all of them, from the start that
    ``start_rounds`` rounds over a sample of about ``START_TOKENS`` tokens give (rows in hash order of their symbols, each once)."""
    prior = known.lookup.prior()
    model = Model.random(prior, states, seed)
    turn = F.xxhash64(F.lit(seed), "_codes")
    short = coded.where(F.col("_tokens").between(8, SEGMENT)).select("_codes", turn.alias("_turn")).distinct()
    sample = [r["_codes"] for r in short.orderBy("_turn", "_codes").limit(START_TOKENS // 256).collect()]
    if sample:
        symbols, lengths = _symbols(sample)
        held = max(1, int(np.searchsorted(np.cumsum(lengths), START_TOKENS)))
        symbols, lengths = symbols[: lengths[:held].sum()], lengths[:held]
        for _ in range(start_rounds):
            sums = Sums.empty(states)
            _expect_all(model, symbols, lengths, sums)
            model = model.next(sums, prior)
        model.logs.clear()
    kinds = ", ".join(f"e{i} double" for i in range(states))
    for _ in range(rounds):
        shared = coded.sparkSession.sparkContext.broadcast(model)
        parts = coded.select("_codes").mapInArrow(lambda it, shared=shared: _expected(it, shared), f"at long, {kinds}")
        summed = parts.groupBy("at").agg(*[F.sum(f"e{i}").alias(f"e{i}") for i in range(states)]).toPandas()
        shared.unpersist()
        if not len(summed):
            break
        model = model.next(Sums.of_rows(summed["at"].to_numpy(), summed.drop(columns="at").to_numpy()), prior)
    return model


def score(coded: DataFrame, model: Model, known: Vocabulary, keep: list[str]) -> DataFrame:
    """``keep``, ``n_tokens``, ``n_known`` (tokens of the training documents' vocabulary), ``train_tokens``, ``base_score``
    (log10 by counts alone) and ``score`` (log10 by the model) of every row of ``encode``'s table.

    The recursion runs where the symbols are; what is exchanged are the words that no worker holds, by word, and their sums by row."""
    look = known.lookup
    row = next(c for c in coded.columns[len(keep) :])
    shared = coded.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def forward(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for codes in batches:
            codes = list(codes)
            lengths = np.array([len(c) // 2 for c in codes])
            out, order = np.empty(len(codes)), np.argsort(-lengths, kind="stable")  # texts of like length together
            for a, b in _groups(lengths[order], 4 * GROUP):
                mine = order[a:b]
                out[mine] = shared.value.likelihoods(*_symbols([codes[i] for i in mine]))
            yield pd.Series(out)

    words = coded.select(F.col(row).alias("_r"), F.explode("_rare").alias("w")).select("_r", F.col("w.word").alias("word"), F.col("w.tf").alias("tf"))
    n = F.coalesce(F.col("n"), F.lit(0))
    met = words.join(known.counts, "word", "left").groupBy("_r").agg(
        F.sum(F.col("tf") * F.log10(n + 0.5)).alias("_more"), F.sum(F.when(n > 0, F.col("tf")).otherwise(0)).alias("_met")
    )
    made = coded.withColumn("_forward", forward.asNondeterministic()("_codes")).drop("_codes", "_rare").join(met, F.col(row) == F.col("_r"), "left")
    more, tokens = F.coalesce(F.col("_more"), F.lit(0.0)), F.col("_tokens")
    end = float(np.log10(look.ends + 0.5))
    return made.select(
        *keep, tokens.alias("n_tokens"), (F.col("_held") + F.coalesce(F.col("_met"), F.lit(0)) + int(look.ends > 0)).cast("long").alias("n_known"),
        F.lit(known.tokens).cast("long").alias("train_tokens"), (F.col("_log") + more + end - tokens * float(np.log10(look.total))).alias("base_score"),
        (F.col("_forward") + F.col("_within") + more).alias("score"),
    )

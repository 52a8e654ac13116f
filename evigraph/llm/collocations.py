"""Phrase collocations by language (operator 13).

Texts in lower case (A-Z) are cut into pieces at punctuation and line breaks, and those into words.  Phrases of two to four words that occur
``least`` times or more are scored by their weakest cut.  Three passes over the texts:

1. Sketches: every task counts its phrases by hash in arrays of counters of one byte that stay at 255; the arrays are summed by
   chunk and broadcast (68 MB in all, whatever the corpus).  A counter is an upper bound of each of its phrases.  The first pass
   counts words and pairs, the second those longer phrases of which all pairs may be frequent.
2. A scan: in each block of text the phrases that, with all their parts, may reach ``least`` are compiled into an automaton
   (pyahocorasick), each guarded by the blanks round it, and the block is scanned, overlapping matches included.  Spark sums the
   blocks' counts, and only then the threshold is applied: what the sketches let through too much falls out here.

An automaton holds only phrases of its own block, so that none grows with the corpus; a fuller sketch of a larger corpus prunes less, which
costs time and never a result.  What follows are joins of the phrases that are left.

Rows: a null text is empty, a null language is ``und``; repeated rows count each; languages without a phrase have no rows; the
scores of huge counts are exact (decimals).  A text's tokens are held while it is read.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evigraph.llm._store import spread, stage

WORDS = 4
UNKNOWN = "und"
BITS = 25
_CHUNK = 1 << 17
#: Bytes of text that are tokenised at a time, phrases that a task holds before it hands them on, and counts that it holds before it sums them.
_TEXT_BYTES, _FLUSH, _HELD = 4 << 20, 800_000, 1_000_000
_UPPER, _CUT = bytes(range(65, 91)), b".,;:!?\n\x0b\x0c\r"
#: The end of a piece: a byte that UTF-8 never has.
_END = b"\xff"
_TABLE = bytes.maketrans(_UPPER + _CUT, _UPPER.lower() + _END * len(_CUT))
#: Counters by the number of words.
Bounds = dict[int, np.ndarray]


@dataclass
class Packed:
    """Counters as they travel: packed chunks by words and place, unpacked by each worker once."""

    sizes: dict[int, int]
    chunks: dict[tuple[int, int], bytes]

    @cached_property
    def counters(self) -> Bounds:
        out = {n: np.zeros(1 << bits, dtype=np.uint8) for n, bits in self.sizes.items()}
        for (n, i), part in self.chunks.items():
            out[n][i * _CHUNK : (i + 1) * _CHUNK] = np.frombuffer(zlib.decompress(part), dtype=np.uint8)
        self.chunks = {}  # a worker's own copy: only the counters are needed from here on
        return out

    def __or__(self, other: Packed) -> Packed:
        return Packed(self.sizes | other.sizes, self.chunks | other.chunks)

    def __getstate__(self):
        return {"sizes": self.sizes, "chunks": self.chunks}


def _shift(counters: np.ndarray) -> np.uint64:
    """Of a 64-bit hash, so that it names a counter."""
    return np.uint64(65 - len(counters).bit_length())


def tokens_of(texts: list[bytes]) -> list[bytes]:
    """Words of the texts one after the other, with an end after each piece."""
    whole = (b" " + _END + b" ").join(t.translate(_TABLE).replace(_END, b" " + _END + b" ") for t in texts)
    return whole.split()


class Block:
    """Texts of one language: their words by local number (0: end of a piece), and hashes of the phrases at each place."""

    def __init__(self, lang: str, texts: list[bytes]):
        self.tokens = tokens_of(texts)
        ids: defaultdict[bytes, int] = defaultdict()
        ids.default_factory = ids.__len__
        ids[_END]
        self.at = np.fromiter(map(ids.__getitem__, self.tokens), np.int64, len(self.tokens))
        self.words = list(ids)
        seed = zlib.crc32(lang.encode())
        self._hash = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in self.words), np.uint64, len(self.words))[self.at]

    def phrases(self, bounds: Bounds, least: int, most: int = WORDS) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(words, places, hash at each): where phrases of so many words begin that, with all their parts, may reach ``least`` as far
        as ``bounds`` know."""
        inside, hashed, last = self.at > 0, self._hash, None
        for n in range(1, most + 1):
            if n > 1:
                inside = inside[:-1] & (self.at[n - 1 :] > 0)
                hashed = hashed[:-1] * np.uint64(0x9E3779B97F4A7C15) + self._hash[n - 1 :]
            if not len(inside):
                return
            may = inside if last is None else inside & last[:-1] & last[1:]
            place = np.flatnonzero(may)
            mixed = hashed[place]
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(n)
            mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
            if n in bounds:
                enough = bounds[n][mixed >> _shift(bounds[n])] >= min(least, 255)
                place, mixed = place[enough], mixed[enough]
                may = np.zeros(len(inside), dtype=bool)
                may[place] = True
            last = may
            yield n, place, mixed

    def count_into(self, tables: Bounds, bounds: Bounds, least: int) -> None:
        for n, _, hashed in self.phrases(bounds, least, max(tables)):
            if n in tables:
                at, times = np.unique(hashed >> _shift(tables[n]), return_counts=True)
                tables[n][at] = np.minimum(tables[n][at] + times, 255)

    def count(self, bounds: Bounds, least: int) -> Iterator[tuple[bytes, int]]:
        """(phrase, occurrences) of all phrases of the block that may reach ``least`` in the corpus; of the empty phrase, all words."""
        yield b"", int((self.at > 0).sum())
        width = max(1, len(self.words)).bit_length()
        found: list[bytes] = []
        rank = self.at
        for n, place, _ in self.phrases(bounds, least):
            if n == 1:
                words = np.bincount(self.at[place], minlength=len(self.words))
                yield from ((self.words[i], int(words[i])) for i in np.flatnonzero(words))
                continue
            # A phrase by the number of its first words' phrase and its last word: exact, whatever the hashes do.
            _, first, back = np.unique(rank[place] << width | self.at[place + n - 1], return_index=True, return_inverse=True)
            rank = np.full(len(self.at), -1, dtype=np.int64)
            rank[place] = back
            found += [b" ".join(self.tokens[i : i + n]) for i in place[first].tolist()]
        if found:
            machine = ahocorasick.Automaton(ahocorasick.STORE_INTS)
            for i, phrase in enumerate(found):
                machine.add_word(f" {phrase.decode(errors='surrogateescape')} ", i)
            machine.make_automaton()
            line = (b" " + b" ".join(self.tokens) + b" ").replace(_END, b"\n").decode(errors="surrogateescape")
            times = np.bincount(np.fromiter(map(itemgetter(1), machine.iter(line)), np.int64), minlength=len(found))
            yield from zip(found, times.tolist(), strict=True)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Block]]:
    """The task's texts by language, some megabytes at a time."""
    held: defaultdict[str, list[bytes]] = defaultdict(list)
    size = 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist(), strict=True):
            if text:
                held[lang].append(text)
                size += len(text)
            if size > _TEXT_BYTES:
                while held:
                    lang, texts = held.popitem()
                    yield lang, Block(lang, texts)
                size = 0
    while held:
        lang, texts = held.popitem()
        yield lang, Block(lang, texts)


def _packed(chunks: Iterator[tuple[int, int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    for n, i, counters in chunks:
        if counters.any():
            yield pa.record_batch([pa.array([n], pa.int32()), pa.array([i], pa.int32()), pa.array([zlib.compress(counters.tobytes(), 1)], pa.binary())], ["words", "chunk", "counters"])


def _sketch(batches: Iterator[pa.RecordBatch], sizes: dict[int, int], shared, least: int) -> Iterator[pa.RecordBatch]:
    tables = {n: np.zeros(1 << bits, dtype=np.uint8) for n, bits in sizes.items()}
    for _, block in _blocks(batches):
        block.count_into(tables, shared.value.counters, least)
    yield from _packed((n, i, table[i * _CHUNK : (i + 1) * _CHUNK]) for n, table in tables.items() for i in range(-(-len(table) // _CHUNK)))


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the chunks that a task gets, one part at a time."""
    total: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for *at, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            mine, at = np.frombuffer(zlib.decompress(part), dtype=np.uint8), tuple(at)
            total[at] = np.minimum(total[at].astype(np.uint16) + mine, 255).astype(np.uint8) if at in total else mine
    yield from _packed((*at, counters) for at, counters in total.items())


def sketch(texts: DataFrame, sizes: dict[int, int], bounds: Packed, least: int) -> Packed:
    """Upper bounds (at most 255) of the occurrences of phrases of (lang, text) rows by hash, in 2^sizes[n] counters for n words;
    phrases that ``bounds`` rule out are not counted."""
    shared = texts.sparkSession.sparkContext.broadcast(bounds)
    parts = texts.mapInArrow(lambda it: _sketch(it, sizes, shared, least), "words int, chunk int, counters binary")
    summed = parts.repartition("words", "chunk").mapInArrow(_summed, "words int, chunk int, counters binary")
    # Chunks of a fixed number and size come to the driver.
    out = Packed(sizes, {(row["words"], row["chunk"]): bytes(row["counters"]) for row in summed.toLocalIterator()})
    shared.unpersist()
    return out


def _scan(batches: Iterator[pa.RecordBatch], shared, least: int, parts: int) -> Iterator[pa.RecordBatch]:
    """Counts of a task's phrases, a row for each language and part (by hash of the phrase): lists of phrases and of their counts."""
    found: defaultdict[str, Counter[bytes]] = defaultdict(Counter)

    def out() -> Iterator[pa.RecordBatch]:
        while found:
            lang, counts = found.popitem()
            phrases, times = list(counts), np.fromiter(counts.values(), np.int64, len(counts))
            part = np.fromiter((zlib.crc32(p) for p in phrases), np.int64, len(phrases)) % parts
            order = np.argsort(part, kind="stable")
            sizes = np.bincount(part, minlength=parts)
            some = np.flatnonzero(sizes)
            ends = pa.array(np.concatenate([[0], np.cumsum(sizes[some])]).astype(np.int32))
            texts = pa.array(phrases, pa.binary()).cast(pa.string()).take(pa.array(order))
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(some), pa.string()), pa.array(some, pa.int32()), pa.ListArray.from_arrays(ends, texts), pa.ListArray.from_arrays(ends, pa.array(times[order]))],
                ["lang", "part", "phrases", "counts"],
            )

    for lang, block in _blocks(batches):
        mine = found[lang]
        for phrase, n in block.count(shared.value.counters, least):
            mine[phrase] += n
        if sum(map(len, found.values())) > _FLUSH:
            yield from out()
    yield from out()


def _merged(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Sums of a part's counts: the phrases that reach ``least``, and the languages' words."""
    held: list[pa.Table] = []

    def summed() -> pa.Table:
        rows = pa.concat_tables(held).group_by(["lang", "phrase"]).aggregate([("f", "sum")])
        return rows.rename_columns({"f_sum": "f"}).select(["lang", "phrase", "f"])

    for batch in batches:
        phrases = batch.column("phrases")
        langs = batch.column("lang").take(pc.list_parent_indices(phrases))
        held.append(pa.table([langs, phrases.flatten(), batch.column("counts").flatten()], names=["lang", "phrase", "f"]))
        if sum(map(len, held)) > _HELD and len(held) > 1:
            held = [summed()]
    if held:
        rows = summed()
        yield from rows.filter(pc.or_(pc.equal(rows["phrase"], ""), pc.greater_equal(rows["f"], least))).to_batches()


def phrase_counts(docs: DataFrame, least: int = 30, text: str = "text", lang: str = "lang", bits: int = BITS) -> DataFrame:
    """(lang, phrase, f): exact counts of all phrases of one to four words that occur ``least`` times or more in a
    language, and under the empty phrase the number of its words.  A staged table.

    Blocks' counts travel as lists by part; there are as many parts as the texts' bytes ask for, so that a part stays as small as the input grows."""
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text).cast("string").alias("text"))
    short = sketch(texts, {1: max(1, bits - 3), 2: bits}, Packed({}, {}), least)
    bounds = short | sketch(texts, {3: max(1, bits - 1), 4: max(1, bits - 1)}, short, least)
    shared = docs.sparkSession.sparkContext.broadcast(bounds)
    tasks = spread(texts)
    counted = texts.mapInArrow(lambda it: _scan(it, shared, least, 4 * tasks), "lang string, part int, phrases array<string>, counts array<long>")
    merged = counted.repartition(tasks, "part").mapInArrow(lambda it: _merged(it, least), "lang string, phrase string, f long")
    made = stage(merged, "phrases")
    shared.unpersist()
    return made


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, contained: int = 80, text: str = "text", lang: str = "lang", bits: int = BITS) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A phrase of ``a`` occurrences, cut in two parts of ``l`` and ``r``, scores floor(2000000 a / (l + r)); its weakest cut counts (ties: the
    first).  Phrases within a longer one that has at least ``contained`` per cent of their occurrences are left out."""
    counts = phrase_counts(docs, least, text, lang, bits)
    exact = lambda c: F.col(c).cast("decimal(20,0)")
    phrases = counts.where("phrase <> ''").withColumn("w", F.split("phrase", " ", -1))
    longer = phrases.where(F.size("w") > 1).withColumnRenamed("f", "a")
    part = lambda start, size: F.array_join(F.slice("w", start, size), " ")

    cuts = longer.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("head"), part(F.col("k") + 1, F.size("w") - F.col("k")).alias("tail"))
    heads = counts.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    tails = counts.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r"))
    score = F.expr("CAST(2000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(20,0)) div (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))")
    weakest = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))

    inner = longer.where(F.size("w") > 2).select("lang", "a", "w", F.explode(F.sequence(F.lit(2), F.size("w") - 1)).alias("size"))
    inner = inner.select("lang", "a", "w", "size", F.explode(F.expr("sequence(1, size(w) - size + 1)")).alias("start"))
    over = inner.groupBy("lang", part(F.col("start"), F.col("size")).alias("phrase")).agg(F.max("a").alias("over"))
    kept = weakest.join(over, ["lang", "phrase"], "left").where(F.col("over").isNull() | (100 * exact("over") < contained * exact("a")))

    by = F.col("cut.score").desc(), F.col("a").desc(), F.col("phrase")
    # A language of very many phrases: the first of each part, then those of all parts.
    part_ = Window.partitionBy("lang", "part").orderBy(*by)
    first = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64))).withColumn("rank", F.row_number().over(part_)).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*by))).where(F.col("rank") <= top)
    sizes = counts.where("phrase = ''").select("lang", F.col("f").alias("n"))
    return ranked.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score")

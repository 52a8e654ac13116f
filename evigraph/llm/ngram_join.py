"""Exact n-gram Jaccard self-join with set-relation skipping (operator 6).

Documents whose sets of distinct word n-grams have a Jaccard similarity of at least a threshold are
linked; the result is each document's set size and component.  Every step covers all documents and no link is lost.

1. Equal sets are one node (documents hang on their set's 64-bit signature), so exact copies cost nothing further.
2. All n-grams stand in one global order: by how often they were counted (each batch of documents reports
   those it holds three times or more; the counts are added up), rarest first, ties by hash.  The order decides
   cost only.  In that order a set's first ``n - ceil(t n) + 1`` n-grams must meet those of every partner, so
   they are its entries in the index lists (prefix filter).
3. Index-level skipping: each list is ordered by set size and cut into blocks which know their sizes and least
   position; an entry is dropped if size and position rule out every block of its list.  What is left
   of a list gathers round one of its nodes, the pivot; entries of the same pivot are one group.
4. Answer-level skipping: within a group each set is described by what it shares with the pivot.  A pair's overlap is
   its overlap inside the pivot plus that outside; pairs that the pivot's part with the outside's size
   rules out, or that are already connected, need nothing more, the others are completed incrementally.
   Large groups are cut into blocks, each with the pivot: that is a linear number of rows, and a group of near copies is one
   component after it.  Only where a large group still holds several components are pairs of its blocks compared, each pair a row
   group of its own, and none whose sets are all of one component.  A group returns one edge per connected set, never its pairs.
5. Components over those edges.

Two sets that are linked share an entry, so they meet in its pivot's group, where they are compared exactly
on 64-bit hashes of their n-grams.

Rows: null text, and text without words, has an empty set: it is linked with nothing (its component is itself).
Rows that repeat an id are rows of the sets of their texts.  A row without an id keeps its size, takes no
part in links and has no component.  An empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.llm._store import spread, stage
from evigraph.llm._worker import ENTRY, Memo, held
from evigraph.llm.components import components

#: N-grams that are counted together, and the least count that a batch reports.
BATCH, REPORT = 2_000_000, 3
#: The most frequent n-grams that the order knows by count; the others come first.  It bounds the broadcast.
FREQUENT = 200_000
#: Sets in a block of a group, and entries in a block of a list.
GROUP_BLOCK, LIST_BLOCK = 1024, 64
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def shingles(text: str | None, n: int = 5) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct n-grams of words (A-Z lower-cased, split at ASCII white
    space); fewer words than ``n`` make one n-gram."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, dtype=np.uint64)
    known = held("words", Memo)
    try:
        values = [known[w] for w in words]
    except KeyError:
        new = {w: xxhash.xxh3_64_intdigest(w) for w in words if w not in known}
        known.room(sum(map(len, new)) + ENTRY * len(new))
        values = [known[w] if w in known else new[w] if w in new else xxhash.xxh3_64_intdigest(w) for w in words]
        known.update(new)
    codes = np.array(values, dtype=np.uint64)
    size = min(n, len(codes))
    h = codes[: len(codes) - size + 1].copy()
    for i in range(1, size):
        h = h * _STEP + codes[i : len(codes) - size + 1 + i]
    return np.unique(_mixed(h + np.uint64(size)))


def signature(found: np.ndarray) -> int:
    """A set's 64 bits, as a signed long."""
    return xxhash.xxh3_64_intdigest(found.tobytes()) - (1 << 63)


def need(x, y, percent: int):
    """The least overlap of sets of sizes x and y whose similarity is ``percent`` hundredths."""
    return -(-percent * (x + y) // (100 + percent))


def prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


# --- Pass 1: signatures of all sets, counts of repeated n-grams ------------------------------------------


def _survey(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []
    n_held = 0

    def repeated():
        values, counts = np.unique(np.concatenate(held), return_counts=True)
        keep = counts >= REPORT
        none = pa.nulls(int(keep.sum()), pa.int64())
        return pa.RecordBatch.from_arrays([none, pa.array(counts[keep].astype(np.int64)), pa.array(values[keep].view(np.int64)), pa.array(np.ones(int(keep.sum()), dtype=bool))], names=["key", "n", "hash", "counted"])

    for batch in batches:
        keys, texts = batch.column(0), batch.column(1)
        sizes, signs = np.empty(len(batch), dtype=np.int64), np.empty(len(batch), dtype=np.int64)
        for i, text in enumerate(texts):
            s = shingles(text.as_py(), n)
            sizes[i] = len(s)
            signs[i] = signature(s)
            held.append(s)
            n_held += len(s)
            if n_held >= BATCH:
                yield repeated()
                held.clear()
                n_held = 0
        yield pa.RecordBatch.from_arrays([keys.cast(pa.int64()), pa.array(sizes), pa.array(signs), pa.array(np.zeros(len(batch), dtype=bool))], names=["key", "n", "hash", "counted"])
    if held:
        yield repeated()


# --- Pass 2: entries of the index lists -------------------------------------------------------------------


def _ordered(s: np.ndarray, frequent: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The n-grams of a set in the global order."""
    if not len(frequent):
        return s
    at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
    rank = np.where(frequent[at] == s, counts[at], 0)
    return s[np.argsort(rank, kind="stable")]  # s is sorted: ties by hash


def _entries(batches: Iterator[pa.RecordBatch], n: int, percent: int, frequent: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()  # equal sets of a task are one node already here
    for batch in batches:
        found: list[tuple[np.ndarray, int, int]] = []
        for text in batch.column(0):
            s = shingles(text.as_py(), n)
            node = signature(s)
            if len(s) and node not in seen:
                seen.add(node)
                found.append((_ordered(s, frequent, counts)[: prefix_size(len(s), percent)], node, len(s)))
            if len(seen) > 1_000_000:
                seen.clear()
        for a in range(0, len(found), 1000):
            part = found[a : a + 1000]
            sizes = np.array([len(p[0]) for p in part])
            key = np.concatenate([p[0] for p in part]).view(np.int64)
            node = np.repeat(np.array([p[1] for p in part], dtype=np.int64), sizes)
            place = np.arange(len(key)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            shape = (np.repeat(np.array([p[2] for p in part], dtype=np.int64), sizes) << 32) | place
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(node), pa.array(shape)], names=["key", "node", "shape"])


# --- Pass 3: index lists to groups -------------------------------------------------------------------------


def _alive(size: np.ndarray, place: np.ndarray, percent: int) -> np.ndarray:
    """Which entries of a list (ordered by size) have a possible partner in it.  A short list is looked
    at pair by pair, a long one block by block."""
    left = size - place  # n-grams from the entry on: a pair that first meets here shares no more
    if len(size) <= LIST_BLOCK:
        fits = np.minimum(left[:, None], left[None, :]) >= need(size[:, None], size[None, :], percent)
        np.fill_diagonal(fits, False)
        return fits.any(axis=1)
    starts = np.arange(0, len(size), LIST_BLOCK)
    least, most = size[starts], np.maximum.reduceat(size, starts)
    room = np.maximum.reduceat(left, starts)
    lowest = -(-percent * size // 100)  # of a partner's size
    out = np.zeros(len(size), dtype=bool)
    for b in range(len(starts)):
        in_reach = (most[b] >= lowest) & (percent * least[b] <= 100 * size)
        out |= in_reach & (np.minimum(left, room[b]) >= need(size, np.maximum(least[b], lowest), percent))
    return out


def _groups(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """(pivot, node) of the lists of a sorted partition; a list may span batches, whose arrays are put together once."""
    rest: list[list[np.ndarray]] = []

    def lists(key: np.ndarray, node: np.ndarray, shape: np.ndarray):
        first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (node[1:] != node[:-1])]))
        key, node, shape = key[first], node[first], shape[first]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.concatenate([starts, [len(key)]]))
        size, left = shape >> 32, (shape >> 32) - (shape & 0xFFFFFFFF)
        two = starts[sizes == 2]  # the bulk of the lists, all at once
        two = two[np.minimum(left[two], left[two + 1]) >= need(size[two], size[two + 1], percent)]
        low = np.minimum(node[two], node[two + 1])
        pivots, nodes = [low, low], [node[two], node[two + 1]]
        for a, m in zip(starts[sizes > 2], sizes[sizes > 2], strict=True):
            order = a + np.argsort(size[a : a + m], kind="stable")
            own = node[order[_alive(size[order], size[order] - left[order], percent)]]
            if len(own) > 1:
                pivots.append(np.full(len(own), own.min()))
                nodes.append(own)
        if sum(map(len, pivots)):
            both = np.unique(np.stack([np.concatenate(pivots), np.concatenate(nodes)]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["pivot", "node"])

    for batch in batches:
        part = [batch.column(i).to_numpy() for i in range(3)]
        if not len(part[0]):
            continue
        last = int(np.searchsorted(part[0], part[0][-1]))
        if last or (rest and rest[-1][0][-1] != part[0][0]):  # another list begins in this batch
            whole = [*rest, [x[:last] for x in part]]
            yield from lists(*(np.concatenate([x[i] for x in whole]) for i in range(3)))
            rest = [[x[last:] for x in part]]
        else:
            rest.append(part)
    if rest:
        yield from lists(*(np.concatenate([x[i] for x in rest]) for i in range(3)))


# --- Pass 4: exact comparison inside groups ----------------------------------------------------------------


def _linked(sets: list[np.ndarray], pivot: np.ndarray, percent: int) -> np.ndarray:
    """For each set the lowest index it is connected to by links among ``sets``."""
    m = len(sets)
    size = np.array([len(s) for s in sets], dtype=np.int64)
    owner, values = np.repeat(np.arange(m), size), np.concatenate(sets)
    at = np.minimum(np.searchsorted(pivot, values), len(pivot) - 1)
    inside = pivot[at] == values
    asked = need(size[:, None], size[None, :], percent)
    overlap = _overlaps(owner[inside], at[inside], m)
    outside = size - overlap.diagonal()  # n-grams that the pivot lacks
    sure = overlap >= asked
    label = _closed(sure)
    open_ = ~sure & (overlap + np.minimum(outside[:, None], outside[None, :]) >= asked) & (label[:, None] != label[None, :])
    if open_.any():
        rows = np.flatnonzero(open_.any(axis=1))
        new = np.full(m, -1)
        new[rows] = np.arange(len(rows))
        use = ~inside & (new[owner] >= 0)
        _, column, times = np.unique(values[use], return_inverse=True, return_counts=True)
        keep = times[column] > 1
        extra = _overlaps(new[owner[use]][keep], np.unique(column[keep], return_inverse=True)[1], len(rows))
        here = np.ix_(rows, rows)
        sure[here] |= overlap[here] + extra >= asked[here]
        label = _closed(sure)
    return label


def _overlaps(row: np.ndarray, column: np.ndarray, m: int, width: int = 1024) -> np.ndarray:
    """Common columns of each two of ``m`` rows, a bounded number of columns at a time."""
    total = np.zeros((m, m), dtype=np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        low, high = np.searchsorted(column, [a, a + width])
        part = np.zeros((m, min(width, int(column[-1]) + 1 - a)), dtype=np.float32)
        part[row[low:high], column[low:high] - a] = 1
        total += part @ part.T
    return np.rint(total).astype(np.int64)


def _closed(links: np.ndarray) -> np.ndarray:
    """Lowest index connected to each index of a symmetric boolean matrix."""
    label = np.full(len(links), -1)
    for i in range(len(links)):
        if label[i] < 0:
            front = np.zeros(len(links), dtype=bool)
            front[i] = True
            while front.any():
                label[front] = i
                front = links[front].any(axis=0) & (label < 0)
    return label


def _compare(batches: Iterator[pd.DataFrame], n: int, percent: int) -> Iterator[pd.DataFrame]:
    """Edges of the groups of a sorted partition (columns group, later, node, text)."""
    group, nodes, sets = None, [], []

    def edges():
        out = []
        if len(nodes) > 1:
            label = _linked(sets, sets[0], percent)
            out = [(nodes[i], nodes[j]) for i, j in enumerate(label) if i != j]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    for batch in batches:
        out = []
        for g, node, text in zip(batch["group"], batch["node"], batch["text"], strict=True):
            if g != group:
                out.append(edges())
                group, nodes, sets = g, [], []
            found = shingles(text, n)
            if signature(found) == node and node not in nodes[-1:]:  # else another row of that key
                nodes.append(node)
                sets.append(found)
        yield pd.concat(out) if out else pd.DataFrame({"a": [], "b": []}, dtype="int64")
    yield edges()


def similarity_components(
    df: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, percent: int = 75
) -> DataFrame:
    """key, n_shingles, component_id (smallest key reachable by links, itself included)."""
    spark = df.sparkSession
    docs = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    parts = spread(docs)
    surveyed = stage(docs.mapInArrow(lambda it: _survey(it, n), "key long, n long, hash long, counted boolean"), "sets")
    sets = surveyed.where("not counted").select("key", "n", F.col("hash").alias("node"))
    top = surveyed.where("counted").groupBy("hash").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "hash").limit(FREQUENT).toPandas()
    frequent, counts = top["hash"].to_numpy().view(np.uint64), top["n"].to_numpy()
    order = np.argsort(frequent)
    shared = spark.sparkContext.broadcast((frequent[order], counts[order]))

    entries = docs.where("key is not null").select("text").mapInArrow(lambda it: _entries(it, n, percent, *shared.value), "key long, node long, shape long")
    lists = entries.repartition(parts, "key").sortWithinPartitions("key", "node")
    members = stage(lists.mapInArrow(lambda it: _groups(it, percent), "pivot long, node long").distinct(), "groups")

    first = sets.where("n > 0 and key is not null").groupBy("node").agg(F.min("key").alias("key"))

    def compared(rows: DataFrame, name: str) -> DataFrame:
        """Edges of row groups (group, later, node), the texts joined to them."""
        placed = rows.join(first, "node").join(docs, "key").select("group", "later", "node", "text")
        grouped = placed.repartition(parts, "group").sortWithinPartitions("group", "later", "node")
        return stage(grouped.mapInPandas(lambda it: _compare(it, n, percent), "a long, b long"), name)

    # Groups of one block, and the blocks of large groups with the pivot in each.
    blocks = members.groupBy("pivot").agg(F.ceil(F.count("*") / GROUP_BLOCK).cast("int").alias("blocks")).where("blocks > 1")
    cut = members.join(blocks, "pivot", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    cut = cut.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    lead = blocks.select("pivot", F.col("pivot").alias("node"), "blocks", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("own"))
    alone = cut.unionByName(lead.where(F.pmod(F.xxhash64("node"), F.col("blocks")) != F.col("own")))
    edges = compared(alone.select("node", F.xxhash64("pivot", "own").alias("group"), (F.col("node") != F.col("pivot")).alias("later")), "links")
    label = components(edges)

    # Pairs of the blocks of large groups that are not one component yet.
    known = cut.where("blocks > 1").select("pivot", "node", "own").join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    spans = known.groupBy("pivot", "own").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    open_ = spans.groupBy("pivot").agg(F.min("low").alias("all_low"), F.max("high").alias("all_high")).where("all_low < all_high").select("pivot")
    spans = spans.join(open_, "pivot", "left_semi")
    other = spans.select("pivot", F.col("own").alias("other"), F.col("low").alias("other_low"), F.col("high").alias("other_high"))
    pairs = spans.join(other, "pivot").where("own < other and not (low = high and other_low = other_high and low = other_low)")
    ends = pairs.select("pivot", F.xxhash64("pivot", "own", "other").alias("group"), F.explode(F.array("own", "other")).alias("own"))
    ends = stage(ends, "block-pairs")
    if not ends.isEmpty():
        more = compared(known.join(ends, ["pivot", "own"]).select("node", "group", (F.col("node") != F.col("pivot")).alias("later")), "links")
        label = components(edges.unionByName(more))
    named = label.join(first, "node").groupBy("label").agg(F.min("key").alias("component_id"))
    named = label.join(named, "label").select("node", "component_id")
    own_copy = first.select("node", F.col("key").alias("own_copy"))
    return (
        sets.join(named, "node", "left")
        .join(own_copy, "node", "left")
        .select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("key").isNotNull() & (F.col("n") > 0), F.coalesce("component_id", "own_copy")).otherwise(F.col("key")).alias("component_id"))
    )

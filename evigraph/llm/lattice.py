"""Embedding near-duplicates by E8 lattice hashing (operator 10).

Random projections of unit vectors are decoded, eight coordinates at a time, to the nearest points of the E8
lattice; the points of a table make a vector's home cell there.  Besides it a vector visits the
neighbouring cells that it is nearest to, one lattice point exchanged for the next nearest.  Two vectors
meet in a cell if it is the home of one of them; what meets is verified by cosine in double precision.

Only vectors of equal label are compared.  Equal vectors of a label are one node with a count, so that
copies cost nothing further.  Cells in which nothing meets are dropped while rows are still keys; large
cells are cut into blocks and compared block by block.  A pair that meets in several cells counts in the
first of them (every vector carries its cells), so links are counted, not listed: a cell returns its members'
numbers of links and one edge per connected member.

Rows: vectors that are null, empty, zero or hold null or non-finite components, and rows without a label,
are linked with nothing.  Vectors of different lengths are never linked.  Repeated ids are rows of their
own, with the same id.  An empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.llm._store import spread, stage
from evigraph.llm.components import components

SCALE = 0.5
#: Tables, and lattice points of a home cell: the same for every size of the input.  In 64 dimensions a pair of cosine
#: 0.93 meets in one of the cells with probability 0.995, one of 0.94 with 0.998.
TABLES, POINTS = 12, 2
#: Nodes in a block of a cell.
CELL_BLOCK = 1024


def _d8(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest points of D8 (whole coordinates, even sum) and the next nearest of their kind."""
    near = np.rint(x)
    off = x - near
    order = np.argsort(-np.abs(off), axis=1)
    rows = np.arange(len(x))
    step = np.where(off >= 0, 1.0, -1.0)

    def moved(points, *places):
        out = points.copy()
        for p in places:
            out[rows, order[:, p]] += step[rows, order[:, p]]
        return out

    odd = (near.sum(axis=1) % 2 != 0)[:, None]
    return np.where(odd, moved(near, 0), near), np.where(odd, moved(near, 1), moved(near, 0, 1))


def e8(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest point, a next nearest point and the loss of taking it, for rows of eight coordinates.
    Points are doubled, which makes them whole."""
    found = []
    for shift in (0.0, 0.5):
        for points in _d8(x - shift):
            found.append(points + shift)
    points = np.stack(found)
    far = ((points - x) ** 2).sum(axis=2)
    order = np.argsort(far, axis=0, kind="stable")
    rows = np.arange(len(x))
    return 2 * points[order[0], rows], 2 * points[order[1], rows], far[order[1], rows] - far[order[0], rows]


def _code(points: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """64 bits for each row of whole numbers."""
    h = (points.astype(np.int64).view(np.uint64) * salt).sum(axis=1, dtype=np.uint64)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def cells(x: np.ndarray, tables: int, blocks: int, scale: float = SCALE, seed: int = 8) -> np.ndarray:
    """Cells of unit vectors: (rows, tables, 2 + blocks); the home, then the neighbours: one lattice point
    exchanged, the cheapest first, then all."""
    rng = np.random.default_rng(seed)
    n, dims = x.shape
    salts = rng.integers(1, 1 << 62, size=(blocks, 8), dtype=np.uint64) | np.uint64(1)
    rows, out = np.arange(n), np.empty((n, tables, 2 + blocks), dtype=np.int64)
    for t in range(tables):
        home, swaps, losses = np.full(n, t, dtype=np.uint64), [], []
        for b in range(blocks):
            near, next_, loss = e8(x @ rng.standard_normal((dims, 8)) * scale)
            turn = np.uint64(2 * b + 1)
            here = _code(near, salts[b]) * turn
            home = home + here
            swaps.append(_code(next_, salts[b]) * turn - here)
            losses.append(loss)
        order = np.argsort(np.stack(losses), axis=0, kind="stable")
        swaps = np.stack(swaps)
        out[:, t, 0] = home.view(np.int64)
        for p in range(blocks):
            out[:, t, 1 + p] = (home + swaps[order[p], rows]).view(np.int64)
        out[:, t, 1 + blocks] = (home + swaps.sum(axis=0, dtype=np.uint64)).view(np.int64)
    return out


def _unit(vectors: list) -> np.ndarray:
    x = np.asarray([np.asarray(v, dtype=np.float64) for v in vectors])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _first_meeting(own: np.ndarray, other: np.ndarray, table: int, cell: int) -> np.ndarray:
    """Whether pairs (their cells row by row) that meet in this cell meet in none before it, cells being
    ordered by table and code."""
    before = np.zeros(len(own), dtype=bool)
    for t in range(table + 1):
        for x, y in ((own, other), (other, own)):
            met = x[:, t, :1] == y[:, t, :]
            if t == table:
                met &= x[:, t, :1] < cell
            before |= met.any(axis=1)
    return ~before


def _links(group: pd.DataFrame, tables: int, width: int, cosine: float) -> pd.DataFrame:
    """Weighted links of each member of a cell (or of two of its blocks), and the least node it is connected to."""
    x, home = _unit(list(group["vector"])), group["home"].to_numpy()
    code = np.asarray(list(group["cells"]), dtype=np.int64).reshape(len(group), tables, width)
    node, weight, block = (group[c].to_numpy() for c in ("node", "copies", "own"))
    table, cell = int(group["t"].iloc[0]), int(group["cell"].iloc[0])
    near = x @ x.T >= cosine
    near &= home[:, None] | home[None, :]
    if group["cross"].iloc[0]:  # within a block its own group counts
        near &= block[:, None] != block[None, :]
    i, j = np.nonzero(np.triu(near, 1))
    links, low = np.zeros(len(group), dtype=np.int64), node.copy()
    step = (48 << 17) // (tables * width)  # pairs at a time: their cells are held in memory
    for a in range(0, len(i), step):
        p, q = i[a : a + step], j[a : a + step]
        new = _first_meeting(code[p], code[q], table, cell)
        np.add.at(links, p[new], weight[q[new]])
        np.add.at(links, q[new], weight[p[new]])
    while len(i):
        least = low.copy()
        np.minimum.at(least, i, low[j])
        np.minimum.at(least, j, low[i])
        if (least == low).all():
            break
        low = least
    keep = (links > 0) | (low != node)
    return pd.DataFrame({"node": node[keep], "links": links[keep], "low": low[keep]})


def _compare(batches: Iterator[pd.DataFrame], tables: int, width: int, cosine: float) -> Iterator[pd.DataFrame]:
    """The groups of a partition sorted by group; a group may span batches."""
    rest: pd.DataFrame | None = None
    for batch in batches:
        rest = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        starts = np.flatnonzero(np.diff(rest["group"].to_numpy(), prepend=rest["group"].iloc[0] - 1 if len(rest) else 0))
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            yield _links(rest.iloc[a:b], tables, width, cosine)
        rest = rest.iloc[starts[-1] :] if len(starts) else None
    if rest is not None and len(rest):
        yield _links(rest, tables, width, cosine)


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = 0.93, tables: int = TABLES, points: int = POINTS) -> DataFrame:
    """key, n_links (other vectors linked directly), component_id (smallest key reachable by links, itself
    included) and kept (key = component_id), for every row.  More ``points`` a cell make unrelated vectors meet more rarely and
    near ones too; more ``tables`` make up for that."""
    spark = df.sparkSession
    parts = spread(df)
    v = F.col(vector).cast("array<double>")
    inner = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = F.col(label).isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.coalesce(inner, F.lit(False)) & F.exists(v, lambda x: x != 0)
    rows = df.select(F.col(key).cast("long").alias("key"), F.when(usable, F.xxhash64(F.col(label), v)).alias("node"), F.col(label).alias("label"), v.alias("vector"))
    nodes = rows.where("node is not null").groupBy("node").agg(F.count("*").alias("copies"), F.min("key").alias("key"), F.first("label").alias("label"), F.first("vector").alias("vector"))
    width = 2 + points

    @F.pandas_udf("array<long>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vectors in batches:
            out: list = [None] * len(vectors)
            sizes = np.array([len(x) for x in vectors])
            for size in np.unique(sizes):  # a table's projections depend on the vectors' length
                at = np.flatnonzero(sizes == size)
                found = cells(_unit([vectors.iloc[i] for i in at]), tables, points)
                for i, c in zip(at, found.reshape(len(at), -1), strict=True):
                    out[i] = c
            yield pd.Series(out)

    nodes = stage(nodes.withColumn("cells", find("vector")), "lattice")
    visits = nodes.select("node", F.col("label").alias("of"), F.size("vector").alias("dims"), F.posexplode("cells").alias("k", "cell"))
    visits = visits.select("node", F.floor(F.col("k") / width).cast("int").alias("t"), (F.col("k") % width == 0).alias("home"), "cell", F.xxhash64("of", "dims", F.floor(F.col("k") / width), "cell").alias("place"))
    meeting = visits.groupBy("place").agg(F.count("*").alias("n"), F.max("home").alias("lived")).where("n > 1 and lived").select("place", F.ceil(F.col("n") / CELL_BLOCK).cast("int").alias("blocks"))
    met = visits.join(meeting, "place").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.withColumn("group", F.xxhash64("place", F.least("own", "other"), F.greatest("own", "other")))
    placed = met.select("group", "node", "own", (F.col("own") != F.col("other")).alias("cross"), "home", "t", "cell").join(nodes.select("node", "copies", "vector", "cells"), "node")
    grouped = placed.repartition(parts, "group").sortWithinPartitions("group")
    found = stage(grouped.mapInPandas(lambda it: _compare(it, tables, width, cosine), "node long, links long, low long"), "links")

    label_of = components(found.select(F.col("node").alias("a"), F.col("low").alias("b")))
    first = nodes.select("node", "copies", F.col("key").alias("first"))
    named = label_of.join(first, "node").groupBy("label").agg(F.min("first").alias("component_id"))
    named = label_of.join(named, "label").select("node", "component_id")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    of_node = first.join(counts, "node", "left").join(named, "node", "left").select("node", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "first").alias("component_id"))
    out = rows.select("key", "node").join(of_node, "node", "left")
    component = F.coalesce("component_id", "key")
    return out.select(F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("key") == component, F.lit(True)).alias("kept"))

"""Image copies by local descriptors (operator 4): cropped, rescaled or edited copies of grey images.

Images are binary columns in portable grey-map form (``P5``, 8 bits).  On every level of a pyramid, in every cell of it, the
strongest corners (of the structure tensor) are described by 256 comparisons of smoothed pixels, turned by the patch's
orientation (its intensity centroid); large images have more cells, and so more corners.  Four 32-bit parts of a descriptor
are keys of four tables (Hamming tables): in a key's list two corners are the same if sketches of every second bit differ by at
most ``CLOSE``.  Two images that share ``SHARED`` corners are verified by geometric consensus: the matches (mutually nearest by
Hamming distance) must agree on one scale, turn and shift, read in either direction.

1. Groups are found through heads: of each list the members that are like its first image are paired with it, each image
   goes with the head that shares most corners with it, and what is verified is joined.  Two such rounds, over two tables each
   and with other heads, decide nothing but cost.
2. Then all pairs of images of different components that share enough corners are verified, over all tables.  A list
   within one component is done with; long lists are cut into blocks, and each pair of blocks is a row group of its own.
   No such pair is passed over, so the components are those of all pairs.

Equal images are one node.

Rows: a null image, or one that can't be read or is too small for a patch, has no corners and is a component of its own;
repeated ids are rows of their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.llm._store import discard, spread, stage
from evigraph.llm.components import components

#: Corners of a cell on the first three levels of the pyramid, and on the others; a cell's side in pixels of the level.
CORNERS, FURTHER, CELL = (20, 14, 8), 8, 80
#: A level's least side.
LEAST = 40
RADIUS = 7
TURNS = 36
BITS, PARTS = 256, 8
#: The parts that are keys, by how many bits the sketches of one corner may differ, and a sketch's bits (two words).
TABLES, CLOSE, SKETCH = (0, 2, 4, 6), 8, 128
#: Shared corners that make a candidate, Hamming distance of a match, agreeing matches that make a link.
SHARED, NEAR, AGREE = 3, 56, 6
#: Images in a block of a key's list; pairs that a task makes at a time; pixels that are described at a time.
LIST_BLOCK, PAIRS, PIXELS = 1024, 1 << 20, 1 << 19
_RECORD = np.dtype([("x", "<f4"), ("y", "<f4"), ("scale", "<f4"), ("angle", "<f4"), ("bits", "u1", BITS // 8)])


def read_pgm(data: bytes | None) -> np.ndarray | None:
    """Pixels of a binary grey-map, or None."""
    head = re.match(rb"P5\s+(?:#[^\n]*\n\s*)*(\d+)\s+(\d+)\s+(\d+)\s", data or b"")
    if not head:
        return None
    width, height, most = map(int, head.groups())
    if not 0 < most < 256 or len(data) - head.end() < width * height:
        return None
    return np.frombuffer(data, dtype=np.uint8, count=width * height, offset=head.end()).reshape(height, width)


def write_pgm(pixels: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % pixels.shape[::-1] + np.ascontiguousarray(pixels, dtype=np.uint8).tobytes()


def _box(x: np.ndarray, r: int) -> np.ndarray:
    """Mean over windows of side 2r+1, of the images' own size."""
    exact = np.float64 if x.shape[1] * x.shape[2] > 1 << 14 else x.dtype  # sums over large images outgrow 24 bits
    pad = np.pad(x, ((0, 0), (r + 1, r), (r + 1, r)), mode="edge").cumsum(axis=1, dtype=exact).cumsum(axis=2)
    n = 2 * r + 1
    return ((pad[:, n:, n:] - pad[:, :-n, n:] - pad[:, n:, :-n] + pad[:, :-n, :-n]) / (n * n)).astype(x.dtype, copy=False)


def _resized(x: np.ndarray, scale: float) -> np.ndarray:
    if scale == 1:
        return x
    h, w = int(x.shape[1] * scale), int(x.shape[2] * scale)
    if h < 2 or w < 2:
        return x[:, :h, :w]
    x = _box(x, max(1, int(0.5 / scale)))
    ys, xs = (np.arange(h) + 0.5) / scale - 0.5, (np.arange(w) + 0.5) / scale - 0.5
    y0, x0 = np.clip(ys.astype(int), 0, x.shape[1] - 2), np.clip(xs.astype(int), 0, x.shape[2] - 2)
    fy, fx = (ys - y0)[None, :, None], (xs - x0)[None, None, :]
    top = x[:, y0][:, :, x0] * (1 - fx) + x[:, y0][:, :, x0 + 1] * fx
    low = x[:, y0 + 1][:, :, x0] * (1 - fx) + x[:, y0 + 1][:, :, x0 + 1] * fx
    return top * (1 - fy) + low * fy


def _tests() -> np.ndarray:
    """Offsets of the compared pixels for each turn: (turns, bits, 4)."""
    rng = np.random.default_rng(4)
    points = rng.normal(0, RADIUS / 2.2, size=(BITS, 2, 2))
    norm = np.linalg.norm(points, axis=2, keepdims=True)
    points *= np.minimum(1, RADIUS / np.maximum(norm, 1e-9))
    angle = 2 * np.pi * np.arange(TURNS) / TURNS
    turn = np.stack([np.stack([np.cos(angle), -np.sin(angle)], 1), np.stack([np.sin(angle), np.cos(angle)], 1)], 1)
    return np.rint(np.einsum("tij,bkj->tbki", turn, points)).astype(np.int64).reshape(TURNS, BITS, 4)


_TESTS = _tests()
_DISC = np.array([(dy, dx) for dy in range(-RADIUS, RADIUS + 1) for dx in range(-RADIUS, RADIUS + 1) if dy * dy + dx * dx <= RADIUS * RADIUS])


def levels(height: int, width: int) -> list[tuple[float, int]]:
    """(scale, corners of a cell) of the pyramid: 1, 3/4, 1/2, 3/8, 1/4 and so on."""
    out = []
    for i in range(2 * 16):
        scale = (1.0, 0.75)[i % 2] / (1 << (i // 2))
        if i >= len(CORNERS) and min(height, width) * scale < LEAST:
            break
        out.append((scale, CORNERS[i] if i < len(CORNERS) else FURTHER))
    return out


def _strongest(value: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(image, y, x) of the largest values over 0 of each cell."""
    found = []
    n, h, w = value.shape
    for y in range(0, h, CELL):
        for x in range(0, w, CELL):
            cell = value[:, y : y + CELL, x : x + CELL]
            flat = cell.reshape(n, -1)
            best = np.argsort(-flat, axis=1, kind="stable")[:, : min(most, flat.shape[1])]
            image, column = np.nonzero(np.take_along_axis(flat, best, axis=1) > 0)
            at = best[image, column]
            found.append((image, y + at // cell.shape[2], x + at % cell.shape[2]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def corners(images: np.ndarray) -> list[np.ndarray]:
    """Corner records of a stack of images of one size."""
    found: list[list[np.ndarray]] = [[] for _ in images]
    border = RADIUS + 2
    for scale, most in levels(*images.shape[1:]):
        x = _resized(images.astype(np.float32), scale)
        _, h, w = x.shape
        if h <= 2 * border + 2 or w <= 2 * border + 2:
            continue
        smooth = _box(x, 1)
        gy, gx = np.gradient(smooth, axis=(1, 2))
        a, b, c = _box(gx * gx, 2), _box(gy * gy, 2), _box(gx * gy, 2)
        strength = a * b - c * c - 0.05 * (a + b) ** 2
        inner = strength[:, border:-border, border:-border]
        peak = np.ones_like(inner, dtype=bool)
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                if dy or dx:
                    peak &= inner >= strength[:, border + dy : h - border + dy, border + dx : w - border + dx]
        image, ys, xs = _strongest(np.where(peak & (inner > 1e-3), inner, 0), most)
        ys, xs = ys + border, xs + border
        patch = smooth[image[:, None], ys[:, None] + _DISC[:, 0], xs[:, None] + _DISC[:, 1]]
        angle = np.arctan2(patch @ _DISC[:, 0], patch @ _DISC[:, 1])
        t = _TESTS[np.rint(angle / (2 * np.pi) * TURNS).astype(int) % TURNS]
        rows = image[:, None]
        first = smooth[rows, ys[:, None] + t[:, :, 1], xs[:, None] + t[:, :, 0]]
        second = smooth[rows, ys[:, None] + t[:, :, 3], xs[:, None] + t[:, :, 2]]
        records = np.zeros(len(image), dtype=_RECORD)
        records["x"], records["y"] = (xs + 0.5) / scale, (ys + 0.5) / scale
        records["scale"], records["angle"], records["bits"] = scale, angle, np.packbits(first < second, axis=1)
        for i in np.unique(image):
            found[i].append(records[image == i])
    return [np.concatenate(f) if f else np.empty(0, dtype=_RECORD) for f in found]


def describe(images: list[bytes | None]) -> list[bytes]:
    """Corner records of each image, as bytes."""
    pixels = [read_pgm(x) for x in images]
    out = [b""] * len(images)
    by_size: dict[tuple[int, int], list[int]] = {}
    for i, p in enumerate(pixels):
        if p is not None:
            by_size.setdefault(p.shape, []).append(i)
    for places in by_size.values():
        step = max(1, PIXELS // (pixels[places[0]].size))
        for a in range(0, len(places), step):
            part = places[a : a + step]
            for i, found in zip(part, corners(np.stack([pixels[i] for i in part])), strict=True):
                out[i] = found.tobytes()
    return out


def _nearest(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For descriptors x and y: of each x the nearest y and how far it is, and of each y the nearest x; a block of rows at
    a time."""
    x, y = (np.ascontiguousarray(d["bits"]).view("<u8") for d in (x, y))
    to, far = np.empty(len(x), dtype=np.int64), np.empty(len(x), dtype=np.int64)
    back, least = np.zeros(len(y), dtype=np.int64), np.full(len(y), BITS + 1)
    step = max(1, (1 << 20) // len(y))
    for a in range(0, len(x), step):
        apart = sum(np.bitwise_count(x[a : a + step, None, w] ^ y[None, :, w]).astype(np.int16) for w in range(BITS // 64))
        to[a : a + step], far[a : a + step] = apart.argmin(axis=1), apart.min(axis=1)
        here, low = apart.argmin(axis=0), apart.min(axis=0)
        better = low < least
        back[better], least[better] = a + here[better], low[better]
    return to, far, back


def agreeing(a: bytes, b: bytes) -> int:
    """Matches of two images' corners that agree on one scale, turn and shift; 0 if they are under an eighth of all
    matches, as many as agree by chance."""
    x, y = np.frombuffer(a, dtype=_RECORD), np.frombuffer(b, dtype=_RECORD)
    if not len(x) or not len(y):
        return 0
    to, far, back = _nearest(x, y)
    i = np.flatnonzero((back[to] == np.arange(len(x))) & (far <= NEAR))
    if len(i) < 2:
        return len(i)
    j = to[i]
    turn, size = y["angle"][j] - x["angle"][i], x["scale"][i] / y["scale"][j]
    p, q = np.stack([x["x"][i], x["y"][i]], 1), np.stack([y["x"][j], y["y"][j]], 1)
    cos, sin = np.cos(turn) * size, np.sin(turn) * size
    # Each match proposes the map that its own scale, angle and place give; the others vote.
    best, step = 0, max(1, (1 << 20) // len(i))
    for k in (slice(at, at + step) for at in range(0, len(i), step)):
        dx, dy = p[None, :, 0] - p[k, None, 0], p[None, :, 1] - p[k, None, 1]
        ex = q[k, None, 0] + cos[k, None] * dx - sin[k, None] * dy - q[None, :, 0]
        ey = q[k, None, 1] + sin[k, None] * dx + cos[k, None] * dy - q[None, :, 1]
        reach = 2.5 + 0.12 * np.hypot(dx, dy)
        best = max(best, int(((ex**2 + ey**2) <= reach**2).sum(axis=1).max()))
    return best if 8 * best >= len(i) else 0


def _keys(batches: Iterator[pa.RecordBatch], tables: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    """(key, node, part_of, corner, sketch, more) of the descriptors' parts in ``tables``; part_of: the node's component."""
    for batch in batches:
        found: list[list[np.ndarray]] = [[], [], [], [], [], []]
        for node, part_of, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            bits = np.frombuffer(data, dtype=_RECORD)["bits"]
            parts = np.ascontiguousarray(bits).view("<u4").astype(np.int64)[:, tables]
            sketch = np.packbits(np.unpackbits(bits, axis=1)[:, :: BITS // SKETCH], axis=1).view("<i8")
            found[0].append(((np.asarray(tables, dtype=np.int64) << 32) + parts).ravel())
            found[1].append(np.full(parts.size, node))
            found[2].append(np.full(parts.size, part_of))
            found[3].append(np.repeat(np.arange(len(parts), dtype=np.int64), len(tables)))
            found[4].append(np.repeat(sketch[:, 0], len(tables)))
            found[5].append(np.repeat(sketch[:, 1], len(tables)))
        if found[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in found], names=["key", "node", "part_of", "corner", "sketch", "more"])


def _differ(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count((x ^ y).view(np.uint64)).astype(np.int16)


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(head, node, corner) of the members of each list that have the corner of its first entry and another component.
    Partitions are sorted by key; of a list no more than its head is kept."""
    key, held = None, []
    for batch in batches:
        k, node, comp, corner, bits, more = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(6))
        if not len(k):
            continue
        starts = np.flatnonzero(np.diff(k, prepend=k[0] - 1))
        sizes = np.diff(np.append(starts, len(k)))
        own = [x[starts].copy() for x in (node, comp, bits, more)]
        if k[0] == key:
            for x, h in zip(own, held, strict=True):
                x[0] = h
        heads = [np.repeat(x, sizes) for x in own]
        keep = (heads[1] != comp) & (_differ(heads[2], bits) + _differ(heads[3], more) <= CLOSE)
        yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (heads[0], node, corner)], names=["a", "b", "corner"])
        key, held = k[-1], [x[-1] for x in own]


def _pairs(group: np.ndarray, node: np.ndarray, part_of: np.ndarray, corner: np.ndarray, sketch: np.ndarray, more: np.ndarray, own: np.ndarray, cross: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(a, b, corner of b) of the entries of a group that are one corner of images of different components and, where two
    blocks meet, of different blocks."""
    index = np.arange(len(group))
    last = np.append(np.flatnonzero(np.diff(group)), len(group) - 1)
    after = last[np.searchsorted(last, index)] - index
    total = np.cumsum(after)
    at = 0
    while at < len(index):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, side="right")))
        n = after[at:end]
        i = np.repeat(index[at:end], n)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        keep = (_differ(sketch[i], sketch[j]) + _differ(more[i], more[j]) <= CLOSE) & (part_of[i] != part_of[j]) & (~cross[i] | (own[i] != own[j]))
        i, j = i[keep], j[keep]
        low = node[i] < node[j]
        columns = (np.where(low, node[i], node[j]), np.where(low, node[j], node[i]), np.where(low, corner[j], corner[i]))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["a", "b", "corner"])
        at = end


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, corner) of the groups of a partition sorted by group; a group may span batches."""
    rest: list[np.ndarray] | None = None
    for batch in batches:
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(8)]
        rest = columns if rest is None else [np.concatenate(x) for x in zip(rest, columns, strict=True)]
        starts = np.flatnonzero(np.diff(rest[0])) + 1
        if len(starts):
            yield from _pairs(*[x[: starts[-1]] for x in rest])
            rest = [x[starts[-1] :] for x in rest]
    if rest is not None and len(rest[0]):
        yield from _pairs(*rest)


def _agree(xs: pd.Series, ys: pd.Series) -> pd.Series:
    # Either image's own places may propose the map: a link must not hang on which comes first.
    return pd.Series([min(agreeing(x, y), agreeing(y, x)) for x, y in zip(xs, ys, strict=True)])


def _sharing(pairs: DataFrame, parts: int) -> DataFrame:
    """(a, b, n) of pairs with ``SHARED`` different corners; one exchange serves both counts."""
    return pairs.repartition(parts, "a", "b").distinct().groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= SHARED)


def _verified(pairs: DataFrame, nodes: DataFrame, name: str) -> DataFrame:
    """The pairs (a, b) whose corners agree."""
    left = nodes.select(F.col("node").alias("a"), F.col("corners").alias("x"))
    right = nodes.select(F.col("node").alias("b"), F.col("corners").alias("y"))
    checked = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", F.pandas_udf(_agree, "int")("x", "y").alias("n"))
    return stage(checked.where(F.col("n") >= AGREE).select("a", "b"), name)


def _labelled(nodes: DataFrame, label: DataFrame | None) -> DataFrame:
    """``nodes`` with ``part_of``, the component that they are known to belong to."""
    if label is None:
        return nodes.withColumn("part_of", F.col("node"))
    return nodes.join(label, "node", "left").withColumn("part_of", F.coalesce("label", "node")).drop("label")


def image_copies(df: DataFrame, key: str = "image_id", image: str = "image") -> DataFrame:
    """key, n_keypoints, n_copies (other rows of its component) and component_id (smallest key reachable by verified
    copies, itself included)."""
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(image).alias("image"))

    @F.pandas_udf("binary")
    def see(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for images in batches:
            yield pd.Series(describe(list(images)))

    seen = stage(rows.select("key", F.xxhash64("image").alias("hash"), see("image").alias("corners")), "corners")
    size = F.octet_length("corners")
    slim = stage(seen.select("key", F.when(size > 0, F.col("hash")).alias("node"), (size / _RECORD.itemsize).cast("int").alias("n_keypoints")), "seen")
    nodes = stage(seen.where(size > 0).groupBy(F.col("hash").alias("node")).agg(F.first("corners").alias("corners")), "images")
    discard(seen)
    parts, entry = spread(nodes), "key long, node long, part_of long, corner long, sketch long, more long"
    links = label = None
    half = len(TABLES) // 2
    for turn, tables in enumerate((TABLES[:half], TABLES[half:])):
        entries = _labelled(nodes, label).select("node", "part_of", "corners").mapInArrow(lambda it, t=tables: _keys(it, t), entry)
        order = F.xxhash64(F.lit(turn), "node")
        pairs = entries.repartition(parts, "key").sortWithinPartitions("key", order).mapInArrow(_heads, "a long, b long, corner long")
        pairs = _sharing(pairs, parts)
        best = pairs.groupBy("b").agg(F.max_by("a", F.struct("n", "a")).alias("a"))
        new = _verified(best, nodes, "copies")
        links = new if links is None else links.unionByName(new)
        label = components(links)

    entries = _labelled(nodes, label).select("node", "part_of", "corners").mapInArrow(lambda it: _keys(it, TABLES), entry)
    lists = entries.groupBy("key").agg(F.count("*").alias("n"), F.min("part_of").alias("low"), F.max("part_of").alias("high"))
    lists = lists.where("low < high").select("key", F.ceil(F.col("n") / LIST_BLOCK).cast("int").alias("blocks"))
    met = entries.join(lists, "key").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    group = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("group")
    met = met.select(group, "node", "part_of", "corner", "sketch", "more", "own", (F.col("own") != F.col("other")).alias("cross"))
    pairs = met.repartition(parts, "group").sortWithinPartitions("group").mapInArrow(_candidates, "a long, b long, corner long")
    pairs = _sharing(pairs, parts)
    links = links.unionByName(_verified(pairs, nodes, "copies"))
    label = components(links)

    known = slim.join(label, "node", "left").select("key", "n_keypoints", F.coalesce("label", "node").alias("part_of"))
    of = known.where("part_of is not null").groupBy("part_of").agg(F.min("key").alias("component_id"), F.count("*").alias("n"))
    return known.join(of, "part_of", "left").select(
        F.col("key").alias(key), "n_keypoints", F.coalesce(F.col("n") - 1, F.lit(0)).cast("long").alias("n_copies"),
        F.coalesce("component_id", "key").alias("component_id"),
    )

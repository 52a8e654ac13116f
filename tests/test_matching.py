"""Similar strings, unnumbered chapters, rectangles, captions and near vectors against brute force."""

from __future__ import annotations

import difflib
import math
import random

import numpy as np
from pyspark.sql import functions as F

from evigraph.functions.text import title_confidence
from evigraph.operators import consensus, layout, linking, normalize, similar


def names_like(rng, n):
    parts = ["an", "bert", "ko", "la", "mi", "ros", "tu", "Vi", "é", "x "]
    return ["".join(rng.choices(parts, k=rng.randint(1, 6))) for _ in range(n)]


def changed(rng, name):
    i = rng.randrange(len(name) + 1)
    return rng.choice([name[:i] + rng.choice("abxé") + name[i:], name[:i] + name[i + 1 :], name.upper(), name[::-1]])


def ratio(a, b):
    return difflib.SequenceMatcher(None, a.lower(), b.lower()).ratio()


def test_similar_equals_all_pairs(spark):
    rng = random.Random(2)
    known = sorted(set(names_like(rng, 200)))
    names = sorted({changed(rng, rng.choice(known)) for _ in range(300)} | set(names_like(rng, 50)) | {"", "é"})
    left, right = spark.createDataFrame([(x,) for x in [*names, names[3]]], "a string"), spark.createDataFrame([(x,) for x in known], "b string")
    want = {(a, b) for a in names for b in known if a and b and ratio(a, b) >= 0.8}
    assert len(want) > 100 and {(r.a, r.b) for r in similar.similar(left, right, 0.8).collect()} == want
    compared = similar.candidates(left, right, 0.8).count()
    assert len(want) <= compared < len(names) * len(known) / 10


def test_closest_takes_the_best_and_the_first(spark):
    rng = random.Random(5)
    known = list(dict.fromkeys(names_like(rng, 120)))
    names = [changed(rng, rng.choice(known)) for _ in range(200)] + known[:5] + [None, ""]

    def fold(name):
        if name is None or name in known:
            return name
        best, score = name, 0.8
        for k in known:
            r = ratio(name, k)
            if r > score or (r == score and best is name):
                best, score = k, r
        return best

    df = spark.createDataFrame([(x,) for x in names], "name string")
    got = normalize.closest(df, spark.createDataFrame([(k, i) for i, k in enumerate(known)], "canonical string, ord int")).collect()
    assert len(got) == len(names) and {r.name: r.canonical for r in got} == {x: fold(x) for x in names}


def test_unnumbered_equals_the_fold(spark):
    rng = random.Random(6)
    rows = []
    for book in range(15):
        titles = [f"{a} {b}" for a in ("the long", "a short", "an old") for b in ("story", "stories", "History of x", "road")]
        rows += [(book, src, pos, "", rng.choice([str, str.upper])(changed(rng, rng.choice(titles)))) for src in range(3) for pos in range(8)]

    def fold(group):
        made = {}
        for src, _, title in sorted((r[1], r[2], r[4]) for r in group):
            low = " ".join(title.lower().split())
            key = next((k for k in made if difflib.SequenceMatcher(None, low, k).ratio() >= 0.75), low)
            made.setdefault(key, []).append((src, title))
        return {(k, len({s for s, _ in v}), max((t for _, t in v), key=len)) for k, v in made.items() if len({s for s, _ in v}) >= 2}

    df = spark.createDataFrame(rows, "book int, src int, pos int, num string, title string")
    got = consensus.unnumbered(df).collect()
    assert {(r.book, r.key, r.n_sources, r.title) for r in got} == {(b, *x) for b in range(15) for x in fold([r for r in rows if r[0] == b])}


def test_rectangles_meet_once(spark):
    rng = random.Random(7)
    rows = [(i, i % 2, x := rng.uniform(-300, 900), y := rng.uniform(-50, 700), x + rng.choice([0, 5, 40, 700]), y + rng.choice([0, 3, 30, 400])) for i in range(150)]
    df = spark.createDataFrame([*rows, (999, 0, None, 1.0, 2.0, 3.0)], "id int, page int, x0 double, y0 double, x1 double, y1 double")
    pairs = layout.overlap_join(df, df.withColumnRenamed("id", "other"), ["page"], 2.0, 5.0).collect()
    want = [(a[0], b[0]) for a in rows for b in rows if a[1] == b[1] and a[2] - 2 < b[4] and b[2] < a[4] + 2 and a[3] - 5 < b[5] and b[3] < a[5] + 5]
    assert sorted((r.id, r.other) for r in pairs) == sorted(want) and len(want) > 500
    figures, captions = df.where("id < 75"), df.where("id >= 75")
    near = lambda f, c: (-6 <= f[3] - c[5] <= 48 or -6 <= c[3] - f[5] <= 48) and f[2] - 10 < c[4] and c[2] < f[4] + 10
    has = {f[0] for f in rows[:75] if any(near(f, c) for c in rows[75:] if c[1] == f[1])}
    assert {r.id for r in layout.with_caption(figures, captions, ["page"], "id").collect()} == has
    assert {r.id for r in layout.with_caption(figures, captions, ["page"], "id", has=False).collect()} == {f[0] for f in rows[:75]} - has


def test_captions_equal_the_fold(spark):
    rng = random.Random(8)
    docs = {d: [(rng.choice(["figure", "table", "caption", "caption", "paragraph"]), i // 7, rng.choice(["Figure 1", "Table 2", ""])) for i in range(30)] for d in range(25)}

    def fold(blocks):
        used, out = set(), set()
        for i, (kind, page, _) in enumerate(blocks):
            if kind in ("figure", "table"):
                for j in (i + s for k in range(1, 6) for s in (-k, k)):
                    if 0 <= j < len(blocks) and j not in used and blocks[j][0] == "caption" and blocks[j][1] == page and blocks[j][2].lower().startswith(kind):
                        used.add(j)
                        out.add((3 * i, 3 * j))
                        break
        return out

    df = spark.createDataFrame([(d, 3 * i, *b) for d, bs in docs.items() for i, b in enumerate(bs)], "doc int, pos int, type string, page int, label string")
    assert {(r.doc, r.figure, r.caption) for r in layout.attach_captions(df).collect()} == {(d, *x) for d, bs in docs.items() for x in fold(bs)}
    assert layout.attach_captions(df.where("false")).collect() == []


def test_all_near_pairs(spark, monkeypatch):
    monkeypatch.setattr(normalize, "BLOCK", 16)
    rng = random.Random(9)
    base = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(20)]
    rows = [(i, [x + rng.gauss(0, 0.15) for x in base[i % 20]]) for i in range(90)] + [(200, None), (201, [0.0] * 8), (202, [math.nan] * 8), (203, [1.0, None]), (204, [3.0, 4.0]), (205, [6.0, 8.0])]
    fine = [(i, v) for i, v in rows if v and i not in (201, 202, 203)]
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / math.hypot(*a) / math.hypot(*b)
    want = {(i, j) for i, v in fine for j, w in fine if i < j and len(v) == len(w) and cos(v, w) >= 0.93}
    got = normalize.all_near_pairs(spark.createDataFrame(rows, "id long, v array<double>"), "id", "v").collect()
    assert len(got) == len(want) > 50 and {(r.a, r.b) for r in got} == want


def test_all_near_pairs_exchange_no_block_for_each_other(spark, monkeypatch):
    """blocks meet where they are read; with more blocks nothing more is exchanged."""
    monkeypatch.setattr(normalize, "BLOCK", 4)
    rows = [(f"k{i}", [math.cos(i / 40), math.sin(i / 40)] + [0.0] * (i % 2)) for i in range(120)]
    near = normalize.all_near_pairs(spark.createDataFrame(rows, "id string, v array<float>"), "id", "v", 0.99)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan
    got = near.collect()
    assert {(r.a, r.b) for r in got} == {tuple(sorted((f"k{i}", f"k{j}"))) for i in range(120) for j in range(i) if i % 2 == j % 2 and math.cos((i - j) / 40) >= 0.99}
    assert len(got) == len({(r.a, r.b) for r in got}) and all(abs(r.similarity - math.cos((int(r.a[1:]) - int(r.b[1:])) / 40)) < 1e-6 for r in got)


def test_links_equal_all_pairs(spark):
    rng = random.Random(10)
    words = ["the", "the", "dune", "star", "war", "2", "life", "of", "pi-day", "É"]
    make = lambda n: sorted({" ".join(rng.choices(words, k=rng.randint(1, 5))) + rng.choice(["", "", " ", "!"]) for _ in range(n)})
    titles, asked = make(60), [*make(60), "", "  "]
    index = spark.createDataFrame([(t, f"Q{i}") for i, t in enumerate(titles)], "title string, qid string")
    queries = spark.createDataFrame([(q, rng.choice(["concept", "theory", "person", "place"])) for q in asked], "query string, type string")
    cache = spark.createDataFrame([(asked[0], "known", "C", 0.9, "local")], "query string, canonical_name string, qid string, confidence double, method string")
    got = {r.query: (r.canonical_name, r.confidence, r.method) for r in linking.resolve(queries, index, cache, index).collect()}
    pairs = queries.crossJoin(index).select("query", "type", "title", title_confidence(F.col("query"), F.col("title")).alias("c")).collect()
    for q, kind in queries.collect():
        fits = sorted((-p.c, p.title) for p in pairs if p.query == q and p.c >= 0.6)
        want = ("known", 0.9, "local") if q == asked[0] else (fits[0][1], -fits[0][0], "remote" if kind == "person" else "local") if fits and kind != "place" else (None, None, "not_found")
        assert got[q] == want, q


def test_links_send_no_names_through_the_driver(spark):
    rows = [(f"query {i}", "concept" if i % 2 else "person") for i in range(40)]
    queries = spark.createDataFrame(rows, "query string, type string")
    index = spark.createDataFrame([(q, "Q") for q, _ in rows], "title string, qid string")
    remote = spark.createDataFrame([(f"{q} life", "R") for q, _ in rows], "title string, qid string")
    cache = spark.createDataFrame([("query 3", "cached", "C", 0.9, "local")], "query string, canonical_name string, qid string, confidence double, method string")
    found = linking.resolve(queries, index, cache, remote)
    assert "BroadcastExchange" not in found._jdf.queryExecution().executedPlan().toString()
    got = {r.query: (r.canonical_name, r.confidence) for r in found.collect()}
    assert len(got) == 40 and got["query 3"] == ("cached", 0.9) and got["query 5"] == ("query 5", 1.0) and got["query 4"] == ("query 4 life", 0.85)


def test_boxes_of_pages_go_to_python_by_the_batch(spark):
    rng = random.Random(5)
    rows = [(p, *(lambda x, y: (x, y, x + rng.random() * 30, y + rng.random() * 30))(rng.random() * 200, rng.random() * 200)) for p in range(30) for _ in range(p)]
    merged = layout.merge_boxes(spark.createDataFrame(rows, "page int, x0 double, y0 double, x1 double, y1 double"), ["page"])
    assert "FlatMapGroupsIn" not in merged._jdf.queryExecution().executedPlan().toString()
    want = sorted((p, *b) for p in range(30) for b in layout.merged_boxes([r[1:] for r in rows if r[0] == p]))
    assert sorted(map(tuple, merged.collect())) == want


def test_earlier_pairs_of_small_and_large_groups(spark, monkeypatch):
    """small groups are compared within a task, large ones by the index; both as all pairs are."""
    rng = random.Random(5)
    names = sorted({n.lower() for n in names_like(rng, 40)} | {""})
    names = sorted({*names, *(changed(rng, n).lower() for n in names)})
    rows = [(b, n, rng.randrange(5)) for b in range(3) for n in names[: 60 if b else 12]]
    df = spark.createDataFrame(rows, "book int, low string, k int").select("book", "low", F.struct("k", "low").alias("ord"))
    want = {(b, x, y) for b, x, k in rows for c, y, j in rows if b == c and (j, y) < (k, x) and x and y and ratio(x, y) >= 0.75}
    assert len(want) > 20
    for most in (512, 20, 0):
        monkeypatch.setattr(similar, "MOST_TOGETHER", most)
        monkeypatch.setattr(similar, "MOST_CELLS", 300)
        got = similar.earlier(df, 0.75, "book", "low", "ord").collect()
        assert {(r.book, r.a, r.b) for r in got} == want and len(got) == len(want)
        assert all(r.b_ord.low == r.b for r in got)


def test_similar_sends_only_counts_to_all(spark, monkeypatch):
    """the strings' characters are many times their files and are not broadcast; characters that are not counted are the rarest."""
    rng = random.Random(11)
    words = ["".join(rng.choice("abcde fgh") for _ in range(rng.randint(4, 9))) for _ in range(120)]
    left, right = (spark.createDataFrame([(i % 3, w) for i, w in enumerate(words) if i % 5 != k], f"g int, {c} string") for k, c in enumerate("ab"))
    want = {(i % 3, a, b) for i, a in enumerate(words) if i % 5 for j, b in enumerate(words) if j % 5 != 1 and i % 3 == j % 3 and difflib.SequenceMatcher(None, a.lower(), b.lower()).ratio() >= 0.6}
    for most in (65_536, 4):
        monkeypatch.setattr(similar, "MOST_RANKS", most, raising=False)
        found = similar.similar(left, right, 0.6, ["g"])
        lines = found._jdf.queryExecution().executedPlan().toString().split("\n")
        sent = [lines[i + 1 : i + 3] for i, line in enumerate(lines) if "BroadcastExchange" in line]
        assert sent and all(any("TakeOrderedAndProject" in x for x in below) for below in sent)
        assert {(r.g, r.a, r.b) for r in found.collect()} == want and len(want) > 20


def test_far_blocks_are_not_multiplied(spark, monkeypatch):
    """blocks that are too far apart as a whole are passed over, and no pair is lost by it; similarities are rounded in the task."""
    draw = np.random.default_rng(12)
    far = 0
    for _ in range(400):
        d, wide = int(draw.integers(2, 7)), draw.choice([0.02, 0.2, 1.0])
        left, right = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (draw.normal(size=d) + wide * draw.normal(size=(9, d)) for _ in range(2)))
        least = float(draw.choice([-0.5, 0.3, 0.93, 0.999]))
        if normalize._far(left, right, least):
            far += 1
            assert (left @ right.T).max() < least
    assert 50 < far < 400 and not normalize._far(left, left, 1.0)

    monkeypatch.setattr(normalize, "BLOCK", 8)
    base = draw.normal(size=(6, 5))
    vectors = [(base[i % 6] + 0.2 * draw.normal(size=5)).tolist()[: 5 - i % 2] for i in range(120)]
    got = normalize.all_near_pairs(spark.createDataFrame([(f"k{i}", v) for i, v in enumerate(vectors)], "id string, v array<double>"), "id", "v", 0.9, digits=6).collect()
    want = {}
    for i, v in enumerate(vectors):
        for j, w in enumerate(vectors[:i]):
            if len(v) == len(w) and (cos := float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w))) >= 0.9:
                want[tuple(sorted((f"k{i}", f"k{j}")))] = round(cos, 6)
    assert len(got) == len(want) > 100 and all(abs(want[r.a, r.b] - r.similarity) < 1e-9 for r in got)

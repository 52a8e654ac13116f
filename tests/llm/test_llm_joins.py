"""n-gram join (6), lattice hashing (10), image copies (4), components, mixing (1), licenses (9), pipeline."""

from __future__ import annotations

import hashlib
import random
import re

import duckdb
import numpy as np
import pytest

from evigraph.llm import image_copies, lattice, licenses, mixing, ngram_join
from evigraph.llm.components import components

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def groups_of(edges, nodes):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(rng.randint(100, 300), rng.randint(100, 300)) for _ in range(90)] + [(500, 500 + i) for i in range(60)] + [(7, 7), (None, 3)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    want = groups_of(real, {x for e in real for x in e})
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_join(rows, n=5, percent=75):
    sets = []
    for key, text in rows:
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]
        sets.append((key, {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()))
    index = list(range(len(sets)))
    edges = [(i, j) for i in index for j in index[:i] if sets[i][1] and sets[j][1] and sets[i][0] is not None and sets[j][0] is not None and 100 * len(sets[i][1] & sets[j][1]) >= percent * len(sets[i][1] | sets[j][1])]
    label = groups_of(edges, index)
    low: dict[int, int] = {}
    for i in index:
        if sets[i][0] is not None:
            low[label[i]] = min(low.get(label[i], sets[i][0]), sets[i][0])
    return sorted(((k, len(s), low[label[i]] if k is not None else None) for i, (k, s) in enumerate(sets)), key=str)


@pytest.mark.parametrize("seed", range(4))
def test_ngram_join_equals_brute_force(spark, seed, monkeypatch):
    rng = random.Random(seed)
    if seed % 2:  # groups and lists are cut into many blocks
        monkeypatch.setattr(ngram_join, "GROUP_BLOCK", 3)
        monkeypatch.setattr(ngram_join, "LIST_BLOCK", 2)
    if seed == 3:
        monkeypatch.setattr(ngram_join, "BATCH", 800)
    word = lambda: "".join(rng.choices(LETTERS, k=3))
    base = [[word() for _ in range(rng.randint(1, 90))] for _ in range(25)]
    passage = [word() for _ in range(30)]
    rows = []
    for b in base:
        for _ in range(rng.randint(1, 7)):
            copy = list(b)
            for _ in range(rng.randint(0, 1 + len(b) // 25)):
                copy[rng.randrange(len(copy))] = word()
            if rng.random() < 0.3:
                copy += passage
            rows.append((len(rows) * 3 % 199 + 10, " ".join(copy)))
    rows += [(5, None), (6, ""), (7, " \t\n"), (8, "One two"), (9, "one two"), (4, "ONE  two"), (3, "Éa b"), (2, "éa b"), (None, "One two"), (None, None), rows[0], (rows[1][0], "another text of that id")]
    rows += [(1000 + i, "the same six words go here " * 40) for i in range(20)]
    df = spark.createDataFrame([(k, t, 1, 2) for k, t in rows], "doc_id long, text string, node int, n int")
    got = [tuple(r) for r in ngram_join.similarity_components(df).collect()]
    assert sorted(got, key=str) == brute_join(rows)


def test_ngram_join_of_nothing(spark):
    assert ngram_join.similarity_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_lists_and_groups_alone():
    size, place = np.array([10, 10, 10, 14]), np.array([0, 1, 3, 0])
    # 10 and 10 need 9 in common: positions 0 and 1 leave that, 3 does not; 14 is too large for 10.
    assert ngram_join._alive(size, place, 75).tolist() == [True, True, False, False]
    sets = [np.arange(a, a + 20, dtype=np.uint64) for a in (0, 1, 2, 3, 40)]
    assert ngram_join._linked(sets, sets[0], 75).tolist() == [0, 0, 0, 0, 4]


def test_e8_decodes_to_nearest_points():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 8)) * 2
    near, next_, loss = lattice.e8(x)
    for points in (near, next_):
        assert np.isin(points % 2, [0, 1]).all() and (np.abs(points % 2 - points[:, :1] % 2) < 1e-9).all()
        assert (points.sum(axis=1) % 4 == 0).all()
    far = np.linalg.norm(x - near / 2, axis=1)
    assert far.max() <= 1 + 1e-9 and (loss >= 0).all()
    roots = np.array([v for v in np.stack(np.meshgrid(*[[-1, 0, 1]] * 8), -1).reshape(-1, 8) if np.abs(v).sum() == 2] + [v for v in np.stack(np.meshgrid(*[[-0.5, 0.5]] * 8), -1).reshape(-1, 8) if (v.sum() % 2) == 0])
    assert len(roots) == 240  # no neighbour of the decoded point is nearer
    assert all(far[i] <= np.linalg.norm(x[i] - near[i] / 2 - roots, axis=1).min() + 1e-9 for i in range(100))


def brute_cosine(rows, limit=0.93):
    good = []
    for i, (_, v, label) in enumerate(rows):
        if v and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good.append((i, np.asarray(v, dtype=float) / np.linalg.norm(v), label))
    edges = [(i, j) for i, a, x in good for j, b, y in good if j < i and x == y and len(a) == len(b) and a @ b >= limit]
    label = groups_of(edges, range(len(rows)))
    low: dict[int, int] = {}
    for i, r in enumerate(rows):
        low[label[i]] = min(low.get(label[i], r[0]), r[0])
    count = [sum(i in e for e in edges) for i in range(len(rows))]
    return sorted((rows[i][0], count[i], low[label[i]], rows[i][0] == low[label[i]]) for i in range(len(rows)))


@pytest.mark.parametrize("block", [1024, 4])
def test_lattice_near_duplicates(spark, block, monkeypatch):
    monkeypatch.setattr(lattice, "CELL_BLOCK", block)
    rng = np.random.default_rng(block)
    rows = []
    for g in range(40):
        v = rng.normal(size=64)
        for _ in range(rng.integers(1, 9)):
            rows.append((len(rows), (v + rng.normal(size=64) * rng.uniform(0.02, 0.35)).tolist(), int(g % 3)))
    for _ in range(30):
        rows.append((len(rows), rows[3][1], rows[3][2]))
    rows += [(900, [x * 5e100 for x in rows[3][1]], rows[3][2]), (901, rows[3][1], None), (902, None, 1), (903, [], 1), (904, [0.0] * 64, 1), (905, [float("nan")] * 64, 1), (906, [1.0, None], 1), (907, [float("inf"), 1.0], 1), (908, [1.0, 2.0], 1), (909, [1.0, 2.1], 1), (909, [1.0, 2.1], 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, node string")
    got = sorted(tuple(r) for r in lattice.near_duplicates(df).collect())
    want = brute_cosine(rows)
    assert sum(g[1] for g in got) >= 0.97 * sum(w[1] for w in want)
    assert all(g[0] == w[0] and g[1] <= w[1] for g, w in zip(got, want, strict=True))
    assert sum(g != w for g, w in zip(got, want, strict=True)) <= 0.05 * len(rows)
    assert lattice.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("cosine,least", [(0.93, 0.985), (0.94, 0.99), (0.96, 0.995)])
def test_lattice_recall_at_the_threshold(cosine, least):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(2, 4000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b = cosine * a + (1 - cosine**2) ** 0.5 * b / np.linalg.norm(b, axis=1, keepdims=True)
    x, y = (lattice.cells(v, lattice.TABLES, lattice.POINTS) for v in (a, b))
    assert ((x[:, :, :1] == y).any(axis=2) | (y[:, :, :1] == x).any(axis=2)).any(axis=1).mean() >= least


def test_lattice_with_other_tables(spark):
    rng = np.random.default_rng(7)
    rows = []
    for _ in range(20):
        v = rng.normal(size=64)
        v /= np.linalg.norm(v)
        for _ in range(4):
            w = rng.normal(size=64)
            w -= (w @ v) * v
            rows.append((len(rows), (v + w / np.linalg.norm(w) * 0.27).tolist(), 1))  # two of a group are near cosine 0.93
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert sorted(tuple(r) for r in lattice.near_duplicates(df, tables=40, points=3).collect()) == brute_cosine(rows)


def texture(rng, side=96):
    x = rng.normal(size=(1, side, side))
    x = image_copies._box(image_copies._box(x, 2), 1)[0]
    return np.clip(128 + 45 * x / x.std(), 0, 255).astype(np.uint8)


def test_image_copies(spark):
    rng = np.random.default_rng(3)
    originals = [texture(rng) for _ in range(25)]
    rows = [(i, image_copies.write_pgm(x)) for i, x in enumerate(originals)]
    expected = {}
    for i, x in enumerate(originals[:16]):
        edited = [x[6:86, 10:92], np.rot90(x), np.clip(x * 0.8 + 30 + rng.normal(0, 5, x.shape), 0, 255), x][i % 4]
        rows.append((100 + i, image_copies.write_pgm(edited)))
        expected[100 + i] = i
    rows += [(200, None), (201, b""), (202, b"P5\n3 3\n255\n123456789"), (203, b"P6 junk"), (204, image_copies.write_pgm(np.full((90, 90), 7))), (205, b"P5\n90 90\n255\nshort"), (0, rows[0][1])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "image_id long, image binary, node int")
    out = image_copies.image_copies(df).collect()
    assert len(out) == len(rows)
    found = {r.image_id: r for r in out}
    assert sum(found[k].component_id == v for k, v in expected.items()) >= 15
    assert all(found[i].component_id == i for i in range(25))
    assert all(found[i].n_keypoints == 0 and found[i].component_id == i and found[i].n_copies == 0 for i in range(200, 206))
    assert found[0].n_copies >= 1
    assert image_copies.image_copies(df.limit(0)).count() == 0


@pytest.mark.parametrize("block", [1024, 3])
def test_image_copies_equal_brute_force_over_all_pairs(spark, block, monkeypatch):
    monkeypatch.setattr(image_copies, "LIST_BLOCK", block)
    rng = np.random.default_rng(5)
    mark = texture(rng)[:40]  # hot keys: all images bear it, so lists begin with images that are no copies
    rows = []
    for _ in range(6):
        x = texture(rng).astype(float)
        x[:40] = mark
        rows += [(len(rows) + i, image_copies.write_pgm(np.clip(x + rng.normal(0, 6, x.shape), 0, 255))) for i in range(3)]
    for _ in range(12):
        x = texture(rng).astype(float)
        edits = [x, x[8:88, 5:90], np.rot90(x), x * 0.7 + 40, x + rng.normal(0, 5, x.shape)]
        rows += [(len(rows) + i, image_copies.write_pgm(np.clip(e, 0, 255))) for i, e in enumerate(edits)]
    seen = image_copies.describe([r[1] for r in rows])
    edges = [(i, j) for i in range(len(rows)) for j in range(i) if min(image_copies.agreeing(seen[i], seen[j]), image_copies.agreeing(seen[j], seen[i])) >= image_copies.AGREE]
    got = {r.image_id: r.component_id for r in image_copies.image_copies(spark.createDataFrame(rows, "image_id long, image binary")).collect()}
    label = groups_of(edges, range(len(rows)))
    assert all(label[got[i]] == label[i] for i in got)  # nothing joined that brute force keeps apart
    wanted = sum(label[i] == label[j] for i in range(len(rows)) for j in range(i))
    found = sum(got[i] == got[j] for i in range(len(rows)) for j in range(i))
    assert found >= 0.9 * wanted


def test_image_copies_finds_a_crop_of_a_large_image(spark):
    rng = np.random.default_rng(8)
    large = [texture(rng, 600) for _ in range(4)]
    rows = [(i, image_copies.write_pgm(x)) for i, x in enumerate(large)]
    rows += [(10, image_copies.write_pgm(large[2][100:250, 300:450])), (11, image_copies.write_pgm(large[1][::2, ::2])), (12, image_copies.write_pgm(texture(rng, 200)))]
    got = {r.image_id: r for r in image_copies.image_copies(spark.createDataFrame(rows, "image_id long, image binary")).collect()}
    assert [got[i].component_id for i in (10, 12)] == [2, 12]
    assert got[0].n_keypoints > 10 * got[12].n_keypoints / 4


def brute_shares(budget, nodes):
    """Shares of siblings [(weight, limit)]: the level is found by repetition."""
    live, given = [i for i, (w, _) in enumerate(nodes) if w > 0], [0.0] * len(nodes)
    budget = min(budget, sum(nodes[i][1] for i in live))
    while live:
        level = budget / sum(nodes[i][0] for i in live)
        full = [i for i in live if nodes[i][1] < level * nodes[i][0] - 1e-9]
        if not full:
            for i in live:
                given[i] = level * nodes[i][0]
            break
        for i in full:
            given[i] = nodes[i][1]
            budget -= nodes[i][1]
        live = [i for i in live if i not in full]
    return given


def test_mixing_is_planned_in_small_steps(spark):
    """The pipeline's stage once was one plan of 23 exchanges, too large for the memory of a small driver."""
    docs = spark.createDataFrame([(i, f"{'w ' * (i % 7)}x{i}", "ab"[i % 2], f"s{i % 3}") for i in range(60)], "doc_id long, text string, lang string, source string")
    mixed = mixing.mix(mixing.counted(docs, ["doc_id", "lang", "source"]), ["lang", "source"], {}, share=0.5, max_epochs=2)
    texts = mixing.with_text(mixed, docs, ["doc_id", "lang", "source"])
    for df, most in ((mixed, 6), (texts, 3)):
        assert df._jdf.queryExecution().executedPlan().toString().count("Exchange ") <= most
    assert texts.count() == mixed.count() > 0


def test_mixing(spark, monkeypatch):
    rng = random.Random(6)
    monkeypatch.setattr(mixing, "RANGE_ROWS", 8)
    rows = [(i, " ".join(["w"] * rng.randint(0, 30)), rng.choice("pq"), rng.choice(["en", "de", None]), rng.choice(["s1", "s1", "s1", "s2"])) for i in range(300)]
    rows += [(304, "a b c d e", "q", "de", "s1")] * 25  # a document of many rows
    rows += [(None, "a b c", "p", "en", "s1"), (7, rows[7][1], *rows[7][2:]), (301, None, "p", "en", "s1"), (302, "x " * 500, "z", "en", "s9"), (303, "y", "0", "en", "s1")]
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, domain string, lang string, source string, epoch int")
    slim = mixing.counted(df, ["doc_id", "domain", "lang", "source", "epoch"])
    weights = {"p": 3, "q": 1, "z": 5, "0": 0, "*/en": 2, "p/de/": 1, "*/*/s2": 2.5}
    total = sum(len((r[1] or "").split()) for r in rows)
    levels = ["domain", "lang", "source"]
    for share, epochs in ((0.5, 1), (0.9, 3), (2.0, 2), (0.0, 2)):
        out = mixing.mix(slim, levels, weights, share=share, max_epochs=epochs, seed=3).collect()
        size: dict[tuple, int] = {}
        for r in rows:
            leaf = (r[2], r[3] or "", r[4])
            size[leaf] = size.get(leaf, 0) + len((r[1] or "").split())
        size = {k: v for k, v in size.items() if v}
        weight = lambda i, name: float(weights.get(name if i == 0 else "*/" * i + name, 1))
        limit = {k: v * epochs * (k[0] != "0") for k, v in size.items()}
        got: dict[tuple, int] = {}
        for r in out:
            leaf = (r.domain, r.lang or "", r.source)
            got[leaf] = got.get(leaf, 0) + r.taken_tokens
            assert 0 < r.taken_tokens <= r.n_tokens and r.epoch < epochs

        def descend(prefix, budget, got=got, limit=limit):
            names = sorted({k[: len(prefix) + 1] for k in limit if k[: len(prefix)] == prefix})
            nodes = [(weight(len(prefix), n[-1]), sum(v for k, v in limit.items() if k[: len(n)] == n)) for n in names]
            for name, part in zip(names, brute_shares(budget, nodes), strict=True):
                if len(name) == 3:
                    assert abs(got.get(name, 0) - part) < 1, (name, part)
                else:
                    descend(name, part)

        descend((), int(total * share))
        # A leaf's part of an epoch is a prefix in the order of the seeded hash.
        for leaf, n in got.items():
            whole = n // size[leaf]
            part = [r for r in out if (r.domain, r.lang or "", r.source) == leaf and r.epoch == whole]
            docs = sorted((hashlib.md5(f"3:{whole}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[0]) for r in rows if (r[2], r[3] or "", r[4]) == leaf and (r[1] or "").split())
            assert sorted(str(r.doc_id) for r in part) == sorted(str(k) for _, k in docs[: len(part)])
            assert sum(r.taken_tokens < r.n_tokens for r in part) <= 1
    assert mixing.mix(slim.limit(0), levels, weights).count() == 0
    texts = mixing.with_text(mixing.mix(slim, levels, weights, share=0.5, max_epochs=1, seed=3), df, ["doc_id", "domain", "lang", "source"])
    assert texts.columns == df.columns
    assert sum(len(r.text.split()) for r in texts.collect()) == pytest.approx(total * 0.5, abs=12)


def test_licenses(spark):
    mit, gpl = (next(t for k, t in licenses.TEMPLATES if k == name) for name in ("mit", "gpl-3.0"))
    rows = [
        (1, f"code\n{mit}\nmore", "a/x.py"), (2, "nothing here", "a/b/y.py"), (3, gpl, "a/LICENSE"), (4, "plain", "a/b/c/z.py"), (5, None, "d/q.py"),
        (6, "", None), (7, "the work of the form under version", "q.py"), (8, "released UNDER the mit license", "/a//b/v.py"), (9, f"{mit}\n{gpl}", "e/COPYING.txt"),
        (10, "x", "e/f"), (11, "license license license", "LICENSE"), (12, "word " * 50_000 + "\n" + mit, "big"), (12, "other row of that id", "big"), (None, gpl, "n"),
    ]
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, path string, license string")
    got = {(r.doc_id, r.path): r for r in licenses.scan(df).collect()}
    assert licenses.scan(df).count() == len(rows)
    assert got[(1, "a/x.py")].own_license == "mit" and got[(1, "a/x.py")].inherited_from is None
    assert got[(2, "a/b/y.py")].license == "gpl-3.0" and got[(2, "a/b/y.py")].inherited_from == "a"
    assert got[(4, "a/b/c/z.py")].inherited_from == "a"
    assert got[(5, "d/q.py")].license is None and got[(6, None)].license is None and got[(7, "q.py")].license is None
    assert got[(8, "/a//b/v.py")].own_license == "mit"
    assert got[(9, "e/COPYING.txt")].own_license == "gpl-3.0" or got[(9, "e/COPYING.txt")].own_score == 1.0
    assert got[(10, "e/f")].inherited_from == "e"
    assert got[(12, "big")].own_license == "mit" and got[(None, "n")].own_license == "gpl-3.0"
    assert licenses.scan(df.limit(0)).count() == 0


def test_license_notices_among_common_words(spark):
    common = "this file is released under the see license for details"
    rows = [(i, f"{common} {i}") for i in range(400)]
    found = {1000: "This file is released under the MIT License.", 1001: "Released under the MIT License. See LICENSE for details."}
    rows += [*found.items(), (1002, "zyx wvu tsr qpo nml kji mit license")]  # words that no other document has
    got = {r.doc_id: r.license for r in licenses.license_units(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: "mit" for k in found}


GPL_HEADER = """#!/bin/sh
# tool - does things
# Copyright (C) 2024 Somebody
#
# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
#
# This program is distributed in the hope that it will be useful.
echo
"""
APACHE_HEADER = """/*
 * Copyright 2024 Somebody
 *
 * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 * You may obtain a copy of the License at
 *
 *     http://www.apache.org/licenses/LICENSE-2.0
 */
int main() {}
"""


def test_license_headers_and_files(spark):
    mit = "Copyright (c) 2024 Somebody\n\n" + max((t for k, t in licenses.TEMPLATES if k == "mit"), key=len).replace(", ", ",\n")
    gpl = "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Everyone is permitted to copy it verbatim.\n" + "filler text of many words\n" * 300
    lgpl = gpl.replace("GNU GENERAL", "GNU LESSER GENERAL")
    rows = [
        (1, GPL_HEADER, "g/a.sh"), (2, APACHE_HEADER, "g/b.c"), (3, mit, "m/LICENSE"), (4, "code of words", "m/x/y.py"), (5, gpl, "n/COPYING"), (6, lgpl, "o/COPYING"),
        (7, "words of any file", "n/z.py"), (8, "# some header\n# of free software that\n# you can modify\ncode", "h.py"), *((i, f"plain words {i} of a file", f"q/{i}") for i in range(20, 60)),
    ]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, path string")).collect()}
    assert [got[i].own_license for i in (1, 2, 3, 5, 6)] == ["gpl-3.0", "apache-2.0", "mit", "gpl-3.0", "lgpl-3.0"]
    assert (got[4].license, got[4].inherited_from) == ("mit", "m") and got[7].license == "gpl-3.0"
    assert got[8].license is None and got[30].license is None


def test_queries_with_sql_equal_it(spark):
    from evigraph.llm import queries

    sf = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for name in ("documents", "pages", "embeddings", "labels"):
        db.execute(f"create view {name} as select * from '{sf}/{name}.parquet{'' if __import__('os').path.isfile(f'{sf}/{name}.parquet') else '/*.parquet'}'")
    for name, sql in queries.oracle_sql().items():
        want = db.execute(sql).fetchall()
        columns = [c[0] for c in db.description]
        got = [tuple(r[c] for c in columns) for r in queries.queries()[name](spark, sf).collect()]
        assert sorted(map(str, got)) == sorted(map(str, want)), name


def test_pipeline_against_its_stages(spark):
    import corpus_pipeline as cp

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    toxic = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 1").collect()}
    found = [docs]
    for _, step in cp.STAGES:
        found.append(cp.stage(step(spark, found[-1], sf), "test"))
        if len(found) <= len(cp.STAGES):
            assert found[-1].columns == cp.COLUMNS
    ids = [[r.doc_id for r in f.select("doc_id").collect()] for f in found]
    assert set(ids[1]) <= set(ids[0]) and len(ids[1]) >= 0.99 * len(ids[0])
    assert len(set(ids[1]) - set(ids[2])) <= 1.5 * len(toxic) + 3 and not (set(ids[2]) & toxic) - set(list(toxic)[:2]) or len(set(ids[2]) & toxic) <= 0.1 * len(toxic) + 1
    rows = [(r.doc_id, r.text) for r in found[2].select("doc_id", "text").collect()]
    assert sorted(ids[3]) == sorted(k for k, _, low in brute_join(rows) if k == low)
    words = sum(len((r.text or "").split()) for r in found[3].collect())
    assert sum(len(r.text.split()) for r in found[4].collect()) == pytest.approx(0.9 * words, abs=80)
    assert set(ids[5]) == set(ids[4])
    assert cp.run(spark, sf).count() == len(ids[5])


def test_standard_bsd_files_are_not_proprietary(spark):
    full = {k: max((t for n, t in licenses.TEMPLATES if n == k), key=len) for k in ("bsd-2-clause", "bsd-3-clause", "isc")}
    rows = [(i, "Copyright (c) 2020, Someone\nAll rights reserved.\n\n" + t.replace(" 1. ", "\n\n1. ").replace(" 2. ", "\n\n2. ").replace(" 3. ", "\n\n3. ").replace(" THIS SOFTWARE IS", "\n\nTHIS SOFTWARE IS", 1), f"{k}/LICENSE") for i, (k, t) in enumerate(full.items())]
    rows += [(10, "x", "bsd-3-clause/src/a.py"), (11, "some words\nAll rights reserved.\nmore", "z/LICENSE"), (12, "code", "z/a.py")]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, path string")).collect()}
    assert [got[i].own_license for i in range(3)] == list(full) and got[10].license == "bsd-3-clause"
    assert got[11].own_license == "proprietary" and got[12].license == "proprietary"


def test_full_texts_refuse_more_than_they_hold(spark, tmp_path, monkeypatch):
    for i in range(4):
        (tmp_path / f"Own-{i}.txt").write_text(f"terms number {i}")
    assert [k for k, _ in licenses.full_texts(spark, str(tmp_path))] == [f"own-{i}" for i in range(4)]
    monkeypatch.setattr(licenses, "MOST_TEXTS", 3)
    with pytest.raises(ValueError, match="more than 3"):
        licenses.full_texts(spark, str(tmp_path))

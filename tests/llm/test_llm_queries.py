"""The opN queries themselves on a small folder: nulls, repeats, ties, long texts, extra and clashing columns, empty tables."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from test_llm_classifiers import brute_rule
from test_llm_joins import brute_cosine, brute_join
from tokenizers import Tokenizer

from evigraph.llm import queries

DOCUMENTS = (
    "doc_id long, text string, lang string, source string, n_chars long, told string, tokens int, n_tokens string, score string, path string, node long, _mix_rows int"
)
LABELS, PAGES, EMBEDDINGS = "doc_id long, quality long, toxic long, text string", "page_id long, url string, html string, rule int", "vec_id long, embedding array<float>, label long, node int"
COLUMNS = {
    "op1_mixing": {"doc_id": "bigint", "n_tokens": "bigint", "taken_tokens": "bigint", "epoch": "int"},
    "op2_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op3_url_filter": {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"},
    "op4_image_copies": {"vec_id": "bigint", "component_id": "bigint"},
    "op5_token_counts": {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"},
    "op6_ngram_join": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
    "op7_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op8_best_fit_packing": {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op9_license_scan": {"doc_id": "bigint", "license": "string"},
    "op10_lattice_near_dedup": {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"},
}


def rows_of():
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(300)]
    texts = [" ".join(rng.choices(words, k=rng.randint(3, 120))) for _ in range(60)]
    texts += [None, "", "  \n\t", "é", "12 !!", texts[0], texts[0] + " more", texts[1].upper(), "long " * 6000, "idiotic trash " + texts[3], "x" * 9000, "a <|endoftext|> b"]
    docs = [(i, t, ("en", "de", None)[i % 3], ("s1", "s1", "s2", None)[i % 4], len(t or ""), "x", 1, "y", "z", "p", 7, 8) for i, t in enumerate(texts)]
    docs += [docs[2], docs[2], (docs[5][0], "another text of that id", *docs[5][2:]), (None, texts[7], *docs[7][2:]), (None, None, *docs[7][2:])]
    labels = [(i, None if i == 4 else 1, None if i == 3 else int(i % 6 == 0), "t") for i in range(55)] + [(2, 1, 0, "t"), (2, 1, 0, "t"), (None, 0, 1, "t"), (9000, 1, 1, "t")]
    urls = [None, "", "no scheme", "http://com", "HTTP://A.example.ORG/es/x?y", "http://x.com/fr/1#z", "http://x.com/de/1", "ftp://y.net/a?b=c&d=e"]
    urls += [f"http://{rng.choice('abc')}.{rng.choice(['net', 'org', 'com'])}/{rng.choice(['fr', 'de', 'es'])}/{rng.randint(1, 40)}" for _ in range(80)] + ["http://hot.com/fr/1"] * 30
    pages = [(i, u, None, 3) for i, u in enumerate(urls)]
    r = np.random.default_rng(3)
    vectors = []
    for g in range(12):
        v = r.normal(size=64)
        vectors += [(len(vectors) + k, [float(np.float32(x)) for x in v + r.normal(size=64) * 0.05 * (k > 0)], g % 2, 1) for k in range(3)]
    vectors += [(100, vectors[0][1], 0, 1), (100, vectors[0][1], 0, 1), (101, vectors[0][1], None, 1), (102, None, 0, 1), (103, [0.0] * 64, 0, 1), (104, [float("nan")] * 64, 0, 1), (105, [], 0, 1), (None, vectors[3][1], 1, 1)]
    return docs, labels, pages, vectors


def write(spark, folder, docs, labels, pages, vectors):
    for name, rows, schema in (("documents", docs, DOCUMENTS), ("labels", labels, LABELS), ("pages", pages, PAGES), ("embeddings", vectors, EMBEDDINGS)):
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("small"), *rows_of())


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_empty_tables(spark, tmp_path, name):
    out = queries.queries()[name](spark, write(spark, tmp_path, [], [], [], []))
    kinds = dict(out.dtypes)
    assert {k: kinds.get(k) for k in COLUMNS[name]} == COLUMNS[name]
    assert out.collect() == []


def of(spark, small, name):
    return queries.queries()[name](spark, small).collect()


def part(key, n):
    return zlib.crc32(("" if key is None else str(key)).encode()) % n


def test_classifiers_answer_every_row(spark, small):
    docs = rows_of()[0]
    keys = sorted((str(d[0]) for d in docs))
    for name, n, held in (("op2_language_id", 4, 2), ("op7_toxicity", 5, 0)):
        rows = of(spark, small, name)
        assert sorted(str(r.doc_id) for r in rows) == keys
        assert all(r.held_out == (part(r.doc_id, n) == held) and 0 <= r.score <= 1 for r in rows)
    assert all(r.predicted == int(r.score >= 0.5) for r in rows)
    told = [r for r in of(spark, small, "op2_language_id") if r.doc_id in (60, 61, 62, 64)]
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in told)


def test_url_verdicts(spark, small):
    rows = of(spark, small, "op3_url_filter")
    urls = {p[0]: p[1] for p in rows_of()[2]}
    assert len(rows) == len(urls)
    assert all((r.host, r.path, r.rule) == brute_rule(urls[r.page_id]) and r.verdict in ("allow", "block") for r in rows)


def test_token_counts(spark, small):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sorted(str((d[0], len((d[1] or "").encode()), n := len(library.encode(d[1] or "", add_special_tokens=False).ids), n > 2048)) for d in rows_of()[0])
    assert sorted(str((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit)) for r in of(spark, small, "op5_token_counts")) == want


def test_join_and_near_vectors(spark, small):
    docs, _, _, vectors = rows_of()
    got = sorted((tuple(r[c] for c in ("doc_id", "n_shingles", "component_id")) for r in of(spark, small, "op6_ngram_join")), key=str)
    assert got == brute_join([(d[0], d[1]) for d in docs])
    keyed = [v for v in vectors if v[0] is not None]
    want = brute_cosine([(v[0], v[1], v[2]) for v in keyed])
    found = sorted(tuple(r[c] for c in ("vec_id", "n_links", "component_id", "kept")) for r in of(spark, small, "op10_lattice_near_dedup") if r.vec_id is not None)
    assert [f[0] for f in found] == [w[0] for w in want] and [f[2:] for f in found] == [w[2:] for w in want]
    images = of(spark, small, "op4_image_copies")
    assert len(images) == len(vectors)
    alone = {r.vec_id: r for r in images if r.vec_id in (102, 103, 104, 105)}
    assert all(r.component_id == k and r.n_copies == 0 for k, r in alone.items())


def test_packing(spark, small):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = of(spark, small, "op8_best_fit_packing")
    want = []
    for d in rows_of()[0]:
        ids = np.asarray([*library.encode(d[1] or "", add_special_tokens=False).ids, 0], dtype="<u4")
        first = len(ids) % 2048 or min(len(ids), 2048)
        for i, (a, b) in enumerate(zip([0, *range(first, len(ids), 2048)], [*range(first, len(ids) + 1, 2048)], strict=True)):
            want.append((d[0], i, a, b - a, zlib.crc32(ids[a:b].tobytes())))
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in rows)
    full: dict[int, list] = {}
    for r in rows:
        full.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in full.values():
        ends = [o + n for o, n in sorted(places)]
        assert [o for o, _ in sorted(places)] == [0, *ends[:-1]] and ends[-1] <= 2048


def test_pipeline_on_a_small_folder(spark, small):
    """Each stage against its rule on its own input: ids repeat, texts and keys are null."""
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{small}/documents.parquet")
    for k, (name, step) in enumerate(cp.STAGES):
        before = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        docs = cp.stage(step(spark, docs, small), "test")
        if k == 4:
            break
        after = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        assert docs.columns == cp.COLUMNS
        if name == "language ID":
            assert all(t and any(c.isalpha() for c in t) for _, t in after)
        if k < 2:
            assert len(after) >= 0.8 * sum(any(c.isalpha() for c in t or "") for _, t in before)
        if k == 2:
            label = brute_join([(i, t) for i, (_, t) in enumerate(before)])
            groups: dict[int, set] = {}
            for i, _, c in label:
                groups.setdefault(c, set()).add(i)
            kept = sorted(map(str, after))
            lowest = [min((before[i][0] is None, before[i][0] or 0, before[i][0]) for i in g)[2] for g in groups.values()]
            assert sorted(str(x) for x, _ in after) == sorted(map(str, lowest)) and len(set(kept)) == len(kept)
        if k == 3:
            words = sum(len(t.split()) for _, t in before)
            assert sum(len(t.split()) for _, t in after) == pytest.approx(0.9 * words, abs=40)
    assert {r.doc_id for r in docs.collect()} == {i for i, _ in after}


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline as cp

    assert cp.run(spark, write(spark, tmp_path, [], [], [], [])).collect() == []

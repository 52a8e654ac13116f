"""Operators 11 to 13: conversation trie, hidden Markov model, collocations."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import string
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from evigraph.llm import collocations, conversation_trie, hidden_markov, queries

TURNS = "conv_id long, turn long, role string, text string, pos string, digest int, sid int"


def brute_trie(rows):
    """Nodes as the contract has them, from prefixes as tuples."""
    said = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            said[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    said = {c: [(r, t) for _, r, t in sorted(v, key=lambda x: (x[0], x[1].encode(), x[2].encode()))] for c, v in said.items()}
    built = {}
    for c in said:
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(said.get(c - c % 5, [])[:h] + said[c][h:])
    members = defaultdict(list)
    for c, path in built.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, of in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += (len(of) - 1) * len(p[-1][1].encode()) if p else 0
    out = set()
    for p, of in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in of if len(built[c]) == len(p)))
        out.add((min(of), len(p), min(members[p[:-1]]) if p else None, len(of), kids[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def trie_rows(spark, rows, tmp_path):
    spark.createDataFrame(rows, TURNS).write.parquet(f"{tmp_path}/conversations.parquet")
    made = queries.op11_conversation_trie(spark, str(tmp_path))
    assert dict(made.dtypes) == {**dict.fromkeys(["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"], "bigint"), "ends_sha256": "string"}
    return [tuple(r[c] for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")) for r in made.collect()]


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_equals_brute_force(spark, tmp_path, seed, monkeypatch):
    monkeypatch.setattr(conversation_trie, "BLOCK", 7)
    monkeypatch.setattr(conversation_trie, "AHEAD", 2)
    rng, rows = random.Random(seed), []
    for c in rng.sample(range(200), 70):
        n = rng.choice([1, 2, 3, 5, 9, 14])
        if rng.random() < 0.4:  # long shared openings, copies among them
            rows += [(c, i, "user", f"shared {i} é" * (i % 4), "x", 1, 2) for i in range(rng.choice([n, 30, 30, 31]))]
        else:
            rows += [(c, rng.choice([i, i, 0, None]), rng.choice(["user", None, "a"]), rng.choice(["", "yes", "no", None]), "x", 1, 2) for i in range(n)]
    rows += [rows[0], rows[0], (None, 1, "user", "lost", "x", 1, 2), (3_000_000_000, None, None, None, "x", 1, 2), (901, 1, "user", "x" * 100_000, "x", 1, 2)]
    made = trie_rows(spark, rows, tmp_path)
    assert len(made) == len(set(made)) and set(made) == brute_trie(rows)


@pytest.mark.parametrize("rows", [[], [(5, 0, "u", "t", "x", 1, 2)], [(7, 0, "u", "only", "x", 1, 2)], [(c, i, "u", f"{i}", "x", 1, 2) for c in (0, 10, 20) for i in range(40)]], ids=["empty", "one", "turnless", "copies"])
def test_trie_of_few(spark, tmp_path, rows):
    assert set(trie_rows(spark, rows, tmp_path)) == brute_trie(rows)


# --- hidden Markov model ---


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(5)
    k, used = 3, [0, 1, 2, hidden_markov.END]
    emits = np.full((hidden_markov.SYMBOLS, k), 1e-12)
    emits[used] = rng.random((4, k))
    emits /= emits.sum(axis=0)
    moves = rng.random((k, k))
    model = hidden_markov.Model(np.tile(rng.dirichlet(np.ones(k)), (2, 1)), moves / moves.sum(axis=1, keepdims=True), emits)
    texts = [[0, 1, 2, hidden_markov.END], [hidden_markov.END], [2, 2, 0, 1, 1, hidden_markov.END], [0, hidden_markov.END]]
    logs, sums = [], hidden_markov.Sums.empty(k)
    want = hidden_markov.Sums.empty(k)
    for text in texts:
        paths = {}
        for path in itertools.product(range(k), repeat=len(text)):
            p = model.starts[0, path[0]] * emits[text[0], path[0]]
            for i in range(1, len(text)):
                p *= model.moves[path[i - 1], path[i]] * emits[text[i], path[i]]
            paths[path] = p
        total = sum(paths.values())
        logs.append(math.log10(total))
        for path, p in paths.items():
            want.starts[0, path[0]] += p / total
            for i, s in enumerate(path):
                want.emits[text[i], s] += p / total
                if i:
                    want.moves[path[i - 1], s] += p / total
    flat, lengths = np.array(sum(texts, []), dtype=np.uint16), np.array([len(t) for t in texts])
    assert np.allclose(model.likelihoods(flat, lengths), logs)
    model.expect(flat, lengths, np.zeros(4, dtype=bool), sums)
    assert np.allclose(sums.starts, want.starts, atol=1e-4) and np.allclose(sums.moves, want.moves, atol=1e-4) and np.allclose(sums.emits, want.emits, atol=1e-4)
    assert abs(sums.log - sum(logs)) < 1e-3
    back = hidden_markov.Sums.of_rows(*sums.rows())
    assert np.allclose(back.emits, sums.emits) and np.allclose(back.moves, sums.moves) and back.log == sums.log


def test_long_text_is_scored_whole():
    rng = np.random.default_rng(6)
    model = hidden_markov.Model.random(np.full(hidden_markov.SYMBOLS, 1 / hidden_markov.SYMBOLS), 4)
    text = rng.integers(0, hidden_markov.SYMBOLS, 5000).astype(np.uint16)
    state, want = model.starts[0], 0.0
    for i, s in enumerate(text):
        state = (state if not i else state @ model.moves) * model.emits[s]
        want += math.log10(state.sum())
        state = state / state.sum()
    assert np.allclose(model.likelihoods(np.concatenate([text, text[:3]]), np.array([5000, 3]))[0], want)
    sizes, later = hidden_markov.segments(np.array([1, 1024, 1025, 5000]))
    assert sizes.sum() == 7050 and sizes.max() == 1024 and later.tolist() == [False, False, False, True, False, True, True, True, True]


def lm_rows():
    rng = random.Random(4)
    tongues = [["".join(rng.choices(letters, k=rng.randint(1, 5))) for _ in range(60)] for letters in ("abcde", "vwxyz")]
    docs = [(i, " ".join(rng.choices(tongues[i % 2], k=rng.randint(1, 80)))) for i in range(300)]
    docs += [(400, None), (401, ""), (402, " \n\t\x0b "), (403, "É É x \x1c y"), (404, "w" * 70 + " " + "w" * 70), (405, "new " * 3000), (406, "ABC abc"), (None, "abc"), (None, None), docs[3], docs[3], (docs[4][0], "other")]
    return [(i, t, "x", 1.0, 5) for i, t in docs]


def brute_base(rows):
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)))
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1
    counts = Counter(w for i, t, *_ in rows if not held(i) for w in [*words(t), None])
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, t, *_ in rows:
        tokens = [*words(t), None]
        out.append((i, held(i), len(tokens), sum(counts[w] > 0 for w in tokens), n, round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens), 6)))
    return counts, out


@pytest.mark.parametrize("local", [1 << 18, 20])
def test_language_model_query(spark, tmp_path, monkeypatch, local):
    monkeypatch.setattr(hidden_markov, "LOCAL", local)  # with few local words most counts come by the join
    rows = lm_rows()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, word int").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    made = queries.op12_hidden_markov(spark, str(tmp_path))
    assert made.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("n_tokens", "bigint"), ("n_known", "bigint"), ("train_tokens", "bigint"), ("base_score", "double"), ("score", "double")]
    got = made.collect()
    _, want = brute_base(rows)
    order = lambda x: tuple((v is not None, v) for v in x)
    assert sorted(((r[0], r[1], r[2], r[3], r[4], round(r[5], 6)) for r in got), key=order) == sorted(want, key=order)
    assert all(math.isfinite(r["score"]) and r["score"] <= 0 for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 300]
    if local > 20:
        assert sum(r["score"] for r in held) > 0.95 * sum(r["base_score"] for r in held)  # two tongues: states tell them apart


def test_language_model_sums_to_one(spark, monkeypatch):
    """Over all words and the unseen ones of each class, the probabilities of the next token are one."""
    docs = spark.createDataFrame([(f"a b c{i % 7} d",) for i in range(40)], "text string")
    known = hidden_markov.vocabulary(docs)
    look = known.lookup
    counts = {r["word"].encode(): r["n"] for r in known.counts.collect()}
    model = hidden_markov.baum_welch(hidden_markov.encode(docs, known, []), known, states=3, rounds=2)
    assert np.allclose(model.emits.sum(axis=0), 1, atol=1e-6) and np.allclose(model.moves.sum(axis=1), 1)
    assert np.allclose(look.class_size, 0.5)  # every word has a symbol of its own here: classes hold what was never seen
    monkeypatch.setattr(hidden_markov, "LOCAL", 5)
    part = hidden_markov.vocabulary(docs).lookup
    assert part.words == [b"a", b"b", b"d"]
    rest = Counter(hidden_markov.class_of(w) for w in counts if w not in part.words)
    of = {c: sum(n for w, n in counts.items() if w not in part.words and hidden_markov.class_of(w) == c) for c in rest}
    assert all(part.class_size[c] == of[c] + 0.5 * (v + 1) for c, v in rest.items())  # words and half a count each, and the unseen
    assert known.tokens == sum(counts.values()) + 40 and known.distinct == len(counts) + 1
    assert model.logs == sorted(model.logs)


def test_language_model_without_training(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    known = hidden_markov.vocabulary(empty)
    coded = hidden_markov.encode(spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string"), known, ["doc_id"])
    model = hidden_markov.baum_welch(coded.where("false"), known)
    rows = {r["doc_id"]: r for r in hidden_markov.score(coded, model, known, ["doc_id"]).collect()}
    assert rows[1]["base_score"] == 0 and rows[1]["n_known"] == 0 and rows[1]["train_tokens"] == 0 and rows[2]["n_tokens"] == 1 and rows[2]["score"] < 0
    assert hidden_markov.score(hidden_markov.encode(empty, known, ["doc_id"]), model, known, ["doc_id"]).collect() == []


# --- collocations ---


def brute_collocations(rows, least, top):
    low = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    f, n = defaultdict(Counter), Counter()
    for text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(low)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = set()
    for lang, c in f.items():
        found = {p: a for p, a in c.items() if a >= least and len(p) > 1}
        over = Counter()
        for p, a in found.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    over[p[i : i + size]] = max(over[p[i : i + size]], a)
        rows_ = []
        for p, a in found.items():
            if p in over and 100 * over[p] >= 80 * a:
                continue
            score, _, l, r = min((2000000 * a // (c[p[:k]] + c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            rows_.append((score, a, " ".join(p), l, r))
        rows_.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out |= {(lang, i, p, a, l, r, n[lang], s) for i, (s, a, p, l, r) in enumerate(rows_[:top], 1)}
    return out


def phrase_rows():
    rng = random.Random(8)
    words = [*"abcdefgh", "ñandú", "x\x1cy", "É", " ", "=", "￿"]
    rows = [(" ".join(rng.choices(words, k=rng.randint(0, 60))).replace(" c", rng.choice([" c", ". c", "\tc", "\x0bc", "  C"])), rng.choice(["en", "de", None, "und"])) for _ in range(500)]
    rows += [(None, "en"), ("", "fr"), ("...", "fr"), ("a a a a a a", "fr"), ("of the " * 20_000, "en"), ("z" * 50_000, "en"), rows[0], rows[0]]
    return [(*r, 1, "p") for r in rows]


@pytest.mark.parametrize(("bits", "flush"), [(16, 250_000), (6, 5)])
def test_collocations_equal_brute_force(spark, tmp_path, monkeypatch, bits, flush):
    """A sketch too small to prune anything, and tiny hand-overs, change no result."""
    monkeypatch.setattr(collocations, "_FLUSH", flush)
    monkeypatch.setattr(collocations, "_HELD", flush)
    rows = phrase_rows()
    docs = spark.createDataFrame(rows, "text string, lang string, f int, phrase string").repartition(3)
    made = collocations.collocations(docs, least=5, top=60, bits=bits)
    assert made.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and {t for c, t in made.dtypes if c not in ("lang", "phrase")} == {"bigint"}
    assert {tuple(r) for r in made.collect()} == brute_collocations(rows, 5, 60)


def test_collocations_query(spark, tmp_path):
    rows = phrase_rows()
    spark.createDataFrame(rows, "text string, lang string, f int, phrase string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {tuple(r) for r in queries.op13_collocations(spark, str(tmp_path)).collect()} == brute_collocations(rows, 30, 2000)


def test_collocations_of_nothing(spark):
    assert collocations.collocations(spark.createDataFrame([], "text string, lang string"), bits=10).collect() == []
    assert collocations.collocations(spark.createDataFrame([(None, None), (" , ", "en")], "text string, lang string"), bits=10).collect() == []


def test_sketch_bounds_from_above(spark):
    texts = spark.createDataFrame([("en", "a b a b c"), ("en", "a b a"), ("de", "a b")], "lang string, text string").repartition(3)
    short = collocations.sketch(texts, {1: 10, 2: 12}, collocations.Packed({}, {}), 2)
    bounds = (short | collocations.sketch(texts, {3: 11, 4: 11}, short, 2)).counters
    block = collocations.Block("en", [b"a b a b c", b"a b a"])
    lists = [[b"a", b"b", b"a", b"b", b"c"], [b"a", b"b", b"a"]]
    times = lambda phrase, n: sum(w[j : j + n] == phrase for w in lists for j in range(len(w) - n + 1))
    for n, place, hashed in block.phrases({}, 2):
        for i, h in zip(place.tolist(), hashed, strict=True):
            phrase = block.tokens[i : i + n]
            assert n > 2 or bounds[n][h >> collocations._shift(bounds[n])] >= times(phrase, n)
    assert {(b" ".join(block.tokens[i : i + 3])) for n, place, _ in block.phrases(bounds, 2) if n == 3 for i in place} >= {b"a b a"}
    assert dict(block.count(bounds, 2)).items() >= {b"a b": 3, b"b a": 2, b"a b a": 2, b"a": 4, b"": 8}.items()
    full = [pa.record_batch([pa.array([1], pa.int32()), pa.array([0], pa.int32()), pa.array([zlib.compress(bytes([200] * 8))], pa.binary())], ["words", "chunk", "counters"])] * 3
    (out,) = collocations._summed(iter(full))
    assert zlib.decompress(out.column(2)[0].as_py()) == bytes([255] * 8)

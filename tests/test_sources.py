"""Folders, books, feeds, variants and the first topic pairs."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from evigraph.operators import artefacts, graph
from evigraph.sources import files


def test_sources_in_order_with_a_missing_one(spark, tmp_path):
    for name, text in {"tree/b.TXT": "b\n", "tree/a/z.md": "z", "tree/a/skip.py": "no", "own.data": "any ending"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    with pytest.warns(UserWarning, match="nowhere"):
        found = files.read_sources(spark, [str(tmp_path / "own.data"), str(tmp_path / "nowhere"), str(tmp_path / "tree"), str(tmp_path / "own.data")])
    assert [(r.source.rsplit("/", 1)[1], r.text) for r in found.orderBy("source_no").collect()] == [("own.data", "any ending"), ("z.md", "z"), ("b.TXT", "b\n"), ("own.data", "any ending")]
    with pytest.warns(UserWarning):
        assert files.read_sources(spark, [str(tmp_path / "nowhere")]).collect() == []


def test_books_from_cache_and_files(spark, tmp_path):
    (tmp_path / "cache").mkdir()
    address = "https://gutenberg.org/files/long-path-to-the-book/1342-0.txt"
    name = spark.range(1).select(files.cache_name(F.lit(address))).first()[0]
    assert name == re.sub(r"[^\w]", "_", address[-40:]) + ".txt"
    (tmp_path / "cache" / name).write_text("x\n*** START OF THE BOOK ***\nbody\n*** END OF THE BOOK ***\ny")
    (tmp_path / "My.Own.book.txt").write_text("mine")
    listed = spark.createDataFrame([(address, None, "A", "gutenberg"), (str(tmp_path / "My.Own.book.txt"), "", None, "local_file"), ("https://x/none", "t", "B", "url")], "source string, title string, author string, kind string")
    got = {r.kind: r for r in files.read_books(spark, listed, str(tmp_path / "cache")).collect()}
    assert set(got) == {"gutenberg", "local_file"}  # what was not downloaded is not there
    assert (got["gutenberg"].title, got["gutenberg"].text, got["gutenberg"].char_count, got["gutenberg"].source_url) == ("1342-0.txt", "body", 4, address)
    assert (got["local_file"].title, got["local_file"].text, got["local_file"].source_url) == ("My.Own.book", "mine", None)


def test_episode_numbers_and_names(spark):
    rows = [("f", 0, "Wed, 06 May 2026 10:00:00 GMT", " New: Things — and Ünïcode! ", "http://h/a.OGG?x"), ("f", 1, "someday soon", "Old", None)]
    items = spark.createDataFrame([(*r, "1:00", "d" * 600) for r in rows], "feed string, pos int, pub_date string, title string, audio_url string, duration string, description string")
    got = {r.ep_num: r for r in files.episodes(items, "feed", "pos").collect()}
    assert got[2].file_name == "2026-05-06_ep002_new_things_and_ünïcode.ogg" and got[2].title == "New: Things — and Ünïcode!" and len(got[2].description) == 500
    assert got[1].file_name == "someday so_ep001_old.mp3"


def test_variants_keep_unknown_keys(spark):
    texts = ['x {"a": 1, "b": {"c": [1, "two"]}, "z": null} y', "{broken", "none", None, '{"a": "no number"}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", artefacts.variant_object(F.col("t")).alias("v"))
    got = {r.i: r for r in artefacts.variant_fields(df, "v", {"a": "$.a bigint", "second": "$.b.c[1] string"}).collect()}
    assert (got[0].a, got[0].second, got[0].rest) == (1, "two", '{"a":1,"b":{"c":[1,"two"]},"z":null}')
    assert [got[i].rest for i in (1, 2, 3)] == [None] * 3 and got[4].a is None and got[4].rest == '{"a":"no number"}'


@pytest.mark.parametrize("most", [1, 7, 200])
def test_first_topic_pairs_equal_all_pairs_cut(spark, most):
    rng = random.Random(11)
    claims = spark.createDataFrame([(rng.randint(0, 6), f"c{rng.randint(0, 9)}") for _ in range(60)] + [(0, "lone"), (0, "lone")], "speaker int, concept string")
    relations = spark.createDataFrame([(f"t{i % 5}", "R", f"c{rng.randint(0, 9)}") for i in range(25)] + [("t9", "R", "lone")], "src string, rel string, dst string")
    topics = spark.createDataFrame([(f"t{i}", [0.5, 0.9][i % 2]) for i in range(10)], "topic string, confidence double")
    order = [F.desc("confidence"), "topic", "speaker1", "claim1", "speaker2", "claim2"]
    want = graph.topic_pairs(claims, relations, ["R"], topics).orderBy(*order).limit(most)
    got = graph.first_topic_pairs(claims, relations, ["R"], topics, most)
    columns = ["topic", "confidence", "speaker1", "claim1", "speaker2", "claim2"]
    assert got.select(columns).collect() == want.select(columns).collect() and got.count() == min(most, want.count())

"""Document parts, speakers, linking, segmentation, queue decisions on small cases."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from evigraph.functions import documents
from evigraph.operators import layout, linking, registry, speakers


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).first()[0]


def test_document_parts(spark):
    df = spark.createDataFrame([(1, "Intro\n5 Conclusion\nWe did.\nIt works.\n6 References\nx"), (2, "0123456789"), (3, "")], "k int, text string")
    assert {r.k: r.conclusion for r in documents.conclusions(df, "k").collect()} == {1: "We did.\nIt works.", 2: "789", 3: ""}
    assert one(spark, "a\n\n## キーワード\n\n`AI` / `機械学習` / x\n\nb", documents.keywords) == ["AI", "機械学習", "x"]
    assert one(spark, "none", documents.keywords) == []
    got = one(spark, "<think>no</think>TLDR: short\n- 要点1: one\n- two\n- two\nPOINTS:", documents.parse_summary)
    assert (got.tldr, got.points) == ("short", ["one", "two"])
    assert one(spark, "\nfirst line\nPOINTS", documents.parse_summary).tldr == "first line"
    assert one(spark, "doc \n", lambda c: documents.add_section(c, "## H", F.lit("b"))) == "doc\n\n## H\n\nb\n"
    assert one(spark, "doc ## H", lambda c: documents.add_section(c, "## H", F.lit("b"))) == "doc ## H"
    assert one(spark, "a\n## 概要\nb", lambda c: documents.insert_before(c, "## 概要", F.lit("NEW"))) == "a\nNEW\n\n## 概要\nb"
    assert one(spark, "abcdefghij", lambda c: documents.three_points(c, 4)) == ["abcd", "defg", "ghij"]
    assert [tuple(one(spark, v, documents.halves, "array<int>")) for v in ([1], [1, 2, 3], [])] == [([1], []), ([1], [2, 3]), ([], [])]
    assert one(spark, "abcdef", lambda c: documents.for_prompt(c, 3, "[cut]")) == "abc[cut]"
    assert one(spark, ["a", " ", "c"], documents.numbered_notes, "array<string>") == "[チャンク 1] a\n\n[チャンク 3] c"
    assert one(spark, "---\nkg_sources:\n  - a\n  - \"b\"\ntitle: x\n---", lambda c: documents.list_field(c, "kg_sources")) == ["a", "b"]
    assert one(spark, ["A", "B", "C", "D"], documents.byline, "array<string>") == "A, B, C et al."


def test_digest_feed_contents_glossary(spark):
    papers = spark.createDataFrame([("d", 1, "T", ["A"], ["c"], "u", "s", datetime(2024, 3, 5)), ("d", 0, "S", ["B"], ["c"], "v", "t", datetime(2024, 3, 5))], "day string, n int, title string, authors array<string>, categories array<string>, url string, summary string, published timestamp")
    text = documents.digest(papers, ["day"], "n").first().digest
    assert text.startswith("## 1. S\n\nB · c · 2024年3月5日\n\nt\n\n<v>") and "## 2. T" in text
    feed = spark.createDataFrame([("x", 0, 0, "1v2", datetime(2024, 1, 1)), ("x", 0, 1, "2", datetime(2024, 1, 3)), ("y", 1, 0, "1v1", datetime(2024, 1, 2)), ("y", 1, 1, "3", None)], "category string, category_no int, pos int, id string, published timestamp")
    assert [(r.id, r.category) for r in documents.recent_papers(feed, 2).collect()] == [("2", "x"), ("1", "x"), ("3", "y")]
    rows = spark.createDataFrame([("b", 0, 1, "<i>Intro</i>"), ("b", 1, 1, "References"), ("b", 2, 4, "deep"), ("b", 3, 2, "Two")], "book string, pos int, level int, line string")
    assert [(r.num, r.title) for r in documents.contents(rows, ["book"], ["references"]).orderBy("num").collect()] == [(1, "Intro"), (2, "Two")]
    texts = spark.createDataFrame([(1, 0, "Big Model (BM) and (x)"), (1, 1, "again (BM) (GPU2)")], "k int, n int, text string")
    assert {(r.acronym, r.first) for r in documents.glossary(texts, "k", "n").collect()} == {("BM", 0), ("GPU2", 1)}


def test_speakers(spark):
    assert one(spark, "[A] x\n[B] y\n[A] z\nt [C]", speakers.labels) == ["A", "B"]
    assert [one(spark, t, speakers.guest_of_video) for t in ("Jensen Huang: NVIDIA", "State of AI in 2026: x", "no mark", "Ann Lee — a talk")] == ["Jensen Huang", None, None, "Ann Lee"]
    assert [one(spark, t, speakers.guest_of_episode) for t in ("#123 – Adam Smith – talk", "Sam Altman: x", "Alone: x", "plain")] == ["Adam Smith", "Sam Altman", "", ""]
    rows = [("―― **Ann Lee** x\n―― **The Guest**", "Bob Ray: t", ""), ("", "Bob Ray: t", ""), ("", "t", "a conversation with Cid Ono, who"), ("", "t", "none"), (None, None, None)]
    df = spark.createDataFrame(rows, "s string, t string, r string").select(speakers.speakers(F.col("s"), F.col("t"), F.col("r")).alias("n"))
    assert [r.n for r in df.collect()] == [["Ann Lee"], ["Bob Ray"], ["Cid Ono"], [], []]
    entities = spark.createDataFrame([("s", "c1", "claim", "[Ann] says", 0.5), ("s", "c2", "concept", "[Zed] x", 0.5), ("s", "c3", "person", "[Ann]", 0.5), ("s", "c4", "claim", "no", 0.5)], "source_id string, name string, type string, description string, confidence double")
    known = spark.createDataFrame([("s", "Bob Ann", 1), ("s", "Ann Lee", 0)], "source_id string, speaker string, ord int")
    assert {(r.subject, r.object) for r in speakers.attributed_claims(entities, known).collect()} == {("Ann Lee", "c1"), ("Zed", "c2")}
    assert one(spark, "The Guest", lambda c: speakers.canonical_speaker(c, F.lit("X"))) == "X"
    assert one(spark, "[the host] said [x]", lambda c: speakers.canonical_prefix(c, F.lit("X"))) == "[X] said [x]"
    assert speakers.with_speakers(entities, known).count() == 6
    fixed = speakers.normalized(spark.createDataFrame([("ann lea",), ("Guest",)], "name string"), known.select(F.col("speaker").alias("canonical"), "ord"), "Ann Lee")
    assert [r.canonical for r in fixed.collect()] == ["Ann Lee", "Ann Lee"]
    assert speakers.first_per_speaker(known, 1, ["ord"], "source_id").first().speaker == "Ann Lee"


def test_linking(spark):
    queries = spark.createDataFrame([("Dune", "concept"), ("Dune", "place"), ("deep nets", "concept"), ("Ada", "person"), ("old", "theory")], "query string, type string")
    index = spark.createDataFrame([("Dune film", "q1"), ("Dune", "q2"), ("deep x", "q3")], "title string, qid string")
    cache = spark.createDataFrame([("old", "Old", "q9", 1.0, "local", "t0")], "query string, canonical_name string, qid string, confidence double, method string, fetched_at string")
    people = spark.createDataFrame([("Ada film", "p1")], "title string, qid string")
    got = {(r.query, r.type): (r.canonical_name, r.method) for r in linking.resolve(queries, index, cache, people).collect()}
    assert got == {("Dune", "concept"): ("Dune", "local"), ("Dune", "place"): (None, "not_found"), ("deep nets", "concept"): (None, "not_found"), ("Ada", "person"): ("Ada film", "remote"), ("old", "theory"): ("Old", "local")}
    assert linking.cached(cache, linking.resolve(queries, index, cache, people), "t1").count() == 4


def test_segmentation(spark):
    rows = [
        (0, 1, "text", "A Paper", 20.0, False), (1, 1, "text", "Ann, University of X", 20.0, False), (2, 1, "text", "Abstract", 10.0, True), (3, 1, "text", "We inter-\nnational do\nthings.", 10.0, False),
        (4, 1, "text", "1.2 Method", 10.0, False), (5, 2, "text", "Long body text of the paper that goes on.", 10.0, False), (6, 2, "image", "", 0.0, False), (7, 2, "text", "Figure 1: a", 10.0, False),
        (8, 3, "text", "References", 10.0, True), (9, 3, "text", "[1] x", 10.0, False), (10, 3, "image", "", 0.0, False),
    ]
    df = spark.createDataFrame([(1, *r[:3], 0.0, 100.0, *r[3:]) for r in rows], "doc int, pos int, page int, kind string, x0 double, x1 double, text string, font_size double, bold boolean")
    sizes = layout.upper_median(df.where("kind = 'text'"), ["doc"], "font_size")
    got = layout.numbered_blocks(layout.segmented(df, sizes)).orderBy("pos").collect()
    assert [(r.id, r.type, r.level) for r in got] == [
        ("b0001", "heading", 1), ("b0002", "paragraph", None), ("b0003", "heading", 2), ("b0004", "abstract", None), ("b0005", "heading", 2), ("b0006", "paragraph", None), ("b0007", "figure", None), ("b0008", "caption", None),
    ]
    assert got[3].text == "We international do things." and got[1].skip_translate and got[7].label == "Figure 1"
    assert layout.segmented(df, sizes, skip_references=False).where("type = 'reference'").count() == 1
    counted = layout.diagnostics(spark.createDataFrame([(1, 0, "paragraph", "open"), (1, 1, "figure", ""), (1, 2, "paragraph", "end.")], "doc int, pos int, type string, text string")).first()
    assert (counted.paragraph, counted.figure, counted.dangling) == (2, 1, 1)


def test_queue_and_decisions(spark):
    state = spark.createDataFrame([("a", "pending", 1, 100), ("b", "pending", 2, None), ("c", "pending", 3, 9999), ("d", "done", 0, 9999)], "id string, status string, added_at int, duration int")
    assert [(r.id, r.status, r.error) for r in registry.drain(state, 2).collect()] == [("a", "failed", "short_video:100s"), ("b", "processing", None)]
    runs = spark.createDataFrame([("a", "1", 3), ("a", "2", 0), ("b", "1", 1)], "id string, run string, n_files int")
    assert [tuple(r) for r in registry.unpublished(runs, spark.createDataFrame([("b",)], "id string")).collect()] == [("a", "1")]
    cases = [(50.0, None, "redo"), (90.0, None, "publish"), (80.0, None, "review"), (80.0, 'x {"action": "publish", "reason": "r"}', "publish"), (99.0, '{"action": "burn"}', "review"), (99.0, "junk", "review")]
    df = spark.createDataFrame([c[:2] for c in cases], "s double, a string").select(registry.decision(F.col("s"), F.col("a")).alias("d"))
    assert [r.d.action for r in df.collect()] == [c[2] for c in cases]
    assert [r.id for r in registry.added(state, state.where("id = 'a'"), "id").collect()] == ["b", "c", "d"]

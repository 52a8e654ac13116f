"""Operators on small cases: retrieval, parsing, graph, layout, normalisation, loops, streams."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from evigraph.operators import consensus, export, graph, layout, normalize, parse, registry, retrieval, timeline
from evigraph.plans import catalog_streams, providers, refine
from evigraph.streaming import feeds, registry_state


def test_bm25_on_tiny_corpora(spark):
    claims = spark.createDataFrame([(1, "cat dog")], "claim_id long, claim string")
    one = spark.createDataFrame([(1, "cat")], "chunk_id long, chunk string")
    two = spark.createDataFrame([(1, "cat"), (2, "cow")], "chunk_id long, chunk string")
    five = spark.createDataFrame([(i, t) for i, t in enumerate(["cat x", "cow", "cow y", "dog dog", "hen"])], "chunk_id long, chunk string")
    assert retrieval.top_k(claims, one).count() == 0 and retrieval.top_k(claims, two).count() == 0
    got = retrieval.top_k(claims, five, 2).orderBy("rank").collect()
    idf, average = math.log(4.5) - math.log(1.5), 8 / 5
    assert [r.chunk_id for r in got] == [3, 0]
    assert math.isclose(got[0].score, idf * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 2 / average)), abs_tol=1e-6)


def test_verdicts(spark):
    cases = {
        'x {"verdict": "Supported", "reason": "r"}': ("supported", "r"), '{"verdict": "no"} partial。 rest': ("partial", '{"verdict": "no"} partial'),
        "unsupported claim": ("supported", "unsupported claim"), '{"verdict": "contradicted"': ("contradicted", '{"verdict": "contradicted"'), "": ("unverifiable", ""),
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", retrieval.parse_verdict(F.col("t")).alias("v"))
    assert {r.t: tuple(r.v) for r in df.collect()} == cases
    scored = retrieval.confidence(spark.createDataFrame([("a", "supported"), ("a", "partial"), ("b", "unverifiable")], "k string, verdict string"), ["k"])
    assert {r.k: r.score for r in scored.collect()} == {"a": 75.0, "b": 0.0}
    kept = spark.createDataFrame([("0123456789", "01234"), ("0123456789", "0123456"), ("a", None)], "o string, n string").select(retrieval.keep_rewrite(F.col("o"), F.col("n")))
    assert [r[0] for r in kept.collect()] == ["0123456789", "0123456", "a"]


def test_parsing(spark):
    df = spark.createDataFrame([("a [1, \"x\", \"\", null] b",), ("[bad",), ("none",)], "t string")
    assert [r[0] for r in df.select(parse.string_array(F.col("t"))).collect()] == [["1", "x"], [], []]
    lines = spark.createDataFrame([("1. a claim of size\n- short\n以下は about it all\n• another long claim",)], "t string")
    assert lines.select(parse.claim_lines(F.col("t"))).first()[0] == ["a claim of size", "another long claim"]
    raw = 'x {"entities":[{"name":" ","type":"x"},{"name":"Bob","type":"PERSON","confidence":true},{"name":"bob","confidence":"9"}],"triples":[{"subject":"Bob","predicate":"zaps","object":"Al"},{"subject":"bob","predicate":"uses","object":"BOB"}]} y'
    answers = spark.createDataFrame([(1, raw), (2, "junk")], "k int, raw string")
    found = parse.entities(answers, ["k"])
    assert [(r.name, r.type, r.confidence) for r in found.orderBy("pos").collect()] == [("Bob", "person", 1.0), ("bob", "concept", 0.8)]
    assert parse.dedupe_entities(found, ["k"], ["pos"]).count() == 1
    assert parse.triples(answers, found, ["k"], ["k"]).count() == 0  # Al is unknown, the other is a loop
    known = spark.createDataFrame([(1, "BOB"), (1, "al")], "k int, name string")
    assert [(r.subject, r.predicate) for r in parse.triples(answers, known, ["k"], ["k"]).collect()] == [("Bob", "related_to")]
    assert parse.triples(answers, known, ["k"], ["k"], podcast=True).first().predicate == "is_a"
    batch = spark.createDataFrame([('[{"i":1,"ja":"b"},{"i":0,"ja":"a"}]', 2), ('[{"i":0,"ja":"a"}]', 2), ('[{"i":0,"ja":"a"},{"i":0,"ja":"b"}]', 2)], "t string, n int")
    assert [r[0] for r in batch.select(parse.indexed_batch(F.col("t"), F.col("n"))).collect()] == [["a", "b"], None, None]


def test_graph_and_normalisation(spark):
    log = spark.createDataFrame([("A", "x", "d", 0.5, 1), ("A", "y", "long", 0.4, 2), ("a", "z", "", 0.1, 3)], "name string, type string, description string, confidence double, seq int")
    assert {tuple(r) for r in graph.upsert_entities(log).collect()} == {("A", "x", 0.5, "long"), ("a", "z", 0.1, "")}
    edges = spark.createDataFrame([("A", "says-it", "a", 0.2, "s1", 1), ("A", "says-it", "a", 0.9, "s2", 2), ("A", "x", "zz", 1.0, "s1", 3)], "src string, rel string, dst string, confidence double, source_id string, seq int")
    edges = edges.withColumn("rel", graph.relation_name(F.col("rel")))
    merged = graph.upsert_relations(edges, log)
    assert [tuple(r) for r in merged.collect()] == [("A", "SAYS_IT", "a", 0.9, "s1")]
    assert graph.clear_source(merged, "s1").count() == 0
    names = spark.createDataFrame([("Graph Net (GN)",), ("graph net",), ("GN",), ("GNs",), ("Other",)], "name string")
    groups = {r.key: (r.names, r.canonical) for r in normalize.string_duplicates(names).collect()}
    assert groups == {"graph net": (["Graph Net (GN)", "graph net"], "Graph Net (GN)")}
    assert [r.canonical for r in normalize.acronym_duplicates(names).collect()] == ["Graph Net (GN)"]
    mapping = normalize.merge_mapping(normalize.string_duplicates(names))
    entities = spark.createDataFrame([("graph net", "t1", "d1", 0.9), ("Graph Net (GN)", "t2", "d2", 0.1)], "name string, type string, description string, confidence double")
    assert [tuple(r) for r in normalize.rename_entities(entities, mapping).collect()] == [("Graph Net (GN)", "t2", "d2", 0.9)]
    relations = spark.createDataFrame([("graph net", "R", "x", 0.3, "s"), ("Graph Net (GN)", "R", "x", 0.1, "q"), ("graph net", "R", "Graph Net (GN)", 0.5, "s")], "src string, rel string, dst string, confidence double, source_id string")
    assert {(r.src, r.dst, r.confidence) for r in normalize.rename_relations(relations, mapping).collect()} == {("Graph Net (GN)", "x", 0.1), ("Graph Net (GN)", "Graph Net (GN)", 0.5)}
    known = spark.createDataFrame([("Ada Lovelace", 1), ("Alan Turing", 2)], "canonical string, ord int")
    close = normalize.closest(spark.createDataFrame([("ada lovelase",), ("Alan Turing",), ("Bob",), (None,)], "name string"), known)
    assert [r.canonical for r in close.collect()] == ["Ada Lovelace", "Alan Turing", "Bob", None]
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.1]), (3, [0.0, 0.0])], "id int, v array<double>")
    assert [(r.a, r.b) for r in normalize.near_pairs(vectors, "id", "v").collect()] == [(1, 2)]
    posts = spark.range(1).select(export.short_post(F.lit("h"), F.lit("text。 more"), F.lit("f"), 7).alias("cut"), export.short_post(F.lit("h"), F.lit("text"), F.lit("f")).alias("whole")).first()
    assert (posts["cut"], posts["whole"]) == ("htext…f", "htextf")


def test_intervals_ignore_touching_and_empty_segments(spark):
    segments = spark.createDataFrame([(1, 0, 0.0, 10.0), (1, 1, 20.0, 20.0), (1, 2, 30.0, 40.0), (1, 3, 5.0, 7000.0)], "k int, segment int, start double, end double")
    turns = spark.createDataFrame([(1, 0, -5.0, 5.0, "A"), (1, 1, 5.0, 15.0, "B"), (1, 2, 19.0, 21.0, "C"), (1, 3, 40.0, 50.0, "D"), (1, 4, 100.0, 6900.0, "E")], "k int, turn int, start double, end double, speaker string")
    got = timeline.align(segments, turns, "k", "segment", 60.0).orderBy("segment").collect()
    assert [(r.speaker, r.overlap) for r in got] == [("A", 5.0), ("UNKNOWN", None), ("UNKNOWN", None), ("E", 6800.0)]


def test_layout_folds(spark):
    blocks = spark.createDataFrame([(1, 0, "heading", 1, "H1"), (1, 1, "paragraph", None, "a"), (1, 2, "heading", 2, "H2"), (1, 3, "paragraph", None, "b"), (1, 4, "heading", None, "H3")], "doc int, pos int, type string, level int, text string")
    assert [r.section_path for r in layout.section_paths(blocks).orderBy("pos").collect()] == [[], ["H1"], ["H1"], ["H1", "H2"], []]
    assert [r.batch for r in layout.batches(blocks, 4).orderBy("pos").collect()] == [0, 0, 1, 1, 2]
    assert layout.merged_boxes([(0, 0, 10, 10), (12, 0, 20, 10), (50, 1, 60, 10), (200, 200, 210, 210)]) == [(0, 0, 60, 10), (200, 200, 210, 210)]
    captions = [("Figure 1: x", "Figure 1"), ("Table 2 shows our many results over all of the sets", ""), ("Table 2 short", "Table 2"), ("text", "")]
    df = spark.createDataFrame([(c,) for c, _ in captions], "t string")
    assert [r[0] for r in df.select(layout.caption_label(F.col("t"))).collect()] == [x for _, x in captions]
    parts = spark.createDataFrame([(1, 0, "figure", 1, ""), (1, 1, "caption", 1, "Figure 1"), (1, 2, "figure", 1, ""), (1, 3, "caption", 2, "Figure 2")], "doc int, pos int, type string, page int, label string")
    assert [tuple(r) for r in layout.attach_captions(parts).collect()] == [(1, 0, 1)]


def test_consensus(spark):
    rows = [("b", s, i, f"Chapter {i + 1}", f"Title {i} {'x' * s}") for s in (1, 2) for i in range(4)] + [("c", 1, 0, "", "Alpha beta"), ("c", 2, 0, "", "Alpha betas"), ("c", 3, 0, "", "Else")]
    df = spark.createDataFrame(rows, "book string, src int, pos int, num string, title string")
    agreed = consensus.numbered(df)
    assert agreed.count() == 4 and agreed.where("key = '1'").first().title == "Title 0 xx"
    made = consensus.confidence(agreed, df.where("book = 'b'")).first()
    assert made.agreed == 4 and made.confidence == 1.0
    assert [(r.n_sources, r.title) for r in consensus.unnumbered(df).collect()] == [(2, "Alpha betas")]


def test_registry_capped_feed(spark):
    feed = spark.createDataFrame([("c", i) for i in range(5)], "channel string, id int")
    known = spark.createDataFrame([(0,), (3,)], "id int")
    got = registry.unregistered(feed, known, ["id"], "channel", ["id"], 2)
    assert sorted(r.id for r in got.collect()) == [1, 2]


def test_refine_loop_and_replay(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path / "cp"))
    docs = spark.createDataFrame([(1, "The cat sat on mats."), (2, "Dogs bark at night here.")], "doc_id long, text string")
    chunks = spark.createDataFrame([(0, "the cat sat"), (1, "cows eat grass"), (2, "hens lay eggs"), (3, "dogs bark")], "chunk_id long, chunk string")

    class Judge:
        def ask(self, prompts):
            return prompts.withColumn("answer", F.when(F.col("claim").contains("cat"), "supported").otherwise("contradicted"))

    def rewrite(open_docs, verdicts):
        fixed = verdicts.groupBy("doc_id").agg(F.count_if(F.col("verdict") == "contradicted").alias("n_fixed"))
        return open_docs.join(fixed, "doc_id").withColumn("text", F.when(F.col("n_fixed") > 0, F.concat("text", F.lit(" A cat dogs line."))).otherwise(F.col("text")))

    out = {r.doc_id: r for r in refine.refine(docs, chunks, Judge(), rewrite, refine.RefineConfig(max_iter=3)).collect()}
    assert out[1].score == 100.0 and out[1].iterations == 1
    assert out[2].iterations == 3 and out[2].score == 50.0
    recorded = spark.createDataFrame([("p1", "yes")], "prompt string, answer string").select(F.sha2("prompt", 256).alias("prompt_hash"), "answer")
    asked = providers.ReplayProvider(recorded).ask(spark.createDataFrame([("p1",), ("p2",)], "prompt string"))
    assert {r.prompt: r.answer for r in asked.collect()} == {"p1": "yes", "p2": None}
    assert providers.EchoProvider().ask(asked.select("prompt")).first().answer == "p1"

    def flaky(prompt):
        raise OSError

    assert providers.CallProvider(str.upper).ask(asked.select("prompt")).first().answer == "P1"
    assert providers.CallProvider(flaky, 2).ask(asked.select("prompt")).first().answer is None


def test_streams(spark, tmp_path):
    feed, registry_path = tmp_path / "feed", tmp_path / "registry"
    feed.mkdir()
    schema = "id string, published timestamp"

    def deliver(name, lines):
        (feed / name).write_text("\n".join(lines))
        stream = feeds.new_entries(feeds.read_feed(spark, str(feed), schema), ["id"], "published")
        feeds.register(stream, str(registry_path), str(tmp_path / "cp"), ["id"]).awaitTermination()

    deliver("a.json", ['{"id": "1", "published": "2024-01-02T00:00:00"}', '{"id": "1", "published": "2024-01-02T00:00:00"}', '{"id": "2"}'])
    deliver("b.json", ['{"id": "2", "published": "2024-01-03T00:00:00"}', '{"id": "3", "published": "2099-01-03T00:00:00"}'])
    assert sorted(r.id for r in spark.read.parquet(str(registry_path)).collect()) == ["1", "2", "3"]
    events = spark.readStream.schema("t timestamp, k string").json(str(feed))
    for frame in (feeds.windowed_counts(events, "t", ["k"]), feeds.sessions(events, "t", ["k"])):
        assert frame.isStreaming and "n" in frame.columns


def test_ids_of_claims_stay_exact_and_ties_go_to_the_earlier_chunk(spark):
    claims = spark.createDataFrame([(-8871059966584415231, "alpha beta"), (5, "zeta"), (6, "")], "claim_id long, claim string")
    chunks = spark.createDataFrame([(i, f"alpha beta gamma {'x' * (i % 2)}") for i in range(9)] + [(9, ""), (10, None)] + [(20 + i, f"other words {i}") for i in range(30)], "chunk_id long, chunk string")
    got = retrieval.top_k(claims, chunks, 3).orderBy("rank").collect()
    assert {r.claim_id for r in got} == {-8871059966584415231} and len(got) == 3
    before, retrieval.MOST_ASKED = retrieval.MOST_ASKED, 1  # beyond the bound of the broadcast the same rows come in several passes
    try:
        assert retrieval.top_k(claims, chunks, 3).orderBy("rank").collect() == got
    finally:
        retrieval.MOST_ASKED = before


def test_section_shares_by_block_and_by_token(spark):
    claims = spark.createDataFrame([(1, "one two three four"), (2, "nothing here"), (3, "")], "claim_id long, claim string")
    sections = spark.createDataFrame([(7, 1, "# A", "one two"), (7, 2, "# B", "one two three"), (7, 3, "# C", "three two one"), (8, 1, "# D", ""), (8, 0, None, "one two three four")], "doc_id long, section int, header string, body string")
    want = [(1, 7, 2, 0.75)]
    assert [tuple(r) for r in retrieval.best_sections(claims, sections).collect()] == want
    before, retrieval.MOST_ASKED = retrieval.MOST_ASKED, 1
    try:
        assert [tuple(r) for r in retrieval.best_sections(claims, sections).collect()] == want
    finally:
        retrieval.MOST_ASKED = before


def test_documents_are_corrected_section_by_section(spark):
    from evigraph.functions import chunks
    from evigraph.operators import correction

    docs = spark.createDataFrame([(1, "head\n# A\nthe moon is cheese\n# B\nall fine here"), (2, "no sections at all")], "doc_id long, text string")
    made = chunks.sections(docs, "doc_id")
    verdicts = spark.createDataFrame([(1, "the moon is cheese", "contradicted"), (1, "all fine here", "supported"), (2, "zzz", "partial")], "doc_id long, claim string, verdict string")
    asked = correction.to_correct(verdicts, made.withColumn("section", F.col("section").cast("int")))
    assert [tuple(r) for r in asked.collect()] == [(1, 1, ["the moon is cheese"])]
    new = asked.select("doc_id", "section", F.lit("the moon is made of rock").alias("new"))
    out = {r.doc_id: (r.text, r.n_fixed) for r in correction.reassemble(made, new).collect()}
    assert out == {1: ("head\n\n# A\nthe moon is made of rock\n\n# B\nall fine here", 1), 2: ("no sections at all", 0)}


def test_upper_median_and_relevance_bounds(spark):
    rows = spark.createDataFrame([("a", 3.0), ("a", 1.0), ("a", 3.0), ("a", 2.0), ("b", -1.0), ("c", 5.0), ("c", None)], "doc string, v double")
    assert sorted(map(tuple, layout.upper_median(rows, ["doc"], "v").collect())) == [("a", 3.0), ("b", 10.0), ("c", 5.0)]
    entities = spark.createDataFrame([("Graph", "of words"), ("x", None)], "name string, description string")
    words = spark.createDataFrame([("graph",), ("word",), ("none",)], "term string")
    assert [tuple(r) for r in graph.relevance(entities, words).collect()] == [("Graph", 2)]


def test_index_is_extended_without_reading_the_old_chunks(spark, monkeypatch):
    chunks = spark.createDataFrame([(i, f"alpha w{i % 7} beta{i % 3} " * (i % 5)) for i in range(60)], "chunk_id int, chunk string")
    claims = spark.createDataFrame([(i, f"alpha w{i} beta1") for i in range(9)], "claim_id int, claim string")
    want = sorted(map(tuple, retrieval.top_k(claims, chunks, 4).collect()))
    index = retrieval.Index.of(chunks.where("chunk_id < 25")).extended(chunks.where("chunk_id >= 25"))
    assert sorted(map(tuple, retrieval.top_k(claims, index, 4).collect())) == want and len(want) == 36
    monkeypatch.setattr(retrieval, "BLOCK_BYTES", 1)  # one claim at a time
    monkeypatch.setattr(retrieval, "MOST_ASKED", 8)  # and some passes
    monkeypatch.setattr(retrieval, "MOST_HELD", 3)
    assert sorted(map(tuple, retrieval.top_k(claims, index, 4).collect())) == want


def _grouped(spark):
    """Groups of one to nine members, claims of few speakers (some given twice), a member that nobody speaks of."""
    members = [(g, 10 * g + i) for g in range(12) for i in range(g % 10)]
    claims = [(h * 7919 % 5, n) for h, (g, n) in enumerate(members * 3) if n % 4] + [(0, 51), (0, 51)]
    held = [(n * s % 3, n) for _, n in members for s in (1, 2, 5)]
    pairs = [(a, "R", b) for g, a in members for k, b in members if g == k and a < b]
    make = spark.createDataFrame
    return make(members, "g int, name int"), make(claims, "speaker int, concept int"), make(held, "source_id int, name int"), make(pairs, "src int, rel string, dst int")


def test_pairs_of_groups_equal_those_of_their_edges(spark, monkeypatch):
    members, claims, held, pairs = _grouped(spark)
    monkeypatch.setattr(graph, "CELL", 2)
    both = sorted(map(tuple, graph.both_ways(pairs).select("a", "b").collect()))
    assert sorted(map(tuple, graph.group_pairs(members, ["g"]).select("a", "b").collect())) == both
    for mentions in (None, held):
        assert sorted(map(tuple, graph.group_degrees(members, ["g"], mentions).collect())) == sorted(map(tuple, graph.degrees(pairs, mentions).collect()))
    links = export.source_graph(held, members, pairs)[1].select("source_id", "src", "dst")
    assert sorted(map(tuple, export.group_links(held, members, ["g"]).collect())) == sorted(map(tuple, links.collect()))


def test_first_pairs_of_groups_are_chosen_before_pairing(spark):
    members, claims, _, pairs = _grouped(spark)
    whole = sorted(map(tuple, graph.claim_pairs(claims, pairs, ["R"]).collect()), key=lambda r: (r[0], r[1], r[2], r[3]))
    topics = members.select(F.col("name").alias("topic"), (F.col("name") % 3).alias("confidence"))
    hung = sorted(map(tuple, graph.topic_pairs(claims, pairs, ["R"], topics).select("topic", "confidence", "speaker1", "claim1", "speaker2", "claim2").collect()), key=lambda r: (-r[1], r[0], *r[2:]))
    for most in (1, 7, 50, 10_000):
        assert list(map(tuple, graph.first_group_claim_pairs(claims, members, ["g"], most).collect())) == whole[:most]
        assert [(r.topic, r.confidence, r.speaker1, r.claim1, r.speaker2, r.claim2) for r in graph.first_group_topic_pairs(claims, members, ["g"], topics, most).collect()] == hung[:most]


def test_summaries_send_no_tables_through_the_driver(spark):
    from evigraph.plans import passes
    from evigraph.plans.catalog_contents import _Extractor

    summaries = spark.createDataFrame([(i, f"word{i} thing{i} more", [f"Ann Lee {i}"]) for i in range(9)], "source_id int, text string, speakers array<string>")
    entities, triples = passes.extract_summaries(summaries, _Extractor())
    for found in (entities, triples):
        assert "BroadcastExchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert (entities.count(), triples.count()) == (27, 18)


def test_speakers_of_one_name_count_once(spark):
    """a name that many people bear is met once, not once for each of them."""
    from evigraph.operators import graph

    people = spark.range(50).select(F.lit("Ann").alias("name"))
    mentions = spark.createDataFrame([(1, "Ann"), (1, "c"), (1, "d"), (2, "c")], "source_id int, name string")
    entities = spark.createDataFrame([("c", "[Ann] it holds"), ("d", "on [Ann] it holds"), ("e", "nothing")], "name string, description string")
    for said, name in ((True, "c"), (False, "d")):
        made = graph.attributed(mentions, people, entities, said)
        assert [tuple(r) for r in made.collect()] == [(1, "Ann", name)]
        assert "LeftSemi" in made._jdf.queryExecution().optimizedPlan().toString()


def test_registry_replay_of_many_items(spark):
    """items and their states go to Python in batches, and the log is that of the whole."""
    kinds = ["add", "processing", "done", "failed", "retry", "reset"]
    rows = [(u, 10 * u + i, kinds[(u * i + i) % 6] if i else "add", "t" if i % 2 else "", None if i % 3 else "e" * 600, i + 1) for u in range(40) for i in range(9)]
    at = lambda df: df.withColumn("at", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("s"))).withColumn("seen", F.col("at")).drop("s")
    schema = "u long, seq long, action string, title string, error string, s int"
    batches = [at(spark.createDataFrame([r for r in rows if r[1] % 3 == k or k == 1], schema)) for k in range(3)]
    last = at(spark.createDataFrame([(-1, -1, "none", "", "", 10_000)], schema))
    made = []
    got = catalog_streams.replayed(spark, batches, lambda s: made.append(registry_state.registry_log(s, ["u"], "1 hour")) or made[-1], last)
    assert "TransformWithState" not in made[0]._jdf.queryExecution().logical().toString()
    want = []
    for u in range(40):
        item = None
        for r in (r for r in rows if r[0] == u):
            after = registry_state.applied(item, registry_state.Action((1_700_000_000 + r[5]) * 10**6, r[1], r[2], r[3], r[4] or ""))
            if after is not item:
                item = after
                want.append((u, r[1], r[2], *item))
    us = [F.unix_micros(c).alias(c) for c in ("added_at", "processed_at")]
    assert sorted(map(tuple, got.select("u", "seq", "action", "status", "title", "error", *us).collect())) == sorted(want)


def test_refine_searches_a_claim_once(spark, monkeypatch):
    """F16: rounds that only take claims out search nothing, and a claim of many documents is searched once."""
    docs = spark.createDataFrame([(i, "\n".join(f"claim number {j} holds" for j in range(i + 1))) for i in range(3)], "doc_id long, text string")
    chunks = spark.createDataFrame([(i, f"number {i}") for i in range(9)], "chunk_id long, chunk string")

    class Judge:
        def ask(self, prompts):
            return prompts.withColumn("answer", F.lit("contradicted"))

    def rewrite(held, verdicts):
        return held.select("doc_id", F.regexp_replace("text", r"^[^\n]*\n?", "").alias("text"), F.lit(1).alias("n_fixed"))

    asked, search = [], retrieval.top_k
    monkeypatch.setattr(retrieval, "top_k", lambda claims, *more: asked.append(claims.count()) or search(claims, *more))
    out = refine.refine(docs, chunks, Judge(), rewrite, refine.RefineConfig(max_iter=3)).collect()
    assert asked == [3] and {(r.doc_id, r.iterations) for r in out} == {(0, 3), (1, 3), (2, 3)}


def test_best_chunks_of_many_rows(spark):
    """what is below the best k so far is dropped, ties are not."""
    chunks = spark.range(3000, numPartitions=1).select(F.col("id").alias("chunk_id"), F.concat(F.lit("other words "), F.repeat(F.lit("alpha "), F.when(F.col("id") % 5 == 0, F.col("id") % 3 + 1).otherwise(0).cast("int")), F.repeat(F.lit("pad "), (F.col("id") % 7).cast("int"))).alias("chunk"))
    got = retrieval.top_k(spark.createDataFrame([(1, "alpha")], "claim_id long, claim string"), chunks, 4).orderBy("rank")
    assert [r.chunk_id for r in got.collect()] == [35, 140, 245, 350]


def test_summaries_are_asked_whole(spark):
    """a section longer than the size is asked in slices, and every entity of an answer counts."""
    from evigraph.operators import splits
    from evigraph.plans import passes

    class Words:
        def ask(self, prompts):
            words = F.split(F.trim(F.element_at(F.split("prompt", "\n\n"), -1)), r"\s+")
            named = F.to_json(F.struct(F.transform(words, lambda w: F.struct(w.alias("name"), F.lit("concept").alias("type"))).alias("entities")))
            last = F.struct(F.get(words, F.lit(0)).alias("subject"), F.lit("uses").alias("predicate"), F.element_at(words, -1).alias("object"))
            return prompts.withColumn("answer", F.when(F.contains("prompt", F.lit("List the entities")), named).otherwise(F.to_json(F.struct(F.array(last).alias("triples")))))

    words = [f"w{i:03d}" for i in range(200)]
    texts = spark.createDataFrame([(1, "#### one\n" + " ".join(words), ["Ann Lee"]), (2, "short text", ["Ann Lee"]), (3, "", ["Ann Lee"])], "source_id int, text string, speakers array<string>")
    entities, triples = passes.extract_summaries(texts, Words(), size=120)
    found = {(r.source_id, r.name) for r in entities.collect()}
    assert {(1, w) for w in words} <= found and {(2, "short"), (2, "text"), (3, "Ann Lee")} <= found
    assert (1, "w199") in {(r.source_id, r.object) for r in triples.collect()}

    for text in ("", "a", "ab " * 50, "x" * 25, "\U0001f600a" * 12 + " b\n" * 9, "日本語" * 9):
        cut = spark.createDataFrame([(text,)], "t string").select(splits.slices(F.col("t"), 10)).first()[0]
        assert "".join(cut) == text and all(len(s) <= 10 for s in cut)
    assert spark.createDataFrame([("one two three",)], "t string").select(splits.slices(F.col("t"), 9)).first()[0] == ["one two", " three"]

"""Query catalogue, tables: graph, registry, layout, consensus and linking, with the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import functions as F

from evigraph.operators import consensus, graph, layout, linking, normalize, registry, speakers, timeline
from evigraph.plans import passes
from evigraph.plans.catalog import query, table

# --- Graph -------------------------------------------------------------------------------------------------


def _mentions(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 50).alias("source_id"), F.col("l_partkey").alias("name"))


def _entities(spark, sf_dir):
    """Parts as entities; every fifth is a person, every seventh has no description."""
    kind = F.when(F.col("p_partkey") % 5 == 0, "person").when(F.col("p_partkey") % 3 == 0, "concept").otherwise("method")
    described = F.when(F.col("p_partkey") % 7 != 0, F.col("p_name"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("name"), kind.alias("type"), described.alias("description"), (F.col("p_size") / 50).alias("confidence"))


_M = "(SELECT DISTINCT (l_orderkey % 50)::BIGINT AS source_id, l_partkey AS name FROM lineitem)"
_E = "(SELECT p_partkey AS name, CASE WHEN p_partkey % 5 = 0 THEN 'person' WHEN p_partkey % 3 = 0 THEN 'concept' ELSE 'method' END AS type, CASE WHEN p_partkey % 7 <> 0 THEN p_name END AS description, p_size / 50.0::DOUBLE AS confidence FROM part)"


@query("""SELECT o_orderkey % 1000 AS source_id, arg_max(o_orderstatus, o_orderkey) AS title, max(o_orderkey) AS seq FROM orders GROUP BY o_orderkey % 1000""")
def source_upsert(spark, sf_dir):
    log = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 1000).alias("source_id"), F.col("o_orderstatus").alias("title"), F.col("o_orderkey").alias("seq"))
    return graph.upsert_sources(log)


@query(f"SELECT source_id, name, type, description, confidence FROM {_M} JOIN {_E} USING (name)")
def source_entities(spark, sf_dir):
    return graph.source_entities(_mentions(spark, sf_dir).distinct(), _entities(spark, sf_dir))


@query("SELECT l_orderkey AS source_id, l_suppkey AS src, l_partkey AS dst FROM lineitem WHERE l_orderkey <> 1")
def cleared_relations(spark, sf_dir):
    relations = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("source_id"), F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"))
    return graph.clear_source(relations, 1)


@query("""SELECT p_partkey AS name, p_name, p_size / 50.0::DOUBLE AS confidence FROM part WHERE contains(lower(p_name), 're') ORDER BY confidence DESC, p_name, name LIMIT 20""")
def entity_search(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.concat("p_name", F.lit(" #"), F.col("p_partkey").cast("string")).alias("name"), (F.col("p_size") / 50).alias("confidence"))
    found = graph.search(part.withColumn("name", F.concat(F.split("name", " #")[0], F.lit(" #"), F.lpad(F.split("name", " #")[1], 12, "0"))), "RE")
    return found.select(F.split("name", " #")[1].cast("long").alias("name"), F.split("name", " #")[0].alias("p_name"), "confidence")


@query("""SELECT o_orderkey AS source_id, o_orderstatus AS title, o_orderpriority AS source_type, o_orderdate AS created_at FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 5)""")
def source_listing(spark, sf_dir):
    sources = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("source_id"), F.col("o_orderstatus").alias("title"), F.col("o_orderpriority").alias("source_type"), F.col("o_orderdate").alias("created_at"))
    return graph.listing(sources, table(spark, sf_dir, "lineitem").where("l_linenumber = 5").select(F.col("l_orderkey").alias("source_id")))


@query(f"""WITH s AS (SELECT DISTINCT source_id FROM {_M} JOIN {_E} USING (name) WHERE type = 'person' AND name IN (5, 10, 15)), g AS (SELECT range AS source_id FROM range(3))
SELECT source_id, true AS given FROM g UNION ALL SELECT source_id, false FROM s WHERE source_id NOT IN (SELECT source_id FROM g)""")
def speaker_sources(spark, sf_dir):
    return graph.sources_of(_mentions(spark, sf_dir), _entities(spark, sf_dir), [5, 10, 15], spark.range(3).toDF("source_id"))


@query(f"SELECT name, count(*) AS n FROM {_M} JOIN {_E} USING (name) WHERE type = 'person' GROUP BY name")
def sources_per_speaker(spark, sf_dir):
    return graph.sources_per_speaker(_mentions(spark, sf_dir), _entities(spark, sf_dir))


@query(f"""SELECT source_id, name, type, description, confidence FROM {_M} JOIN {_E} USING (name) WHERE source_id NOT IN (1, 2) AND type IN ('concept', 'framework', 'theory', 'method', 'phenomenon', 'claim') AND description IS NOT NULL AND confidence >= 0.5
ORDER BY confidence DESC, name, source_id LIMIT 40""")
def other_material(spark, sf_dir):
    ids = spark.range(1, 3).toDF("source_id")
    return graph.material(_mentions(spark, sf_dir), _entities(spark, sf_dir), ids, passes.MATERIAL, 40, inside=False, least=0.5)


@query(f"""SELECT source_id, name, type, description, confidence FROM {_M} JOIN {_E} USING (name) WHERE source_id IN (1, 2) AND type IN ('concept', 'framework', 'theory', 'method', 'phenomenon', 'claim') AND description IS NOT NULL
ORDER BY confidence DESC, name, source_id LIMIT 80""")
def primary_material(spark, sf_dir):
    return graph.material(_mentions(spark, sf_dir), _entities(spark, sf_dir), spark.range(1, 3).toDF("source_id"), passes.MATERIAL, 80)


@query(f"SELECT name FROM {_M} WHERE source_id = 1 INTERSECT SELECT name FROM {_M} WHERE source_id = 2")
def common_entities(spark, sf_dir):
    return graph.common_entities(_mentions(spark, sf_dir), 1, 2)


@query(f"""WITH own AS (SELECT name, type, description, max(confidence) AS c FROM (SELECT source_id, name, type, description, confidence FROM {_M} JOIN {_E} USING (name) WHERE source_id IN (1, 2) AND type IN ('concept', 'method') AND description IS NOT NULL ORDER BY confidence DESC, name, source_id LIMIT 80) GROUP BY ALL)
SELECT 1 AS topic, count(*) AS n_own FROM own""")
def synthesis_prompt(spark, sf_dir):
    thesis = spark.sql("select 1 as topic, 'all is graph' as thesis")
    made = passes.synthesis_prompts(_mentions(spark, sf_dir), _entities(spark, sf_dir), spark.range(1, 3).toDF("source_id"), thesis)
    own = F.regexp_extract("prompt", "(?s)Material:\n(.*?)\n\nFrom other", 1)
    return made.select("topic", F.size(F.split(own, "\n")).cast("long").alias("n_own"))


@query("""WITH old AS (SELECT l_orderkey AS source_id, l_suppkey AS src, l_partkey AS dst, l_linenumber::BIGINT AS seq FROM lineitem), new AS (SELECT l_orderkey AS source_id, l_partkey AS src, l_suppkey AS dst, (l_linenumber + 100)::BIGINT AS seq FROM lineitem WHERE l_orderkey % 10 = 0)
SELECT * FROM old WHERE source_id NOT IN (SELECT source_id FROM new) UNION ALL SELECT * FROM new""")
def processed_relations(spark, sf_dir):
    """Every tenth source is processed again: its relations go, the new ones come."""
    li = table(spark, sf_dir, "lineitem")
    old = li.select(F.col("l_orderkey").alias("source_id"), F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_linenumber").cast("long").alias("seq"))
    new = li.where("l_orderkey % 10 = 0").select(F.col("l_orderkey").alias("source_id"), F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), (F.col("l_linenumber") + 100).cast("long").alias("seq"))
    return graph.processed({"relations": new}, {"relations": old}, new.select("source_id"))["relations"]


# --- Merges ------------------------------------------------------------------------------------------------

_MAP = "(SELECT p_partkey AS old, p_partkey - p_partkey % 10 AS new FROM part WHERE p_partkey % 10 BETWEEN 1 AND 2 AND p_partkey > 10)"


def _mapping(spark, sf_dir):
    """Parts whose last digit is 1 or 2 go by the name of the one that ends in 0."""
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").where((key % 10).between(1, 2) & (key > 10)).select(key.alias("old"), (key - key % 10).alias("new"))


@query(f"""WITH m AS (SELECT coalesce(new, p_partkey) AS name, new IS NOT NULL AS moved, p_partkey AS was, p_type AS type, p_name AS description, p_size / 50.0::DOUBLE AS confidence FROM part LEFT JOIN {_MAP} ON old = p_partkey)
SELECT name, arg_min(type, (moved, was)) AS type, arg_min(description, (moved, was)) AS description, max(confidence) AS confidence FROM m GROUP BY name""")
def renamed_entities(spark, sf_dir):
    entities = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("name"), F.col("p_type").alias("type"), F.col("p_name").alias("description"), (F.col("p_size") / 50).alias("confidence"))
    return normalize.rename_entities(entities, _mapping(spark, sf_dir))


@query(f"""WITH r AS (SELECT l_partkey AS src, l_returnflag AS rel, l_partkey - l_linenumber AS dst, max(l_discount) AS confidence, min(l_orderkey) AS source_id FROM lineitem GROUP BY ALL),
m AS (SELECT coalesce(a.new, src) AS src, rel, coalesce(b.new, dst) AS dst, confidence, source_id, a.new IS NOT NULL OR b.new IS NOT NULL AS moved FROM r LEFT JOIN {_MAP} a ON a.old = src LEFT JOIN {_MAP} b ON b.old = dst),
k AS (SELECT *, row_number() OVER (PARTITION BY src, rel, dst ORDER BY moved, confidence DESC, source_id) AS k FROM m)
SELECT src, rel, dst, confidence, source_id FROM k WHERE k = 1""")
def renamed_relations(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    relations = li.groupBy(F.col("l_partkey").alias("src"), F.col("l_returnflag").alias("rel"), (F.col("l_partkey") - F.col("l_linenumber")).alias("dst")).agg(F.max("l_discount").alias("confidence"), F.min("l_orderkey").alias("source_id"))
    return normalize.rename_relations(relations, _mapping(spark, sf_dir))


@query("""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_mktsegment WHEN 1 THEN 'Speaker ' || upper(c_mktsegment) ELSE substr(c_mktsegment, 1, length(c_mktsegment) - 1) END AS name, CASE c_custkey % 3 WHEN 1 THEN 'Speaker ' || upper(c_mktsegment) ELSE c_mktsegment END AS canonical FROM customer""")
def speaker_names(spark, sf_dir):
    """Known names stay, what is like none of them stays too, and names that lack their last letter are found."""
    customer = table(spark, sf_dir, "customer")
    known = customer.groupBy(F.col("c_mktsegment").alias("canonical")).agg(F.min("c_custkey").alias("ord"))
    k = F.col("c_custkey") % 3
    heard = F.when(k == 1, F.concat(F.lit("Speaker "), F.upper("c_mktsegment"))).when(k == 2, F.expr("substring(c_mktsegment, 1, length(c_mktsegment) - 1)")).otherwise(F.col("c_mktsegment"))
    names = customer.select("c_custkey", heard.alias("name"))
    found = speakers.normalized(names.select("name").distinct(), known, "First", "name")
    return names.join(found, "name").select("c_custkey", "name", "canonical")


@query("""WITH q AS (SELECT 'query ' || p_partkey AS query, CASE p_partkey % 4 WHEN 0 THEN 'concept' WHEN 1 THEN 'person' WHEN 2 THEN 'place' ELSE 'theory' END AS type, p_partkey FROM part)
SELECT query, type, CASE WHEN p_partkey % 10 = 3 THEN 'cached' WHEN p_partkey % 4 IN (0, 3) THEN query WHEN p_partkey % 4 = 1 THEN query || ' life' END AS canonical_name,
  CASE WHEN p_partkey % 10 = 3 THEN 0.9 WHEN p_partkey % 4 IN (0, 3) THEN 1.0 WHEN p_partkey % 4 = 1 THEN 0.85 END::DOUBLE AS confidence,
  CASE WHEN p_partkey % 10 = 3 THEN 'local' WHEN p_partkey % 4 IN (0, 3) THEN 'local' WHEN p_partkey % 4 = 1 THEN 'remote' ELSE 'not_found' END AS method FROM q""")
def entity_links(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("query "), F.col("p_partkey").cast("string")).alias("query"))
    k = F.col("p_partkey") % 4
    queries = part.select("query", F.when(k == 0, "concept").when(k == 1, "person").when(k == 2, "place").otherwise("theory").alias("type"))
    index = part.select(F.col("query").alias("title"), F.concat(F.lit("Q"), F.col("p_partkey").cast("string")).alias("qid"))
    remote = part.select(F.concat("query", F.lit(" life")).alias("title"), F.lit("R").alias("qid"))
    cache = part.where("p_partkey % 10 = 3").select("query", F.lit("cached").alias("canonical_name"), F.lit("C").alias("qid"), F.lit(0.9).alias("confidence"), F.lit("local").alias("method"))
    return linking.resolve(queries, index, cache, remote).select("query", "type", "canonical_name", "confidence", "method")


# --- Registry ----------------------------------------------------------------------------------------------


@query("""SELECT user_id, 'pending' AS status, 't' || user_id AS title, max(ts) AS at FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND event_id % 50 = 0) GROUP BY user_id""")
def registry_insert(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    state = events.where("event_type = 'error' and event_id % 50 = 0").select("user_id").distinct()
    new = events.groupBy("user_id").agg(F.max("ts").alias("at")).withColumn("title", F.concat(F.lit("t"), F.col("user_id").cast("string")))
    return registry.insert(state, new, ["user_id"], F.col("at"))


@query("""WITH s AS (SELECT user_id, arg_max(event_type, event_id) AS status FROM events WHERE event_id % 3 = 0 GROUP BY user_id), w AS (SELECT DISTINCT user_id FROM events)
SELECT user_id, status IS NOT NULL AS present, status FROM w LEFT JOIN s USING (user_id)""")
def registry_lookup(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    state = events.where("event_id % 3 = 0").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("status"))
    return registry.lookup(state, events.select("user_id"), ["user_id"])


@query("""SELECT event_id, CASE WHEN value IS NOT NULL AND event_id % 4 <> 0 AND event_id * 13 % 7200 < 3600 THEN 'failed' ELSE 'processing' END AS status FROM (SELECT * FROM events WHERE event_type = 'view' ORDER BY ts, event_id LIMIT 100)""")
def queue_drain(spark, sf_dir):
    """Items without a duration pass."""
    events = table(spark, sf_dir, "events")
    duration = F.when((F.col("event_id") % 4 != 0) & F.col("value").isNotNull(), F.col("event_id") * 13 % 7200)
    state = events.where("event_type = 'view'").select("event_id", F.lit("pending").alias("status"), F.struct("ts", "event_id").alias("added_at"), duration.alias("duration"))
    return registry.drain(state, 100).select("event_id", "status")


@query("""SELECT user_id AS id, max(event_id) AS run FROM events WHERE event_id % 3 > 0 AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND event_id % 40 = 0) GROUP BY user_id""")
def unpublished_runs(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    runs = events.select(F.col("user_id").alias("id"), F.col("event_id").alias("run"), (F.col("event_id") % 3).alias("n_files"))
    return registry.unpublished(runs, events.where("event_type = 'purchase' and event_id % 40 = 0").select(F.col("user_id").alias("id")))


@query("""SELECT DISTINCT user_id AS id FROM events WHERE event_type = 'view' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'click' AND event_id % 40 = 0)""")
def added_items(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumnRenamed("user_id", "id")
    return registry.added(events.where("event_type = 'view'"), events.where("event_type = 'click' and event_id % 40 = 0"), "id")


@query("""WITH c AS (SELECT event_type, event_id AS pos, (event_id % 17 + 10 * (event_id % 3))::BIGINT AS score, props AS text, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY score DESC, pos) AS j FROM c WHERE k <= 50) SELECT event_type, pos, score, substring(text, 1, 300) AS text FROM r WHERE j <= 30""")
def popular_comments(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    comments = events.select("event_type", F.col("event_id").alias("pos"), (F.col("event_id") % 17).alias("votes"), (F.col("event_id") % 3).alias("reply_count"), F.col("props").alias("text"))
    return registry.popular(comments, by=["event_type"])


# --- Chapters ----------------------------------------------------------------------------------------------


def _chapters(spark, sf_dir):
    """Books are orders' last two digits, sources suppliers' last digit, chapters line numbers."""
    li = table(spark, sf_dir, "lineitem")
    return li.select((F.col("l_orderkey") % 100).alias("book"), (F.col("l_suppkey") % 4).alias("src"), F.concat(F.lit("Ch. "), F.col("l_linenumber").cast("string")).alias("num"), F.concat(F.lit("Title "), F.repeat(F.lit("x"), F.col("l_quantity").cast("int"))).alias("title")).distinct()


_CH = "(SELECT DISTINCT l_orderkey % 100 AS book, l_suppkey % 4 AS src, l_linenumber AS n, 'Title ' || repeat('x', l_quantity::INTEGER) AS title FROM lineitem)"


@query(f"""SELECT book, n::VARCHAR AS key, count(DISTINCT src) AS n_sources, arg_max(title, (length(title), -src, title)) AS title FROM {_CH} GROUP BY book, n HAVING count(DISTINCT src) >= 2""")
def chapter_consensus(spark, sf_dir):
    return consensus.numbered(_chapters(spark, sf_dir))


@query(f"""WITH a AS (SELECT book, n, count(DISTINCT src) AS votes FROM {_CH} GROUP BY book, n HAVING count(DISTINCT src) >= 2), f AS (SELECT book, count(*) AS agreed, sum(votes) AS votes FROM a GROUP BY book),
s AS (SELECT book, src, count(*) AS n FROM {_CH} GROUP BY book, src), e AS (SELECT book, count(*) AS sources, list_sort(list(n))[count(*) // 2 + 1] AS expected FROM s GROUP BY book),
c AS (SELECT book, coalesce(agreed, 0) AS agreed, CASE WHEN sources = 1 THEN 0.35 WHEN coalesce(agreed, 0) = 0 THEN 0.2 ELSE least(1.0, (least(1.0, agreed::DOUBLE / expected) * 0.6 + votes::DOUBLE / (agreed * sources) * 0.4) * 1.2) END AS confidence FROM e LEFT JOIN f USING (book))
SELECT book, agreed, round(confidence, 6) AS confidence, confidence >= 0.5 AND agreed >= 2 AS reliable FROM c""")
def chapter_confidence(spark, sf_dir):
    chapters = _chapters(spark, sf_dir)
    made = consensus.confidence(consensus.numbered(chapters), chapters)
    return made.select("book", "agreed", F.round("confidence", 6).alias("confidence"), consensus.reliable(F.col("confidence"), F.col("agreed")).alias("reliable"))


@query(f"""WITH s AS (SELECT book, src, count(*) AS n FROM {_CH} GROUP BY book, src) SELECT book, src, n FROM s QUALIFY row_number() OVER (PARTITION BY book ORDER BY n DESC, src) = 1""")
def best_chapter_source(spark, sf_dir):
    return consensus.best_source(_chapters(spark, sf_dir))


@query(f"""WITH a AS (SELECT book, count(*) AS had FROM (SELECT book, n FROM {_CH} WHERE n > 5 GROUP BY book, n HAVING count(DISTINCT src) >= 2) GROUP BY book),
s AS (SELECT book, src, count(*) AS n FROM {_CH} GROUP BY book, src), b AS (SELECT book, src, n, count(*) OVER (PARTITION BY book) - 1 AS others, row_number() OVER (PARTITION BY book ORDER BY n DESC, src) AS k FROM s)
SELECT book, src, n, round(least(0.85, 0.5 + 0.05 * others), 6)::DOUBLE AS confidence FROM b LEFT JOIN a USING (book) WHERE k = 1 AND n > greatest(coalesce(had, 0), 4) AND n > 1.5 * coalesce(had, 0)""")
def chapter_override(spark, sf_dir):
    chapters = _chapters(spark, sf_dir)
    agreed = consensus.numbered(chapters.where(F.regexp_extract("num", "([0-9]+)", 1).cast("int") > 5))
    return consensus.override(agreed, chapters).withColumn("confidence", F.round("confidence", 6))


# --- Layout and time ---------------------------------------------------------------------------------------


@query("""WITH s AS (SELECT p_brand AS doc, p_size % 5 + 10.0::DOUBLE AS size, length(p_name) AS n, p_partkey AS p, p_partkey % 50 = 0 AS bold FROM part), g AS (SELECT doc, size, sum(n) AS n, min(p) AS p FROM s GROUP BY doc, size)
SELECT g.doc, arg_max(g.size, (g.n, -g.p)) AS size, (SELECT bool_or(bold) FROM s WHERE s.doc = g.doc) AS bold FROM g GROUP BY g.doc""")
def dominant_sizes(spark, sf_dir):
    spans = table(spark, sf_dir, "part").select(F.col("p_brand").alias("doc"), (F.col("p_size") % 5 + 10.0).cast("double").alias("size"), F.col("p_name").alias("text"), F.col("p_partkey").alias("span"), (F.col("p_partkey") % 50 == 0).alias("bold"))
    return layout.dominant_size(spans, ["doc"])


@query("""SELECT page_id FROM pages WHERE page_id % 10 >= 4 OR page_id % 10 IN (SELECT page_id % 10 FROM pages WHERE page_id % 10 < 4 GROUP BY page_id % 10 HAVING count(*) < 3)""")
def single_images(spark, sf_dir):
    data = F.when(F.col("page_id") % 10 < 4, F.concat(F.lit("logo"), (F.col("page_id") % 10).cast("string"))).otherwise(F.concat(F.lit("own"), F.col("page_id").cast("string")))
    return layout.once_only(table(spark, sf_dir, "pages").select("page_id", data.cast("binary").alias("image_bytes"))).select("page_id")


_R = "(SELECT p_partkey AS id, p_partkey // 60 AS page, (p_partkey * 37 % 500)::DOUBLE AS x0, (p_partkey * 53 % 700)::DOUBLE AS y0, p_size FROM part)"


def _boxes(spark, sf_dir):
    k = F.col("p_partkey")
    x0, y0 = (k * 37 % 500).cast("double"), (k * 53 % 700).cast("double")
    return table(spark, sf_dir, "part").select(k.alias("id"), F.floor(k / 60).alias("page"), F.struct(x0.alias("x0"), y0.alias("y0"), (x0 + F.col("p_size")).alias("x1"), (y0 + 40).alias("y1")).alias("box"))


@query(f"""SELECT a.id AS a, b.id AS b FROM {_R} a JOIN {_R} b ON a.page = b.page AND a.id < b.id AND a.x0 - 2 < b.x0 + b.p_size AND b.x0 - 2 < a.x0 + a.p_size AND a.y0 - 2 < b.y0 + 40 AND b.y0 - 2 < a.y0 + 40""")
def box_overlaps(spark, sf_dir):
    boxes = _boxes(spark, sf_dir)
    a, b = boxes.select(F.col("id").alias("a"), "page", F.col("box").alias("p")), boxes.select(F.col("id").alias("b"), "page", F.col("box").alias("q"))
    return a.join(b, "page").where((F.col("a") < F.col("b")) & layout.overlaps("p", "q", 2.0)).select("a", "b")


@query("""SELECT page, x0::DOUBLE AS x0, y0::DOUBLE AS y0, x1::DOUBLE AS x1, y1::DOUBLE AS y1 FROM (SELECT DISTINCT p_partkey // 10 AS page FROM part), (VALUES (0, 0, 14, 30), (100, 0, 110, 10), (0, 200, 90, 210)) t(x0, y0, x1, y1)""")
def merged_boxes(spark, sf_dir):
    """On each page two boxes that are near, one that is far, and two side by side."""
    made = spark.createDataFrame([(0.0, 0.0, 10.0, 10.0), (4.0, 14.0, 14.0, 30.0), (100.0, 0.0, 110.0, 10.0), (0.0, 200.0, 20.0, 210.0), (60.0, 201.0, 90.0, 209.0)], "x0 double, y0 double, x1 double, y1 double")
    pages = table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 10).alias("page")).distinct()
    return layout.merge_boxes(pages.crossJoin(F.broadcast(made)), ["page"])


def _blocks(spark, sf_dir):
    """A short paper for each document."""
    rows = [
        ("text", 1, 14.0, True, "A Title of Things"), ("text", 1, 10.0, False, "ann@uni.edu"), ("text", 1, 12.0, True, "Abstract"), ("text", 1, 10.0, False, "we show that."), ("text", 1, 12.0, True, "1 Intro"),
        ("text", 1, 10.0, False, "some long body text\nthat goes on"), ("image", 2, 0.0, False, ""), ("text", 2, 9.0, False, "Figure 1: a figure"), ("text", 2, 9.0, False, "Algorithm 2. steps"), ("text", 2, 10.0, False, "more text at the end."), ("text", 2, 12.0, True, "References"), ("text", 2, 10.0, False, "[1] someone"),
    ]
    made = spark.createDataFrame([(i, *r, 10.0, 210.0) for i, r in enumerate(rows)], "pos int, kind string, page int, font_size double, bold boolean, text string, x0 double, x1 double")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc")).crossJoin(F.broadcast(made))


def _segmented(spark, sf_dir):
    blocks = _blocks(spark, sf_dir)
    return layout.segmented(blocks, blocks.select("doc").distinct().withColumn("size", F.lit(10.0)))


@query("""SELECT event_id, (event_id % 10) / 10.0 * value AS "start", (event_id % 10 + 1) / 10.0 * value AS "end" FROM events WHERE value IS NOT NULL""")
def chunk_times(spark, sf_dir):
    span = timeline.chunk_times(F.col("event_id") % 10, F.lit(10), F.col("value"))
    made = table(spark, sf_dir, "events").where("value is not null").select("event_id", span.alias("s"))
    return made.select("event_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"))

"""Entity linking against a dictionary table, with a cache of what was asked before."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evigraph.functions.text import strip, title_confidence

LOCAL_TYPES = ["concept", "framework", "theory"]
REMOTE_TYPES = ["person", "organization"]


def resolve(queries: DataFrame, index: DataFrame, cache: DataFrame, remote: DataFrame | None = None, local_least: float = 0.4, least: float = 0.6) -> DataFrame:
    """(query, type, canonical_name, qid, confidence, method) of queries (query, type).

    A cached query (whatever its type) is not asked again.  Concepts meet the titles of ``index`` (title, qid), people and
    organisations those of ``remote``; other types never resolve.  Queries and titles meet by their rarest words, so that a word that all
    of them share brings no pair together.  The best title at or over
    ``least`` holds, else ``not_found`` (which is cached too).  All tables grow with the names: each join is by exchange, since names
compress so well in files that Spark would take millions of them for a table small enough to send through the driver."""
    known = queries.join(cache.select("query", "canonical_name", "qid", "confidence", "method").hint("merge"), "query")
    asked = queries.join(cache.select("query").hint("merge"), "query", "left_anti").distinct()

    def words(column: str):
        return F.array_distinct(F.filter(F.split(F.lower(strip(F.col(column))), r"(?U)\W+"), lambda w: w != ""))

    def indexed(rows: DataFrame, by: list[str], counts: DataFrame, floor: float) -> DataFrame:
        """Rows under their rarest words: as many as two texts can't both miss that share ``floor`` (rounded) of the longer one's words."""
        spread = rows.withColumn("_w", words(by[0])).select(*by, F.size("_w").alias("_n"), F.explode("_w").alias("w")).join(counts.hint("merge"), "w")
        place = F.row_number().over(Window.partitionBy(*by).orderBy("_r", "w"))
        return spread.withColumn("_k", place).where(F.col("_k") <= F.col("_n") - F.ceil((floor - 0.0005) * F.col("_n") - 1e-9) + 1).select(*by, "w")

    def begun(short: DataFrame, long: DataFrame) -> DataFrame:
        """A name that is another with a qualifier may be much longer: the two meet by the longer one's first words."""
        (a, *_), (b, *_) = short.columns, long.columns
        said = F.split(F.lower(strip(F.col(b))), " ")
        heads = long.select("*", F.explode(F.transform(said, lambda _, i: F.array_join(F.slice(said, F.lit(1), i + 1), " "))).alias("_head"))
        return short.withColumn("_head", F.lower(strip(F.col(a)))).join(heads.hint("merge"), "_head").drop("_head")

    def best(rows: DataFrame, titles: DataFrame, floor: float, method: str) -> DataFrame:
        rows, titles = rows.select("query", "type"), titles.select("title", "qid")
        counts = titles.select(F.explode(words("title")).alias("w")).unionByName(rows.select(F.explode(words("query")).alias("w"))).groupBy("w").agg(F.count("*").alias("_r"))
        pairs = indexed(rows, ["query", "type"], counts, floor).join(indexed(titles, ["title", "qid"], counts, floor).hint("merge"), "w").drop("w")
        pairs = pairs.unionByName(begun(rows, titles)).unionByName(begun(titles, rows)).distinct()
        scored = pairs.withColumn("confidence", title_confidence(F.col("query"), F.col("title"))).where(F.col("confidence") >= floor)
        first = Window.partitionBy("query", "type").orderBy(F.desc("confidence"), "title")
        top = scored.withColumn("_k", F.row_number().over(first)).where("_k = 1")
        return top.select("query", "type", F.col("title").alias("canonical_name"), "qid", "confidence", F.lit(method).alias("method"))

    found = best(asked.where(F.col("type").isin(LOCAL_TYPES)), index, max(local_least, least), "local")
    if remote is not None:
        found = found.unionByName(best(asked.where(F.col("type").isin(REMOTE_TYPES)), remote, least, "remote"))
    out = asked.join(found.hint("merge"), ["query", "type"], "left").withColumn("method", F.coalesce("method", F.lit("not_found")))
    return out.unionByName(known.select(*out.columns))


def cached(cache: DataFrame, resolved: DataFrame, now: str) -> DataFrame:
    """The cache with new answers; the first answer of a query stays."""
    new = resolved.join(cache.select("query"), "query", "left_anti").dropDuplicates(["query"])
    columns = ["query", "canonical_name", "qid", "confidence", "method", "fetched_at"]
    return cache.select(*columns).unionByName(new.withColumn("fetched_at", F.lit(now)).select(*columns))

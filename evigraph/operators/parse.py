"""Model output to rows: JSON with recovery, entities, triples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigraph.functions.text import strip

# Vocabularies of the two extractors.
CORE_TYPES = "method material phenomenon theory measurement application person organization place event concept product work".split()
PODCAST_TYPES = [*CORE_TYPES, "claim", "framework"]
CORE_RELATIONS = "is_a part_of uses enables measures applies_to based_on related_to created says mentions about works_at located_in".split()
PODCAST_RELATIONS = (
    "argues_that predicts criticizes distinguishes evidence_for caused_by builds_on created works_at agrees_with responds_to"
    " is_a part_of uses enables says mentions about based_on applies_to measures located_in"
).split()


def string_array(text: Column) -> Column:
    """The first JSON array of a text as strings (shortest match); [] if it is no valid array."""
    found = F.from_json(F.regexp_extract(text, r"(?s)(\[.*?\])", 1), "array<string>")
    return F.filter(F.coalesce(found, F.array().cast("array<string>")), lambda x: x.isNotNull() & ~x.isin("", "false", "0", "0.0"))


def claim_lines(text: Column) -> Column:
    """Lines of more than ten characters, without list marks."""
    lines = F.transform(F.split(text, r"\r?\n"), lambda x: F.regexp_replace(strip(x), r"^[0-9.\-・•* ]+", ""))
    # Openings of lines about the answer itself.
    about = "^(以下[はに]|これら[はの]|上記[はの]|抽出しました|クレームを抽出|ご確認|注意|なお、|※)"
    return F.filter(lines, lambda x: (F.length(x) > 10) & ~x.rlike(about))


def _confidence(value: Column) -> Column:
    number = F.when(F.lower(value) == "true", F.lit(1.0)).when(F.lower(value) == "false", F.lit(0.0)).otherwise(value.try_cast("double"))
    return F.when((number >= 0) & (number <= 1), number).otherwise(F.lit(0.8))


def entities(df: DataFrame, keys: list[str], raw: str = "raw", types: list[str] = CORE_TYPES, most: int | None = 15) -> DataFrame:
    """(keys, pos, name, type, description, confidence): the first ``most`` named entities of each answer, all if ``most`` is None."""
    body = F.from_json(F.regexp_extract(raw, r"(?s)(\{.*\})", 1), "entities array<struct<name:string,type:string,description:string,confidence:string>>")
    rows = df.select(*keys, F.posexplode(body["entities"]).alias("pos", "e")).where(strip(F.coalesce(F.col("e.name"), F.lit(""))) != "")
    kind = F.lower(F.coalesce(F.col("e.type"), F.lit("")))
    rows = rows.select(
        *keys, "pos", strip(F.col("e.name")).alias("name"), F.when(kind.isin(types), kind).otherwise("concept").alias("type"),
        F.coalesce(F.col("e.description"), F.lit("")).alias("description"), _confidence(F.col("e.confidence")).alias("confidence"),
    )
    if most is None:
        return rows
    k = F.row_number().over(Window.partitionBy(*keys).orderBy("pos"))
    return rows.withColumn("_k", k).where(F.col("_k") <= most).drop("_k")


def dedupe_entities(rows: DataFrame, scope: list[str], order: list[str]) -> DataFrame:
    """Of the entities of one name (any case) in a scope the one of highest confidence, the first on ties."""
    best = Window.partitionBy(*scope, F.lower("name")).orderBy(F.desc("confidence"), *order)
    return rows.withColumn("_k", F.row_number().over(best)).where("_k = 1").drop("_k")


def triples(df: DataFrame, known: DataFrame, keys: list[str], scope: list[str], raw: str = "raw", podcast: bool = False) -> DataFrame:
    """(keys, pos, subject, predicate, object, confidence) between known names of the scope (any case), no loops.

    Unknown predicates become ``related_to``; the podcast form makes them ``is_a`` and drops ``related_to``."""
    body = F.from_json(F.regexp_extract(raw, r"(?s)(\{.*\})", 1), "triples array<struct<subject:string,predicate:string,object:string,confidence:string>>")
    rows = df.select(*keys, F.posexplode(body["triples"]).alias("pos", "t"))
    rel = F.lower(F.coalesce(F.col("t.predicate"), F.lit("")))
    named = rows.select(*keys, "pos", strip(F.col("t.subject")).alias("subject"), rel.alias("predicate"), strip(F.col("t.object")).alias("object"), _confidence(F.col("t.confidence")).alias("confidence"))
    if podcast:
        named = named.where("predicate <> 'related_to'")
    vocabulary, other = (PODCAST_RELATIONS, "is_a") if podcast else (CORE_RELATIONS, "related_to")
    named = named.withColumn("predicate", F.when(F.col("predicate").isin(vocabulary), F.col("predicate")).otherwise(other))
    named = named.where("lower(subject) <> lower(object)")
    for end in ("subject", "object"):
        names = known.select(*scope, F.lower("name").alias("_n")).distinct()
        named = named.withColumn("_n", F.lower(end)).join(names.hint("merge"), [*scope, "_n"], "left_semi").drop("_n")
    return named


def dedupe_triples(rows: DataFrame, scope: list[str], order: list[str]) -> DataFrame:
    best = Window.partitionBy(*scope, F.lower("subject"), "predicate", F.lower("object")).orderBy(F.desc("confidence"), *order)
    return rows.withColumn("_k", F.row_number().over(best)).where("_k = 1").drop("_k")


def indexed_batch(text: Column, expected: Column) -> Column:
    """Translations of a numbered batch in order, or null if the numbers are not exactly 0 to n-1."""
    rows = F.from_json(F.regexp_extract(text, r"(?s)(\[.*\])", 1), "array<struct<i:int,ja:string>>")
    ordered = F.array_sort(rows)
    right = F.transform(ordered, lambda x: x["i"]) == F.sequence(F.lit(0), expected - 1)
    return F.when((F.size(rows) == expected) & right, F.transform(ordered, lambda x: x["ja"]))

"""Corpus pipeline over ``documents``: five stages of the numbered operators.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's
documents.  All but the last return the columns of ``documents``.

Rows: ids may be null and may repeat.  Documents without a letter (null and empty texts among them) go in the first stage; of
rows that repeat id and text one stays in the third.  An empty table gives an empty result.

1. Language ID: documents without an identifiable language go; ``lang`` becomes the identified language.
2. Toxicity: documents scored toxic go.
3. n-gram Jaccard join: of each group of near-duplicates the document of the smallest id stays (null after all others).
4. Mixing: documents are taken to the target weights, once each; of each leaf's last one the first words.
5. Best-fit packing into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.llm import language_id, mixing, ngram_join, packing, toxicity
from evigraph.llm._store import stage
from evigraph.llm.queries import MIX_SEED, MIX_WEIGHTS, with_domain

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document stays if its language has at least this probability (four languages: 0.25 is chance).
LANGUAGE_SCORE = 0.4
TOXIC_SCORE = 0.5
MIX_SHARE = 0.9


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language_id.fit(docs)
    told = language_id.predict(docs.select(*COLUMNS), model)
    kept = told.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LANGUAGE_SCORE))
    return kept.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.fit(docs, labels)
    scored = toxicity.score(docs.select(*COLUMNS), model, threshold=TOXIC_SCORE)
    return scored.where("predicted = 0").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    row = F.xxhash64("doc_id", "text").alias("row")  # a row by its id and text: ids may repeat
    found = ngram_join.similarity_components(docs.select(row, "text"), key="row").distinct()
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    stays = docs.select(row, "doc_id").join(found, "row").groupBy("component_id").agg(first).select("first.row")
    return docs.select(row, *COLUMNS).join(stays, "row", "left_semi").dropDuplicates(["row"]).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    slim = mixing.counted(with_domain(docs), ["doc_id", "domain", "lang", "source"])
    mixed = mixing.mix(slim, ["domain", "lang", "source"], MIX_WEIGHTS, share=MIX_SHARE, max_epochs=1, seed=MIX_SEED)
    return mixing.with_text(mixed, docs.select(*COLUMNS), ["doc_id", "lang", "source"]).withColumn("n_chars", F.length("text").cast("long"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language ID", identify_language),
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("mixing", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: Two stages decide by trained models and one by a plan, which SQL can't express: tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, from ``documents``; each result but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

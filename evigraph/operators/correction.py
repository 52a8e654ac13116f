"""Claims out of model answers, and documents put together again from corrected sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evigraph.operators.parse import claim_lines, string_array
from evigraph.operators.retrieval import best_sections, keep_rewrite


def claims_from_answers(answers: DataFrame, doc: str = "doc_id", chunk: str = "chunk_no", answer: str = "answer", most: int = 30) -> DataFrame:
    """(doc, claim_no, claim) of model answers, one for each chunk: the answer's JSON array, else its lines; each claim once,
    where it is met first, and ``most`` of a document."""
    listed = string_array(F.col(answer))
    found = F.when(F.size(listed) > 0, listed).otherwise(claim_lines(F.coalesce(answer, F.lit(""))))
    rows = answers.select(doc, chunk, F.posexplode(found).alias("pos", "claim"))
    first = rows.groupBy(doc, "claim").agg(F.min(F.struct(chunk, "pos")).alias("at"))
    number = F.row_number().over(Window.partitionBy(doc).orderBy("at", "claim"))
    return first.withColumn("claim_no", number - 1).where(F.col("claim_no") < most).select(doc, "claim_no", "claim")


def to_correct(verdicts: DataFrame, sections: DataFrame, skip: tuple[str, ...] = (), least: float = 0.15) -> DataFrame:
    """(doc_id, section, claims) to rewrite: the contradicted and partial claims of a document gathered at its own best
    sections; a claim without one is left."""
    bad = verdicts.where(F.col("verdict").isin("contradicted", "partial")).select("doc_id", F.xxhash64("doc_id", "claim").alias("claim_id"), "claim").distinct()
    at = best_sections(bad.select("claim_id", "claim").distinct(), sections, skip=skip, least=least)
    placed = bad.join(at, ["claim_id", "doc_id"])
    return placed.groupBy("doc_id", "section").agg(F.array_sort(F.collect_list("claim")).alias("claims"))


def reassemble(sections: DataFrame, rewrites: DataFrame) -> DataFrame:
    """(doc_id, text, n_fixed): documents of their sections (doc_id, section, header, body) with the rewritten bodies
    (doc_id, section, new) in place, joined by blank lines.  A rewrite that is empty or too short is not taken, but counts."""
    both = sections.join(rewrites.withColumn("_asked", F.lit(1)), ["doc_id", "section"], "left")
    body = F.when(F.col("_asked") == 1, keep_rewrite(F.col("body"), F.col("new"))).otherwise(F.col("body"))
    part = F.concat(F.when(F.col("section") > 0, F.concat("header", F.lit("\n"))).otherwise(""), body)
    parts = F.array_sort(F.collect_list(F.struct("section", part.alias("part"))))
    return both.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda p: p["part"]), "\n\n").alias("text"), F.count("_asked").alias("n_fixed"))

"""Text segmentation: windows, slices and sections.  Greedy splits are in ``operators/splits.py``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evigraph.functions.text import char_windows


def chunk_by_chars(df: DataFrame, key: str, text: str = "text", size: int = 400, overlap: int = 80) -> DataFrame:
    """(key, chunk_no, offset, chunk): sliding windows of characters."""
    spread = df.select(key, F.col(text).alias("_t"), F.posexplode(char_windows(F.col(text), size, overlap)).alias("chunk_no", "offset"))
    return spread.select(key, "chunk_no", "offset", F.substring(F.col("_t"), F.col("offset") + 1, F.lit(size)).alias("chunk"))


def lines_of(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, line_no, line)."""
    return df.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line"))


def sections(df: DataFrame, key: str, text: str = "text", levels: str = "#{1,6}") -> DataFrame:
    """(key, section, header, body): split at Markdown headings; what is before the first has section 0 and no
    header, and no row if it is blank."""
    so_far = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = lines_of(df, key, text).withColumn("is_header", F.col("line").rlike(f"^{levels} "))
    numbered = numbered.withColumn("section", F.sum(F.col("is_header").cast("int")).over(so_far))
    body = F.array_sort(F.collect_list(F.when(~F.col("is_header"), F.struct("line_no", "line"))))
    grouped = numbered.groupBy(key, "section").agg(
        F.max(F.when(F.col("is_header"), F.col("line"))).alias("header"),
        F.regexp_replace(F.array_join(F.transform(body, lambda x: x["line"]), "\n"), r"(?U)^\s+|\s+$", "").alias("body"),
    )
    return grouped.where("section > 0 or body <> ''")


def without_sections(df: DataFrame, key: str, names: list[str], text: str = "text") -> DataFrame:
    """(key, text) without first- to third-level sections whose heading holds one of ``names``."""
    so_far = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lines = lines_of(df, key, text)
    skip = F.lit(False)
    for name in names:
        skip = skip | F.col("line").contains(name)
    lines = lines.withColumn("skip", F.last(F.when(F.col("line").rlike("^#{1,3} "), skip), ignorenulls=True).over(so_far))
    kept = lines.where(~F.coalesce("skip", F.lit(False)))
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    return kept.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias(text))


def slices(df: DataFrame, key: str, text: str = "text", size: int = 6000) -> DataFrame:
    """(key, chunk_no, offset, chunk): slices that do not overlap, for translations (6000) and summaries (5000)."""
    at = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(size))
    rows = df.where(F.length(text) > 0).select(key, F.col(text).alias("_t"), F.posexplode(at).alias("chunk_no", "offset"))
    return rows.select(key, "chunk_no", "offset", F.substring("_t", F.col("offset") + 1, F.lit(size)).alias("chunk"))

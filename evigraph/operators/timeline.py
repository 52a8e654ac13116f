"""Ordered and interval operators on transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, key: str, order: str, label: str, text: str) -> DataFrame:
    """(key, island, label, first, n, text): runs of one label, their texts joined by blanks; blank texts are skipped."""
    rows = Window.partitionBy(key).orderBy(order)
    said = df.where(F.trim(F.coalesce(text, F.lit(""))) != "")
    changed = F.coalesce((F.col(label) != F.lag(label).over(rows)).cast("int"), F.lit(1))
    numbered = said.withColumn("_c", changed).withColumn("island", F.sum("_c").over(rows.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.trim(text).alias("t"))))
    return numbered.groupBy(key, "island", label).agg(F.min(order).alias("first"), F.count("*").alias("n"), F.array_join(F.transform(ordered, lambda x: x["t"]), " ").alias("text"))


def speaking_ranks(df: DataFrame, key: str, label: str, amount: Column) -> DataFrame:
    """(key, label, total, rank, role): the most speaking is the guest, the next the host; one alone is the host."""
    total = df.groupBy(key, label).agg(F.sum(amount).alias("total"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("total"), label))
    alone = F.count("*").over(Window.partitionBy(key)) == 1
    ranked = total.withColumn("rank", rank).withColumn("_alone", alone)
    role = F.when(F.col("_alone"), "host").when(F.col("rank") == 1, "guest").when(F.col("rank") == 2, "host").otherwise(F.concat(F.lit("speaker"), F.col("rank").cast("string")))
    return ranked.withColumn("role", role).drop("_alone")


def align(segments: DataFrame, turns: DataFrame, key: str, segment: str, bucket: float, missing: str | None = "UNKNOWN") -> DataFrame:
    """Each segment with the speaker of the turn of largest positive overlap, the first turn on ties.

    segments: (key, segment, start, end), turns: (key, turn, start, end, speaker).  An equi-join on key and
    time bucket; both sides repeat once for each bucket that they touch, and a pair counts in its first common one."""

    def bucketed(df: DataFrame, prefix: str) -> DataFrame:
        low, high = (F.floor(F.col(c) / bucket).cast("long") for c in ("start", "end"))
        named = df.select(key, *[F.col(c).alias(prefix + c) for c in df.columns if c != key], low.alias(prefix + "low"), F.greatest(low, high).alias(prefix + "high"))
        return named.withColumn("bucket", F.explode(F.sequence(prefix + "low", prefix + "high")))

    a, b = bucketed(segments, "s_"), bucketed(turns, "t_")
    overlap = F.least("s_end", "t_end") - F.greatest("s_start", "t_start")
    pairs = a.join(b, [key, "bucket"]).where(F.col("bucket") == F.greatest("s_low", "t_low")).withColumn("overlap", overlap).where("overlap > 0")
    best = pairs.groupBy(key, F.col(f"s_{segment}").alias(segment)).agg(F.min_by(F.struct("t_speaker", "overlap"), F.struct((-F.col("overlap")).alias("o"), "t_turn")).alias("x"))
    out = segments.join(best, [key, segment], "left")
    return out.select(*segments.columns, F.coalesce("x.t_speaker", F.lit(missing)).alias("speaker"), F.col("x.overlap").alias("overlap"))


def chunk_times(index: Column, chunks: Column, total: Column) -> Column:
    """struct(start, end): the even share of the total time that a chunk stands for."""
    return F.struct((index / chunks * total).alias("start"), ((index + 1) / chunks * total).alias("end"))

"""Work registry as an event log and a view of its current state."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def current(log: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """State of each item.  log: (keys, seq, status, title, error, at): the last status holds, a title stays until a
    later one that is not empty, errors are cut at 500 characters and belong to failures."""
    titled = F.when(F.coalesce("title", F.lit("")) != "", F.col(seq))
    return log.groupBy(*keys).agg(
        F.max_by("status", seq).alias("status"),
        F.max_by("title", titled).alias("title"),
        F.substring(F.max_by("error", F.when(F.col("status") == "failed", F.col(seq))), 1, 500).alias("error"),
        F.min("at").alias("added_at"),
        F.max_by("at", F.when(F.col("status").isin("done", "failed"), F.col(seq))).alias("processed_at"),
    )


def pending(state: DataFrame) -> DataFrame:
    return state.where("status = 'pending'").orderBy("added_at")


def failed(state: DataFrame) -> DataFrame:
    return state.where("status = 'failed'").orderBy(F.desc("processed_at"))


def listed(state: DataFrame, most: int = 50, **equal: str | None) -> DataFrame:
    """Newest first; each given value is a condition."""
    for column, value in equal.items():
        if value is not None:
            state = state.where(F.col(column) == value)
    return state.orderBy(F.desc("added_at")).limit(most)


def counts(state: DataFrame, *columns: str) -> DataFrame:
    """(what, value, n) for each of the columns, one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("what"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")
    return state.select(pairs).groupBy("x.what", "x.value").agg(F.count("*").alias("n"))


def unregistered(feed: DataFrame, registry: DataFrame, keys: list[str], per: str, order: list, most: int) -> DataFrame:
    """Feed rows that the registry lacks: of each ``per`` the first ``most`` in feed order."""
    new = feed.join(registry.select(*keys).distinct(), keys, "left_anti")
    return new.withColumn("_k", F.row_number().over(Window.partitionBy(per).orderBy(*order))).where(F.col("_k") <= most).drop("_k")


def failure_kind(log):
    """The first rule whose words a log holds, as a column."""
    # Words of each kind, in order.
    rules = [
        ("auth_error", ("401", "unauthorized", "authentication")), ("rate_limit", ("rate limit", "usage limit")),
        ("import_error", ("importerror", "modulenotfounderror")), ("json_error", ("jsondecode", "json.decoder")),
        ("sigpipe", ("sigpipe", "broken pipe")), ("ollama_timeout", ("timeout", "connection refused")),
    ]
    low, kind = F.lower(log), F.when(F.lit(False), F.lit(""))
    for name, words in rules:
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        kind = kind.when(hit, F.lit(name))
    return kind.otherwise(F.lit("unknown"))


def drain(state: DataFrame, most: int, least_seconds: int = 3600) -> DataFrame:
    """The first ``most`` pending items (added_at, duration): too short ones fail, those without a duration pass."""
    first = state.where("status = 'pending'").orderBy("added_at").limit(most)
    short = F.col("duration") < least_seconds
    error = F.when(short, F.concat(F.lit("short_video:"), F.col("duration").cast("string"), F.lit("s")))
    return first.withColumn("error", error).withColumn("status", F.when(short, "failed").otherwise("processing"))


def unpublished(runs: DataFrame, published: DataFrame) -> DataFrame:
    """(id, run): of each id that is not published the latest run that holds something."""
    latest = runs.where("n_files > 0").groupBy("id").agg(F.max("run").alias("run"))
    return latest.join(published.select("id"), "id", "left_anti")


def decision(score, answer):
    """struct(action, reason): redo below 70 unasked; else the model's action if it is one; without an answer publish from 88 on."""
    body = F.from_json(F.regexp_extract(answer, r"(?s)(\{.*\})", 1), "action string, reason string")
    action = F.when(body["action"].isin("publish", "review", "redo"), body["action"]).otherwise(F.lit("review"))
    failed = F.when(score >= 88, F.lit("publish")).otherwise(F.lit("review"))
    chosen = F.when(score < 70, F.lit("redo")).when(answer.isNull(), failed).otherwise(action)
    return F.struct(chosen.alias("action"), F.coalesce(F.when((score >= 70) & answer.isNotNull(), body["reason"]), F.lit("")).alias("reason"))


def added(after: DataFrame, before: DataFrame, key: str) -> DataFrame:
    """What is there after and was not before, in order."""
    return after.select(key).distinct().join(before.select(key), key, "left_anti").orderBy(key)


def insert(state: DataFrame, new: DataFrame, keys: list[str], now, skip_if_exists: bool = True) -> DataFrame:
    """Rows to append to the log for new items (keys, title), all pending: those that the state lacks, or all, which
    sets what is there back."""
    items = new.dropDuplicates(keys)
    if skip_if_exists:
        items = items.join(state.select(*keys), keys, "left_anti")
    return items.select(*keys, F.lit("pending").alias("status"), "title", now.alias("at"))


def lookup(state: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, present, status) of the items asked for."""
    known = state.select(*keys, "status").withColumn("present", F.lit(True))
    return wanted.select(*keys).distinct().join(known, keys, "left").select(*keys, F.coalesce("present", F.lit(False)).alias("present"), "status")


def popular(comments: DataFrame, first: int = 50, most: int = 30, by: list[str] | None = None) -> DataFrame:
    """(by, pos, score, text) of comments (by, pos, votes, reply_count, text): of the first so many of each group those with most votes and
    answers, an answer worth ten votes; texts cut at 300 characters."""
    scored = comments.withColumn("score", F.col("votes") + 10 * F.col("reply_count"))
    groups = by or []
    at = Window.partitionBy(*groups) if groups else None
    if at is None:
        top = scored.orderBy("pos").limit(first).orderBy(F.desc("score"), "pos").limit(most)
    else:
        met = scored.withColumn("_k", F.row_number().over(at.orderBy("pos"))).where(F.col("_k") <= first)
        top = met.withColumn("_k", F.row_number().over(at.orderBy(F.desc("score"), "pos"))).where(F.col("_k") <= most)
    return top.select(*groups, "pos", "score", F.substring("text", 1, 300).alias("text"))

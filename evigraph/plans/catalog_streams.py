"""Query catalogue, streams: tables replayed as streams of files, with the SQL that reads the whole table at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.plans.catalog import query, table
from evigraph.shared import new_dir, settings
from evigraph.streaming import registry_state


def replayed(spark: SparkSession, batches: list[DataFrame], transform, last: DataFrame) -> DataFrame:
    """What a stream makes of ``batches``, each a batch of as many files as there are cores, and of ``last`` after a restart from its checkpoint."""
    folder, out, checkpoint = (new_dir(spark, f"replay-{n}") for n in ("in", "out", "checkpoint"))
    cores = spark.sparkContext.defaultParallelism

    def run() -> None:
        stream = spark.readStream.schema(last.schema).option("maxFilesPerTrigger", cores).parquet(folder)
        transform(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    with settings(spark, spark__sql__streaming__stateStore__providerClass=registry_state.STORE, spark__sql__shuffle__partitions=str(cores)):
        for batch in batches:
            batch.repartition(cores).write.mode("append").parquet(folder)
        run()
        last.coalesce(1).write.mode("append").parquet(folder)
        run()
    return spark.read.parquet(out)


#: What each event asks of its item (a user).
_ACTIONS = {"signup": "add", "view": "processing", "purchase": "done", "error": "failed", "click": "retry"}


@query("""WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
f AS (SELECT e.*, first_k FROM e JOIN (SELECT user_id, min(k) AS first_k FROM e WHERE event_type = 'signup' GROUP BY user_id) USING (user_id) WHERE k = first_k OR (k > first_k AND event_type <> 'signup')),
s AS (SELECT *, CASE event_type WHEN 'view' THEN 'processing' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' ELSE 'pending' END AS status,
  last_value(CASE WHEN event_type = 'purchase' AND event_id % 4 <> 0 THEN 'T' || props WHEN event_type = 'signup' THEN 'first' END IGNORE NULLS) OVER w AS title,
  last_value(CASE event_type WHEN 'error' THEN substr(repeat(props, 60), 1, 500) WHEN 'view' THEN NULL ELSE '' END IGNORE NULLS) OVER w AS error,
  last_value(CASE event_type WHEN 'view' THEN NULL WHEN 'purchase' THEN epoch_us(ts) WHEN 'error' THEN epoch_us(ts) ELSE -1 END IGNORE NULLS) OVER w AS done_at FROM f WINDOW w AS (PARTITION BY user_id ORDER BY k))
SELECT user_id, event_id AS seq, status, title, error, nullif(done_at, -1) AS processed_us FROM s""")
def registry_stream(spark, sf_dir):
    """The registry's log by keyed state: events in three batches of files, out of order, a tenth of them twice, some undated."""
    events = table(spark, sf_dir, "events")
    kind = F.create_map(*[F.lit(x) for kv in _ACTIONS.items() for x in kv])[F.col("event_type")]
    done = F.when(F.col("event_id") % 4 != 0, F.concat(F.lit("T"), F.col("props"))).otherwise("")
    ts = F.col("ts").cast("timestamp")
    actions = events.select(
        "user_id", F.col("event_id").alias("seq"), kind.alias("action"), F.when(F.col("event_type") == "signup", "first").otherwise(done).alias("title"),
        F.repeat("props", F.lit(60)).alias("error"), F.when(F.col("event_id") % 50 != 0, ts).alias("at"), ts.alias("seen"),
    )
    parts = [actions.where((F.col("seq") % 3 == k) | (F.lit(k == 2) & (F.col("seq") % 10 == 0))) for k in range(3)]
    after = events.agg(F.max(ts).alias("t")).select(F.lit(-1).cast("long").alias("user_id"), F.lit(-1).cast("long").alias("seq"), F.lit("none").alias("action"), F.lit("").alias("title"), F.lit("").alias("error"), (F.col("t") + F.expr("INTERVAL 60 DAYS")).alias("at"), F.col("t").alias("seen"))
    made = replayed(spark, parts, lambda stream: registry_state.registry_log(stream, ["user_id"], "31 days"), after)
    return made.select("user_id", "seq", "status", "title", "error", F.unix_micros("processed_at").alias("processed_us"))

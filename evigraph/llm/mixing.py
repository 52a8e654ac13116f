"""Mixing sources to target weights by hierarchical budgeting (operator 1); DataFrame functions only.

A token budget goes down a tree of levels (domain, language, source).  Among siblings it is shared by weight; a
node that can't use its share (its tokens times ``max_epochs``) takes what it can, and what it leaves goes to its
siblings by weight.  A parent's limit is the sum of its children's, so a shortage leaves the parent only when
every sibling is full: siblings before ancestors.  The level is found without iteration: in order of
limit per weight, the first node that its share fits fixes the share of all after it.

A leaf's documents are read in seeded epochs: in each a new order, by a hash of seed, epoch and key.  The leaf takes the
prefix of that stream which holds its tokens: whole epochs, then the first documents of the next, the
last of them in part.  The running sum over an epoch is taken in two steps, over hash ranges and then
within the one range where the prefix ends.  Leaves with more than a thousandth of all documents (a thousand at most) are
joined to their documents by broadcast, so that a hot source is never one task; the others by an exchange.

Rows: a null level is a node of its own (named by the empty string); null text and key are read as empty, null tokens as none;
documents without tokens are never taken; nodes of weight 0 get nothing; rows that repeat key and text
are documents of their own, next to each other in the order of an epoch; an empty table or budget gives an empty result.  Columns of the input pass
through; names that begin with ``_mix`` are the operator's.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigraph.llm._store import stage

#: Words: runs of other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Documents of a leaf's hash range.
RANGE_ROWS = 1_000
#: A leaf is hot if it has more than this part of all documents.
HOT = 1 / 1000


def words(text: Column) -> Column:
    """Tokens as this operator counts them: words of a text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _weight(names: list[str], weights: Mapping[str, float]) -> Column:
    """Weight of a node: of its path ``a/b/c``, else of its own name at this depth ``*/*/c``, else 1."""
    path = F.concat_ws("/", *names)
    own = F.concat(F.lit("*/" * (len(names) - 1)), F.col(names[-1]))
    if not weights:
        return F.lit(1.0)
    table = F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, float(v))])
    return F.coalesce(table[path], table[own], F.lit(1.0))


def _share(nodes: DataFrame, parents: list[str], name: str) -> DataFrame:
    """Adds ``_mix_share`` to siblings with ``_mix_weight``, ``_mix_limit`` and their parent's ``_mix_budget``."""
    order = (F.when(F.col("_mix_weight") > 0, F.col("_mix_limit") / F.col("_mix_weight")), F.col(name))
    siblings = Window.partitionBy(*parents)
    ranked = siblings.orderBy(order[0].asc_nulls_last(), order[1])
    before = F.coalesce(F.sum("_mix_limit").over(ranked.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("_mix_weight").over(ranked.rowsBetween(0, Window.unboundedFollowing))
    level = F.when(rest > 0, (F.col("_mix_budget") - before) / rest)
    fits = level * F.col("_mix_weight") <= F.col("_mix_limit")
    leveled = nodes.withColumn("_mix_level", level).withColumn("_mix_level", F.when(fits & (F.col("_mix_weight") > 0), F.col("_mix_level")))
    reached = F.max("_mix_level").over(siblings)
    share = F.when(F.col("_mix_weight") <= 0, F.lit(0.0)).otherwise(F.least("_mix_limit", F.coalesce(reached * F.col("_mix_weight"), "_mix_limit")))
    return leveled.withColumn("_mix_share", share).drop("_mix_level")


def budgets(leaves: DataFrame, levels: list[str], weights: Mapping[str, float], budget: float | None, share: float, max_epochs: int) -> DataFrame:
    """Leaves (levels, ``_mix_total``, ``_mix_rows``) with their whole tokens ``_mix_take``.  The budget is
    ``budget`` tokens, or the part ``share`` of all there are."""
    known = leaves
    for i in range(len(levels)):
        known = known.withColumn(f"_mix_w{i}", _weight(levels[: i + 1], weights))
    usable = F.greatest(F.lit(0.0), F.least(*[F.col(f"_mix_w{i}") for i in range(len(levels))])) > 0 if len(levels) > 1 else F.col("_mix_w0") > 0
    known = known.withColumn("_mix_limit", F.when(usable, F.col("_mix_total").cast("double") * max_epochs).otherwise(F.lit(0.0)))
    if budget is None:  # one number
        budget = math.floor(float(leaves.agg(F.coalesce(F.sum("_mix_total"), F.lit(0))).first()[0]) * float(share))
    above = None
    for i, name in enumerate(levels):
        parents = levels[:i]
        nodes = known.groupBy(*parents, name).agg(F.sum("_mix_limit").alias("_mix_limit"), F.first(f"_mix_w{i}").alias("_mix_weight"))
        nodes = nodes.join(above, parents) if parents else nodes.withColumn("_mix_budget", F.lit(float(budget)))
        above = _share(nodes, parents, name).select(*parents, name, F.col("_mix_share").alias("_mix_budget"))
    return leaves.join(above, levels).withColumn("_mix_take", F.floor(F.col("_mix_budget") + F.lit(1e-6)).cast("long")).drop("_mix_budget")


def mix(
    df: DataFrame, levels: list[str], weights: Mapping[str, float], key: str = "doc_id", tokens: str = "n_tokens",
    budget: float | None = None, share: float = 1.0, max_epochs: int = 4, seed: int = 0,
) -> DataFrame:
    """Rows of ``df`` that the mixture takes, one per epoch, with ``epoch`` and ``taken_tokens``.

    ``df`` carries each document's ``tokens``; it is read several times, so it should be a slim table
    (``counted``) to which texts are joined afterwards (``with_text``)."""
    named = [f"_mix_l{i}" for i in range(len(levels))]
    docs = df.withColumn("_mix_tokens", F.coalesce(F.col(tokens), F.lit(0)).cast("long"))
    for name, level in zip(named, levels, strict=True):
        docs = docs.withColumn(name, F.coalesce(F.col(level).cast("string"), F.lit("")))
    docs = docs.where("_mix_tokens > 0")
    leaves = docs.groupBy(*named).agg(F.sum("_mix_tokens").alias("_mix_total"), F.count("*").alias("_mix_rows"))
    plan = budgets(leaves, named, weights, budget, share, max_epochs).where("_mix_take > 0")
    plan = plan.withColumn("_mix_whole", F.floor(F.col("_mix_take") / F.col("_mix_total")).cast("int"))
    plan = plan.withColumn("_mix_rest", F.col("_mix_take") - F.col("_mix_whole") * F.col("_mix_total"))
    digits = F.greatest(F.lit(1), F.ceil(F.log(16.0, F.col("_mix_rows") / RANGE_ROWS))).cast("int")
    plan = plan.withColumn("_mix_digits", digits).drop("_mix_total", "_mix_take")
    plan = stage(plan, "plan")
    n = plan.agg(F.sum("_mix_rows")).first()[0] or 0
    hot = F.broadcast(plan.where(F.col("_mix_rows") > n * HOT))
    others = docs.join(hot.select(*named), named, "left_anti").join(plan.where(F.col("_mix_rows") <= n * HOT), named)

    ordered = docs.join(hot, named).unionByName(others).drop("_mix_rows").withColumn(
        "_mix_hash", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("_mix_whole").cast("string"), F.coalesce(F.col(key).cast("string"), F.lit(""))))
    ).withColumn("_mix_range", F.substring(F.col("_mix_hash"), F.lit(1), F.col("_mix_digits")))
    ordered = stage(ordered, "ordered")  # four branches read it: as one plan they are too large for a small driver
    ranges = ordered.where("_mix_rest > 0").groupBy(*named, "_mix_range", "_mix_rest").agg(F.sum("_mix_tokens").alias("_mix_sum"))
    ahead = Window.partitionBy(*named).orderBy("_mix_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("_mix_before", F.coalesce(F.sum("_mix_sum").over(ahead), F.lit(0))).where("_mix_before < _mix_rest")
    ranges = ranges.withColumn("_mix_inside", F.col("_mix_before") + F.col("_mix_sum") <= F.col("_mix_rest"))
    ranges = stage(ranges.drop("_mix_sum", "_mix_rest"), "ranges")
    begun = ordered.join(ranges.select(*named, "_mix_range", "_mix_before", "_mix_inside"), [*named, "_mix_range"])

    inside = begun.where("_mix_inside").withColumn("_mix_taken", F.col("_mix_tokens"))
    # Where the prefix ends: rows that repeat a document are one row with a count, which is cut and dealt out again.
    last = begun.where("not _mix_inside")
    last = last.groupBy(*last.columns).agg(F.count("*").alias("_mix_copies"))
    within = Window.partitionBy(*named, "_mix_range").orderBy("_mix_hash", "_mix_tokens", *_rest_of(last)).rowsBetween(Window.unboundedPreceding, -1)
    last = last.withColumn("_mix_ahead", F.col("_mix_before") + F.coalesce(F.sum(F.col("_mix_tokens") * F.col("_mix_copies")).over(within), F.lit(0)))
    last = last.withColumn("_mix_left", F.least(F.col("_mix_tokens") * F.col("_mix_copies"), F.col("_mix_rest") - F.col("_mix_ahead"))).where("_mix_left > 0")
    last = last.withColumn("_mix_no", F.explode(F.sequence(F.lit(0), F.ceil(F.col("_mix_left") / F.col("_mix_tokens")).cast("long") - 1)))
    last = last.withColumn("_mix_taken", F.least("_mix_tokens", F.col("_mix_left") - F.col("_mix_no") * F.col("_mix_tokens")))
    whole = ordered.where("_mix_whole > 0").withColumn("_mix_epoch", F.explode(F.sequence(F.lit(0), F.col("_mix_whole") - 1)))

    kept = [c for c in df.columns if c not in ("epoch", "taken_tokens")]

    def result(part: DataFrame, epoch: str, taken: str) -> DataFrame:
        return part.select(*kept, F.col(epoch).cast("int").alias("epoch"), F.col(taken).alias("taken_tokens"))

    return (
        result(whole, "_mix_epoch", "_mix_tokens")
        .unionByName(result(inside, "_mix_whole", "_mix_taken"))
        .unionByName(result(last, "_mix_whole", "_mix_taken"))
    )


def _rest_of(df: DataFrame) -> list[str]:
    """The input's columns that can be ordered: they settle ties between different documents of one key."""
    return [c for c, kind in df.dtypes if not c.startswith("_mix") and not kind.startswith(("map", "variant"))]


def counted(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The slim table of a corpus: the columns ``keep``, ``n_tokens`` and ``text_hash``, a row for each row; texts are
    read once."""
    return stage(df.select(*keep, words(F.col(text)).alias("n_tokens"), F.xxhash64(F.col(text)).alias("text_hash")), "counted")


def with_text(mixed: DataFrame, df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Rows of ``df`` as often as the mixture took them; of a document taken in part the first words, joined by single
    blanks.  ``keep`` are columns of both (those of ``counted``); rows that agree in them and in their text are one row
    with a count, and the other columns are those of one of them."""
    names = {c: f"_mix_{i}" for i, c in enumerate([*keep, "text_hash"])}
    taken = mixed.select(*[F.col(c).alias(n) for c, n in names.items()], F.col("n_tokens").alias("_mix_all"), F.col("taken_tokens").alias("_mix_taken"))
    taken = stage(taken.groupBy(*taken.columns).agg(F.count("*").alias("_mix_times")), "taken")
    rows = df.withColumn("_mix_same", F.xxhash64(F.col(text)))
    same = [F.col(c).eqNullSafe(F.col(names[c])) for c in keep] + [F.col("_mix_same") == F.col(names["text_hash"])]
    rows = rows.dropDuplicates([*keep, "_mix_same"]).join(taken, same).withColumn("_mix_no", F.explode(F.sequence(F.lit(1), F.col("_mix_times"))))
    first = F.array_join(F.slice(F.regexp_extract_all(F.col(text), F.lit(f"({WORD})"), F.lit(1)), F.lit(1), F.col("_mix_taken").cast("int")), " ")
    cut = F.when(F.col("_mix_taken") < F.col("_mix_all"), first).otherwise(F.col(text))
    return rows.select(*[cut.alias(c) if c == text else F.col(c) for c in df.columns])

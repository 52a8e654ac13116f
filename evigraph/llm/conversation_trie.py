"""Prefix trie of conversations by partition refinement (operator 11).

All sequences of turns begin in one class.  A round looks at the next turns of the classes that still hold several different sequences: where
all members agree, the class goes on as one chain of nodes; at the first turn where they don't, it is split by that turn.  Classes
of one sequence retire at once, and their tails become chains.  Rounds fold back what the chains hold, last round first.  So a trie is
a table of chains (segments), and the rounds are as many as a path has splits, not turns.

What moves are digests (SHA-256 of role and text), not texts, and a sequence that many conversations share is refined once, with their
number: copies are told by count and 128 bits over places and digests.  The members of a class never meet in a task: classes are aggregates
with map-side combination.  The list of a group of copies, whose SHA-256 has to be taken in order, is streamed through its task, not held.

Rows: turns come by number, null first, then role and text; a null role or text is empty; repeated rows are turns of their own; rows
without a conversation are left out; no conversations give no nodes.  Extra columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigraph.llm._store import discard, stage

#: Rows of a conversation that a window numbers or sums at a time.
BLOCK = 4096
#: Turns that the first round looks ahead; twice as many in each round after it.
AHEAD, MOST_AHEAD = 8, 1 << 14
NOTHING = hashlib.sha256(b"").hexdigest()


def _before(df: DataFrame, keys: list[str], block: str, value: Column, name: str) -> DataFrame:
    """(keys, block, name): the sum of ``value`` over a key's earlier blocks."""
    order = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    return df.groupBy(*keys, block).agg(value.alias("_v")).select(*keys, block, F.coalesce(F.sum("_v").over(order), F.lit(0)).alias(name))


def numbered(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, pos, digest, bytes): the turns of each conversation in order, counted from 0.  The turns are numbered within
    blocks of their own numbers, so that a conversation of very many turns isn't one task's."""
    said, by = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (text, role))
    digest = F.unhex(F.sha2(F.concat(F.length(by).cast("string"), F.lit(":"), by, said), 256))
    rows = turns.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv_id"), F.floor(F.col(turn) / BLOCK).alias("_b"), F.col(turn).alias("_turn"), by.alias("_by"), digest.alias("digest"),
        said.alias("_said"), F.octet_length(said).cast("long").alias("bytes"),
    )
    rows = rows.withColumn("_b", F.coalesce("_b", F.lit(-(1 << 62))))
    order = Window.partitionBy("conv_id", "_b").orderBy(F.col("_turn").asc_nulls_first(), "_by", "_said")
    own = rows.withColumn("_n", F.row_number().over(order) - 1).drop("_turn", "_by", "_said")
    return own.join(_before(rows, ["conv_id"], "_b", F.count("*"), "_o"), ["conv_id", "_b"]).select("conv_id", (F.col("_o") + F.col("_n")).cast("long").alias("pos"), "digest", "bytes")


def with_openings(turns: DataFrame, every: int = 5, most: int = 9) -> DataFrame:
    """Numbered turns of rebuilt conversations: c takes the first h turns of conversation c - c % ``every`` (all, if fewer) in
    place of its own first h, h being the CRC-32 of its number modulo ``most``.  A conversation that is left without turns has one
    row of nulls."""
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("_size"))
    h = F.crc32(F.col("conv_id").cast("string")) % most
    plan = sizes.select("conv_id", (F.col("conv_id") - F.pmod("conv_id", F.lit(every))).alias("_from"), h.alias("_h"))
    given = sizes.select(F.col("conv_id").alias("_from"), F.col("_size").alias("_there"))
    plan = plan.join(given, "_from", "left").withColumn("_there", F.least("_h", F.coalesce("_there", F.lit(0))))
    opening = plan.join(turns.withColumnRenamed("conv_id", "_from"), "_from").where("pos < _h").select("conv_id", "pos", "digest", "bytes")
    own = plan.select("conv_id", "_h", "_there").join(turns, "conv_id").where("pos >= _h").select("conv_id", (F.col("pos") - F.col("_h") + F.col("_there")).alias("pos"), "digest", "bytes")
    made = opening.unionByName(own)
    none = plan.select("conv_id").join(made.select("conv_id").distinct(), "conv_id", "left_anti")
    return made.unionByName(none, allowMissingColumns=True)


def _copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each run of equal sequences, whose conversations come in order: the first, how many, and the SHA-256 of all."""
    key = first = digest = None
    n, out = 0, []

    def made() -> pa.RecordBatch:
        names = ["sid", "size", "n_convs", "ends_sha256"]
        batch = pa.record_batch([pa.array(c, pa.string() if i == 3 else pa.int64()) for i, c in enumerate(zip(*out, strict=True))], names)
        out.clear()
        return batch

    for batch in batches:
        for conv, *sequence in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if sequence == key:
                digest.update(b",%d" % conv)
                n += 1
                continue
            if key is not None:
                out.append((first, key[0], n, digest.hexdigest()))
            key, first, n, digest = sequence, conv, 1, hashlib.sha256(b"%d" % conv)
        if len(out) > 10_000:
            yield made()
    if key is not None:
        out.append((first, key[0], n, digest.hexdigest()))
        yield made()


def _sequences(turns: DataFrame) -> DataFrame:
    """(sid, size, n_convs, ends_sha256): each different sequence by its smallest conversation."""
    there = F.col("pos").isNotNull()
    a, b = (F.coalesce(F.expr(f"bit_xor(CASE WHEN pos IS NOT NULL THEN xxhash64({x}) END)"), F.lit(0)) for x in ("pos, digest", "7, digest, pos"))
    told = turns.groupBy("conv_id").agg(F.count(F.when(there, 1)).alias("size"), a.alias("a"), b.alias("b"))
    sorted_ = told.select("conv_id", "size", "a", "b").repartition("size", "a", "b").sortWithinPartitions("size", "a", "b", "conv_id")
    return sorted_.mapInArrow(_copies, "sid long, size long, n_convs long, ends_sha256 string")


def trie(turns: DataFrame) -> DataFrame:
    """Nodes of the trie of numbered turns (a conversation without turns: one row of nulls beside its number).

    conv_id (the node's smallest member) and depth name a node; parent_conv_id is its parent's conv_id at depth - 1; n_convs,
    n_children, n_leaves, saved_tokens (bytes of the last texts that a trie holds once, not for each member, over the subtree) and
    ends_sha256 (SHA-256 of the conversations that end here, in order, joined by commas)."""
    made: list[DataFrame] = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        made.append(stage(df, name))
        return made[-1]

    turns = keep(turns, "trie-turns")
    sequences = keep(_sequences(turns), "trie-sequences")
    # Turns of the different sequences, with the bytes up to each; the root is the first sequence's turn -1.
    top = sequences.agg(F.min("sid").alias("sid"), F.sum("n_convs").alias("n_convs"), F.count("*").alias("n_seqs"))
    own = turns.where("pos IS NOT NULL").withColumnRenamed("conv_id", "sid").join(sequences.select("sid"), "sid", "left_semi").withColumn("_b", F.floor(F.col("pos") / BLOCK))
    up_to = Window.partitionBy("sid", "_b").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    summed = own.withColumn("_c", F.sum("bytes").over(up_to)).join(_before(own, ["sid"], "_b", F.sum("bytes"), "_o"), ["sid", "_b"])
    path = summed.select("sid", "pos", "digest", "bytes", (F.col("_o") + F.col("_c")).alias("so_far"))
    root = top.where("sid IS NOT NULL").selectExpr("sid", "-1L AS pos", "CAST(NULL AS binary) AS digest", "0L AS bytes", "0L AS so_far")
    path = keep(path.unionByName(root), "trie-path")

    # Chains by level: (conv, start, end, parent, n_convs, n_children); nodes are the places from start up to before end.
    open_ = top.where("sid IS NOT NULL").selectExpr("sid AS conv", "-1L AS start", "CAST(NULL AS bigint) AS parent", "n_convs", "n_seqs")
    active = keep(sequences.select("sid", "n_convs").crossJoin(F.broadcast(top.selectExpr("sid AS conv", "n_seqs"))).withColumn("at", F.lit(0).cast("long")), "trie-active")
    levels: list[DataFrame] = []
    ended: list[DataFrame] = []
    retired, ahead = None, AHEAD
    while True:
        seen = active.join(path.select("sid", "pos", "digest"), "sid").where((F.col("pos") >= F.col("at")) & (F.col("pos") < F.col("at") + ahead))
        steps = seen.groupBy("conv", "pos").agg(F.count("*").alias("c"), F.min("digest").alias("lo"), F.max("digest").alias("hi"), F.min("n_seqs").alias("n"))
        apart = F.min(F.when((F.col("c") < F.col("n")) | (F.col("lo") != F.col("hi")), F.col("pos")))
        until = steps.groupBy("conv").agg(F.coalesce(apart, F.max("pos") + 1).alias("until"))
        at = active.join(until, "conv", "left").withColumn("end", F.coalesce("until", "at"))
        split = at.join(path.select("sid", F.col("pos").alias("end"), "digest"), ["sid", "end"], "left").select("sid", "conv", "end", "n_convs", "digest")
        split = keep(split, "trie-split")
        kids = split.where("digest IS NOT NULL").groupBy("conv", "end", "digest").agg(F.min("sid").alias("child"), F.count("*").alias("n_seqs"), F.sum("n_convs").alias("n_convs"))
        kids = keep(kids, "trie-kids")
        chains = open_.drop("n_seqs").join(split.groupBy("conv").agg(F.min("end").alias("end")), "conv")
        chains = chains.join(kids.groupBy("conv").agg(F.count("*").alias("n_children")), "conv", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
        levels.append(chains if retired is None else chains.unionByName(retired))
        ended.append(split.where("digest IS NULL").select("sid", F.col("conv").alias("conv_id"), F.col("end").alias("depth")))
        single = kids.where("n_seqs = 1").join(sequences.select(F.col("sid").alias("child"), "size"), "child")
        retired = single.selectExpr("child AS conv", "end AS start", "size AS end", "conv AS parent", "n_convs", "0L AS n_children")
        ended.append(retired.select(F.col("conv").alias("sid"), F.col("conv").alias("conv_id"), F.col("end").alias("depth")))
        more = kids.where("n_seqs > 1")
        if more.isEmpty():
            levels.append(retired)
            break
        open_ = more.selectExpr("child AS conv", "end AS start", "conv AS parent", "n_convs", "n_seqs")
        rest = split.select("sid", "conv", "digest", "n_convs").join(more.select("conv", "digest", "child", "n_seqs", "end"), ["conv", "digest"])
        active = keep(rest.select("sid", "n_convs", F.col("child").alias("conv"), "n_seqs", (F.col("end") + 1).alias("at")), "trie-active")
        ahead = min(2 * ahead, MOST_AHEAD)

    # Fold back: leaves and saved bytes below each chain, from the last level up.
    below, folded = None, []
    place = (F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("end"))
    steps = path.withColumnRenamed("sid", "conv")
    for chains in reversed(levels):
        held = chains.join(steps, "conv").where(place).groupBy("conv", "start").agg(F.sum("bytes").alias("own"), F.max("so_far").alias("all"))
        chains = chains.join(held, ["conv", "start"])
        if below is None:
            chains = chains.withColumns({"leaves": F.lit(1).cast("long"), "under": F.lit(0).cast("long")})
        else:
            sums = below.groupBy(F.col("parent").alias("conv"), F.col("start").alias("end")).agg(F.sum("leaves").alias("leaves"), F.sum(F.col("under") + (F.col("n_convs") - 1) * F.col("own")).alias("under"))
            chains = chains.join(sums, ["conv", "end"], "left").withColumns({"leaves": F.coalesce("leaves", F.lit(1)), "under": F.coalesce("under", F.lit(0))})
        below = keep(chains.select("conv", "start", "end", "parent", "n_convs", "n_children", "own", "all", "leaves", "under"), "trie-folded")
        folded.append(below)

    union = lambda parts: parts[0] if len(parts) == 1 else union([a.unionByName(b) for a, b in zip(parts[::2], parts[1::2], strict=False)] + parts[len(parts) - len(parts) % 2 :])
    nodes = union(folded).join(steps, "conv").where(place)
    ends = union(ended).join(sequences.select("sid", "ends_sha256"), "sid").select("conv_id", "depth", "ends_sha256")
    nodes = nodes.select(
        F.col("conv").alias("conv_id"), (F.col("pos") + 1).alias("depth"), F.when(F.col("pos") == F.col("start"), F.col("parent")).otherwise(F.col("conv")).alias("parent_conv_id"),
        "n_convs", F.when(F.col("pos") == F.col("end") - 1, F.col("n_children")).otherwise(1).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"),
        (F.col("under") + (F.col("n_convs") - 1) * (F.col("all") - F.col("so_far") + F.col("bytes"))).alias("saved_tokens"),
    )
    result = stage(nodes.join(ends, ["conv_id", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NOTHING))), "trie")
    for table in made:
        discard(table)
    return result

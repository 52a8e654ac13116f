"""Fact-check and repair of documents, many at once: claims, evidence, verdicts, scores, rewrites, again."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.operators import retrieval
from evigraph.plans.providers import ModelProvider
from evigraph.shared import written


@dataclass(frozen=True)
class RefineConfig:
    threshold: float = 95.0
    max_iter: int = 5
    max_claims: int = 50
    top_k: int = 5


def claims_of(documents: DataFrame, config: RefineConfig = RefineConfig()) -> DataFrame:
    """(doc_id, claim_no, claim): sentences of more than ten characters, each once, the first ``max_claims``."""
    sentences = F.array_distinct(F.transform(F.split("text", r"(?<=[.!?。])\s+|\n"), lambda s: F.trim(s)))
    kept = F.slice(F.filter(sentences, lambda s: F.length(s) > 10), 1, config.max_claims)
    return documents.select("doc_id", F.posexplode(kept).alias("claim_no", "claim"))


def evidence_of(claims: DataFrame, chunks: DataFrame, config: RefineConfig = RefineConfig(), index: retrieval.Index | None = None) -> DataFrame:
    """(claim, evidence): the best chunks of each different claim."""
    keyed = claims.select("claim").distinct().withColumn("claim_id", F.xxhash64("claim"))
    found = retrieval.top_k(keyed, index or chunks, config.top_k)
    texts = found.join(chunks.select("chunk_id", "chunk"), "chunk_id")
    evidence = F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk"))), lambda x: x["chunk"])
    known = keyed.join(texts.groupBy("claim_id").agg(evidence.alias("evidence")), "claim_id", "left")
    return known.select("claim", F.coalesce("evidence", F.array().cast("array<string>")).alias("evidence"))


def verified(
    claims: DataFrame, chunks: DataFrame, provider: ModelProvider, config: RefineConfig = RefineConfig(), index: retrieval.Index | None = None,
    evidence: DataFrame | None = None,
) -> DataFrame:
    """(doc_id, claim_no, claim, verdict, reason, evidence).  A claim without evidence is unverifiable unasked.  ``index``: that of
    the chunks, if there is one; ``evidence``: that of all claims, if it is known (``evidence_of``)."""
    if evidence is None:
        evidence = written(evidence_of(claims, chunks, config, index), "evidence")
    known = claims.drop("evidence").join(evidence, "claim", "left").withColumn("evidence", F.coalesce("evidence", F.array().cast("array<string>")))
    prompt = F.concat(F.lit("Claim: "), F.col("claim"), F.lit("\nEvidence:\n"), F.array_join("evidence", "\n---\n"))
    asked = provider.ask(known.where(F.size("evidence") > 0).withColumn("prompt", prompt))
    judged = asked.select("doc_id", "claim_no", "claim", retrieval.parse_verdict(F.coalesce("answer", F.lit(""))).alias("v"), "evidence")
    judged = judged.select("doc_id", "claim_no", "claim", "v.verdict", "v.reason", "evidence")
    bare = known.where(F.size("evidence") == 0).select("doc_id", "claim_no", "claim", F.lit("unverifiable").alias("verdict"), F.lit("").alias("reason"), "evidence")
    return judged.unionByName(bare)


def refine(
    documents: DataFrame, chunks: DataFrame, provider: ModelProvider, rewrite: Callable[[DataFrame, DataFrame], DataFrame],
    config: RefineConfig = RefineConfig(), store: Callable[[DataFrame], DataFrame] = lambda df: written(df, "refine"),
) -> DataFrame:
    """(doc_id, text, score, iterations) of documents (doc_id, text).

    Each round scores what is still open, keeps a document's best version so far, and lets ``rewrite(open
    documents, verdicts)`` give (doc_id, text, n_fixed).  A document ends at the threshold, with its best version
    after the last round, or as it stands when nothing was fixed.  The rounds are the driver's; their
    tables are written, so that a round's plan does not hold all before it.  The chunks are indexed once for all rounds, and searched
    only for claims that no round before had."""
    index = retrieval.Index.of(chunks)
    state = documents.select("doc_id", "text", F.lit(-1.0).alias("best_score"), F.col("text").alias("best_text"), F.lit(0).alias("iterations"))
    done: DataFrame | None = None
    evidence: DataFrame | None = None
    for turn in range(1, config.max_iter + 1):
        claims = store(claims_of(state, config))
        new = claims if evidence is None else claims.join(evidence, "claim", "left_anti")
        if evidence is None or not new.isEmpty():
            more = store(evidence_of(new, chunks, config, index))
            evidence = more if evidence is None else evidence.unionByName(more)
        verdicts = store(verified(claims, chunks, provider, config, evidence=evidence))
        scored = state.join(retrieval.confidence(verdicts, ["doc_id"]), "doc_id", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
        better = F.col("score") > F.col("best_score")
        scored = scored.withColumn("best_text", F.when(better, F.col("text")).otherwise(F.col("best_text"))).withColumn("best_score", F.greatest("score", "best_score"))
        fixed = rewrite(scored.select("doc_id", "text"), verdicts).select("doc_id", F.col("text").alias("_new"), "n_fixed")
        scored = store(scored.join(fixed, "doc_id", "left").withColumn("n_fixed", F.coalesce("n_fixed", F.lit(0))).withColumn("iterations", F.lit(turn)))
        reached, idle = F.col("score") >= config.threshold, F.col("n_fixed") == 0
        last = F.lit(turn == config.max_iter)
        text = F.when(reached | ~last & idle, F.col("text")).otherwise(F.col("best_text"))
        score = F.when(reached | ~last & idle, F.col("score")).otherwise(F.col("best_score"))
        ended = scored.where(reached | idle | last).select("doc_id", text.alias("text"), score.alias("score"), "iterations")
        done = ended if done is None else done.unionByName(ended)
        state = scored.where(~(reached | idle | last)).select("doc_id", F.coalesce("_new", "text").alias("text"), "best_score", "best_text", "iterations")
        if turn < config.max_iter and state.isEmpty():
            break
    return done

"""BM25 evidence retrieval and verdict scoring as relational operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evigraph.functions.text import tokenize, word_set
from evigraph.shared import widened, written

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Claim tokens (over all claims) that are broadcast at a time.
MOST_ASKED = 1_000_000
#: Bytes of the dense weights of a block of claims, rows that are scored at a time, and rows that a task holds before it keeps the best.
BLOCK_BYTES, ROW_BLOCK, MOST_HELD = 16 << 20, 512, 200_000
#: Marks in the table of counts: the number of chunks, and their tokens in all.
_ALL, _SIZE = "", " "


def _counts(chunks: DataFrame, k: str) -> DataFrame:
    """(token, n): in how many chunks each token is, with two marks; one pass, map-side partial sums."""
    one = F.transform(F.array_distinct(k), lambda t: F.struct(t.alias("token"), F.lit(1).cast("long").alias("n")))
    marks = F.array(*[F.struct(F.lit(m).alias("token"), n.cast("long").alias("n")) for m, n in ((_ALL, F.lit(1)), (_SIZE, F.size(k)))])
    return chunks.select(F.explode(F.concat(one, marks)).alias("e")).groupBy("e.token").agg(F.sum("e.n").alias("n"))


def _weights(counts: DataFrame) -> DataFrame:
    n = F.coalesce(counts.where(F.col("token") == _ALL).agg(F.max("n")).scalar(), F.lit(0)).cast("double")
    raw = counts.where(~F.col("token").isin(_ALL, _SIZE)).withColumn("raw", F.log(n - F.col("n") + 0.5) - F.log(F.col("n") + 0.5))
    mean = raw.agg(F.avg("raw")).scalar()
    return raw.select("token", F.col("n").alias("df"), F.when(F.col("raw") < 0, EPSILON * mean).otherwise(F.col("raw")).alias("idf"))


def term_weights(chunks: DataFrame, k: str = "tokens") -> DataFrame:
    """(token, df, idf): idf may be negative; then it is ``EPSILON`` times the mean of all raw values.

    Distinct tokens are counted with map-side partial sums; only one number per token is shuffled."""
    return _weights(_counts(chunks, k))


class _Asked:
    """Weighted tokens of claims, sparse: what is broadcast is as many numbers as there are asked tokens.  Workers make the dense weights
    of a block of claims at a time, of ``BLOCK_BYTES`` at most (a claim of very many tokens alone may have more)."""

    def __init__(self, rows: pa.Table, claim: str, average: float = 1.0):
        rows = rows.sort_by([(claim, "ascending"), ("token", "ascending")])
        names, tokens = rows[claim].combine_chunks().dictionary_encode(), rows["token"].combine_chunks().dictionary_encode()
        self.names, self.vocabulary, self.average = names.dictionary, tokens.dictionary, average
        self.claim, self.token = names.indices.to_numpy().astype(np.int32), tokens.indices.to_numpy().astype(np.int32)
        self.weight = rows["weight"].combine_chunks().to_numpy(zero_copy_only=False).astype(float)

    def blocks(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(claims, place of each token of the vocabulary among the block's or -1, dense weights: tokens x claims)."""
        ends = np.concatenate([[0], np.cumsum(np.bincount(self.claim, minlength=len(self.names)))])
        a = 0
        while a < len(self.names):
            size = (ends[a + 1 :] - ends[a]) * np.arange(1, len(self.names) - a + 1) * 8  # at most so many bytes with each further claim
            b = a + max(1, int(np.searchsorted(size, BLOCK_BYTES, side="right")))
            mine = slice(ends[a], ends[b])
            used = np.unique(self.token[mine])
            place = np.full(len(self.vocabulary), -1, dtype=np.int32)
            place[used] = np.arange(len(used))
            dense = np.zeros((len(used), b - a))
            dense[place[self.token[mine]], self.claim[mine] - a] = self.weight[mine]
            yield np.arange(a, b), place, dense
            a = b

    def scores(self, lists: pa.ListArray, value: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, claims, scores) of token lists, some rows and a block of claims at a time; ``value`` turns counts and list sizes into
        amounts.  Tokens are looked up by Arrow, not one by one."""
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        code = pc.fill_null(pc.index_in(lists.flatten(), value_set=self.vocabulary), -1).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(sizes)), sizes)[code >= 0]
        pair, times = np.unique(row * len(self.vocabulary) + code[code >= 0], return_counts=True)
        row, code = np.divmod(pair, max(1, len(self.vocabulary)))
        amounts = value(times, sizes[row])
        for claims, place, dense in self.blocks():
            for a in range(0, len(sizes), ROW_BLOCK):
                low, high = np.searchsorted(row, [a, a + ROW_BLOCK])
                column = place[code[low:high]]
                some = np.zeros((min(ROW_BLOCK, len(sizes) - a), len(dense)))
                some[row[low:high][column >= 0] - a, column[column >= 0]] = amounts[low:high][column >= 0]
                yield a, claims, some @ dense


def _portions(asked: DataFrame, claim: str) -> Iterator[DataFrame]:
    """Rows (claim, token, weight) in portions of about ``MOST_ASKED``; a claim is in one."""
    n = max(1, -(-asked.count() // MOST_ASKED))
    for i in range(n):
        yield asked if n == 1 else asked.where(F.pmod(F.xxhash64(claim), F.lit(n)) == i)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@dataclass
class Index:
    """Tokens of chunks (*order, tokens) and in how many chunks each token is, both written once."""

    tokens: DataFrame
    counts: DataFrame
    order: tuple[str, ...]

    @classmethod
    def of(cls, chunks: DataFrame, order: tuple[str, ...] = ("chunk_id",)) -> Index:
        """The index of ``chunks`` (*order, chunk): each chunk is tokenised here, and never again."""
        spread = widened(chunks.select(*order, "chunk"))
        tokens = written(spread.select(*order, tokenize(F.col("chunk")).alias("tokens")), "tokens")
        return cls(tokens, written(_counts(tokens, "tokens"), "token-counts"), order)

    def extended(self, chunks: DataFrame) -> Index:
        """With more chunks: only they are read, and their counts are added."""
        more = Index.of(chunks, self.order)
        counts = self.counts.unionByName(more.counts).groupBy("token").agg(F.sum("n").alias("n"))
        return Index(self.tokens.unionByName(more.tokens), written(counts, "token-counts"), self.order)


def top_k(claims: DataFrame, chunks: DataFrame | Index, k: int = 5, claim: str = "claim_id", claim_text: str = "claim", order: tuple[str, ...] = ("chunk_id",)) -> DataFrame:
    """(claim, rank, *order, score): the ``k`` best chunks of each claim, then those of positive score.

    ``chunks`` has the ``order`` columns and ``chunk``, or is an index of such; ties go to the earlier chunk.  The sparse
    weights of the claims' tokens are broadcast, at most about ``MOST_ASKED`` of them at a time (more claims take more
    passes over the tokens); each task scores its chunks by matrix products and keeps ``k`` for each claim, so that what is
    exchanged is tasks x claims x k rows and nothing by token.  Scores are rounded so that the order of summation decides no tie."""
    index = chunks if isinstance(chunks, Index) else Index.of(chunks, order)
    order, tokens, counts = index.order, index.tokens, index.counts
    asked = claims.select(claim, F.explode(tokenize(F.col(claim_text))).alias("token")).groupBy(claim, "token").agg(F.count("*").alias("qf"))
    total = {r["token"]: r["n"] for r in counts.where(F.col("token").isin(_ALL, _SIZE)).collect()}
    weights = written(_weights(counts).join(asked, "token").select(claim, "token", (F.col("qf") * F.col("idf")).alias("weight")), "asked")
    average = total.get(_SIZE, 0) / max(1, total.get(_ALL, 0))
    scored = _union([_best_chunks(tokens, part, average, k, claim, order) for part in _portions(weights, claim)])
    best = Window.partitionBy(claim).orderBy(F.desc("score"), *order)
    return scored.withColumn("rank", F.row_number().over(best)).where((F.col("rank") <= k) & (F.col("score") > 0)).select(claim, "rank", *order, "score")


def _best_chunks(tokens: DataFrame, weights: DataFrame, average: float, k: int, claim: str, order: tuple[str, ...]) -> DataFrame:
    """(claim, *order, score): the best of each task."""
    shared = tokens.sparkSession.sparkContext.broadcast(_Asked(weights.toArrow(), claim, average))
    fields = [weights.schema[claim], *(tokens.schema[c] for c in order)]

    def amount(times: np.ndarray, size: np.ndarray) -> np.ndarray:
        return times * (K1 + 1) / (times + K1 * (1 - B + B * size / shared.value.average))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, held = shared.value, []
        floor = np.zeros(len(asked.names))  # so many a claim's best k of this task have at least: nothing below is kept
        for batch in batches:
            lists = batch.column("tokens")
            for a, claims, scores in asked.scores(lists, amount):
                scores = np.round(scores, 6)
                kept = (scores > 0) & (scores >= floor[claims])
                many = np.flatnonzero(kept.sum(axis=0) > k)
                if len(many):  # those equal to the k-th stay in
                    least = np.partition(scores[:, many], -k, axis=0)[-k]
                    floor[claims[many]] = np.maximum(floor[claims[many]], least)
                    kept[:, many] &= scores[:, many] >= least
                row, column = np.nonzero(kept)
                at = pa.table([pa.array(claims[column]), pa.array(scores[row, column]), *(batch.column(c).take(pa.array(a + row)) for c in order)], names=["c", "score", *order])
                held.append(at)
                if sum(map(len, held)) > MOST_HELD:
                    held = [_best(held, k, order)]
                    which, first, times = np.unique(held[0]["c"].to_numpy(), return_index=True, return_counts=True)
                    full = times == k
                    floor[which[full]] = np.maximum(floor[which[full]], held[0]["score"].to_numpy()[first[full] + k - 1])
        if held:
            best = _best(held, k, order)
            yield from pa.table([asked.names.take(best["c"].combine_chunks()), *(best[c] for c in (*order, "score"))], names=[claim, *order, "score"]).to_batches()

    return tokens.select(*order, "tokens").mapInArrow(score, T.StructType([*fields, T.StructField("score", T.DoubleType())]))


def _best(held: list[pa.Table], k: int, order: tuple[str, ...]) -> pa.Table:
    """The first ``k`` rows of each claim."""
    rows = pa.concat_tables(held).sort_by([("c", "ascending"), ("score", "descending"), *((c, "ascending") for c in order)])
    claim = rows["c"].to_numpy()
    first = np.flatnonzero(np.concatenate([[True], claim[1:] != claim[:-1]])) if len(claim) else np.empty(0, dtype=int)
    rank = np.arange(len(claim)) - np.repeat(first, np.diff(np.concatenate([first, [len(claim)]])))
    return rows.filter(pa.array(rank < k))


def confidence(verdicts: DataFrame, by: list[str], verdict: str = "verdict") -> DataFrame:
    """(by, score): 100 times the mean of 1, 0.5 and 0 for supported, partial and contradicted; 0 without any."""
    points = F.when(F.col(verdict) == "supported", F.lit(1.0)).when(F.col(verdict) == "partial", F.lit(0.5)).when(F.col(verdict) == "contradicted", F.lit(0.0))
    return verdicts.groupBy(*by).agg(F.coalesce(100 * F.avg(points), F.lit(0.0)).alias("score"))


def histogram(verdicts: DataFrame, values: tuple[str, ...], verdict: str = "verdict") -> DataFrame:
    """(verdict, n) with every value, zeros included."""
    spark = verdicts.sparkSession
    all_ = spark.createDataFrame([(v,) for v in values], f"{verdict} string")
    return all_.join(verdicts.groupBy(verdict).agg(F.count("*").alias("n")), verdict, "left").select(verdict, F.coalesce("n", F.lit(0)).alias("n"))


def parse_verdict(text: Column) -> Column:
    """struct(verdict, reason) of a model's answer: its first JSON object if valid, else by keyword."""
    body = F.regexp_extract(text, r"(?s)(\{.*?\})", 1)
    whole = F.from_json(body, "struct<verdict:string,reason:string>", {"mode": "PERMISSIVE"})
    known = F.lower(F.trim(whole["verdict"]))
    valid = F.get_json_object(body, "$").isNotNull() & known.isin("supported", "partial", "contradicted", "unverifiable")
    low = F.lower(text)
    word = F.when(low.contains("contradicted"), "contradicted").when(low.contains("partial"), "partial").when(low.contains("supported"), "supported").otherwise("unverifiable")
    stop = F.instr(text, "。")
    reason = F.when(stop > 0, F.substring(text, F.lit(1), stop - 1)).otherwise(F.substring(text, 1, 100))
    return F.when(valid, F.struct(known.alias("verdict"), F.coalesce(whole["reason"], F.lit("")).alias("reason"))).otherwise(F.struct(word.alias("verdict"), reason.alias("reason")))


def best_sections(claims: DataFrame, sections: DataFrame, claim: str = "claim_id", claim_text: str = "claim", skip: tuple[str, ...] = (), least: float = 0.15) -> DataFrame:
    """(claim, doc, section, score): per document the section that holds most of the claim's tokens, the first on
    ties, if at least ``least`` of them.  ``sections`` has doc_id, section, header and body."""
    usable = sections.where("section > 0 and body <> ''")
    for word in skip:
        usable = usable.where(~F.col("header").contains(word))
    held = usable.select("doc_id", "section", word_set(F.concat_ws(" ", "header", "body")).alias("tokens"))
    asked = claims.select(claim, word_set(F.col(claim_text)).alias("tokens")).where(F.size("tokens") > 0)
    rows = written(asked.select(claim, F.explode("tokens").alias("token"), (1 / F.size("tokens")).alias("weight")), "asked")
    scored = _union([_shares(widened(held), part, claim, least) for part in _portions(rows, claim)])
    first = Window.partitionBy(claim, "doc_id").orderBy(F.desc("score"), "section")
    return scored.where(F.col("score") >= least).withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k")


def _shares(held: DataFrame, weights: DataFrame, claim: str, least: float) -> DataFrame:
    """(claim, doc_id, section, score) of at least ``least``: sections stay where they are."""
    table = weights.toArrow()
    asked = _Asked(table, claim)
    asked.size = np.rint(1 / asked.weight[np.unique(asked.claim, return_index=True)[1]]) if len(asked.claim) else np.empty(0)
    asked.weight[:] = 1.0
    shared = held.sparkSession.sparkContext.broadcast(asked)
    fields = [weights.schema[claim], held.schema["doc_id"], held.schema["section"]]

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        for batch in batches:
            for a, claims, common in asked.scores(batch.column("tokens"), lambda times, _: times):
                score = np.rint(common) / asked.size[claims]
                row, column = np.nonzero((score >= least) & (common > 0))
                at = pa.array(a + row)
                yield pa.RecordBatch.from_arrays([asked.names.take(pa.array(claims[column])), batch.column("doc_id").take(at), batch.column("section").take(at), pa.array(score[row, column])], [claim, "doc_id", "section", "score"])

    return held.mapInArrow(share, T.StructType([*fields, T.StructField("score", T.DoubleType())]))


def keep_rewrite(old: Column, new: Column) -> Column:
    """A rewrite that is empty or under 60 % of the original's length is not taken."""
    return F.when(new.isNull() | (F.length(F.trim(new)) == 0) | (F.length(new) < F.length(old) * 0.6), old).otherwise(new)

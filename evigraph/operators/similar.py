"""Pairs of strings by matching-blocks similarity (2 M / T, as ``difflib`` has it), without comparing all with all.

M is at most the number of characters that two strings have in common (each as often as both have it), so a pair that reaches ``least`` shares
at least least/2 (|a| + |b|) of them.  That is an exact bound for a prefix filter over an inverted index: characters are numbered by
occurrence ("the second e"), each string is indexed under its rarest ones only, and pairs that meet there are kept if
lengths and common characters allow ``least``.  Only what is left is compared, by a vectorised Python function, since Spark has none.
Groups of at most ``MOST_TOGETHER`` strings need no index: their strings travel as one row (``earlier``).
Strings are compared in lower case; empty ones are like nothing.
"""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evigraph.shared import written

#: Strings of a group that are compared within a task, and numbers of the matrix of common characters held at a time.
MOST_TOGETHER, MOST_CELLS = 512, 4_000_000
#: Numbered characters whose occurrences are counted; the rest are the rarest.
MOST_RANKS = 65_536


def characters(text: Column) -> Column:
    """The characters of a string, numbered by occurrence."""
    signs = F.split(text, "")
    return F.transform(signs, lambda c, i: F.concat(c, F.size(F.filter(F.slice(signs, F.lit(1), i + 1), lambda x: x == c)).cast("string")))


def apart(table: DataFrame, by: list[str] | None) -> DataFrame:
    """``table`` to be joined by exchange if it is grouped: it grows with the groups then, however small its files are."""
    return table.hint("merge") if by else table


def _indexed(strings: DataFrame, by: list[str], name: str, ranks: DataFrame, least: float) -> DataFrame:
    """(by, name, sign): each string under its rarest characters, as many as two strings over ``least`` can't both miss.

    It is the counts that are sent to all: they are few, while the strings' characters, small as their files are, are as many as the text."""
    row = Window.partitionBy(*by, name).orderBy("_r", "_sign")
    spread = strings.select(*by, name, F.size("_c").alias("_n"), F.explode("_c").alias("_sign")).join(F.broadcast(ranks), "_sign", "left").withColumn("_r", F.coalesce("_r", F.lit(0)))
    shared = F.ceil(F.col("_n") * (least / 2) / (1 - least / 2) - 1e-9)
    return spread.withColumn("_k", F.row_number().over(row)).where(F.col("_k") <= F.col("_n") - shared + 1).select(*by, name, "_sign")


def candidates(left: DataFrame, right: DataFrame, least: float, by: list[str] | None = None) -> DataFrame:
    """(by, a, b): pairs of different strings of ``left`` (by, a) and ``right`` (by, b) that may reach ``least``: none that does is missing."""
    by = by or []
    a, b = (df.where((F.length(c) > 0)).select(*by, c).distinct().withColumn("_c", characters(F.lower(c))) for df, c in ((left, "a"), (right, "b")))
    a, b = written(a, "similar-a"), written(b, "similar-b")
    counts = a.select(F.explode("_c").alias("_sign")).unionByName(b.select(F.explode("_c").alias("_sign"))).groupBy("_sign").agg(F.count("*").alias("_r"))
    counts = counts.orderBy(F.desc("_r"), "_sign").limit(MOST_RANKS)  # any order of all signs that is the same for both will do
    met = _indexed(a, by, "a", counts, least).join(apart(_indexed(b, by, "b", counts, least), by), [*by, "_sign"]).select(*by, "a", "b").distinct()
    both = met.join(apart(a, by), [*by, "a"]).join(apart(b.withColumnRenamed("_c", "_d"), by), [*by, "b"])
    total = F.size("_c") + F.size("_d")
    enough = 2 * F.least(F.size("_c"), F.size("_d")) >= least * total - 1e-9
    return both.where(enough & (2 * F.size(F.array_intersect("_c", "_d")) >= least * total - 1e-9)).select(*by, "a", "b")


@F.pandas_udf(T.DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype=float)


def similar(left: DataFrame, right: DataFrame, least: float, by: list[str] | None = None) -> DataFrame:
    """(by, a, b, ratio) of the pairs that reach ``least``; the ratio is not symmetric: a's blocks are looked for in b."""
    found = candidates(left, right, least, by)
    return found.withColumn("ratio", _ratio(F.lower("a"), F.lower("b"))).where(F.col("ratio") >= least)


def _close(strings: list[str], least: float) -> Iterator[tuple[int, int]]:
    """(i, j), j < i, of the strings of a group that reach ``least``: common characters are counted for all, and what they allow is compared."""
    sizes = np.fromiter(map(len, strings), dtype=np.int64, count=len(strings))
    signs, code = np.unique(np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), dtype="<u4"), return_inverse=True)
    counts = np.zeros((len(strings), len(signs)), dtype=np.int32)
    np.add.at(counts, (np.repeat(np.arange(len(strings)), sizes), code), 1)
    matcher = difflib.SequenceMatcher(None)
    step = max(1, MOST_CELLS // max(1, counts.size))
    for a in range(0, len(strings), step):
        common = np.minimum(counts[a : a + step, None, :], counts[None, :, :]).sum(axis=2)
        total = sizes[a : a + step, None] + sizes[None, :]
        ahead = np.arange(len(strings))[None, :] > np.arange(a, min(a + step, len(strings)))[:, None]
        row, column = np.nonzero(ahead & (sizes[a : a + step, None] > 0) & (sizes[None, :] > 0) & (2 * common >= least * total - 1e-9))
        last = -1
        for j, i in zip((row + a).tolist(), column.tolist(), strict=True):  # the matcher keeps what it knows of its second string
            if j != last:
                matcher.set_seq2(strings[j])
                last = j
            matcher.set_seq1(strings[i])
            if matcher.ratio() >= least:
                yield i, j


def earlier(strings: DataFrame, least: float, by: str, text: str, order: str) -> DataFrame:
    """(by, a, b, b_order): pairs of a group's different strings (by, text, order) that reach ``least``, b before a in ``order``.

    A small group is one row, compared within a task; a group of more than ``MOST_TOGETHER`` strings meets by the index."""
    small = strings.groupBy(by).agg(F.count("*").alias("_n")).where(F.col("_n") <= MOST_TOGETHER).select(by)
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.lower(text).alias("low"), F.col(text).alias("t"))))
    lists = strings.join(small, by, "left_semi").groupBy(by).agg(rows.alias("_rows"))
    kind = {f.name: f.dataType for f in strings.schema}
    fields = [T.StructField(by, kind[by]), T.StructField("a", kind[text]), T.StructField("b", kind[text]), T.StructField(f"b_{order}", kind[order])]

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, ends = batch.column("_rows"), np.cumsum(batch.column("_rows").value_lengths().to_numpy())
            flat = held.flatten()
            low, said, at = flat.field("low").to_pylist(), flat.field("t"), flat.field("o")
            for k, end in enumerate(ends.tolist()):
                begin = end - len(held[k])
                pairs = list(_close(low[begin:end], least))
                if pairs:
                    a, b = (pa.array([begin + x for x in side]) for side in zip(*pairs, strict=True))
                    yield pa.RecordBatch.from_arrays([batch.column(by).take(pa.array([k] * len(pairs))), said.take(a), said.take(b), at.take(b)], [by, "a", "b", f"b_{order}"])

    together = lists.mapInArrow(compared, T.StructType(fields))
    large = written(strings.join(small, by, "left_anti").select(by, text, order), "large-groups")
    if large.isEmpty():
        return together
    pairs = similar(large.select(by, F.col(text).alias("a")), large.select(by, F.col(text).alias("b")), least, [by])
    of = lambda c: large.select(by, F.col(text).alias(c), F.col(order).alias(f"{c}_{order}"))
    met = pairs.join(of("a"), [by, "a"]).join(of("b"), [by, "b"]).where(F.col(f"b_{order}") < F.col(f"a_{order}"))
    return together.unionByName(met.select(by, "a", "b", f"b_{order}"))

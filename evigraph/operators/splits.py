"""Greedy splits as tables: no fold over a text's parts.

Where a text or a group's sizes are one row, its pieces are found along that row: sentences, turns and sections in the text's own row, packed units in a slim
row of their sizes, up to ``MOST_TOGETHER`` units of a group.  What may have more is a table:

Where a piece that begins at a part ends depends on that beginning alone.  So every possible beginning gets a pointer to the next (a window
with a range frame), and the beginnings that are reached from the first are found by doubling the pointers: after round k
those within 2^k pieces are known.  A text of any number of pieces takes the logarithm of that many rounds, and all texts are
split at once.  A document's key names one row; rows without a key have no pieces.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigraph.functions.chunks import chunk_by_chars
from evigraph.functions.text import strip
from evigraph.shared import written

#: White space that ends with a sentence.
_SPACE = r"(?U)[\s\x{1c}-\x{1f}]*"
# Fixed value: signs that end a sentence.
SENTENCE_END = "[。．.!?！？]"
#: Units of a group whose sizes are one row.
MOST_TOGETHER = 100_000


def reached(starts: DataFrame, pointers: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, at): what is reached from ``starts`` (keys, at) by ``pointers`` (keys, at, to), the starts included."""
    seen, jump = starts.select(*keys, "at"), written(pointers.where("to IS NOT NULL").select(*keys, "at", "to"), "pointers")
    while True:
        step = seen.join(jump, [*keys, "at"]).select(*keys, F.col("to").alias("at"))
        seen = written(seen.unionByName(step), "reached")
        twice = jump.join(jump.select(*keys, F.col("at").alias("to"), F.col("to").alias("_on")), [*keys, "to"])
        jump = written(twice.select(*keys, "at", F.col("_on").alias("to")), "pointers")
        if jump.isEmpty():
            return seen


def _pieces_of(sizes: np.ndarray, heads: np.ndarray, most: int) -> np.ndarray:
    """The piece of each unit of a group, as ``packed`` has it."""
    n = len(sizes)
    begins = np.concatenate([[0], np.cumsum(sizes)])
    first = np.zeros(n, dtype=np.int32)
    i = moved = 0
    while True:
        over = int(np.searchsorted(begins, begins[i] + most + 1))
        if over > n:
            break
        to = max(over - 1, int(np.searchsorted(begins, begins[i] + 1)), i + 1 + moved)
        if to >= n:
            break
        i, moved = (to - 1, 1) if heads[to - 1] and to - 1 > i else (to, 0)
        first[i] = 1
    return np.cumsum(first, dtype=np.int32)


def packed(units: DataFrame, keys: list[str], most: int, order: str = "i", size: str = "size", heading: str | None = None) -> DataFrame:
    """``units`` with ``piece`` (from 0): units in order up to ``most`` together, one at least.  What holds nothing is not ended.  A
    piece does not end in a unit that is a ``heading`` unless it is alone: that begins the next piece, which then takes the unit after it too."""
    head = F.coalesce(F.col(heading), F.lit(False)) if heading else F.lit(False)
    unit = F.struct(F.col(order).alias("o"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("s"), head.alias("h")).alias("_u")
    slim = written(units.select(*keys, unit), "sizes")
    large = written(slim.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > MOST_TOGETHER).select(*keys), "large-groups")
    if large.isEmpty():
        return _packed_rows(units, slim, keys, most, order)
    rest = _packed_rows(units.join(large, keys, "left_anti"), slim.join(large, keys, "left_anti"), keys, most, order)
    return rest.unionByName(_packed_table(units.join(large, keys, "left_semi"), keys, most, order, size, heading))


def _packed_rows(units: DataFrame, slim: DataFrame, keys: list[str], most: int, order: str) -> DataFrame:
    """Groups whose sizes (``slim``) are one row each; the units are exchanged once, by group."""

    @F.pandas_udf("array<int>")
    def pieces(sizes: pd.Series, heads: pd.Series) -> pd.Series:
        return pd.Series([_pieces_of(s, h, most) for s, h in zip(sizes, heads, strict=True)], dtype=object)

    lists = slim.groupBy(*keys).agg(F.array_sort(F.collect_list("_u")).alias("_u"))
    lists = lists.select(*keys, pieces(F.transform("_u", lambda u: u["s"]), F.transform("_u", lambda u: u["h"])).alias("_pieces"))
    placed = units.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1)
    return placed.join(lists.hint("merge"), keys, "left").withColumn("piece", F.get("_pieces", F.col("_i"))).select(*units.columns, "piece")


def _packed_table(units: DataFrame, keys: list[str], most: int, order: str, size: str, heading: str | None) -> DataFrame:
    """Groups of any number of units, by pointers."""
    row = Window.partitionBy(*keys).orderBy(order)
    sized = units.withColumn("_i", F.row_number().over(row) - 1).withColumn("_size", F.coalesce(F.col(size), F.lit(0)).cast("long"))
    up_to = F.sum("_size").over(row.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    head = F.coalesce(F.col(heading), F.lit(False)) if heading else F.lit(False)
    slim = sized.select(*keys, "_i", head.alias("_head"), (up_to - F.col("_size")).alias("_begin"))
    n = sized.groupBy(*keys).agg(F.count("*").alias("_i"), F.sum("_size").alias("_begin"))
    places = written(slim.unionByName(n.select(*keys, "_i", F.lit(False).alias("_head"), "_begin")), "places")  # with the end
    from_here = Window.partitionBy(*keys).orderBy("_begin")
    over = F.min("_i").over(from_here.rangeBetween(most + 1, Window.unboundedFollowing)) - 1  # the first unit that is too much
    some = F.min("_i").over(from_here.rangeBetween(1, Window.unboundedFollowing))  # the first with something before it
    known = places.select(*keys, "_i", "_head", over.alias("_over"), some.alias("_some"))
    # A beginning is 2 i, or 2 i + 1 if it is a heading that has been moved there.
    ways = F.explode(F.when(F.col("_head"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_m")
    nodes = known.select("*", ways).withColumn("_to", F.greatest(F.col("_over"), F.when(F.col("_over").isNotNull(), F.col("_some")), F.col("_i") + 1 + F.col("_m")))
    ends = places.select(*keys, F.col("_i").alias("_to"), F.lag("_head").over(row.orderBy("_i")).alias("_after_head"))
    nodes = nodes.where("_over IS NOT NULL").join(ends.join(n.select(*keys, F.col("_i").alias("_n")), keys), [*keys, "_to"]).where("_to < _n")
    moved = F.col("_after_head") & (F.col("_to") - 1 > F.col("_i"))
    pointers = nodes.select(*keys, (2 * F.col("_i") + F.col("_m")).alias("at"), F.when(moved, 2 * F.col("_to") - 1).otherwise(2 * F.col("_to")).alias("to"))
    starts = reached(n.select(*keys, F.lit(0).cast("long").alias("at")), pointers, keys)
    begun = starts.select(*keys, F.floor(F.col("at") / 2).alias("_i"), F.lit(1).alias("_new")).distinct()
    so_far = Window.partitionBy(*keys).orderBy("_i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return sized.join(begun, [*keys, "_i"], "left").withColumn("piece", (F.sum("_new").over(so_far) - 1).cast("int")).drop("_i", "_size", "_new")


def _cuts() -> Column:
    """The pieces ``_p`` (begin, end, offset) of a text ``_t``."""
    return F.transform("_p", lambda p: F.struct(p["offset"].cast("int").alias("offset"), F.substring(F.col("_t"), (p["begin"] + 1).cast("int"), (p["end"] - p["begin"]).cast("int")).alias("text")))


def _sentence_pieces(lengths: np.ndarray, size: int, overlap: int) -> list[tuple[int, int, int]]:
    """(begin, end, offset) of the pieces of a text's sentences, as ``sentence_chunks`` has them; what a piece carries is the
    overlap, or all there has been while that is shorter."""
    n, out, i = len(lengths), [], 0
    begins = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    while i < n:
        begin = int(begins[i])
        carried = min(overlap, begin) if overlap else begin
        # The first sentence that begins too far on.
        over = np.searchsorted(begins, size, side="right") if carried == begin else np.searchsorted(begins, begin + size - overlap + 1)
        to = min(n, max(int(over) - 1, i + 1))
        out.append((begin - carried, int(begins[to]), begin - overlap if i else 0))
        i = to
    return out


def _cut(df: DataFrame, key: str, text: Column, pieces: DataFrame) -> DataFrame:
    """(key, chunk_no, offset, chunk) of pieces (key, begin, end, offset); texts are met once, whole."""
    lists = pieces.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("begin", "end", "offset"))).alias("_p"))
    return df.select(key, text.alias("_t")).join(lists, key).select(key, _cuts().alias("_c"))


def _rows(made: DataFrame, key: str, keep: tuple[str, ...] = ()) -> DataFrame:
    spread = made.select(key, *keep, F.posexplode("_c").alias("chunk_no", "c"))
    return spread.select(key, *keep, "chunk_no", "c.offset", F.col("c.text").alias("chunk"))


def sentence_chunks(df: DataFrame, key: str, text: str = "text", size: int = 400, overlap: int = 80) -> DataFrame:
    """(key, chunk_no, offset, chunk): sentences packed up to ``size`` characters; each next piece starts with the last ``overlap``
    of the one before (all of it if ``overlap`` is 0).  White space after a sentence counts nowhere; blank pieces are left out."""
    sentences = F.filter(F.split(F.col(text), f"(?<={SENTENCE_END}){_SPACE}", -1), lambda s: s != "")

    @F.pandas_udf("array<struct<begin:long,end:long,offset:long>>")
    def pieces(lengths: pd.Series) -> pd.Series:
        return pd.Series([_sentence_pieces(n, size, overlap) for n in lengths], dtype=object)

    # By ``inline``, so that neither the sentences nor the text of them are made anew for each piece.
    docs = df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(key, F.inline(F.array(F.struct(sentences.alias("_s")))))
    whole = F.struct(F.array_join("_s", "").alias("_t"), F.transform("_s", lambda s: F.length(s).cast("long")).alias("_n"))
    ends = docs.select(key, F.inline(F.array(whole))).select(key, "_t", pieces("_n").alias("_p"))
    made = ends.select(key, _cuts().alias("_c"))
    tidy = F.filter(F.transform("_c", lambda c: F.struct(c["offset"].alias("offset"), strip(c["text"]).alias("text"))), lambda c: c["text"] != "")
    return _rows(made.select(key, tidy.alias("_c")), key)


def bounded_chunks(df: DataFrame, key: str, text: str = "text", size: int = 4000) -> DataFrame:
    """(key, chunk_no, offset, chunk): slices up to ``size``, each moved back to the last sentence end before a line end, sentence end,
    paragraph or line in it, whichever of these it has first."""
    docs = df.where(F.col(key).isNotNull() & (F.length(text) > 0))
    parts = F.split(F.col(text), "(?<=[。\n])", -1)
    rows = docs.select(key, F.posexplode(parts).alias("i", "s"))
    order = Window.partitionBy(key).orderBy("i")
    marks = rows.select(
        key, F.sum(F.length("s")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("long").alias("end"),
        F.substring("s", -1, 1).alias("sign"), F.coalesce(F.substring(F.lead("s").over(order), 1, 1), F.lit("")).alias("after"),
    )
    line = F.col("after") == "\n"
    marks = written(marks.where(F.col("sign").isin("。", "\n")).select(key, (F.col("end") - 1).alias("at"), F.col("sign").alias("sign"), line.alias("line")), "marks")
    lengths = docs.select(key, F.length(text).cast("long").alias("n"))
    # Where a slice may begin: the text's begin, after a mark, and from there (or a mark itself) by whole sizes up to the next mark.
    base = marks.select(key, F.explode(F.array(F.col("at"), F.col("at") + 1)).alias("at")).unionByName(lengths.select(key, F.lit(0).cast("long").alias("at"))).distinct()
    along = Window.partitionBy(key).orderBy("at")
    both = marks.select(key, "at", F.lit(True).alias("mark")).unionByName(base.withColumn("mark", F.lit(False)))
    following = F.min(F.when(F.col("mark"), F.col("at"))).over(along.rangeBetween(1, Window.unboundedFollowing))
    spans = both.withColumn("next", following).where(~F.col("mark")).join(lengths, key).withColumn("next", F.coalesce("next", "n"))
    times = F.greatest(F.lit(0), F.floor((F.col("next") - F.col("at")) / size)).cast("long")
    nodes = spans.select(key, "n", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), times), lambda k: F.col("at") + k * size)).alias("at")).where("at < n").distinct()
    found = marks.select(key, "at", "sign", "line", F.lit(None).cast("long").alias("n")).unionByName(nodes.select(key, "at", F.lit(None).cast("string").alias("sign"), F.lit(None).cast("boolean").alias("line"), "n"))
    two, one = along.rangeBetween(1, size - 2), along.rangeBetween(1, size - 1)
    last = lambda sign, wide: F.max(F.when((F.col("sign") == sign) & (F.col("line") if wide else F.lit(True)), F.col("at"))).over(two if wide else one)
    back = F.coalesce(last("。", True) + 2, last("。", False) + 1, last("\n", True) + 2, last("\n", False) + 1, F.col("at") + size)
    pointers = found.withColumn("to", back).where("n IS NOT NULL")
    pointers = written(pointers.select(key, "at", F.when(F.col("at") + size < F.col("n"), F.col("to")).alias("to"), "n"), "slice-ends")
    starts = reached(lengths.select(key, F.lit(0).cast("long").alias("at")), pointers, [key])
    pieces = starts.join(pointers, [key, "at"]).select(key, F.col("at").alias("begin"), F.coalesce("to", "n").alias("end"), F.col("at").alias("offset"))
    return _rows(_cut(df, key, F.col(text), pieces), key)


def _part_pieces(lengths: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """(begin, end, offset) of the pieces of a text's parts."""
    ends = np.cumsum(lengths, dtype=np.int64)
    last = np.flatnonzero(np.diff(_pieces_of(lengths, np.zeros(len(lengths), dtype=bool), size), append=-1))
    bounds = [0, *ends[last].tolist()]
    return [(a, b, a) for a, b in zip(bounds, bounds[1:])]


def _parts_packed(df: DataFrame, key: str, text: str, begin: str, size: int, keep: tuple[str, ...] = (), empty: bool = False) -> DataFrame:
    """(key, keep, chunk_no, offset, chunk): parts of a text, which begin at the pattern ``begin``, put together up to ``size``, along the text's own
    row.  An empty text has no piece, or an empty one if ``empty``."""

    @F.pandas_udf("array<struct<begin:long,end:long,offset:long>>")
    def pieces(lengths: pd.Series) -> pd.Series:
        return pd.Series([_part_pieces(n, size) if len(n) or not empty else [(0, 0, 0)] for n in lengths], dtype=object)

    # By ``inline``, so that the text is made once, and not anew for each use and each of its pieces.
    docs = df.select(key, *keep, F.inline(F.array(F.struct(F.col(text).alias("_t"))))).where(F.col("_t").isNotNull())
    docs = docs.where(F.col(key).isNotNull() | (F.length("_t") == 0) if empty else F.col(key).isNotNull())
    lengths = F.filter(F.transform(F.split("_t", begin, -1), lambda s: F.length(s).cast("long")), lambda n: n > 0)
    return _rows(docs.select(key, *keep, "_t", pieces(lengths).alias("_p")).select(key, *keep, _cuts().alias("_c")), key, keep)


def turn_chunks(df: DataFrame, key: str, text: str = "text", size: int = 4000) -> DataFrame:
    """(key, chunk_no, offset, chunk): speaker turns (lines that begin with a label in brackets) packed up to ``size``; what is before
    the first label is left out; a text without labels is cut in fixed slices."""
    label = r"(?m)^(?=\[[^\]]+\])"
    labelled = F.coalesce(F.col(text).rlike(label), F.lit(False))
    said = df.where(labelled).withColumn("_from", F.length(F.regexp_extract(text, r"(?s)\A(.*?)(?m:^\[[^\]]+\])", 1)))
    turns = said.withColumn("_said", F.expr(f"substring(`{text}`, _from + 1)"))
    made = _parts_packed(turns.drop(text), key, "_said", label, size)
    made = made.join(said.select(key, "_from"), key).select(key, "chunk_no", (F.col("offset") + F.col("_from")).cast("int").alias("offset"), "chunk")
    plain = df.where(~labelled & (F.length(text) > 0)).select(key, F.col(text).alias("_t"), F.posexplode(F.sequence(F.lit(0), F.length(text) - 1, F.lit(size))).alias("chunk_no", "offset"))
    return made.unionByName(plain.select(key, "chunk_no", "offset", F.substring("_t", F.col("offset") + 1, F.lit(size)).alias("chunk")))


def slices(text: Column, size: int) -> Column:
    """A text as slices of at most ``size`` characters, the whole of it together: each ends before white space, or after ``size`` characters where it
    has none.  Only texts that are longer go to Python."""
    cut = rf"(?s:.{{1,{size}}}(?!\S)|.{{{size}}})"

    @F.pandas_udf("array<string>")
    def sliced(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else re.findall(cut, t) for t in texts], dtype=object)

    return F.when(F.length(text) > size, sliced(F.when(F.length(text) > size, text))).otherwise(F.array(text))


def heading_chunks(df: DataFrame, key: str, text: str = "text", size: int = 6000, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, keep, chunk_no, offset, chunk): fourth-level sections packed up to ``size``; an empty text is one empty chunk.  Columns
    ``keep`` go along with each chunk."""
    filled = df.withColumn(text, F.coalesce(F.col(text), F.lit("")))
    return _parts_packed(filled, key, text, "(?m)^(?=####)", size, keep, empty=True)


def chunk_text(df: DataFrame, key: str, strategy: str = "character", text: str = "text", size: int = 400, overlap: int = 80) -> DataFrame:
    """(key, chunk_no, offset, chunk) by a strategy: ``sentence`` packs sentences, any other cuts windows of characters."""
    return (sentence_chunks if strategy == "sentence" else chunk_by_chars)(df, key, text, size, overlap)

"""Chapter lists of several sources to one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evigraph.operators.similar import earlier
from evigraph.shared import written


def numbered_key(num):
    """Digits of a chapter number, joined by points; null if there are none."""
    digits = F.array_join(F.regexp_extract_all(num, F.lit("([0-9]+)"), F.lit(1)), ".")
    return F.when(digits != "", digits)


def numbered(chapters: DataFrame, book: str = "book") -> DataFrame:
    """(book, key, n_sources, title): numbered chapters that at least two sources have, with the longest title.
    chapters: (book, src, num, title)."""
    keyed = chapters.withColumn("key", numbered_key(F.col("num"))).where("key is not null")
    return keyed.groupBy(book, "key").agg(
        F.count_distinct("src").alias("n_sources"),
        F.max_by("title", F.struct(F.length("title").alias("n"), (-F.col("src")).alias("s"), F.col("title"))).alias("title"),
    ).where("n_sources >= 2")


def confidence(agreed: DataFrame, chapters: DataFrame, book: str = "book") -> DataFrame:
    """(book, agreed, confidence): 1.2 (0.6 coverage + 0.4 agreement), at most 1; one source 0.35."""
    sizes = chapters.groupBy(book, "src").agg(F.count("*").alias("n"))
    lists = F.array_sort(F.collect_list("n"))
    expected = sizes.groupBy(book).agg(F.count("*").alias("sources"), F.element_at(lists, F.floor(F.size(lists) / 2).cast("int") + 1).alias("expected"))
    found = agreed.groupBy(book).agg(F.count("*").alias("agreed"), F.sum("n_sources").alias("votes"))
    both = expected.join(found, book, "left").withColumn("agreed", F.coalesce("agreed", F.lit(0)))
    cover = F.least(F.lit(1.0), F.col("agreed") / F.col("expected"))
    share = F.col("votes") / (F.col("agreed") * F.col("sources"))
    full = F.least(F.lit(1.0), (cover * 0.6 + share * 0.4) * 1.2)
    return both.select(book, "agreed", F.when(F.col("sources") == 1, 0.35).when(F.col("agreed") == 0, 0.2).otherwise(full).alias("confidence"))


def unnumbered(chapters: DataFrame, book: str = "book", least: float = 0.75) -> DataFrame:
    """(book, key, n_sources, title): titles (src, pos, title) gathered each with the first similar one before it that is no
    follower itself.

    Who is a key: a title without a similar key before it.  That is decided in rounds over all books at once: a title with a similar
    key follows, one of which all similar titles before it follow is a key; the rest wait for the next round.  Similar
    titles come from ``earlier``; titles are compared in lower case with single blanks."""
    low = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce("title", F.lit(""))), r"(?U)^\s+|\s+$", ""), r"(?U)\s+", " ")
    plain = chapters.where(numbered_key(F.col("num")).isNull() | F.col("num").isNull()).select(book, "src", "pos", "title", low.alias("low"))
    firsts = written(plain.groupBy(book, "low").agg(F.min(F.struct("src", "pos", "low")).alias("ord")), "titles")
    before = written(earlier(firsts, least, book, "low", "ord"), "similar-titles")
    state = written(firsts.select(book, "low", F.lit(None).cast("boolean").alias("key")), "keys")
    while True:
        seen = before.join(state.withColumnRenamed("low", "b"), [book, "b"]).groupBy(book, F.col("a").alias("low"))
        seen = seen.agg(F.bool_or(F.coalesce("key", F.lit(False))).alias("has"), F.bool_or(F.col("key").isNull()).alias("waits"))
        known = state.join(seen, [book, "low"], "left").withColumn("now", F.when(F.col("has"), False).when(~F.coalesce("waits", F.lit(False)), True))
        state = written(known.select(book, "low", F.coalesce("key", "now").alias("key")), "keys")
        if state.where("key IS NULL").isEmpty():
            break
    keys = state.where("key")
    to = before.join(keys.select(book, F.col("low").alias("b")), [book, "b"]).groupBy(book, F.col("a").alias("low")).agg(F.min_by("b", "b_ord").alias("to"))
    placed = plain.join(to, [book, "low"], "left").withColumn("key", F.coalesce("to", "low"))
    longest = F.min_by("title", F.struct((-F.length("title")).alias("n"), "src", "pos"))
    return placed.groupBy(book, "key").agg(F.count_distinct("src").alias("n_sources"), longest.alias("title")).where("n_sources >= 2")


def best_source(chapters: DataFrame, book: str = "book") -> DataFrame:
    """(book, src, n): the longest list, the first source on ties."""
    sizes = chapters.groupBy(book, "src").agg(F.count("*").alias("n"))
    k = F.row_number().over(Window.partitionBy(book).orderBy(F.desc("n"), "src"))
    return sizes.withColumn("_k", k).where("_k = 1").drop("_k")


def reliable(confidence_, agreed):
    """Whether a structure is used: confidence of 0.5 and two agreed chapters at least."""
    return (confidence_ >= 0.5) & (agreed >= 2)


def domain_of(url):
    """The host of a URL in lower case without ``www.``; a text that is no URL stands for itself."""
    host = F.lower(F.regexp_replace(F.regexp_extract(url, "^.*?://([^/]*)", 1), "^www[.]", ""))
    return F.when(F.contains(url, F.lit("://")), host).otherwise(url)


def submitted(answers: DataFrame, key: str, chapters: str = "chapters", sources: str = "sources", confidence_: str = "confidence") -> DataFrame:
    """(key, chapters, confidence, sources_agreed) of chapter lists that a model handed in.

    Chapters (num, title, part) without a number get their place; lists with a chapter without title, and empty ones, are left
    out; the confidence is clamped to 0 and 1; agreement is the number of different domains."""
    plain = F.transform(F.col(chapters), lambda c, i: F.struct(F.coalesce(F.when(F.trim(c["num"]) != "", F.trim(c["num"])), (i + 1).cast("string")).alias("num"), F.trim(c["title"]).alias("title"), F.coalesce(F.trim(c["part"]), F.lit("")).alias("part")))
    whole = (F.size(chapters) > 0) & ~F.exists(chapters, lambda c: F.coalesce(F.trim(c["title"]), F.lit("")) == "")
    named = F.filter(F.transform(F.coalesce(sources, F.array()), lambda s: F.trim(s)), lambda s: s != "")
    agreed = F.size(F.array_distinct(F.transform(named, domain_of))).alias("sources_agreed")
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col(confidence_).cast("double"), F.lit(0.0)))).alias("confidence")
    return answers.where(whole).select(key, plain.alias("chapters"), sure, agreed)


def override(agreed: DataFrame, chapters: DataFrame, book: str = "book") -> DataFrame:
    """(book, src, n, confidence) where one source's list replaces the agreed one: it is longer than four and than one and
    a half times what was agreed.  Its confidence is 0.5 and 0.05 for each other source, 0.85 at most."""
    n_agreed = agreed.groupBy(book).agg(F.count("*").alias("_agreed"))
    others = chapters.groupBy(book).agg((F.count_distinct("src") - 1).alias("_others"))
    both = best_source(chapters, book).join(n_agreed, book, "left").join(others, book)
    had = F.coalesce("_agreed", F.lit(0))
    wins = both.where((F.col("n") > F.greatest(had, F.lit(4))) & (F.col("n") > 1.5 * had))
    return wins.select(book, "src", "n", F.least(F.lit(0.85), 0.5 + 0.05 * F.col("_others")).alias("confidence"))

"""Parts of documents: conclusions, keywords, summaries, sections that are added once, digests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigraph.functions.text import drop_thoughts, strip

# The heading of a conclusion and of what follows it, and the forms of lines in a model's summary.
CONCLUSION = r"^(\d+\.?\s+)?[Cc]onclu(sion|ding|de)"
NUMBERED = r"^\d+\.?\s+[A-Z]"
TLDR = r"(?i)^TL;?DR\s*[:：]\s*(.+)$"
BULLET = r"^[-・*]\s*(.+)$"
POINT = r"(?i)^(要点|ポイント|point)\s*\d+\s*[:：.]\s*"


def conclusions(df: DataFrame, key: str, text: str = "text", most: int = 3000) -> DataFrame:
    """(key, conclusion): from the heading of the conclusion to the next numbered heading; else the last 30 %."""
    lines = df.select(key, F.posexplode(F.split(text, r"\r?\n")).alias("n", "line"))
    head = F.trim("line").rlike(CONCLUSION)
    starts = lines.where(head).groupBy(key).agg(F.min("n").alias("start"))
    inside = lines.join(starts, key).where("n > start")
    stops = inside.where(F.trim("line").rlike(NUMBERED)).groupBy(key).agg(F.min("n").alias("stop"))
    kept = inside.join(stops, key, "left").where(F.col("stop").isNull() | (F.col("n") < F.col("stop")))
    ordered = F.array_sort(F.collect_list(F.struct("n", "line")))
    found = kept.groupBy(key).agg(strip(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n")).alias("found"))
    tail = F.substring(F.col(text), F.floor(F.length(text) * 0.7).cast("int") + 1, F.length(text))
    return df.join(found, key, "left").select(key, F.substring(F.when(F.coalesce("found", F.lit("")) != "", F.col("found")).otherwise(tail), 1, most).alias("conclusion"))


def keywords(summary: Column, heading: str = "キーワード", most: int = 10) -> Column:
    """Tags of the keyword section, split at slashes, without ticks."""
    body = F.regexp_extract(summary, rf"(?s)## {heading}\n+(.+?)(?:\n\n|\n##|\z)", 1)
    tags = F.transform(F.split(strip(body), r"\s*/\s*"), lambda t: F.regexp_replace(strip(t), "^`+|`+$", ""))
    return F.slice(F.filter(tags, lambda t: t != ""), 1, most)


def parse_summary(text: Column) -> Column:
    """struct(tldr, points) of a model's summary: a TLDR line (else the first line) and up to five different points."""
    lines = F.transform(F.split(drop_thoughts(text), r"\r?\n"), lambda x: strip(x))
    marked = F.filter(lines, lambda x: x.rlike(TLDR))
    tldr = strip(F.regexp_extract(F.get(F.slice(F.reverse(marked), 1, 1), F.lit(0)), TLDR, 1))
    other = F.get(F.filter(lines, lambda x: (x != "") & ~F.upper(x).rlike("^(POINTS|TLDR)")), F.lit(0))
    bullets = F.filter(lines, lambda x: x.rlike(BULLET))
    points = F.transform(bullets, lambda x: strip(F.regexp_replace(F.regexp_extract(x, BULLET, 1), POINT, "")))
    first = F.slice(F.array_distinct(F.filter(points, lambda p: p != "")), 1, 5)
    return F.struct(F.coalesce(F.when(F.coalesce(tldr, F.lit("")) != "", tldr), other, F.lit("")).alias("tldr"), first.alias("points"))


def add_section(document: Column, header: str, body: Column) -> Column:
    """A section at the end, unless its header is there already."""
    ended = F.concat(F.regexp_replace(document, r"(?U)\s+$", ""), F.lit(f"\n\n{header}\n\n"), body, F.lit("\n"))
    return F.when(F.contains(document, F.lit(header)), document).otherwise(ended)


def insert_before(document: Column, heading: str, section: Column) -> Column:
    """A section before the first occurrence of a heading; without it the document as it is."""
    at = F.instr(document, heading)
    return F.when(at > 0, F.concat(F.substring(document, F.lit(1), at - 1), section, F.lit("\n\n"), F.substring(document, at, F.length(document)))).otherwise(document)


def three_points(text: Column, size: int = 4000) -> Column:
    """Head, middle and tail of a text; they overlap on short ones."""
    n = F.length(text)
    middle = F.greatest(F.lit(0), F.floor(n / 2).cast("int") - size // 2)
    return F.array(F.substring(text, 1, size), F.substring(text, middle + 1, F.lit(size)), F.substring(text, F.greatest(F.lit(0), n - size) + 1, F.lit(size)))


def halves(items: Column) -> Column:
    """struct(first, second) of an array; the first half is never empty."""
    middle = F.greatest(F.lit(1), F.floor(F.size(items) / 2).cast("int"))
    return F.struct(F.slice(items, F.lit(1), middle).alias("first"), F.slice(items, middle + 1, F.greatest(F.size(items) - middle, F.lit(0))).alias("second"))


def for_prompt(text: Column, most: int, mark: str) -> Column:
    """A text cut for a prompt, the cut marked."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(mark))).otherwise(text)


def numbered_notes(notes: Column, label: str = "チャンク") -> Column:
    """Notes that are not blank, each with its number, as one text."""
    tagged = F.transform(notes, lambda x, i: F.when(F.trim(x) != "", F.concat(F.lit(f"[{label} "), (i + 1).cast("string"), F.lit("] "), x)))
    return F.array_join(F.filter(tagged, lambda x: x.isNotNull()), "\n\n")


def list_field(text: Column, name: str) -> Column:
    """Entries of a list in a document's front matter."""
    block = F.regexp_extract(text, rf"(?m)^{name}:\n((?:\s+-\s+.+\n?)+)", 1)
    return F.transform(F.regexp_extract_all(block, F.lit(r"(?m)^\s+-\s+(.+?)\s*$"), F.lit(1)), lambda x: F.regexp_replace(x, "^[\"']|[\"']$", ""))


def byline(authors: Column, most: int = 3) -> Column:
    """The first authors, and whether there are more."""
    return F.concat(F.array_join(F.slice(authors, 1, most), ", "), F.when(F.size(authors) > most, F.lit(" et al.")).otherwise(F.lit("")))


def digest(papers: DataFrame, by: list[str], order: str) -> DataFrame:
    """(by, digest): papers (title, authors, categories, url, summary, published) as numbered Markdown sections."""
    number = F.row_number().over(Window.partitionBy(*by).orderBy(order))
    date = F.date_format("published", "y年M月d日")
    meta = F.concat_ws(" · ", byline(F.col("authors")), F.array_join(F.slice("categories", 1, 3), ", "), date)
    section = F.concat(F.lit("## "), F.col("_n").cast("string"), F.lit(". "), F.col("title"), F.lit("\n\n"), meta, F.lit("\n\n"), F.col("summary"), F.lit("\n\n<"), F.col("url"), F.lit(">"))
    made = papers.withColumn("_n", number).withColumn("_s", section)
    return made.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_s"))), lambda x: x["_s"]), "\n\n").alias("digest"))


def recent_papers(entries: DataFrame, most: int) -> DataFrame:
    """Feed entries (category, category_no, pos, id, published, ...): of each category the first ``most``, versions off the ids,
    each paper once in its first category, newest first."""
    plain = entries.withColumn("id", F.regexp_replace("id", r"v\d+$", ""))
    capped = plain.withColumn("_k", F.row_number().over(Window.partitionBy("category").orderBy("pos"))).where(F.col("_k") <= most)
    once = capped.withColumn("_k", F.row_number().over(Window.partitionBy("id").orderBy("category_no", "pos"))).where("_k = 1")
    return once.drop("_k").orderBy(F.desc("published"), "id")


def contents(sections: DataFrame, by: list[str], stop: list[str], deepest: int = 3) -> DataFrame:
    """Chapters of section rows (by, pos, level, line): tags off, shallow levels only, stop headings out."""
    plain = sections.withColumn("title", strip(F.regexp_replace("line", "<[^>]+>", "")))
    low = F.lower("title")
    bad = reduce(lambda a, b: a | b, [low == w for w in stop], F.col("title") == "")
    kept = plain.where((F.col("level") <= deepest) & ~bad)
    return kept.select(*by, F.row_number().over(Window.partitionBy(*by).orderBy("pos")).alias("num"), "title", "level")


def glossary(texts: DataFrame, key: str, order: str, text: str = "text") -> DataFrame:
    """(key, acronym, first): acronyms in brackets and where each first occurs."""
    found = texts.select(key, order, F.explode(F.regexp_extract_all(text, F.lit(r"\(([A-Z][A-Za-z0-9]{1,6})\)"), F.lit(1))).alias("acronym"))
    return found.groupBy(key, "acronym").agg(F.min(order).alias("first"))

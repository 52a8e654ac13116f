"""File sources: text folders, feeds, queues and Markdown tables."""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evigraph.functions.text import strip

#: Local books that a list names one by one.
MOST_LOCAL = 10_000
#: Endings of sound files; the first is taken where there is none.
AUDIO = (".mp3", ".m4a", ".ogg", ".aac", ".wav")
TEXT_ENDINGS = "*.{[tT][xX][tT],[mM][dD],[rR][sS][tT]}"


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(source, text): every text file of a folder tree, one row each."""
    found = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=TEXT_ENDINGS)
    return found.select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("text"))


def read_sources(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(source, text, source_no) of folders and files in the order given: of a folder its text files in path order, a file whatever
    its ending.  A path that is not there is left out with a warning; without any there are no rows."""
    parts = []
    for i, path in enumerate(paths):
        there = spark._jvm.org.apache.hadoop.fs.Path(path)
        store = there.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        if not store.exists(there):
            warnings.warn(f"{path} is not there", stacklevel=2)
        elif store.getFileStatus(there).isDirectory():
            parts.append(read_texts(spark, path).withColumn("_path", F.lit(i)))
        else:
            parts.append(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("text"), F.lit(i).alias("_path")))
    if not parts:
        return spark.createDataFrame([], "source string, text string, source_no int")
    found = reduce(DataFrame.unionByName, parts)
    # The names alone are numbered; a file that is named twice is there twice.
    names = found.select("_path", "source")
    sizes = names.groupBy("_path").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    at = names.withColumn("_at", F.row_number().over(Window.partitionBy("_path").orderBy("source")) - 1).join(F.broadcast(sizes), "_path")
    return found.join(at.select("_path", "source", (F.col("_before") + F.col("_at")).cast("int").alias("source_no")), ["_path", "source"]).select("source", "text", "source_no")


def ordered_sources(texts: DataFrame) -> DataFrame:
    """With ``source_no``, the place in path order.  The names alone are numbered, folder by folder, and the
    numbers joined to the texts."""
    names = texts.select("source").groupBy("source").agg(F.count("*").alias("_times")).withColumn("_folder", F.regexp_replace("source", "[^/]*$", ""))
    sizes = names.groupBy("_folder").agg(F.sum("_times").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_folder").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.coalesce(F.sum("_times").over(Window.partitionBy("_folder").orderBy("source").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = names.withColumn("_at", inside).join(sizes.select("_folder", before.alias("_before")), "_folder")
    return texts.join(at.select("source", (F.col("_before") + F.col("_at")).cast("int").alias("source_no")), "source")


def strip_gutenberg(text: Column) -> Column:
    """The book between the start and end markers; a missing marker cuts nothing."""
    start, end = r"\*\*\* ?START OF[^\n]*?\*\*\*", r"\*\*\* ?END OF[^\n]*?\*\*\*"
    first = F.regexp_instr(text, F.lit(start))
    begin = F.when(first > 0, first + F.length(F.regexp_extract(text, f"({start})", 1))).otherwise(F.lit(1))
    last = F.regexp_instr(text, F.lit(end))
    size = F.when(last > 0, F.greatest(last - begin, F.lit(0))).otherwise(F.length(text))
    return strip(F.substring(text, begin, size))


#: Kinds of books, and the sizes of their chunks.
BOOK_KINDS, BOOK_CHUNK, BOOK_OVERLAP = ("gutenberg", "url", "local_file"), 2000, 200


def cache_name(source: Column) -> Column:
    """The file that a downloaded source is kept in: its last 40 characters, what is no word character replaced."""
    return F.concat(F.regexp_replace(F.substring(source, -40, 40), r"(?U)[^\w]", "_"), F.lit(".txt"))


def books(rows: DataFrame) -> DataFrame:
    """(source_id, title, author, kind, text, source_url, char_count) of books (source, title, author, kind, text): of Project Gutenberg
    the part between its markers; without a title the last part of an address, or a file's name without its ending."""
    last = F.substring_index("source", "/", -1)
    stem = F.when(F.instr(F.substring(last, 2, 1 << 20), ".") > 0, F.regexp_replace(last, r"(?s)(.)\.[^.]*$", "$1")).otherwise(last)
    remote = F.col("kind") != "local_file"
    body = F.when(F.col("kind") == "gutenberg", strip_gutenberg(F.coalesce("text", F.lit("")))).otherwise(F.coalesce("text", F.lit("")))
    made = rows.where(F.col("kind").isin(*BOOK_KINDS)).withColumn("text", body)
    title = F.when(F.coalesce("title", F.lit("")) != "", F.col("title")).when(remote, last).otherwise(stem)
    return made.select(F.col("source").alias("source_id"), title.alias("title"), "author", "kind", "text", F.when(remote, F.col("source")).alias("source_url"), F.length("text").alias("char_count"))


def read_books(spark: SparkSession, listed: DataFrame, cache: str) -> DataFrame:
    """``books`` of a list (source, title, author, kind): local files by their paths, downloaded ones from the folder ``cache``."""
    named = listed.withColumn("_file", F.when(F.col("kind") == "local_file", F.substring_index("source", "/", -1)).otherwise(cache_name(F.col("source"))))
    local = [r["source"] for r in listed.where("kind = 'local_file'").select("source").distinct().limit(MOST_LOCAL + 1).collect()]
    if len(local) > MOST_LOCAL:
        raise ValueError(f"more than {MOST_LOCAL} local books: put them into one folder")
    kept = read_texts(spark, cache).select(F.substring_index("source", "/", -1).alias("_file"), "text")
    own = read_sources(spark, local).select(F.substring_index("source", "/", -1).alias("_file"), "text")
    remote = named.where("kind <> 'local_file'").join(kept, "_file")
    return books(remote.unionByName(named.where("kind = 'local_file'").join(own, "_file")).drop("_file"))


def episodes(items: DataFrame, feed: str, order: str) -> DataFrame:
    """(feed, ep_num, pub_date, title, audio_url, duration, description, file_name) of feed items, newest first by ``order``: the oldest is number 1."""
    number = F.row_number().over(Window.partitionBy(feed).orderBy(F.desc(order)))
    url = F.lower(F.substring_index(F.coalesce("audio_url", F.lit("")), "?", 1))
    ending = F.coalesce(*[F.when(F.endswith(url, F.lit(e)), F.lit(e)) for e in AUDIO], F.lit(AUDIO[0]))
    plain = F.regexp_replace(F.lower(F.col("title")), r"(?U)[^\w\s-]", "")
    name = F.substring(F.regexp_replace(strip(plain), r"(?U)[\s_-]+", "_"), 1, 60)
    made = items.withColumns({"ep_num": number, "title": strip(F.coalesce("title", F.lit(""))), "pub_date": rss_date(F.col("pub_date"))})
    return made.select(
        feed, "ep_num", "pub_date", "title", "audio_url", "duration", F.substring("description", 1, 500).alias("description"),
        F.concat(F.col("pub_date"), F.lit("_ep"), F.lpad(F.col("ep_num").cast("string"), F.greatest(F.lit(3), F.length(F.col("ep_num").cast("string"))), F.lit("0")), F.lit("_"), name, ending).alias("file_name"),
    )


def read_queue(spark: SparkSession, path: str, types: list[str]) -> DataFrame:
    """(source_type, source_id) of lines ``type id``; comments, blanks and unknown types are left out."""
    return queue_items(spark.read.text(path), types)


def queue_items(lines: DataFrame, types: list[str], line: str = "value") -> DataFrame:
    """(source_type, source_id) of queue lines."""
    lines = lines.select(F.trim(line).alias("line")).where("line <> '' and not startswith(line, '#')")
    parts = F.split("line", r"\s+", 2)
    return lines.select(parts[0].alias("source_type"), F.get(parts, F.lit(1)).alias("source_id")).where(F.col("source_type").isin(types) & F.col("source_id").isNotNull())


def read_rss(spark: SparkSession, path: str) -> DataFrame:
    """Items of RSS files as (title, link, pub_date text, description)."""
    schema = "title string, link string, pubDate string, description string"
    return spark.read.format("xml").option("rowTag", "item").schema(schema).load(path).withColumnRenamed("pubDate", "pub_date")


def rss_date(text: Column) -> Column:
    """YYYY-MM-DD of a mail-style date; an unknown month is 00, another form its first ten characters."""
    months = F.create_map(*[F.lit(x) for i, m in enumerate("Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split(), 1) for x in (m, f"{i:02d}")])
    pattern = r"(\d{1,2}) (\w{3}) (\d{4})"
    day, month, year = (F.regexp_extract(text, pattern, i) for i in (1, 2, 3))
    return F.when(year != "", F.concat_ws("-", year, F.coalesce(F.try_element_at(months, month), F.lit("00")), F.lpad(day, 2, "0"))).otherwise(F.substring(text, 1, 10))


def recent(df: DataFrame, published: str, now: Column, days: int) -> DataFrame:
    """Rows of the last ``days`` (0: all); rows without a date stay."""
    if not days:
        return df
    return df.where(F.col(published).isNull() | (F.col(published) >= now - F.make_dt_interval(F.lit(days))))


def carried_sections(lines: DataFrame, key: str, line_no: str = "line_no", line: str = "line") -> DataFrame:
    """Each line with the last second-level heading at or above it."""
    so_far = Window.partitionBy(key).orderBy(line_no).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    heading = F.when(F.col(line).rlike("^## "), F.regexp_replace(line, "^## +", ""))
    return lines.withColumn("section", F.last(heading, ignorenulls=True).over(so_far))


def episode_rows(lines: DataFrame, key: str, line_no: str = "line_no", line: str = "line", channel: str | None = None) -> DataFrame:
    """(key, line_no, video_id, title, date, channel) of the lines of Markdown tables that link a video; channel: the
    section they stand in, which must hold the word asked for."""
    rows = carried_sections(lines, key, line_no, line).withColumn("video_id", F.regexp_extract(line, r"youtube\.com/watch\?v=([A-Za-z0-9_-]{11})", 1))
    rows = rows.where((F.col("video_id") != "") & ~F.col(line).rlike("^## "))
    section = F.coalesce("section", F.lit(""))
    if channel:
        rows = rows.where(F.contains(F.lower(section), F.lit(channel.lower())))
    title = F.regexp_extract(line, r"\[([^\]]+)\]\(https://www\.youtube", 1).alias("title")
    return rows.select(key, line_no, "video_id", title, F.regexp_extract(line, r"^\|\s*(\d{4}-\d{2}-\d{2})\s*\|", 1).alias("date"), section.alias("channel"))


def channel_entries(entries: DataFrame, now: Column, days: int) -> DataFrame:
    """Entries of a channel feed (id, link, title, published): the id from its tag, else from the link; the last ``days`` and what has
    no date, which counts as of now."""
    video = F.coalesce(F.when(F.trim("id") != "", F.regexp_replace("id", "^yt:video:", "")), F.regexp_extract("link", r"[?&]v=([A-Za-z0-9_-]+)", 1))
    kept = recent(entries.withColumn("video_id", video), "published", now, days)
    return kept.where("video_id <> ''").select("video_id", "title", F.coalesce("published", now).alias("published"))

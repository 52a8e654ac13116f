"""Text functions as column expressions; pandas UDFs only where Spark has no expression for the rule."""

from __future__ import annotations

import html
import html.entities
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN = r"(?U)([A-Za-z0-9]+|[^\s])"


def strip(text: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def tokenize(text: Column) -> Column:
    """Runs of ASCII letters and digits, and every other visible character; each token lower-cased."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(1)), lambda t: F.lower(t))


def word_set(text: Column) -> Column:
    """Distinct tokens for section matching: ASCII words, and character pairs of CJK runs."""
    words = F.transform(F.regexp_extract_all(text, F.lit("([A-Za-z0-9]+)"), F.lit(1)), lambda t: F.lower(t))
    runs = F.regexp_extract_all(text, F.lit("([぀-鿿]{2,})"), F.lit(1))
    pairs = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))))
    return F.array_distinct(F.concat(words, pairs))


def char_windows(text: Column, size: int = 400, overlap: int = 80) -> Column:
    """Offsets of sliding windows: the first one to reach the end is the last.  Empty text has none."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be less than the window size")
    step, n = size - overlap, F.length(text)
    last = F.when(n <= size, F.lit(0)).otherwise(F.ceil((n - size) / step).cast("int"))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), last), lambda i: i * step)).otherwise(F.array().cast("array<int>"))


def slug(title: Column, most: int = 60) -> Column:
    """Lower-case words joined by hyphens, cut."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, most)


def clock(seconds: Column) -> Column:
    """H:MM:SS, or MM:SS under an hour; fractions are dropped."""
    s = F.floor(seconds).cast("int")
    h, m, rest = F.floor(s / 3600).cast("int"), F.floor(s % 3600 / 60).cast("int"), s % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, rest)).otherwise(F.format_string("%02d:%02d", m, rest))


def count_of(text: Column) -> Column:
    """Counts as people write them: 1.2K, 3M, 1,234; anything else is 0.  Decimal arithmetic: 32.3K is 32,300, where doubles fall just short."""
    plain = F.upper(F.regexp_replace(F.trim(text), ",", ""))
    unit = F.when(plain.endswith("K"), F.lit(1000)).when(plain.endswith("M"), F.lit(1_000_000)).otherwise(F.lit(1))
    number = F.regexp_replace(plain, "[KM]$", "").try_cast("decimal(30,12)")
    return F.coalesce((number * unit.cast("decimal(7,0)")).try_cast("long"), F.lit(0))


def bare_name(name: Column) -> Column:
    """A name without its brackets, stripped and lower-cased: the key of string duplicates."""
    return F.lower(strip(F.regexp_replace(name, r"\s*[(\[].*?[)\]]", "")))


def name_tokens(name: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(name), r"[\s\-_/]+"), lambda t: F.length(t) > 2))


def jaccard(a: Column, b: Column) -> Column:
    """Share of common elements; 0 for two empty arrays."""
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(F.lit(0.0))


def title_confidence(query: Column, title: Column) -> Column:
    """1 for equal names, 0.85 if one is the other with a qualifier (not a number), else the common words over
    the larger word set."""
    q, t = F.lower(strip(query)), F.lower(strip(title))

    def qualified(long: Column, short: Column) -> Column:
        rest = F.substring(long, F.length(short) + 1, F.length(long))
        return long.startswith(F.concat(short, F.lit(" "))) & ~F.ltrim(rest).rlike("^[0-9]")

    def words(x: Column) -> Column:
        return F.array_distinct(F.filter(F.split(x, r"(?U)\W+"), lambda w: w != ""))

    most = F.greatest(F.size(words(q)), F.size(words(t)))
    overlap = F.when(most > 0, F.size(F.array_intersect(words(q), words(t))) / most).otherwise(F.lit(0.0))
    return F.when(q == t, F.lit(1.0)).when(qualified(q, t) | qualified(t, q), F.lit(0.85)).otherwise(F.round(overlap, 3))


def arxiv_id(text: Column) -> Column:
    """The paper number in a link, or the text itself; without version."""
    found = F.regexp_extract(text, r"arxiv\.org/(?:abs|pdf)/([0-9.]+[0-9])", 1)
    return F.substring_index(F.when(found != "", found).otherwise(strip(text)), "v", 1)


def drop_thoughts(text: Column) -> Column:
    """Model output without its thinking blocks."""
    return strip(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""))


def file_stem(date: Column, number: Column, title: Column) -> Column:
    """Episode file name without ending: date, number, slug of words joined by underscores."""
    plain = F.regexp_replace(F.lower(compose(title)), r"(?U)[^\w\s-]", "")
    return F.concat(date, F.lit("_ep"), F.lpad(number.cast("string"), 3, "0"), F.lit("_"), F.substring(F.regexp_replace(strip(plain), r"(?U)[\s_-]+", "_"), 1, 60))


@F.pandas_udf(T.StringType())
def unescape(text: pd.Series) -> pd.Series:
    """HTML character references; Spark has no function for them."""
    return text.map(html.unescape, na_action="ignore")


@F.pandas_udf(T.StringType())
def unescape_closed(text: pd.Series) -> pd.Series:
    """Only the references that a semicolon ends, each by its whole name: ``&amp`` at a cut end stays as it is."""
    number, name = r"&#(?:[0-9]+|[xX][0-9a-fA-F]+);", r"&([A-Za-z][A-Za-z0-9]*;)"
    read = lambda m: html.entities.html5.get(m[1], m[0]) if m[1] else html.unescape(m[0])
    return text.map(lambda t: re.sub(f"{number}|{name}", read, t), na_action="ignore")


@F.pandas_udf(T.StringType())
def compose(text: pd.Series) -> pd.Series:
    """NFKC; Spark has no function for it."""
    return text.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")

"""Web pages: title, text and outbound links of an (id, url, html) table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.functions.text import char_windows, strip, unescape, unescape_closed

# Domains and link patterns that are never followed.
NOISE_DOMAINS = [
    "web.archive.org", "archive.org", "twitter.com", "x.com", "mastodon.social", "facebook.com", "instagram.com", "linkedin.com", "threads.net",
    "mamot.fr", "bsky.app", "medium.com", "youtube.com", "youtu.be", "vimeo.com", "amazon.com", "amzn.to", "bookshop.org", "indiebound.org",
    "us.macmillan.com", "macmillan.com", "harpercollins.com", "strandbooks.com", "booksoup.com", "penguinrandomhouse.com", "simonandschuster.com",
    "powells.com", "eventbrite.com", "eventbrite.co.uk", "meetup.com", "luma.com", "tickettailor.com", "sxswlondon.com", "eventbrite.ca",
    "paypal.com", "patreon.com", "ko-fi.com", "c0.wp.com", "i0.wp.com", "i1.wp.com", "i2.wp.com", "creativecommons.org", "wordpress.org",
    "wordpress.com", "deflect.ca", "xkcd.com", "flickr.com", "tumblr.com", "deviantart.com", "gmpg.org", "omny.fm", "ipetitions.com", "actblue.com",
    "secure.actblue.com", "re-publica.com", "otherland-berlin.de", "howthelightgetsin.org", "encuentroderechosdigitales.com", "sxsw.com",
    "votingvillage.org", "thebezzle.org", "lost-cause.org", "seizethemeansofcomputation.org", "redteamblues.com", "chokepointcapitalism.com",
    "pluralistic.net", "craphound.com", "boingboing.net",
]
NOISE_LINKS = [
    r"^/", r"^mailto:", r"^#", r"\.(jpg|jpeg|png|gif|pdf|mp3|mp4|zip|css|js|woff|woff2|svg|ico)$", r"/wp-content/", r"/wp-includes/",
]
DROPPED_BLOCKS = ["script", "style", "head", "nav", "footer", "header"]
# How a title, a tag and a link are told.
TITLE, TAG, HREF = r"(?i)<title[^>]*>([^<]+)</title>", "<[^>]+>", r"""(?i)href=["']([^"']+)["']"""


def raw_title(html: Column) -> Column:
    return F.regexp_extract(html, TITLE, 1)


def title(html: Column, closed: bool = False) -> Column:
    """The page title, unescaped (``closed``: only references with a semicolon); empty if there is none."""
    return (unescape_closed if closed else unescape)(strip(raw_title(html)))


def without_markup(html: Column) -> Column:
    """Blocks that hold no text out, tags to blanks."""
    for block in DROPPED_BLOCKS:
        html = F.regexp_replace(html, rf"(?is)<{block}[^>]*>.*?</{block}>", " ")
    return F.regexp_replace(html, TAG, " ")


def tidy(text: Column) -> Column:
    """Long runs of white space to a paragraph break."""
    return strip(F.regexp_replace(text, r"(?U)\s{3,}", "\n\n"))


def text(html: Column, closed: bool = False) -> Column:
    """The visible text.  Character references (``closed``: only those with a semicolon) are read after the tags are gone, so that an
    escaped tag stays text."""
    return tidy((unescape_closed if closed else unescape)(without_markup(html)))


def links(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, pos, url, domain): absolute outbound links, noise out, query and fragment cut, each once a page."""
    found = pages.select(key, F.posexplode(F.regexp_extract_all(F.col(html), F.lit(HREF), F.lit(1))).alias("pos", "href"))
    found = found.withColumn("href", strip(F.col("href")))
    for pattern in NOISE_LINKS:
        found = found.where(~F.col("href").rlike("(?i)" + pattern))
    host = F.regexp_replace(F.lower(F.regexp_extract("href", r"^https?://([^/?#]+)", 1)), r"^www\.", "")
    found = found.withColumn("domain", host).where("domain <> ''")
    labels = F.split("domain", r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    found = found.where(~F.arrays_overlap(tails, F.array(*map(F.lit, NOISE_DOMAINS))))
    found = found.withColumn("url", F.regexp_extract("href", r"^([^?#]*)", 1))
    return found.groupBy(key, "url", "domain").agg(F.min("pos").alias("pos"))


def ingest(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", given_title: str | None = None, size: int = 1500, overlap: int = 150, closed: bool = False) -> DataFrame:
    """Source documents (key, source_type, source_id, title, text, chunks) of pages: the title given, else the page's own, else
    the URL; the text in windows of characters."""
    own = title(F.col(html), closed)
    named = F.coalesce(*([F.when(F.trim(given_title) != "", F.col(given_title))] if given_title else []), F.when(own != "", own), F.col(url))
    made = pages.select(key, F.lit("web").alias("source_type"), F.col(url).alias("source_id"), named.alias("title"), text(F.col(html), closed).alias("text"))
    at = char_windows(F.col("text"), size, overlap)
    return made.withColumn("chunks", F.transform(at, lambda i: F.substring(F.col("text"), i + 1, F.lit(size))))


def collected(articles: DataFrame, links_: DataFrame, key: str = "page_id") -> DataFrame:
    """(source_id, title): articles (key, url, title) and the links on them (key, pos, url), each URL once, with the title
    where it is met first: an article before its links, articles in key order."""
    own = articles.select(F.col(key).alias("a"), F.lit(-1).alias("p"), F.col("url").alias("source_id"), "title")
    rows = own.unionByName(links_.select(F.col(key).alias("a"), F.col("pos").alias("p"), F.col("url").alias("source_id"), F.lit("").alias("title")))
    return rows.groupBy("source_id").agg(F.min_by("title", F.struct("a", "p", "title")).alias("title"))

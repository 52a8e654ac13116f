"""Text functions, segmentation and sources on small cases."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from evigraph.functions import chunks, text
from evigraph.sources import files, web


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    ("value", "tokens"),
    [("Hello World", ["hello", "world"]), ("日本語", ["日", "本", "語"]), ("GPT4 é!", ["gpt4", "é", "!"]), ("a　b c", ["a", "b", "c"]), ("", []), (None, [])],
)
def test_tokenize(spark, value, tokens):
    assert one(spark, value, text.tokenize) == tokens


def test_char_windows(spark):
    assert one(spark, "a" * 1000, lambda c: text.char_windows(c)) == [0, 320, 640]
    assert one(spark, "a" * 400, lambda c: text.char_windows(c)) == [0]
    assert one(spark, "hello world", lambda c: text.char_windows(c, 5, 0)) == [0, 5, 10]
    assert one(spark, "", lambda c: text.char_windows(c)) == []
    with pytest.raises(ValueError, match="overlap"):
        text.char_windows(F.lit("a"), 5, 5)


def test_small_text_functions(spark):
    assert one(spark, "  Some Title: 2nd! ", text.slug) == "some-title-2nd"
    assert [one(spark, s, text.clock, "double") for s in (59.9, 3600.0, 3725.5)] == ["00:59", "1:00:00", "1:02:05"]
    assert [one(spark, s, text.count_of) for s in ("1.2K", "3M", "1,234", "x", "")] == [1200, 3_000_000, 1234, 0, 0]
    assert [one(spark, s, text.count_of) for s in ("32.3K", "64.1k", "-1.5K", "1e3", "9" * 25 + "M", "nan")] == [32_300, 64_100, -1500, 1000, 0, 0]
    assert one(spark, "Deep Learning (DL)", text.bare_name) == "deep learning"
    assert one(spark, "https://arxiv.org/abs/2401.12345v2", text.arxiv_id) == "2401.12345"
    assert one(spark, "<think>a\nb</think> c ", text.drop_thoughts) == "c"
    assert one(spark, "a &lt;b&gt; &amp;", text.unescape) == "a <b> &"
    assert one(spark, "&lt;b&gt; &#39;&#x41; &amp;lt; &ampx; &amp", text.unescape_closed) == "<b> 'A &lt; &ampx; &amp"
    assert sorted(one(spark, "AI と機械学習 x", text.word_set)) == sorted(["ai", "x", "と機", "機械", "械学", "学習"])


def test_title_confidence(spark):
    pairs = [("Dune", "dune", 1.0), ("Dune", "Dune film", 0.85), ("Dune", "Dune 2", 0.5), ("a b", "b c d", 0.333), ("", "x", 0.0)]
    df = spark.createDataFrame([p[:2] for p in pairs], "q string, t string")
    got = [r[0] for r in df.select(text.title_confidence(F.col("q"), F.col("t"))).collect()]
    assert got == [p[2] for p in pairs]


def test_sections(spark):
    df = spark.createDataFrame([(1, "intro\n# A\nx\n\n## B\n"), (2, "# only\nbody"), (3, "")], "doc_id long, text string")
    got = sorted((r.doc_id, r.section, r.header, r.body) for r in chunks.sections(df, "doc_id").collect())
    assert got == [(1, 0, None, "intro"), (1, 1, "# A", "x"), (1, 2, "## B", ""), (2, 1, "# only", "body")]
    kept = chunks.without_sections(spark.createDataFrame([(1, "a\n## 編集後記\nb\n#### c\n# d\ne")], "doc_id long, text string"), "doc_id", ["編集後記"])
    assert kept.first().text == "a\n# d\ne"


def test_web(spark):
    html = "<head><title> A &amp; B </title></head><style>x</style><p>one &lt;b&gt;</p>\n\n\n<p>two</p><script>no</script>"
    assert one(spark, html, web.title) == "A & B"
    assert one(spark, html, web.text) == "one <b>\n\ntwo"
    cut = "<title>a &amp;&amp</title><p>b &lt</p>"
    assert (one(spark, cut, web.title), one(spark, cut, lambda c: web.title(c, closed=True))) == ("a &&", "a &&amp")
    assert one(spark, cut, lambda c: web.text(c, closed=True)) == "a &&amp  b &lt"
    page = '<a href="/in">x</a><a href="https://www.News.org/a?q#f">y</a><a href="https://news.org/a">z</a><a href="https://m.twitter.com/u">t</a><a href="mailto:x">m</a><a href="https://x.org/a.pdf">p</a>'
    got = [(r.url, r.domain) for r in web.links(spark.createDataFrame([(1, page), (2, None)], "page_id long, html string")).orderBy("pos").collect()]
    assert got == [("https://www.News.org/a", "news.org"), ("https://news.org/a", "news.org")]


def test_files(spark, tmp_path):
    (tmp_path / "b").mkdir()
    (tmp_path / "b/x.MD").write_text("two\nlines")
    (tmp_path / "a.txt").write_text("one")
    (tmp_path / "c.pdf").write_text("no")
    got = files.ordered_sources(files.read_texts(spark, str(tmp_path))).orderBy("source_no").collect()
    assert [r.text for r in got] == ["one", "two\nlines"]
    (tmp_path / "queue.lst").write_text("# c\npodcast abc\nweb  http://x y\nother 1\n\npaper\n")
    queue = files.read_queue(spark, str(tmp_path / "queue.lst"), ["podcast", "web", "paper"])
    assert [tuple(r) for r in queue.collect()] == [("podcast", "abc"), ("web", "http://x y")]
    (tmp_path / "feed.xml").write_text("<rss><channel><item><title>t</title><pubDate>Tue, 05 Mar 2024 10:00:00 GMT</pubDate></item></channel></rss>")
    feed = files.read_rss(spark, str(tmp_path / "feed.xml"))
    assert feed.select(files.rss_date(F.col("pub_date"))).first()[0] == "2024-03-05"
    assert one(spark, "5 Xyz 2020", files.rss_date) == "2020-00-05" and one(spark, "2020-01-02T", files.rss_date) == "2020-01-02"
    book = "head\n*** START OF THE BOOK ***\nbody\n*** END OF THE BOOK ***\ntail"
    assert one(spark, book, files.strip_gutenberg) == "body" and one(spark, " x ", files.strip_gutenberg) == "x"
    lines = spark.createDataFrame([(1, 0, "a"), (1, 1, "## S"), (1, 2, "b")], "k int, line_no int, line string")
    assert [r.section for r in files.carried_sections(lines, "k").orderBy("line_no").collect()] == [None, "S", "S"]

"""JSON artefacts of runs: book data, truth texts, loose objects, records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.functions.text import strip

RULE = "\n\n---\n\n"
CHUNKS = "chunks array<struct<heading:string,text:string>>"
WEB = (
    "subject string, chunks array<struct<heading_title:string,summary_text:string,sources:array<string>>>,"
    " raw_results map<string,array<struct<title:string,url:string,body:string>>>"
)
CONCEPTS = (
    "subject string, source_mode string, concepts array<struct<name:string,description:string,significance:string>>,"
    " relations array<struct<source:string,target:string,relation_type:string,description:string>>,"
    " aporias array<struct<name:string,description:string>>, logic_flow array<string>, core_frustration string"
)


def _or_empty(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def _items(array: Column) -> Column:
    return F.coalesce(array, F.array())


def _section(title: str, body: Column) -> Column:
    """A one-entry array of a section with a body, else none."""
    return F.when(_or_empty(body) != "", F.array(F.concat(F.lit(f"{title}\n\n"), body))).otherwise(F.array().cast("array<string>"))


def chunks_text(json: Column) -> Column:
    """A book's chunks as one text, headings above theirs."""
    parts = F.from_json(json, CHUNKS)["chunks"]
    return F.array_join(F.transform(_items(parts), lambda c: F.concat(F.when(_or_empty(c["heading"]) != "", F.concat(F.lit("## "), c["heading"], F.lit("\n\n"))).otherwise(""), _or_empty(c["text"]))), RULE)


def web_text(json: Column) -> Column:
    """Search results as one text: the subject, summaries with their sources, then what was found under each heading."""
    x = F.from_json(json, WEB)

    def summary(c: Column) -> Column:
        body = strip(_or_empty(c["summary_text"]))
        head = F.when(_or_empty(c["heading_title"]) != "", F.concat(F.lit("## "), c["heading_title"], F.lit("\n\n"))).otherwise("")
        tail = F.when(F.size(_items(c["sources"])) > 0, F.concat(F.lit("\n\nSources: "), F.array_join(c["sources"], ", "))).otherwise("")
        return F.when(body != "", F.concat(head, body, tail))

    def found(r: Column) -> Column:
        body = strip(_or_empty(r["body"]))
        return F.when(body != "", F.concat(F.lit("["), _or_empty(r["title"]), F.lit("] ("), _or_empty(r["url"]), F.lit(")\n"), body))

    raw = F.flatten(F.coalesce(F.map_values(x["raw_results"]), F.array()))
    parts = F.concat(_section("# Subject", x["subject"]), F.transform(_items(x["chunks"]), summary), F.transform(raw, found))
    return F.array_join(F.filter(parts, lambda p: p.isNotNull()), RULE)


def concepts_text(json: Column) -> Column:
    """A concept graph as one text: overview, concepts, relations, aporias, flow, frustration."""
    x = F.from_json(json, CONCEPTS)

    def concept(c: Column) -> Column:
        more = F.when(_or_empty(c["significance"]) != "", F.concat(F.lit("\n\nSignificance: "), c["significance"])).otherwise("")
        return F.when(_or_empty(c["name"]) != "", F.concat(F.lit("## Concept: "), c["name"], F.lit("\n\n"), _or_empty(c["description"]), more))

    def relation(r: Column) -> Column:
        named = (_or_empty(r["source"]) != "") & (_or_empty(r["target"]) != "")
        return F.when(named, F.concat(F.lit("## Relation: "), r["source"], F.lit(" → "), r["target"], F.lit(" ("), _or_empty(r["relation_type"]), F.lit(")\n\n"), _or_empty(r["description"])))

    def aporia(a: Column) -> Column:
        return F.when(_or_empty(a["name"]) != "", F.concat(F.lit("## Aporia: "), a["name"], F.lit("\n\n"), _or_empty(a["description"])))

    flow = F.array_join(F.transform(F.filter(_items(x["logic_flow"]), lambda s: s.isNotNull()), lambda s: F.concat(F.lit("- "), s)), "\n")
    parts = F.concat(
        _section("# Overview", x["subject"]), F.transform(_items(x["concepts"]), concept), F.transform(_items(x["relations"]), relation),
        F.transform(_items(x["aporias"]), aporia), _section("## Logic Flow", flow), _section("## Core Frustration", x["core_frustration"]),
    )
    return F.array_join(F.filter(parts, lambda p: p.isNotNull()), RULE)


def truth_text(ready: Column, chunks: Column, web: Column, concepts: Column) -> Column:
    """struct(route, text) of a run: what was written before, else its chunks, its search results, its concept graph; null
    without any."""
    routes = (("ready", ready, ready), ("chunks", chunks, chunks_text(chunks)), ("web", web, web_text(web)), ("concepts", concepts, concepts_text(concepts)))
    return F.coalesce(*[F.when(given.isNotNull(), F.struct(F.lit(name).alias("route"), text.alias("text"))) for name, given, text in routes])


def run_data(runs: DataFrame, key: str, log: str = "log", concepts: str = "concepts") -> DataFrame:
    """(key, book_id, source_mode, subject) of runs from their logs and concept graphs.

    The last line that says a run started names the book; a web search in the log decides the mode, then an intake, then
    the concept graph."""
    lines = F.split(F.coalesce(log, F.lit("")), r"\r?\n")
    started = F.filter(lines, lambda x: x.contains("run started") & (F.regexp_extract(x, r"book=(\S+)", 1) != ""))
    book = F.regexp_extract(F.element_at(F.reverse(F.concat(F.array(F.lit("")), started)), 1), r"book=(\S+)", 1)
    node = F.filter(lines, lambda x: x.contains("→ node:"))
    graph = F.from_json(concepts, CONCEPTS)
    mode = F.when(F.exists(node, lambda x: x.contains("web_research")), "web_researcher").when(F.exists(node, lambda x: x.contains("ingest")), "gutenberg")
    return runs.select(
        key, F.when(book != "", book).otherwise("unknown").alias("book_id"),
        F.coalesce(mode, graph["source_mode"], F.lit("unknown")).alias("source_mode"), _or_empty(graph["subject"]).alias("subject"),
    )


def loose_object(text: Column, schema: str, greedy: bool = True) -> Column:
    """The JSON object in a text (from the first brace to the last, or to the first closing one), by a schema; its fields
    are null if it is no valid object."""
    return F.from_json(F.regexp_extract(text, r"(?s)(\{.*\})" if greedy else r"(?s)(\{.*?\})", 1), schema)


def post_tags(tags: Column, given: Column, channel: Column) -> Column:
    """Tags of a post: the keywords given, if any, else the model's tags without ``#``; the channel at the end if it lacks."""
    plain = F.filter(F.transform(_items(tags), lambda t: strip(F.ltrim(strip(t), F.lit("#")))), lambda t: t != "")
    chosen = F.when(F.size(_items(given)) > 0, given).otherwise(plain)
    return F.when((_or_empty(channel) != "") & ~F.array_contains(chosen, channel), F.array_append(chosen, channel)).otherwise(chosen)


def write_records(df: DataFrame, name: str = "record") -> DataFrame:
    """Rows as JSON texts."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias(name))


def read_records(df: DataFrame, schema: str, name: str = "record") -> DataFrame:
    """JSON texts as rows of a schema (``evigraph.schemas``): unknown keys are left out, missing ones null."""
    return df.select(F.from_json(name, schema).alias("x")).select("x.*")


def variant_object(text: Column) -> Column:
    """The JSON object in a text (from the first brace to the last) as a variant, whatever its keys; null if there is no valid one."""
    body = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.when(body != "", F.try_parse_json(body))


def variant_fields(df: DataFrame, name: str, fields: dict[str, str], rest: str = "rest") -> DataFrame:
    """``df`` with a column for each of ``fields`` (column: "path type") of the variant ``name``, and the whole of it as JSON under
    ``rest``, so that keys nobody asked for are kept.  What is missing, or of a type that can't be cast, is null."""
    made = {c: F.try_variant_get(F.col(name), *spec.split(" ", 1)) for c, spec in fields.items()}
    return df.withColumns(made | {rest: F.to_json(name)}).drop(name)

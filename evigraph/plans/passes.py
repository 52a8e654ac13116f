"""Passes over the model boundary: prompts as columns, answers read back, with a plain form where an answer can't be used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigraph.functions.documents import for_prompt, numbered_notes
from evigraph.operators import graph, layout, normalize, parse, speakers, splits
from evigraph.operators.correction import claims_from_answers
from evigraph.plans.providers import ModelProvider
from evigraph.shared import written

# Blocks that are translated, and the material of a synthesis.
TRANSLATABLE = ["title", "heading", "abstract", "paragraph", "caption"]
MATERIAL = ["concept", "framework", "theory", "method", "phenomenon", "claim"]


def speakers_block(speakers: Column) -> Column:
    """The part of a prompt that names a source's speakers; empty without any."""
    names = F.array_join(F.transform(speakers, lambda s: F.concat(F.lit('"'), s, F.lit('"'))), ", ")
    lines = [F.lit("## Speakers: use exactly these names"), F.concat(F.lit("Known speakers: "), names), F.concat(F.lit('If it is not clear who speaks: "'), F.get(speakers, F.lit(0)), F.lit('"'))]
    return F.when(F.size(F.coalesce(speakers, F.array().cast("array<string>"))) > 0, F.concat(F.concat_ws("\n", *lines), F.lit("\n\n"))).otherwise("")


def question_counts(chunks: Column) -> Column:
    """struct(least, most): how many questions an article of so many chunks asks."""
    return F.struct(F.greatest(F.lit(2), F.least(2 * chunks, F.lit(5))).alias("least"), F.greatest(F.lit(3), F.least(3 * chunks, F.lit(7))).alias("most"))


def extract_claims(documents: DataFrame, provider: ModelProvider, size: int = 4000, most: int = 30) -> DataFrame:
    """(doc_id, claim_no, claim): a document's pieces are asked for their claims."""
    pieces = splits.bounded_chunks(documents, "doc_id", size=size)
    asked = provider.ask(pieces.select("doc_id", "chunk_no", F.concat(F.lit("List the claims of this text as a JSON array.\n\n"), F.col("chunk")).alias("prompt")))
    return claims_from_answers(asked, most=most)


def translate(blocks: DataFrame, provider: ModelProvider, most: int = 3000) -> DataFrame:
    """Blocks (doc, pos, type, text, skip_translate) with ``ja``: in numbered batches of ``most`` characters; where a batch's answer
    does not fit it, block by block.  Other blocks have no translation."""
    wanted = F.col("type").isin(TRANSLATABLE) & ~F.coalesce("skip_translate", F.lit(False)) & (F.trim(F.coalesce("text", F.lit(""))) != "")
    blocks = written(blocks, "blocks")
    placed = layout.batches(blocks.where(wanted).select("doc", "pos", "type", "text"), most)
    whole = placed.groupBy("doc", "batch").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("rows"))
    prompt = F.to_json(F.transform("rows", lambda r, i: F.struct(i.alias("i"), r["text"].alias("en"))))
    parts = [F.transform("rows", lambda r: r["pos"]).alias("at"), F.transform("rows", lambda r: r["text"]).alias("en")]
    asked = provider.ask(whole.select("doc", *parts, prompt.alias("prompt"), F.size("rows").alias("n")))
    answered = asked.select("doc", "at", "en", parse.indexed_batch(F.col("answer"), F.col("n")).alias("all"))
    # Written, so that no batch is made or asked twice.
    answered = written(answered.withColumn("all", F.when(~F.exists("all", lambda x: x.isNull()), F.col("all"))), "answered")
    fitting = answered.where("all is not null").select("doc", "all", F.posexplode("at").alias("i", "pos")).select("doc", "pos", F.get("all", F.col("i")).alias("ja"))
    failed = answered.where("all is null").select("doc", "en", F.posexplode("at").alias("i", "pos"))
    single = provider.ask(failed.select("doc", "pos", F.get("en", F.col("i")).alias("prompt")))
    made = fitting.unionByName(single.select("doc", "pos", F.trim(F.col("answer")).alias("ja")))
    return blocks.join(made, ["doc", "pos"], "left")


def article_prompts(notes: DataFrame, key: str = "doc_id", order: str = "chunk_no", note: str = "note", overview: int = 16000) -> DataFrame:
    """(key, first, second, overview, questions): the prompts of an article's passes from its notes: the first half of them, the
    second, the start of all, and how many questions are asked."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(order, note))), lambda x: x[note])
    made = notes.groupBy(key).agg(ordered.alias("_n"))
    middle = F.greatest(F.lit(1), F.floor(F.size("_n") / 2).cast("int"))
    first, second = F.slice("_n", F.lit(1), middle), F.slice("_n", middle + 1, F.size("_n"))
    counts = question_counts(F.size("_n"))
    return made.select(
        key, numbered_notes(first).alias("first"), numbered_notes(second).alias("second"), for_prompt(numbered_notes(F.col("_n")), overview, "…").alias("overview"),
        F.format_string("%d-%d", counts["least"], counts["most"]).alias("questions"),
    )


def article(notes: DataFrame, provider: ModelProvider, key: str = "doc_id", order: str = "chunk_no", note: str = "note", most: int = 16000, asked: int = 2) -> DataFrame:
    """(key, first, second, frame, questions): an article of its notes in four passes.

    The first half of the notes gives the first points; the second half the others, told which headings the first has, so that they
    are avoided; both together, cut at ``most`` characters, give the frame (summary, quotes, keywords) and ``asked`` questions that
    the points leave open.  Notes keep their numbers over both halves.  An answer that is missing is empty; without notes in the
    second half it is not asked for."""
    number = F.row_number().over(Window.partitionBy(key).orderBy(order))
    sized = notes.withColumns({"_i": number, "_n": F.count("*").over(Window.partitionBy(key))})
    sized = sized.withColumn("_late", F.col("_i") > F.greatest(F.lit(1), F.floor(F.col("_n") / 2)))
    line = F.concat(F.lit("[Part "), F.col("_i").cast("string"), F.lit("]\n"), F.coalesce(F.col(note), F.lit("")))
    parts = F.array_sort(F.collect_list(F.struct("_i", line.alias("t"))))
    counts = question_counts(F.count("*").cast("int"))
    halves = sized.groupBy(key, "_late").agg(F.array_join(F.transform(parts, lambda p: p["t"]), "\n\n---\n\n").alias("notes"), F.format_string("%d to %d points", counts["least"], counts["most"]).alias("many"))

    def answered(prompts: DataFrame, name: str) -> DataFrame:
        return provider.ask(prompts).select(key, F.coalesce("answer", F.lit("")).alias(name))

    task = F.concat(F.lit("Write "), F.col("many"), F.lit(" as #### sections."))
    a = halves.where(~F.col("_late")).select(key, F.concat_ws("\n\n", task, F.col("notes")).alias("prompt"))
    first = written(answered(a, "first"), "article-first")
    heads = F.array_join(F.transform(F.regexp_extract_all("first", F.lit(r"(?m)^####\s+(.+)$"), F.lit(1)), lambda h: F.concat(F.lit("- "), h)), "\n")
    avoid = F.concat(F.lit("Already there, not to be repeated:\n"), F.when(heads != "", heads).otherwise("(none)"))
    b = halves.where("_late").join(first, key).select(key, F.concat_ws("\n\n", task, avoid, F.col("notes")).alias("prompt"))
    both = first.join(answered(b, "second"), key, "left").withColumn("second", F.coalesce("second", F.lit("")))
    both = written(both, "article-points")
    points = F.substring(F.concat_ws("\n\n", F.col("first"), F.when(F.col("second") != "", F.col("second"))), 1, most)
    frame = answered(both.select(key, F.concat_ws("\n\n", F.lit("Write the summary, the quotes and the keywords of this article."), points).alias("prompt")), "frame")
    open_ = answered(both.select(key, F.concat_ws("\n\n", F.lit(f"Ask {asked} questions that these points leave open."), points).alias("prompt")), "questions")
    return both.join(frame, key).join(open_, key)


def speaker_bundle(sources: DataFrame, claims: DataFrame, concepts: DataFrame, shared: DataFrame, by: str = "topic", most_claims: int = 8, most_concepts: int = 5, most_shared: int = 15) -> DataFrame:
    """(by, prompt): the material of a synthesis by speaker.

    sources (by, source_id, title, ord) are numbered in order; claims (by, speaker, claim, description, source_id, ord) and concepts (by, speaker, concept, type,
    description, ord) stand under their speakers, the first of each, speakers in the order in which they come; shared (by, name, type, n_sources, ord) are named last."""
    numbered = sources.withColumn("_no", F.row_number().over(Window.partitionBy(by).orderBy("ord")))

    def listed(rows: DataFrame, line: Column, name: str, joint: str = "\n") -> DataFrame:
        return rows.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", line.alias("t")))), lambda x: x["t"]), joint).alias(name))

    def spoken(rows: DataFrame, line: Column, most: int, name: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(by, "speaker").orderBy("ord"))
        kept = rows.withColumn("_k", place).where(F.col("_k") <= most)
        lines = F.array_sort(F.collect_list(F.struct("_k", line.alias("t"))))
        said = kept.groupBy(by, "speaker").agg(F.min("ord").alias("_at"), F.array_join(F.transform(lines, lambda x: x["t"]), "\n").alias("lines"))
        return listed(said, F.concat(F.lit("**"), F.col("speaker"), F.lit("**\n"), F.col("lines")), name, "\n\n")

    short = lambda c, n: F.substring(F.coalesce(c, F.lit("")), 1, n)
    at = claims.join(numbered.select(by, "source_id", "_no"), [by, "source_id"], "left").withColumn("_ref", F.coalesce(F.col("_no").cast("string"), F.lit("?")))
    told = short("description", 120)
    claim = F.concat(F.lit("- "), F.col("claim"), F.lit(" ["), F.col("_ref"), F.lit("]"), F.when(told != "", F.concat(F.lit("\n  ("), told, F.lit(")"))).otherwise(""))
    meant = short("description", 80)
    concept = F.concat(F.lit("- ["), F.col("type"), F.lit("] "), F.col("concept"), F.when(meant != "", F.concat(F.lit(": "), meant)).otherwise(""))
    common = shared.withColumn("_at", F.row_number().over(Window.partitionBy(by).orderBy("ord"))).where(F.col("_at") <= most_shared)
    parts = [
        listed(numbered.withColumn("_at", F.col("_no")), F.concat(F.lit("["), F.col("_no").cast("string"), F.lit("] "), F.col("title")), "s"), spoken(at, claim, most_claims, "c"), spoken(concepts, concept, most_concepts, "n"),
        listed(common, F.concat(F.lit("- **"), F.col("name"), F.lit("** ["), F.col("type"), F.lit("]: in "), F.col("n_sources").cast("string"), F.lit(" sources")), "e"),
    ]
    made = parts[0]
    for part in parts[1:]:
        made = made.join(part, by, "left")
    said = lambda head, c: F.concat(F.lit(f"## {head}\n"), F.coalesce(c, F.lit("(none)")))
    return made.select(by, F.concat_ws("\n\n", said("Sources", "s"), said("Claims by speaker", "c"), said("Concepts by speaker", "n"), said("In several sources", "e")).alias("prompt"))


def extract_summaries(summaries: DataFrame, provider: ModelProvider, size: int = 6000) -> tuple[DataFrame, DataFrame]:
    """(entities, triples) of summaries (source_id, text, speakers), all sources at once.

    The sections of a summary are asked for entities, a section of more than ``size`` characters in several slices, so that all of the text is
    asked; of each name the surest stays, and the source's speakers are there as persons.  Then they are asked for relations between those names; what an entity's description says of its speaker is a relation too, if it is none
    already.  At last names like a speaker's become that speaker, and generic ones the first.  All tables grow with the sources: each join
    is by exchange, since short names compress so well in files that Spark would send millions of them through the driver.  What is read twice is
    written; the texts are exchanged once, to meet the names found in them."""
    known = summaries.select("source_id", F.posexplode("speakers").alias("ord", "speaker"))
    names = summaries.select("source_id", F.get("speakers", F.lit(0)).alias("first"))
    asked = summaries.where("source_id IS NOT NULL").withColumn("block", speakers_block(F.col("speakers")))
    pieces = splits.heading_chunks(asked, "source_id", size=size, keep=("block",))
    pieces = pieces.select("source_id", "block", "chunk_no", F.posexplode(splits.slices(F.col("chunk"), size)).alias("part", "text"))
    chunks = written(pieces.select("source_id", "block", F.struct("chunk_no", "part").alias("chunk_no"), "text"), "summary-chunks")
    asked = chunks.select("source_id", "chunk_no", F.concat(F.col("block"), F.lit("List the entities of this text as JSON.\n\n"), "text").alias("prompt"))
    answers = provider.ask(asked).select("source_id", "chunk_no", F.col("answer").alias("raw"))
    found = parse.entities(answers, ["source_id", "chunk_no"], types=parse.PODCAST_TYPES, most=None)
    found = written(parse.dedupe_entities(found, ["source_id"], ["chunk_no", "pos"]), "summary-found")
    entities = written(speakers.with_speakers(found, known.select("source_id", "speaker")), "summary-entities")

    line = F.concat(F.lit("- "), F.col("name"), F.lit(" ("), F.col("type"), F.lit(")"))
    listed = entities.groupBy("source_id").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("list"))
    asked = chunks.join(listed.hint("merge"), "source_id").select("source_id", "chunk_no", F.concat(F.lit("List the relations between these entities as JSON.\n"), F.col("list"), F.lit("\n\n"), "text").alias("prompt"))
    answers = provider.ask(asked).select("source_id", "chunk_no", F.col("answer").alias("raw"))
    related = parse.triples(answers, entities, ["source_id", "chunk_no"], ["source_id"], podcast=True)
    related = parse.dedupe_triples(related, ["source_id"], ["chunk_no", "pos"]).select("source_id", "subject", "predicate", "object", "confidence")
    triples = written(related, "summary-related")
    said = speakers.attributed_claims(entities, known)
    same = [F.lower(f"a.{c}") == F.lower(f"b.{c}") for c in ("subject", "predicate", "object")]
    more = said.alias("a").join(triples.alias("b").hint("merge"), [F.col("a.source_id") == F.col("b.source_id"), *same], "left_anti")
    triples = written(triples.unionByName(more.select(*triples.columns)), "summary-triples")

    persons = entities.where("type = 'person'").select("source_id", "name").unionByName(triples.select("source_id", F.col("subject").alias("name")))
    like = normalize.closest(persons.distinct(), known.withColumnRenamed("speaker", "canonical"), by=["source_id"]).join(names.select("source_id", "first").hint("merge"), "source_id")
    to = written(like.select("source_id", "name", F.coalesce(speakers.canonical_speaker(F.col("canonical"), F.col("first")), "canonical").alias("to")).distinct(), "summary-names")
    renamed = entities.join(to.hint("merge"), ["source_id", "name"], "left").withColumn("name", F.when(F.col("type") == "person", F.coalesce("to", "name")).otherwise(F.col("name"))).drop("to")
    told = renamed.join(names.select("source_id", "first").hint("merge"), "source_id")
    told = told.withColumn("description", F.coalesce(speakers.canonical_prefix(F.col("description"), F.col("first")), "description")).drop("first")
    once = parse.dedupe_entities(told, ["source_id"], ["type", "description"])
    subjects = to.withColumnRenamed("name", "subject")
    triples = triples.join(subjects.hint("merge"), ["source_id", "subject"], "left").withColumn("subject", F.coalesce("to", "subject")).drop("to")
    return once, parse.dedupe_triples(triples, ["source_id"], ["confidence"])


def extraction_texts(documents: DataFrame, most_chunks: int = 10) -> DataFrame:
    """(source_id, mode, text) to extract from: a source's summary, else its transcript with speakers, else the first chunks of
    its plain text; sources without any are left out."""
    has = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    text = F.substring("text", 1, 4000 * most_chunks - 200 * (most_chunks - 1))
    chosen = F.when(has("summary"), F.struct(F.lit("summary").alias("mode"), F.col("summary").alias("text"))).when(has("diarised"), F.struct(F.lit("diarised").alias("mode"), F.col("diarised").alias("text"))).when(has("text"), F.struct(F.lit("chunked").alias("mode"), text.alias("text")))
    return documents.select("source_id", chosen.alias("x")).where("x is not null").select("source_id", "x.mode", "x.text")


def synthesis_prompts(mentions: DataFrame, entities: DataFrame, primary: DataFrame, thesis: DataFrame, most: int = 80, others: int = 40) -> DataFrame:
    """(topic, prompt) of theses (topic, thesis): the material of the primary sources, then what other sources hold of the same kinds."""

    def listed(rows: DataFrame, name: str) -> DataFrame:
        line = F.concat(F.lit("- "), F.col("name").cast("string"), F.lit(" ("), F.col("type"), F.lit("): "), F.col("description"))
        once = rows.groupBy("name").agg(F.max("confidence").alias("c"), F.min(line).alias("line"))
        return once.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("c"), "name", "line"))), lambda x: x["line"]), "\n").alias(name))

    own = listed(graph.material(mentions, entities, primary, MATERIAL, most), "own").select(F.coalesce("own", F.lit("")).alias("own")).scalar()
    other = listed(graph.material(mentions, entities, primary, MATERIAL, others, inside=False, least=0.5), "other").select(F.coalesce("other", F.lit("")).alias("other")).scalar()
    return thesis.select("topic", F.concat_ws("\n\n", F.concat(F.lit("Thesis: "), F.col("thesis")), F.concat(F.lit("Material:\n"), own), F.concat(F.lit("From other sources:\n"), other)).alias("prompt"))


def dialectic(thesis: DataFrame, prompts, provider: ModelProvider, loops: int = 2) -> DataFrame:
    """(topic, loop, thesis): each loop asks with the thesis of the one before; an answer that is empty keeps it."""
    out = thesis.select("topic", F.lit(0).alias("loop"), "thesis")
    held = thesis
    for i in range(1, loops + 1):
        answers = provider.ask(prompts(held)).select("topic", F.col("answer").alias("_new"))
        held = held.join(answers, "topic", "left").select("topic", F.when(F.trim(F.coalesce("_new", F.lit(""))) != "", F.col("_new")).otherwise(F.col("thesis")).alias("thesis"))
        out = out.unionByName(held.select("topic", F.lit(i).alias("loop"), "thesis"))
    return out

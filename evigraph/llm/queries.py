"""Queries of the numbered operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.llm import collocations, conversation_trie, hidden_markov, image_copies, language_id, lattice, licenses, mixing, ngram_join, packing, token_counts, toxicity, url_filter
from evigraph.shared import widened


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _part(n: int):
    """crc32 of the key's text (empty for null), modulo n."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % n


#: Target weights of the mixture: domains, languages within each, sources alike.
MIX_WEIGHTS = {"d0": 4, "d1": 3, "d2": 2, "d3": 1, "*/en": 5, "*/de": 2, "*/fr": 2, "*/es": 1}
MIX_SHARE, MIX_EPOCHS, MIX_SEED = 0.8, 4, 17


def with_domain(docs: DataFrame) -> DataFrame:
    """The domain of a source: its number modulo 4."""
    number = F.expr("try_cast(regexp_extract(source, '([0-9]+)$', 1) AS int)")
    return docs.withColumn("domain", F.concat(F.lit("d"), F.pmod(F.coalesce(number, F.lit(0)), F.lit(4)).cast("string")))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_domain(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    docs = mixing.counted(docs, ["doc_id", "domain", "lang", "source"])
    mixed = mixing.mix(docs, ["domain", "lang", "source"], MIX_WEIGHTS, share=MIX_SHARE, max_epochs=MIX_EPOCHS, seed=MIX_SEED)
    return mixed.select("doc_id", "epoch", "domain", "lang", "source", "n_tokens", "taken_tokens")


_OP1_LEVEL = """
{me}_r AS (SELECT *, lim / w AS r FROM {me}_n),
{me}_c AS (SELECT *, coalesce(sum(lim) OVER (PARTITION BY {part} ORDER BY r, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c,
  sum(w) OVER (PARTITION BY {part} ORDER BY r, {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws FROM {me}_r),
{me}_l AS (SELECT *, CASE WHEN ((b - c) / ws) * w <= lim THEN (b - c) / ws END AS l FROM {me}_c),
{me} AS (SELECT *, least(lim, coalesce(max(l) OVER (PARTITION BY {part}) * w, lim)) AS give FROM {me}_l)"""

OP1_SQL = (
    f"""WITH docs AS (SELECT doc_id, text, lang, source,
  'd' || (coalesce(try_cast(regexp_extract(source, '([0-9]+)$', 1) AS INTEGER), 0) % 4) AS domain,
  coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS t FROM documents),
leaf AS (SELECT domain, coalesce(lang, '') AS la, coalesce(source, '') AS so, sum(t)::DOUBLE AS total, sum(t)::DOUBLE * {MIX_EPOCHS} AS lim FROM docs WHERE t > 0 GROUP BY ALL),
a_n AS (SELECT domain, sum(lim) AS lim, CASE domain WHEN 'd0' THEN 4.0::DOUBLE WHEN 'd1' THEN 3 WHEN 'd2' THEN 2 ELSE 1 END AS w,
  (SELECT floor(sum(total) * {MIX_SHARE}::DOUBLE) FROM leaf) AS b FROM leaf GROUP BY domain),"""
    + _OP1_LEVEL.format(me="a", part="1", name="domain")
    + """,
b_n AS (SELECT leaf.domain, la, sum(leaf.lim) AS lim, CASE la WHEN 'en' THEN 5.0::DOUBLE WHEN 'de' THEN 2 WHEN 'fr' THEN 2 ELSE 1 END AS w, any_value(a.give) AS b
  FROM leaf JOIN a ON a.domain = leaf.domain GROUP BY leaf.domain, la),"""
    + _OP1_LEVEL.format(me="b", part="domain", name="la")
    + """,
c_n AS (SELECT leaf.domain, leaf.la, so, leaf.lim, 1.0::DOUBLE AS w, b.give AS b, total FROM leaf JOIN b ON b.domain = leaf.domain AND b.la = leaf.la),"""
    + _OP1_LEVEL.format(me="c", part="domain, la", name="so")
    + f""",
plan AS (SELECT domain, la, so, floor(give + 1e-6)::BIGINT AS take, total::BIGINT AS total, (floor(give + 1e-6)::BIGINT // total::BIGINT) AS whole FROM c),
o AS (SELECT docs.*, whole, take - whole * plan.total AS rest, md5('{MIX_SEED}:' || whole || ':' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM docs JOIN plan ON plan.domain = docs.domain AND plan.la = coalesce(lang, '') AND plan.so = coalesce(source, '') WHERE t > 0 AND take > 0),
s AS (SELECT *, coalesce(sum(t) OVER (PARTITION BY domain, lang, source ORDER BY h, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM o)
SELECT doc_id, unnest(range(0, whole))::INTEGER AS epoch, domain, lang, source, t::BIGINT AS n_tokens, t::BIGINT AS taken_tokens FROM o
UNION ALL SELECT doc_id, whole::INTEGER, domain, lang, source, t::BIGINT, least(t, rest - ahead)::BIGINT FROM s WHERE ahead < rest"""
)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.fit(docs.where(_part(4) != 2))
    told = language_id.predict(docs.select("doc_id", "text"), model)
    return told.select("doc_id", (_part(4) == 2).alias("held_out"), "lang_pred", "score")


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Model:
    """Learned from labelled documents outside the held-out fifth."""
    labels = _table(spark, sf_dir, "labels").where(_part(5) != 0).select("doc_id", "toxic")
    return toxicity.fit(docs, labels)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity_model(spark, docs, sf_dir))
    return scored.select("doc_id", (_part(5) == 0).alias("held_out"), "score", "predicted")


URL_RULES = {
    "org/": "allow",
    "example.org/es/": "block",
    "example.org/en/1": "block",
    "com/fr/": "allow",
    "com/de/": "block",
}


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trees learn from the URLs that a rule labels and judge those that no rule fits."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    url = F.col("url")
    rule = url_filter.rule_for(url_filter.host_of(url), url_filter.path_of(url), URL_RULES)
    verdict_of = F.create_map(*[F.lit(x) for kv in URL_RULES.items() for x in kv])
    model = url_filter.fit(pages.select("url", verdict_of[rule].alias("verdict")))
    judged = url_filter.judge(pages, URL_RULES, model)
    return judged.select("page_id", "host", "path", "rule", "verdict", F.col("block_score"))


SIDE = 80


@cache
def _textures() -> np.ndarray:
    """A smooth random texture for each of 64 components."""
    noise = np.random.default_rng(64).standard_normal((64, SIDE + 16, SIDE + 16))
    for axis in (1, 2):
        for _ in range(3):
            noise = (np.roll(noise, 1, axis) + noise + np.roll(noise, -1, axis)) / 3
    return noise[:, 8:-8, 8:-8].reshape(64, -1)


def render(vector: list[float] | None) -> bytes | None:
    """The tables hold no images: a vector is drawn as a grey image, near vectors as edited copies."""
    if vector is None or len(vector) != 64:
        return None
    x = np.asarray([np.nan if v is None else v for v in vector], dtype=float)
    if not np.isfinite(x).all() or not x.any():
        return None
    field = x @ _textures()
    return image_copies.write_pgm(np.clip(128 + 45 * field / field.std(), 0, 255).astype(np.uint8).reshape(SIDE, SIDE))


def op4_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("binary")
    def draw(vectors: pd.Series) -> pd.Series:
        return pd.Series([render(v) for v in vectors])

    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", draw("embedding").alias("image"))
    return image_copies.image_copies(vectors, "vec_id")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = widened(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    counted = token_counts.over_budget(token_counts.prefix_token_counts(docs, keep_table=False), 2048)
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    return counted.select("doc_id", n_bytes, "n_tokens", "over_limit")


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similarity_components(_table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def with_path(docs: DataFrame) -> DataFrame:
    """Documents have no paths: they are laid out as source/lang/thousand/id.txt, every fortieth as the
    LICENSE file of its folder or, every eightieth, of the folder above."""
    number = F.coalesce(F.col("doc_id"), F.lit(0))
    top = F.concat_ws("/", F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-")))
    folder = F.concat_ws("/", top, F.floor(number / 1000).cast("string"))
    name = F.when(number % 80 == 0, F.concat_ws("/", top, F.lit("LICENSE"))).when(number % 40 == 0, F.concat_ws("/", folder, F.lit("LICENSE")))
    return docs.withColumn("path", F.coalesce(name, F.concat(folder, F.lit("/"), number.cast("string"), F.lit(".txt"))))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = widened(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return licenses.scan(with_path(docs).select("doc_id", "text", "path"))


_NOTICES = ", ".join(f"({i}, '{k}', '{v}')" for i, (k, v) in enumerate(licenses.TEMPLATES))
_TERMS = "regexp_extract_all(lower({}), '" + licenses.WORD + "')"
OP9_SQL = f"""WITH docs AS (SELECT doc_id, text, coalesce(source, '-') || '/' || coalesce(lang, '-') AS top, coalesce(doc_id, 0) AS num FROM documents),
files AS (SELECT doc_id, text, CASE WHEN num % 80 = 0 THEN top ELSE top || '/' || (num // 1000) END AS folder,
  CASE WHEN num % 40 = 0 THEN 'LICENSE' ELSE num || '.txt' END AS name FROM docs),
templates(t, name, notice) AS (VALUES {_NOTICES}),
tw AS (SELECT t, name, word, count(*) AS tf FROM (SELECT t, name, unnest({_TERMS.format("notice")}) AS word FROM templates) GROUP BY ALL),
seen AS (SELECT word, count(*) AS df FROM (SELECT unnest(list_distinct({_TERMS.format("text")})) AS word FROM docs) GROUP BY word),
size AS (SELECT count(*) AS n FROM docs),
idf AS (SELECT word, ln((n + 1) / (coalesce(df, 0) + 1)) + 1 AS idf FROM (SELECT word FROM tw UNION SELECT word FROM seen) LEFT JOIN seen USING (word), size),
tv AS (SELECT t, name, word, tf * idf AS w FROM tw JOIN idf USING (word)),
tn AS (SELECT t, name, word, w / sqrt(sum(w * w) OVER (PARTITION BY t)) AS u FROM tv),
parts AS (SELECT doc_id, 'line' AS kind, string_split(text, chr(10)) AS p FROM files UNION ALL
  SELECT doc_id, 'block', string_split(regexp_replace(text, '{licenses.BLANK}', chr(12) || chr(0), 'g'), chr(12) || chr(0)) FROM files UNION ALL
  SELECT doc_id, 'file', [text] FROM files WHERE name = 'LICENSE'),
units AS (SELECT doc_id, kind, unnest(p) AS unit, generate_subscripts(p, 1) AS no FROM parts),
words AS (SELECT doc_id, kind, no, word, count(*) AS tf FROM (SELECT doc_id, kind, no, unnest({_TERMS.format("unit")}) AS word FROM units) GROUP BY ALL),
uw AS (SELECT doc_id, kind, no, word, tf * idf AS w FROM words JOIN idf USING (word)),
norm AS (SELECT doc_id, kind, no, sqrt(sum(w * w)) AS norm FROM uw GROUP BY ALL),
cosine AS (SELECT doc_id, kind, no, t, name, round(sum(w * u) / any_value(norm), 6) AS score FROM uw JOIN tn USING (word) JOIN norm USING (doc_id, kind, no) GROUP BY ALL),
own AS (SELECT doc_id, score, name, row_number() OVER (PARTITION BY doc_id ORDER BY name = 'proprietary', score DESC, name) AS k FROM cosine WHERE score >= 0.75),
known AS (SELECT files.doc_id, folder, files.name AS file, own.name AS lic, own.score FROM files LEFT JOIN own ON own.doc_id = files.doc_id AND own.k = 1),
grants AS (SELECT folder AS above, lic AS given FROM (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY score DESC, lic DESC) AS k FROM known WHERE file = 'LICENSE' AND lic IS NOT NULL) WHERE k = 1),
reach AS (SELECT f.folder, above, given, row_number() OVER (PARTITION BY f.folder ORDER BY length(above) DESC) AS k
  FROM (SELECT DISTINCT folder FROM known) f JOIN grants ON f.folder = above OR starts_with(f.folder, above || '/'))
SELECT known.doc_id, known.folder || '/' || file AS path, lic AS own_license, score AS own_score, coalesce(lic, given) AS license,
  CASE WHEN lic IS NULL THEN above END AS inherited_from
FROM known LEFT JOIN reach ON reach.folder = known.folder AND reach.k = 1"""


def op10_lattice_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = conversation_trie.numbered(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    return conversation_trie.trie(conversation_trie.with_openings(turns))


#: CRC-32 of a number's decimal digits, bit by bit.
_CRC = """xor(list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT),
  lambda c, d: list_reduce(range(8), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END, xor(c, d)), 4294967295::BIGINT), 4294967295::BIGINT)"""
OP11_SQL = f"""WITH turns AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos FROM conversations WHERE conv_id IS NOT NULL),
sizes AS (SELECT conv_id, count(*) AS size FROM turns GROUP BY conv_id),
plan AS (SELECT sizes.conv_id, sizes.conv_id - sizes.conv_id % 5 AS base, {_CRC.replace("conv_id", "sizes.conv_id")} % 9 AS h FROM sizes),
known AS (SELECT plan.*, least(h, coalesce(size, 0)) AS there FROM plan LEFT JOIN sizes ON sizes.conv_id = base),
built AS (SELECT known.conv_id, pos, role, text FROM known JOIN turns ON turns.conv_id = base AND pos < h
  UNION ALL SELECT known.conv_id, pos - h + there, role, text FROM known JOIN turns ON turns.conv_id = known.conv_id AND pos >= h),
steps AS (SELECT conv_id, pos + 1 AS depth, strlen(text) AS bytes,
  list(sha256(length(role) || ':' || role || text)) OVER (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::VARCHAR AS path FROM built),
members AS (SELECT conv_id, depth, bytes, sha256(path) AS path FROM steps UNION ALL SELECT conv_id, 0, 0, '' FROM sizes),
lengths AS (SELECT conv_id, max(depth) AS len FROM members GROUP BY conv_id),
nodes AS (SELECT depth, path, min(members.conv_id) AS conv, count(*) AS n_convs, any_value(bytes) AS bytes,
  sha256(coalesce(string_agg(members.conv_id::VARCHAR, ',' ORDER BY members.conv_id) FILTER (WHERE depth = len), '')) AS ends FROM members JOIN lengths ON lengths.conv_id = members.conv_id GROUP BY depth, path),
up AS (SELECT n.*, p.path AS parent FROM nodes n LEFT JOIN members p ON p.conv_id = n.conv AND p.depth = n.depth - 1),
kids AS (SELECT depth - 1 AS depth, parent AS path, count(*) AS n_children FROM up WHERE depth > 0 GROUP BY ALL),
full_ AS (SELECT up.*, q.conv AS parent_conv, coalesce(n_children, 0) AS n_children FROM up LEFT JOIN nodes q ON q.depth = up.depth - 1 AND q.path = up.parent
  LEFT JOIN kids ON kids.depth = up.depth AND kids.path = up.path),
sums AS (SELECT a.depth, a.path, sum((n.n_children = 0)::BIGINT)::BIGINT AS n_leaves, sum((n.n_convs - 1) * n.bytes)::BIGINT AS saved
  FROM full_ n JOIN members a ON a.conv_id = n.conv AND a.depth <= n.depth GROUP BY ALL)
SELECT conv AS conv_id, full_.depth, parent_conv AS parent_conv_id, n_convs, n_children, n_leaves, saved AS saved_tokens, ends AS ends_sha256
FROM full_ JOIN sums ON sums.depth = full_.depth AND sums.path = full_.path"""


def op12_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = widened(_table(spark, sf_dir, "documents").select("doc_id", "text", (_part(5) == 1).alias("held_out")))
    known = hidden_markov.vocabulary(docs.where("not held_out"))
    coded = hidden_markov.encode(docs, known, ["doc_id", "held_out"])
    model = hidden_markov.baum_welch(coded.where("not held_out"), known)
    return hidden_markov.score(coded, model, known, ["doc_id", "held_out"])


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(widened(_table(spark, sf_dir, "documents").select("text", "lang")))


OP13_SQL = """WITH docs AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM docs),
words AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
places AS (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM words, range(1, 5) AS sizes(m) WHERE len(w) >= m),
f AS (SELECT lang, m, w[i:i + m - 1] AS p, count(*) AS f FROM places GROUP BY ALL),
sizes AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
longer AS (SELECT lang, m, p, f AS a FROM f WHERE m > 1 AND f >= 30),
cuts AS (SELECT lang, p, a, unnest(range(1, m)) AS k FROM longer),
scored AS (SELECT c.lang, c.p, a, k, h.f AS l, t.f AS r, ((2000000::HUGEINT * a) // (h.f::HUGEINT + t.f))::BIGINT AS score
  FROM cuts c JOIN f h ON h.lang = c.lang AND h.p = c.p[1:k] JOIN f t ON t.lang = c.lang AND t.p = c.p[k + 1:]),
weakest AS (SELECT *, row_number() OVER (PARTITION BY lang, p ORDER BY score, k) AS turn FROM scored),
inside AS (SELECT lang, p, a, m, s, unnest(range(1, m - s + 2)) AS i FROM longer, range(2, 4) AS parts(s) WHERE s < m),
over AS (SELECT lang, p[i:i + s - 1] AS p, max(a) AS most FROM inside GROUP BY ALL),
kept AS (SELECT weakest.lang, array_to_string(weakest.p, ' ') AS phrase, a, l, r, score FROM weakest
  LEFT JOIN over ON over.lang = weakest.lang AND over.p = weakest.p WHERE turn = 1 AND (most IS NULL OR 100::HUGEINT * most < 80::HUGEINT * a)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT ranked.lang, rank, phrase, a, l, r, n, score FROM ranked JOIN sizes ON sizes.lang = ranked.lang WHERE rank <= 2000"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: v for k, v in globals().items() if k.startswith("op") and k[2:3].isdigit()}
    return dict(sorted(found.items(), key=lambda kv: int(kv[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": OP1_SQL, "op9_license_scan": OP9_SQL, "op11_conversation_trie": OP11_SQL, "op13_collocations": OP13_SQL}

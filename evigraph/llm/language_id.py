"""Language identification by multinomial naive Bayes over hashed character n-grams (operator 2).

Counts of hashed 1- to 3-grams per language are gathered by Spark from a bounded sample of labelled rows
(``rows_per_lang`` for each language, drawn by key hash) and smoothed into a matrix of log-probabilities of
fixed size (buckets x languages), which is broadcast.  Batches of texts are scored in numpy: the n-grams
of a batch pick their rows of the matrix, and the rows of each text are added up.  Every whole text is
read, in windows of bounded size.

Rows: null text and text without a letter give ``und`` with score 0; rows whose label is null teach
nothing; without any labelled row every text is ``und``; repeated rows are scored each; extra columns
pass through, and one that bears a result's name is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.llm._store import spare

UNKNOWN = "und"
ORDERS = (1, 2, 3)
#: Characters whose n-grams are held at a time.
WINDOW = 1 << 19
#: What is no letter among the first 128 characters counts as a blank.
_BLANKED = np.array([c if chr(c).isalpha() else 32 for c in range(128)], dtype=np.uint32)


def _codes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.where(codes < 128, _BLANKED[np.minimum(codes, 127)], codes)


def _hashed(codes: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """Buckets of the n-grams of each order, one for each place where one begins."""
    shift = np.uint32(32 - bits)
    h = np.zeros(len(codes), dtype=np.uint32)
    for n in range(1, max(ORDERS) + 1):
        if len(codes) < n:
            return
        h = (h[: len(codes) - n + 1] ^ codes[n - 1 :]) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        if n in ORDERS:
            yield (h * np.uint32(0x85EBCA77)) >> shift


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def windows(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text number of each character, its code), at most about WINDOW characters at a time.  Texts are
    set apart by two blanks that belong to no text (number -1); a long text goes on in the next window,
    which repeats its last two characters as borders."""
    size, rows, parts = 0, [], []
    border = np.full(2, 32, dtype=np.uint32)

    def flush():
        return np.concatenate(rows), np.concatenate(parts)

    for i, text in enumerate(texts):
        codes = _codes(text) if text else np.empty(0, dtype=np.uint32)
        for a in range(0, len(codes), WINDOW):
            part = codes[a : a + WINDOW + 2]  # n-grams that begin in this window reach into the next
            own = min(WINDOW, len(codes) - a)
            rows += [np.full(own, i), np.full(len(part) - own + 2, -1)]
            parts += [part, border]
            size += own
            if size >= WINDOW:
                yield flush()
                size, rows, parts = 0, [], []
    if parts:
        yield flush()


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # log-probabilities, buckets x languages
    prior: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and its posterior probability for each whole text."""
        n, bits = len(texts), int(np.log2(len(self.table)))
        total = np.tile(self.prior, (n, 1))
        for owner, codes in windows(texts):
            for h in _hashed(codes, bits):
                at = owner[: len(h)]
                starts = np.flatnonzero(np.diff(at, prepend=-2))
                sums = np.add.reduceat(self.table[h], starts, axis=0, dtype=np.float64)
                of = at[starts]
                np.add.at(total, of[of >= 0], sums[of >= 0])
        if not self.langs:
            return [UNKNOWN] * n, np.zeros(n)
        p = np.exp(total - total.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        known = [has_letter(t) for t in texts]
        return [self.langs[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], np.where(known, p[np.arange(n), best], 0.0)


def _count(batches: Iterator[pd.DataFrame], bits: int) -> Iterator[pd.DataFrame]:
    """Counts of each (language, bucket) in a task's rows."""
    found: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, texts in batch.groupby("_lang")["_text"]:
            mine = found.setdefault(lang, np.zeros(1 << bits, dtype=np.int64))
            for owner, codes in windows([t if isinstance(t, str) else None for t in texts]):
                for h in _hashed(codes, bits):
                    mine += np.bincount(h[owner[: len(h)] >= 0], minlength=1 << bits)
    for lang, counts in found.items():
        at = np.flatnonzero(counts)
        yield pd.DataFrame({"_lang": lang, "_bucket": at, "_n": counts[at]})

#: Languages that a model tells apart at most.
MOST_LANGS = 256


def fit(
    labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
    bits: int = 15, rows_per_lang: int = 4000, smooth: float = 0.5, tasks: int = 8,
) -> Model:
    """Learn from about ``rows_per_lang`` different rows of each language at most.  Rows that repeat key and text are
    drawn once; nothing of the sample's texts goes to the driver, only the counts."""
    rows = labelled.where(F.col(lang).isNotNull()).select(F.col(key).alias("_k"), F.col(lang).alias("_lang"), F.col(text).alias("_text"))
    sizes = {r[0]: r[1] for r in rows.groupBy("_lang").count().limit(MOST_LANGS + 1).collect()}
    if len(sizes) > MOST_LANGS:  # the broadcast table has a column for each
        raise ValueError(f"more than {MOST_LANGS} values of {lang}: clean the labels first")
    if not sizes:
        return Model([], np.zeros((1 << bits, 1), dtype=np.float32), np.zeros(1))
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, rows_per_lang / n))])
    drawn = F.pmod(F.xxhash64(F.lit(5), "_k", "_text"), F.lit(1 << 30)) < share[F.col("_lang")] * (1 << 30)
    sample = rows.where(drawn).distinct().select("_lang", "_text").repartition(tasks)
    counted = sample.mapInPandas(lambda it: _count(it, bits), "_lang string, _bucket long, _n long")
    langs = sorted(sizes)
    counts = np.full((1 << bits, len(langs)), smooth)
    for name, bucket, n in counted.groupBy("_lang", "_bucket").agg(F.sum("_n")).toPandas().itertuples(index=False):
        counts[bucket, langs.index(name)] += n
    table = np.log(counts / counts.sum(axis=0))
    prior = np.log(np.array([sizes[x] for x in langs], dtype=float) / sum(sizes.values()))
    return Model(langs, table.astype(np.float32), prior)


def predict(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``df`` with ``lang_pred`` and ``score``; one pass, no shuffle.  The scoring is marked as not to be repeated, so
    that a filter on its result does not make Spark score each text twice."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def tell(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            lang, p = shared.value.predict([t if isinstance(t, str) else None for t in texts])
            yield pd.DataFrame({"lang": lang, "score": p})

    told = spare(df, "told")
    made = df.withColumn(told, tell.asNondeterministic()(F.col(text)))
    return made.withColumn("lang_pred", F.col(f"{told}.lang")).withColumn("score", F.col(f"{told}.score")).drop(told)

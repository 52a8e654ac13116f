"""Toxicity by subword-bag embeddings under a linear softmax (operator 7).

A word is the sum of the vectors of its character n-grams (with word borders) and of the word itself,
all from one hashed table; a text is the average of its words; a linear softmax over that average gives
the score.  Table and softmax are trained jointly in numpy.  A misspelling that was never seen shares most n-grams with
the word it stands for, and so its vector.

Training reads a bounded sample of labelled rows (``train_rows`` and ``train_bytes``, chosen by a hash of the key, a
quarter of it at most from the label 1); scoring covers every whole text: since the softmax is linear, a word adds a
fixed amount to the text's logit, which workers keep per word.

Rows: null, empty and wordless texts score the bias alone; rows without a label are not learned from;
null labels and labels other than 0 and 1 are left out; without both labels in the sample the score is
the smoothed rate of label 1 (0.5 with no label at all); repeated rows are scored each; extra columns
pass through, and one that bears a result's name is replaced.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.llm._worker import ENTRY, Memo

_WORD = re.compile(r"[^\W_]+")
ORDERS = (3, 4, 5)
#: Zero words that each average takes in, so that a few words do not decide a short text by chance.
PAD = 16
#: Bytes of the words' amounts that a worker keeps; beyond it the memo starts anew.
MEMO_BYTES = 32 << 20
#: Words whose n-grams are made at a time.
WORDS_AT_ONCE = 20_000


def words_of(text: str | None) -> list[str]:
    """The words (runs of letters, lower case) of a whole text."""
    return _WORD.findall(text.lower()) if text else []


def subwords(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of many words at once: the features, and where each word's begin."""
    if not words:
        return np.empty(0, dtype=np.int64), np.zeros(1, dtype=np.int64)
    marked = [f"<{w}>" for w in words]
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, marked), dtype=np.int64, count=len(marked))
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(words)), sizes)
    left = ends[owner] - np.arange(len(codes))  # characters from here to the word's end
    parts = [np.fromiter((zlib.crc32(m.encode("utf-8", "surrogatepass")) for m in marked), dtype=np.uint64, count=len(words)) % np.uint64(buckets)]
    owners = [np.arange(len(words))]
    rolled = codes.copy()
    for n in range(2, max(ORDERS) + 1):
        rolled = rolled[:-1] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 :]
        if not len(rolled):
            break
        if n in ORDERS:
            ok = np.flatnonzero(left[: len(rolled)] >= n)
            h = rolled[ok] ^ (rolled[ok] >> np.uint64(29))
            h = (h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(20)
            parts.append(h % np.uint64(buckets))
            owners.append(owner[ok])
    owner, features = np.concatenate(owners), np.concatenate(parts).astype(np.int64)
    order = np.argsort(owner, kind="stable")
    return features[order].astype(np.int32), np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(words)))])


def _sums(table: np.ndarray, picks: np.ndarray, starts: np.ndarray, step: int = 200_000, weight: np.ndarray | None = None) -> np.ndarray:
    """Sums of table rows over the segments of ``picks`` that begin at ``starts`` (the last entry is the
    end), a bounded number of segments at a time."""
    out = np.zeros((len(starts) - 1, table.shape[1]), dtype=np.float32)
    for a in range(0, len(out), step):
        b = min(a + step, len(out))
        low, high = starts[a], starts[b]
        if high > low:
            rows = table[picks[low:high]]
            if weight is not None:
                rows = rows * weight[low:high, None]
            full = np.flatnonzero(np.diff(starts[a : b + 1]))
            out[a + full] = np.add.reduceat(rows, starts[a:b][full] - low, axis=0)
    return out


@dataclass
class Model:
    """The n-gram table, the softmax (one row per label) and its bias."""

    table: np.ndarray
    softmax: np.ndarray
    bias: np.ndarray
    known: Memo = field(default_factory=lambda: Memo(MEMO_BYTES), repr=False)  # (amount, words) of a token as one complex number

    def __getstate__(self):
        return {"table": self.table, "softmax": self.softmax, "bias": self.bias, "known": Memo(MEMO_BYTES)}

    def learn(self, tokens: set[str]) -> None:
        """Amounts of tokens between blanks: the sum over their words, and how many words they hold."""
        self.known.room(sum(map(len, tokens)) + ENTRY * len(tokens))
        tokens = list(tokens)
        split = [_WORD.findall(t) for t in tokens]
        words = list({w for ws in split for w in ws})
        line = (self.table @ (self.softmax[1] - self.softmax[0])).astype(np.float32)[:, None]
        amount: dict[str, float] = {}
        for a in range(0, len(words), WORDS_AT_ONCE):
            part = words[a : a + WORDS_AT_ONCE]
            amount.update(zip(part, _sums(line, *subwords(part, len(self.table)))[:, 0].tolist(), strict=True))
        for t, ws in zip(tokens, split, strict=True):
            self.known[t] = complex(sum(amount[w] for w in ws), len(ws))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Probability of label 1 of each whole text."""
        bias, out = float(self.bias[1] - self.bias[0]), np.empty(len(texts))
        for a in range(0, len(texts), 64):
            split = [t.lower().split() if t else [] for t in texts[a : a + 64]]
            new = {t for tokens in split for t in tokens if t not in self.known}
            if new:
                self.learn(new)
                if any(t not in self.known for tokens in split for t in tokens):  # the memo was emptied
                    self.learn({t for tokens in split for t in tokens})
            for i, tokens in enumerate(split, a):
                got = sum(map(self.known.__getitem__, tokens), 0j)
                out[i] = got.real / (got.imag + PAD) + bias
        return 1 / (1 + np.exp(-np.clip(out, -50, 50)))


def train(
    texts: list[str | None], labels: np.ndarray, buckets: int = 1 << 16, dims: int = 4,
    rounds: int = 60, rate: float = 0.5, floor: float = 0.05, decay: float = 0.02, seed: int = 7,
) -> Model:
    """Fit table and softmax jointly (Adam over all rows)."""
    rng = np.random.default_rng(seed)
    table = (rng.random((buckets, dims), dtype=np.float32) - 0.5) / dims
    softmax = np.zeros((2, dims), dtype=np.float32)
    softmax[1] = (rng.random(dims, dtype=np.float32) - 0.5) / dims
    labels = np.asarray(labels, dtype=np.int64)
    share = np.bincount(labels, minlength=2)
    bias = np.log((share + 1) / (share.sum() + 2)).astype(np.float32)
    if min(share) == 0:
        return Model(np.zeros_like(table), np.zeros_like(softmax), bias)
    # Texts as bags of words, words as bags of n-grams; each bag also the other way round for gradients.
    ids: dict[str, int] = {}
    bags = []
    for t in texts:
        bags.append(np.unique(np.fromiter((ids.setdefault(w, len(ids)) for w in words_of(t)), dtype=np.int64), return_counts=True))
    word = np.concatenate([b[0] for b in bags])
    text_start = np.concatenate([[0], np.cumsum([len(b[0]) for b in bags])])
    owner = np.repeat(np.arange(len(bags)), np.diff(text_start))
    weight = np.concatenate([b[1] / (PAD + b[1].sum()) for b in bags]).astype(np.float32)
    back = np.argsort(word, kind="stable")
    word_start = np.concatenate([[0], np.cumsum(np.bincount(word, minlength=len(ids)))])
    names = list(ids)
    parts = [subwords(names[a : a + WORDS_AT_ONCE], buckets) for a in range(0, len(names), WORDS_AT_ONCE)]
    features = np.concatenate([x[0] for x in parts]) if parts else np.empty(0, dtype=np.int32)
    sizes = np.concatenate([np.diff(x[1]) for x in parts]) if parts else np.empty(0, dtype=np.int64)
    feature_start = np.concatenate([[0], np.cumsum(sizes)])
    feature_owner = np.repeat(np.arange(len(ids), dtype=np.int32), sizes)
    del parts
    turn = np.argsort(features, kind="stable")
    turned = feature_owner[turn]
    del turn, feature_owner
    bucket_start = np.concatenate([[0], np.cumsum(np.bincount(features, minlength=buckets))])
    each = np.full(len(labels), 1 / len(labels), dtype=np.float32)
    params = [table, softmax, bias]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    for t in range(1, rounds + 1):
        vectors = _sums(table, features, feature_start)
        means = _sums(vectors, word, text_start, weight=weight)
        logits = means @ softmax.T + bias
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(labels)), labels] -= 1
        p *= each[:, None]
        to_words = _sums((p @ softmax).astype(np.float32), owner[back], word_start, weight=weight[back])
        grads = [_sums(to_words, turned, bucket_start) + decay * table / buckets, p.T @ means + decay * softmax, p.sum(axis=0)]
        for x, g, (m, v) in zip(params, grads, moments, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            # Steps of rare n-grams stay in proportion to their small gradients: they carry no evidence.
            size = np.sqrt(v / (1 - 0.99**t))
            x -= (rate * (m / (1 - 0.9**t)) / (size + floor * size.max() + 1e-12)).astype(np.float32)
    return Model(table, softmax, bias)


def calibrated(texts: list[str | None], labels: np.ndarray, **options) -> Model:
    """Train on four fifths of the rows and move the bias so that a score of 0.5 gives the best F1 on the fifth
    that was not trained on (every fifth row of each label).  Too few rows for that are all trained on."""
    labels = np.asarray(labels, dtype=np.int64)
    place = np.zeros(len(labels), dtype=np.int64)
    for y in (0, 1):
        place[labels == y] = np.arange((labels == y).sum())
    held = place % 5 == 4
    if min(np.bincount(labels[held], minlength=2)) < 5:
        return train(texts, labels, **options)
    model = train([t for t, h in zip(texts, held, strict=True) if not h], labels[~held], **options)
    p = np.clip(model.scores([t for t, h in zip(texts, held, strict=True) if h]), 1e-12, 1 - 1e-12)
    order = np.argsort(-p)
    logit, hit = np.log(p / (1 - p))[order], labels[held][order]
    f1 = 2 * np.cumsum(hit) / (np.arange(1, len(hit) + 1) + hit.sum())
    best = int(f1.argmax())
    model.bias[1] -= (logit[best] + logit[min(best + 1, len(logit) - 1)]) / 2
    return model


def fit(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", train_rows: int = 3600,
    train_bytes: int = 96 << 20, **options,
) -> Model:
    """Train on at most ``train_rows`` labelled keys, a quarter of them of label 1 at most, drawn by key hash.

    The draw reads ``labels`` alone: equal rows count once, and a limit after the hash order bounds the list of keys, which is
    broadcast to the documents.  Of the documents with a drawn key sizes and hashes are looked at first, equal texts of a key
    once; in hash order each that still fits into ``train_bytes`` of text is taken (one that doesn't is passed over, not the end), and only
    their texts go to the driver.  A label of which no row fits is an error."""
    rows = labels.where(F.col(label).isin(0, 1)).select(F.col(key).alias("_k"), F.col(label).cast("int").alias("_y")).where("_k is not null").distinct()
    turn = F.xxhash64(F.lit(11), "_k")
    drawn = [rows.where(F.col("_y") == y).orderBy(turn, "_k").limit(most) for y, most in ((0, train_rows - train_rows // 4), (1, train_rows // 4))]
    texts = docs.select(F.col(key).alias("_k"), F.col(text).alias("_t")).join(F.broadcast(drawn[0].unionByName(drawn[1])), "_k")
    shape = [F.coalesce(F.octet_length("_t"), F.lit(0)).alias("_n"), F.xxhash64("_t").alias("_h")]
    found = texts.select("_k", "_y", *shape).distinct().orderBy(turn, "_k", "_y", "_h").limit(2 * train_rows).toPandas()
    room, fits = train_bytes, []
    for size in found["_n"]:
        fits.append(size <= room)
        room -= size if fits[-1] else 0
    taken = found[np.array(fits, dtype=bool)]
    if lost := set(found["_y"]) - set(taken["_y"]):
        raise ValueError(f"no text of label {min(lost)} fits into train_bytes = {train_bytes}")
    chosen = docs.sparkSession.createDataFrame(taken[["_k", "_y", "_h"]], texts.select("_k", "_y", shape[1]).schema) if len(taken) else None
    if chosen is None:
        return calibrated([], np.array([], dtype=np.int64), **options)
    texts = docs.select(F.col(key).alias("_k"), F.col(text).alias("_t")).withColumn("_h", F.xxhash64("_t"))
    sample = texts.join(F.broadcast(chosen), ["_k", "_h"]).select("_k", "_y", "_t", "_h").distinct().toPandas().sort_values(["_k", "_y", "_h"], kind="stable")
    return calibrated(list(sample["_t"].where(sample["_t"].notna(), None)), sample["_y"].to_numpy(dtype=np.int64), **options)


def score(df: DataFrame, model: Model, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """``df`` with ``score`` (double, 0 to 1) and ``predicted`` (int: score at or over ``threshold``).

    One pass, no shuffle; the broadcast model has a fixed size (buckets x dims).  A filter on the score does not make
    Spark score a text twice."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def rate(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = shared.value
        try:
            for texts in batches:
                yield pd.Series(known.scores([t if isinstance(t, str) else None for t in texts]))
        finally:
            known.known.clear()

    return df.withColumn("score", rate.asNondeterministic()(F.col(text))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))

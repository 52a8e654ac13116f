"""URL filter: rules, and gradient-boosted trees on lexical features where no rule fits (operator 3).

Rules ``host/path-prefix`` with a verdict are matched by SQL functions; the longest that fits decides.  The
others are decided by boosted trees over length, depth, digit ratio, entropy, parameter counts and
statistics of suffixes (how often labelled URLs with this top-level domain, this registered name, this
first folder, this file ending are blocked).  Trees and statistics are trained in numpy from labelled
URLs, a bounded sample of them (``train_rows``, first in hash order); every URL is judged.

Rows: a null URL, or one without ``://``, has an empty host and path, fits no rule and is scored on what
characters it has; without labelled URLs of both verdicts the verdict is the commoner one (allow if
there are none); repeated rows are judged each; an empty table gives an empty result; other columns pass
through, and one that bears a result's name is replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Longer URLs are judged, but not learned from.
MOST_CHARS = 8192
_SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _SPLIT, 1), ascii_uppercase, ascii_lowercase)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), _SPLIT, 2)


def rule_for(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest of a (short, literal) rule list that fits, or null.  A rule fits its host and every
    subdomain, if the path starts with the rule's."""
    fits = []
    for rule in sorted(rules, key=lambda r: (-len(r), r)):
        name, slash, rest = rule.partition("/")
        here = (host == name) | F.endswith(host, F.lit("." + name))
        fits.append(F.when(here & F.startswith(path, F.lit(slash + rest)), F.lit(rule)))
    return F.coalesce(*fits, F.lit(None).cast("string"))


# --- Features ---------------------------------------------------------------------------------------------


def _parts(url: str) -> tuple[str, str, str]:
    rest = url.partition("://")[2].partition("#")[0]
    place, _, query = rest.partition("?")
    host, slash, path = place.partition("/")
    return host.lower(), slash + path, query


def suffixes(url: str | None) -> list[str]:
    """What a URL's statistics hang on: top-level domain, registered name, first folder, file ending."""
    host, path, _ = _parts(url or "")
    labels, folders = host.split("."), path.split("/")
    last = folders[-1]
    return [
        "top:" + labels[-1],
        "name:" + ".".join(labels[-3:-1] if len(labels) > 2 else labels[:1]),
        "folder:" + (folders[1] if len(folders) > 2 else ""),
        "ending:" + (last.rpartition(".")[2] if "." in last else ""),
    ]


def lexical(url: str | None) -> list[float]:
    """Lengths, depth, digit ratios, entropy and counts of a URL."""
    url = url or ""
    host, path, query = _parts(url)
    counts = np.array(list(Counter(url).values()), dtype=float)
    share = counts / max(1.0, counts.sum())
    digits = sum(map(str.isdigit, url))
    return [
        len(url), len(host), len(path), path.count("/"), host.count("."), url.count("-"), digits / max(1, len(url)),
        sum(map(str.isdigit, host)), float(-(share * np.log2(share)).sum()) if len(share) else 0.0,
        query.count("=") if query else 0, query.count("&"), float("#" in url), float(url.startswith("https")),
    ]


# --- Trees --------------------------------------------------------------------------------------------------


@dataclass
class Trees:
    """Boosted trees of fixed depth over binned features, with the suffixes' block rates."""

    base: float
    edges: list[np.ndarray] = field(default_factory=list)  # bin borders of each feature
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)  # feature, bin, leaf
    rates: dict[str, float] = field(default_factory=dict)
    depth: int = 3

    def features(self, urls: list[str | None]) -> np.ndarray:
        prior = 1 / (1 + np.exp(-self.base))
        return np.array([lexical(u) + [self.rates.get(s, prior) for s in suffixes(u)] for u in urls], dtype=float).reshape(len(urls), -1)

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, i], side="left") for i, e in enumerate(self.edges)], axis=1)

    def _leaf(self, bins: np.ndarray, feature: np.ndarray, border: np.ndarray) -> np.ndarray:
        at, rows = np.zeros(len(bins), dtype=np.int64), np.arange(len(bins))
        for level in range(self.depth):
            node = (1 << level) - 1 + at
            at = 2 * at + (bins[rows, feature[node]] > border[node])
        return at

    def score(self, urls: list[str | None]) -> np.ndarray:
        """Probability of block."""
        total = np.full(len(urls), self.base)
        if self.trees and urls:
            bins = self.binned(self.features(urls))
            for feature, border, leaf in self.trees:
                total += leaf[self._leaf(bins, feature, border)]
        return 1 / (1 + np.exp(-total))


def train(urls: list[str | None], blocked: np.ndarray, rounds: int = 40, rate: float = 0.2, bins: int = 32, depth: int = 3, ridge: float = 1.0) -> Trees:
    """Second-order boosting of the logistic loss on histograms of binned features."""
    y = np.asarray(blocked, dtype=float)
    if not len(y):
        return Trees(-50.0)
    share = (y.sum() + 0.5) / (len(y) + 1)
    model = Trees(float(np.log(share / (1 - share))), depth=depth)
    if y.min() == y.max():
        return model
    seen: dict[str, list[float]] = {}
    for u, b in zip(urls, y, strict=True):
        for s in suffixes(u):
            got = seen.setdefault(s, [0.0, 0.0])
            got[0] += b
            got[1] += 1
    model.rates = {s: (b + 5 * share) / (n + 5) for s, (b, n) in seen.items()}
    x = model.features(urls)
    model.edges = [np.unique(np.quantile(col, np.linspace(0, 1, bins + 1)[1:-1])) for col in x.T]
    binned, width = model.binned(x), bins + 1
    total = np.full(len(y), model.base)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-total))
        grad, curve = y - p, p * (1 - p)
        feature, border = np.zeros((1 << depth) - 1, dtype=np.int64), np.full((1 << depth) - 1, width, dtype=np.int64)
        at = np.zeros(len(y), dtype=np.int64)
        for level in range(depth):
            n = 1 << level
            best = np.full(n, 1e-9)
            for f in range(x.shape[1]):
                where = at * width + binned[:, f]
                g, h = (np.bincount(where, weights=w, minlength=n * width).reshape(n, width).cumsum(axis=1) for w in (grad, curve))
                gain = g**2 / (h + ridge) + (g[:, -1:] - g) ** 2 / (h[:, -1:] - h + ridge) - g[:, -1:] ** 2 / (h[:, -1:] + ridge)
                pick = gain.argmax(axis=1)
                better = np.flatnonzero(gain[np.arange(n), pick] > best)
                best[better] = gain[better, pick[better]]
                feature[n - 1 + better], border[n - 1 + better] = f, pick[better]
            node = n - 1 + at
            at = 2 * at + (binned[np.arange(len(y)), feature[node]] > border[node])
        g, h = (np.bincount(at, weights=w, minlength=1 << depth) for w in (grad, curve))
        leaf = rate * g / (h + ridge)
        model.trees.append((feature, border, leaf))
        total += leaf[at]
    return model


def fit(labelled: DataFrame, url: str = "url", verdict: str = "verdict", train_rows: int = 20_000, **options) -> Trees:
    """Train on at most ``train_rows`` labelled rows (verdict ``block`` or ``allow``), those first in the order of a hash.
    Equal rows count once, and a limit bounds what goes to the driver however often a URL is repeated."""
    rows = labelled.where(F.col(verdict).isin("block", "allow") & F.col(url).isNotNull()).select(F.col(url).alias("url"), (F.col(verdict) == "block").alias("blocked"))
    turn = F.xxhash64(F.lit(3), "url")
    different = rows.agg(F.approx_count_distinct("url")).first()[0]
    near = F.pmod(turn, F.lit(1 << 20)) <= (1 << 20) * min(1.0, 2 * train_rows / max(1, different))  # spares the others the exchange
    turn = F.pmod(turn, F.lit(1 << 20))
    sample = rows.where(near & (F.length("url") <= MOST_CHARS)).distinct().orderBy(turn, "url", "blocked").limit(train_rows).toPandas().sort_values(["url", "blocked"])
    return train(list(sample["url"]), sample["blocked"].to_numpy(dtype=float), **options)


def judge(df: DataFrame, rules: dict[str, str], model: Trees, url: str = "url", threshold: float = 0.5) -> DataFrame:
    """``df`` with ``host``, ``path``, ``rule``, ``block_score`` and ``verdict``; one pass, no shuffle."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def rate(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for urls in batches:
            yield pd.Series(shared.value.score([u if isinstance(u, str) else None for u in urls]))

    verdict_of = F.create_map(*[F.lit(x) for kv in rules.items() for x in kv])
    return (
        df.withColumn("host", host_of(F.col(url)))
        .withColumn("path", path_of(F.col(url)))
        .withColumn("rule", rule_for(F.col("host"), F.col("path"), rules))
        .withColumn("block_score", rate.asNondeterministic()(F.col(url)))
        .withColumn("verdict", F.coalesce(verdict_of[F.col("rule")], F.when(F.col("block_score") >= threshold, F.lit("block")).otherwise(F.lit("allow"))))
    )

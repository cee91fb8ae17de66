"""Quality and toxicity by a document classifier within hierarchical empirical Bayes.

A logistic model over hashed words, the beginnings of words and how often they
occur, and a few shape measures gives each document its own evidence. The sums of that evidence by host and by path (one grouped
aggregation of numbers, no text) are shrunk: a host's mean towards the global
mean, a path's towards its host's, each as strongly as the spread between hosts
(or paths) tells by the method of moments, so that sparse sites stay near the
prior. A document's log-odds are then shifted by what its path, without the
document itself, says against the global mean.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qualispark.llm.common import arrow_map, written

#: Labelled documents that the model is fitted on at most, by a hash of their ids.
FIT_ROWS = 6000
BUCKETS = 1 << 17
#: Documents of the fit in which a word must occur to count.
LEAST_DOCS = 5
#: Standard errors by which a word's share must differ between the classes.
LEAST_Z = 4.0
THRESHOLD = 0.5
#: Bounds of the prior strength in documents.
STRENGTH = (5.0, 10_000.0)
TARGETS = ("quality", "toxic")
N_SHAPES = 6

#: Characters of word beginnings that count as features, beside whole words.
STEMS = (3, 4, 5, 6)
#: Shares of a text's words from which a beginning counts again, if two words at least have it.
SHARES = (0.005, 0.01, 0.02)
N_FEATURES = BUCKETS * (1 + len(SHARES))

_EDGE = re.compile(rb"^[\x00-/:-@\[-`{-\x7f]+|[\x00-/:-@\[-`{-\x7f]+$")
_seen: dict[bytes, tuple[int, ...]] = {}


def _word_buckets(word: bytes) -> tuple[int, ...]:
    """The bucket of a word and those of its beginnings; -1 where there is none."""
    if len(_seen) > 200_000:
        _seen.clear()
    found = _seen.get(word)
    if found is None:
        plain = _EDGE.sub(b"", word).decode("utf-8", "ignore").lower()
        own = xxhash.xxh64_intdigest(plain, 7) % BUCKETS if plain else -1
        stems = (xxhash.xxh64_intdigest(plain[:k], 7 + k) % BUCKETS if len(plain) > k else -1 for k in STEMS)
        found = _seen[word] = (own, *stems)
    return found


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The distinct features of words and their beginnings, and the shape measures, of a whole text."""
    words = text.lower().split()
    n, chars = max(1, len(words)), max(1, len(text))
    flat = np.fromiter(chain.from_iterable(map(_word_buckets, words)), np.int64).reshape(-1, 1 + len(STEMS))
    own, (stems, counts) = np.unique(flat[:, 0]), np.unique(flat[:, 1:], return_counts=True)
    own, counts, stems = own[own >= 0], counts[stems >= 0], stems[stems >= 0]
    levels = [stems[(counts >= 2) & (counts >= share * n)] + (i + 1) * BUCKETS for i, share in enumerate(SHARES)]
    found = np.unique(np.concatenate([own, stems, *levels]))
    codes = np.bincount(np.frombuffer(text, np.uint8), minlength=128)[:128]
    upper, lower = codes[65:91].sum(), codes[97:123].sum()
    symbols = codes[[33, 35, 36, 37, 38, 42, 60, 62, 64, 94, 124, 126]].sum()
    shapes = np.array(
        [
            upper / max(1, upper + lower),
            min(2.0, symbols / n),
            codes[48:58].sum() / chars,
            len(own) / n,
            min(2.0, np.log10(n) / 4),
            1.0,
        ]
    )
    return found, shapes


def _features_of(labelled: DataFrame) -> DataFrame:
    def rows(batches):
        for b in batches:
            raw = b.column(0).cast(pa.binary()).to_pylist()
            found = [features(t or b"") for t in raw]
            yield {
                "buckets": [x.astype("<i4").tobytes() for x, _ in found],
                "shapes": [s.tolist() for _, s in found],
                "quality": b.column(1),
                "toxic": b.column(2),
            }

    return arrow_map(labelled, rows, "buckets binary, shapes array<double>, quality int, toxic int")


class Model:
    """Weights of the words and shapes for each target: a table of fixed size."""

    def __init__(self, words: np.ndarray, shapes: np.ndarray):
        self.words, self.shapes = words, shapes

    def logits(self, buckets: np.ndarray, shapes: np.ndarray) -> np.ndarray:
        return self.words[buckets].sum(axis=0) + shapes @ self.shapes


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Logistic regression on at most ``fit_rows`` labelled documents.

    Labels with a null are left out; of several labels of an id the least
    counts, and of several texts of an id the least.
    """
    both = labels.filter("doc_id is not null and quality is not null and toxic is not null")
    one = both.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("toxic").alias("toxic"))
    chosen = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    labelled = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality", "toxic").agg(F.min("text").alias("text"))
    rows = _features_of(labelled.select("text", "quality", "toxic")).collect()
    words, shapes = np.zeros((N_FEATURES, len(TARGETS))), np.zeros((N_SHAPES, len(TARGETS)))
    if not rows:
        return Model(words, shapes)
    lists = [np.frombuffer(r["buckets"], "<i4") for r in rows]
    column = np.concatenate(lists)
    row = np.repeat(np.arange(len(rows)), [len(x) for x in lists])
    often = np.bincount(column, minlength=N_FEATURES) >= LEAST_DOCS
    row, column = row[often[column]], column[often[column]]
    used, column = np.unique(column, return_inverse=True)
    dense = np.array([r["shapes"] for r in rows])
    for k, target in enumerate(TARGETS):
        y = np.array([float(r[target] > 0) for r in rows])
        # words whose share of documents differs by class beyond chance; the rest is noise
        n1 = max(1.0, y.sum())
        n0 = max(1.0, len(y) - n1)
        a1, a = np.bincount(column, y[row], len(used)), np.bincount(column, minlength=len(used))
        share = a / len(y)
        z = (a1 / n1 - (a - a1) / n0) / np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n1 + 1 / n0))
        kept = np.flatnonzero(np.abs(z) >= LEAST_Z)
        place = np.searchsorted(kept, column)
        inside = (place < len(kept)) & (np.append(kept, -1)[np.minimum(place, len(kept))] == column)
        w, v = _logistic(row[inside], place[inside], len(kept), dense, y)
        words[used[kept], k], shapes[:, k] = w, v
    return Model(words, shapes)


def _logistic(row, column, n_words, dense, y, steps: int = 150, rate: float = 0.15, ridge: float = 2e-4):
    """Adam on the full sample; the ridge is per example."""
    w, v = np.zeros(n_words), np.zeros(dense.shape[1])
    moments = [np.zeros(n_words), np.zeros(n_words), np.zeros(len(v)), np.zeros(len(v))]
    for t in range(1, steps + 1):
        z = np.bincount(row, w[column], len(y)) + dense @ v
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        gradients = np.bincount(column, error[row], n_words) + ridge * w, dense.T @ error + ridge * v
        for i, (x, g) in enumerate(((w, gradients[0]), (v, gradients[1]))):
            m, s = moments[2 * i], moments[2 * i + 1]
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            x -= rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)
    return w, v


def evidence(docs: DataFrame, model: Model, host_col: str = "source", path_cols: tuple[str, ...] = ("lang",)) -> DataFrame:
    """doc_id, host, path and the classifier's probability of each target."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches):
        own = shared.value
        for b in batches:
            raw = b.column(3).cast(pa.binary()).to_pylist()
            z = np.array([own.logits(*features(t or b"")) for t in raw]).reshape(len(raw), len(TARGETS))
            p = 1 / (1 + np.exp(-np.clip(z, -12, 12)))
            yield {"doc_id": b.column(0), "host": b.column(1), "path": b.column(2)} | {
                f"p_{t}": pa.array(p[:, k]) for k, t in enumerate(TARGETS)
            }

    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    path = F.concat_ws("/", text(host_col), *(text(c) for c in path_cols))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text(host_col).alias("host"), path.alias("path"), "text")
    return arrow_map(own, rows, "doc_id long, host string, path string, p_quality double, p_toxic double")


def _strength(groups: DataFrame, n: str, total: str, mean: Column | float) -> Column:
    """Prior strength of group means by the method of moments, as an aggregate column.

    The variance of group means beyond what documents' own spread explains is
    the variance between groups; the strength is the ratio of the two, bounded.
    """
    m = F.col(total) / F.col(n)
    weight = F.sum(n)
    between = F.sum(F.col(n) * (m - mean) * (m - mean)) / weight
    within = F.sum(F.col(total + "_sq") - F.col(total) * m) / weight
    groups_less = F.greatest(F.count("*") - 1, F.lit(1)) / weight * within
    ratio = within / F.greatest(between - groups_less, F.lit(1e-9))
    return F.greatest(F.lit(STRENGTH[0]), F.least(F.lit(STRENGTH[1]), F.coalesce(ratio, F.lit(STRENGTH[1]))))


def posteriors(scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents with the posterior of each target and ``kept``."""
    sums = [
        x
        for t in TARGETS
        for x in (F.sum(f"p_{t}").alias(f"{t}_sum"), F.sum(F.col(f"p_{t}") * F.col(f"p_{t}")).alias(f"{t}_sum_sq"))
    ]
    paths = written(scored.groupBy("host", "path").agg(F.count("*").alias("n"), *sums), "paths")
    parts = [x for t in TARGETS for x in (F.sum(f"{t}_sum").alias(f"{t}_sum"), F.sum(f"{t}_sum_sq").alias(f"{t}_sum_sq"))]
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), *parts)
    world = paths.agg(F.sum("n").alias("n"), *parts).first()
    prior = {t: ((world[f"{t}_sum"] or 0.0) + 1) / ((world["n"] or 0) + 2) for t in TARGETS}
    of_hosts = hosts.agg(*(_strength(hosts, "n", f"{t}_sum", F.lit(prior[t])).alias(t) for t in TARGETS)).first()
    host_means = hosts.select(
        "host",
        *(((F.col(f"{t}_sum") + of_hosts[t] * prior[t]) / (F.col("n") + of_hosts[t])).alias(f"{t}_host") for t in TARGETS),
    )
    sites = paths.join(host_means, "host")
    of_paths = sites.agg(*(_strength(sites, "n", f"{t}_sum", F.col(f"{t}_host")).alias(t) for t in TARGETS)).first()
    sites = sites.select("path", "host", "n", *(f"{t}_{x}" for t in TARGETS for x in ("sum", "host")))
    joined = scored.join(sites, ["host", "path"])

    def shifted(t: str) -> Column:
        p = F.col(f"p_{t}")
        others = (F.col(f"{t}_sum") - p + of_paths[t] * F.col(f"{t}_host")) / (F.col("n") - 1 + of_paths[t])
        odds = (p / (1 - p)) * (others / (1 - others)) / (prior[t] / (1 - prior[t]))
        return odds / (1 + odds)

    out = joined.select("doc_id", "host", "path", *(f"p_{t}" for t in TARGETS), *(shifted(t).alias(f"{t}_posterior") for t in TARGETS))
    return out.withColumn("kept", (F.col("quality_posterior") >= threshold) & (F.col("toxic_posterior") < threshold))


def classify(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """One row per document: host, path, evidence, posteriors and ``kept``.

    Needs doc_id, text, source, lang; null hosts and paths are the empty name;
    a null text is empty; null ids and repeated rows are scored like any other;
    an empty table gives no rows; without labels all evidence is one half.
    """
    model = fit(docs, labels, fit_rows)
    return posteriors(written(evidence(docs, model), "evidence"))

"""Severity of toxicity by cumulative-link ordinal regression on sparse text features."""

from __future__ import annotations

import string
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellwise.llm.store import keep

PREFIXES = (4, 5, 6)


def features(word: str) -> list[str]:
    """Of a raw word: the word without case and outer punctuation, and its beginnings (marked by a trailing *)."""
    word = word.lower().strip(string.punctuation)
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) >= n)] if word else []


@dataclass
class Model:
    """P(grade >= k) is the logistic function of (sum of the features' weights - thresholds[k - 1]): one set of weights for all."""

    weights: dict[str, float] = field(default_factory=dict)
    thresholds: tuple[float, ...] = (8.0, 16.0)

    def reach(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ...; one row per score."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - np.array(self.thresholds), -40, 40)))


def fit_cumulative_link(rows: list[list[int]], grades: np.ndarray, width: int, levels: int, penalty: float = 1e-3, rounds: int = 600) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds of the greatest penalised likelihood, by Adam. rows: the features that each has."""
    index = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    feature = np.fromiter((f for r in rows for f in r), np.int64, len(index))
    share = np.array([(grades >= k).mean() for k in range(1, levels)])
    start = -np.log(np.clip(share, 1e-4, 1 - 1e-4) / (1 - np.clip(share, 1e-4, 1 - 1e-4)))
    # free parameters: weights, the first threshold, and logarithms of the gaps to the next
    p = np.concatenate([np.zeros(width), start[:1], np.log(np.maximum(np.diff(start), 0.1))])
    mean, square = np.zeros_like(p), np.zeros_like(p)
    logistic = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for t in range(1, rounds + 1):
        gaps = np.exp(p[width + 1 :])
        cut = np.concatenate([[-np.inf], p[width] + np.concatenate([[0], np.cumsum(gaps)]), [np.inf]])
        score = np.bincount(index, p[:width][feature], len(rows))
        above, below = logistic(score - cut[grades]), logistic(score - cut[grades + 1])
        likely = np.maximum(above - below, 1e-12)
        slope_a, slope_b = above * (1 - above) / likely, below * (1 - below) / likely
        by_score = (slope_a - slope_b) / len(rows)
        by_cut = (np.bincount(grades + 1, slope_b, levels + 1) - np.bincount(grades, slope_a, levels + 1))[1:levels] / len(rows)
        by_gap = np.cumsum(by_cut[::-1])[::-1]
        up = np.concatenate([np.bincount(feature, by_score[index], width) - penalty * p[:width] / max(1, width), by_gap[:1], by_gap[1:] * gaps])
        mean, square = 0.9 * mean + 0.1 * up, 0.999 * square + 0.001 * up * up
        p = p + 0.1 * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.999**t)) + 1e-8)
    return p[:width], p[width] + np.concatenate([[0], np.cumsum(np.exp(p[width + 1 :]))])


def _signature(words: list[str]) -> int:
    """The least hash of the five-word shingles: mostly the same for copies and near copies."""
    spans = (" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4)))
    return min(xxhash.xxh64_intdigest(s) for s in spans) - (1 << 63)


def fit(docs: DataFrame, labels: DataFrame, most: int = 12_000, evidence: float = 30.0, width: int = 20_000) -> Model:
    """Fit on some ``most`` of the labelled rows, chosen by the hash of doc_id; copies and near copies of a text count once.

    A feature is used if its likelihood-ratio statistic with the label is at least ``evidence`` (the best ``width``). The labels
    say toxic or not; the grades above are told apart by how many of the features that speak for toxicity a toxic document
    has: grade 1 below the median, grade 2 from it on. Labels that are null or all alike give a model that finds nothing, and so do empty tables and
    labels without documents. Of several labels of a doc_id the greatest counts, of several texts of a doc_id each; null texts, ids and labels are left out;
    of features of equal evidence those that sort first are used. Very long texts count whole; other columns are ignored.
    """
    marked = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    total = marked.count()
    chosen = marked.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 20)) < int((1 << 20) * min(1.0, most / max(total, 1))))

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            words = [t.split() for t in batch["text"]]
            found = [sorted({f for w in set(ws) for f in features(w)}) for ws in words]
            yield pd.DataFrame({"copy": [_signature(w) for w in words], "toxic": batch["toxic"], "features": found})

    texts = docs.select(F.col("doc_id").cast("long"), "text").where("text IS NOT NULL").join(chosen, "doc_id")
    sample = texts.select("text", F.col("toxic").cast("int").alias("toxic")).mapInPandas(extract, "copy long, toxic int, features array<string>")
    sample = keep(sample.groupBy("copy").agg(F.max(F.struct("toxic", "features")).alias("best")).select("copy", "best.*"), "sample")
    size = sample.agg(F.count("*").alias("n"), F.sum("toxic").alias("k")).first()
    if not size["n"] or not size["k"] or size["n"] == size["k"]:
        return Model()

    n, k = F.col("n"), F.col("k")
    rest, bad = F.lit(size["n"]) - n, F.lit(size["k"]) - k
    share = lambda a, b: F.when(a > 0, a * F.log(a / b)).otherwise(0.0)
    rate = size["k"] / size["n"]
    ratio = 2 * (share(k, n * rate) + share(n - k, n * (1 - rate)) + share(bad, rest * rate) + share(rest - bad, rest * (1 - rate)))
    stats = sample.select("toxic", F.explode("features").alias("feature")).groupBy("feature").agg(F.count("*").alias("n"), F.sum("toxic").alias("k"))
    stats = stats.withColumns({"ratio": ratio, "bad": k > n * rate}).where(F.col("ratio") >= evidence)
    used = stats.orderBy(F.desc("ratio"), "feature").limit(width).collect()
    if not used:
        return Model()
    place = {r["feature"]: i for i, r in enumerate(used)}
    speaks = np.array([r["bad"] for r in used])

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"toxic": batch["toxic"], "found": [[place[f] for f in fs if f in place] for fs in batch["features"]]})

    small = sample.orderBy("copy").mapInPandas(reduce, "toxic int, found array<int>").toPandas()
    rows, toxic = [list(f) for f in small["found"]], small["toxic"].to_numpy() > 0
    count = np.array([speaks[r].sum() for r in rows])
    grades = np.where(toxic, np.where(count >= np.median(count[toxic]), 2, 1), 0)
    weights, thresholds = fit_cumulative_link(rows, grades, len(used), 3)
    return Model({f: float(weights[i]) for f, i in place.items()}, tuple(float(x) for x in thresholds))


def _scorer(model: Model) -> Callable[[Iterable[str | None]], np.ndarray]:
    """Texts to P(grade >= k) for k = 1, 2, ...: one row per text."""
    weights = model.weights
    known: dict[str, tuple[str, ...]] = {}

    def reach(texts: Iterable[str | None]) -> np.ndarray:
        sums = []
        for text in texts:
            found: set[str] = set()
            for word in set(text.split()) if text else ():
                hit = known.get(word)
                if hit is None:
                    if len(known) > 500_000:
                        known.clear()
                    hit = known[word] = tuple(f for f in features(word) if f in weights)
                if hit:
                    found.update(hit)
            sums.append(sum(weights[f] for f in sorted(found)))
        return model.reach(np.array(sums, float))

    return reach


def score(docs: DataFrame, model: Model, reject_at: float = 0.5) -> DataFrame:
    """Rows (doc_id, expected_severity, grade, toxic), one per row of ``docs(doc_id, text)``.

    expected_severity is the sum over grades of grade times probability; grade is the likeliest one; toxic tells that the probability of any grade above
    0 is at least ``reject_at``. Each feature counts once per text, wherever in it. A null or empty text has no features.
    Repeated rows and null ids are scored like others; other columns are ignored; an empty table gives an empty result.
    """

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reach_of = _scorer(model)
        for batch in batches:
            reach = reach_of(batch["text"])
            yield pd.DataFrame({
                "doc_id": batch["doc_id"].astype("Int64"),
                "expected_severity": reach.sum(1),
                "grade": (np.argmax(-np.diff(np.hstack([np.ones((len(batch), 1)), reach, np.zeros((len(batch), 1))])), axis=1)).astype("int32"),
                "toxic": reach[:, 0] >= reject_at,
            })

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(scored, "doc_id long, expected_severity double, grade int, toxic boolean")


def drop_toxic(docs: DataFrame, model: Model, reject_at: float = 0.5) -> DataFrame:
    """``docs`` without the rows whose text is toxic; all columns and all other rows stay as they are.

    Each row is judged by its own text where it lies, so repeated and null doc_ids, ties and columns of any name make no difference and nothing is
    shuffled. A null, empty or blank text is not toxic; a very long one is read whole; an empty table gives an empty result.
    """

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach_of = _scorer(model)
        for batch in batches:
            yield batch.filter(pa.array(reach_of(t.as_py() for t in batch.column("text"))[:, 0] < reject_at))

    return docs.mapInArrow(clean, docs.schema)

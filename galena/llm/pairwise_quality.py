"""Quality classifier: Bradley-Terry ranking from preference pairs.

A good document beats a bad one with probability ``sigmoid(w . (x_good - x_bad))``; ``w`` minimises
the logistic loss over such pairs, so ``w . x`` ranks documents. The cut comes from quantiles of the
scores of all labelled training rows: the middle between the quantile just below and the one just above
the share of bad rows among them, so that it lies in the gap between the two kinds if there is one.
Scores are mapped to 0..1 with the cut at ``CUT``.

The weights are fitted on a bounded sample: ``fit_rows`` labelled training rows go to the driver
(about 1.5 MB) and make ``n_pairs`` pairs. The quantile covers all labelled training rows.

Defined results: a null text counts as empty and is scored; without labels of both kinds every score
is 1; repeated rows get equal scores; a null id is never held out nor trained on; an empty table gives
an empty result. Labels, language, source and id are never inputs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galena.llm.common import bounded_sample, cut
from galena.llm.text_stats import COUNTS, RATIOS, ratios, with_stats

CUT = 0.3


def features(stats: dict[str, np.ndarray]) -> np.ndarray:
    """Ratios, with square roots of the shares so that a little junk counts, and a flag of short texts."""
    r = ratios(stats)
    shares = r[:, [RATIOS.index(c) for c in ("symbol_share", "dup_line_share", "repeat_share", "upper_share", "mark_share")]]
    return np.concatenate([r, np.sqrt(shares), np.minimum(r[:, :1], np.log1p(50))], axis=1)


@dataclass
class Ranking:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float = -np.inf
    spread: float = 1.0

    def raw(self, stats: dict[str, np.ndarray]) -> np.ndarray:
        return np.clip((features(stats) - self.mean) / self.scale, -8, 8) @ self.weights

    def score(self, stats: dict[str, np.ndarray]) -> np.ndarray:
        if not np.isfinite(self.cut):
            return np.ones(len(stats["n_words"]))
        z = np.clip((self.raw(stats) - self.cut) / self.spread, -30, 30) + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-z))


def fit_pairs(x: np.ndarray, good: np.ndarray, n_pairs: int = 40_000, rounds: int = 300, ridge: float = 1e-3, seed: int = 11) -> Ranking:
    """Gradient descent with momentum on the logistic loss of feature differences."""
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.clip((x - mean) / scale, -8, 8)
    rng = np.random.default_rng(seed)
    d = z[rng.choice(np.flatnonzero(good), n_pairs)] - z[rng.choice(np.flatnonzero(~good), n_pairs)]
    w, speed = np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for _ in range(rounds):
        lose = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
        speed = 0.9 * speed + (lose @ d) / n_pairs - ridge * w
        w = w + 0.1 * speed
    return Ranking(mean, scale, w)


def remainder(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(5))


def fit(stats: DataFrame, labels: DataFrame, fit_rows: int = 12_000, seed: int = 11) -> Ranking:
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & (remainder(F.col("doc_id")) != 0)).groupBy("doc_id").agg(F.min("quality").alias("__good"))
    training = stats.join(known, "doc_id")
    sample = bounded_sample(training.withColumn("__is_good", F.col("__good") > 0), fit_rows, ["doc_id", *COUNTS], seed, "__is_good").select(*COUNTS, "__is_good").toPandas()
    good = sample["__is_good"].to_numpy().astype(bool)
    if not good.any() or good.all():
        k = len(features({c: np.zeros(1) for c in COUNTS})[0])
        return Ranking(np.zeros(k), np.ones(k), np.zeros(k))
    model = fit_pairs(features({c: sample[c].to_numpy() for c in COUNTS}), good, seed=seed)

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = model.raw({c: b.column(k).to_numpy() for k, c in enumerate(COUNTS)})
            yield pa.RecordBatch.from_arrays([pa.array(raw), b.column(len(COUNTS))], names=["raw", "good"])

    scored = training.select(*COUNTS, (F.col("__good") > 0).cast("int").alias("good")).mapInArrow(job, "raw double, good int")
    bad = 1 - scored.agg(F.avg("good")).first()[0]
    # A little on either side of the quantile: the cut is in the middle of the gap, if there is one.
    low, cut_at, high, q1, q3 = scored.agg(F.percentile_approx("raw", [max(0.0, bad * 0.99), bad, min(1.0, bad + 0.01 * (1 - bad)), 0.25, 0.75], 10_000)).first()[0]
    model.cut = (low + high) / 2 if low <= cut_at <= high else cut_at
    model.spread = max((q3 - q1) / 2, 1e-6)
    return model


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``."""
    stats = cut(with_stats(docs))
    model = fit(stats, labels)

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = model.score({c: b.column(k + 1).to_numpy() for k, c in enumerate(COUNTS)})
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score), pa.array((score >= CUT).astype(np.int32))], names=["doc_id", "score", "predicted"])

    kind = stats.schema["doc_id"].dataType.simpleString()
    out = stats.select("doc_id", *COUNTS).mapInArrow(job, f"doc_id {kind}, score double, predicted int")
    return out.select("doc_id", F.coalesce(remainder(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", "predicted")

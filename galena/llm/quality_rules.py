"""Quality rules with an isolation forest over rule statistics.

Two fixed rules come first (too few words, too many repeated words). A forest of random splits over
the rule statistics then scores every other document: anomalous documents are cut off by few splits,
so their mean path is short and their score ``2 ** (-mean path / c(sample))`` is high. The cut on the
score comes from a histogram over *all* labelled rows.

The forest itself is fitted on a bounded sample of labelled rows: ``fit_rows`` rows go to the driver
(about 1 MB), each tree takes ``tree_rows`` good ones of them.

Defined results: a null or empty text has no words and fails the base rules; repeated rows and rows
with a null id are each judged by their own text; without labels the forest rejects nothing; an
empty table gives an empty result. Only ``doc_id`` and the text are read, so other columns may have
any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galena.llm.common import bounded_sample, cut, flat, slices
from galena.llm.text_stats import COUNTS, RATIOS, ratios, stats_of, with_stats

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
BINS = 2000


def _mean_path(n: np.ndarray) -> np.ndarray:
    """Mean depth of an unsuccessful search in a random tree of n rows."""
    n = np.asarray(n, np.float64)
    m = np.maximum(n, 2)
    return np.where(n > 2, 2 * (np.log(m - 1) + 0.5772156649) - 2 * (m - 1) / m, np.where(n == 2, 1.0, 0.0))


#: The forest looks at the square roots of these ratios, so that a small share of junk counts.
RULES = [RATIOS.index(c) for c in ("word_length", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "mark_share")]


@dataclass
class Forest:
    """Trees in shared arrays: ``roots`` are their first nodes, the children of a node are ``left`` and ``left + 1``, leaves have feature -1."""

    roots: np.ndarray
    feature: np.ndarray
    split: np.ndarray
    left: np.ndarray
    path: np.ndarray
    depth: int
    norm: float

    def score(self, ratio: np.ndarray) -> np.ndarray:
        x = np.sqrt(ratio[:, RULES]).astype(np.float32)
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                f = self.feature[node]
                node = np.where(f >= 0, self.left[node] + (x[rows, f] >= self.split[node]), node)
            total += self.path[node]
        return np.exp2(-total / len(self.roots) / self.norm) if len(self.roots) else np.zeros(len(x))


def fit_forest(ratio: np.ndarray, good: np.ndarray, trees: int = 64, tree_rows: int = 1024, depth: int = 12, seed: int = 7) -> Forest:
    """Each tree takes ``tree_rows`` good rows and splits the box that all rows span at random.

    The box, not the range of the tree's own rows, bounds a split, so a document in a part of the
    box without good rows is cut off early however many other such documents there are.
    """
    x = np.sqrt(ratio[:, RULES]).astype(np.float32)
    rng = np.random.default_rng(seed)
    roots, nodes = [], []  # of a node: feature, split, left, path
    pool = x[good]
    rows = min(tree_rows, len(pool))
    for _ in range(trees if rows > 1 else 0):
        roots.append(len(nodes))
        nodes.append([-1, 0.0, 0, 0.0])
        todo = [(len(nodes) - 1, 0, pool[rng.choice(len(pool), rows, replace=False)], x.min(0), x.max(0))]
        while todo:
            node, level, part, low, high = todo.pop()
            if level == depth or len(part) < 2:
                nodes[node][3] = level + float(_mean_path(len(part)))
                continue
            f = int(rng.integers(x.shape[1]))
            at = np.float32(rng.uniform(low[f], high[f]))
            nodes[node][:3] = [f, at, len(nodes)]
            nodes += [[-1, 0.0, 0, 0.0], [-1, 0.0, 0, 0.0]]
            below, above = high.copy(), low.copy()
            below[f] = above[f] = at
            right = part[:, f] >= at
            todo += [(nodes[node][2], level + 1, part[~right], low, below), (nodes[node][2] + 1, level + 1, part[right], above, high)]
    feature, split, left, path = zip(*nodes, strict=True) if nodes else ((), (), (), ())
    return Forest(np.array(roots, np.int64), np.array(feature, np.int8), np.array(split, np.float32), np.array(left, np.int32), np.array(path, np.float32), depth, float(_mean_path(np.array(rows))) or 1.0)


def base_failed(n_words: np.ndarray, n_repeat: np.ndarray) -> np.ndarray:
    return (n_words < MIN_WORDS) | (100 * n_repeat > MAX_REPEAT_PERCENT * n_words)


@dataclass
class QualityModel:
    forest: Forest
    threshold: float


def fit(stats: DataFrame, labels: DataFrame, fit_rows: int = 8192, max_good_lost: float = 0.002, seed: int = 7) -> QualityModel:
    """Fit the forest and its cut. ``stats``: doc_id and COUNTS; ``labels``: doc_id, quality (1 good, 0 bad).

    The cut is the lowest score above which at most ``max_good_lost`` of the good labelled rows lie,
    or the best margin between the two classes if that loses fewer; rows that the base rules reject
    take no part.
    """
    good = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("__good"))
    passing = stats.where((F.col("n_words") >= MIN_WORDS) & (100 * F.col("n_repeat_words") <= MAX_REPEAT_PERCENT * F.col("n_words")))
    labelled = passing.join(good, "doc_id")
    sample = bounded_sample(labelled.withColumn("__is_good", F.col("__good") > 0), fit_rows, ["doc_id", *COUNTS], seed, "__is_good").select(*COUNTS, "__is_good").toPandas()
    forest = fit_forest(ratios({c: sample[c].to_numpy() for c in COUNTS}), sample["__is_good"].to_numpy().astype(bool), seed=seed)

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = {c: b.column(k).to_numpy() for k, c in enumerate(COUNTS)}
            bins = np.floor(forest.score(ratios(t)) * BINS).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(bins), b.column(len(COUNTS))], names=["bin", "good"])

    found = labelled.select(*COUNTS, F.col("__good").cast("int").alias("good")).mapInArrow(job, "bin long, good int").groupBy("bin", "good").count().collect()
    n = np.zeros((2, BINS + 2))
    for r in found:
        n[int(r["good"] > 0), r["bin"]] += r["count"]
    if not n[0].sum() or not n[1].sum():
        return QualityModel(forest, np.inf)
    above = n[:, ::-1].cumsum(1)[:, ::-1]  # rows with a score in this bin or a higher one
    lost, caught = above[1] / n[1].sum(), above[0] / n[0].sum()
    gain = np.where(lost <= max_good_lost, caught - 5 * lost, -1.0)
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    return QualityModel(forest, (best[0] + best[-1]) // 2 / BINS)


def verdict(stats: dict[str, np.ndarray], model: QualityModel) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base_failed, score, kept."""
    failed = base_failed(stats["n_words"], stats["n_repeat_words"])
    score = model.forest.score(ratios(stats))
    return failed, score, ~failed & (score < model.threshold)


def judge(stats: DataFrame, model: QualityModel) -> DataFrame:
    """Verdicts for rows of statistics."""

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            failed, score, kept = verdict({c: b.column(k + 1).to_numpy() for k, c in enumerate(COUNTS)}, model)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(failed), pa.array(score), pa.array(kept)], names=["doc_id", *COUNTS, "base_failed", "score", "kept"])

    kind = stats.schema["doc_id"].dataType.simpleString()
    return stats.select("doc_id", *COUNTS).mapInArrow(job, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, score double, kept boolean")


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the statistics, base_failed, the anomaly score and the verdict ``kept`` of each row."""
    stats = cut(with_stats(docs))
    return judge(stats, fit(stats, labels))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns. Texts are not shuffled."""
    model = fit(cut(with_stats(docs)), labels)
    at = docs.columns.index("text")

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = flat(b.column(at))
            for i, j in slices(off):
                kept = verdict(stats_of(data[off[i] : off[j]], off[i : j + 1] - off[i]), model)[2]
                yield b.slice(i, j - i).filter(pa.array(kept))

    return docs.mapInArrow(job, docs.schema)

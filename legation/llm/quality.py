"""Quality classifier: regularised quadratic discriminant over document statistics.

Statistics of every whole text are computed in one scan; per class the count,
sum and sum of outer products of the labelled rows are enough to fit, so
fitting moves one small row per task. Class covariances are shrunk towards
their scaled diagonal, and scores are differences of Gaussian log densities
whose Mahalanobis terms come from the Cholesky factors, factored once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from legation.llm.common import chunks, cut, row_keys, text_of
from legation.llm.words import IS_WORD, buffers, word_hashes, word_spans

# Shares enter as log odds after adding PRIOR_CHARS or PRIOR_WORDS of ordinary
# prose with these usual shares, so that a short text stays near the centre.
USUAL = {
    "upper": 0.02, "digit": 0.005, "stop_mark": 0.03, "symbol": 0.003, "non_ascii": 0.03,
    "short_words": 0.35, "distinct_words": 0.75, "top_word": 0.06, "distinct_lines": 0.97,
}
PRIOR_CHARS, PRIOR_WORDS, PRIOR_LINES = 100, 20, 10
USUAL_WORD, USUAL_SQUARE = 5.5, 42.0

STATISTICS = ("word_mean", "word_spread", *USUAL)

_CLASSES = {}
for _name, _bytes in {
    "upper": range(0x41, 0x5B),
    "digit": range(0x30, 0x3A),
    "stop_mark": b".,;:!?",
    "symbol": [b for b in range(0x21, 0x80) if not IS_WORD[b] and b not in b".,;:!?'\"()-"],
    "non_ascii": range(0x80, 0x100),
}.items():
    _CLASSES[_name] = np.zeros(256, np.int64)
    _CLASSES[_name][list(_bytes)] = 1


def _per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(values) + 1, np.float64)
    np.cumsum(values, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of transformed statistics per text; all finite, also for empty texts.

    The length itself is no statistic: clean texts have one word to 20,000,
    and a Gaussian over it would reject the shortest and the longest.
    """
    data, offsets = buffers(texts)
    starts, ends, first = word_spans(data, offsets)
    hashes, _ = word_hashes(texts)
    size = np.diff(offsets).astype(float)
    n_words = np.diff(first).astype(float)
    lengths = (ends - starts).astype(float)
    some = n_words + PRIOR_WORDS
    mean = (_per_text(lengths, first) + PRIOR_WORDS * USUAL_WORD) / some
    square = (_per_text(lengths**2, first) + PRIOR_WORDS * USUAL_SQUARE) / some
    spread = np.sqrt(np.maximum(square - mean**2, 0))
    count = {name: _per_text(lut[data], offsets) for name, lut in _CLASSES.items()}
    short = _per_text(lengths <= 3, first)
    distinct, top = np.zeros(len(size)), np.zeros(len(size))
    lines, distinct_lines = np.ones(len(size)), np.ones(len(size))
    raw = data.tobytes()
    for i in range(len(size)):
        own = np.sort(hashes[first[i] : first[i + 1]])
        if len(own):
            change = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1], [True])))
            distinct[i], top[i] = len(change) - 1, np.diff(change).max()
        parts = [x for x in raw[offsets[i] : offsets[i + 1]].split(b"\n") if x]
        lines[i], distinct_lines[i] = len(parts), len(set(parts))

    def share(name: str, part: np.ndarray, whole: np.ndarray, weight: int) -> np.ndarray:
        usual = USUAL[name]
        return np.log((part + weight * usual) / (np.maximum(whole - part, 0) + weight * (1 - usual)))

    columns = [np.log1p(mean), np.log1p(spread)]
    columns += [share(name, count[name], size, PRIOR_CHARS) for name in ("upper", "digit", "stop_mark", "symbol", "non_ascii")]
    words = {"short_words": short, "distinct_words": distinct, "top_word": top}
    columns += [share(name, part, n_words, PRIOR_WORDS) for name, part in words.items()]
    columns.append(share("distinct_lines", distinct_lines, lines, PRIOR_LINES))
    return np.column_stack(columns)


def document_statistics(docs: DataFrame, id_col: str, text_col: str, row_col: str | None = None) -> DataFrame:
    """``id, row, x`` (array of :data:`STATISTICS`) for every row; null text is empty, ``row`` null if not asked for."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", 1 << 20):
            x = statistics(batch.column(1))
            values = pa.array(x.ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), values)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), lists], names=["id", "row", "x"])

    row = F.lit(None).cast("long") if row_col is None else F.col(row_col)
    source = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"), row.alias("row"))
    return source.mapInArrow(rows, "id long, row long, x array<double>")


@dataclass(frozen=True)
class Discriminant:
    """Two Gaussians: per class the mean, inverse Cholesky factor, log determinant and log prior."""

    means: np.ndarray
    factors: np.ndarray
    log_dets: np.ndarray
    log_priors: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        logs = []
        for mean, factor, log_det, prior in zip(self.means, self.factors, self.log_dets, self.log_priors):
            z = (x - mean) @ factor.T  # factor is the inverse of the Cholesky factor
            logs.append(prior - 0.5 * (log_det + np.einsum("ij,ij->i", z, z)))
        gap = np.clip(logs[1] - logs[0], -700, 700)
        return 1 / (1 + np.exp(-gap))


def fit(labelled: DataFrame, shrinkage: float = 0.1) -> Discriminant:
    """Fit on rows ``x, y`` (y in 0, 1).

    Only class counts, sums and sums of outer products leave the tasks. Each
    covariance becomes (1 - shrinkage) S + shrinkage diag(S) plus a small
    multiple of the pooled variances, so it can be factored for any class
    size; a class without rows gets the pooled moments, and without any row
    the result scores everything by an even prior.
    """
    d = len(STATISTICS)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            y = batch.column(1).to_numpy(zero_copy_only=False)
            for label in (0, 1):
                own = x[y == label]
                total[label, 0] += len(own)
                total[label, 1 : 1 + d] += own.sum(axis=0)
                total[label, 1 + d :] += (own.T @ own).ravel()
        yield pa.RecordBatch.from_arrays(
            [pa.array([0, 1], pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["y", "m"]
        )

    parts = labelled.select("x", F.col("y").cast("int").alias("y")).mapInArrow(moments, "y int, m array<double>")
    at = F.posexplode("m").alias("at", "v")
    # Summed as decimals, so that the order in which tasks end changes nothing. 2 (1 + d + d^2) rows.
    sums = parts.select("y", at).groupBy("y", "at").agg(F.sum(F.col("v").cast("decimal(38,12)")).alias("v")).collect()
    total = np.zeros((2, 1 + d + d * d))
    for row in sums:
        total[row["y"], row["at"]] = float(row["v"])
    n = total[:, 0]
    pooled = total.sum(axis=0)
    size = max(pooled[0], 1.0)
    pooled_mean = pooled[1 : 1 + d] / size
    pooled_cov = pooled[1 + d :].reshape(d, d) / size - np.outer(pooled_mean, pooled_mean)
    floor = np.maximum(np.diag(pooled_cov), 0) * 1e-3 + 1e-6
    means, factors, log_dets = [], [], []
    for label in (0, 1):
        mean, cov = pooled_mean, pooled_cov
        if n[label] > 0:
            mean = total[label, 1 : 1 + d] / n[label]
            cov = total[label, 1 + d :].reshape(d, d) / n[label] - np.outer(mean, mean)
        cov = (1 - shrinkage) * cov + shrinkage * np.diag(np.diag(cov)) + np.diag(floor)
        values, vectors = np.linalg.eigh((cov + cov.T) / 2)  # rounding may leave a tiny negative value
        cov = (vectors * np.maximum(values, 1e-9)) @ vectors.T
        chol = np.linalg.cholesky((cov + cov.T) / 2)
        means.append(mean)
        factors.append(np.linalg.inv(chol))
        log_dets.append(2 * np.log(np.diag(chol)).sum())
    priors = np.log((n + 1) / (n.sum() + 2))
    return Discriminant(np.array(means), np.array(factors), np.array(log_dets), priors)


def held_out(id_col: Column, folds: int = 5) -> Column:
    """Whether crc32 of the id as text falls into fold 0, which is never learnt from."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds == 0, F.lit(False))


def classify(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    threshold: float = 0.3,
    shrinkage: float = 0.1,
    row_col: str | None = None,
) -> DataFrame:
    """One row per document: ``<id>, held_out, score, predicted``, and ``row_col`` if given.

    The score depends on the text alone. Labels are learnt from rows that are
    not held out; an id labelled 0 as well as 1 is not learnt from, labels
    other than 0 and 1 (and null ids) are ignored, repeated equal labels
    count once. Null text is empty and is scored like any other; without any
    usable label every score is the same. Other columns are ignored.
    """
    stats = cut(document_statistics(docs, id_col, text_col, row_col))
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("y")).filter("y in (0, 1) and id is not null")
    known = known.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("top")).filter("y = top").drop("top")
    train = stats.filter(~held_out(F.col("id"))).join(known, "id")
    model = fit(train, shrinkage)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(model.score(x))], names=["id", "row", "score"])

    scored = stats.select("id", "row", "x").mapInArrow(score, "id long, row long, score double")
    return scored.select(
        F.col("id").alias(id_col),
        *([F.col("row").alias(row_col)] if row_col else []),
        held_out(F.col("id")).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def drop_rejected(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows that :func:`classify` predicts 1, all columns unchanged.

    Every row is judged by its own text: rows without an id go if rejected,
    and an accepted row stays though a row with its id goes.
    """
    keyed = row_keys(docs, id_col)
    judged = classify(keyed, labels, id_col, text_col, row_col="__key", **options)
    gone = judged.filter("predicted = 0").select(F.col("__key").alias("__gone"))
    return keyed.join(gone, F.col("__key") == F.col("__gone"), "left_anti").drop("__key")

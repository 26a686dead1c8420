"""Quality by positive-unlabelled learning.

Trusted positives are documents labelled good; every document of the training fold is unlabelled text, whatever its
label says. With class prior p, a linear model g over document statistics minimises the non-negative unbiased risk

    p E_P[l(g)] + max(0, E_U[l(-g)] - p E_P[l(-g)]),    l the logistic loss.

As l(z) - l(-z) = -z, what stands inside the maximum's range is convex; it is minimised by Newton's method, whose sums
over all trusted and all unlabelled rows are one distributed pass a step, without a sample. The class prior is estimated from positive and unlabelled text alone: the share of unlabelled rows above a score can't be less than p times
that of the positive ones, so the least ratio of the two tails bounds p from above.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import blocks
from .common import id_text, lean, materialize, read_documents, release
from .toxicity import fold

#: Passes of the fit at most, and its penalty.
STEPS = 16
RIDGE = 1e-3
#: Standardised statistics are cut off here. Bins of the scores whose tails are compared, and the least share of
#: positive rows in a tail.
CLIP = 6.0
BINS = 400
LEAST_TAIL = 0.2

_MARKS = b"!\"#$%&'()*+,-./:;<=>?@[]^_`{|}~"


def features(text: str) -> list[float]:
    """Statistics of a whole text: shares of kinds of characters, words and lines."""
    raw = text.encode("utf-8", "replace")
    n = len(raw)
    if not n:
        return [0.0] * N_FEATURES
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    n_words = max(1, len(words))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    distinct = len(set(words))
    upper, lower = int(hist[65:91].sum()), int(hist[97:123].sum())
    marks = [np.sqrt(hist[b] / n_words) for b in _MARKS]
    triples = max(1, len(words) - 2)
    return [
        1.0, np.log1p(n), np.log1p(len(words)), np.sqrt(upper / n), lower / n, np.sqrt(int(hist[48:58].sum()) / n), hist[32] / n, np.sqrt(hist[10] / n),
        int(hist[128:].sum()) / n, n / n_words / 10, distinct / n_words, len(set(zip(words, words[1:], words[2:], strict=False))) / triples,
        len(set(lines)) / max(1, len(lines)), np.log1p(n_words / max(1, len(lines))), float(len(words) < 20), float(upper > lower), *marks,
    ]


N_FEATURES = 16 + len(_MARKS)


def featurise(docs: DataFrame) -> DataFrame:
    """doc_id and ``x`` (32-bit floats, binary), one row per row. Null and empty texts have all statistics 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            x = [np.asarray(features(t), np.float32).tobytes() for t in block["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([block["doc_id"], pa.array(x, pa.binary())], ["doc_id", "x"])

    return id_text(docs).mapInArrow(lean(run), "doc_id long, x binary")


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch["x"].to_pylist()), np.float32).reshape(-1, N_FEATURES).astype(np.float64)


def _sums(rows: DataFrame, of: Callable[[np.ndarray], np.ndarray]) -> dict[bool, np.ndarray]:
    """Sums over the trusted (True) and over all rows of what ``of`` makes of a matrix of rows (a vector): one row per
    task and side on the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[bool, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x, trusted = _matrix(batch), batch["trusted"].to_numpy(zero_copy_only=False).astype(bool)
            for side, part in ((False, x), (True, x[trusted])):
                if len(part):
                    totals[side] = totals.get(side, 0) + of(part)
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.bool_()), pa.array([t.tolist() for t in totals.values()], pa.list_(pa.float64()))], ["side", "total"])

    parts = rows.mapInArrow(lean(run), "side boolean, total array<double>").select("side", F.posexplode("total").alias("i", "v"))
    found = parts.groupBy("side", "i").agg(F.sum("v").alias("v")).collect()
    return {side: np.array([r["v"] for r in sorted(found, key=lambda r: r["i"]) if r["side"] == side]) for side in (False, True)}


def standardise(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.clip((x - mean) / scale, -CLIP, CLIP)


def risk_sums(z: np.ndarray, w: np.ndarray) -> np.ndarray:
    """What Newton's method needs of some rows: their number, sums of l(-g), of x, of its gradient and of its curvature."""
    g = np.clip(z @ w, -30, 30)
    s = 1 / (1 + np.exp(-g))
    return np.concatenate([[len(z), np.logaddexp(0, g).sum()], z.sum(0), s @ z, ((z * (s * (1 - s))[:, None]).T @ z).ravel()])


def non_negative_risk(sums: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], prior: float, size: int) -> np.ndarray:
    """The weights that minimise the non-negative risk; ``sums`` gives ``risk_sums`` of the trusted and of all rows.

    A step is halved as long as it doesn't lower the risk, or takes the negative part below zero, where the estimator
    would only fit the trusted rows by heart.
    """
    w, step, lowest = np.zeros(size), np.zeros(size), np.inf
    for _ in range(STEPS):
        p, u = (x[1:] / x[0] for x in sums(w + step))
        risk = u[0] - prior * (w + step) @ p[1 : size + 1] + RIDGE / 2 * (w + step) @ (w + step)
        if risk > lowest or u[0] < prior * p[0]:
            step = step / 2
            continue
        w, lowest = w + step, risk
        gradient = u[size + 1 : 2 * size + 1] - prior * p[1 : size + 1] + RIDGE * w
        step = -np.linalg.solve(u[2 * size + 1 :].reshape(size, size) + RIDGE * np.eye(size), gradient)
        if np.abs(step).max() < 1e-3:
            break
    return w


def prior_from_tails(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The least ratio of the unlabelled to the positive rows' share above a score, from histograms of scores; two
    standard errors are added, so that a thin tail doesn't decide by chance."""
    tail = lambda h: h[::-1].cumsum()[::-1] / max(h.sum(), 1)
    p, u = tail(positive), tail(unlabelled)
    enough = p >= LEAST_TAIL
    error = 2 * np.sqrt(u / max(unlabelled.sum(), 1) + p / max(positive.sum(), 1))
    return float(np.clip(((u + error) / np.maximum(p, 1e-9))[enough].min(initial=1.0), 0.01, 0.99))


Model = tuple[np.ndarray, np.ndarray, np.ndarray]


def fit(featured: DataFrame, labels: DataFrame) -> Model | float:
    """(weights, mean, scale) from the table (doc_id, x), or a constant score where there are no positives.

    Only rows outside the held-out fold count, and of the labels only the positive ones. A doc_id counts once.
    """
    trusted = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull() & (fold(3) != 1)).select(F.col("doc_id").cast("long").alias("doc_id")).distinct().withColumn("trusted", F.lit(True))
    once = featured.where(F.col("doc_id").isNotNull() & (fold(3) != 1)).groupBy("doc_id").agg(F.min("x").alias("x"))
    rows = materialize(once.join(trusted, "doc_id", "left").select(F.coalesce("trusted", F.lit(False)).alias("trusted"), "x"), "training")
    first = _sums(rows, lambda x: np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)]))
    if not len(first[True]):
        return 0.5
    n = first[False][0]
    mean = first[False][1 : N_FEATURES + 1] / n
    scale = np.sqrt(np.maximum(0, first[False][N_FEATURES + 1 :] / n - mean**2))
    mean[0], scale[0] = 0.0, 1.0
    scale[scale < 1e-6] = 1.0

    def moments(x: np.ndarray) -> np.ndarray:
        z = standardise(x, mean, scale)
        return np.concatenate([z.sum(0), (z.T @ z).ravel()])

    second = _sums(rows, moments)
    sides = {k: (second[k][:N_FEATURES] / first[k][0], second[k][N_FEATURES:].reshape(N_FEATURES, N_FEATURES) / first[k][0]) for k in (False, True)}
    # positive against unlabelled rows, only to order them for the prior
    between = np.linalg.solve(sides[True][1] + sides[False][1] + 1e-3 * np.eye(N_FEATURES), sides[True][0] - sides[False][0])

    def histogram(x: np.ndarray) -> np.ndarray:
        at = np.clip((standardise(x, mean, scale) @ between + 1) * BINS / 2, 0, BINS - 1).astype(int)
        return np.bincount(at, minlength=BINS).astype(np.float64)

    third = _sums(rows, histogram)

    def sums(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        both = _sums(rows, lambda x: risk_sums(standardise(x, mean, scale), w))
        return both[True], both[False]

    model = non_negative_risk(sums, prior_from_tails(third[True], third[False]), N_FEATURES), mean, scale
    release(rows)
    return model


def score(featured: DataFrame, model: Model | float) -> DataFrame:
    """doc_id and ``score``, one row per row of the table (doc_id, x)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if isinstance(model, float):
                s = np.full(batch.num_rows, model)
            else:
                w, mean, scale = model
                s = 1 / (1 + np.exp(-np.clip(standardise(_matrix(batch), mean, scale) @ w, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(s, pa.float64())], ["doc_id", "score"])

    return featured.mapInArrow(lean(run), "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, one row per row. Rows without doc_id are scored and not held out.

    Null and empty texts are scored like any other, equal texts equally, texts of any length whole.
    """
    featured = materialize(featurise(docs), "features")
    scored = score(featured, fit(featured, labels))
    return scored.select("doc_id", F.coalesce(fold(3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))

"""Toxic passages by maximum-scoring segment search.

Each word carries the log-odds of occurring in toxic against clean documents, with an informative Dirichlet prior
(the words' frequency over both) so that rare words stay near zero; words without significant log-odds cost a small
fixed drift. A linear scan finds every maximal-scoring segment of a text. The highest score of a clean text follows an
extreme-value law, P(S >= x) = 1 - exp(-K n e^(-lambda x)); its parameters come from the clean training documents, and
a document's evidence is the calibrated sum over its significant segments.

Labels are learnt from at most ``MAX_LABELLED`` documents (those with the smallest hash of their id); all documents are
scored whole. The segments of the labelled documents stay in a table; only sums, a histogram of word scores and two
numbers a document come to the driver.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import blocks
from .common import by_ids, id_text, lean, materialize, read_documents, release

#: Bound on the labelled documents that are learnt from.
MAX_LABELLED = 200_000
#: Pseudo-documents of the Dirichlet prior; least z-score and log-odds of a word that counts as toxic. Every such word
#: does: as each needs several toxic documents, the bound on the labelled ones bounds the model.
PRIOR = 200.0
LEAST_Z = 3.0
LEAST_ODDS = 1.0
DRIFT = 0.15
#: Segments with a larger expected number in a clean text are not reported.
SIGNIFICANT = 1.0

_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if chr(b).isalnum() and b < 128 or b >= 128 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    """Lower-case runs of ASCII letters and digits and of any non-ASCII characters."""
    return text.encode("utf-8", "replace").translate(_TABLE).split()


def fold(modulus: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def labelled(docs: DataFrame, labels: DataFrame, column: str, modulus: int, held: int, bound: int) -> DataFrame:
    """doc_id, text and label (0/1) of at most ``bound`` training documents; held-out rows are never among them.

    The chosen labels are the broadcast side: their number is bounded, so the texts need no shuffle. Where the table
    repeats a doc_id its least text counts, once.
    """
    known = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull() & (fold(modulus) != held))
    chosen = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(column)).cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    held = id_text(docs).join(F.broadcast(chosen), "doc_id")
    if held.groupBy("doc_id").count().where("count > 1").isEmpty():  # reads no text
        return held
    return held.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per word the toxic and clean documents that have it, folded per partition slice."""
    counts: tuple[Counter, Counter] = (Counter(), Counter())

    def out() -> pa.RecordBatch:
        keys = list(counts[0].keys() | counts[1].keys())
        rows = pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([counts[1][k] for k in keys], pa.int64()), pa.array([counts[0][k] for k in keys], pa.int64())], ["word", "toxic", "clean"])
        counts[0].clear(), counts[1].clear()
        return rows

    for block in blocks(batches, "text"):
        for text, label in zip(block["text"].to_pylist(), block["label"].to_pylist(), strict=True):
            counts[label > 0].update(set(words_of(text)))
        if len(counts[0]) + len(counts[1]) > 200_000:
            yield out()
    yield out()


@dataclass
class Model:
    scores: dict[bytes, float]
    drift: float
    lam: float
    k: float
    slope: float
    intercept: float

    def segments(self, words: list[bytes]) -> list[tuple[int, int, float]]:
        """All maximal-scoring segments (first word, past the last, score), by a linear scan (Ruzzo and Tompa's rule).

        Only words with positive scores can begin or end one, so runs of drift between them are taken as one step.
        """
        get = self.scores.get
        hits = [(i, s) for i, w in enumerate(words) if (s := get(w))]
        if not hits:
            return []
        stack: list[list[float]] = []  # first, past the last, sum left of it, sum up to its end
        total, before = 0.0, 0
        for i, s in hits:
            total -= self.drift * (i - before)
            left, total = total, total + s
            before = i + 1
            cur = [i, i + 1, left, total]
            while True:
                j = len(stack) - 1
                while j >= 0 and stack[j][2] >= cur[2]:
                    j -= 1
                if j < 0 or stack[j][3] >= cur[3]:
                    stack.append(cur)
                    break
                cur = [stack[j][0], cur[1], stack[j][2], cur[3]]
                del stack[j:]
        return [(int(a), int(b), right - left) for a, b, left, right in stack]

    def expected(self, score: float, n: int) -> float:
        """Segments of at least this score that a clean text of n words is expected to have."""
        return self.k * max(n, 1) * math.exp(-self.lam * score)

    def surprise(self, score: float, n: int) -> float:
        """Minus the log of the probability that a clean text of n words has a segment of this score."""
        log_expected = math.log(self.k * max(n, 1)) - self.lam * score
        return -log_expected if log_expected < -18 else max(0.0, -math.log(-math.expm1(-math.exp(min(log_expected, 700)))))

    def evidence(self, found: list[tuple[int, int, float]], n: int) -> float:
        """The surprise of the best segment, and half of that of each further one that is beyond chance."""
        logs = sorted((self.surprise(s, n) for _, _, s in found), reverse=True)
        return sum(logs[:1]) + 0.5 * sum(x for x in logs[1:] if x > 1)

    def score(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * math.log1p(evidence) + self.intercept))))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept by Newton's method with a slight ridge."""
    a = np.column_stack([x, np.ones_like(x)])
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) + 1e-3 * w
        h = (a * (p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def word_scores(training: DataFrame) -> tuple[dict[bytes, float], float]:
    """Significant words with their log-odds, and the share of clean documents' words among all (for the prior)."""
    counts = training.select("text", "label").mapInArrow(lean(_document_counts), "word binary, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    sizes = {r["toxic"]: r["count"] for r in training.groupBy((F.col("label") > 0).alias("toxic")).count().collect()}  # reads no text
    n_toxic, n_clean = sizes.get(True, 0), sizes.get(False, 0)
    if not n_toxic or not n_clean:
        return {}, float(n_toxic > 0)
    n = n_toxic + n_clean
    prior = F.lit(PRIOR) * (F.col("toxic") + F.col("clean")) / n
    yt, yc = F.col("toxic") + prior, F.col("clean") + prior
    odds = F.log(yt / (n_toxic + PRIOR - yt + 1e-9)) - F.log(yc / (n_clean + PRIOR - yc + 1e-9))
    z = odds / F.sqrt(1 / yt + 1 / yc)
    scored = counts.where("toxic > 0").select("word", odds.alias("odds"), z.alias("z"))
    telling = scored.where((F.col("z") >= LEAST_Z) & (F.col("odds") >= LEAST_ODDS)).collect()
    return {bytes(r["word"]): float(r["odds"]) for r in telling}, n_toxic / n


def fit(training: DataFrame) -> Model:
    """The model from ``labelled`` rows. Without both classes among them every score is the share of toxic rows."""
    scores, share = word_scores(training)
    model = Model(scores, DRIFT, 1.0, 1.0, 1.0, 0.0)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            rows = []
            for text, label in zip(block["text"].to_pylist(), block["label"].to_pylist(), strict=True):
                words = words_of(text)
                hits = [scores[w] for w in words if w in scores]
                rows.append((label, len(words), [s for _, _, s in model.segments(words)], hits))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.float64())), pa.array([r[3] for r in rows], pa.list_(pa.float64()))], ["label", "n", "found", "hits"])

    if not scores:
        model.slope, model.intercept = 0.0, math.log((share + 1e-3) / (1 - share + 1e-3)) if share else -5.0
        return model
    held = materialize(training.select("text", "label").mapInArrow(lean(segments), "label int, n long, found array<double>, hits array<double>"), "segments")
    clean = held.where("label = 0")
    steps = clean.select(F.explode("hits").alias("s")).groupBy("s").count().collect()  # a row per score of a word at most
    step, times = (np.array([r[i] for r in steps], np.float64) for i in (0, 1))
    n_clean, n_words = clean.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    # lambda > 0 with sum over a clean text's words of p(s) e^(lambda s) = 1
    low, high = 1e-3, 20.0
    mean = lambda lam: ((times * np.exp(np.minimum(lam * step, 500))).sum() + (n_words - times.sum()) * math.exp(-lam * DRIFT)) / max(n_words, 1)
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if mean(mid) < 1 else (low, mid)
    model.lam = low
    spread = clean.agg(F.sum(F.greatest("n", F.lit(1)) * F.exp(-model.lam * F.coalesce(F.array_max("found"), F.lit(0.0))))).first()[0] or 0.0
    model.k = max(1e-9, n_clean / max(1e-9, spread))
    expected = lambda s: F.log(F.lit(model.k) * F.greatest("n", F.lit(1))) - F.lit(model.lam) * s
    surprise = lambda s: F.when(expected(s) < -18, -expected(s)).otherwise(F.greatest(F.lit(0.0), -F.log(-F.expm1(-F.exp(F.least(expected(s), F.lit(700.0)))))))
    logs = held.select("label", F.transform("found", surprise).alias("logs"))
    most = F.coalesce(F.array_max("logs"), F.lit(0.0))
    beyond = F.aggregate("logs", F.lit(0.0), lambda total, x: total + F.when(x > 1, x).otherwise(0.0))
    rows = logs.select("label", (most + 0.5 * (beyond - F.when(most > 1, most).otherwise(0.0))).alias("e")).collect()  # two numbers for each of MAX_LABELLED documents
    release(held)
    model.slope, model.intercept = _logistic(np.log1p([r["e"] for r in rows]), np.array([float(r["label"] > 0) for r in rows]))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, n_words and the significant ``passages`` (first word, past the last, score, expected number).

    Null and empty texts have no words and the score of no evidence. Every row of ``docs`` gives one row, equal texts
    equal scores. Of segments that tie none is preferred: all are reported. Texts of any length are scanned whole, in
    memory proportional to their words.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the labelled documents' words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64()), ("expected", pa.float64())]))
        for block in blocks(batches, "text"):
            scores, counts, passages = [], [], []
            for text in block["text"].to_pylist():
                words = words_of(text)
                found = m.segments(words)
                n = len(words)
                scores.append(m.score(m.evidence(found, n)))
                counts.append(n)
                passages.append([{"first": a, "last": b, "score": s, "expected": e} for a, b, s in found if (e := m.expected(s, n)) <= SIGNIFICANT])
            yield pa.RecordBatch.from_arrays([block["doc_id"], pa.array(scores, pa.float64()), pa.array(counts, pa.int64()), pa.array(passages, kind)], ["doc_id", "score", "n_words", "passages"])

    return id_text(docs).mapInArrow(lean(run), "doc_id long, score double, n_words long, passages array<struct<first:int,last:int,score:double,expected:double>>")


def classify(docs: DataFrame, labels: DataFrame, bound: int = MAX_LABELLED) -> DataFrame:
    """doc_id, held_out, score, predicted, n_passages. Rows without doc_id are scored and not held out."""
    scored = score(docs, fit(labelled(docs, labels, "toxic", 5, 0, bound)))
    return scored.select("doc_id", F.coalesce(fold(5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose text isn't predicted toxic, with all their columns."""
    toxic = classify(docs, labels).where("predicted = 1 and doc_id is not null").select(F.col("doc_id").alias("id")).distinct()
    return by_ids(docs, materialize(toxic, "toxic"), "left_anti")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))

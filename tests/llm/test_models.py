"""Held-out accuracy of the classifiers, their parts against brute force, and the pipeline."""

import random

import numpy as np
import pytest

import corpus_pipeline
from loomgraph.llm import quality_model, queries, toxicity

LABELS = "doc_id long, quality int, toxic int"


def made_corpus(spark, n=900):
    """Prose with toxic words in a fifth of the texts and junk in another fifth."""
    rng = random.Random(5)
    vocabulary = [f"word{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(n):
        ws = [rng.choice(vocabulary) for _ in range(rng.randrange(20, 120))]
        toxic, junk = rng.random() < 0.2, rng.random() < 0.2
        if toxic:
            for _ in range(3):
                ws.insert(rng.randrange(len(ws)), rng.choice(["vile", "rotten", "filth"]))
        if junk:
            ws = [w.upper() + "!!$$" for w in ws]
        docs.append((i, " ".join(ws), "en", "s", 0))
        if rng.random() < 0.7:
            labels.append((i, int(not junk), int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, LABELS)


@pytest.fixture(scope="module")
def made(spark):
    return made_corpus(spark)


@pytest.mark.parametrize(("classify", "label"), [(toxicity.classify, "toxic"), (quality_model.classify, "quality")])
def test_held_out_accuracy(made, classify, label):
    docs, labels = made
    got = classify(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert len(got) > 100 and (got["predicted"] == got[label]).mean() > 0.97


@pytest.mark.parametrize("classify", [toxicity.classify, quality_model.classify])
def test_odd_rows(spark, made, odd_docs, no_docs, classify):
    _, labels = made
    got = classify(odd_docs, labels).collect()
    assert len(got) == odd_docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert classify(no_docs, labels).count() == 0
    none = spark.createDataFrame([], LABELS)
    assert all(0 <= r["score"] <= 1 for r in classify(odd_docs, none).collect())
    nulls = spark.createDataFrame([(1, None, None), (None, 1, 1), (2, 1, 0), (2, 1, 0)], LABELS)
    assert classify(odd_docs, nulls).count() == odd_docs.count()


def brute_segments(values):
    """All maximal segments by the recursive definition: the best one, then those to its left and right."""

    def within(a, b):
        best = None
        for i in range(a, b):
            total = 0.0
            for j in range(i, b):
                total += values[j]
                if total > 1e-9 and (best is None or total > best[2] + 1e-9 or abs(total - best[2]) <= 1e-9 and j + 1 - i < best[1] - best[0]):
                    best = (i, j + 1, total)
        return [] if best is None else [*within(a, best[0]), best, *within(best[1], b)]

    return within(0, len(values))


def test_segments_equal_the_definition():
    rng = random.Random(7)
    model = toxicity.Model({b"x": 1.03, b"y": 0.37}, 0.21, 1.0, 1.0, 1.0, 0.0)
    for _ in range(150):
        words = [rng.choice([b"x", b"y", b".", b".", b"."]) for _ in range(rng.randrange(30))]
        values = [model.scores.get(w, -model.drift) for w in words]
        got, want = model.segments(words), brute_segments(values)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert np.allclose([s for *_, s in got], [s for *_, s in want])


def test_non_negative_risk_separates():
    rng = np.random.default_rng(0)
    ones = np.ones((500, 1))
    good, bad = (np.hstack([ones, rng.normal(m, 1, (500, 2))]) for m in (2, -2))
    u = np.vstack([good[250:], bad])
    w = quality_model.non_negative_risk(lambda w: (quality_model.risk_sums(good[:250], w), quality_model.risk_sums(u, w)), 0.33, 3)
    assert (good @ w > 0).mean() > 0.95 and (bad @ w < 0).mean() > 0.95


def test_prior_from_tails():
    rng = np.random.default_rng(1)
    for share in (0.2, 0.5, 0.8):
        positive = rng.normal(0.4, 0.2, 20_000)
        unlabelled = np.concatenate([rng.normal(0.4, 0.2, int(20_000 * share)), rng.normal(-0.4, 0.2, int(20_000 * (1 - share)))])
        made = [np.histogram(x, quality_model.BINS, (-1, 1))[0].astype(float) for x in (positive, unlabelled)]
        assert abs(quality_model.prior_from_tails(*made) - share) < 0.05


def test_quality_scores_equal_a_plain_recomputation(made):
    import zlib

    docs, labels = made
    rows = {r["doc_id"]: np.asarray(quality_model.features(r["text"]), np.float32).astype(float) for r in docs.collect()}
    train = [i for i in rows if zlib.crc32(str(i).encode()) % 3 != 1]
    good = {r["doc_id"] for r in labels.where("quality = 1").collect()} & set(train)
    u, p = np.array([rows[i] for i in train]), np.array([rows[i] for i in train if i in good])
    mean, scale = u.mean(0), u.std(0)
    mean[0], scale[0] = 0, 1
    scale[scale < 1e-6] = 1
    z = lambda x: np.clip((x - mean) / scale, -quality_model.CLIP, quality_model.CLIP)
    side = lambda x: (z(x).mean(0), z(x).T @ z(x) / len(x))
    (mp, sp), (mu, su) = side(p), side(u)
    between = np.linalg.solve(sp + su + 1e-3 * np.eye(len(mp)), mp - mu)
    bins = lambda x: np.bincount(np.clip((z(x) @ between + 1) * quality_model.BINS / 2, 0, quality_model.BINS - 1).astype(int), minlength=quality_model.BINS).astype(float)
    w = quality_model.non_negative_risk(lambda w: (quality_model.risk_sums(z(p), w), quality_model.risk_sums(z(u), w)), quality_model.prior_from_tails(bins(p), bins(u)), len(mp))
    for r in quality_model.classify(docs, labels).collect():
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-np.clip(z(rows[r["doc_id"]]) @ w, -30, 30))), abs=1e-4)


def test_toxicity_scores_equal_a_plain_recomputation(made):
    import math

    docs, labels = made
    training = toxicity.labelled(docs, labels, "toxic", 5, 0, 10_000)
    model = toxicity.fit(training)
    rows = [(toxicity.words_of(r["text"]), r["label"]) for r in training.collect()]
    n = [sum(1 for _, label in rows if label == side) for side in (0, 1)]
    scores = {}
    for word in {w for ws, _ in rows for w in ws}:
        clean, toxic = (sum(1 for ws, label in rows if label == side and word in ws) for side in (0, 1))
        prior = toxicity.PRIOR * (clean + toxic) / len(rows)
        yt, yc = toxic + prior, clean + prior
        odds = math.log(yt / (n[1] + toxicity.PRIOR - yt)) - math.log(yc / (n[0] + toxicity.PRIOR - yc))
        if toxic and odds >= toxicity.LEAST_ODDS and odds / math.sqrt(1 / yt + 1 / yc) >= toxicity.LEAST_Z:
            scores[word] = odds
    assert model.scores == pytest.approx(scores, abs=1e-6) and set(scores) == {b"vile", b"rotten", b"filth"}
    clean = [(ws, model.segments(ws)) for ws, label in rows if not label]
    every = [scores.get(w, -toxicity.DRIFT) for ws, _ in clean for w in ws]
    assert np.mean(np.exp(model.lam * np.array(every))) == pytest.approx(1, abs=1e-3) or model.lam > 19.9
    spread = sum(max(len(ws), 1) * math.exp(-model.lam * max((s for *_, s in found), default=0.0)) for ws, found in clean)
    assert model.k == pytest.approx(len(clean) / spread, rel=1e-6)
    evidence = np.array([model.evidence(model.segments(ws), len(ws)) for ws, _ in rows])
    slope, intercept = toxicity._logistic(np.log1p(evidence), np.array([float(label) for _, label in rows]))
    assert (model.slope, model.intercept) == pytest.approx((slope, intercept), rel=1e-4)


def test_repeated_labelled_rows_count_once(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 1), (1, 1, 1), (2, 0, 0)], LABELS)
    got = {(r["doc_id"], r["text"]) for r in toxicity.labelled(docs, labels, "toxic", 1, 7, 100).collect()}
    assert got == {(1, "a"), (2, "c")}


def test_held_out_rows_are_never_learnt_from(spark, made):
    docs, labels = made
    import zlib

    ids = {r["doc_id"] for r in toxicity.labelled(docs, labels, "toxic", 5, 0, 100).collect()}
    assert len(ids) == 100 and all(zlib.crc32(str(i).encode()) % 5 for i in ids)


def test_stages(spark, made, tmp_path):
    docs, labels = made
    copies = docs.where("doc_id < 40").selectExpr("doc_id + 5000 as doc_id", "text", "lang", "source", "n_chars")
    near = docs.where("doc_id < 40").selectExpr("doc_id + 6000 as doc_id", "concat(text, ' tail') as text", "lang", "source", "n_chars")
    (d := tmp_path / "sf").mkdir()
    docs.union(copies).union(near).write.parquet(f"{d}/documents.parquet")
    labels.write.parquet(f"{d}/labels.parquet")
    state = spark.read.parquet(f"{d}/documents.parquet")
    columns, seen = state.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, state, str(d)).write.parquet(f"{d}/{name}")
        state = spark.read.parquet(f"{d}/{name}")
        seen[name] = {r["doc_id"] for r in state.select("doc_id").collect()}
        assert name == "packing" or state.columns == columns
    assert seen["exact_dedup"] < seen["toxicity"] and not {x for x in seen["exact_dedup"] if x < 40}
    assert seen["near_dedup"] < seen["exact_dedup"] and seen["substring_dedup"] == seen["near_dedup"] == seen["packing"]
    ran = corpus_pipeline.run(spark, str(d))
    assert sorted(map(tuple, ran.select("doc_id", "piece", "length").collect())) == sorted(map(tuple, state.select("doc_id", "piece", "length").collect()))


def test_all_stages_take_an_empty_table(spark, made, no_docs, tmp_path):
    _, labels = made
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs, str(tmp_path)).count() == 0


def test_ten_operators_are_registered():
    assert {n.split("_")[0] for n in queries.QUERIES} == {"pipeline", *(f"op{k}" for k in range(1, 11))}

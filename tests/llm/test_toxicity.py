import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from ridepulse.llm import toxicity
from tests_llm import clash, words


def corpus(n=1500, seed=4):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        toxic = i % 9 == 0
        w = words(rng, rng.randrange(20, 200), 3000).split()
        if toxic:
            for _ in range(6):
                w.insert(rng.randrange(len(w)), rng.choice(["vilord", "vilum", "grubby", "grubful", "sniv"]))
        docs.append((i, " ".join(w)))
        if i % 2 == 0:
            labels.append((i, int(toxic)))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    lab = spark.createDataFrame(labels + [(None, 1), (3, None), labels[0]], "doc_id long, toxic int")
    df = clash(spark, docs)
    model = toxicity.fit(df, lab, max_unlabelled=1000, max_positive=1000)
    got = toxicity.score(df, model).collect()
    assert len(got) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert all(r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in got)
    held = [(r.doc_id % 9 == 0, r.predicted == 1) for r in got if r.held_out]
    hits = sum(t and p for t, p in held)
    assert hits >= 0.95 * sum(t for t, _ in held) and hits >= 0.95 * sum(p for _, p in held)
    clean = toxicity.keep_clean(df, model)
    assert clean.columns == df.columns
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in got if not r.predicted}


def test_held_out_labels_are_not_read(spark):
    docs, labels = corpus(400)
    df = clash(spark, docs)
    other = [(i, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, t in labels]
    a, b = (toxicity.fit(df, spark.createDataFrame(x, "doc_id long, toxic int")) for x in (labels, other))
    assert np.array_equal(a.keys, b.keys) and np.array_equal(a.weights, b.weights)


def test_risk_estimator_by_brute_force():
    """One step of training follows the slope of the corrected risk."""
    rng = np.random.default_rng(0)
    docs, found = np.repeat(np.arange(40), 5), rng.integers(0, 12, 200).astype(np.uint64)
    both = np.unique(np.stack([docs.astype(np.uint64), found]), axis=1)
    docs, found = both[0].astype(int), both[1]
    positive, unlabelled = np.arange(40) < 10, np.arange(40) >= 8
    x = np.zeros((40, 12))
    x[docs, found.astype(int)] = 1

    def risk(w, b):
        g = x @ w + b
        loss = lambda z: np.logaddexp(0, -z)
        clean = loss(-g[unlabelled]).mean() - 0.3 * loss(-g[positive]).mean()
        return 0.3 * loss(g[positive]).mean() + max(0.0, clean)

    zero, one = (toxicity.train(docs, found, positive, unlabelled, 0.3, steps=s, rate=1e-3, decay=0.0, least=1, excess=-1e9) for s in (1, 40))
    assert len(one.keys) == 12
    assert risk(one.weights, one.intercept) < risk(zero.weights, zero.intercept) < risk(np.zeros(12), 0.0)
    slope = [(risk(np.eye(12)[i] * 1e-6, 0.0) - risk(np.zeros(12), 0.0)) / 1e-6 for i in range(12)]
    assert all(np.sign(zero.weights[i]) == -np.sign(s) for i, s in enumerate(slope) if abs(s) > 1e-4)


def test_rare_toxic_texts_are_counted_in_the_whole_corpus(spark):
    """0.2 % toxic, about one of them in the unlabelled sample."""
    rng = random.Random(6)
    docs, labels = [], []
    for i in range(10_000):
        w = words(rng, 30, 3000).split()
        if i % 500 < 1:
            for _ in range(6):
                w.insert(rng.randrange(len(w)), rng.choice(["vilord", "vilum", "grubby", "grubful", "sniv"]))
            labels.append((i, 1))
        docs.append((i, " ".join(w)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    model = toxicity.fit(df, spark.createDataFrame(labels, "doc_id long, toxic int"), max_unlabelled=500)
    got = {r.doc_id: r.predicted for r in toxicity.score(df, model).collect()}
    assert sum(got[i] for i, _ in labels) >= 0.9 * len(labels)
    assert sum(got.values()) <= 1.1 * len(labels)


def test_frequencies_equal_a_plain_count(spark):
    texts = ["viley grubby viley", "grubby", "", "other words"]
    keys = np.unique(toxicity.features(["viley grubby absent"])[1])
    df = spark.createDataFrame([(t,) for t in texts], "__text string").repartition(3)
    n, total = toxicity.frequencies(df, keys)
    assert total == 4
    assert n.tolist() == [sum(k in toxicity.features([t])[1] for t in texts) for k in keys]


def test_odd_rows(spark, odd, none):
    df, pairs = odd
    docs, labels = corpus(400)
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(clash(spark, docs), lab)
    got = toxicity.score(df, model).collect()
    assert len(got) == len(pairs)
    assert all(r.held_out for r in got if r.doc_id is None)
    by_text = {}
    for (i, t), r in zip(pairs, df.withColumn("__row", F.monotonically_increasing_id()).join(
            toxicity.score(df, model).select("__row", F.col("score").alias("s")), "__row").orderBy("__row").collect()):
        assert by_text.setdefault(t or "", r.s) == r.s
    assert toxicity.score(none, model).count() == 0 and toxicity.keep_clean(none, model).count() == 0
    empty = toxicity.fit(none, lab)
    assert {r.score for r in toxicity.score(df, empty).collect()} == {0.0}
    no_labels = toxicity.fit(df, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.keep_clean(df, no_labels).count() == len(pairs)

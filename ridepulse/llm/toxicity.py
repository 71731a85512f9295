"""Toxicity (operator 5): a classifier from non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; all other training texts, labelled clean or
not labelled at all, count as unlabelled.  With class prior p the risk of a scorer g is

    p * E_pos[loss(g)] + max(0, E_unl[loss(-g)] - p * E_pos[loss(-g)])

whose second part estimates the risk on clean text; when it would go below zero
(overfitting) the step climbs it instead of descending.  g is linear in the presence
of a text's words and word beginnings (4 and 5 bytes), of those that clearly more positive
than unlabelled texts have, and is trained by Adam in numpy.

Training reads a bounded sample: rows whose id hashes below a cut-off chosen from the
row counts, about ``max_unlabelled`` unlabelled and ``max_positive`` positive texts.
What the corpus decides, the document frequencies that choose the features and the class
prior, is counted over all training rows for the features of the sample.
Scoring reads every whole text.  Rows whose crc32(id as text) mod ``folds`` is 0 are
held out: neither their labels nor their texts are trained on.  A null id is held out.

Null and empty texts have no features: their score is that of the intercept.  Labels
that repeat count once, null labels not at all.  Without any positive every score is 0.
Repeated rows are scored row by row; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridepulse.llm.common import Words, blocks, mix, rows

_BEGINNINGS = (4, 5)
_CELLS = 1 << 30
_CLEAREST = 20
_COMMON = 0.02


@dataclass
class Model:
    """Sorted 64-bit feature hashes with their weights, and the intercept; no positives: an empty model."""

    keys: np.ndarray
    weights: np.ndarray
    intercept: float


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature hash) of the words and word beginnings of a block of texts, with repeats."""
    w = Words(texts)
    docs, found = [w.doc], [w.hash]
    for size in _BEGINNINGS:
        long = np.flatnonzero(w.end - w.start > size)
        start = np.zeros(len(long), dtype=np.uint64)
        for i in range(size):
            start = (start << np.uint64(8)) | w.buf[w.start[long] + i]
        docs.append(w.doc[long])
        found.append(mix(start ^ np.uint64(size << 56)))
    return np.concatenate(docs), np.concatenate(found)


def _known(keys: np.ndarray, docs: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text and place of the key, of the pairs (docs[i], found[i]) that have one of the sorted ``keys``."""
    if not len(keys):
        return docs[:0], np.zeros(0, dtype=np.int64)
    at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
    known = keys[at] == found
    return docs[known], at[known]


def frequencies(texts: DataFrame, keys: np.ndarray) -> tuple[np.ndarray, int]:
    """How many of ``texts`` (__text) have each of the sorted feature ``keys``, and how many texts there are."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros(len(keys) + 1, dtype=np.int64)
        for b in batches:
            texts = b["__text"].tolist()
            for lo, hi in blocks(texts):
                docs, at = _known(keys, *features(texts[lo:hi]))
                n[:-1] += np.bincount(np.unique(docs * np.int64(_CELLS) + at) % _CELLS, minlength=len(keys))
                n[-1] += hi - lo
        place = np.flatnonzero(n)
        yield pd.DataFrame({"place": place, "n": n[place]})

    got = texts.select("__text").mapInPandas(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(len(keys) + 1, dtype=np.int64)
    out[got["place"].to_numpy(dtype=np.int64)] = got["n"]
    return out[:-1], int(out[-1])


def train(docs: np.ndarray, found: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None,
          steps: int = 300, rate: float = 0.05, decay: float = 3e-4, least: int = 4, excess: float = 5.0,
          count: Callable[[np.ndarray], tuple[np.ndarray, int]] | None = None) -> Model:
    """nnPU on presence features: (docs[i], found[i]) pairs without repeats, and two masks over texts.

    A feature is used if it is in ``least`` texts and in more positive texts than its share of the unlabelled ones
    explains, by ``excess`` standard deviations; the ten thousands of others would only fit single texts.  Without
    a given ``prior``, it is read off the ``_CLEAREST`` features: one that only toxic texts have is in the unlabelled ones
    p times as often as in the positives.  (Labelled rows need not have the corpus's share of toxic ones, and a prior
    that is too large makes everything toxic.)  ``count`` gives the unlabelled texts of the whole corpus that have each
    of some features, and the number of all of them; without it, the given texts are the corpus.  The weight decay falls
    with a small prior, as positives weigh only ``prior``.
    """
    keys, seen = np.unique(found, return_counts=True)
    keys = keys[seen >= least]
    docs, cols = _known(keys, docs, found)
    del found, seen
    in_pos = np.bincount(cols[positive[docs]], minlength=len(keys))
    if count:
        maybe = in_pos > 0
        keys, in_pos = keys[maybe], in_pos[maybe]
        docs, cols = docs[maybe[cols]], (np.cumsum(maybe) - 1)[cols[maybe[cols]]]
        in_unl, of_unl = count(keys)
    else:
        in_unl, of_unl = np.bincount(cols[unlabelled[docs]], minlength=len(keys)), int(unlabelled.sum())
    share = (in_unl + 1) / (of_unl + 1)
    expected = share * positive.sum()
    clear = (in_pos - expected) / np.sqrt(expected * (1 - share) + 1e-9)
    often = clear > excess
    if prior is None:
        best = np.flatnonzero(often)[np.argsort(-clear[often], kind="stable")[:_CLEAREST]]
        prior = float(np.median(in_unl[best] / of_unl / (in_pos[best] / positive.sum()))) if len(best) else 0.0
    prior = min(max(prior, 1 / (of_unl + 1)), 0.9)
    decay *= min(1.0, prior / _COMMON)
    place = np.cumsum(often) - 1
    on = often[cols]
    docs, cols, keys = docs[on], place[cols[on]], keys[often]
    del on
    n, d = len(positive), len(keys)
    w, b = np.zeros(d), 0.0
    m, v, mb, vb = np.zeros(d), np.zeros(d), 0.0, 0.0
    n_pos, n_unl = positive.sum(), unlabelled.sum()
    for step in range(1, steps + 1):
        g = np.bincount(docs, w[cols], minlength=n) + b
        says_toxic = 1 / (1 + np.exp(-np.clip(g, -30, 30)))
        as_clean = np.logaddexp(0, g)  # loss(-g)
        clean_risk = as_clean[unlabelled].mean() - prior * as_clean[positive].mean()
        up = unlabelled / n_unl * says_toxic - prior * positive / n_pos * says_toxic  # slope of the clean risk
        slope = -up if clean_risk < 0 else up - prior * positive / n_pos * (1 - says_toxic)
        gw, gb = np.bincount(cols, slope[docs], minlength=d) + decay * w, slope.sum()
        m, mb = 0.9 * m + 0.1 * gw, 0.9 * mb + 0.1 * gb
        v, vb = 0.999 * v + 0.001 * gw * gw, 0.999 * vb + 0.001 * gb * gb
        scale = rate * np.sqrt(1 - 0.999 ** step) / (1 - 0.9 ** step)
        w -= scale * m / (np.sqrt(v) + 1e-8)
        b -= scale * mb / (np.sqrt(vb) + 1e-8)
    return Model(keys, w, float(b))


def score_texts(model: Model, texts: list[str]) -> np.ndarray:
    """Probability of toxic for each text."""
    if not len(model.keys):
        return np.zeros(len(texts))
    out = np.empty(len(texts))
    for lo, hi in blocks(texts):
        docs, found = features(texts[lo:hi])
        at = np.minimum(np.searchsorted(model.keys, found), len(model.keys) - 1)
        known = model.keys[at] == found
        once = np.unique(docs[known] * np.int64(_CELLS) + at[known])
        out[lo:hi] = np.bincount(once // _CELLS, model.weights[once % _CELLS], minlength=hi - lo) + model.intercept
    return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def held_out(doc_id: Column, folds: int = 5) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, max_positive: int = 2000, max_unlabelled: int = 6000,
        prior: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """The model of the training folds of ``docs`` and ``labels`` (id, toxic)."""
    own = rows(docs, id_col, text_col).where(~held_out(F.col("__id"), folds))
    known = labels.select(F.col(id_col).alias("__id"), F.col("toxic").alias("__toxic")).where(
        F.col("__toxic").isNotNull() & F.col("__id").isNotNull() & ~held_out(F.col("__id"), folds)) \
        .groupBy("__id").agg(F.max("__toxic").alias("__toxic"))
    n_toxic = known.agg(F.coalesce(F.sum("__toxic"), F.lit(0))).first()[0]
    if not n_toxic:
        return Model(np.zeros(0, dtype=np.uint64), np.zeros(0), 0.0)
    share = F.pmod(F.xxhash64("__id", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    few = known.where("__toxic = 1").where(share < max_positive / n_toxic).select("__id").limit(2 * max_positive)
    near = own.where(F.col("__id").isNotNull()).join(F.broadcast(few.withColumn("positive", F.lit(True))), "__id", "left") \
        .withColumn("positive", F.coalesce("positive", F.lit(False))) \
        .withColumn("unlabelled", share < max_unlabelled / max(docs.count(), 1)).where("positive OR unlabelled")

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = b["__text"].tolist()
            for lo, hi in blocks(texts):
                docs, found = features(texts[lo:hi])
                order = np.argsort(docs, kind="stable")
                ends = np.searchsorted(docs[order], np.arange(hi - lo + 1))
                found = found[order]
                yield pd.DataFrame({"positive": b["positive"][lo:hi], "unlabelled": b["unlabelled"][lo:hi],
                                    "features": [np.unique(found[i:j]).tobytes() for i, j in zip(ends, ends[1:])]})

    got = near.select("positive", "unlabelled", "__text").mapInPandas(
        extract, "positive boolean, unlabelled boolean, features binary").toPandas()
    positive, unlabelled = got["positive"].to_numpy(dtype=bool), got["unlabelled"].to_numpy(dtype=bool)
    if not positive.any() or not unlabelled.any():
        return Model(np.zeros(0, dtype=np.uint64), np.zeros(0), 0.0)
    docs_of = np.repeat(np.arange(len(got), dtype=np.int32), [len(f) // 8 for f in got["features"]])
    found = np.frombuffer(b"".join(got.pop("features")), dtype=np.uint64)
    return train(docs_of, found, positive, unlabelled, prior, count=lambda keys: frequencies(own, keys))


def score(docs: DataFrame, model: Model, folds: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: __row, id, held_out, score and predicted."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"__row": b["__row"], "__id": b["__id"], "score": score_texts(model, b["__text"].tolist())})

    own = rows(docs, id_col, text_col).select("__row", "__id", "__text")
    scored = own.mapInPandas(run, f"__row long, __id {own.schema['__id'].dataType.simpleString()}, score double")
    return scored.select("__row", F.col("__id").alias(id_col), held_out(F.col("__id"), folds).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model does not call toxic, in one pass and with all their columns."""

    @F.pandas_udf("double")
    def toxic(texts: pd.Series) -> pd.Series:
        return pd.Series(score_texts(model, texts.tolist()))

    return docs.where(toxic(F.coalesce(F.col(text_col), F.lit(""))) < 0.5)

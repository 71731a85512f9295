"""URL filters (operator 10): host word segmentation and a naive Bayes score beside explicit rules.

1. Host and path are cut out of the url; the longest fitting rule, if any, decides.
2. Host names are split into words by unigram Viterbi: every distinct host gives its
   substrings of the lengths that counted words have, a join with the word counts prices the known
   ones, and the cheapest split of each label wins (an unknown word of n letters costs as much as a
   word seen 10 / 10^n times).  Words and hosts may have any length.
3. Multinomial naive Bayes over host words and path tokens (numbers by first digit and
   length), learnt from the pages that rules decide, scores every page; it decides
   where no rule fits.  Tokens are hashed into ``FEATURES`` cells, so the model has a
   fixed size whatever the table's.

Null urls and urls without ``://`` have an empty host and path and no tokens.  Repeated rows and null
ids are judged row by row; with an empty table or no page that a rule decides, the
model says allow.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridepulse.llm.common import written

FEATURES = 1 << 16
_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (host, path, verdict): fixed by the query's contract.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def host_and_path(url: Column) -> tuple[Column, Column]:
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, pattern, 1), UPPER, LOWER), F.regexp_extract(url, pattern, 2)


def best_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """(size, rule, verdict) of the longest rule for this host or a parent domain whose path begins the url's."""
    fits = [F.when(((host == h) | host.endswith("." + h)) & path.startswith(p),
                   F.struct(F.lit(len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
            for h, p, v in rules]
    none = F.lit(None).cast("struct<size:int,rule:string,verdict:string>")
    return F.array_max(F.array(none, *fits))


def text_words(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """(word, n): how often each word stands in the pages' visible text."""
    text = F.regexp_replace(F.coalesce(F.col(html_col), F.lit("")), "<[^>]*>", " ")
    words = pages.select(F.explode(F.split(F.translate(text, UPPER, LOWER), _NOT_WORD)).alias("word"))
    return words.where(F.length("word") > 0).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def split_label(label: str, known: dict[tuple[int, int], int], at: int, total: int) -> list[str]:
    """The most probable words of one label that starts at ``at``; known: counts by (start, length)."""
    log_total = math.log10(max(total, 1))
    priced: dict[int, list[tuple[int, int]]] = {}
    for (start, size), n in known.items():
        if at <= start and start + size <= at + len(label):
            priced.setdefault(start + size - at, []).append((start - at, n))
    best: list[tuple[float, int]] = [(0.0, 0)]
    ahead = 0  # where an unknown word that ends here had best begin
    for end in range(1, len(label) + 1):
        options = [(best[start][0] + math.log10(n) - log_total, start) for start, n in priced.get(end, [])]
        options.append((best[ahead][0] + 1 - log_total - (end - ahead), ahead))
        best.append(max(options))
        if best[end][0] + end > best[ahead][0] + ahead:
            ahead = end
    words, end = [], len(label)
    while end:
        start = best[end][1]
        words.append(label[start:end])
        end = start
    return words[::-1]


def host_words(hosts: DataFrame, counts: DataFrame) -> DataFrame:
    """(host, words) for distinct hosts: each label split by unigram Viterbi over ``counts`` (word, n)."""
    counts = written(counts, "url-words")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hosts = written(hosts.where(F.length("host") > 0), "url-hosts")
    longest = hosts.select(F.max(F.array_max(F.transform(F.split("host", r"\."), F.length)))).first()[0] or 0
    # the lengths of counted words that fit in a label: at most as many numbers as the longest label has characters
    lengths = sorted(r[0] for r in counts.select(F.length("word").alias("size")).where(F.col("size") <= longest).distinct().collect())
    starts = hosts.select("host", F.explode(F.sequence(F.lit(1), F.length("host"))).alias("i"))
    left = F.length("host") - F.col("i") + 1
    parts = starts.select("host", "i", F.explode(F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= left)).alias("size"))
    parts = parts.withColumn("word", F.substring("host", F.col("i"), F.col("size"))).where(~F.col("word").rlike(_NOT_WORD))
    found = parts.join(counts, "word").groupBy("host").agg(
        F.collect_list(F.struct(F.col("i"), F.col("size"), F.col("n"))).alias("found"))

    @F.pandas_udf("array<string>")
    def split(names: pd.Series, priced: pd.Series) -> pd.Series:
        out = []
        for host, spans in zip(names, priced):
            known = {(s["i"] - 1, s["size"]): s["n"] for s in spans} if spans is not None else {}
            words, at = [], 0
            for label in host.split("."):
                words += split_label(label, known, at, total) if label else []
                at += len(label) + 1
            out.append(words)
        return pd.Series(out)

    return hosts.join(found, "host", "left").select("host", split("host", "found").alias("words"))


def url_filter(pages: DataFrame, counts: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES,
               id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per row: id, host, path, rule (or null), verdict, score (probability of block) and the host's words.

    ``rules`` is a short policy list; it becomes one expression.
    """
    host, path = host_and_path(F.col(url_col))
    own = pages.select(F.col(id_col).alias("__id"), host.alias("host"), path.alias("path"))
    own = own.withColumn("fit", best_rule(F.col("host"), F.col("path"), rules))
    names = written(host_words(own.select("host").distinct(), counts), "url-names")

    plain = F.translate(F.col("path"), UPPER, LOWER)
    numbers = F.regexp_replace(plain, "(?<=[0-9])[0-9]", "#")
    tokens = F.concat(
        F.transform(F.coalesce("words", F.array(F.col("host"))), lambda w: F.concat(F.lit("host "), w)),
        F.transform(F.split(numbers, r"[\x00-\x22\x24-\x2F\x3A-\x60\x7B-\x7F]+"), lambda t: F.concat(F.lit("path "), t)))
    cells = F.transform(tokens, lambda t: F.pmod(F.xxhash64(t), F.lit(FEATURES)).cast("int"))
    judged = written(own.join(names, "host", "left").select("__id", "host", "path", "fit", "words", cells.alias("cells")),
                     "url-features")

    weights, prior = naive_bayes(judged.where("fit IS NOT NULL").select(
        "cells", (F.col("fit.verdict") == "block").alias("block")))

    @F.pandas_udf("double")
    def score(cell_lists: pd.Series) -> pd.Series:
        odds = np.array([prior + weights[np.asarray(c, dtype=np.int64)].sum() for c in cell_lists], dtype=float)
        return pd.Series(1 / (1 + np.exp(-np.clip(odds, -30, 30))))

    out = judged.withColumn("score", score("cells"))
    return out.select(F.col("__id").alias(id_col), "host", "path", F.col("fit.rule").alias("rule"),
                      F.coalesce("fit.verdict", F.when(F.col("score") > 0.5, "block").otherwise("allow")).alias("verdict"),
                      "score", "words")


def naive_bayes(labelled: DataFrame) -> tuple[np.ndarray, float]:
    """Log-odds of block for each cell and for a page without tokens, from (cells, block) rows.

    At most ``FEATURES`` rows of counts come to the driver.
    """
    n = labelled.groupBy("block").agg(F.count(F.lit(1)).alias("n")).collect()
    pages = {bool(r["block"]): r["n"] for r in n}
    if not pages:
        return np.zeros(FEATURES), -1e-9
    counts = np.ones((2, FEATURES))
    by_cell = labelled.select(F.explode("cells").alias("cell"), "block").groupBy("cell").agg(
        F.count_if(~F.col("block")).alias("allow"), F.count_if("block").alias("block"))
    for cell, allow, block in by_cell.collect():
        counts[0, cell] += allow
        counts[1, cell] += block
    logs = np.log(counts / counts.sum(axis=1, keepdims=True))
    return logs[1] - logs[0], math.log((pages.get(True, 0) + 1) / (pages.get(False, 0) + 1))

"""License scans (operator 1): diagonal voting.

All rolling word k-gram hashes of all texts are joined in Spark to the k-grams of the
license templates.  A hit at word p of a text and word q of a template votes for the
diagonal p - q; votes are counted per text, template and diagonal.  Neighbouring
diagonals (a few words put in or left out) are merged: from each diagonal on, those at most
``DRIFT`` further.  Merged votes are verified before they make a span: the join compares the words of
a gram as well as its hash, and the places of the template that they stand for, each counted
once, have to be enough of its k-grams (a gram that the text repeats proves one place).  Of overlapping
spans of a template the best one is kept.  Short phrases have to stand in one piece: all their
k-grams on a single diagonal.

Words are the shared ones (``common.WORD``).  A null or empty text has 0 words, no
spans and score 0.  Repeated rows and null ids are scanned row by row; an empty table
gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridepulse.llm.common import Words, blocks, rows, written

K = 3
DRIFT = 3
COVER = 0.8
_FEW = 100_000

#: Phrases whose places are counted, with their labels: fixed by the query's contract.
BASE = [("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")]

#: Opening sentences of public licenses and their usual names, with labels of this method's own.
TEMPLATES = [
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
                 "associated documentation files the software to deal in the software without restriction"),
    ("apache-header", "licensed under the apache license version 2 0 the license you may not use this file except in "
                      "compliance with the license"),
    ("apache", "licensed under the apache license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that "
            "the following conditions are met"),
    ("gpl", "gnu general public license"),
    ("gpl-header", "this program is free software you can redistribute it and or modify it under the terms of the gnu "
                   "general public license as published by the free software foundation"),
    ("lgpl", "gnu lesser general public license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
            "granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc", "licensed under a creative commons attribution"),
]

_VOTES = "__row long, __id {id}, pos int, hash long, gram string"


def template_grams(spark: SparkSession, templates: Sequence[tuple[str, str, bool]], k: int = K) -> DataFrame:
    """(template, q, t_hash, t_gram) for every k-gram of (label, text, exact) templates."""
    found = []
    for number, (label, text, _) in enumerate(templates):
        w = Words([text])
        if w.count(0) < k:
            raise ValueError(f"template {label!r} has fewer than {k} words")
        at, hashes = w.grams(k)
        found += [(number, int(i), int(h), w.text(int(i), k)) for i, h in zip(at, hashes.view(np.int64))]
    return spark.createDataFrame(found, "template int, q int, t_hash long, t_gram string")


def _rolling(hashes: np.ndarray, k: int, schema: pa.Schema):
    """A mapInArrow function: a line with pos -1 for each text (hash: its number of words), and one for each k-gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, row = b.column("__text").to_pylist(), b.column("__row").to_numpy()
            for lo, hi in blocks(texts):
                w = Words(texts[lo:hi])
                own = row[lo:hi]
                yield pa.RecordBatch.from_arrays([
                    pa.array(own), b.column("__id").slice(lo, hi - lo), pa.array(np.full(hi - lo, -1, dtype=np.int32)),
                    pa.array(np.diff(w.first).astype(np.int64)), pa.nulls(hi - lo, pa.string())], schema=schema)
                at, gram = w.grams(k)
                if not len(at):
                    continue
                known = hashes[np.minimum(np.searchsorted(hashes, gram), len(hashes) - 1)] == gram
                hit = np.flatnonzero(known)
                words = [w.text(int(i), k).encode() for i in at[hit]]
                sizes = np.zeros(len(at) + 1, dtype=np.int32)
                sizes[hit + 1] = [len(x) for x in words]
                gram_text = pa.StringArray.from_buffers(
                    len(at), pa.py_buffer(np.cumsum(sizes, dtype=np.int32)), pa.py_buffer(b"".join(words)),
                    pa.py_buffer(np.packbits(known, bitorder="little")))
                yield pa.RecordBatch.from_arrays([
                    pa.array(own[w.doc[at]]), pa.nulls(len(at), schema.field("__id").type),
                    pa.array((at - w.first[w.doc[at]]).astype(np.int32)), pa.array(gram.view(np.int64)), gram_text], schema=schema)
    return run


def license_spans(docs: DataFrame, templates: Sequence[tuple[str, str, bool]], k: int = K, drift: int = DRIFT,
                  cover: float = COVER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Accepted spans: __row, __id, n_words, template, start, end (words), coverage; a line with template null per text."""
    spark = docs.sparkSession
    table = template_grams(spark, templates, k)
    hashes = np.unique(np.concatenate([Words([t]).grams(k)[1] for _, t, _ in templates]))
    own = rows(docs, id_col, text_col)
    kind = own.schema["__id"].dataType
    schema = pa.schema([("__row", pa.int64()), ("__id", _arrow(kind)), ("pos", pa.int32()), ("hash", pa.int64()), ("gram", pa.string())])
    grams = own.mapInArrow(_rolling(hashes, k, schema), _VOTES.format(id=kind.simpleString()))
    few = F.broadcast(table) if len(hashes) <= _FEW else table
    votes = grams.join(few, (F.col("hash") == F.col("t_hash")) & (F.col("gram") == F.col("t_gram")), "left") \
        .where("pos < 0 OR template IS NOT NULL")
    counted = written(votes.groupBy("__row", "template", (F.col("pos") - F.col("q")).alias("diagonal")).agg(
        F.max("__id").alias("__id"), F.max(F.when(F.col("pos") < 0, F.col("hash"))).alias("n_words"),
        F.collect_set("q").alias("places"), F.min("pos").alias("start"), (F.max("pos") + k).alias("end")), "votes")

    sizes = spark.createDataFrame([(i, len(Words([t]).grams(k)[1]), bool(exact)) for i, (_, t, exact) in enumerate(templates)],
                                  "template int, grams int, exact boolean")
    along = Window.partitionBy("__row", "template").orderBy("diagonal")
    near = along.rangeBetween(0, drift)  # at most drift + 1 diagonals of at most a template's places
    merged = counted.where("template IS NOT NULL").join(F.broadcast(sizes), "template")
    all_places = F.size(F.array_distinct(F.flatten(F.collect_list("places").over(near))))
    merged = merged.withColumn("coverage", F.when(F.col("exact"), F.size("places")).otherwise(all_places) / F.col("grams")) \
        .withColumn("start", F.when(F.col("exact"), F.col("start")).otherwise(F.min("start").over(near))) \
        .withColumn("end", F.when(F.col("exact"), F.col("end")).otherwise(F.max("end").over(near))) \
        .where(F.col("coverage") >= F.when(F.col("exact"), 1.0).otherwise(cover))
    apart = F.col("exact") | (F.col("diagonal") - F.lag("diagonal").over(along) > drift)
    spans = merged.withColumn("span", F.sum(F.coalesce(apart, F.lit(True)).cast("int")).over(along)) \
        .groupBy("__row", "template", "span").agg(F.max(F.struct("coverage", -F.col("diagonal"), "start", "end")).alias("best")) \
        .select("__row", "template", "best.start", "best.end", "best.coverage")
    none = counted.where("template IS NULL").select("__row", "__id", "n_words")
    return none.join(spans.select("__row", "template", "start", "end", "coverage"), "__row", "left")


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    return to_arrow_type(kind)


def license_scan(docs: DataFrame, base: Sequence[tuple[str, str]] = BASE, templates: Sequence[tuple[str, str]] = TEMPLATES,
                 id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per row: id, n_words, n_base, first_word, last_word, base_labels, labels, score (the best coverage)."""
    every = [(label, text, True) for label, text in base] + [(label, text, False) for label, text in templates]
    spans = license_spans(docs, every, id_col=id_col, text_col=text_col, **options)
    names = F.array(*[F.lit(label) for label, _, _ in every])
    label, is_base = F.element_at(names, F.col("template") + 1), F.col("template") < len(base)
    join = lambda found: F.array_join(F.array_sort(F.collect_set(found)), ",")
    start = F.when(is_base, F.col("start")).cast("long")
    return spans.groupBy("__row").agg(
        F.max("__id").alias(id_col), F.max("n_words").cast("long").alias("n_words"),
        F.count(F.when(is_base, 1)).alias("n_base"), F.min(start).alias("first_word"), F.max(start).alias("last_word"),
        join(F.when(is_base, label)).alias("base_labels"), join(F.when(F.col("template").isNotNull(), label)).alias("labels"),
        F.coalesce(F.max("coverage"), F.lit(0.0)).alias("score")).drop("__row")

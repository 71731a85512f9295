"""PII (operator 13): information-theoretic sanitisation.  DataFrame functions only.

Base findings are protected entities: email and numeric addresses, card and phone numbers.
Words beside them can give an entity away as well (a name, an account, a birth year), and the
corpus tells which: over all documents, n(c) hold the entity c, n(t) the term t and n(c, t) the
term within ``SCOPE`` characters of the entity.  With N documents the entity carries
IC(c) = log2(N / n(c)) bits, and the term tells PMI(c; t) = log2(N n(c, t) / (n(c) n(t))) of
them.  A term whose share PMI / IC is at least ``DISCLOSURE`` (1: the term occurs only there) is

* generalised if its general form (first letter and length class of a word, number of characters where there are
  digits) tells less than that share: many other terms have the same form;
* removed otherwise.

An estimate needs more than one observation: a pair counts only if the entity was seen in two
or more different surroundings, so copies of one document prove nothing.  Terms are looked for in
texts that hold the entity they tell; texts without a base finding have no spans at all.

Scale.  One pass scans for base findings and writes them with their surroundings (small); one
counts terms by a map-side combined aggregate.  Entities and terms in a third of all rows are counted per
(entity, term, row) first, which no key dominates, and the few telling pairs are joined back
to their places over ``salts`` copies.  Nothing is gathered by entity.

Null texts count as empty: no spans.  Repeated rows count as rows and are scanned one by one; a null id stays null;
extra columns are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridepulse.llm.common import rows, written

#: Fixed by the query's contract; possessive forms of them that match the same and need no deep stack.  A match
#: begins where a run of its first class begins, or where the last match ended.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ["email", "ip", "card", "phone", "generalise", "remove"]
GENERALISE, REMOVE = 4, 5
SCOPE, DISCLOSURE = 80, 0.5
#: A word: ASCII letters of either case, digits, everything that is not ASCII.  Terms are words in small letters.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_PART = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    back = F.transform(F.split(F.reverse(number), ""), lambda d, i: d.cast("int") * (1 + i % 2))
    return F.aggregate(back, F.lit(0), lambda total, d: total + F.floor(d / 10).cast("int") + d % 10) % 10 == 0


def _found(text: Column) -> list[tuple]:
    """Per kind: (pattern, can the text hold a match, is a match kept, the entity it names)."""
    long_enough = lambda m: F.length(_digits(m)).between(16, 19)
    return [
        (EMAIL, text.contains("@"), lambda m: F.lit(True), F.lower),
        (IP, text.rlike(r"[0-9]\.[0-9]"), lambda m: m.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"), lambda m: m),
        (CARD, text.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"), lambda m: F.when(long_enough(m), _luhn(_digits(m))).otherwise(False), _digits),
        (PHONE, text.contains("+"), lambda m: F.length(_digits(m)).between(8, 15), _digits),
    ]


_HIT = "array<struct<kind:int,nth:int,gap:int,size:int,entity:string,before:string,after:string>>"


def _matches(text: Column, kind: int, pattern: str, maybe: Column, keep, entity, scope: int) -> Column:
    """All matches of a kind in order, with the length of the text before each; kept ones with entity and surroundings."""
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    each = F.filter(F.arrays_zip(gaps.alias("gap"), F.slice(gaps, F.lit(2), F.size(gaps)).alias("next"),
                                 F.slice(gaps, F.lit(3), F.size(gaps)).alias("further"), hits.alias("hit")),
                    lambda b: b["hit"].isNotNull())

    def one(b: Column, i: Column) -> Column:
        ok, near = keep(b["hit"]), F.lit(scope)
        # a word that the scope or another match cuts is left out
        before = F.when((i == 0) & (F.length(b["gap"]) <= near), b["gap"]).otherwise(F.regexp_replace(F.right(b["gap"], near), f"^{WORD}", ""))
        after = F.when(b["further"].isNull() & (F.length(b["next"]) <= near), b["next"]) \
            .otherwise(F.regexp_replace(F.left(b["next"], near), f"{WORD}$", ""))
        return F.struct(F.lit(kind).alias("kind"), i.alias("nth"), F.length(b["gap"]).alias("gap"), F.length(b["hit"]).alias("size"),
                        F.when(ok, F.md5(entity(b["hit"]))).alias("entity"), F.when(ok, before).alias("before"),
                        F.when(ok, after).alias("after"))

    return F.when(maybe, F.transform(each, one)).otherwise(F.array()).cast(_HIT)


def entities(docs: DataFrame, scope: int = SCOPE, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """(__row, __id, kind, start, end, entity, before, after) of every base finding, and a line with nulls for every row.

    ``entity`` is the md5 of what is named: the address in small letters, the number's digits.
    """
    own = rows(docs, id_col, text_col, row_col)
    text = F.col("__text")
    head = F.array(F.struct(*[F.lit(v) for v in (None, 0, 0, 0, None, None, None)])).cast(_HIT)
    hits = F.concat(head, *[_matches(text, k, *f, scope) for k, f in enumerate(_found(text))])
    flat = own.select("__row", "__id", F.explode(hits).alias("m")).select("__row", "__id", "m.*")
    so_far = Window.partitionBy("__row", "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("size")).over(so_far)
    return flat.withColumn("end", end).withColumn("start", F.col("end") - F.col("size")) \
        .where("kind IS NULL OR entity IS NOT NULL").select(
            "__row", "__id", "kind", *[F.when(F.col("kind").isNotNull(), F.col(c)).alias(c) for c in ("start", "end")],
            "entity", "before", "after")


def general(term: Column) -> Column:
    """The general form of a term: digits as #, or the first letter and a length class.  No word looks like one."""
    letters = F.concat(F.left(term, F.lit(1)), F.lit("*"), F.least(F.floor(F.length(term) / 4), F.lit(3)).cast("string"))
    return F.when(term.rlike("[0-9]"), F.concat(F.lit("#"), F.length(term).cast("string"))).otherwise(letters)


def _placed_words(text: Column, at: Column) -> Column:
    """(term, start, end) of the words of a short text that begins at ``at``."""
    gaps, hits = F.split(text, WORD, -1), F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    each = F.filter(F.arrays_zip(gaps.alias("gap"), hits.alias("hit")), lambda b: b["hit"].isNotNull())
    word = "struct<term:string,start:long,end:long>"
    first = F.struct(at.cast("long").alias("at"), F.array().cast(f"array<{word}>").alias("words"))

    def add(so_far: Column, b: Column) -> Column:
        start = so_far["at"] + F.length(b["gap"])
        end = start + F.length(b["hit"])
        return F.struct(end.alias("at"), F.concat(so_far["words"], F.array(F.struct(
            F.lower(b["hit"]).alias("term"), start.alias("start"), end.alias("end")))).alias("words"))

    return F.aggregate(each, first, add, lambda done: done["words"])


def surroundings(found: DataFrame) -> DataFrame:
    """(__row, entity, around, term, general, start, end): the words beside every finding, without those that touch it or
    lie in another one."""
    words_before = F.filter(_placed_words(F.col("before"), F.col("start") - F.length("before")), lambda w: w["end"] < F.col("start"))
    words_after = F.filter(_placed_words(F.col("after"), F.col("end")), lambda w: w["start"] > F.col("end"))
    beside = found.where("entity IS NOT NULL").select(
        "__row", "entity", F.xxhash64("before", "after").alias("around"), F.explode(F.concat(words_before, words_after)).alias("w"))
    beside = beside.select("__row", "entity", "around", "w.*")
    # findings and words of a row in order of their starts: the furthest end so far and the next start tell an overlap
    marks = found.where("entity IS NOT NULL").select(
        "__row", F.lit(None).cast("string").alias("entity"), F.lit(None).cast("long").alias("around"), F.lit(None).cast("string").alias("term"),
        "start", "end")
    both = beside.unionByName(marks)
    mark = F.col("term").isNull()
    before = Window.partitionBy("__row").orderBy("start", F.col("term").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("__row").orderBy(F.desc("start"), F.col("term").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    clear = both.withColumn("last", F.max(F.when(mark, F.col("end"))).over(before)) \
        .withColumn("next", F.min(F.when(mark, F.col("start"))).over(after)) \
        .where(~mark & (F.coalesce("last", F.col("start")) <= F.col("start")) & (F.coalesce("next", F.col("end")) >= F.col("end")))
    return clear.select("__row", "entity", "around", "term", general(F.col("term")).alias("general"), "start", "end")


def document_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(term, n): the number of rows that hold each word, and of those that hold each general form."""
    words = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD), F.lit(0)), F.lower))
    terms = docs.select(words.alias("w")).select(F.explode(F.concat("w", F.array_distinct(F.transform("w", general)))).alias("term"))
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def disclosing(beside: DataFrame, found: DataFrame, counts: DataFrame, share: float = DISCLOSURE) -> DataFrame:
    """(entity, term, kind) of the terms that tell at least ``share`` of an entity, and whether to generalise or remove them."""
    n_rows = found.where("kind IS NULL").count()  # one such line per row
    held = found.where("entity IS NOT NULL").groupBy("entity", "__row").agg(F.lit(1).alias("one")) \
        .groupBy("entity").agg(F.count(F.lit(1)).alias("n_c"))
    per_row = beside.select("__row", "entity", "around", "term", F.explode(F.array("term", "general")).alias("form")) \
        .groupBy("entity", "form", "__row").agg(F.min("around").alias("lo"), F.max("around").alias("hi"))
    pairs = per_row.groupBy("entity", "form").agg(F.count(F.lit(1)).alias("n_ct"), F.min("lo").alias("lo"), F.max("hi").alias("hi")) \
        .where("lo < hi").drop("lo", "hi")  # two different surroundings at least
    told = pairs.join(counts.withColumnRenamed("term", "form"), "form").join(held, "entity").where(F.col("n_c") < n_rows)
    ratio = F.log2(F.lit(float(n_rows)) * F.col("n_ct") / (F.col("n_c") * F.col("n"))) / F.log2(F.lit(float(n_rows)) / F.col("n_c"))
    told = written(told.select("entity", "form", (ratio >= share).alias("tells")).where("tells"), "pii-telling")
    words = beside.select("entity", "term", "general").distinct().join(told.withColumnRenamed("form", "term").drop("tells"), ["entity", "term"])
    wide = told.select("entity", F.col("form").alias("general"), "tells")
    return words.join(wide, ["entity", "general"], "left").select(
        "entity", "term", F.when(F.col("tells"), F.lit(REMOVE)).otherwise(F.lit(GENERALISE)).alias("kind"))


def private_data(docs: DataFrame, scope: int = SCOPE, share: float = DISCLOSURE, salts: int = 8, id_col: str = "doc_id",
                 text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """Per row: __row, id and ``spans``, an array of (kind, start, end) sorted by kind and then start, code points, end
    exclusive.  ``kind`` indexes ``KINDS``; 0 to 3 are the base kinds.  A term told by several entities is removed if
    one of them asks for it."""
    found = written(entities(docs, scope, id_col, text_col, row_col), "pii-found")
    beside = written(surroundings(found), "pii-beside")
    telling = written(disclosing(beside, found, document_counts(docs, id_col, text_col), share), "pii-pairs")
    spread = telling.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    terms = beside.withColumn("salt", F.pmod(F.xxhash64("__row"), F.lit(salts)).cast("int")).join(spread, ["entity", "term", "salt"]) \
        .groupBy("__row", "start", "end").agg(F.max("kind").alias("kind"))
    spans = found.select("__row", "__id", "kind", "start", "end").unionByName(
        terms.select("__row", F.lit(None).cast(found.schema["__id"].dataType).alias("__id"), "kind", "start", "end"))
    return spans.groupBy("__row").agg(
        F.max("__id").alias("__id"),
        F.array_sort(F.collect_list(F.when(F.col("kind").isNotNull(), F.struct("kind", "start", "end")))).alias("spans")) \
        .withColumnRenamed("__id", id_col)


def sanitised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, text, n_spans): findings become their kind in brackets, telling terms their general form or nothing.

    Spans that overlap are one span of the first one's kind.
    """
    own = written(rows(docs, id_col, text_col), "pii-texts")
    spans = private_data(own, id_col="__id", text_col="__text", row_col="__row", **options)
    each = spans.select("__row", F.explode("spans").alias("s")).select("__row", "s.*")
    line = Window.partitionBy("__row").orderBy("start", "kind")
    each = each.withColumn("last", F.max("end").over(line.rowsBetween(Window.unboundedPreceding, -1))) \
        .withColumn("nth", F.sum(F.when(F.col("start") < F.col("last"), 0).otherwise(1)).over(line))
    merged = each.groupBy("__row", "nth").agg(F.min(F.struct("start", "kind")).alias("first"), F.max("end").alias("end")) \
        .groupBy("__row").agg(F.array_sort(F.collect_list(F.struct("first.start", "end", "first.kind"))).alias("cuts"))
    text = F.col("__text")
    part = lambda lo, hi: F.substring(text, lo.cast("int") + 1, (hi - lo).cast("int"))
    names = F.array(*map(F.lit, KINDS))

    def shown(s: Column) -> Column:
        return F.when(s["kind"] == REMOVE, F.lit("")).when(s["kind"] == GENERALISE, general(F.lower(part(s["start"], s["end"])))) \
            .otherwise(F.concat(F.lit("["), F.upper(F.element_at(names, s["kind"] + 1)), F.lit("]")))

    before = F.concat(F.array(F.lit(0).cast("long")), F.transform("cuts", lambda s: s["end"]))
    pieces = F.transform("cuts", lambda s, i: F.concat(part(F.element_at(before, i + 1), s["start"]), shown(s)))
    clean = F.concat(F.array_join(pieces, ""), part(F.element_at(before, -1), F.length(text).cast("long")))
    return own.join(merged, "__row", "left").select(
        F.col("__id").alias(id_col), F.when(F.col("cuts").isNull(), text).otherwise(clean).alias(text_col),
        F.coalesce(F.size("cuts"), F.lit(0)).alias("n_spans"))


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")

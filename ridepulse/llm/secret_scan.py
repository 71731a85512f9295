"""Secret scans (operator 7): multipart credential linking by an interval join.  DataFrame functions only.

Strong findings stand on their own: assignments to secret-like names (``assign``),
access identifiers (``access``) and long hexadecimal strings (``hex``).  Weak ones are
common in clean text and count only beside the parts that make them usable:

* ``weak_id``: a user or account name that is assigned, near a secret;
* ``weak_secret``: a short value assigned to a secret-like name, or a 40-character
  base64 run with capitals, small letters and digits, near an identifier or endpoint;
* ``endpoint``: a url or a numeric address, near both an identifier and a secret.

"Near" is a scope of ``scope`` characters between the parts' starts.  Parts are joined
on (row, scope number) with the three scope numbers a part can reach, so the join is an
equi-join and, as parts of a kind do not overlap, a part meets a bounded number of
others.  A weak part inside a strong one is that strong one.

Null texts count as empty: no spans.  Repeated rows, null ids and clashing extra columns
are scanned row by row; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridepulse.llm.common import rows, written

#: Kinds in the order in which equal starts are listed: (name, pattern, role, test of a match).  The first
#: three patterns and their least lengths are fixed by the query's contract.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"  # AKIA[A-Z0-9]+ of 16 and more
HEX = r"[0-9a-f]{32,}"  # [0-9a-f]+ of 32 and more: a run is never cut
WEAK_ID = r"""(?i)(?:user(?:name)?|login|account|client_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]{3,})"""
BASE64 = r"[A-Za-z0-9+/]{40,}"
ENDPOINT = r"(?:https?|ftp|ssh|jdbc:[a-z]+|postgres(?:ql)?|mysql|redis|mongodb)://[^\s\"'<>]+|\b\d{1,3}(?:\.\d{1,3}){3}(?::\d+)?\b"
KINDS = ["assign", "access", "hex", "weak_id", "weak_secret", "endpoint"]


def _value(match: Column) -> Column:
    return F.length(F.regexp_extract(match, ASSIGN, 2))


def _found(text: Column) -> list[tuple[str, Column, Column]]:
    """(pattern, kind number or null if the match is dropped, text searched)."""
    return [
        (ASSIGN, lambda m: F.when(_value(m) >= 8, 0).when(_value(m) >= 4, 4)),
        (ACCESS, lambda m: F.lit(1)),
        (HEX, lambda m: F.lit(2)),
        (WEAK_ID, lambda m: F.lit(3)),
        (BASE64, lambda m: F.when((F.length(m) == 40) & m.rlike("[A-Z]") & m.rlike("[a-z]") & m.rlike("[0-9]"), 4)),
        (ENDPOINT, lambda m: F.lit(5)),
    ]


def _matches(text: Column, number: int, pattern: str, kind) -> Column:
    """All matches of a pattern in order, each with the length of the text between it and the one before."""
    both = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))
    return F.when(text.rlike(pattern), F.transform(F.filter(both, lambda b: b["hit"].isNotNull()), lambda b, i: F.struct(
        F.lit(number).alias("pattern"), i.alias("nth"), F.length(b["gap"]).alias("gap"),
        F.length(b["hit"]).alias("size"), kind(b["hit"]).cast("int").alias("kind")))).otherwise(
        F.array().cast("array<struct<pattern:int,nth:int,gap:int,size:int,kind:int>>"))


def parts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(__row, __id, kind, start, end) of every strong or weak part, and one line with nulls for every row."""
    own = rows(docs, id_col, text_col)
    head = F.array(F.struct(*[F.lit(v).cast("int").alias(c) for c, v in
                              (("pattern", None), ("nth", 0), ("gap", 0), ("size", 0), ("kind", None))]))
    hits = F.concat(head, *[_matches(F.col("__text"), i, p, k) for i, (p, k) in enumerate(_found(F.col("__text")))])
    flat = own.select("__row", "__id", F.explode(hits).alias("m")).select("__row", "__id", "m.*")
    so_far = Window.partitionBy("__row", "pattern").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("size")).over(so_far)
    placed = flat.withColumn("end", end).withColumn("start", F.col("end") - F.col("size"))
    return placed.where("pattern IS NULL OR kind IS NOT NULL").select(
        "__row", "__id", "kind", *[F.when(F.col("kind").isNotNull(), F.col(c)).alias(c) for c in ("start", "end")])


def link(found: DataFrame, scope: int = 400) -> DataFrame:
    """The weak parts of ``parts`` that have their complements within ``scope`` characters."""
    found = found.where("kind IS NOT NULL").withColumn("place", F.floor(F.col("start") / scope))
    before = Window.partitionBy("__row").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, 0)
    strong_end = F.max(F.when(F.col("kind") < 3, F.col("end"))).over(before)
    after = Window.partitionBy("__row").orderBy(F.desc("start"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0)
    strong_start = F.min(F.when(F.col("kind") < 3, F.col("start"))).over(after)
    weak = found.withColumn("strong_end", strong_end).withColumn("strong_start", strong_start).where(
        (F.col("kind") >= 3) & (F.coalesce("strong_end", F.lit(-1)) <= F.col("start"))
        & (F.coalesce("strong_start", F.col("end")) >= F.col("end")))
    reach = weak.select("__row", F.col("kind").alias("weak"), F.col("start").alias("from"), F.col("end").alias("to"),
                        F.explode(F.array(F.col("place") - 1, F.col("place"), F.col("place") + 1)).alias("place"))
    role = F.when(F.col("kind").isin(1, 3), 1).when(F.col("kind").isin(0, 2, 4), 2).otherwise(4)
    others = found.select("__row", "place", "start", role.alias("role"))
    met = reach.join(others, ["__row", "place"]).where((F.abs(F.col("start") - F.col("from")) <= scope))
    roles = met.groupBy("__row", "weak", "from", "to").agg(F.bit_or("role").alias("roles"))
    beside = F.when(F.col("weak") == 3, F.col("roles").bitwiseAND(2) != 0) \
        .when(F.col("weak") == 4, F.col("roles").bitwiseAND(5) != 0).otherwise(F.col("roles").bitwiseAND(3) == 3)
    return roles.where(beside).select("__row", F.col("weak").alias("kind"), F.col("from").alias("start"), F.col("to").alias("end"))


def secret_scan(docs: DataFrame, scope: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id and ``spans``, an array of (start, kind, end) sorted by start and then kind, code points, end exclusive.

    ``kind`` indexes ``KINDS``; 0 to 2 are the strong kinds.
    """
    found = written(parts(docs, id_col, text_col), "secret-parts")
    linked = link(found, scope).withColumn("__id", F.lit(None).cast(found.schema["__id"].dataType))
    strong = found.select("__row", "__id", *[F.when(F.col("kind").isNull() | (F.col("kind") < 3), F.col(c)).alias(c)
                                             for c in ("kind", "start", "end")])
    spans = strong.unionByName(linked).groupBy("__row").agg(
        F.max("__id").alias("__id"),
        F.array_sort(F.collect_list(F.when(F.col("kind").isNotNull(), F.struct("start", "kind", "end")))).alias("spans"))
    return spans.select(F.col("__id").alias(id_col), "spans")


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")

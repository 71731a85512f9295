import hashlib
import random
import zlib

import pytest

from ridepulse.llm.merkle import digest, fold, manifest
from ridepulse.llm.queries import op11_merkle_manifest, table

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, pos int, no long, total string, leaf int, root string, "
          "block int, part int, __id string, __group int, __row double")


def frame(spark, rows):
    return spark.createDataFrame([(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"], 1, 2, "x", 3, "r", 4, 5, "i", 6, 0.5)
                                  for r in rows], SCHEMA)


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i:i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def siblings(levels, i):
    out = []
    for nodes in levels[:-1]:
        out.append((i % 2 == 1, nodes[i ^ 1]) if i ^ 1 < len(nodes) else None)
        i //= 2
    return out


def brute(rows):
    def leaf(r):
        return h(*["-" if r[f] is None else f"{len(str(r[f]).encode())}:{r[f]}" for f in FIELDS])

    groups, out = {}, []
    for r in rows:
        forged = dict(r)
        if r["doc_id"] is not None and r["n_chars"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0:
            forged["n_chars"] += 1
        groups.setdefault(r["lang"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r), leaf(forged), r["doc_id"]))
    langs = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = [tree([x[2] for x in sorted(groups[g])]) for g in langs]
    top = tree([t[-1][0] for t in trees])
    for g, lang in enumerate(langs):
        for i, (_, _, own, forged, doc_id) in enumerate(sorted(groups[lang], key=lambda x: x[:3])):
            path, node = siblings(trees[g], i) + siblings(top, g), forged
            for s in path:
                node = h(node) if s is None else h(s[1], node) if s[0] else h(node, s[1])
            out.append((doc_id, own, trees[g][-1][0], top[-1][0], h(*[s[1] for s in path if s]), node, node == top[-1][0]))
    return sorted(out, key=str)


def some(rng, n, langs):
    rows = [dict(doc_id=rng.choice([i, i, i, i % 5, None, -i]), text=rng.choice([None, "", "é日😀", f"t{i}", "x" * 3000]),
                 lang=rng.choice(langs), source=rng.choice([None, "", "s"]), n_chars=rng.choice([None, 0, 9, 2 ** 63 - 1])) for i in range(n)]
    return rows + rows[:3]


@pytest.mark.parametrize("n,langs,bits,parts", [
    (0, ["a"], 2, 1), (1, ["a"], 2, 1), (37, ["a"], 1, 5), (64, ["a", "b", None, "é", "z", "y", ""], 2, 3),
    (150, ["a"] * 30 + [str(i) for i in range(30)] + [None], 2, 9), (200, ["a"] * 9 + ["b"], 10, 4)])
def test_every_column_equals_a_plain_tree(spark, n, langs, bits, parts):
    rows = some(random.Random(n), n, langs)
    got = manifest(frame(spark, rows).repartition(parts), bits=bits).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_registered_query_equals_a_plain_tree(spark):
    sf = "/root/testdata/sf0.001"
    rows = [r.asDict() for r in table(spark, sf, "documents").collect()]
    got = op11_merkle_manifest(spark, sf).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)
    assert {r.verified for r in got} == {True, False} and len({r.root for r in got}) == 1


def test_places_hold_when_the_scans_are_split_differently(spark, tmp_path):
    """The number of cores decides how a table is split; the result is the same."""
    rows = some(random.Random(9), 300, ["a", "a", "b"])
    frame(spark, rows).repartition(6).write.parquet(f"{tmp_path}/t")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        got = manifest(spark.read.parquet(f"{tmp_path}/t"), bits=3)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1g")
        assert sorted(map(tuple, got.collect()), key=str) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_fold():
    assert digest("a", "b") == h("a", "b")
    assert fold("x", ["<l", "", ">r"]) == h(h(h("l", "x")), "r")

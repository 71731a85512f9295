import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from ridepulse.llm import near_dup
from ridepulse.llm.common import WORD, Words, written
from ridepulse.llm.graph import components, grown
from ridepulse.llm.near_dup import _open, _packed, _prefixes, aligned, keep_one, labelled_shingles, near_duplicates, similar, sketch
from tests_llm import clash, words


def shingles(t, k=5):
    w = re.findall(WORD, (t or "").lower())
    k = min(k, len(w))
    seen, out = Counter(), []
    for i in range(len(w) - k + 1 if k else 0):
        g = tuple(w[i:i + k])
        out.append((g, seen[g]))
        seen[g] += 1
    return out


def common(x, y):
    """Longest common subsequence by the plain table."""
    row = [0] * (len(y) + 1)
    for a in x:
        last = 0
        for j, b in enumerate(y):
            last, row[j + 1] = row[j + 1], (last + 1 if a == b else max(row[j], row[j + 1]))
    return row[-1]


def is_similar(x, y):
    c = common(x, y)
    return c > 0 and c >= 0.8 * (len(x) + len(y) - c) - 1e-9


def edited(rng, t, n):
    w = t.split()
    for _ in range(n):
        i = rng.randrange(len(w))
        w[i:i + 1] = rng.choice([[], ["zz"], [w[i], f"q{rng.randrange(50)}"]])
    return " ".join(w)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(21)
    out = []
    for n in (7, 12, 28, 33, 60, 200, 400):
        for _ in range(4):
            t = words(rng, n, 900)
            out += [t] + [edited(rng, t, rng.randrange(1 + n // 30) + (rng.random() < 0.3)) for _ in range(4)]
    hub = words(rng, 150, 900)
    out += [edited(rng, hub, 5) for _ in range(40)] + [out[0]] * 5
    return out


def classes(pairs):
    """Connected components by comparing all pairs."""
    sh = [shingles(t) for _, t in pairs]
    comp = list(range(len(pairs)))

    def top(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(pairs)):
        for j in range(i):
            if sh[i] == sh[j] or (min(len(sh[i]), len(sh[j])) >= 0.8 * max(len(sh[i]), len(sh[j]))
                                  and len(set(sh[i]) & set(sh[j])) >= 0.4 * (len(sh[i]) + len(sh[j])) and is_similar(sh[i], sh[j])):
                comp[top(i)] = top(j)
    groups = defaultdict(set)
    for i in range(len(pairs)):
        groups[top(i)].add(i)
    return {frozenset(g) for g in groups.values()}


def test_alignment_equals_the_plain_table(texts):
    rng = random.Random(2)
    for _ in range(300):
        a = rng.choice(texts)
        b = rng.choice([edited(rng, a, rng.randrange(6)), rng.choice(texts), " ".join(sorted(a.split()))])
        x, y = shingles(a), shingles(b)
        hx, hy = (labelled_shingles(Words([t]).hash) for t in (a, b))
        assert len(hx) == len(x) and len(set(hx.tolist())) == len(x)
        assert similar(hx, hy) == is_similar(x, y)
        if is_similar(x, y):
            assert aligned(hx, hy) == common(x, y)


def test_sketches_keep_order():
    x = labelled_shingles(np.arange(200, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    assert len(sketch(x)) == 64 and np.array_equal(sketch(x), sketch(x.copy()))
    assert not set(sketch(x).tolist()) & set(sketch(x[::-1].copy()).tolist())
    assert len(sketch(x[:26])) == 80 and len(sketch(x[:1])) == 16 and len(sketch(x[:0])) == 0


def test_classes_equal_all_pairs(spark, texts):
    pairs = list(enumerate(texts))
    got = near_duplicates(written(clash(spark, pairs).repartition(3), "test")).collect()
    by_class = defaultdict(set)
    for r in got:
        by_class[r.class_id].add(r.doc_id)
    assert len(got) == len(pairs) and {frozenset(g) for g in by_class.values()} == classes(pairs)
    assert all(r.class_id == min(by_class[r.class_id]) and r.class_size == len(by_class[r.class_id]) for r in got)
    assert sum(r.kept for r in got) == len(by_class)


def test_a_hot_header_hides_no_pair(spark):
    """Pairs that mostly meet in large buckets of a common header, where no centre is like them."""
    rng = random.Random(8)
    header, pairs = words(rng, 20, 10**6), []
    for i in range(80):
        own = words(rng, 2, 10**6)
        pairs += [(2 * i, f"{header} {own} {words(rng, 2, 10**6)}"), (2 * i + 1, f"{header} {own} {words(rng, 2, 10**6)}")]
    want = classes(pairs)
    assert len(want) == 80
    by_class = defaultdict(set)
    for r in near_duplicates(written(spark.createDataFrame(pairs, "doc_id long, text string").repartition(3), "test")).collect():
        by_class[r.class_id].add(r.doc_id)
    assert {frozenset(g) for g in by_class.values()} == want


def test_open_buckets_equal_a_plain_loop(spark):
    """Buckets of several components are found over many shards; their members come back whole."""
    rng = random.Random(4)
    members = {(r, b) for r in range(900) for b in rng.sample(range(40), 3)}
    members = {(r, b) for r, b in members if b % 4 or r < 450 and r % 3 == b % 3}
    size = Counter(b for _, b in members)
    comp = {r: r % 3 for r in range(600)}  # the others have no link yet
    df = spark.createDataFrame([(r, 10, 5, b, size[b]) for r, b in sorted(members)], "__row long, n long, pop long, bucket long, size long")
    comps = spark.createDataFrame(list(comp.items()), "node long, comp long")
    packed = _packed(df)
    assert packed.select("shard").distinct().count() > 1
    for above in (1, 60):
        of = defaultdict(set)
        for r, b in members:
            of[b].add(comp.get(r, r))
        want = {(r, b, comp.get(r, r), size[b]) for r, b in members if size[b] > above and len(of[b]) > 1}
        got = [(m["__row"], m["bucket"], m["comp"], m["size"]) for m in _open(packed, comps, above).collect()]
        assert len(got) == len(want) and set(got) == want and len(want) < len(members)
    assert _open(packed, comps, 10**6).count() == 0 == _open(_packed(df.limit(0)), comps, 1).count()


@pytest.mark.parametrize("part", [1 << 17, 64])
def test_first_shingles_equal_a_plain_loop(spark, texts, monkeypatch, part):
    """Shingles that join components, with the lengths that allow it, over one shard and over many; a text is one row until then."""
    stages = {}

    def kept(df, name):
        stages[name] = written(df, name)
        return stages[name]

    monkeypatch.setattr(near_dup, "PART", part)
    monkeypatch.setattr(near_dup, "written", kept)
    own = [(i, i % 7, len(shingles(t)), t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(own, "__row long, comp long, n long, __text string").repartition(3)
    got = [(r["__row"], r["n"], r["bucket"], round(r["upto"], 4)) for r in _prefixes(df, 5, 0.8).collect()]
    hashes = [labelled_shingles(Words([t]).hash).view(np.int64).tolist() for t in texts]
    known = near_dup._heavy(df, 5, near_dup.HEAVY)
    rank = {b: i + 1 for i, b in enumerate(known)}
    each, of = [], defaultdict(list)
    for (row, comp, n, _), h in zip(own, hashes):
        for at, b in enumerate(sorted(h, key=lambda b: (rank.get(b, 0), b))[:n - int(np.ceil(n * 0.8 - 1e-6)) + 1], 1):
            each.append((row, n, b, min(n / 0.8, (n - at + 1) * 2.25 - n) + 1e-6))
            of[b].append((n, comp))
    want = {(r, n, b, round(u, 4)) for r, n, b, u in each if len({c for _, c in of[b]}) > 1 and u >= min(of[b])[0]}
    assert len(got) == len(want) and set(got) == want and 0 < len(want) < len(each)
    assert stages["prefixes"].count() == len(texts) and (stages["prefixes"].select("shard").distinct().count() > 1) == (part == 64)
    assert _prefixes(df.limit(0), 5, 0.8).count() == 0


def test_odd_rows(spark, odd, none):
    df, pairs = odd
    got = near_duplicates(df).collect()
    assert len(got) == len(pairs)
    empty = [r for r in got if r.doc_id in (1, 2, 5)]
    assert all(r.class_size == 4 for r in empty)  # with the null id's null text
    assert next(r for r in got if r.doc_id == 6).class_id == 6 == next(r for r in got if r.doc_id == 7).class_id
    kept = keep_one(df)
    assert kept.columns == df.columns and kept.count() == sum(r.kept for r in got) == 7
    assert near_duplicates(none).count() == 0 and keep_one(none).count() == 0


def test_components(spark):
    rng = random.Random(3)
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(500, i) for i in range(501, 560)]
    extra = [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(60)]
    edges = [(a, b) for a, b in chain + star + extra if a != b]
    rng.shuffle(edges)
    got = {r.node: r.comp for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    comp = {n: n for e in edges for n in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(comp[a], comp[b])
            changed |= comp[a] != m or comp[b] != m
            comp[a] = comp[b] = m
    assert got == comp
    for cut in (0, 1, 90, len(edges)):  # the same by adding the rest of the links later
        first, later = (spark.createDataFrame(part, "a long, b long") for part in (edges[:cut], edges[cut:]))
        assert {r.node: r.comp for r in grown(components(first), later).collect()} == comp
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("numbers, joined", [(near_dup.NUMBERS, "BroadcastHashJoin"), (0, "SortMergeJoin")])
def test_texts_are_picked_without_a_shuffle(spark, texts, monkeypatch, numbers, joined):
    """Representatives and texts in shared buckets are picked by broadcast row numbers up to the bound, else by a join of both sides."""
    plans = {}

    def seen(df, name):
        plans.setdefault(name, df._jdf.queryExecution().sparkPlan().toString())
        return written(df, name)

    monkeypatch.setattr(near_dup, "written", seen)
    monkeypatch.setattr(near_dup, "NUMBERS", numbers)
    pairs = list(enumerate(texts[:25] + texts[-20:]))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = near_duplicates(spark.createDataFrame(pairs, "doc_id long, text string")).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    by_class = defaultdict(set)
    for r in got:
        by_class[r.class_id].add(r.doc_id)
    assert len(got) == len(pairs) and {frozenset(g) for g in by_class.values()} == classes(pairs)
    assert joined in plans["texts"] and (joined == "SortMergeJoin") == ("SortMergeJoin" in plans["texts"])

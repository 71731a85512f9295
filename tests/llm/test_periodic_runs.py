import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np

from ridepulse.llm.periodic_runs import all_runs, collapsed, periodic_runs, runs
from ridepulse.llm.queries import op12_periodic_runs, table
from tests_llm import clash

SF = "/root/testdata/sf0.001"


def brute(w):
    """Runs by trying every period at every place."""
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            seg = w[i:j + q]
            if len(seg) >= max(6, 4 * q) and not any(seg[r:] == seg[:-r] for r in range(1, q)):
                out.append((i, len(seg), q))
            i = max(j, i + 1)
    return sorted(out, key=lambda t: (t[0], t[2]))


def expected(doc_id, text, planted):
    w = re.findall("[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if planted and h % 10 == 0 and w:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, len(w))]
    found = brute(w)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else None
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            sha("".join("%d,%d,%d\n" % r for r in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_runs_equal_brute_force():
    rng, many = random.Random(1), 0
    for _ in range(500):
        docs = []
        for _ in range(rng.randrange(1, 4)):
            n, letters = rng.randrange(60), rng.choice([1, 2, 2, 3, 5])
            w = [rng.randrange(letters) for _ in range(n)]
            if n and rng.random() < 0.5:
                p, s = rng.randrange(1, n + 1), rng.randrange(n)
                w = w[:s] + [w[min(n - 1, s + i % p)] for i in range(n - s)]
            docs.append(w)
        got = runs(np.array([x for w in docs for x in w], dtype=np.int64), np.repeat(np.arange(len(docs)), [len(w) for w in docs]))
        want, first = [], 0
        for w in docs:
            want += [(s + first, n, q) for s, n, q in brute(w)]
            first += len(w)
        assert list(zip(*(x.tolist() for x in got))) == want
        many += len(want)
    assert many > 300


def texts():
    rng, out = random.Random(4), []
    for _ in range(150):
        unit = [rng.choice(["a", "b", "c", "é", "日本"]) for _ in range(rng.randrange(1, 8))]
        out.append(rng.choice([" ", "\n", "\t \r"]).join(
            [f"x{rng.randrange(9)}" for _ in range(rng.randrange(9))] + unit * rng.randrange(1, 9) + unit[:rng.randrange(1, 8)]))
    return out


def test_query_columns_equal_brute_force(spark):
    pairs = list(enumerate(texts())) + [(None, "a a a a a a a"), (None, None), (3, ""), (4, " \n"), (5, "b c " * 9), (5, "b c " * 9),
                                        (6, "\x0b\x0cx y " * 8), (7, "a" * 50_000)]
    got = periodic_runs(clash(spark, pairs).repartition(3), planted=True).collect()
    assert sorted(map(tuple, got), key=str) == sorted((expected(i, t, True) for i, t in pairs), key=str)


def test_registered_query_on_whole_documents(spark):
    docs = {r.doc_id: r.text for r in table(spark, SF, "documents").collect() if len(r.text) < 8000}
    got = {r.doc_id: tuple(r) for r in op12_periodic_runs(spark, SF).collect()}
    assert len(got) == table(spark, SF, "documents").count()
    assert all(got[i] == expected(i, t, True) for i, t in docs.items())
    assert sum(r[1] > 0 for r in got.values()) > 10


def test_every_run_and_the_collapsed_text(spark, odd, none):
    df = clash(spark, [(1, "a b a b a b a b c"), (2, "x y z"), (3, None), (None, "q " * 40)])
    assert sorted(map(tuple, all_runs(df).collect()), key=str) == [(1, 0, 8, 2), (None, 0, 40, 1)]
    assert {r.doc_id: r.text for r in collapsed(df).collect()} == {1: "a b c", 2: "x y z", 3: "", None: "q"}
    assert periodic_runs(odd[0]).count() == len(odd[1])
    assert periodic_runs(none).count() == all_runs(none).count() == collapsed(none).count() == 0

import random
import re

import pytest

from ridepulse.llm.common import WORD
from ridepulse.llm.decontaminate import contained, drop_contaminated
from tests_llm import clash, words


def shingles(t, k=5):
    w = re.findall(WORD, (t or "").lower())
    k = min(k, len(w))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if k else set()


def held(t, size):
    w = re.findall(WORD, (t or "").lower())
    return {tuple(w[i:i + size]) for i in range(len(w) - size + 1)}


def brute(docs, items):
    out = []
    for d, t in docs:
        for i, x in items:
            s = shingles(x)
            if s and len(s & held(t, len(next(iter(s))))) >= 0.8 * len(s) - 1e-9:
                out.append((d, i, len(s), len(s & held(t, len(next(iter(s)))))))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def cases():
    rng = random.Random(9)
    items = [(i, words(rng, rng.choice([1, 2, 4, 5, 6, 9, 17, 40, 70]), 12 if i % 4 == 0 else 3000)) for i in range(60)]
    items += [(100, None), (101, ""), (102, items[3][1]), (None, items[4][1])]
    docs = []
    for d in range(150):
        t = words(rng, rng.choice([0, 3, 50, 800]), 3000).split()
        x = (rng.choice(items)[1] or "").split()
        for _ in range(rng.randrange(4)):  # edits around the threshold
            if x:
                x[rng.randrange(len(x))] = f"new{rng.randrange(99)}"
        at = rng.randrange(len(t) + 1)
        docs.append((d, " ".join(t[:at] + x + t[at:])))
    return docs, items


def test_equals_brute_force(spark, cases, odd):
    docs, items = cases
    docs = docs + odd[1]
    df, bench = clash(spark, docs).repartition(3), clash(spark, items, "item_id")
    for block in (1_000_000, 60):
        got = contained(df, bench, block_shingles=block).select("doc_id", "item_id", "n_shingles", "shared").collect()
        assert sorted(map(tuple, got), key=str) == brute(docs, items)
    kept = drop_contaminated(df, bench, block_shingles=60)
    dirty = {str(d) for d, *_ in brute(docs, items)}
    assert kept.columns == df.columns
    assert sorted((r.doc_id, r.text) for r in kept.where("doc_id < 1000 AND doc_id >= 12").collect()) == \
        sorted((d, t) for d, t in docs if d is not None and d >= 12 and str(d) not in dirty)


def test_empty_tables(spark, cases, none):
    docs, items = cases
    df, bench = clash(spark, docs), clash(spark, items, "item_id")
    assert contained(none, bench).count() == 0
    assert contained(df, clash(spark, [], "item_id")).count() == 0
    assert drop_contaminated(df, clash(spark, [], "item_id")).count() == len(docs)

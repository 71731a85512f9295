import hashlib
from collections import Counter

import pytest

from ridepulse.llm.sharding import fill, place
from tests_llm import clash

SHARDS = [f"shard-{i:02d}" for i in range(12)]


def test_equal_shares_and_few_moves():
    table = fill(SHARDS, 10007)
    n = Counter(table)
    assert max(n.values()) - min(n.values()) <= 1 and len(n) == 12
    fewer = fill(SHARDS[:-1], 10007)
    moved = sum(a != b for a, b in zip(table, fewer) if a != 11)
    assert moved < 0.35 * 10007
    assert fill(["a"], 2) == [0, 0]


def test_turns_by_brute_force():
    """Every shard's k-th claim is the first slot of its preference order not yet taken."""
    table, taken = fill(SHARDS[:5], 101), {}
    order = []
    for s in SHARDS[:5]:
        off, skip = (int.from_bytes(hashlib.md5(f"{salt}:{s}".encode()).digest()[:8], "big") for salt in ("offset", "skip"))
        order.append([(off + j * (skip % 100 + 1)) % 101 for j in range(101)])
    turn = 0
    while len(taken) < 101:
        slot = next(x for x in order[turn % 5] if x not in taken)
        taken[slot] = turn % 5
        turn += 1
    assert table == [taken[i] for i in range(101)]


def test_rows(spark, odd, none):
    df, pairs = odd
    got = place(df, SHARDS, slots=101).select("doc_id", "slot", "shard").collect()
    table = fill(SHARDS, 101)
    want = []
    for i, _ in pairs:
        slot = int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:8], 16) % 101
        want.append((i, slot, SHARDS[table[slot]]))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert place(none, SHARDS).count() == 0
    twice = place(place(clash(spark, [(1, "a")]), SHARDS), SHARDS)
    assert twice.columns.count("shard") == 1


@pytest.mark.parametrize("shards,slots", [([], 101), (["a", "a"], 101), (["a"], 100), (["a", "b", "c"], 2)])
def test_bad_tables(shards, slots):
    with pytest.raises(ValueError):
        fill(shards, slots)

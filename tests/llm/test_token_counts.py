import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from ridepulse.llm.packing import SumOfSquares, pack
from ridepulse.llm.token_counts import _prefixes, fit, prefix_counts, prefix_tables, token_counts
from ridepulse.llm.tokens import WordTokenizer, tokenizer

TEXTS = ["", " ", "It's A1 12'S don't <|endoftext|> x", "<|ENDOFTEXT|>a", "Thedni onheretionshon, eronouen!!",
         "éa b c\u0085d\x1fe\x0bf", "ΑΣ ΟΔΟΣ 日本 \U0001F600x é İst ﬁ ſtrange", "they'll  \n we're",
         "a" * 90, "Keitge schätzdesengepflich\tschöer", "a­b ²³ ª", "''''s 're $$$ x%%%y"]


def library(text):
    return tokenizer().library.encode(text, add_special_tokens=False).ids


def test_ids_equal_the_library():
    rng = random.Random(3)
    alphabet = "abcdeé ü'ñ.,12  \ń<|Ωs" + "the ing tion "
    texts = TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(400)]
    for t in texts:
        assert np.frombuffer(tokenizer().encode(t), dtype="<u4").tolist() == library(t), repr(t)


def test_every_prefix_and_every_limit():
    rng = random.Random(4)
    alphabet = "abcdeé ü'ñ.,12  \ń<|Ωs" + "the ing tion "
    for t in TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(30))) for _ in range(150)]:
        want = [len(library(t[:i])) for i in range(len(t) + 1)]
        assert prefix_counts(t) == want, repr(t)
        for limit in (0, 1, 3, 7):
            assert fit(t, limit) == (want[-1], max(i for i, n in enumerate(want) if n <= limit)), (t, limit)


@pytest.mark.parametrize("alphabet", ["日本語中文の東京大学人", "the nation\u00a0of don't\u3000", "กาที่นี่ไม่สวัส", "ée\u0301ñ한\u1112\u1161\u11abİΣ'res!1<|"])
def test_long_chunks_only_the_library_handles(alphabet):
    rng = random.Random(9)
    t = "".join(rng.choice(alphabet) for _ in range(1000)) + "<|endoftext|>" + alphabet
    want = [len(library(t[:i])) for i in range(len(t) + 1)]
    assert prefix_counts(t) == want
    for limit in (150, 433, 600):
        assert fit(t, limit) == (want[-1], max(i for i, n in enumerate(want) if n <= limit))


def test_counts_come_from_the_recurrence(monkeypatch):
    rng = random.Random(12)
    texts = TEXTS + [" ".join("".join(rng.choice("aabeinorst'.é") for _ in range(rng.randrange(1, 14))) for _ in range(40)) for _ in range(100)]
    want = [len(library(t)) for t in texts]

    def never(*_):
        raise AssertionError("a text was encoded")

    for name in ("ids", "chunk", "piece", "encode"):
        monkeypatch.setattr(WordTokenizer, name, never)
    texts += ["\u00c3\u00a9", "\u00e9", "\u00c3\u00a9"]  # the second one in the byte-level alphabet looks like the first
    want += [len(library(t)) for t in texts[-3:]]
    assert [fit(t, 5)[0] for t in texts] == want == [prefix_counts(t)[-1] for t in texts]


def test_stable_pairs_equal_merging():
    table, rng = _prefixes(None), random.Random(13)
    tokens = [t for t in rng.sample(sorted(table.vocab), 4000) if table.last_merge(t)]
    first = [t for t in tokens + ["a", "aa", "e", "ee", "the", "in"] if not t.endswith("</w>") and t in table.vocab]
    for _ in range(20_000):
        u, t = rng.choice(first), rng.choice(tokens + first)
        parts = table.symbols(u) + table.symbols(t)
        while pairs := [(table.ranks[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in table.ranks]:
            _, i = min(pairs)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        assert table.stable(u, t) == (parts == [u, t]), (u, t)


def test_counts_of_a_table(odd, none):
    df, pairs = odd
    got = sorted(map(tuple, token_counts(df, limit=50).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()), key=str)
    want = [(i, len((t or "").encode()), n := len(library(t or "")), n > 50) for i, t in pairs]
    assert got == sorted(want, key=str)
    assert token_counts(none).count() == 0
    assert prefix_tables(none).count() == 0


def test_stored_tables_answer_without_encoding(spark):
    df = spark.createDataFrame([(1, "the nationés of"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r.prefix_tokens for r in prefix_tables(df).collect()}
    assert got[1] == [len(library("the nationés of"[:i])) for i in range(len("the nationés of") + 1)]
    assert got[2] == [0]


def packed_whole(rows, docs, size):
    """Every id in one piece, in order; gapless sequences of at most ``size``, whole or a power of two."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for i, t in docs.items():
        ids = np.array(library(t or "") + [1], dtype="<u4")
        at = 0
        for r in sorted(by_doc.pop(i), key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    assert not by_doc
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size and at & (at - 1) == 0


def test_packing_loses_nothing(spark, none):
    rng = random.Random(1)
    docs = {i: " ".join(rng.choice(["the", "nation", "of", "xqz", "7"]) for _ in range(rng.randrange(120))) for i in range(300)}
    docs |= {1000: None, 1001: "", 1002: "the " * 1500}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    packed_whole(pack(df, size=128).collect(), docs, 128)
    assert pack(none).count() == 0
    with_ids = pack(df, size=128, with_ids=True).collect()
    assert all(zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) == r.ids_crc32 for r in with_ids)
    with pytest.raises(ValueError):
        pack(df, size=100)


def test_packing_odd_rows(odd):
    df, pairs = odd
    rows = pack(df, size=256).collect()
    assert sum(r.length for r in rows) == sum(len(library(t or "")) + 1 for _, t in pairs)


def test_each_place_minimises_the_sum_of_squares():
    rng = random.Random(2)
    packer, size, cut, whole = SumOfSquares(64), 64, 0, 0
    for i in range(2000):
        s = rng.choice([3, 5, 9, 17, 31, 40, 63])
        before = packer.levels[1:size].copy()

        def cost(h):
            after = before.copy()
            if h:
                after[h - 1] -= 1
            if h + s < size:
                after[h + s - 1] += 1
            return int((after ** 2).sum())

        options = [0] + [h for h in range(1, size - s + 1) if before[h - 1]]
        packer.place((i, 0, b"\0" * 4 * s))
        assert int((packer.levels[1:size] ** 2).sum()) == min(map(cost, options))
    for sequence in packer.rest():
        n = sum(len(p[2]) // 4 for p in sequence)
        whole, cut = whole + (n == size), cut + (n < size)
    assert cut <= 6

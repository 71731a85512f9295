import hashlib
import math
import random
import re
from collections import defaultdict

import pytest

from ridepulse.llm.private_data import KINDS, WORD, private_data, sanitised
from ridepulse.llm.queries import op13_private_data, table
from tests_llm import clash

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+",
            r"\+[0-9][\x20().0-9-]+[0-9]"]


def kept(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == 1:
        return all(int(p) <= 255 for p in m.split("."))
    if kind == 2:
        odd = sum(int(d) for d in digits[-1::-2]) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
        return 16 <= len(digits) <= 19 and odd % 10 == 0
    return kind == 0 or 8 <= len(digits) <= 15


def base(text):
    return [(k, m.start(), m.end()) for k, p in enumerate(PATTERNS) for m in re.finditer(p, text) if kept(k, m[0])]


def form(t):
    return f"#{len(t)}" if re.search("[0-9]", t) else f"{t[0]}*{min(3, len(t) // 4)}"


def brute(pairs, scope=80, share=0.5):
    """Spans of every text from counts over all texts."""
    n, n_t, n_c, n_ct, seen, words = len(pairs), defaultdict(int), defaultdict(set), defaultdict(set), defaultdict(set), []
    for row, (_, t) in enumerate(pairs):
        t = t or ""
        terms = {w.lower() for w in re.findall(WORD, t)}
        for x in terms | {form(w) for w in terms}:
            n_t[x] += 1
        spans = base(t)
        for k in range(4):
            hits = [m.span() for m in re.finditer(PATTERNS[k], t)]
            for i, (s, e) in enumerate(hits):
                if (k, s, e) not in spans:
                    continue
                c = t[s:e].lower() if k == 0 else t[s:e] if k == 1 else re.sub("[^0-9]", "", t[s:e])
                n_c[c].add(row)
                lo, hi = hits[i - 1][1] if i else 0, hits[i + 1][0] if i + 1 < len(hits) else len(t)
                before, after = t[max(lo, s - scope):s], t[e:min(hi, e + scope)]
                if s - lo > scope or i:
                    before = re.sub(f"^{WORD}", "", before)
                if hi - e > scope or i + 1 < len(hits):
                    after = re.sub(f"{WORD}$", "", after)
                for text, at in ((before, s - len(before)), (after, e)):
                    for m in re.finditer(WORD, text):
                        a, b = at + m.start(), at + m.end()
                        if b == s or a == e or any(x < b and a < y for _, x, y in spans):
                            continue
                        words.append((row, c, m[0].lower(), a, b))
                        for x in (m[0].lower(), form(m[0].lower())):
                            n_ct[c, x].add(row)
                            seen[c, x].add((before, after))

    def tells(c, x):
        if len(seen[c, x]) < 2 or len(n_c[c]) == n:
            return False
        return math.log2(n * len(n_ct[c, x]) / (len(n_c[c]) * n_t[x])) / math.log2(n / len(n_c[c])) >= share

    out = [base(t or "") for _, t in pairs]
    extra = defaultdict(int)
    for row, c, w, a, b in words:
        if tells(c, w):
            extra[row, a, b] = max(extra[row, a, b], 5 if tells(c, form(w)) else 4)
    for (row, a, b), k in extra.items():
        out[row].append((k, a, b))
    return sorted(((pairs[i][0], sorted(s)) for i, s in enumerate(out)), key=str)


def texts():
    rng = random.Random(21)
    parts = ["ann.lee@mail.example.org", "a@b.c%d@e.f", "a@b@c.d", "x.@y", "10.0.0.1", "10.0.0.256", "1.2.3.4.5.6.7.8", "007.1.2.003",
             "4111 1111 1111 1111", "4111111111111112", "4111-1111-1111-1111", "+1 (555) 010-9999", "+12 (", "+1234567", "+1 2 3 4 5 6 7 8",
             "+1 4111 1111 1111 1111", "é", "日本", "😀", " ", " ", " ", "\n", "-", ".", "@", "+", "7", "word", "Zorblat", "born1987", "the", "of"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(250)]


def told():
    """Some people's addresses, each with a name and an account that occur nearly only there, among common words."""
    rng, out = random.Random(7), []
    common = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)]
    for i in range(300):
        w = [rng.choice(common) for _ in range(30)]
        if i % 4 == 0:
            p = i // 4 % 12
            w[10:10] = [f"Person{'abcdefghijkl'[p]}son", f"acct{p}x9", f"person{p}@mail.example.org", rng.choice(common)]
        if i % 50 == 7:
            w.append("Personbson")
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("which", [texts, told])
def test_spans_equal_brute_force(spark, odd, which):
    pairs = list(enumerate(which())) + odd[1] + [(8001, "personal ann.lee@mail.example.org Zorblat")] * 3
    got = private_data(clash(spark, pairs).repartition(3)).collect()
    mine = sorted(((r.doc_id, [tuple(s) for s in r.spans]) for r in got), key=str)
    assert mine == brute(pairs)
    kinds = {s[0] for _, spans in mine for s in spans}
    assert kinds >= ({0, 1, 2, 3} if which is texts else {0, 4, 5})


def test_copies_prove_nothing_and_clean_texts_stay(spark, none):
    pairs = [(i, "call Zorblat now ann.lee@mail.example.org") for i in range(40)] + [(100 + i, "Zorblat was here") for i in range(5)]
    got = {r.doc_id: [KINDS[s.kind] for s in r.spans] for r in private_data(clash(spark, pairs)).collect()}
    assert got[0] == ["email"] and got[100] == []
    assert private_data(none).count() == sanitised(none).count() == 0


def test_a_third_of_the_rows_hold_one_entity(spark):
    rng = random.Random(3)
    pairs = [(i, f"{rng.randrange(99)} the Zorblat 10.1.2.3 of {rng.randrange(99)}" if i % 3 == 0 else f"the of {rng.randrange(99)}") for i in range(240)]
    got = private_data(clash(spark, pairs).repartition(4), salts=3).collect()
    assert sorted(((r.doc_id, [tuple(s) for s in r.spans]) for r in got), key=str) == brute(pairs)
    assert all(KINDS[r.spans[-1].kind] in ("generalise", "remove") for r in got if r.doc_id % 3 == 0)


def test_very_long_runs_need_no_deep_stack(spark):
    long = ["1" * 12_000, "1 " * 12_000, "a" * 12_000 + "@", "a@b" + ".c" * 12_000, "+" * 12_000, "+1" + "(" * 12_000, "1." * 12_000]
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in private_data(clash(spark, list(enumerate(long)))).collect()}
    assert {i: [s for s in got[i] if s[0] < 4] for i in got} == {i: base(t) for i, t in enumerate(long)}


def test_sanitised_text(spark):
    pairs = list(enumerate(told())) + [(900, None), (901, "é x4111 1111 1111 1111 😀 a@b.cd"), (902, "plain"), (902, "plain")]
    got = {r.doc_id: r for r in sanitised(clash(spark, pairs).repartition(3)).collect()}
    assert len(got) == len(pairs) - 1
    assert got[900].text == "" and got[902].text == "plain" and got[901].text == "é x[CARD] 😀 [EMAIL]"
    for i, t in enumerate(told()):
        if "@" in t:
            assert "@" not in got[i].text and "acct" not in got[i].text and "[EMAIL]" in got[i].text
    spans = {i: s for i, s in brute(pairs)}
    for i, t in pairs:
        if t and "@" not in t and "+" not in t:
            assert got[i].text == t and spans[i] == []


def test_registered_query(spark):
    sf = "/root/testdata/sf0.001"
    pairs = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    want = dict(brute(pairs))
    rows = op13_private_data(spark, sf).collect()
    assert len(rows) == len(pairs)
    for r in rows:
        said = [f"{KINDS[k]}:{a}:{b}" for k, a, b in want[r.doc_id]]
        plain = ",".join(x for x in said if x.split(":")[0] in KINDS[:4])
        assert r.spans == ",".join(said) and r.base_sha256 == hashlib.sha256(plain.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for k, *_ in want[r.doc_id]) for i in range(4)]

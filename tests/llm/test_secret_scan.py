import hashlib
import random
import re

from pyspark.sql import functions as F

from ridepulse.llm.secret_scan import KINDS, secret_scan, span_text
from tests_llm import clash

ASSIGN = re.compile(r"""((?:p|P)(?:a|A)(?:s|S)(?:s|S)(?:w|W)(?:o|O)(?:r|R)(?:d|D)|(?i:passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.ASCII)


def base(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


def texts():
    rng = random.Random(11)
    parts = ["password=", "PassWD: ", "secret", "token = \"", "api_key:'", "APIKEY==", "AKIA", "AKIA1234567890ABCD", "AKIAAKIA12345678",
             "0123456789abcdef0123456789abcdef", "deadbeef" * 9, "x" * 9, "abc", " ", "\n", "é", "\U0001F600", "日本", "=", ":", '"', "user=bob",
             "https://db.example.org/x", "10.0.0.1:22", "token=secret:abcdefghijk ", "Ab1" * 13 + "z"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(300)]


def test_base_spans(spark, odd, none):
    pairs = list(enumerate(texts())) + odd[1]
    got = secret_scan(clash(spark, pairs).repartition(3)).select("doc_id", F.filter("spans", lambda s: s["kind"] < 3).alias("b")).collect()
    assert sorted(((r.doc_id, [tuple(s) for s in r.b]) for r in got), key=str) == \
        sorted(((i, base(t or "")) for i, t in pairs), key=str)
    assert secret_scan(none).count() == 0


def test_weak_parts_only_beside_their_complements(spark):
    far = " word" * 200
    weak = "Ab1" * 13 + "z"
    pairs = [(1, f"login=alice password=abcdefgh1 at https://db.example.org/x"),
             (2, "login=alice and https://db.example.org/x"),
             (3, "login=alice" + far + " password=abcdefgh1"),
             (4, weak), (5, "AKIA1234567890ABCD " + weak), (6, "token=abcd"), (7, "host 10.0.0.1:22 token=abcd"),
             (8, "user=token=abcdefghijkl")]
    got = {r.doc_id: [(KINDS[s.kind], s.start, s.end) for s in r.spans] for r in secret_scan(clash(spark, pairs)).collect()}
    assert got[1] == [("weak_id", 0, 11), ("assign", 12, 30), ("endpoint", 34, 58)]
    assert got[2] == [] and got[4] == [] and got[6] == []
    assert [k for k, *_ in got[3]] == ["assign"]
    assert got[5] == [("access", 0, 18), ("weak_secret", 19, 59)]
    assert got[7] == [("weak_secret", 17, 27)]  # an address needs an identifier too
    assert [k for k, *_ in got[8]] == ["assign"]


def test_span_text(spark):
    r = secret_scan(clash(spark, [(1, "é password=abcdefgh1")])).select(span_text(F.col("spans")).alias("t")).first()
    assert r.t == "assign:2:20"
    assert hashlib.sha256(r.t.encode()).hexdigest()


def test_linking_equals_all_pairs(spark):
    """The interval join against a loop over all pairs of parts of a text."""
    from ridepulse.llm.secret_scan import link, parts
    pairs = [(i, t.replace("é", " " * 60)) for i, t in enumerate(texts())]
    found = parts(clash(spark, pairs)).where("kind IS NOT NULL").collect()
    want = set()
    by_row = {}
    for p in found:
        by_row.setdefault(p["__row"], []).append(p)
    for row, ps in by_row.items():
        strong = [(p.start, p.end) for p in ps if p.kind < 3]
        for p in ps:
            if p.kind < 3 or any(s < p.end and p.start < e for s, e in strong):
                continue
            near = {q.kind for q in ps if abs(q.start - p.start) <= 40}
            has_id, has_secret, has_place = near & {1, 3}, near & {0, 2, 4}, near & {5}
            if (p.kind == 3 and has_secret) or (p.kind == 4 and (has_id or has_place)) or (p.kind == 5 and has_id and has_secret):
                want.add((row, p.kind, p.start, p.end))
    got = {tuple(r) for r in link(parts(clash(spark, pairs)), scope=40).collect()}
    assert got == want and want

import random
import re

from ridepulse.llm.common import WORD, Words
from ridepulse.llm.license_scan import BASE, TEMPLATES, license_scan, license_spans
from tests_llm import clash

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(text):
    w = re.findall(WORD, (text or "").translate(UPPER))
    places = [(i, label) for label, phrase in BASE for i in range(len(w))
              if w[i:i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in places]
    return (len(w), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places})))


def texts(seed):
    rng = random.Random(seed)
    parts = [p for _, p in BASE] + ["Under", "the", "MIT", "license", "apache", "version-2", "2", "cc", "by", "nc", "é", ".", "x_y", "日本"]
    return [" ".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(200)]


def test_words_equal_the_pattern():
    for t in texts(7) + ["", "a", "É.É", "A1_b2\x7f\x80c"]:
        w = Words(["x", t, "y"])
        assert [w.text(i, 1) for i in range(w.first[1], w.first[2])] == re.findall(WORD, t.translate(UPPER))
        for k in (1, 2, 5):
            grams = Words([t]).grams(k)
            assert len(grams[0]) == max(0, len(re.findall(WORD, t.translate(UPPER))) - k + 1)


def test_base_places(spark, odd, none):
    pairs = list(enumerate(texts(1))) + odd[1]
    got = license_scan(clash(spark, pairs).repartition(3)).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()
    assert sorted(map(tuple, got), key=str) == sorted(((i, *brute(t)) for i, t in pairs), key=str)
    assert license_scan(none).count() == 0


def test_templates_with_drift(spark):
    mit = dict(TEMPLATES)["mit-text"]
    changed = mit.replace("free of charge", "free of any charge").replace("software to deal", "software deal")
    pairs = [(1, "x y " + mit + " z"), (2, changed), (3, mit[: len(mit) // 3]), (4, "clean words only"),
             (5, "Licensed under CC BY-NC 4.0. This work is licensed under the GNU General Public License")]
    got = {r.doc_id: r for r in license_scan(clash(spark, pairs)).collect()}
    assert got[1].labels == "mit-text" and got[1].score == 1.0
    assert got[2].labels == "mit-text" and 0.8 <= got[2].score < 1.0
    assert got[3].labels == "" and got[4].score == 0.0
    assert got[5].base_labels == "cc-by-nc" and got[5].labels == "cc-by-nc,gpl" and got[5].first_word == 2
    spans = license_spans(clash(spark, pairs), [(a, b, False) for a, b in TEMPLATES]).where("__id = 1 AND coverage = 1").collect()
    assert [(s.start, s.end) for s in spans] == [(2, 2 + len(mit.split()))]


def verified(text, template, drift=3, cover=0.8):
    """Whether enough different places of the template stand within ``drift`` diagonals: by trying every first diagonal."""
    w, t = re.findall(WORD, text.translate(UPPER)), template.split()
    hits = [(p - q, q) for p in range(len(w) - 2) for q in range(len(t) - 2) if w[p:p + 3] == t[q:q + 3]]
    return max((len({q for d, q in hits if first <= d <= first + drift}) / (len(t) - 2) for first, _ in hits), default=0.0) >= cover


def test_spans_are_verified(spark):
    repeated = [(1, "gnu general public gnu general public"), (2, "licensed under the licensed under the licensed under the")]
    assert [r.labels for r in license_scan(clash(spark, repeated)).collect()] == ["", ""]
    rng = random.Random(5)
    pieces = [x for _, t in TEMPLATES for x in (t, t[:len(t) // 2], " ".join(t.split()[2:5]), " ".join(t.split()[:4] + ["odd"] + t.split()[4:]))]
    pairs = [(i, " ".join(rng.choice(pieces + ["word", "the", "license"]) for _ in range(rng.randrange(9)))) for i in range(300)]
    pairs += [(1000, "licensed under the " * 400 + "apache license")]
    templates = [(label, t) for label, t in TEMPLATES]
    got = {r.doc_id: {x for x in r.labels.split(",") if x} for r in license_scan(clash(spark, pairs).repartition(3), base=[]).collect()}
    for i, t in pairs:
        assert got[i] == {label for label, template in templates if verified(t, template)}, t
    assert sum(map(len, got.values())) > 100

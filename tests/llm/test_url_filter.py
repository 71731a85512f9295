import itertools
import math

from ridepulse.llm.url_filter import RULES, host_words, naive_bayes, split_label, text_words, url_filter
from tests_llm import CLASH, CLASHING

URLS = ["https://www.bluefish.example.org/en/1234.html", "http://bluefish.example.org/es/7?x=://y", "https://Red.COM/fr/9#top",
        "ftp://red.com/de/", "https://red.com/de", "https://notexample.org/es/1", "https://example.org", "https://red.net/en/5",
        None, "", "no scheme", "://", "http://?q", "https://" + "a" * 400 + ".net/x", "https://ünï.net/ü", "a://b.com/fr/c://d.org/es/",
        "https://user@h-x.net:80/fr/1", "https://red.net/en/5"]


def brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        tail = rest[cut:]
        path = tail[:min((tail.index(c) for c in "?#" if c in tail), default=len(tail))]
    fits = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


def pages(spark, urls):
    return spark.createDataFrame([(i if i % 5 else None, u, "<p>blue fish <b>Red</b> net</p>", *CLASHING) for i, u in enumerate(urls)],
                                 f"page_id long, url string, html string, {CLASH}")


def test_hosts_paths_and_rules(spark):
    df = pages(spark, URLS)
    got = url_filter(df, text_words(df)).collect()
    assert len(got) == len(URLS)
    assert sorted(((r.host, r.path, r.rule) for r in got), key=str) == sorted((brute(u)[:3] for u in URLS), key=str)
    for r in got:
        want = brute("x://" + r.host + r.path)[3]
        assert r.verdict == want if r.rule else r.verdict in ("allow", "block")
        assert 0 <= r.score <= 1
    by_host = {r.host: r.words for r in got}
    assert by_host["www.bluefish.example.org"][1:3] == ["blue", "fish"]


def test_empty_tables(spark):
    df = pages(spark, [])
    assert url_filter(df, text_words(df)).count() == 0
    lone = pages(spark, ["https://red.net/en/5"])
    assert url_filter(lone, text_words(df)).first().verdict == "allow"


def test_viterbi_finds_the_best_split():
    counts = {"blue": 50, "fish": 40, "bluef": 1, "ish": 3, "b": 1, "a": 9, "lue": 2, "fis": 30, "h": 5}
    total = sum(counts.values())

    def cost(parts):
        return sum(math.log10(counts[p] / total) if p in counts else 1 - math.log10(total) - len(p) for p in parts)

    for label in ("bluefish", "ablue", "hhfisblue", "zzz", "fishfish"):
        known = {(7 + i, n): counts[label[i:i + n]] for i in range(len(label)) for n in range(1, len(label) + 1)
                 if label[i:i + n] in counts and i + n <= len(label)}
        got = split_label(label, known, 7, total)
        cuts = itertools.chain.from_iterable(itertools.combinations(range(1, len(label)), r) for r in range(len(label)))
        best = max(cost([label[a:b] for a, b in zip((0, *c), (*c, len(label)))]) for c in cuts)
        assert "".join(got) == label and math.isclose(cost(got), best)


def test_naive_bayes_by_hand(spark):
    weights, prior = naive_bayes(spark.createDataFrame(
        [([1, 2], True), ([1, 1], True), ([2, 3], False)], "cells array<int>, block boolean"))
    n = len(weights)
    assert math.isclose(weights[1], math.log((3 + 1) / (n + 4)) - math.log(1 / (n + 2)))
    assert math.isclose(weights[3], math.log(1 / (n + 4)) - math.log(2 / (n + 2)))
    assert math.isclose(prior, math.log(3 / 2))


def test_the_model_decides_where_no_rule_fits(spark):
    urls = [f"https://ads.x{i}.com/de/spam/{i}" for i in range(40)] + [f"https://news.y{i}.org/story/{i}" for i in range(40)]
    df = pages(spark, urls + ["https://ads.other.net/spam/3", "https://news.other.net/story/3"])
    got = {r.host: r.verdict for r in url_filter(df, text_words(df)).collect()}
    assert got["ads.other.net"] == "block" and got["news.other.net"] == "allow"


def test_words_and_hosts_of_any_length(spark):
    """Long words are learnt and tried, and long hosts are split; every host against the best of all splits."""
    long = "pneumonoultramicroscopicsilicovolcanoconiosis"
    counts = {"internationalization": 200, "inter": 90, "nation": 80, "alization": 1, long: 7, "shop": 30, "a": 5, "my": 9, "www": 40, "com": 50}
    hosts = ["internationalization.com", f"my{long}shop.com", "www.myshop.com", "zq.com", "myshop" * 60 + ".com", "é.a", "..", "x" * 3000]
    got = {r.host: r.words for r in host_words(spark.createDataFrame([(h,) for h in hosts + [""]], "host string"),
                                               spark.createDataFrame(list(counts.items()), "word string, n long")).collect()}
    assert got["internationalization.com"] == ["internationalization", "com"]
    assert got[f"my{long}shop.com"] == ["my", long, "shop", "com"] and got["www.myshop.com"] == ["www", "my", "shop", "com"]
    assert got["myshop" * 60 + ".com"] == ["my", "shop"] * 60 + ["com"]
    assert got["zq.com"] == ["zq", "com"] and got[".."] == [] and got["x" * 3000] == ["x" * 3000] and set(got) == set(hosts)
    assert text_words(pages(spark, ["u"] * 2)).where("word = 'fish'").first().n == 2

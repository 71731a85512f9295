import random
import re
import zlib
from collections import defaultdict

import pytest

import corpus_pipeline
from ridepulse.llm import toxicity
from ridepulse.llm.common import WORD
from ridepulse.llm.queries import QUERIES, SQL, table
from test_near_dup import classes, edited
from test_token_counts import packed_whole
from tests_llm import words

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A documents table with toxic rows, copies, near copies, benchmark passages, nulls and empties."""
    rng = random.Random(8)
    d = tmp_path_factory.mktemp("corpus")
    docs, labels = [], []
    items = [(i, words(rng, 40, 5000)) for i in range(6)]
    for i in range(300):
        w = words(rng, rng.randrange(30, 120), 2000)
        if i % 7 == 0:
            w += " vilord grubby sniv vilum"
            labels.append((i, 1, 1))
        elif i % 2:
            labels.append((i, 1, 0))
        docs.append((i, w))
    docs += [(1000 + i, t) for i, t in docs[1:30] if i % 7] + [(2000 + i, edited(rng, t, 1)) for i, t in docs[1:200] if i % 7]
    docs += [(3000 + i, words(rng, 50, 2000) + " " + items[i % 6][1]) for i in range(12)]
    docs += [(4000, None), (4001, ""), (None, "a b c"), (4002, "a b c")]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs],
                          "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d), docs, items


def test_stages_against_brute_force(spark, folder):
    d, docs, items = folder
    frame = table(spark, d, "documents")
    seen = [sorted((r.doc_id, r.text) for r in frame.collect() if r.doc_id is not None)]
    columns = frame.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, d)
        assert frame.columns == columns, name
        frame = corpus_pipeline.written(frame, "test")
        seen.append([(r.doc_id, r.text) for r in frame.collect()])
    whole, clean, exact, near, left = seen
    toxic = {i for i, t in docs if i is not None and t and "vilord" in t}
    assert len(toxic & {i for i, _ in clean}) <= 0.1 * len(toxic)
    assert {i for i, _ in clean if i is not None} >= {i for i, _ in whole} - toxic
    last = defaultdict(list)
    for i, t in clean:
        last[t or ""].append(i)
    assert sorted(map(str, (max((x for x in g if x is not None), default=None) for g in last.values()))) == sorted(str(i) for i, _ in exact)
    groups = classes(exact)
    assert len(near) == len(groups)
    kept = {i for i, _ in near}
    assert all(len({exact[j][0] for j in g} & kept) == 1 for g in groups)
    dirty = {i for i, t in near if any(x.lower() in " ".join(re.findall(WORD, (t or "").lower())) for _, x in items)}
    assert {i for i, _ in left} == kept - dirty and dirty
    packed_whole(corpus_pipeline.pack_sequences(spark, frame, d).collect(), dict(left), 2048)


def test_run_is_the_stages_in_turn(spark, folder):
    d, docs, _ = folder
    rows = corpus_pipeline.run(spark, d).collect()
    assert sum(r.length for r in rows) == sum({(r.doc_id): r.doc_tokens for r in rows}.values())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "near dedup", "decontamination", "packing"]


def test_empty_documents_pass_through(spark, folder, tmp_path):
    d = folder[0]
    frame = table(spark, d, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, d)
    assert frame.count() == 0


def test_every_query_is_registered_and_whole(spark):
    import __spark_entry__ as entry
    names = entry.queries()
    assert set(QUERIES) <= set(names) and "pipeline" in names and set(SQL) <= set(entry.oracle_sql())
    n = table(spark, SF, "documents").count()
    for name in ("op1_license_scan", "op2_token_counts", "op4_exact_dedup", "op6_sharding", "op7_secret_scan", "op8_near_duplicates"):
        got = names[name](spark, SF)
        assert got.count() == n == got.select("doc_id").distinct().count(), name
    assert names["op10_url_filter"](spark, SF).count() == table(spark, SF, "pages").count()


def test_toxicity_learns_only_from_training_folds(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    got = {r.doc_id: r for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [i for i in truth if i in got and zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out for i in held)

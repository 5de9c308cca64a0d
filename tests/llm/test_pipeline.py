"""The stages of the pipeline and their chain, on tables with null and repeated doc_ids, empty and long texts."""

import collections

import pytest

import corpus_pipeline
from tests.llm.test_llm import components, sentence, shingle_set

LONG = sentence(900, 6000) + " " + " ".join(f"u{i}" for i in range(30000))
NEAR = sentence(7, 200)
#: doc_id, text, lang, source, and a column that documents doesn't have
ROWS = [
    (1, NEAR, "en", "a", "x"),
    (2, NEAR + " tail", "en", "b", "x"),
    (2, sentence(8, 150), "de", "b", "x"),
    (2, sentence(8, 150), "de", "b", "y"),
    (None, NEAR, "en", None, "x"),
    (None, sentence(11, 120), None, "a", "x"),
    (None, sentence(11, 120) + " more", None, "a", "x"),
    (None, "too short", "en", "a", "x"),
    (None, None, "en", "a", "x"),
    (3, "", "en", "a", "x"),
    (4, LONG, "en", "c", "x"),
    (5, LONG + " end", "en", "c", "x"),
    (6, sentence(21, 400) + ". " + sentence(31, 40) + ". " + sentence(22, 500) + ".", "en", "c", "x"),
    (7, sentence(31, 40) + ". " + sentence(23, 60) + ".", "en", "c", "x"),
    (8, sentence(24, 70), "en", "a", "x"),
    (8, sentence(25, 70), "en", "a", "x"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _key string"


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    docs = spark.createDataFrame([(i, t, lang, s, len(t or ""), e) for i, t, lang, s, e in ROWS], SCHEMA)
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 1, 0), (2, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([("q", sentence(31, 40)), ("q", sentence(31, 40)), (None, None)], "item_id string, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def rows(df):
    return collections.Counter((r.doc_id, r.text, r._key) for r in df.collect())


def test_quality_rules(spark, sf, docs):
    got = rows(corpus_pipeline.quality_rules(spark, docs, sf))
    assert got == collections.Counter((i, t, e) for i, t, _, _, e in ROWS if len((t or "").split()) >= 50)


def test_near_duplicates(spark, sf, docs):
    out = corpus_pipeline.near_duplicates(spark, docs, sf)
    assert out.columns == docs.columns
    got = rows(out)
    assert sum(got.values()) == len(set(got))
    sets = [shingle_set(t) for _, t, _, _, _ in ROWS]
    of = components(sets, range(len(ROWS)))
    kept = collections.Counter()
    for k, (i, t, _, _, e) in enumerate(ROWS):
        if not sets[k]:
            assert got[(i, t, e)] == 1
    for i, t, e in got:
        found = [k for k, r in enumerate(ROWS) if (r[0], r[1], r[4]) == (i, t, e)]
        if sets[found[0]]:
            kept[of[found[0]]] += 1
            ids = [r[0] for k, r in enumerate(ROWS) if of[k] == of[found[0]] and r[0] is not None]
            assert i == min(ids, default=None)
    assert set(kept) == {of[k] for k in range(len(ROWS)) if sets[k]} and set(kept.values()) == {1}


def test_decontamination(spark, sf, docs):
    got = corpus_pipeline.decontamination(spark, docs, sf)
    texts = {r.doc_id: r for r in got.collect()}
    assert 7 not in texts and sentence(31, 40) not in texts[6].text and sentence(21, 400) in texts[6].text
    assert texts[6].n_chars == len(texts[6].text) and texts[4].text == LONG and got.count() == len(ROWS) - 1


def test_source_mix(spark, sf, docs):
    got = rows(corpus_pipeline.source_mix(spark, docs, sf))
    size = lambda t: len((t or "").split())
    for key, n in got.items():
        assert n <= 2 * sum((r[0], r[1], r[4]) == key for r in ROWS) and size(key[1])
    assert sum(n * size(t) for (_, t, _), n in got.items()) <= 1.5 * sum(size(r[1]) for r in ROWS)
    assert rows(corpus_pipeline.source_mix(spark, docs, sf)) == got


def test_chain(spark, sf, docs, tmp_path):
    out = corpus_pipeline.run(spark, sf).collect()
    assert out and {r.doc_id for r in out} <= {r[0] for r in ROWS} and all(r.n_tokens > 50 for r in out)
    start = 0
    for r in sorted(out, key=lambda r: r.start):
        assert r.start == start
        start += r.n_tokens


def test_no_rows(spark, sf, docs):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0, name

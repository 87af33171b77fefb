"""The registered queries and the pipeline on the smallest tables."""

import hashlib
from collections import defaultdict

import duckdb
import pytest
from brute import cut, groups, personal, shingle_set, similar

import __spark_entry__ as entry
import corpus_pipeline
from tools.check import TABLES, rows

COLUMNS = {
    "op1_vptree": "query_id rank vec_id score",
    "op2_quality": "doc_id held_out score predicted",
    "op3_packing": "doc_id piece start length ids_crc32 sequence_id offset",
    "op4_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op5_simhash": "doc_id fingerprint component_id",
    "op6_tokens": "doc_id n_tokens",
    "op7_tiles": "vec_id n_links component_id kept",
    "op8_substrings": "doc_id n_words n_removed kept_sha256",
    "op9_fixity": "record_key file offset length digest offset_2 length_2 digest_2 status",
    "op10_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op11_filters": "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley",
    "op12_planes": "vec_id cluster distance cluster_inertia inertia centroid_sha256",
    "op13_radix": "doc_id keep_id group_size kept text_sha256",
    "pipeline": "doc_id piece start length ids_crc32 sequence_id offset",
}


@pytest.mark.parametrize("name", COLUMNS)
def test_columns(spark, sf, name):
    df = entry.queries()[name](spark, sf)
    assert df.columns == COLUMNS[name].split()
    assert df.count() > 0


@pytest.mark.parametrize("name", ["op9_fixity", "op11_filters", "op12_planes", "op13_radix"])
def test_against_sql(spark, sf, name):
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    result = db.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    df = entry.queries()[name](spark, sf)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(columns, result.fetchall())


def test_digests(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    run = lambda name: {r.doc_id: r for r in entry.queries()[name](spark, sf).collect()}
    got = run("op8_substrings")
    for i, words, removed, kept in cut(list(docs.items())):
        assert tuple(got[i])[1:] == (words, removed, hashlib.sha256(kept.encode()).hexdigest())
    got = run("op10_pii")
    for i, text in docs.items():
        spans = ",".join(f"{k}:{a}:{b}" for k, a, b in personal(text))
        assert got[i].base_sha256 == hashlib.sha256(spans.encode()).hexdigest()
        assert got[i].spans.startswith(spans)
    assert all(r.decoded_sha256 == hashlib.sha256(docs[i].encode()).hexdigest() for i, r in run("op4_bpe").items())


def test_pipeline_stages(spark, sf):
    """Each stage against a plain version of its decisions, on what the stage before kept."""
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}

    before = docs.collect()
    docs = stages["quality classifier"](spark, docs, sf).cache()
    kept = {r.doc_id for r in docs.collect()}
    judged = [(labels[r.doc_id], r.doc_id in kept) for r in before if r.doc_id in labels]
    assert sum(bool(a) == b for a, b in judged) >= 0.97 * len(judged) and docs.columns == names

    before = docs.collect()
    docs = stages["SimHash near-dedup"](spark, docs, sf).cache()
    sets = {r.doc_id: shingle_set(r.text) for r in before}
    root = groups(list(sets), lambda a, b: similar(sets[a], sets[b]))
    assert {r.doc_id for r in docs.collect()} == {i for i in sets if root[i] == i} and docs.columns == names

    before = sorted(docs.collect(), key=lambda r: r.doc_id)
    docs = stages["substring dedup"](spark, docs, sf).cache()
    want = {
        i: (text if not removed else kept)
        for (i, words, removed, kept), text in zip(cut([(r.doc_id, r.text) for r in before]), [r.text for r in before])
        if not removed or kept
    }
    assert {r.doc_id: r.text for r in docs.collect()} == want and docs.columns == names

    docs = stages["PII"](spark, docs, sf).cache()
    after = docs.collect()
    assert {r.doc_id for r in after} == set(want) and docs.columns == names
    assert all(not personal(r.text) and r.n_chars == len(r.text) for r in after)
    assert all(r.text == want[r.doc_id] for r in after if not any(c.isdigit() or c == "@" for c in want[r.doc_id]))

    packed = stages["best-fit packing"](spark, docs, sf).collect()
    assert {r.doc_id for r in packed} == set(want)
    bins = defaultdict(int)
    for r in packed:
        bins[r.sequence_id] += r.length
    assert max(bins.values()) <= 1024


def test_pipeline_of_odd_rows(spark, docs, texts, sf):
    """NULL ids and texts, repeated rows and clashing columns pass all stages."""
    table = docs.selectExpr("*", "'en' AS lang", "CAST(-1 AS BIGINT) AS n_chars")
    names = table.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        table = stage(spark, table, sf).cache()
        assert table.columns == names, name
    assert corpus_pipeline.STAGES[-1][1](spark, table, sf).count() >= table.count()

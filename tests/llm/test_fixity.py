"""The audit of two replicas against a comparison record by record."""

import hashlib

import pytest

from tracemill.llm import fixity
from tracemill.llm.fixity import audit, damaged, trees, warc_records

SCHEMA = "page_id long, url string, html string, offset string, node string, hash string"


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(k, f"http://h/{k}", f"<p>é{k}</p>" * (k % 7), *["given"] * 3) for k in range(-30, 500)]
    rows += [(600, None, None, *["given"] * 3), (None, "u", "x", *["given"] * 3)]
    rows += [(7, "http://h/7", "again", *["given"] * 3), (9000, "far", "away", *["given"] * 3)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def plain(one, two):
    """Differences by key, copies of a key in order of their digests."""
    a, b = ({}, {})
    for records, into in ((one, a), (two, b)):
        for r in records.collect():
            into.setdefault(r.record_key, []).append(hashlib.sha256(bytes(r.record)).hexdigest())
    out = []
    for key in a.keys() | b.keys():
        mine, theirs = sorted(a.get(key, [])), sorted(b.get(key, []))
        for k in range(max(len(mine), len(theirs))):
            x = mine[k] if k < len(mine) else None
            y = theirs[k] if k < len(theirs) else None
            if x != y:
                out.append((key, x, y, "missing" if y is None else "extra" if x is None else "changed"))
    return out


def test_audit(pages, same):
    one, two = warc_records(pages), warc_records(damaged(pages, 31))
    for first, second in ((one, two), (two, one), (one, one), (one, one.limit(0))):
        rows = audit(first, second, fanout=4, file_records=50).collect()
        same([(r.record_key, r.digest, r.digest_2, r.status) for r in rows], plain(first, second))


def test_offsets_follow_the_bytes(pages):
    leaves = trees(warc_records(pages), 1, file_records=50).leaves.collect()
    for file in {r.file for r in leaves}:
        at = 0
        for r in sorted((r for r in leaves if r.file == file), key=lambda r: (r.record_key, r.copy)):
            assert r.offset == at
            at += r.length


def test_only_branches_that_differ_are_opened(spark, pages):
    """A shorter record shifts all later offsets and still leaves their nodes as they are."""
    one = warc_records(pages)
    two = warc_records(pages.replace("http://h/40", "http://h/4", "url"))
    a, b = trees(one, 3, 4, 10**6), trees(two, 3, 4, 10**6)
    for level in range(4):
        nodes = [{r.node: r.hash for r in t.levels[level].collect()} for t in (a, b)]
        assert {n for n in nodes[0] if nodes[0][n] != nodes[1][n]} == {40 // 4**level}


def test_empty(pages):
    assert audit(warc_records(pages.limit(0)), warc_records(pages.limit(0))).count() == 0


def test_copies_of_one_key(spark, same, monkeypatch):
    """Nodes over four copies, so that a key with 300 of them has a tree of several levels; some bytes differ or are gone."""
    monkeypatch.setattr(fixity, "COPY_RANGE", 4)
    rows = [(5, "u", f"copy {k % 250}") for k in range(300)] + [(k, "v", "x") for k in range(20)]
    damage = [(i, u, h + "!" if h == "copy 17" else h) for i, u, h in rows if h != "copy 99"]
    one, two = (warc_records(spark.createDataFrame(r, "page_id long, url string, html string").repartition(3)) for r in (rows, damage))
    got = audit(one, two).collect()
    same([(r.record_key, r.digest, r.digest_2, r.status) for r in got], plain(one, two))
    assert audit(one, one).count() == 0
    leaves = sorted((r.record_key, r.copy, r.offset, r.length) for r in fixity.offsets(one).collect())
    at = 0
    for k, (_, _, offset, length) in enumerate(leaves):
        assert offset == at
        at += length
    assert [copy for key, copy, *_ in leaves if key == 5] == list(range(301))


def test_large_keys_and_long_records(spark, same):
    keys = [2**53 + 1, 2**53, 2**63 - 1, -(2**63), -(2**53) - 1, -1, 0]
    rows = [(k, "u", "body " * 200_000 if k in (0, 2**53) else str(k)) for k in keys]
    one = warc_records(spark.createDataFrame(rows, "page_id long, url string, html string"))
    two = warc_records(spark.createDataFrame([(k, u, h[:-1]) for k, u, h in rows[:3]] + rows[3:6], "page_id long, url string, html string"))
    got = audit(one, two, fanout=4096).collect()
    same([(r.record_key, r.digest, r.digest_2, r.status) for r in got], plain(one, two))
    assert {r.record_key for r in got} == {2**53 + 1, 2**53, 2**63 - 1, 0}


"""Operators on texts against plain versions, on rows with every odd case."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from brute import cut, fingerprint, groups, personal
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tracemill.llm.bpe import decode, encode
from tracemill.llm.components import components
from tracemill.llm.packing import pack_documents, plan_packing
from tracemill.llm.pii import find_pii, redact_pii, span_text
from tracemill.llm.quality import score_quality
from tracemill.llm.simhash import simhash_groups
from tracemill.llm.substrings import dedup_substrings
from tracemill.llm.token_files import count_tokens, document_tokens, read_token_files, write_token_files
from tracemill.llm.vocabulary import encoder


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def test_simhash(docs, texts, same):
    prints = [fingerprint(text) for _, text in texts]
    root = groups(list(set(prints)), lambda a, b: bin(a ^ b).count("1") <= 2)
    first = defaultdict(list)
    for (i, _), p in zip(texts, prints):
        first[root[p]] += [] if i is None else [i]
    want = [(i, f"{p:016x}", min(first[root[p]], default=None)) for (i, _), p in zip(texts, prints)]
    same(simhash_groups(docs).collect(), want)


def test_simhash_links_every_pair_in_reach(spark):
    """All fingerprints at two bits from one another, none by way of a third."""
    from tracemill.llm.simhash import links

    rng = np.random.default_rng(2)
    prints = set()
    for base in rng.integers(-(2**62), 2**62, 40):
        for _ in range(4):
            a, b = rng.integers(0, 64, 2)
            prints |= {int(base), signed((int(base) ^ (1 << int(a)) ^ (1 << int(b))) % 2**64)}
    frame = spark.createDataFrame([(p,) for p in prints], "fp long")
    forest = {r.node: r.root for r in components(links(frame)).collect()}
    want = groups(list(prints), lambda a, b: bin((a ^ b) % 2**64).count("1") <= 2)
    assert {p: forest.get(p, p) for p in prints} == want


def test_components(spark):
    rng = np.random.default_rng(7)
    chain = [(k + 1, k) for k in range(1000, 1300)]
    star = [(5, k) for k in range(2000, 2500)]
    loose = [tuple(map(int, rng.integers(5000, 5400, 2))) for _ in range(250)]
    edges = [*chain, *star, *loose, (7, 7), (8, None), (None, None)]
    frame = spark.createDataFrame(edges, "u long, v long").repartition(7)
    got = {r.node: r.root for r in components(frame).collect()}
    near = defaultdict(set)
    for u, v in edges:
        if u is not None and v is not None:
            near[u].add(v), near[v].add(u)
    seen = {}
    for node in sorted(near):
        work = [] if node in seen else [node]
        while work:
            at = work.pop()
            if at not in seen:
                seen[at] = node
                work += near[at]
    assert got == {node: root for node, root in seen.items() if node != root}
    assert components(frame.limit(0)).count() == 0


def test_substrings(docs, texts, same):
    got = dedup_substrings(docs, extra=["kept", "length"])
    assert got.columns == ["doc_id", "length", "n_words", "n_removed", "kept", "removed"]
    rows = got.collect()
    same([(r.doc_id, r.n_words, r.n_removed, r.kept) for r in rows], cut(texts))
    for r in rows:
        assert sum(b - a for a, b in r.removed) == r.n_removed
        assert all(b < c for (_, b), (c, _) in zip(r.removed, r.removed[1:]))


def test_substrings_over_many_flushes(spark, same, monkeypatch):
    from tracemill.llm import substrings

    monkeypatch.setattr(substrings, "CHARS_A_BUCKET", 2000)
    rng = np.random.default_rng(5)
    passage = " ".join(f"p{k}" for k in range(30))
    rows = [
        (k, " ".join(f"v{x}" for x in rng.integers(0, 4, 120)) + (f" {passage}" if k % 3 == 0 else ""))
        for k in range(150)
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    got = dedup_substrings(frame)
    same([(r.doc_id, r.n_words, r.n_removed, r.kept) for r in got.collect()], cut(rows))


def test_bpe(docs, texts, same):
    exact = encoder(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    rows = decode(encode(docs)).collect()
    want = []
    for i, text in texts:
        ids = np.array(exact.encode_ordinary(text or ""), dtype="<u4")
        want.append((i, len(ids), ids.tobytes(), (text or "").encode()))
    same([(r.doc_id, r.n_tokens, bytes(r.ids), bytes(r.decoded)) for r in rows], want)
    for r in rows:
        assert (np.frombuffer(r.ends, "<u4")[-1:] == [len(r.decoded)] * (r.n_tokens > 0)).all()


def test_boundaries_of_every_character():
    from tracemill.llm.bpe import Merger, encode_texts
    from tracemill.llm.pretokens import class_ranges, class_table
    from tracemill.llm.vocabulary import ranks

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    points = [c for c in range(0x33480) if not 0xD800 <= c < 0xE000]
    odd = ["it's'sabc 'll're''s \n's  'd\t\t x", "a  \n b", "\n\n", "'LL 'l 'lla", "!'s", " '", "1'2 's3", "\0'm\0"]
    texts = ["".join(f"a{chr(c)}b1{chr(c)} {chr(c)}\n" for c in points[k : k + 500]) for k in range(0, len(points), 500)]
    texts += [x + y for x in odd for y in odd]
    got = encode_texts(texts, class_table(class_ranges()), Merger(ranks(path)))
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [encoder(path).encode_ordinary(t) for t in texts]


def test_long_texts_are_cut_between_words():
    from tracemill.llm.bpe import CHUNK, Merger, encode_text, parts
    from tracemill.llm.pretokens import class_ranges, class_table
    from tracemill.llm.vocabulary import ranks

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    rng = np.random.default_rng(8)
    for letters in ("abc  '\n1!é", "ab ", " \n1!", "a"):
        text = "".join(rng.choice(list(letters), 5 * CHUNK)) if len(letters) > 1 else letters * 3 * CHUNK
        assert "".join(parts(text)) == text
        if letters != "a":
            got = np.frombuffer(encode_text(text, class_table(class_ranges()), Merger(ranks(path))), "<u4")
            assert got.tolist() == encoder(path).encode_ordinary(text)


def test_packing(docs, texts, same):
    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [*texts, (80, "a <|endoftext|> b"), (81, "<|endoftext|>"), (82, "x<|endoftext|><|endoftext|>  <|endoftext|"), (83, "<|endoftext|> " * 2000)]
    docs = docs.unionByName(docs.sparkSession.createDataFrame(texts[-4:], "doc_id long, text string"), allowMissingColumns=True)
    assert exact.encode(texts[-4][1], add_special_tokens=False).ids == [64, 220, 50256, 275]
    want = []
    for i, text in texts:
        ids = [*exact.encode(text or "", add_special_tokens=False).ids, 2]
        starts = [0, *range(len(ids) % 1024 or 1024, len(ids), 1024)]
        for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
            want.append((i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    rows = pack_documents(docs).collect()
    same([tuple(r)[:5] for r in rows], want)
    assert_packed(rows, 1024)
    total = sum(r.length for r in rows)
    assert len({r.sequence_id for r in rows}) <= -(-total // 1024) + 1


def assert_packed(rows, capacity):
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity


def fewest(lengths, capacity):
    """Least number of bins, by trying everything."""
    best = [len(lengths)]

    def place(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(lengths):
            best[0] = len(bins)
            return
        for i, room in enumerate(bins):
            if room >= lengths[k]:
                place(k + 1, [*bins[:i], room - lengths[k], *bins[i + 1 :]])
        place(k + 1, [*bins, capacity - lengths[k]])

    place(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(12))
def test_dominance_keeps_an_optimum(seed):
    from tracemill.llm.packing import Plan, reduce_dominated

    rng = np.random.default_rng(seed)
    lengths = sorted(map(int, rng.integers(1, 21, 9)), reverse=True)
    left = [0] * 21
    for x in lengths:
        left[x] += 1
    plan = Plan(20, left)
    reduce_dominated(plan)
    rest = [size for size in range(20, 0, -1) for _ in range(plan.left[size])]
    assert plan.bins + fewest(rest, 20) == fewest(lengths, 20)


def test_plan_size_does_not_follow_the_pieces():
    rng = np.random.default_rng(0)
    counts = Counter(np.minimum(1024, rng.lognormal(5, 1, 20000).astype(int) + 1).tolist())
    small, large = plan_packing(counts), plan_packing({k: 10**6 * n for k, n in counts.items()})
    assert len(large.rows) < 100_000
    tokens = sum(k * n for k, n in counts.items())
    assert small.bins <= 1.002 * tokens / 1024 + 1 and large.bins <= 1.002 * 10**6 * tokens / 1024 + 1


def test_pii(docs, texts, same):
    rows = find_pii(docs).collect()
    same([(r.doc_id, [tuple(s) for s in r.base]) for r in rows], [(i, personal(t)) for i, t in texts])
    assert all(set(map(tuple, r.base)) <= set(map(tuple, r.spans)) for r in rows)
    clean = redact_pii(docs)
    assert clean.columns == docs.columns
    text = {r.doc_id: r.text for r in clean.collect()}
    assert text[70].startswith("mail [EMAIL] or [PHONE] from 10.0.0.256 [IP], [CARD] <|end")
    assert text[1] is None and text[42] == dict(texts)[42]


def test_pii_against_random_texts(spark):
    rng = np.random.default_rng(3)
    rows = []
    for letters in ("ab@.-_ %é", "0123456789 -.", "+1234567890 ().-x", "ab0@.1 +-25()=\""):
        rows += ["".join(rng.choice(list(letters), rng.integers(0, 100))) for _ in range(400)]
    rows += ["1 " * 20000, "1" * 50000, "+1" * 20000, "4111 1111 1111 1111\n" * 200]
    frame = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(8)
    for r in find_pii(frame).collect():
        assert [tuple(s) for s in r.base] == personal(rows[r.doc_id]), rows[r.doc_id][:100]


def test_pii_learns_further_spans(spark):
    plain = ["see chapter-12-of-the-book and version_3_of_it", "file_name_2024_final and item-no-12345678"] * 40
    secret = [f"password={hashlib.md5(bytes([k])).hexdigest()} ok" for k in range(60)]
    rows = list(enumerate(plain + secret))
    out = find_pii(spark.createDataFrame(rows, "doc_id long, text string")).withColumn("t", span_text(F.col("spans")))
    got = {r.doc_id: r.t for r in out.collect()}
    assert all(got[k] == "" for k in range(len(plain)))
    assert all(got[k] == "secret:9:41" for k in range(len(plain), len(rows)))


def test_quality(spark, docs, texts, sf):
    documents, labels = (spark.read.parquet(f"{sf}/{name}.parquet") for name in ("documents", "labels"))
    rows = score_quality(documents, labels).join(labels, "doc_id").collect()
    for part in (True, False):
        some = [r for r in rows if r.held_out is part]
        assert sum(r.predicted == r.quality for r in some) >= 0.97 * len(some)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    odd = score_quality(docs, labels).collect()
    assert len(odd) == len(texts)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in odd)


def test_quality_takes_no_held_out_label(spark, sf):
    documents, labels = (spark.read.parquet(f"{sf}/{name}.parquet") for name in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    turned = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (score_quality(documents, x).orderBy("doc_id").collect() for x in (labels, turned))
    assert all(abs(x.score - y.score) < 1e-9 for x, y in zip(a, b))


def test_quality_without_labels(spark, docs, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    assert {r.score for r in score_quality(docs, labels.limit(0)).collect()} == {0.5}
    assert {r.score for r in score_quality(docs, labels.where("quality = 1")).collect()} == {1.0}


def test_token_counts(spark, docs, texts, same, tmp_path):
    exact = encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    size = lambda text: len(exact.encode_ordinary(text or ""))
    same(document_tokens(docs).collect(), [(i, size(text)) for i, text in texts])
    blocks, manifest = write_token_files(docs, block_tokens=64)
    joined = manifest.join(count_tokens(blocks), ["file", "ordinal"]).select("doc_id", "n_tokens")
    same(joined.collect(), [(i, size(text)) for i, text in texts])


def test_token_counts_of_raw_files(spark, same, tmp_path):
    end, streams = 50256, {"a": [1, 2, 50256, 50256, 3], "b": [50256], "c": [], "d": [5] * 20, "e": [7, 8, 50256]}
    want = {"a": [(2, True), (0, True), (1, False)], "b": [(0, True)], "d": [(20, False)], "e": [(2, True)]}
    (tmp_path / "deep").mkdir()
    for name, ids in streams.items():
        (tmp_path / ("deep" if name == "d" else ".") / f"{name}.bin").write_bytes(np.array(ids, "<u2").tobytes())
    for block_tokens in (1, 2, 3, 100):
        rows = count_tokens(read_token_files(spark, str(tmp_path), block_tokens), end).collect()
        got = defaultdict(list)
        for r in sorted(rows, key=lambda r: (r.file, r.ordinal)):
            got[r.file[-5]].append((r.n_tokens, r.ended))
        assert got == want


def test_empty_tables(no_docs, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for result in (
        simhash_groups(no_docs), dedup_substrings(no_docs), decode(encode(no_docs)), pack_documents(no_docs),
        find_pii(no_docs), redact_pii(no_docs), score_quality(no_docs, labels), document_tokens(no_docs),
    ):
        assert result.collect() == []


def test_words_that_polynomials_confuse_are_told_apart(spark):
    """A Thue-Morse word of 1,024 letters and its complement have equal polynomials modulo 2^64."""
    word = "".join("ab"[bin(k).count("1") % 2] for k in range(1024))
    other = word.translate(str.maketrans("ab", "ba"))
    shared = " ".join(f"w{k}" for k in range(12))
    rows = [(1, f"{word} {shared}"), (2, f"{other} {shared}"), (3, f"{word} {shared}")]
    got = {r.doc_id: r.n_removed for r in dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 0, 3: 13}

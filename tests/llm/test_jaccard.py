"""Near-duplicates of the pipeline against brute-force similarity of five-word shingles."""

import random
from itertools import combinations

import pytest
from brute import fingerprint, groups, shingle_set as shingles, similar

import corpus_pipeline
from tracemill.llm.jaccard import jaccard_groups, rare_pairs

SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def copies():
    """Texts with copies that differ in 1 to 12 of 200 words, copies of copies, and short and empty ones."""
    rng = random.Random(5)
    say = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    texts = ["", None, " \n", "one two", "One TWO", "one two three"]
    for _ in range(25):
        texts.append(" ".join(words := say(200)))
        for edits in (1, 3, 4, 5, 7, 12):
            changed = list(words) if rng.random() < 0.7 else texts[-1].split()
            for at in rng.sample(range(200), edits):
                changed[at] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(changed))
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_groups(spark, copies):
    sets = {i: shingles(text) for i, text in copies}
    want = groups(list(sets), lambda a, b: similar(sets[a], sets[b]))
    far = [bin(fingerprint(copies[a][1]) ^ fingerprint(copies[b][1])).count("1") > 2 for a, b in combinations(sets, 2) if similar(sets[a], sets[b])]
    assert sum(far) > 50
    rows = jaccard_groups(spark.createDataFrame(copies, SCHEMA).repartition(5)).collect()
    first = {}
    for r in sorted(rows):
        first.setdefault(r.root, r.doc_id)
    assert {r.doc_id: first[r.root] for r in rows} == want


def test_stage(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sets = {r.doc_id: shingles(r.text) for r in docs.collect()}
    want = groups(list(sets), lambda a, b: similar(sets[a], sets[b]))
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, sf).collect()}
    assert kept == {i for i in want if want[i] == i}
    assert not {177, 145} & kept  # 0.83 beside 1 and 6, more than two bits away


def test_rows_of_one_id_and_of_none_are_decided_by_themselves(spark, sf):
    """A text stays if no row of its group comes before it, whatever else has its id."""
    say = lambda name: " ".join(f"{name}{k}" for k in range(60))
    rows = [
        (1, say("a"), "x"), (7, say("a"), "x"), (7, say("b"), "x"), (7, say("c"), "x"), (7, say("c"), "w"), (7, say("c"), "w"),
        (None, say("d"), "x"), (None, say("d"), "x"), (None, say("d") + " more", "x"), (None, say("a"), "x"), (None, say("e"), "x"),
        (9, say("e"), "x"), (None, None, "x"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    got = [(r.doc_id, r.text, r.lang) for r in corpus_pipeline.near_duplicates(spark, docs, sf).collect()]
    d = [x for x in got if x[0] is None and x[1] and x[1].startswith("d")]
    assert len(d) == 1
    got.remove(d[0])
    want = [(1, say("a"), "x"), (7, say("b"), "x"), (7, say("c"), "w"), (9, say("e"), "x"), (None, None, "x")]
    assert sorted(got, key=str) == sorted(want, key=str)


def similarity(a, b):
    return len(a & b) / len(a | b)


def family(rng, size, own, shared=200):
    """Sets with ``shared`` numbers in common and ``own`` each for itself."""
    common = set(range(shared))
    return [common | {rng.randrange(10**6, 10**12) for _ in range(own)} for _ in range(size)]


def candidates(spark, sets, roots):
    """Pairs to compare; sets are named by their place."""
    rows = [(k, sorted(x)) for k, x in enumerate(sets)]
    frame = spark.createDataFrame(rows, "set long, hashes array<long>").repartition(3)
    facts = [(k, len(x), root) for k, (x, root) in enumerate(zip(sets, roots))]
    found = rare_pairs(spark.createDataFrame(facts + facts[:9], "set long, size long, root long"), frame)
    return [tuple(r) for r in found.collect()]


def test_rare_pairs_miss_nothing(spark):
    """Pairs of all similarities around 0.8, sizes equal and not, against all pairs of different roots."""
    rng = random.Random(8)
    sets = []
    for _ in range(12):
        base = [rng.randrange(10**9) for _ in range(rng.choice([1, 2, 5, 9, 10, 50, 90]))]
        for _ in range(8):
            keep = rng.sample(base, max(1, round(len(base) * rng.choice([0.75, 0.85, 0.9, 0.95, 1]))))
            sets.append(set(keep) | {rng.randrange(10**9) for _ in range(rng.choice([0, 0, 1, 2, 5]))})
    for roots in (list(range(len(sets))), [k % 7 for k in range(len(sets))], [k // 30 for k in range(len(sets))]):
        got = candidates(spark, sets, roots)
        want = {(a, b) for a, b in combinations(range(len(sets)), 2) if roots[a] != roots[b] and similarity(sets[a], sets[b]) >= 0.8}
        assert want <= set(got) and len(got) == len(set(got)) and all(roots[a] != roots[b] for a, b in got)
        assert len(want) > 2


def test_sets_alike_without_being_similar_do_not_meet(spark):
    """300 sets that share the same 200 numbers and have 45 to 50 of their own: similarities of 0.67 to 0.69."""
    sets = [x for own in (45, 48, 50) for x in family(random.Random(own), 100, own)]
    assert similarity(sets[0], sets[1]) > 0.68 and similarity(sets[-1], sets[0]) < 0.8
    assert candidates(spark, sets, range(len(sets))) == []


def test_a_connected_group_is_not_compared_with_itself(spark):
    """400 similar sets of one root beside 3 others: every pair has one of the others."""
    rng = random.Random(1)
    sets = [*family(rng, 400, 5), *family(rng, 3, 20)]
    got = candidates(spark, sets, [0] * 400 + [400, 401, 402])
    want = {(a, b) for a, b in combinations(range(403), 2) if b >= 400 and similarity(sets[a], sets[b]) >= 0.8}
    assert want <= set(got) and len(got) <= 3 * 400 + 3


def test_group_of_similar_and_of_unlike_texts(spark):
    """Texts with one passage in common: 60 of them similar, 60 at about 0.7."""
    rng = random.Random(21)
    say = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passage = say(150)
    texts = [" ".join(passage + say(n)) for n in [8] * 60 + [26] * 60]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    sets = {i: shingles(text) for i, text in rows}
    want = groups(list(sets), lambda a, b: similar(sets[a], sets[b]))
    got = jaccard_groups(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    first = {}
    for r in sorted(got):
        first.setdefault(r.root, r.doc_id)
    # brute names groups by their place in the list
    smallest = {}
    for i in sorted(want):
        smallest.setdefault(want[i], i)
    assert {r.doc_id: first[r.root] for r in got} == {i: smallest[want[i]] for i in want}

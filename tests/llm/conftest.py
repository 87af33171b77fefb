import random

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def texts():
    """Rows with every odd case: NULL id and text, empty and very long texts, repeated rows, ties, shared passages."""
    rng = random.Random(11)
    vocabulary = [f"w{k}" for k in range(400)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, other = say(60), say(14)
    near = say(300).split()
    changed = [*near[:150], "changed", *near[151:]]
    rows = [
        (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "one two"), (6, "One TWO"), (7, "é ü 日本  x"),
        (20, say(20) + " " + passage + " " + say(5)), (21, passage), (22, say(30) + "\n" + passage),
        (23, other), (24, other + " " + say(3)), (19, other),
        (30, " ".join(near)), (31, " ".join(changed)), (32, " ".join(near)), (33, " ".join(near).upper()),
        (40, "a " * 40000), (41, "x" * 300000), (42, say(20000)), (43, "a " * 30),
        (50, say(100)), (50, "same id, another text " + passage), (60, passage), (60, passage),
        (None, passage), (None, None), (-5, passage + " " + say(4)),
        (70, "mail a.b@c.de or +49 (170) 1234567 from 10.0.0.256 10.0.0.255, 4111 1111 1111 1111 <|endoftext|> it's 'll"),
    ]
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    """With columns whose names the operators use too."""
    frame = spark.createDataFrame(texts, SCHEMA).repartition(5)
    clashing = ["length", "score", "ids", "bucket", "fp", "found", "kept", "n", "vector", "hash", "word"]
    return frame.withColumns({name: F.lit("given") for name in clashing}).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def key(row):
    return tuple(str(x) for x in row)


@pytest.fixture(scope="session")
def same():
    def check(got, want):
        assert sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key)

    return check

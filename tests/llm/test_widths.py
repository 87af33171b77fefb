"""Vectors of several lengths in one table."""

import numpy as np
from pyspark.sql import functions as F

from tracemill.llm.tiles import embedding_groups
from tracemill.llm.vptree import nearest


def test_each_length_is_compared_by_itself(spark):
    rng = np.random.default_rng(3)
    table = [(k, rng.normal(size=4).tolist()) for k in range(30)]
    table += [(30, table[20][1]), (40, [1.0] * 9), (41, [2.0] * 9), (60, [1.0, 2.0])]
    frame = spark.createDataFrame(table, "vec_id long, embedding array<double>").repartition(3)
    good = dict(table)
    got = nearest(frame, F.col("vec_id") % 20 == 0, k=3, factor=1.0).collect()
    for q in (0, 20, 40, 60):
        scores = [(-float(np.dot(good[q], x)), i) for i, x in table if i != q and len(x) == len(good[q])]
        assert [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] == [i for _, i in sorted(scores)[:3]]
    groups = {r.vec_id: r for r in embedding_groups(frame, 0.999).collect()}
    assert len(groups) == len(table)
    assert [i for i, r in groups.items() if not r.kept] in ([30, 41], [41, 30])
    assert (groups[30].component_id, groups[41].component_id, groups[20].n_links, groups[40].n_links, groups[60].n_links) == (20, 40, 1, 1, 0)

import os

import pytest

from tracemill import session


class Fake:
    """A session without a checkpoint folder."""

    def __init__(self, master):
        self.conf = self
        self.sparkContext = self
        self.master = master

    def get(self, name, default=None):
        return "file:/warehouse" if name == "spark.sql.warehouse.dir" else default

    def getCheckpointDir(self):  # noqa: N802
        return None


def test_a_cluster_must_name_a_shared_folder():
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            session.shared_dir(Fake(master))
    assert session.shared_dir(Fake("local[4]")) == "file:/warehouse/_scratch"


def test_stored_tables_are_dropped(spark):
    before = spark.sparkContext.getCheckpointDir()
    tables = [session.stored(spark.range(5), "t"), session.stored(spark.range(5).repartition(4), "t", compact=True)]
    paths = [table.inputFiles()[0].removeprefix("file:").replace("///", "/") for table in tables]
    assert all(table.count() == 5 for table in tables) and all(map(os.path.exists, paths))
    assert len(tables[1].inputFiles()) == 1
    assert session.drop_stored(spark) >= 2
    assert not any(map(os.path.exists, paths))
    assert spark.sparkContext.getCheckpointDir() == before


def test_what_a_result_was_made_from_is_emptied(spark):
    made = []

    def make():
        made.append(session.stored(spark.range(7), "first"))
        made.append(session.stored(made[0].where("id > 2"), "second"))
        return made[1].withColumn("double", made[1].id * 2)

    kept = session.stored(spark.range(3), "other")
    files = lambda table: [f.removeprefix("file:").replace("///", "/") for f in table.inputFiles()]
    result = session.settled(spark, make, "result")
    assert sorted(r.double for r in result.collect()) == [6, 8, 10, 12]
    assert not any(os.path.exists(f) for table in made for f in files(table)) and kept.count() == 3
    session.drop_stored(spark)
    assert not any(os.path.exists(f) for f in files(result))

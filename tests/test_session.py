import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from quillmesh import session


@pytest.mark.parametrize(("per_part", "total"), [(10, None), (10, 1100), (1_000_000, None)])
def test_salted_sides_join_as_plain_ones_do(spark, per_part, total):
    """A hot key is split, others and null keys are not, and no row is lost or met twice."""
    rows = spark.range(1000).select(F.lit("hot").alias("k"), F.col("id").alias("i"))
    rows = rows.unionByName(spark.range(100).select(F.concat(F.lit("k"), (F.col("id") % 30).cast("string")).alias("k"), (F.col("id") + 1000).alias("i")))
    rows = rows.unionByName(spark.createDataFrame([(None, 5000)], "k string, i bigint"))
    sized = rows.where("k is not null").groupBy("k").agg(F.count("*").alias("n"), F.min("i").alias("least"))
    salted, repeated = session.salt_hot(rows, sized, ["k"], "i", per_part=per_part, total=total)
    got = salted.join(repeated.hint("merge"), ["k", "part"])
    assert rows_of(got, "k", "i", "least") == rows_of(rows.join(sized, "k"), "k", "i", "least")
    parts = salted.where("k = 'hot'").groupBy("part").agg(F.count("*").alias("n")).collect()
    assert (len(parts) == 100 and max(r.n for r in parts) < 40) if per_part == 10 else len(parts) == 1
    assert salted.where("k is null and part = 0").count() == 1
    none, of_none = session.salt_hot(rows.limit(0), sized.limit(0), ["k"], "i")
    assert none.join(of_none, ["k", "part"]).count() == 0


@pytest.mark.parametrize(("master", "allowed"), [("local", True), ("local[*]", True), ("local[4,2]", True), ("local-cluster[3,2,1024]", False), ("spark://host:7077", False), ("yarn", False)])
def test_only_one_process_gets_a_folder_of_its_own(master, allowed):
    class Gone:
        def isDefined(self):  # noqa: N802
            return False

    class Jvm:
        def sc(self):
            return self

        def getCheckpointDir(self):  # noqa: N802
            return Gone()

    class Context:
        _jsc = Jvm()

        def setCheckpointDir(self, path):  # noqa: N802
            self.path = path

    class Session:
        sparkContext = Context()  # noqa: N815

        class conf:  # noqa: N801
            @staticmethod
            def get(key, default):
                return default

    Session.sparkContext.master = master
    if allowed:
        assert session.ensure_checkpoint_dir(Session()) == Session.sparkContext.path
    else:
        with pytest.raises(RuntimeError):
            session.ensure_checkpoint_dir(Session())

from collections import Counter

import pytest

from alinea.plans import skew
from alinea.plans.skew import skew_join
from alinea.plans.stage import shared_dir, staged


@pytest.mark.parametrize("few", [100_000, 0])
@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_joins_equal_plain_ones(spark, how, few, monkeypatch):
    monkeypatch.setattr(skew, "BROADCAST_ROWS", few)
    left = spark.createDataFrame([("hot", i, [i]) for i in range(300)] + [("a", 1, [1]), ("b", 2, None), (None, 3, [3])] * 2, "k string, v int, extra array<int>")
    right = spark.createDataFrame([("hot", 10), ("hot", 500), ("a", 7), (None, 1)], "k string, w int")
    rows = lambda df: Counter(str(r) for r in df.collect())
    plain, salted = (skew_join(left, right, ["k"], how, None, hot) for hot in (10**9, 20))
    assert plain.columns == salted.columns and rows(plain) == rows(salted)
    from pyspark.sql import functions as F

    also = F.col("w") > F.col("v")
    plain, salted = (skew_join(left, right, ["k"], how, also, hot) for hot in (10**9, 20))
    assert rows(plain) == rows(salted)
    assert skew_join(left.limit(0), right, ["k"], how, None, 1).count() == 0


def test_staged_tables_are_in_the_shared_folder(spark):
    df = staged(spark.range(5), "t")
    assert all(f.startswith("file:") and "alinea-" in f for f in df.inputFiles()) and df.count() == 5


def test_the_sessions_folder_is_taken_and_demanded_on_a_cluster():
    from types import SimpleNamespace as N

    session = lambda master, folder: N(conf=N(get=lambda *_: folder), sparkContext=N(master=master, applicationId="x"))
    assert shared_dir(session("spark://a:1", "hdfs://a/b/")) == "hdfs://a/b"
    with pytest.raises(ValueError):
        shared_dir(session("spark://a:1", None))

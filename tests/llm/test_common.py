from quaestor.llm import common


def test_stored_tables_can_be_dropped(spark):
    """A session's stored tables are read again until they are dropped; new ones can be stored after that."""
    df = common.stored(spark.range(5))
    assert df.count() == 5 and common.frozen(df).count() == 5
    common.drop_stored(spark)
    assert common.stored(spark.range(3)).count() == 3


def test_bounded_sample(spark):
    """Small tables stay whole; of large ones about as many rows as asked for, null and repeated keys not in one piece."""
    df = spark.range(40_000).selectExpr("IF(id % 2 = 0, NULL, id % 7) AS k", "id AS x")
    assert common.bounded_sample(df.limit(50), "k", 100).count() == 50
    assert 800 < common.bounded_sample(df, "k", 1000).count() < 1200
    assert common.bounded_sample(df, "k", 1).count() < 10

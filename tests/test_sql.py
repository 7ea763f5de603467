import pytest
from pyspark.sql import functions as F

from markwright.functions import sql, text


def test_sql_functions_agree(spark):
    names = sql.register(spark)
    assert "mw_canonicalize" in names
    rows = ["it's “ok”…  now\n \n\nа\u200bb \x0b x  ", "", "plain (text). Don’t!", "a\u3000b"]
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    df.createOrReplaceTempView("texts")
    got = spark.sql("SELECT mw_canonicalize(t) AS c, mw_tokenize(t) AS k, mw_canonical_hash(t) AS h FROM texts").collect()
    own = df.select(text.canonicalize(F.col("t"), False).alias("c"), text.tokenize(F.col("t")).alias("k"), text.canonical_hash(F.col("t")).alias("h")).collect()
    assert got == own
    assert spark.sql("SELECT mw_iou(0, 10, 5, 15)").first()[0] == pytest.approx(1 / 3)
    assert spark.sql("SELECT mw_message('h', 'm', 'c')").first()[0].endswith("|h|m|c")


def test_views(spark):
    assert sql.register_views(spark, "/root/testdata/sf0.001", ["canonical_hash"]) == ["mw_canonical_hash"]
    assert spark.sql("SELECT count(*) FROM mw_canonical_hash").first()[0] == 200

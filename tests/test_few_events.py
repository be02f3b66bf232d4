"""Bound queries on tables whose series hardly rise above their median, as the means of very many rows do."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tidewright.operators import onset as O
from tidewright.plans import REGISTRY
from tools.check import canon, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def flat(tmp_path_factory):
    """The smallest tables with one price everywhere but in one spring: a bloom in 1996 and no other."""
    folder = str(tmp_path_factory.mktemp("flat"))
    con = duckdb.connect()
    for t, price, day in (("lineitem", "l_extendedprice", "l_shipdate"), ("orders", "o_totalprice", "o_orderdate")):
        rise = f"CASE WHEN year({day}) = 1996 AND dayofyear({day}) BETWEEN 100 AND 140 THEN 300.0 ELSE 100.0 + year({day}) % 7 END::DOUBLE"
        con.execute(f"COPY (SELECT * REPLACE ({rise} AS {price}) FROM '{FOLDER}/{t}.parquet') TO '{folder}/{t}.parquet' (FORMAT parquet)")
    for t in "region nation customer supplier part events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"COPY (SELECT * FROM '{FOLDER}/{t}.parquet') TO '{folder}/{t}.parquet' (FORMAT parquet)")
    return folder


def same(spark, folder, name):
    got, want = REGISTRY[name].run(spark, folder).toPandas(), connect(folder).sql(REGISTRY[name].sql).df()
    spark.catalog.clearCache()
    assert canon(got) == canon(want)
    return got


def test_no_recipe_without_scores(spark):
    scores = spark.createDataFrame([("a", 1, 2, 0.5)], "recipe string, same_week long, within_one long, mae double")
    assert [r.recipe for r in O.best_recipe(scores, ["recipe"]).collect()] == ["a"]
    assert O.best_recipe(scores.where(F.lit(False)), ["recipe"]).collect() == []


def test_best_recipe_without_common_years(spark, flat, tmp_path):
    con = duckdb.connect()
    con.execute(f"COPY (SELECT * FROM '{flat}/orders.parquet' WHERE year(o_orderdate) <> 1996) TO '{tmp_path}/orders.parquet' (FORMAT parquet)")
    for t in "region nation customer supplier part lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"COPY (SELECT * FROM '{flat}/{t}.parquet') TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
    assert len(same(spark, str(tmp_path), "onset_best_recipe")) == 0


def test_links_with_few_common_years(spark, flat):
    links = same(spark, flat, "phenology_links")
    few = links[links.n < 5]
    assert len(few) and few[["r", "lo", "hi", "p"]].isna().all().all()

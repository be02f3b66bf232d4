"""Stored tables and files: the cube with pruned reads, stage tables, files with a preamble, and the choice of a step's file."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..session import new_folder
from ..sources import grids as G
from ..sources import outputs as OUT
from ..sources import tables as TB
from .base import Tables, query
from .bindings import CUBE, PAIRED, cube, paired

YEARS, STEPS = (1996, 1998), (31, 60)  # the time slice that is read


def store_cube(t: Tables) -> str:
    """The gridded fields of both variables as a store of long rows."""
    path = new_folder(t.spark, "cube")
    both = F.array(F.struct(F.lit("price").alias("var"), F.col("value").alias("v")), F.struct(F.lit("quantity").alias("var"), F.col("value2").alias("v")))
    G.write_cube(cube(t).select("year", "step", "row", "col", F.inline(both)), path)
    return path


@query("cube_slice", "var:s year:i step:i n:i v:f4", f"""{CUBE}, final AS (SELECT 'price' AS var, year, step, count(*) AS n, avg(value) AS v FROM cube
  WHERE year BETWEEN {YEARS[0]} AND {YEARS[1]} AND step BETWEEN {STEPS[0]} AND {STEPS[1]} GROUP BY 2, 3)""", covers="SRC-07")
def cube_slice(t: Tables):
    c = G.read_cube(t.spark, store_cube(t), variables=["price"], years=YEARS, steps=STEPS)
    return c.groupBy("var", "year", "step").agg(F.count("v").alias("n"), F.avg("v").alias("v"))


STAGE = "grp string, season string, obs double, model double, n long, year int"


@query("stage_round_trip", "fmt:s grp:s year:i season:s obs:f4 model:f4 n:i", f"""{PAIRED}, m AS (SELECT grp, year, season, CASE WHEN count(*) > 20 THEN avg(obs) END AS obs, avg(model) AS model, count(*) AS n FROM paired GROUP BY 1, 2, 3),
  final AS (SELECT fmt, m.* FROM m, (VALUES ('csv'), ('parquet')) v(fmt))""", covers="SNK-02")
def stage_round_trip(t: Tables):
    few = F.when(F.count(F.lit(1)) > 20, F.avg("obs"))  # a mean of few rows is missing, and must come back missing
    m = paired(t).groupBy("grp", "year", "season").agg(few.alias("obs"), F.avg("model").alias("model"), F.count(F.lit(1)).alias("n"))
    back = []
    for fmt in ("csv", "parquet"):
        path = new_folder(t.spark, f"stage-{fmt}")
        OUT.write_stage(m.select("grp", "season", "obs", "model", "n", "year"), path, fmt=fmt, partition_by=["year"])
        back.append(OUT.read_stage(t.spark, path, STAGE, fmt=fmt).withColumn("fmt", F.lit(fmt)))
    return back[0].unionByName(back[1])


PREAMBLE = 14  # lines before the column names of raw model output


def write_raw_output(t: Tables, path: str) -> None:
    """One text file a year: a preamble, a line of column names, a line for each line item."""
    year = F.year("l_shipdate")
    head = [*[f"note {i},," for i in range(PREAMBLE)], "key,quantity,price"]
    heads = t.lineitem.select(year.alias("year")).distinct().select("year", F.posexplode(F.array(*map(F.lit, head))).alias("no", "value"))
    body = t.lineitem.select(year.alias("year"), F.lit(1000).alias("no"), F.concat_ws(",", "l_orderkey", "l_quantity", "l_extendedprice").alias("value"))
    rows = heads.unionByName(body).repartition("year").sortWithinPartitions("year", "no")
    rows.select("year", "value").write.partitionBy("year").text(path)


@query("csv_preamble", "year:i n:i n_bad:i quantity:f2 price:f2", """final AS (SELECT year(l_shipdate) AS year, count(*) AS n, 0 AS n_bad, sum(l_quantity) AS quantity, sum(l_extendedprice) AS price FROM lineitem GROUP BY 1)""", covers="SRC-08")
def csv_preamble(t: Tables):
    path = new_folder(t.spark, "raw-output")
    write_raw_output(t, path)
    rows = TB.read_csv_skipping(t.spark, f"{path}/*/*.txt", "key long, quantity double, price double", PREAMBLE)
    year = F.regexp_extract("file", r"/year=(\d+)/", 1).cast("int")
    return rows.groupBy(year.alias("year")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.isnull("key")).alias("n_bad"), F.sum("quantity").alias("quantity"), F.sum("price").alias("price"))


FILES = """files AS (SELECT year(d) AS year, dayofyear(d) AS day, wide, '/in/no3' || CASE WHEN wide = 1 THEN '__' ELSE '_' END || year(d) || '_' || lpad(dayofyear(d)::VARCHAR, 3, '0') || '.asc' AS file
    FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS wide FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 300000)),
  centres AS (SELECT y AS year, s AS step, CASE WHEN s < 120 THEN s*3 - 1 WHEN (y % 4 = 0 AND y % 100 <> 0) OR y % 400 = 0 THEN 361 ELSE 360 END AS centre
    FROM (SELECT unnest(range(min(year), max(year) + 1)) AS y FROM files), range(1, 121) b(s)),
  offers AS (SELECT c.year, step, o, file, row_number() OVER (PARTITION BY c.year, step ORDER BY k, wide, file) AS place
    FROM centres c, (VALUES (1, 0), (2, 1), (3, 2), (4, -1), (5, -2)) v(k, o) JOIN files f ON f.year = c.year AND f.day = c.centre + o)"""


@query("file_fallback", "year:i step:i offset:i file:s", f"{FILES}, final AS (SELECT year, step, o AS \"offset\", file FROM offers WHERE place = 1)", covers="SRC-03")
def file_fallback(t: Tables):
    # The binding: a file exists for the days with a large urgent order.
    d = F.col("o_orderdate").cast("date")
    days = t.orders.where("o_orderpriority = '1-URGENT' AND o_totalprice > 300000").select(d.alias("d"), F.when(F.col("o_orderstatus") == "F", "_").otherwise("__").alias("mark")).distinct()
    files = days.select(F.concat(F.lit("/in/no3"), "mark", F.year("d").cast("string"), F.lit("_"), F.lpad(F.dayofyear("d").cast("string"), 3, "0"), F.lit(".asc")).alias("file"))
    return G.resolve_files(G.calendar_of(days.select(F.year("d").alias("year")), steps=cal.STEPS_PER_YEAR), files)

"""ASCII grid text to long tables and back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.calendar import pool_tail_doy, step_centre_doy
from ..functions.clean import grid_clean

HEADER_LINES = 6


def read_asc(spark: SparkSession, path: str, header_lines: int = HEADER_LINES) -> DataFrame:
    """All ASCII grids under ``path`` as (file, row, col, value); one task reads many whole small files."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    return parse_asc(raw, header_lines)


def parse_asc(raw: DataFrame, header_lines: int = HEADER_LINES) -> DataFrame:
    """(file, text) -> (file, row, col, value), rows and columns from 1; a text is one grid of fixed size."""
    lines = F.filter(F.split("text", r"\r?\n"), lambda x: F.trim(x) != "")
    body = raw.select("file", F.posexplode(F.slice(lines, header_lines + 1, F.size(lines))).alias("r", "line"))
    cells = body.select("file", (F.col("r") + 1).alias("row"), F.posexplode(F.split(F.trim("line"), r"\s+")).alias("c", "txt"))
    return cells.select("file", "row", (F.col("c") + 1).alias("col"), F.col("txt").try_cast("double").alias("value"))


def asc_header(raw: DataFrame) -> DataFrame:
    """Header entries of each grid text."""
    def entry(name: str, kind: str) -> Column:
        return F.regexp_extract("text", rf"(?im)^{name}\s+(\S+)", 1).try_cast(kind).alias(name.lower())

    return raw.select("file", entry("ncols", "int"), entry("nrows", "int"), entry("xllcorner", "double"),
                      entry("yllcorner", "double"), entry("cellsize", "double"), entry("NODATA_value", "double"))


def file_key(file: Column) -> dict[str, Column]:
    """var, year and step (or day of year) from ``{var}_{year}_{n}.asc``, one or two underscores, padded or not."""
    name = F.regexp_extract(file, r"([^/]+)\.asc$", 1)
    pat = r"^(.+?)_+(\d{4})_+(\d+)$"
    n = F.regexp_extract(name, pat, 3)
    return {
        "var": F.regexp_extract(name, pat, 1),
        "year": F.regexp_extract(name, pat, 2).try_cast("int"),
        "n": n.try_cast("int"),
        "is_running_step": F.length(n) == 5,
    }


def with_step(df: DataFrame, file: str = "file") -> DataFrame:
    """Add var, year and step. Year-end files keyed a few days off fall on the last step."""
    k = file_key(F.col(file))
    d = df.withColumns(k)
    step = F.when(F.col("is_running_step"), ((F.col("n") - 1) % 120 + 1).cast("int")).otherwise(pool_tail_doy(F.col("n")))
    return d.withColumn("step", step).drop("n", "is_running_step")


def calendar_of(df: DataFrame, year: str = "year", steps: int = 120) -> DataFrame:
    """Every (year, step) from the first to the last year of ``df``; one small row is expanded."""
    span = df.agg(F.min(year).cast("int").alias("a"), F.max(year).cast("int").alias("b")).where("a IS NOT NULL")
    years = span.select(F.explode(F.sequence("a", "b")).alias("year"))
    return years.select("year", F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step"))


#: Days around a block's centre at which its file is looked for, in order. Fixed values.
OFFSETS = (0, 1, 2, -1, -2)


def resolve_files(calendar: DataFrame, files: DataFrame, keys: Sequence[str] = (), offsets: Sequence[int] = OFFSETS) -> DataFrame:
    """One file for each step of the calendar: (keys, year, step, offset, file), none where no file fits.

    ``calendar`` has year and step, ``files`` has ``keys`` and file, named ``{var}_{year}_{day}.asc``. The first offset from the block's
    centre for which a file exists wins; between two spellings of one day the single underscore wins. Each file is offered
    to the few centres it could serve, and the offers of a step are reduced before they are shuffled.
    """
    keys = list(keys)
    k = file_key(F.col("file"))
    named = files.select(*keys, "file", k["year"].alias("year"), k["n"].alias("__day"), F.col("file").rlike(r"__\d{4}_+\d+\.asc$").cast("int").alias("__wide"))
    order = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(o).alias("offset")) for i, o in enumerate(offsets)])
    offers = named.select(*keys, "file", "year", "__day", "__wide", F.inline(order)).withColumn("__centre", F.col("__day") - F.col("offset"))
    centres = calendar.select("year", "step").withColumn("__centre", step_centre_doy(F.col("year"), F.col("step")))
    best = F.min(F.struct("rank", "__wide", "file", "offset")).alias("__best")
    found = offers.join(centres, ["year", "__centre"]).groupBy(*keys, "year", "step").agg(best)
    return found.select(*keys, "year", "step", F.col("__best.offset").alias("offset"), F.col("__best.file").alias("file"))


def missing_steps(field: DataFrame, calendar: DataFrame) -> DataFrame:
    """Calendar steps without any value."""
    return calendar.select("year", "step").join(field.select("year", "step").distinct(), ["year", "step"], "left_anti")


def build_cube(cells: DataFrame, grid: DataFrame, *, corner: tuple[int, int] | None = None) -> DataFrame:
    """Cleaned cells with grid coordinates. The grid is a dimension table; its join side is left to the optimiser."""
    v = grid_clean(F.col("value"), F.col("row"), F.col("col"), corner)
    return cells.withColumn("value", v).join(grid, ["row", "col"])


STEPS_PER_FILE = 30


def write_cube(cube: DataFrame, path: str, steps_per_file: int = STEPS_PER_FILE) -> None:
    """Columnar store split by variable and year, clustered by time inside a file for range pruning.

    A year of a variable is dealt out by blocks of steps, so that one task writes a block of a fine grid and not a whole year.
    """
    block = F.floor((F.col("step") - 1) / steps_per_file)
    dealt = cube.repartition(F.col("var"), F.col("year"), block).sortWithinPartitions("var", "year", "step", "row", "col")
    dealt.write.mode("overwrite").partitionBy("var", "year").parquet(path)


def read_cube(spark: SparkSession, path: str, *, variables: Sequence[str] | None = None, years: tuple[int, int] | None = None,
              steps: tuple[int, int] | None = None) -> DataFrame:
    """Slice of a stored cube; variables and years prune folders, steps reach the Parquet filters."""
    c = spark.read.parquet(path)
    if variables:
        c = c.where(F.col("var").isin(list(variables)))
    if years:
        c = c.where(F.col("year").between(*years))
    if steps:
        c = c.where(F.col("step").between(*steps))
    return c


def start_later(calendar: DataFrame, series: DataFrame, values: Sequence[str], start_year: int) -> DataFrame:
    """Full calendar with NULL before a variable's first year and where it has no data."""
    j = calendar.join(series, ["year", "step"], "left")
    return j.withColumns({v: F.when(F.col("year") >= start_year, F.col(v)) for v in values})


def asc_lines(field: DataFrame, keys: Sequence[str], *, row: str = "row", col: str = "col", value: str = "value", decimals: int = 2,
              row_range: tuple[int, int] | None = None, col_range: tuple[int, int] | None = None, reverse_rows: bool = False,
              mask: Column | None = None, fill: float = 0.0) -> DataFrame:
    """One text line per grid row: cropped, masked, missing as ``fill``, fixed decimals, columns in order.

    The only collected group is one row of one grid, whose length is the grid width.
    """
    f = field
    if row_range:
        f = f.where(F.col(row).between(*row_range))
    if col_range:
        f = f.where(F.col(col).between(*col_range))
    v = F.col(value) if mask is None else F.when(mask, F.col(value))
    v = F.coalesce(F.when(~F.isnan(v.cast("double")), v), F.lit(fill))
    f = f.select(*keys, row, col, F.format_string(f"%.{decimals}f", v.cast("double")).alias("__t"))
    lines = f.groupBy(*keys, row).agg(F.array_sort(F.collect_list(F.struct(F.col(col), "__t"))).alias("__l"))
    order = -F.col(row) if reverse_rows else F.col(row)
    return lines.select(*keys, order.alias("line_no"), F.array_join(F.transform("__l", lambda x: x["__t"]), " ").alias("line"))


def write_asc(field: DataFrame, path: str, keys: Sequence[str], *, header: str | None = None, **crop) -> None:
    """One folder per key with one text file of ordered lines."""
    lines = asc_lines(field, keys, **crop)
    if header:
        heads = lines.select(*keys).distinct().withColumns({"line_no": F.lit(-(2**31)), "line": F.lit(header)})
        lines = lines.unionByName(heads)
    lines.repartition(*keys).sortWithinPartitions(*keys, "line_no").select(*keys, "line").write.mode("overwrite").partitionBy(*keys).text(path)

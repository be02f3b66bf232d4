"""Least squares from grouped cross-product sums.

Rows only ever contribute to sums (with map-side combine); the small systems, one per group, are solved in
vectorised pandas functions. Rank-deficient systems get the minimum-norm solution.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import attach_one, null_safe_join, salted_join, with_group_stats


def _poly_solver(degree: int):
    size = degree + 1

    @F.pandas_udf("array<double>")
    def solve(sums: pd.Series, rhs: pd.Series) -> pd.Series:
        s = np.array(sums.tolist(), dtype=float)
        b = np.array(rhs.tolist(), dtype=float)
        idx = np.add.outer(np.arange(size), np.arange(size))
        beta = np.linalg.pinv(s[:, idx], rcond=1e-13, hermitian=True) @ b[:, :, None]
        return pd.Series(list(beta[:, :, 0]))

    return solve


def poly_coefficients(df: DataFrame, keys: Sequence[str], t: Column, ys: Sequence[str], degree: int = 3) -> DataFrame:
    """Coefficients of y on 1, t, ..., t^degree per group, one array column ``b_<y>`` per y."""
    keys = list(keys)
    d = df.where(F.col(ys[0]).isNotNull()).withColumn("__t", t)
    powers = [F.sum(F.pow("__t", F.lit(k))) for k in range(2 * degree + 1)]
    sums = d.groupBy(*keys).agg(
        F.array(*powers).alias("__s"),
        *[F.array(*[F.sum(F.col(y) * F.pow("__t", F.lit(k))) for k in range(degree + 1)]).alias(f"__y_{y}") for y in ys])
    solve = _poly_solver(degree)
    return sums.select(*keys, *[solve("__s", f"__y_{y}").alias(f"b_{y}") for y in ys])


def poly_value(b: Column, t: Column, degree: int = 3) -> Column:
    out = F.get(b, F.lit(degree))
    for k in range(degree - 1, -1, -1):
        out = out * t + F.get(b, F.lit(k))
    return out


def poly_residuals(df: DataFrame, keys: Sequence[str], x: str, ys: Sequence[str], degree: int = 3) -> DataFrame:
    """Rows with ``<y>_res``: residual of a polynomial in x fitted per group (x scaled by group mean and SD)."""
    d = with_group_stats(df, keys, [x, *ys], __xm=F.avg(x), __xs=F.stddev_pop(x))
    d = d.withColumn("__t", (F.col(x) - F.col("__xm")) / F.greatest(F.col("__xs"), F.lit(1.0)))
    coef = poly_coefficients(d, keys, F.col("__t"), ys, degree)
    d = salted_join(d, coef, list(keys), [x, *ys])
    d = d.withColumns({f"{y}_res": F.col(y) - poly_value(F.col(f"b_{y}"), F.col("__t"), degree) for y in ys})
    return d.drop("__xm", "__xs", "__t", *[f"b_{y}" for y in ys])


def yearly_residuals(df: DataFrame, keys: Sequence[str], x: str, ys: Sequence[str], *, year: str = "year",
                     tow: str = "tow", centre: Column, scale: float, degree: int = 3) -> DataFrame:
    """Yearly means of the residuals of a per-group polynomial, without touching rows a second time.

    The mean residual of a year is the year's mean of y minus the coefficients times the year's mean powers, so
    the (group, year) sums serve both the fit and the result.
    """
    keys = list(keys)
    d = df.withColumn("__t", (F.col(x) - centre) / F.lit(scale))
    a = d.groupBy(*keys, year).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct(tow).alias("n_tows"), F.avg(x).alias(f"mean_{x}"),
        F.array(*[F.sum(F.pow("__t", F.lit(k))) for k in range(2 * degree + 1)]).alias("__s"),
        *[F.array(*[F.sum(F.col(y) * F.pow("__t", F.lit(k))) for k in range(degree + 1)]).alias(f"__y_{y}") for y in ys])
    g = a.groupBy(*keys).agg(
        F.array(*[F.sum(F.get("__s", F.lit(k))) for k in range(2 * degree + 1)]).alias("__gs"),
        *[F.array(*[F.sum(F.get(f"__y_{y}", F.lit(k))) for k in range(degree + 1)]).alias(f"__gy_{y}") for y in ys])
    solve = _poly_solver(degree)
    coef = g.select(*keys, *[solve("__gs", f"__gy_{y}").alias(f"b_{y}") for y in ys])
    a = null_safe_join(a, coef, keys)
    out = {}
    for y in ys:
        fit = F.lit(0.0)
        for k in range(degree + 1):
            fit = fit + F.get(f"b_{y}", F.lit(k)) * F.get("__s", F.lit(k))
        out[f"{y}_res"] = (F.get(f"__y_{y}", F.lit(0)) - fit) / F.col("n")
        out[f"{y}_mean"] = F.get(f"__y_{y}", F.lit(0)) / F.col("n")
    return a.withColumns(out).select(*keys, year, "n", "n_tows", f"mean_{x}", *out)


@dataclass(frozen=True)
class Terms:
    """Design of a linear model: categorical factors, numeric columns and polynomials in scaled columns."""

    factors: tuple[str, ...] = ()
    numeric: tuple[str, ...] = ()
    poly: tuple[tuple[str, int], ...] = ()
    name: str = "model"

    def without(self, term: str) -> "Terms":
        return Terms(tuple(f for f in self.factors if f != term), tuple(n for n in self.numeric if n != term),
                     tuple(p for p in self.poly if p[0] != term), f"without {term}")

    @property
    def labels(self) -> list[str]:
        return [*self.factors, *self.numeric, *[p[0] for p in self.poly]]


_FIT_SCHEMA = "model string, term string, level string, effect double, n_terms int, rank int, r2 double, n long"


def _design(models: Sequence[Terms]) -> tuple[list[str], list[str], dict[str, int]]:
    """Factors, numeric columns and degrees of the polynomials over all models."""
    degree: dict[str, int] = {}
    for m in models:
        for c, deg in m.poly:
            degree[c] = max(deg, degree.get(c, 0))
    return sorted({f for m in models for f in m.factors}), sorted({n for m in models for n in m.numeric}), degree


def design_sums(df: DataFrame, keys: Sequence[str], ys: Sequence[str], models: Sequence[Terms]) -> DataFrame:
    """One row per key and combination of factor levels and numeric values: count, sum and sum of squares of each response.

    The fits of every response and model follow from it, and the rows are read once. It pays where the numeric columns take
    few values (days, months, flags); with continuous ones it has as many rows as the table.
    """
    factors, numeric, degree = _design(models)
    by = list(dict.fromkeys([*keys, *factors, *numeric, *degree]))
    aggs = [a for y in ys for a in (F.count(y).cast("double").alias(f"__n_{y}"), F.sum(y).alias(f"__s_{y}"), F.sum(F.col(y) * F.col(y)).alias(f"__q_{y}"))]
    return df.groupBy(*by).agg(*aggs)


def cross_products(df: DataFrame, keys: Sequence[str], y: str, models: Sequence[Terms]) -> DataFrame:
    """Sparse cross-product sums (keys, i, j, p) over the union of all terms of ``models``.

    Rows, or those of ``design_sums``, are first reduced to one record per combination of factor levels holding the dense
    sums of the numeric part, with map-side combine; only those records are spread over term pairs.
    """
    keys = list(keys)
    factors, numeric, degree = _design(models)
    n, s, q = (f"__{a}_{y}" for a in "nsq")
    d = df if n in df.columns else df.where(F.col(y).isNotNull()).withColumns({n: F.lit(1.0), s: F.col(y).cast("double"), q: F.col(y).cast("double") * F.col(y)})
    d = d.where(F.col(n) > 0)
    for c in [*numeric, *degree]:
        d = d.where(F.col(c).isNotNull())
    for c in sorted(degree):
        # The same centre and spread whether a row stands for itself or for many.
        mean = F.sum(F.col(n) * F.col(c)) / F.sum(n)
        d = with_group_stats(d, keys, [c, s], __m=mean, __v=F.sum(F.col(n) * F.col(c) * F.col(c)) / F.sum(n) - mean * mean)
        spread = F.greatest(F.sqrt(F.greatest("__v", F.lit(0.0))), F.lit(1.0))
        d = d.withColumn(f"__z_{c}", (F.col(c) - F.col("__m")) / spread).drop("__m", "__v")
    dense: list[tuple[str, Column]] = [("(1)", F.lit(1.0))]
    dense += [(c, F.col(c).cast("double")) for c in numeric]
    dense += [(f"{c}^{k}", F.pow(F.col(f"__z_{c}"), F.lit(k))) for c in sorted(degree) for k in range(1, degree[c] + 1)]
    last = len(dense)
    dense.append(("(y)", F.col(s)))
    pairs = [(i, j) for i in range(len(dense)) for j in range(i, len(dense))]
    lv = [F.concat(F.lit(f"{f}="), F.coalesce(F.col(f).cast("string"), F.lit("-"))).alias(f"__f{k}") for k, f in enumerate(factors)]
    d = d.select(*keys, *lv, F.col(n).alias("__n"), F.col(q).alias("__q"), *[c.alias(f"__d{i}") for i, (_, c) in enumerate(dense)])

    def product(i: int, j: int) -> Column:
        if j < last:
            return F.col("__n") * F.col(f"__d{i}") * F.col(f"__d{j}")
        return F.col("__q") if i == last else F.col(f"__d{i}") * F.col(f"__d{j}")

    sums = d.groupBy(*keys, *[f"__f{k}" for k in range(len(factors))]).agg(*[F.sum(product(i, j)).alias(f"__p{i}_{j}") for i, j in pairs])

    def entry(i: Column, j: Column, p: str) -> Column:
        return F.struct(F.least(i, j).alias("i"), F.greatest(i, j).alias("j"), F.col(p).alias("p"))

    entries = [entry(F.lit(dense[i][0]), F.lit(dense[j][0]), f"__p{i}_{j}") for i, j in pairs]
    for n in range(len(factors)):
        entries += [entry(F.col(f"__f{n}"), F.lit(dense[i][0]), f"__p0_{i}") for i in range(len(dense))]
        entries += [entry(F.col(f"__f{n}"), F.col(f"__f{o}"), "__p0_0") for o in range(n, len(factors))]
    return sums.select(*keys, F.inline(F.array(*entries))).groupBy(*keys, "i", "j").agg(F.sum("p").alias("p"))


def _matrix(pdf: pd.DataFrame) -> tuple[np.ndarray, list[str]]:
    """The full cross-product matrix of one group's sums, and the names of its terms."""
    names = sorted(set(pdf["i"]) | set(pdf["j"]))
    pos = {n: i for i, n in enumerate(names)}
    g = np.zeros((len(names), len(names)))
    ii, jj = pdf["i"].map(pos).to_numpy(), pdf["j"].map(pos).to_numpy()
    g[ii, jj] = pdf["p"].to_numpy()
    g[jj, ii] = pdf["p"].to_numpy()
    return g, names


def _solve_models(g: np.ndarray, names: list[str], models: Sequence[Terms]) -> pd.DataFrame:
    """Effects of every model from the union cross-product matrix of one group."""
    pos = {n: i for i, n in enumerate(names)}
    yi, one = pos["(y)"], pos["(1)"]
    n_obs = g[one, one]
    sst = g[yi, yi] - g[one, yi] ** 2 / n_obs
    out = []
    for m in models:
        use, base = ["(1)"], []
        for f in m.factors:
            levels = [n for n in names if n.startswith(f"{f}=")]
            base += levels[:1]
            use += levels[1:]
        use += list(m.numeric) + [f"{c}^{k}" for c, deg in m.poly for k in range(1, deg + 1)]
        k = [pos[n] for n in use]
        xtx, xty = g[np.ix_(k, k)], g[k, yi]
        scale = np.sqrt(np.where(np.diag(xtx) > 0, np.diag(xtx), 1.0))
        gs = xtx / np.outer(scale, scale)
        beta = (np.linalg.pinv(gs, rcond=1e-11, hermitian=True) @ (xty / scale)) / scale
        sse = g[yi, yi] - 2 * beta @ xty + beta @ xtx @ beta
        terms = [*use, *base]
        out.append(pd.DataFrame({
            "model": m.name,
            "term": [n.split("=", 1)[0] for n in terms],
            "level": [n.split("=", 1)[1] if "=" in n else "" for n in terms],
            "effect": [*beta.astype(float), *[0.0] * len(base)],
            "n_terms": len(use),
            "rank": int(np.linalg.matrix_rank(gs, tol=1e-9, hermitian=True)),
            "r2": float(1 - sse / sst) if sst > 0 else np.nan,
            "n": int(round(n_obs)),
        }))
    return pd.concat(out, ignore_index=True)


def fit_terms(df: DataFrame, keys: Sequence[str], y: str, models: Sequence[Terms], max_terms: int | None = None) -> DataFrame:
    """Fit several linear models per group in one job; one row per model and term (baseline levels included).

    Rows with a missing response or numeric term are left out. The sums of a group are bounded by the square of
    its number of terms, so a factor whose levels grow with the data belongs in ``absorbed_effects``; ``max_terms``
    checks the number before solving. The first level of a factor in text order is the
    baseline with effect 0.
    """
    keys = list(keys)
    gram = cross_products(df, keys, y, models)
    key_schema = ", ".join(f"`{k}` {t}" for k, t in gram.dtypes if k in keys)

    def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        g, names = _matrix(pdf)
        if max_terms is not None and len(names) > max_terms:
            raise ValueError(f"{len(names)} terms in group {key}: more than {max_terms}")
        res = _solve_models(g, names, models)
        for i, k in enumerate(keys):
            res[k] = key[i]
        return res[[*keys, *[c.split()[0] for c in _FIT_SCHEMA.split(", ")]]]

    schema = ", ".join(x for x in (key_schema, _FIT_SCHEMA) if x)
    if keys:
        return gram.groupBy(*keys).applyInPandas(solve, schema)
    return gram.groupBy(F.lit(1).alias("__all")).applyInPandas(solve, schema)


def factor_effects(fits: DataFrame, keys: Sequence[str], factor: str) -> DataFrame:
    """Effects of one factor, centred on their unweighted mean."""
    from pyspark.sql import Window as W

    f = fits.where(F.col("term") == factor)
    w = W.partitionBy(*keys, "model")
    return f.select(*keys, "model", F.col("level"), (F.col("effect") - F.avg("effect").over(w)).alias("effect"), "r2", "n")


def absorbed_effects(df: DataFrame, keys: Sequence[str], y: str, model: Terms, factor: str) -> DataFrame:
    """``factor_effects`` of one model for a factor of any number of levels; only the other terms are solved densely.

    The between-level part is taken off the sums of the other terms, which leaves their within-level system. A level's
    effect is its mean response less the other terms' part, and the effects are centred on their unweighted mean.
    """
    keys = list(keys)
    gram = cross_products(df, keys, y, [model]).persist(StorageLevel.MEMORY_AND_DISK)
    of_i, of_j = (F.startswith(F.col(c), F.lit(f"{factor}=")) for c in ("i", "j"))
    cross = gram.where(of_i != of_j).select(*keys, F.when(of_i, F.col("i")).otherwise(F.col("j")).alias("level"),
                                            F.struct(F.when(of_i, F.col("j")).otherwise(F.col("i")).alias("t"), "p").alias("c"))
    # A level's sums with the other terms; the one with the intercept is its number of rows.
    levels = cross.groupBy(*keys, "level").agg(F.collect_list("c").alias("c"), F.max(F.when(F.col("c.t") == "(1)", F.col("c.p"))).alias("n_level"))
    pairs = levels.select(*keys, "n_level", "c", F.explode("c").alias("a")).select(*keys, "n_level", "a", F.explode("c").alias("b"))
    between = pairs.where("a.t <= b.t").select(*keys, F.col("a.t").alias("i"), F.col("b.t").alias("j"), (F.col("a.p") * F.col("b.p") / F.col("n_level")).alias("b"))
    rest = gram.where(~of_i & ~of_j).withColumn("b", F.lit(0.0)).unionByName(between.withColumn("p", F.lit(0.0)))
    rest = rest.groupBy(*keys, "i", "j").agg(F.sum("p").alias("p"), F.sum("b").alias("b"))
    others = model.without(factor)

    def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(pdf["i"]) | set(pdf["j"]))
        pos = {n: i for i, n in enumerate(names)}
        ii, jj = pdf["i"].map(pos).to_numpy(), pdf["j"].map(pos).to_numpy()
        g, w = np.zeros((2, len(names), len(names)))
        for m, v in ((g, pdf["p"].to_numpy()), (w, (pdf["p"] - pdf["b"]).to_numpy())):
            m[ii, jj] = v
            m[jj, ii] = v
        use = [n for f in others.factors for n in [n for n in names if n.startswith(f"{f}=")][1:]]
        use += list(others.numeric) + [f"{c}^{k}" for c, deg in others.poly for k in range(1, deg + 1)]
        k, yi, one = [pos[n] for n in use], pos["(y)"], pos["(1)"]
        xtx, xty = w[np.ix_(k, k)], w[k, yi]
        # What the levels explain whole is noise beside the raw sum, and gets the effect 0.
        scale = np.sqrt(np.maximum(np.diag(xtx), 0.0))
        scale = np.where(scale**2 > 1e-11 * np.diag(g)[k], scale, np.inf)
        beta = (np.linalg.pinv(xtx / np.outer(scale, scale), rcond=1e-11, hermitian=True) @ (xty / scale)) / scale
        sse = w[yi, yi] - 2 * beta @ xty + beta @ xtx @ beta
        sst = g[yi, yi] - g[one, yi] ** 2 / g[one, one]
        out = {"beta": [dict(zip(use, map(float, beta)))], "r2": [float(1 - sse / sst) if sst > 0 else np.nan], "n": [int(round(g[one, one]))]}
        return pd.DataFrame({kk: [v] for kk, v in zip(keys, key)} | out)

    schema = ", ".join([*[f"`{k}` {t}" for k, t in gram.dtypes if k in keys], "beta map<string,double>, r2 double, n long"])
    fits = rest.groupBy(*(keys or [F.lit(1).alias("__all")])).applyInPandas(solve, schema)
    attach = lambda a, b: null_safe_join(a, b, keys) if keys else attach_one(a, b)
    part = lambda x: F.when(x.t == "(y)", x.p).otherwise(-x.p * F.coalesce(F.try_element_at("beta", x.t), F.lit(0.0)))
    e = attach(levels, fits)
    e = e.withColumn("effect", F.aggregate("c", F.lit(0.0), lambda s, x: s + part(x)) / F.col("n_level"))
    e = attach(e, e.groupBy(*keys).agg(F.avg("effect").alias("__mean")))
    return e.select(*keys, F.lit(model.name).alias("model"), F.expr(f"substr(level, {len(factor) + 2})").alias("level"),
                    (F.col("effect") - F.col("__mean")).alias("effect"), "r2", "n")


def year_index(df: DataFrame, keys: Sequence[str], y: str, *, year: str = "year", models: Sequence[Terms]) -> DataFrame:
    """Centred year effects for each control set."""
    e = factor_effects(fit_terms(df, keys, y, models), keys, year)
    return e.select(*keys, "model", F.col("level").cast("int").alias("year"), F.col("effect").alias("index"))


def corrected_year_index(df: DataFrame, keys: Sequence[str], y: str, *, year: str = "year", corrections: Sequence[Terms]) -> DataFrame:
    """Year index under each correction by two methods, as rows (keys, correction, method, year, index, n).

    ``residual-then-average`` fits the correction alone and takes the mean residual of a year; what differs between years can
    vanish in the correction. ``joint`` fits year effects along with it. A year's mean residual is its mean response less the
    coefficients times its mean terms, so one table of sums serves all corrections and both methods, and rows are read once.
    Indices are centred on their unweighted mean over the years. Rows without a response or a numeric term are left out.
    """
    keys = list(keys)
    joint = [Terms((year, *c.factors), c.numeric, c.poly, c.name) for c in corrections]
    gram = cross_products(df, keys, y, joint)
    key_schema = [f"`{k}` {t}" for k, t in gram.dtypes if k in keys]

    def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        g, names = _matrix(pdf)
        pos = {n: i for i, n in enumerate(names)}
        years = [n for n in names if n.startswith(f"{year}=")]
        at, count = [pos[n] for n in years], g[[pos[n] for n in years], pos["(1)"]]
        parts = []
        for method, models in (("residual-then-average", corrections), ("joint", joint)):
            fits = _solve_models(g, names, models)
            fits["name"] = fits["term"].where(~fits["term"].isin([f for m in models for f in m.factors]), fits["term"] + "=" + fits["level"])
            for m in models:
                beta = fits[fits["model"] == m.name].set_index("name")["effect"]
                if method == "joint":
                    index = beta.reindex(years).to_numpy()
                else:
                    index = (g[at, pos["(y)"]] - g[np.ix_(at, [pos[n] for n in beta.index])] @ beta.to_numpy()) / count
                parts.append(pd.DataFrame({"correction": m.name, "method": method, year: [n.split("=", 1)[1] for n in years], "index": index - index.mean(), "n": count.round().astype(int)}))
        out = pd.concat(parts, ignore_index=True)
        for k, v in zip(keys, key):
            out[k] = v
        return out[[*keys, "correction", "method", year, "index", "n"]]

    schema = ", ".join([*key_schema, f"correction string, method string, `{year}` string, index double, n long"])
    return gram.groupBy(*(keys or [F.lit(1).alias("__all")])).applyInPandas(solve, schema)


def drop_one_r2(df: DataFrame, keys: Sequence[str], y: str, full: Terms) -> DataFrame:
    """R2 of the full model and the part lost when each term is left out."""
    full = Terms(full.factors, full.numeric, full.poly, "full")
    fits = fit_terms(df, keys, y, [full, *[full.without(t) for t in full.labels]])
    one = fits.where("term = '(1)'").select(*keys, "model", "r2", "n")
    base = one.where("model = 'full'").select(*keys, F.col("r2").alias("full_r2"))
    lost = one.where("model <> 'full'")
    j = null_safe_join(lost, base, keys) if keys else attach_one(lost, base)
    return j.select(*keys, F.regexp_replace("model", "^without ", "").alias("dropped"), "full_r2",
                    (F.col("full_r2") - F.col("r2")).alias("unique_r2"), "n")


def degree_bins(df: DataFrame, keys: Sequence[str], temp: str | dict[str, Column], value: str, width: float = 1.0, min_n: int = 3,
                use_mean: bool = False) -> DataFrame:
    """Response by right-closed temperature bins: median (or mean) value and mean temperature.

    ``temp`` is a column, or a name for each of several temperatures of a row; then a column ``source`` tells them apart, and the rows
    are read and binned once for all of them. Bins start at the whole degree below the least temperature of their source.
    """
    from .quantiles import grouped_quantiles

    several = isinstance(temp, dict)
    temps = temp if several else {"": F.col(temp)}
    d = df.where(F.col(value).isNotNull()).select(*keys, F.col(value), *[t.alias(f"__t{i}") for i, t in enumerate(temps.values())])
    low = d.agg(*[F.floor(F.min(f"__t{i}")).alias(f"__lo{i}") for i in range(len(temps))])
    each = [F.struct(F.lit(s).alias("source"), F.col(f"__t{i}").alias("__t"), F.col(f"__lo{i}").alias("__lo")) for i, s in enumerate(temps)]
    d = attach_one(d, low).select(*keys, value, F.inline(F.array(*each))).where(F.col("__t") > F.col("__lo"))
    d = d.withColumn("bin", (F.ceil((F.col("__t") - F.col("__lo")) / width) - 1) * width + F.col("__lo"))
    by = [*keys, "source", "bin"]
    a = d.groupBy(*by).agg(F.avg("__t").alias("temp"), F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n"))
    a = a.where(F.col("n") >= min_n)
    if use_mean:
        a = a.withColumnRenamed("mean", "response")
    else:
        a = null_safe_join(a.drop("mean"), grouped_quantiles(d, by, value, {"response": 0.5}), by)
    return a if several else a.drop("source")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, inside a higher-order function."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def thermal_curve_grid(binned: DataFrame, keys: Sequence[str], *, temp: str = "temp", value: str = "response", log: bool = False,
                       topt: tuple[float, float] = (0.0, 30.0), rate: tuple[float, float] = (0.0, 1.0),
                       points: int = 11, rounds: int = 8, min_rows: int = 5) -> DataFrame:
    """Two-sided Gaussian response per group by refined grid search: topt, a, b, c, n, rmse and aic.

    y = c exp(-a (T - Topt)^2) left of Topt and c exp(-b (T - Topt)^2) right of it, each parameter inside its bounds, which an
    optimum may touch; ``log`` fits log(1 + value). The height c >= 0 has a closed form. Given Topt, the sums of the left
    points depend on a alone and those of the right points on b alone, so a round costs points^2 passes over the points.
    A group is one short array of its bins (``degree_bins`` bounds their number), and all rounds run inside one projection:
    no shuffle, no scan and no table between them. Candidates whose share of unexplained squares is equal to nine digits
    count as equal; the least Topt, a and b among them win.
    """
    keys = list(keys)
    y = F.log1p(F.col(value).cast("double")) if log else F.col(value).cast("double")
    d = binned.where(F.col(temp).isNotNull() & F.col(value).isNotNull()).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(F.col(temp).cast("double").alias("x"), y.alias("y")))).alias("pts"),
        F.count(F.lit(1)).alias("n"), F.sum(y * y).alias("yy"),
    ).where(F.col("n") >= min_rows)
    bounds = {"t": topt, "a": rate, "b": rate}

    def grid(box: Column, name: str) -> Column:
        lo, hi = box[f"lo_{name}"], box[f"hi_{name}"]
        return F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: lo + (hi - lo) * i / (points - 1))

    def sums(t: Column, r: Column, left: bool) -> Column:
        def add(s: Column, q: Column) -> Column:
            dt = q["x"] - t
            e = F.when((q["x"] <= t) if left else (q["x"] > t), F.exp(-r * dt * dt)).otherwise(0.0)
            return F.struct((s["sy"] + e * q["y"]).alias("sy"), (s["ss"] + e * e).alias("ss"))

        both = F.aggregate("pts", F.struct(F.lit(0.0).alias("sy"), F.lit(0.0).alias("ss")), add)
        return _let(both, lambda m: F.struct(r.alias("r"), m["sy"].alias("sy"), m["ss"].alias("ss")))

    def scored(t: Column, left: Column, right: Column) -> Column:
        sy, ss = left["sy"] + right["sy"], left["ss"] + right["ss"]
        c = F.greatest(F.lit(0.0), sy / F.greatest(ss, F.lit(1e-300)))
        sse = F.greatest(F.lit(0.0), F.col("yy") - 2 * c * sy + c * c * ss)
        return F.struct(F.round(sse / F.greatest("yy", F.lit(1e-300)), 9).alias("off"), t.alias("t"), left["r"].alias("a"), right["r"].alias("b"), c.alias("c"), sse.alias("sse"))

    def at(box: Column, t: Column) -> Column:
        left = F.transform(grid(box, "a"), lambda r: sums(t, r, True))
        right = F.transform(grid(box, "b"), lambda r: sums(t, r, False))
        pairs = _let(right, lambda rs: F.flatten(F.transform(left, lambda one: F.transform(rs, lambda other: scored(t, one, other)))))
        return F.array_min(pairs)

    def narrowed(box: Column, _: Column) -> Column:
        best = F.array_min(F.transform(grid(box, "t"), lambda t: at(box, t)))

        def around(f: Column) -> Column:
            out = [f.alias("best")]
            for name, (lo, hi) in bounds.items():
                reach = (box[f"hi_{name}"] - box[f"lo_{name}"]) * 0.15
                out += [F.greatest(f[name] - reach, F.lit(float(lo))).alias(f"lo_{name}"), F.least(f[name] + reach, F.lit(float(hi))).alias(f"hi_{name}")]
            return F.struct(*out)

        return _let(best, around)

    none = F.struct(*[F.lit(0.0).alias(c) for c in ("off", "t", "a", "b", "c", "sse")])
    box = F.struct(none.alias("best"), *[F.lit(float(v)).alias(f"{side}_{name}") for name, b in bounds.items() for side, v in zip(("lo", "hi"), b)])
    d = d.withColumn("f", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), box, narrowed)["best"])
    mse = F.col("f.sse") / F.col("n")
    return d.select(*keys, F.col("f.t").alias("topt"), *[F.col(f"f.{c}").alias(c) for c in "abc"], "n", F.sqrt(mse).alias("rmse"), (F.col("n") * F.log(mse) + 8).alias("aic"))


def flag_best(fits: DataFrame, keys: Sequence[str], score: str = "aic") -> DataFrame:
    """Mark the lowest score of each group."""
    from pyspark.sql import Window as W

    return fits.withColumn("best", F.col(score) == F.min(score).over(W.partitionBy(*keys)))

"""Elasticities: per-SKU regressions from moments, model choice, imputation from similar SKUs."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillmark.functions.exprs import safe_div
from tillmark.operators.joins import join_keys, with_group
from tillmark.session import stage


def fit_elasticity(df: DataFrame, by: Sequence[str], price: str, quantity: str, form: str = "loglog", min_rows: int = 3) -> DataFrame:
    """One-predictor regression per group: elasticity, intercept, R2 and RMSE.

    ``loglog``: slope of log quantity on log price. ``linear``: slope times price over predicted quantity,
    averaged. Only moments are shuffled, so the rows of a group never meet in one task.
    """
    used = df.filter((F.col(price) > 0) & (F.col(quantity) > 0))
    x, y = (F.ln(price), F.ln(quantity)) if form == "loglog" else (F.col(price), F.col(quantity))
    used = used.withColumn("__x", x).withColumn("__y", y)
    fit = used.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.regr_slope("__y", "__x").alias("slope"),
        F.regr_intercept("__y", "__x").alias("intercept"),
        F.regr_r2("__y", "__x").alias("r2"),
        F.regr_syy("__y", "__x").alias("__syy"),
    ).filter((F.col("n") >= min_rows) & F.col("slope").isNotNull())
    rmse = F.sqrt(F.greatest(F.col("__syy") * (1 - F.col("r2")) / F.col("n"), F.lit(0.0)))
    fit = fit.withColumn("rmse", rmse).drop("__syy")
    if form == "loglog":
        return fit.withColumn("elasticity", F.col("slope"))
    rows = join_keys(used.select(*by, "__x"), fit.select(*by, "slope", "intercept"), by, "inner")
    marginal = safe_div(F.col("slope") * F.col("__x"), F.col("intercept") + F.col("slope") * F.col("__x"))
    return join_keys(fit, rows.groupBy(*by).agg(F.avg(marginal).alias("elasticity")), by)


def held_out_fit(df: DataFrame, by: Sequence[str], price: str, quantity: str, test: Column, form: str = "linear", min_rows: int = 3) -> DataFrame:
    """One-predictor regression on the rows that ``test`` leaves, with R2 on those and on the rows it holds out.

    The moments of both parts come from one aggregation. The held-out R2 follows from the test part's moments and the
    training part's coefficients, so no row is scored or joined back. It is NULL where the held-out quantities do not vary.
    """
    used = df.filter((F.col(price) > 0) & (F.col(quantity) > 0))
    x, y = (F.ln(price), F.ln(quantity)) if form == "loglog" else (F.col(price), F.col(quantity))
    used = used.withColumn("__t", F.coalesce(test, F.lit(False))).withColumn("__x", x).withColumn("__y", y)
    part = lambda c, held: F.when(F.col("__t") == F.lit(held), F.col(c))
    tx, ty = part("__x", True), part("__y", True)
    m = used.groupBy(*by).agg(
        F.count(part("__x", False)).alias("n_train"),
        F.count(tx).alias("n_test"),
        F.regr_slope(part("__y", False), part("__x", False)).alias("slope"),
        F.regr_intercept(part("__y", False), part("__x", False)).alias("intercept"),
        F.regr_r2(part("__y", False), part("__x", False)).alias("r2_train"),
        F.avg(tx).alias("__mx"), F.avg(ty).alias("__my"), F.var_pop(tx).alias("__vx"), F.var_pop(ty).alias("__vy"), F.covar_pop(tx, ty).alias("__c"),
    ).filter((F.col("n_train") >= min_rows) & F.col("slope").isNotNull())
    b, bias = F.col("slope"), F.col("__my") - F.col("intercept") - F.col("slope") * F.col("__mx")
    mse = F.when(F.col("n_test") > 0, F.greatest(F.col("__vy") + b * b * F.col("__vx") - 2 * b * F.col("__c") + bias * bias, F.lit(0.0)))
    return m.select(
        *by, "n_train", "n_test", "slope", "intercept", "r2_train", (1 - safe_div(mse, "__vy")).alias("r2_test"), F.sqrt(mse).alias("rmse_test")
    )


def fit_price_promo(df: DataFrame, by: Sequence[str], price: str, discount: str, quantity: str, min_rows: int = 4) -> DataFrame:
    """Quantity on price and discount share per group: n, intercept, price_beta, promo_beta and r2, from covariances.

    Groups whose price and discount do not vary apart from one another have no such model and no row.
    """
    used = df.filter((F.col(price) > 0) & (F.col(quantity) > 0) & F.col(discount).isNotNull())
    m = used.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(price).alias("__mp"), F.avg(discount).alias("__md"), F.avg(quantity).alias("__mq"),
        F.var_pop(price).alias("__pp"), F.var_pop(discount).alias("__dd"), F.var_pop(quantity).alias("__qq"),
        F.covar_pop(price, discount).alias("__pd"), F.covar_pop(quantity, price).alias("__qp"), F.covar_pop(quantity, discount).alias("__qd"),
    )
    c = F.col
    own = c("__pp") * c("__dd")
    m = m.filter((c("n") >= min_rows) & (own - c("__pd") * c("__pd") > F.lit(1e-9) * own))
    det = own - c("__pd") * c("__pd")
    m = m.withColumn("price_beta", (c("__qp") * c("__dd") - c("__qd") * c("__pd")) / det).withColumn("promo_beta", (c("__qd") * c("__pp") - c("__qp") * c("__pd")) / det)
    explained = c("price_beta") * c("__qp") + c("promo_beta") * c("__qd")
    return m.select(
        *by, "n", (c("__mq") - c("price_beta") * c("__mp") - c("promo_beta") * c("__md")).alias("intercept"), "price_beta", "promo_beta", safe_div(explained, "__qq").alias("r2")
    )


def response_elasticity(rows: DataFrame, fit: DataFrame, by: Sequence[str], x: str, other: str, betas: tuple[str, str], name: str, min_values: int = 1) -> DataFrame:
    """Mean point elasticity along the fitted response to ``x``, at each of its different values in a group's rows.

    ``betas`` are the columns of ``fit`` with the effects of ``x`` and of ``other``, which stays at its mean over the rows. Groups with fewer
    than ``min_values`` different values have no row.
    """
    values = rows.filter(F.col(x).isNotNull()).groupBy(*by, x).agg(F.sum(other).alias("__s"), F.count(other).alias("__n"))
    values = with_group(values, by, [(F.sum("__s") / F.sum("__n")).alias("__m"), F.count(F.lit(1)).alias("__u")]).filter(F.col("__u") >= min_values)
    both = join_keys(values.select(*by, x, "__m"), fit.select(*by, "intercept", *betas), by, "inner")
    response = F.col("intercept") + F.col(betas[0]) * F.col(x) + F.col(betas[1]) * F.col("__m")
    return both.groupBy(*by).agg(F.avg(safe_div(F.col(betas[0]) * F.col(x), response)).alias(name))


def promo_elasticity(panel: DataFrame, fit: DataFrame, by: Sequence[str], period: str, price: str, discount: str, min_values: int = 5) -> DataFrame:
    """Elasticity of quantity to the discount share, on discounted periods only.

    Of periods in a row with the same discount share the first counts; ``min_values`` different shares at least. ``fit`` is that of
    :func:`fit_price_promo`. ``panel`` has one row per group and period, so a window holds a group's periods and no more.
    """
    before = F.lag(discount).over(Window.partitionBy(*by).orderBy(period))
    shown = panel.filter(F.col(discount) != 0).withColumn("__before", before)
    shown = shown.filter(F.col("__before").isNull() | (F.col("__before") != F.col(discount)))
    return response_elasticity(shown, fit, by, discount, price, ("promo_beta", "price_beta"), "promo_elasticity", min_values)


def fit_ols(df: DataFrame, by: Sequence[str], features: Sequence[str], target: str, min_rows: int | None = None) -> DataFrame:
    """Least squares with several predictors per group, from the cross-products of the columns.

    Spark sums the products, one row per group; a vectorised function solves the small systems. Returns
    the coefficients as an array (intercept first), R2 and RMSE.
    """
    k = len(features) + 1
    least = min_rows or k + 1
    cols: list[Column] = [F.lit(1.0), *[F.col(c).cast("double") for c in features], F.col(target).cast("double")]
    pairs = list(combinations_with_replacement(range(k + 1), 2))
    used = df.dropna(subset=[*features, target])
    moments = used.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.sum(cols[i] * cols[j]) for i, j in pairs]).alias("__m")
    ).filter(F.col("n") >= least)

    @F.pandas_udf("struct<coefficients:array<double>,r2:double,rmse:double>")
    def solve(m: pd.Series) -> pd.DataFrame:
        rows = []
        for values in m:
            full = np.zeros((k + 1, k + 1))
            for (i, j), v in zip(pairs, values):
                full[i, j] = full[j, i] = v
            xx, xy, yy = full[:k, :k], full[:k, k], full[k, k]
            beta = np.linalg.lstsq(xx, xy, rcond=None)[0]
            n, ybar = full[0, 0], full[0, k] / full[0, 0]
            sse = max(yy - 2 * beta @ xy + beta @ xx @ beta, 0.0)
            sst = yy - n * ybar**2
            rows.append((beta.tolist(), 1 - sse / sst if sst > 0 else None, float(np.sqrt(sse / n))))
        return pd.DataFrame(rows, columns=["coefficients", "r2", "rmse"])

    return moments.withColumn("__f", solve("__m")).select(*by, "n", "__f.*")


def beta_by_sku(df: DataFrame, by: Sequence[str], x: str, y: str, transform: str = "none") -> DataFrame:
    """Slope through the origin per group after a transform of both columns: none, log, minmax or boxcox.

    Scaling and the Box-Cox exponent use all rows, as the slopes are to be comparable.
    """
    work = df.select(*by, F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y"))
    if transform == "log":
        work = work.filter((F.col("__x") > 0) & (F.col("__y") > 0))
        work = work.withColumn("__x", F.ln("__x")).withColumn("__y", F.ln("__y"))
    elif transform in ("minmax", "boxcox"):
        work = with_group(work, [], [
            F.min("__x").alias("__x0"), F.max("__x").alias("__x1"), F.min("__y").alias("__y0"), F.max("__y").alias("__y1")
        ])
        if transform == "minmax":
            for c in ("x", "y"):
                scaled = safe_div(F.col(f"__{c}") - F.col(f"__{c}0"), F.col(f"__{c}1") - F.col(f"__{c}0"), 0)
                work = work.withColumn(f"__{c}", scaled)
        else:
            for c in ("x", "y"):
                work = work.withColumn(f"__{c}", F.col(f"__{c}") - F.col(f"__{c}0") + F.lit(1e-10))
            work = stage(work.select(*by, "__x", "__y"))
            for c in ("__x", "__y"):
                work = work.withColumn(c, boxcox(F.col(c), boxcox_lambda(work, c)))
    return work.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), safe_div(F.sum(F.col("__x") * F.col("__y")), F.sum(F.col("__x") * F.col("__x"))).alias("beta")
    )


def boxcox(value: Column, power: float) -> Column:
    return F.ln(value) if abs(power) < 1e-12 else (F.pow(value, F.lit(power)) - 1) / F.lit(power)


def boxcox_lambda(df: DataFrame, column: str, low: float = -2.0, high: float = 2.0, tolerance: float = 1e-4, points: int = 17) -> float:
    """Exponent with the highest Box-Cox likelihood; each round is one pass over a grid.

    While the best point is an end of the grid, the grid moves on and doubles; after that it narrows until its step is under
    ``tolerance``. A likelihood that rises without end stops at an exponent of 64 either way, where powers of doubles begin to overflow.
    """
    c = F.col(column)
    while True:
        grid = np.linspace(low, high, points)
        row = df.agg(
            F.count(c).alias("n"), F.sum(F.ln(c)).alias("s"), *[F.var_pop(boxcox(c, float(g))).alias(f"v{i}") for i, g in enumerate(grid)]
        ).first()
        score = [
            -np.inf if not row[f"v{i}"] or not 0 < row[f"v{i}"] < np.inf else -row["n"] / 2 * np.log(row[f"v{i}"]) + (g - 1) * row["s"]
            for i, g in enumerate(grid)
        ]
        top, step = int(np.argmax(score)), grid[1] - grid[0]
        best = float(grid[top])
        if top == 0 and best > -64 and score[top] > score[top + 1]:
            low, high = best - 2 * (high - low), best + step
        elif top == points - 1 and best < 64 and score[top] > score[top - 1]:
            low, high = best - step, best + 2 * (high - low)
        elif step < tolerance:
            return best
        else:
            low, high = best - step, best + step


def acceptable(r2: float = 0.6) -> Column:
    return ((F.col("r2") >= r2) & (F.col("elasticity") < 0)).cast("int")


def select_models(results: DataFrame, by: Sequence[str], model: str = "model", r2: float = 0.6) -> DataFrame:
    """The model with most acceptable SKUs per group, then the highest mean R2 of those."""
    good = results.filter(acceptable(r2) == 1).groupBy(*by, model).agg(
        F.count(F.lit(1)).alias("skus"), F.avg("r2").alias("avg_r2"), F.avg("elasticity").alias("avg_elasticity")
    )
    order = F.struct("skus", F.round("avg_r2", 9).alias("__r"), model)
    return good.groupBy(*by).agg(
        F.max_by(model, order).alias("best_model"),
        F.max_by("skus", order).alias("skus"),
        F.max_by("avg_r2", order).alias("avg_r2"),
        F.max_by("avg_elasticity", order).alias("avg_elasticity"),
    )


def quality_matrix(results: DataFrame, by: Sequence[str], sku: str, r2: float = 0.6) -> DataFrame:
    """SKUs by good or bad fit and good or bad sign of the elasticity."""
    fit, sign = F.col("r2") >= r2, F.col("elasticity") < 0
    count = lambda test: F.countDistinct(F.when(test, F.col(sku)))
    return results.groupBy(*by).agg(
        F.countDistinct(sku).alias("total_skus"),
        count(fit & sign).alias("good_fit_good_sign"),
        count(fit & ~sign).alias("good_fit_bad_sign"),
        count(~fit & sign).alias("bad_fit_good_sign"),
        count(~fit & ~sign).alias("bad_fit_bad_sign"),
    )


def _distances(a: pd.DataFrame, b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ordinal, correlation and attribute distances between two blocks of SKUs."""
    gap = lambda c: np.abs(a[c].to_numpy(float)[:, None] - b[c].to_numpy(float)[None, :])
    ordinal = 0.2 * gap("content_ordinal") + 0.8 * gap("price_ordinal")
    x, y = (np.array(list(f["series"]), dtype=float) for f in (a, b))
    mx, my = ~np.isnan(x), ~np.isnan(y)
    x, y, fx, fy = np.nan_to_num(x), np.nan_to_num(y), mx.astype(float), my.astype(float)
    n, sx, sy = fx @ fy.T, x @ fy.T, fx @ y.T
    sxx, syy, sxy = (x * x) @ fy.T, fx @ (y * y).T, x @ y.T
    with np.errstate(divide="ignore", invalid="ignore"):
        vx, vy = sxx - sx * sx / n, syy - sy * sy / n
        r = (sxy - sx * sy / n) / np.sqrt(vx * vy)
    r[(n < 2) | (vx <= 1e-9 * sxx) | (vy <= 1e-9 * syy)] = np.nan
    p, q = (np.array(list(f["attributes"]), dtype=np.int64) for f in (a, b))
    same = sum((p[:, None, k] == q[None, :, k]).astype(float) for k in range(p.shape[1])) / max(1, p.shape[1])
    return ordinal, 1 - r, 1 - same


def impute_elasticity(
    skus: DataFrame, by: Sequence[str], sku: str, block: int = 500, nearest: int = 3, flag: str = "acceptable", value: str = "elasticity", share: str = "acceptable"
) -> DataFrame:
    """Elasticity of SKUs without an acceptable model, from the most similar SKUs that have one.

    ``flag`` says which SKUs have one (0/1), ``value`` is the elasticity handed on, and ``share`` the flag whose mean over
    the group decides the case: promo elasticities go by a flag of their own, their case by the price flag.

    ``skus`` has the flags, the value, content_ordinal, price_ordinal, series (quantity per period,
    NULL where unsold) and attributes (array of text). Three distances are min-max scaled over the group
    and averaged; the nearest SKU gives one estimate and the mean of the nearest three the other.

    Both sides are cut into blocks, and every block of one meets every block of the other in a task of
    its own, once. How the distances will be scaled is not known before all have been seen, but it lies between bounds: the range of a distance over
    the group is at least that over the block and at most what its definition allows. A task hands on the extremes of its block, and for each SKU
    the few references that are not certain to stand behind three others, whatever the scaling; scaling and the last choice follow as column expressions.
    No other pair is written or shuffled, and a large group is spread over many tasks.
    """
    cols = [*by, sku, "content_ordinal", "price_ordinal", "series", "attributes"]
    coded = F.transform("attributes", lambda x: F.xxhash64(x))  # whole numbers compare faster than text
    flags = [F.col(flag).alias("acceptable"), F.col(value).alias("elasticity"), F.col(share).cast("double").alias("__in_share")]
    base = stage(skus.select(*cols, *flags).withColumn("attributes", coded))
    spread = lambda c: F.max(c) - F.min(c)
    sizes = base.groupBy(*by).agg(
        F.ceil(F.sum(F.col("acceptable")) / block).cast("int").alias("__nm"),
        F.ceil(F.sum(1 - F.col("acceptable")) / block).cast("int").alias("__nu"),
        F.avg("__in_share").alias("__share"),
        (0.2 * spread("content_ordinal") + 0.8 * spread("price_ordinal")).cast("double").alias("__range"),
    )
    sized = join_keys(base.drop("__in_share"), sizes, by).filter((F.col("__nm") > 0) & (F.col("__nu") > 0))
    numbered = lambda n: F.pmod(F.xxhash64(sku), F.col(n)).cast("int")
    others = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = sized.filter("acceptable = 0").withColumn("__ub", numbered("__nu")).withColumn("__mb", others("__nm"))
    right = sized.filter("acceptable = 1").withColumn("__mb", numbered("__nm")).withColumn("__ub", others("__nu"))
    left, right = left.drop("__nm", "__nu", "elasticity"), right.drop("__nm", "__nu", "__share", "__range")
    right = right.select(*[F.col(c).alias(c) for c in right.columns])  # both sides stem from one scan
    keys = [*by, "__ub", "__mb"]
    parts = ("ordinal", "correlation", "attribute")
    ends = [f"{end}_{part}" for part in parts for end in ("lo", "hi")]
    numbers = [*parts, *ends, "elasticity", "modelled_share"]
    schema = T.StructType(
        [base.schema[c] for c in by]
        + [T.StructField(sku, base.schema[sku].dataType), T.StructField("reference", base.schema[sku].dataType)]
        + [T.StructField(c, T.DoubleType()) for c in numbers]
    )

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame(columns=schema.names)
        distances = _distances(a, b)
        known = [d[~np.isnan(d)] for d in distances]
        found = {f"{end}_{part}": f(d) if d.size else np.nan for part, d in zip(parts, known) for end, f in (("lo", np.min), ("hi", np.max))}
        row, other = np.nonzero(_possible(distances, (a["__range"].iloc[0], 2.0, 1.0), nearest))
        out = a.iloc[row][[*by, sku]].reset_index(drop=True)
        out = out.assign(
            reference=b[sku].to_numpy()[other], elasticity=b["elasticity"].to_numpy()[other], modelled_share=a["__share"].to_numpy()[row],
            **{part: d[row, other] for part, d in zip(parts, distances)},
        )
        first = a.iloc[:1][list(by)].assign(**found)  # a row without a SKU: the extremes of the block
        return pd.concat([out, first], ignore_index=True).reindex(columns=schema.names)

    met = stage(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, schema))
    known = lambda c: F.when(~F.isnan(c), F.col(c))
    limits = met.filter(F.col(sku).isNull()).groupBy(*by).agg(*[(F.min if c.startswith("lo") else F.max)(known(c)).alias(f"__{c}") for c in ends])
    pairs = join_keys(met.filter(F.col(sku).isNotNull()).drop(*ends), limits, by)
    scaled = [safe_div(known(p) - F.col(f"__lo_{p}"), F.col(f"__hi_{p}") - F.col(f"__lo_{p}")) for p in parts]
    total = sum((F.coalesce(c, F.lit(0.0)) for c in scaled), F.lit(0.0))
    count = sum((c.isNotNull().cast("int") for c in scaled), F.lit(0))
    pairs = pairs.withColumn("distance", F.round(safe_div(total, count), 9)).filter("distance IS NOT NULL")  # without any known distance: no neighbour
    from tillmark.operators.series import top_n

    kept = top_n(pairs, [*by, sku], [F.col("distance"), F.col("reference")], nearest)
    modelled = F.max("modelled_share")
    return kept.groupBy(*by, sku).agg(
        F.min_by("reference", "position").alias("nearest_sku"),
        F.min_by("elasticity", "position").alias("elasticity_nearest"),
        F.avg("elasticity").alias("elasticity_top3"),
        F.when(modelled >= 0.77, "case 1").when(modelled >= 0.36, "case 2").otherwise("case 3").alias("case"),
    )


def _possible(distances: Sequence[np.ndarray], most: Sequence[float], nearest: int) -> np.ndarray:
    """Pairs (rows x references) that can be among a row's ``nearest`` by the mean of the distances, each divided by its range over a larger set.

    That range is at least the one seen here and at most ``most``. Only pairs with the same distances known are compared: there the offsets of the
    scaling cancel. A pair goes when ``nearest`` others of its kind are nearer under every scaling, by more than the rounding of the mean.
    """
    known = [~np.isnan(d) for d in distances]
    weights = []
    for d, k, top in zip(distances, known, most):
        seen = float(d[k].max() - d[k].min()) if k.any() else 0.0
        # a distance that is the same for all pairs here sets none of them apart
        weights.append((1.0 / max(top, seen), 1.0 / seen) if seen > 0 else (0.0, 0.0))
    kind = sum(k.astype(int) << p for p, k in enumerate(known))
    possible = np.zeros(kind.shape, dtype=bool)
    for code in np.unique(kind[kind > 0]):
        own = kind == code
        used = [p for p in range(len(distances)) if code >> p & 1]
        middle = sum(np.sqrt(weights[p][0] * weights[p][1]) * np.where(own, distances[p], 0.0) for p in used)
        first = np.argsort(np.where(own, middle, np.inf), axis=1, kind="stable")[:, :nearest]
        behind = np.ones(own.shape, dtype=bool)
        for r in range(nearest):
            if r >= first.shape[1]:
                behind[:] = False
                break
            at = first[:, r : r + 1]
            gap = np.zeros(own.shape)
            for p in used:
                step = np.take_along_axis(distances[p], at, 1) - distances[p]
                gap += np.maximum(weights[p][0] * step, weights[p][1] * step)
            behind &= (gap < -1e-8) & np.take_along_axis(own, at, 1)
        possible |= own & ~behind
    return possible


def accepted_and_imputed(skus: DataFrame, imputed: DataFrame, keys: Sequence[str], flag: str, value: str) -> DataFrame:
    """Own elasticities where the flag accepts them, imputed ones elsewhere: criteria, top_1 (own or nearest) and top_3 (own or mean of three)."""
    own = skus.filter(F.col(flag) == 1).select(*keys, F.lit("accepted set").alias("criteria"), F.col(value).alias("top_1"), F.col(value).alias("top_3"))
    other = imputed.filter(F.col("elasticity_top3").isNotNull()).select(
        *keys, F.concat(F.lit("imputed: "), F.col("case")).alias("criteria"), F.col("elasticity_nearest").alias("top_1"), F.col("elasticity_top3").alias("top_3")
    )
    return own.unionByName(other)


def final_elasticity(price: DataFrame, promo: DataFrame, keys: Sequence[str], group: Sequence[str]) -> DataFrame:
    """Price elasticities with their promo elasticities; where there is none, the averages of the group.

    Both come from :func:`accepted_and_imputed`; ``price`` has the columns of ``group`` as well. A group average is that over its rows with a promo elasticity.
    """
    renamed = lambda df, kind: df.withColumnsRenamed({f"top_{n}": f"{kind}_elasticity_top_{n}" for n in (1, 3)})
    out = join_keys(renamed(price, "price"), renamed(promo, "promo").drop("criteria"), keys)
    values = [f"promo_elasticity_top_{n}" for n in (1, 3)]
    out = with_group(out, group, [F.avg(c).alias(f"__{c}") for c in values])
    return out.withColumns({c: F.coalesce(c, f"__{c}") for c in values}).drop(*(f"__{c}" for c in values))

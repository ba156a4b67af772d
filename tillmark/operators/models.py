"""Choice models, tree models and association measures."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations
from math import gcd

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillmark.functions.exprs import safe_div, seeded_order
from tillmark.operators.joins import join_keys, with_group
from tillmark.operators.ordered import column_counts, running
from tillmark.session import stage


def choice_dataset(
    purchases: DataFrame, receipt: str, day: str, attributes: Sequence[str], price: str, seed: int = 42
) -> tuple[DataFrame, float]:
    """Purchases and an equal number of non-purchases, with the true purchase rate of the full grid.

    The grid of receipts and attribute combinations is not built. Combinations are numbered, and every receipt
    walks over their numbers from a seeded start in seeded steps that have no factor in common with their count, so it meets
    none twice. Walks of twice the mean receipt leave enough non-purchases once what was bought is taken out, which needs the
    receipt's own numbers only, and these are cut to size in a seeded order: counts by the first digits of the hash tell where
    the cut lies, so only rows that share them are sorted. Prices of non-purchases are those of the next purchase of the
    combination, else of the last one. The price is min-max scaled; filling copies prices, so the purchases have its range.
    """
    bought = stage(purchases.groupBy(receipt, *attributes).agg(F.min(day).alias(day), F.avg(price).alias(price)))
    combos = stage(running(bought.select(*attributes).distinct(), [F.col(a).asc() for a in attributes], position="__c"))
    k = combos.dropna(subset=list(attributes)).count()
    own = bought.select(receipt, day, *attributes).join(combos, list(attributes), "left")
    heads = stage(own.groupBy(receipt).agg(F.min(day).alias(day), F.count(F.lit(1)).alias("__n"), F.collect_set("__c").alias("__own")))
    size = heads.agg(F.sum("__n").alias("p"), F.count(receipt).alias("t")).first()
    p, cells = size["p"] or 0, size["t"] * k
    if cells <= p:
        raise ValueError("every receipt holds every combination: there is no non-purchase")
    wanted = min(p, cells - p)
    length = min(k, -(-2 * p // size["t"]))
    steps = [x for x in range(1, max(2, k)) if gcd(x, k) == 1][:64]
    number = lambda salt: F.conv(F.substring(seeded_order(salt, receipt), 1, 8), 16, 10).cast("long")
    step = F.element_at(F.array(*[F.lit(x) for x in steps]), (number(seed + 1) % len(steps) + 1).cast("int"))
    walk = F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda j: (F.col("__a") + j * F.col("__step")) % k + 1)
    free = F.when(F.col(receipt).isNull(), walk).otherwise(F.array_except(walk, "__own"))
    walks = heads.withColumn("__a", number(seed)).withColumn("__step", step).select(receipt, day, F.explode(free).alias("__c"))
    hashed = seeded_order(seed + 2, receipt, *attributes)
    drawn = stage(walks.join(combos, "__c").select(receipt, *attributes, day, F.substring(hashed, 1, 4).alias("__b")))
    counts = running(drawn.groupBy("__b").agg(F.count(F.lit(1)).alias("__n")), [F.col("__b")], sums={"__upto": "__n"})
    edge = counts.filter(F.col("__upto") >= wanted).orderBy("__b").first()
    others = drawn
    if edge:
        order = [hashed, F.col(receipt), *[F.col(a) for a in attributes]]
        last = running(drawn.filter(F.col("__b") == edge["__b"]), order, position="__pos")
        last = last.filter(F.col("__pos") <= wanted - (edge["__upto"] - edge["__n"])).drop("__pos")
        others = drawn.filter(F.col("__b") < edge["__b"]).unionByName(last)
    both = bought.withColumn("purchase_flag", F.lit(1)).unionByName(
        others.drop("__b").withColumn(price, F.lit(None).cast("double")).withColumn("purchase_flag", F.lit(0))
    )
    # later the same day, else on the next day with a purchase, else the last purchase: days and combinations are few
    known = F.col(price).isNotNull()
    days = both.groupBy(*attributes, day).agg(F.min_by(price, F.when(known, F.struct(receipt))).alias("__first"))
    later = Window.partitionBy(*attributes).orderBy(F.col(day).desc()).rowsBetween(Window.unboundedPreceding, -1)
    days = days.select(*attributes, day, F.last("__first", ignorenulls=True).over(later).alias("__next"))
    lasts = bought.groupBy(*attributes).agg(F.max_by(price, F.when(known, F.struct(day, receipt))).alias("__last"))
    own_day = Window.partitionBy(*attributes, day).orderBy(F.col(receipt).desc()).rowsBetween(Window.unboundedPreceding, 0)
    filled = both.withColumn(price, F.last(price, ignorenulls=True).over(own_day))
    filled = join_keys(join_keys(filled, days, [*attributes, day]), lasts, attributes)
    span = bought.agg(F.min(price).alias("__lo"), F.max(price).alias("__hi"))
    out = filled.withColumn(price, F.coalesce(price, "__next", "__last")).crossJoin(F.broadcast(span))
    scaled = safe_div(F.col(price) - F.col("__lo"), F.col("__hi") - F.col("__lo"), 0)
    return out.withColumn(price, scaled).select(receipt, *attributes, price, "purchase_flag"), p / cells


def held_out(*keys: str, tenths: int = 3, seed: int = 7) -> Column:
    """True for about ``tenths`` of ten keys: the test part of a split that any engine repeats."""
    return F.conv(F.substring(seeded_order(seed, *keys), 1, 8), 16, 10).cast("long") % 10 >= 10 - tenths


def fit_choice(df: DataFrame, attributes: Sequence[str], numeric: Sequence[str], label: str = "purchase_flag") -> PipelineModel:
    """Logistic regression on one-hot attributes and numeric columns."""
    indexed = [f"__i_{a}" for a in attributes]
    coded = [f"__o_{a}" for a in attributes]
    stages = [
        StringIndexer(inputCols=list(attributes), outputCols=indexed, stringOrderType="alphabetDesc"),
        OneHotEncoder(inputCols=indexed, outputCols=coded, dropLast=True),
        VectorAssembler(inputCols=[*coded, *numeric], outputCol="features"),
        LogisticRegression(featuresCol="features", labelCol=label, maxIter=100, standardization=True),
    ]
    return Pipeline(stages=stages).fit(df)


def choice_coefficients(spark, model: PipelineModel, attributes: Sequence[str], numeric: Sequence[str]) -> DataFrame:
    """(attribute, level, beta); the base level of each attribute has no row, the intercept no level."""
    indexer, logistic = model.stages[0], model.stages[-1]
    names = [(a, level) for a, levels in zip(attributes, indexer.labelsArray) for level in levels[:-1]]
    names += [(n, None) for n in numeric]
    rows = [(a, level, float(b)) for (a, level), b in zip(names, logistic.coefficients.toArray())]
    rows.append(("intercept", None, float(logistic.intercept)))
    return spark.createDataFrame(rows, "attribute string, level string, beta double")


def classification_report(scored: DataFrame, label: str = "purchase_flag", prediction: str = "prediction", by: Sequence[str] = ()) -> DataFrame:
    """Confusion counts with accuracy, precision and recall, per group in one aggregation."""
    y, z = F.col(label) == 1, F.col(prediction) == 1
    count = lambda t: F.sum(F.when(t, 1).otherwise(0))
    out = scored.groupBy(*by).agg(count(y & z).alias("tp"), count(~y & z).alias("fp"), count(y & ~z).alias("fn"), count(~y & ~z).alias("tn"))
    return out.select(
        "*",
        ((F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))).alias("accuracy"),
        safe_div("tp", F.col("tp") + F.col("fp"), 0).alias("precision"),
        safe_div("tp", F.col("tp") + F.col("fn"), 0).alias("recall"),
    )


def fit_trees(df: DataFrame, features: Sequence[str], target: str, kind: str = "rf", seed: int = 42) -> PipelineModel:
    """Random forest (``rf``) or gradient boosted trees (``gbt``) on numeric features."""
    learner = {"rf": RandomForestRegressor, "gbt": GBTRegressor}[kind]
    fit = learner(featuresCol="features", labelCol=target, seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features"), fit]).fit(df)


def regression_report(scored: DataFrame, target: str, by: Sequence[str] = (), prediction: str = "prediction") -> DataFrame:
    """R2 and RMSE of predictions, per group."""
    error = F.col(target) - F.col(prediction)
    out = scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum(error * error).alias("__sse"), (F.var_pop(target) * F.count(F.lit(1))).alias("__sst")
    )
    return out.select(
        *by, "n", (1 - safe_div("__sse", "__sst")).alias("r2"), F.sqrt(F.col("__sse") / F.col("n")).alias("rmse")
    )


def partial_dependence(model: PipelineModel, df: DataFrame, column: str, points: int = 100) -> DataFrame:
    """Mean prediction with the column set to each point between its 5th and 95th percentile."""
    low, high = df.approxQuantile(column, [0.05, 0.95], 0.001)
    step = (high - low) / max(points - 1, 1)
    grid = F.array(*[F.lit(low + i * step) for i in range(points)])
    moved = df.withColumn("__g", F.explode(grid)).withColumn(column, F.col("__g")).drop("features")
    return model.transform(moved).groupBy(F.col("__g").alias(column)).agg(F.avg("prediction").alias("predicted"))


def marginal_elasticity(model: PipelineModel, df: DataFrame, column: str) -> DataFrame:
    """Mean relative change of the prediction for a rise of the column by a hundredth of its deviation."""
    delta = (df.agg(F.stddev(column)).first()[0] or 0.0) * 0.01
    if delta == 0:
        raise ValueError(f"{column} does not vary")
    now = model.transform(df).withColumnRenamed("prediction", "__y0").withColumn("__x", F.col(column)).drop("features")
    moved = model.transform(now.withColumn(column, F.col(column) + F.lit(delta)))
    e = safe_div(safe_div(F.col("prediction") - F.col("__y0"), "__y0"), safe_div(F.lit(delta), "__x"))
    return moved.agg(F.avg(e).alias("elasticity"))


def curve_elasticity(curve: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean of the point elasticities along a curve of few points (differences as in a numeric gradient), per group."""
    w = Window.partitionBy(*by or [F.lit(0)]).orderBy(column)

    def slope(c: str):
        ahead, behind = F.lead(c).over(w), F.lag(c).over(w)
        return (
            F.when(behind.isNull(), ahead - F.col(c)).when(ahead.isNull(), F.col(c) - behind).otherwise((ahead - behind) / 2)
        )

    points = curve.select(*by, column, "predicted", slope(column).alias("__dx"), slope("predicted").alias("__dy"))
    e = F.coalesce(safe_div(safe_div("__dy", "predicted"), safe_div("__dx", column)), F.lit(0.0))
    return points.groupBy(*by).agg(F.avg(e).alias("elasticity"))


def tree_elasticities(
    panel: DataFrame, by: Sequence[str], price: str, quantity: str, test: Column, features: Sequence[str] = (), kind: str = "rf", points: int = 20, min_rows: int = 5, seed: int = 42
) -> DataFrame:
    """Price elasticity of every key (SKU and region, say) from one tree model over all of them, with R2 on training and held-out rows.

    A model per key would be a loop on the driver. One model learns the quantity relative to the key's mean from the price relative to the key's mean, the
    other ``features``, and what tells keys apart: for each column of ``by`` the training means of quantity and price of its value, and the key's
    own slope of log quantity on log price, which lets trees bend the response key by key. Values of ``by`` enter by such means and not as categories, so their
    number is not bounded by the trees' bins. All of these come from the rows that ``test`` leaves.

    Each key's response is then read from the model on the key's own price grid: its different prices, or ``points`` steps from its 5th to its
    95th percentile where there are more; other features stay at their means. The elasticity is the mean of the point elasticities along the
    curve. Keys with fewer than ``min_rows`` training rows, or one price, have no row.
    """
    keys, extra = list(by), list(features)
    used = panel.filter((F.col(price) > 0) & (F.col(quantity) > 0)).dropna(subset=extra) if extra else panel.filter((F.col(price) > 0) & (F.col(quantity) > 0))
    rows = stage(used.select(*keys, F.col(price).cast("double").alias("__p"), F.col(quantity).cast("double").alias("__q"), *extra, F.coalesce(test, F.lit(False)).alias("__test")))
    train = rows.filter(~F.col("__test"))
    shape = train.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_train"), F.avg("__p").alias("__mp"), F.avg("__q").alias("__mq"), F.regr_slope(F.ln("__q"), F.ln("__p")).alias("__slope"),
        F.countDistinct("__p").alias("__u"), F.percentile("__p", F.array(F.lit(0.05), F.lit(0.95))).alias("__ends"), *[F.avg(c).alias(f"__m_{c}") for c in extra],
    ).filter((F.col("n_train") >= min_rows) & F.col("__slope").isNotNull())
    coded = []
    for i, c in enumerate(keys):
        level = train.groupBy(c).agg(F.avg(F.ln("__q")).alias(f"__lq{i}"), F.avg(F.ln("__p")).alias(f"__lp{i}"))
        shape = join_keys(shape, level, [c])
        coded += [f"__lq{i}", f"__lp{i}"]
    shape = stage(shape)
    inputs = ["__x", "__slope", *coded, *extra]
    known = join_keys(rows, shape, keys, "inner").withColumn("__x", F.col("__p") / F.col("__mp")).withColumn("__y", F.col("__q") / F.col("__mq"))
    learner = RandomForestRegressor(featuresCol="features", labelCol="__y", seed=seed, numTrees=60, maxDepth=9, featureSubsetStrategy="all", subsamplingRate=0.7) if kind == "rf" else GBTRegressor(featuresCol="features", labelCol="__y", seed=seed, maxIter=60, maxDepth=5, stepSize=0.15)
    model = Pipeline(stages=[VectorAssembler(inputCols=inputs, outputCol="features"), learner]).fit(known.filter(~F.col("__test")).select(*inputs, "__y"))
    scored = model.transform(known.select(*keys, *inputs, "__y", "__q", "__mq", "__test")).withColumn("prediction", F.col("prediction") * F.col("__mq"))
    report = regression_report(scored, "__q", [*keys, "__test"])
    report = report.groupBy(*keys).agg(*[F.max(F.when(F.col("__test") == F.lit(t), F.col("r2"))).alias(n) for n, t in (("r2_train", False), ("r2_test", True))])
    low, high = F.col("__ends")[0], F.col("__ends")[1]
    steps = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: low + (high - low) * i / (points - 1))
    even = shape.filter(F.col("__u") > points).select(*keys, F.explode(F.array_distinct(steps)).alias("__g"))
    own = join_keys(train.select(*keys, F.col("__p").alias("__g")).distinct(), shape.filter(F.col("__u") <= points).select(*keys), keys, "left_semi")
    grid = join_keys(even.unionByName(own), shape, keys, "inner").withColumn("__x", F.col("__g") / F.col("__mp")).withColumns({c: F.col(f"__m_{c}") for c in extra})
    curve = model.transform(grid.select(*keys, "__g", *inputs)).withColumnRenamed("prediction", "predicted")
    found = curve_elasticity(curve.select(*keys, "__g", "predicted"), "__g", keys)
    out = join_keys(join_keys(found, shape.filter("__u > 1").select(*keys, "n_train"), keys, "inner"), report, keys)
    return out.select(*keys, "n_train", "r2_train", "r2_test", "elasticity")


def spearman(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rank correlation of every two columns, long form; ties share their average rank, NULLs have none.

    The values of all columns are counted together and ranked in one running pass; rows then look their ranks up, column by column.
    """
    counts = running(column_counts(df, columns), [F.col("value")], ["column"], sums={"__c": "__n"})
    ranks = stage(counts.select("column", "value", (F.col("__c") - (F.col("__n") - 1) / 2).alias("__rank")))
    ranked = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    for c in columns:
        own = ranks.filter(F.col("column") == c).select(F.col("value").alias(f"__v_{c}"), F.col("__rank").alias(f"__r_{c}"))
        ranked = ranked.join(own, F.col(c) == F.col(f"__v_{c}"), "left").drop(f"__v_{c}")
    pairs = list(combinations(columns, 2))
    row = ranked.agg(*[F.corr(f"__r_{a}", f"__r_{b}").alias(f"{i}") for i, (a, b) in enumerate(pairs)])
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{i}").alias("rho")) for i, (a, b) in enumerate(pairs)]
    return row.select(F.explode(F.array(*cells)).alias("__c")).select("__c.*")


def cramers_v(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Association of every two categorical columns, long form.

    Contingency counts of all pairs of columns come from one pass; the rest works on the counts.
    """
    cells = [
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).cast("string").alias("x"), F.col(b).cast("string").alias("y"))
        for a, b in combinations(columns, 2)
    ]
    long = df.select(F.explode(F.array(*cells)).alias("__c")).select("__c.*").dropna()
    counts = stage(long.groupBy("a", "b", "x", "y").agg(F.count(F.lit(1)).alias("o")))
    rows = counts.groupBy("a", "b", "x").agg(F.sum("o").alias("r"))
    cols = counts.groupBy("a", "b", "y").agg(F.sum("o").alias("c"))
    joined = join_keys(join_keys(counts, rows, ["a", "b", "x"]), cols, ["a", "b", "y"])
    joined = with_group(joined, ["a", "b"], [F.sum("o").alias("n")])
    out = joined.groupBy("a", "b").agg(
        F.max("n").alias("n"),
        F.countDistinct("x").alias("kx"),
        F.countDistinct("y").alias("ky"),
        F.sum(F.col("o") * F.col("o") / (F.col("r") * F.col("c"))).alias("s"),
    )
    v = F.sqrt(safe_div(F.greatest(F.col("s") - 1, F.lit(0.0)), F.least(F.col("kx") - 1, F.col("ky") - 1)))
    return out.select("a", "b", "n", v.alias("v"))

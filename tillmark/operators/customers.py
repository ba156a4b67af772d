"""Customers: repeat purchase, visits, loyalty, indices, retention and cohorts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillmark.functions.dates import month_number
from tillmark.functions.exprs import safe_div
from tillmark.operators.joins import exclude, flag_present, join_keys, with_group
from tillmark.operators.metrics import rate_by
from tillmark.session import stage


def customer_repeat(
    df: DataFrame, by: Sequence[str] = (), customer: str = "customer_id", transaction: str = "transaction_id"
) -> DataFrame:
    """Customers with one receipt and with several, per group."""
    per = df.filter(F.col(customer).isNotNull()).groupBy(*by, customer).agg(F.countDistinct(transaction).alias("__n"))
    out = per.groupBy(*by).agg(
        F.count(F.lit(1)).alias("customers"),
        F.sum((F.col("__n") == 1).cast("int")).alias("one_timers"),
        F.sum((F.col("__n") > 1).cast("int")).alias("repeaters"),
    )
    return out.select(
        "*",
        safe_div("one_timers", "customers").alias("one_timer_share"),
        safe_div("repeaters", "customers").alias("repeat_share"),
    )


def share_index(
    df: DataFrame, child: Sequence[str], parent: Sequence[str], kind: str = "one_timer"
) -> DataFrame:
    """Child share of one-timers (or repeaters) over the share of its parent, ranked within the parent."""
    column = f"{kind}_share"
    low = customer_repeat(df, [*parent, *child]).select(*parent, *child, "customers", F.col(column).alias("child_share"))
    high = customer_repeat(df, parent).select(*parent, F.col(column).alias("parent_share"))
    out = join_keys(low, high, parent, "inner").withColumn("index", safe_div("child_share", "parent_share"))
    order = [F.col("index").desc(), *[F.col(c) for c in child]]
    return out.withColumn("position", F.row_number().over(Window.partitionBy(*parent).orderBy(*order)))


def affinity_index(
    df: DataFrame, by: Sequence[str], segment: str, flag: str, customer: str = "customer_id", min_customers: int = 0
) -> DataFrame:
    """Penetration of a segment among buyers of flagged items over its penetration among the others.

    Others are all buyers less those of flagged items. Reduced to one row per customer before counting.
    """
    per = stage(df.groupBy(*by, segment, customer).agg(F.max(flag).alias("__f")).filter(F.col(customer).isNotNull()))
    counts = [F.sum("__f").alias("flagged"), F.sum(1 - F.col("__f")).alias("others")]
    seg = per.groupBy(*by, segment).agg(*counts)
    allc = per.groupBy(*by).agg(F.sum("__f").alias("all_flagged"), F.sum(1 - F.col("__f")).alias("all_others"))
    out = join_keys(seg, allc, by).filter(F.col("all_flagged") > min_customers)
    a, b = safe_div("flagged", "all_flagged"), safe_div("others", "all_others")
    return out.select("*", a.alias("flagged_penetration"), b.alias("other_penetration"), safe_div(a, b).alias("index"))


def wallet_index(df: DataFrame, by: Sequence[str], segment: str, flag: str, metric: str = "amount") -> DataFrame:
    """Share of a segment in flagged sales over its share in the other sales."""
    hit = F.sum(F.when(F.col(flag) == 1, F.col(metric)).otherwise(0.0))
    miss = F.sum(F.when(F.col(flag) == 1, 0.0).otherwise(F.col(metric)))
    seg = df.groupBy(*by, segment).agg(hit.alias("flagged_sales"), miss.alias("other_sales"))
    out = with_group(seg, by, [F.sum("flagged_sales").alias("__f"), F.sum("other_sales").alias("__o")])
    a, b = safe_div("flagged_sales", "__f"), safe_div("other_sales", "__o")
    return out.select(
        *seg.columns, a.alias("flagged_share"), b.alias("other_share"), safe_div(a, b).alias("index")
    )


def rfm_features(tx: DataFrame, as_of: str, customer: str = "customer_id", transaction: str = "transaction_id", day: str = "business_day") -> DataFrame:
    """Recency, frequency, spend, ATV, tenure and mean gap between visit days, per customer."""
    per = tx.filter(F.col(customer).isNotNull()).groupBy(customer).agg(
        F.max(day).alias("__last"),
        F.min(day).alias("__first"),
        F.countDistinct(day).alias("visit_days"),
        F.countDistinct(transaction).alias("orders"),
        F.sum("amount").alias("spend"),
    )
    ref = F.lit(as_of).cast("date")
    return per.select(
        customer,
        F.datediff(ref, "__last").alias("recency"),
        F.datediff(ref, "__first").alias("tenure"),
        "visit_days",
        "orders",
        "spend",
        safe_div("spend", "orders").alias("atv"),
        safe_div(F.datediff("__last", "__first"), F.col("visit_days") - 1).alias("inter_purchase_time"),
    )


def points_balance(
    tx: DataFrame,
    customer: str = "customer_id",
    receipt: Sequence[str] = ("transaction_id", "loyalty_points", "redeemed_points", "forced_redemption_points"),
) -> DataFrame:
    """Points issued, redeemed and left; receipt-level points repeat on each line and are counted once."""
    once = tx.select(customer, *receipt).distinct()
    total = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0.0)))
    out = once.groupBy(customer).agg(
        total("loyalty_points").alias("issued"),
        total("redeemed_points").alias("redeemed"),
        total("forced_redemption_points").alias("forced"),
    )
    return out.withColumn("balance", F.col("issued") - F.col("redeemed") - F.col("forced"))


def propensity_features(tx: DataFrame, as_of: str, customer: str = "customer_id") -> DataFrame:
    """Purchase behaviour and points of each customer, rows with unusable values left out."""
    out = rfm_features(tx, as_of, customer).join(points_balance(tx, customer), customer)
    return out.filter((F.col("recency") >= 0) & (F.col("spend") > 0) & (F.col("balance") >= 0))


def visit_gaps(tx: DataFrame, customer: str = "customer_id", day: str = "business_day") -> DataFrame:
    """Visit days with their number and the days since the visit before.

    Lines are reduced to one row per customer and day first, so a customer has at most as many rows
    in the window as there are days.
    """
    days = tx.filter(F.col(customer).isNotNull()).select(customer, day).distinct()
    w = Window.partitionBy(customer).orderBy(day)
    return days.select(
        customer, day, F.row_number().over(w).alias("visit"), F.datediff(F.col(day), F.lag(day).over(w)).alias("gap_days")
    )


def nth_visit_gap(tx: DataFrame, n: int = 2, customer: str = "customer_id", day: str = "business_day") -> DataFrame:
    """Mean days up to the ``n``-th visit over customers who reached it."""
    gaps = visit_gaps(tx, customer, day).filter(F.col("visit").between(2, n))
    return gaps.groupBy("visit").agg(F.count(F.lit(1)).alias("customers"), F.avg("gap_days").alias("avg_gap_days"))


def first_purchase_spend(tx: DataFrame, customer: str = "customer_id", day: str = "business_day", by: Sequence[str] = ()) -> DataFrame:
    """Spend and receipts on the customer's first day.

    Day totals come first; the first day is then picked by an aggregate, not by a second join to the lines.
    """
    daily = tx.groupBy(*by, customer, day).agg(
        F.sum("amount").alias("spend"), F.countDistinct("transaction_id").alias("orders")
    )
    first = F.min(F.struct(day, "spend", "orders")).alias("__f")
    return daily.groupBy(*by, customer).agg(first).select(
        *by,
        customer,
        F.col(f"__f.{day}").alias("first_day"),
        F.col("__f.spend").alias("first_spend"),
        F.col("__f.orders").alias("first_orders"),
    )


def store_loyalists(df: DataFrame, threshold: float = 0.7, customer: str = "customer_id", store: str = "store_id", by: Sequence[str] = ()) -> DataFrame:
    """Share of customers with more than ``threshold`` of their spend in one store."""
    cells = df.filter(F.col(customer).isNotNull()).groupBy(*by, customer, store).agg(F.sum("amount").alias("__s"))
    per = cells.groupBy(*by, customer).agg(F.max("__s").alias("__top"), F.sum("__s").alias("__all"))
    out = per.groupBy(*by).agg(
        F.count(F.lit(1)).alias("customers"),
        F.sum((F.round(safe_div("__top", "__all"), 4) > threshold).cast("int")).alias("loyal_customers"),
    )
    return out.withColumn("customer_perc", safe_div("loyal_customers", "customers"))


def loyalty_share(df: DataFrame, by: Sequence[str], member: Column, customer: str = "customer_id", transaction: str = "transaction_id") -> DataFrame:
    """Receipts, customers and frequency of loyalty members and of everyone.

    Lines are reduced to one row per receipt and customer; a receipt or customer is a member's if any of its rows is.
    """
    own = stage(df.groupBy(*by, transaction, customer).agg(F.max(F.coalesce(member, F.lit(False)).cast("int")).alias("__m")))
    parts = []
    for key, name in ((transaction, "receipts"), (customer, "customers")):
        per = own.filter(F.col(key).isNotNull()).groupBy(*by, key).agg(F.max("__m").alias("__m"))
        parts.append(per.groupBy(*by).agg(F.count(F.lit(1)).alias(name), F.sum("__m").alias(f"member_{name}")))
    out = own.select(*by).distinct() if by else own.sparkSession.range(1).select()
    for part in parts:
        out = join_keys(out, part, by) if by else out.crossJoin(F.broadcast(part))
    counts = ["receipts", "member_receipts", "customers", "member_customers"]
    out = out.select(*by, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts])
    return out.select(
        "*",
        safe_div("member_receipts", "receipts", 0).alias("member_receipt_share"),
        safe_div("receipts", "customers").alias("frequency"),
        safe_div("member_receipts", "member_customers").alias("member_frequency"),
    )


def atv_stretch_cohort(df: DataFrame, low: float, high: float, breach: float, customer: str = "customer_id", transaction: str = "transaction_id") -> DataFrame:
    """Customers with an average receipt in a band and at least one receipt above ``breach``."""
    receipts = df.groupBy(customer, transaction).agg(F.sum("amount").alias("__r"))
    per = receipts.groupBy(customer).agg(
        F.count(F.lit(1)).alias("orders"),
        F.sum("__r").alias("spend"),
        F.avg("__r").alias("atv"),
        F.sum((F.col("__r") >= breach).cast("int")).alias("breaches"),
    )
    return per.filter(F.col("atv").between(low, high) & (F.col("breaches") > 0))


def breach_count(df: DataFrame, threshold: float, more_than: int, customer: str = "customer_id", transaction: str = "transaction_id") -> DataFrame:
    """Customers with more than ``more_than`` receipts of at least ``threshold``."""
    receipts = df.groupBy(customer, transaction).agg(F.sum("amount").alias("__r"))
    per = receipts.groupBy(customer).agg(F.sum((F.col("__r") >= threshold).cast("int")).alias("breaches"))
    return per.filter(F.col("breaches") > more_than)


def band_filter(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    for c, (low, high) in bounds.items():
        df = df.filter(F.col(c).between(low, high))
    return df


def inactive_base(tx: DataFrame, by: Sequence[str], event: Column, entity: str = "customer_id") -> DataFrame:
    """Entities with no row matching ``event``."""
    per = tx.groupBy(*by, entity).agg(F.max(F.coalesce(event, F.lit(False)).cast("int")).alias("__e"))
    return per.filter("__e = 0").drop("__e")


def activation(tx: DataFrame, before: Column, during: Column, by: Sequence[str], entity: str = "customer_id") -> DataFrame:
    """Entities not active before, and those of them active during the window, per group."""
    per = tx.groupBy(*by, entity).agg(F.max(before.cast("int")).alias("__b"), F.max(during.cast("int")).alias("__d"))
    out = per.filter("__b = 0").groupBy(*by).agg(
        F.count(F.lit(1)).alias("inactive"), F.sum("__d").alias("activated")
    )
    return out.withColumn("activation_rate", safe_div("activated", "inactive", 0))


def compare_cohorts(df: DataFrame, cohort: DataFrame, key: str, measures: Sequence[str], name: str = "activated") -> DataFrame:
    """Means of customer measures inside and outside a cohort."""
    return flag_present(df, cohort, [key], name).groupBy(name).agg(
        F.count(F.lit(1)).alias("customers"), *[F.avg(m).alias(f"avg_{m}") for m in measures]
    )


def rolling_retention(
    tx: DataFrame, customer: str = "customer_id", day: str = "business_day", window: int = 3, by: Sequence[str] = ()
) -> DataFrame:
    """Share of the customers of each ``window``-month window who buy in the month after it.

    A purchase month stands for the windows that contain it and none of the customer's months before, and for the return
    to the window it follows, if the month before lies in that. So a window meets a customer once, and only counts per
    month leave a task. Windows reaching past the data are left out.
    """
    every = tx.groupBy(*by, customer, month_number(day).alias("__m")).agg(F.count(F.lit(1)).alias("__n"))  # read once, for months and span
    months = every.filter((F.col(customer).isNotNull()) & (F.col("__n") > 0) & F.col("__m").isNotNull())
    before = F.lag("__m").over(Window.partitionBy(*by, customer).orderBy("__m"))
    months = months.select(*by, "__m", before.alias("__p"))
    back = F.col("__m") - F.col("__p") <= window
    fresh = F.when(back, F.col("__p") + window + 1).otherwise(F.col("__m") + 1)
    reached = F.when(fresh <= F.col("__m") + window, F.sequence(fresh, F.col("__m") + window))
    marks = F.array_append(
        F.transform(F.coalesce(reached, F.array().cast(f"array<{dict(months.dtypes)['__m']}>")), lambda t: F.struct(t.alias("target"), F.lit(1).alias("in"), F.lit(0).alias("back"))),
        F.struct(F.col("__m").alias("target"), F.lit(0).alias("in"), F.coalesce(back, F.lit(False)).cast("int").alias("back")),
    )
    per = months.select(*by, F.explode(marks).alias("__k")).select(*by, "__k.*")
    span = every.agg(F.min("__m").alias("__lo"), F.max("__m").alias("__hi"))
    out = per.groupBy(*by, "target").agg(F.sum("in").alias("window_customers"), F.sum("back").alias("returning")).filter("window_customers > 0")
    inside = out.crossJoin(F.broadcast(span)).filter(
        (F.col("target") - window >= F.col("__lo")) & (F.col("target") <= F.col("__hi"))
    )
    year, month = F.floor((F.col("target") - 1) / 12), F.pmod(F.col("target") - 1, F.lit(12)) + 1
    return inside.select(
        *by,
        (year * 100 + month).cast("int").alias("year_month"),
        "window_customers",
        "returning",
        safe_div("returning", "window_customers").alias("retention"),
    )


def lapse_new(tx: DataFrame, next_months: int = 5, customer: str = "customer_id", day: str = "business_day") -> DataFrame:
    """Per month: active customers, those not seen the month before, those not seen in the next months.

    Lag and lead over a customer's months answer all three; a month without enough future is left out.
    """
    every = tx.groupBy(customer, month_number(day).alias("__m")).agg(F.count(F.lit(1)).alias("__n"))  # read once, for months and span
    months = every.filter((F.col(customer).isNotNull()) & (F.col("__n") > 0))
    w = Window.partitionBy(customer).orderBy("__m")
    flags = months.select(
        "__m",
        F.coalesce(F.col("__m") - F.lag("__m").over(w) > 1, F.lit(True)).cast("int").alias("__new"),
        F.coalesce(F.lead("__m").over(w) - F.col("__m") > next_months, F.lit(True)).cast("int").alias("__lapsed"),
    )
    out = flags.groupBy("__m").agg(
        F.count(F.lit(1)).alias("customers"), F.sum("__new").alias("new_customers"), F.sum("__lapsed").alias("lapsed")
    )
    span = every.agg(F.min("__m").alias("__lo"), F.max("__m").alias("__hi"))
    out = out.crossJoin(F.broadcast(span)).filter(
        (F.col("__m") > F.col("__lo")) & (F.col("__m") + next_months <= F.col("__hi"))
    )
    year, month = F.floor((F.col("__m") - 1) / 12), F.pmod(F.col("__m") - 1, F.lit(12)) + 1
    return out.select(
        (year * 100 + month).cast("int").alias("year_month"), "customers", "new_customers", "lapsed"
    )


def segment_migration(first: DataFrame, second: DataFrame, customer: str = "customer_id", segment: str = "segment") -> DataFrame:
    """Customers per (segment in the first snapshot, segment in the second)."""
    a = first.select(customer, F.col(segment).alias("from_segment"))
    b = second.select(customer, F.col(segment).alias("to_segment"))
    return a.join(b, customer).groupBy("from_segment", "to_segment").agg(F.count(F.lit(1)).alias("customers"))


def organic_share(spend: DataFrame, promo: DataFrame, line: Sequence[str], customer: str = "customer_id") -> DataFrame:
    """Spend of each customer on promoted lines and its share; the rest is organic."""
    tagged = flag_present(spend, promo, line, "__promo")
    out = tagged.groupBy(customer).agg(
        F.sum("amount").alias("spend"),
        F.sum(F.when(F.col("__promo") == 1, F.col("amount")).otherwise(0.0)).alias("promo_spend"),
    )
    share = safe_div("promo_spend", "spend", 0)
    return out.select("*", (F.col("spend") - F.col("promo_spend")).alias("organic_spend"), share.alias("promo_share"))


def never_bought(profile: DataFrame, tx: DataFrame, customer: str = "customer_id") -> DataFrame:
    return exclude(profile, tx, keys=[customer])


def conversion_by_feature(df: DataFrame, features: Sequence[str], flag: str) -> DataFrame:
    return rate_by(df, features, flag)

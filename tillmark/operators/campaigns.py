"""Campaign audiences, test/control splits and results."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from hashlib import md5
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillmark.functions.exprs import safe_div, seeded_order
from tillmark.functions.stats import t_test_p
from tillmark.operators.joins import exclude, flag_present, join_keys, with_group
from tillmark.operators.ordered import percentiles, running
from tillmark.operators.sets import union_all
from tillmark.session import stage


def build_audience(tx: DataFrame, segments: DataFrame, keep_segments: Sequence[str], *excluded: DataFrame, customer: str = "customer_id", segment: str = "segment") -> DataFrame:
    """Customers of the segments who bought, with RPC and ATV, less those on the excluded lists.

    Segment filter and exclusions reduce the customer list first, so the lines of excluded customers are
    dropped before they are aggregated.
    """
    chosen = segments.filter(F.col(segment).isin(*keep_segments)).select(customer, segment)
    if excluded:
        chosen = exclude(chosen, *excluded, keys=[customer])
    out = tx.join(chosen, customer).groupBy(customer, segment).agg(
        F.sum("amount").alias("rpc"), F.countDistinct("transaction_id").alias("orders")
    )
    return out.withColumn("atv", safe_div("rpc", "orders"))


def exclusive_audience(lists: DataFrame, customer: str = "customer_id", campaign: str = "campaign") -> DataFrame:
    """Customers on one list only: one aggregation for all campaigns."""
    per = lists.filter(F.col(customer).isNotNull()).groupBy(customer).agg(
        F.min(campaign).alias("__lo"), F.max(campaign).alias("__hi")
    )
    return per.filter(F.col("__lo") == F.col("__hi")).select(F.col("__lo").alias(campaign), customer)


def sample_cap(lists: DataFrame, caps: Mapping[str, int], seed: int = 42, customer: str = "customer_id", campaign: str = "campaign") -> DataFrame:
    """Seeded random position of each customer within its campaign, up to the campaign's cap.

    Positions are running ones, so that a campaign of very many customers is spread over tasks.
    """
    cap = F.create_map(*[F.lit(v) for kv in caps.items() for v in kv])[F.col(campaign)]
    order = [seeded_order(seed, customer, campaign), F.col(customer)]
    once = lists.select(campaign, customer).distinct()
    return running(once, order, [campaign], position="position").filter(F.col("position") <= cap)


def allocate_audience(lists: DataFrame, order: Sequence[str], caps: Mapping[str, int], seed: int = 42, customer: str = "customer_id", campaign: str = "campaign") -> DataFrame:
    """One campaign per customer, campaigns being served in order.

    A campaign takes its exclusive customers, and those within its cap whom no earlier campaign took. As
    positions are drawn before anyone is taken, a customer ends in the first campaign whose cap reaches
    them: a minimum over campaigns, without a loop.
    """
    lists = stage(lists.filter(F.col(customer).isNotNull() & F.col(campaign).isin(*order)).select(campaign, customer).distinct())
    turn = F.create_map(*[F.lit(v) for i, c in enumerate(order) for v in (c, i)])[F.col(campaign)]
    drawn = sample_cap(lists, caps, seed, customer, campaign).select(campaign, customer)
    candidates = exclusive_audience(lists, customer, campaign).select(campaign, customer).unionByName(drawn)
    return candidates.groupBy(customer).agg(F.min_by(campaign, turn).alias(campaign)).select(campaign, customer)


def ntile_split(df: DataFrame, key: str, tiles: int = 20, test_tiles: int = 19, seed: int = 42) -> DataFrame:
    """Equal tiles of a seeded random order; the first ``test_tiles`` of them are the test set."""
    ranked = running(df.withColumn("__one", F.lit(1)), [seeded_order(seed, key), F.col(key)], position="__p", totals={"__n": "__one"})
    size, rest = F.floor(F.col("__n") / tiles), F.col("__n") % tiles
    wide = rest * (size + 1)
    tile = F.when(F.col("__p") <= wide, F.ceil(F.col("__p") / (size + 1))).otherwise(
        rest + F.ceil(F.try_divide(F.col("__p") - wide, size))
    ).cast("int")
    label = F.when(tile <= test_tiles, F.lit("test")).otherwise(F.lit("control"))
    return ranked.select(*df.columns, tile.alias("tile"), label.alias("campaign_set"))


def sample_rows(df: DataFrame, n: int, keys: Sequence[str], seed: int = 42) -> DataFrame:
    return df.orderBy(seeded_order(seed, *keys), *keys).limit(n)


def validated_split(df: DataFrame, key: str, metric: str, fraction: float, seeds: int = 1000, level: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """Best balanced test/control split out of several seeded ones.

    Returns (customers with their set, report of the seeds examined). For each seed a t-test compares the
    metric of both sets, pooled or Welch as the Levene test on medians says; the largest p wins. Raises
    ``ValueError`` when it does not exceed ``level``.

    Customers get one position in a seeded order; a seed then maps positions by an affine permutation, so
    a set of exact size costs arithmetic and no sort per seed. Both t-tests need sums only. The Levene
    test, which needs medians, runs for the seeds that can still win: those whose better p reaches the
    best worse p.
    """
    rows = df.select(key, F.col(metric).cast("double").alias("__x")).dropna()
    placed = stage(running(rows, [seeded_order(0, key), F.col(key)], position="__p"))
    total = placed.agg(F.count(F.lit(1)).alias("n"), F.avg("__x").alias("mean")).first()
    n, mean = total["n"], total["mean"]
    size = int(n * fraction + 0.5)
    if size < 2 or n - size < 2:
        raise ValueError("too few customers for a split")
    maps = _permutations(n, seeds)
    centred = placed.select("__p", (F.col("__x") - F.lit(mean)).alias("__z"))
    moments = _seed_moments(centred, maps, n, size)
    tests = stage(_t_tests(moments))
    bar = tests.agg(F.max(F.least("p_welch", "p_pooled"))).first()[0]
    if bar is None or bar != bar:
        raise ValueError("the metric does not vary")
    finalists = tests.filter(F.greatest("p_welch", "p_pooled") >= bar)
    last = {r["seed"] for r in finalists.select("seed").collect()}  # ``seeds`` rows at most
    grid = F.array(*[F.struct(F.lit(s).alias("seed"), F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for s, a, b in maps if s in last])
    spread = centred.select("__p", "__z", F.explode(grid).alias("__g")).select("__p", "__z", "__g.*")
    in_test = (F.col("a") * F.col("__p") + F.col("b")) % F.lit(n) < size
    chosen = stage(spread.select("seed", F.when(in_test, F.lit("test")).otherwise(F.lit("control")).alias("part"), "__z"))
    report = join_keys(finalists, _levene(chosen), ["seed"]).withColumn(
        "p_value", F.when(F.col("p_levene") < level, F.col("p_welch")).otherwise(F.col("p_pooled"))
    ).withColumn("t_value", F.when(F.col("p_levene") < level, F.col("t_welch")).otherwise(F.col("t_pooled")))
    report = stage(report)
    best = report.orderBy(F.col("p_value").desc(), "seed").first()
    if not best["p_value"] > level:
        raise ValueError(f"no balanced split: best p-value {best['p_value']:.4f}")
    a, b = next((a, b) for s, a, b in maps if s == best["seed"])
    moved = (F.lit(a).cast("long") * F.col("__p") + F.lit(b)) % F.lit(n)
    split = placed.select(key, F.when(moved < size, F.lit("test")).otherwise(F.lit("control")).alias("campaign_set"))
    return split, report


def _permutations(n: int, seeds: int) -> list[tuple[int, int, int]]:
    """Multiplier prime to ``n`` and offset, per seed, from the MD5 of the seed; the product with a position stays within a long."""
    number = lambda salt, s: int(md5(f"{salt}|{s}".encode()).hexdigest()[:8], 16)
    out = []
    for s in range(seeds):
        a = number("a", s) % min(n, 10**9) + 1
        while gcd(a, n) != 1:
            a += 1
        out.append((s, a, number("b", s) % n))
    return out


def _seed_moments(rows: DataFrame, maps: Sequence[tuple[int, int, int]], n: int, size: int) -> DataFrame:
    """Per seed the rows, sum and sum of squares of ``__z`` in the test part and in the control part.

    A block of rows against all seeds is a 0/1 matrix, and its product with (1, z, z squared) gives the test part's sums. A task
    returns one row per seed, whatever it has read.
    """
    seed, mul, add = (np.array(x, dtype=np.int64) for x in zip(*maps))

    def run(batches):
        test, every = np.zeros((len(seed), 3)), np.zeros(3)
        for batch in batches:
            p, z = batch.column(0).to_numpy().astype(np.int64), batch.column(1).to_numpy()
            for at in range(0, len(p), 2048):
                own = z[at : at + 2048]
                inside = (p[at : at + 2048, None] * mul + add) % n < size
                powers = np.stack([np.ones_like(own), own, own * own], axis=1)
                test += inside.T.astype(np.float64) @ powers
                every += powers.sum(axis=0)
        rest = every - test
        yield pa.RecordBatch.from_arrays([pa.array(seed.astype(np.int32)), *(pa.array(x[:, k]) for x in (test, rest) for k in range(3))], ["seed", "n_t", "s_t", "q_t", "n_c", "s_c", "q_c"])

    names = [f"{k}_{part}" for part in "tc" for k in "nsq"]
    made = rows.mapInArrow(run, "seed int, " + ", ".join(f"{c} double" for c in names))
    sums = made.groupBy("seed").agg(*[F.sum(c).alias(c) for c in names])
    return sums.withColumns({c: F.round(c).cast("long") for c in ("n_t", "n_c")})


def _t_tests(moments: DataFrame) -> DataFrame:
    out = moments
    for name in ("t", "c"):
        n, s, q = (F.col(f"{k}_{name}") for k in "nsq")
        out = out.withColumn(f"m_{name}", s / n).withColumn(f"v_{name}", F.greatest((q - s * s / n) / (n - 1), F.lit(0.0)))
    nt, nc, vt, vc = (F.col(c) for c in ("n_t", "n_c", "v_t", "v_c"))
    gap, df = F.col("m_t") - F.col("m_c"), nt + nc - 2
    pooled = ((nt - 1) * vt + (nc - 1) * vc) / df
    et, ec = vt / nt, vc / nc
    welch_df = safe_div((et + ec) * (et + ec), et * et / (nt - 1) + ec * ec / (nc - 1))
    out = out.withColumn("t_pooled", safe_div(gap, F.sqrt(pooled * (1 / nt + 1 / nc)))).withColumn(
        "t_welch", safe_div(gap, F.sqrt(et + ec))
    )
    return out.select(
        "seed",
        F.col("n_t").alias("test_size"),
        F.col("n_c").alias("control_size"),
        "t_pooled",
        "t_welch",
        t_test_p("t_pooled", df.cast("double")).alias("p_pooled"),
        t_test_p("t_welch", welch_df).alias("p_welch"),
    )


def _levene(rows: DataFrame) -> DataFrame:
    """Levene's test on deviations from the medians of the two parts, per seed."""
    medians = percentiles(rows, "__z", {"__med": 0.5}, ["seed", "part"])
    dev = join_keys(rows, medians, ["seed", "part"]).withColumn("__d", F.abs(F.col("__z") - F.col("__med")))
    parts = dev.groupBy("seed", "part").agg(F.count(F.lit(1)).alias("n"), F.avg("__d").alias("m"), F.var_samp("__d").alias("v"))
    grand = with_group(parts, ["seed"], [F.sum("n").alias("__all"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("__mean")])
    between = F.sum(F.col("n") * (F.col("m") - F.col("__mean")) * (F.col("m") - F.col("__mean")))
    within = F.sum((F.col("n") - 1) * F.col("v"))
    w = grand.groupBy("seed").agg(between.alias("b"), within.alias("w"), F.max("__all").alias("__all"))
    stat = F.sqrt(safe_div(F.col("b") * (F.col("__all") - 2), "w"))
    return w.select("seed", t_test_p(stat, (F.col("__all") - 2).cast("double")).alias("p_levene"))


def assert_members(df: DataFrame, profile: DataFrame, key: str) -> DataFrame:
    """Return ``df``, or raise ``ValueError`` with the number of keys the profile does not know."""
    unknown = exclude(df, profile, keys=[key]).count()
    if unknown:
        raise ValueError(f"{unknown} rows are not in the profile")
    return df


def campaign_metrics(audience: DataFrame, delivery: DataFrame, sales: DataFrame) -> DataFrame:
    """Funnel per campaign and set: audience, opened, returning and offer customers, spend, ATV and RPC.

    For the test set spend counts for customers who opened; for control it counts for all.
    """
    a = join_keys(audience, delivery.select("campaign_id", "customer_id", "delivery_status"), ["campaign_id", "customer_id"])
    cols = ["num_trans", "num_offer_trans", "total_spend", "total_offer_spend"]
    a = join_keys(a, sales.select("campaign_id", "customer_id", *cols), ["campaign_id", "customer_id"]).na.fill(0, subset=cols)
    test, control = F.col("campaign_set") == "test", F.col("campaign_set") == "control"
    opened = F.coalesce(F.col("delivery_status") == "opened", F.lit(False))
    unopened = F.coalesce(F.col("delivery_status") == "not_opened", F.lit(False))
    count = lambda t: F.sum(F.when(t, 1).otherwise(0))
    amount = lambda t, c: F.sum(F.when(t, F.col(c)).otherwise(0))
    bought, used = F.col("num_trans") > 0, F.col("num_offer_trans") > 0
    reached = (test & opened) | control
    out = a.groupBy("campaign_id", "campaign_set").agg(
        F.count("customer_id").alias("customers"),
        count(test & opened).alias("read_customers"),
        count(test & unopened).alias("unread_customers"),
        count(reached & bought).alias("read_returning"),
        count(((test & unopened) | control) & bought).alias("unread_returning"),
        count(opened & used).alias("read_offer"),
        count(unopened & used).alias("unread_offer"),
        amount(reached, "total_spend").alias("spend"),
        amount(test & opened, "total_offer_spend").alias("offer_spend"),
        amount(reached, "num_trans").alias("transactions"),
        amount(test & opened, "num_offer_trans").alias("offer_transactions"),
    )
    base = F.when(F.col("campaign_set") == "test", F.col("read_customers")).otherwise(F.col("customers"))
    return out.select(
        "*",
        safe_div("spend", "transactions").alias("atv"),
        safe_div("spend", "read_returning").alias("rpc"),
        safe_div("read_returning", base, 0).alias("returning_share"),
    )


def offer_conversion(tx: DataFrame, audience: DataFrame, threshold: float, customer: str = "customer_id") -> DataFrame:
    """Customers reaching the offer threshold, per set, over those addressed (test: opened only)."""
    addressed = audience.filter((F.col("campaign_set") == "control") | (F.col("delivery_status") == "opened"))
    spend = tx.join(addressed.select(customer).distinct(), customer, "left_semi").groupBy(customer).agg(F.sum("amount").alias("__rpc"))
    out = join_keys(addressed, spend, [customer])
    hit = F.col("__rpc") >= threshold
    res = out.groupBy("campaign_set").agg(
        F.countDistinct(customer).alias("addressed"),
        F.countDistinct(F.when(hit, F.col(customer))).alias("converted"),
        F.avg(F.when(hit, F.col("__rpc"))).alias("converted_rpc"),
    )
    return res.withColumn("conversion", safe_div("converted", "addressed", 0))


def expected_conversion(
    tx: DataFrame, segments: DataFrame, categories: DataFrame, week: str, customer: str = "customer_id", segment: str = "segment", category: str = "category"
) -> DataFrame:
    """Mean weekly customers per campaign among buyers of its segments and categories.

    ``segments`` and ``categories`` list (campaign, segment) and (campaign, category). All campaigns are
    counted together from distinct (customer, segment, category, week) rows.
    """
    rows = tx.select(customer, segment, category, week).distinct()
    rows = rows.join(segments.distinct(), segment)
    rows = rows.join(categories.distinct(), ["campaign", category])
    weekly = rows.groupBy("campaign", week).agg(F.countDistinct(customer).alias("__n"))
    return weekly.groupBy("campaign").agg(F.count(F.lit(1)).alias("weeks"), F.avg("__n").alias("avg_weekly_customers"))


def campaign_open_rate(delivery: DataFrame, min_campaigns: int = 3, customer: str = "customer_id") -> DataFrame:
    """Campaigns, opens and open rate per customer, with the flag of those who never open."""
    out = delivery.groupBy(customer).agg(
        F.count(F.lit(1)).alias("campaigns"), F.sum((F.col("delivery_status") == "opened").cast("int")).alias("opens")
    ).withColumn("open_rate", safe_div("opens", "campaigns"))
    flag = ((F.col("campaigns") >= min_campaigns) & (F.col("open_rate") == 0)).cast("int")
    return out.withColumn("exclude_flag", flag)


def reachability(profile: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Share of customers with each contact column filled."""
    out = profile.groupBy(*by).agg(F.count(F.lit(1)).alias("customers"), *[F.count(c).alias(f"with_{c}") for c in columns])
    return out.select("*", *[safe_div(f"with_{c}", "customers").alias(f"{c}_share") for c in columns])


def touched_before(audience: DataFrame, delivery: DataFrame, customer: str = "customer_id", name: str = "touched") -> DataFrame:
    return flag_present(audience, delivery, [customer], name)


def campaign_lists(named: Mapping[str, DataFrame], customer: str = "customer_id") -> DataFrame:
    """One (campaign, customer) frame out of several lists."""
    return union_all([df.select(F.lit(name).alias("campaign"), customer) for name, df in named.items()]).distinct()


def threshold_met(column: str, threshold: float) -> Column:
    return (F.col(column) >= threshold).cast("int")

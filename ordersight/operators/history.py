"""Per-person order history features and labels.

Every feature of an order looks only at the person's *earlier* orders, in
``(order time, order id)`` order (ties at the same second are broken by the
order id). All of them are prefix aggregates, so they are built with
``ordered_prefix`` and stay balanced when one person has a huge history.

W6 (orders in the last 90 days) is a sweep: every order also emits an
"expiry" event at ``t + 90 days + 1 s``; the expiry events seen before an order
are the earlier orders that are more than 90 days old.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.time import SECONDS_PER_DAY, epoch_seconds, whole_days
from .prefix import (_AGG, DEFAULT_HOT_THRESHOLD, DEFAULT_MAX_HOT_KEYS, add_chunk, chunk_summary,
                     combine, hot_keys, local_prefix, ordered_prefix, split_hot, with_parts)

HISTORY_COLUMNS = [
    "time_since_last_purchase", "time_between_purchases", "time_since_first_purchase",
    "number_of_past_orders", "order_frequency_90_days", "average_order_value",
    "total_order_value", "std_order_value", "repeat_purchase_amount",
]


def history_features(df: DataFrame, person: str = "person_id", ts: str = "order_datetime",
                     order: str = "order_id", total: str = "order_total", *,
                     window_days: int = 90, bucket: int = SECONDS_PER_DAY, labels: bool = True,
                     hot_threshold: int | None = DEFAULT_HOT_THRESHOLD,
                     max_hot_keys: int = DEFAULT_MAX_HOT_KEYS,
                     instant_threshold: int = DEFAULT_HOT_THRESHOLD) -> DataFrame:
    """Add W1-W9 (and the labels W12/W13 when ``labels``) to an order table.

    * ``time_since_last_purchase``: whole days since the previous order.
    * ``time_between_purchases``: one earlier order: same as above; n >= 2 earlier
      orders: sum of the whole-day gaps among the earlier orders divided by n.
    * ``time_since_first_purchase``: whole days since the first order.
    * ``number_of_past_orders`` = ``repeat_purchase_amount``: earlier orders.
    * ``order_frequency_90_days``: earlier orders at most 90 days (to the second) old.
    * ``average_order_value`` / ``total_order_value`` / ``std_order_value``: mean,
      sum and sample standard deviation of earlier order totals (nulls ignored;
      totals are taken to four decimals and summed exactly).
    * ``repeat_customer_initial`` (W12): 1 unless it is the person's first order.
    * ``repeat_customer`` (W13): 1 unless it is the person's last order.

    Persons with more than ``hot_threshold`` orders (found by one partially
    aggregated count; at most ``max_hot_keys`` of them, else all persons) take
    the chunked path: one shuffle by ``(person, chunk)`` with chunks of at most
    one day (``bucket`` must divide a day), so consecutive orders in a chunk are
    less than a day apart and the W2 gap sums come from the chunk level. Chunks
    of more than ``instant_threshold`` events are cut again by ``(time, order id)``,
    so orders that all share a second are spread too. All other persons use plain per-person windows. ``hot_threshold=None`` sends
    every person through the chunked path. Rows with a null person keep null
    features and labels.
    """
    if bucket <= 0 or SECONDS_PER_DAY % bucket:
        raise ValueError("bucket must divide one day (86400 s)")
    s = "_s"
    known = F.col(person).isNotNull()
    base = df.filter(known).withColumn(s, epoch_seconds(ts))
    feats_light = None
    if hot_threshold is not None:
        hk = hot_keys(base, [person], hot_threshold, max_hot_keys)
        if hk is not None:
            light, base = split_hot(base, [person], hk) if hk else (base, None)
            feats_light = _plain_history(light, person, order, total, window_days, labels, s)
    parts = [feats_light] if feats_light is not None else []
    if base is not None:
        parts.append(_chunked_history(base, person, order, total, window_days, bucket, labels, s, instant_threshold))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p.select(*out.columns))
    feats = [c for c in out.columns if c not in df.columns]
    # Orders without a person keep their row; every history column is null.
    nulls = df.filter(~known)
    return out.unionByName(nulls.withColumns(
        {c: F.lit(None).cast(out.schema[c].dataType) for c in feats}))


def _features(n, n_old, cnt, sm, sq, gap, gap_before, s, first_s, n_all, labels):
    """Feature columns from prefix quantities (shared by both paths)."""
    # n * sum(x^2) - sum(x)^2 = n * (n - 1) * sample variance, exact in money units^2.
    nvar = (cnt.cast("decimal(38,0)") * sq - sm * sm).cast("double")
    feats = {
        "time_since_last_purchase": F.when(n > 0, gap),
        "time_between_purchases": F.when(n == 1, gap.cast("double"))
                                   .when(n > 1, gap_before.cast("double") / n),
        "time_since_first_purchase": F.when(n > 0, whole_days(F.col(s) - first_s)),
        "number_of_past_orders": n,
        "order_frequency_90_days": n - n_old,
        "average_order_value": F.when(cnt > 0, sm.cast("double") / cnt / F.lit(float(MONEY_UNITS))),
        "total_order_value": F.when(cnt > 0, sm.cast("double") / F.lit(float(MONEY_UNITS))),
        "std_order_value": F.when(cnt > 1, F.sqrt(F.greatest(nvar, F.lit(0.0)) / (cnt * (cnt - 1)))
                                  / F.lit(float(MONEY_UNITS))),
        "repeat_purchase_amount": n,
    }
    if labels:
        feats["repeat_customer_initial"] = (n > 0).cast("int")
        feats["repeat_customer"] = (n + 1 < n_all).cast("int")
    return feats


#: Whole units of money a 1.00 has: totals count to the fourth decimal.
MONEY_UNITS = 10_000


def _units(total: str) -> Column:
    # Money is summed exactly in whole units (sum of squares as 38-digit
    # decimals), so results do not depend on partitioning or summation order.
    return F.round(F.col(total).cast("double") * MONEY_UNITS).cast("bigint")


def _plain_history(rows: DataFrame, person, order, total, window_days, labels, s) -> DataFrame:
    """Per-person windows (one shuffle by person) for persons of bounded size."""
    w = W.partitionBy(person).orderBy(F.col(s), F.col(order))
    wp = w.rowsBetween(W.unboundedPreceding, -1)
    old = W.partitionBy(person).orderBy(F.col(s)).rangeBetween(
        W.unboundedPreceding, -(window_days * SECONDS_PER_DAY + 1))
    c38 = _units(total).cast("decimal(38,0)")
    x = rows.withColumns({
        "_n": F.count(F.lit(1)).over(wp), "_old": F.count(F.lit(1)).over(old),
        "_prev_s": F.lag(s).over(w), "_first_s": F.min(s).over(wp),
        "_cnt": F.count(c38).over(wp), "_sum": F.sum(c38).over(wp), "_sq": F.sum(c38 * c38).over(wp),
        "_n_all": F.count(F.lit(1)).over(W.partitionBy(person))})
    x = x.withColumn("_gap", whole_days(F.col(s) - F.col("_prev_s")))
    x = x.withColumn("_gap_before", F.sum("_gap").over(wp))
    feats = _features(F.col("_n"), F.col("_old"), F.col("_cnt"), F.col("_sum"), F.col("_sq"),
                      F.col("_gap"), F.coalesce(F.col("_gap_before"), F.lit(0)), s, F.col("_first_s"),
                      F.col("_n_all"), labels)
    tmp = ["_n", "_old", "_prev_s", "_first_s", "_cnt", "_sum", "_sq", "_n_all", "_gap", "_gap_before", s]
    return x.withColumns(feats).drop(*tmp)


def _chunked_history(base: DataFrame, person, order, total, window_days, bucket, labels, s,
                     instant_threshold) -> DataFrame:
    """Chunked path: one shuffle by (person, chunk); W6 as an expiry-event sweep."""
    rows_in = base.withColumns({"_kind": F.lit(1), "_is_row": F.lit(1), "_is_exp": F.lit(0)})
    expiry = rows_in.select(
        F.col(person), F.col(order),
        (F.col(s) + F.lit(window_days * SECONDS_PER_DAY + 1)).alias(s),
        F.lit(0).alias("_kind"), F.lit(0).alias("_is_row"), F.lit(1).alias("_is_exp"))
    sweep = add_chunk(rows_in.unionByName(expiry, allowMissingColumns=True), s, bucket)
    sweep = with_parts(sweep, [person, "_chunk"], [s, "_kind", order], instant_threshold)
    keys = [person, "_chunk", "_part"]

    row = F.col("_is_row") == 1
    rs = F.when(row, F.col(s))
    units = F.when(row, _units(total))
    c38 = units.cast("decimal(38,0)")
    aggs = [("n", "sum", F.col("_is_row").cast("bigint")),
            ("exp", "sum", F.col("_is_exp").cast("bigint")),
            ("max_s", "max", rs), ("min_s", "min", rs),
            ("cnt", "sum", F.when(units.isNotNull(), F.lit(1)).otherwise(F.lit(0)).cast("bigint")),
            ("sum", "sum", c38), ("sq", "sum", c38 * c38)]

    rows = local_prefix(sweep, keys, [F.col(s), F.col("_kind"), F.col(order)], aggs)
    summ = chunk_summary(sweep, keys, aggs)
    # Chunk level: gap of each chunk's first order to the previous chunk's last one.
    w_prev = W.partitionBy(person).orderBy("_chunk", "_part").rowsBetween(W.unboundedPreceding, -1)
    summ = summ.withColumn("_prev_max_s", F.max("_tmax_s").over(w_prev))
    summ = summ.withColumn("_tfirst_gap", whole_days(F.col("_tmin_s") - F.col("_prev_max_s")))
    offs = summ.select(
        *keys, "_prev_max_s", "_tfirst_gap",
        *[_AGG[k](F.col(f"_t{n}")).over(w_prev).alias(f"_o{n}") for n, k, _ in aggs],
        F.sum(F.coalesce("_tfirst_gap", F.lit(0))).over(w_prev).alias("_ogap"),
        F.sum("_tn").over(W.partitionBy(person)).alias("_n_all"))
    j = rows.filter(row).join(offs, keys, "inner")

    def tot(n, k):
        return combine(k, F.col(f"_o{n}"), F.col(f"_l{n}"))

    prev_s = F.coalesce(F.col("_lmax_s"), F.col("_prev_max_s"))
    has_local_prev = F.coalesce(F.col("_ln"), F.lit(0)) > 0
    gap_before = F.coalesce(F.col("_ogap"), F.lit(0)) + F.when(
        has_local_prev, F.coalesce(F.col("_tfirst_gap"), F.lit(0))).otherwise(F.lit(0))
    feats = _features(F.coalesce(tot("n", "sum"), F.lit(0)), F.coalesce(tot("exp", "sum"), F.lit(0)),
                      F.coalesce(tot("cnt", "sum"), F.lit(0)), tot("sum", "sum"), tot("sq", "sum"),
                      whole_days(F.col(s) - prev_s), gap_before, s,
                      F.coalesce(F.col("_omin_s"), F.col("_lmin_s")), F.col("_n_all"), labels)
    keep = [c for c in base.columns if c != s]
    return j.select(*keep, *[v.alias(k) for k, v in feats.items()])


def repeat_flags(df: DataFrame, person: str = "person_id", ts: str = "order_datetime",
                 order: str = "order_id", *, bucket: int = SECONDS_PER_DAY,
                 hot_threshold: int | None = DEFAULT_HOT_THRESHOLD,
                 instant_threshold: int = DEFAULT_HOT_THRESHOLD) -> DataFrame:
    """W12 ``repeat_customer_initial`` and W13 ``repeat_customer`` only."""
    s = "_s"
    base = df.withColumn(s, epoch_seconds(ts))
    out = ordered_prefix(base, [person], s, [order], [("_n", "sum", F.lit(1).cast("bigint"))],
                         bucket=bucket, whole=[("_n_all", "sum", F.lit(1).cast("bigint"))],
                         hot_threshold=hot_threshold, instant_threshold=instant_threshold)
    known = F.col(person).isNotNull()
    n = F.coalesce(F.col("_n"), F.lit(0))
    return out.withColumns({
        "repeat_customer_initial": F.when(known, (n > 0).cast("int")),
        "repeat_customer": F.when(known, (n + 1 < F.col("_n_all")).cast("int")),
    }).drop(s, "_chunk", "_n", "_n_all")

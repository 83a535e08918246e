"""Model evaluation as table aggregations over ``(y, score)`` rows.

The input is a long table ``(target, y, score)`` — pooled predictions of any
number of models (U2): one row per scored example and target. Scores are first
aggregated to distinct values per target (positives, negatives), so the work
after the first aggregation is bounded by the number of distinct scores. The
cumulative sums along the score axis use ``ordered_prefix`` with score buckets
as chunks, so no single task walks all distinct scores.

Curve conventions: at threshold ``t`` an example is predicted positive when
``score >= t``. The precision-recall curve has one point per distinct score in
ascending order plus the final point (precision 1, recall 0, no threshold).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .prefix import DEFAULT_HOT_THRESHOLD, ordered_prefix

SCORE_BUCKETS = 1 << 20  # chunks along the score axis (probabilities in [0, 1]); chunk table <= 1M rows


def score_counts(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``(*by, score, pos, neg)``: examples per distinct score."""
    by = by or []
    return scored.groupBy(*by, "score").agg(
        F.sum(F.col("y").cast("bigint")).alias("pos"),
        F.sum((1 - F.col("y")).cast("bigint")).alias("neg"))


def _cumulative(counts: DataFrame, by: list[str]) -> DataFrame:
    """Add ``pos_above``/``neg_above`` (score > s) and ``neg_below`` (score < s) per ``by``.

    One prefix pass: sums over lower scores plus the group totals give the sums
    over higher scores (``above = total - below - own``).
    """
    keyed = counts.withColumn("_g", F.lit(0)) if not by else counts
    keys = by or ["_g"]
    keyed = keyed.withColumn("_chunk", F.floor(F.col("score") * SCORE_BUCKETS).cast("bigint"))
    cum = ordered_prefix(keyed, keys, "score", [], [("_pb", "sum", F.col("pos")),
                                                    ("_nb", "sum", F.col("neg"))],
                         null_keys=False, hot_threshold=DEFAULT_HOT_THRESHOLD,
                         whole=[("P", "sum", F.col("pos")), ("N", "sum", F.col("neg"))])
    pb = F.coalesce(F.col("_pb"), F.lit(0))
    nb = F.coalesce(F.col("_nb"), F.lit(0))
    out = cum.withColumns({
        "pos_above": (F.col("P") - pb - F.col("pos")).cast("bigint"),
        "neg_above": (F.col("N") - nb - F.col("neg")).cast("bigint"),
        "neg_below": nb.cast("bigint")})
    return out.drop("_chunk", "_pb", "_nb", *(["_g"] if not by else []))


def _with_end(c: DataFrame, by: list[str], point: Column, end: Column) -> DataFrame:
    """The points of a curve; the highest score of each group also gives the curve's end (no second scan)."""
    top = F.col("pos_above") + F.col("neg_above") == 0
    return c.select(*by, F.explode(F.when(top, F.array(point, end)).otherwise(F.array(point))).alias("_p")) \
        .select(*by, "_p.*")


def pr_curve(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``(*by, threshold, precision, recall, tp, fp)`` per distinct score, plus the
    final point ``(null, 1.0, 0.0)`` (V1)."""
    by = by or []
    c = _cumulative(score_counts(scored, by), by)
    tp = F.col("pos_above") + F.col("pos")
    fp = F.col("neg_above") + F.col("neg")
    point = F.struct(F.col("score").alias("threshold"),
                     F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.lit(0.0)).alias("precision"),
                     F.when(F.col("P") > 0, tp / F.col("P")).otherwise(F.lit(1.0)).alias("recall"),
                     tp.alias("tp"), fp.alias("fp"))
    none = F.lit(None).cast("bigint")
    final = F.struct(F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"),
                     F.lit(0.0).alias("recall"), none.alias("tp"), none.alias("fp"))
    return _with_end(c, by, point, final)


def roc_curve(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``(*by, threshold, fpr, tpr)`` per distinct score plus the start ``(null, 0, 0)`` (V2)."""
    by = by or []
    c = _cumulative(score_counts(scored, by), by)
    tp = F.col("pos_above") + F.col("pos")
    fp = F.col("neg_above") + F.col("neg")
    point = F.struct(F.col("score").alias("threshold"),
                     F.when(F.col("N") > 0, fp / F.col("N")).alias("fpr"),
                     F.when(F.col("P") > 0, tp / F.col("P")).alias("tpr"))
    start = F.struct(F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"),
                     F.lit(0.0).alias("tpr"))
    return _with_end(c, by, point, start)


def auc(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """ROC AUC with ties counted half (V3; V5 with ``by=["target"]``).

    ``AUC = sum_s pos_s * (2 * neg_below_s + neg_s) / (2 * P * N)``, integers
    until the single final division. Null when a class is missing.
    """
    by = by or []
    c = _cumulative(score_counts(scored, by), by)
    num = F.col("pos") * (2 * F.col("neg_below") + F.col("neg"))
    agg = c.groupBy(*by).agg(F.sum(num.cast("decimal(38,0)")).alias("_num"),
                             F.max("P").alias("positives"), F.max("N").alias("negatives"))
    den = (F.lit(2) * F.col("positives") * F.col("negatives")).cast("double")
    return agg.select(*by, F.when(den > 0, F.col("_num").cast("double") / den).alias("auc"),
                      "positives", "negatives")


def weighted_auc(scored: DataFrame) -> DataFrame:
    """Mean of per-target AUC weighted by the target's positives (V4)."""
    per = auc(scored, ["target"]).filter(F.col("auc").isNotNull())
    return per.agg((F.sum(F.col("auc") * F.col("positives")) / F.sum("positives")).alias("auc_weighted"))


# ------------------------------------------------------------ thresholded metrics

def confusion(scored: DataFrame, threshold: float | Column, strict: bool = False) -> DataFrame:
    """``(y, pred, n)`` with ``pred = score >= t`` (``>`` when ``strict``) (V8)."""
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    pred = (F.col("score") > t) if strict else (F.col("score") >= t)
    return scored.groupBy(F.col("y").cast("int").alias("y"), pred.cast("int").alias("pred")).agg(
        F.count(F.lit(1)).alias("n"))


def _class_stats(conf: DataFrame) -> DataFrame:
    """Per class 0/1: tp, fp, fn, support from a 2x2 confusion table."""
    wide = conf.agg(*[F.coalesce(F.sum(F.when((F.col("y") == a) & (F.col("pred") == b), F.col("n"))),
                                 F.lit(0)).cast("bigint").alias(f"c{a}{b}")
                      for a in (0, 1) for b in (0, 1)])
    rows = []
    for cls in (0, 1):
        other = 1 - cls
        rows.append(wide.select(
            F.lit(cls).alias("label"),
            F.col(f"c{cls}{cls}").alias("tp"), F.col(f"c{other}{cls}").alias("fp"),
            F.col(f"c{cls}{other}").alias("fn"),
            (F.col(f"c{cls}{cls}") + F.col(f"c{cls}{other}")).alias("support")))
    return rows[0].unionByName(rows[1])


def _prf(tp, fp, fn):
    p = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.lit(0.0))
    r = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(F.lit(0.0))
    f = F.when(2 * tp + fp + fn > 0, (2 * tp) / (2 * tp + fp + fn)).otherwise(F.lit(0.0))
    return p, r, f


def class_report(scored: DataFrame, threshold: float | Column) -> DataFrame:
    """Per-class precision, recall, F1, support plus macro and weighted averages (V7, V8)."""
    st = _class_stats(confusion(scored, threshold))
    p, r, f = _prf(F.col("tp"), F.col("fp"), F.col("fn"))
    per = st.select(F.col("label").cast("string").alias("label"), p.alias("precision"),
                    r.alias("recall"), f.alias("f1"), F.col("support"))
    macro = per.agg(*[(F.sum(c) / 2).alias(c) for c in ("precision", "recall", "f1")],
                    F.sum("support").alias("support")).select(
        F.lit("macro avg").alias("label"), "precision", "recall", "f1", "support")
    weighted = per.agg(*[(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c)
                         for c in ("precision", "recall", "f1")],
                            F.sum("support").alias("support")).select(
        F.lit("weighted avg").alias("label"), "precision", "recall", "f1", "support")
    return per.unionByName(macro).unionByName(weighted)


def class_stats_by(scored: DataFrame, by: list[str], threshold: Column) -> DataFrame:
    """Per group: precision, recall and F1 of class 1 at the row's own threshold (V7 per target)."""
    hit = F.col("score") >= threshold
    pos = F.col("y") == 1
    agg = scored.groupBy(*by).agg(F.count_if(hit & pos).alias("tp"), F.count_if(hit & ~pos).alias("fp"),
                                  F.count_if(~hit & pos).alias("fn"))
    p, r, f = _prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return agg.select(*by, p.alias("precision"), r.alias("recall"), f.alias("f1"))


def pooled_metrics(scored: DataFrame, threshold: float | Column) -> DataFrame:
    """Accuracy and macro precision / recall / F1 of pooled predictions (V6)."""
    st = _class_stats(confusion(scored, threshold))
    p, r, f = _prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return st.agg(
        F.sum("tp").alias("_correct"),
        F.sum("support").alias("_n"),
        (F.sum(p) / 2).alias("precision_macro"), (F.sum(r) / 2).alias("recall_macro"),
        (F.sum(f) / 2).alias("f1_macro")).select(
        (F.col("_correct") / F.col("_n")).alias("accuracy"), "precision_macro", "recall_macro",
        "f1_macro")


# ---------------------------------------------------------------- thresholds

def _f1_col(eps: float) -> Column:
    p, r = F.col("precision"), F.col("recall")
    return (F.lit(2.0) * p * r) / (p + r + F.lit(eps))


def threshold_best_f1(scored: DataFrame) -> DataFrame:
    """Threshold of the PR point with the best F1 (``+1e-9``), lowest on ties (V9)."""
    c = pr_curve(scored).filter(F.col("threshold").isNotNull()).withColumn("f1", _f1_col(1e-9))
    best = c.agg(F.min_by(F.struct("threshold", "precision", "recall", "f1"),
                          F.struct(-F.col("f1"), F.col("threshold"))).alias("b"))
    return best.select("b.threshold", "b.precision", "b.recall", "b.f1")


def threshold_f1_recall(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Threshold with the best ``F1 + 0.01 * recall`` (``+1e-10``), lowest on ties."""
    by = by or []
    c = pr_curve(scored, by).filter(F.col("threshold").isNotNull()).withColumn("f1", _f1_col(1e-10))
    key = F.col("f1") + F.lit(0.01) * F.col("recall")
    best = c.groupBy(*by).agg(F.min_by(F.struct("threshold", "precision", "recall", "f1"),
                                       F.struct(-key, F.col("threshold"))).alias("b"))
    return best.select(*by, "b.threshold", "b.precision", "b.recall", "b.f1")


def threshold_min_precision(scored: DataFrame, min_precision: float = 0.4) -> DataFrame:
    """Lowest threshold whose precision reaches ``min_precision``; 1.0 when none."""
    c = pr_curve(scored).filter(F.col("threshold").isNotNull())
    return c.agg(F.coalesce(F.min(F.when(F.col("precision") >= min_precision, F.col("threshold"))),
                            F.lit(1.0)).alias("threshold"))


def threshold_precision_recall(scored: DataFrame, min_precision: float = 0.3) -> DataFrame:
    """Lowest threshold with precision >= p and recall > precision; else 0.5."""
    c = pr_curve(scored).filter(F.col("threshold").isNotNull())
    ok = (F.col("precision") >= min_precision) & (F.col("recall") > F.col("precision"))
    return c.agg(F.coalesce(F.min(F.when(ok, F.col("threshold"))), F.lit(0.5)).alias("threshold"))


def sweep_thresholds(spark: SparkSession, start: float = 0.01, stop: float = 0.9,
                     num: int = 100) -> DataFrame:
    """``num`` evenly spaced thresholds from ``start`` to ``stop`` (both included)."""
    step = (stop - start) / (num - 1)
    i = F.col("id")
    return spark.range(num).select(
        F.when(i == num - 1, F.lit(stop)).otherwise(i.cast("double") * F.lit(step) + F.lit(start))
        .alias("threshold"))


def threshold_sweep(scored: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Macro F1 of ``score > t`` for each threshold; the first best one.

    Thresholds are merged into the distinct-score sequence (placed after equal
    scores), so one cumulative pass gives, for every threshold, the positives
    and negatives scored above it; no threshold x score product is formed.
    """
    counts = score_counts(scored).withColumn("_kind", F.lit(0))
    th = thresholds.select(F.col("threshold").alias("score"), F.lit(0).cast("bigint").alias("pos"),
                           F.lit(0).cast("bigint").alias("neg"), F.lit(1).alias("_kind"))
    seq = counts.unionByName(th).withColumn("_g", F.lit(0)).withColumn(
        "_chunk", F.floor(F.col("score") * SCORE_BUCKETS).cast("bigint"))
    cum = ordered_prefix(seq, ["_g"], "score", ["_kind"],
                         [("_pa", "sum", F.col("pos")), ("_na", "sum", F.col("neg"))],
                         direction="after", null_keys=False, hot_threshold=DEFAULT_HOT_THRESHOLD,
                         whole=[("_P", "sum", F.col("pos")), ("_N", "sum", F.col("neg"))])
    tp = F.coalesce(F.col("_pa"), F.lit(0))
    fp = F.coalesce(F.col("_na"), F.lit(0))
    fn = F.col("_P") - tp
    tn = F.col("_N") - fp
    f1_pos = F.when(2 * tp + fp + fn > 0, (2 * tp) / (2 * tp + fp + fn)).otherwise(F.lit(0.0))
    f1_neg = F.when(2 * tn + fn + fp > 0, (2 * tn) / (2 * tn + fn + fp)).otherwise(F.lit(0.0))
    per = cum.filter(F.col("_kind") == 1).select(
        F.col("score").alias("threshold"), ((f1_pos + f1_neg) / 2).alias("f1_macro"))
    best = per.agg(F.min_by(F.struct("threshold", "f1_macro"),
                            F.struct(-F.col("f1_macro"), F.col("threshold"))).alias("b"))
    return best.select("b.threshold", "b.f1_macro")


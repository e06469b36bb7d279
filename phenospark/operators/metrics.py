"""Evaluation metrics over (group, y, p, call) rows. Undefined metrics are null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import rounded


def _count(when: Column) -> Column:
    return F.sum(F.when(when, 1).otherwise(0))


#: Ranges of a group's distinct scores.
BUCKETS = 256


def by_score(rows: DataFrame, group: str) -> DataFrame:
    """Positives and negatives of each distinct score: what rank metrics need, aggregated before any window, with the range
    _b that the score lies in. Ranges hold about equally many of a group's scores, wherever they pile up."""
    t = rows.groupBy(group, "p").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    shares = F.array(*[F.lit(k / BUCKETS) for k in range(1, BUCKETS)])
    cuts = t.groupBy(group).agg(F.percentile_approx("p", shares, F.lit(20 * BUCKETS)).alias("_cuts"))
    return t.join(cuts, group).withColumn("_b", F.size(F.filter("_cuts", lambda c: c < F.col("p")))).drop("_cuts")


def _running(t: DataFrame, group: str, columns: list[str], rising: bool, inclusive: bool) -> DataFrame:
    """Running sums over a group's scores in order, without a group's scores in one task: sums before each of at most
    BUCKETS ranges of scores, and windows within a range."""
    order = F.col("p") if rising else F.desc("p")
    bucket = F.col("_b") if rising else F.desc("_b")
    before = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(group, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    sums = t.groupBy(group, "_b").agg(*[F.sum(c).alias(c) for c in columns]).select(group, "_b", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_{c}") for c in columns])
    both = t.join(sums, [group, "_b"])
    return both.select(*t.columns, *[(F.col(f"_{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(f"{c}_to") for c in columns])


def auroc(rows: DataFrame, group: str) -> DataFrame:
    """Mann-Whitney with ties at half, over distinct scores."""
    t = _running(by_score(rows, group), group, ["neg"], True, False)
    out = t.groupBy(group).agg(F.sum(F.col("pos") * (F.col("neg_to") + F.col("neg") / 2)).alias("u"), F.sum("pos").alias("np"), F.sum("neg").alias("nn"))
    return out.select(group, F.when((F.col("np") > 0) & (F.col("nn") > 0), F.col("u") / (F.col("np") * F.col("nn"))).alias("auroc"))


def average_precision(rows: DataFrame, group: str) -> DataFrame:
    """Sum of recall steps times precision over distinct thresholds."""
    t = _running(by_score(rows, group), group, ["pos", "neg"], False, True)
    out = t.groupBy(group).agg(F.sum(F.col("pos") * F.col("pos_to") / (F.col("pos_to") + F.col("neg_to"))).alias("s"), F.sum("pos").alias("np"), F.sum("neg").alias("nn"))
    return out.select(group, F.when((F.col("np") > 0) & (F.col("nn") > 0), F.col("s") / F.col("np")).alias("pr_auc"))


def decisions(rows: DataFrame, group: str) -> DataFrame:
    """Balanced accuracy, recalls and F1 on answered rows; null where the truth has one class."""
    fail, work = F.col("call") == "likely_to_fail", F.col("call") == "likely_to_work"
    y = F.col("y") == 1
    c = rows.groupBy(group).agg(_count(fail & y).alias("tp"), _count(fail & ~y).alias("fp"), _count(work & ~y).alias("tn"), _count(work & y).alias("fn"))
    both = (F.col("tp") + F.col("fn") > 0) & (F.col("tn") + F.col("fp") > 0)
    r, s = F.col("tp") / (F.col("tp") + F.col("fn")), F.col("tn") / (F.col("tn") + F.col("fp"))
    return c.select(
        group,
        (F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")).alias("n_answered"),
        F.when(both, (r + s) / 2).alias("bal_acc"),
        F.when(both, r).alias("recall_r"),
        F.when(both, s).alias("recall_s"),
        F.when(both, 2.0 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).alias("f1_r"),
    )


def coverage(rows: DataFrame, group: str) -> DataFrame:
    def pct(when: Column) -> Column:
        return 100.0 * _count(when) / F.count("*")

    call = F.col("call")
    return rows.groupBy(group).agg(F.count("*").alias("n"), pct(call.isin("likely_to_fail", "likely_to_work")).alias("coverage"), pct(call == "no_call").alias("no_call"), pct(call == "not_applicable").alias("not_applicable"))


def brier(rows: DataFrame, group: str, p: str = "p") -> DataFrame:
    return rows.groupBy(group).agg(F.avg((F.col(p) - F.col("y")) * (F.col(p) - F.col("y"))).alias("brier"))


def reliability(rows: DataFrame, bins: int = 10) -> DataFrame:
    """Bins closed on the left, the last on both sides; empty ones are left out. Edges are literals k / bins."""
    at = F.lit(0)
    for k in range(1, bins):
        at = at + (F.col("p") >= k / bins).cast("int")
    return rows.groupBy(at.alias("bin")).agg(F.avg("p").alias("mean_p"), F.avg("y").alias("mean_y"), F.count("*").alias("n"))


def per_cluster(rows: DataFrame, cluster: str, least: int = 3) -> DataFrame:
    out = decisions(rows, cluster)
    right = rows.where(F.col("call").isin("likely_to_fail", "likely_to_work")).groupBy(cluster).agg(F.avg(((F.col("call") == "likely_to_fail") == (F.col("y") == 1)).cast("double")).alias("accuracy"))
    return out.where(F.col("n_answered") >= least).join(right, cluster).select(cluster, "n_answered", "accuracy", "bal_acc")


def over_seeds(rows: DataFrame, group: str, metric: str) -> DataFrame:
    """Mean, population deviation and number of seeds whose metric is defined."""
    return rows.groupBy(group).agg(F.avg(metric).alias("mean"), F.stddev_pop(metric).alias("sd"), F.count(metric).alias("seeds"))


def seed_table(rows: DataFrame, group: str, metrics: list[str]) -> DataFrame:
    """One row a group: n_test (mean), seeds, and of each metric mean±sd as text (n/a where no seed has it) and the number
    of seeds that do. ``rows`` has one row for each group and seed."""
    def text(m: str) -> Column:
        return F.when(F.count(m) > 0, F.format_string("%.3f±%.3f", F.avg(m), F.stddev_pop(m))).otherwise("n/a")

    return rows.groupBy(group).agg(F.bround(F.avg("n_test"), 0).cast("long").alias("n_test"), F.count("*").alias("seeds"), *[c for m in metrics for c in (text(m).alias(m), F.count(m).alias(f"{m}_n"))])


def leakage(rows: DataFrame, group: str) -> DataFrame:
    """Mean and sample deviation for the random and the grouped split to three digits, and the gap of these means."""
    def of(kind: str, f):
        return rounded(f(F.when(F.col("split") == kind, F.col("value"))), 3)

    out = rows.groupBy(group).agg(*[of(k, f).alias(f"{k}{n}") for k in ("random", "grouped") for n, f in (("", F.avg), ("_sd", F.stddev_samp))])
    return out.withColumn("gap", rounded(F.col("random") - F.col("grouped"), 3))


def calibration(rows: DataFrame, group: str, low: float, high: float) -> DataFrame:
    """n, Brier score before and after, share of ambiguous and of unfamiliar rows (percent), fitted.

    ``rows`` has y, raw, p (calibrated), ood and fitted."""
    def share(c: Column) -> Column:
        return 100.0 * F.sum(c.cast("int")) / F.count("*")

    def loss(c: str) -> Column:
        return F.avg((F.col(c) - F.col("y")) * (F.col(c) - F.col("y")))

    return rows.groupBy(group).agg(F.count("*").alias("n"), loss("raw").alias("brier_raw"), loss("p").alias("brier_cal"), share(F.col("p").between(low, high)).alias("pct_ambiguous"), share(F.col("ood")).alias("pct_ood"), F.min("fitted").alias("fitted"))


def ood_threshold(distances: DataFrame, keys: list[str], at: float, floor: float) -> DataFrame:
    """(keys, threshold): a percentile of the distances, linear between ranks, but no less than the floor."""
    return distances.groupBy(*keys).agg(F.greatest(F.percentile("distance", F.lit(at)), F.lit(floor)).alias("threshold"))

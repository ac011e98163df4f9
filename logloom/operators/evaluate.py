"""Accuracy of parsed clusters against ground truth, as joins and aggregations.

``truth``: msg_id, template_id, template_tokens.  ``parsed``: msg_id,
cluster_id, template_tokens.  Group accuracy here is the largest-overlap kind:
putting all lines in one cluster scores 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _harmonic(a: Column, b: Column) -> Column:
    return F.when(a + b > 0, 2 * a * b / (a + b)).otherwise(F.lit(0.0))


def _pairs(truth: DataFrame, parsed: DataFrame) -> DataFrame:
    return truth.select("msg_id", "template_id").join(parsed.select("msg_id", "cluster_id"), "msg_id")


def group_scores(truth: DataFrame, parsed: DataFrame) -> DataFrame:
    """One row: group_accuracy, f1_group_accuracy."""
    cells = _pairs(truth, parsed).groupBy("template_id", "cluster_id").agg(F.count(F.lit(1)).alias("both"))
    order = Window.partitionBy("template_id").orderBy(F.desc("both"), "first")
    first = parsed.groupBy("cluster_id").agg(F.min("msg_id").alias("first"), F.count(F.lit(1)).alias("in_cluster"))
    own = truth.groupBy("template_id").agg(F.count(F.lit(1)).alias("in_truth"))
    best = cells.join(first, "cluster_id").withColumn("r", F.row_number().over(order)).filter("r = 1").join(own, "template_id")
    sums = best.agg(
        F.sum("both").alias("hit"), F.sum("in_truth").alias("n"),
        F.avg(F.col("both") / F.col("in_cluster")).alias("precision"), F.avg(F.col("both") / F.col("in_truth")).alias("recall"),
    )
    return sums.select(F.coalesce(F.col("hit") / F.col("n"), F.lit(1.0)).alias("group_accuracy"), F.coalesce(_harmonic(F.col("precision"), F.col("recall")), F.lit(1.0)).alias("f1_group_accuracy"))


def _best_overlap(own: DataFrame, shown: DataFrame) -> DataFrame:
    """(template_id, n, hit): tokens (a) against those (b) of one length, and most positions that agree.

    Two bracketed tokens agree.  Templates that some ``b`` equals are settled by an equality join.  The others
    meet only what they share a token with at some place, through lists by
    length, place and token; the count of lists is the overlap.
    """
    loose = lambda t: F.transform(t, lambda x: F.when(x.startswith("<") & x.endswith(">"), F.lit("<>")).otherwise(x))
    own = own.select("template_id", loose(F.col("a")).alias("a"))
    shown = shown.select(loose(F.col("b")).alias("b")).distinct()
    equal = own.join(shown.withColumnRenamed("b", "a"), "a", "left_semi").select("template_id")
    rest = own.join(equal, "template_id", "left_anti")
    left = rest.select("template_id", F.size("a").alias("n"), F.posexplode("a").alias("pos", "tok"))
    right = shown.select("b", F.size("b").alias("n"), F.posexplode("b").alias("pos", "tok"))
    hits = left.join(right, ["n", "pos", "tok"]).groupBy("template_id", "b").agg(F.count(F.lit(1)).alias("hit")).groupBy("template_id").agg(F.max("hit").alias("hit"))
    known = own.select("template_id", F.size("a").alias("n")).join(equal.withColumn("same", F.lit(True)), "template_id", "left").join(hits, "template_id", "left")
    return known.select("template_id", "n", F.when(F.col("same"), F.col("n")).otherwise(F.coalesce("hit", F.lit(0))).alias("hit"))


def template_scores(truth: DataFrame, parsed: DataFrame) -> DataFrame:
    """One row: template_accuracy, f1_template_accuracy.

    A cluster's template is the first one it showed; each true template is
    compared with those of its length.
    """
    own = truth.groupBy("template_id").agg(F.min_by("template_tokens", "msg_id").alias("a"))
    shown = parsed.groupBy("cluster_id").agg(F.min_by("template_tokens", "msg_id").alias("b")).select("b").distinct()
    best = _best_overlap(own, shown)
    found = F.col("hit") > 0
    sums = best.agg(
        F.count(F.lit(1)).alias("all"), F.sum(F.when(found, F.col("hit"))).alias("hit"), F.sum(F.when(found, F.col("n"))).alias("n"),
        F.avg(F.when(found, F.col("hit") / F.col("n"))).alias("score"),
    )
    empty = F.col("all") == 0
    score = F.coalesce(_harmonic(F.col("score"), F.col("score")), F.lit(0.0))
    return sums.select(F.when(empty, 1.0).otherwise(F.coalesce(F.col("hit") / F.col("n"), F.lit(0.0))).alias("template_accuracy"), F.when(empty, 1.0).otherwise(score).alias("f1_template_accuracy"))


def evaluate(truth: DataFrame, parsed: DataFrame) -> DataFrame:
    """One row with the four scores and three counts (each side is one row)."""
    counts = truth.agg(F.count(F.lit(1)).alias("messages"), F.countDistinct("template_id").alias("templates"))
    found = parsed.agg(F.countDistinct("cluster_id").alias("clusters"))
    out = group_scores(truth, parsed)
    for one_row in (template_scores(truth, parsed), counts, found):
        out = out.join(one_row)
    return out


def evaluate_compact(truth: DataFrame, parsed: DataFrame) -> DataFrame:
    """One row with the four scores by the compact definitions (per message, exact tokens)."""
    met = _pairs(truth, parsed)
    cells = met.groupBy("template_id", "cluster_id").agg(F.count(F.lit(1)).alias("both"))
    t = cells.groupBy("template_id").agg(F.max("both").alias("best"), F.sum("both").alias("n"))
    c = cells.groupBy("cluster_id").agg(F.max("both").alias("best"), F.sum("both").alias("n"))
    groups = t.agg((F.sum("best") / F.sum("n")).alias("ga"), F.avg(F.col("best") / F.col("n")).alias("p")).join(c.agg(F.avg(F.col("best") / F.col("n")).alias("r")))
    own = truth.groupBy("template_id").agg(F.min_by("template_tokens", "msg_id").alias("a"))
    shown = parsed.groupBy("cluster_id").agg(F.min_by("template_tokens", "msg_id").alias("b"))
    equal = F.size(F.filter(F.zip_with("a", "b", lambda x, y: F.coalesce(x == y, F.lit(False))), lambda x: x))
    tokens = cells.join(own, "template_id").join(shown, "cluster_id")
    sums = tokens.agg(
        F.sum(F.col("both") * equal).alias("hit"), F.sum(F.col("both") * F.greatest(F.size("a"), F.size("b"))).alias("longest"),
        F.sum(F.col("both") * F.size("b")).alias("nb"), F.sum(F.col("both") * F.size("a")).alias("na"),
    )
    return groups.join(sums).select(
        F.coalesce("ga", F.lit(1.0)).alias("group_accuracy"),
        F.coalesce(_harmonic(F.col("p"), F.col("r")), F.lit(1.0)).alias("f1_group_accuracy"),
        F.coalesce(F.col("hit") / F.col("longest"), F.lit(1.0)).alias("template_accuracy"),
        F.when(F.col("hit").isNull(), 1.0).otherwise(_harmonic(F.col("hit") / F.col("nb"), F.col("hit") / F.col("na"))).alias("f1_template_accuracy"),
    )


SCORES = ("group_accuracy", "f1_group_accuracy", "template_accuracy", "f1_template_accuracy")


def macro(runs: DataFrame) -> DataFrame:
    """One row: the plain averages of the four scores over runs (one row a data set) and their number."""
    return runs.agg(*[F.avg(c).alias(c) for c in SCORES], F.count(F.lit(1)).alias("data_sets"))

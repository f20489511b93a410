"""Bootstrap intervals and rank tests as joins of rows with replicates, without shared random state.

How often a replicate draws a unit is a Poisson(1) number from a digest of the replicate and the
unit. A retried task draws the same, rows of one unit are drawn together wherever they lie, and
both sides of a difference see one draw. Rows meet their replicates in a generator, and are
summed to levels of equal score before they are exchanged.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.aggregates import totals_before
from tidemark.operators.evaluation import average_rank

#: P(Poisson(1) <= k) for k from 0.
POISSON_STEPS = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.999916758850712)


def weight_of(seed: int, replicate: Column, *unit: Column) -> Column:
    """How often a replicate draws a unit."""
    name = F.concat_ws("|", F.lit(str(seed)), replicate.cast("string"), *(u.cast("string") for u in unit))
    share = F.conv(F.substring(F.md5(name.cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return sum(((share >= s).cast("int") for s in POISSON_STEPS), F.lit(0))


def drawn(df: DataFrame, unit: Sequence[str], replicates: int, seed: int) -> DataFrame:
    """Each row once for every replicate that draws its unit, with the number of times as `weight`."""
    rows = df.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    return rows.withColumn("weight", weight_of(seed, F.col("replicate"), *(F.col(u) for u in unit))).where("weight > 0")


def interval(each: DataFrame, value: str) -> DataFrame:
    """One row: how many replicates gave a value, and their 2.5 and 97.5 per cent limits."""
    return each.agg(F.count(value).alias("n_replicates"), F.percentile(value, 0.025).alias("low"), F.percentile(value, 0.975).alias("high"))


def _share(total: Column) -> Column:
    return F.nullif(total.cast("double"), F.lit(0.0))


def bootstrap_precision(df: DataFrame, flag: str, label: str, cluster: str, replicates: int = 200, seed: int = 0) -> DataFrame:
    """Limits of a flag's precision over clusters drawn with replacement. Clusters are summed before they are multiplied out."""
    sums = df.where(F.col(flag)).groupBy(cluster).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("h"))
    each = drawn(sums, [cluster], replicates, seed).groupBy("replicate").agg((F.sum(F.col("h") * F.col("weight")) / _share(F.sum(F.col("n") * F.col("weight")))).alias("p"))
    return interval(each, "p")


def weighted_auc(rows: DataFrame, score: str, label: str, keys: Sequence[str]) -> DataFrame:
    """(keys, auc): area under the ROC curve of weighted rows, ties counting half; null without both classes."""
    y = F.col(label).cast("double")
    levels = rows.where(F.col(score).isNotNull() & y.isNotNull()).groupBy(*keys, score).agg(F.sum(F.col("weight") * y).alias("__p"), F.sum(F.col("weight") * (1 - y)).alias("__n"))
    below = totals_before(levels, [score], {"__below": F.col("__n")}, keys)
    both = F.sum("__p") * F.sum("__n")
    return below.groupBy(*keys).agg((F.sum(F.col("__p") * (F.col("__below") + F.col("__n") / 2)) / F.nullif(both, F.lit(0.0))).alias("auc"))


def bootstrap_auc(df: DataFrame, score: str, label: str, unit: Sequence[str], replicates: int = 200, seed: int = 0) -> DataFrame:
    """Limits of the AUC. Units are drawn within their class: the label belongs to what is drawn."""
    return interval(weighted_auc(drawn(df, [*unit, label], replicates, seed), score, label, ["replicate"]), "auc")


def bootstrap_auc_difference(df: DataFrame, score_a: str, score_b: str, label: str, unit: Sequence[str], replicates: int = 200, seed: int = 0) -> DataFrame:
    """Limits of AUC(a) - AUC(b), both over the same draws."""
    rows = drawn(df.where(F.col(score_a).isNotNull() & F.col(score_b).isNotNull()), [*unit, label], replicates, seed)
    a, b = (weighted_auc(rows, s, label, ["replicate"]).withColumnRenamed("auc", n) for s, n in ((score_a, "a"), (score_b, "b")))
    return interval(a.join(b, "replicate").withColumn("difference", F.col("a") - F.col("b")), "difference")


def hits_within(rows: DataFrame, score: str, label: str, keys: Sequence[str], room: Column) -> DataFrame:
    """(keys, hits, slots): weighted hits among the first `room` by score, a level that the cut parts counting in proportion.

    room is an expression over columns that are equal for all rows of a key.
    """
    levels = rows.groupBy(*keys, score).agg(F.sum("weight").alias("__w"), F.sum(F.col("weight") * F.col(label).cast("long")).alias("__h"), F.max(room).alias("__room"))
    ranked = totals_before(levels, [F.desc(score)], {"__before": F.col("__w")}, keys)
    left = F.col("__room") - F.col("__before")
    taken = F.when(left <= 0, 0.0).when(left >= F.col("__w"), F.col("__h").cast("double")).otherwise(left * F.col("__h") / F.col("__w"))
    return ranked.groupBy(*keys).agg(F.sum(taken).alias("hits"), F.least(F.max("__room"), F.sum("__w")).cast("double").alias("slots"))


def pooled_difference(df: DataFrame, cutoff: str, cluster: str, score_a: str, score_b: str, label: str, k: int, replicates: int = 200, seed: int = 0) -> DataFrame:
    """One row: pooled precision of the k best of every cutoff by score a, less that by score b, and its limits.

    Clusters (a vessel with all of its rows in every cutoff) are drawn; precision is hits over
    places of all cutoffs together. Replicate 0 is the table as it is.
    """
    point = df.withColumns({"replicate": F.lit(0), "weight": F.lit(1)})
    rows = point.unionByName(drawn(df, [cluster], replicates, seed))
    keys = ["replicate", cutoff]
    sides = []
    for s, n in ((score_a, "a"), (score_b, "b")):
        each = hits_within(rows, s, label, keys, F.lit(k)).groupBy("replicate").agg((F.sum("hits") / _share(F.sum("slots"))).alias(n))
        sides.append(each)
    each = sides[0].join(sides[1], "replicate").withColumn("difference", F.col("a") - F.col("b"))
    at = F.when(F.col("replicate") == 0, F.col("difference"))
    other = F.when(F.col("replicate") > 0, F.col("difference"))
    return each.agg(F.max(at).alias("point"), F.count(other).alias("n_replicates"), F.percentile(other, 0.025).alias("low"), F.percentile(other, 0.975).alias("high"))


def rule_difference(df: DataFrame, score: str, rule: str, label: str, unit: Sequence[str], replicates: int = 200, seed: int = 0) -> DataFrame:
    """Limits of the precision of a score, cut to as many rows as the rule flags, less that of the rule itself."""
    rows = drawn(df, unit, replicates, seed)
    flagged = rows.where(F.col(rule)).groupBy("replicate").agg(F.sum("weight").alias("__k"), F.sum(F.col("weight") * F.col(label).cast("long")).alias("__r"))
    hits = hits_within(rows.join(flagged, "replicate"), score, label, ["replicate"], F.col("__k"))
    each = hits.join(flagged, "replicate").withColumn("difference", F.col("hits") / F.col("slots") - F.col("__r") / F.col("__k"))
    return interval(each, "difference")


def melted(df: DataFrame, features: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """A row for each feature of a row: feature, value, and the columns named."""
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features)))
    return df.select(*columns, each.alias("__f")).select(*columns, "__f.*").where("value is not null")


def rank_tests(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """A row for each feature: sizes, Mann-Whitney U of the positive rows, AUC, and the z of its tie-corrected normal approximation.

    z has the continuity correction; it is null where all values are equal or a class is missing.
    """
    rows = melted(df, features, [label]).where(F.col(label).isNotNull())
    ranked = average_rank(rows, "value", ["feature"])
    y = F.col(label).cast("int") == 1
    sums = ranked.groupBy("feature").agg(F.count_if(y).alias("n_positive"), F.count_if(~y).alias("n_negative"), F.sum(F.when(y, F.col("avg_rank"))).alias("__r"))
    ties = rows.groupBy("feature", "value").agg(F.count("*").cast("double").alias("t")).groupBy("feature").agg(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("__ties"))
    p, q = F.col("n_positive").cast("double"), F.col("n_negative").cast("double")
    n = p + q
    u = F.col("__r") - p * (p + 1) / 2
    variance = p * q / 12 * (n + 1 - F.col("__ties") / F.nullif(n * (n - 1), F.lit(0.0)))
    away = u - p * q / 2
    z = F.signum(away) * F.greatest(F.abs(away) - 0.5, F.lit(0.0)) / F.nullif(F.sqrt(variance), F.lit(0.0))
    return sums.join(ties, "feature").select("feature", "n_positive", "n_negative", u.alias("u"), (u / F.nullif(p * q, F.lit(0.0))).alias("auc"), z.alias("z"))


def feature_verdicts(df: DataFrame, features: Sequence[str], label: str, unit: Sequence[str], least: int = 20, replicates: int = 200, seed: int = 0) -> DataFrame:
    """`rank_tests` with limits of each AUC and a verdict: which way a feature tells the classes apart, if the limits leave out one half."""
    rows = melted(df, features, [*unit, label]).where(F.col(label).isNotNull())
    each = weighted_auc(drawn(rows, [*unit, label], replicates, seed), "value", label, ["feature", "replicate"])
    limits = each.groupBy("feature").agg(F.percentile("auc", 0.025).alias("low"), F.percentile("auc", 0.975).alias("high"))
    few = F.least("n_positive", "n_negative") < least
    verdict = F.when(few, "insufficient_data").when(F.col("low") > 0.5, "discriminates_as_expected").when(F.col("high") < 0.5, "discriminates_opposite").otherwise("no_discrimination")
    return rank_tests(df, features, label).join(limits, "feature", "left").withColumn("verdict", verdict)


def one_window(df: DataFrame, columns: Sequence[str], population: Column) -> tuple[DataFrame, tuple]:
    """The rows of the population and the one window that they are of; an error if they are of several or none."""
    kept = df.where(population)
    windows = kept.select(*columns).distinct().limit(2).collect()
    if len(windows) != 1:
        raise ValueError(f"rows of one window are wanted, these are of {'several' if windows else 'none'}")
    return kept, tuple(windows[0])


def coverage_gates(df: DataFrame, values: Sequence[str], label: str, least_share: float = 0.5, most_gap: float = 0.1) -> DataFrame:
    """For each value column: the share of rows of either class that have it, and whether both shares and their difference pass."""
    y = F.col(label).cast("int") == 1
    rows = df.where(F.col(label).isNotNull()).select(y.alias("__y"), F.explode(F.array(*(F.struct(F.lit(v).alias("value"), F.col(v).isNotNull().cast("int").alias("has")) for v in values))).alias("__f"))
    out = rows.groupBy(F.col("__f.value").alias("value")).agg(F.avg(F.when(F.col("__y"), F.col("__f.has"))).alias("positive_share"), F.avg(F.when(~F.col("__y"), F.col("__f.has"))).alias("negative_share"))
    fine = (F.least("positive_share", "negative_share") >= least_share) & (F.abs(F.col("positive_share") - F.col("negative_share")) <= most_gap)
    return out.withColumn("passes", F.coalesce(fine, F.lit(False)))

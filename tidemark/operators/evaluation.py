"""Rank-based evaluation with ties handled exactly."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.functions.columns import is_foc
from tidemark.operators.aggregates import global_rank, totals_before
from tidemark.storage import written


def score_levels(df: DataFrame, score: str, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """Distinct scores, highest first: rows and hits on each and above it. Ties collapse into one row per level first."""
    levels = df.groupBy(*keys, score).agg(F.count("*").alias("w"), F.sum(F.col(label).cast("long")).alias("h"))
    return totals_before(levels, [F.desc(score)], {"before_w": F.col("w"), "before_h": F.coalesce("h", F.lit(0))}, keys)


def average_rank(df: DataFrame, score: str, keys: Sequence[str] = (), name: str = "avg_rank") -> DataFrame:
    """Ascending rank of each row's score, the mean of the ranks that its ties take."""
    levels = df.groupBy(*keys, score).agg(F.count("*").alias("__w"))
    below = totals_before(levels, [score], {"__below": F.col("__w")}, keys)
    ranks = below.select(*keys, score, (F.col("__below") + (F.col("__w") + 1) / 2).alias(name))
    return df.join(ranks, [*keys, score])


def auc(df: DataFrame, score: str, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve by average ranks; null without both classes."""
    ranked = average_rank(df.where(F.col(score).isNotNull() & F.col(label).isNotNull()), score, keys)
    out = ranked.groupBy(*keys).agg(F.sum(F.col(label).cast("double")).alias("p"), F.count("*").cast("double").alias("n"), F.sum(F.when(F.col(label).cast("int") == 1, F.col("avg_rank"))).alias("r"))
    q = F.col("n") - F.col("p")
    return out.select(*keys, F.col("p").cast("long").alias("n_positive"), q.cast("long").alias("n_negative"), ((F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / F.nullif(F.col("p") * q, F.lit(0.0))).alias("auc"))


def precision_at(df: DataFrame, score: str, label: str, tie: str, k: int) -> DataFrame:
    """Precision among the first k by score, ties by the tie column, and how many rows share the score at the cut."""
    top = df.orderBy(F.desc(score), tie).limit(k)
    cut = top.agg(F.min(score).alias("cut"), F.avg(F.col(label).cast("double")).alias("precision_at_k"), F.count("*").alias("k"))
    return df.join(F.broadcast(cut), F.col(score) == F.col("cut")).groupBy("k", "precision_at_k").agg(F.count("*").alias("n_tied_at_cutoff"))


def expected_hits_at(df: DataFrame, score: str, label: str, k: int, keys: Sequence[str] = ()) -> DataFrame:
    """Expected hits among the first k when ties are broken at random: whole levels, and a share of the one that the cut parts."""
    rows = score_levels(df, score, label, keys)
    room = F.lit(k) - F.col("before_w")
    share = F.when(room <= 0, 0.0).when(room >= F.col("w"), F.col("h").cast("double")).otherwise(room * F.col("h") / F.col("w"))
    out = rows.groupBy(*keys).agg(F.sum(share).alias("expected_hits"), F.least(F.lit(k), F.sum("w")).cast("long").alias("k"))
    return out.withColumn("expected_precision", F.col("expected_hits") / F.col("k"))


def pooled_precision(df: DataFrame, cutoff: str, score: str, label: str, k: int) -> DataFrame:
    """Precision over all cutoffs together, each with its own k best; and the ceiling, if every hit came first."""
    each = expected_hits_at(df, score, label, k, [cutoff]).join(df.groupBy(cutoff).agg(F.sum(F.col(label).cast("long")).alias("__p")), cutoff)
    total = F.sum("k").cast("double")
    return each.agg(F.count("*").alias("n_cutoffs"), F.sum("k").alias("k_total"), (F.sum("expected_hits") / total).alias("pooled_precision"), (F.sum(F.least("__p", "k")) / total).alias("ceiling"))


def rule_report(df: DataFrame, rule: str, label: str) -> DataFrame:
    """Confusion counts, precision, recall and lift of a boolean rule; null where nothing divides."""
    r, y = F.col(rule).cast("boolean"), F.col(label).cast("int") == 1
    c = df.agg(F.count_if(r & y).alias("tp"), F.count_if(r & ~y).alias("fp"), F.count_if(~r & y).alias("fn"), F.count_if(~r & ~y).alias("tn"))
    d = lambda a, b: a / F.nullif(b.cast("double"), F.lit(0.0))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.withColumns({"precision": d(tp, tp + fp), "recall": d(tp, tp + fn), "lift": d(d(tp, tp + fp), d(tp + fn, tp + fp + fn + tn))})


def log_binomial(n: np.ndarray | int, k: np.ndarray) -> np.ndarray:
    return np.vectorize(math.lgamma, otypes=[float])(np.asarray(n, float) + 1) - np.vectorize(math.lgamma, otypes=[float])(k + 1.0) - np.vectorize(math.lgamma, otypes=[float])(n - k + 1.0)


def fisher_two_sided(tp: int, fp: int, fn: int, tn: int, block: int = 4096) -> float:
    """Fisher's exact test: the probability, with the margins given, of a table no likelier than this one.

    Terms are hypergeometric, from log factorials. They rise to one peak and fall, so both tails are
    summed from where they begin outwards, a block at a time until nothing is added.
    """
    row, column, n = tp + fp, tp + fn, tp + fp + fn + tn
    low, high = max(0, row + column - n), min(row, column)
    whole = float(log_binomial(n, np.array([column]))[0])
    log_p = lambda k: log_binomial(row, k) + log_binomial(n - row, column - k) - whole
    limit = float(log_p(np.array([tp]))[0]) + 1e-7
    peak = (row + 1) * (column + 1) // (n + 2)

    def tail(first: int, last: int, step: int) -> float:
        """From the term nearest the peak that is no likelier than the table, found by halving, out to the end."""
        near, far = first, last
        if (last - first) * step < 0 or float(log_p(np.array([last]))[0]) > limit:
            return 0.0
        while near != far:
            middle = near + step * (abs(far - near) // 2)
            near, far = (near, middle) if float(log_p(np.array([middle]))[0]) <= limit else (middle + step, far)
        total = 0.0
        for start in range(near, last + step, step * block):
            k = np.arange(start, start + step * min(block, abs(last - start) + 1), step)
            more = float(np.exp(log_p(k)).sum())
            total += more
            if more <= total * 1e-17:
                break
        return total

    peak = min(max(peak, low), high)
    return min(1.0, tail(peak, low, -1) + tail(peak + 1, high, 1))


def rule_reports(df: DataFrame, rules: Sequence[str], label: str, tie: str, k: int = 20) -> DataFrame:
    """A row for each boolean rule: what it flags, its hits, precision, recall, lift, AUC, Fisher's two-sided p, precision among the first k, and a verdict.

    The first k are by rule, then by the tie column; n_ties_at_cut tells how many rows share the
    rule's value at that cut, none where there are fewer than k rows. A rule that is null in every
    row is blocked, and has a verdict only; else its nulls don't flag. Figures that nothing divides
    are null.
    """
    yes = F.coalesce(F.col(label).cast("int") == 1, F.lit(False))
    fired = {r: F.coalesce(F.col(r).cast("boolean"), F.lit(False)) for r in rules}
    counts = df.agg(F.count("*").alias("n"), F.count_if(yes).alias("p"), *(c.alias(f"{kind}{i}") for i, r in enumerate(rules) for kind, c in (("known", F.count(r)), ("tp", F.count_if(fired[r] & yes)), ("flagged", F.count_if(fired[r])))))
    each = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), *(F.col(f"{kind}{i}").alias(kind) for kind in ("known", "tp", "flagged"))) for i, r in enumerate(rules))))
    c = counts.select("n", "p", each.alias("e")).select("n", "p", "e.*")
    d = lambda a, b: a / F.nullif(b.cast("double"), F.lit(0.0))
    first = None
    for r in rules:
        top = df.select(fired[r].alias("fired"), yes.cast("double").alias("y"), F.col(tie).alias("tie")).orderBy(F.desc("fired"), "tie").limit(k)
        found = top.agg(F.count("*").alias("m"), F.avg("y").alias("precision_at_k"), F.bool_and("fired").alias("all_fired")).select(F.lit(r).alias("rule"), "m", "precision_at_k", "all_fired")
        first = found if first is None else first.unionByName(found)

    @F.pandas_udf("double")
    def fisher(tp: pd.Series, fp: pd.Series, fn: pd.Series, tn: pd.Series) -> pd.Series:
        return pd.Series([fisher_two_sided(*map(int, x)) for x in zip(tp, fp, fn, tn)], dtype=float)

    tp, fp, fn = F.col("tp"), F.col("flagged") - F.col("tp"), F.col("p") - F.col("tp")
    tn = F.col("n") - F.col("flagged") - fn
    figures = {
        "n_flagged": F.col("flagged"), "tp": tp, "fp": fp, "precision": d(tp, tp + fp), "recall": d(tp, tp + fn), "lift": d(d(tp, tp + fp), d(tp + fn, F.col("n"))),
        "auc": (d(tp, tp + fn) + d(tn, fp + tn)) / 2, "fisher_p": fisher(tp, fp, fn, tn), "precision_at_k": F.when(F.col("m") >= k, F.col("precision_at_k")),
        "n_ties_at_cut": F.when(F.col("m") < k, 0).when(F.col("all_fired"), F.col("flagged")).otherwise(F.col("n") - F.col("flagged")),
    }
    known = F.col("known") > 0
    return c.join(first, "rule").select("rule", *(F.when(known, v).alias(name) for name, v in figures.items()), F.when(known, "evaluated").otherwise("blocked_by_gate").alias("verdict"))


def tanker_rules(df: DataFrame, ship_type: str, flag: str, window_end: str, build_year: str | None, age_years: int = 15) -> DataFrame:
    """df with the rules r1 (a tanker), r2 (and under a flag of convenience) and r3 (and built over age_years before the window's end).

    Unknown types, flags and years don't fire. Without a source of build years that its gate lets
    pass, build_year is None and r3 null in every row.
    """
    r1 = F.coalesce(F.col(ship_type) == "Tanker", F.lit(False))
    r2 = r1 & is_foc(F.col(flag))
    r3 = F.lit(None).cast("boolean") if build_year is None else r2 & F.coalesce(F.year(window_end) - F.col(build_year) > age_years, F.lit(False))
    return df.withColumns({"r1": r1, "r2": r2, "r3": r3})


def matched_groups(df: DataFrame, tile: str, group: str, label: str) -> DataFrame:
    """Strata of tile and group that hold both classes, with the counts of each."""
    both = df.groupBy(tile, group).agg(F.count_if(F.col(label) == 1).alias("n_positive"), F.count_if(F.col(label) == 0).alias("n_negative"))
    return both.where("n_positive > 0 and n_negative > 0")


def retrieval_rank(df: DataFrame, id_col: str, vector: str, label: str, block: int = 256) -> DataFrame:
    """For each query (the smallest id of a label), the rank by cosine of the label's next id among the second ids of all labels.

    Queries and candidates, one of each a label, are packed in blocks of `block` vectors; a pair of
    blocks is one matrix product, of which a count per query is left.
    """
    rank = F.row_number().over(Window.partitionBy(label).orderBy(id_col))
    rows = df.where(F.col(vector).isNotNull()).withColumn("__n", rank).where("__n <= 2")
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    rows = rows.withColumn("__u", F.transform(vector, lambda x: x.cast("double") / norm))
    q = rows.where("__n = 1").select(F.col(label).alias("label"), F.col(id_col).alias("query_id"), F.col("__u").alias("__q"))
    c = rows.where("__n = 2").select(F.col(label).alias("label"), F.col("__u").alias("__c"))
    cosine = F.aggregate(F.zip_with("__q", "__c", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    asked = written(global_rank(q.join(c, "label").select("label", "query_id", "__q", "__c", cosine.alias("own")), ["label"], "__i"), "queries")
    blocks = -(-asked.count() // block)
    packed = asked.groupBy(F.floor((F.col("__i") - 1) / block).alias("b"))  # at most `block` rows a group
    left = packed.agg(F.collect_list(F.struct("label", "query_id", "own", F.col("__q").alias("u"))).alias("queries"))
    right = packed.agg(F.collect_list(F.struct("label", F.col("__c").alias("u"))).alias("candidates")).withColumnRenamed("b", "a")
    met = left.withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(max(blocks - 1, 0))))).repartition("a", "b").join(right, "a")

    def count(batches):
        for batch in batches:
            for queries, candidates in zip(batch.column("queries").to_pylist(), batch.column("candidates").to_pylist()):
                scores = np.array([x["u"] for x in queries]) @ np.array([x["u"] for x in candidates]).T
                other = np.array([x["label"] for x in queries])[:, None] != np.array([x["label"] for x in candidates])
                better = ((scores > np.array([x["own"] for x in queries])[:, None]) & other).sum(1)
                yield pa.RecordBatch.from_pylist([{"query_label": x["label"], "query_id": x["query_id"], "better": int(n), "own": x["own"]} for x, n in zip(queries, better)], schema=out)

    kinds = {k: asked.schema[n].dataType for k, n in (("query_label", "label"), ("query_id", "query_id"))}
    schema = T.StructType([*(T.StructField(k, t) for k, t in kinds.items()), T.StructField("better", T.LongType()), T.StructField("own", T.DoubleType())])
    out = to_arrow_schema(schema)
    counted = met.select("queries", "candidates").mapInArrow(count, schema)
    return counted.groupBy("query_label", "query_id").agg((F.sum("better") + 1).alias("rank"), F.round(F.max("own"), 6).alias("own_cosine"))

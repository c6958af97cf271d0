"""Classification metrics as grouped aggregations over (gold, predicted) columns.

How a missing prediction counts is stated by a policy: ``as_none`` reads it as the label none,
``as_error`` keeps it as a class of its own (wrong, no miss, a false alarm), ``drop`` leaves the
row out. Ratios with an empty denominator are null where they describe rates, 0 for precision,
recall and F1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..runtime import cut
from . import stats
from .taxonomy import EPOCHS, rank

MALFORMED = "PARSE_ERROR"
FPR_ALERT = 0.30
MIN_GOLD = 5


def ratio(a: Column, b: Column, places: int = 6) -> Column:
    return F.round(F.try_divide(a.cast("double"), b.cast("double")), places)


def ratio0(a: Column, b: Column, places: int = 6) -> Column:
    return F.coalesce(ratio(a, b, places), F.lit(0.0))


def with_policy(df: DataFrame, policy: str = "as_none", pred: str = "pred_label") -> DataFrame:
    """``df`` with missing and unparsable predictions treated by the policy."""
    bad = F.col(pred).isNull() | (F.col(pred) == MALFORMED)
    if policy == "drop":
        return df.where(~bad)
    return df.withColumn(pred, F.when(bad, "none" if policy == "as_none" else MALFORMED).otherwise(F.col(pred)))


def confusion(df: DataFrame, labels: list[str], by: list[str], gold: str = "gold_label", pred: str = "pred_label") -> DataFrame:
    """Counts of gold by predicted, a column per label; rows outside the labels are left out."""
    kept = df.where(F.col(gold).isin(labels) & F.col(pred).isin(labels))
    return kept.groupBy(*by, gold).pivot(pred, labels).count().na.fill(0, labels)


def binary_cells(df: DataFrame, by: list[str], gold: Column, pred: Column) -> DataFrame:
    """tp, fp, fn, tn of two boolean columns."""
    return df.groupBy(*by).agg(F.count_if(gold & pred).alias("tp"), F.count_if(~gold & pred).alias("fp"), F.count_if(gold & ~pred).alias("fn"), F.count_if(~gold & ~pred).alias("tn"))


def relevance(df: DataFrame, by: list[str], gold: str = "gold_label", pred: str = "pred_label") -> DataFrame:
    return binary_cells(df, by, ~F.col(gold).eqNullSafe("none"), ~F.col(pred).eqNullSafe("none"))


def scores(cells: DataFrame) -> DataFrame:
    """Accuracy, precision, recall, F1, miss and false-alarm rates from tp, fp, fn, tn."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return cells.withColumns(
        {
            "accuracy": ratio(tp + tn, tp + fp + fn + tn),
            "precision": ratio0(tp, tp + fp),
            "recall": ratio0(tp, tp + fn),
            "f1": ratio0(2 * tp, 2 * tp + fp + fn),
            "fnr": ratio(fn, tp + fn),
            "fpr": ratio(fp, fp + tn),
        }
    )


def label_f1(df: DataFrame, by: list[str], gold: str = "gold_label", pred: str = "pred_label") -> DataFrame:
    """tp, n_gold, n_pred, precision, recall and F1 of each label, by one pass: every row counts
    once for its gold label and once for its predicted one."""
    sides = F.array(F.struct(F.col(gold).alias("label"), F.lit(1).alias("g"), F.lit(0).alias("p")), F.struct(F.col(pred).alias("label"), F.lit(0).alias("g"), F.lit(1).alias("p")))
    hit = F.col(gold).eqNullSafe(F.col(pred)).cast("int")
    out = df.select(*by, hit.alias("hit"), F.explode(sides).alias("s")).where("s.label is not null")
    out = out.groupBy(*by, F.col("s.label").alias("label")).agg(F.sum(F.col("hit") * F.col("s.g")).alias("tp"), F.sum("s.g").alias("n_gold"), F.sum("s.p").alias("n_pred"))
    return out.withColumns({"precision": ratio0(F.col("tp"), F.col("n_pred")), "recall": ratio0(F.col("tp"), F.col("n_gold")), "f1": ratio0(2 * F.col("tp"), F.col("n_gold") + F.col("n_pred"))})


def rich_labels(df: DataFrame, by: list[str], least: int = MIN_GOLD, gold: str = "gold_label") -> DataFrame:
    """``(by, label)``: labels with at least ``least`` gold rows."""
    return df.groupBy(*by, F.col(gold).alias(gold)).count().where(F.col("count") >= least).where(F.col(gold).isNotNull()).drop("count")


def _averaged(labels: DataFrame, by: list[str]) -> DataFrame:
    f1 = F.coalesce(F.try_divide((2 * F.col("tp")).cast("double"), (F.col("n_gold") + F.col("n_pred")).cast("double")), F.lit(0.0))
    return labels.groupBy(*by).agg(F.round(F.avg(f1), 6).alias("macro_f1"), F.count("*").alias("n_labels"))


def macro_f1_rich(df: DataFrame, by: list[str], least: int = MIN_GOLD, gold: str = "gold_label", pred: str = "pred_label") -> DataFrame:
    """Rows of rich gold labels only; F1 averaged over the labels that are gold or predicted there."""
    kept = df.join(F.broadcast(rich_labels(df, by, least, gold)), [*by, gold])
    return _averaged(label_f1(kept, by, gold, pred), by)


def macro_f1(df: DataFrame, by: list[str], gold: str = "gold_label", pred: str = "pred_label") -> DataFrame:
    return _averaged(label_f1(df, by, gold, pred), by)


def miss_rates(df: DataFrame, epochs: DataFrame, epoch: str = "epoch", by: list[str] | None = None) -> DataFrame:
    """Per period: relevant gold rows, misses without and with malformed predictions counted as
    none, and both rates; ``by`` group. Periods without rows come out with null rates."""
    by = by or []
    rel, bad, none = F.col("gold_label") != "none", F.col("pred_label").isNull(), F.col("pred_label") == "none"
    got = df.groupBy(*by, epoch).agg(F.count_if(rel).alias("n_relevant"), F.count_if(rel & F.coalesce(none, F.lit(False))).alias("n_missed"), F.count_if(rel & (F.coalesce(none, F.lit(False)) | bad)).alias("n_missed_as_none"))
    every = df.select(*by).distinct().crossJoin(F.broadcast(epochs)) if by else epochs
    out = every.join(got, [*by, epoch], "left").na.fill(0, ["n_relevant", "n_missed", "n_missed_as_none"])
    return out.withColumns({"fnr": ratio(F.col("n_missed"), F.col("n_relevant")), "fnr_as_none": ratio(F.col("n_missed_as_none"), F.col("n_relevant"))})


def false_alarm_rates(df: DataFrame, by: list[str]) -> DataFrame:
    """None-gold rows, those with a label and those malformed, and the rate of both together."""
    none, bad = F.col("gold_label") == "none", F.col("pred_label").isNull()
    got = df.groupBy(*by).agg(F.count_if(none).alias("n_none"), F.count_if(none & ~bad & (F.col("pred_label") != "none")).alias("n_label"), F.count_if(none & bad).alias("n_malformed"))
    return got.withColumn("fpr", ratio(F.col("n_label") + F.col("n_malformed"), F.col("n_none")))


def collapse_alert(df: DataFrame, by: list[str], limit: float = FPR_ALERT) -> DataFrame:
    return false_alarm_rates(df, by).select(*by, "fpr", F.coalesce(F.col("fpr") > limit, F.lit(False)).alias("alert"))


def predicted_distribution(df: DataFrame, by: list[str], pred: str = "pred_label") -> DataFrame:
    return df.groupBy(*by, F.coalesce(F.col(pred), F.lit(MALFORMED)).alias("label")).agg(F.count("*").alias("n"))


def frequencies(df: DataFrame, column: str) -> DataFrame:
    """``(column, n, share)``; nulls are left out."""
    c = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    return c.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy(F.lit(1))), 6))


def crosstab(df: DataFrame, rows: str, row_values: DataFrame, columns: str, values: list[str]) -> DataFrame:
    """Counts in a fixed order of rows and columns, 0 where nothing is."""
    return row_values.join(df.groupBy(rows).pivot(columns, values).count(), rows, "left").na.fill(0, values)


def majority_baseline(df: DataFrame, column: str) -> DataFrame:
    """Share of the largest class, chance by class, number of classes."""
    c = df.where(F.col(column).isNotNull()).groupBy(column).count()
    return c.agg(ratio(F.max("count"), F.sum("count")).alias("majority"), ratio(F.lit(1), F.count("*")).alias("chance"), F.count("*").alias("n_classes"))


def suite(df: DataFrame, gold: str = "gold_label", pred: str = "pred_label", epoch: str = "epoch") -> DataFrame:
    """One row for each model with all its figures: accuracy, binary precision, recall, F1, kappa and
    error rates, macro F1 over rich labels, drift of F1 over the periods (difference, least squares
    and rank correlation with their p, from F1 at three places) and drift of the miss rate.

    The rows are read once, for the counts of their cells (model, period, gold, predicted); all
    figures come from these counts.
    """
    c = cut(df.groupBy("model", F.col(epoch).alias("epoch"), F.col(gold).alias("gold"), F.col(pred).alias("pred")).agg(F.count("*").alias("k")))
    g, p, k = ~F.col("gold").eqNullSafe("none"), ~F.col("pred").eqNullSafe("none"), F.col("k")
    sums = [F.sum(F.when(x, k).otherwise(0)).alias(n) for n, x in (("tp", g & p), ("fp", ~g & p), ("fn", g & ~p), ("tn", ~g & ~p))]
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    chance = ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)).cast("double") / (n * n)
    same = F.sum(F.when(F.col("gold").eqNullSafe(F.col("pred")), k).otherwise(0))
    hits = c.groupBy("model").agg(ratio(same, F.sum("k")).alias("accuracy_labels"))
    whole = scores(c.groupBy("model").agg(*sums)).withColumn("n", n).withColumn("kappa", F.round(F.try_divide((tp + tn) / n - chance, 1 - chance), 6)).drop("tp", "fp", "fn", "tn")
    rich = c.groupBy("model", "gold").agg(F.sum("k").alias("_n")).where(F.col("gold").isNotNull() & (F.col("_n") >= MIN_GOLD)).drop("_n")
    sides = F.array(F.struct(F.col("gold").alias("label"), k.alias("g"), F.lit(0).alias("p")), F.struct(F.col("pred").alias("label"), F.lit(0).alias("g"), k.alias("p")))
    labels = c.join(F.broadcast(rich), ["model", "gold"]).select("model", (F.col("gold").eqNullSafe(F.col("pred"))).alias("same"), F.explode(sides).alias("s")).where("s.label is not null")
    labels = labels.groupBy("model", "s.label").agg(F.sum(F.when(F.col("same"), F.col("s.g")).otherwise(0)).alias("tp"), F.sum("s.g").alias("n_gold"), F.sum("s.p").alias("n_pred"))
    series = cut(scores(c.where("epoch is not null").groupBy("model", "epoch").agg(*sums)).select("model", "epoch", F.round("f1", 3).alias("f1"), "fnr", rank(EPOCHS, F.col("epoch")).alias("x")).where("x is not null"))
    at = lambda e: F.max(F.when(F.col("epoch") == e, F.col("fnr")))
    missed = series.groupBy("model").agg(F.round(at(EPOCHS[0]) - at(EPOCHS[-1]), 6).alias("fnr_drift"))
    out = whole
    for part in (hits, _averaged(labels, ["model"]), stats.drift(series, ["model"], "x", "f1"), stats.spearman(series, ["model"], "x", "f1").drop("n_points"), missed):
        out = out.join(F.broadcast(part), "model", "left")
    return out

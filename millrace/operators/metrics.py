"""Scores of predictions: classification, ranking, regression, doses, aggregates.

All come from counts by (group, truth, prediction) or by distinct score, which are pre-aggregated
in the partitions; no rows of single predictions are gathered.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.numeric import softmax, top_k
from millrace.operators.relational import median, running_sums

MISSING = "__NO_PREDICTION__"


def ratio(a: Column, b: Column) -> Column:
    """0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def f1(p: Column, r: Column) -> Column:
    return ratio(2 * p * r, p + r)


def accuracy(truth: Column, prediction: Column) -> Column:
    return F.avg(F.coalesce(truth == prediction, F.lit(False)).cast("double"))


def top_k_accuracy(logits: Column, truth: Column, k: int = 3) -> Column:
    return F.avg(F.array_contains(top_k(logits, k), truth.cast("int")).cast("double"))


def confidence(df: DataFrame, logits: str, truth: str) -> DataFrame:
    """accuracy, confidence (mean largest probability) and calibration (their distance)."""
    rows = df.select(F.array_max(softmax(F.col(logits))).alias("c"), (F.get(top_k(F.col(logits), 1), F.lit(0)) == F.col(truth)).cast("double").alias("hit"))
    out = rows.agg(F.avg("hit").alias("accuracy"), F.avg("c").alias("confidence"))
    return out.withColumn("calibration", F.abs(F.col("confidence") - F.col("accuracy")))


def _counts(df: DataFrame, truth: str, prediction: str, by: list[str]) -> DataFrame:
    return df.groupBy(*by, F.col(truth).alias("t"), F.coalesce(F.col(prediction), F.lit(MISSING)).alias("p")).agg(F.count("*").alias("n"))


def confusion(df: DataFrame, truth: str = "truth", prediction: str = "prediction", only_truth: bool = False, other: str = "__OTHER__") -> DataFrame:
    """(truth, prediction, n) for all pairs of labels that occur, zeros too. The label grid is as large as the labels squared.

    Where predictions are free texts, only_truth counts all that no row has as its truth under other.
    """
    c = _counts(df, truth, prediction, [])
    if only_truth:
        known = c.select(F.col("t").alias("p")).distinct().withColumn("__known", F.lit(True))
        c = c.join(known, "p", "left").groupBy("t", F.when(F.col("__known"), F.col("p")).otherwise(other).alias("p")).agg(F.sum("n").alias("n"))
    labels = c.select(F.explode(F.array("t", "p")).alias("label")).distinct()
    grid = labels.select(F.col("label").alias("truth")).crossJoin(labels.select(F.col("label").alias("prediction")))
    found = c.select(F.col("t").alias("truth"), F.col("p").alias("prediction"), "n")
    return grid.join(found, ["truth", "prediction"], "left").fillna(0, ["n"])


def per_class(df: DataFrame, truth: str = "truth", prediction: str = "prediction", by: list[str] | None = None) -> DataFrame:
    """precision, recall, f1 and support of every label of truth or prediction."""
    by = by or []
    c = _counts(df, truth, prediction, by)
    roles = F.array(F.struct(F.col("t").alias("label"), F.lit(1).alias("is_t")), F.struct(F.col("p").alias("label"), F.lit(0).alias("is_t")))
    long = c.select(*by, "n", (F.col("t") == F.col("p")).alias("hit"), F.inline(roles))
    s = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    out = long.groupBy(*by, "label").agg(s((F.col("is_t") == 1) & F.col("hit")).alias("tp"), s(F.col("is_t") == 0).alias("predicted"), s(F.col("is_t") == 1).alias("support"))
    out = out.withColumn("precision", ratio(F.col("tp"), F.col("predicted"))).withColumn("recall", ratio(F.col("tp"), F.col("support")))
    return out.withColumn("f1", f1(F.col("precision"), F.col("recall"))).select(*by, "label", "precision", "recall", "f1", "support")


def averages(classes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Macro over all labels, macro over labels of the truth only, and weighted by support, of per_class()."""
    out, valid = [], F.col("support") > 0
    for m in ("precision", "recall", "f1"):
        out += [F.avg(m).alias(f"macro_{m}"), F.avg(F.when(valid, F.col(m))).alias(f"valid_{m}"), ratio(F.sum(F.col(m) * F.col("support")), F.sum("support")).alias(f"weighted_{m}")]
    return classes.groupBy(*(by or [])).agg(*out)


def evaluation_counts(df: DataFrame, truth: str = "truth", prediction: str = "prediction", by: list[str] | None = None) -> DataFrame:
    """evaluated, correct, failed (no prediction), invalid (label that the truth lacks)."""
    by = by or []
    c = _counts(df.where(F.col(truth).isNotNull()), truth, prediction, by)
    known = c.select(*by, F.col("t").alias("p")).distinct().withColumn("known", F.lit(True))
    c = c.join(known, [*by, "p"], "left")
    s = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    return c.groupBy(*by).agg(F.sum("n").alias("evaluated"), s(F.col("t") == F.col("p")).alias("correct"), s(F.col("p") == MISSING).alias("failed"), s((F.col("p") != MISSING) & F.col("known").isNull()).alias("invalid"))


def valid_only(df: DataFrame, prediction: str, labels: list[str]) -> DataFrame:
    return df.where(F.col(prediction).isin(*labels))


def score_curve(df: DataFrame, truth: str, score: str, by: list[str] | None = None) -> DataFrame:
    """One row a distinct score, from high to low, with positives and negatives so far (of all rows: P, N)."""
    by = by or []
    d = df.groupBy(*by, F.col(score).alias("s")).agg(F.sum(F.when(F.col(truth) == 1, 1).otherwise(0)).alias("pos"), F.sum(F.when(F.col(truth) == 1, 0).otherwise(1)).alias("neg"))
    found = running_sums(d, F.desc("s"), {"tp": "pos", "fp": "neg"}, by)
    total = d.groupBy(*by).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    return found.join(total, by) if by else found.crossJoin(total)  # without by: one row


def roc_auc(df: DataFrame, truth: str, score: str, by: list[str] | None = None) -> DataFrame:
    """Area under the ROC curve, ties counted half; 0 where one class is missing."""
    c = score_curve(df, truth, score, by)
    area = F.col("neg") * (F.col("tp") - F.col("pos") / 2.0)
    return c.groupBy(*(by or [])).agg(ratio(F.sum(area), F.max("P") * F.max("N")).alias("roc_auc"))


def average_precision(df: DataFrame, truth: str, score: str, by: list[str] | None = None) -> DataFrame:
    """Sum of recall steps times precision over distinct scores."""
    c = score_curve(df, truth, score, by)
    return c.groupBy(*(by or [])).agg(ratio(F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))), F.max("P")).alias("average_precision"))


def hard_label_auc(df: DataFrame, truth: str = "truth", prediction: str = "prediction", by: list[str] | None = None) -> DataFrame:
    """Macro one-against-rest ROC-AUC and average precision of labels without scores, over labels of the truth; other predictions are dropped."""
    by = by or []
    c = _counts(df.where(F.col(truth).isNotNull()), truth, prediction, by)
    labels = c.select(*by, F.col("t").alias("label")).distinct()
    c = c.join(labels.withColumnRenamed("label", "p"), [*by, "p"], "left_semi")
    grid = c.crossJoin(labels) if not by else c.join(labels, by)
    s = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    t, p = F.col("t") == F.col("label"), F.col("p") == F.col("label")
    k = grid.groupBy(*by, "label").agg(s(t & p).alias("tp"), s(~t & p).alias("fp"), s(t).alias("P"), s(~t).alias("N"))
    recall, fpr = ratio(F.col("tp"), F.col("P")), ratio(F.col("fp"), F.col("N"))
    prevalence, precision = ratio(F.col("P"), F.col("P") + F.col("N")), ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    k = k.withColumn("auc", (recall + 1 - fpr) / 2).withColumn("ap", precision * recall + (1 - recall) * prevalence)
    return k.groupBy(*by).agg(F.avg("auc").alias("roc_auc"), F.avg("ap").alias("average_precision"))


# --- policies for missing and invalid predictions ------------------------------------------


POSITIVE_ORDER = ("Successful", "Long", "High")


def positive_label(labels: list[str]) -> str:
    return next((x for x in POSITIVE_ORDER if x in labels), sorted(labels)[0])


def opposite_if_missing(truth: Column, prediction: Column, labels: tuple[str, str]) -> Column:
    """A prediction that is neither label counts as the wrong one."""
    other = F.when(truth == labels[0], labels[1]).otherwise(labels[0])
    return F.when(prediction.isin(*labels), prediction).otherwise(other)


def next_if_missing(truth: Column, prediction: Column, labels: list[str]) -> Column:
    """A prediction that is no label counts as the label after the truth."""
    array = F.array(*(F.lit(x) for x in labels))
    at = F.array_position(array, truth).cast("int")
    return F.when(prediction.isin(*labels), prediction).otherwise(F.element_at(array, at % len(labels) + 1))


def binary_metrics(df: DataFrame, truth: str, prediction: str, labels: tuple[str, str], by: list[str] | None = None, missing_is_wrong: bool = True) -> DataFrame:
    """Accuracy, precision, recall, f1, roc_auc and average_precision of the positive label."""
    by = by or []
    p = opposite_if_missing(F.col(truth), F.col(prediction), labels) if missing_is_wrong else F.col(prediction)
    rows = (df if missing_is_wrong else valid_only(df, prediction, list(labels))).select(*by, F.col(truth).alias("t"), p.alias("p"))
    pos = positive_label(list(labels))
    s = lambda cond: F.count_if(cond)
    t, q = F.col("t") == pos, F.col("p") == pos
    k = rows.groupBy(*by).agg(F.count("*").alias("evaluated"), s(F.col("t") == F.col("p")).alias("hit"), s(t & q).alias("tp"), s(~t & q).alias("fp"), s(t).alias("P"), s(~t).alias("N"))
    precision, recall = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("P"))
    auc = F.when((F.col("P") > 0) & (F.col("N") > 0), (recall + 1 - ratio(F.col("fp"), F.col("N"))) / 2).otherwise(0.0)
    ap = precision * recall + (1 - recall) * ratio(F.col("P"), F.col("P") + F.col("N"))
    return k.select(*by, "evaluated", ratio(F.col("hit"), F.col("evaluated")).alias("accuracy"), precision.alias("precision"), recall.alias("recall"), f1(precision, recall).alias("f1"), auc.alias("roc_auc"), ap.alias("average_precision"))


def multiclass_metrics(df: DataFrame, truth: str, prediction: str, labels: list[str], by: list[str] | None = None) -> DataFrame:
    by = by or []
    rows = df.where(F.col(truth).isin(*labels)).select(*by, F.col(truth).alias("t"), next_if_missing(F.col(truth), F.col(prediction), labels).alias("p"))
    acc = rows.groupBy(*by).agg(F.count("*").alias("evaluated"), accuracy(F.col("t"), F.col("p")).alias("accuracy"))
    avg = averages(per_class(rows, "t", "p", by), by)
    return acc.join(avg, by) if by else acc.crossJoin(avg)


def regression_metrics(df: DataFrame, truth: str, prediction: str, by: list[str] | None = None, penalise: bool = True) -> DataFrame:
    """mae, mse, rmse, r2, and mean, deviation and median of the error. Missing predictions count as the mean truth, or are dropped."""
    by = by or []
    rows = df.where(F.col(truth).isNotNull())
    if penalise:
        mean = rows.groupBy(*by).agg(F.avg(truth).alias("__mean"))
        rows = rows.join(mean, by) if by else rows.crossJoin(mean)  # without by: one row
        rows = rows.withColumn("__p", F.coalesce(F.col(prediction).cast("double"), F.col("__mean")))
    else:
        rows = rows.where(F.col(prediction).isNotNull()).withColumn("__p", F.col(prediction).cast("double"))
    e, y = F.col("__p") - F.col(truth), F.col(truth)
    middle = [F.median(e).alias("median_error")] if by else []
    out = rows.groupBy(*by).agg(
        F.count("*").alias("evaluated"),
        F.avg(F.abs(e)).alias("mae"),
        F.avg(e * e).alias("mse"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        (F.lit(1.0) - F.try_divide(F.avg(e * e), F.var_pop(y))).alias("r2"),
        F.avg(e).alias("mean_error"),
        F.stddev_pop(e).alias("std_error"),
        *middle,
    )
    if not by:
        out = out.crossJoin(median(rows.select(e.alias("e")), "e").withColumnRenamed("median", "median_error"))
    return out.fillna(0.0, ["r2"])


def regression_as_binary(df: DataFrame, truth: str, prediction: str, threshold: float = 0.5, inclusive: bool = False) -> DataFrame:
    """df with t, p (0 or 1) and s (the raw value), for the binary measures; missing predictions count as the wrong side."""
    over = lambda c: (c >= threshold if inclusive else c > threshold).cast("int")
    t = over(F.col(truth))
    return df.where(F.col(truth).isNotNull()).select("*", t.alias("t"), F.coalesce(over(F.col(prediction)), 1 - t).alias("p"), F.coalesce(F.col(prediction).cast("double"), (1 - t).cast("double")).alias("s"))


def dose_long(df: DataFrame, truth: str, prediction: str, parts: tuple[str, ...] = ("max", "min", "avg"), levels: int = 5) -> DataFrame:
    """(part, t, p) of dose structs; a missing prediction counts as the level after the truth."""
    wrong = lambda t: F.pmod(t + 1, F.lit(levels))
    rows = [F.struct(F.lit(x).alias("part"), F.col(truth)[x].alias("t"), F.coalesce(F.col(prediction)[x], wrong(F.col(truth)[x])).alias("p")) for x in parts]
    return df.select("*", F.inline(F.array(*rows)))


def dose_metrics(df: DataFrame, truth: str, prediction: str, parts: tuple[str, ...] = ("max", "min", "avg"), levels: int = 5) -> DataFrame:
    """accuracy and macro f1 by part over all levels, their mean, and the share of rows with all parts right (part `all`)."""
    base = df.select(truth, prediction)
    long = dose_long(base, truth, prediction, parts, levels)
    c = long.groupBy("part", "t", "p").agg(F.count("*").alias("n"))
    s = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    cells = [x for k in range(levels) for x in (s((F.col("t") == k) & (F.col("p") == k)).alias(f"tp{k}"), s(F.col("t") == k).alias(f"t{k}"), s(F.col("p") == k).alias(f"p{k}"))]
    k = c.groupBy("part").agg(F.sum("n").alias("n"), s(F.col("t") == F.col("p")).alias("hit"), *cells)
    scores = [ratio(2 * F.col(f"tp{i}"), F.col(f"t{i}") + F.col(f"p{i}")) for i in range(levels)]
    by_part = k.select("part", ratio(F.col("hit"), F.col("n")).alias("accuracy"), (reduce(lambda a, b: a + b, scores) / levels).alias("macro_f1"))
    mean = by_part.agg(F.lit("mean").alias("part"), F.avg("accuracy").alias("accuracy"), F.avg("macro_f1").alias("macro_f1"))
    right = reduce(lambda a, b: a & b, [F.coalesce(F.col(truth)[x] == F.col(prediction)[x], F.lit(False)) for x in parts])
    whole = base.agg(F.lit("all").alias("part"), F.avg(right.cast("double")).alias("accuracy"), F.lit(None).cast("double").alias("macro_f1"))
    return by_part.unionByName(mean).unionByName(whole)


# --- aggregates over formats, files and categories --------------------------------------------


def weighted_formats(df: DataFrame, metrics: list[str], weight: str = "evaluated", positive_only: tuple[str, ...] = ("roc_auc", "average_precision")) -> DataFrame:
    """Means weighted by the number evaluated; areas only over formats where they are above 0."""
    out = []
    for m in metrics:
        w = F.when(F.col(m) > 0, F.col(weight)) if m in positive_only else F.when(F.col(m).isNotNull(), F.col(weight))
        out.append(ratio(F.sum(F.col(m) * w), F.sum(w)).alias(m))
    return df.agg(F.sum(weight).alias(weight), *out)


def mean_and_deviation(df: DataFrame, metrics: list[str], by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or [])).agg(*(x for m in metrics for x in (F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std"))))


def per_file_and_total(df: DataFrame, file: str, *aggregates: Column) -> DataFrame:
    """The aggregates by file, and over all files under a null file, in one pass."""
    return df.rollup(file).agg(*aggregates)


def answer_format(options: Column) -> Column:
    """three_way, many (over five options), letters, or other: by the keys of the option map."""
    keys = F.array_sort(F.map_keys(options))
    return (
        F.when(keys == F.array(F.lit("Maybe"), F.lit("No"), F.lit("Yes")), "three_way")
        .when(F.size(keys) > 5, "many")
        .when((F.size(keys) > 0) & F.forall(keys, lambda k: k.rlike("^[A-E]$")), "letters")
        .otherwise("other")
    )


def task_kind(mode: str | None, task: str, first_prediction: object) -> str:
    """How a result file is scored: by its mode, else its task name and the type of its first prediction."""
    if mode:
        return mode
    name, value = task.lower(), first_prediction
    is_text = isinstance(value, str)
    if "approval" in name:
        return "binary"
    if "duration" in name:
        return "binary" if value in ("Long", "Short") else "regression"
    if "failure" in name and "reason" in name:
        return "multiclass"
    if "mortality" in name:
        return "binary" if value in ("High", "Low") else "regression_as_binary"
    if "dropout" in name or "adverse" in name:
        return "binary" if is_text else "regression"
    if "dose" in name:
        return "multilabel"
    return "multilabel" if isinstance(value, dict) else "multiclass" if is_text else "regression"

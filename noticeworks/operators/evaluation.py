"""Evaluation of multi-label predictions, folds and rule violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scored(pairs: DataFrame, expected: str, predicted: str) -> DataFrame:
    """`pairs` with the sizes of what both label arrays share, of what only the prediction and only the truth has."""
    e, p = (F.array_distinct(F.coalesce(c, F.array().cast("array<string>"))) for c in (expected, predicted))
    return pairs.withColumns({"_e": e, "_p": p}).withColumns({"_hit": F.size(F.array_intersect("_e", "_p")), "_over": F.size(F.array_except("_p", "_e")), "_missed": F.size(F.array_except("_e", "_p"))})


def summary(rows: DataFrame, *by: str) -> DataFrame:
    """One row (for each `by`) of what `scored` rows come to (A10).

    Accuracy is of exact sets, 0 without rows; micro precision and recall are 1 without a label to judge.
    """
    n, exact = F.count(F.lit(1)), F.count_if((F.col("_over") == 0) & (F.col("_missed") == 0))
    hit, over, missed = (F.coalesce(F.sum(c), F.lit(0)) for c in ("_hit", "_over", "_missed"))
    share = lambda a, b, none: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(none))
    size = {"e": F.size("_e"), "p": F.size("_p")}
    return rows.groupBy(*by).agg(
        n.alias("rows"),
        share(exact, n, 0.0).alias("exact_set"),
        share(hit, hit + over, 1.0).alias("micro_precision"),
        share(hit, hit + missed, 1.0).alias("micro_recall"),
        F.count_if(size["p"] > 0).alias("categorized"),
        F.count_if(size["e"] == 0).alias("expected_none"),
        F.count_if(size["e"] > 1).alias("expected_many"),
        F.count_if(size["p"] > 1).alias("predicted_many"),
        F.coalesce(F.max(size["p"]), F.lit(0)).alias("most"),
        over.alias("over"),
        missed.alias("missed"),
    )


def per_class(rows: DataFrame, vocabulary: DataFrame, name: str) -> DataFrame:
    """(name, tp, fp, fn, support, precision, recall) of every class of `vocabulary`; null where nothing is to be judged (A10)."""
    each = rows.select(F.explode(F.array_union("_e", "_p")).alias(name), "_e", "_p")
    there = lambda c: F.array_contains(c, F.col(name))
    n = each.groupBy(name).agg(F.count_if(there("_e") & there("_p")).alias("tp"), F.count_if(~there("_e")).alias("fp"), F.count_if(~there("_p")).alias("fn"))
    j = vocabulary.select(name).distinct().join(n, name, "left").fillna(0, ["tp", "fp", "fn"])
    j = j.withColumn("support", F.col("tp") + F.col("fn"))
    return j.withColumn("precision", F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp"))).withColumn("recall", F.try_divide(F.col("tp").cast("double"), F.col("support")))


def dealt(rows: DataFrame, stratum: Column, key: str, folds: int = 5, width: int = 1 << 16) -> DataFrame:
    """`rows` with their `fold` from 0: by stratum, then by the long `key`, dealt in turn across strata.

    No stratum meets in one task: rows are numbered within blocks of `width` keys, and a table with a row for each
    block gives what comes before.
    """
    r = rows.withColumns({"_stratum": stratum, "_block": F.floor(F.col(key) / width)})
    sizes = r.groupBy("_stratum", "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_stratum", "_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy("_stratum", "_block").orderBy(key))
    j = r.withColumn("_k", own).join(sizes.withColumn("_before", before).drop("_n"), ["_stratum", "_block"])
    return j.withColumn("fold", ((F.col("_before") + F.col("_k") - 1) % folds).cast("int")).drop("_stratum", "_block", "_k", "_before")


def cross_validated(folds: DataFrame) -> DataFrame:
    """Mean, least, greatest and population deviation of the folds' exact-set accuracy, and mean micro figures."""
    r = lambda c: F.round(c, 9)
    return folds.agg(
        r(F.avg("exact_set")).alias("mean_exact"), r(F.min("exact_set")).alias("min_exact"), r(F.max("exact_set")).alias("max_exact"), r(F.stddev_pop("exact_set")).alias("stdev_exact"),
        r(F.avg("micro_precision")).alias("mean_precision"), r(F.avg("micro_recall")).alias("mean_recall"),
    )


def violations(rows: DataFrame, key: str, rules: dict[str, tuple[str, Column]], examples: int = 3, salts: int = 64) -> DataFrame:
    """(rule, severity, n, examples): for each of `rules`, name -> (severity, condition), its rows and the first few keys.

    Examples are ranked within salts of a rule, then across them, so that no task holds a rule's keys.
    """
    names = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(r)) for r, (_, c) in rules.items()]))
    v = rows.select(F.col(key).alias("_key"), F.explode(names).alias("rule")).withColumn("_salt", F.pmod(F.xxhash64("_key"), F.lit(salts)))
    top = lambda d, *by: d.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy("_key"))).where(F.col("_k") <= examples)
    some = top(top(v, "rule", "_salt"), "rule").groupBy("rule").agg(F.array_join(F.transform(F.array_sort(F.collect_list("_key")), lambda x: x.cast("string")), ",").alias("examples"))
    severity = F.create_map(*[F.lit(x) for r, (s, _) in rules.items() for x in (r, s)])
    return v.groupBy("rule").agg(F.count(F.lit(1)).alias("n")).join(some, "rule").select("rule", F.try_element_at(severity, F.col("rule")).alias("severity"), "n", "examples")


def unfindable(asked: DataFrame, known: DataFrame, key: str, correct: str) -> DataFrame:
    """(asked, unknown, any_correct, rate): how many asked ids are not known, and the share of the others with one correct answer at least."""
    each = asked.groupBy(key).agg(F.bool_or(correct).alias("_ok")).join(known.select(key).distinct().withColumn("_known", F.lit(True)), key, "left")
    seen = F.col("_known").isNotNull()
    right = F.count_if(seen & F.coalesce("_ok", F.lit(False)))
    return each.agg(F.count(F.lit(1)).alias("asked"), F.count_if(~seen).alias("unknown"), right.alias("any_correct"), F.round(F.try_divide(right.cast("double"), F.count_if(seen)), 9).alias("rate"))

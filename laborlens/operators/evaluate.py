"""Evaluation of a classifier from scored rows: is_tech (truth), predicted, score, category, expected_category, margin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laborlens.operators.running import with_running_sums
from laborlens.session import stored


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, 0.0).otherwise(part / whole)


def _measures(counts: DataFrame) -> DataFrame:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    precision, recall, specificity = ratio(tp, tp + fp), ratio(tp, tp + fn), ratio(tn, tn + fp)
    return counts.select(
        "*", precision.alias("precision"), recall.alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        specificity.alias("specificity"), ((recall + specificity) / 2).alias("balanced_accuracy"),
    )


def _confusion(truth: Column, said: Column) -> list[Column]:
    return [F.count_if(truth & said).alias("tp"), F.count_if(~truth & said).alias("fp"), F.count_if(truth & ~said).alias("fn"), F.count_if(~truth & ~said).alias("tn")]


def binary(rows: DataFrame) -> DataFrame:
    return _measures(rows.agg(*_confusion(F.col("is_tech"), F.col("predicted"))))


def by_score(rows: DataFrame) -> DataFrame:
    """(score, pos, neg): what the curves need; written once, as they read it several times."""
    return stored(rows.groupBy("score").agg(F.count_if("is_tech").alias("pos"), F.count_if(~F.col("is_tech")).alias("neg")), "scores")


def roc_auc(rows: DataFrame) -> DataFrame:
    """Share of (positive, negative) pairs in order, ties half; 0 if there is one class only."""
    parts = with_running_sums(by_score(rows), "score", ["neg"]).withColumn("won", F.col("pos") * (F.col("upto_neg") - F.col("neg") / 2))
    out = parts.agg(F.sum("won").alias("won"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return out.select(F.coalesce(ratio(F.col("won"), F.col("p") * F.col("n")), F.lit(0.0)).alias("roc_auc"))


def pr_auc(rows: DataFrame) -> DataFrame:
    """Trapezoids over the precision-recall curve at distinct scores, from recall 0 at precision 1."""
    counts = by_score(rows)
    all_ = counts.agg(F.sum("pos").alias("p"), F.sum("neg").alias("q"))
    # what scores at least as much, and what scores more
    tp, fp = F.col("p") - F.col("upto_pos") + F.col("pos"), F.col("q") - F.col("upto_neg") + F.col("neg")
    over, wrong = F.col("p") - F.col("upto_pos"), F.col("q") - F.col("upto_neg")
    before = F.when(over + wrong == 0, 1.0).otherwise(ratio(over, over + wrong))
    curve = with_running_sums(counts, "score", ["pos", "neg"]).join(all_, F.lit(True))
    step = (ratio(tp, F.col("p")) - ratio(over, F.col("p"))) * (ratio(tp, tp + fp) + before) / 2
    return curve.select(step.alias("area")).agg(F.coalesce(F.sum("area"), F.lit(0.0)).alias("pr_auc"))


def category_f1(rows: DataFrame) -> DataFrame:
    """Accuracy, macro and weighted F1 over all labels that occur on either side."""
    truth = rows.groupBy(F.col("expected_category").alias("label")).agg(F.count("*").alias("support"))
    said = rows.groupBy(F.col("category").alias("label")).agg(F.count("*").alias("said"), F.count_if(F.col("category") == F.col("expected_category")).alias("hit"))
    both = truth.join(said, "label", "full_outer").fillna(0, ["support", "said", "hit"])
    both = both.withColumn("f1", ratio(2 * F.col("hit"), F.col("support") + F.col("said")))
    return both.agg(ratio(F.sum("hit"), F.sum("support")).alias("category_accuracy"), F.avg("f1").alias("macro_f1"), ratio(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1"))


def reasons(rows: DataFrame) -> DataFrame:
    return rows.groupBy("reason").agg(F.count("*").alias("count"), F.avg("ambiguity").alias("mean_ambiguity"), F.count_if(F.col("ambiguity") > 0.5).alias("ambiguous"))


def policy_grid(spark) -> DataFrame:
    """tech_minimum 3 to 19, margin 1 to 5 by half: 153 policies."""
    return spark.range(3, 20).select(F.col("id").cast("double").alias("tech_minimum")).join(spark.range(2, 11).select((F.col("id") / 2).alias("minimum_margin")), F.lit(True))


def grid(rows: DataFrame) -> DataFrame:
    """Measures of every policy. Rows are first counted by what decides (score and margin on the grid's steps), so the grid meets
    at most a few hundred groups whatever the input."""
    groups = rows.groupBy(F.least(F.floor("score"), F.lit(20)).alias("s"), F.least(F.floor(F.col("margin") * 2), F.lit(11)).alias("m"), "is_tech").agg(F.count("*").alias("n"))
    met = groups.join(F.broadcast(policy_grid(rows.sparkSession)), F.lit(True))
    said = (F.col("s") >= F.col("tech_minimum")) & (F.col("m") >= 2 * F.col("minimum_margin"))

    def total(test: Column, name: str) -> Column:
        return F.sum(F.when(test, F.col("n")).otherwise(0)).alias(name)

    counts = met.groupBy("tech_minimum", "minimum_margin").agg(total(F.col("is_tech") & said, "tp"), total(~F.col("is_tech") & said, "fp"), total(F.col("is_tech") & ~said, "fn"), total(~F.col("is_tech") & ~said, "tn"))
    return _measures(counts)


def best_policy(measured: DataFrame, metric: str = "f1") -> DataFrame:
    return measured.orderBy(F.desc(F.round(metric, 9)), F.desc(F.round("precision", 9)), "tech_minimum", "minimum_margin").limit(1)


def report(rows: DataFrame, default: tuple[float, float] = (8.0, 3.0)) -> DataFrame:
    """Default and best policy in one row, with what to do."""
    measured = grid(rows)
    old = measured.filter((F.col("tech_minimum") == default[0]) & (F.col("minimum_margin") == default[1])).select(F.col("f1").alias("default_f1"))
    best = best_policy(measured).select("tech_minimum", "minimum_margin", F.col("f1").alias("best_f1"))
    out = old.join(best, F.lit(True)).join(rows.agg(F.count("*").alias("rows"), F.count_if("is_tech").alias("tech_rows")), F.lit(True))
    gain = F.round(F.col("best_f1") - F.col("default_f1"), 9)
    return out.withColumn("improvement", gain).withColumn("recommendation", F.when(gain > 0.02, "adopt").when(gain > 0.005, "slight").otherwise("keep"))


def policy_hash(name: str | Column, minimum: Column, margin: Column) -> Column:
    """Short fingerprint of a policy."""
    return F.substring(F.md5(F.concat_ws("|", F.lit(name) if isinstance(name, str) else name, minimum.cast("string"), margin.cast("string"))), 1, 8)


#: Measures that a report tells.
MEASURES = ["tp", "fp", "fn", "tn", "precision", "recall", "f1", "accuracy", "specificity", "balanced_accuracy"]


def report_document(rows: DataFrame, default: tuple[float, float] = (8.0, 3.0), metric: str = "f1") -> DataFrame:
    """One nested row: size and classes of the data, the default policy and the best one with their measures, what the best one gains, and the reason that
    most rows have. The grid is measured once."""
    measured = stored(grid(rows), "grid")
    policy = F.struct("tech_minimum", "minimum_margin").alias("policy")
    metrics = F.struct(*MEASURES).alias("metrics")
    of = lambda name: F.struct(policy, policy_hash(name, F.col("tech_minimum"), F.col("minimum_margin")).alias("policy_hash"), metrics)
    old = measured.filter((F.col("tech_minimum") == default[0]) & (F.col("minimum_margin") == default[1])).select(of("default").alias("default_policy"))
    best = best_policy(measured, metric).select(of("best").alias("best_policy"))
    size = rows.agg(F.count("*").alias("dataset_size"), F.struct(F.count_if("is_tech").alias("tech"), F.count_if(~F.coalesce("is_tech", F.lit(False))).alias("non_tech")).alias("class_distribution"))
    top = reasons(rows).agg(F.min(F.struct((-F.col("count")).alias("n"), "reason")).alias("t")).select(F.struct(F.col("t.reason").alias("reason"), (-F.col("t.n")).alias("count")).alias("top_reason"))
    tried = measured.agg(F.count("*").alias("total_combinations"))
    out = size.join(old, F.lit(True)).join(best, F.lit(True)).join(top, F.lit(True)).join(tried, F.lit(True))
    gain = F.struct(*(F.round(F.col(f"best_policy.metrics.{m}") - F.col(f"default_policy.metrics.{m}"), 9).alias(m) for m in ("f1", "precision", "recall")))
    advice = F.when(F.col("gain.f1") > 0.02, "adopt").when(F.col("gain.f1") > 0.005, "slight").otherwise("keep")
    out = out.withColumn("gain", gain)
    return out.select(
        "dataset_size", "class_distribution", "default_policy", F.struct("best_policy", F.lit(metric).alias("optimize_for"), "total_combinations").alias("optimization"),
        F.struct(F.col("best_policy.policy").alias("recommended_policy"), F.col("gain").alias("improvement_over_default"), advice.alias("recommendation"), "top_reason").alias("recommendations"),
    )


def write_report(document: DataFrame, path: str) -> None:
    """The report as a JSON document."""
    document.coalesce(1).write.mode("errorifexists").json(path)


def hashes(rows: DataFrame) -> DataFrame:
    """Short fingerprint of a policy and cache key of a posting's content; skills count in any order."""
    policy = policy_hash("default", F.lit(8.0), F.lit(3.0))
    skills = [F.array_join(F.sort_array("skills"), ",")] if "skills" in rows.columns else []
    return rows.select("id", policy.alias("policy"), F.sha2(F.concat_ws("\x1f", F.lit("v1"), "title", "description", *skills), 256).alias("cache_key"))

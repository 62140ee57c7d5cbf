"""Review of regions, their counts, and measures against a truth mask."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATUSES = ("pending", "confirmed", "false_positive", "submitted")
KEYS = ["run_id", "region_id"]


def status_of(column: str) -> Column:
    """null and empty count as pending."""
    return F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit("pending"))


def merged(regions: DataFrame, reviews: DataFrame) -> DataFrame:
    """Regions with the status of their review row; without one, their own."""
    r = reviews.select(*KEYS, F.col("status").alias("_status"))
    return regions.join(r, KEYS, "left").withColumn("review_status", F.coalesce("_status", status_of("review_status"))).drop("_status")


def latest(log: DataFrame) -> DataFrame:
    """ST5, MU6: the state of each region after a log of (run_id, region_id, seq, status): the last legal status; after submitted nothing counts."""
    legal = log.filter(F.col("status").isin(*STATUSES))
    done = Window.partitionBy(*KEYS).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    open_ = legal.withColumn("_done", F.coalesce(F.max((F.col("status") == "submitted").cast("int")).over(done), F.lit(0))).filter("_done = 0")
    return open_.groupBy(*KEYS).agg(F.max_by("status", "seq").alias("status"), F.count(F.lit(1)).alias("changes"))


def submitted(reviews: DataFrame, ids: DataFrame) -> DataFrame:
    """MU7, F7: confirmed rows among ``ids`` become submitted."""
    j = reviews.join(ids.select(*KEYS).distinct().withColumn("_in", F.lit(True)), KEYS, "left")
    return j.withColumn("status", F.when(F.col("_in") & (F.col("status") == "confirmed"), "submitted").otherwise(F.col("status"))).drop("_in")


def summary(regions: DataFrame) -> DataFrame:
    """A2: regions by status; the four known ones appear with 0 if need be, unknown ones stay."""
    spark = regions.sparkSession
    known = spark.createDataFrame([(s,) for s in STATUSES], "review_status string")
    counts = regions.groupBy(status_of("review_status").alias("review_status")).count()
    return counts.join(known, "review_status", "full").select("review_status", F.coalesce("count", F.lit(0)).alias("n"))


def confusion(df: DataFrame, keys: list[str], predicted: Column, truth: Column) -> DataFrame:
    """Tp, fp, fn, tn."""
    return df.groupBy(*keys).agg(F.count_if(predicted & truth).alias("tp"), F.count_if(predicted & ~truth).alias("fp"), F.count_if(~predicted & truth).alias("fn"), F.count_if(~predicted & ~truth).alias("tn"))


def measures(counts: DataFrame) -> DataFrame:
    """IoU, Dice, F1, precision, recall, accuracy and the two error rates, to 4 places. Nothing predicted and nothing true is perfect; other divisions by 0 give 0."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    part = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    none = tp + fp + fn == 0
    of = lambda a, b: F.when(none, 1.0).otherwise(part(a, b))
    precision, recall, dice = of(tp, tp + fp), of(tp, tp + fn), of(2 * tp, 2 * tp + fp + fn)
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(dice)
    values = {"iou": of(tp, tp + fp + fn), "dice": dice, "f1": f1, "precision": precision, "recall": recall, "accuracy": part(tp + tn, tp + fp + fn + tn), "fpr": part(fp, fp + tn), "fnr": part(fn, fn + tp)}
    return counts.withColumns({k: F.round(v, 4) for k, v in values.items()})


def activity(jobs: DataFrame, runs: DataFrame) -> DataFrame:
    """Jobs, and those runs that no job names, as one table."""
    rest = runs.join(jobs.select("run_id").filter("run_id is not null").distinct(), "run_id", "left_anti")
    return jobs.select(F.lit("job").alias("kind"), "job_id", "run_id", "created_at").unionByName(rest.select(F.lit("run").alias("kind"), F.lit(None).cast("long").alias("job_id"), "run_id", "created_at"))

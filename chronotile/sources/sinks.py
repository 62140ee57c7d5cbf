"""Tables and files handed to others: region CSV, training export, reports, audit rows, payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CSV_COLUMNS = ("run_id", "region_id", "object_type", "change_type", "area", "x", "y", "w", "h", "confidence", "severity", "lat", "lng", "review_status")


def region_rows(regions: DataFrame) -> DataFrame:
    """K1: the 14 columns of the region CSV as text, confidence with 4 places, nulls empty."""
    have = set(regions.columns)
    text = lambda c: F.coalesce((F.format_string("%.4f", F.col(c).cast("double")) if c == "confidence" else F.col(c).cast("string")) if c in have else F.lit(None).cast("string"), F.lit(""))
    return regions.select(*[text(c).alias(c) for c in CSV_COLUMNS])


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def false_positives(reviews: DataFrame, runs: DataFrame, regions: DataFrame) -> DataFrame:
    """False positives for training: review, run and region that all exist."""
    return reviews.filter("status = 'false_positive'").join(runs, "run_id").join(regions.drop("review_status"), ["run_id", "region_id"])


def payloads(regions: DataFrame) -> DataFrame:
    """K3, K5: one JSON document per run with its regions in order."""
    r = F.struct("region_id", "object_type", "area", "confidence")
    return regions.groupBy("run_id").agg(F.sort_array(F.collect_list(r)).alias("regions")).select("run_id", F.size("regions").cast("long").alias("n"), F.to_json(F.struct(F.col("run_id").alias("runId"), "regions")).alias("payload"))


def serialised(regions: DataFrame) -> DataFrame:
    """run_id, regions_count and regions_json, the stored form of a run's regions in order of their id; absent enrichments are null."""
    have = set(regions.columns)
    own = lambda c, kind: (F.col(c) if c in have else F.lit(None)).cast(kind)
    centre = F.struct(*[F.bround(F.col(f"centre_{c}") if f"centre_{c}" in have else F.col(c) + (F.col(s) - 1) / 2).cast("int").alias(c) for c, s in (("x", "w"), ("y", "h"))])
    region = F.struct(
        F.col("region_id").cast("int").alias("id"), F.col("area").cast("long").alias("area"), centre.alias("center"),
        F.struct(*[F.col(c).cast("int").alias(c) for c in ("x", "y", "w", "h")]).alias("bbox"),
        F.col("object_type").alias("objectType"), F.col("confidence").cast("double").alias("confidence"),
        F.coalesce(own("severity", "string"), F.lit("minor")).alias("severity"),
        own("sub_type", "string").alias("subType"), own("sub_type_confidence", "double").alias("subTypeConfidence"),
        own("stories", "int").alias("estimatedStories"), own("height_m", "double").alias("estimatedHeightM"),
        own("stage", "string").alias("constructionStage"),
    )
    text = F.to_json("regions", {"ignoreNullFields": "false"}).alias("regions_json")
    return regions.groupBy("run_id").agg(F.sort_array(F.collect_list(region)).alias("regions")).select("run_id", F.size("regions").alias("regions_count"), text)


def run_rows(runs: DataFrame, statistics: DataFrame, regions: DataFrame) -> DataFrame:
    """Rows to append to the run table: ``runs`` (run_id, user_id, title, method, ...) with the statistics of R32 and regions as R33 stores them."""
    stored = serialised(regions)
    counted = F.coalesce("regions_count", F.lit(0)).alias("regions_count")
    rows = runs.join(statistics, "run_id").join(stored, "run_id", "left")
    own = [c for c in runs.columns] + ["total_pixels", "changed_pixels", "change_percentage"]
    return rows.select(*own, counted, F.coalesce("regions_json", F.lit("[]")).alias("regions_json"))


def file_exports(runs: DataFrame, confirmed: DataFrame) -> DataFrame:
    """K4: what a hand-over by file says of each run: ok, mode, message, submitted_count and download_path. ``confirmed`` are confirmed regions."""
    n = F.coalesce("_n", F.lit(0))
    rows = runs.select("run_id").join(confirmed.groupBy("run_id").agg(F.count(F.lit(1)).alias("_n")), "run_id", "left")
    ready = F.concat(n.cast("string"), F.lit(" confirmed region(s) ready for CSV download."))
    path = F.when(n > 0, F.concat(F.lit("/api/dda/reports/"), F.col("run_id").cast("string"), F.lit("/export.csv?confirmed=1")))
    message = F.when(n > 0, ready).otherwise("No confirmed regions to export.")
    return rows.select("run_id", (n > 0).alias("ok"), F.lit("file").alias("mode"), message.alias("message"), n.cast("long").alias("submitted_count"), path.alias("download_path"))


def hand_over(runs: DataFrame, confirmed: DataFrame, address: str | None, send=None) -> DataFrame:
    """K4: payloads for ``send``, a function of a payload row run in the executors, where an address is set; else the file hand-over."""
    if not address:
        return file_exports(runs, confirmed)
    documents = payloads(confirmed)
    if send is not None:
        documents.foreachPartition(lambda rows: [send(r) for r in rows] and None)
    return documents


def audit_rows(before: DataFrame, after: DataFrame, key: str, action: str) -> DataFrame:
    """A row with old and new JSON for each key whose row changed."""
    pack = lambda df, name: df.select(key, F.to_json(F.struct(*[c for c in df.columns if c != key])).alias(name))
    return pack(before, "old_value").join(pack(after, "new_value"), key, "full").filter(~F.col("old_value").eqNullSafe(F.col("new_value"))).withColumn("action", F.lit(action))


def cache_state(previews: DataFrame) -> DataFrame:
    """K9: whether a cached preview may be served, and the size cap of a new one by the size of its source."""
    return previews.withColumn("valid", F.coalesce(F.col("cached_at") >= F.col("modified_at"), F.lit(False))).withColumn("max_side", F.when(F.col("size") > 2 * 1024**3, 512).when(F.col("size") > 500 * 1024**2, 1024).otherwise(4096))

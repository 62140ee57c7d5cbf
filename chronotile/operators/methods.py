"""Detection methods put together from signals, masks and a model's scores, and the choice among them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronotile.functions.lineage import cut
from chronotile.operators import masks as M
from chronotile.operators import signals as S
from chronotile.operators.pixels import KEY

DIFFERENCES = ["dl", "da", "db", "ds", "dv"]
#: Names that callers use, and older ones.
METHODS = {"Feature-Based": "feature", "AI Deep Learning": "model", "Image Difference": "model", "Hybrid AI": "hybrid_model", "Hybrid": "hybrid"}


def colour_differences(df: DataFrame) -> DataFrame:
    """M3: absolute differences of L, a, b, saturation and value."""
    c = S.coloured(df)
    d = lambda space, f: F.abs(F.col(f"{space}1")[f] - F.col(f"{space}2")[f]).cast("double")
    return c.select(*KEY, d("lab", "l").alias("dl"), d("lab", "a").alias("da"), d("lab", "b").alias("db"), d("hsv", "s").alias("ds"), d("hsv", "v").alias("dv"))


#: Most cells of a pair that its clusters are sought on; larger images are averaged over square cells first.
MOST_CELLS = 250_000


def _centres(clusters: int, starts: int = 10, rounds: int = 100):
    """For one pair's cells: means and deviations of the features, and the cluster centres of the best of several k-means."""

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        raw = rows.sort_values(["cy", "cx"])[DIFFERENCES].to_numpy(float)
        mean, scale = raw.mean(0), raw.std(0)
        scale[scale == 0] = 1
        x, random, best = (raw - mean) / scale, np.random.default_rng(42), None
        for _ in range(starts):
            centres = x[[random.integers(len(x))]]
            for _ in range(clusters - 1):  # the next centre by its distance from those there are
                far = ((x[:, None] - centres) ** 2).sum(-1).min(1)
                centres = np.vstack([centres, x[random.choice(len(x), p=far / far.sum() if far.sum() else None)]])
            for _ in range(rounds):
                own = ((x[:, None] - centres) ** 2).sum(-1).argmin(1)
                moved = np.array([x[own == k].mean(0) if (own == k).any() else centres[k] for k in range(clusters)])
                if np.allclose(moved, centres):
                    break
                centres = moved
            loss = ((x - centres[own]) ** 2).sum()
            if best is None or loss < best[0] - 1e-12:
                best = loss, centres, own
        _, centres, own = best
        size = np.sqrt((raw**2).sum(1))
        most = int(np.argmax([size[own == k].mean() if (own == k).any() else 0.0 for k in range(clusters)]))
        return pd.DataFrame({"pair_id": [int(rows["pair_id"].iloc[0])], "mean": [mean], "scale": [scale], "centres": [list(centres)], "most": [most]})

    return fit


def feature_mask(df: DataFrame, clusters: int = 4) -> DataFrame:
    """M3: on pixels of each pair's own cluster whose members differ most, after standardising.

    Centres are sought on at most MOST_CELLS cells of a pair (means over squares of larger images), one pair a task; then all pixels take
    the nearest centre.
    """
    rows = cut(colour_differences(df))
    side = rows.groupBy("pair_id").agg(F.ceil(F.sqrt(F.count(F.lit(1)) / MOST_CELLS)).alias("side"))
    cell = [F.floor(F.col(c) / F.col("side")).alias(n) for c, n in (("y", "cy"), ("x", "cx"))]
    cells = rows.join(side, "pair_id").groupBy("pair_id", *cell).agg(*[F.avg(d).alias(d) for d in DIFFERENCES])
    found = "pair_id long, mean array<double>, scale array<double>, centres array<array<double>>, most int"
    centres = cut(cells.groupBy("pair_id").applyInPandas(_centres(clusters), found))
    scaled = F.transform(F.arrays_zip(F.array(*DIFFERENCES).alias("v"), "mean", "scale"), lambda z: (z["v"] - z["mean"]) / z["scale"])
    far = lambda c: F.aggregate(F.zip_with(c, "z", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, d: s + d)
    near = F.array_position("far", F.array_min("far")) - 1
    placed = rows.join(centres.hint("merge"), "pair_id").withColumn("z", scaled).withColumn("far", F.transform("centres", far))
    return placed.select(*KEY, (near == F.col("most")).cast("int").alias("on"))


def model_mask(scores: DataFrame, sensitivity: float = 0.5) -> DataFrame:
    """(pair_id, y, x, model, classical) to on pixels: model and rule masks joined by the smart union; without model scores the rules alone."""
    on = lambda c: F.coalesce(c.cast("int"), F.lit(0))
    cut_at = scores.groupBy("pair_id").agg(F.percentile("classical", F.lit(min(0.96, max(0.86, 0.94 - (sensitivity - 0.5) * 0.06)))).alias("q"))
    marked = scores.join(cut_at, "pair_id").withColumns({"model_on": on(F.col("model") >= 0.32 + 0.22 * (1 - sensitivity)), "rule_on": on(F.col("classical") >= F.col("q")), "model": F.coalesce("model", F.lit(0.0))})
    return M.smart_union(marked.drop("q"), sensitivity)


def with_fallback(df: DataFrame, mask: DataFrame, registered: DataFrame | None = None) -> DataFrame:
    """``mask`` (pair_id, y, x, on), with the feature mask for the pairs in which nothing is on; of these only those in ``registered``
    (pair_id), if it is given. The feature method runs on these pairs alone."""
    mask = cut(mask.select(*KEY, "on"))
    empty = mask.groupBy("pair_id").agg(F.max("on").alias("_any")).filter("_any = 0").select("pair_id")
    empty = cut(empty if registered is None else empty.join(registered, "pair_id", "left_semi"))
    second = feature_mask(df.join(empty, "pair_id", "left_semi"))
    return mask.join(empty, "pair_id", "left_anti").unionByName(second)


def detect(df: DataFrame, method: str, model_scores: DataFrame | None = None, sensitivity: float = 0.5, border: int = 12, least: int = 120, fallback: bool = False) -> DataFrame:
    """On pixels (pair_id, y, x, on) by a method's name; older names go to their successor, unknown ones to the hybrid.

    With ``fallback``, pairs in which the method finds nothing get the feature mask.
    """
    kind = METHODS.get(method, "hybrid")
    if fallback and kind != "feature":
        return with_fallback(df, detect(df, method, model_scores, sensitivity, border, least))
    if kind == "feature":
        return feature_mask(df)
    df = cut(df)
    channels = S.signal_channels(df)  # of both the score and the confidence
    classical = cut(S.classical_score(df, channels=channels).select(*KEY, F.col("score").alias("classical")))
    if model_scores is None:
        both = classical.withColumn("model", F.lit(None).cast("double"))
    else:
        both = classical.join(model_scores.select(*KEY, F.col("score").alias("model")), list(KEY), "left")
    both = cut(both)
    if kind == "hybrid_model":
        scored = None if model_scores is None else both.select(*KEY, F.col("model").alias("score"))
        level = 0.25 + (1 - min(1.0, max(0.0, sensitivity))) * 0.25
        rule = M.core_mask(classical.withColumnRenamed("classical", "score"), sensitivity, border, least).withColumnRenamed("on", "rule_on")
        marked = both.join(rule, list(KEY)).join(S.confidence_map(df, scored, channels), list(KEY))
        model_on = F.coalesce((F.col("model") >= level).cast("int"), F.lit(0))
        on = marked.filter(M.hybrid_model_on(model_on, F.col("rule_on"), F.col("confidence"), sensitivity, model_scores is not None)).select(*KEY)
    else:
        on = model_mask(both, sensitivity)
    out = both.select(*KEY).join(on.withColumn("on", F.lit(1)), list(KEY), "left").na.fill(0, ["on"])
    if kind == "hybrid":
        byte = lambda c: F.col(c) * 255
        both_masks = out.withColumnRenamed("on", "m").join(feature_mask(df).withColumnRenamed("on", "f"), list(KEY))
        out = both_masks.select(*KEY, M.hybrid_on(byte("f"), byte("m"), sensitivity).cast("int").alias("on"))
    return out

"""Measures over pixel tables: image_id, x, y, r, g, b."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def luma() -> Column:
    return 0.299 * F.col("r") + 0.587 * F.col("g") + 0.114 * F.col("b")


def patch_stats(pixels: DataFrame, size: int = 16) -> DataFrame:
    """image_id, px, py, mean r, g, b, luminance, energy (mean absolute deviation, summed over the channels). One shuffle of the pixels."""
    df = pixels.withColumn("px", F.floor(F.col("x") / size)).withColumn("py", F.floor(F.col("y") / size))
    keys = ["image_id", "px", "py"]
    df = df.dropna(subset=keys).withColumns({f"mean_{c}": F.avg(c).over(Window.partitionBy(*keys)) for c in "rgb"})
    off = sum((F.abs(F.col(c) - F.col(f"mean_{c}")) for c in "gb"), F.abs(F.col("r") - F.col("mean_r")))
    return df.groupBy(*keys).agg(*(F.first(f"mean_{c}").alias(f"mean_{c}") for c in "rgb"), F.avg(luma()).alias("luminance"), F.avg(off).alias("energy"))


def entropy(pixels: DataFrame) -> DataFrame:
    """image_id, entropy (bits) of the rounded luminance."""
    counts = pixels.groupBy("image_id", F.round(luma()).cast("int").alias("level")).agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("image_id"))
    return counts.withColumn("p", share).groupBy("image_id").agg(F.sum(-F.col("p") * F.log2("p")).alias("entropy"))


def edge_residual(pixels: DataFrame) -> DataFrame:
    """image_id, edges: mean absolute Laplacian (4 neighbours) over the inner pixels."""
    df = pixels.select("image_id", "x", "y", luma().alias("v"))
    row, column = Window.partitionBy("image_id", "y").orderBy("x"), Window.partitionBy("image_id", "x").orderBy("y")
    df = df.withColumns({"l": F.lag("v").over(row), "r": F.lead("v").over(row)}).withColumns({"u": F.lag("v").over(column), "d": F.lead("v").over(column)})
    return df.groupBy("image_id").agg(F.coalesce(F.avg(F.abs(4 * F.col("v") - F.col("l") - F.col("r") - F.col("u") - F.col("d"))), F.lit(0.0)).alias("edges"))


def irrecoverability(pixels: DataFrame) -> DataFrame:
    """image_id, entropy, edges, resistance (0 to 100, one decimal), zero_information, verdict."""
    df = entropy(pixels).join(edge_residual(pixels), "image_id")
    value = F.greatest(F.round(100 - (17.5 * F.col("entropy") + 0.4 * F.col("edges")), 1), F.lit(0.0))
    df = df.withColumn("resistance", value).withColumn("zero_information", (F.col("entropy") < 0.0001) & (F.col("edges") < 0.0001))
    return df.withColumn("verdict", F.when(F.col("zero_information"), "irrecoverable").when(F.col("resistance") >= 60, "strong").otherwise("weak"))


def in_boxes(pixels: DataFrame, boxes: DataFrame, cell: int = 32) -> DataFrame:
    """Pixels by the boxes (image_id, box_id, x, y, w, h) that they lie in; they meet on grid cells."""
    xs = F.sequence(F.floor(F.col("x") / cell), F.floor((F.col("x") + F.col("w") - 1) / cell))
    ys = F.sequence(F.floor(F.col("y") / cell), F.floor((F.col("y") + F.col("h") - 1) / cell))
    b = boxes.filter("w > 0 and h > 0").select("image_id", "box_id", *(F.col(c).alias(f"b{c}") for c in "xywh"), F.explode(xs).alias("cx"), ys.alias("ys")).withColumn("cy", F.explode("ys")).drop("ys")
    p = pixels.withColumn("cx", F.floor(F.col("x") / cell)).withColumn("cy", F.floor(F.col("y") / cell))
    return p.join(b, ["image_id", "cx", "cy"]).filter("x >= bx and x < bx + bw and y >= by and y < by + bh")


def region_stats(pixels: DataFrame, boxes: DataFrame) -> DataFrame:
    """image_id, box_id, n, dark_share (luma up to 12), mean, variance over every second pixel each way; an empty box is dark."""
    rows = in_boxes(pixels, boxes).filter("(x - bx) % 2 = 0 and (y - by) % 2 = 0").withColumn("v", luma())
    stats = rows.groupBy("image_id", "box_id").agg(F.count("*").alias("n"), F.avg((F.col("v") <= 12).cast("int")).alias("dark_share"), F.avg("v").alias("mean"), F.var_pop("v").alias("variance"))
    return boxes.select("image_id", "box_id").join(stats, ["image_id", "box_id"], "left").fillna({"n": 0, "dark_share": 1.0, "mean": 0.0, "variance": 0.0})


def ink_survival(reference: DataFrame, redacted: DataFrame, boxes: DataFrame) -> DataFrame:
    """image_id, box_id, n_ink, n_same, leaked: ink (over 35 from the box's upper median luma) that redaction left as it was."""
    ref = in_boxes(reference, boxes).select("image_id", "box_id", "x", "y", "r", "g", "b", luma().alias("v"))
    by = Window.partitionBy("image_id", "box_id")
    ranked = ref.withColumn("i", F.row_number().over(by.orderBy("v", "x", "y")) - 1).withColumn("n", F.count("*").over(by))
    back = ranked.filter(F.col("i") == F.floor(F.col("n") / 2)).select("image_id", "box_id", F.col("v").alias("background"))
    ink = ref.join(back, ["image_id", "box_id"]).filter(F.abs(F.col("v") - F.col("background")) > 35)
    out = redacted.select("image_id", "x", "y", *(F.col(c).alias(f"{c}2") for c in "rgb"))
    same = F.greatest(*(F.abs(F.col(c) - F.col(f"{c}2")) for c in "rgb")) <= 8
    rows = ink.join(out, ["image_id", "x", "y"]).groupBy("image_id", "box_id").agg(F.count("*").alias("n_ink"), F.count_if(same).alias("n_same"))
    rows = boxes.select("image_id", "box_id").join(rows, ["image_id", "box_id"], "left").fillna(0)
    return rows.withColumn("leaked", (F.col("n_ink") >= 20) & (F.col("n_same") > 0.02 * F.col("n_ink")))


def legible_safe(stats: DataFrame, first: int = 12) -> DataFrame:
    """image_id, legible: of each image's first safe boxes, how many are less than half dark."""
    place = F.row_number().over(Window.partitionBy("image_id").orderBy("box_id"))
    return stats.withColumn("_n", place).filter(F.col("_n") <= first).groupBy("image_id").agg(F.count_if(F.col("dark_share") < 0.5).alias("legible"))

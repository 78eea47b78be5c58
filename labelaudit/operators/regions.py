"""What follows picture OCR: boxes, words, regions and their confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelaudit.operators.scoring import ocr_level

_RECT = "struct<l: int, t: int, r: int, b: int>"


def _per_picture(boxes: DataFrame) -> DataFrame:
    """image_id, boxes: a picture's boxes, some dozens, in order of their numbers."""
    names = ["box_no", "x", "y", "width", "height"]
    return boxes.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct(*[F.col(n).cast("int").alias(n) for n in names]))).alias("boxes"))


def _area(r: Column) -> Column:
    return (r["r"] - r["l"]) * (r["b"] - r["t"])


def _takes_in(a: Column, b: Column, share: float) -> Column:
    """Whether two boxes overlap by more than `share` of the smaller."""
    w = F.least(a["r"], b["r"]) - F.greatest(a["l"], b["l"])
    h = F.least(a["b"], b["b"]) - F.greatest(a["t"], b["t"])
    return (w > 0) & (h > 0) & (w * h / F.least(_area(a), _area(b)) > share)


def _around(a: Column, b: Column) -> Column:
    low, high = ("l", "t"), ("r", "b")
    return F.struct(*[F.least(a[n], b[n]).alias(n) for n in low], *[F.greatest(a[n], b[n]).alias(n) for n in high])


def merged_rects(rects: Column, share: float = 0.5) -> Column:
    """From left to right over the list: a box takes in each later one that it overlaps, growing as it does. A fold whose
    steps take the first box that is left and fold the others into it."""
    none = F.array().cast(f"array<{_RECT}>")

    def one(state: Column, _: Column) -> Column:
        head, others = F.get(state["left"], F.lit(0)), F.slice(state["left"], F.lit(2), F.greatest(F.size(state["left"]) - 1, F.lit(0)))

        def against(held: Column, box: Column) -> Column:
            hit = _takes_in(held["now"], box, share)
            return F.struct(
                F.when(hit, _around(held["now"], box)).otherwise(held["now"]).alias("now"), F.when(hit, held["kept"]).otherwise(F.array_append(held["kept"], box)).alias("kept")
            )

        run = F.aggregate(others, F.struct(head.alias("now"), none.alias("kept")), against)
        step = F.transform(F.array(run), lambda x: F.struct(x["kept"].alias("left"), F.array_append(state["out"], x["now"]).alias("out")))
        return F.when(F.size(state["left"]) > 0, F.get(step, F.lit(0))).otherwise(state)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(rects), F.lit(1))), F.struct(rects.alias("left"), none.alias("out")), one, lambda s: s["out"])


def merge_boxes(boxes: DataFrame, share: float = 0.5) -> DataFrame:
    """image_id, box_no, x, y, width, height: merged boxes of each picture."""
    rect = lambda b: F.struct(b["x"].alias("l"), b["y"].alias("t"), (b["x"] + b["width"]).alias("r"), (b["y"] + b["height"]).alias("b"))
    found = _per_picture(boxes).withColumn("rects", F.transform("boxes", rect)).withColumn("rects", F.col("rects").cast(f"array<{_RECT}>"))
    each = found.select("image_id", F.posexplode(merged_rects(F.col("rects"), share)).alias("box_no", "o"))
    return each.select("image_id", "box_no", F.col("o.l").alias("x"), F.col("o.t").alias("y"), (F.col("o.r") - F.col("o.l")).alias("width"), (F.col("o.b") - F.col("o.t")).alias("height"))


def reading_order(boxes: DataFrame) -> DataFrame:
    """image_id, box_no, row, position: boxes numbered row by row, each row left to right; a row's boxes have their
    centres within half the mean height of the centre of its first."""
    heights = F.aggregate("boxes", F.lit(0).cast("long"), lambda s, b: s + b["height"])
    reach = heights / F.size("boxes") * 0.5
    down = F.array_sort(F.transform("boxes", lambda b, i: F.struct(b["y"].alias("y"), i.alias("i"), b["x"].alias("x"), b["height"].alias("height"), b["box_no"].alias("box_no"))))

    def place(state: Column, box: Column) -> Column:
        centre = box["y"] + F.floor(box["height"] / 2).cast("int")
        same = (state["row"] >= 0) & (F.abs(centre - state["at"]) < F.col("reach"))
        row = F.when(same, state["row"]).otherwise(state["row"] + 1)
        spot = F.struct(row.alias("row"), box["x"].alias("x"), F.size(state["out"]).alias("nth"), box["box_no"].alias("box_no"))
        return F.struct(row.alias("row"), F.when(same, state["at"]).otherwise(centre).alias("at"), F.array_append(state["out"], spot).alias("out"))

    none = F.array().cast("array<struct<row: int, x: int, nth: int, box_no: int>>")
    start = F.struct(F.lit(-1).alias("row"), F.lit(0).alias("at"), none.alias("out"))
    found = _per_picture(boxes).withColumn("reach", reach).withColumn("down", down)
    placed = found.select("image_id", F.posexplode(F.array_sort(F.aggregate("down", start, place, lambda s: s["out"]))).alias("position", "o"))
    return placed.select("image_id", "o.box_no", "o.row", "position")


def region_text(words: DataFrame, least: float = 60.0) -> DataFrame:
    """image_id, region, seq, word, confidence -> the region's text and mean confidence (0 to 1), without empty ones."""
    kept = words.where((F.col("confidence") >= least) & (F.trim("word") != ""))
    return kept.groupBy("image_id", "region").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "word"))), lambda w: w["word"]), " ").alias("text"),
        F.round(F.avg("confidence") / 100, 6).alias("confidence"),
    )


def confidence(regions: DataFrame, low: float = 0.65) -> DataFrame:
    mean = F.avg("confidence")
    return regions.groupBy("image_id").agg(F.round(mean, 4).alias("confidence"), ocr_level(F.round(mean, 4)).alias("level"), F.count_if(F.col("confidence") < low).alias("low_confidence"))


def word_confidence(x: Column) -> Column:
    """Mean of the confidences that were given; -1 means none was."""
    return F.avg(F.when(x >= 0, x))


def best_version(tries: DataFrame, key: str) -> DataFrame:
    """The try with the highest confidence among those with text, the first on ties."""
    kept = tries.where(F.trim("text") != "")
    return kept.groupBy(key).agg(F.max_by(F.struct("version", "text"), F.struct("confidence", -F.col("version"))).alias("best")).select(key, "best.version", "best.text")


def text_confidence(words: Column, found: Column, total: Column) -> Column:
    """0.6 of a score for length and 0.4 of the share of fields found, cut to a whole number."""
    length = F.when(words >= 100, 100).when(words >= 50, 80).when(words >= 20, 60).otherwise(words * 2)
    share = F.least(F.lit(100.0), found / total * 100)
    return F.floor(length * 0.6 + share * 0.4 + 1e-9).cast("int")

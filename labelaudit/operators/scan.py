"""The whole scan of one product, the picture audit that follows OCR, and the small gates around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelaudit.functions import explain
from labelaudit.functions import extract as E
from labelaudit.functions import text as X
from labelaudit.operators import regions as G
from labelaudit.operators import scoring as S
from labelaudit.operators.audits import once
from labelaudit.operators.clauses import with_clauses

def scan(products: DataFrame, clauses: DataFrame, k: int = 3) -> DataFrame:
    """products (key, product_name, text) -> the four simple fields, violations of the four static rules, clauses,
    explanation, score and risk. The key takes the place of a random id."""
    fields = once(products, **E.simple_fields(F.col("text")))
    names = ("mrp", "quantity", "manufacturer", "country_of_origin")
    found = once(fields, violations=S.simple_violations({n: F.col(n) for n in names}))
    found = with_clauses(found, clauses, F.concat_ws(" ", "product_name", "text"), k)
    score = S.penalty_score(F.transform("violations", lambda v: v["penalty"]))
    return found.select("key", *names, "violations", "clauses", explain.explained(F.col("violations")).alias("explanation"), score.alias("score"), S.legacy_risk(score).alias("risk"))


def picture_scan(regions: DataFrame, keep: list[str]) -> DataFrame:
    """Regions (image_id, region, text, confidence, and the columns in `keep`, which are one value a picture) ->
    what follows OCR: the text in reading order, confidence, its level and whether someone must look."""
    parts = F.array_sort(F.collect_list(F.struct("region", "text", "confidence")))
    # summed in the order of the regions, so that a mean on the edge of a level doesn't hang on who came first
    known = F.filter(F.transform(parts, lambda r: r["confidence"]), lambda c: c.isNotNull())
    mean = F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda s, c: s + c.cast("double")) / F.size(known))
    level = S.ocr_level(mean)
    return regions.groupBy("image_id", *keep).agg(
        F.array_join(F.transform(parts, lambda r: r["text"]), " ").alias("combined_text"),
        F.count("*").cast("int").alias("regions_processed"),
        F.count_if(F.col("confidence") < 0.65).cast("int").alias("low_confidence_regions"),
        F.round(mean, 4).alias("confidence_score"),
        level.alias("confidence_level"),
        level.isin("LOW_CONFIDENCE", "VERY_LOW_CONFIDENCE").alias("needs_review"),
    )


def picture_audit(regions: DataFrame, category: str = "category") -> DataFrame:
    """`picture_scan` with the fields read from the combined text."""
    found = picture_scan(regions, [category])
    return once(found, **E.region_fields(F.col("combined_text"), F.col(category)))


def text_confidence(text: Column, fields: dict[str, Column], category: Column) -> Column:
    """The confidence of a text audit: 0 without text, else length and the share of the fields that are there."""
    there = sum(F.coalesce(f.cast("string") != "", F.lit(False)).cast("int") if name != "net_quantity_unit_valid" else f.cast("int") for name, f in fields.items())
    total = F.when(category.isin("food", "electronics"), 14).when(category == "cosmetics", 12).otherwise(6)
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit(0)).otherwise(G.text_confidence(X.word_count(text), there, total))


#: What `merged_entities` reads of each side.
FROM_OCR = ("fssai", "mrp", "dates", "net_weight", "batch_number", "country_of_origin")
FROM_ENTITIES = ("fssai", "dates")


def merged_entities(ocr: Column, found: Column) -> dict[str, Column]:
    """The seven rule fields of a picture: OCR's own fields, with an entity of the same name where OCR has none.
    Only licence and dates go by one name in both."""
    dated = ocr["dates"]["expiry_date"].isNotNull() | ocr["dates"]["manufacturing_date"].isNotNull() | ocr["dates"]["shelf_life_months"].isNotNull()
    date = lambda n: F.when(dated, ocr["dates"][n]).otherwise(found["dates"][n]["parsed"])
    return {
        "fssai": F.coalesce(ocr["fssai"]["value"], found["fssai"]["value"]),
        "mrp": ocr["mrp"]["value"],
        "expiry_date": date("expiry_date"),
        "manufacturing_date": date("manufacturing_date"),
        "net_weight": ocr["net_weight"]["value"],
        "batch": ocr["batch_number"],
        "country": ocr["country_of_origin"],
    }


# --- gates and small steps ----------------------------------------------------------------------------------


def readable(text: Column) -> Column:
    """Whether a picture's text is worth keeping."""
    return F.length(X.strip(F.coalesce(text, F.lit("")))) > 5


def joined_texts(texts: DataFrame, key: str, order: str, text: str = "text") -> DataFrame:
    """One text per key of those worth keeping, a line each, by position and not by who came first."""
    kept = texts.where(readable(F.col(text))).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, text))).alias("t"))
    return kept.select(key, F.array_join(F.transform("t", lambda x: x[text]), "\n").alias("text"))


def first_pictures(pictures: DataFrame, key: str, arrived: str, picture: str, most: int = 20) -> DataFrame:
    """key, pictures: the first of each key in order of arrival. Each task passes on `most` of a key at most."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(arrived))
    first = pictures.withColumn("__rank", rank).where(F.col("__rank") <= most)
    ordered = F.array_sort(F.collect_list(F.struct("__rank", F.col(picture).alias("p"))))
    return first.groupBy(key).agg(F.transform(ordered, lambda x: x["p"]).alias("pictures"))


def usable_picture(content_type: Column, size: Column) -> Column:
    """Not what is too small for a picture: under 500 bytes, or under 1000 without a picture's type."""
    typed = F.coalesce(F.contains(F.lower(content_type), F.lit("image")), F.lit(False))
    return (size >= 500) & (typed | (size >= 1000))


def title_or(title: Column, name: Column) -> Column:
    return F.coalesce(F.when(title != "", title), name)


def counter_id(prefix: str, width: int, number: Column) -> Column:
    return F.concat(F.lit(prefix), F.lpad(number.cast("string"), width, "0"))


def found_fields(fields: dict[str, Column]) -> tuple[Column, Column]:
    """The names of the fields that are there and of those that are not."""
    there = {n: F.coalesce(~c.cast("string").isin("", "false", "0"), F.lit(False)) for n, c in fields.items()}
    pick = lambda want: F.array_compact(F.array(*[F.when(t == F.lit(want), F.lit(n)) for n, t in there.items()]))
    return pick(True), pick(False)


def refuse_over(limit: int, what: str, n: Column) -> Column:
    """An error message where a request holds too many; nothing is cut off."""
    return F.when(n > limit, F.concat(F.lit(f"Maximum {limit} {what} allowed, got "), n.cast("string")))


def language_codes(asked: Column, codes: dict[str, str], installed: list[str]) -> Column:
    """Codes of the languages that are known and installed, joined by +, else eng."""
    table = F.create_map(*[F.lit(v) for kv in codes.items() for v in kv])
    mine = F.filter(F.transform(asked, lambda x: F.try_element_at(table, F.lower(x))), lambda c: c.isNotNull() & c.isin(*installed))
    return F.when(F.size(mine) > 0, F.array_join(mine, "+")).otherwise("eng")


# Languages of the OCR engine, the fields and levels it reports, categories and their search words.
LANGUAGES = {
    "english": "eng", "hindi": "hin", "tamil": "tam", "telugu": "tel", "kannada": "kan", "marathi": "mar", "bengali": "ben", "gujarati": "guj",
    "punjabi": "pan", "malayalam": "mal", "odia": "ori", "assamese": "asm", "sanskrit": "san", "urdu": "urd", "nepali": "nep",
}
SUPPORTED_FIELDS = (
    ("mrp", "Maximum Retail Price (₹)", "all"),
    ("net_quantity", "Net weight/volume (g, kg, ml, L)", "all"),
    ("manufacture_date", "Date of manufacture/packing", "all"),
    ("expiry_date", "Expiry/Best before date", "all"),
    ("country_of_origin", "Country where product was made", "all"),
    ("manufacturer", "Manufacturer/Packer name and address", "all"),
    ("importer", "Importer details (for imported products)", "all"),
    ("consumer_care", "Consumer helpline/contact number", "all"),
    ("batch_number", "Batch/Lot number", "all"),
    ("fssai_license", "FSSAI License number (14 digits)", "food"),
    ("bis_certification", "BIS/ISI certification number", "electronics"),
)
SEARCH_WORDS = {
    "food_oil": ("sunflower oil", "cooking oil", "edible oil", "mustard oil", "groundnut oil"),
    "food_packaged": ("packaged food", "snacks", "biscuits", "noodles", "ready to eat"),
    "electronics": ("mobile phone", "laptop", "headphones", "charger", "power bank"),
    "cosmetics": ("face cream", "shampoo", "soap", "lotion", "skincare"),
    "imported_goods": ("imported", "foreign brand"),
    "household": ("detergent", "cleaning", "kitchen appliance"),
    "beverages": ("juice", "soft drink", "energy drink", "packaged water"),
}
CATEGORY_NAMES = {
    "food": ("Food & Edibles", "Packaged food items, edible oils, beverages, snacks"),
    "electronics": ("Electronics & Electrical", "Mobile phones, laptops, chargers, appliances, gadgets"),
    "cosmetics": ("Cosmetics & Personal Care", "Skincare, haircare, makeup, toiletries, personal hygiene products"),
    "generic": ("General Products", "Default rules for unspecified product categories"),
}

"""Open payloads: walking JSON to any depth, and what listings' attributes say of contacts, houses and images."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwellgraph.functions.text import CONTACT_KEYS, contact_tokens, norm_text
from dwellgraph.operators.lineage import cut

#: Attributes that hold a house number, the images that a duplicate group of examples has, and lengths of hashes in hex.
HOUSE_KEYS = ("building_number", "house_number", "будинок")
GROUP_IMAGES = 2
EXACT_LENGTH, VISUAL_LENGTH = 64, 16


def strings(rows: DataFrame, key: str, json: str) -> DataFrame:
    """(key, path, value) of every text within the JSON of each row; path is the keys on the way, in lower case, each behind a dot.

    Items of a list have the list's path. The payload is a VARIANT that is opened level by level, all rows at once, until
    nothing is left to open, so any depth is reached. What is no JSON, and a null, has no texts. Repeated rows
    have theirs each.
    """
    level = cut(rows.select(F.col(key).alias("id"), F.lit("").alias("path"), F.try_parse_json(F.col(json)).alias("v")).where("v is not null"))
    spark, found = rows.sparkSession, []
    while True:
        kind = F.schema_of_variant("v")
        found.append(level.where(kind == "STRING").select("id", "path", F.variant_get("v", "$", "string").alias("value")))
        open_ = level.where(kind.startswith("OBJECT") | kind.startswith("ARRAY"))
        # An item of a list has no key of its own.
        step = F.when(F.col("key").isNull(), F.col("path")).otherwise(F.concat("path", F.lit("."), F.lower("key")))
        each = open_.lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).select("id", step.alias("path"), F.col("value").alias("v"))
        level = cut(each.where("v is not null"))
        if level.isEmpty():
            return reduce(DataFrame.union, found).withColumnRenamed("id", key)


def contacts(rows: DataFrame, key: str, json: str) -> DataFrame:
    """(key, tokens): the distinct contact tokens of the texts whose path names a contact (see text.contact_tokens)."""
    named = reduce(lambda a, b: a | b, [F.contains("path", F.lit(k)) for k in CONTACT_KEYS])
    each = strings(rows, key, json).where(named).select(key, F.explode(contact_tokens(F.col("value"))).alias("token"))
    return each.groupBy(key).agg(F.array_sort(F.collect_set("token")).alias("tokens"))


def house_number(json: Column) -> Column:
    """The first house number among the attributes, normalised and without spaces; '' without one."""
    # Most payloads name none, and nothing is normalised for them.
    said = [F.get_json_object(json, f"$['{k}']") for k in HOUSE_KEYS]
    values = [F.when(x.isNotNull(), norm_text(x)) for x in said]
    return F.left(F.coalesce(*[F.when(v != "", F.replace(v, F.lit(" "), F.lit(""))) for v in values], F.lit("")), F.lit(32))


def image_hashes(json: Column) -> tuple[Column, Column]:
    """(exact, visual): hashes of images that the attributes name; broken ones are passed over.

    They are those of trusted_image_hashes (sha256, dhash), those shared by a group of example duplicates, and
    demo_image_hashes are not among them.
    """
    trusted = F.from_json(F.get_json_object(json, "$.trusted_image_hashes"), "array<struct<sha256:string,dhash:string>>")
    valid = lambda v, n: F.when(F.lower(F.trim(v)).rlike(f"^[0-9a-f]{{{n}}}$"), F.lower(F.trim(v)))
    given = lambda name, n: F.array_compact(F.transform(F.coalesce(trusted, F.array().cast("array<struct<sha256:string,dhash:string>>")), lambda x: valid(x[name], n)))
    group = F.get_json_object(json, "$.demo_duplicate_group")
    made = lambda what, n: F.when(F.coalesce(group, F.lit("")) != "", F.array(*[F.left(F.sha2(F.concat(group, F.lit(f":{what}:{i}")), 256), F.lit(n)) for i in range(GROUP_IMAGES)])).otherwise(F.array().cast("array<string>"))
    return F.concat(given("sha256", EXACT_LENGTH), made("image", EXACT_LENGTH)), F.concat(given("dhash", VISUAL_LENGTH), made("visual", VISUAL_LENGTH))

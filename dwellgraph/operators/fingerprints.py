"""Fingerprints of listings: what duplicates are looked for by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwellgraph.functions import nested
from dwellgraph.functions import text as t


def image_hashes(*urls: Column) -> Column:
    """The SHA-256 of each image's canonical address, distinct and in order; blank and broken addresses are passed over."""
    return url_hashes(*[t.canonical_url(u) for u in urls])


def url_hashes(*canonical: Column) -> Column:
    """image_hashes of addresses that are canonical already."""
    named = [F.when(u != "", F.sha2(F.concat(F.lit("url:"), u), 256)) for u in canonical]
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*named))))


def fingerprints(listings: DataFrame, *, url: str | None = None, images: tuple[str, ...] = ("image_one", "image_two"), perceptual: str | None = "perceptual", attributes: str = "attributes", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per listing with its keys: city, url, contacts, address, place, attributes, price, images and text.

    Empty keys are '' and never match. contacts and exact are arrays of hashes, perceptual one of 64-bit
    hashes in hex. A column of attributes (JSON), if there is one, adds contacts at any depth of it, a house number
    and images. body is the normalised title and description, simhash its hash and text_block the first
    16 bits of that. Columns of keep are kept as they are. The listings are dealt out by their ids, for
    few files would make few tasks of long ones.
    """
    listings = listings.repartition("id")
    street, title, description = (t.norm_text(F.col(c)) for c in ("street", "title", "description"))
    named = listings.withColumns({"n_city": t.norm_text(F.col("city")), "n_district": t.norm_text(F.col("district")), "n_street": street, "n_title": title, "n_description": description})
    tokens = F.array_distinct(F.concat(t.contact_tokens(F.col("description")), t.contact_tokens(F.col("title"))))
    house, exact, visual = F.lit(""), F.array().cast("array<string>"), F.array().cast("array<string>")
    if attributes in listings.columns:
        house = nested.house_number(F.col(attributes))
        exact, visual = nested.image_hashes(F.col(attributes))
        found = nested.contacts(listings, "id", attributes).withColumnRenamed("tokens", "named_contacts")
        named = named.join(found, "id", "left")
        tokens = F.array_distinct(F.concat(tokens, F.coalesce("named_contacts", F.array().cast("array<string>"))))
    named = named.withColumns({"house": house, "building": F.left(t.building_number(F.col("n_street"), F.col("n_title"), F.col("n_description")), F.lit(32)), "geo_key": t.geo_key(F.col("lat"), F.col("lon"), F.col("rooms"))})
    area = (F.bround(F.coalesce("total_area", F.lit(0)) / 5) * 5).cast("bigint")
    kinds = [t.norm_text(F.col(c)) for c in ("deal_type", "property_type")]
    fit_out = [t.norm_text(F.col(c)) for c in ("building_type", "renovation_level", "heating_type")]
    floors = [F.coalesce(F.col(c), F.lit(0)) for c in ("floor", "floors_total")]
    named = named.withColumn("building", F.when(F.col("house") != "", F.col("house")).otherwise(F.col("building")))
    # Made once, as the hashes read each twice.
    named = named.withColumns({f"n_image_{i}": t.canonical_url(F.col(c)) for i, c in enumerate(images)})
    own = F.array_compact(F.array(F.col(perceptual) if perceptual else F.lit(None).cast("string")))
    body = F.trim(F.concat_ws(" ", "n_title", "n_description"))
    told = named.select(
        "id",
        F.col("n_city").alias("city_key"),
        (t.canonical_url(F.col(url)) if url else F.lit("")).alias("url_key"),
        t.token_hashes(tokens).alias("contacts"),
        t.address_key(F.col("n_city"), F.col("n_district"), F.col("n_street"), F.col("building"), F.col("geo_key")).alias("address_key"),
        "geo_key",
        "building",
        t.joined_key(*kinds, F.col("rooms"), area, *floors, *fit_out).alias("attribute_key"),
        F.greatest(F.lit(0), F.floor(F.col("price_uah") / 1000)).alias("price_bucket"),
        F.array_sort(F.array_distinct(F.concat(url_hashes(*[F.col(f"n_image_{i}") for i in range(len(images))]), exact))).alias("exact"),
        F.array_sort(F.array_distinct(F.concat(own, visual))).alias("perceptual"),
        body.alias("body"),
        *keep,
    )
    told = told.withColumn("simhash", t.simhash64(F.col("body")))
    return told.withColumn("text_block", F.left("simhash", F.lit(4)))


def stale(current: DataFrame, listings: DataFrame, *, version: int, image_version: int) -> DataFrame:
    """The ids of listings without a fingerprint, with one of another version of texts or images, or with one older than their last update."""
    kept = current.select("id", F.col("version").alias("v"), F.col("image_version").alias("i"), F.col("computed_at").alias("at"))
    old = F.col("v").isNull() | (F.col("v") != version) | ~F.col("i").eqNullSafe(F.lit(image_version)) | (F.col("at") < F.col("updated_at"))
    return listings.select("id", "updated_at").join(kept, "id", "left").where(old).select("id")

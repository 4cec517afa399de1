"""Geography as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwellgraph.operators.lineage import cut

EARTH_METRES = 6_371_000.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres between two points on a sphere."""
    half = lambda x: F.sin(x / 2) * F.sin(x / 2)
    a = half(F.radians(lat2 - lat1)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(F.radians(lon2 - lon1))
    return 2 * EARTH_METRES * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


#: The WGS 84 ellipsoid's larger half axis and flattening.
AXIS, FLATTENING = 6_378_137.0, 1 / 298.257223563
_STEPS = 20


def geodesic(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres between two points on the WGS 84 ellipsoid, by Vincenty's inverse formula; null if either is unknown.

    Below a millimetre off, except for points nearly opposite on the globe, where the formula finds no end.
    """
    f, minor = FLATTENING, AXIS * (1 - FLATTENING)
    u1, u2 = (F.atan((1 - f) * F.tan(F.radians(x))) for x in (lat1, lat2))
    base = F.struct(F.sin(u1).alias("s1"), F.cos(u1).alias("c1"), F.sin(u2).alias("s2"), F.cos(u2).alias("c2"), F.radians(lon2 - lon1).alias("d"))

    def arc(b: Column, turn: Column) -> dict[str, Column]:
        """The arc for a difference of longitude on the auxiliary sphere: its sine, cosine, azimuth and midpoint."""
        across = b["c2"] * F.sin(turn)
        along = b["c1"] * b["s2"] - b["s1"] * b["c2"] * F.cos(turn)
        sine = F.sqrt(across * across + along * along)
        cosine = b["s1"] * b["s2"] + b["c1"] * b["c2"] * F.cos(turn)
        azimuth = F.when(sine == 0, 0.0).otherwise(b["c1"] * b["c2"] * F.sin(turn) / sine)
        square = 1 - azimuth * azimuth
        middle = F.when(square <= 1e-15, 0.0).otherwise(cosine - 2 * b["s1"] * b["s2"] / square)
        return {"sine": sine, "cosine": cosine, "azimuth": azimuth, "square": square, "middle": middle}

    def step(b: Column, turn: Column) -> Column:
        a = F.transform(F.array(F.struct(*[v.alias(k) for k, v in arc(b, turn).items()])), lambda a: b["d"] + (1 - curve(a)) * f * a["azimuth"] * (F.atan2(a["sine"], a["cosine"]) + curve(a) * a["sine"] * (a["middle"] + curve(a) * a["cosine"] * (2 * a["middle"] * a["middle"] - 1))))
        return a[0]

    def curve(a: Column) -> Column:
        return f / 16 * a["square"] * (4 + f * (4 - 3 * a["square"]))

    def length(a: Column) -> Column:
        u = a["square"] * ((AXIS / minor) ** 2 - 1)
        big = 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u)))
        small = u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))
        m = a["middle"]
        fix = small * a["sine"] * (m + small / 4 * (a["cosine"] * (2 * m * m - 1) - small / 6 * m * (4 * a["sine"] * a["sine"] - 3) * (4 * m * m - 3)))
        return minor * big * (F.atan2(a["sine"], a["cosine"]) - fix)

    # Each value is made once, as the only element of an array, and the turn is found in a fixed number of steps.
    def measured(b: Column) -> Column:
        turn = F.aggregate(F.sequence(F.lit(1), F.lit(_STEPS)), b["d"], lambda t, _: step(b, t))
        arcs = F.transform(F.array(turn), lambda t: F.struct(*[v.alias(k) for k, v in arc(b, t).items()]))
        return F.transform(arcs, length)[0]

    known = lat1.isNotNull() & lon1.isNotNull() & lat2.isNotNull() & lon2.isNotNull()
    return F.when(known, F.transform(F.array(base), measured)[0])


def in_box(lat: Column, lon: Column, box: str) -> Column:
    """Whether a point lies in west,south,east,north; the text is checked here."""
    parts = [float(x) for x in box.split(",")]
    if len(parts) != 4:
        raise ValueError("a box has four numbers")
    west, south, east, north = parts
    if not (-180 <= west < east <= 180 and -90 <= south < north <= 90):
        raise ValueError("the box is empty or outside the world")
    return lon.between(west, east) & lat.between(south, north)


def cell(lat: Column, lon: Column, degrees: float) -> tuple[Column, Column]:
    return F.floor(lat / degrees), F.floor(lon / degrees)


#: The places that the offline geocoder knows, with their centres.
CENTRES = {"львів": (49.839683, 24.029717), "рівне": (50.619900, 26.251617), "київ": (50.450100, 30.523400)}


def offline_point(query: Column) -> tuple[Column, Column]:
    """Latitude and longitude near the centre of the first known place in the query; nulls if it names none.

    The offset comes from the first two 16-bit numbers of the lower-cased query's SHA-256.
    """
    name = F.lower(query)
    part = lambda at: F.conv(F.substring(F.sha2(name, 256), at, 4), 16, 10).cast("double") / 65535 - 0.5
    centre = lambda i: F.coalesce(*[F.when(F.contains(name, F.lit(place)), F.lit(at[i])) for place, at in CENTRES.items()])
    return F.round(centre(0) + part(1) * 0.035, 6), F.round(centre(1) + part(5) * 0.05, 6)


def kilometres(metres: Column) -> Column:
    """Kilometres to two places, half up."""
    return F.round(metres / 1000, 2)


def valid_point(lat: Column, lon: Column) -> Column:
    """Whether both coordinates are given and on the globe."""
    return F.coalesce(lat.between(-90, 90) & lon.between(-180, 180), F.lit(False))


def quantised(lat: Column, lon: Column, places: int = 6) -> tuple[Column, Column]:
    """Coordinates to so many places, half even; null if they are no valid point."""
    return tuple(F.when(valid_point(lat, lon), F.bround(x, places)) for x in (lat, lon))


def bounds(rows: DataFrame, *groups: str, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """(groups, west, south, east, north) of the valid points; no row for a group without any."""
    inside = rows.where(valid_point(F.col(lat), F.col(lon)))
    return inside.groupBy(*groups).agg(F.min(lon).alias("west"), F.min(lat).alias("south"), F.max(lon).alias("east"), F.max(lat).alias("north"))


def features(rows: DataFrame, properties: list[str], *, key: str = "id", lat: str = "lat", lon: str = "lon") -> DataFrame:
    """(key, feature): each row as a GeoJSON feature; rows without a valid point are left out."""
    point = F.struct(F.lit("Point").alias("type"), F.array(F.col(lon), F.col(lat)).alias("coordinates"))
    told = F.to_json(F.struct(F.lit("Feature").alias("type"), F.col(key).alias("id"), point.alias("geometry"), F.struct(*properties).alias("properties")))
    return rows.where(valid_point(F.col(lat), F.col(lon))).select(key, told.alias("feature"))


def read_point(feature: Column) -> Column:
    """(lat, lon) of the text of a GeoJSON feature with a valid point; null for any other text."""
    told = F.from_json(feature, "type string, geometry struct<type:string,coordinates:array<double>>")
    at = told["geometry"]["coordinates"]
    lat, lon = F.get(at, F.lit(1)), F.get(at, F.lit(0))
    good = (told["type"] == "Feature") & (told["geometry"]["type"] == "Point") & (F.size(at) == 2) & valid_point(lat, lon)
    return F.when(F.coalesce(good, F.lit(False)), F.struct(lat.alias("lat"), lon.alias("lon")))


def write_features(rows: DataFrame, path: str, properties: list[str], **names) -> None:
    """Write the rows' features as GeoJSON text sequences, one feature a line."""
    features(rows, properties, **names).select("feature").write.mode("overwrite").text(path)


#: A cell with more points is split into four, until it is so many times smaller.
CROWDED, SPLITS = 2_000, 12


def within(points: DataFrame, places: DataFrame, km: float, *, metres=haversine, crowded: int = CROWDED) -> DataFrame:
    """(place, id, km) of the points within km kilometres of each place, by cells that split where points are many.

    Both tables have lat and lon; places has place, points id. metres is the distance, on a sphere or an ellipsoid.
    A place looks into the cells around its own, about km wide. A cell with more than crowded points is split into
    four, and again, so that no task has more of one cell's points (but for many at one place), and a place
    meets only those parts of it that its circle reaches.
    """
    size = km / 110.5  # a degree of latitude is no shorter, on the sphere or the ellipsoid
    reach = F.ceil(F.lit(1.0) / F.greatest(F.cos(F.radians("plat")), F.lit(0.05))).cast("int")
    around = places.select("place", F.col("lat").alias("plat"), F.col("lon").alias("plon")).where(valid_point(F.col("plat"), F.col("plon")))
    around = around.withColumn("cy", F.explode(F.sequence(F.floor(F.col("plat") / size) - 1, F.floor(F.col("plat") / size) + 1)))
    around = around.withColumn("cx", F.explode(F.sequence(F.floor(F.col("plon") / size) - reach, F.floor(F.col("plon") / size) + reach)))
    placed = points.where(valid_point(F.col("lat"), F.col("lon"))).select("id", "lat", "lon", F.floor(F.col("lat") / size).alias("cy"), F.floor(F.col("lon") / size).alias("cx"))
    far = metres(F.col("plat"), F.col("plon"), F.col("lat"), F.col("lon"))
    found = []
    for level in range(SPLITS + 1):
        full = placed.groupBy("cy", "cx").agg(F.count("*").alias("n")).where(F.col("n") > crowded).select("cy", "cx") if level < SPLITS else None
        full = None if full is None else cut(full)
        wide = full is not None and not full.isEmpty()
        now, seen = (placed.join(full, ["cy", "cx"], "left_anti"), around.join(full, ["cy", "cx"], "left_anti")) if wide else (placed, around)
        found.append(now.join(seen, ["cy", "cx"]).withColumn("m", far).where(F.col("m") <= km * 1000).select("place", "id", kilometres(F.col("m")).alias("km")))
        if not wide:
            break
        # One level down; of a place's parts those that its circle can't reach are dropped, by latitude and by longitude.
        size /= 2
        placed = cut(placed.join(full, ["cy", "cx"], "left_semi").select("id", "lat", "lon", F.floor(F.col("lat") / size).alias("cy"), F.floor(F.col("lon") / size).alias("cx")))
        split = around.join(full, ["cy", "cx"], "left_semi").withColumn("dy", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("dx", F.explode(F.array(F.lit(0), F.lit(1))))
        split = split.select("place", "plat", "plon", (2 * F.col("cy") + F.col("dy")).alias("cy"), (2 * F.col("cx") + F.col("dx")).alias("cx"))
        gap = lambda cell, at: F.greatest(F.col(cell) * size - F.col(at), F.col(at) - (F.col(cell) + 1) * size, F.lit(0.0))  # noqa: E731, B023
        # The farthest from the equator that the circle comes has the shortest degrees of longitude.
        near = F.cos(F.radians(F.least(F.abs("plat") + km / 110.5, F.lit(89.9))))
        around = cut(split.where((gap("cy", "plat") * 110.5 <= km) & (gap("cx", "plon") * 110.5 * near <= km)))
    return reduce(DataFrame.union, found)

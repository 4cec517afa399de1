"""Joins that no hot district or cell makes wide, and distances on the ellipsoid."""

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from dwellgraph.functions import geo


def metres(spark, a, b):
    return spark.range(1).select(geo.geodesic(*[F.lit(float(x)) for x in (*a, *b)])).first()[0]


def test_geodesic_golden(spark):
    """Published distances on the ellipsoid."""
    assert abs(metres(spark, (40.6, -73.8), (51.6, -0.5)) - 5551759.400) < 0.01
    dms = lambda d, m, s: math.copysign(abs(d) + m / 60 + s / 3600, d)
    assert abs(metres(spark, (dms(-37, 57, 3.72030), dms(144, 25, 29.52440)), (dms(-37, 39, 10.15610), dms(143, 55, 35.38390))) - 54972.271) < 0.01
    assert metres(spark, (50, 30), (50, 30)) == 0 and abs(metres(spark, (0, 0), (0, 1)) - 111319.491) < 0.001 and abs(metres(spark, (0, 0), (1, 0)) - 110574.389) < 0.001
    assert spark.range(1).select(geo.geodesic(F.lit(None).cast("double"), F.lit(1.0), F.lit(1.0), F.lit(1.0))).first()[0] is None


def on_sphere(a, b):
    la, lo, lb, lp = map(math.radians, (*a, *b))
    return 2 * 6_371_000 * math.asin(math.sqrt(min(1, math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((lp - lo) / 2) ** 2)))


@pytest.mark.parametrize("crowded", [2000, 15])
def test_crowded_cells_are_split(spark, crowded):
    """Half of the points in one cell, some at one place, and far north."""
    rng = random.Random(2)
    at = [(49.84 + rng.gauss(0, 0.002), 24.03 + rng.gauss(0, 0.002)) for _ in range(150)] + [(49.84, 24.03)] * 30 + [(rng.uniform(49, 51), rng.uniform(23, 25)) for _ in range(150)] + [(69.6 + rng.gauss(0, 0.05), 18.9 + rng.gauss(0, 0.1)) for _ in range(60)]
    points = spark.createDataFrame([(i, *p) for i, p in enumerate(at)] + [(900, None, 1.0), (901, 99.0, 1.0)], "id int, lat double, lon double")
    spots = [("a", 49.841, 24.031), ("b", 49.9, 24.2), ("c", 69.62, 18.95), ("d", None, None)]
    places = spark.createDataFrame(spots, "place string, lat double, lon double")
    got = {(r.place, r.id) for r in geo.within(points, places, 5.0, crowded=crowded).collect()}
    assert got == {(n, i) for n, la, lo in spots[:3] for i, p in enumerate(at) if on_sphere((la, lo), p) <= 5000} and len(got) > 150
    real = {(r.place, r.id): r.km for r in geo.within(points, places, 5.0, metres=geo.geodesic, crowded=crowded).collect()}
    assert abs(len(real) - len(got)) < 10 and all(abs(real[k] - on_sphere(next((la, lo) for n, la, lo in spots if n == k[0]), at[k[1]]) / 1000) < 0.03 for k in real)


@pytest.mark.parametrize("most", [4, 120])
def test_hot_district_equals_plain_reading(spark, most):
    """All listings in one district; areas with and without fractions, unknown, and beyond the tree."""
    from dwellgraph.operators import market

    rng = random.Random(6)
    now = datetime.datetime(2024, 1, 31)
    rows = [(i, "A", "d", 1, rng.choice([9000, 9500, 10000]), rng.choice([None, 0.0, 30.0, 40.05, 5000.0, 5100.0, float(rng.randrange(20, 120)), rng.uniform(20, 120)]), "", "", now - datetime.timedelta(days=rng.randrange(20)), None, None, i // 3 if i % 6 < 3 else None, ("primary" if i % 3 == 0 else "duplicate") if i % 6 < 3 else None) for i in range(300)]
    t = spark.createDataFrame(rows, "id bigint, city string, district string, rooms bigint, price_uah bigint, total_area double, building_type string, renovation_level string, published_at timestamp, lat double, lon double, cluster bigint, role string")
    got = {}
    for r in market.comparables(t, t, now, least=2, most=most).where("stage = 'district_rooms_area'").collect():
        got.setdefault(r.target, (set(), r.candidates))[0].add(r.id)
    for target in rows:
        area = target[5]
        fits = [r for r in rows if r[0] != target[0] and (r[12] in (None, "primary")) and not (r[11] is not None and r[11] == target[11]) and (not area or (r[5] is not None and area * (1 - 20 / 100) <= r[5] <= area * (1 + 20 / 100)))]
        fits.sort(key=lambda r: (-r[8].timestamp(), r[4], r[0]))
        want = ({r[0] for r in fits[:most]}, min(len(fits), most + 1)) if len(fits) >= 2 else None
        assert got.get(target[0]) == want

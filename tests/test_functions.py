import math
import random
from collections import namedtuple

import numpy as np
from pyspark.sql import functions as F

from placerank.config import EARTH_KM
from placerank.functions import attributes, geo, hours, text


def one(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_open_hours(spark):
    cases = [
        # open, close, open the day before, close the day before, minute, expected
        (540, 1050, None, None, 540, True), (540, 1050, None, None, 1050, False),
        (1080, 120, None, None, 1200, True), (None, None, 1080, 120, 60, True),
        (None, None, 1080, 120, 120, False), (0, 0, None, None, 700, True),
        (None, None, None, None, 700, False),
    ]
    found = one(spark, cases, "o int, c int, po int, pc int, m int, e boolean",
                hours.open_at(F.col("o"), F.col("c"), F.col("po"), F.col("pc"), F.col("m")))
    assert found == [c[-1] for c in cases]


def test_packed_hours_use_sunday_before_monday(spark):
    week = [None] * 12 + [1080, 120]
    found = one(spark, [(week, 0, 60), (week, 6, 1200), (week, 1, 60)], "h array<int>, d int, m int",
                hours.packed_open_at(F.col("h"), F.col("d"), F.col("m")))
    assert found == [True, True, False]


def test_hours_text(spark):
    rows = [("9:0-17:30",), ("",), (None,), ("closed",)]
    assert one(spark, rows, "t string", hours.open_minutes(F.col("t"))) == [540, None, None, None]
    assert one(spark, rows, "t string", hours.close_minutes(F.col("t"))) == [1050, None, None, None]


def test_quality(spark):
    rows = [(209, 4.5), (295, 4.0), (207, 4.0), (193, 4.0), (294, 3.5)]
    assert one(spark, rows, "n int, s double", attributes.quality(F.col("n"), F.col("s"))) == [
        47.025, 39.541, 37.089, 36.605, 30.255]


def test_dictionary_text(spark):
    rows = [(None,), ("None",), ("{broken",), ("{u'romantic': False, 'casual': True, \"classy\": None}",)]
    assert one(spark, rows, "t string", text.dict_to_map(F.col("t"))) == [
        None, None, None, {"romantic": False, "casual": True, "classy": None}]
    flags = spark.createDataFrame(rows, "t string").select(*attributes.ambience_flags(F.col("t"))).collect()
    assert [r["Ambience_casual"] for r in flags] == [0, 0, 0, 1]
    assert sum(flags[0]) == 0


def test_labels(spark):
    rows = [("u'loud'",), ("quiet",), ("'None'",), (None,)]
    assert one(spark, rows, "t string", attributes.ordinal_attribute("NoiseLevel", F.col("t"))) == [2, 0, None, None]


def test_durations_and_days(spark):
    assert one(spark, [(65.9,), (0.0,), (None,)], "s double", text.format_duration(F.col("s"))) == ["1m 5s", "N/A", "N/A"]
    assert one(spark, [("monday",), ("SUNDAY",), ("x",)], "d string", text.previous_day(F.col("d"))) == [
        "Sunday", "Saturday", None]
    assert one(spark, [("21:05",), ("",), (None,), ("7",), ("a:b",)], "c string", text.clock_to_minutes(F.col("c"))) == [
        1265, 1260, 1260, 420, 0]


def test_circle_cells_cover_date_line_and_poles(spark):
    circles = [(10.0, 179.95, 30.0), (10.0, -179.95, 30.0), (89.9, 0.0, 50.0), (-89.95, 170.0, 500.0), (0.0, 0.0, 25000.0)]
    points = [(10.0, -179.99), (10.0, 179.99), (10.1, 180.0), (89.95, 178.0), (-88.0, -20.0), (-60.0, 100.0), (9.9, -180.0)]
    c = spark.createDataFrame([(i, *x) for i, x in enumerate(circles)], "c int, clat double, clon double, r double")
    c = c.withColumn("level", geo.circle_level(F.col("clat"), F.col("r")))
    c = c.withColumn("places", geo.circle_cells(F.col("clat"), F.col("clon"), F.col("r"), F.col("level")))
    p = spark.createDataFrame(points, "lat double, lon double").withColumn("cells", geo.point_cells(F.col("lat"), F.col("lon")))
    near = geo.haversine(F.col("lat"), F.col("lon"), F.col("clat"), F.col("clon")) <= F.col("r")
    hit = F.arrays_overlap("places", F.transform("cells", lambda x: x["place"]))
    rows = c.crossJoin(p).select(near.alias("near"), hit.alias("hit")).collect()
    assert all(r.hit for r in rows if r.near) and sum(r.near for r in rows) >= 10
    assert c.select(F.max(F.size("places"))).first()[0] <= 12


def test_haversine_within_equals_haversine(spark):
    """Also on the border itself, a step of a double beside it, and far from where the bounds are close."""
    rng = random.Random(4)
    pairs = [(rng.uniform(-90, 90), rng.uniform(-180, 180), 10 ** rng.uniform(-7, 2.2)) for _ in range(1500)]
    rows = [(a, o, max(-90.0, min(90.0, a + rng.uniform(-d, d))), (o + rng.uniform(-d, d) + 180) % 360 - 180) for a, o, d in pairs]
    rows += [(10.0, 20.0, 10.0, 20.0), (0.0, 0.0, 0.0, 180.0), (90.0, 0.0, -90.0, 0.0), (0.0, 179.99, 0.0, -179.99), (-89.9, 0.0, -90.2, 170.0), (math.nan, 0.0, 0.0, 0.0)]
    lat1, lon1, lat2, lon2 = map(F.col, ("a", "o", "b", "p"))
    cosines = F.cos(F.radians(lat1)), F.cos(F.radians(lat2))
    df = spark.createDataFrame(rows, "a double, o double, b double, p double").withColumn("d", geo.haversine(lat1, lon1, lat2, lon2))
    radii = [F.col("d") * x for x in (1.0, 1 + 2**-52, 1 - 2**-53, 1 + 1e-9, 1 - 1e-9, 0.5, 2.0)] + [F.lit(x) for x in (-1.0, 0.0, 20.0, 9000.0, 20016.0, 50000.0)]
    df = df.withColumn("r", F.explode(F.array(*radii)))
    true, found = F.col("d") <= F.col("r"), geo.haversine_within(lat2 - lat1, lon2 - lon1, *cosines, F.col("r"))
    assert df.count() == len(rows) * len(radii) and df.filter(~true.eqNullSafe(found)).count() == 0
    assert df.filter(~geo.haversine_of(lat2 - lat1, lon2 - lon1, *cosines).eqNullSafe(F.col("d"))).count() == 0


def test_round_km_equals_round(spark):
    rng = random.Random(5)
    values = [10 ** rng.uniform(-9, 5) for _ in range(3000)] + [k / 2e6 for k in range(1, 4000)] + [math.nextafter(k / 2e6, 9e9) for k in range(1, 999, 2)]
    values += [0.0, -0.0, 1.5e-6, -1.2345675, 1e9, 1e17, 1e300, math.inf, math.nan, None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert df.filter(~geo.round_km(F.col("v"), 6).eqNullSafe(F.round("v", 6))).collect() == []


Cell = namedtuple("Cell", "c level row col inside")


def test_covers_hold_circles_and_little_more():
    rng = random.Random(6)
    circles = [(10.0, 179.95, 30.0), (10.0, -179.95, 30.0), (89.9, 0.0, 50.0), (-89.95, 170.0, 500.0), (0.0, 0.0, 25000.0), (5.0, 5.0, 0.0),
               (27.9, -82.4, 5.0), (60.0, 20.0, 300.0), (-45.0, 100.0, 9000.0), (27.9, -82.4, 0.4)]
    circles += [(rng.uniform(-89, 89), rng.uniform(-180, 180), 10 ** rng.uniform(-1, 4)) for _ in range(30)]
    covers = [Cell(*map(int, x)) for x in zip(*geo.circle_cover(*np.array(circles).T))]
    assert {x.c for x in covers if x.inside} >= {0, 4, 6, 7, 8} and {x.c for x in covers} == set(range(len(circles)))
    for i, (clat, clon, radius) in enumerate(circles):
        own = {(x.level, x.row, x.col): x.inside for x in covers if x.c == i}
        assert len(own) == len([x for x in covers if x.c == i]) <= 90
        tested = hits = 0
        points = [(clat, clon)] + [(clat + rng.uniform(-1, 1) * radius / 100, clon + rng.uniform(-1, 1) * radius / 100 / max(0.02, math.cos(math.radians(clat))))
                                   for _ in range(400)]
        for plat, plon in points:
            plat, plon = max(-90.0, min(90.0, plat)), (plon + 180) % 360 - 180
            a = math.sin(math.radians(plat - clat) / 2) ** 2 + math.cos(math.radians(clat)) * math.cos(math.radians(plat)) * math.sin(
                math.radians(plon - clon) / 2) ** 2
            near = 2 * EARTH_KM * math.asin(min(1.0, math.sqrt(a))) <= radius
            at = [v for (level, row, col), v in own.items() if (math.floor(plat / geo.CELL_EDGES[level]), math.floor(plon / geo.CELL_EDGES[level])) == (row, col)]
            assert len(at) <= 1 and (not near or at) and (near or not any(at))
            tested, hits = tested + len(at), hits + near
        if radius > 2 and abs(clat) < 80 and radius < 5000:
            assert tested < 2 * hits

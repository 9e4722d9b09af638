import math

import pytest
from pyspark.sql import functions as F

from roadtrace.functions import geometry as g
from roadtrace.functions import quality as ql
from roadtrace.functions import text as t


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_projections(spark):
    lon, lat = F.lit(30.6), F.lit(50.5)
    x, y = g.project_equirect(lon, lat, 30.52, 50.45)
    assert one(spark, x) == pytest.approx(0.08 * 111320 * math.cos(math.radians(50.45)), abs=1e-9)
    assert one(spark, y) == pytest.approx(0.05 * 111320, abs=1e-6)
    sx, sy = g.project_stereo(lon, lat, 30.52, 50.45)
    back = g.unproject_stereo(sx, sy, 30.52, 50.45)
    assert one(spark, back[0]) == pytest.approx(30.6, abs=1e-9) and one(spark, back[1]) == pytest.approx(50.5, abs=1e-9)
    p1, p2 = math.radians(50.45), math.radians(50.5)
    a = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(0.04)) ** 2
    haversine = 2 * g.RADIUS * math.asin(math.sqrt(a))
    assert math.hypot(one(spark, sx), one(spark, sy)) == pytest.approx(haversine, rel=1e-4)
    assert one(spark, g.unproject_stereo(F.lit(0.0), F.lit(0.0), 30.52, 50.45)[1]) == 50.45


def test_polylines(spark):
    line = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (0, 100), (50, 100))))
    assert one(spark, g.polyline_length(line)) == 150
    for d, at in ((-5, (0, 0)), (30, (0, 30)), (120, (20, 100)), (900, (50, 100))):
        p = one(spark, g.point_at(line, F.lit(float(d))))
        assert (p["x"], p["y"]) == at
    assert one(spark, g.heading_at(line, F.lit(50.0))) == pytest.approx(0) and one(spark, g.heading_at(line, F.lit(130.0))) == pytest.approx(math.pi / 2)
    on = one(spark, g.project_on_polyline(line, F.lit(-3.0), F.lit(40.0)))
    assert (on["error"], on["along"]) == (3, 40)
    assert one(spark, g.angle_difference(F.lit(3.0), F.lit(-3.0))) == pytest.approx(6 - 2 * math.pi)


def test_vehicle_axes(spark):
    upright = F.array(F.lit(0.0), F.lit(-1.0), F.lit(0.0))
    v = one(spark, g.vehicle_axes(upright, F.array(F.lit(0.0), F.lit(0.5), F.lit(-2.0))))
    assert (v["forward"], v["up"]) == (2.0, 0.5) and v["lateral"] == pytest.approx(0)
    assert one(spark, g.vehicle_axes(F.array(F.lit(0.0), F.lit(0.0), F.lit(-1.0)), upright)) is None


PLACES = [
    ("https://maps.example/maps/place/Kava/@50.1,30.2,17z/data=!3d50.4501!4d30.5234", (50.4501, 30.5234)),
    ("https://maps.example/?q=50.45,30.52", (50.45, 30.52)),
    ("https://consent.example/?continue=https%3A%2F%2Fmaps.example%2F%3Fq%3D50.45%252C30.52", (50.45, 30.52)),
    ("https://osm.example/?mlat=49.84&mlon=24.03#map=15/1/2", (49.84, 24.03)),
    ("https://osm.example/#map=15/49.84/24.03", (49.84, 24.03)),
    ("geo:49.84,24.03?z=3", (49.84, 24.03)), ("meet at 49.840, 24.030 ok", (49.84, 24.03)),
    ("49°50'24\"N 24°1'48\"E", (49.84, 24.03)), ("24°1'48\"W 49°50'24\"S", (-49.84, -24.03)),
    ("https://short.example/abc", None), ("Open 24/7 at all times", None), ("geo:0,0", None), ("geo:95,10", None),
]


@pytest.mark.parametrize("text,place", PLACES)
def test_place_from_text(spark, text, place):
    got = one(spark, t.place_from_text(F.lit(text)))
    assert got is None if place is None else (got["lat"], got["lon"]) == pytest.approx(place, abs=1e-4)


def test_names_words_letters(spark):
    assert one(spark, t.place_name(F.lit("https://m.example/maps/place/Caf%C3%A9+Noir/@1,2"))) == "Café Noir"
    assert one(spark, t.place_name(F.lit("https://m.example/maps/place/50.1,30.2/"))) is None
    assert one(spark, t.words(F.lit("L'été à Zürich — été, 2x"))) == ["lete", "a", "zurich", "ete", "2x"]
    assert one(spark, t.words(F.lit("čas ŻAR Київ Йорж c\u0327a va\u0301 ǆ Ất"))) == ["cas", "zar", "киів", "иорж", "ca", "va", "ǆ", "at"]
    for word, latin in (("ЗГУРА зГ 5я з’їзд объём Эхо рыба", "ZGhURA zGh 5ya zizd obiom Ekho ryba"), ("Згурський", "Zghurskyi"), ("Єнакієве", "Yenakiieve"), ("Їжакевич", "Yizhakevych"), ("Знам'янка", "Znamianka"), ("Щорс Юрій", "Shchors Yurii")):
        assert one(spark, t.transliterate(F.lit(word))) == latin
    assert one(spark, t.one_edit_prefix(F.lit("khreshchatyk"), F.lit("khrashc"))) and not one(spark, t.one_edit_prefix(F.lit("abcd"), F.lit("abxd")))
    assert one(spark, t.map_link(F.lit(50.45), F.lit(30.52), F.lit("A b"))) == "geo:50.450000,30.520000?q=A+b"


def test_flags(spark):
    names = ["latitude", "longitude", "timestamp", "age", "horizontal", "altitude", "vertical", "speed", "speed_accuracy", "course", "course_accuracy", "reduced", "simulated", "accessory"]
    fix = lambda *v: ql.gps_flags(F.struct(*(F.lit(x).alias(n) for x, n in zip(v, names, strict=True))))
    nan = float("nan")
    assert one(spark, fix(50.0, 30.0, 9.0, 0.5, 5.0, 100.0, 3.0, 3.0, 1.0, 90.0, 5.0, False, False, False)) == []
    assert one(spark, fix(nan, 30.0, nan, 5.25, 50.0, nan, 3.0, 3.0, 9.0, 360.0, 5.0, True, True, True)) == [
        "invalid_coordinate", "invalid_timestamp", "stale_fix", "poor_horizontal_accuracy", "invalid_altitude", "poor_speed_accuracy", "invalid_course", "reduced_accuracy", "software_simulation", "accessory_source",
    ]
    assert one(spark, fix(50.0, 30.0, 9.0, -2.0, -1.0, 1.0, 1.0, -3.0, 9.0, 90.0, -1.0, False, False, False)) == ["future_fix", "invalid_horizontal_accuracy", "invalid_speed", "invalid_course"]
    vector = lambda *v: F.array(*map(F.lit, v))
    assert one(spark, ql.valid_raw(vector(0.0, 0.1, 0.2), vector(0.0, 0.0, 0.0), vector(0.0, -1.0, 0.0)))
    assert not one(spark, ql.valid_raw(vector(0.0, 0.1), vector(0.0, 0.0, 0.0), vector(0.0, -1.0, 0.0)))
    assert not one(spark, ql.valid_raw(vector(0.0, 0.1, 0.2), vector(0.0, 0.0, 0.0), vector(0.0, -0.2, 0.0)))


def test_places_by_precedence(spark):
    """The most telling form wins, wherever it stands; broken pairs, prices and telephone numbers are none."""
    cases = {
        "geo:50.45,30.52 or https://m.example/@10.1,20.2": (50.45, 30.52), "https://m.example/@1.1,2.2,9z #map=12/50.1/30.2": (50.1, 30.2), "https://m.example/?center=50.4,30.5": (50.4, 30.5),
        "https://m.example/?markers=loc:50.4,30.5": (50.4, 30.5), "https://o.example/?mlat=50.4&amp;mlon=30.5": (50.4, 30.5), "https://m.example/?saddr=1.5,2.5&daddr=3.5,4.5": (3.5, 4.5),
        "https://m.example/?coordinate=91.5,2.5&q=3.5,4.5": (3.5, 4.5), "Call me at 12, 30 tomorrow": None, "12.50, 30.20": None, "at 50.4501 30.5234": (50.4501, 30.5234), "150.4501,30.5234": None,
        "https://s.example/x 50.4501, 30.5234": None, "?q=0.0,0.0": None, "30°31'24\"E, 50°27'N": (50.45, 30.523333), "https://a.example/l?u=https%253A%252F%252Fm.example%252F%2540%3Fll%3D5.5%2C6.5": (5.5, 6.5),
    }
    df = spark.createDataFrame([(k, *(v or (None, None))) for k, v in cases.items()], "t string, lat double, lon double")
    for r in df.withColumn("p", t.place_from_text(F.col("t"))).collect():
        assert (r["p"] is None) == (r["lat"] is None), r["t"]
        assert r["p"] is None or (r["p"]["lat"], r["p"]["lon"]) == pytest.approx((r["lat"], r["lon"]), abs=1e-5), r["t"]
    names = {"https://a.example/?q=Big+House&z=1&ll=1.5,2.5": "Big House", "https://a.example/?ll=1.5,2.5&q=House": None, "https://a.example/?q=1.5,2.5&ll=1.5,2.5": None, "no link": None}
    df = spark.createDataFrame(list(names.items()), "t string, name string")
    assert all(r["got"] == r["name"] for r in df.withColumn("got", t.place_name(F.col("t"))).collect())


def test_landmark_radius_and_names(spark):
    from roadtrace.functions import motion as m

    args = (4.0, 0.5, 0.0001, -0.002, 12.0)
    v, b = max(0.5, 0.15**2), max(0.0001, 0.004**2)
    c = max(-((v * b) ** 0.5), min(-0.002, (v * b) ** 0.5))
    want = 2 * (2 + (v * 144 - c * 12**3 + b * 12**4 / 4 + 0.07**2 * 12**3 / 3 + 0.004**2 * 12**5 / 20) ** 0.5)
    assert one(spark, m.landmark_radius(*map(F.lit, args))) == pytest.approx(want)
    assert one(spark, t.recording_name(F.lit("lviv"), F.lit("2026-01-02 03:04:05").cast("timestamp"), F.lit("ab12cdef"))) == "Lviv_2026-01-02_03-04-05_AB12.jsonl.gz"

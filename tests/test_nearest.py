"""The nearest known place against all pairs: far gaps, ties, groups, poles and the date line."""

from __future__ import annotations

import math
import random

import pytest

from stormledger.operators.nearest import nearest, nearest_filled, nearest_on_earth


def km(a, b):
    (la, lo), (ma, mo) = ([math.radians(x) for x in p] for p in (a, b))
    h = math.sin((ma - la) / 2) ** 2 + math.cos(la) * math.cos(ma) * math.sin((mo - lo) / 2) ** 2
    return 2 * 6371.0088 * math.asin(min(1, math.sqrt(h)))


@pytest.mark.parametrize("seed", [1, 2])
def test_on_the_plane(spark, seed):
    r = random.Random(seed)
    known = [(k, r.choice("ab"), float(r.randrange(40)), float(r.randrange(40))) for k in range(120)] + [(k, "a", 1e6 + r.random(), -1e6) for k in range(200, 203)]
    asked = [(k, r.choice("abc"), float(r.choice([r.randrange(40), 5000, 10**6])), float(r.choice([r.randrange(40), -(10**6)]))) for k in range(150)]
    want = {}
    for k, g, x, y in asked:
        if best := min((((x - u) ** 2 + (y - v) ** 2, o) for o, h, u, v in known if h == g), default=None):
            want[k] = best[::-1]
    a = spark.createDataFrame([*asked, (999, "a", None, 1.0)], "ask long, g string, x double, y double")
    b = spark.createDataFrame([*known, (998, "a", 1.0, None)], "other long, g string, x double, y double")
    got = {x.ask: (x.other, x.d2) for x in nearest(a, b, ["x", "y"], 1.0, 4e6, ["g"]).collect()}
    assert got == want
    assert nearest(a, b.where("false"), ["x", "y"], 1.0, 4e6, ["g"]).collect() == []
    one = {x.ask: x.other for x in nearest(a.drop("g"), b.drop("g").where("other < 120"), ["x", "y"], 1.0, 4e6).collect()}
    assert one == {k: min(((x - u) ** 2 + (y - v) ** 2, o) for o, _, u, v in known[:120])[1] for k, _, x, y in asked}


def test_on_earth(spark):
    r = random.Random(3)
    known = [(k, r.uniform(-90, 90), r.uniform(-180, 180)) for k in range(60)] + [(100, 0.0, 179.9), (101, 89.9, 0.0), (102, 10.0, 10.0), (103, 10.0, 10.0)]
    asked = [(k, r.uniform(-90, 90), r.uniform(-180, 180)) for k in range(100)] + [(200, 0.0, -179.9), (201, 89.9, 180.0), (202, 10.0, 370.0), (203, -90.0, 0.0)]
    frame = lambda rows, name: spark.createDataFrame(rows, f"{name} long, lat double, lon double")
    got = {x.ask: (x.other, x.km) for x in nearest_on_earth(frame(asked, "ask"), frame(known, "other")).collect()}
    for k, *p in asked:
        d, best = min((math.floor(km(p, q) * 1e6), o) for o, *q in known)
        assert got[k][0] == best and got[k][1] == pytest.approx(d / 1e6, abs=1e-5), k
    assert got[200][0] == 100 and got[201][0] == 101 and got[202][0] == 102


def test_cells_are_filled_from_any_distance(spark):
    cells = [(0, 0, 1.0, 9), (0, 4, 2.0, 9), (-3, 4000, 3.0, 9), (2, 2, None, 9), (0, 0, 0.5, 9)]
    wanted = [(0, 0), (0, 2), (2, 2), (5, 3990), (-900, -900), (1, 3), (1, 3)]
    got = {(x.i, x.j): (x.v, x.filled) for x in nearest_filled(spark.createDataFrame(wanted, "i int, j int"), spark.createDataFrame(cells, "i int, j int, v double, extra int"), "v").collect()}
    assert got == {(0, 0): (1.0, False), (0, 2): (1.0, True), (2, 2): (1.0, True), (5, 3990): (3.0, True), (-900, -900): (1.0, True), (1, 3): (2.0, True)}
    none = nearest_filled(spark.createDataFrame(wanted, "i int, j int"), spark.createDataFrame([], "i int, j int, v double"), "v").collect()
    assert len(none) == 6 and all(x.v is None and x.filled for x in none)

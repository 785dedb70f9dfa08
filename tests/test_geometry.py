"""Clipping, simplification and inner points against plain versions; odd shapes and empty ones."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from stormledger.operators import geometry as g

LINES, AREAS = f"feature_id long, paths array<array<{g.POINT}>>, extra string", f"feature_id long, polygons array<array<array<{g.POINT}>>>"
BOX = (0.0, 0.0, 10.0, 6.0)


def inside(rings, p):
    """Even-odd, with points on an edge inside."""
    odd = False
    for r in rings:
        for (x1, y1), (x2, y2) in zip(r, [*r[1:], r[0]], strict=True):
            if abs((x2 - x1) * (p[1] - y1) - (y2 - y1) * (p[0] - x1)) <= 1e-7 * (1 + math.hypot(x2 - x1, y2 - y1)) and min(x1, x2) - 1e-9 <= p[0] <= max(x1, x2) + 1e-9 and min(y1, y2) - 1e-9 <= p[1] <= max(y1, y2) + 1e-9:
                return True
            if (y1 > p[1]) != (y2 > p[1]) and p[0] < (x2 - x1) * (p[1] - y1) / (y2 - y1) + x1:
                odd = not odd
    return odd


def length(paths):
    return sum(math.dist(a, b) for p in paths for a, b in zip(p, p[1:], strict=False))


def test_clipped_lines_cover_what_lies_inside(spark):
    """Every sampled place of a line is in the parts just if it's in the box; parts are as many as its stays inside."""
    r = random.Random(1)
    rows = []
    for i in range(120):
        paths = [[(r.choice([r.uniform(-5, 15), 0.0, 10.0, 5.0]), r.choice([r.uniform(-5, 11), 0.0, 6.0])) for _ in range(r.randrange(2, 9))] for _ in range(r.randrange(1, 3))]
        for p in paths:
            if r.random() < 0.3:
                p.insert(1, p[0])  # a vertex twice
        rows.append((i, paths, "x"))
    rows += [(500, None, "x"), (501, [], "x"), (502, [[]], "x"), (503, [[(1.0, 1.0)]], "x"), (504, [[(-1.0, 1.0), (0.0, 0.0), (1.0, -1.0)]], "x")]
    got = {x.feature_id: [[(p.x, p.y) for p in part] for part in x.paths] for x in g.clip_lines(spark.createDataFrame(rows, LINES).repartition(2), BOX).collect()}
    for i, paths, _ in rows[:120]:
        share, stays = 0.0, 0
        for p in paths:
            was = None
            for a, b in zip(p, p[1:], strict=False):
                if a == b:
                    continue
                ts = sorted({0.0, 1.0, *(t for k, v in ((0, BOX[0]), (0, BOX[2]), (1, BOX[1]), (1, BOX[3])) if a[k] != b[k] and 0 < (t := (v - a[k]) / (b[k] - a[k])) < 1)})
                for s, t in zip(ts, ts[1:], strict=False):
                    x, y = (a[k] + (b[k] - a[k]) * (s + t) / 2 for k in (0, 1))
                    now = BOX[0] <= x <= BOX[2] and BOX[1] <= y <= BOX[3]
                    share += now * (t - s) * math.dist(a, b)
                    stays += now and not was
                    was = now
        assert length(got.get(i, [])) == pytest.approx(share, abs=1e-9)
        assert len(got.get(i, [])) == stays, (i, paths)
        assert all(BOX[0] - 1e-9 <= x <= BOX[2] + 1e-9 and BOX[1] - 1e-9 <= y <= BOX[3] + 1e-9 for part in got.get(i, []) for x, y in part)
    assert not set(got) & {500, 501, 502, 503, 504}


def covered(rings, p):
    return inside(rings[:1], p) and not any(inside([h], p) for h in rings[1:])


def star(r, n, x, y, size):
    turns = sorted(r.uniform(0, 2 * math.pi) for _ in range(n))
    return [(x + size * r.uniform(0.3, 1) * math.cos(t), y + size * r.uniform(0.3, 1) * math.sin(t)) for t in turns]


def test_clipped_polygons(spark):
    r = random.Random(2)
    rows = [(i, [[star(r, r.randrange(3, 12), r.uniform(-2, 12), r.uniform(-2, 8), r.uniform(1, 9))]]) for i in range(60)]
    rows += [(100, None), (101, [[]]), (102, [[[(20.0, 20.0), (21.0, 20.0), (21.0, 21.0)]]]), (103, [[[(-5.0, -5.0), (15.0, -5.0), (15.0, 15.0), (-5.0, 15.0)], [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 2.0)], [(-4.0, -4.0), (-3.0, -4.0), (-3.0, -3.0)]]])]
    got = {x.feature_id: [[[(p.x, p.y) for p in ring] for ring in rings] for rings in x.polygons] for x in g.clip_polygons(spark.createDataFrame(rows, AREAS), BOX).collect()}
    assert not set(got) & {100, 101, 102}
    assert [len(x) for x in got[103]] == [2] and g.polygon_area([np.array(x) for x in got[103][0]]) == pytest.approx(59.0)
    for i, polygons in rows[:60]:
        for _ in range(60):
            p = (r.uniform(0.01, 9.99), r.uniform(0.01, 5.99))
            assert inside(polygons[0], p) == any(inside(rings, p) for rings in got.get(i, [])), (i, p)


def by_recursion(path, tolerance):
    if len(path) < 3:
        return path
    a, b = np.array(path[0]), np.array(path[-1])
    far = []
    for p in path[1:-1]:
        c = b - a
        t = min(1, max(0, float((np.array(p) - a) @ c / (c @ c)))) if c @ c else 0.0
        far.append(float(np.hypot(*(np.array(p) - a - t * c))))
    k = int(np.argmax(far)) + 1
    return path[:1] + path[-1:] if far[k - 1] <= tolerance else by_recursion(path[: k + 1], tolerance)[:-1] + by_recursion(path[k:], tolerance)


def test_simplified_lines(spark):
    r = random.Random(3)
    rows = []
    for i in range(40):
        x = y = 0.0
        path = []
        for _ in range(r.randrange(2, 80)):
            x, y = x + r.uniform(-1, 3), y + r.uniform(-2, 2)
            path.append((x, y))
        rows.append((i, [path, path[:1], [*path, path[0]]], "x"))
    big = [(float(i), r.uniform(-1.4, 1.4) if i % 1000 else 500.0) for i in range(100_000)]
    rows += [(90, [big], None), (91, None, "x"), (92, [[]], "x"), (93, [[(1.0, 1.0)] * 5], "x")]
    got = {x.feature_id: [[(p.x, p.y) for p in part] for part in x.paths] for x in g.simplify_lines(spark.createDataFrame(rows, LINES), 3.0).collect()}
    for i, paths, _ in rows[:40]:
        assert got[i] == [by_recursion(p, 3.0) for p in paths]
    assert 200 < len(got[90][0]) < 1000 and got[90][0][0] == big[0] and got[90][0][-1] == big[-1]
    assert got[91] == [] and got[92] == [[]] and got[93] == [[(1.0, 1.0), (1.0, 1.0)]]
    same = spark.createDataFrame(rows[:2], LINES)
    assert g.simplify_lines(same, 0.0) is same


SHAPES = {
    "bent": [[(0, 0), (100, 0), (100, 2), (2, 2), (2, 100), (0, 100)]],
    "holed": [[(0, 0), (90, 0), (90, 90), (0, 90)], [(1, 1), (89, 1), (89, 89), (1, 89)]],
    "slanted": [[(0, 0), (10_000, 9_000), (10_000, 9_001), (0, 1)]],
    "comb": [[(0, 0), (70, 0), (70, 40), (60, 40), (60, 5), (50, 5), (50, 40), (40, 40), (40, 5), (30, 5), (30, 40), (0, 40)]],
    "bowl": [[(0, 0), (50, 45), (100, 0), (50, 50)]],
}


@pytest.mark.parametrize("name", SHAPES)
def test_points_lie_inside(name):
    rings = [np.array(r, float) for r in SHAPES[name]]
    plain = [[tuple(p) for p in r.tolist()] for r in rings]
    p = g.interior_point(rings)
    assert covered(plain, p)
    for spacing, most in ((5.0, 300), (20.0, 7), (1e6, 300)):
        found = g.grid_points(rings, spacing, most)
        assert 1 <= len(found) <= most and all(inside(plain, q) for q in found.tolist())
    size, target = g.polygon_area(rings), 60
    cell = max(1.0, math.sqrt(size / min(target, math.ceil(size / 25))))
    (x0, y0), (x1, y1) = rings[0].min(axis=0), rings[0].max(axis=0)
    if (x1 - x0) * (y1 - y0) / cell**2 < 1e5:  # the same grid, every place of it asked
        every = [(x0 + (i + 0.5) * cell, y0 + (j + 0.5) * cell) for i in range(math.ceil((x1 - x0) / cell)) for j in range(math.ceil((y1 - y0) / cell))]
        want = [q for q in every if q[0] <= x1 and q[1] <= y1 and inside(plain, q)]
        got = g.grid_points(rings, 5.0, target)
        assert np.allclose(got, want[:target]) if want else len(got) == 1


def test_grid_points_on_edges_count():
    square = [np.array([(0.5, 0.5), (0.5, 3.5), (3.5, 3.5), (3.5, 0.5)])]
    hole = np.array([(1.5, 1.5), (2.5, 1.5), (2.5, 2.5), (1.5, 2.5)])
    places = g.grid_points([square[0] - 0.5, hole - 0.5], 1.0, 300).tolist()
    assert [1.5, 1.5] not in places and [0.53, 0.53] not in places and len(places) == 8
    assert g.shared_out([1.0, 1.0, 2.0], 8) == [2, 2, 4] and g.shared_out([1000.0, 1.0, 1.0], 3) == [1, 1, 1] and g.shared_out([1.0, 0.1], 1) == [1, 1]


def test_sampled_polygons_of_odd_features(spark):
    unit = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]
    flat = [(0.0, 0.0), (4.0, 0.0), (2.0, 0.0)]
    rows = [(1, [[unit]]), (2, [[flat]]), (3, [[flat], [unit]]), (4, [[flat], [flat]]), (5, None), (6, []), (7, [[]]), (1, [[unit]])]
    got = {}
    for x in g.sample_polygons(spark.createDataFrame(rows, AREAS), 5.0, 50).collect():
        got.setdefault(x.feature_id, []).append((x.x, x.y))
    assert {k: len(v) for k, v in got.items()} == {1: 8, 2: 1, 3: 4} and got[2] == [(2.0, 0.0)]

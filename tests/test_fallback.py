"""The engine without hazards against a plain version of its rules, figure by figure."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict
from hashlib import blake2b

import pytest

from stormledger.operators import fallback as f

CLASSES = {"elec_aerien": 1.2, "elec_souterrain": 0.75, "eau_reseau": 0.95, "eau_ouvrage": 1.08, "habitation": 0.82, "other": 1.0}
SCHEMA = "feature_id string, territory string, lat double, lon double, infra_class string, value double, weight double, n_points int, label string, asset_type string"


def band(x, edges, names):
    return names[sum(x >= e for e in edges)]


def health(rows):
    total = sum(w for w, _ in rows)
    return 1.0 if total <= 0 else min(1, max(0, 1 - sum({"S0": 0, "S1": 0.3, "S2": 0.7, "S3": 1}[s] * w for w, s in rows) / total))


def distance(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return math.asin(min(1, math.sqrt(h)))


def plain(features):
    """(direct, final, state, final state, tier) of each feature and hazard, and electricity's health overall."""
    spread = min(200, max(1, sum(x[7] for x in features) / len(features)))
    base = min(0.22, max(0.045, 0.055 + 0.008 * math.log10(spread + 1)))
    out, overall = {}, {}
    for hazard, times, share in (("storm", 1.0, 0.22), ("storm_cmcc", 1.24, 0.25)):
        damage = {}
        for x in features:
            unit = int.from_bytes(blake2b(f"{x[0]}|{hazard}|{x[4]}".encode(), digest_size=8).digest(), "big") / 2**64
            damage[x[0]] = min(0.95, base * CLASSES[x[4]] * times * (0.82 + 0.36 * unit))
        state = {k: band(v, (0.05, 0.15, 0.35), ("S0", "S1", "S2", "S3")) for k, v in damage.items()}
        local, places = defaultdict(list), defaultdict(list)
        for x in features:
            if x[4].startswith("elec"):
                local[x[1]].append((x[6], state[x[0]]))
                if x[2] is not None:
                    places[x[1]].append(x[2:4])
        overall[hazard] = health([y for v in local.values() for y in v])
        centre = {k: [sum(c) / len(v) for c in zip(*v, strict=True)] for k, v in places.items()}
        for x in features:
            k, v = x[0], max(0.0, x[5])
            final, worst, tier = damage[k], state[k], None
            if x[4].startswith("eau"):
                if x[1] in local:
                    tier, h = "local", health(local[x[1]])
                elif x[2] is not None and centre:
                    tier, h = "nearest", health(local[min(centre, key=lambda t: (distance(x[2:4], centre[t]), t))])
                else:
                    tier, h = "global", overall[hazard]
                need = band(h, (0.35, 0.55, 0.75), ("S3", "S2", "S1", "S0"))
                worst = max(worst, need)
                final = min(0.95, max(final, {"S0": 0.0, "S1": 0.07, "S2": 0.2, "S3": 0.45}[need]) + (1 - h) * 0.12)
            direct = min(v, v * damage[k] * share)
            out[hazard, k] = (direct, max(direct, min(v, v * final * share)), state[k], worst, tier)
    return out, overall


@pytest.mark.parametrize("seed,electric", [(1, True), (2, True), (3, False)])
def test_fallback_like_plain_rules(spark, seed, electric):
    r = random.Random(seed)
    kinds = [k for k in CLASSES if electric or not k.startswith("elec")]
    features = []
    for i in range(150):
        lat, lon = (None, None) if r.random() < 0.1 else (r.uniform(-60, 60), r.uniform(-179, 179))
        kind = r.choice(kinds)
        territory = "uploaded-aggregate" if lat is None else f"t{int(lat // 8)}{'e' if kind.startswith('elec') and r.random() < 0.7 else ''}"
        features.append((f"f{i}", territory, lat, lon, kind, r.choice([100.0, -50.0, 12345.67, 0.0, 1e6]), r.choice([1.0, 3.0, 0.37]), r.randrange(1, 40), f"label {i}", None))
    want, overall = plain(features)
    done = f.fallback_run(spark.createDataFrame(features, SCHEMA))
    got = {(x.hazard, x.feature_id): x for x in done.features.collect()}
    assert set(got) == set(want)
    for k, (direct, total, state, worst, tier) in want.items():
        assert (got[k].state, got[k].final_state, got[k].tier) == (state, worst, tier) and (got[k].direct, got[k].total) == pytest.approx((direct, total)), k
    sums = defaultdict(lambda: [0.0, 0.0, 0.0])
    for (h, k), (direct, total, *_) in want.items():
        x = features[int(k[1:])]
        sums[h, x[1]] = [a + b for a, b in zip(sums[h, x[1]], (max(0.0, x[5]), direct, total), strict=True)]
    rows = {(x.hazard, x.territory): x for x in done.territories.collect()}
    assert set(rows) == set(sums)
    for k, (exposure, direct, total) in sums.items():
        assert (rows[k].exposure, rows[k].direct_eai, rows[k].indirect_eai, rows[k].total_eai) == pytest.approx((exposure, direct, total - direct, total), abs=0.011)
        assert rows[k].risk_index == pytest.approx(min(100, total / max(exposure, 1) * 1000), abs=0.006)
    portfolio = {x.hazard: x for x in done.portfolio.collect()}
    for h, times in (("storm", 4.5), ("storm_cmcc", 4.9)):
        p, total = portfolio[h], sum(rows[k].total_eai for k in rows if k[0] == h)
        assert p.total_eai == pytest.approx(total, abs=0.005)
        assert [p.max_event, p.pml_10, p.pml_20, p.pml_50, p.pml_100, p.pml_200, p.pml_1000, p.tvar95] == pytest.approx([total * m for m in (times, 2.3, 2.0, 1.7, 1.45, 1.25, 1.9, 1.8)], abs=0.02)
    (delta,) = done.delta.collect()
    assert delta.eai == pytest.approx(portfolio["storm_cmcc"].total_eai - portfolio["storm"].total_eai, abs=0.01)
    buckets = defaultdict(list)
    for (h, k), (*_, worst, _) in want.items():
        buckets[h, features[int(k[1:])][4]].append((features[int(k[1:])][6], worst))
    found = {(x.hazard, x.infra_class): x for x in done.component_health.collect()}
    assert set(found) == set(buckets)
    for k, v in buckets.items():
        assert found[k].health == pytest.approx(health(v), abs=1e-4) and found[k].n_assets == len(v) and found[k].s2 == pytest.approx(sum(w for w, s in v if s == "S2"))
    model = {x.hazard: x for x in done.interdependency.collect()}
    assert {h: x.electric_health for h, x in model.items()} == pytest.approx(overall, abs=1e-4)
    assert {h: x.impacted_assets for h, x in model.items()} == {h: sum(w > s for (g, _), (_, _, s, w, _) in want.items() if g == h) for h in model}
    tiers = Counter((h, v[4]) for (h, _), v in want.items() if v[4])
    assert {(x.hazard, x.tier): x.n for x in done.resolution.collect()} == tiers
    curve = {(x.hazard, x.return_period): x for x in done.curves.collect()}
    assert curve["storm", 50].lifetime_30 == pytest.approx(portfolio["storm"].total_eai / math.sqrt(50) * 1.105, abs=0.02)
    assert {x.label for x in done.assets.collect()} == {x[8] for x in features} and done.assets.count() == 300


def test_values_are_clipped_and_nothing_is_one_territory(spark):
    rows = [("a", "t", 1.0, 1.0, "habitation", 100.0, 1.0, 1, "", ""), ("b", "t", 1.0, 1.0, "habitation", -50.0, 1.0, 1, "", ""), ("c", None, None, None, "habitation", 100.0, 1.0, 1, "", "")]
    frame = spark.createDataFrame(rows, SCHEMA)
    done = f.fallback_run(frame)
    assert {x.exposure for x in done.portfolio.collect()} == {200.0} and done.features.where("direct < 0").count() == 0
    none = f.fallback_run(frame.where("false"))
    assert {(x.hazard, x.territory, x.total_eai) for x in none.territories.collect()} == {("storm", "uploaded-aggregate", 0.0), ("storm_cmcc", "uploaded-aggregate", 0.0)}
    assert {x.pml_10 for x in none.portfolio.collect()} == {0.0}

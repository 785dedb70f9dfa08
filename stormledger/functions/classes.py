"""Classes of infrastructure, unit values, and small row functions of the case studies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
NETWORK_CLASSES = {
    "eau_aep_cana": "eau_aep",
    "eau_eu_cana": "eau_eu",
    "elec_bt_souterrain": "elec_bt_souterrain",
    "elec_bt_aerien": "elec_bt_aerien",
    "elec_hta_souterrain": "elec_hta_souterrain",
    "elec_hta_aerien": "elec_hta_aerien",
}
WATER_VALUES = {
    "guadeloupe": {"eau_aep_cana": 776_386.0, "eau_eu_cana": 791_691.0, "eau_eu_pr": 523_211.0, "eau_eu_step": 7_777_800.0},
    "martinique": {"eau_aep_cana": 653_445.0, "eau_eu_cana": 831_815.0, "eau_eu_pr": 44_257.0, "eau_eu_step": 7_923_344.0},
}
ELECTRIC_VALUES = {"elec_bt_aerien": 167_060.0, "elec_bt_souterrain": 1_336_480.0, "elec_hta_aerien": 249_299.0, "elec_hta_souterrain": 1_994_390.0}
WORKS_VALUES = {"TRAIT": 3_500_000.0, "STPMP": 1_200_000.0, "CAP": 1_000_000.0, "CUV": 500_000.0}
WORKS_DEFAULT, LEAST_LINE_VALUE = 800_000.0, 5_000.0
RAIN_MODELS = ("R-CLIPER", "TCR")
HIDDEN_BELOW_MPS = 18.0


def choice(key: Column, table: dict[str, object], default: object = None) -> Column:
    """The table's value for a key; ``default`` for others."""
    found = F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)
    return found if default is None else F.coalesce(found, F.lit(default))


def network_class(asset: Column) -> Column:
    """One of six classes of lines; null for what isn't a line."""
    return choice(asset, NETWORK_CLASSES)


def breakdown_class(asset: Column) -> Column:
    """One of nine classes: those of lines, works of drinking water, pumping stations and treatment plants; null for others."""
    return F.when(asset.startswith("eau_aep_ouvrage"), "eau_aep_ouvrages").when(asset.isin("eau_eu_pr", "eau_eu_step"), asset).otherwise(network_class(asset))


def unit_value(territory: Column, asset: Column) -> Column:
    """Euros a kilometre (lines) or a piece (stations, plants) by territory and asset type; null where there is none."""
    water = F.when(territory == "martinique", choice(asset, WATER_VALUES["martinique"])).otherwise(choice(asset, WATER_VALUES["guadeloupe"]))
    return F.coalesce(water, choice(asset, ELECTRIC_VALUES))


def works_value(code: Column) -> Column:
    """The value of a piece of drinking-water works by its type code."""
    return choice(F.upper(F.trim(code)), WORKS_VALUES, WORKS_DEFAULT)


def asset_value(territory: Column, asset: Column, km: Column, code: Column) -> Column:
    """Lines by length (at least LEAST_LINE_VALUE), works by code, stations and plants by piece."""
    unit = unit_value(territory, asset)
    return F.when(network_class(asset).isNotNull(), F.greatest(F.lit(LEAST_LINE_VALUE), km * unit)).when(asset.startswith("eau_aep_ouvrage"), works_value(code)).otherwise(unit)


def scenario_metric(scenario: Column, mean: Column, rp50: Column, rp100: Column, most: Column) -> Column:
    """The metric that stands for a scenario: the mean for annual, top10 and top5; 0 where it isn't positive."""
    value = F.when(scenario == "rp50", rp50).when(scenario == "rp100", rp100).when(scenario == "event_max", most).otherwise(mean)
    return F.when(value > 0, value).otherwise(0.0)


def hide_low(value: Column, hazard: Column, metric: Column) -> Column:
    """Null where the second hazard's 50- or 100-year wind is too low to be shown."""
    return F.when((hazard == "storm_cmcc") & metric.isin("rp50", "rp100") & (value <= HIDDEN_BELOW_MPS), None).otherwise(value)


def rain_model(name: Column) -> Column:
    """The name of a known rain model, in whatever case it's given; the first one otherwise."""
    known = F.upper(F.trim(F.coalesce(name, F.lit(""))))
    return F.when(known.isin(*RAIN_MODELS), known).otherwise(RAIN_MODELS[0])


def kmh(mps: Column) -> Column:
    return mps * 3.6


def fixed_length(values: Column, n: int) -> Column:
    """An array of ``n`` numbers: cut or filled with zeros; nulls, NaN and negative ones are 0."""
    clean = F.transform(values, lambda v: F.when(v.isNotNull() & ~F.isnan(v) & (v > 0), v).otherwise(0.0))
    return F.slice(F.concat(F.coalesce(clean, F.array().cast("array<double>")), F.array_repeat(F.lit(0.0), n)), 1, n)


def class_edges(low: Column, high: Column, classes: int = 5) -> Column:
    """Edges of ``classes`` equal classes, outwards to the nearest half."""
    a, b = F.floor(low * 2) / 2, F.ceil(high * 2) / 2
    step = F.greatest(F.lit(0.5), F.ceil((b - a) / classes * 2) / 2)
    return F.transform(F.sequence(F.lit(0), F.lit(classes)), lambda k: a + k * step)


def step_edges(low: Column, high: Column, step: Column) -> Column:
    """Edges from the multiple of ``step`` below ``low`` to the one above ``high``, one step at least; what isn't finite gives way to 0 and to one step."""
    size = F.greatest(F.lit(1e-6), F.coalesce(F.nullif(F.nanvl(step.cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(1.0)))
    finite = lambda x: F.when(F.abs(x.cast("double")) < float("inf"), x.cast("double"))
    a = F.coalesce(F.floor(finite(low) / size) * size, F.lit(0.0))
    b = F.coalesce(F.ceil(finite(high) / size) * size, a + size)
    n = F.greatest(F.lit(1).cast("long"), F.floor((b - a + 1e-9) / size))
    return F.transform(F.sequence(F.lit(0).cast("long"), n), lambda k: F.round(a + k * size, 6))

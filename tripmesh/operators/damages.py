"""Prices on emissions, AUD per kg, under several scenarios."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from tripmesh.config import PRICED

# Exchange rates, price levels and damage costs behind the rates.
AUD_PER_POUND = 1.90707364
AUD_PER_USD = 1.42804505
CO2_USD_PER_TONNE_2020 = 308
DISCOUNT_RATE = 0.015
YEARS_SINCE_2020 = 6
PRICE_LEVEL_RATIO = 100.32 / 81.0
CO_WARMING = 1.9
HC_WARMING = 10.5
POUNDS_PER_TONNE = {"sox": 26193, "nox": 17172, "pm": 146743, "hc": 150}
OFFICIAL_CO2_AUD_PER_TONNE = 80

SCENARIOS = ("as_published", "pm_corrected", "official_price")


def damage_rates(scenario: str = "as_published") -> dict[str, float]:
    """AUD per kg of each priced pollutant.

    ``as_published`` prices particles at the NOx rate, as the published figures
    do; ``pm_corrected`` uses the particle rate; ``official_price`` takes the
    regulator's carbon price.
    """
    if scenario not in SCENARIOS:
        raise ValueError(f"unknown scenario {scenario!r}, expected one of {SCENARIOS}")
    local = {p: pounds * AUD_PER_POUND / 1000 for p, pounds in POUNDS_PER_TONNE.items()}
    if scenario == "official_price":
        co2 = OFFICIAL_CO2_AUD_PER_TONNE / 1000
    else:
        grown = CO2_USD_PER_TONNE_2020 * PRICE_LEVEL_RATIO * (1 + DISCOUNT_RATE) ** YEARS_SINCE_2020
        co2 = grown * AUD_PER_USD / 1000
    return {
        "co2": co2,
        "co": co2 * CO_WARMING,
        "sox": local["sox"],
        "nox": local["nox"],
        "hc": local["hc"] + HC_WARMING * co2,
        "pm": local["pm"] if scenario == "pm_corrected" else local["nox"],
    }


def rate_table(spark: SparkSession) -> DataFrame:
    """One row per scenario, one ``*_rate`` column per priced pollutant. Always three rows."""
    return spark.sql(f"SELECT {_scenario_rows()}")


def _scenario_rows() -> str:
    """Generator of one row per scenario, from constants."""
    rows = []
    for scenario in SCENARIOS:
        rates = damage_rates(scenario)
        rows.append(f"'{scenario}', " + ", ".join(f"{rates[p]!r}D" for p in PRICED))
    names = ", ".join(f"{p}_rate" for p in PRICED)
    return f"stack({len(rows)}, {', '.join(rows)}) AS (scenario, {names})"


def with_total(df: DataFrame) -> DataFrame:
    """Add ``total_damage``, the sum of all ``*_damage`` columns; nulls count as 0."""
    parts = [f"coalesce({c}, 0D)" for c in df.columns if re.fullmatch(r".*_damage", c)]
    return df.selectExpr("*", f"{' + '.join(parts)} AS total_damage")


def damages(totals: DataFrame, scenario: str = "as_published") -> DataFrame:
    """Add ``*_damage`` of each priced pollutant and ``total_damage``."""
    rates = damage_rates(scenario)
    costs = [f"{mass} * {rates[p]!r}D AS {p}_damage" for p, mass in PRICED.items()]
    return with_total(totals.selectExpr("*", *costs))


def damages_by_scenario(totals: DataFrame) -> DataFrame:
    """Every row under each of the three scenarios."""
    priced = totals.selectExpr("*", _scenario_rows())
    costs = [f"{mass} * {p}_rate AS {p}_damage" for p, mass in PRICED.items()]
    return with_total(priced.selectExpr("scenario", *totals.columns, *costs))


def final_totals(last: DataFrame) -> DataFrame:
    """The priced last row of each day as (``pollutant``, ``kg``, ``cost``) rows and a total row."""
    lines = [f"'{p}', {mass}, {p}_damage" for p, mass in PRICED.items()]
    lines.append("'total', cast(NULL AS double), total_damage")
    rows = f"stack({len(lines)}, {', '.join(lines)}) AS (pollutant, kg, cost)"
    return last.selectExpr("day", rows)

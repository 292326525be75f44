"""Physics as Column expressions; an absent input stays NULL and never becomes zero."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the measurements.
FAIMAN_U0, FAIMAN_U1 = 25.0, 6.84
DC_FACTOR, AC_FACTOR = 0.86, 0.96
FACTOR_FLOOR, SIGNIFICANCE_CAP = 0.3, 999.0
STC_TEMPERATURE, STC_IRRADIANCE = 25.0, 1000.0


@dataclass(frozen=True)
class Plant:
    """A plant's figures, or Columns of them where rows of many plants are measured at once."""

    capacity_kw: float = 100.0
    gamma: float = -0.004
    utc_offset_hours: float = 0.0
    ac_ceiling_kw: float | None = None

    def __post_init__(self):
        if not isinstance(self.capacity_kw, Column) and (self.capacity_kw <= 0 or self.gamma > 0):
            raise ValueError("capacity must be positive and gamma not above zero")


def faiman(poa: Column, ambient: Column, wind: Column) -> Column:
    """Cell temperature; a missing wind counts as 1 m/s, a negative one as 0."""
    return ambient + poa / (FAIMAN_U0 + FAIMAN_U1 * F.greatest(F.coalesce(wind, F.lit(1.0)), F.lit(0.0)))


def correction_factor(temperature: Column, gamma: float) -> Column:
    """NULL temperatures stay NULL, which greatest() alone would turn into the floor."""
    return F.when(temperature.isNotNull(), F.greatest(1 + gamma * (temperature - STC_TEMPERATURE), F.lit(FACTOR_FLOOR)))


def expected_ac(poa: Column, temperature: Column, plant: Plant) -> Column:
    dc = F.greatest(plant.capacity_kw * F.coalesce(poa, F.lit(0.0)) / STC_IRRADIANCE * (1 + plant.gamma * (temperature - STC_TEMPERATURE)), F.lit(0.0)) * DC_FACTOR
    ac = F.when(temperature.isNotNull(), dc * AC_FACTOR)
    return ac if plant.ac_ceiling_kw is None else F.least(ac, F.lit(plant.ac_ceiling_kw))


def significance(change: Column, scatter: Column) -> Column:
    """0 for no change, the cap where there is no scatter to compare with."""
    return F.when(change == 0, F.lit(0.0)).when(scatter <= 0, F.lit(SIGNIFICANCE_CAP)).otherwise(F.least(F.try_divide(F.abs(change), scatter), F.lit(SIGNIFICANCE_CAP)))


def local_hour(ts: Column, plant: Plant) -> Column:
    if isinstance(plant.utc_offset_hours, Column):
        return F.hour(F.timestamp_seconds(F.unix_timestamp(ts) + (plant.utc_offset_hours * 3600).cast("long")))
    return F.hour(ts + F.make_dt_interval(F.lit(0), F.lit(int(plant.utc_offset_hours)), F.lit(int(plant.utc_offset_hours % 1 * 60))))

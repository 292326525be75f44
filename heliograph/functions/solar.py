"""Sun position and clear-sky irradiance as native expressions, one row at a time.

The sun follows the low-precision almanac series (about 0.01 degrees) with refraction; the clear sky is
the Ineichen model with a monthly turbidity, brought into the plane of the array with Perez's model.
``ts`` is a UTC instant; a NULL ``ts`` gives NULL angles and no irradiance.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Clearness bins and coefficients of the transposition model (all sites, 1990).
PEREZ_BINS = (1.065, 1.23, 1.5, 1.95, 2.8, 4.5, 6.2)
PEREZ = {
    "f11": (-0.008, 0.130, 0.330, 0.568, 0.873, 1.132, 1.060, 0.678), "f12": (0.588, 0.683, 0.487, 0.187, -0.392, -1.237, -1.600, -0.327),
    "f13": (-0.062, -0.151, -0.221, -0.295, -0.362, -0.412, -0.359, -0.250), "f21": (-0.060, -0.019, 0.055, 0.109, 0.226, 0.288, 0.264, 0.156),
    "f22": (0.072, 0.066, -0.064, -0.152, -0.462, -0.823, -1.127, -1.377), "f23": (-0.022, -0.029, -0.026, -0.014, 0.001, 0.056, 0.131, 0.251),
}


@dataclass(frozen=True)
class Site:
    latitude: float = 39.13
    longitude: float = 0.0
    altitude_m: float = 138.0
    tilt_deg: float = 20.0
    azimuth_deg: float = 180.0
    albedo: float = 0.2
    #: Linke turbidity of each month.
    turbidity: tuple[float, ...] = (2.6, 2.7, 2.9, 3.1, 3.3, 3.5, 3.6, 3.5, 3.2, 2.9, 2.7, 2.6)

    def __post_init__(self):
        if not (-90 <= self.latitude <= 90 and -180 <= self.longitude <= 180 and len(self.turbidity) == 12):
            raise ValueError("latitude, longitude or turbidity out of range")


def _let(use, **values: Column) -> Column:
    """``use`` over values that are computed once.

    Columns of a projection would be copied into every filter that is pushed through it, and the copies
    of a chain of them double with each link; bound values stay single.
    """
    bound = F.array(F.struct(*(v.alias(k) for k, v in values.items())))
    return F.element_at(F.transform(bound, use), 1)


def sun_angles(ts: Column, site: Site = Site()) -> Column:
    """struct(zenith, azimuth) in degrees; the zenith is the apparent one."""
    lat = math.radians(site.latitude)

    def orbit(a: Column) -> Column:
        g = F.radians(357.528 + 0.9856003 * a["n"])
        return _let(ecliptic, s=a["s"], n=a["n"], e=F.radians(23.439 - 0.0000004 * a["n"]), lam=F.radians(280.460 + 0.9856474 * a["n"] + 1.915 * F.sin(g) + 0.020 * F.sin(2 * g)))

    def ecliptic(a: Column) -> Column:
        ra = F.degrees(F.atan2(F.cos(a["e"]) * F.sin(a["lam"]), F.cos(a["lam"])))
        hour = F.radians(15 * (6.697375 + 0.0657098242 * a["n"] + F.pmod(a["s"], F.lit(86400.0)) / 3600) + site.longitude - ra)
        return _let(horizon, ha=hour, dec=F.asin(F.sin(a["e"]) * F.sin(a["lam"])))

    def horizon(a: Column) -> Column:
        el = F.degrees(F.asin(F.sin(a["dec"]) * math.sin(lat) + F.cos(a["dec"]) * math.cos(lat) * F.cos(a["ha"])))
        azimuth = F.degrees(F.atan2(-F.cos(a["dec"]) * F.sin(a["ha"]), F.sin(a["dec"]) * math.cos(lat) - F.cos(a["dec"]) * math.sin(lat) * F.cos(a["ha"])))
        return _let(refracted, el=el, azimuth=F.pmod(azimuth, F.lit(360.0)))

    def refracted(a: Column) -> Column:
        el = a["el"]
        lift = F.when(el > -0.56, 3.51561 * (0.1594 + 0.0196 * el + 0.00002 * el * el) / (1 + 0.505 * el + 0.0845 * el * el)).otherwise(0.0)
        return F.struct((90 - (el + lift)).alias("zenith"), a["azimuth"].alias("azimuth"))

    s = F.unix_timestamp(ts).cast("double")
    return _let(orbit, s=s, n=s / 86400 - 10957.5)


def clearsky(ts: Column, sun: Column, site: Site = Site()) -> Column:
    """Clear-sky irradiance in the plane of the array under the angles ``sun``; 0 at night."""
    fh1, fh2 = math.exp(-site.altitude_m / 8000), math.exp(-site.altitude_m / 1250)
    cg1, cg2 = 0.0000509 * site.altitude_m + 0.868, 0.0000392 * site.altitude_m + 0.0387
    pressure = (1 - 0.0000225577 * site.altitude_m) ** 5.25588
    tilt = math.radians(site.tilt_deg)
    day = 2 * math.pi * (F.dayofyear(ts) - 1) / 365
    extra = 1366.1 * (1.00011 + 0.034221 * F.cos(day) + 0.00128 * F.sin(day) + 0.000719 * F.cos(2 * day) + 0.000077 * F.sin(2 * day))

    def air(a: Column) -> Column:
        z = F.radians(a["zenith"])
        cz = F.greatest(F.cos(z), F.lit(0.0))
        facing = F.greatest(F.cos(z) * math.cos(tilt) + F.sin(z) * math.sin(tilt) * F.cos(F.radians(a["azimuth"] - site.azimuth_deg)), F.lit(0.0))
        mass = F.when(a["zenith"] < 90, 1 / (cz + 0.50572 * F.pow(96.07995 - a["zenith"], F.lit(-1.6364))))
        return _let(level, z=z, cz=cz, aoi=facing, air=mass, i0=a["i0"], tl=a["tl"])

    def level(a: Column) -> Column:
        ghi = cg1 * a["i0"] * a["cz"] * F.exp(-cg2 * a["air"] * pressure * (fh1 + fh2 * (a["tl"] - 1)))
        return _let(beam, ghi=ghi, **{k: a[k] for k in ("z", "cz", "aoi", "air", "i0", "tl")})

    def beam(a: Column) -> Column:
        direct = (0.664 + 0.163 / fh1) * F.exp(-0.09 * a["air"] * pressure * (a["tl"] - 1)) * a["i0"]
        bound = F.try_divide(a["ghi"] * (1 - (0.1 - 0.2 * F.exp(-a["tl"])) / (0.1 + 0.882 / fh1)), a["cz"])
        dni = F.when(a["ghi"].isNotNull(), F.least(direct, F.greatest(bound, F.lit(0.0))))
        return _let(split, dni=dni, **{k: a[k] for k in ("ghi", "z", "cz", "aoi", "air", "i0")})

    def split(a: Column) -> Column:
        return _let(cleared, dhi=a["ghi"] - a["dni"] * a["cz"], **{k: a[k] for k in ("dni", "ghi", "z", "cz", "aoi", "air", "i0")})

    def cleared(a: Column) -> Column:
        cube = 1.041 * a["z"] * a["z"] * a["z"]
        clearness = (F.try_divide(a["dhi"] + a["dni"], a["dhi"]) + cube) / (1 + cube)
        return _let(binned, clearness=clearness, delta=a["dhi"] * a["air"] / a["i0"], **{k: a[k] for k in ("dhi", "dni", "ghi", "z", "cz", "aoi")})

    def binned(a: Column) -> Column:
        number = sum((F.when(a["clearness"] >= b, 1).otherwise(0) for b in PEREZ_BINS), F.lit(1))
        return _let(transposed, bin=number, **{k: a[k] for k in ("delta", "dhi", "dni", "ghi", "z", "cz", "aoi")})

    def transposed(a: Column) -> Column:
        c = {k: F.element_at(F.array(*map(F.lit, v)), a["bin"]) for k, v in PEREZ.items()}
        near = F.greatest(c["f11"] + c["f12"] * a["delta"] + c["f13"] * a["z"], F.lit(0.0))
        low = c["f21"] + c["f22"] * a["delta"] + c["f23"] * a["z"]
        return _let(total, near=near, low=low, **{k: a[k] for k in ("dhi", "dni", "ghi", "cz", "aoi")})

    def total(a: Column) -> Column:
        diffuse = a["dhi"] * (0.5 * (1 - a["near"]) * (1 + math.cos(tilt)) + a["near"] * a["aoi"] / F.greatest(a["cz"], F.lit(math.cos(math.radians(85)))) + a["low"] * math.sin(tilt))
        sky = F.when(diffuse.isNotNull(), F.greatest(diffuse, F.lit(0.0)))
        return F.coalesce(a["dni"] * a["aoi"] + sky + a["ghi"] * site.albedo * (1 - math.cos(tilt)) / 2, F.lit(0.0))

    turbidity = F.element_at(F.array(*map(F.lit, site.turbidity)), F.month(ts))
    return F.coalesce(_let(air, zenith=sun["zenith"], azimuth=sun["azimuth"], i0=extra, tl=turbidity), F.lit(0.0))


def with_sun(rows: DataFrame, site: Site = Site(), ts: str = "ts") -> DataFrame:
    """Adds ``sun_zenith`` (apparent) and ``sun_azimuth`` in degrees."""
    out = rows.withColumn("__sun", sun_angles(F.col(ts), site))
    return out.withColumns({"sun_zenith": F.col("__sun.zenith"), "sun_azimuth": F.col("__sun.azimuth")}).drop("__sun")


def with_clearsky(rows: DataFrame, site: Site = Site(), ts: str = "ts") -> DataFrame:
    """Adds ``clearsky_poa``, an upper bound of the irradiance on the array (0 at night)."""
    return rows.withColumn("__sun", sun_angles(F.col(ts), site)).withColumn("clearsky_poa", clearsky(F.col(ts), F.col("__sun"), site)).drop("__sun")

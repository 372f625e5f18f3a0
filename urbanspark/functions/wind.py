"""Formulas of the parametric wind model, as Column expressions. Published: Hanna and Britter (2002), Kaplan and Dinar (1996), Bagal et al. (2004), Pol et al. (2006), Cionco (1972), Macdonald (2000)."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Constants of the zones' formulas, default roughness, codes of the zones.
CDZ, P_PROFILE, Z0_DEFAULT = 0.4, 0.16, 0.5
FREE, INSIDE, UPWIND, UPWIND_VORTEX, CAVITY, WAKE, ROOF_PERPENDICULAR, ROOF_CORNER, CANYON = range(9)
NODATA = -9999.0


@dataclass(frozen=True)
class Profile:
    """kind: log, urban or power (whatever else is named); the site's roughness and heights."""

    kind: str = "power"
    z_ref: float = 10.0
    z0: float = Z0_DEFAULT
    d: float = 0.0
    hr: float = 10.0
    lambda_f: float = 0.1

    def ratio(self, z: Column) -> Column:
        if self.kind == "log":
            return log_profile(z, F.lit(self.z_ref), F.lit(self.z0))
        if self.kind == "urban":
            return urban_profile(z, F.lit(self.z_ref), F.lit(self.z0), F.lit(self.d), F.lit(self.hr), F.lit(self.lambda_f))
        return power_profile(z, F.lit(self.z_ref), F.lit(self.z0))


def at_least(x: Column, least: float) -> Column:
    return F.greatest(x, F.lit(least))


def to_wind_frame(x: Column, y: Column, direction: float) -> tuple[Column, Column]:
    """(along, cross) for wind from ``direction`` degrees."""
    a = math.radians(270.0 - direction)
    return x * math.cos(a) + y * math.sin(a), y * math.cos(a) - x * math.sin(a)


def from_wind_frame(along: Column, cross: Column, direction: float) -> tuple[Column, Column]:
    a = math.radians(270.0 - direction)
    return along * math.cos(a) - cross * math.sin(a), along * math.sin(a) + cross * math.cos(a)


def _solid(h: Column, weff: Column, length: Column) -> Column:
    return F.when((h <= 0) | (weff <= 0), 0.0).otherwise(length)


def upwind_length(h: Column, weff: Column) -> Column:
    return _solid(h, weff, 1.5 * weff / (1 + 0.8 * weff / h))


def upwind_vortex_length(h: Column, weff: Column) -> Column:
    return _solid(h, weff, 0.6 * weff / (1 + 0.8 * weff / h))


def cavity_length(h: Column, weff: Column, leff: Column) -> Column:
    return _solid(h, weff, 1.8 * weff / (F.pow(at_least(leff / h, 1e-6), F.lit(0.3)) * (1 + 0.24 * leff / h)))


def wake_length(h: Column, weff: Column, leff: Column) -> Column:
    return 3 * cavity_length(h, weff, leff)


def displacement_height(h: Column, weff: Column) -> Column:
    return _solid(h, weff, 0.22 * (0.67 * F.least(h, weff) + 0.33 * F.greatest(h, weff)))


def log_profile(z: Column, z_ref: Column, z0: Column) -> Column:
    z0 = at_least(z0, 0.01)
    return F.ln(at_least(z, 0.01) / z0) / F.ln(at_least(z_ref, 0.01) / z0)


def power_profile(z: Column, z_ref: Column, z0: Column) -> Column:
    return F.pow(at_least(z, 0.01) / at_least(z_ref, 0.01), 0.12 * z0 + 0.18)


def urban_profile(z: Column, z_ref: Column, z0: Column, d: Column, hr: Column, lambda_f: Column) -> Column:
    """Exponential below the mean height, logarithmic above; matched at the mean height or at the reference below it."""
    z, z_ref, z0, a = at_least(z, 0.01), at_least(z_ref, 0.01), at_least(z0, 0.01), 9.6 * lambda_f
    log = lambda at: F.ln(F.greatest(at - d, z0) / z0)
    ratio = lambda at: F.when(F.abs(log(z_ref)) < 1e-12, 1.0).otherwise(log(at) / log(z_ref))
    return F.when((z_ref < hr) & (z < hr), F.exp(a * (z - z_ref) / hr)).when(z < hr, F.exp(a * (z / hr - 1)) * ratio(hr)).otherwise(ratio(z))


def hanna_britter(lambda_f: Column, hr: Column) -> tuple[Column, Column]:
    """(d, z0) by frontal density."""
    f = F.least(lambda_f, F.lit(1.0))
    d = F.when(f <= 0.05, 3 * f * hr).when(f < 0.15, (0.15 + 5.5 * (f - 0.05)) * hr).when(f < 1.0, (0.7 + 0.35 * (f - 0.15)) * hr).otherwise(hr)
    z0 = F.when(f < 0.15, f * hr).otherwise(0.15 * hr)
    return at_least(d, 0.0), at_least(z0, 0.01)


def ellipse(part: Column, whole: Column) -> Column:
    """sqrt(1 - (part / whole)^2), 0 outside."""
    q = part / whole
    return F.sqrt(at_least(1 - q * q, 0.0))


def zone_code(along: Column, cross: Column, b: Column) -> Column:
    """Zone of a point relative to a building: struct b of h, w, l, weff, leff and the lengths lu, lfv, lr, lw."""
    half_l, half_w = b["l"] / 2, b["w"] / 2
    up, down, side = -(along + half_l), along - half_l, cross / half_w
    in_up = lambda n: (up <= n) & ((up / n) * (up / n) + side * side <= 1)
    wide = half_w > 1e-10
    return (
        F.when((F.abs(along) <= half_l) & (F.abs(cross) <= half_w), INSIDE)
        .when((up > 0) & wide & in_up(b["lu"]) & (b["lfv"] > 1e-10) & in_up(b["lfv"]), UPWIND_VORTEX)
        .when((up > 0) & wide & in_up(b["lu"]), UPWIND)
        .when((down > 0) & (down <= b["lr"]) & wide & (F.abs(cross) <= half_w * ellipse(down, b["lr"])), CAVITY)
        .when((down > b["lr"]) & (down <= b["lw"]) & wide & (F.abs(cross) <= half_w * ellipse(down, b["lw"])), WAKE)
        .otherwise(FREE)
    )


def zone_factor(zone: Column, along: Column, z: Column, b: Column, profile: Profile) -> Column:
    """Speed over the reference speed in a zone; negative where the flow turns back."""
    h, half_l = b["h"], b["l"] / 2
    up, down = -(along + half_l), along - half_l
    roof, here = profile.ratio(h), profile.ratio(z)
    vortex_top = 0.5 * h * ellipse(up, b["lfv"])
    vortex = F.when(z < vortex_top, -(0.6 * F.cos(math.pi * z / (0.5 * h)) + 0.05) * 0.6 * F.sin(math.pi * up / b["lfv"])).otherwise(0.0) * roof
    vortex = F.when((b["lfv"] <= 0) | (h <= 0), CDZ * 0.5 * roof).otherwise(vortex)
    front = F.when((z < 0.6 * h * ellipse(up, b["lu"])) & (h > 0), CDZ * F.pow(z / h, F.lit(P_PROFILE))).otherwise(CDZ * 0.5) * roof
    front = F.when(b["lu"] <= 0, CDZ * 0.5).otherwise(front)
    term = 1 - (down / b["lr"]) * ellipse(z, h)
    cavity = F.when(z < h * ellipse(down, b["lr"]), -(term * term)).otherwise(-0.5) * roof
    cavity = F.when((b["lr"] <= 0) | (h <= 0), -0.5 * profile.ratio(at_least(h, 0.01))).otherwise(cavity)
    wake = F.when(z < h * ellipse(down, b["lw"]), at_least(1 - F.pow(b["lr"] / down, F.lit(1.5)) * F.pow(ellipse(z, h), F.lit(1.5)), 0.0)).otherwise(1.0) * here
    wake = F.when((b["lw"] <= b["lr"]) | (down <= 1e-10) | (h <= 0), here).otherwise(wake)
    free = F.when(z > h, here).otherwise(1.0)
    return F.when(zone == INSIDE, 0.0).when(zone == UPWIND_VORTEX, vortex).when(zone == UPWIND, front).when(zone == CAVITY, cavity).when(zone == WAKE, wake).otherwise(free)


def _clamped(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def vegetation_built(z: Column, top: Column, z0: Column, alpha: Column) -> Column:
    inner, rough = at_least(z, 0.01), at_least(z0, 0.01)
    value = F.ln(top / rough) / F.ln(inner / rough) * F.exp(alpha * (inner / top - 1))
    return F.when((top <= 0) | (z <= 0) | (inner >= top), 1.0).otherwise(_clamped(value))


def vegetation_open(z: Column, top: Column, z0: Column, d: Column, alpha: Column) -> Column:
    """Below the canopy and above it, in open country."""
    inner, rough = at_least(z, 0.01), at_least(z0, 0.01)
    below = F.ln(F.greatest(top - d, rough + 0.01) / rough) / F.ln(inner / rough) * F.exp(alpha * (inner / top - 1))
    below = F.when((top <= 0) | (z <= 0) | (inner >= top), 1.0).otherwise(_clamped(below))
    above = F.when(z <= 0, 1.0).otherwise(_clamped(F.ln(F.greatest(inner - d, rough + 0.01) / rough) / F.ln(inner / rough)))
    return F.when(z < top, below).otherwise(above)


def vegetation_factor(z: Column, top: Column, z0: Column, d: Column, alpha: Column, built_up: bool) -> Column:
    return vegetation_built(z, top, z0, alpha) if built_up else vegetation_open(z, top, z0, d, alpha)

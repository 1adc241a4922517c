"""Column expressions for flow conditions and error measures (all JVM-side)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Air at 298.15 K (polynomial coefficients in temperature, constant term first),
# the viscosity used for wall shear, and the legacy flat-plate constants.
AIR_TEMPERATURE = 298.15
AIR_NU_POLYNOMIAL = (-3.400747e-6, 3.452139e-8, 1.00881778e-10, -1.363528e-14)
WALL_NU = 1.56e-5
LEGACY_NU = 1.5e-5
LEGACY_RHO = 1.225
CHORD = 1.0


def nu_air(temperature: float = AIR_TEMPERATURE) -> float:
    return math.fsum(c * temperature**k for k, c in enumerate(AIR_NU_POLYNOMIAL))


def reynolds(u_inf: Column, chord: float = CHORD) -> Column:
    return u_inf * F.lit(chord) / F.lit(nu_air())


def dynamic_pressure(u_inf: Column) -> Column:
    """Kinematic: half the squared speed."""
    return F.lit(0.5) * u_inf * u_inf


def speed_from_reynolds(re: Column, nu: float = LEGACY_NU, chord: float = CHORD) -> Column:
    return re * F.lit(nu) / F.lit(chord)


def flow_directions(alpha_deg: Column, u_inf: Column) -> dict[str, Column]:
    """Velocity components and unit lift/drag directions for an angle of attack."""
    c, s = F.cos(F.radians(alpha_deg)), F.sin(F.radians(alpha_deg))
    return {"ux": u_inf * c, "uy": u_inf * s, "lift_x": -s, "lift_y": c, "drag_x": c, "drag_y": s}


def first_cell_height(re: Column, y_plus: Column, nu: float = LEGACY_NU, rho: float = LEGACY_RHO, chord: float = CHORD) -> Column:
    """Wall distance that gives ``y_plus`` on a turbulent flat plate: Cf = 0.026 / Re^(1/7)."""
    friction = F.lit(0.026) / F.pow(re, F.lit(1.0 / 7.0))
    speed = speed_from_reynolds(re, nu, chord)
    shear = F.lit(0.5 * rho) * speed * speed * friction
    return y_plus * F.lit(nu) / F.sqrt(shear / F.lit(rho))


def boundary_layer_thickness(re: Column, chord: float = CHORD) -> Column:
    return F.lit(0.37 * chord) / F.pow(re, F.lit(0.2))


def classify_regime(alpha_deg: Column, re: Column, thickness: Column) -> Column:
    """Flow regime letter; the first rule that holds wins."""
    thin_enough = (thickness >= 0.10) & (thickness <= 0.18)
    return (F.when(alpha_deg >= 10.0, "B")
            .when(re < 1.0e6, "C")
            .when((re >= 2.0e6) & (alpha_deg <= 6.0) & thin_enough, "D")
            .otherwise("A"))


# --- error measures --------------------------------------------------------------------------------

def relative_error(true: Column, pred: Column) -> Column:
    """abs((true - pred) / true) with no guard near zero: 0/0 is NaN and x/0 infinite, as in IEEE."""
    gap = F.abs(true - pred)
    return (F.when((true == 0) & (gap == 0), F.lit(float("nan")))
            .when(true == 0, F.lit(float("inf")))
            .otherwise(F.try_divide(gap, F.abs(true))))


def percent_error(value: Column, reference: Column) -> Column:
    """Signed percent of the reference; NaN where the reference is zero or NaN, null where it is null."""
    undefined = (reference == 0) | F.isnan(reference)
    return F.when(undefined, F.lit(float("nan"))).otherwise(F.lit(100.0) * F.try_divide(value - reference, reference))


def absolute_percent_error(value: Column, reference: Column) -> Column:
    return F.abs(percent_error(value, reference))


def is_finite(x: Column) -> Column:
    """False for null, NaN and both infinities."""
    x = x.cast("double")
    return F.coalesce(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), F.lit(False))


def is_close(a: Column, b: Column, atol: float = 1e-8, rtol: float = 1e-5) -> Column:
    """abs(a - b) <= atol + rtol * abs(b): the relative part is there whatever ``atol`` is."""
    return F.coalesce(F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b), F.lit(False)) & ~F.isnan(a) & ~F.isnan(b)

"""Uncertainty bands and case errors as column sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the two-sided 95 % normal quantile, as published.
Z95 = 1.96


def defined(x: Column) -> Column:
    """The value, with NaN as null: a missing sigma."""
    return F.nanvl(x, F.lit(None).cast("double"))


def posterior_columns(cl: Column, cl_std: Column, log_cd: Column, log_cd_std: Column) -> dict[str, Column]:
    """Lift, drag and +-2 sigma bands from model space (Cl, log Cd).

    The drag band is exp(log Cd +- 2 sigma), so it is asymmetric; ``Cd_std`` is the delta method.
    """
    cd = F.exp(log_cd)
    return {
        "Cl": cl, "Cl_std": cl_std, "Cl_lo": cl - 2 * cl_std, "Cl_hi": cl + 2 * cl_std,
        "Cd": cd, "Cd_std": cd * log_cd_std,
        "Cd_lo": F.exp(log_cd - 2 * log_cd_std), "Cd_hi": F.exp(log_cd + 2 * log_cd_std),
        "L_over_D": F.try_divide(cl, cd),
    }


def add_95_band(df: DataFrame) -> DataFrame:
    """95 % limits for Cl, Cd and L/D of rows with Cl, Cd, L_over_D, Cl_std, Cd_std.

    Drag is log-normal with sigma = Cd_std / Cd; L/D uses first-order propagation, 0 where undefined.
    Rows without a sigma get null limits for Cl and Cd.
    """
    cl_std, cd_std = defined(F.col("Cl_std")), defined(F.col("Cd_std"))
    s_log = F.try_divide(cd_std, F.col("Cd"))
    spread = F.sqrt(F.pow(F.try_divide(cl_std, F.nullif(F.col("Cl"), F.lit(0.0))), 2) + s_log * s_log)
    wide = df.withColumns({
        "Cl_lo95": F.col("Cl") - Z95 * cl_std, "Cl_hi95": F.col("Cl") + Z95 * cl_std,
        "Cd_lo95": F.col("Cd") * F.exp(-Z95 * s_log), "Cd_hi95": F.col("Cd") * F.exp(Z95 * s_log),
        "L_over_D_std": F.coalesce(F.abs("L_over_D") * spread, F.lit(0.0)),
    })
    return wide.withColumns({
        "L_over_D_lo95": F.col("L_over_D") - Z95 * F.col("L_over_D_std"),
        "L_over_D_hi95": F.col("L_over_D") + Z95 * F.col("L_over_D_std"),
    })


def test_band(target: str) -> tuple[Column, Column]:
    """95 % interval of a scored case; Cd in log space."""
    if target == "Cl":
        s = defined(F.col("Cl_std"))
        return F.col("Cl_pred") - Z95 * s, F.col("Cl_pred") + Z95 * s
    s = defined(F.col("logCd_std"))
    return F.col("Cd_pred") * F.exp(-Z95 * s), F.col("Cd_pred") * F.exp(Z95 * s)


test_band.__test__ = False   # not a test, whatever its name says


def covered_95(target: str) -> Column:
    """Whether the true value lies in the 95 % interval; null without a sigma."""
    lo, hi = test_band(target)
    return (lo <= F.col(f"{target}_true")) & (F.col(f"{target}_true") <= hi)


def covered_2sigma(true: Column, mean: Column, std: Column) -> Column:
    """Model-space coverage flag: abs(true - mean) <= 2 sigma."""
    return F.abs(true - mean) <= 2 * defined(std)


def case_errors(df: DataFrame) -> DataFrame:
    """Absolute lift error and percent drag error of each scored case."""
    return df.withColumns({
        "dCl": F.col("Cl_pred") - F.col("Cl_true"),
        "dCd_pct": 100 * F.try_divide(F.col("Cd_pred") - F.col("Cd_true"), F.col("Cd_true")),
    })

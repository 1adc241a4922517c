"""Published reference tables: layout and provenance of each kind, and reference lookups for cases."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aeroframe.operators.compare import CP_ROLES
from aeroframe.operators.joins import best_by_priority, first_match
from aeroframe.sources.lines import pressure_table, read_zones, surfaced_pressure_table, zone_table


@dataclass(frozen=True)
class ReferenceKind:
    columns: tuple[str, ...]
    constants: dict = field(default_factory=dict)
    zone: str | None = None


# Columns, source text, Reynolds and Mach number and trip state of each published table.
KINDS = {
    "ladson_forces": ReferenceKind(("alpha_deg", "Cl", "Cd"), {"source": "Ladson NASA TM 4074", "Re": 6.0e6, "M": 0.15, "trip_condition": "transition fixed at x/c=0.05"}, "80 grit"),
    "abbott_lift": ReferenceKind(("alpha_deg", "Cl"), {"source": "Abbott & von Doenhoff (digitized)", "Re": 6.0e6, "M": 0.0, "trip_condition": "natural"}),
    "abbott_polar": ReferenceKind(("Cl", "Cd"), {"source": "Abbott & von Doenhoff drag polar (digitized)", "Re": 6.0e6, "M": 0.0, "trip_condition": "natural"}),
    "gregory_lift": ReferenceKind(("alpha_deg", "Cl"), {"source": "Gregory & O'Reilly (ARC R&M 3726, 1970, digitized)", "Re": 3.0e6, "M": 0.0, "trip_condition": "tripped"}),
    "cfd_forces": ReferenceKind(("alpha_deg", "Cl", "Cd"), {"source": "CFD", "Re": 6.0e6, "M": 0.15, "trip_condition": "fully turbulent"}),
}
WADCOCK = {"alpha_deg": 13.87, "source": "Coles & Wadcock (AIAA J. 17, 1979)", "Re": 1.52e6, "M": 0.0}
POLAR_TOLERANCE, ZONE_TOLERANCE = 0.05, 0.5


def force_reference(lines: DataFrame, kind: str, source: str | None = None, all_zones: bool = False) -> DataFrame:
    """Force rows of one kind with their provenance; the zone, where a kind names one, can be lifted."""
    k = KINDS[kind]
    constants = {**k.constants, **({"source": source} if source else {})}
    out = zone_table(read_zones(lines, strict=False), k.columns, constants, None if all_zones else k.zone)
    if kind == "ladson_forces":
        out = out.withColumn("source", F.concat(F.col("source"), F.lit(" ("), F.col("zone"), F.lit(")")))
    return out if "Cd" in k.columns else out.withColumn("Cd", F.lit(None).cast("double"))


def pressure_reference(lines: DataFrame, source: str) -> DataFrame:
    """Pressure rows with the angle of their zone title."""
    return pressure_table(read_zones(lines, strict=False), source)


def loop_pressure_reference(lines: DataFrame) -> DataFrame:
    """Pressure rows of a walk round the section, split by the sign of y."""
    return surfaced_pressure_table(read_zones(lines, strict=False), WADCOCK)


def all_references(*tables: DataFrame) -> DataFrame:
    """One reference table; columns a source does not have are null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def zone_at(reference: DataFrame, alpha: float, tolerance: float = ZONE_TOLERANCE) -> DataFrame:
    """Rows of the zones whose angle matches; all rows if none does."""
    hit = F.abs(F.col("alpha_deg") - alpha) <= tolerance + 1e-5 * abs(alpha)
    matched = reference.filter(hit)
    return matched if matched.limit(1).count() else reference


def fill_from_polars(references: DataFrame, polars: DataFrame) -> DataFrame:
    """Inline values first; a reference of a tool without values takes the polar row at its angle.

    ``references``: polar (name or null), alpha_deg, tool, Cl, Cd; ``polars``: polar, seq, alpha_deg, Cl, Cd.
    """
    found = first_match(references, polars, ["polar"], "alpha_deg", "alpha_deg", "seq", ["Cl", "Cd"], POLAR_TOLERANCE)
    asks = (F.col("tool") == "xfoil") & F.col("Cl").isNull() & F.col("Cd").isNull()
    return found.withColumns({c: F.when(asks, F.col(f"match_{c}")).otherwise(F.col(c)) for c in ("Cl", "Cd")}).drop("match_Cl", "match_Cd")


def chosen_pressure_source(references: DataFrame) -> DataFrame:
    """The file a case's pressure is compared with: engineering first, then CFD, then experiment."""
    file = F.when(F.col("role") == CP_ROLES[0], F.when(F.col("tool") == "xfoil", F.col("expected_file"))).otherwise(F.col("file_cp"))
    known = references.withColumn("file", file)
    return best_by_priority(known, ["case_id"], F.col("role"), list(CP_ROLES), F.col("file").isNotNull() & F.col("role").isin(*CP_ROLES), ["seq"])

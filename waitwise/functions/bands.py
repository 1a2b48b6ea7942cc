"""Named value bands (half-open [lo, hi) intervals) as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The reference's interpretation scales, lower bound -> label, highest first.
R2_BANDS = [(0.8, "exceptional"), (0.6, "good"), (0.4, "acceptable"), (0.2, "weak"), (None, "unusable")]
WEIGHT_BANDS = [(0.2, "critical"), (0.1, "high"), (0.04, "medium"), (0.01, "low"), (None, "ignore")]
SIGNIFICANCE_ALPHA = 0.05
# Our default trend-coefficient scale (the reference names the band but not its edges).
TREND_BANDS = [(0.5, "strong growth"), (0.1, "growth"), (-0.1, "stable"), (-0.5, "decline"),
               (None, "strong decline")]
# Our default |r| scale for correlation strength.
CORRELATION_BANDS = [(0.7, "strong"), (0.5, "noticeable"), (0.3, "moderate"), (0.1, "weak"), (None, "none")]


def band_label(col: Column | str, bands: list[tuple[float | None, str]]) -> Column:
    """Map a value to the label of the first band whose lower bound it reaches.

    ``bands`` is ordered from the highest lower bound down; ``None`` marks the
    catch-all bottom band. NULL input gives NULL.
    """
    c = F.col(col) if isinstance(col, str) else col
    expr = None
    for lo, label in bands:
        cond = F.lit(True) if lo is None else c >= F.lit(float(lo))
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return F.when(c.isNull(), F.lit(None).cast("string")).otherwise(expr)


def band_sql(col: str, bands: list[tuple[float | None, str]]) -> str:
    """The same band mapping as ANSI SQL text (for oracles and SQL users)."""
    parts = [f"WHEN {col} IS NULL THEN NULL"]
    for lo, label in bands:
        parts.append(f"ELSE '{label}'" if lo is None else f"WHEN {col} >= {float(lo)!r} THEN '{label}'")
    return "CASE " + " ".join(parts) + " END"


def r2_band(col: Column | str) -> Column:
    return band_label(col, R2_BANDS)


def weight_band(col: Column | str) -> Column:
    return band_label(col, WEIGHT_BANDS)


def trend_band(col: Column | str, bands: list[tuple[float | None, str]] = TREND_BANDS) -> Column:
    return band_label(col, bands)

"""Error-grid zones as column expressions, and their texts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONES = ("A", "B", "C", "D", "E")


@dataclass(frozen=True)
class ParkesLimits:
    """Thresholds of one Parkes variant."""

    near: float  # share of the reference that counts as accurate
    wide: float  # share that counts as benign in the middle band
    low_b: float  # benign limit for a low reference
    low_c: float  # overcorrection limit for a low reference
    mid_high: float  # overcorrection limit for a mid-range reference
    mid_low: float  # dangerous limit for a mid-range reference
    upper: float  # reference from which the high band starts


# Thresholds of the two Parkes variants, mg/dL and shares.
PARKES = {
    "type1": ParkesLimits(0.15, 0.20, 110, 180, 250, 56, 240),
    "type2": ParkesLimits(0.20, 0.25, 120, 200, 300, 50, 300),
}
LOW, HIGH = 70.0, 180.0
CLARKE_NEAR = 0.2

# Texts per zone.
CLARKE_TEXT = {
    "A": "Clinically accurate: Within 20% of reference or both < 70 mg/dL",
    "B": "Benign errors: Deviations that would not lead to inappropriate treatment",
    "C": "Overcorrection errors: Deviations leading to unnecessary corrections",
    "D": "Dangerous errors: Failure to detect hypoglycemia or hyperglycemia",
    "E": "Erroneous treatment: Deviations that could lead to dangerous treatment decisions",
}
PARKES_TEXT = {
    "A": "Clinically accurate: No effect on clinical action",
    "B": "Benign errors: Little or no effect on clinical outcome",
    "C": "Overcorrection errors: Likely to affect clinical action but unlikely to affect clinical outcome",
    "D": "Dangerous errors: Likely to affect clinical action and likely to affect clinical outcome",
    "E": "Erroneous treatment: Likely to affect clinical action and could have significant medical risk",
}

# Fixed values: (lower bound in percent, text) of zones A+B and of zone A; (upper bound, text) of D+E.
CLARKE_BANDS = {
    "acceptable": [
        (95, "Excellent clinical accuracy (≥95% in zones A+B)"),
        (90, "Good clinical accuracy (≥90% in zones A+B)"),
        (80, "Acceptable clinical accuracy (≥80% in zones A+B)"),
        (None, "Poor clinical accuracy (<80% in zones A+B)"),
    ],
    "precision": [
        (75, "High precision (≥75% in zone A)"),
        (60, "Moderate precision (≥60% in zone A)"),
        (None, "Low precision (<60% in zone A)"),
    ],
    "danger": [
        (2, "Low safety risk (≤2% dangerous errors)"),
        (5, "Moderate safety risk (≤5% dangerous errors)"),
        (None, "High safety risk (>5% dangerous errors)"),
    ],
}
PARKES_BANDS = {
    "acceptable": [
        (99, "Excellent clinical accuracy (≥99% in zones A+B)"),
        (95, "Very good clinical accuracy (≥95% in zones A+B)"),
        (90, "Good clinical accuracy (≥90% in zones A+B)"),
        (85, "Acceptable clinical accuracy (≥85% in zones A+B)"),
        (None, "Poor clinical accuracy (<85% in zones A+B)"),
    ],
    "precision": [
        (85, "Excellent precision (≥85% in zone A)"),
        (75, "Good precision (≥75% in zone A)"),
        (65, "Acceptable precision (≥65% in zone A)"),
        (None, "Poor precision (<65% in zone A)"),
    ],
    "danger": [
        (1, "Excellent safety profile (≤1% dangerous errors)"),
        (2, "Good safety profile (≤2% dangerous errors)"),
        (3, "Acceptable safety profile (≤3% dangerous errors)"),
        (None, "Poor safety profile (>3% dangerous errors)"),
    ],
}


def _first(rules: list[tuple[Column, str]], otherwise: Column | str) -> Column:
    out = F.when(*rules[0])
    for test, zone in rules[1:]:
        out = out.when(test, zone)
    return out.otherwise(otherwise)


def clarke_zone(reference: Column, predicted: Column) -> Column:
    """Clarke zone A to D.

    Stated as disjoint regions: accurate pairs are A, then each reference band
    (low, normal, high) maps the prediction's band to a zone. What no band covers
    is graded by relative error. Zone E is not reachable under these rules.
    """
    r, p = reference.cast("double"), predicted.cast("double")
    error = F.abs(p - r)
    low, high = r < LOW, r > HIGH
    normal = ~low & ~high
    accurate = (error <= r * CLARKE_NEAR) | (low & (p < LOW))
    benign = (
        (low & p.between(LOW, HIGH)) | (high & (p >= LOW) & (p < r)) | (normal & p.between(LOW, HIGH))
    )
    overcorrected = (low & (p > HIGH)) | (high & (p < LOW)) | (normal & (p > HIGH))
    missed_low = normal & (p < LOW)
    graded = _first([(error <= r * 0.3, "B"), (error <= r * 0.5, "C")], "D")
    return _first([(accurate, "A"), (benign, "B"), (overcorrected, "C"), (missed_low, "D")], graded)


def clarke_zone_simple(reference: Column, predicted: Column) -> Column:
    """The coarser Clarke rules, which do reach zone E."""
    r, p = reference.cast("double"), predicted.cast("double")
    low_side = _first([(p <= LOW, "A"), (p <= HIGH, "B")], "C")
    high_side = _first([(p < LOW, "E"), (p <= r + r * CLARKE_NEAR, "A")], "C")
    above = _first([(p <= HIGH, "B")], "C")
    below = _first([(p >= LOW, "B"), (p >= 56, "D")], "E")
    middle = F.when(F.abs(p - r) <= r * CLARKE_NEAR, "A").otherwise(F.when(p > r, above).otherwise(below))
    return F.when(r <= LOW, low_side).otherwise(F.when(r >= HIGH, high_side).otherwise(middle))


def parkes_zone(reference: Column, predicted: Column, kind: str = "type1") -> Column:
    """Parkes zone for ``type1`` or ``type2``."""
    if kind not in PARKES:
        raise ValueError(f"kind must be one of {tuple(PARKES)}")
    k = PARKES[kind]
    r, p = reference.cast("double"), predicted.cast("double")
    error = F.abs(p - r)
    near = error <= r * k.near
    # The relative band is compared as bounds on the prediction as well; the two
    # tests differ only in the last floating-point digit.
    at_least, at_most = p >= r * (1 - k.near), p <= r * (1 + k.near)
    low = _first([(p <= LOW, "A"), (p <= k.low_b, "B"), (p <= k.low_c, "C")], "E")
    middle = _first(
        [
            (near, "A"),
            (error <= r * k.wide, "B"),
            ((p > r) & (p <= k.mid_high), "C"),
            (p > r, "E"),
            (p >= LOW, "B"),
            (p >= k.mid_low, "D"),
        ],
        "E",
    )
    raised = _first([(near, "A"), (at_least & at_most, "B"), (p > r, "C"), (p >= LOW, "B")], "D")
    top = _first([(near, "A"), (at_least, "B"), (p >= LOW, "C")], "D")
    return F.when(r <= LOW, low).otherwise(
        F.when(r <= HIGH, middle).otherwise(F.when(r <= k.upper, raised).otherwise(top))
    )


def band_text(value: Column, bands: list[tuple[float | None, str]], rising: bool = True) -> Column:
    """Text of the first band that ``value`` reaches (or, falling, does not exceed)."""
    tests = [((value >= b) if rising else (value <= b), text) for b, text in bands if b is not None]
    return _first(tests, bands[-1][1])


def interpretation(bands: dict, acceptable: Column, zone_a: Column, danger: Column, *more: Column) -> Column:
    """Texts for A+B, A and D+E in one line."""
    return F.concat_ws(
        "; ",
        band_text(acceptable, bands["acceptable"]),
        band_text(zone_a, bands["precision"]),
        band_text(danger, bands["danger"], rising=False),
        *more,
    )

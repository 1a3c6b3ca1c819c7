"""Scalar functions as Column expressions: all but ``display_matches`` stay inside code generation."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

#: A number in a displayed text.
_SHOWN = re.compile(r"-?[0-9]+[.]?[0-9]*")


def squared_error(y: Column, p: Column) -> Column:
    return (y - p) * (y - p)


def absolute_error(y: Column, p: Column) -> Column:
    return F.abs(y - p)


def brier(y: Column, p: Column) -> Column:
    """Raises unless y is 0 or 1 and p is in [0, 1]."""
    ok = y.isin(0, 1) & p.between(0, 1)
    return F.when(ok, (y - p) * (y - p)).otherwise(F.raise_error(F.lit("brier: target 0 or 1, prediction in [0, 1]")))


def log_loss_bits(y: Column, p: Column, clip: float = 1e-12) -> Column:
    q = F.greatest(F.least(p, F.lit(1 - clip)), F.lit(clip))
    ok = y.isin(0, 1) & p.between(0, 1)
    return F.when(ok, -(y * F.log2(q) + (1 - y) * F.log2(1 - q))).otherwise(F.raise_error(F.lit("log loss: target 0 or 1, prediction in [0, 1]")))


def leakage_score(balanced_accuracy: Column, chance: Column) -> Column:
    """Accuracy over chance, in [0, 1]; 0 where chance leaves no room."""
    raw = (balanced_accuracy - chance) / (1 - chance)
    return F.when(chance >= 1, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)))


def severity(score: Column, moderate: float = 0.15, severe: float = 0.50) -> Column:
    return F.when(score >= severe, "severe").when(score >= moderate, "moderate").otherwise("low")


def risk_verdict(low: Column, high: Column, tolerance: float) -> Column:
    return F.when(low.isNull() | high.isNull(), "inconclusive").when(low > tolerance, "premature_compression").when(high <= tolerance, "bounded_risk_adequacy").otherwise("inconclusive")


def advantage_verdict(high: Column, tolerance: float | None) -> Column:
    if tolerance is None:
        return F.lit("not_declared")
    return F.when(high.isNull(), "inconclusive").when(high < -tolerance, "compact_arm_advantage").otherwise("not_demonstrated")


def component_verdict(support: Column, risk: Column) -> Column:
    lost = (support == "support_loss") | (risk == "premature_compression")
    good = (support == "within_support_tolerances") & (risk == "bounded_risk_adequacy")
    return F.when(lost, "loss_detected").when(good, "bounded_event_support_and_common_risk").otherwise("inconclusive")


#: Seconds of each unit of time; other units compare only with themselves.
UNIT_SECONDS = {"microseconds": 1e-6, "milliseconds": 1e-3, "seconds": 1.0, "minutes": 60.0, "hours": 3600.0, "days": 86400.0}


def elapsed_seconds(value: Column, unit: Column) -> Column:
    """Null for units that aren't time."""
    scale = F.create_map(*[x for k, v in UNIT_SECONDS.items() for x in (F.lit(k), F.lit(v))])
    return value * scale[unit]


def compare_elapsed(a_value: Column, a_unit: Column, a_origin: Column, b_value: Column, b_unit: Column, b_origin: Column) -> Column:
    """-1, 0, 1; null where origins differ or the units can't be compared."""
    a, b = elapsed_seconds(a_value, a_unit), elapsed_seconds(b_value, b_unit)
    same = a_unit.eqNullSafe(b_unit)
    x, y = F.when(same, a_value).otherwise(a), F.when(same, b_value).otherwise(b)
    return F.when(a_origin.eqNullSafe(b_origin), F.signum(x - y).cast("int"))


def offset_timestamp(text: Column) -> Column:
    """An ISO 8601 time with an offset; null without one."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?([Zz]|[+-]\d{2}:?\d{2})$"), F.try_to_timestamp(text))


def label_token(kind: str, value: Column) -> Column:
    """Labels of different types never meet: ``int:1`` is not ``str:1``."""
    return F.concat(F.lit(kind + ":"), value.cast("string"))


def policy_numbers(text: Column, pattern: str, groups: int = 3) -> list[Column]:
    """Numbers of a named policy (``_`` is the decimal point); null without a match."""
    out = []
    for i in range(1, groups + 1):
        m = F.regexp_extract(text, pattern, i)
        out.append(F.when(text.rlike(pattern), F.replace(m, F.lit("_"), F.lit(".")).try_cast("double")))
    return out


def in_bounds(value: Column, low: float, high: float) -> Column:
    return value.between(low, high)


def _with(value: Column, f) -> Column:
    """``f`` of a value that is computed once, not once per element."""
    return F.transform(F.array(value), f)[0]


def zscores(x: Column, eps: float = 1e-6) -> Column:
    """Each element less the mean, over the population deviation plus ``eps``."""
    mean = F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / F.size(x)

    def centred(m):
        var = F.aggregate(x, F.lit(0.0), lambda a, v: a + (v - m) * (v - m)) / F.size(x)
        return _with(F.sqrt(var), lambda d: F.transform(x, lambda v: (v - m) / (d + eps)))

    return _with(mean, centred)


def l1_normalized(x: Column, eps: float = 1e-6) -> Column:
    total = F.aggregate(x, F.lit(0.0), lambda a, v: a + F.abs(v))
    return _with(total, lambda t: F.transform(x, lambda v: v / (t + eps)))


def differences(x: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(x) - 1), lambda i: F.get(x, i) - F.get(x, i - 1))


def peak_density(x: Column, threshold: float) -> Column:
    """Share of interior points above ``threshold``, strictly above their left neighbour and not
    below their right one; 0 without an interior."""
    at = F.sequence(F.lit(1), F.size(x) - 2)
    peak = F.filter(at, lambda i: (F.get(x, i) > F.get(x, i - 1)) & (F.get(x, i) >= F.get(x, i + 1)) & (F.get(x, i) > threshold))
    return F.when(F.size(x) >= 3, F.size(peak) / (F.size(x) - 2)).otherwise(F.lit(0.0))


@F.pandas_udf(BooleanType())
def _rounds_to(shown: pd.Series, values: pd.Series) -> pd.Series:
    """Python's own rounding: to even on exact ties, judged on the double's exact value."""

    def one(text, held):
        if text is None or held is None:
            return False
        numbers = _SHOWN.findall(text)
        if len(numbers) != len(held):
            return False
        places = [len(n.partition(".")[2]) for n in numbers]
        return all(v is not None and v == v and round(float(v), p) == float(n) for v, n, p in zip(held, numbers, places))

    return pd.Series([one(t, v) for t, v in zip(shown, values)], dtype=bool)


def display_matches(shown: Column, values: Column) -> Column:
    """Whether a shown text has as many numbers as there are ``values`` (an array of doubles), and each value rounded to the
    decimals shown is the number in its place.  Nulls never match."""
    return _rounds_to(shown, values)


"""Scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import _c, first_match

WEIGHTS = {"duration": 0.50, "stages": 0.25, "hrv": 0.05, "resting_hr": 0.15, "awake": 0.05}
DEEP, REM = 0.18, 0.22
NEUTRAL, SLOPE = 0.65, 1.5
AWAKE_ZERO = 0.15


def _clamp(x: Column) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))


def duration_component(hours, need) -> Column:
    """PRJ-26: nearness to the need; a shortfall costs three times a surplus."""
    dev = (_c(hours) - _c(need)) / _c(need)
    return F.when(_c(need) <= 0, 0.0).otherwise(_clamp(F.when(dev >= 0, 1 - 0.5 * dev).otherwise(1 + 1.5 * dev)))


def stage_component(hours, deep, rem) -> Column:
    one = lambda v, best: F.when(_c(v) >= 0, _clamp(1 - F.abs(_c(v) / _c(hours) - best) / best))
    a, b = one(deep, DEEP), one(rem, REM)
    return F.when(a.isNotNull() & b.isNotNull(), (a + b) / 2).otherwise(F.coalesce(a, b))


def ratio_component(seen, baseline, higher_is_better: bool) -> Column:
    rel = (_c(seen) - _c(baseline)) / _c(baseline)
    return F.when(_c(baseline) > 0, _clamp(NEUTRAL + (rel if higher_is_better else -rel) * SLOPE))


def awake_component(awake, hours) -> Column:
    total = _c(hours) + _c(awake)
    return F.when((_c(awake) >= 0) & (total > 0), _clamp(1 - F.try_divide(_c(awake), total) / AWAKE_ZERO))


def sleep_score(hours="sleep_hours", deep="sleep_deep_hrs", rem="sleep_rem_hrs", resting_hr="resting_hr", hrv="hrv_rmssd", awake=None, need=8.0, hrv_baseline=None, resting_hr_baseline=None) -> Column:
    """SCO-01: 0 to 100, the weighted mean of the components whose inputs are there; null without sleep. Not rounded."""
    null = F.lit(None).cast("double")
    some = lambda x: null if x is None else _c(x)
    need = F.lit(need) if isinstance(need, (int, float)) else _c(need)
    h = F.when(_c(hours) > 0, _c(hours))
    parts = [
        (WEIGHTS["duration"], duration_component(h, need)), (WEIGHTS["stages"], stage_component(h, some(deep), some(rem))),
        (WEIGHTS["hrv"], ratio_component(some(hrv), some(hrv_baseline), True)), (WEIGHTS["resting_hr"], ratio_component(some(resting_hr), some(resting_hr_baseline), False)), (WEIGHTS["awake"], awake_component(some(awake), h)),
    ]
    top = sum((F.coalesce(w * v, F.lit(0.0)) for w, v in parts), F.lit(0.0))
    base = sum((F.when(v.isNotNull(), w).otherwise(0.0) for w, v in parts), F.lit(0.0))
    return F.when(h.isNotNull(), F.least(F.greatest(top / base * 100, F.lit(0.0)), F.lit(100.0)))


def readiness(debt="sleep_debt_7d", suppressed="hrv_suppressed_days", acwr="acute_chronic_ratio", sleep_days="recovery_sleep_days_7d", hrv_days="recovery_hrv_days_7d", most: float = 1.5) -> Column:
    """SCO-02: null where neither sleep nor HRV was seen. Not rounded."""
    v = 100 - F.least(F.lit(40.0), F.coalesce(_c(debt) * 4, F.lit(0.0))) - F.least(F.lit(40.0), F.coalesce(_c(suppressed) * 8.0, F.lit(0.0))) - F.when(_c(acwr) > most, 20.0).otherwise(0.0)
    return F.when((F.coalesce(_c(sleep_days), F.lit(0)) > 0) | (F.coalesce(_c(hrv_days), F.lit(0)) > 0), F.least(F.greatest(v, F.lit(0.0)), F.lit(100.0)))


#: Thresholds of the training-pace lights (fixed values).
PACE = {"acwr_green_low": 0.8, "acwr_green_high": 1.3, "acwr_yellow_high": 1.5, "wow_drop": 25.0, "month_yellow": 30.0, "month_red": 50.0}
SPIKES = {"strength": (12.0, 20.0), "cardio": (10.0, 15.0)}


def _light(pairs, seen) -> Column:
    """Rank (0 unknown, 1 green, 2 yellow, 3 red) and direction of one signal."""
    kind = lambda r, d: F.struct(F.lit(r).alias("rank"), F.lit(d).cast("string").alias("direction"))
    return first_match([(_c(seen).isNull(), kind(0, None)), *[(c, kind(r, d)) for c, r, d in pairs]], kind(1, None))


def pace_lights(acwr, wow, month, domain: str) -> list[Column]:
    """SCO-05: the three signals' lights."""
    yellow, red = SPIKES[domain]
    a, w, m = _c(acwr), _c(wow), _c(month)
    return [
        _light([(a > PACE["acwr_yellow_high"], 3, "high"), (a > PACE["acwr_green_high"], 2, "high"), (a < PACE["acwr_green_low"], 1, "low")], a),
        _light([(w >= red, 3, "high"), (w >= yellow, 2, "high"), (w <= -PACE["wow_drop"], 1, "low")], w),
        _light([(m >= PACE["month_red"], 3, "high"), (m >= PACE["month_yellow"], 2, "high"), (m <= -PACE["month_yellow"], 1, "low")], m),
    ]


def pace_status(acwr, wow, month, domain: str) -> Column:
    """SCO-05: struct of status, direction, label; the worst light decides, `high` before `low` among equals."""
    lights = pace_lights(acwr, wow, month, domain)
    worst = F.greatest(*[x["rank"] for x in lights])
    any_ = lambda d: sum((F.when((x["rank"] == worst) & (x["direction"] == d), 1).otherwise(0) for x in lights), F.lit(0)) > 0
    direction = F.when(any_("high"), "high").when(any_("low"), "low")
    status = first_match([(worst == 3, "red"), (worst == 2, "yellow"), (worst == 1, "green")], "unknown")
    label = first_match([(status == "unknown", "Building baseline"), (F.coalesce(direction, F.lit("")) == "low", "Underloaded — room to push"), (status == "red", "Overloaded — take it easy"), (status == "yellow", "Cautious — ease up a little")], "Good to go")
    return F.struct(status.alias("status"), F.when(status != "unknown", direction).alias("direction"), label.alias("label"))


def goal_pace(done, target, day, week) -> Column:
    """SCO-10: done, not_yet, behind or urgent, by the day of the week."""
    at = F.datediff(_c(day), _c(week))
    return first_match([(_c(target).isNotNull() & (_c(done) >= _c(target)), "done"), (_c(target).isNull() | (at <= 2), "not_yet"), (6 - at < _c(target) - _c(done), "urgent")], "behind")

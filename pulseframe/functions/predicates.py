"""Conditions on rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import _c, in_family, is_bridge, run_pace

STRENGTH_NAMES = ("traditional strength training", "functional strength training", "core training")
PACE_MIN, PACE_MAX = 210.0, 1080.0


def trailing(d, as_of, days: int) -> Column:
    """FLT-01: the last `days` days, as_of included."""
    n = F.datediff(_c(as_of), _c(d))
    return (n >= 0) & (n < days)


def prior(d, as_of, days: int) -> Column:
    """FLT-02: the `days` days before as_of."""
    n = F.datediff(_c(as_of), _c(d))
    return (n > 0) & (n <= days)


def strength_like(activity) -> Column:
    """FLT-03"""
    return F.coalesce(F.lower(F.trim(_c(activity))).isin(*STRENGTH_NAMES), F.lit(False))


def pace_flags(duration="duration_min", miles="distance_miles", activity="activity_type", low: float = PACE_MIN, high: float = PACE_MAX) -> Column:
    """FLT-04, ARR-08: array of quality flags."""
    p = run_pace(duration, miles, activity)
    return F.array_compact(F.array(F.when((p < low) | (p > high), F.lit("implausible_run_pace"))))


def suspect_distance(flags) -> Column:
    return F.array_contains(flags, "implausible_run_pace")


def over_recorded(duration="duration_min", miles="distance_miles", activity="activity_type", low: float = PACE_MIN) -> Column:
    """FLT-05: faster than the band; slow runs stay."""
    return F.coalesce(run_pace(duration, miles, activity) < low, F.lit(False))


def bridge_walk(app="source_app", activity="activity_type") -> Column:
    """FLT-06: steps a bridge app passes on as walks."""
    return is_bridge(app) & in_family(activity, "walk")


def counts_as_load(activity="activity_type", app="source_app") -> Column:
    """FLT-07"""
    return ~strength_like(activity) & ~bridge_walk(app, activity)


def covers(start, end, d, active=None) -> Column:
    """FLT-08: an interval that holds the date; null `active` counts as true."""
    ok = (_c(start) <= _c(d)) & (_c(d) <= _c(end))
    return ok if active is None else ok & F.coalesce(_c(active), F.lit(True))


def in_effect(active, since, until, d) -> Column:
    """FLT-09: open ends where null."""
    return F.coalesce(_c(active), F.lit(True)) & (F.coalesce(_c(since), _c(d)) <= _c(d)) & (F.coalesce(_c(until), _c(d)) >= _c(d))


def affects(types, goal_type) -> Column:
    """FLT-11"""
    return F.coalesce(F.array_contains(_c(types), _c(goal_type)), F.lit(False))


def active_pattern(status="status", description="description") -> Column:
    """FLT-12"""
    return (_c(status) == "active") & (F.trim(F.coalesce(_c(description), F.lit(""))) != "")

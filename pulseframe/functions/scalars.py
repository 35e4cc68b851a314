"""Column functions: dates, numbers, units, names and texts. All give null for input they can't read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LB_PER_KG = 2.2046226218
M_PER_MILE = 1609.344
KM_PER_MILE = 1.609344
FT_PER_M = 3.280839895
KCAL_PER_KJ = 0.239006


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def first_match(pairs, otherwise=None) -> Column:
    """The value of the first condition that holds."""
    out = None
    for cond, value in pairs:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out.otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


def as_date(x) -> Column:
    """PRJ-01, PRJ-04: the calendar date at the start of an ISO text; any offset is left aside."""
    return F.try_to_date(F.substring(_c(x).cast("string"), 1, 10), "yyyy-MM-dd")


def number(x) -> Column:
    """PRJ-02: a finite double."""
    v = _c(x).try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def instant(x) -> Column:
    """PRJ-03: a timestamp of ISO text with T or a space, Z or an offset; without one it is UTC; a bare date is midnight."""
    t = F.regexp_replace(F.trim(_c(x).cast("string")), r"^(\d{4}-\d{2}-\d{2}) (\d)", "$1T$2")
    t = F.regexp_replace(t, r"\s+([+-]\d{2}):?(\d{2})$", "$1:$2")
    t = F.regexp_replace(t, r"([+-]\d{2})(\d{2})$", "$1:$2")
    ok = t.rlike(r"^\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:\d{2})?)?$")
    return F.when(ok, t.try_cast("timestamp"))


def week_start(d) -> Column:
    """PRJ-05: the Monday of the date's week."""
    return F.date_trunc("week", _c(d)).cast("date")


def month_bounds(d) -> tuple[Column, Column]:
    """PRJ-06: the month's first and last day."""
    return F.trunc(_c(d), "MM"), F.last_day(_c(d))


def previous_month(d) -> Column:
    """PRJ-06: the first day of the month before."""
    return F.add_months(F.trunc(_c(d), "MM"), -1)


def km_to_miles(x) -> Column:
    return _c(x) / KM_PER_MILE


def miles_to_km(x) -> Column:
    return _c(x) * KM_PER_MILE


def quantity_to_miles(qty, unit) -> Column:
    """PRJ-08: by the first unit named; an unknown unit is metres; negative gives null."""
    q, u = _c(qty), F.lower(F.coalesce(_c(unit), F.lit("")))
    v = first_match([(u.contains("mi"), q), (u.contains("km"), q * 0.621371192), (u.contains("m"), q / M_PER_MILE), (u.contains("ft"), q / 5280)], q / M_PER_MILE)
    return F.when(q >= 0, v)


def quantity_to_feet(qty, unit) -> Column:
    """PRJ-08: elevation, as above in the order feet, miles, kilometres, metres."""
    q, u = _c(qty), F.lower(F.coalesce(_c(unit), F.lit("")))
    v = first_match([(u.contains("ft"), q), (u.contains("mi"), q * 5280), (u.contains("km"), q * 1000 * FT_PER_M), (u.contains("m"), q * FT_PER_M)], q * FT_PER_M)
    return F.when(q >= 0, v)


def mass_to_lb(qty, unit) -> Column:
    """PRJ-09"""
    return F.when(F.lower(F.coalesce(_c(unit), F.lit(""))).contains("kg"), F.round(_c(qty) * LB_PER_KG, 4)).otherwise(_c(qty))


def sleep_hours(total, asleep) -> Column:
    """PRJ-10: a positive duration; above 72 it is in seconds."""
    v = F.coalesce(number(total), number(asleep))
    return F.when(v > 72, v / 3600).when(v > 0, v)


def stage_hours(v, unit) -> Column:
    """PRJ-11: by the unit, else by size (above 1440 seconds, above 24 minutes)."""
    q, u = number(v), F.lower(F.coalesce(_c(unit), F.lit("")))
    by_size = F.when(q > 1440, q / 3600).when(q > 24, q / 60).otherwise(q)
    return F.when(q >= 0, first_match([(u.contains("min"), q / 60), (u.contains("sec") | (u == "s"), q / 3600), (u.startswith("h"), q)], by_size))


def kilocalories(qty, unit) -> Column:
    """PRJ-12: one quantity; kilojoules are converted."""
    return F.when(F.lower(F.coalesce(_c(unit), F.lit(""))).contains("kj"), _c(qty) * KCAL_PER_KJ).otherwise(_c(qty))


def pace_seconds(seconds, miles) -> Column:
    """PRJ-36: whole seconds a mile; null without distance."""
    return F.when(_c(miles) > 1e-9, F.bround(_c(seconds) / _c(miles)).cast("int"))


def run_pace(duration_min, miles, activity) -> Column:
    """PRJ-14: seconds a mile of a run with duration and distance."""
    ok = (cardio_mode(activity) == "running") & (_c(duration_min) > 0) & (_c(miles) > 0)
    return F.when(ok, F.try_divide(_c(duration_min) * 60, _c(miles)))


def cardio_mode(activity) -> Column:
    """PRJ-15"""
    a = F.lower(F.coalesce(_c(activity), F.lit("")))
    ride = a.contains("cycl") | a.contains("bike") | a.contains("ride") | a.contains("spin")
    return first_match([(a.contains("run"), "running"), (ride, "cycling")], "other")


#: Prefixes of words and their family, in order of precedence (fixed values).
FAMILIES = (("run", "run"), ("jog", "run"), ("walk", "walk"), ("hik", "hike"), ("cycl", "ride"), ("bike", "ride"), ("ride", "ride"), ("spin", "ride"), ("swim", "swim"), ("strength", "strength"), ("weight", "strength"), ("elliptical", "elliptical"), ("row", "row"))


def _family_words(families) -> str:
    """The pattern of a word that begins one of the families' names."""
    return f"(^|[^a-z0-9])({'|'.join(k for k, v in FAMILIES if v in families)})"


def activity_family(activity) -> Column:
    """PRJ-16: by the first family with a word that begins so; else the name itself, of blank `workout`."""
    a = F.lower(F.coalesce(_c(activity), F.lit("")))
    words = [(a.rlike(_family_words([v])), v) for v in dict.fromkeys(v for _, v in FAMILIES)]
    return first_match([(F.trim(a) == "", "workout"), *words], F.regexp_replace(F.trim(a), r"\s+", " "))


def in_family(activity, family: str) -> Column:
    """Is it the activity_family() of the name? Two patterns, for filters."""
    names = list(dict.fromkeys(v for _, v in FAMILIES))
    a = F.lower(F.coalesce(_c(activity), F.lit("")))
    own, before = a.rlike(_family_words([family])), names[: names.index(family)]
    return own & ~a.rlike(_family_words(before)) if before else own


#: Rank of the app a session comes from (fixed values).
APP_RANKS = (("nike run club", 40), ("nike+ run club", 40), ("nrc", 40), ("strava", 30), ("apple watch", 20), ("iphone", 18), ("health", 16), ("fitbit", 10), ("google", 10), ("google fit", 10), ("health sync", 10))
BRIDGES = ("health sync", "fitbit", "google fit", "google")
DEFAULT_RANK = 15


def _one_spaced(x) -> Column:
    return F.regexp_replace(F.trim(F.lower(F.coalesce(_c(x), F.lit("")))), r"\s+", " ")


def app_rank(app) -> Column:
    """PRJ-17: by the longest keyword in the name, in any case and whatever white space is between its words."""
    a = _one_spaced(app)
    return first_match([(a.contains(k), v) for k, v in sorted(APP_RANKS, key=lambda x: -len(x[0]))], DEFAULT_RANK)


def is_bridge(app) -> Column:
    """An app that only passes on others' sessions, in any case and whatever white space is between its words."""
    return F.lower(F.coalesce(_c(app), F.lit(""))).rlike("|".join(BRIDGES).replace(" ", r"\s+"))


def best_app(chains) -> Column:
    """PRJ-18: the app that recorded a session, from its provenance chains (`a|b|c`) in their order.

    The best-ranked name of a chain without a bridge, the first of equals; else the first bridge; else null. Names of
    no rank (devices, unknown apps) never win; names are cut at 200 characters, null chains are skipped.
    """
    parts = F.transform(F.array_compact(chains), lambda c: F.filter(F.transform(F.split(c, r"\|"), lambda x: F.trim(x)), lambda x: x != ""))
    native = F.filter(F.flatten(F.filter(parts, lambda p: ~F.exists(p, is_bridge))), lambda x: app_rank(x) != DEFAULT_RANK)
    best = F.array_max(F.transform(native, lambda x, i: F.struct(app_rank(x).alias("r"), (-i).alias("i"), x.alias("a"))))["a"]
    bridges = F.filter(F.flatten(parts), is_bridge)
    return F.left(F.coalesce(best, F.try_element_at(bridges, F.lit(1))), F.lit(200))


#: Rank of sources of power data (fixed values).
SOURCE_RANKS = {"wahoo_fit": 50, "strava_export": 40, "strava": 25, "apple_health": 20}


def power_source_rank(source) -> Column:
    """PRJ-19"""
    return first_match([(_c(source) == k, v) for k, v in SOURCE_RANKS.items()], 10)


def richness(power: bool = False) -> Column:
    """PRJ-20: how many fields a session has, weighted; with power also those."""
    have = lambda c, w: F.when(F.col(c).isNotNull(), w).otherwise(0)
    base = have("distance_miles", 2) + have("avg_hr", 1) + have("max_hr", 1) + have("elevation_ft", 1)
    if power:
        return base + F.when(F.col("avg_watts").isNotNull() | F.col("power_mmp_json").isNotNull(), 5).otherwise(0)
    return base + have("calories", 1)


def stable_id(prefix: str, *parts, digits: int = 20) -> Column:
    """PRJ-21: an id that depends on the parts alone."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", *[_c(p).cast("string") for p in parts]), 256), 1, digits))


#: Words of exercise names by body half (fixed values).
UPPER_WORDS = ("bench", "press", "chest", "shoulder", "overhead", "ohp", "row", "pull", "lat", "pulldown", "chin", "curl", "tricep", "bicep", "fly", "raise", "dip")
LOWER_WORDS = ("squat", "deadlift", "rdl", "leg", "calf", "lunge", "hip", "glute", "hamstring", "extension", "thrust")


def session_focus(name) -> Column:
    """PRJ-22: upper, lower, mixed or other."""
    n = F.lower(F.coalesce(_c(name), F.lit("")))
    up, low = n.rlike("|".join(UPPER_WORDS)), n.rlike("|".join(LOWER_WORDS))
    return first_match([(up & low, "mixed"), (up, "upper"), (low, "lower")], "other")


def is_hard_set(set_type) -> Column:
    """PRJ-23"""
    return F.coalesce(F.lower(F.trim(_c(set_type))) == "working", F.lit(False))


def set_type(kind) -> Column:
    """SRC-02: the stored name of an API's set type."""
    k = F.lower(F.trim(F.coalesce(_c(kind), F.lit(""))))
    return F.when(k.isin("normal", ""), F.lit("working")).otherwise(k)


#: Activity names of sports (fixed values).
SPORTS = {"running": "Run", "cycling": "Ride", "biking": "Ride", "walking": "Walk", "hiking": "Hike", "swimming": "Swim", "rowing": "Rowing", "training": "Workout"}


def sport_activity(sport) -> Column:
    """PRJ-24: exact, then either contained in the other, then with capitals; the numbers 1, 2 and 11 by profile."""
    s = F.lower(F.trim(F.coalesce(_c(sport).cast("string"), F.lit(""))))
    pairs = [(s == "", "Workout"), (s == "1", "Run"), (s == "2", "Ride"), (s == "11", "Walk")]
    pairs += [(s == k, v) for k, v in SPORTS.items()]
    pairs += [(s.contains(k) | F.lit(k).contains(s), v) for k, v in SPORTS.items()]
    return first_match(pairs, F.initcap(F.translate(s, "_", " ")))


def json_map(x) -> Column:
    """PRJ-25: a JSON object of numbers; anything else is empty."""
    return F.coalesce(F.from_json(_c(x), "map<string,double>"), F.create_map().cast("map<string,double>"))


def duration_key(k) -> Column:
    """ARR-07: a duration in whole seconds above 0 from a map's key."""
    v = _c(k).try_cast("double").try_cast("int")
    return F.when(v > 0, v)


def target_label(label, low, high) -> Column:
    """PRJ-28"""
    n = lambda c: F.format_string("%d", _c(c).cast("long"))
    return F.coalesce(F.when(F.trim(_c(label)) != "", _c(label)), F.when(_c(low).isNotNull() & _c(high).isNotNull() & (_c(low) != _c(high)), F.concat(n(low), F.lit("-"), n(high), F.lit("x"))), F.concat(n(low), F.lit("x")), F.lit("?"))


def mileage_in_miles(check) -> Column:
    """PRJ-29: a mileage struct of kilometres as one of miles."""
    c = _c(check)
    return F.struct(km_to_miles(c["this_week_km"]).alias("this_week_mi"), km_to_miles(c["last_week_km"]).alias("last_week_mi"), c["change_pct"].alias("change_pct"), c["flag"].alias("flag"))


def correlation_direction(r) -> Column:
    """PRJ-30"""
    return F.when(_c(r) > 0, "positive").otherwise("negative")


def readiness_band(x) -> Column:
    """PRJ-31"""
    return F.when(_c(x) >= 75, "High").when(_c(x) >= 50, "Moderate").when(_c(x).isNotNull(), "Low")


def calendar_status(in_month, lifting, cardio, bridged) -> Column:
    """PRJ-32"""
    return first_match([(~_c(in_month), "out_of_range"), (_c(lifting) & _c(cardio), "both"), (_c(lifting), "lifting"), (_c(bridged), "fitbit"), (_c(cardio), "cardio")], "rest")


def first_integer(x) -> Column:
    """PRJ-33"""
    return F.regexp_extract(_c(x), r"(\d+)", 1).try_cast("int")


TRUNCATED = "\n[truncated]"


def truncate(x, most: int = 4000) -> Column:
    """PRJ-34: a long text's beginning and a mark."""
    return F.when(F.length(_c(x)) > most, F.concat(F.left(_c(x), F.lit(most)), F.lit(TRUNCATED))).otherwise(_c(x))


def front_matter(x, key: str) -> Column:
    """PRJ-34: a value of the block between --- lines at a text's beginning."""
    block = F.regexp_extract(_c(x), r"(?s)\A---\s*\n(.*?)\n---", 1)
    v = F.regexp_extract(block, rf"(?m)^{key}\s*:\s*[\"']?(.*?)[\"']?\s*$", 1)
    return F.when(v != "", v)


def fenced(x, kind: str = "sql") -> Column:
    """PRJ-34: what stands between code fences, else the whole text, trimmed, without a last semicolon."""
    inside = F.regexp_extract(_c(x), rf"(?s)```(?:{kind})?\s*\n?(.*?)```", 1)
    return F.regexp_replace(F.trim(F.when(inside != "", inside).otherwise(_c(x))), r";\s*$", "")


def fit_time(n) -> Column:
    """PRJ-39: seconds since the end of 1989 from 0x10000000 on, else since 1970."""
    v = _c(n).cast("long")
    return F.timestamp_seconds(F.when(v >= 0x10000000, v + 631065600).otherwise(v))


def completion(done, target) -> Column:
    """PRJ-40: a goal's share done, 0 to 1."""
    share = F.try_divide(_c(done), _c(target))
    return F.when(share.isNotNull(), F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)))


def alert_chips(flags, anomalies) -> Column:
    """PRJ-40: flags with capitals, then anomalies with their severity's mark."""
    a = F.transform(_c(flags), lambda f: F.initcap(F.replace(F.lower(f), F.lit("_"), F.lit(" "))))
    b = F.transform(_c(anomalies), lambda x: F.concat(F.when(x["severity"] == "alert", "!! ").when(x["severity"] == "warning", "! ").otherwise(""), x["metric"]))
    return F.concat(F.coalesce(a, F.array()), F.coalesce(b, F.array()))


def glance_line(label: str, value, unit: str = "", signed: bool = False, digits: int = 1) -> Column:
    """PRJ-27: `- label: 1,234.5 unit`, null without a value."""
    v = _c(value)
    text = F.format_string(f"%+.{digits}f", v) if signed else F.format_number(v, digits)
    return F.when(v.isNotNull(), F.concat(F.lit(f"- {label}: "), text, F.lit(unit)))


def glance_block(*lines: Column) -> Column:
    """PRJ-27: the lines that have a value."""
    return F.concat_ws("\n", F.filter(F.array(*lines), lambda x: x.isNotNull()))


def heart_rate(block, avg, most) -> tuple[Column, Column]:
    """PRJ-13: average and largest heart rate as whole numbers, from a JSON block with Avg/Max or avg/max (quantities or
    numbers; the first pair that has either), else from the quantities of their own."""
    whole = lambda v: F.bround(F.when(v >= 0, v)).cast("int")
    of = lambda k: whole(F.coalesce(number(F.get_json_object(_c(block), f"$.{k}.qty")), number(F.get_json_object(_c(block), f"$.{k}"))))
    up, low = (of("Avg"), of("Max")), (of("avg"), of("max"))
    pick = lambda i, own: F.when(up[0].isNotNull() | up[1].isNotNull(), up[i]).when(low[0].isNotNull() | low[1].isNotNull(), low[i]).otherwise(whole(_c(own)))
    return pick(0, avg), pick(1, most)


def briefing_title(d) -> Column:
    """PRJ-35: the title with the day, as in `Morning Check-In · Sunday, March 9`."""
    return F.concat(F.lit("Morning Check-In · "), F.date_format(_c(d), "EEEE, MMMM d"))


def without_last_question(note) -> Column:
    """PRJ-35: a note that ends in a question, up to the last full stop, exclamation mark or blank line before its last questions; as it was if nothing is left then."""
    text = F.rtrim(F.translate(_c(note), "\t\r", "  "))
    asked = F.regexp_replace(text, r"\s+$", "").endswith("?")
    kept = F.regexp_replace(F.regexp_extract(text, r"(?s)\A(.*(?:[.!](?=\s)|\n(?=\n)))", 1), r"\s+$", "")
    return F.when(asked & (kept != ""), kept).otherwise(_c(note))


def _own_heading(line) -> Column:
    """Is the line a heading, or the title by its letters?"""
    letters = F.regexp_replace(F.lower(line), "[^a-z]", "")
    return F.ltrim(line).startswith("#") | letters.startswith("morningcheckin")


def briefing_text(note, d, glance=None) -> Column:
    """PRJ-35: title, glance block if there is one, and the note without a first line that is a heading or title of its own."""
    n = F.regexp_replace(_c(note), r"\A\s+", "")
    first = F.substring_index(n, "\n", 1)
    body = F.regexp_replace(F.when(_own_heading(first), F.substr(n, F.length(first) + 2)).otherwise(n), r"\A\s+|\s+\z", "")
    parts = [F.concat(F.lit("# "), briefing_title(d)), *([_c(glance)] if glance is not None else []), F.when(body != "", body)]
    return F.concat_ws("\n\n", F.filter(F.array(*parts), lambda x: x.isNotNull()))

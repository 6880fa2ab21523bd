"""Cron schedules as columns: when a row's schedule fires next, and whether it is due. No Python runs for a row.

A field is a set of small numbers, kept as the bits of a long: minutes, hours, days of a month, months, and days of a week from
Sunday. Day of month and day of week must both hold. Times are epoch seconds, in UTC.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from ..sources import store

#: Bounds of the five fields, and names of week days and months.
BOUNDS = {"minute": (0, 59), "hour": (0, 23), "day": (1, 31), "month": (1, 12), "weekday": (0, 6)}
WEEKDAYS = ["sun", "mon", "tue", "wed", "thu", "fri", "sat"]
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
MANUAL = "manual"

_DAY = 86_400
_WEEKS = sum(1 << 7 * k for k in range(5))  # repeats a mask of seven days over a month
_FAR = 12 * 40  # months: a 29 February on a given week day comes round within 40 years, over a century too


def normalized(cron: Column) -> Column:
    """One space between fields, lower case; manual for null, empty and manual."""
    c = F.lower(F.btrim(F.regexp_replace(F.coalesce(cron, F.lit("")), r"\s+", " ")))
    return F.when(c.isin("", MANUAL), MANUAL).otherwise(c)


def _bit(n: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), n.cast("int"))


def _below(n: Column) -> Column:
    """Bits under n."""
    return _bit(n) - 1


def _first(mask: Column) -> Column:
    """The place of the lowest bit; null for no bits."""
    return F.when(mask != 0, F.bit_count(mask.bitwiseAND(-mask) - 1))


def _part(part: Column, name: str) -> Column:
    """Bits of one part of a list: *, n, a-b, each but n with /step. A range that ends before it starts goes round. Null if it is none of these."""
    low, high = BOUNDS[name]
    names, base = {"weekday": (WEEKDAYS, 0), "month": (MONTHS, 1)}.get(name, ([], 0))
    span = high - low + 1

    def number(text: Column) -> Column:
        n = text.try_cast("int")
        if names:
            n = F.coalesce(n, F.nullif(F.array_position(F.lit(names), text), F.lit(0)).cast("int") + base - 1)
        return let(n, lambda x: F.when(x.between(low, high), x).when(x == 7, 0) if name == "weekday" else F.when(x.between(low, high), x))

    def bits(p: Column) -> Column:
        return F.aggregate(F.sequence(p["start"], p["start"] + F.pmod(p["end"] - p["start"], F.lit(span)), p["by"]), F.lit(0).cast("long"), lambda m, n: m.bitwiseOR(_bit(F.pmod(n - low, F.lit(span)) + low)))

    def read(g: Column) -> Column:
        """g: star, first, last and step of the part, empty where it lacks them."""
        star, first, last, step = (g[i] for i in range(1, 5))
        start = F.when(star != "", low).otherwise(number(first))
        end = F.when(star != "", high).when(last == "", start).otherwise(number(last))
        by = F.when(step == "", 1).when((star != "") | (last != ""), step.try_cast("int"))
        return let(F.struct(start.alias("start"), end.alias("end"), by.alias("by")), lambda p: F.when(p["start"].isNotNull() & p["end"].isNotNull() & (p["by"] > 0), bits(p)))

    form = r"^(?:(\*)|([0-9a-z]+)(?:-([0-9a-z]+))?)(?:/([0-9]+))?$"
    return F.when(part.rlike(form), let(F.array(part, *(F.regexp_extract(part, form, g) for g in range(1, 5))), read))


def masks(cron: Column) -> Column:
    """A struct of the fields' bits, by the names of BOUNDS; null where cron is invalid or manual."""

    def field(fields: Column, i: int, name: str) -> Column:
        parts = F.transform(F.split(F.get(fields, F.lit(i)), ","), lambda p: _part(p, name))
        return F.aggregate(parts, F.lit(0).cast("long"), lambda a, m: a.bitwiseOR(m))  # null if a part is

    bits = let(F.split(normalized(cron), " "), lambda f: F.when(F.size(f) == 5, F.struct(*(field(f, i, name).alias(name) for i, name in enumerate(BOUNDS)))))
    return let(bits, lambda m: F.when(F.concat(*(m[name].cast("string") for name in BOUNDS)).isNotNull(), m))


def is_valid(cron: Column) -> Column:
    """Whether cron is a schedule, or manual."""
    return (normalized(cron) == MANUAL) | masks(cron).isNotNull()


def _days(m: Column, first: Column) -> Column:
    """Bits of the days of the month that begins on the date first: those whose month, day and week day hold."""
    shift = (F.dayofweek(first) - 1).cast("int")  # from Sunday
    week = F.call_function("shiftright", m["weekday"], shift).bitwiseOR(F.call_function("shiftleft", m["weekday"], F.lit(7) - shift)).bitwiseAND(F.lit(127))
    in_month = _below(F.dayofmonth(F.last_day(first)) + 1)
    return F.when(m["month"].bitwiseAND(_bit(F.month(first))) != 0, (week * F.lit(_WEEKS) * 2).bitwiseAND(m["day"]).bitwiseAND(in_month)).otherwise(F.lit(0).cast("long"))


def _above(mask: Column, n: Column) -> Column:
    """The lowest bit of mask over n."""
    return _first(mask.bitwiseAND(F.bitwise_not(_below(n + 1))))


def _time_left(m: Column, minute: Column) -> Column:
    """The first minute of a day after the given one that hours and minutes allow; null without one."""
    hour = F.floor(minute / 60).cast("int")
    this_hour = F.when(m["hour"].bitwiseAND(_bit(hour)) != 0, hour * 60 + _above(m["minute"], minute % 60))
    return F.coalesce(this_hour, _above(m["hour"], hour) * 60 + _first(m["minute"]))


def _next_day(m: Column, today: Column) -> Column:
    """Day number of the first fitting day after the date today, month by month; those after the next twelve are looked at only where these have none."""

    def day_in(n: Column) -> Column:
        first = F.add_months(F.trunc(today, "month"), n)
        days = _days(m, first)
        left = F.when(n == 0, days.bitwiseAND(F.bitwise_not(_below(F.dayofmonth(today) + 1)))).otherwise(days)
        return F.unix_date(first) + _first(left) - 1

    def among(low: int, high: int) -> Column:
        return F.get(F.filter(F.transform(F.sequence(F.lit(low), F.lit(high)), day_in), lambda d: d.isNotNull()), F.lit(0))

    return F.coalesce(among(0, 12), among(13, _FAR))


def next_fire(m: Column, after: Column) -> Column:
    """Epoch seconds of the first minute after the epoch second after that the schedule of masks m holds; null without one.

    Within the day the next hour and minute are the lowest bits left; the next day is looked for month by month, by the days' bits.
    """

    def at(s: Column) -> Column:
        date_no = F.floor(s["after"] / _DAY).cast("int")
        today = F.date_from_unix_date(date_no)
        minute = F.floor((s["after"] - date_no.cast("long") * _DAY) / 60).cast("int")
        fits = _days(s["m"], F.trunc(today, "month")).bitwiseAND(_bit(F.dayofmonth(today))) != 0
        this_day = date_no.cast("long") * _DAY + F.when(fits, _time_left(s["m"], minute)) * 60
        first_time = _first(s["m"]["hour"]) * 60 + _first(s["m"]["minute"])
        return F.coalesce(this_day, _next_day(s["m"], today).cast("long") * _DAY + first_time * 60)

    # Bound once: every part of it reads the masks.
    return let(F.struct(m.alias("m"), after.cast("long").alias("after")), lambda s: F.when(s["m"].isNotNull() & s["after"].isNotNull(), at(s)))


def next_fires(rows: DataFrame, cron: str, after: str, name: str = "next_fire") -> DataFrame:
    """rows with name: next_fire of each row's cron after its epoch second.

    A schedule is read once, and the first fitting day after a day looked for once for each schedule and day; a row has its own day's minutes
    to look at only. The days are written, so that few of them are known to be few and rows are not shuffled to meet them.
    """
    date_no = lambda: F.floor(F.col(after) / _DAY).cast("int")
    schedules = store.written(rows.select(F.col(cron).alias("_cron")).where("_cron is not null").distinct(), "schedules").select("_cron", masks(F.col("_cron")).alias("_m")).where("_m is not null")
    days = rows.select(F.col(cron).alias("_cron"), date_no().alias("_day")).where("_day is not null").distinct().join(store.written(schedules, "masks"), "_cron")
    today = F.date_from_unix_date("_day")
    first_time = _first(F.col("_m")["hour"]) * 60 + _first(F.col("_m")["minute"])
    fits = _days(F.col("_m"), F.trunc(today, "month")).bitwiseAND(_bit(F.dayofmonth(today))) != 0
    days = store.written(days.select("_cron", "_day", "_m", fits.alias("_fits"), (_next_day(F.col("_m"), today).cast("long") * _DAY + first_time * 60).alias("_later")), "days-of-schedules")
    met = rows.withColumn("_day", date_no()).join(days.withColumnRenamed("_day", "_of"), (F.col(cron) == F.col("_cron")) & (F.col("_day") == F.col("_of")), "left")
    start = F.col("_day").cast("long") * _DAY
    minute = F.floor((F.col(after) - start) / 60).cast("int")
    this_day = start + F.when(F.col("_fits"), _time_left(F.col("_m"), minute)) * 60
    return met.select(*rows.columns, F.coalesce(this_day, F.col("_later")).alias(name))


def is_due(m: Column, baseline: Column, now: Column) -> Column:
    """Whether the schedule has fired after baseline (now, if it is later; a year ago without one), up to now. Manual and invalid ones never are."""
    since = F.least(F.coalesce(baseline, now - 366 * _DAY), now)
    return F.coalesce(next_fire(m, since) <= now, F.lit(False))


def matches(m: Column, now: Column) -> Column:
    """Whether the schedule holds in the minute of now."""
    return F.coalesce(next_fire(m, F.floor(now / 60) * 60 - 1) <= now, F.lit(False))

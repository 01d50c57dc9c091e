"""The New York exchange's calendar from its holiday rules, and joins to its sessions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quillon.functions.market import NEW_YORK

_DAY = dt.timedelta(days=1)


def easter(year: int) -> dt.date:
    """Easter Sunday, by the anonymous Gregorian computus."""
    golden, century = year % 19, year // 100
    shift = (19 * golden + century - century // 4 - (century - (century + 8) // 25 + 1) // 3 + 15) % 30
    week = (32 + 2 * (century % 4) + 2 * (year % 100 // 4) - shift - year % 100 % 4) % 7
    late = (golden + 11 * shift + 22 * week) // 451
    month, day = divmod(shift + week - 7 * late + 114, 31)
    return dt.date(year, month, day + 1)


def _nth(year: int, month: int, weekday: int, n: int) -> dt.date:
    """The n-th weekday of a month; the last for n = -1."""
    if n > 0:
        first = dt.date(year, month, 1)
        return first + _DAY * ((weekday - first.weekday()) % 7 + 7 * (n - 1))
    last = dt.date(year + month // 12, month % 12 + 1, 1) - _DAY
    return last - _DAY * ((last.weekday() - weekday) % 7)


def _observed(day: dt.date) -> dt.date:
    return day - _DAY if day.weekday() == 5 else day + _DAY if day.weekday() == 6 else day


def closures(year: int) -> set[dt.date]:
    """Full closures. A New Year's Day on a Saturday is not made up for in the old year."""
    out = {
        _nth(year, 1, 0, 3),
        _nth(year, 2, 0, 3),
        easter(year) - 2 * _DAY,
        _nth(year, 5, 0, -1),
        _observed(dt.date(year, 7, 4)),
        _nth(year, 9, 0, 1),
        _nth(year, 11, 3, 4),
        _observed(dt.date(year, 12, 25)),
    }
    if year >= 2022:
        out.add(_observed(dt.date(year, 6, 19)))
    new_year = dt.date(year, 1, 1)
    if new_year.weekday() != 5:
        out.add(_observed(new_year))
    return out


def early_closes(year: int) -> set[dt.date]:
    """Days that end at 13:00: after Thanksgiving, and the trading days before July 4 and Christmas."""
    days = {_nth(year, 11, 3, 4) + _DAY, dt.date(year, 7, 3), dt.date(year, 12, 24)}
    return {d for d in days if d.weekday() < 5 and d not in closures(year)}


def sessions(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    """(day, open_ts, close_ts) of every session: about 252 rows a year, from rules."""
    rows = []
    for year in range(first_year, last_year + 1):
        closed, early = closures(year), early_closes(year)
        day = dt.date(year, 1, 1)
        while day.year == year:
            if day.weekday() < 5 and day not in closed:
                rows.append((day, "13:00:00" if day in early else "16:00:00"))
            day += _DAY
    df = spark.createDataFrame(rows, "day date, until string")
    at = lambda clock: F.to_utc_timestamp(F.to_timestamp(F.concat_ws(" ", F.col("day").cast("string"), clock)), NEW_YORK)
    return df.select("day", at(F.lit("09:30:00")).alias("open_ts"), at(F.col("until")).alias("close_ts"))


def derived(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    """(day, kind) of every full closure and early close by the rules."""
    rows = [(d, kind) for y in range(first_year, last_year + 1) for kind, days in (("closure", closures(y)), ("early_close", early_closes(y))) for d in sorted(days) if d.year == y]
    return spark.createDataFrame(rows, "day date, kind string")


def calendar_problems(static: DataFrame, rules: DataFrame) -> DataFrame:
    """(day, kind, problem) of days of a static calendar (day, kind, special) that no rule gives, and of rules' days that
    it lacks. Special closures, which no rule can give, are left out on both sides."""
    special = static.where("special").select("day")
    plain = static.where("not special").select("day", "kind")
    wanted = rules.select("day", "kind").join(special, "day", "left_anti")
    lacking = wanted.join(plain, ["day", "kind"], "left_anti").withColumn("problem", F.lit("missing"))
    return lacking.unionByName(plain.join(wanted, ["day", "kind"], "left_anti").withColumn("problem", F.lit("no_rule")))


def weekend_windows(fridays: DataFrame, calendar: DataFrame, day: str) -> DataFrame:
    """fridays with start, the last close before the weekend that follows, and end, the next open after it: a holiday
    on the Friday or the Monday makes the window longer. Another day of the week has neither."""
    noon = F.to_utc_timestamp(F.date_add(day, 1).cast("timestamp"), NEW_YORK)
    found = next_open(fridays.withColumn("_at", F.when(F.dayofweek(day) == 6, noon)), calendar, "_at")
    return found.withColumnsRenamed({"previous_close": "start", "next_open": "end"}).drop("_at", "in_session")


def weekdays_back(day: Column, n: int) -> Column:
    """The date n weekdays before day; a weekend counts from its Friday. n is 1 or more."""
    base = F.date_sub(day, F.greatest(F.lit(0), F.weekday(day) - 4))
    past = n - F.weekday(base)  # weekdays before this week's Monday
    weeks = F.ceil(past / 5).cast("int")
    inside = (weeks * 5 - past).cast("int")
    return F.when(past <= 0, F.date_sub(base, n)).otherwise(F.date_add(F.date_sub(F.date_sub(base, F.weekday(base)), weeks * 7), inside))


def trading_dates(calendar: DataFrame, first: str, last: str) -> DataFrame:
    """The days of sessions from first to last, for instance to fetch option chains of."""
    return calendar.where(F.col("day").between(F.lit(first).cast("date"), F.lit(last).cast("date"))).select("day")


def weekday(day: Column) -> Column:
    return F.dayofweek(day).between(2, 6)


def next_open(df: DataFrame, calendar: DataFrame, ts: str) -> DataFrame:
    """df with in_session, previous_close (at or before ts) and next_open (after ts). The calendar is
    one sorted array; a row finds its place by its date."""
    packed = calendar.agg(F.array_sort(F.collect_list(F.struct("day", "open_ts", "close_ts"))).alias("_c"))  # about 252 entries a year
    # places by date: for each calendar date the first session on or after it
    dates = packed.select(F.posexplode("_c").alias("_i", "_s")).select(F.col("_s.day").alias("_day"), F.col("_i").cast("int").alias("_i"))
    # from the year's first day on, and for a holiday week beyond the last session
    last = F.date_add(F.element_at("_c", -1)["day"], 7)
    span = packed.select(F.explode(F.sequence(F.trunc(F.col("_c")[0]["day"], "year"), last)).alias("_day"))
    from pyspark.sql import Window

    place = span.join(dates, "_day", "left").withColumn("_i", F.first("_i", ignorenulls=True).over(Window.orderBy("_day").rowsBetween(0, Window.unboundedFollowing)))
    at = F.coalesce(F.col("_i"), F.size("_c"))
    near = place.join(F.broadcast(packed)).select("_day", F.slice("_c", F.greatest(at - 1, F.lit(1)), F.lit(4)).alias("_c"))  # one row
    out = df.withColumn("_day", F.to_date(ts)).join(F.broadcast(near), "_day", "left")
    t = F.col(ts)
    return out.withColumns(
        {
            "in_session": F.exists("_c", lambda s: (s["open_ts"] <= t) & (t < s["close_ts"])),
            "previous_close": F.array_max(F.transform(F.filter("_c", lambda s: s["close_ts"] <= t), lambda s: s["close_ts"])),
            "next_open": F.array_min(F.transform(F.filter("_c", lambda s: s["open_ts"] > t), lambda s: s["open_ts"])),
        }
    ).drop("_c", "_day")


def lookback(day: dt.date, n: int) -> dt.date:
    """The trading day n sessions before day."""
    while n:
        day -= _DAY
        n -= day.weekday() < 5 and day not in closures(day.year)
    return day


def minimum_detectable(n: Column, power_z: float = 0.8416212335729143, alpha_z: float = 1.959963984540054) -> Column:
    """The smallest correlation that n pairs can tell from 0, by Fisher's z."""
    return F.when(n > 3, F.tanh((alpha_z + power_z) / F.sqrt(n - 3)))

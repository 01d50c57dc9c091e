"""The serving layer: typed questions, a policy that classifies them, and their compilation to a
DataFrame over governed daily views."""

from __future__ import annotations

import datetime as dt
import unicodedata
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window, functions as F

OPERATIONS = ("trend", "compare", "rank", "aggregate")
PERIODS = ("day", "week", "month", "quarter", "year")
CHEAP, NORMAL, EXPENSIVE, REJECT = "CHEAP", "NORMAL", "EXPENSIVE", "REJECT"


@dataclass(frozen=True)
class Measure:
    """A metric: its column, how a period or an entity is summed up, and its limits."""

    column: str
    period: str = "last"  # last, mean, sum, compound
    aggregations: tuple[str, ...] = ("mean", "min", "max")
    most_entities: int = 100
    most_years: int = 5
    splits_matter: bool = False


METRICS: dict[str, Measure] = {
    "price": Measure("close", "last", splits_matter=True),
    "return": Measure("return_1d", "compound", ("mean", "compound")),
    "volume": Measure("volume", "sum", ("sum", "mean")),
    "realized_volatility": Measure("realised_vol", "mean", ("mean", "max")),
    "drawdown": Measure("drawdown", "min", ("min",)),
    "momentum": Measure("momentum", "last", ("mean", "last")),
    "relative_performance": Measure("relative_performance", "last", ("last",)),
    "implied_volatility": Measure("implied_vol", "mean", ("mean", "max")),
    "put_call_ratio": Measure("put_call_ratio", "mean", ("mean", "max")),
}


@dataclass(frozen=True)
class Intent:
    metric: str
    operation: str
    entities: tuple[str, ...]
    start: dt.date
    end: dt.date
    grouping: str = "day"
    aggregation: str | None = None
    limit: int = 1000


@dataclass(frozen=True)
class Verdict:
    level: str
    reasons: tuple[str, ...] = ()


@dataclass
class Bounds:
    """What a question may cost, in expected rows, and what is known of the data."""

    cheap_rows: int = 5_000
    normal_rows: int = 100_000
    most_rows: int = 5_000_000
    splits: Sequence[tuple[str, dt.date]] = field(default_factory=tuple)
    adjusted: bool = False


def classify(intent: Intent, bounds: Bounds, as_of: dt.date) -> Verdict:
    """CHEAP, NORMAL, EXPENSIVE or REJECT with every reason; a pure function of its arguments."""
    measure, reasons = METRICS.get(intent.metric), []
    if measure is None or intent.operation not in OPERATIONS:
        return Verdict(REJECT, ("pair_not_registered",))
    if intent.grouping not in (*PERIODS, "ticker"):
        reasons.append("grouping_not_allowed")
    if intent.operation == "compare" and len(intent.entities) < 2:
        reasons.append("too_few_entities")
    if not intent.entities:
        reasons.append("no_entity")
    if len(intent.entities) > measure.most_entities:
        reasons.append("entity_limit_exceeded")
    if intent.end > as_of:
        reasons.append("future_date")
    if intent.end < intent.start:
        reasons.append("end_before_start")
    if intent.start < years_before(intent.end, measure.most_years):
        reasons.append("date_range_exceeded")
    if intent.aggregation is not None and intent.aggregation not in measure.aggregations:
        reasons.append("aggregation_not_allowed")
    if measure.splits_matter and not bounds.adjusted:
        if any(s in intent.entities and intent.start <= day <= intent.end for s, day in bounds.splits):
            reasons.append("unadjusted_corporate_action")
    rows = len(intent.entities) * max(0, (intent.end - intent.start).days + 1)
    if rows > bounds.most_rows:
        reasons.append("too_many_rows")
    if reasons:
        return Verdict(REJECT, tuple(reasons))
    return Verdict(CHEAP if rows <= bounds.cheap_rows else NORMAL if rows <= bounds.normal_rows else EXPENSIVE)


def years_before(day: dt.date, n: int) -> dt.date:
    try:
        return day.replace(year=day.year - n)
    except ValueError:
        return day.replace(year=day.year - n, day=28)


_SUMMARY = {
    "mean": lambda c, t: F.avg(c),
    "min": lambda c, t: F.min(c),
    "max": lambda c, t: F.max(c),
    "sum": lambda c, t: F.sum(c),
    "last": lambda c, t: F.max_by(c, t),
    "compound": lambda c, t: F.exp(F.sum(F.log1p(F.when(F.col(c) > -1, F.col(c))))) - 1,
}


def compile_intent(intent: Intent, view: DataFrame, key: str = "symbol", day: str = "day") -> DataFrame:
    """The answer over a daily view: entity and date filters first, so the scan prunes, then one
    aggregate. trend and compare: a row per entity and period; rank: entities by their last value;
    aggregate: a row per entity."""
    measure = METRICS[intent.metric]
    c = measure.column
    df = view.where(F.col(key).cast("string").isin(*intent.entities) & F.col(day).between(F.lit(intent.start), F.lit(intent.end))).select(key, day, c)
    df = df.where(F.col(c).isNotNull())
    if intent.operation in ("trend", "compare"):
        if intent.grouping in ("day", "ticker"):
            return df.orderBy(day, key).limit(intent.limit)
        period = F.to_date(F.date_trunc(intent.grouping, F.col(day).cast("timestamp")))
        return df.groupBy(key, period.alias("period")).agg(_SUMMARY[measure.period](c, day).alias(c)).orderBy("period", key).limit(intent.limit)
    if intent.operation == "rank":
        last = df.groupBy(key).agg(F.max_by(c, day).alias(c), F.max(day).alias(day))
        return last.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(c), key))).where(F.col("rank") <= intent.limit)  # a row per entity
    how = intent.aggregation or measure.aggregations[0]
    return df.groupBy(key).agg(_SUMMARY[how](c, day).alias(c), F.count("*").alias("n_days"))


def normal_text(text: str) -> str:
    """NFKC, single spaces, case folded; control characters and markup make it hostile."""
    if any(unicodedata.category(ch) in ("Cc", "Cf") and ch not in "\t\n" for ch in text) or any(x in text for x in (";", "--", "/*", "<", ">")):
        raise ValueError("text is not allowed")
    return " ".join(unicodedata.normalize("NFKC", text).split()).casefold()


def resolve_aliases(names: Sequence[str], aliases: Mapping[str, str]) -> tuple[list[str], list[str]]:
    """(symbols, unknown names), by normal form; symbols once each, in order."""
    known = {normal_text(k): v for k, v in aliases.items()}
    found = [known.get(normal_text(n)) for n in names]
    return list(dict.fromkeys(f for f in found if f)), [n for n, f in zip(names, found) if not f]


def relative_range(text: str, today: dt.date) -> tuple[dt.date, dt.date] | None:
    """(first, last) day of an expression such as `last month`, `ytd` or `last 30 days`."""
    t = normal_text(text).replace("_", " ")
    day = dt.timedelta(days=1)
    month = today.replace(day=1)
    quarter = today.replace(month=(today.month - 1) // 3 * 3 + 1, day=1)
    year = today.replace(month=1, day=1)
    monday = today - day * today.weekday()

    def before(start: dt.date, months: int) -> tuple[dt.date, dt.date]:
        index = start.year * 12 + start.month - 1 - months
        return dt.date(index // 12, index % 12 + 1, 1), start - day

    fixed = {
        "last week": (monday - 7 * day, monday - day),
        "last month": before(month, 1),
        "last quarter": before(quarter, 3),
        "last year": before(year, 12),
        "mtd": (month, today),
        "qtd": (quarter, today),
        "ytd": (year, today),
    }
    if t in fixed:
        return fixed[t]
    words = t.split()
    if len(words) == 3 and words[0] == "last" and words[2] == "days" and words[1] in ("5", "30", "90", "252"):
        return today - day * (int(words[1]) - 1), today
    return None

"""Daily aggregates of change events (event_id, operation, before_payload, after_payload,
occurred_at), from their JSON payloads."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

SUCCESS = ("success", "ok", "completed")


def parsed(events: DataFrame, fields: Mapping[str, str]) -> DataFrame:
    """Events with event_date (UTC) and, for each name -> type, after_<name> and before_<name>."""
    schema = ", ".join(f"{n} {t}" for n, t in fields.items())
    step = events.withColumns({"_a": F.from_json("after_payload", schema), "_b": F.from_json("before_payload", schema), "event_date": F.to_date("occurred_at")})
    return step.withColumns({f"{s}_{n}": F.col(f"_{s[0]}.{n}") for s in ("after", "before") for n in fields}).drop("_a", "_b")


def activity(events: DataFrame, keys: list[str], user: str) -> DataFrame:
    """Count, different users and the last event of each key; the last event is that with the
    largest event_id."""
    return events.groupBy(*keys).agg(
        F.count("*").alias("n_events"),
        F.countDistinct(F.nullif(F.col(user), F.lit(""))).alias("n_users"),
        F.max("event_id").alias("last_event_id"),
        F.max_by("occurred_at", "event_id").alias("last_source_time"),
    )


def additions_removals(events: DataFrame, keys: list[str]) -> DataFrame:
    add, gone = F.col("operation").isin("insert", "snapshot"), F.col("operation") == "delete"
    return events.groupBy(*keys).agg(
        F.count_if(add).alias("additions"), F.count_if(gone).alias("removals"), (F.count_if(add) - F.count_if(gone)).alias("net_change")
    )


def funnel(events: DataFrame, status: Column, stages: Mapping[str, str]) -> DataFrame:
    """Events by date and the stage their new status maps to; deletes and unknown statuses do not
    count."""
    lookup = F.create_map(*[x for k, v in stages.items() for x in (F.lit(k), F.lit(v))])
    staged = events.where("operation <> 'delete'").withColumn("stage", F.try_element_at(lookup, status)).where("stage is not null")
    return staged.groupBy("event_date", "stage").agg(F.count("*").alias("n_events"))


def usage(events: DataFrame, action: Column, status: Column, write_pattern: str) -> DataFrame:
    """Retrievals, writes, successes and failures by date; an unknown outcome is neither."""
    ok = F.lower(status).isin(*SUCCESS)
    return events.groupBy("event_date").agg(
        F.count_if(~action.rlike(write_pattern)).alias("retrievals"),
        F.count_if(action.rlike(write_pattern)).alias("writes"),
        F.count_if(ok).alias("successes"),
        F.count_if(status.isNotNull() & ~ok).alias("failures"),
    )


def affected(events: DataFrame, batch: DataFrame) -> DataFrame:
    """All events of the dates that a batch touches."""
    return events.join(batch.select("event_date").distinct(), "event_date", "left_semi")


def replaced_aggregates(stored: DataFrame, fresh: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Stored daily aggregates with those of the batch's dates replaced by the recomputed ones; a key of such a date
    that is no longer there goes, so an empty recomputation empties the date."""
    dates = batch.select("event_date").distinct()
    return stored.join(dates, "event_date", "left_anti").unionByName(fresh.select(*stored.columns))


def run_batch(outbox: DataFrame, delivered: DataFrame, most: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(batch, delivery marks, state row) of the oldest events that are not delivered: marks (event_id, delivered_at) to
    append once the batch is applied, and one row (last_event_id, n_events, run_at), empty for an empty batch."""
    from quillon.sources.readers import undelivered

    batch = undelivered(outbox, delivered, most)
    marks = batch.select("event_id").withColumn("delivered_at", F.current_timestamp())
    state = batch.agg(F.max("event_id").alias("last_event_id"), F.count("*").alias("n_events")).where("n_events > 0")
    return batch, marks, state.withColumn("run_at", F.current_timestamp())

"""Conversations and turns as rows: usage, artifacts, fragments, versions, retention, clamps, figures as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def turn_usage(calls: DataFrame, key: str, order: str, sums: tuple[str, ...], last: str) -> DataFrame:
    """Totals of each turn's calls and the last call's figure. Nulls add nothing."""
    return calls.groupBy(key).agg(F.count(F.lit(1)).alias("calls"), *(F.coalesce(F.sum(c), F.lit(0)).alias(f"total_{c}") for c in sums), F.max_by(last, order).alias(f"last_{last}"))


def latest_artifacts(artifacts: DataFrame, turn: str, path: str, order: list[str]) -> DataFrame:
    """One row of each path of a turn: the newest, all columns as they were."""
    w = Window.partitionBy(turn, path).orderBy(*(F.desc(c) for c in order))
    return artifacts.withColumn("__place", F.row_number().over(w)).where("__place = 1").drop("__place")


def accumulated(pieces: DataFrame, key: list[str], order: str, piece: str) -> DataFrame:
    """Fragments of each call joined in order; null fragments are empty."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(F.col(piece), F.lit("")).alias("p"))))
    return pieces.groupBy(*key).agg(F.concat_ws("", F.transform(ordered, lambda x: x["p"])).alias("whole"), F.count(F.lit(1)).alias("pieces"))


def visible_models(users: DataFrame, models: DataFrame, allowed: DataFrame, default: str) -> DataFrame:
    """``user_id, model_id``: an administrator sees every model, others the allowed ones and the default if it exists.

    The lists of administrators and of models are short; allowed has user_id and model_id.
    """
    admins = users.where("role = 'admin'").select("user_id").crossJoin(F.broadcast(models.select("model_id")))
    others = users.where("role IS NULL OR role <> 'admin'").select("user_id")
    own = allowed.join(others, "user_id", "left_semi").join(models.select("model_id"), "model_id", "left_semi").select("user_id", "model_id")
    base = others.join(models.where(F.col("model_id") == default).select("model_id").limit(1), how="cross")
    return admins.unionByName(own).unionByName(base).distinct()


def as_of(versions: DataFrame, key: str, version: str, at: Column) -> DataFrame:
    """Each key's newest row up to a version."""
    w = Window.partitionBy(key).orderBy(F.desc(version))
    return versions.where(F.col(version) <= at).withColumn("__place", F.row_number().over(w)).where("__place = 1").drop("__place")


def versioned(changes: DataFrame, scope: str, order: str) -> DataFrame:
    """Changes of each scope numbered from 1 in order: the monotone version a reader asks for."""
    return changes.withColumn("version", F.row_number().over(Window.partitionBy(scope).orderBy(order)))


def replay(events: DataFrame, subscribers: DataFrame, key: str, order: str) -> DataFrame:
    """What each late subscriber of a conversation still has to see: events past its position (null: all of them)."""
    late = subscribers.select(key, "subscriber", "position")
    return events.join(late, key).where(F.col("position").isNull() | (F.col(order) > F.col("position"))).drop("position")


def expired(rows: DataFrame, kind: str, stamp: str, now: Column, minutes: dict[str, int]) -> DataFrame:
    """Rows past the lifetime of their kind; kinds without one stay for ever."""
    life = F.create_map(*[F.lit(x) for kv in minutes.items() for x in kv])
    age = F.unix_micros(now) - F.unix_micros(F.col(stamp))
    return rows.where(age > F.try_element_at(life, F.col(kind)).cast("long") * F.lit(60_000_000))


def clamped(value: Column, low: float, high: float) -> Column:
    """A parameter kept in its range; what is no number is dropped (null)."""
    number = value.try_cast("double")
    return F.when(number.isNotNull() & ~F.isnan(number), F.least(F.greatest(number, F.lit(float(low))), F.lit(float(high))))


def size_text(n: Column) -> Column:
    """Bytes as B, KB, MB or GB with one decimal from KB on."""
    step = lambda k, unit: F.concat(F.format_string("%.1f", F.round(n / F.lit(float(k)), 1)), F.lit(unit))
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1 << 20, step(1 << 10, " KB")).when(n < 1 << 30, step(1 << 20, " MB")).otherwise(step(1 << 30, " GB"))


def compact_int(n: Column) -> Column:
    """12, 3.4k, 5.6M: one decimal, rounded half up."""
    step = lambda k, unit: F.concat(F.format_string("%.1f", F.round(n / F.lit(float(k)), 1)), F.lit(unit))
    return F.when(n < 1000, n.cast("string")).when(n < 1_000_000, step(1_000, "k")).otherwise(step(1_000_000, "M"))

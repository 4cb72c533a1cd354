"""The application's relational side: search, usage, spend, model choice, queues, threads."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.text import snippet


def query_tokens(query: str, most: int = 6) -> list[str]:
    """Distinct lower-case words of two characters or more, the first ``most``."""
    return [t for t in dict.fromkeys(query.lower().split()) if len(t) >= 2][:most]


@F.pandas_udf(DoubleType())
def fuzzy_score(text: pd.Series, token: pd.Series) -> pd.Series:
    """Best 0.9 times the matching-blocks ratio over words that share the token's first four characters."""

    def one(t: str, q: str) -> float:
        best = 0.0
        if len(q) > 4:
            for w in set((t or "").lower().split()):
                if w[:4] == q[:4] and abs(len(w) - len(q)) <= 3:
                    r = SequenceMatcher(None, w, q).ratio()
                    best = max(best, 0.9 * r if r >= 0.78 else 0.0)
        return best

    return pd.Series([one(t, q) for t, q in zip(text, token, strict=True)])


def search(messages: DataFrame, query: str, candidates: int = 400, results: int = 30, fuzzy: bool = True) -> DataFrame:
    """``conv_id, score, hits, snippet``: conversations by token coverage, then recency.

    messages: conv_id, seq, role, text, updated_at. Users' and assistants' messages that hold a token, or its first four characters, are candidates;
    a token's score in a conversation is its best over the messages.
    """
    tokens = query_tokens(query)
    low = F.lower("text")
    if not tokens:
        return messages.where("false").select("conv_id", F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("hits"), F.lit("").alias("snippet"))
    any_hit = None
    for t in tokens:
        hit = low.contains(t[:4] if fuzzy else t)
        any_hit = hit if any_hit is None else any_hit | hit
    rows = messages.where(F.col("role").isin("user", "assistant") & any_hit).orderBy(F.desc("updated_at"), "conv_id", "seq").limit(candidates)
    each = [F.when(low.contains(t), 1.0).otherwise(fuzzy_score(F.col("text"), F.lit(t)) if fuzzy else 0.0).alias(f"s{i}") for i, t in enumerate(tokens)]
    scored = rows.select("conv_id", "seq", "text", "updated_at", *each)
    total = sum((F.col(f"s{i}") for i in range(len(tokens))), F.lit(0.0))
    first = F.coalesce(*(F.when(F.col(f"s{i}") == 1.0, snippet(F.col("text"), F.lit(t))) for i, t in enumerate(tokens)), F.substring("text", 1, 180))
    scored = scored.withColumn("total", total).withColumn("snip", first).where("total > 0")
    by = scored.groupBy("conv_id").agg(*(F.max(f"s{i}").alias(f"s{i}") for i in range(len(tokens))), F.count(F.lit(1)).alias("hits"), F.max_by("snip", F.struct("total", -F.col("seq"))).alias("snippet"), F.max("updated_at").alias("updated_at"))
    return by.withColumn("score", total).orderBy(F.desc("score"), F.desc("updated_at"), "conv_id").limit(results).select("conv_id", "score", "hits", "snippet")


def usage(facts: DataFrame, metrics: dict[str, Column], dimensions: list[str], granularity: str = "day", time_col: str = "ts", start: str | None = None, end: str | None = None, filters: dict | None = None, order_by: str | None = None, limit: int | None = None) -> DataFrame:
    """The generic usage query: filter, group by time bucket and at most two dimensions, aggregate, order, cut at 500 rows at most."""
    if not 1 <= len(metrics) <= 12 or len(dimensions) > 2 or granularity not in ("day", "week", "month") or len(filters or {}) > 8:
        raise ValueError("1 to 12 metrics, at most 2 dimensions and 8 filters, by day, week or month")
    df = facts
    if start:
        df = df.where(F.col(time_col) >= F.lit(start).cast("timestamp"))
    if end:
        df = df.where(F.col(time_col) < F.lit(end).cast("timestamp"))
    for name, values in (filters or {}).items():
        df = df.where(F.col(name).isin(*(values if isinstance(values, (list, tuple)) else [values])))
    out = df.groupBy(F.date_trunc(granularity, time_col).cast("date").alias("bucket"), *dimensions).agg(*(c.alias(n) for n, c in metrics.items()))
    if order_by:
        out = out.orderBy(F.desc(order_by), "bucket", *dimensions)
    return out.limit(min(limit, 500)) if limit else out


def spend_matrix(facts: DataFrame, row: str, column: str, values: list, amount: str) -> DataFrame:
    """Rows by columns with a total: the pivot's values are given, so it is one aggregation."""
    out = facts.groupBy(row).pivot(column, values).agg(F.sum(amount))
    return out.select(row, *(F.coalesce(F.col(f"`{v}`"), F.lit(0.0)).alias(str(v)) for v in values), sum((F.coalesce(F.col(f"`{v}`"), F.lit(0.0)) for v in values), F.lit(0.0)).alias("total"))


def top_n_other(facts: DataFrame, key: str, amount: str, n: int = 5) -> DataFrame:
    """Sums of the n greatest keys and one row ``other`` for the rest."""
    sums = facts.groupBy(key).agg(F.sum(amount).alias("amount"))
    top = sums.orderBy(F.desc("amount"), key).limit(n).select(F.col(key).alias("top"))
    named = sums.join(F.broadcast(top), sums[key] == top["top"], "left").select(F.coalesce(F.col("top").cast("string"), F.lit("other")).alias("key"), "amount")
    return named.groupBy("key").agg(F.sum("amount").alias("amount"))


def choose_model(models: DataFrame, rule: str = "balanced", score: str = "score", price: str = "price", key: str = "id") -> DataFrame:
    """The guided choice: ``best`` the greatest score, then cheapest; ``balanced`` and ``economy`` the cheapest with 0.9 and 0.8 of it."""
    share = {"best": 1.0, "balanced": 0.9, "economy": 0.8}[rule]
    top = models.agg(F.max(score).alias("top"))
    ok = models.join(F.broadcast(top)).where(F.col(score) >= F.col("top") * share)
    return ok.orderBy(price, F.desc(score), key).limit(1).drop("top")


def latest(rows: DataFrame, keys: list[str], order: str, n: int, tie: str) -> DataFrame:
    """The newest n rows of each group."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order), tie)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def queue_positions(jobs: DataFrame, owner: str = "owner_id", arrived: str = "created_at", key: str = "id") -> DataFrame:
    """Fair round-robin: a job's turn is its rank within its owner; before it stand its own earlier jobs and, of each other owner, at most as many and one."""
    own = Window.partitionBy(owner).orderBy(arrived, key)
    ranked = jobs.withColumn("turn", F.row_number().over(own))
    sizes = ranked.groupBy("turn").agg(F.count(F.lit(1)).alias("jobs"))
    before = sizes.select("turn", F.sum("jobs").over(Window.orderBy("turn")).alias("until"))
    return ranked.join(before, "turn").select(F.col(key), F.col(owner), (F.col("turn") - 1).alias("own_before"), (F.col("until") - 1).alias("position"))


def nested(parents: DataFrame, children: DataFrame, key: str, fields: list[str], name: str) -> DataFrame:
    """One-to-many as an array of structs in field order, empty where there are none."""
    grouped = children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
    empty = F.array().cast(grouped.schema[name].dataType)
    return parents.join(grouped, key, "left").withColumn(name, F.coalesce(name, empty))


def fallback_join(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], value: str) -> DataFrame:
    """A value by the first of several keys that has one; null where none does."""
    out = left
    for i, (a, b) in enumerate(keys):
        out = out.join(right.select(F.col(b).alias(f"__k{i}"), F.col(value).alias(f"__v{i}")).dropDuplicates([f"__k{i}"]), F.col(a) == F.col(f"__k{i}"), "left")
    return out.withColumn(value, F.coalesce(*(F.col(f"__v{i}") for i in range(len(keys))))).drop(*(f"__{x}{i}" for x in "kv" for i in range(len(keys))))


def interval_overlaps(a: DataFrame, b: DataFrame, key: str, width: int = 64) -> DataFrame:
    """Pairs of spans of one key that overlap, clipped: an equi-join on blocks of positions, each pair once.

    a and b have key, id, start, end; the result has key, a_id, b_id, start, end.
    """
    blocks = lambda df, p: df.where("start < end").select(key, F.col("id").alias(f"{p}_id"), F.col("start").alias(f"{p}_start"), F.col("end").alias(f"{p}_end"), F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))).alias("block"))
    x, y = blocks(a, "a"), blocks(b, "b")
    start, end = F.greatest("a_start", "b_start"), F.least("a_end", "b_end")
    return x.join(y, [key, "block"]).where((start < end) & (F.floor(start / width) == F.col("block"))).select(key, "a_id", "b_id", start.alias("start"), end.alias("end"))


def running_offsets(lines: DataFrame, key: str, order: str, text: str, separator: int = 1) -> DataFrame:
    """Where each line starts and ends in the lines joined in order."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length(text) + separator).over(w), F.lit(0))
    return lines.withColumn("start", start).withColumn("end", start + F.length(text))


def budget_cut(rows: DataFrame, key: str, order: str, cost: str, cap: float) -> DataFrame:
    """Rows of each key with their running cost and whether it is still within a cap."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("running", F.sum(cost).over(w)).withColumn("within", F.col("running") <= cap)

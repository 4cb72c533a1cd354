"""From candidates to a rewritten text and back: span merge, placeholders, anonymise, decode, verify."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import canonical_key, collapse, exploded
from .detect import ENTITY, EXACT

PLACEHOLDER = r"\[[A-Z0-9_]+_[0-9]+\]"


def merge_spans(entities: Column) -> Column:
    """Greedy choice without overlap: validated first, then priority, score, length, first start; result in text order."""
    rank = F.transform(entities, lambda e: F.struct((~e["validated"]).alias("r1"), (-e["priority"]).alias("r2"), (-e["score"]).alias("r3"), (e["start"] - e["end"]).alias("r4"), e["start"].alias("r5"), e.alias("e")))
    ordered = F.transform(F.array_sort(rank), lambda r: r["e"])
    free = lambda acc, e: ~F.exists(acc, lambda o: (o["start"] < e["end"]) & (e["start"] < o["end"]))
    chosen = F.aggregate(ordered, F.expr(f"cast(array() as {ENTITY})"), lambda acc, e: F.when(free(acc, e), F.array_append(acc, e)).otherwise(acc))
    return F.transform(F.array_sort(F.transform(chosen, lambda e: F.struct(e["start"].alias("s"), e.alias("e")))), lambda r: r["e"])


def entity_rows(resolved: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per resolved entity."""
    return exploded(resolved, "entities", id_col).select(id_col, "e.label", "e.start", "e.end", "e.value", "e.validated", "e.source")


def value_key(label: Column, value: Column) -> Column:
    return F.when(label.isin(*EXACT), value).otherwise(canonical_key(value))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def with_placeholders(entities: Column, text: Column | None = None) -> Column:
    """Entities with ``placeholder``: numbered per label by first occurrence of the value, equal values share one.

    Where the text itself holds placeholders of a label, its numbers go on after the greatest of them, so that a
    literal one is never taken for a value's.
    """
    keyed = F.transform(entities, lambda e: F.struct(e["label"].alias("label"), e["start"].alias("start"), e["end"].alias("end"), e["value"].alias("value"), value_key(e["label"], e["value"]).alias("key")))
    literal = F.array().cast("array<string>") if text is None else F.regexp_extract_all(text, F.lit(PLACEHOLDER), F.lit(0))

    def placed(k: Column, firsts: Column, said: Column) -> Column:
        def number(e: Column) -> Column:
            own = F.filter(firsts, lambda f: f["label"] == e["label"])
            taken = F.filter(said, lambda m: F.regexp_extract(m, r"^\[(.*)_[0-9]+\]$", 1) == e["label"])
            top = F.array_max(F.transform(taken, lambda m: F.regexp_extract(m, r"_([0-9]+)\]$", 1).try_cast("long")))
            return F.array_position(F.transform(own, lambda f: f["key"]), e["key"]) + F.coalesce(top, F.lit(0))

        return F.transform(k, lambda e: F.struct(e["label"].alias("label"), e["start"].alias("start"), e["end"].alias("end"), e["value"].alias("value"), F.concat(F.lit("["), e["label"], F.lit("_"), number(e).cast("string"), F.lit("]")).alias("placeholder")))

    distinct = lambda k: F.array_distinct(F.transform(k, lambda e: F.struct(e["label"].alias("label"), e["key"].alias("key"))))
    return let(keyed, lambda k: let(distinct(k), lambda firsts: let(literal, lambda said: placed(k, firsts, said))))


def rewrite(text: Column, placed: Column) -> Column:
    """The text with placeholders in place of the spans (in text order, without overlap)."""
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda acc, e: F.struct(e["end"].alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, e["start"] - acc["at"]), e["placeholder"]).alias("out"))
    return F.aggregate(placed, zero, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def anonymise(detected: DataFrame, text_col: str = "text", excluded: tuple[str, ...] = ()) -> DataFrame:
    """``detected`` with resolved ``entities`` (and their placeholders), ``anonymized_text``, ``mapping``, ``n_entities``, ``n_unique``.

    Excluded labels go before user terms count: an entity whose source is ``custom`` always stays.
    """
    kept = F.filter("entities", lambda e: (e["source"] == "custom") | ~e["label"].isin(*excluded)) if excluded else F.col("entities")
    out = detected.withColumn("entities", merge_spans(kept)).withColumn("entities", with_placeholders(F.col("entities"), F.col(text_col)))
    text = F.coalesce(F.col(text_col), F.lit(""))
    distinct = F.array_distinct(F.transform("entities", lambda e: e["placeholder"]))
    first = lambda p: F.element_at(F.filter("entities", lambda e: e["placeholder"] == p), 1)["value"]
    return out.select("*", rewrite(text, F.col("entities")).alias("anonymized_text"), F.map_from_arrays(distinct, F.transform(distinct, first)).alias("mapping"), F.size("entities").alias("n_entities"), F.size(distinct).alias("n_unique"))


def decode(text: Column, mapping: Column) -> Column:
    """Placeholders back to values in one pass: a value that looks like a placeholder is not decoded again; unknown ones stay."""
    marks = F.regexp_extract_all(text, F.lit(PLACEHOLDER), F.lit(0))
    gaps = F.split(text, PLACEHOLDER, -1)
    return F.concat_ws("", F.zip_with(gaps, marks, lambda g, m: F.concat(g, F.coalesce(F.try_element_at(mapping, m), m, F.lit("")))))


def unknown_placeholders(text: Column, mapping: Column) -> Column:
    return F.array_except(F.regexp_extract_all(text, F.lit(PLACEHOLDER), F.lit(0)), F.map_keys(mapping))


def residual(text: Column, value: Column) -> Column:
    """Whether a value is still in a text, by plain search on canonical forms: every occurrence is looked at, independent of the patterns.

    An occurrence counts if no word character stands beside it, nor, where the value's edge is a digit, a decimal
    mark with another digit. Null and empty values are in no text.
    """
    t, v = canonical_key(text), canonical_key(value)
    parts = F.split(t, F.concat(F.lit(r"\Q"), F.replace(v, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")), -1)
    word, digit = r"(?U)[\w]", "[0-9]"
    # Occurrences may overlap each other's edges, so a part that is empty stands for the value itself.
    left = F.transform(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p, i: F.when((p == "") & (i > 0), v).otherwise(p))
    right = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p, i: F.when((p == "") & (i < F.size(parts) - 2), v).otherwise(p))
    free_left = lambda p: ~F.right(p, F.lit(1)).rlike(word) & ~(F.left(v, F.lit(1)).rlike(digit) & p.rlike("[0-9][.,]$"))
    free_right = lambda p: ~F.left(p, F.lit(1)).rlike(word) & ~(F.right(v, F.lit(1)).rlike(digit) & p.rlike("^[.,][0-9]"))
    return F.coalesce((F.length(v) > 0) & F.exists(F.zip_with(left, right, lambda p, q: free_left(p) & free_right(q)), lambda x: x), F.lit(False))


def by_label(entities: DataFrame) -> DataFrame:
    """Entities and distinct values by label, most frequent first."""
    return entities.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(value_key(F.col("label"), F.col("value"))).alias("n_unique")).orderBy(F.desc("n"), "label")


def chunked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 120, overlap: int = 20) -> DataFrame:
    """Chunks of ``size`` words, ``overlap`` of them shared with the next: ``chunk_no, first_word, n_words, chunk``."""
    words = F.filter(F.split(collapse(F.coalesce(F.col(text_col), F.lit(""))), " "), lambda w: w != "")
    step = size - overlap
    rows = docs.select(id_col, words.alias("w")).where(F.size("w") > 0)
    last = F.greatest(F.ceil((F.size("w") - overlap) / step).cast("int") - 1, F.lit(0))
    rows = rows.select(id_col, "w", F.explode(F.sequence(F.lit(0), last)).alias("chunk_no"))
    piece = F.slice("w", F.col("chunk_no") * step + 1, F.lit(size))
    return rows.select(id_col, "chunk_no", (F.col("chunk_no") * step).alias("first_word"), F.size(piece).alias("n_words"), F.array_join(piece, " ").alias("chunk"))


def coalesce_spans(spans: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Gaps and islands: overlapping or touching spans of one label become one (id, label, start, end)."""
    w = Window.partitionBy(id_col, "label").orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("start") > F.coalesce(F.col("reach"), F.lit(-1)), 1).otherwise(0)).over(w)
    return spans.withColumn("reach", reach).withColumn("island", island).groupBy(id_col, "label", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")

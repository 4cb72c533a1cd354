"""Spreadsheets as a long table of cells: table detection, column classification, sampling, profiles.

``cells``: doc_id, sheet, row (from 1), col (from 0), text, is_text; non-empty cells only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import canonical_key, exploded
from .detect import RULES, rule_entities

KEYS = ["doc_id", "sheet"]


def column_uniques(cells: DataFrame) -> DataFrame:
    """Distinct values of each column in order of first appearance: ``value, first_row, n, rank``."""
    seen = cells.groupBy(*KEYS, "col", F.col("text").alias("value")).agg(F.min("row").alias("first_row"), F.count(F.lit(1)).alias("n"))
    return seen.withColumn("rank", F.row_number().over(Window.partitionBy(*KEYS, "col").orderBy("first_row", "value")))


def detect_tables(cells: DataFrame, merges: DataFrame | None = None, min_rows: int = 12, gap: int = 2, rectangular: float = 0.95, dominant: float = 0.8, min_cells: int = 10) -> DataFrame:
    """``doc_id, sheet, header_row, n_rows, n_cols, is_table`` of each sheet.

    The header is the first of the first five rows that holds three cells or more, all text. Data rows follow without a
    gap beyond ``gap``, most of them as wide as the header, each well-filled column mostly of one type, no merge among them.
    """
    rows = cells.groupBy(*KEYS, "row").agg(F.count(F.lit(1)).alias("n"), F.min(F.col("is_text").cast("int")).alias("all_text"))
    order = rows.withColumn("ord", F.row_number().over(Window.partitionBy(*KEYS).orderBy("row")))
    header = order.where("ord <= 5 AND n >= 3 AND all_text = 1").groupBy(*KEYS).agg(F.min_by(F.struct("row", "n"), "row").alias("h")).select(*KEYS, F.col("h.row").alias("header_row"), F.col("h.n").alias("n_cols"))
    data = rows.join(header, KEYS).where(F.col("row") > F.col("header_row"))
    lag = F.lag("row").over(Window.partitionBy(*KEYS).orderBy("row"))
    shape = data.withColumn("jump", F.col("row") - F.coalesce(lag, F.col("header_row"))).groupBy(*KEYS, "header_row", "n_cols").agg(F.count(F.lit(1)).alias("n_rows"), F.max("jump").alias("jump"), F.avg((F.col("n") <= F.col("n_cols")).cast("double")).alias("fit"))
    types = cells.join(header, KEYS).where(F.col("row") > F.col("header_row")).groupBy(*KEYS, "col").agg(F.count(F.lit(1)).alias("cells"), F.avg(F.col("is_text").cast("double")).alias("share"))
    mixed = types.where((F.col("cells") >= min_cells) & (F.greatest("share", 1 - F.col("share")) < dominant)).select(*KEYS).distinct().withColumn("mixed", F.lit(True))
    out = shape.join(mixed, KEYS, "left")
    ok = (F.col("n_rows") >= min_rows) & (F.col("jump") <= gap) & (F.col("fit") >= rectangular) & F.col("mixed").isNull()
    if merges is not None:
        crossing = merges.join(header, KEYS).where(F.col("r2") > F.col("header_row")).select(*KEYS).distinct().withColumn("merged", F.lit(True))
        out = out.join(crossing, KEYS, "left")
        ok = ok & F.col("merged").isNull()
    return out.select(*KEYS, "header_row", "n_rows", "n_cols", ok.alias("is_table"))


def stratified_sample(rows: DataFrame, keys: list[str], order: str, size: int) -> DataFrame:
    """A deterministic sample of ``size`` rows of each group: half from its head, half evenly spaced to its last row."""
    w = Window.partitionBy(*keys)
    ranked = rows.withColumn("__i", F.row_number().over(w.orderBy(order)) - 1).withColumn("__n", F.count(F.lit(1)).over(w))
    head = size // 2
    rest, span = size - head, F.col("__n") - head - 1
    near = F.round((F.col("__i") - head) * (rest - 1) / F.greatest(span, F.lit(1)))
    spaced = (F.col("__i") >= head) & (F.round(near * span / max(rest - 1, 1)) + head == F.col("__i"))
    return ranked.where((F.col("__n") <= size) | (F.col("__i") < head) | spaced).drop("__i", "__n")


def classify_columns(values: DataFrame, labels: tuple[str, ...] = ("EMAIL", "CREDITCARDNUMBER", "TELEPHONENUM", "IP_ADDRESS", "IBAN", "DATE"), coverage: int = 60, least: int = 5, model_share: float = 0.2) -> DataFrame:
    """``doc_id, sheet, col, n, label, full_hits, partial_hits, mode`` over distinct values.

    mode is ``column`` if enough values are one label as a whole, ``model`` if some hold one, else ``regex``.
    """
    text, rules = F.col("value"), [r for r in RULES if r.label in labels and not r.needs_cue]
    found = F.flatten(F.array(*(F.transform(rule_entities(text, r), lambda e: F.struct(e["label"].alias("label"), ((e["start"] == 0) & (e["end"] == F.length(text))).alias("whole"))) for r in rules)))
    none = F.expr("named_struct('label', cast(null AS string), 'whole', cast(null AS boolean))")  # every value's own row, which counts them
    hits = exploded(values.select(*KEYS, "col", "value", F.concat(F.array(none), F.array_distinct(found)).alias("f")), "f", *KEYS, "col", "value", name="f")
    label, each = F.col("label"), hits.groupBy(*KEYS, "col", F.col("f.label").alias("label")).agg(F.countDistinct("value").alias("n"), F.countDistinct(F.when(F.col("f.whole"), F.col("value"))).alias("full_hits"), F.countDistinct(F.when(~F.col("f.whole"), F.col("value"))).alias("partial_hits"))
    best = F.max_by(F.struct("label", "full_hits", "partial_hits"), F.when(label.isNotNull(), F.struct("full_hits", "partial_hits", "label")))
    columns = each.groupBy(*KEYS, "col").agg(F.max(F.when(label.isNull(), F.col("n"))).alias("n"), best.alias("b"))
    full, part = F.coalesce("b.full_hits", F.lit(0)), F.coalesce("b.partial_hits", F.lit(0))
    mode = F.when((F.col("n") >= least) & (full * 100 >= F.col("n") * coverage) & (full >= part), "column").when((full + part) >= F.greatest(F.lit(2.0), F.col("n") * model_share), "model").otherwise("regex")
    return columns.select(*KEYS, "col", "n", F.when(full + part > 0, F.col("b.label")).alias("label"), full.alias("full_hits"), part.alias("partial_hits"), mode.alias("mode"))


def linearise(cells: DataFrame, header: DataFrame | None = None) -> DataFrame:
    """One line per row: cells joined by `` | ``; under a header as ``Label: value``."""
    c = cells
    if header is not None:
        heads = cells.join(header.select(*KEYS, "header_row"), KEYS).where("row = header_row").select(*KEYS, "col", F.col("text").alias("head"), "header_row")
        c = cells.join(heads, [*KEYS, "col"], "left").withColumn("text", F.when(F.col("head").isNotNull() & (F.col("row") > F.col("header_row")), F.concat("head", F.lit(": "), "text")).otherwise(F.col("text")))
    lines = c.groupBy(*KEYS, "row").agg(F.array_sort(F.collect_list(F.struct("col", "text"))).alias("cells"))
    return lines.select(*KEYS, "row", F.array_join(F.transform("cells", lambda x: x["text"]), " | ").alias("line"))


def header_only(mapping: DataFrame, cells: DataFrame, header: DataFrame) -> DataFrame:
    """Placeholders whose value is a header label and occurs in no data cell."""
    placed = cells.join(header.select(*KEYS, "header_row"), KEYS)
    heads = placed.where("row = header_row").select(canonical_key(F.col("text")).alias("key")).distinct()
    data = placed.where("row > header_row").select(canonical_key(F.col("text")).alias("key")).distinct()
    return mapping.withColumn("key", canonical_key(F.col("value"))).join(heads, "key", "left_semi").join(data, "key", "left_anti").drop("key")


def delimiter_vote(text: Column, candidates: tuple[str, ...] = (",", ";", "\t", "|"), lines: int = 20) -> Column:
    """The delimiter that most head lines hold equally often; a comma where none does."""
    head = F.slice(F.filter(F.split(text, "\r?\n"), lambda x: F.trim(x) != ""), 1, lines)

    def score(d: str) -> Column:
        counts = F.transform(head, lambda x: F.length(x) - F.length(F.replace(x, F.lit(d), F.lit(""))))
        first = F.coalesce(F.try_element_at(counts, F.lit(1)), F.lit(0))
        return F.when(first > 0, F.size(F.filter(counts, lambda n: n == first)) * 1000 + first).otherwise(0)

    best = F.greatest(*(score(d) for d in candidates))
    return F.coalesce(F.when(best > 0, F.coalesce(*(F.when(score(d) == best, F.lit(d)) for d in candidates))), F.lit(","))


def json_card(text: Column) -> Column:
    """What a JSON text holds: ``array of n``, ``object: keys``, ``scalar`` or ``invalid``."""
    v = F.try_parse_json(text)
    kind = F.schema_of_variant(v)
    keys = F.json_object_keys(text)
    return F.when(v.isNull(), "invalid").when(kind.startswith("ARRAY"), F.concat(F.lit("array of "), F.json_array_length(text).cast("string"))).when(keys.isNotNull(), F.concat(F.lit("object: "), F.array_join(F.array_sort(keys), ","))).otherwise("scalar")


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """A card of a table: ``column, n, n_null, n_distinct, least, greatest`` in one pass (distinct counts are estimates)."""
    aggs = [f for c in columns for f in (F.count(F.when(F.col(c).isNull(), 1)).alias(f"{c}__null"), F.approx_count_distinct(c, 0.02).alias(f"{c}__distinct"), F.min(c).cast("string").alias(f"{c}__min"), F.max(c).cast("string").alias(f"{c}__max"))]
    one = df.agg(F.count(F.lit(1)).alias("n"), *aggs)
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col("n"), F.col(f"{c}__null").alias("n_null"), F.col(f"{c}__distinct").alias("n_distinct"), F.col(f"{c}__min").alias("least"), F.col(f"{c}__max").alias("greatest")) for c in columns))).alias("c")).select("c.*")

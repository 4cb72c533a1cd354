"""A registry's life: analyse texts into versioned entities, correct it by hand, realign what was written, check what leaves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import alnum_count, canonical_key, too_noisy
from .registry import LEGAL_FORMS, allocate, resolve_merges, surface_key
from .resolve import PLACEHOLDER, decode

#: Joins the fields of a batch; no detector's match can hold it.
FIELD_BREAK = "\n␞\n"


def junk_value(label: Column, value: Column) -> Column:
    """Values that are nobody's: fewer than two letters or digits, or a company name that is only a legal form."""
    bare = F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), r"[.\s]", "")
    return (alnum_count(F.coalesce(value, F.lit(""))) < 2) | ((label == "ORG") & bare.rlike(rf"^(?:{LEGAL_FORMS})$"))


def forced_spans(found: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """``key, label, start, end, forced``: spans of known values win over found ones they overlap unless a found one is longer.

    Ties go to the known value; a known span that loses to a longer found one goes.
    """
    f = found.select(key, F.col("label").alias("f_label"), F.col("start").alias("f_start"), F.col("end").alias("f_end"))
    k = known.select(key, F.col("label").alias("k_label"), F.col("start").alias("k_start"), F.col("end").alias("k_end"))
    over = f.join(k, key).where("f_start < k_end AND k_start < f_end")
    longer = F.col("f_end") - F.col("f_start") > F.col("k_end") - F.col("k_start")
    lost_f = over.where(~longer).select(key, F.col("f_label").alias("label"), F.col("f_start").alias("start"), F.col("f_end").alias("end")).distinct()
    lost_k = over.where(longer).select(key, F.col("k_label").alias("label"), F.col("k_start").alias("start"), F.col("k_end").alias("end")).distinct()
    cols = [key, "label", "start", "end"]
    return found.select(cols).join(lost_f, cols, "left_anti").withColumn("forced", F.lit(False)).unionByName(known.select(cols).join(lost_k, cols, "left_anti").withColumn("forced", F.lit(True)))


def analysed(entities: DataFrame, existing: DataFrame, version: int) -> tuple[DataFrame, DataFrame]:
    """New registry rows from found entities: ``(scope, label, key, value, placeholder, version)`` of entities and
    ``(scope, key, surface, placeholder, version)`` of aliases.

    entities: scope, label, value, first_seen; existing: scope, label, key, placeholder. Junk is left out, known keys keep their
    placeholder, new ones are numbered on; what this call learns has the version after ``version``.
    """
    real = entities.where(~junk_value(F.col("label"), F.col("value")))
    placed = allocate(real, existing)
    fresh = placed.join(existing.select("scope", "key"), ["scope", "key"], "left_anti").withColumn("version", F.lit(version + 1))
    surfaces = real.select("scope", surface_key(F.col("label"), F.col("value")).alias("key"), F.col("value").alias("surface")).distinct()
    aliases = surfaces.join(placed.select("scope", "key", "placeholder"), ["scope", "key"]).withColumn("version", F.lit(version + 1))
    return fresh, aliases


def merged(entities: DataFrame, aliases: DataFrame, source: Column, target: Column, version: int) -> tuple[DataFrame, DataFrame]:
    """Entities and aliases after one entity is sent to another: its aliases are copied under the target with a new version, no row is rewritten but the redirect."""
    sent = entities.withColumn("merged_into", F.when(F.col("id") == source, target).otherwise(F.col("merged_into")))
    copies = aliases.where(F.col("entity_id") == source).withColumn("entity_id", target.cast(aliases.schema["entity_id"].dataType)).withColumn("version", F.lit(version + 1).cast(aliases.schema["version"].dataType))
    return sent, aliases.unionByName(copies)


def keep_separate(suggestions: DataFrame, refused: DataFrame) -> DataFrame:
    """Merge suggestions without the pairs that were refused, in whichever order."""
    pair = lambda df: df.select(F.least("short_id", "long_id").alias("p"), F.greatest("short_id", "long_id").alias("q"))
    marked = suggestions.withColumn("p", F.least("short_id", "long_id")).withColumn("q", F.greatest("short_id", "long_id"))
    return marked.join(pair(refused).distinct(), ["p", "q"], "left_anti").drop("p", "q")


def excluded(entities: DataFrame, ids: DataFrame | None = None, labels: tuple[str, ...] = (), exclude: bool = True) -> DataFrame:
    """Entities with ``excluded`` set (or taken back) for given ids and whole labels; the others keep theirs."""
    hit = F.col("label").isin(*labels) if labels else F.lit(False)
    if ids is not None:
        entities = entities.join(ids.select("id").distinct().withColumn("__hit", F.lit(True)), "id", "left")
        hit = hit | F.coalesce("__hit", F.lit(False))
    return entities.withColumn("excluded", F.when(hit, F.lit(exclude)).otherwise(F.coalesce("excluded", F.lit(False)))).drop("__hit")


def column_placeholders(cells: DataFrame, columns: DataFrame, existing: DataFrame) -> DataFrame:
    """Placeholders for every usable distinct value of columns chosen by hand; known values keep theirs.

    cells: scope, sheet, row, col, text; columns: sheet, col, label.
    """
    values = cells.join(columns, ["sheet", "col"]).where(~too_noisy(F.col("text"))).groupBy("scope", "label", F.col("text").alias("value")).agg(F.min("row").alias("first_seen"))
    return allocate(values, existing)


def stale_files(files: DataFrame, surfaces: DataFrame) -> DataFrame:
    """``file_id, scope, written``: files written before the registry's last version; these are what a realignment redoes."""
    last = surfaces.groupBy("scope").agg(F.max("version").alias("last"))
    return files.join(last, "scope").where(F.col("written") < F.col("last")).select("file_id", "scope", "written", "last")


def egress(messages: DataFrame, leaks: DataFrame, key: str) -> DataFrame:
    """Messages and what keeps them from leaving: ``blocked`` and the leaked placeholders in order."""
    per = leaks.groupBy(key).agg(F.array_sort(F.collect_set("placeholder")).alias("leaked"))
    return messages.join(per, key, "left").select(key, F.col("leaked").isNotNull().alias("blocked"), F.coalesce("leaked", F.array().cast("array<string>")).alias("leaked"))


def fields_text(fields: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """The fields of a batch as one text, so that one analysis sees them all."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(F.col(text), F.lit("")).alias("t"))))
    return fields.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x["t"]), FIELD_BREAK).alias("text"), F.transform(ordered, lambda x: x["o"]).alias("orders"))


def text_fields(batch: DataFrame, key: str, text: str) -> DataFrame:
    """The fields back from a batch's rewritten text."""
    parts = F.arrays_zip(F.col("orders").alias("order_no"), F.split(text, FIELD_BREAK, -1).alias("field"))
    return batch.select(key, F.explode(parts).alias("p")).select(key, "p.order_no", "p.field")


def safe_variants(texts: DataFrame, variants: DataFrame, key: str) -> DataFrame:
    """``key, placeholder, surface``: derived variants that can be replaced in a text: they occur as words, and no glued form of one is left.

    Both sides are compared in canonical form; variants are those of the text's own scope (few for a text).
    """
    t = texts.select(key, "scope", F.concat(F.lit(" "), canonical_key(F.col("text")), F.lit(" ")).alias("t"))
    pairs = t.join(variants.select("scope", "placeholder", "surface", canonical_key(F.col("surface")).alias("v")), "scope")
    word = F.regexp_replace("t", F.concat(F.lit(r"(?U)(?<!\w)\Q"), F.col("v"), F.lit(r"\E(?!\w)")), "\u0001")
    return pairs.select(key, "placeholder", "surface", "t", "v", word.alias("masked")).where(F.contains("masked", F.lit("\u0001")) & ~F.contains("masked", F.col("v"))).select(key, "placeholder", "surface")


#: Parts of an answer in which placeholders stay as they are: fenced code, inline code, tags, link targets.
PROTECTED = r"(?s)```.*?(?:```|\z)|`[^`\n]*`|<[^<>\n]*>|\]\([^()\n]*\)"


def protected_placeholders(text: Column) -> Column:
    """Distinct placeholders left inside protected parts, in order."""
    parts = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PROTECTED), F.lit(0))
    return F.array_distinct(F.flatten(F.transform(parts, lambda p: F.regexp_extract_all(p, F.lit(PLACEHOLDER), F.lit(0)))))


def escaped(value: Column, syntax: str) -> Column:
    """A value as it must be written inside ``xml``/``html`` or a ``json`` string."""
    if syntax in ("xml", "html"):
        pairs = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;" if syntax == "html" else "&apos;"))
    elif syntax == "json":
        pairs = (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f"))
    else:
        raise ValueError(f"no escapes for {syntax}")
    for plain, written in pairs:
        value = F.replace(value, F.lit(plain), F.lit(written))
    return value


def restored(text: Column, mapping: Column, syntax: str) -> Column:
    """Placeholders back to values, escaped for the file's syntax; unknown ones stay."""
    return decode(text, F.transform_values(mapping, lambda _, v: escaped(v, syntax)))


def whole_cells(cells: DataFrame, known: DataFrame) -> DataFrame:
    """Cells whose whole value is known, by canonical key: ``sheet, row, col, placeholder``."""
    right = known.select(canonical_key(F.col("surface")).alias("__key"), "placeholder").groupBy("__key").agg(F.min("placeholder").alias("placeholder"))
    return cells.withColumn("__key", canonical_key(F.col("text"))).join(right, "__key").select("sheet", "row", "col", "placeholder")


def value_hits(sampled: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """``key, value, hit``: sampled distinct values that are an entity's value (``full``) or hold one (``partial``).

    Both sides belong to one key (a sheet's column) and are bounded by the sample.
    """
    pairs = sampled.select(key, "value").distinct().join(values.select(key, F.col("value").alias("entity")).distinct(), key)
    full = F.max(F.lower("value") == F.lower("entity"))
    part = F.max(F.contains(F.lower("value"), F.lower("entity")))
    got = pairs.groupBy(key, "value").agg(full.alias("full"), part.alias("part"))
    return got.where("part").select(key, "value", F.when(F.col("full"), "full").otherwise("partial").alias("hit"))


def projected_matches(matches: DataFrame, segments: DataFrame, key: str) -> DataFrame:
    """``key, segment, start, end, replacement``: matches on the joined text as pieces of the segments (nodes, cells) they touch.

    The first piece of a match takes its placeholder, the others are emptied; positions count from the segment's start.
    """
    pairs = matches.select(key, F.col("start").alias("ms"), F.col("end").alias("me"), "placeholder").join(segments.select(key, "segment", F.col("start").alias("ss"), F.col("end").alias("se")), key).where("ms < se AND ss < me")
    first = F.row_number().over(Window.partitionBy(key, "ms", "me").orderBy("ss", "segment")) == 1
    return pairs.select(key, "segment", (F.greatest("ms", "ss") - F.col("ss")).alias("start"), (F.least("me", "se") - F.col("ss")).alias("end"), F.when(first, F.col("placeholder")).otherwise("").alias("replacement"))


def preview(rows: DataFrame, sheet: str, order: str, most: int) -> DataFrame:
    """The first rows of each sheet, and whether the sheet has more."""
    w = Window.partitionBy(sheet)
    numbered = rows.withColumn("place", F.row_number().over(w.orderBy(order))).withColumn("truncated", F.count(F.lit(1)).over(w) > most)
    return numbered.where(F.col("place") <= most)


def current_roots(entities: DataFrame) -> DataFrame:
    """Entities that others were merged into or that stand alone, with how many they stand for."""
    return resolve_merges(entities).groupBy("root").agg(F.count(F.lit(1)).alias("n"))


def exact_pattern(value: str) -> str:
    """A pattern for a value whose case and blanks count: word edges only where the value ends in a word character; ``-p`` may stand before it."""
    import re

    word = re.compile(r"\w")
    left = r"(?:(?<!\w)|(?<=(?<!\w)-[pP]))" if word.match(value[:1]) else ""
    return f"{left}\\Q{value}\\E{'(?!\\w)' if word.match(value[-1:]) else ''}"


def value_pattern(value: str) -> str:
    """A pattern that finds a value in running text: any blanks between its words, a hyphen at a line's end inside a word, no digit or decimal mark beside a number."""
    import re

    tokens = value.split()
    if not tokens:
        raise ValueError("an empty value has no pattern")
    # Each character may be followed by a hyphen at a line's end.
    body = r"[\s  ]+".join(r"(?:-[ \t]*\r?\n[ \t]*)?".join(f"\\Q{c}\\E" for c in t) for t in tokens)
    enough = len(re.sub(r"[\W_]", "", value)) >= 4
    first, last = value.strip()[0], value.strip()[-1]

    def edge(c: str, number: str, other: str) -> str:
        if c.isdigit():
            return number
        return other if c.isalnum() or not enough else ""

    return f"(?iU){edge(first, r'(?<![\w])(?<![0-9][.,])', r'(?<!\w)')}{body}{edge(last, r'(?!\w)(?![.,][0-9])', r'(?!\w)')}"


def display_name(placeholder: Column) -> Column:
    """A placeholder as a name for people and files: no brackets, blanks and odd characters as underscores."""
    return F.regexp_replace(F.regexp_replace(F.trim(placeholder), r"^\[|\]$", ""), r"[^\p{L}\p{N}_.-]+", "_")

"""Versioned entity registry: resolution of merges, known surfaces, allocation, redaction, leaks, staleness.

Tables: ``entities(id, scope, placeholder, label, canonical_value, version, merged_into, excluded)`` and
``aliases(entity_id, surface, version)``. Rows are never rewritten: a merge points to its target, an
exclusion sets a flag, and a placeholder that was ever handed out stays decodable.
"""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import canonical_key, collapse, exploded, too_noisy
from .detect import EXACT

#: Label spellings that mean the same (fixed values).
LABEL_GROUPS = {"PERSON": "FULLNAME", "PER": "FULLNAME", "NAME": "FULLNAME", "FULL_NAME": "FULLNAME", "ORGANIZATION": "ORG", "ORGANISATION": "ORG", "COMPANY": "ORG"}
#: Titles before names and legal forms after company names (fixed values).
TITLES = "mr|mrs|ms|dr|prof|sig|sigra|ing|avv|herr|frau|mme|sr|sra"
LEGAL_FORMS = "srl|spa|sas|snc|gmbh|ag|kg|ug|ltd|llc|inc|plc|corp|sa|sarl|sl|nv|bv"
#: Surfaces that one automaton of a text pass holds.
BLOCK = 20_000
#: Words of a surface by which it is looked up, and bytes of surfaces that are told to every task.
HEAD, SURFACE_BYTES = 8, 8 << 20


def label_group(label: Column) -> Column:
    groups = F.create_map(*[F.lit(x) for kv in LABEL_GROUPS.items() for x in kv])
    return F.coalesce(F.try_element_at(groups, F.upper(label)), F.upper(label))


def surface_key(label: Column, surface: Column) -> Column:
    """What makes two surfaces one entity: raw for exact labels; names without titles, word order ignored; companies without legal form."""
    group = label_group(label)
    bare = F.trim(F.regexp_replace(canonical_key(surface), r"[.,]", ""))
    name = F.array_join(F.array_sort(F.split(F.regexp_replace(bare, rf"^(?:(?:{TITLES})\s+)+", ""), " ")), " ")
    org = F.regexp_replace(bare, rf"\s+(?:{LEGAL_FORMS})$", "")
    return F.concat(group, F.lit("|"), F.when(label.isin(*EXACT), surface).when(group == "FULLNAME", name).when(group == "ORG", org).otherwise(bare))


def _cut(df: DataFrame) -> DataFrame:
    """Materialise in the session's checkpoint folder, a temporary one where none is named."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir") or df.sparkSession.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="maskwright-checkpoint-"))
    return df.checkpoint(eager=True)


def resolve_merges(entities: DataFrame) -> DataFrame:
    """``id, root``: the end of each chain of ``merged_into``, found by pointer doubling until no pointer changes.

    A pointer to a missing entity ends its chain there. Entities whose chain runs in a circle are their own root:
    they reach no end in as many rounds as the longest possible chain needs.
    """
    present = entities.select(F.col("id").alias("merged_into"))
    valid = entities.where("merged_into IS NOT NULL").join(present, "merged_into", "left_semi").select("id", "merged_into")
    jump = _cut(entities.select("id").join(valid, "id", "left").select("id", F.coalesce("merged_into", "id").alias("to")))
    ends = jump.where(F.col("id") == F.col("to")).join(valid, "id", "left_anti").select(F.col("id").alias("end"))
    for _ in range(jump.where(F.col("id") != F.col("to")).count().bit_length()):
        ahead = jump.select(F.col("id").alias("to"), F.col("to").alias("further"))
        moved = _cut(jump.join(ahead, "to").select("id", F.col("further").alias("to"), (F.col("further") != F.col("to")).alias("changed")))
        jump = moved.select("id", "to")
        if moved.where("changed").isEmpty():
            break
    return jump.join(ends, jump["to"] == ends["end"], "left").select("id", F.when(F.col("end").isNotNull(), F.col("to")).otherwise(F.col("id")).alias("root"))


def known_surfaces(entities: DataFrame, aliases: DataFrame, max_version: int | None = None) -> DataFrame:
    """``scope, placeholder, label, surface`` to look for: aliases up to a version, through merges, without excluded or noisy ones."""
    if max_version is not None:
        aliases = aliases.where(F.col("version") <= max_version)
    roots = resolve_merges(entities)
    target = entities.select(F.col("id").alias("root"), "scope", "placeholder", "label", "excluded")
    rows = aliases.join(roots, aliases["entity_id"] == roots["id"]).join(target, "root").where(~F.coalesce("excluded", F.lit(False)))
    usable = F.when(F.col("label").isin(*EXACT), F.length("surface") > 0).otherwise(~too_noisy(F.col("surface")))
    return rows.where(usable).select("scope", "placeholder", "label", "surface").distinct()


def derived_variants(surfaces: DataFrame) -> DataFrame:
    """Company surfaces without their legal form, if two words and six letters or digits are left."""
    bare = F.regexp_replace(collapse(F.col("surface")), rf"(?i)[\s,]+(?:{LEGAL_FORMS})\.?$", "")
    rows = surfaces.where(label_group(F.col("label")) == "ORG").select("scope", "placeholder", "label", bare.alias("derived"), "surface")
    keep = (F.col("derived") != F.col("surface")) & (F.size(F.split("derived", " ")) >= 2) & (F.length(F.regexp_replace("derived", r"[^\p{L}\p{N}]", "")) >= 6)
    return rows.where(keep).select("scope", "placeholder", "label", F.col("derived").alias("surface")).distinct()


def allocate(values: DataFrame, existing: DataFrame, order: str = "first_seen") -> DataFrame:
    """``scope, label, key, value, placeholder``: existing placeholders by key, new ones numbered on after the greatest.

    values: scope, label, value and an order column; existing: scope, label, key, placeholder. No number is used twice.
    """
    keyed = values.withColumn("key", surface_key(F.col("label"), F.col("value")))
    first = keyed.groupBy("scope", "label", "key").agg(F.min(order).alias("at"), F.min_by("value", order).alias("value"))
    known = first.join(existing.select("scope", "key", "placeholder").dropDuplicates(["scope", "key"]), ["scope", "key"], "left")
    number = F.regexp_extract("placeholder", r"_([0-9]+)\]$", 1).cast("int")
    top = existing.groupBy("scope", "label").agg(F.max(number).alias("top"))
    new = known.where("placeholder IS NULL").join(top, ["scope", "label"], "left")
    rank = F.row_number().over(Window.partitionBy("scope", "label").orderBy("at", "key"))
    numbered = new.withColumn("placeholder", F.concat(F.lit("["), F.col("label"), F.lit("_"), (F.coalesce("top", F.lit(0)) + rank).cast("string"), F.lit("]")))
    cols = ["scope", "label", "key", "value", "placeholder"]
    return known.where("placeholder IS NOT NULL").select(cols).unionByName(numbered.select(cols))


class Lookup:
    """Whole-word occurrences of known values, longest first, by one automaton over case-folded text."""

    def __init__(self, pairs: list[tuple[str, str]]):
        import ahocorasick

        self.machine = ahocorasick.Automaton()
        for surface, placeholder in sorted(set(pairs)):
            self.machine.add_word(surface.lower(), (len(surface), placeholder, surface))
        if len(self.machine):
            self.machine.make_automaton()

    def claims(self, text: str) -> list[tuple[int, int, str]]:
        """Non-overlapping (start, end, placeholder): longer first, then leftmost; in text order."""
        low = text.lower()
        if not len(self.machine) or len(low) != len(text):
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        word = re.compile(r"\w")
        found = []
        for last, (n, placeholder, _) in self.machine.iter(low) if len(self.machine) else ():
            a, b = last - n + 1, last + 1
            open_left = not (a and word.match(low[a]) and word.match(low[a - 1]))
            open_right = not (b < len(low) and word.match(low[b - 1]) and word.match(low[b]))
            if open_left and open_right:
                found.append((a, b, placeholder))
        taken: list[tuple[int, int, str]] = []
        for a, b, p in sorted(found, key=lambda f: (f[0] - f[1], f[0])):
            if all(b <= x or a >= y for x, y, _ in taken):
                taken.append((a, b, p))
        return sorted(taken)


def redact(docs: DataFrame, surfaces: list[tuple[str, str]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, redacted, occurrences, by_placeholder``: known surfaces replaced, longest first.

    ``surfaces`` is a bounded term list (see BLOCK); for larger registries use :func:`occurrences`, which joins.
    """
    if len(surfaces) > BLOCK:
        raise ValueError(f"{len(surfaces)} surfaces; take them in blocks of {BLOCK}")
    shared = docs.sparkSession.sparkContext.broadcast(surfaces)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(shared.value)
        for batch in batches:
            texts, counts, marks = [], [], []
            for text in batch.column(1).to_pylist():
                claims = lookup.claims(text or "")
                out, at, by = [], 0, {}
                for a, b, p in claims:
                    out += [text[at:a], p]
                    at = b
                    by[p] = by.get(p, 0) + 1
                texts.append(None if text is None else "".join([*out, text[at:]]))
                counts.append(len(claims))
                marks.append(sorted(by.items()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, type=pa.string()), pa.array(counts, type=pa.int64()), pa.array(marks, type=pa.map_(pa.string(), pa.int64()))], names=[id_col, "redacted", "occurrences", "by_placeholder"])

    return docs.select(F.col(id_col).cast("long").alias(id_col), text_col).mapInArrow(kernel, f"{id_col} long, redacted string, occurrences long, by_placeholder map<string,bigint>")


def _words(c: Column) -> Column:
    """Words of a text's canonical form."""
    return F.filter(F.split(canonical_key(c), r"(?U)[^\w]+"), lambda w: w != "")


def occurrences(docs: DataFrame, surfaces: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, placeholder, surface`` for surfaces that occur in a text as a run of whole words; a join on runs of words.

    Each text gives its distinct runs of as many words as surfaces have, HEAD at most; they meet the surfaces by equality. Of
    longer surfaces the first HEAD words find the texts, which are then searched for the whole. One count of the surfaces says
    which lengths there are, and whether they are told to every task (BLOCK of them, SURFACE_BYTES at most) or dealt out:
    Catalyst's own choice goes by the size of files, in which repeats are small, and may send the texts' words to the driver.
    """
    s = surfaces.select("placeholder", "surface", _words(F.col("surface")).alias("words")).where(F.size("words") > 0).distinct()
    head = F.array_join(F.slice("words", 1, HEAD), " ")
    s = s.select("placeholder", "surface", head.alias("head"), F.array_join("words", " ").alias("form"), F.size("words").alias("size"))
    bytes_ = sum(F.octet_length(c) for c in ("surface", "head", "form"))
    sizes = s.groupBy(F.least("size", F.lit(HEAD)).alias("n")).agg(F.count(F.lit(1)).alias("rows"), F.sum(bytes_).alias("bytes"), F.max("size").alias("longest")).collect()  # HEAD rows at most
    few = sum(r.rows for r in sizes) <= BLOCK and sum(r.bytes for r in sizes) <= SURFACE_BYTES

    def runs(n: int) -> Column:
        found = F.transform(F.sequence(F.lit(1), F.size("words") - n + 1), lambda i: F.array_join(F.slice("words", i, n), " "))
        return F.when(F.size("words") >= n, found).otherwise(F.array().cast("array<string>"))

    words = docs.select(id_col, _words(F.coalesce(F.col(text_col), F.lit(""))).alias("words"))
    every = F.array_distinct(F.flatten(F.array(*[runs(r.n) for r in sizes]))) if sizes else F.array().cast("array<string>")
    each = exploded(words.select(id_col, every.alias("runs")), "runs", id_col, name="run")
    hits = each.join(F.broadcast(s) if few else s.hint("merge"), F.col("run") == F.col("head"))
    short = hits.where(F.col("size") <= HEAD).select(id_col, "placeholder", "surface")
    if all(r.longest <= HEAD for r in sizes):
        return short.distinct()
    long = hits.where(F.col("size") > HEAD).select(F.col(id_col).alias("__id"), "placeholder", "surface", "form").distinct()
    padded = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    texts = words.select(id_col, padded(F.array_join("words", " ")).alias("__text"))
    whole = texts.hint("merge").join(long, F.col(id_col).eqNullSafe(F.col("__id"))).where(F.contains("__text", padded(F.col("form"))))
    return short.union(whole.select(id_col, "placeholder", "surface")).distinct()


def leaks(docs: DataFrame, surfaces: DataFrame, older: DataFrame | None = None, **cols: str) -> DataFrame:
    """Known surfaces still present; with ``older`` only those learned since."""
    if older is not None:
        surfaces = surfaces.join(older.select("placeholder", "surface"), ["placeholder", "surface"], "left_anti")
    return occurrences(docs, surfaces, **cols)


def stale(files: DataFrame, learned: DataFrame) -> DataFrame:
    """Files whose text may hold surfaces learned after they were last written or checked: ``file_id, scope, n_new``."""
    since = F.greatest("written_version", F.coalesce("checked_version", F.lit(0)))
    rows = files.withColumn("since", since).join(learned, "scope").where(F.col("version") > F.col("since"))
    return rows.groupBy("file_id", "scope").agg(F.count(F.lit(1)).alias("n_new"))


def merge_suggestions(entities: DataFrame) -> DataFrame:
    """Pairs of one scope and label in which one value's words are a proper subset of the other's: ``scope, label, short_id, long_id``.

    Joined on the shorter one's rarest word, so that a common word does not pair everything with everything.
    """
    words = entities.select("scope", "label", "id", F.array_distinct(F.split(canonical_key(F.col("canonical_value")), " ")).alias("words"))
    each = words.select("scope", "label", "id", "words", F.explode("words").alias("word"))
    rarity = each.groupBy("scope", "label", "word").agg(F.count(F.lit(1)).alias("df"))
    short = each.join(rarity, ["scope", "label", "word"]).groupBy("scope", "label", "id").agg(F.min_by("word", F.struct("df", "word")).alias("word"), F.first("words").alias("short_words")).withColumnRenamed("id", "short_id")
    long = each.select("scope", "label", "word", F.col("id").alias("long_id"), F.col("words").alias("long_words"))
    pairs = short.join(long, ["scope", "label", "word"])
    subset = (F.size(F.array_except("short_words", "long_words")) == 0) & (F.size("long_words") > F.size("short_words"))
    return pairs.where(subset).select("scope", "label", "short_id", "long_id").distinct()


def redaction_report(mapping: DataFrame, found: DataFrame) -> DataFrame:
    """Occurrences of every placeholder of a mapping, 0 where none was found."""
    return mapping.join(found.groupBy("placeholder").agg(F.count(F.lit(1)).alias("occurrences")), "placeholder", "left").select("placeholder", F.coalesce("occurrences", F.lit(0)).alias("occurrences"))


def merge_terms(global_terms: DataFrame, personal_terms: DataFrame) -> DataFrame:
    """Two term lists as one ``term, tag``: noisy terms go, equal keys once, the global list wins, then input order."""
    both = global_terms.withColumn("level", F.lit(0)).unionByName(personal_terms.withColumn("level", F.lit(1)))
    both = both.withColumn("term", collapse(F.col("term"))).where(~too_noisy(F.col("term")))
    w = Window.partitionBy(canonical_key(F.col("term"))).orderBy("level", "position")
    return both.withColumn("rank", F.row_number().over(w)).where("rank = 1").select("term", "tag", "level")


def purge(tables: dict[str, DataFrame], user_id: int) -> dict[str, DataFrame]:
    """All tables without what belongs to a user, in dependency order: users, conversations, messages, entities, aliases, attachments."""
    out = dict(tables)
    gone = tables["conversations"].where(F.col("owner_id") == user_id).select(F.col("id").alias("gone"))
    out["users"] = tables["users"].where(F.col("id") != user_id)
    out["conversations"] = tables["conversations"].where(F.coalesce(F.col("owner_id") != user_id, F.lit(True)))
    for name, key in (("messages", "conv_id"), ("attachments", "conv_id"), ("entities", "scope")):
        if name in tables:
            out[name] = tables[name].join(gone, tables[name][key] == gone["gone"], "left_anti")
    if "aliases" in tables:
        out["aliases"] = tables["aliases"].join(out["entities"].select(F.col("id").alias("entity_id")), "entity_id", "left_semi")
    return out


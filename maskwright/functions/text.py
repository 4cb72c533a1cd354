"""Scalar text semantics as Catalyst expressions: canonical keys, predicates, match spans, HTML to text."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

BLANK = r"[\s\u00A0\u202F\u2007]+"


def collapse(c: Column) -> Column:
    """White space runs as one blank, none at the edges."""
    return F.trim(F.regexp_replace(c, BLANK, " "))


def canonical_key(c: Column) -> Column:
    """Case-folded, collapsed form for comparing ordinary values (sharp s as ss); NFC input is assumed, see :func:`nfc`."""
    return collapse(F.regexp_replace(F.lower(c), "ß", "ss"))


@F.pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Canonical composition; only worth calling where the text is not ASCII."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def alnum_count(c: Column) -> Column:
    """Letters and digits of any script."""
    return F.length(F.regexp_replace(c, r"[^\p{L}\p{N}]+", ""))


def too_noisy(c: Column) -> Column:
    """Values that must not be searched for: fewer than two letters or digits, or exactly two digits."""
    return (alnum_count(c) < 2) | F.regexp_replace(c, r"[^\p{L}\p{N}]+", "").rlike("^[0-9]{2}$")


def searchable(c: Column) -> Column:
    """Values safe to look up anywhere in a text: not noisy, four letters or digits at least."""
    return ~too_noisy(c) & (alnum_count(c) >= 4)


def clean_tag(c: Column) -> Column:
    """A tag of A-Z, 0-9 and underscores; null unless a letter or digit is left."""
    tag = F.upper(F.regexp_replace(c, "[^A-Za-z0-9_]", ""))
    return F.when(tag.rlike("[A-Z0-9]"), tag)


def contains_escaped(c: Column, needle: Column) -> Column:
    """Case-insensitive substring search in which % and _ are ordinary characters."""
    return F.contains(F.lower(c), F.lower(needle))


def spans(text: Column, pattern: str | Column, matches: Column | None = None) -> Column:
    """``array<struct<start,end,value>>`` of all matches, in code points; the pattern must not match the empty string."""
    m = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)) if matches is None else matches
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(m))
    pairs = F.zip_with(gaps, m, lambda g, v: F.struct(F.length(g).alias("g"), v.alias("v")))
    zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int,value:string>>)").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + p["g"]
        end = start + F.length(p["v"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), p["v"].alias("value")))).alias("out"))

    return F.when(F.size(m) > 0, F.aggregate(pairs, zero, step, lambda acc: acc["out"])).otherwise(F.expr("cast(array() as array<struct<start:int,end:int,value:string>>)"))


def exploded(df: DataFrame, column: str, *keep: str, name: str = "e") -> DataFrame:
    """One row per element of an array column of structs, named ``name``, beside the columns of ``keep``.

    A plain explode lets Catalyst filter on the array's size first, below the projection that makes the array: a dear
    expression is then evaluated once for the filter and once more for the rows. The outer one is not rewritten so.
    """
    return df.select(*keep, F.explode_outer(column).alias(name)).where(F.col(name).isNotNull())


def html_to_text(html: Column) -> Column:
    """Visible text of a page: scripts, styles and comments go, blocks end lines, cells are parted by tabs, basic entities decoded."""
    c = F.regexp_replace(html, r"(?is)<(script|style|template|canvas|iframe|video|audio)\b.*?</\1\s*>", "")
    c = F.regexp_replace(c, r"(?s)<!--.*?-->", "")
    c = F.regexp_replace(c, r"(?i)</?(p|div|br|li|ul|ol|h[1-6]|tr|table|section|article|header|footer|nav|main|title)\b[^>]*>", "\n")
    c = F.regexp_replace(c, r"(?i)</?(td|th)\b[^>]*>", "\t")
    c = F.regexp_replace(c, r"<[^>]*>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    c = F.regexp_replace(F.regexp_replace(c, r"[ \t\r]*\n[ \t\r\n]*", "\n"), r"[ \r]+", " ")
    return F.regexp_replace(F.regexp_replace(c, r"\t+", "\t"), r"^\s+|\s+$", "")


def snippet(text: Column, needle: Column, before: int = 60, after: int = 120) -> Column:
    """What surrounds the first hit, with ellipses where the text goes on."""
    flat = collapse(text)
    at = F.instr(F.lower(flat), F.lower(needle))
    start = F.greatest(at - before, F.lit(1))
    stop = F.least(at + after, F.length(flat) + 1)
    return F.when(at > 0, F.concat(F.when(start > 1, "…").otherwise(""), F.substring(flat, start, stop - start), F.when(stop <= F.length(flat), "…").otherwise("")))

"""Post-checks of entities that a model proposed: each is aligned to what the rules find at its place, corrected, or dropped.

Entities and candidates are rows ``doc_id, label, start, end``; candidates come from :func:`detect.detect` over the whole text,
one scan for all labels. Entities of labels without a post-check pass as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import checksums as cs
from ..functions.text import exploded
from . import detect
from .registry import _cut

#: Labels whose entities must meet a candidate of one of these labels.
ALIGNED = {"IBAN": ("IBAN",), "CREDITCARDNUMBER": ("CREDITCARDNUMBER",), "CF": ("CF", "ES_NIF", "FR_NIR", "DE_STEUER_ID", "UK_NINO", "NL_BSN", "CH_AHV", "BE_NATIONAL", "AT_SVNR", "US_SSN")}
#: Characters beside a span that its checks look at.
NEAR = 64
_VAT_CUE = r"(?i)(?:p\.? ?iva|partita iva|vat|ust-?id|tva|nif|btw)[\s.:#no°]*$"
_DATE_CUE = r"(?i)(?:date|data|datum|fecha|nato|nata|born|du|il|am|on)[\s:.]*$"
_MONEY = r"(?i)^[\s]*(?:€|\$|£|eur|usd|gbp|chf)"


def candidates(docs: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """Rule candidates as rows: doc_id, c_label, c_start, c_end, c_valid."""
    # Written before it is unnested: the optimizer would otherwise work on every rule's expression once more.
    found = _cut(detect.detect(docs.select("doc_id", "text"), labels=labels).select("doc_id", "entities"))
    return exploded(found, "entities", "doc_id").select("doc_id", F.col("e.label").alias("c_label"), F.col("e.start").alias("c_start"), F.col("e.end").alias("c_end"), F.col("e.validated").alias("c_valid"))


def aligned(entities: DataFrame, found: DataFrame) -> DataFrame:
    """Entities beside the candidate for their label (``__for``) that they overlap: a validated one first, then the longest, then the first; those that overlap none have null ``c_start``."""
    over = (F.col("label") == F.col("__for")) & (F.col("start") < F.col("c_end")) & (F.col("c_start") < F.col("end"))
    joined = entities.join(found, (entities["doc_id"] == found["doc_id"]) & over, "left").drop(found["doc_id"])
    w = Window.partitionBy("doc_id", "label", "start", "end").orderBy(F.desc_nulls_last("c_valid"), F.desc_nulls_last(F.col("c_end") - F.col("c_start")), F.asc_nulls_last("c_start"))
    return joined.withColumn("__place", F.row_number().over(w)).where("__place = 1").drop("__place")


def _before(text: Column, at: Column) -> Column:
    """The ``NEAR`` characters before a place."""
    low = F.greatest(at - NEAR, F.lit(0))
    return F.substr(text, low + 1, at - low)


def _after(text: Column, at: Column) -> Column:
    """The ``NEAR`` characters from a place on."""
    return F.substr(text, at + 1, F.lit(NEAR))


def _run(text: Column, start: Column, end: Column, unit: str) -> tuple[Column, Column]:
    """Start and end of the run of characters of a class around a span, blanks and marks at its ends left out; ``NEAR`` characters to either side are looked at, more than any number has."""
    left = F.regexp_extract(_before(text, start), rf"({unit}*)$", 1)
    right = F.regexp_extract(_after(text, end), rf"^({unit}*)", 1)
    return start - F.length(F.regexp_replace(left, "^[^0-9+(]+", "")), end + F.length(F.regexp_replace(right, "[^0-9]+$", ""))


def checked(docs: DataFrame, entities: DataFrame) -> DataFrame:
    """``doc_id, label, start, end``: what the post-checks leave of a model's entities.

    IBAN, card and tax code take the place of a candidate or go. A VAT number takes a candidate's place, else the run of
    digits around it, if that has eleven, is no amount, and passes its check digit or stands after a cue. A phone takes
    the run of digits and separators around it, if that has 7 to 15 digits, is no date after a cue, no amount and no postcode.
    Null texts have no entities; repeated rows stay repeated once.
    """
    entities = entities.select("doc_id", "label", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end")).where("start < end").distinct()
    texts = docs.select("doc_id", F.col("text").alias("__text")).where("text IS NOT NULL")
    groups = [(label, name) for label, names in (*ALIGNED.items(), ("PIVA", ("PIVA",))) for name in names]
    # One scan of the texts that have entities serves all labels.
    found = candidates(docs.join(entities.select("doc_id").distinct(), "doc_id", "left_semi"), tuple(sorted({n for _, n in groups})))
    allowed = docs.sparkSession.createDataFrame(groups, "label string, c_label string")
    met = aligned(entities.where(F.col("label").isin(*ALIGNED, "PIVA")), found.join(F.broadcast(allowed), "c_label").withColumnRenamed("label", "__for"))
    cols = ["doc_id", "label", "start", "end"]
    out = entities.where(~F.col("label").isin(*ALIGNED, "PIVA", "TELEPHONENUM")).select(cols)
    hit = met.where((F.col("label") != "PIVA") & F.col("c_start").isNotNull())
    out = out.unionByName(hit.select("doc_id", "label", F.col("c_start").alias("start"), F.col("c_end").alias("end")))
    vat = met.where("label = 'PIVA'").join(texts, "doc_id")
    text = F.col("__text")
    s, e = _run(text, F.col("start"), F.col("end"), "[0-9]")
    vat = vat.withColumn("s", s).withColumn("e", e)
    number = F.regexp_extract(F.substr(text, F.col("s") + 1, F.col("e") - F.col("s")), "([0-9]+)", 1)
    before, after = _before(text, F.col("s")), _after(text, F.col("e"))
    digits_ok = (F.length(number) == 11) & ~after.rlike(_MONEY) & ~before.rlike(r"(?i)(?:€|\$|£|eur|usd|gbp|chf)\s?$") & (cs.luhn(number) | F.right(before, F.lit(40)).rlike(_VAT_CUE))
    lead = F.coalesce(F.length(F.regexp_extract(F.substr(text, F.col("s") + 1, F.col("e") - F.col("s")), "^([^0-9]*)", 1)), F.lit(0))
    vat = vat.withColumn("__ok", F.col("c_start").isNotNull() | digits_ok).where("__ok")
    out = out.unionByName(vat.select("doc_id", "label", F.coalesce("c_start", F.col("s") + lead).cast("int").alias("start"), F.coalesce("c_end", F.col("s") + lead + 11).cast("int").alias("end")))
    phone = entities.where("label = 'TELEPHONENUM'").join(texts, "doc_id")
    s, e = _run(text, F.col("start"), F.col("end"), r"[0-9+()/.\- ]")
    phone = phone.withColumn("s", s).withColumn("e", e)
    whole = F.substr(text, F.col("s") + 1, F.col("e") - F.col("s"))
    n = F.length(F.regexp_replace(whole, "[^0-9]", ""))
    before, after = _before(text, F.col("s")), _after(text, F.col("e"))
    is_date = whole.rlike(r"^[0-9]{1,2}[/.\-][0-9]{1,2}[/.\-][0-9]{2,4}$") & F.right(before, F.lit(24)).rlike(_DATE_CUE)
    is_amount = after.rlike(_MONEY) | before.rlike(r"(?i)(?:€|\$|£|eur|usd|gbp|chf)\s?$")
    kept = phone.where((n >= 7) & (n <= 15) & ~is_date & ~is_amount & ~whole.rlike("^[0-9]{5}$"))
    out = out.unionByName(kept.select("doc_id", "label", F.col("s").cast("int").alias("start"), F.col("e").cast("int").alias("end")))
    return out.distinct()

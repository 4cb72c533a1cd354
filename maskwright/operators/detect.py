"""Detectors of personal and technical identifiers: one rule table, one narrow plan.

A rule is a label, a pattern, a predicate over the match (a check digit, a range, a shape), a
pattern that must or must not stand before the match, and a priority. Each rule becomes one
array expression over the text, guarded by a cheap look for its trigger; all rules share one scan
and nothing is shuffled. Offsets are code points of the untouched text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import checksums as cs
from ..functions.text import spans

ENTITY = "array<struct<label:string,start:int,end:int,value:string,validated:boolean,score:double,priority:int,source:string>>"
ALWAYS = lambda v: F.lit(True)


#: Six digits with one separator at most between two.
SIX_DIGITS = r"[0-9](?:[ .\-/\x{A0}\x{202F}]?[0-9]){5}"


@dataclass(frozen=True)
class Rule:
    """How one kind of value is found.

    needs_cue: accepted only behind ``cue``; keep_unchecked: a failing check is kept, unvalidated, behind ``cue``;
    digits: every match holds what SIX_DIGITS asks for, so all such rules are passed over together.
    """

    label: str
    pattern: str
    check: Callable[[Column], Column] = ALWAYS
    cue: str | None = None
    needs_cue: bool = False
    keep_unchecked: bool = False
    veto: str | None = None
    trigger: str | None = None
    priority: int = 50
    window: int = 48
    digits: bool = False


def _octets(v: Column) -> Column:
    parts = F.split(F.regexp_extract(v, r"^([0-9.]+)", 1), r"\.")
    first = parts[0].cast("int")
    return F.forall(parts, lambda p: p.cast("int") <= 255) & (first > 0) & (first != 127) & (first < 224)


def _real_date(v: Column) -> Column:
    n = F.regexp_replace(v, r"[/.\-]", "-")
    forms = [F.try_to_date(F.regexp_extract(n, r"^(\S+)", 1), f) for f in ("d-M-yyyy", "M-d-yyyy", "yyyy-M-d")]
    return F.coalesce(F.year(F.coalesce(*forms)).between(1900, 2099), F.lit(False))


def _amount(v: Column) -> Column:
    n = F.regexp_extract(v, r"([0-9][0-9.,' ]*)", 1)
    return F.trim(n).rlike(r"^[0-9]{1,3}(([.,' ])[0-9]{3})(\2[0-9]{3})*([.,][0-9]{1,2})?$|^[0-9]+([.,][0-9]{1,2})?$")


def _email(v: Column) -> Column:
    local = F.regexp_extract(v, "^([^@]+)@", 1)
    return (F.octet_length(local) <= 64) & ~local.rlike(r"^\.|\.$|\.\.") & ~F.regexp_extract(v, "@(.*)$", 1).rlike(r"\.\.|^-|-\.|\.-")


def _product_key(v: Column) -> Column:
    bare = F.replace(v, F.lit("-"), F.lit(""))
    return (F.size(F.array_distinct(F.split(bare, ""))) >= 6) & bare.rlike("[0-9]") & bare.rlike("[A-Z]")


def _compact_digits(low: int, high: int) -> Callable[[Column], Column]:
    return lambda v: F.length(cs.digits(v)).between(low, high) & ~cs.digits(v).rlike(r"^(\d)\1*$")


#: Top-level domains that make a bare host a link (fixed values).
TLDS = ("com", "org", "net", "edu", "gov", "int", "info", "biz", "io", "dev", "app", "eu", "it", "de", "fr", "es", "nl", "uk", "ch", "at", "be", "pt", "pl")
#: Full month names by language, month by month (fixed values).
MONTHS = ("january|gennaio|januar|janvier|enero|januari", "february|febbraio|februar|février|febrero|februari", "march|marzo|märz|mars|maart", "april|aprile|avril|abril", "may|maggio|mai|mayo|mei", "june|giugno|juni|juin|junio", "july|luglio|juli|juillet|julio", "august|agosto|août|augustus", "september|settembre|septembre|septiembre", "october|ottobre|oktober|octobre|octubre", "november|novembre|noviembre", "december|dicembre|dezember|décembre|diciembre")
_MONTH = "|".join(MONTHS)

#: What may stand between a cue and its number.
_TAIL = r"(?:[\s:.\-()/#«»\"']|(?<!\w)(?:n[°º]?|nr|no|num|nummer|number|num[ée]ro|n[úu]mero|de|d[’']|du|der|des|die|dem|di|del|della|van|het|the|is|ist|est|es|lautet|luidt|è|are|sont|son|zijn)(?!\w))*$"


def _cue(words: str) -> str:
    return rf"(?iU)(?<!\w)(?:{words})(?!\w)" + _TAIL


def _national(label: str, pattern: str, words: str, check: Callable[[Column], Column] = ALWAYS, priority: int = 63) -> Rule:
    """A national number that counts behind its cue only."""
    return Rule(label, rf"(?i)(?<!\w)(?:{pattern})(?!\w)", check, cue=_cue(words), needs_cue=True, priority=priority, window=128, digits=True)


_S = r"[ .\-\x{A0}\x{202F}]?"
NATIONAL: tuple[Rule, ...] = (
    _national("FR_SPI", rf"[0-9]{{2}}{_S}[0-9]{{2}}(?:{_S}[0-9]{{3}}){{3}}", r"num[ée]ro\s+fiscal(?:\s+de\s+r[ée]f[ée]rence)?|identifiant\s+fiscal|SPI|n[°º]\s*fiscal|num[ée]ro\s+d[’']identification\s+fiscale?"),
    _national("DE_STEUERNUMMER", r"[0-9]{1,3}/[0-9]{3,4}/[0-9]{4,5}|[0-9]{10,13}", r"steuernummer|steuer-?nr|st\.?-?nr"),
    _national("ES_CIF", rf"[ABCDEFGHJNPQRSUVW]{_S}[0-9]{{7}}{_S}[0-9A-J]", r"CIF|C\.I\.F|NIF|N\.I\.F|c[óo]digo\s+de\s+identificaci[óo]n\s+fiscal", cs.spanish_company, 66),
    _national("ES_NSS", r"[0-9]{2}[ /\-]?[0-9]{8}[ /\-]?[0-9]{2}", r"NSS|NAF|(?:n[úu]mero\s+de\s+(?:la\s+)?)?seguridad\s+social|afiliaci[óo]n", cs.spanish_social, 74),
    _national("NL_RSIN", r"[0-9]{9}", r"RSIN|fiscaal\s+nummer", lambda v: cs.mod11(v, [9, 8, 7, 6, 5, 4, 3, 2, -1]), 64),
    _national("NL_KVK", r"[0-9]{8}", r"KvK(?:-?nummer|-?nr)?|K\.v\.K|kamer\s+van\s+koophandel|handelsregister(?:nummer)?|HR-?nummer|inschrijvingsnummer"),
    _national("UK_UTR", r"[0-9]{5} ?[0-9]{5}", r"UTR|unique\s+tax(?:payer)?\s+reference|tax(?:payer)?\s+reference", cs.uk_tax_reference, 66),
    _national("UK_COMPANY", r"[A-Z]{2}[0-9]{6}|[0-9]{8}", r"company(?:\s+registration)?|companies\s+house|registered(?:\s+in\s+(?:england(?:\s+and\s+wales)?|scotland))?|reg(?:istration)?|CRN"),
    _national("BE_ENTERPRISE", r"[01][0-9]{3}\.[0-9]{3}\.[0-9]{3}|[01][0-9]{9}", r"KBO|BCE|ondernemingsnummer|ondernemingsnr|num[ée]ro\s+d[’']entreprise|n[°º]\s*d[’']entreprise|entreprise\s+n[°º]|BTW|TVA", lambda v: cs.tail_mod97(v, 10), 66),
    _national("AT_SVNR", r"[0-9]{4} ?[0-9]{6}", r"SVNR|SV-?Nr|SV-?Nummer|sozialversicherungsnummer|versicherungsnummer|versicherungs-?nr|versichertennummer", cs.austrian_social, 67),
)


def _run(n: int, unit: str = "[0-9]") -> str:
    """So many characters, printed in groups or not."""
    return unit if n == 1 else rf"{unit}(?:[ .\-]?{unit}){{{n - 1}}}"


def _body(v: Column) -> Column:
    """What follows the country of a VAT number."""
    return F.substring(F.upper(F.regexp_replace(v, r"[ .\-]", "")), F.lit(3), F.length(v))


def _vat_fr(v: Column) -> Column:
    b = _body(v)
    key, siren = F.substring(b, 1, 2), F.substring(b, 3, 9)
    return cs.luhn(siren) & F.when(key.rlike("^[0-9]{2}$"), (12 + 3 * (siren.cast("long") % 97)) % 97 == key.cast("long")).otherwise(True)


def _vat_gb(v: Column) -> Column:
    d = F.substring(cs.digits(v), 1, 9)
    total = cs.weighted(F.substring(d, 1, 7), [8, 7, 6, 5, 4, 3, 2]) + F.substring(d, 8, 2).cast("int")
    return _body(v).rlike("^(GD|HA)") | (total % 97 == 0) | ((total + 55) % 97 == 0)


def _vat_pl(v: Column) -> Column:
    return cs.weighted(F.substring(cs.digits(v), 1, 9), [6, 5, 7, 2, 3, 4, 5, 6, 7]) % 11 == cs.last_digit(cs.digits(v))


def _vat_el(v: Column) -> Column:
    return cs.weighted(F.substring(cs.digits(v), 1, 8), [256, 128, 64, 32, 16, 8, 4, 2]) % 11 % 10 == cs.last_digit(cs.digits(v))


#: Countries with a VAT number beside those of RULES: form of the body, check digit or none (fixed values).
VAT: dict[str, tuple[str, Callable[[Column], Column] | None]] = {
    "AT": ("U" + _run(8), lambda v: (96 - cs.doubled(F.substring(cs.digits(v), 1, 7), 1)) % 10 == cs.last_digit(cs.digits(v))),
    "BG": (_run(10) + "|" + _run(9), None),
    "CY": (_run(8) + "[A-Z]", None),
    "CZ": (_run(10) + "|" + _run(9) + "|" + _run(8), None),
    "DK": (_run(8), None),
    "EE": (_run(9), None),
    "EL": (_run(9), _vat_el),
    "GR": (_run(9), _vat_el),
    "ES": ("[A-Z0-9]" + _run(7) + "[A-Z0-9]", lambda v: cs.spanish_letter(_body(v)) | cs.spanish_company(_body(v))),
    "FI": (_run(8), None),
    "FR": ("[A-Z0-9]{2}[ .\\-]?" + _run(9), _vat_fr),
    "HR": (_run(11), None),
    "HU": (_run(8), None),
    "IE": (r"[0-9]{7}[A-W][A-I]?|[0-9][A-Z0-9+*][0-9]{5}[A-W]", None),
    "LT": (_run(12) + "|" + _run(9), None),
    "LU": (_run(8), lambda v: F.substring(cs.digits(v), 1, 6).cast("int") % 89 == F.substring(cs.digits(v), 7, 2).cast("int")),
    "LV": (_run(11), None),
    "MT": (_run(8), None),
    "PL": (_run(10), _vat_pl),
    "RO": (r"[0-9]{4,10}", None),
    "SE": (_run(10) + "[ .\\-]?01", None),
    "SI": (_run(8), None),
    "SK": (_run(10), None),
    "GB": (_run(12) + "|" + _run(9) + "|(?:GD|HA)[0-9]{3}", _vat_gb),
    "CHE": (_run(9), None),
    "NO": (_run(9), None),
}
_VAT_CUE = _cue(r"p(?:artita)?\.?\s?iva|vat(?:\s+(?:id|reg(?:istration)?))?|ust-?id(?:-?nr)?|tva|iva|btw|mwst|nif|uid")
#: With a blank behind the country a number needs its check digit or a cue.
VAT_RULES: tuple[Rule, ...] = (
    *(Rule("PIVA", rf"\b{cc}[ .\-]?(?:{body})(?![0-9A-Za-z])", check, priority=71, digits=cc != "GB") for cc, (body, check) in VAT.items() if check),
    Rule("PIVA", r"\b(?:" + "|".join(rf"{cc}[ .\-]?(?:{body})" for cc, (body, check) in VAT.items() if not check) + ")(?![0-9A-Za-z])", lambda v: ~v.rlike(r"^[A-Z]+\s"), cue=_VAT_CUE, keep_unchecked=True, priority=54),
)


#: A number of country 1 ends after ten digits; a dotted quad or eleven digits in a row behind a number are no part of it.
_NANP = r"1[ \-./]?(?:\([0-9]{3}\)|[0-9]{3})[ \-./]?[0-9]{3}[ \-./]?[0-9]{4}"
_OTHER = r"(?!(?:[0-9]{1,3}\.){3}[0-9]|[0-9]{11})"
RULES: tuple[Rule, ...] = (
    Rule("EMAIL", r"(?U)[\w!#$%&'*+/=?^`{|}~.\-]+@[\p{L}0-9](?:[\p{L}0-9\-]*[\p{L}0-9])?(?:\.[\p{L}0-9](?:[\p{L}0-9\-]*[\p{L}0-9])?)*\.\p{L}{2,24}(?![\p{L}0-9])", _email, trigger="@", priority=90),
    Rule("URL", r"(?i)\b(?:https?|ftp)://[^\s<>\"']*[^\s<>\"'.,;:!?)\]]|\bwww\.[a-z0-9\-]+(?:\.[a-z0-9\-]+)+[^\s<>\"'.,;:!?)\]]*", trigger="://|www\\.", priority=85),
    Rule("URL", r"(?<![\w@.\-/])[a-z0-9][a-z0-9\-]{2,}(?:\.[a-z0-9\-]+)*\.(?:" + "|".join(TLDS) + r")(?:/[^\s<>\"']*)?(?![\w@.\-])", trigger="\\.(?:" + "|".join(TLDS) + ")", priority=40),
    Rule("IBAN", r"(?i)\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b", cs.iban, trigger=r"(?i)[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}", priority=88),
    Rule("CREDITCARDNUMBER", r"(?<![0-9.\-])[0-9](?:[ \-]?[0-9]){12,18}(?![0-9\-])", lambda v: cs.luhn(v) & ~cs.digits(v).rlike("^89[0-9]{17,18}$"), trigger="[0-9]", priority=80, digits=True),
    Rule("CF", r"(?i)\b[A-Z]{6}[0-9LMNPQRSTUV]{2}[ABCDEHLMPRST][0-9LMNPQRSTUV]{2}[A-Z][0-9LMNPQRSTUV]{3}[A-Z]\b", cs.tax_code_it, cue=r"(?i)(?:codice fiscale|c\.?f\.?)\W*$", keep_unchecked=True, priority=86),
    Rule("PIVA", r"(?<![0-9A-Za-z])(?:IT ?)?[0-9]{11}(?![0-9])", cs.luhn, cue=r"(?i)(?:p(?:artita)?\.? ?iva|vat)\W*$", trigger="[0-9]{11}", priority=70, digits=True),
    Rule("PIVA", r"\bDE ?[0-9]{9}\b", lambda v: _de_vat(v), cue=r"(?i)vat\W*$|ust-?id\W*$", priority=72, digits=True),
    Rule("PIVA", r"\bNL ?[0-9]{9}B[0-9]{2}\b", lambda v: cs.mod11(F.substring(cs.digits(v), 1, 9), [9, 8, 7, 6, 5, 4, 3, 2, -1]) | (cs.mod97(F.regexp_replace(v, " ", "")) == 1), priority=72, digits=True),
    Rule("PIVA", r"\bBE ?[01][0-9]{9}\b", lambda v: cs.tail_mod97(v, 10), priority=72, digits=True),
    Rule("PIVA", r"\bPT ?[0-9]{9}\b", lambda v: cs.mod11(v, [9, 8, 7, 6, 5, 4, 3, 2, 1]) | (cs.weighted(F.substring(cs.digits(v), 1, 8), [9, 8, 7, 6, 5, 4, 3, 2]) % 11 < 2) & (F.substring(cs.digits(v), 9, 1) == "0"), priority=72, digits=True),
    Rule("AMOUNT", r"(?i)(?<![\w.,])(?:€|\$|£|eur|usd|gbp|chf)\s?[0-9][0-9.,']*[0-9]|(?<![\w.,])(?:€|\$|£|eur|usd|gbp|chf)\s?[0-9](?![0-9.,])|(?<![\w.,])[0-9](?:[0-9.,']*[0-9])?\s?(?:€|\$|£|(?:euro?|usd|gbp|chf|dollars)\b)", _amount, trigger=r"(?i)[€$£]|eur|usd|gbp|chf|dollars", priority=55),
    Rule("DATE", r"(?<![0-9/.\-])(?:[0-9]{1,2}([/.\-])[0-9]{1,2}\1[0-9]{4}|[0-9]{4}([/.\-])[0-9]{1,2}\2[0-9]{1,2})(?:[ T][0-2]?[0-9]:[0-5][0-9](?::[0-5][0-9])?)?(?![0-9/\-])", _real_date, trigger=r"[0-9]{4}", priority=45, digits=True),
    Rule("DATE", rf"(?iU)\b(?:[0-3]?[0-9](?:st|nd|rd|th|º|\.)?\s+(?:de\s+)?(?:{_MONTH})\s+(?:de\s+)?(?:19|20)[0-9]{{2}}|(?:{_MONTH})\s+[0-3]?[0-9](?:st|nd|rd|th)?,?\s+(?:19|20)[0-9]{{2}})\b", lambda v: F.regexp_extract(v, r"(?<![0-9])([0-9]{1,2})(?![0-9])", 1).cast("int").between(1, 31), trigger=r"(?:19|20)[0-9]{2}", priority=45),
    Rule("TARGA", r"(?<![A-Za-z0-9])[A-HJ-NPR-TV-Z]{2} ?[0-9]{3} ?[A-HJ-NPR-TV-Z]{2}(?![A-Za-z0-9])", priority=42),
    Rule("DOCID", r"(?i)\b(?:prot(?:ocollo)?|r\.?g\.?|rif|ref|case|docket)\.?\s*(?:n(?:o|r|umero)?\.?°?\s*)?[0-9]{1,7}[/\-][0-9]{2,4}\b", priority=44),
    Rule("US_SSN", r"(?<![0-9\-])(?!000|666|9)[0-9]{3}[- ](?!00)[0-9]{2}[- ](?!0000)[0-9]{4}(?![0-9\-])", trigger=r"[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}", priority=65, digits=True),
    Rule("FR_NIR", r"(?<![0-9])[12] ?[0-9]{2} ?(?:0[1-9]|1[0-2]) ?[0-9]{2} ?[0-9]{3} ?[0-9]{3} ?[0-9]{2}(?![0-9])", lambda v: cs.tail_mod97(v, 15), trigger="[12]", priority=78, digits=True),
    Rule("FR_SIRET", r"(?<![0-9])[0-9]{3} ?[0-9]{3} ?[0-9]{3} ?[0-9]{5}(?![0-9])", cs.luhn, cue=r"(?i)siret\W*$", needs_cue=True, trigger="(?i)siret", priority=82, digits=True),
    Rule("FR_SIREN", r"(?<![0-9])[0-9]{3} ?[0-9]{3} ?[0-9]{3}(?![0-9])", cs.luhn, cue=r"(?i)siren\W*$", needs_cue=True, trigger="(?i)siren", priority=62, digits=True),
    Rule("DE_STEUER_ID", r"(?<![0-9])[1-9][0-9] ?[0-9]{3} ?[0-9]{3} ?[0-9]{3}(?![0-9])", cs.steuer_id, cue=r"(?i)(?:steuer-?id|idnr|identifikationsnummer)\W*$", needs_cue=True, trigger="(?i)steuer|id", priority=76, digits=True),
    Rule("ES_NIF", r"(?i)(?<![A-Z0-9])[XYZ0-9][0-9]{7}-?[A-Z](?![A-Z0-9])", cs.spanish_letter, priority=66, digits=True),
    Rule("NL_BSN", r"(?<![0-9])[0-9]{9}(?![0-9])", lambda v: cs.mod11(v, [9, 8, 7, 6, 5, 4, 3, 2, -1]), cue=r"(?i)(?:bsn|burgerservicenummer)\W*$", needs_cue=True, trigger="(?i)bsn|burger", priority=64, digits=True),
    Rule("UK_NINO", r"\b(?!BG|GB|NK|KN|TN|NT|ZZ)[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z] ?[0-9]{2} ?[0-9]{2} ?[0-9]{2} ?[A-D]\b", trigger=r"[A-Z]{2} ?[0-9]{2} ?[0-9]{2}", priority=66),
    Rule("CH_AHV", r"\b756\.?[0-9]{4}\.?[0-9]{4}\.?[0-9]{2}\b", lambda v: cs.weighted(cs.digits(v), [1, 3] * 6 + [1]) % 10 == 0, priority=84, digits=True),
    Rule("BE_NATIONAL", r"(?<![0-9])[0-9]{2}\.?[0-1][0-9]\.?[0-3][0-9]-?[0-9]{3}\.?[0-9]{2}(?![0-9])", lambda v: cs.tail_mod97(v, 11), cue=r"(?i)(?:rijksregister|registre national|nrn)\W*(?:nummer)?\W*$", needs_cue=True, trigger="(?i)rijks|registre|nrn", priority=74, digits=True),
    Rule("TELEPHONENUM", rf"(?<![\w+])(?:\+|00)(?:{_NANP}|[1-9][0-9]{{0,2}}[ \-./]?(?:\([0-9]{{1,4}}\)[ \-./]?)?[0-9]+(?:[ \-./]{_OTHER}[0-9]+)*)(?![0-9])", _compact_digits(7, 15), trigger="\\+|00", priority=60),
    Rule("TELEPHONENUM", r"(?<![\w+])(?:\([0-9]{2,5}\)[ \-]?)?[0-9]{2,5}(?:[ \-./][0-9]{2,5}){1,4}(?![\w\-])", _compact_digits(7, 12), cue=r"(?i)(?:tel(?:efono?|ephone|\.)?|phone|mobile|cell(?:ulare)?|fax|call|t[ée]l)\W*$", needs_cue=True, trigger="(?i)tel|phone|mobile|cell|fax|call|tél", priority=58),
    Rule("IP_ADDRESS", r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?:/(?:3[0-2]|[12]?[0-9]))?(?![0-9.]*[0-9])", _octets, veto=r"(?i)(?:version|ver|rel(?:ease)?|build|v)\.?\s*$", trigger="[0-9]\\.[0-9]", priority=83, window=24),
    Rule("IP_ADDRESS", r"(?i)(?<![0-9a-f:])(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}(?![0-9a-f:])|(?<![0-9a-f:])(?:[0-9a-f]{1,4}:){1,6}(?::[0-9a-f]{1,4}){1,6}(?![0-9a-f:])", lambda v: F.size(F.split(v, ":")) <= 8, trigger=":", priority=83),
    Rule("MAC_ADDRESS", r"(?i)(?<![0-9a-f:\-])[0-9a-f]{2}([:\-])(?:[0-9a-f]{2}\1){4}[0-9a-f]{2}(?![0-9a-f:\-])|(?<![0-9a-f.])[0-9a-f]{4}\.[0-9a-f]{4}\.[0-9a-f]{4}(?![0-9a-f.])", lambda v: ~F.regexp_replace(v, "[^0-9A-Fa-f]", "").rlike("^(0+|[fF]+)$"), trigger=r"(?i)[0-9a-f]{2}[:\-][0-9a-f]{2}[:\-]|[0-9a-f]{4}\.[0-9a-f]{4}\.", priority=87),
    Rule("PASSWORD_HASH", r"\$(?:2[aby]\$[0-9]{2}\$[./A-Za-z0-9]{53}|[156]\$(?:rounds=[0-9]+\$)?[^\s$]{1,16}\$[./A-Za-z0-9]{22,86}|argon2(?:id?|d)\$[^\s]+)|\{S?SHA(?:256|512)?\}[A-Za-z0-9+/=]{28,}", trigger="\\$|\\{S", priority=89),
    Rule("PASSWORD_HASH", r"(?i)\b(?:[0-9a-f]{128}|[0-9a-f]{64}|[0-9a-f]{40}|[0-9a-f]{32})\b", cue=r"(?i)(?:hash|md5|sha-?[0-9]*|ntlm|digest)\W*$", needs_cue=True, priority=75),
    Rule("TOTP_SECRET", r"otpauth://[^\s\"'<>]+", trigger="otpauth", priority=95),
    Rule("TOTP_SECRET", r"\b[A-Z2-7]{4}(?: ?[A-Z2-7]{4}){3,15}\b", cue=r"(?i)(?:2fa|totp|otp|authenticator|two-factor)[^\n]{0,60}$", needs_cue=True, trigger="(?i)2fa|otp|authenticator|two-factor", priority=77, window=100),
    Rule("SSH_KEY", r"\b(?:ssh-(?:rsa|ed25519|dss)|ecdsa-sha2-nistp(?:256|384|521)) AAAA[A-Za-z0-9+/=]{40,}", trigger="AAAA", priority=94),
    Rule("SSH_FINGERPRINT", r"\bSHA256:[A-Za-z0-9+/]{43}=?|\bMD5:(?:[0-9a-f]{2}:){15}[0-9a-f]{2}\b", trigger="SHA256:|MD5:", priority=94),
    Rule("CERTIFICATE", r"-----BEGIN (?:CERTIFICATE|PUBLIC KEY)-----[A-Za-z0-9+/=\s]+-----END (?:CERTIFICATE|PUBLIC KEY)-----", trigger="-----BEGIN", priority=96),
    Rule("SECRET", r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END (?:[A-Z]+ )?PRIVATE KEY-----", trigger="-----BEGIN", priority=97),
    Rule("WINDOWS_SID", r"\bS-1-(?:5-21|12-1)(?:-[0-9]{1,10}){3,5}\b", trigger="S-1-", priority=92),
    Rule("CRYPTO_WALLET", r"\b(?:bc1[ac-hj-np-z02-9]{11,71}|0x[0-9a-fA-F]{40})\b", trigger="bc1|0x", priority=79),
    Rule("CRYPTO_WALLET", r"(?<![A-Za-z0-9])[1-9A-HJ-NP-Za-km-z]{25,35}(?![A-Za-z0-9])", cs.base58_check, priority=79),
    Rule("PRODUCT_KEY", r"\b[A-Z0-9]{5}(?:-[A-Z0-9]{5}){4}\b", _product_key, priority=81),
    Rule("HOSTNAME", r"\b(?:DESKTOP|LAPTOP|WIN)-[A-Z0-9]{7,11}\b|(?<=\\\\)[A-Za-z][A-Za-z0-9\-]{2,14}(?=\\)|\b[a-z][a-z0-9\-]+(?:\.[a-z0-9\-]+)*\.(?:local|lan|internal|corp|intra)\b", trigger=r"DESKTOP|LAPTOP|WIN-|\\\\|\.(?:local|lan|internal|corp|intra)", priority=48),
    Rule("HOSTNAME", r"[A-Za-z][A-Za-z0-9\-]*[0-9A-Za-z]", lambda v: F.length(v) >= 3, cue=r"(?i)\b(?:hostname|computer name|host)\s*[:=]\s*$", needs_cue=True, trigger="(?i)host|computer name", priority=47),
    Rule("DEVICE_ID", r"(?<![0-9])[0-9]{15}(?![0-9])", cs.luhn, cue=r"(?i)imei\W*$", needs_cue=True, trigger="(?i)imei", priority=91, digits=True),
    Rule("DEVICE_ID", r"(?<![0-9])89[0-9]{17,18}(?![0-9])", priority=82, digits=True),
    Rule("DEVICE_ID", r"[A-Z0-9][A-Z0-9\-]{5,23}", lambda v: v.rlike("[0-9]"), cue=r"(?i)(?:serial(?: number| no\.?)?|s/n|service tag|asset tag|device id)\s*[:=#]?\s*$", needs_cue=True, trigger="(?i)serial|s/n|tag|device id", priority=57),
    Rule("PASSWORD", r"[^\s\"',;]{4,128}", cue=r"(?i)\b(?:password|passwd|pwd|passphrase|passwort|mot de passe|contraseña)\s*[:=]\s*[\"']?$", needs_cue=True, trigger="(?i)passw|pwd|passphrase|mot de passe|contrase", priority=93),
    Rule("SECRET", r"[A-Za-z0-9_\-./+=]{8,}", cue=r"(?i)\b(?:api[_ \-]?key|secret(?:[_ ]key)?|access[_ ]token|token|bearer)\s*[:=]?\s*[\"']?$", needs_cue=True, trigger="(?i)key|secret|token|bearer", check=lambda v: v.rlike("[0-9]"), priority=92),
    *NATIONAL,
    *VAT_RULES,
    Rule("USERNAME", r"[A-Za-z0-9._\-]{3,32}", cue=r"(?i)\b(?:user(?:name)?|login|benutzer(?:name)?|utente)\s*[:=]\s*[\"']?$", needs_cue=True, trigger="(?i)user|login|benutzer|utente", priority=46),
)
#: Labels whose spans are exact: compared with case, never trimmed or widened.
EXACT = ("EMAIL", "URL", "IP_ADDRESS", "MAC_ADDRESS", "PASSWORD_HASH", "TOTP_SECRET", "SSH_KEY", "SSH_FINGERPRINT", "CERTIFICATE", "WINDOWS_SID", "CRYPTO_WALLET", "PRODUCT_KEY", "PASSWORD", "SECRET", "USERNAME")


def _de_vat(v: Column) -> Column:
    d = cs.digits(v)

    def step(a: Column, x: Column) -> Column:
        s = (x.cast("int") + a) % 10
        return (F.when(s == 0, 10).otherwise(s) * 2) % 11

    check = F.aggregate(F.slice(F.filter(F.split(d, ""), lambda x: x != ""), 1, 8), F.lit(10), step)
    return (11 - check) % 10 == F.substring(d, 9, 1).cast("int")


def rule_entities(text: Column, rule: Rule) -> Column:
    """Entities of one rule in a text."""
    empty = F.expr(f"cast(array() as {ENTITY})")

    def behind(pattern: str) -> Callable[[Column], Column]:
        return lambda s: F.substring(text, F.greatest(s["start"] - rule.window, F.lit(0)) + 1, F.least(s["start"], F.lit(rule.window))).rlike(pattern)

    def entity(s: Column) -> Column:
        ok = rule.check(s["value"])
        return F.struct(F.lit(rule.label).alias("label"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), F.coalesce(ok, F.lit(False)).alias("validated"), F.when(ok, 1.0).otherwise(0.5).alias("score"), F.lit(rule.priority).alias("priority"), F.lit("regex").alias("source"))

    def keep(s: Column) -> Column:
        ok = F.coalesce(rule.check(s["value"]), F.lit(False))
        if rule.keep_unchecked and rule.cue:
            ok = ok | behind(rule.cue)(s)
        if rule.needs_cue:
            ok = ok & behind(rule.cue)(s)
        if rule.veto:
            ok = ok & ~behind(rule.veto)(s)
        return ok

    found = F.transform(F.filter(spans(text, rule.pattern), keep), entity)
    return F.when(text.rlike(rule.trigger or rule.pattern), found).otherwise(empty)


#: Labels whose values, once anchored, are tagged wherever they recur in the same text; in any case of letters for the first two.
PROPAGATED = ("HOSTNAME", "DEVICE_ID", "PASSWORD", "SECRET", "USERNAME")


def propagated(text: Column, entities: Column) -> Column:
    """Further occurrences in a text of values already found in it, of six letters or digits at least (of a full host name its first label too): lowest priority, not validated."""
    anchors = F.filter(entities, lambda e: e["label"].isin(*PROPAGATED))
    named = lambda label, value: F.struct(label.alias("label"), value.alias("value"))
    values = F.transform(anchors, lambda e: named(e["label"], e["value"]))
    hosts = F.transform(F.filter(anchors, lambda e: (e["label"] == "HOSTNAME") & F.contains(e["value"], F.lit("."))), lambda e: named(e["label"], F.substring_index(e["value"], ".", 1)))
    keep = lambda v: (F.length(F.regexp_replace(v["value"], r"[^\p{L}\p{N}]", "")) >= 6) | (v["label"] == "HOSTNAME") & v["value"].rlike("^[A-Za-z][A-Za-z0-9.\\-]*[0-9]") & (F.length(v["value"]) >= 4)
    distinct = F.array_distinct(F.filter(F.concat(values, hosts), keep))

    def again(v: Column) -> Column:
        literal = F.concat(F.lit("\\Q"), F.replace(v["value"], F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
        pattern = F.concat(F.when(v["label"].isin(*PROPAGATED[:2]), F.lit("(?iU)")).otherwise(F.lit("(?U)")), F.lit(r"(?<![\w\-])"), literal, F.lit(r"(?![\w\-]|\.\w)"))
        entity = lambda s: F.struct(v["label"].alias("label"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), F.lit(False).alias("validated"), F.lit(0.5).alias("score"), F.lit(1).alias("priority"), F.lit("propagated").alias("source"))
        fresh = lambda s: ~F.exists(anchors, lambda e: (e["start"] < s["end"]) & (s["start"] < e["end"]))
        return F.transform(F.filter(spans(text, pattern), fresh), entity)

    return F.array_distinct(F.flatten(F.transform(distinct, again)))


def one_scan(text: Column, rules: tuple[Rule, ...]) -> Column:
    """Entities of rules that are alternatives of one scan from left to right, in this order: what a match covers, checked or not, no other rule sees.

    For rules whose check looks at the value alone; a match belongs to the first rule that takes all of it.
    """
    if any(r.cue or r.veto for r in rules):
        raise ValueError("rules with a cue or a veto have no place in one scan")
    every = "|".join(f"(?:{r.pattern})" for r in rules)

    def entity(s: Column) -> Column:
        whole = [s["value"].rlike(rf"\A(?:{r.pattern})\z") for r in rules]
        pick = lambda of: F.coalesce(*[F.when(w, of(r)) for w, r in zip(whole, rules, strict=True)])
        ok = F.coalesce(pick(lambda r: r.check(s["value"])), F.lit(False))
        return F.struct(pick(lambda r: F.lit(r.label)).alias("label"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), ok.alias("validated"), F.lit(1.0).alias("score"), pick(lambda r: F.lit(r.priority)).alias("priority"), F.lit("regex").alias("source"))

    found = F.filter(F.transform(spans(text, every), entity), lambda e: e["validated"])
    return F.when(text.rlike(every), found).otherwise(F.expr(f"cast(array() as {ENTITY})"))


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", labels: tuple[str, ...] | None = None, rules: tuple[Rule, ...] = RULES, scan: bool = False) -> DataFrame:
    """``docs`` with a column ``entities``: candidates of all rules, unresolved; a null text has none.

    With ``scan`` the rules are alternatives of a single scan, see :func:`one_scan`.
    """
    rules = [r for r in rules if labels is None or r.label in labels]
    text = F.coalesce(F.col(text_col), F.lit(""))
    if scan:
        return docs.withColumn("entities", one_scan(text, tuple(rules)))
    of = lambda some: [rule_entities(text, r) for r in some]
    numeric, others = of(r for r in rules if r.digits), of(r for r in rules if not r.digits)
    if numeric:  # one look for all of them
        others.append(F.when(text.rlike(SIX_DIGITS), F.flatten(F.array(*numeric))).otherwise(F.expr(f"cast(array() as {ENTITY})")))
    out = docs.withColumn("entities", F.flatten(F.array(*others)))
    if not any(r.label in PROPAGATED for r in rules):
        return out
    anchored = F.exists("entities", lambda e: e["label"].isin(*PROPAGATED))
    return out.withColumn("entities", F.when(anchored, F.concat("entities", propagated(text, F.col("entities")))).otherwise(F.col("entities")))


def custom_terms(docs: DataFrame, terms: list[tuple[str, str]], text_col: str = "text") -> DataFrame:
    """Add entities of user terms (term, tag) to ``entities``: whole words, any case, flexible white space, always validated."""
    import re

    text, found = F.coalesce(F.col(text_col), F.lit("")), [F.col("entities")]
    for term, tag in terms:
        body = r"\s+".join(re.escape(t) for t in term.split())
        rule = Rule(tag, rf"(?iU)(?<![\w]){body}(?![\w])", priority=99)
        found.append(F.transform(rule_entities(text, rule), lambda e: e.withField("source", F.lit("custom"))))
    return docs.withColumn("entities", F.flatten(F.array(*found)))

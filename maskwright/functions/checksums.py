"""Check digits as Catalyst expressions over strings of digits and letters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _chars(c: Column) -> Column:
    """Single characters of a string."""
    return F.filter(F.split(c, ""), lambda x: x != "")


def weighted(c: Column, weights: list[int]) -> Column:
    """Sum of digits times weights."""
    return F.aggregate(F.zip_with(_chars(c), F.array(*map(F.lit, weights)), lambda x, w: F.coalesce(x.cast("int"), F.lit(0)) * F.coalesce(w, F.lit(0))), F.lit(0), lambda a, x: a + x)


def luhn(c: Column) -> Column:
    """Luhn sum over the digits, not all equal."""
    d = digits(c)
    return F.call_function("luhn_check", d) & ~d.rlike(r"^(\d)\1*$")


def mod97(c: Column) -> Column:
    """ISO 7064 mod 97 of an alphanumeric string, letters as 10 to 35."""
    return F.aggregate(_chars(F.upper(c)), F.lit(0), lambda a, x: F.when(x.rlike("[0-9]"), (a * 10 + x.cast("int")) % 97).otherwise((a * 100 + F.ascii(x) - 55) % 97))


#: Length of an IBAN by country (fixed values, ISO 13616 registry).
IBAN_LENGTHS = {"AD": 24, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27}


def iban(c: Column) -> Column:
    """Right length for the country and remainder 1."""
    v = F.upper(F.regexp_replace(c, r"[^A-Za-z0-9]", ""))
    lengths = F.create_map(*[F.lit(x) for kv in IBAN_LENGTHS.items() for x in kv])
    return F.coalesce((F.length(v) == F.try_element_at(lengths, F.substring(v, 1, 2))) & (mod97(F.concat(F.substring(v, 5, 40), F.substring(v, 1, 4))) == 1), F.lit(False))


#: Values of characters in odd places of an Italian tax code (fixed values, public standard), for 0-9 and A-Z.
CF_ODD = [1, 0, 5, 7, 9, 13, 15, 17, 19, 21, 1, 0, 5, 7, 9, 13, 15, 17, 19, 21, 2, 4, 18, 20, 11, 3, 6, 8, 12, 14, 16, 10, 22, 25, 24, 23]


def tax_code_it(c: Column) -> Column:
    """Control letter of a 16-character Italian tax code."""
    v = F.upper(c)
    odd = F.create_map(*[F.lit(x) for kv in zip(DIGITS, CF_ODD, strict=True) for x in kv])
    even = F.create_map(*[F.lit(x) for k, ch in enumerate(DIGITS) for x in (ch, k if k < 10 else k - 10)])
    total = F.aggregate(F.transform(F.slice(_chars(v), 1, 15), lambda x, i: F.coalesce(F.when(i % 2 == 0, F.try_element_at(odd, x)).otherwise(F.try_element_at(even, x)), F.lit(0))), F.lit(0), lambda a, x: a + x)
    return (F.length(v) == 16) & (F.ascii(F.substring(v, 16, 1)) - 65 == total % 26)


def mod11(c: Column, weights: list[int], modulus: int = 11) -> Column:
    """Weighted sum is a multiple of the modulus."""
    return weighted(digits(c), weights) % modulus == 0


def tail_mod97(c: Column, size: int, tail: int = 2) -> Column:
    """The last digits are 97 minus the rest modulo 97."""
    d = digits(c)
    return F.substring(d, size - tail + 1, tail).cast("int") == 97 - F.substring(d, 1, size - tail).cast("long") % 97


def spanish_letter(c: Column) -> Column:
    """Control letter of a Spanish DNI or NIE."""
    v = F.translate(F.upper(c), "XYZ", "012")
    number = F.regexp_extract(v, "^([0-9]{8})", 1)
    return F.when(number != "", F.substring(F.lit("TRWAGMYFPDXBNJZSQVHLCKE"), (number.cast("int") % 23) + 1, F.lit(1)) == F.upper(F.substring(c, -1, 1))).otherwise(False)


def steuer_id(c: Column) -> Column:
    """ISO 7064 mod 11,10 over eleven digits."""
    d = digits(c)

    def step(a: Column, x: Column) -> Column:
        s = (x.cast("int") + a) % 10
        return (F.when(s == 0, 10).otherwise(s) * 2) % 11

    check = F.aggregate(F.slice(_chars(d), 1, 10), F.lit(10), step)
    return (F.length(d) == 11) & ((11 - check) % 10 == F.substring(d, 11, 1).cast("int"))


def iso7064(d: Column) -> Column:
    """ISO 7064 mod 11,10: the last digit is right for those before it."""

    def step(a: Column, x: Column) -> Column:
        s = (x.cast("int") + a) % 10
        return (F.when(s == 0, 10).otherwise(s) * 2) % 11

    check = F.aggregate(F.slice(_chars(d), 1, F.length(d) - 1), F.lit(10), step)
    return (11 - check) % 10 == F.substring(d, -1, 1).cast("int")


def doubled(d: Column, first: int) -> Column:
    """Sum of digits with every second one doubled and cast out by nine, from place ``first`` (0 or 1) on."""
    return F.aggregate(F.transform(_chars(d), lambda x, i: F.when(i % 2 == first, x.cast("int") * 2 - F.when(x.cast("int") > 4, 9).otherwise(0)).otherwise(x.cast("int"))), F.lit(0), lambda a, x: a + x)


def last_digit(d: Column) -> Column:
    return F.substring(d, -1, 1).cast("int")


def spanish_company(c: Column) -> Column:
    """Control character of a Spanish CIF: a digit or a letter, as the first letter demands."""
    v = F.upper(F.regexp_replace(c, "[^A-Za-z0-9]", ""))
    k = (10 - doubled(F.substring(v, 2, 7), 0) % 10) % 10
    letter, digit, head, tail = F.substring(F.lit("JABCDEFGHI"), k + 1, F.lit(1)), k.cast("string"), F.substring(v, 1, 1), F.substring(v, 9, 1)
    return v.rlike("^[A-Z][0-9]{7}[0-9A-Z]$") & F.when(head.rlike("[KPQRSNW]"), tail == letter).when(head.rlike("[ABEH]"), tail == digit).otherwise((tail == letter) | (tail == digit))


def spanish_social(c: Column) -> Column:
    """Control digits of a Spanish social security number."""
    d = digits(c)
    area, number = F.substring(d, 1, 2).cast("long"), F.substring(d, 3, 8).cast("long")
    return (F.length(d) == 12) & area.between(1, 56) & ((F.when(number < 10_000_000, area * 10_000_000).otherwise(area * 100_000_000) + number) % 97 == F.substring(d, 11, 2).cast("long"))


def uk_tax_reference(c: Column) -> Column:
    """First digit of a UK unique taxpayer reference."""
    d = digits(c)
    return F.substring(F.lit("21987654321"), weighted(F.substring(d, 2, 9), [6, 7, 8, 9, 10, 5, 4, 3, 2]) % 11 + 1, F.lit(1)) == F.substring(d, 1, 1)


def austrian_social(c: Column) -> Column:
    """Fourth digit of an Austrian social security number."""
    d = digits(c)
    return ~d.startswith("0") & (weighted(d, [3, 7, 9, 0, 5, 8, 4, 2, 1, 6]) % 11 == F.substring(d, 4, 1).cast("int"))


BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"


def base58_check(c: Column) -> Column:
    """25 bytes in base 58 whose last four are the start of the double SHA-256 of the others; a number of nine 24-bit limbs, lowest first."""

    def add(limbs: Column, x: Column) -> Column:
        begin = F.struct((F.instr(F.lit(BASE58), x) - 1).cast("long").alias("carry"), F.expr("cast(array() as array<bigint>)").alias("out"))
        step = lambda acc, n: F.struct(F.floor((n * 58 + acc["carry"]) / (1 << 24)).cast("long").alias("carry"), F.array_append(acc["out"], (n * 58 + acc["carry"]) % (1 << 24)).alias("out"))
        return F.aggregate(limbs, begin, step, lambda acc: acc["out"])

    limbs = F.aggregate(_chars(c), F.array_repeat(F.lit(0).cast("long"), 9), add)
    number = F.array_join(F.transform(F.reverse(limbs), lambda n: F.lpad(F.lower(F.hex(n)), 6, "0")), "")
    ones = F.length(F.regexp_extract(c, "^(1*)", 1))
    size = F.ceil(F.length(F.regexp_replace(number, "^0+", "")) / 2)
    raw = F.substring(number, 5, 50)
    digest = F.sha2(F.unhex(F.sha2(F.unhex(F.substring(raw, 1, 42)), 256)), 256)
    return (ones + size == 25) & (F.substring(digest, 1, 8) == F.substring(raw, 43, 8))

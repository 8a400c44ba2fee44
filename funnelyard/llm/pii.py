"""Personal data: format-preserving Feistel pseudonyms, in DataFrame functions only.

Numbers, dates and addresses that pass their format's own check (Luhn sum, octet range, calendar, digit
counts) are replaced by a keyed permutation within the same format, so a pseudonym is valid again, equal
values have equal pseudonyms in every document, and the key holder can undo it. What fails its check
stays as it is. All work is within a row; there is no table of known values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from funnelyard.llm.common import drop_clashing

ROUNDS = 10  # as in the published FF1 mode

#: Formats in the order in which they are tried at a place.
FORMATS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}",
    "secret": r"(?i:api[_-]?key|token|secret|password)\s{0,3}[=:]\s{0,3}[\"'][A-Za-z0-9_+/=.-]{16,128}[\"']",
    "ipv4": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9A-Za-z/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9])",
    "card": r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "phone": r"(?<![0-9A-Za-z+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9](?:[ .-]?[0-9]){4,13}(?![0-9A-Za-z])",
    "nanp": r"(?<![0-9A-Za-z(+])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])",
}
ANY = "|".join(f"(?:{p})" for p in FORMATS.values())

#: A Gregorian cycle of 400 years, whose days the date permutation maps onto themselves: 146097 = 189 * 773.
CYCLE_START, CYCLE = "1800-01-01", (189, 773)
DATE_FORMATS = (("yyyy-MM-dd", r"^[0-9]{4}-"), ("yyyy/MM/dd", r"^[0-9]{4}/"), ("MM/dd/yyyy", r"^[0-9]{2}/"), ("dd.MM.yyyy", r"^[0-9]{2}\."))
#: A national number has an area and an exchange of 200 to 999 and a line of 0000 to 9999: 800 * 800 * 10000 = 80000 * 80000.
NATIONAL = (80_000, 80_000)

_DIGITS, _LOWER, _UPPER, _HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"


def _round(key: Column, kind: str, i: Column, half: Column) -> Column:
    """The round function: hex digits of a keyed digest of the other half."""
    return F.sha2(F.concat_ws("|", key, F.lit(kind), i.cast("string"), half), 512)


def permute_number(x: Column, sizes: tuple[int, int], key: Column, kind: str) -> Column:
    """A keyed permutation of 0 ... a * b - 1: an alternating Feistel network on the quotient and the rest by b."""
    a, b = sizes

    def step(s: Column, i: Column) -> Column:
        def moved(own: Column, other: Column, size: int) -> Column:
            digest = _round(key, kind, i, other.cast("string"))
            return F.pmod(own + F.conv(F.substring(digest, 1, 14), 16, 10).cast("long"), F.lit(size))
        even = F.struct(moved(s["l"], s["r"], a).alias("l"), s["r"].alias("r"))
        odd = F.struct(s["l"].alias("l"), moved(s["r"], s["l"], b).alias("r"))
        return F.when(i % 2 == 0, even).otherwise(odd)

    start = F.struct(F.floor(x / F.lit(b)).cast("long").alias("l"), F.pmod(x, F.lit(b)).cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: s["l"] * b + s["r"])


def _shifted(c: Column, by: Column, alphabets: tuple[str, ...]) -> Column:
    out = c
    for alphabet in reversed(alphabets):
        at = F.instr(F.lit(alphabet), c)
        out = F.when((at > 0) & (c != ""), F.substr(F.lit(alphabet), F.pmod(at - 1 + by, F.lit(len(alphabet))) + 1, F.lit(1))).otherwise(out)
    return out


def permute_chars(s: Column, alphabets: tuple[str, ...], key: Column, kind: str) -> Column:
    """A keyed permutation of the strings (128 characters at most) that have each alphabet's characters where `s` has.

    An alternating Feistel network on the two halves; characters of no alphabet stay.
    """
    def step(state: Column, i: Column) -> Column:
        def moved(own: Column, other: Column) -> Column:
            digest = _round(key, kind, i, other)
            shift = lambda c, k: _shifted(c, F.conv(F.substr(digest, 2 * k + 1, F.lit(2)), 16, 10).cast("int"), alphabets)
            return F.array_join(F.transform(F.split(own, ""), shift), "")
        even = F.struct(moved(state["l"], state["r"]).alias("l"), state["r"].alias("r"))
        odd = F.struct(state["l"].alias("l"), moved(state["r"], state["l"]).alias("r"))
        return F.when(i % 2 == 0, even).otherwise(odd)

    half = F.floor(F.length(s) / 2).cast("int")
    start = F.struct(F.substr(s, F.lit(1), half).alias("l"), F.substr(s, half + 1, F.length(s)).alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda x: F.concat(x["l"], x["r"]))


def _only_digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def refill(layout: Column, digits: Column) -> Column:
    """`layout` with its digits replaced, in order, by `digits`."""
    start = F.struct(F.lit("").alias("s"), F.lit(1).alias("k"))

    def step(state: Column, c: Column) -> Column:
        digit = c.rlike("^[0-9]$")
        return F.struct(F.concat(state["s"], F.when(digit, F.substr(digits, state["k"], F.lit(1))).otherwise(c)).alias("s"),
                        (state["k"] + digit.cast("int")).alias("k"))
    return F.aggregate(F.split(layout, ""), start, step, lambda s: s["s"])


def luhn_sum(digits: Column) -> Column:
    """Sum of the digits, every second one from the right doubled; the last is not."""
    def worth(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(i % 2 == 0, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))
    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), worth), F.lit(0), lambda total, d: total + d)


def _card(m: Column, key: Column) -> Column:
    digits = _only_digits(m)
    body = permute_chars(F.substr(digits, F.lit(1), F.length(digits) - 1), (_DIGITS,), key, "card")
    check = F.pmod(F.lit(10) - F.pmod(luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)), F.lit(10))
    return F.when(luhn_sum(digits) % 10 == 0, refill(m, F.concat(body, check.cast("string"))))


def _ipv4(m: Column, key: Column) -> Column:
    parts = F.transform(F.split(m, r"\."), lambda p: p.cast("long"))
    valid = F.forall(F.split(m, r"\."), lambda p: (p.cast("int") <= 255) & ~p.rlike("^0[0-9]"))
    x = F.aggregate(parts, F.lit(0).cast("long"), lambda t, p: t * 256 + p)
    y = permute_number(x, (1 << 16, 1 << 16), key, "ipv4")
    octets = [F.pmod(F.shiftright(y, s), F.lit(256)).cast("string") for s in (24, 16, 8, 0)]
    return F.when(valid, F.concat_ws(".", *octets))


def _date(m: Column, key: Column) -> Column:
    out = F.lit(None).cast("string")
    size = CYCLE[0] * CYCLE[1]
    for form, shape in DATE_FORMATS:
        day = F.datediff(F.to_date(F.try_to_timestamp(m, F.lit(form))), F.lit(CYCLE_START).cast("date"))
        moved = F.date_add(F.lit(CYCLE_START).cast("date"), permute_number(day.cast("long"), CYCLE, key, "date").cast("int"))
        out = F.when(m.rlike(shape), F.when((day >= 0) & (day < size), F.date_format(moved, form))).otherwise(out)
    return out


def _nanp(m: Column, key: Column) -> Column:
    digits = _only_digits(m)
    area, exchange, line = (F.substring(digits, at, n).cast("long") for at, n in ((1, 3), (4, 3), (7, 4)))
    y = permute_number(((area - 200) * 800 + (exchange - 200)) * 10_000 + line, NATIONAL, key, "nanp")
    first = F.floor(y / 10_000).cast("long")
    new = F.concat((F.floor(first / 800).cast("long") + 200).cast("string"), (F.pmod(first, F.lit(800)) + 200).cast("string"),
                   F.lpad(F.pmod(y, F.lit(10_000)).cast("string"), 4, "0"))
    return F.when((area >= 200) & (exchange >= 200), refill(m, new))


def _phone(m: Column, key: Column) -> Column:
    country = F.regexp_extract(m, r"^\+(?:[0-9]{1,3}(?=[ .(-])|[0-9]{2})", 0)
    layout = F.substr(m, F.length(country) + 1, F.length(m))
    digits = _only_digits(layout)
    enough = F.length(_only_digits(m)).between(8, 15)
    return F.when(enough, F.concat(country, refill(layout, permute_chars(digits, (_DIGITS,), key, "phone"))))


def _ssn(m: Column, key: Column) -> Column:
    valid = ~m.rlike("^(000|666|9[0-9][0-9])") & ~m.rlike("-00-") & ~m.rlike("-0000$")
    a, g, s = (F.substring(m, at, n).cast("long") for at, n in ((1, 3), (5, 2), (8, 4)))
    area = a - 1 - (a > 666).cast("long")  # 898 areas, 99 groups, 9999 serials
    y = permute_number((area * 99 + g - 1) * 9999 + s - 1, (898 * 99, 9999), key, "ssn")
    first = F.floor(y / 9999).cast("long")
    new = F.floor(first / 99).cast("long") + 1
    new = new + (new >= 666).cast("long")
    return F.when(valid, F.concat_ws("-", F.lpad(new.cast("string"), 3, "0"), F.lpad((F.pmod(first, F.lit(99)) + 1).cast("string"), 2, "0"),
                                     F.lpad((F.pmod(y, F.lit(9999)) + 1).cast("string"), 4, "0")))


def _email(m: Column, key: Column) -> Column:
    local = F.regexp_extract(m, "^([^@]*)@", 1)
    return F.concat(permute_chars(local, (_DIGITS, _LOWER, _UPPER), key, "email"), F.regexp_extract(m, "@.*$", 0))


def _secret(m: Column, key: Column) -> Column:
    head = F.regexp_extract(m, "^([^\"']*[\"'])", 1)
    value = F.substr(m, F.length(head) + 1, F.length(m) - F.length(head) - 1)
    hexed = permute_chars(value, (_HEX,), key, "secret-hex")
    new = F.when(value.rlike("^[0-9a-f]+$"), hexed).otherwise(permute_chars(value, (_DIGITS, _LOWER, _UPPER), key, "secret"))
    return F.concat(head, new, F.substr(m, F.length(m), F.lit(1)))


_MAKERS = {"email": _email, "secret": _secret, "ipv4": _ipv4, "date": _date, "card": _card, "ssn": _ssn, "phone": _phone, "nanp": _nanp}


def pseudonym(match: Column, key: Column) -> Column:
    """struct(kind, found, new) of a matched string; kind and new are null where it fails its format's check."""
    kind = F.lit(None).cast("string")
    new = F.lit(None).cast("string")
    for name, pattern in reversed(FORMATS.items()):
        fits = match.rlike(f"^(?:{pattern})$")
        kind, new = F.when(fits, F.lit(name)).otherwise(kind), F.when(fits, _MAKERS[name](match, key)).otherwise(new)
    return F.struct(F.when(new.isNotNull(), kind).alias("kind"), match.alias("found"), new.alias("new"))


def pseudonymise(df: DataFrame, text_col: str, key: str | Column, out: str = "clean_text") -> DataFrame:
    """Adds `out`, the text with its personal data replaced, and `replaced`, array<struct<kind, new>> in text order.

    All columns of `df` stay; columns named like the new ones are replaced. A null text gives a null and
    no replacements, an empty text itself. Equal values give equal pseudonyms under one key. No shuffle.
    """
    key = F.lit(key) if isinstance(key, str) else key
    df = drop_clashing(df, [c for c in (out, "replaced") if c != text_col])
    text = F.col(f"`{text_col}`")
    found = F.when(text.rlike("[0-9@]|[\"'][A-Za-z_+/=.-]{16}"), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))
    found = F.coalesce(found, F.expr("cast(array() as array<string>)"))
    given = df.withColumn("__found", F.transform(found, lambda m: pseudonym(m, key)))
    values = F.concat(F.transform("__found", lambda p: F.coalesce(p["new"], p["found"])), F.array(F.lit("")))
    woven = F.array_join(F.flatten(F.zip_with(F.split(text, ANY, -1), values, lambda gap, value: F.array(gap, value))), "")
    hits = F.filter("__found", lambda p: p["new"].isNotNull())
    return (given.withColumn(out, F.when(F.size(hits) > 0, woven).otherwise(text))
            .withColumn("replaced", F.transform(hits, lambda p: F.struct(p["kind"].alias("kind"), p["new"].alias("new"))))
            .drop("__found"))

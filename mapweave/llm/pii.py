"""Format-preserving pseudonyms for personal data, with DataFrame functions alone.

Validated numbers and dates go through a keyed Feistel network over their own domain: card numbers keep length, grouping and
a right check digit, dates stay dates, addresses stay addresses. It is a permutation, so equal values stay equal across
documents and different ones stay different. E-mail addresses get keyed names. All is native: patterns mark the values in
the text, the text is split at the marks, and only the marked pieces are computed on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Marks that no text holds after escaping: ESC before and after a value.
ESC, STAND_IN = "\u0001", "\u0002"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}",
    "date": r"(?<![0-9./-])(?:(?:19|20)[0-9]{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])|(?:0[1-9]|[12][0-9]|3[01])[./](?:0[1-9]|1[0-2])[./](?:19|20)[0-9]{2})(?![0-9./-]?[0-9])",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?![0-9]|\.[0-9])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+1[ .-]?)?(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[.-])[2-9][0-9]{2}[.-][0-9]{4}(?![0-9])|(?<![0-9A-Za-z])\+[1-9][0-9]{0,2}(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])",
    "ssn": r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9A-Za-z.-])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z]|[ -][0-9])",
}
EVERY = "|".join(f"(?:{p})" for p in PATTERNS.values())
FIRST_DAY, DAYS = "1900-01-01", 73049  # to the end of 2099


def keyed(value: Column, secret: str, bits: int = 48) -> Column:
    """A keyed number below 2**bits from SHA-256."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(secret + "|"), value), 256), 1, bits // 4), 16, 10).cast("long")


def feistel(number: Column, left: int, right: int, secret: str, tweak: Column) -> Column:
    """A keyed permutation of 0 .. left * right - 1: halves of the two sizes change in turn by a keyed function of the other."""
    state = F.struct(F.floor(number / F.lit(right)).cast("long").alias("a"), (number % F.lit(right)).cast("long").alias("b"))

    def turn(s: Column, r: Column) -> Column:
        even = r % 2 == 0
        other = F.when(even, s["b"]).otherwise(s["a"])
        f = keyed(F.concat_ws("|", tweak, r, other), secret)
        return F.struct(F.when(even, (s["a"] + f) % F.lit(left)).otherwise(s["a"]).alias("a"), F.when(even, s["b"]).otherwise((s["b"] + f) % F.lit(right)).alias("b"))
    done = F.aggregate(F.array(*[F.lit(i) for i in range(ROUNDS)]), state, turn)
    return done["a"] * F.lit(right) + done["b"]


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn_sum(digits: Column, doubled_last: bool) -> Column:
    """Sum of the digits, every second one doubled, counted from the right; doubled_last: the rightmost is doubled."""
    d = F.reverse(digits)
    places = F.sequence(F.lit(1), F.length(d))

    def add(total: Column, i: Column) -> Column:
        x = F.substring(d, i, F.lit(1)).cast("int")
        twice = F.when(x > 4, x * 2 - 9).otherwise(x * 2)
        return total + F.when((i % 2 == 1) == F.lit(doubled_last), twice).otherwise(x)
    return F.aggregate(places, F.lit(0), add)


def permuted_digits(digits: Column, secret: str, tweak: str) -> Column:
    """A keyed permutation of the digit strings of each length up to 18; the length is part of the tweak."""
    n = F.length(digits)
    out = None
    # halves of equal size, one digit apart for odd lengths; each length has a branch of constants
    for size in range(18, 1, -1):
        branch = F.lpad(feistel(digits.cast("long"), 10 ** (size // 2), 10 ** (size - size // 2), secret, F.lit(f"{tweak}{size}")).cast("string"), size, "0")
        out = F.when(n == size, branch) if out is None else out.when(n == size, branch)
    return out.otherwise(digits)


def refilled(value: Column, digits: Column) -> Column:
    """value with its digits replaced one by one; other characters stay."""
    chars = F.split(value, "")
    state = F.struct(F.lit("").alias("t"), F.lit(1).alias("i"))

    def put(s: Column, c: Column) -> Column:
        number = c.rlike("^[0-9]$")
        return F.struct(F.concat(s["t"], F.when(number, F.substring(digits, s["i"], F.lit(1))).otherwise(c)).alias("t"), (s["i"] + number.cast("int")).alias("i"))
    return F.aggregate(chars, state, put)["t"]


def card(value: Column, secret: str) -> Column:
    d = digits_of(value)
    body = permuted_digits(F.substring(d, F.lit(1), F.length(d) - 1), secret, "card")
    check = (F.lit(10) - luhn_sum(body, True) % 10) % 10
    return refilled(value, F.concat(body, check.cast("string")))


def valid_card(value: Column) -> Column:
    d = digits_of(value)
    return (luhn_sum(d, False) % 10 == 0) & ~d.rlike("^(.)\\1*$")


def phone(value: Column, secret: str) -> Column:
    """The last seven digits change; country and area stay, and the exchange keeps a first digit from 2 to 9."""
    d = digits_of(value)
    last = F.substring(d, -7, 7)
    national = F.substring(last, 1, 1).cast("int") >= 2
    n = F.when(national, last.cast("long") - 2_000_000).otherwise(last.cast("long"))
    new = F.when(national, feistel(n, 800, 10_000, secret, F.lit("phone8")) + 2_000_000).otherwise(feistel(n, 200, 10_000, secret, F.lit("phone2")))
    return refilled(value, F.concat(F.substring(d, F.lit(1), F.length(d) - 7), F.lpad(new.cast("string"), 7, "0")))


def ip(value: Column, secret: str) -> Column:
    part = F.split(value, "\\.")
    n = F.aggregate(part, F.lit(0).cast("long"), lambda t, x: t * 256 + x.cast("long"))
    new = feistel(n, 65536, 65536, secret, F.lit("ip"))
    return F.concat_ws(".", *[(F.floor(new / F.lit(256**i)) % 256).cast("long").cast("string") for i in (3, 2, 1, 0)])


def day(value: Column) -> Column:
    iso = value.rlike("^[0-9]{4}-")
    text = F.when(iso, value).otherwise(F.concat_ws("-", F.substring(value, 7, 4), F.substring(value, 4, 2), F.substring(value, 1, 2)))
    return F.datediff(F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date"), F.lit(FIRST_DAY).cast("date"))


def date(value: Column, secret: str) -> Column:
    """The day permuted among those from 1900 to 2099: a network over 271 * 270 numbers, walked on until it is below DAYS."""
    walk = F.aggregate(F.array(*[F.lit(i) for i in range(12)]), feistel(day(value).cast("long"), 271, 270, secret, F.lit("date")),
                       lambda x, _: F.when(x >= DAYS, feistel(x, 271, 270, secret, F.lit("date"))).otherwise(x))
    new = F.date_add(F.lit(FIRST_DAY).cast("date"), walk.cast("int"))
    mark = F.substring(value, 3, 1)
    return F.when(value.rlike("^[0-9]{4}-"), F.date_format(new, "yyyy-MM-dd")).otherwise(F.concat(F.date_format(new, "dd"), mark, F.date_format(new, "MM"), F.substring(value, 6, 1), F.date_format(new, "yyyy")))


def ssn(value: Column, secret: str) -> Column:
    """Area 001 to 665, group 01 to 99 and serial 0001 to 9999 change within these ranges; areas from 667 among themselves."""
    area, rest = F.substring(value, 1, 3).cast("long"), (F.substring(value, 5, 2).cast("long") - 1) * 9999 + F.substring(value, 8, 4).cast("long") - 1
    low = area < 666
    a = F.when(low, area - 1).otherwise(area - 667)
    new = F.when(low, feistel(a * (99 * 9999) + rest, 665, 99 * 9999, secret, F.lit("ssn"))).otherwise(feistel(a * (99 * 9999) + rest, 233, 99 * 9999, secret, F.lit("ssn9")))
    r = new % F.lit(99 * 9999)
    return F.concat_ws("-", F.lpad((F.floor(new / F.lit(99 * 9999)) + F.when(low, 1).otherwise(667)).cast("string"), 3, "0"), F.lpad((F.floor(r / F.lit(9999)) + 1).cast("string"), 2, "0"), F.lpad((r % 9999 + 1).cast("string"), 4, "0"))


def email(value: Column, secret: str) -> Column:
    """A keyed name at a reserved domain; case does not matter."""
    return F.concat(F.lit("u"), F.substring(F.sha2(F.concat(F.lit(secret + "|email|"), F.lower(value)), 256), 1, 20), F.lit("@example.invalid"))


KINDS: dict[str, Callable[[Column, str], Column]] = {"email": email, "date": date, "ip": ip, "ssn": ssn, "phone": phone, "card": card}


def kind_of(value: Column) -> Column:
    """The kind of a marked value that its checks confirm; null for one that they refute."""
    full = {k: value.rlike(f"^(?:{p})$") for k, p in PATTERNS.items()}
    return (F.when(full["email"], "email").when(full["date"] & day(value).isNotNull(), "date").when(full["ip"], "ip").when(full["ssn"], "ssn")
            .when(full["phone"], "phone").when(full["card"] & valid_card(value), "card"))


def pseudonymised(docs: DataFrame, secret: str, text: str = "text", length: str = "n_chars", counts: bool = False) -> DataFrame:
    """docs with personal data in text replaced by pseudonyms; other columns stay, the column of lengths is brought up to date.

    counts adds n_email, n_date, n_ip, n_ssn, n_phone, n_card (long). A null text stays null with counts 0, an empty one stays empty.
    Card numbers need a right check digit, dates must exist, numbers in an address must be below 256 and have no leading zeros. Rows are handled one by
    one, so null and repeated keys are kept as they are.
    """
    value = F.col(f"`{text}`").cast("string")
    safe = F.replace(F.replace(value, F.lit(STAND_IN), F.lit(STAND_IN + "b")), F.lit(ESC), F.lit(STAND_IN + "a"))
    # every value holds a digit or an at sign
    pieces = F.split(F.when(value.rlike("[0-9@]"), F.regexp_replace(safe, f"({EVERY})", f"{ESC}$1{ESC}")).otherwise(safe), ESC)
    taken = {c.lower() for c in docs.columns}
    held, made = (next(n for n in (f"_{kind}{i}" for i in range(len(taken) + 1)) if n not in taken) for kind in ("pieces", "new"))
    marked = docs.withColumn(held, pieces)
    # every second piece is a value; texts without one have a single piece
    named = F.transform(held, lambda x, i: F.struct(x.alias("x"), F.when(i % 2 == 1, kind_of(x)).alias("k")))
    marked = marked.withColumn(held, F.when(F.size(held) > 1, named))

    def new(p: Column) -> Column:
        out = None
        for k, f in KINDS.items():
            out = F.when(p["k"] == F.lit(k), f(p["x"], secret)) if out is None else out.when(p["k"] == F.lit(k), f(p["x"], secret))
        return out.otherwise(F.replace(F.replace(p["x"], F.lit(STAND_IN + "a"), F.lit(ESC)), F.lit(STAND_IN + "b"), F.lit(STAND_IN)))
    fresh = F.when(F.col(held).isNull(), value).otherwise(F.array_join(F.transform(held, new), ""))
    out = marked.withColumn(made, fresh)
    cols = [F.col(made).alias(text) if n == text else F.when(F.col(held).isNull(), F.col(f"`{n}`")).otherwise(F.length(made)).cast(docs.schema[n].dataType).alias(n) if n == length else F.col(f"`{n}`") for n in docs.columns]

    def tally(k: str) -> Column:
        found = F.size(F.filter(held, lambda p: p["k"] == F.lit(k)))
        return F.when(F.col(held).isNull(), F.lit(0)).otherwise(found).cast("long").alias(f"n_{k}")
    return out.select(*cols, *[tally(k) for k in KINDS if counts])

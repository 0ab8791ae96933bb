"""Personal data: format-preserving pseudonyms by a keyed Feistel network, in SQL functions only."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
#: What may be personal data, in the order in which alternatives are tried.
EMAIL = r"(?<![\w.%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?![\w-])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
DATE_YMD = r"(?<![0-9])[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}(?![0-9])"
DATE_DMY = r"(?<![0-9])[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{4}(?![0-9])"
IP = r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
CARD = r"(?<![0-9-])[0-9](?:[ -]?[0-9]){12,18}(?![0-9-])"
PHONE = r"(?<![0-9+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}(?![0-9])|(?<![0-9])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])|(?<![0-9-])[0-9]{3}-[0-9]{3}-[0-9]{4}(?![0-9-])"
ANY = "|".join((EMAIL, IBAN, DATE_YMD, DATE_DMY, IP, SSN, PHONE, CARD))
#: Cheap test that rules most texts out: an at-sign, or two digits with something like a group.
HINT = r"@|[0-9][0-9 ()./-]{4,}[0-9]|[A-Z]{2}[0-9]{2}"

#: Places of a round's key stream that one digest gives, five hexadecimal digits each.
PLACES = 25
#: Steps after which a date that is none has surely become one again (3 % of the places are none).
WALK = 24


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _hmac(key: str, text: Column, bits: int) -> Column:
    """HMAC over SHA-256 or SHA-512, in hexadecimal digits."""
    block, name = (64, "sha256") if bits == 256 else (128, "sha512")
    raw = key.encode()
    raw = (hashlib.new(name, raw).digest() if len(raw) > block else raw).ljust(block, b"\0")
    inner, outer = (F.lit(bytearray(x ^ pad for x in raw)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(text, "UTF-8")), bits))), bits)


def _f(key: str, kind: str, turn: Column, half: Column, size: Column) -> Column:
    """The round function: 60 bits of a keyed digest."""
    text = F.concat_ws("|", F.lit(kind), size.cast("string"), turn.cast("string"), half.cast("string"))
    return F.conv(F.substring(_hmac(key, text, 256), 1, 15), 16, 10).cast("long")


def feistel(number: Column, a: Column, b: Column, key: str, kind: str) -> Column:
    """A keyed permutation of 0 .. a*b-1: an unbalanced Feistel network over (x div b, x mod b)."""
    size = a * b
    start = F.struct(F.call_function("div", number, b).alias("l"), F.pmod(number, b).alias("r"))

    def turn(s: Column, k: Column) -> Column:
        left, right = s["l"], s["r"]
        even = F.struct(F.pmod(left + F.pmod(_f(key, kind, k, right, size), a), a).alias("l"), right.alias("r"))
        odd = F.struct(left.alias("l"), F.pmod(right + F.pmod(_f(key, kind, k, left, size), b), b).alias("r"))
        return F.when(k % 2 == 0, even).otherwise(odd)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda s: s["l"] * b + s["r"])


def _power(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, "0").cast("long")


def digits_permuted(digits: Column, key: str, kind: str) -> Column:
    """A string of 1 to 18 digits, permuted among the strings of its length."""
    n = F.length(digits)
    half = F.floor(n / 2).cast("int")
    return F.lpad(feistel(digits.cast("long"), _power(n - half), _power(half), key, kind).cast("string"), n, "0")


def places_permuted(values: Column, sizes: Column, key: str, kind: Column) -> Column:
    """An array of small numbers, each below its size, permuted among all such arrays, of any length.

    An alternating Feistel network: in each round every place of one half moves by a key stream
    that the whole other half gives.
    """
    n = F.size(values)
    half = F.ceil(n / 2).cast("int")

    def turn(s: Column, k: Column) -> Column:
        first = k % 2 == 0
        other = F.array_join(F.transform(F.filter(s, lambda v, i: (i < half) != first), lambda v: v.cast("string")), ",")
        text = F.concat_ws("|", kind, n.cast("string"), k.cast("string"), other)
        blocks = F.sequence(F.lit(0), F.floor(F.greatest(half - 1, F.lit(0)) / PLACES).cast("int"))
        stream = F.transform(blocks, lambda b: _hmac(key, F.concat_ws("|", text, b.cast("string")), 512))

        def moved(st: Column) -> Column:
            def place(v: Column, i: Column) -> Column:
                j = F.when(i < half, i).otherwise(i - half)
                step = F.conv(F.substr(F.get(st, F.floor(j / PLACES).cast("int")), F.pmod(j, F.lit(PLACES)) * 5 + 1, F.lit(5)), 16, 10).cast("int")
                return F.when((i < half) == first, F.pmod(v + step, F.get(sizes, i))).otherwise(v)

            return F.transform(s, place)

        return let(stream, moved)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), values, turn)


def long_digits_permuted(digits: Column, key: str, kind: str) -> Column:
    """A string of digits of any length, permuted among the strings of its length."""
    values = F.transform(F.split(digits, ""), lambda c: c.try_cast("int"))
    long = let(values, lambda v: F.array_join(places_permuted(v, F.transform(v, lambda x: F.lit(10)), key, F.lit(kind)), ""))
    return F.when(F.length(digits) <= 18, digits_permuted(digits, key, kind)).otherwise(long)


def _poured(pattern: Column, digits: Column) -> Column:
    """``pattern`` with its digits replaced by ``digits``, one for one."""
    marks = F.split(pattern, "")
    step = lambda s, c: F.when(c.rlike("^[0-9]$"), F.struct(F.concat(s["out"], F.substr(digits, s["at"], F.lit(1))).alias("out"), (s["at"] + 1).alias("at"))).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["at"].alias("at")))
    return F.aggregate(marks, F.struct(F.lit("").alias("out"), F.lit(1).alias("at")), step, lambda s: s["out"])


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a string of digits, its last one undoubled."""
    back = F.split(F.reverse(digits), "")
    each = F.transform(back, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.element_at(F.array(*[F.lit(v) for v in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), c.cast("int") + 1)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x)


def _iban_mod(text: Column) -> Column:
    """An IBAN without spaces as a number modulo 97, letters as 10 to 35."""
    moved = F.split(F.concat(F.substring(text, 5, 40), F.substring(text, 1, 4)), "")
    value = lambda c: F.when(c.rlike("^[0-9]$"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(moved, F.lit(0), lambda a, c: F.pmod(a * F.when(c.rlike("^[0-9]$"), 10).otherwise(100) + value(c), F.lit(97)))


def _iban(m: Column, key: str) -> Column:
    """The digits after the check digits permuted, new check digits; letters and spaces stay."""

    def renewed(plain: Column) -> Column:
        body = F.substring(plain, 5, 40)
        new_body = F.when(body.rlike("[0-9]"), _poured(body, long_digits_permuted(_digits(body), key, "iban"))).otherwise(body)
        check = lambda new: F.lpad((98 - _iban_mod(F.concat(F.substring(plain, 1, 2), F.lit("00"), new))).cast("string"), 2, "0")
        return let(new_body, lambda new: F.concat(F.substring(plain, 1, 2), check(new), new))

    def spaced(new: Column) -> Column:
        start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
        step = lambda s, c: F.when(c == " ", F.struct(F.concat(s["out"], c).alias("out"), s["at"].alias("at"))).otherwise(F.struct(F.concat(s["out"], F.substr(new, s["at"], F.lit(1))).alias("out"), (s["at"] + 1).alias("at")))
        return F.aggregate(F.split(m, ""), start, step, lambda s: s["out"])

    return let(F.regexp_replace(m, " ", ""), lambda plain: F.when(_iban_mod(plain) == 1, let(renewed(plain), spaced)).otherwise(m))


def _card(m: Column, key: str) -> Column:
    """The digits before the last one permuted, the last one as far from the check digit as it was.

    So a number that passes the Luhn sum still does, and one that fails it, but looks like a card
    number, still fails.
    """
    check = lambda body: F.pmod(10 - F.pmod(luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)), F.lit(10))

    def renewed(d: Column) -> Column:
        body = F.substr(d, F.lit(1), F.length(d) - 1)
        off = F.pmod(F.right(d, F.lit(1)).cast("int") - check(body), F.lit(10))
        return let(long_digits_permuted(body, key, "card"), lambda new: F.concat(new, F.pmod(check(new) + off, F.lit(10)).cast("string")))

    return _poured(m, let(_digits(m), renewed))


def _ip(m: Column, key: str) -> Column:
    parts = F.transform(F.split(m, r"\."), lambda x: x.cast("int"))
    whole = F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a * 256 + x)
    new = feistel(whole, F.lit(65536).cast("long"), F.lit(65536).cast("long"), key, "ip")
    octets = lambda n: F.concat_ws(".", *[F.pmod(F.call_function("shiftright", n, F.lit(k)), F.lit(256).cast("long")).cast("string") for k in (24, 16, 8, 0)])
    return F.when(F.forall(parts, lambda x: x < 256), let(new, octets)).otherwise(m)


def date_permuted(date: Column, key: str) -> Column:
    """A date, permuted among those of its 200 years (1900 to 2099 and so on).

    Days 1 to 12 and days above 12 are permuted by themselves, so that a day and month in the order
    of the United States stay readable in that order only. The network permutes year, month and one
    of 12 or 19 days; where the month has no such day it is applied again until there is one.
    """
    y, d = F.year(date).cast("long"), F.dayofmonth(date).cast("long")
    edge = (y < 100) | (y >= 9900)  # years stay four digits
    start = F.when(y < 100, F.lit(0).cast("long")).otherwise(y - F.pmod(y - 100, F.lit(200).cast("long")))
    years = F.when(edge, F.lit(100)).otherwise(F.lit(200)).cast("long")
    low = F.when(d <= 12, F.lit(1)).otherwise(F.lit(13)).cast("long")
    wide = F.when(d <= 12, F.lit(12)).otherwise(F.lit(19)).cast("long")
    own = F.struct(start.alias("start"), years.alias("years"), low.alias("low"), wide.alias("wide"), (((y - start) * 12 + F.month(date) - 1) * wide + d - low).alias("at"))
    div = lambda a, b: F.call_function("div", a, b)

    def walked(o: Column) -> Column:
        again = lambda at: feistel(at, o["years"], o["wide"] * 12, key, "date")
        first = lambda at: F.make_date((o["start"] + div(at, o["wide"] * 12)).cast("int"), F.pmod(div(at, o["wide"]), F.lit(12).cast("long")).cast("int") + 1, F.lit(1))
        day = lambda at: F.pmod(at, o["wide"]) + o["low"]
        step = lambda at, k: F.when(day(at) <= F.dayofmonth(F.last_day(first(at))), at).otherwise(again(at))
        end = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), again(o["at"]), step)
        return let(end, lambda at: F.date_add(first(at), (day(at) - 1).cast("int")))

    return let(own, walked)


def _date(m: Column, year_first: bool, key: str) -> Column:
    """A valid date in its own order and width: day before month unless only the other way is one."""
    sep = F.regexp_extract(m, r"[0-9]+([-/.])", 1)
    p = F.split(m, r"[-/.]")
    y, a, b = (p[0], p[1], p[2]) if year_first else (p[2], p[1], p[0])
    iso = lambda mm, dd: F.try_to_date(F.concat_ws("-", y, F.lpad(mm, 2, "0"), F.lpad(dd, 2, "0")), "yyyy-MM-dd")
    width = lambda part, own: F.when(F.length(own) == 2, F.lpad(part, 2, "0")).otherwise(part)

    def renewed(date: Column, first: Callable[[Column], Column], second: Callable[[Column], Column]) -> Column:
        def text(new: Column) -> Column:
            year = F.lpad(F.year(new).cast("string"), 4, "0")
            one, two = width(first(new).cast("string"), a), width(second(new).cast("string"), b)
            parts = (year, one, two) if year_first else (two, one, year)
            return F.concat(parts[0], sep, parts[1], sep, parts[2])

        return let(date_permuted(date, key), text)

    def either(usual: Column) -> Column:
        return F.when(usual.isNotNull(), renewed(usual, F.month, F.dayofmonth)).otherwise(let(iso(b, a), lambda other: F.when(other.isNotNull(), renewed(other, F.dayofmonth, F.month)).otherwise(m)))

    return let(iso(a, b), either)


def _email(m: Column, key: str) -> Column:
    """The letters and digits of the name permuted among the names of its form; the domain stays.

    Names are read without regard to case, and the new one has capitals where the old one has them.
    """
    local, domain = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    plain = lambda c: c.rlike("^[A-Za-z0-9]$")
    digit = lambda c: c.rlike("^[0-9]$")
    own = F.filter(F.split(local, ""), plain)

    def renewed(c: Column) -> Column:
        values = F.transform(c, lambda x: F.when(digit(x), F.ascii(x) - 48).otherwise(F.ascii(F.lower(x)) - 97))
        new = places_permuted(values, F.transform(c, lambda x: F.when(digit(x), F.lit(10)).otherwise(F.lit(26))), key, F.concat(F.lit("email|"), F.lower(domain)))
        return F.zip_with(c, new, lambda x, v: F.char(F.when(digit(x), v + 48).when(x.rlike("^[A-Z]$"), v + 65).otherwise(v + 97)))

    def poured(new: Column) -> Column:
        start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
        step = lambda s, c: F.struct(F.concat(s["out"], F.when(plain(c), F.get(new, s["at"])).otherwise(c)).alias("out"), (s["at"] + plain(c).cast("int")).alias("at"))
        return F.aggregate(F.split(local, ""), start, step, lambda s: s["out"])

    return F.concat(let(let(own, renewed), poured), F.lit("@"), domain)


def pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of one match of ``ANY``; what fails its check (a date, an address) stays."""
    whole = lambda rx: m.rlike("^(?:" + rx + ")$")
    return (
        F.when(F.contains(m, F.lit("@")), _email(m, key))
        .when(m.rlike("^[A-Z]"), _iban(m, key))
        .when(whole(r"[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}"), _date(m, True, key))
        .when(whole(r"[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{4}"), _date(m, False, key))
        .when(whole(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"), _ip(m, key))
        .when(whole(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"), _poured(m, digits_permuted(_digits(m), key, "ssn")))
        .when(m.rlike(r"^[+(]") | whole(r"[0-9]{3}-[0-9]{3}-[0-9]{4}"), _poured(m, long_digits_permuted(_digits(m), key, "phone")))
        .otherwise(_card(m, key))
    )


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``text_col`` pseudonymised and ``n_private`` added: the values replaced in it.

    Values are found by pattern and checked: card numbers by the Luhn sum, IBANs modulo 97, dates
    by the calendar, addresses by their range. Each is permuted among the values of its format by
    a Feistel network under ``key``, with a new check digit, and its separators stay. So equal
    values (whatever their separators) have equal pseudonyms in all documents, different ones
    different. The texts between are untouched. The key is part of the plan, which Spark shows in
    event logs: who reads those can undo the pseudonyms.

    A null text stays null with n_private 0; texts without private data are returned as they are;
    repeated rows are treated alike; an empty table gives no rows; all other columns are kept, but
    an own n_private is replaced. Everything happens within a row: nothing is shuffled.
    """
    text = F.col(text_col)
    maybe = text.rlike(HINT)
    docs = docs.withColumn("__pii_found", F.when(maybe, F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>")))
    docs = docs.withColumn("__pii_new", F.transform("__pii_found", lambda m: pseudonym(m, key)))
    between = F.split(text, ANY, -1)
    joined = F.array_join(F.zip_with(between, "__pii_new", lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    changed = F.size(F.filter(F.zip_with("__pii_found", "__pii_new", lambda a, b: a != b), lambda x: x))
    out = F.when(F.size("__pii_new") > 0, joined).otherwise(text)
    return docs.withColumns({"n_private": F.when(text.isNull(), 0).otherwise(changed), text_col: out}).drop("__pii_found", "__pii_new")

"""Format-preserving pseudonyms for personal data by a keyed Feistel network.

Found in whole texts by one pattern, then validated, then permuted within their own format:

* card: 13 to 19 digits (single spaces or hyphens between) that pass the Luhn check; all digits
  but the last are permuted, the last becomes the new check digit
* phone: a bracketed or hyphenated number of 10 digits, or an international one of 8 to 15 digits
  with any grouping; the digits after the country code are permuted
* ssn: ddd-dd-dddd with possible group numbers, permuted among the possible ones
* ip: four octets up to 255, permuted as one 32-bit number
* date: a real calendar day from 1900-01-01 on within DAYS days, in ISO, slashed or dotted form,
  permuted among those of these days whose month and day have as many digits: so a date keeps its
  width however it is written, and is the same date in every form
* email and secret (a quoted or assigned key, token, secret or password of 16 hexadecimal or
  more characters): no number to permute; replaced by a keyed digest in the same alphabet

The permutation is a bijection of the format's domain under the key, so equal values become
equal pseudonyms in every document and different values stay different. Separators, quotes and
everything around a value stay as they are. Values that fail validation are left alone. Where a
domain has gaps the permutation is applied until a value of the domain comes out (cycle walking).

The key comes into the plan as a scalar subquery, so neither plans nor event logs show it.

Only built-in functions run: matches are taken and put back within the row, without a shuffle.

Defined results: a null text stays null with no findings; texts without findings come back
unchanged; repeated rows get the same pseudonyms; the key must not be empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyglass.llm.common import opened, sealed, table

#: The pseudonym key; a deployment sets its own in this session setting.
KEY_SETTING = "spark.tallyglass.pseudonym.key"
DEMO_KEY = "set-your-own-key"
ROUNDS = 8
#: Days from 1900-01-01 (to 2099-12-15): 199 * 367, so that both halves have a modulus.
DAYS, DAY_HALVES = 199 * 367, (199, 367)

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
#: No text without one of these holds a value.
HINT = r"[0-9@]|(?i:key|token|secret|password)"
SECRET = r"(?i:(?:api[_-]?key|key|token|secret|password))[\x22']?\s{0,3}[:=]\s{0,3}[\x22']?[0-9A-Fa-f]{16,}"
IP = r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}"
DATE = r"\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.]\d{4}"
SSN = r"\d{3}-\d{2}-\d{4}"
PHONE = r"\+\d{1,3}[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}|\+\d{1,3}(?:[ .-]\(?\d{1,5}\)?){2,5}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4}"
CARD = r"\d(?:[ -]?\d){12,18}"
_EDGE, _END = r"(?<![\p{L}\p{N}_.@+-])", r"(?![\p{L}\p{N}_@]|[.-][\p{L}\p{N}])"
PATTERN = f"{SECRET}(?![0-9A-Za-z])|{_EDGE}(?:{EMAIL}|{PHONE}{_END}|{SSN}{_END}|{DATE}{_END}|{IP}{_END}|{CARD}{_END})"
PATTERN = PATTERN.replace(f"{PHONE}{_END}", f"(?:{PHONE}){_END}").replace(f"{DATE}{_END}", f"(?:{DATE}){_END}")

KINDS = ("card", "phone", "ssn", "ip", "date", "email", "secret")


def _keyed(key: Column, kind: str, turn: Column, half: Column) -> Column:
    """A keyed number of 60 bits."""
    digest = F.sha2(F.concat_ws("|", key, F.lit(kind), turn.cast("string"), half.cast("string")), 256)
    return F.conv(F.left(digest, F.lit(15)), 16, 10).cast("long")


def _div(a: Column, b: Column) -> Column:
    """Integer quotient of non-negative numbers up to 18 digits."""
    return ((a - F.pmod(a, b)).cast("decimal(20,0)") / b.cast("decimal(20,0)")).cast("long")


def feistel(value: Column, low: Column, high: Column, key: Column, kind: str) -> Column:
    """Permutes 0 .. high*low-1: halves of modulus ``high`` and ``low`` shift each other in turn."""
    high_half = _div(value, low)

    def turn(s: Column, r: Column) -> Column:
        a = F.when(r % 2 == 0, F.pmod(s["a"] + F.pmod(_keyed(key, kind, r, s["b"]), high), high)).otherwise(s["a"])
        b = F.when(r % 2 == 1, F.pmod(s["b"] + F.pmod(_keyed(key, kind, r, s["a"]), low), low)).otherwise(s["b"])
        return F.struct(a.alias("a"), b.alias("b"))

    start = F.struct(high_half.alias("a"), F.pmod(value, low).alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda s: s["a"] * low + s["b"])


def _ten_to(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, F.lit("0")).cast("long")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"[^0-9]", "")


def permuted_digits(digits: Column, key: Column, kind: str) -> Column:
    """A string of up to 18 digits, permuted among all strings of its length."""
    n = F.length(digits)
    low = F.floor((n + 1) / 2).cast("int")
    out = feistel(digits.cast("long"), _ten_to(low), _ten_to(n - low), key, kind)
    return F.lpad(out.cast("string"), n, F.lit("0"))


def in_format(value: Column, digits: Column) -> Column:
    """``value`` with its digits replaced in order by ``digits``."""
    chars = F.filter(F.split(value, ""), lambda c: c != "")
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("k"))

    def put(s: Column, c: Column) -> Column:
        digit = c.between("0", "9")
        return F.struct(
            F.concat(s["out"], F.when(digit, F.substring(digits, s["k"] + 1, F.lit(1))).otherwise(c)).alias("out"),
            (s["k"] + F.when(digit, 1).otherwise(0)).alias("k"),
        )

    return F.aggregate(chars, start, put, lambda s: s["out"])


def _card(value: Column, key: Column) -> Column:
    digits = _digits(value)
    body = permuted_digits(F.left(digits, F.length(digits) - 1), key, "card")
    checked = F.filter(F.sequence(F.lit(0), F.lit(9)), lambda d: F.call_function("luhn_check", F.concat(body, d.cast("string"))))
    return in_format(value, F.concat(body, F.element_at(checked, 1).cast("string")))


def _country(value: Column) -> Column:
    """Digits of the country code: those up to the first separator after the plus sign, else all but ten."""
    own = F.length(F.regexp_extract(value, r"^\+(\d{1,3})[ .(-]", 1))
    return F.when(own > 0, own).otherwise(F.length(_digits(value)) - 10)


def _phone(value: Column, key: Column) -> Column:
    digits = _digits(value)
    n = _country(value)
    return in_format(value, F.concat(F.left(digits, n), permuted_digits(F.substring(digits, n + 1, F.length(digits) - n), key, "phone")))


def _ssn(value: Column, key: Column) -> Column:
    """Permuted among 898 areas (001 to 899 but 666), 99 groups and 9999 serial numbers."""
    part = lambda k: F.split_part(value, F.lit("-"), F.lit(k)).cast("long")
    area = part(1) - 1 - F.when(part(1) > 666, 1).otherwise(0)
    moved = feistel((area * 99 + part(2) - 1) * 9999 + part(3) - 1, F.lit(9999).cast("long"), F.lit(898 * 99).cast("long"), key, "ssn")
    text = lambda x, n: F.lpad(x.cast("string"), n, F.lit("0"))

    def said(x: Column) -> Column:
        high = _div(x, F.lit(9999).cast("long"))
        area = _div(high, F.lit(99).cast("long")) + 1
        return F.concat_ws("-", text(area + F.when(area >= 666, 1).otherwise(0), 3), text(F.pmod(high, F.lit(99)) + 1, 2), text(F.pmod(x, F.lit(9999)) + 1, 4))

    return _let(moved, said)


def _octet(value: Column, k: int) -> Column:
    return F.split_part(value, F.lit("."), F.lit(k)).cast("long")


def _ip(value: Column, key: Column) -> Column:
    whole = ((_octet(value, 1) * 256 + _octet(value, 2)) * 256 + _octet(value, 3)) * 256 + _octet(value, 4)
    out = feistel(whole, F.lit(65536).cast("long"), F.lit(65536).cast("long"), key, "ip")
    part = lambda k: F.shiftright(out, k).bitwiseAND(F.lit(255)).cast("string")
    return F.concat_ws(".", part(24), part(16), part(8), part(0))


def _date_parts(value: Column) -> tuple[Column, Column]:
    """The day that ``value`` names (null if none) and its order of fields: ymd, dmy or mdy.

    Where the year is last, day before month is tried first.
    """
    part = lambda k: F.split_part(F.translate(value, "/.", "--"), F.lit("-"), F.lit(k))
    made = lambda y, m, d: F.try_to_date(F.concat_ws("-", y, F.lpad(m, 2, F.lit("0")), F.lpad(d, 2, F.lit("0"))), "yyyy-MM-dd")
    first = F.length(part(1)) == 4
    dmy, mdy = made(part(3), part(2), part(1)), made(part(3), part(1), part(2))
    day = F.when(first, made(part(1), part(2), part(3))).otherwise(F.coalesce(dmy, mdy))
    return day, F.when(first, F.lit("ymd")).when(dmy.isNotNull(), F.lit("dmy")).otherwise(F.lit("mdy"))


def _day_number(value: Column) -> Column:
    return F.datediff(_date_parts(value)[0], F.lit("1900-01-01").cast("date")).cast("long")


#: Applications of a permutation until a real day comes out: one in 33 at most isn't one.
WALKS = 16


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is evaluated once."""
    return F.get(F.transform(F.array(value), f), 0)


def _date(value: Column, key: Column) -> Column:
    """Permuted among the days whose month and day have as many digits; fields keep their order and width."""

    def begin(day: Column) -> Column:
        late_month, late_day = F.month(day) > 9, F.dayofmonth(day) > 9
        m0, months = F.when(late_month, 10).otherwise(1), F.when(late_month, 3).otherwise(9)
        d0, days = F.when(late_day, 10).otherwise(1), F.when(late_day, 22).otherwise(9)
        x = ((F.year(day) - 1900) * months + F.month(day) - m0) * days + F.dayofmonth(day) - d0
        parts = {"x": x, "low": months * days, "days": days, "m0": m0, "d0": d0, "moved": F.lit(0)}
        return F.struct(*[v.cast("long").alias(k) for k, v in parts.items()])

    def fields(s: Column) -> Column:
        rest = F.pmod(s["x"], s["low"])
        return F.struct((_div(s["x"], s["low"]) + 1900).alias("y"), (_div(rest, s["days"]) + s["m0"]).alias("m"), (F.pmod(rest, s["days"]) + s["d0"]).alias("d"))

    def real(f: Column) -> Column:
        leap = F.when((f["y"] % 4 == 0) & ((f["y"] % 100 != 0) | (f["y"] % 400 == 0)), 29).otherwise(28)
        most = F.when(f["m"] == 2, leap).when(f["m"].isin(4, 6, 9, 11), 30).otherwise(31)
        return (f["d"] <= most) & ((f["y"] < 2099) | (f["m"] < 12) | (f["d"] < 16))  # the last of DAYS days

    def walk(s: Column, _: Column) -> Column:
        moved = feistel(s["x"], s["low"], F.lit(200).cast("long"), key, "date")
        next_ = F.struct(moved.alias("x"), *[s[k].alias(k) for k in ("low", "days", "m0", "d0")], F.lit(1).cast("long").alias("moved"))
        return F.when((s["moved"] == 1) & _let(fields(s), real), s).otherwise(next_)

    part = lambda k: F.split_part(F.translate(value, "/.", "--"), F.lit("-"), F.lit(k))
    own = lambda x, k: F.lpad(x.cast("string"), F.length(part(k)), F.lit("0"))
    sign, second = F.regexp_extract(value, r"[-/.]", 0), F.regexp_extract(value, r"[-/.]\d+([-/.])", 1)
    put = lambda a, b, c: F.concat(own(a, 1), sign, own(b, 2), second, own(c, 3))

    def said(t: Column) -> Column:
        end = F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), _let(t["day"], begin), walk, fields)
        return _let(end, lambda f: F.when(t["order"] == "ymd", put(f["y"], f["m"], f["d"])).when(t["order"] == "dmy", put(f["d"], f["m"], f["y"])).otherwise(put(f["m"], f["d"], f["y"])))

    day, order = _date_parts(value)
    return _let(F.struct(day.alias("day"), order.alias("order")), said)


def _keyed_hex(value: Column, key: Column, kind: str) -> Column:
    return F.sha2(F.concat_ws("|", key, F.lit(kind), value), 256)


def _email(value: Column, key: Column) -> Column:
    """A local part of the keyed digest in the reserved domain example.invalid; case is ignored."""
    return F.concat(F.lit("u"), F.left(_keyed_hex(F.lower(value), key, "email"), F.lit(16)), F.lit("@example.invalid"))


def _secret(value: Column, key: Column) -> Column:
    secret = F.regexp_extract(value, r"[0-9A-Fa-f]{16,}$", 0)
    n = F.length(secret)
    digest = _keyed_hex(secret, key, "secret")
    return F.concat(F.left(value, F.length(value) - n), F.left(F.repeat(digest, F.ceil(n / 64).cast("int")), n))


def kind_of(value: Column) -> Column:
    """The kind of a match, or null if it fails the validation of every kind that it looks like."""
    digits = _digits(value)
    number = value.rlike(f"^(?:{CARD})$") & F.call_function("luhn_check", digits)
    octets = [_octet(value, k) <= 255 for k in (1, 2, 3, 4)]
    in_days = F.coalesce(_day_number(value).between(0, DAYS - 1), F.lit(False))
    ssn = value.rlike(f"^{SSN}$") & ~value.rlike(r"^(?:000|666|9)|-00-|-0000$")
    return (
        F.when(value.rlike(f"^{SECRET}$"), "secret")
        .when(value.contains("@"), "email")
        .when(ssn, "ssn")
        .when(value.rlike(f"^(?:{DATE})$"), F.when(in_days, "date"))
        .when(value.rlike(f"^{IP}$"), F.when(octets[0] & octets[1] & octets[2] & octets[3], "ip"))
        .when(number, "card")
        .when(value.rlike(f"^(?:{PHONE})$") & F.length(digits).between(8, 15) & (F.length(digits) - _country(value)).between(6, 14), "phone")
    )


def _hidden(spark: SparkSession, key: str) -> Column:
    """The key as a column that plans don't show: a scalar subquery on a table of one row."""
    return spark.createDataFrame([(key,)], "key string").scalar()


def pseudonym(value: Column, kind: Column, key: Column) -> Column:
    makers = {"card": _card, "phone": _phone, "ssn": _ssn, "ip": _ip, "date": _date, "email": _email, "secret": _secret}
    out = None
    for name in KINDS:
        made = makers[name](value, key)
        out = F.when(kind == name, made) if out is None else out.when(kind == name, made)
    return out.otherwise(value)


def pseudonymised(docs: DataFrame, key: str = DEMO_KEY, text: str = "text") -> DataFrame:
    """``docs`` with the text rewritten, and n_<kind> for each of KINDS (findings that passed)."""
    if not key:
        raise ValueError("the pseudonym key must not be empty")
    outs = [f"n_{k}" for k in KINDS]
    own = [c for c in docs.columns if c not in outs or c == text]
    rows = sealed(docs).withColumns({"_text": F.col("_in").getField(text), "_key": _hidden(docs.sparkSession, key)})
    t = F.col("_text")
    rows = rows.withColumn("_found", F.when(t.rlike(HINT), F.regexp_extract_all(t, F.lit(PATTERN), F.lit(0))))
    has = F.size("_found") > 0
    rows = rows.withColumn("_kinds", F.when(has, F.transform("_found", kind_of)))
    rows = rows.withColumn("_new", F.when(has, F.zip_with("_found", "_kinds", lambda v, k: pseudonym(v, k, F.col("_key")))))
    pieces = F.split(t, PATTERN, -1)
    woven = F.array_join(F.zip_with(pieces, F.array_append("_new", F.lit("")), lambda p, v: F.concat(p, F.coalesce(v, F.lit("")))), "")
    counts = {f"n_{k}": F.coalesce(_count("_kinds", k), F.lit(0)).cast("long") for k in KINDS}
    return opened(rows, own, **{text: F.when(has, woven).otherwise(t)} | {k: v for k, v in counts.items() if k != text})


def _count(kinds: str, kind: str) -> Column:
    return F.when(F.col(kinds).isNotNull(), F.size(F.filter(kinds, lambda x: x == kind)))


def op2_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = spark.conf.get(KEY_SETTING, DEMO_KEY)
    out = pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"), key)
    n = sum((F.col(f"n_{k}") for k in KINDS), F.lit(0))
    return out.select("doc_id", n.cast("long").alias("n_found"), *[f"n_{k}" for k in KINDS], "text")

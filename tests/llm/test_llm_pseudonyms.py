"""Pseudonyms of the whole small table against a plain Python Feistel network."""

import calendar
import datetime
import hashlib

import regex
from test_llm_cases import docs
from test_llm_queries import luhn

from tallyglass.llm import pseudonyms as P

KEY = "set-your-own-key"


def keyed(kind, turn, half):
    return int(hashlib.sha256(f"{KEY}|{kind}|{turn}|{half}".encode()).hexdigest()[:15], 16)


def permuted(x, low, high, kind):
    a, b = divmod(x, low)
    for r in range(P.ROUNDS):
        if r % 2 == 0:
            a = (a + keyed(kind, r, b) % high) % high
        else:
            b = (b + keyed(kind, r, a) % low) % low
    return a * low + b


def digits(s, kind):
    n = len(s)
    low = (n + 1) // 2
    return str(permuted(int(s), 10**low, 10 ** (n - low), kind)).zfill(n)


def put(value, new):
    new = iter(new)
    return "".join(next(new) if c.isdigit() else c for c in value)


def day_of(value):
    x = [int(v) for v in regex.split("[-/.]", value)]
    tries = [("ymd", x)] if len(regex.split("[-/.]", value)[0]) == 4 else [("dmy", x[::-1]), ("mdy", [x[2], x[0], x[1]])]
    for order, (y, m, d) in tries:
        if 1 <= m <= 12 and 1 <= d <= calendar.monthrange(y, m)[1] if y else False:
            return order, datetime.date(y, m, d)
    return None, None


def pseudonym(v):
    """(kind, new value), or (None, value) if it fails."""
    only = "".join(c for c in v if c.isdigit())
    if regex.fullmatch(P.SECRET, v):
        secret = regex.search("[0-9A-Fa-f]{16,}$", v)[0]
        hashed = hashlib.sha256(f"{KEY}|secret|{secret}".encode()).hexdigest()
        return "secret", v[: -len(secret)] + (hashed * (len(secret) // 64 + 1))[: len(secret)]
    if "@" in v:
        return "email", "u" + hashlib.sha256(f"{KEY}|email|{v.lower()}".encode()).hexdigest()[:16] + "@example.invalid"
    if regex.fullmatch(P.SSN, v) and not regex.search("^(?:000|666|9)|-00-|-0000$", v):
        a, g, s = map(int, v.split("-"))
        out = permuted(((a - 1 - (a > 666)) * 99 + g - 1) * 9999 + s - 1, 9999, 898 * 99, "ssn")
        high, s = divmod(out, 9999)
        a, g = divmod(high, 99)
        return "ssn", f"{a + 1 + (a + 1 >= 666):03}-{g + 1:02}-{s + 1:04}"
    if regex.fullmatch(P.DATE, v):
        order, day = day_of(v)
        if not day or not 0 <= (day - datetime.date(1900, 1, 1)).days < P.DAYS:
            return None, v
        m0, months = (10, 3) if day.month > 9 else (1, 9)
        d0, days = (10, 22) if day.day > 9 else (1, 9)
        x = (day.year - 1900) * months * days + (day.month - m0) * days + day.day - d0
        while True:
            x = permuted(x, months * days, 200, "date")
            y, m, d = 1900 + x // (months * days), m0 + x % (months * days) // days, d0 + x % days
            if d <= calendar.monthrange(y, m)[1] and (y, m, d) < (2099, 12, 16):
                break
        own = {"y": y, "m": m, "d": d}
        fields = regex.split("([-/.])", v)
        return "date", "".join(f if k % 2 else str(own[order[k // 2]]).zfill(len(f)) for k, f in enumerate(fields))
    if regex.fullmatch(P.IP, v):
        o = [int(x) for x in v.split(".")]
        if max(o) > 255:
            return None, v
        out = permuted(((o[0] * 256 + o[1]) * 256 + o[2]) * 256 + o[3], 65536, 65536, "ip")
        return "ip", ".".join(str(out >> k & 255) for k in (24, 16, 8, 0))
    if regex.fullmatch(P.CARD, v) and luhn(only):
        body = digits(only[:-1], "card")
        return "card", put(v, body + next(c for c in "0123456789" if luhn(body + c)))
    if regex.fullmatch(P.PHONE, v) and 8 <= len(only) <= 15:
        own = regex.match(r"\+(\d{1,3})[ .(-]", v)
        n = len(own[1]) if own else len(only) - 10
        if 6 <= len(only) - n <= 14:
            return "phone", put(v, only[:n] + digits(only[n:], "phone"))
    return None, v


def rewritten(t):
    counts = dict.fromkeys(P.KINDS, 0)

    def one(m):
        kind, new = pseudonym(m[0])
        if kind:
            counts[kind] += 1
        return new

    return (None if t is None else regex.sub(P.PATTERN, one, t)), counts


def test_whole_table_equals_plain_python(spark, sf, duck):
    from tallyglass import llm

    got = {r.doc_id: r for r in llm.queries()["op2_pseudonyms"](spark, sf).collect()}
    seen = set()
    for i, t in duck.sql("select doc_id, text from documents").fetchall():
        new, counts = rewritten(t)
        assert got[i].text == new and all(got[i][f"n_{k}"] == n for k, n in counts.items())
        seen |= {k for k, n in counts.items() if n}
    assert {"card", "email", "ip", "secret"} <= seen or len(seen) >= 3


def test_cases_equal_plain_python(spark):
    texts = [
        'token = "abcdefabcdefabcdefab"',
        "219-09-9999 and 666-12-1234 and 899-99-9999 and 001-01-0001",
        "2024-1-5, 2024-01-05, 5.1.2024, 05/01/2024, 12/31/1999, 2000-2-29, 1900-10-9, 2099-12-15, 2099-12-16",
        "+44 20 7946 0958 +33 1 42 68 53 00 +1 (168) 555-5254 (168) 555-5254 +442079460958 +1 2",
        "4111 1111 1111 1111 4111-1111-1111-1112",
        "a.b@c.example 10.0.0.1",
        None,
        "",
        "x" * 200_000 + " 2024-01-05",
    ]
    rows = [(k, t, None, None, 0) for k, t in enumerate(texts)] * 2
    df = docs(spark, rows)
    df = df.withColumn("_found", df.n_chars).withColumnsRenamed({"lang": "_text", "source": "_key"})
    out = P.pseudonymised(df, KEY)
    assert out.columns[:6] == df.columns and out.count() == len(rows)
    for r in out.collect():
        new, counts = rewritten(texts[r.doc_id])
        assert (r.text, r["_found"]) == (new, 0) and all(r[f"n_{k}"] == n for k, n in counts.items()), r.doc_id
    dates = next(r.text for r in out.collect() if r.doc_id == 2).split(", ")
    assert [len(x) for x in dates] == [len(x) for x in texts[2].split(", ")]
    assert dates[0].split("-")[1:] == [x.lstrip("0") for x in dates[1].split("-")[1:]] and dates[1].split("-") == dates[3].split("/")[::-1]


def test_permuted_ssns_stay_possible_and_differ(spark):
    from pyspark.sql import functions as F

    n = 20_000
    text = F.format_string("%03d-%02d-%04d", F.lit(1) + F.col("id") % 600, F.lit(1) + F.col("id") % 99, F.lit(1) + F.col("id") % 9999)
    got = [r.y for r in spark.range(n).select(P._ssn(text, F.lit("k")).alias("y")).collect()]
    assert len(set(got)) == n and all(len(x) == 11 and not regex.search("^(?:000|666|9)|-00-|-0000$", x) for x in got)


def test_plans_don_t_show_the_key(spark):
    out = P.pseudonymised(docs(spark), "a-very-secret-key")
    plan = out._jdf.queryExecution()
    assert "a-very-secret-key" not in plan.toString()
    out.collect()
    assert "a-very-secret-key" not in plan.toString()

"""JSON values at any depth against a plain walk, and decompositions against Python's."""

import json
import random
import unicodedata

from pyspark.sql import functions as F

from tallyglass.functions import text
from tallyglass.functions.documents import json_values
from tallyglass.operators import flatten


def walked(node, keys):
    if isinstance(node, dict):
        for k, v in node.items():
            if k in keys and isinstance(v, (str, int, float)):
                yield v if isinstance(v, str) else json.dumps(v)
            else:
                yield from walked(v, keys)
    elif isinstance(node, list):
        for v in node:
            yield from walked(v, keys)


def test_values_at_any_depth(spark):
    pick = random.Random(4)
    texts = ["", "plain", '"id"', '"id": 5', 'a \\" id \\": 3', "\\", "\\\\", '{"id": 9}', "é\n\t:", "id", "ünder/", "12"]
    made = lambda depth: pick.choice([None, True, 7, -2.5, pick.choice(texts), pick.choice(texts)]) if depth == 0 or pick.random() < 0.3 else ([made(depth - 1) for _ in range(pick.randint(0, 4))] if pick.random() < 0.4 else {pick.choice([*texts, "id", "id"]): made(depth - 1) for _ in range(pick.randint(0, 5))})
    deep = {"id": 1}
    for k in range(150):
        deep = {"x": deep, "id": str(k)} if k % 2 else {"y": [deep]}
    docs = [{"a": made(6)} for _ in range(400)] + [deep, {"long": '\\"' * 20_000 + '"id": 3', "id": 4}]
    rows = [(i, json.dumps(d, ensure_ascii=i % 2 == 0, indent=1 if i % 3 == 0 else None)) for i, d in enumerate(docs)]
    rows += [(-1, None), (-2, '{"id": 3'), (-3, ""), (-4, '{"\\u0069d": 8, "id": null, "ID": 1}')]
    found = {r.i: r.v for r in spark.createDataFrame(rows, "i long, t string").select("i", json_values("t", "id").alias("v")).collect()}
    assert [found[k] for k in (-1, -2, -3, -4)] == [None, None, None, ["8"]]
    for i, d in enumerate(docs):
        assert found[i] == list(walked(d, {"id"})), i
    ids = spark.createDataFrame([('{"note": "\\"indicatorId\\": 9", "x": [{"indicatorID": "4"}, {"indicatorId": 2.0}, {"indicatorId": "n"}]}',)], "t string")
    assert ids.select(flatten.indicator_ids("t").alias("i")).first().i == [2, 4]


def test_decompositions(spark):
    chars = [chr(i) for i in range(1, 0x3000)]
    rows = spark.createDataFrame([(i, f"a{c}{c}z") for i, c in enumerate(chars)] + [(-1, None), (-2, "")], "i long, t string")
    got = {r.i: (r.a, r.b) for r in rows.select("i", text.compatible("t", marks=True).alias("a"), text.compatible("t").alias("b")).collect()}
    assert got[-1] == (None, None) and got[-2] == ("", "")
    bare = lambda x: "".join(y for y in x if not unicodedata.combining(y))
    ordered = lambda x: unicodedata.normalize("NFD", x)
    for i, c in enumerate(chars):
        right = unicodedata.normalize("NFKD", f"a{c}{c}z")
        assert ordered(got[i][0]) == right and got[i][1] == bare(right), hex(ord(c))


def test_names_compare_in_their_compatible_form(spark):
    rows = spark.createDataFrame([("Ｌos Ñiﬁos Uniﬁed", "Los Ninios Unified"), ("San José", "San José")], "a string, b string")
    got = rows.select(F.array_join(text.name_tokens("a"), " ").alias("a"), F.array_join(text.name_tokens("b"), " ").alias("b")).collect()
    assert [r.b for r in got] == ["los ninios", "san jose"] and got[1].a == "san jose"

"""Values of JSON texts of any shape, as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyglass.functions.text import _col, let

#: A text token, on request with the plain value that it is the key of. Texts are taken whole, from
#: the left, so a key's name within a text is never taken for a key.
_TOKEN = r'("[^"]*+")(?:\s*+:\s*+("[^"]*+"|[-+.\w]++))?+'


def json_values(c: Column | str, *keys: str) -> Column:
    """array<string>: the plain values under keys at any depth of a JSON text, in their order.

    One pass over the text, whatever the depth. Values are texts (unescaped), numbers and booleans as
    they are written; objects, arrays and nulls under such a key aren't plain and give nothing, though
    keys within them are searched. Keys may be written with escapes. Null where the text is null or
    isn't JSON.
    """
    # escaped quotes and backslashes in a form without either, so that a quote always ends a text
    safe = F.replace(F.replace(_col(c), F.lit("\\\\"), F.lit("\\u005c")), F.lit('\\"'), F.lit("\\u0022"))
    plain = lambda x: F.when(x.contains("\\"), F.get_json_object(F.concat(F.lit("["), x, F.lit("]")), "$[0]")).otherwise(F.trim(x, F.lit('"')))
    pairs = lambda t: F.arrays_zip(F.regexp_extract_all(t, F.lit(_TOKEN), F.lit(1)).alias("k"), F.regexp_extract_all(t, F.lit(_TOKEN), F.lit(2)).alias("v"))
    named = F.filter(let(safe, pairs), lambda e: (e["v"] != "") & (e["v"] != "null") & plain(e["k"]).isin(*keys))
    return F.when(F.get_json_object(_col(c), "$").isNotNull(), F.transform(named, lambda e: plain(e["v"])))

"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyglass.llm import byte_bpe, decontaminate, language_id, license_scan, line_dedup, near_dedup, passages, pseudonyms, quality, token_counts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{k % 977}x{k % 31}" for k in range(30_000))
TEXTS = [None, "", " \n\t", "One", "a b", LONG, "Same line.\nSame line.", "Same line.\nSame line.", "Ünïcode ß 日本語 \U0001f600 \x1f ."]


def docs(spark, rows=None):
    rows = [(k, t, ("en", "de")[k % 2], f"s{k}", len(t or "")) for k, t in enumerate(TEXTS)] + [(None, "no id here", None, None, 0), (4, "a b", "en", "s4", 3)] if rows is None else rows
    return spark.createDataFrame(rows, SCHEMA)


def test_byte_bpe(spark):
    ranks, pattern = byte_bpe.production_ranks()
    df = docs(spark).withColumns({"ids": F.lit(1), "decoded": F.lit(2)})
    out = byte_bpe.encode_decode(df, ranks, pattern)
    for r in out.collect():
        assert bytes(r.decoded) == (r.text or "").encode() and r.n_tokens * 4 == len(r.ids)
    got = out.select(byte_bpe.unpacked(F.col("ids")).alias("u"), "ids").where("n_tokens < 50").collect()
    assert all(np.frombuffer(bytes(r.ids), "<u4").tolist() == r.u for r in got)
    assert byte_bpe.encode_decode(docs(spark, []), ranks, pattern).count() == 0
    with pytest.raises(ValueError):
        byte_bpe.serialise_model({b"a": 0})


def test_language_id(spark):
    rng = random.Random(1)
    say = lambda words: " ".join(rng.choice(words) for _ in range(30))
    texts = [say(["the", "house", "with", "green"]) for _ in range(60)] + [say(["der", "haus", "mit", "grün"]) for _ in range(60)]
    model = language_id.fit(texts, ["en"] * 60 + ["de"] * 60)
    assert model.predict("the green house")[0] == "en" and model.predict("das haus mit")[0] == "de"
    df = docs(spark).withColumn("score", F.lit("mine"))
    out = {r.doc_id: r for r in language_id.predict(df, model).collect()}
    assert [out[k].lang_pred for k in (0, 1, 2)] == ["und"] * 3 and not out[0].accepted and out[0].score == 0
    assert language_id.predict(docs(spark, []), model).count() == 0
    assert language_id.stage(spark, docs(spark, []), "").count() == 0
    with pytest.raises(ValueError):
        language_id.fit([], [])


def test_near_duplicates(spark):
    base = [f"t{k}" for k in range(200)]
    rows = [(k, t, None, None, 0) for k, t in enumerate(TEXTS)]
    rng = random.Random(2)
    for n in range(120):  # near copies around the threshold, in chains
        w = list(base)
        for _ in range(rng.randrange(0, 26)):
            w[rng.randrange(200)] = f"x{rng.randrange(50)}"
        rows.append((100 + n, " ".join(w), None, None, 0))
    rows += [(100, rows[9][1], None, None, 0), (None, "a b", None, None, 0)]
    df = docs(spark, rows).withColumns({"_id": F.lit(1), "component_id": F.lit(2)})
    got = near_dedup.near_duplicates(df).collect()
    from test_llm_queries import exact_components

    want = exact_components([(r[0], r[1]) for r in rows if r[0] is not None])
    assert len(got) == len(rows)
    for r in got:
        assert (r["_id"] is None and r.component_id is None) or (r["_n"], r.component_id) == want[r["_id"]][:2]
    assert near_dedup.near_duplicates(docs(spark, [])).count() == 0


def test_blocks_find_every_link(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 7)
    monkeypatch.setattr(near_dedup, "ROUNDS", 1)
    test_near_duplicates(spark)


def test_minhash_estimate():
    rng = np.random.default_rng(5)
    a = np.unique(rng.integers(0, 1 << 63, 3000, dtype=np.uint64))
    b = np.concatenate([a[:2400], np.unique(rng.integers(0, 1 << 63, 600, dtype=np.uint64))])
    m = near_dedup.signatures([a, np.sort(b)])
    true = 2400 / (len(a) + len(b) - 2400)
    assert abs((m[0] == m[1]).mean() - true) < 5 * (true * (1 - true) / near_dedup.PERMUTATIONS) ** 0.5


def test_line_dedup(spark):
    rows = [(k, f"Shared footer.\nBody of text number {k} with more words than the footer.", "en", f"s{k % 12}", 0) for k in range(24)]
    rows += [(50, None, "en", "s1", 0), (51, "", "en", "s1", 0), (52, "Shared footer.", "en", None, 0), (0, rows[0][1], "en", "s0", 0)]
    df = docs(spark, rows).withColumn("n_removed", F.lit("mine"))
    got = sorted((r.doc_id, r.text, r.n_lines, r.n_removed) for r in line_dedup.deduplicated(df).collect() if r.text is not None)
    assert got[0] == got[1] == (0, "Body of text number 0 with more words than the footer.", 2, 1)
    assert (52, "Shared footer.", 1, 0) in got and (51, "", 0, 0) in got
    assert line_dedup.deduplicated(df).where("text is null").first().n_removed == 0
    assert line_dedup.deduplicated(docs(spark, [])).count() == 0


def test_line_spread_near_the_threshold(spark):
    rows = [(n * 100 + k, f"line {n}\n" + " ".join(f"z{n}_{k}_{j}" for j in range(20)), "en", f"s{k}", 0) for n in (2, 9, 10, 11, 40) for k in range(n)]
    got = collections.Counter()
    for r in line_dedup.deduplicated(docs(spark, rows)).collect():
        got[r.doc_id // 100] += r.n_removed
    assert {n: got[n] for n in (2, 9, 10, 11)} == {2: 0, 9: 0, 10: 10, 11: 11} and sum(got.values()) == 61


def test_decontamination(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    items = spark.createDataFrame([(1, item), (2, item), (3, "tiny"), (4, None), (5, "..."), (None, "x y z")], "item_id long, text string")
    rows = [(1, f"before {item.upper()}! after", None, None, 0), (2, item.replace("twelve", "12"), None, None, 0), (3, item.replace("six", "6"), None, None, 0), (4, LONG + " " + item + " " + LONG, None, None, 0), (5, "so tiny", None, None, 0), (5, "so tiny", None, None, 0), (6, None, None, None, 0)]
    got = {(r["_doc"], r["_item"]): (r.n_shared, r.n_item) for r in decontaminate.found_items(docs(spark, rows), items).collect()}
    assert got == {(d, i): (n, 8) for d, n in ((1, 8), (2, 7), (4, 8)) for i in (1, 2)} | {(5, 3): (1, 1)}
    assert decontaminate.found_items(docs(spark, []), items).count() == 0
    assert decontaminate.found_items(docs(spark, rows), items.where("false")).count() == 0


def test_license_scan(spark):
    mit = license_scan.TEMPLATES["mit-permission"]
    half = " ".join(mit.split()[:40])
    rows = [(1, "x " * 400 + mit + " y" * 300, None, None, 0), (2, half, None, None, 0), (3, "all rights RESERVED", None, None, 0), (4, None, None, None, 0), (5, "", None, None, 0), (None, mit, None, None, 0)]
    got = {(r["_doc"], r["_template"]): (r.n_shared, r.n_template) for r in license_scan.found_templates(docs(spark, rows)).collect()}
    assert set(got) == {(1, "mit-permission"), (3, "all-rights-reserved")} and got[1, "mit-permission"][0] == got[1, "mit-permission"][1]
    assert license_scan.found_templates(docs(spark, [])).count() == 0
    with pytest.raises(ValueError):
        license_scan.found_templates(docs(spark), {"big": LONG}).count()


def test_quality(spark):
    good = " ".join(f"Word{k} follows{k * 3} term{k * 7} here{k}." for k in range(20))
    menu = "\n".join(["Home | News | About | More"] * 3)
    rows = [(1, good, None, None, 0), (2, good + "\n" + menu, None, None, 0), (3, "\n".join(f"a{k} | b{k} | c{k} | d{k}" for k in range(30)), None, None, 0), (4, None, None, None, 0), (5, LONG, None, None, 0)]
    df = docs(spark, rows).withColumn("kept", F.lit("mine"))
    got = {r.doc_id: r for r in quality.judged(df).collect()}
    assert got[1].kept and got[2].kept and got[2].cleaned == good and got[2].n_lines_removed == 3
    assert not got[3].kept and not got[4].kept and got[4].n_words == 0 and got[5].n_words == 30_000
    assert quality.judged(docs(spark, [])).count() == 0


def test_pseudonyms(spark):
    f = lambda x: pseudonyms.feistel(x, F.lit(367).cast("long"), F.lit(199).cast("long"), F.lit("k"), "date")
    assert spark.range(pseudonyms.DAYS).select(f(F.col("id")).alias("y")).distinct().count() == pseudonyms.DAYS
    n = spark.range(1000).select(pseudonyms.permuted_digits(F.lpad(F.col("id").cast("string"), 3, F.lit("0")), F.lit("k"), "ssn").alias("y"))
    assert n.distinct().count() == 1000 and n.agg(F.max(F.length("y"))).first()[0] == 3
    rows = [(1, "4111 1111 1111 1111 or 4111111111111111, not 4111111111111112", None, None, 0), (2, "on 2024-02-29, 29.02.2024 and 31/02/2024", None, None, 0), (3, None, None, None, 0), (4, "ip 10.0.0.1 not 999.1.1.1 or 1.2.3.4.5", None, None, 0)]
    got = {r.doc_id: r for r in pseudonyms.pseudonymised(docs(spark, rows).withColumn("n_ip", F.lit("mine"))).collect()}
    a = got[1].text.split(" or ")
    assert a[0].replace(" ", "") == a[1][:16] != "4111111111111111" and got[1].text.endswith("not 4111111111111112") and got[1].n_card == 2
    b = got[2].text.split()
    assert b[1].rstrip(",").split("-") == b[2].split(".")[::-1] and got[2].text.endswith("31/02/2024") and got[2].n_date == 2
    assert got[3].text is None and got[3].n_card == 0 and got[4].n_ip == 1
    assert pseudonyms.pseudonymised(docs(spark, []), "k").count() == 0
    assert pseudonyms.pseudonymised(docs(spark, rows), "other").where("doc_id = 1").first().text != got[1].text
    with pytest.raises(ValueError):
        pseudonyms.pseudonymised(docs(spark), "")


def test_token_allocation(spark):
    import public_tokenizers as P

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        vocabulary = f.read()
    rng = random.Random(4)
    for _ in range(200):
        ends = np.cumsum([rng.randrange(1, 6) for _ in range(12)])
        starts = np.concatenate([[0], ends[:-1]])
        lo = np.array(sorted(rng.randrange(0, int(ends[-1])) for _ in range(4)))
        hi = lo + np.array([rng.randrange(0, 12) for _ in range(4)])
        n, c = token_counts.allocated(starts, ends, lo, hi)
        n2, c2 = [0] * 4, [0] * 4
        for s, e in zip(starts, ends, strict=True):
            share = [max(0, min(e, b) - max(s, a)) for a, b in zip(lo, hi, strict=True)]
            k = max(range(4), key=lambda i: (share[i], -lo[i], -i))
            if share[k]:
                n2[k] += 1
                c2[k] += sum(x > 0 for x in share) > 1
        assert n.tolist() == n2 and c.tolist() == c2
    out = token_counts.counted(docs(spark).withColumn("section", F.lit(3)), vocabulary, P.PATTERN, "sentences").collect()
    assert {r["_doc"] for r in out} == {2, 3, 4, 5, 6, 7, 8, None}
    given = spark.createDataFrame([(4, 7, 0, 2), (4, 8, 2, 99), (0, 1, 0, 5)], "doc_id long, section int, start int, end int")
    got = sorted((r.section, r.n_tokens, r.n_crossing) for r in token_counts.counted(docs(spark), vocabulary, P.PATTERN, given).where("_doc = 4").collect())
    assert got == [(7, 2, 1), (7, 2, 1), (8, 0, 0), (8, 0, 0)]  # " b" is split evenly: to the first
    assert token_counts.counted(docs(spark, []), vocabulary, P.PATTERN).count() == 0


def test_chains():
    p = np.array([0, 10, 20, 30, 100, 110])
    q = np.array([5, 15, 26, 36, 7, 17])
    found = [c.tolist() for c in passages.chains(p, q)]
    assert found[0] == [0, 1, 2, 3] and [4, 5] in found
    best = lambda p, q: max(
        passages.K * len(s) - passages.GAP_COST * sum(p[b] - p[a] + q[b] - q[a] for a, b in zip(s, s[1:]))
        for m in range(1, 1 << len(p))
        for s in [[k for k in range(len(p)) if m >> k & 1]]
        if all(p[a] < p[b] and q[a] < q[b] for a, b in zip(s, s[1:]))
    )
    rng = random.Random(3)
    for _ in range(60):
        pairs = sorted({(rng.randrange(40), rng.randrange(40)) for _ in range(9)})
        p, q = (np.array(x) for x in zip(*pairs))
        s = passages.chains(p, q)[0]
        got = passages.K * len(s) - passages.GAP_COST * sum(p[b] - p[a] + q[b] - q[a] for a, b in zip(s, s[1:]))
        assert abs(got - best(p.tolist(), q.tolist())) < 1e-9


def test_fuzzy_passages(spark):
    rng = random.Random(9)
    new = lambda n: [f"u{rng.randrange(10**6)}" for _ in range(n)]
    passage = new(120)
    edited = list(passage)
    for k in range(11, 120, 17):
        edited[k] = "edit"
    cut = passage[:60] + passage[63:]
    rows = [(1, " ".join(new(90) + passage + new(50)), None, None, 0), (2, " ".join(new(30) + edited + new(70)), None, None, 0), (3, " ".join(cut + new(40)), None, None, 0), (4, " ".join(new(300)), None, None, 0), (5, " ".join(new(60) + passage[:30] + new(60)), None, None, 0), (6, None, None, None, 0), (7, " ".join(["ha"] * 400), None, None, 0), (None, " ".join(passage), None, None, 0)]
    copies = [(20 + k, " ".join(f"c{j}" for j in range(80)), None, None, 0) for k in range(3)]
    got = collections.defaultdict(set)
    for r in passages.repeated_passages(docs(spark, rows + copies).withColumn("partner", F.lit(1))).collect():
        got[r["_doc"]] |= set(range(r.start_word, r.end_word))
    assert set(got) == {1, 2, 3, 20, 21, 22}
    assert set(range(90, 210)) <= got[1] and len(set(range(30, 150)) - got[2]) <= 12 and len(set(range(117)) - got[3]) <= 2 and max(got[3]) < 125
    assert got[20] == got[21] == got[22] == set(range(80))
    assert passages.repeated_passages(docs(spark, [])).count() == 0


def test_exact_passages_of_other_holders(spark):
    rng = random.Random(17)
    new = lambda n: [f"v{rng.randrange(10**7)}" for _ in range(n)]
    rows, need = [], []
    for g in range(30):
        # the least id, and the least and largest hash of ids, hold the first 45 words only
        passage, ids = new(60), range(100 * g, 100 * g + 12)
        order = [r[0] for r in spark.range(100 * g, 100 * g + 12).orderBy(F.xxhash64("id")).collect()]
        short = {ids[0], order[0], order[-1]}
        need += [k for k in ids if k not in short]
        rows += [(k, " ".join(new(80) + passage[: 45 if k in short else 60] + new(80)), None, None, 0) for k in ids]
    got = collections.defaultdict(set)
    for r in passages.repeated_passages(docs(spark, rows)).collect():
        got[r["_doc"]] |= set(range(r.start_word, r.end_word))
    assert not [k for k in need if set(range(80, 140)) - got[k]]


def test_recall_of_edited_passages(spark):
    rng = random.Random(23)
    new = lambda n: [f"r{rng.randrange(10**9)}" for _ in range(n)]
    kinds, rows = [(60, 6, 0.97), (60, 9, 0.85), (100, 15, 0.97), (100, 20, 0.95)], []
    for k, (n, edits, _) in enumerate(kinds):
        for j in range(100):
            passage = new(n)
            edited = list(passage)
            for at in rng.sample(range(n), edits):
                edited[at] = new(1)[0]
            rows += [(1000 * k + 2 * j + s, " ".join(new(80) + x + new(80)), None, None, 0) for s, x in enumerate((passage, edited))]
    got = {r["_doc"] for r in passages.repeated_passages(docs(spark, rows)).collect()}
    recall = [sum(1000 * k + 2 * j + 1 in got for j in range(100)) / 100 for k in range(len(kinds))]
    assert all(r >= least for r, (_, _, least) in zip(recall, kinds, strict=True)), recall


def test_line_stage_spares_copies_only(spark):
    menu = "\n".join(f"Menu entry number {k} of every site" for k in range(6))
    copied = "\n".join(f"Line {k} of a text that many sites carry" for k in range(6))
    rows = [(k, f"{menu}\nown words of page {k}", "en", f"s{k}", 0) for k in range(3)]
    rows += [(10 + k, menu.split("\n")[k % 6] + "\n" + " ".join(f"b{k}x{j}" for j in range(60)), "en", f"t{k}", 0) for k in range(72)]
    rows += [(100 + k, copied, "en", f"u{k}", 0) for k in range(12)]
    rows[1] = (1, menu.split("\n")[0] + "\n" + menu.split("\n")[1] + "\nquite short", "en", "s1", 0)
    rows[2] = (2, menu.split("\n")[3] + "\n" + menu.split("\n")[4] + "\nanother one", "en", "s2", 0)
    got = {r.doc_id: r.text for r in line_dedup.stage(spark, docs(spark, rows), "").collect()}
    assert (got[0], got[1], got[2]) == ("own words of page 0", "quite short", "another one")
    assert all(got[100 + k] == copied for k in range(12)) and len(got) == len(rows)


def test_near_duplicates_by_five_words(spark):
    words = [f"s{k}" for k in range(200)]
    edited = ["other" + w if k % 25 == 12 else w for k, w in enumerate(words)]  # 0.85 at two words, 0.66 at five
    rows = [(1, " ".join(words), None, None, 0), (2, " ".join(edited), None, None, 0), (3, " ".join(words[:-1]), None, None, 0)]
    got = lambda n: {r["_id"]: r.component_id for r in near_dedup.near_duplicates(docs(spark, rows), shingle=n).collect()}
    assert got(2) == {1: 1, 2: 1, 3: 1} and got(5) == {1: 1, 2: 2, 3: 1}

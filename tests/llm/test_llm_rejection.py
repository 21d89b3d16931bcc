"""Language identification rejects what is of no known language and keeps what is."""

import random

from pyspark.sql import functions as F
from test_llm_cases import docs

from tallyglass.llm import language_id
from tallyglass.llm.common import table


def test_gibberish_and_other_scripts_are_rejected(spark):
    read = table(spark, "/root/testdata/sf0.01", "documents")
    model = language_id.fitted(read, keep=language_id.in_training(F.col("doc_id")))
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 9)))
    texts = [" ".join(word() for _ in range(n)) for n in (5, 20, 100, 400) for _ in range(50)]
    texts += ["Η γλώσσα είναι ένα σύστημα", "Это простой текст на русском языке", "これは日本語の文章です"]
    rows = [(k, t, None, None, 0) for k, t in enumerate(texts)] * 2  # repeated rows, the same answers
    out = language_id.predict(docs(spark, rows), model)
    assert out.where("accepted").count() <= 0.05 * len(rows)
    held = language_id.predict(read.where(~language_id.in_training(F.col("doc_id"))), model).where("lang = lang_pred")
    assert held.where("not accepted").count() <= 0.01 * held.count()
    assert max(model.false_acceptance.values()) <= 0.05 and model.right_lost <= 0.01


def test_null_empty_and_very_long_texts(spark):
    texts = ["the house with green " * 5] * 40 + ["der haus mit grün " * 5] * 40
    model = language_id.fit(texts, ["en"] * 40 + ["de"] * 40)
    assert model.predict(None) == model.predict("") == model.predict("12 !") == (language_id.UNKNOWN, 0.0)
    assert model.predict("the house with green " * 60_000)[0] == "en"
    assert language_id.fit(["only one language here"] * 30, ["en"] * 30).predict("language here")[0] == "en"

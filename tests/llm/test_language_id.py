"""Held-out accuracy, what is learned from, and the rows without a language."""

import zlib

from tidemill.llm import language_id

DATA = "/root/testdata/sf0.01/documents.parquet"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(DATA)
    got = language_id.identify_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count()
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1
    out = [r for r in got if r["held_out"] and r["lang"]]
    assert sum(r["lang"] == r["lang_pred"] for r in out) >= 0.97 * len(out)


def test_labels_of_held_out_rows_are_not_read(spark):
    docs = spark.read.parquet(DATA).limit(300)
    spoiled = docs.selectExpr("doc_id", "text", "CASE WHEN crc32(cast(cast(doc_id as string) as binary)) % 3 = 1 THEN 'xx' ELSE lang END AS lang", "'s' AS source")
    rows = lambda df: sorted((r["doc_id"], r["lang_pred"], r["score"]) for r in language_id.identify_languages(df).collect())
    assert rows(docs) == rows(spoiled.repartition(5))


def test_rows_without_a_language(spark):
    english, german = "the cat and the dog of the house " * 5, "der hund und die katze des hauses ß " * 5
    rows = [(i, english if i % 2 else german, "en" if i % 2 else "de", 7) for i in range(40)]
    rows += [(90, None, "en", 7), (91, "", None, 7), (92, "½ ² Ⅷ ③ 12 _", "de", 7), (93, english * 3000, None, 7), (93, english, None, 7), (None, german, "de", None), (94, "漢", None, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, held_out int")
    got = [(r["doc_id"], r["lang_pred"]) for r in language_id.identify_languages(docs).collect()]
    want = {90: "und", 91: "und", 92: "und", 93: "en", None: "de"}
    assert all(lang == want.get(i, lang) and lang in ("en", "de", "und") for i, lang in got) and len(got) == len(rows)
    assert dict(got)[94] != "und"
    assert {r["lang_pred"] for r in language_id.identify_languages(docs.selectExpr("doc_id", "text", "cast(null as string) AS lang")).collect()} == {"und"}
    assert language_id.identify_languages(docs.where("false")).count() == 0


def test_the_sample_is_bounded(spark):
    rows = [(i, "abc def", f"l{i % 30}") for i in range(3000)]
    vectors, labels = language_id.training_sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_lang=50, most_rows=300)
    assert len(labels) == len(vectors.places) == 300 and all(labels.count(f"l{k}") == 10 for k in range(30))

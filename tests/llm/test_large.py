"""Operators on inputs that are large in one way: many rows without usable ids, many lines, many archive members, many equal pages."""

import gzip
import time

import pytest
from pyspark.sql import functions as F

from resight.llm import langid, licenses, mixing, repeats, simhash, sketch, warc
from resight.llm._spark import new_path

ROWS = 100_000
IDS = {
    "strings": "concat('d', pmod(xxhash64(i), 1000000000L), '-', i)",
    "one null, one twice": "CASE WHEN i = 77 THEN NULL WHEN i = 78 THEN 79L ELSE i END",
}


def many(spark, kind):
    """Each text names its id."""
    rows = spark.range(ROWS, numPartitions=8).withColumnRenamed("id", "i").withColumn("doc_id", F.expr(IDS[kind]))
    text = F.concat_ws(" ", F.lit("id"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.sha2(F.col("i").cast("string"), 256), F.col("i").cast("string"))
    return rows.select("doc_id", text.alias("text"), F.concat(F.lit("s"), F.col("i") % 3).alias("source"), F.lit("en").alias("lang")).repartition(6)


def own(df):
    """Rows whose text names another id."""
    return df.filter(F.split("text", " ")[1] != F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).count()


@pytest.mark.parametrize("kind", sorted(IDS))
def test_the_mix_keeps_every_row_and_its_own_text(spark, kind):
    out = mixing.with_pieces(many(spark, kind)).cache()
    assert out.count() == ROWS and out.select("text").distinct().count() == ROWS and own(out) == 0
    assert out.filter("size <> 4").count() == 0
    out.unpersist()


@pytest.mark.parametrize("kind", sorted(IDS))
def test_near_dedup_keeps_rows_with_their_own_texts(spark, kind):
    docs = many(spark, kind)
    kept = simhash.keep_one(docs.unionByName(docs.filter("text LIKE '%7'")))
    assert own(kept) == 0 and kept.select("text").distinct().count() == kept.count() <= ROWS


def test_figures_stand_beside_their_own_ids(spark):
    docs = many(spark, "strings").filter("pmod(xxhash64(doc_id), 10) < 3").withColumn("text", F.concat("text", F.lit(" "), F.expr("repeat('x ', cast(length(doc_id) * 3 AS int))")))
    got = licenses.scan(docs).join(docs.select("doc_id", F.size(F.regexp_extract_all("text", F.lit("[0-9a-z]+"), F.lit(0))).alias("n")), "doc_id")
    assert got.filter("n_words <> n").count() == 0 and got.count() == docs.count()
    chars = sketch.compare_with_next(docs).join(docs.select("doc_id", F.length("text").alias("n")), "doc_id")
    assert chars.filter("n_chars <> n").count() == 0
    size = repeats.remove_repeats(docs).join(docs.select("doc_id", F.length("text").alias("n")), "doc_id")
    assert size.filter("n_bytes <> n").count() == 0


@pytest.mark.parametrize("lines", [2_147, 5_000, 100_000])
def test_a_license_at_the_end_of_many_lines(spark, lines):
    text = "some words stand here\n" * lines + "Permission is hereby granted, free of charge,\nto any person obtaining a copy\nof this software and associated documentation files."
    rows = licenses.scan(spark.createDataFrame([(1, text), (2, "permission. " * lines + text)], "doc_id int, text string")).collect()
    assert {r.labels for r in rows} == {"mit"} and all(r.score >= 0.8 for r in rows)


def test_many_archive_members_are_read_in_linear_time():
    members = [gzip.compress(b"WARC/1.0\r\n%d\r\n" % i + b"x" * 200) for i in range(20_000)]
    began = time.perf_counter()
    data, whole = warc._unpacked(b"".join(members))
    assert time.perf_counter() - began < 5
    assert whole and data == b"".join(gzip.decompress(m) for m in members)
    assert warc._unpacked(b"".join(members[:50]) + b"\0\r\n")[1] and not warc._unpacked(b"".join(members[:50]) + b"rest")[1] and not warc._unpacked(b"".join(members[:50])[:-4])[1]


@pytest.mark.parametrize("most", [0, 10**6])
def test_half_of_all_pages_are_null_and_a_third_are_one_error_page(spark, monkeypatch, most):
    monkeypatch.setattr(warc, "BROADCAST_DIGESTS", most)
    html = F.when(F.col("id") % 2 == 0, None).when(F.col("id") % 3 == 0, F.lit("error " * 300)).otherwise(F.concat(F.lit("page " * 300), F.col("id").cast("string")))
    pages = spark.range(3_000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), html.alias("html"))
    path = new_path(spark, "pages")
    warc.write_archives(pages, path)
    got = {r.page_id: r for r in warc.read_archives(spark, path).collect()}
    assert len(got) == 3_000 and {r.problem for r in got.values()} == {None}
    last = max(i for i in range(3_000) if i % 2 and i % 3 == 0)
    assert {i for i, r in got.items() if r.record_type == "revisit"} == {i for i in range(3_000) if i % 2 and i % 3 == 0 and i != last}
    assert {r.refers_to for r in got.values()} == {None, last}
    assert all(r.payload_bytes == (0 if i % 2 == 0 else 1800 if i % 3 == 0 else 1500 + len(str(i))) for i, r in got.items())


@pytest.mark.parametrize("docs", [19, 20, 21, 200])
def test_one_rule_for_languages_of_any_number_of_documents(spark, docs):
    """n-grams that occur once are kept up to 1 / least_share n-grams of a language, whatever its number of documents."""
    rows = [(i, "".join(chr(0x4E00 + 40 * i + k) for k in range(40)), "zz") for i in range(docs)] + [(10**6 + i, "the and of the", "en") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = langid.predict(df.filter("lang = 'zz'"), langid.learn(df)).collect()
    assert all(r._lang == "zz" and r._lang_score > 0.95 for r in got)
    none = langid.predict(df.filter("lang = 'zz'"), langid.learn(df, least_share=0.1)).collect()
    assert all(r._lang_score < 0.1 for r in none)


def test_as_a_plain_ngram_model(spark):
    """Containment of trigrams by sets, with the same rule, gives the same languages and, but for false positives, the same scores."""
    import random
    from collections import Counter

    rng = random.Random(6)
    common = "a b c d".split()
    words = {lang: ["".join(rng.choices(letters, k=rng.randint(1, 6))) for _ in range(60)] for lang, letters in {"aa": "abcdefgh", "bb": "efghijkl", "cc": "ijklmnop"}.items()}
    rows = [(i, " ".join(rng.choices(words[lang] + common, k=25)) + rng.choice(["", "!", " 12"]), lang) for i in range(150) for lang in words]
    rows = [(k, t, lang) for k, (_, t, lang) in enumerate(rows)]

    def grams(t):
        out = "".join(c if c.isalpha() else "\0" for c in "\0" + t.lower() + "\0")
        while "\0\0" in out:
            out = out.replace("\0\0", "\0")
        return [out[i : i + 3] for i in range(len(out) - 2) if out[i + 1] != "\0"]

    counts = {lang: Counter(g for _, t, x in rows if x == lang for g in grams(t)) for lang in words}
    share = {lang: {g: n / sum(c.values()) for g, n in c.items()} for lang, c in counts.items()}
    most = Counter()
    for c in share.values():
        for g, p in c.items():
            most[g] = max(most[g], p)
    has = {lang: {g for g, p in c.items() if p > 1e-3 and p >= most[g] / 20} for lang, c in share.items()}
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = {r.doc_id: r for r in langid.predict(df, langid.learn(df, least_share=1e-3)).collect()}
    for i, t, _ in rows:
        g = grams(t)
        want = {lang: sum(x in held for x in g) / len(g) for lang, held in has.items()}
        assert got[i]._lang_score == pytest.approx(max(want.values()), abs=0.02)
        assert want[got[i]._lang] >= max(want.values()) - 0.04

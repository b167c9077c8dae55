"""Every operator against plain rules on awkward documents, unique ids and not, and on empty tables."""

import hashlib
import math
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from resight.llm import decontaminate, langid, licenses, lm, mixing, pii, repeats, sketch, warc
from resight.llm._spark import new_path

from . import cases

both = pytest.mark.parametrize("unique", [True, False])


def key(rows):
    return sorted(rows, key=repr)


@both
def test_mixing(spark, unique):
    df, rows = cases.frame(spark, unique), cases.rows(unique)
    got = mixing.taken(df).collect()
    assert key((r.doc_id, r.size) for r in got) == key((d, len(cases.BLANK.findall(t or ""))) for d, t, *_ in rows)
    assert all(0 <= r.taken <= 2 * r["size"] for r in got)
    by = defaultdict(lambda: [0, 0, 0.0])
    for r in got:
        by[r.source][0] += r["size"]
        by[r.source][1] += r.taken
        by[r.source][2] = r.target
        assert r.source_size == sum(x["size"] for x in got if x.source == r.source)
    order = sorted(by, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, full = 1.5 * sum(x[0] for x in by.values()), set()
    while True:
        level = (total - sum(2 * by[s][0] for s in full)) / max(1, sum(w for s, w in weight.items() if s not in full))
        more = {s for s in order if s not in full and level * weight[s] > 2 * by[s][0]}
        if not more:
            break
        full |= more
    for s in order:
        assert by[s][2] == pytest.approx(2 * by[s][0] if s in full else level * weight[s])
        assert abs(by[s][1] - by[s][2]) <= 1
    assert key(map(tuple, mixing.taken(df).collect())) == key(map(tuple, got))


def test_mixing_shards_are_disjoint_and_even(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', cast(id % 40 AS int))").alias("text"), F.concat(F.lit("s"), F.col("id") % 3).alias("source"))
    _, pieces = mixing.mix(docs)
    p = pieces.collect()
    per = Counter(r.shard for r in p)
    assert len(per) == 4 and sum(r.n_words for r in p) == round(1.5 * sum(i % 40 for i in range(300)))
    quota = spark.createDataFrame([(1, 1000), (2, 10), (3, 0), (4, 501)], "k bigint, quota bigint")
    s = mixing.split(quota, 3).collect()
    drawn = Counter()
    for r in s:
        drawn[r.k] += r.drawn
    assert dict(drawn) == {1: 1000, 2: 10, 3: 0, 4: 501}
    size = Counter()
    for r in s:
        size[r.shard] += r.drawn
    assert max(size.values()) - min(size.values()) <= 3


def test_mixing_is_the_same_by_broadcast_and_by_sorting(spark, monkeypatch):
    rows = lambda: key(map(tuple, mixing.taken(cases.frame(spark)).collect()))
    before = rows()
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 1)
    assert rows() == before
    monkeypatch.setattr(mixing, "MAX_BLOCK", 16)  # the smallest blocks: other pieces, the same targets
    by = defaultdict(lambda: [0, 0.0])
    for r in mixing.taken(cases.frame(spark)).collect():
        by[r.source][0] += r.taken
        by[r.source][1] = r.target
    assert all(abs(a - b) <= 1 for a, b in by.values())


def test_mixing_many_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 4)  # several chunks of sources
    want = {k: (k * 37) % 90 for k in range(1, 31)}
    s = mixing.split(spark.createDataFrame(list(want.items()), "k bigint, quota bigint"), 3).collect()
    drawn, size = Counter(), Counter()
    for r in s:
        drawn[r.k] += r.drawn
        size[r.shard] += r.drawn
        assert r.drawn >= 0 and r.before == sum(x.drawn for x in s if x.k == r.k and x.shard < r.shard)
    assert len(s) == 240 and all(drawn[k] == n for k, n in want.items())
    assert len(size) == 8 and max(size.values()) - min(size.values()) <= 3
    # each shard has about an eighth of a large source
    assert all(abs(r.drawn - want[r.k] / 8) < 14 for r in s)


def test_mixed_texts(spark):
    df = cases.frame(spark)
    mixed = mixing.with_pieces(df)
    path = new_path(spark, "mix")
    mixing.written_mix(mixed, path)
    rows = {r.doc_id: r for r in mixed.collect()}
    assert {d: t for d, t, *_ in cases.rows()} == {d: r.text for d, r in rows.items()}
    want = Counter()
    for d, r in rows.items():
        assert r.taken == sum(p.n_words for p in r.pieces) <= 2 * r["size"]
        w = cases.BLANK.findall(r.text or "")
        for p in r.pieces:
            want[p.shard, p.slot, p.place, d, tuple(w[p.first_word : p.first_word + p.n_words])] += 1
    got = spark.read.parquet(path).withColumn("file", F.input_file_name()).withColumn("nth", F.monotonically_increasing_id()).collect()
    got.sort(key=lambda r: (r.file, r.nth))
    assert Counter((r.shard, r.slot, r.place, r.doc_id, tuple(cases.BLANK.findall(r.text))) for r in got) == want
    order = [(r.shard, r.slot, r.place) for r in got]
    assert order == sorted(order) and len({r.shard for r in got}) == 4


def test_langid(spark):
    words = {"en": "the with and that house", "de": "der mit und dass haus", "fr": "le avec et que maison"}
    rows = [(i, " ".join(w.split()[(i + k * 3) % 5] for k in range(9)), lang) for i in range(60) for lang, w in words.items()]
    df = spark.createDataFrame([(3 * i + j, t, lang) for j, (i, t, lang) in enumerate(rows)], "doc_id bigint, text string, lang string")
    model = langid.learn(df)
    got = langid.predict(df, model).collect()
    assert all(r._lang == r.lang and 0 <= r._lang_score <= 1 for r in got)
    assert langid.keep_known(cases.frame(spark), model).columns == cases.frame(spark).columns
    odd = langid.predict(cases.frame(spark), model, keep=["doc_id", "text"]).collect()
    assert all((r._lang == "und") == (not any(c.isalpha() for c in r.text or "")) for r in odd)
    assert langid.predict(cases.empty(spark), model).count() == 0
    nothing = langid.learn(cases.empty(spark))
    assert {r._lang for r in langid.predict(cases.frame(spark), nothing).collect()} == {"und"}


def test_langid_learns_every_label(spark):
    # 70 languages with scripts of their own, the last with one document
    rows = [(100 * i + j, "".join(chr(0x4E00 + 64 * i + (j + 7 * k) % 60) + " " * (k % 5 == 0) for k in range(80)), f"l{i:02}") for i in range(70) for j in range(1 if i == 69 else 4)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.learn(df)
    assert len(model.languages) == 70
    assert all(r._lang == r.lang and r._lang_score > 0.5 for r in langid.predict(df, model).collect())
    assert langid.keep_known(df, model).count() == len(rows)


def test_langid_contains_all_ngrams_above_the_least_share(spark):
    # 30,000 n-grams of one language, more than the smallest filter is made for
    import random

    rng = random.Random(4)
    letters = [chr(0x4E00 + i) for i in range(12000)]
    long = "".join(rng.choices(letters, k=30000))
    model = langid.learn(spark.createDataFrame([(1, long, "zz"), (2, long, "zz"), (3, "the and of the", "en")], "doc_id bigint, text string, lang string"))
    assert model.slots.shape[1] >= 8 * 29000 and model.false_rate.max() < 0.1
    assert model.predict(pa.array([long[5000:5100]]))[0] == ["zz"] and model.predict(pa.array([long[5000:5100]]))[1][0] > 0.9


def test_langid_keeps_letters_where_nothing_is_learned(spark):
    df = cases.frame(spark).withColumn("lang", F.lit(None).cast("string"))
    kept = [r.doc_id for r in langid.keep_known(df, langid.learn(df)).collect()]
    assert sorted(kept) == sorted(d for d, t, *_ in cases.rows() if any(c.isalpha() for c in t or ""))


@both
@pytest.mark.parametrize("pass_bytes", [1 << 20, 200])
def test_decontaminate(spark, unique, pass_bytes):
    passage = " ".join(f"passage{i}" for i in range(30))
    items = [(1, passage), (2, "of, AND"), (3, None), (4, ""), (5, "12"), (2, passage[20:150]), (None, "zażółć x"), (7, "w1 " * 14)]
    b = spark.createDataFrame(items, "item_id bigint, text string")
    rows = cases.rows(unique)
    got = decontaminate.find_passages(cases.frame(spark, unique), b, pass_bytes=pass_bytes).withColumn("hit", F.expr(decontaminate.N_HIT)).collect()
    windows = defaultdict(set)
    for i, t in items:
        w = cases.WORD.findall(cases.lower(t))
        for k in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[k : k + 13])].add("null" if i is None else str(i))
    want = []
    for d, t, *_ in rows:
        w, hit, found = cases.WORD.findall(cases.lower(t)), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if owners := windows.get(tuple(w[k : k + n])):
                    found |= owners
                    hit |= set(range(k, k + n))
        want.append((d, len(w), len(hit), sorted(found)))
    assert key((r.doc_id, r._n_words, r.hit, list(r._items)) for r in got) == key(want)
    assert decontaminate.find_passages(cases.frame(spark), b.limit(0)).filter("size(_items) > 0").count() == 0
    assert decontaminate.clean_only(cases.frame(spark), b).columns == cases.frame(spark).columns


def test_decontaminate_in_blocks_of_the_default_size(spark):
    import random

    rng = random.Random(7)
    words = [f"{a}{b}{c}" for a in "bdfgklmnprst" for b in "aeiou" for c in "bdfgklmnprst"]
    items = [(i, " ".join(rng.choices(words, k=8000))) for i in range(280)]
    assert sum(len(t) for _, t in items) > decontaminate.PASS_BYTES
    docs = [(i, "x " * 50 + " ".join(items[i][1].split()[100 * i % 7000 :][:20]) + " y" * (20 if i % 2 else 800)) for i in range(0, 280, 10)] + [(1000, "nothing of it")]
    b = spark.createDataFrame(items, "item_id bigint, text string").repartition(4)
    got = {r.doc_id: (r._items, r.hit) for r in decontaminate.find_passages(spark.createDataFrame(docs, "doc_id bigint, text string"), b).withColumn("hit", F.expr(decontaminate.N_HIT)).collect()}
    assert got == {i: ([str(i)], 20) for i in range(0, 280, 10)} | {1000: ([], 0)}


@both
def test_sketch(spark, unique):
    rows = cases.rows(unique)
    got = sketch.compare_with_next(cases.frame(spark, unique), rows_at_once=7).collect()
    assert key((r.doc_id, r.n_chars) for r in got) == key((d, len(t or "")) for d, t, *_ in rows)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    if unique:
        line = sorted(((d, t or "") for d, t, *_ in rows), reverse=True)
        of = {r.doc_id: r for r in got}
        prints = defaultdict(set)
        for i, (d, t) in enumerate(line):
            after = line[(i + 1) % len(line)][1]
            edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
            assert of[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
            assert of[d].near_next == 1.0 or t != after
            prints[t].add(of[d].fingerprint)
            sets = [set(sketch.paragraphs([x.encode()])[1].tolist()) for x in (t, edited, after)]
            for near, other in ((of[d].near_edited, sets[1]), (of[d].near_next, sets[2])):
                assert near == pytest.approx(2 * len(sets[0] & other) / (len(sets[0]) + len(other)) if sets[0] or other else 1)
        assert all(len(x) == 1 for x in prints.values())
    assert sketch.compare_with_next(cases.empty(spark)).count() == 0
    one = spark.createDataFrame([(1, "a b c")], "doc_id bigint, text string")
    assert sketch.compare_with_next(one).first().near_next == 1.0


def test_ids_of_other_types_keep_their_order(spark):
    from resight.llm._spark import ordered

    for ids, kind in ((["a1", "10", "9", None, "b"], "string"), ([1.7, 1.2, -3.5, None, 1.25], "double"), (["10", "9", "9", "100", "-1"], "string")):
        rows, direct = ordered(spark.createDataFrame([(i,) for i in ids], f"id {kind}"), "id")
        got = [r.id for r in rows.orderBy("_ord").collect()]
        assert not direct and got == sorted(ids, key=lambda i: (i is not None, i))
    for kind in ("tinyint", "smallint", "int", "bigint"):
        assert ordered(spark.createDataFrame([(3,), (1,)], "id int").selectExpr(f"cast(id AS {kind}) AS id"), "id")[1]
    texts = [("10", "a b c"), ("9", "a b c"), ("x", "d e f g")]
    from resight.llm.simhash import near_duplicates

    assert sorted((r.doc_id, r.component) for r in near_duplicates(spark.createDataFrame(texts, "doc_id string, text string")).collect()) == [("10", "10"), ("9", "10"), ("x", "x")]
    got = {r.doc_id: r.labels for r in licenses.scan(spark.createDataFrame([(1.2, "all rights reserved"), (1.7, "x")], "doc_id double, text string")).collect()}
    assert got == {1.2: "reserved", 1.7: ""}


def test_sketch_peeling_recovers_all_differences():
    import numpy as np

    rng = np.random.default_rng(1)
    sets = [rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (0, 1, 5, 60, 900)]
    for x in sets:
        for y in sets:
            shared = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
            a, b = np.concatenate([x, shared]), np.concatenate([y, shared])
            pair = [(np.zeros(len(v), np.int64), v) for v in (a, b)]
            near = sketch.likeness(*pair, 1)[0]
            assert near == pytest.approx(2 * len(set(a) & set(b)) / (len(a) + len(b)))


@both
def test_licenses(spark, unique):
    rows = cases.rows(unique)
    got = licenses.scan(cases.frame(spark, unique)).collect()
    want = []
    for d, t, *_ in rows:
        w = cases.WORD.findall(cases.lower(t))
        at = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        want.append((d, len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))))
    assert key((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == key(want)
    assert any("cc-by-nc-4.0" in r.labels for r in got)
    assert licenses.scan(cases.empty(spark)).count() == 0
    assert licenses.scan(cases.frame(spark), templates=[]).filter("labels <> base_labels").count() == 0


def test_licenses_prefix_join_equals_brute_force(spark):
    import random
    import re

    rng = random.Random(2)
    words = [w for _, t in licenses.TEMPLATES for w in licenses.words_of(t)] + ["foo", "bar"]
    docs = []
    for i in range(120):
        label, t = rng.choice(licenses.TEMPLATES)
        w = [x for x in licenses.words_of(t) if rng.random() < 0.9] + rng.choices(words, k=rng.randrange(6))
        rng.shuffle(w)
        docs.append((i, " ".join(w) + rng.choice(["\n", ". ", " "]) + " ".join(rng.choices(words, k=5))))
    got = {r.doc_id: r.labels for r in licenses.scan(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    for i, t in docs:
        low = cases.lower(t)
        found = {label for p, label in licenses.PHRASES.items() if f" {p} " in f" {' '.join(licenses.words_of(t))} "}
        for b in re.split(r"\n|(?<=[.!?])[ \t]+", low):
            own = set(licenses.words_of(b))
            found |= {label for label, x in licenses.TEMPLATES if len(own & set(licenses.words_of(x))) >= math.ceil(0.8 * len(set(licenses.words_of(x))) - 1e-9)}
        placed = [(w, n, (n, m)) for n, b in enumerate(low.split("\n")) for m, c in enumerate(re.split(r"(?<=[.!?])[ \t]+", b)) for w in licenses.words_of(c)]
        for label, x in licenses.TEMPLATES:
            n, place = len(licenses.words_of(x)), 2 if re.search(licenses.BLOCK_END, x) else 1
            for k in range(max(1, len(placed) - n + 1)):
                run = placed[k : k + n]
                own = {w for w, *_ in run} & set(licenses.words_of(x))
                if run[0][place] < run[-1][place] and len(own) >= math.ceil(0.8 * len(set(licenses.words_of(x))) - 1e-9):
                    found.add(label)
        assert got[i] == ",".join(sorted(found))


def test_licenses_wrapped(spark):
    import textwrap

    marks = ["", " * ", "# ", "dnl "]
    docs = [(i, f"{i} words before\n" + textwrap.indent(textwrap.fill(t, [72, 30][i % 2]), marks[i % 4]) + "\nand words after", label) for i, (label, t) in enumerate(licenses.TEMPLATES)]
    docs += [(100 + i, "\r\n\r\n".join(t.split()), label) for i, (label, t) in enumerate(licenses.TEMPLATES)]
    docs += [(200, "all of it\nby rights of\nreserved seats", ""), (201, "Permission is hereby granted, free of charge,\nto any person " + "x " * 40 + "obtaining a copy\nof this software and associated documentation files", "")]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame([x[:2] for x in docs], "doc_id bigint, text string")).collect()}
    for i, t, label in docs:
        assert label in got[i].labels.split(","), t
        assert got[i].score == 0 if i in (200, 201) else got[i].score >= 0.8
    assert all(got[i].score == 1 for i in got if 100 <= i < 200)


def test_licenses_as_whole_texts(spark):
    import random
    import textwrap

    rng = random.Random(3)
    whole = [(label, t) for label, t in licenses.TEMPLATES if "\n" in t]
    assert len(whole) >= 6
    docs = []
    for i, (_, t) in enumerate(whole):
        docs.append((10 * i, "Before it. " + t.replace("\n", " ") + " After it."))  # on one line
        docs.append((10 * i + 1, "/*\n" + textwrap.indent(textwrap.fill(t, 60), " * ") + "\n */"))
        docs.append((10 * i + 2, " ".join(w for w in t.split() if rng.random() < 0.93)))
        docs.append((10 * i + 3, t[: len(t) // 2].replace("\n", " ")))  # half of it is not met as a whole
    got = {r.doc_id: r.labels.split(",") for r in licenses.scan(spark.createDataFrame(docs, "doc_id bigint, text string"), templates=whole).collect()}
    for i, (label, _) in enumerate(whole):
        assert all(label in got[10 * i + k] for k in (0, 1, 2)), label
        assert label not in got[10 * i + 3]


def test_licenses_fold_ascii_only(spark):
    docs = [(1, "All rights re\u017ferved"), (2, "\u212aEY OF All rights reserved"), (3, "ALL RIGHTS RESERVED")]
    got = {r.doc_id: r.labels for r in licenses.scan(spark.createDataFrame(docs, "doc_id bigint, text string"), templates=[("key", "key")]).collect()}
    assert got == {1: "", 2: "reserved", 3: "reserved"}


@both
def test_lm(spark, unique):
    rows = cases.rows(unique)
    learn = F.coalesce(F.col("doc_id") % 5 != 1, F.lit(True))
    got = lm.score(cases.frame(spark, unique), learn, rounds=1).collect()
    tokens = [(d, [*cases.BLANK.findall(cases.lower(t)), None]) for d, t, *_ in rows]
    count = Counter(x for d, w in tokens if d is None or d % 5 != 1 for x in w)
    n, v = sum(count.values()), len(count)
    want = [(d, len(w), sum(count[x] > 0 for x in w), n, round(sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 4)) for d, w in tokens]
    assert key((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == key(want)
    assert all(r.score < 0 for r in got)
    assert lm.score(cases.empty(spark), learn, rounds=1).count() == 0


def test_lm_learns_context(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.expr("array_join(transform(sequence(1, 30), i -> concat(IF(id % 2 = 0, 'aa', 'zz'), cast((id * 7 + i * i) % 13 AS string))), ' ')").alias("text"))
    r = lm.score(docs, F.col("doc_id") % 5 != 1).filter("doc_id % 5 = 1").collect()
    assert sum(x.score for x in r) > sum(x.base_score for x in r)


@pytest.mark.parametrize("share", [1e-6, 0.02])
def test_lm_score_equals_the_plain_model(spark, monkeypatch, share):
    import numpy as np

    monkeypatch.setattr(lm, "SENT_SHARE", share)  # all tokens looked up in place, or most of them by the join
    rows = cases.frame(spark).select("doc_id", F.col("doc_id").alias("_ord"), F.col("text").alias("_text"))
    train = F.col("doc_id") % 5 != 1
    learned = model, *_ = lm.learn(rows.filter(train).select("_ord", "_text"), 1)
    assert len(set(model.classes.tolist())) > 4
    got = {r.doc_id: r.score for r in lm.scores(rows, "doc_id", *learned).collect()}

    def tokens(text):
        raw = np.frombuffer((text or "").encode(), np.uint8)
        t = lm.Tokens.of(raw, np.array([0, len(raw)]), 0, 1, model.classes)
        return [*cases.BLANK.findall(cases.lower(text)), None], t.cls.tolist(), t

    count, pairs, types, seen = Counter(), Counter(), defaultdict(set), Counter()
    docs = {d: tokens(t) for d, t, *_ in cases.rows()}
    for d, (words, cls, _) in docs.items():
        if d % 5 != 1:
            for i, (w, c) in enumerate(zip(words, cls, strict=True)):
                x = cls[i - 1] if i else None
                count[w] += 1
                pairs[w, x] += 1
                types[c, x].add(w)
                seen[c, x] += 1
    kind = {w: c for words, cls, _ in docs.values() for w, c in zip(words, cls, strict=True)}
    whole = {c: sum(n for w, n in count.items() if kind[w] == c) + 0.5 * (sum(kind[w] == c for w in count) + 1) for c in range(lm.CLASSES)}
    for d, (words, cls, t) in docs.items():
        total = 0.0
        for i, (w, c) in enumerate(zip(words, cls, strict=True)):
            x = cls[i - 1] if i else None
            z = sum(model.weights[f].astype(float) for f in t.features(len(model.weights))[i])
            total += (z[c] - math.log(sum(math.exp(v) for v in z))) / math.log(10)
            a = 1 + lm.SMOOTHING * len(types[c, x])
            total += math.log10((pairs[w, x] + a * (count[w] + 0.5) / whole[c]) / (seen[c, x] + a))
        assert got[d] == pytest.approx(total, rel=1e-4, abs=1e-3)


def test_lm_gains_on_held_out_documents(spark):
    import os

    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("no tables here")
    from resight.llm.queries import op6_lm_score

    held = op6_lm_score(spark, folder).filter("held_out").agg(F.sum("n_tokens").alias("n"), F.sum("base_score").alias("base"), F.sum("score").alias("score")).first()
    assert (held.score - held.base) / held.n > 0.3  # log10 a token


def test_lm_probabilities_sum_to_one():
    import numpy as np

    rng = np.random.default_rng(0)
    w = rng.normal(size=(1 << lm.LEAST_FEATURES, lm.CLASSES)).astype(np.float32)
    text = b"one two three four"
    t = lm.Tokens.of(np.frombuffer(text, np.uint8), np.array([0, len(text)]), 0, 1, np.arange(lm.ENDINGS) % lm.CLASSES)
    total = 0
    for c in range(lm.CLASSES):
        t.cls[-1] = c
        total += math.exp(lm.class_scores(w, t)[-1])
    assert total == pytest.approx(1, abs=1e-4)
    # a class of three tokens and the unknown one, after some class
    one = np.ones((1, 1))
    m = lm.Model(None, w, None, None, None, np.array([10 + 0.5 * 4]), 6.0 * one, 9.0 * one)
    zero = np.zeros(4, np.int64)
    assert m.in_class(np.array([5, 3, 2, 0]), np.array([4, 2, 0, 0]), zero, zero).sum() == pytest.approx(1)


@pytest.mark.parametrize("segment", [16 << 10, 300])
def test_warc(spark, segment):
    rows = [(i, None if i % 7 == 0 else f"http://x/{i} a\r\n", t) for i, (_, t, *_) in enumerate(cases.rows())]
    rows += [(200, "u", "é" * 500), (201, "u", "é" * 500), (202, "u", "z" * 999), (203, "u", "z" * 999), (None, "u", "é" * 500), (204, "u", "WARC/1.1\r\n\r\n" * 200), (204, "u", "WARC/1.1\r\n\r\n" * 200), (205, "", "1\r\n0\r\n\r\n" * 400)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(4)
    path = new_path(spark, "warc")
    warc.write_archives(df, path, segment=segment)
    got = warc.read_archives(spark, path, with_payload=True).collect()
    assert {r.problem for r in got} == {None}
    body = lambda h: (h or "").encode()
    last = {}
    for i, _, h in rows:
        if len(body(h)) >= 1000:
            last[body(h)] = max(last.get(body(h), -1), -1 if i is None else i)
    want = []
    for i, _, h in rows:
        b = body(h)
        again = len(b) >= 1000 and i != last[b]
        want.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", last[b] if again else None))
    assert key((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == key(want)
    assert all(hashlib.sha1(r.payload).hexdigest() == r.payload_digest for r in got if r.record_type == "response")


def test_warc_damage_and_empty(spark):
    path = new_path(spark, "warc")
    warc.write_archives(spark.createDataFrame([], "page_id bigint, url string, html string"), path)
    assert warc.read_archives(spark, path).count() == 0
    parts = warc.page_records(1, "u", b"x" * 2000, hashlib.sha1(b"x" * 2000).hexdigest(), None, 500)
    broken = new_path(spark, "broken")
    spark.createDataFrame([(b"\r\n\r\n".join(parts[:2] + parts[3:]).decode(),)], "value string").coalesce(1).write.text(broken)
    r = warc.read_archives(spark, broken).first()
    assert (r.page_id, r.problem, r.payload_digest) == (1, "segments", None)
    assert warc.dechunked(b"5;x=1\r\nhello\r\n0\r\n\r\n") == b"hello" and warc.dechunked(b"5\r\nhell") is None and warc.dechunked(b"zz\r\n") is None


def test_warc_reads_foreign_and_damaged_archives(spark):
    import base64
    import gzip

    def record(kind, name, block, *fields, length=None):
        head = [f"WARC-Type: {kind}", f"WARC-Record-ID: {name}", *fields, f"Content-Length: {len(block) if length is None else length}"]
        return ("WARC/1.0\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"

    body = b"<p>hello</p>"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + body
    sha1, sha256, md5 = (hashlib.new(k, body) for k in ("sha1", "sha256", "md5"))
    good = [
        record("response", "<urn:uuid:1>", http),
        record("response", "<urn:uuid:2>", http, "WARC-Payload-Digest: sha1:" + base64.b32encode(sha1.digest()).decode()),
        record("response", "<urn:uuid:3>", http, "WARC-Payload-Digest: sha256:" + sha256.hexdigest()),
        record("response", "<urn:uuid:4>", http, "WARC-Payload-Digest: md5:" + md5.hexdigest()),
        record("response", "<urn:uuid:5>", http, "WARC-Payload-Digest: crc:77"),
        record("request", "<urn:uuid:6>", b"GET / HTTP/1.1\r\n\r\n"),
        record("revisit", "<urn:uuid:7>", b"HTTP/1.1 200 OK\r\n\r\n", "WARC-Refers-To: <urn:uuid:1>", "WARC-Payload-Digest: md5:xyz"),
    ]
    bad = [
        b"this line is no record\r\n\r\n",
        record("response", "<urn:uuid:10>", http, "WARC-Payload-Digest: sha1:no-base32!"),
        record("response", "<urn:uuid:11>", http, length="many"),
        record("response", "<urn:uuid:12>", http, length=-5),
        record("response", "<urn:uuid:13>", http, "WARC-Segment-Number: one"),
        record("continuation", "<urn:uuid:14>", http, "WARC-Segment-Number: 2"),
        record("response", "<urn:uuid:15>", b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\nzz\r\n"),
        b"WARC/1.0\r\nWARC-Type: response\r\n\r\n",
        record("response", "<urn:uuid:16>", http),
        record("response", "<urn:uuid:17>", http, length=10**9),
    ]
    import os
    import tempfile

    folder = tempfile.mkdtemp(prefix="spark-")  # local mode: the files stand for another tool's archives
    zipped = b"".join(gzip.compress(x) for x in good)
    for name, data in {"a.warc": b"".join(good[:4] + bad), "b.warc.gz": zipped, "c.warc.gz": zipped[:-30], "d.warc": b"", "e.warc": b"\x1f\x8bno gzip"}.items():
        with open(os.path.join(folder, name), "wb") as f:
            f.write(data)
    got = warc.read_archives(spark, f"file://{folder}").collect()
    fine = {r.record_id: r for r in got if r.problem is None}
    assert {r.record_id for r in got if r.problem is None} == {f"<urn:uuid:{i}>" for i in (1, 2, 3, 4, 5, 7, 16)}
    assert all((r.payload_bytes, r.payload_digest) == (len(body), sha1.hexdigest()) for r in fine.values() if r.record_type == "response")
    assert {r.page_id for r in got} == {None}
    problems = Counter(r.problem for r in got if r.problem)
    assert problems == {"record": 8, "digest": 1, "framing": 1, "gzip": 2}


@both
def test_pii_base(spark, unique):
    import re

    patterns = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]

    def fits(k, s):
        digits = re.sub("[^0-9]", "", s)
        return k == 0 or k == 1 and all(int(p) <= 255 for p in s.split(".")) or k == 2 and 12 <= len(digits) <= 19 and pii.luhn(digits) or k == 3 and 9 <= len(digits) <= 15

    rows = cases.rows(unique)
    got = pii.find(cases.frame(spark, unique)).collect()
    want = []
    for d, t, *_ in rows:
        found = sorted((m.start(), k, m.end()) for k, p in enumerate(patterns) for m in re.finditer(p, t or "") if fits(k, m[0]))
        text = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in found)
        want.append((d, [sum(k == j for _, k, _ in found) for j in range(4)], hashlib.sha256(text.encode()).hexdigest()))
    assert key((r.doc_id, list(r._counts), r._base_sha256) for r in got) == key(want)
    assert all(set(filter(None, r._base.split(","))) <= set(r._all.split(",")) for r in got)
    assert pii.find(cases.empty(spark)).count() == 0
    hidden = {r.doc_id: r.text for r in pii.mask_text(cases.frame(spark)).collect()}
    assert any("<EMAIL> or <EMAIL>" in (t or "") for t in hidden.values()) and any(t is None for t in hidden.values())


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("write to jo.doe (at) mail {dot} example [dot] com!", "jo.doe (at) mail {dot} example [dot] com"),
        ("jo at mail dot example dot com", "jo at mail dot example dot com"),
        ("jоhn@exаmple.cоm", "jоhn@exаmple.cоm"),
        ("jo​@mail.com", "jo​@mail.com"),
        ("host one nine two dot one six eight dot zero dot one", "one nine two dot one six eight dot zero dot one"),
        ("call plus one five five five two three four five six seven", "plus one five five five two three four five six seven"),
        ("card ４１１１ １１１１ １１１１ １１１１", "４１１１ １１１１ １１１１ １１１１"),
        ("ask jo@example dot com now", "jo@example dot com"),
        ("ask jo (at) mail dot com now", "jo (at) mail dot com"),
        ("ask jo at mail (dot) com now", "jo at mail (dot) com"),
        ("ask jo at mail.example dot com now", "jo at mail.example dot com"),
        ("ask jo [at] mail.example.com now", "jo [at] mail.example.com"),
        ("j\u200bo \u200b(at) mai\u200bl dot co\u200bm", "j\u200bo \u200b(at) mai\u200bl dot co\u200bm"),
    ],
)
def test_pii_disguises(text, found):
    spans = pii.disguised_spans(text, pii.plain_spans(text))
    assert found in [text[s:e] for s, _, e in spans]


@pytest.mark.parametrize("text", ["we arrived at node.js", "look at example.com", "sit at a dot", "at (at) at", "one dot", "1 (dot)", "Слово и дело"])
def test_pii_leaves_plain_prose(text):
    assert pii.disguised_spans(text, pii.plain_spans(text)) == []


def test_pii_takes_long_runs_and_many_identifiers():
    import time

    blank = " " * 1_000_000
    many = " ".join(f"user{i}@mail{i}.example.com" for i in range(100_000))
    odd = [blank + "\u00a0" + blank, many + "\u00a0", "(" * 300_000 + "\u00a0", "[ " * 300_000 + "\u00a0", "one " * 100_000 + "\u00a0", "a at " * 100_000 + "\u00a0", "a" * 500_000 + "\u00a0", "я" * 1_000_000, "1 - " * 200_000 + "\u00a0"]
    for text in odd:
        began = time.process_time()
        plain = pii.plain_spans(text)
        more = pii.disguised_spans(text, plain)
        assert time.process_time() - began < 6, text[:20]  # a quadratic step takes minutes
        assert len(plain) == (100_000 if text.startswith("user") else 0) and not more


def test_pii_normal_form_maps_back(spark):
    import random

    rng = random.Random(6)
    bits = ["bob", " ", "(at)", " [dot] ", "com", "\u200b", "а", "４", "one two", " at ", " dot ", "@", ".", "plus one", "7", "\u00a0", "é", "\n"]
    for _ in range(3000):
        text = "".join(rng.choices(bits, k=rng.randrange(1, 14)))
        normal, out, seen = pii.normal_form(text)
        last = 0
        for i in range(len(normal)):
            lo, hi = seen.start(out.start(i)), seen.end(out.end(i) - 1)
            assert last <= lo < hi <= len(text) or lo < hi  # a written piece stands for all of its range
            if text[lo:hi] == normal[i]:
                assert hi == lo + 1
            last = lo


@pytest.mark.parametrize(("unique", "most"), [(True, 20_000), (True, 1), (False, 20_000)])
def test_repeats(spark, unique, most):
    rows = cases.rows(unique)
    got = repeats.remove_repeats(cases.frame(spark, unique), most=most).collect()
    assert key((r.doc_id, r.n_bytes) for r in got) == key((d, len((t or "").encode())) for d, t, *_ in rows)
    if unique:
        seen = set()
        of = {r.doc_id: r for r in got}
        for d, t, *_ in sorted(rows):
            b = (t or "").encode()
            gone = bytearray(len(b))
            for i in range(len(b) - 99):
                s = b[i : i + 100]
                if s in seen:
                    gone[i : i + 100] = b"\1" * 100
                seen.add(s)
            kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
            spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
            assert (of[d].n_removed, of[d].n_spans, of[d].kept_sha256) == (sum(gone), spans, hashlib.sha256(kept).hexdigest()), d
    assert repeats.remove_repeats(cases.empty(spark)).count() == 0


def test_suffix_order_is_sorted():
    import numpy as np

    rng = np.random.default_rng(3)
    for alphabet in (2, 3, 200):
        text = rng.integers(0, alphabet, 3000).astype(np.uint8)
        text[500:900] = 7
        text[1500:1900] = text[100:500]
        wanted = np.unique(rng.integers(0, 2800, 900))
        order = repeats.suffix_order(text, wanted, 100)
        raw = text.tobytes() + bytes(300)
        strings = [raw[i : i + 100] for i in order.tolist()]
        assert strings == sorted(strings) and set(wanted.tolist()) <= set(order.tolist())


def test_repeats_of_a_hot_line_in_different_contexts(spark):
    line = "a line that very many documents hold between words of their own, and that is longer than a hundred bytes, by some"
    docs = [(i, f"{i * 7919 % 1009} begins {i} " * 4 + line + f" {i * 31 % 997} ends {i}" * 4) for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {m: {r.doc_id: tuple(r) for r in repeats.remove_repeats(df, most=m).collect()} for m in (20_000, 20)}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    seen = set()
    for d, t in docs:
        b = t.encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 99):
            if b[i : i + 100] in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(b[i : i + 100])
        kept = hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()
        for m in got:
            assert (got[m][d][2], got[m][d][4]) == (sum(gone), kept), (m, d)


def test_repeats_hold_a_hot_string_once(monkeypatch):
    import numpy as np
    import pyarrow as pa

    # equal strings: one is held
    sizes, real = [], repeats._repeats
    monkeypatch.setattr(repeats, "_repeats", lambda parts, *a: (sizes.append(len(parts)), real(parts, *a))[1])
    batch = lambda n: pa.RecordBatch.from_arrays([pa.array([5] * 100), pa.array(range(100 * n, 100 * n + 100)), pa.array([3] * 100), pa.array([bytes(range(100))] * 100)], names=["key", "_ord", "place", "bytes"])
    out = [x for b in repeats._compare(100)(batch(n) for n in range(50)) for x in b.column("_ord").to_pylist()]
    assert sorted(out) == list(range(1, 5000)) and max(sizes) == 1
    # of a batch, one goes on with its bytes
    text = "x" * 20 + "".join(map(chr, range(33, 126))) + "y" * 20
    need = [[{"key": 1, "at": (20 << 8) | (1 << 1), "kind": repeats._SPLIT}]] * 50
    cut = next(repeats._cut_out(93)(iter([pa.RecordBatch.from_arrays([pa.array(range(50, 0, -1)), pa.array([text] * 50), pa.array(need)], names=["_ord", "_text", "need"])])))
    assert [o for o, x in zip(cut.column("_ord").to_pylist(), cut.column("bytes").to_pylist(), strict=True) if x] == [1]
    assert len(set(cut.column("key").to_pylist())) == 50
    # stretches of a hot key go on before the key ends
    taken = []
    def batches():
        for n in range(20):
            taken.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(100, 9)), pa.array(np.arange(100) % 60 + 100 * n + 1), pa.array(np.arange(100) + 100 * n), pa.array(np.full(100, 2))], names=["key", "whole", "_ord", "at"])
    settled = [(len(taken), b) for b in repeats._settle(batches(), 150)]
    kinds = [k for _, b in settled for k in b.column("kind").to_pylist()]
    assert kinds.count(repeats._SPLIT) == 1200 and kinds.count(repeats._REPEAT) == 800
    assert next(n for n, b in settled if repeats._SPLIT in b.column("kind").to_pylist()) == 3

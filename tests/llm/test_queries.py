"""The registered queries of the operators, on the smallest tables: against SQL where there is any, else against plain rules."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from resight.llm import pii
from resight.llm.oracles import ORACLES
from resight.llm.queries import QUERIES

from . import cases
from .test_simhash import groups

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
COLUMNS = {
    "op1_mix_sources": "doc_id size source_size target taken",
    "op2_language_id": "doc_id held_out lang_pred score",
    "op3_decontaminate": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op4_fingerprints": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op5_licenses": "doc_id n_words n_base first_word last_word base_labels labels score",
    "op6_lm_score": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op7_warc": "page_id payload_bytes payload_digest record_type refers_to",
    "op8_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op9_remove_repeats": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op10_simhash_near_dedup": "doc_id fingerprint component_id",
    "op11_source_divergence": "lang source part item value rank",
    "op12_embedding_near_dedup": "vec_id n_links component_id kept",
    "op13_tokenizer_alignment": "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256",
}


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


def result(spark, name):
    df = QUERIES[name](spark, DATA)
    assert set(COLUMNS[name].split()) <= set(df.columns)
    return df.collect()


def held_out(doc_id, by):
    return zlib.crc32(str(doc_id).encode()) % by == 1


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    names = sorted(COLUMNS[name].split())
    key = lambda rows: sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows), key=repr)
    want = c.execute(f"SELECT {', '.join(names)} FROM ({ORACLES[name]})").fetchall()
    assert key(tuple(r[n] for n in names) for r in result(spark, name)) == key(want)


def test_mix(spark, docs):
    got = result(spark, "op1_mix_sources")
    assert {r.doc_id: r["size"] for r in got} == {d: len(cases.BLANK.findall(r.text or "")) for d, r in docs.items()}
    by = defaultdict(lambda: [0, 0.0])
    for r in got:
        assert r.taken <= 2 * r["size"] and (r.pieces > 0) == (r.taken > 0) and r.shards <= r.pieces
        by[r.source][0] += r.taken
        by[r.source][1] = r.target
    assert all(abs(a - b) <= 1 for a, b in by.values())
    assert len({r.shards for r in got}) > 1


def test_languages(spark, docs):
    got = result(spark, "op2_language_id")
    assert len(got) == len(docs) and all(r.held_out == held_out(r.doc_id, 3) and 0 <= r.score <= 1 for r in got)
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in docs[r.doc_id].text or "")) for r in got)
    asked = [r for r in got if r.held_out and docs[r.doc_id].lang]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in asked) / len(asked) > 0.95


def test_fingerprints(spark, docs):
    got = {r.doc_id: r for r in result(spark, "op4_fingerprints")}
    line, of = sorted(docs, reverse=True), defaultdict(set)
    for i, d in enumerate(line):
        t, after = docs[d].text or "", docs[line[(i + 1) % len(line)]].text or ""
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        assert (got[d].n_chars, got[d].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        of[t].add(got[d].fingerprint)
    assert all(len(x) == 1 for x in of.values()) and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got.values())


def test_scores(spark, docs):
    got = {r.doc_id: r for r in result(spark, "op6_lm_score")}
    words = {d: [*cases.BLANK.findall(cases.lower(r.text)), None] for d, r in docs.items()}
    count = Counter(w for d in docs if not held_out(d, 5) for w in words[d])
    n, v = sum(count.values()), len(count)
    for d, w in words.items():
        r = got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held_out(d, 5), len(w), sum(x in count for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w))


def test_personal_data(spark, docs):
    got = {r.doc_id: r for r in result(spark, "op8_pii")}
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def fits(kind, s):
        digits = re.sub("[^0-9]", "", s)
        if kind == "ip":
            return all(int(p) <= 255 for p in s.split("."))
        return kind == "email" or (12 <= len(digits) <= 19 and pii.luhn(digits) if kind == "card" else 9 <= len(digits) <= 15)

    for d, r in docs.items():
        found = sorted((m.start(), i, f"{k}:{m.start()}:{m.end()}") for i, (k, p) in enumerate(patterns.items()) for m in re.finditer(p, r.text or "") if fits(k, m[0]))
        base = [x for *_, x in found]
        assert got[d].base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [got[d][f"n_{k}"] for k in patterns] == [sum(x.startswith(k) for x in base) for k in patterns]
        assert set(base) <= set(got[d].spans.split(",")) | {""}


def test_near_duplicates(spark, docs):
    got = sorted((r.doc_id, int(r.fingerprint, 16), r.component_id) for r in result(spark, "op10_simhash_near_dedup"))
    assert got == groups([(d, r.text) for d, r in docs.items()])


def test_near_duplicate_embeddings(spark):
    from .test_neighbours import plain

    got = sorted((r.vec_id, r.n_links, r.component_id) for r in result(spark, "op12_embedding_near_dedup"))
    assert got == plain([(r.vec_id, r.embedding) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()])


def test_alignments(spark, docs):
    from .test_alignment import FILES, plain

    if not all(map(os.path.exists, FILES)):
        pytest.skip("no vocabulary files here")
    names = COLUMNS["op13_tokenizer_alignment"].split()
    some = sorted(docs)
    got = sorted(tuple(r[n] for n in names) for r in result(spark, "op13_tokenizer_alignment"))
    assert got == plain([(d, docs[d].text) for d in some])

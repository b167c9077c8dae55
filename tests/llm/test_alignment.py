"""Cross-tokenizer alignment against the files' own tokenizers and sets of offsets."""

import hashlib
import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from resight.llm import alignment
from resight.llm.queries import TOKENIZERS

from . import cases

FILES = (f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model")
needs_files = pytest.mark.skipif(not all(map(os.path.exists, FILES)), reason="no vocabulary files here")


def ends(sizes):
    return np.cumsum(np.array(sizes, np.int64))


def by_sets(a, b):
    common = sorted(set(a) & set(b))
    cuts = sorted(set(a) | set(b))
    return [a.index(x) + 1 for x in common], [b.index(x) + 1 for x in common], [next(i for i, e in enumerate(a) if e >= x) for x in cuts], [next(i for i, e in enumerate(b) if e >= x) for x in cuts]


@pytest.mark.parametrize("seed", range(30))
def test_runs_and_groups(seed):
    rng = random.Random(seed)
    same = [rng.randint(1, 3) for _ in range(rng.choice([0, 3, 70]))]
    total = rng.randint(1, 40)

    def split():
        cuts = [0, *sorted(rng.sample(range(1, total), rng.randint(0, total - 1))), total]
        return [y - x for x, y in zip(cuts, cuts[1:], strict=False)]

    a, b = [*same, *split(), *same, *split()], [*same, *split(), *same, *split()]
    got = [x.tolist() for x in alignment.align(ends(a), ends(b))]
    assert got == list(by_sets(ends(a).tolist(), ends(b).tolist()))
    lanes = alignment.lanes(ends(a), ends(b), 3)
    assert [x.tolist() for x in alignment.align(ends(a), ends(b), lanes)] == got


def test_nothing_to_align():
    none = np.zeros(0, np.int64)
    assert [x.tolist() for x in alignment.align(none, none)] == [[], [], [], []] == [x.tolist() for x in alignment.align(none, none, alignment.lanes(none, none))]


def plain(rows):
    """The result rows by doc_id, from the files' own tokenizers, each text encoded whole."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(FILES[0]), sentencepiece.SentencePieceProcessor(model_file=FILES[1])
    a.encode_special_tokens = True
    plain_bytes = alignment.byte_level()
    piece = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    out, held = {}, Counter()
    for k, (doc_id, text) in enumerate(rows):
        x, y = a.encode(" " + (text or ""), add_special_tokens=False).ids, b.encode(text or "")
        of_x, of_y = [bytes(plain_bytes[c] for c in a.id_to_token(i)) for i in x], [piece(i) for i in y]
        if not text or not b"".join(of_x) == b"".join(of_y) == (" " + text).encode():
            out[k] = (doc_id, 0, 0, [], [], "")
            continue
        ga, gb, la, lb = by_sets(ends(list(map(len, of_x))).tolist(), ends(list(map(len, of_y))).tolist())
        said = ";".join(",".join(map(str, x[i:j])) + "|" + ",".join(map(str, y[m:n])) for i, j, m, n in zip([0, *ga], ga, [0, *gb], gb, strict=False))
        links = [(x[i], y[j]) for i, j in zip(la, lb, strict=True)]
        held.update(set(links))
        out[k] = (doc_id, len(x), len(y), ga, links, hashlib.sha256(said.encode()).hexdigest())
    most = defaultdict(int)
    for (i, _), n in held.items():
        most[i] = max(most[i], n)
    return sorted((d, na, nb, len(g), len(links), sum(held[p] == most[p[0]] for p in links), sum(held[p] for p in links), said) for d, na, nb, g, links, said in out.values())


TEXTS = [
    "The quick brown fox", "the the the", " leading", "trailing ", "two  spaces   and more", "line\nbreaks\r\n and \ttabs ", "<|endoftext|> and <s> </s> <unk> <0x41>", "▁ marks ▁▁ a▁b", "\x00 nul", "naïve Straße 東京 zażółć \U0001f680\U0001f680",
    "don't can't I'm we've 1234567 3.14", "", None, " ", "\n", "a", "é ﬁ ﬀ ½ Ａ　Ｂ  nbsp ​ zw", "x" * 300, "=" * 100 + " " * 40 + "end", "﻿bom", "word " * 50, "thinghes onrest ndessh erhendon. " * 20,
]


@needs_files
def test_as_encoded_whole(spark):
    rows = list(enumerate(TEXTS * 2 + cases.texts()[:-3]))
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id bigint, text string, pairs string, row int").repartition(3)
    got = sorted(tuple(r) for r in alignment.compare(df, *FILES).collect())
    assert got == plain(rows)


@needs_files
def test_rare_pairs_are_joined(spark, monkeypatch):
    monkeypatch.setattr(alignment, "SENT_PAIRS", 3)
    rows = [(i // 2 if i > 2 else None, t) for i, t in enumerate(TEXTS)]
    got = [tuple(r) for r in alignment.compare(spark.createDataFrame(rows, "doc_id int, text string"), *FILES).collect()]
    assert sorted(got, key=repr) == sorted(plain_any(rows), key=repr)


def plain_any(rows):
    numbered = plain([(k, t) for k, (_, t) in enumerate(rows)])
    return [(rows[r[0]][0], *r[1:]) for r in numbered]


@needs_files
def test_known_words_are_forgotten(monkeypatch):
    monkeypatch.setattr(alignment, "_KEPT_WORDS", 5)
    pair = alignment.Pair(*FILES)
    texts = [t or "" for t in TEXTS]
    fresh = [alignment.align_texts([t], alignment.Pair(*FILES))["groups_sha256"][0] for t in texts[:12]]
    assert [alignment.align_texts([t], pair)["groups_sha256"][0] for t in texts[:12]] == fresh
    assert alignment.align_texts(texts[:12], pair)["groups_sha256"] == fresh


@needs_files
def test_no_piece_spans_a_cut():
    pair = alignment.Pair(*FILES)
    assert not any("▁" in p.lstrip("▁") for p in pair.b.id_to_piece(list(range(pair.b.get_piece_size()))))
    assert not any(re.search(rb"[!-~] [!-~]", x) for x in pair.bytes_of[0])


@needs_files
def test_empty_table(spark):
    assert alignment.compare(spark.createDataFrame([], cases.SCHEMA), *FILES).collect() == []

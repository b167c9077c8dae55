"""Documents of every awkward kind, and plain rules to hold operators against."""

import random
import re

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size int, target string, _fp string, at int, h string, n bigint, _lang string, _n_words string, _masked int, _row string, _text string, _ord int, doc string"
BLANK = re.compile(r"[^\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def texts():
    rng = random.Random(11)
    words = "the of and licence thésaurus Straße naïve 12 ÅNGSTRÖM x cc by zażółć 東京 \U0001f680 data the-word a1b2".split() + [f"w{i}" for i in range(80)]
    base = [" ".join(rng.choices(words, k=rng.choice([3, 12, 40, 150]))) for _ in range(24)]
    passage = " ".join(f"passage{i}" for i in range(30))
    out = [*base, *(b + " " + passage for b in base[:5]), *(b[: len(b) // 2] + passage.upper() + b[len(b) // 2 :] for b in base[5:8])]
    out += [base[3], base[3], base[3].replace(" ", "\n"), "-" * 500, "ab" * 300, None, "", " \n\t", "123 456", "word", "\x00 nul \x00 byte", "long " * 20000]
    out += ["Mail bob@mail.example.com or eve [at] mail [dot] example [dot] org", "IP 10.0.0.256 and 10.0.0.25, card 4111 1111 1111 1111, phone +1 (555) 123-4567", "CC BY-NC 4.0. Licensed under CC BY NC 4.0\nAll rights reserved."]
    return out


def rows(unique=True):
    t = texts()
    ids = list(range(100, 100 + 3 * len(t), 3)) if unique else [None if i == 4 else 7 * (i // 2) for i in range(len(t))]
    random.Random(5).shuffle(ids)
    return [(d, x, [None, "en", "fr"][i % 3], [None, "a", "b", "B", "ä"][i % 5], len(x or ""), 1, "t", "f", 2, "h", 3, "l", "n", 4, "r", "x", 5, "d") for i, (d, x) in enumerate(zip(ids, t, strict=True))]


def frame(spark, unique=True):
    return spark.createDataFrame(rows(unique), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)

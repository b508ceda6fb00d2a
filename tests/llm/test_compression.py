"""Compression bands (operator 12) against a plain version."""

import base64
import random
import re
from collections import Counter

import zstandard

from sightings.llm import compression as C
from tests.llm.util import by_id, docs

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    hit = {j for i, w in enumerate(windows) if times[w] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    rep = len(hit)
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, rep,
            len(words) < 50 or 100 * rep > 50 * len(words)]


def verdict(text):
    raw, press = (text or "").encode(), zstandard.ZstdCompressor(level=3)

    def outside(b):
        if len(b) < 128:
            return False
        low, high = next((lo, hi) for end, lo, hi in C.BANDS if len(b) < end)
        return not low <= len(press.compress(b)) / len(b) <= high

    parts = [raw[i:i + 4096] for i in range(0, len(raw), 4096)]
    return not outside(raw) and sum(len(p) for p in parts if outside(p)) <= 0.25 * len(raw)


def prose(n, seed=1):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 8))) for _ in range(900)]
    return " ".join(rng.choices(vocabulary, [1 / (i + 1) for i in range(900)], k=n))


def test_rows_against_brute_force(spark):
    rng = random.Random(7)
    noise = base64.b64encode(rng.randbytes(9000)).decode()
    texts = [None, "", " \n\t", "a", "a b c", "a b c a b c", "x\x1cy z", "línea ñ\nlínea ñ\n\n \nlínea ñ ", "## $ <b> | * % &",
             "a a a a a", "w " * 300, prose(60), prose(400), prose(1500, 2), prose(300).replace(" ", "\n"),
             " ".join(noise[i:i + 40] for i in range(0, 8000, 40)), prose(1200, 3) + "\n" + noise * 2,
             "😀 " * 60, prose(80) + "\n" + prose(80), "\x00 \x85   b"]
    got = by_id(C.op12(docs(spark, [*enumerate(texts)])))
    for i, t in enumerate(texts):
        want = brute(t)
        assert [got[i][c] for c in BASE] == want, (i, t and t[:40])
        assert got[i]["kept"] == (not want[-1] and verdict(t)), (i, t and t[:40])
    assert got[13]["kept"] and not got[15]["kept"] and not got[15]["base_failed"] and not got[16]["kept"]


def test_repetitive_text_that_the_base_rules_pass(spark):
    # the same long sentence with one word changed each time: windows repeat in less than half of the words
    body = prose(4, 5).split()
    text = " ".join(f"{body[0]}{i % 7} {body[1]}{i % 11}" for i in range(3000))
    got = by_id(C.op12(docs(spark, [(1, text), (2, prose(3000))])))
    assert got[1]["ratio"] < 0.15 and not got[1]["kept"] and got[2]["kept"]


def test_limits_follow_length():
    assert C.in_band(127, 9.0) and not C.in_band(128, 1.2) and C.in_band(200, 1.0) and not C.in_band(4000, 0.8)
    assert not C.in_band(1 << 30, 0.1)


def test_odd_tables(spark):
    assert C.op12(docs(spark, [(1, "x")]).filter("false")).collect() == []
    twice = C.op12(docs(spark, [(1, prose(60)), (1, prose(60)), (None, None)])).collect()
    assert len(twice) == 3
    wide = docs(spark, [(1, prose(60))]).selectExpr("*", "1 as kept", "'a' as ratio", "2 as n_words")
    assert C.op12(wide).count() == 1 and C.quality_rules(wide).first().n_words == 60


def test_many_different_words():
    words = [b"%d" % i for i in range(1 << 21)]
    assert C.repeated_words(words + [b"1", b"2", b"3"]) == 6

"""Cross-tokenizer alignment (operator 13) against a version that goes token by token."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest

from sightings.llm import alignment as A
from tests.llm.util import docs

NUMBERS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def load():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A.TOKENIZER_A)
    a.encode_special_tokens = True
    letters = A.byte_letters()
    b = sentencepiece.SentencePieceProcessor(model_file=A.TOKENIZER_B)

    def tokens_a(text):
        ids = a.encode(" " + text, add_special_tokens=False).ids
        return [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in ids]

    def tokens_b(text):
        out = []
        for i in b.encode(text):
            p = b.id_to_piece(i)
            out.append((i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()))
        return out

    return tokens_a, tokens_b


@pytest.fixture(scope="module")
def tokenizers():
    return load()


def ranges(tokens):
    out, at = [], 0
    for i, raw in tokens:
        out.append((i, at, at + len(raw)))
        at += len(raw)
    return out


def brute(rows, tokenizers):
    """rows: (doc_id, text); one dict of measures a row."""
    found, counts = [], Counter()
    for _, text in rows:
        a, b = [], []
        if text:
            a, b = (t(text) for t in tokenizers)
            want = (" " + text).encode()
            if b"".join(x for _, x in a) != want or b"".join(x for _, x in b) != want:
                a, b = [], []
        ra, rb = ranges(a), ranges(b)
        links = []
        j = 0
        for i, lo, hi in ra:
            while j < len(rb) and rb[j][2] <= lo:
                j += 1
            k = j
            while k < len(rb) and rb[k][1] < hi:
                links.append((i, rb[k][0]))
                k += 1
        counts.update(links)
        ends = sorted({x[2] for x in ra} & {x[2] for x in rb})
        ga, gb = defaultdict(list), defaultdict(list)
        for r, g in ((ra, ga), (rb, gb)):
            k = 0
            for i, _, hi in r:
                while ends[k] < hi:
                    k += 1
                g[k].append(str(i))
        line = ";".join(",".join(ga[k]) + "|" + ",".join(gb[k]) for k in range(len(ends)))
        found.append((len(a), len(b), len(ends), links, hashlib.sha256(line.encode()).hexdigest() if ends else ""))
    most = Counter()
    for (_, y), c in counts.items():
        most[y] = max(most[y], c)
    return sorted((str(d), n_a, n_b, g, len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), sha)
                  for (d, _), (n_a, n_b, g, links, sha) in zip(rows, found)), counts


def result(df):
    return sorted((str(r.doc_id), *(r[c] for c in NUMBERS), r.groups_sha256) for r in df.collect())


ODD = [None, "", " ", "  ", "a", "\n", " the", "the ", "the  end", "▁", "x▁y", "<s> </s> <unk> <|endoftext|> <0x41>", "don't 's they'll'",
       "\x00\x01\x7f", "ﬁne ﬀ Å é é", "日本語のテキスト and then more", "😀😡 emoji 👨‍👩‍👧", "été à la façon. Où? Là!", "a b c",
       "1 2 33 444 5555, 6.7 8!", "tab\tand\r\nnew\n\n\nlines ", "word " * 50, "aaaa" * 500, " . , ; lead", "A. B. C d e f g",
       "ǅ Ⅷ ½ ² x². y", "नमस्ते दुनिया", "Ünïcödé wörds. Größe; straße", "﻿bom", "​zero width", "end.  Two. \tThree"]


def test_odd_texts(spark, tokenizers):
    rows = [*enumerate(ODD), (100, ODD[17]), (100, ODD[17]), (None, ODD[4])]
    want, counts = brute(rows, tokenizers)
    got, pairs = A.align(docs(spark, rows))
    assert result(got) == want
    assert {(r.id_a, r.id_b): r.links for r in pairs.collect()} == counts


def test_random_texts_in_small_chunks(spark, tokenizers):
    rng = random.Random(5)
    words = ["the", "naïve", "of", "ab", "Zürich", "x1", "42", "don't", "...", "e", "ñandú", "straße", "日本", "Hello"]
    glue = [" ", " ", " ", " ", "  ", "\n", ", ", ". ", "; ", "-", "\t", "'", " (", ") "]
    rows = [(i, "".join(rng.choice(words) + rng.choice(glue) for _ in range(rng.randint(1, 60)))) for i in range(120)]
    rows += [(1000 + i, t) for i, t in rows[:30] for _ in range(3)]
    want, _ = brute(rows, tokenizers)
    assert result(A.align(docs(spark, rows), chunk_bytes=500)[0]) == want
    assert result(A.align(docs(spark, rows))[0]) == want


def test_long_text(spark, tokenizers):
    rng = random.Random(6)
    text = " ".join("".join(rng.choices("etaoin shrdlu.,É", k=rng.randint(1, 9))) for _ in range(40_000))
    rows = [(1, text), (2, "x" * 30_000), (3, text)]
    assert result(A.op13(docs(spark, rows))) == brute(rows, tokenizers)[0]


def test_no_cutting_with_other_models(spark, tokenizers):
    pair = A.Pair(A.read_model(A.TOKENIZER_A), A.read_model(A.TOKENIZER_B))
    assert pair.joins
    texts = [t for t in ODD if t]
    ids_a, n_a, ids_b, n_b, ok = pair.encode(texts, 0)  # one by one
    assert [pair.by_rank.encode_ordinary(" " + t) for t in texts] == [pair.a.encode(" " + t, add_special_tokens=False).ids for t in texts]
    pair.bytes_b = [*pair.bytes_b, b"a b"]
    assert not pair.joins


def test_odd_tables(spark):
    assert A.op13(docs(spark, [(1, "x")]).filter("false")).collect() == []
    none = A.op13(docs(spark, [(1, None), (2, "")])).collect()
    assert sorted((r.doc_id, *(r[c] for c in NUMBERS), r.groups_sha256) for r in none) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]
    wide = docs(spark, [(1, "a b")]).selectExpr("*", "1 as digest", "2 as n_a", "3 as pair", "4 as multiplicity", "5 as chunk")
    assert A.op13(wide).first().n_a == 2


def test_size_of_tokenizers_is_checked(monkeypatch):
    monkeypatch.setattr(A, "MODEL_BYTES", 1000)
    with pytest.raises(ValueError):
        A.read_model(A.TOKENIZER_A)

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from rivernet.llm import suffix_dedup

SF = "/root/testdata/sf0.001"


def brute(texts, length, stretch=suffix_dedup.STRETCH):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    holders = Counter(s for t in set(texts) for s in {t[i : i + stretch] for i in range(len(t) - stretch + 1)})
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((len(t), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest(), any(holders[t[i : i + stretch]] > 1 for i in range(len(t) - stretch + 1))))
    return out


def check(spark, texts):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.remove_repeats(docs).collect()}
    want = brute([(t or "").encode() for t in texts], suffix_dedup.LENGTH)
    assert got == dict(enumerate(want))


def test_null_and_repeated_ids_and_further_columns(spark):
    rows = [(None, "p" * 500, 1, 2), (7, "q" + "p" * 450, 3, 4), (7, None, 5, 6), (None, "", 7, 8), (9, "short", 9, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, mark long, name long")
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.shared, bytes(r.kept)) for r in suffix_dedup.remove_repeats(docs, with_text=True).collect())
    assert got == Counter([(None, 500, 500, True, b""), (7, 451, 450, True, b"q"), (7, 0, 0, False, b""), (None, 0, 0, False, b""), (9, 5, 0, False, b"short")])


def test_passages_of_fifty_words_between_texts(spark):
    rng = random.Random(5)
    words = lambda n: " ".join("".join(rng.choices("abcdefgh", k=rng.randint(3, 8))) for _ in range(n))
    passages = ["".join(rng.choices("xyz ", k=n)) for n in (280, 289, 290, 300, 330, 380) for _ in range(4)]
    texts = [f"{words(rng.randint(0, 90))} {p} {words(rng.randint(0, 90))}" for p in passages for _ in range(2)] + ["w" * 398 + words(3), words(40)]
    check(spark, texts)


def test_tables(spark):
    check(spark, [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()])


def test_odd_texts(spark):
    check(spark, ["a" * 1500, "ab" * 700, "x" * 399, None, "", "é" * 300, "y" * 400, "z" * 401, "z" * 399 + "q"])
    check(spark, ["w" * 399, "v"])
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_random_repeats(spark, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdé ", k=rng.randint(3, 9)))
    passages = ["".join(word() for _ in range(rng.randint(40, 160))) for _ in range(6)]
    texts = []
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(1, 4)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p))
            parts += [p[a : a + rng.randint(200, 900)], *(word() for _ in range(rng.randint(0, 80)))]
        texts.append("".join(parts))
    check(spark, [*texts, texts[0], texts[1]])


def test_pieces_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 150)
    column = __import__("pyarrow").array(["a" * 3000, None, "b" * 10])
    pieces = [(r, o, p) for rows, offsets, parts in suffix_dedup._texts(column) for r, o, p in zip(rows, offsets, parts)]
    assert [(int(r), int(o), len(p)) for r, o, p in pieces] == [(0, o, min(999, 3000 - o)) for o in range(0, 2601, 600)] + [(1, 0, 0), (2, 0, 10)]


def test_sliding_min():
    v = np.random.default_rng(1).integers(0, 50, 500).astype(np.uint64)
    for w in (1, 3, 201):
        assert (suffix_dedup.sliding_min(v, w) == [v[i : i + w].min() for i in range(len(v) - w + 1)]).all()


@pytest.mark.parametrize("few_bytes", [suffix_dedup.FEW_BYTES, 200, 1000])
def test_names_with_many_contents_and_heavy_names(spark, monkeypatch, few_bytes):
    """Large names are sampled by longer prefixes until none is large, or are compared string by string (1000: at once)."""
    monkeypatch.setattr(suffix_dedup, "FEW_BYTES", few_bytes)
    monkeypatch.setattr(suffix_dedup, "FEW_CONTENTS", 1)
    monkeypatch.setattr(suffix_dedup, "SHARE", 1.0)
    monkeypatch.setattr(suffix_dedup, "HEAVY_AT", 2)
    test_random_repeats(spark, 7)
    test_passages_of_fifty_words_between_texts(spark)


def test_a_passage_in_many_surroundings(spark, monkeypatch):
    """One passage of 390 bytes in many texts, alone and with what makes some of them share more; periodic texts; copies."""
    monkeypatch.setattr(suffix_dedup, "FEW_CONTENTS", 3)
    rng = random.Random(2)
    noise = lambda n: "".join(rng.choices("abcdefghij ", k=n))
    line = noise(390)
    texts = [noise(rng.randint(0, 300)) + line + noise(rng.randint(0, 300)) for _ in range(25)]
    tails = [noise(40) for _ in range(3)]
    texts += [noise(rng.randint(100, 300)) + line + tails[i % 3][: 5 + 3 * i] + noise(200) for i in range(12)]
    texts += [line * 3, "xy" * 500, "xy" * 450 + line, texts[0], noise(100) + line + noise(250) + line + noise(50)]
    check(spark, texts)

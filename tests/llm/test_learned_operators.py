import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rivernet.llm import ann, near_dedup, packing, shingles, toxicity

SF = "/root/testdata/sf0.001"
ODD = [
    (1, None, "en", "a", 0, "x"), (2, "", "en", "a", 0, "x"), (3, "one", "en", None, 3, "x"), (3, "one", "en", None, 3, "x"), (4, "ONE", "en", "a", 3, "x"),
    (None, "one", None, "b", 17, None), (5, "word " * 30_000, "en", "b", 150_000, "x"), (6, "é" * 5_000, "fr", "a", 5_000, "x"), (7, " \t\n ", "en", "a", 4, "x"),
]


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, label string")


# --- near-duplicates


def shingle_set(text, width):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())


def brute_components(rows, width, percent=80):
    sets = {k: shingle_set(t, width) for k, t in rows}
    parent = {k: k for k in sets}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {k: (len(sets[k]), find(k), find(k) == k) for k in keys}


def check_near(spark, rows, width):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: tuple(r)[1:] for r in near_dedup.near_duplicates(docs, width).collect()}
    assert got == brute_components(rows, width)


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_tables(spark, width):
    check_near(spark, [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()], width)


def test_near_duplicates_large_groups(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "NODE_ROWS", 40)
    monkeypatch.setattr(near_dedup, "CLASS_SHINGLES", 4_000)
    rng = random.Random(5)
    word = lambda: rng.choice("abcdefghij") + str(rng.randint(0, 60))
    rows = []
    for g in range(4):
        base = [word() for _ in range(60)]
        for _ in range(60):
            text = [w if rng.random() > 0.04 else word() for w in base]
            rows.append((len(rows), " ".join(text[: rng.randint(50, 60)])))
    rows += [(1000 + i, " ".join(word() for _ in range(rng.randint(1, 6)))) for i in range(60)]
    check_near(spark, rows, 2)


@pytest.mark.parametrize("levels", [0, 1, 3])
def test_a_third_of_all_rows_in_one_node(spark, monkeypatch, levels):
    """Near copies of one text, which no branching parts, among other texts and one chain of likely pairs."""
    monkeypatch.setattr(near_dedup, "NODE_ROWS", 30)
    monkeypatch.setattr(near_dedup, "LEVELS", levels)
    monkeypatch.setattr(near_dedup, "CLASS_SHINGLES", 3_000)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(150)]
    rows = [(7 * i, " ".join([*base[: (at := rng.randrange(150))], f"x{i}", *base[at:]])) for i in range(150)]
    rows += [(5_000 + k, " ".join([*base[k:], *(f"z{i}" for i in range(k))])) for k in range(0, 120, 6)]
    rows += [(10_000 + i, " ".join(f"q{rng.randrange(4_000)}" for _ in range(rng.randint(3, 40)))) for i in range(200)]
    check_near(spark, rows, 2)


def test_only_rows_apart_meet_the_others(spark):
    rows = spark.range(2_000).select(F.lit(1).alias("cls"), F.col("id").alias("rep"), F.lit(1).alias("size"), (F.col("id") % 200 == 7).alias("apart"))
    met = near_dedup.meet_apart(rows, "cls", 100).groupBy("grp").agg(F.collect_list("rep").alias("reps"), F.count("*").alias("n")).collect()
    assert sum(r.n for r in met) == 1_990 + 10 * (1 + 40) and max(r.n for r in met) < 130  # 40 blocks of the others
    together = {(a, b) for r in met for a in r.reps if a % 200 == 7 for b in r.reps}
    assert len(together) == 10 * 2_000
    assert near_dedup.meet_apart(rows.withColumn("apart", F.lit(False)), "cls", 100).count() == 0


def test_branching_alone():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 65536, (30, near_dedup.POSITIONS), dtype=np.uint16)
    values = np.repeat(base, 40, axis=0)
    noise = rng.random(values.shape) < 0.12
    values[noise] = rng.integers(0, 65536, noise.sum(), dtype=np.uint16)
    links = near_dedup.branch(values, np.zeros(len(values), np.int64), np.arange(len(values)), 3, 77)
    parent = list(range(len(values)))
    for a, b in links:
        assert a // 40 == b // 40
        ra, rb = a, b
        while parent[ra] != ra:
            ra = parent[ra]
        while parent[rb] != rb:
            rb = parent[rb]
        parent[ra] = rb
    assert 0.95 * 30 * 39 <= len(links) <= 30 * 39  # one tree's recall; trees repeat


def test_near_duplicates_odd_rows(spark):
    got = Counter(tuple(r) for r in near_dedup.near_duplicates(docs_of(spark, ODD), 2).collect())
    assert got == Counter([(1, 0, 1, True), (2, 0, 2, True), (3, 1, 3, True), (3, 1, 3, True), (4, 1, 3, False), (None, 1, None, True), (5, 1, 5, True), (6, 1, 6, True), (7, 0, 7, True)])
    kept = near_dedup.drop_near_duplicates(docs_of(spark, ODD), 2)
    assert kept.columns == docs_of(spark, ODD).columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 5, 6, 7]
    assert near_dedup.near_duplicates(docs_of(spark, [])).count() == 0 and near_dedup.drop_near_duplicates(docs_of(spark, [])).count() == 0


def test_shingle_sets_in_segments(monkeypatch):
    monkeypatch.setattr(shingles, "SEGMENT", 64)
    texts = [b"A b  c\td e", b"", b"x", b"the the the the", b"q" * 500 + b" r", b"A b  c\td e f"]
    for width in (1, 2, 5):
        offsets, h = shingles.shingle_sets(texts, width)
        assert np.diff(offsets).tolist() == [len(shingle_set(t.decode(), width)) for t in texts]
        a, b = (set(h[offsets[i] : offsets[i + 1]].tolist()) for i in (0, 5))
        assert len(a & b) == len(shingle_set(texts[0].decode(), width) & shingle_set(texts[5].decode(), width))


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (103, 101), (7, 7), (200, 150)]
    got = {r.node: r.label for r in near_dedup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 103: 100, 150: 150, 200: 150}


def test_components_of_a_long_chain(spark):
    """A chain of 100,000 links in shuffled order."""
    n = 100_000
    ids = spark.range(n).select((F.col("id") * 7919 % n).alias("a"))
    found = near_dedup.components(ids.withColumn("b", F.col("a") + 1))
    assert tuple(found.agg(F.count("*"), F.max("label")).first()) == (n + 1, 0)


def test_dropping_keeps_columns_of_any_name(spark):
    rows = [(1, "a b c d e f g", 1, 2, 3), (2, "a b c d e f g", 1, 2, 3), (None, "a b c d e f g", 1, 2, 3), (3, None, 1, 2, 3), (3, None, 0, 2, 3), (4, "h", 1, 2, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _gone int, _several int, _row int")
    kept = near_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((tuple(r)[:2] for r in kept.collect()), key=repr) == [(1, "a b c d e f g"), (3, None), (4, "h"), (None, "a b c d e f g")]
    assert near_dedup.drop_near_duplicates(docs.limit(0)).count() == 0


# --- packing


def check_packing(spark, docs):
    t = Tokenizer.from_file(packing.TOKENIZER)
    want = Counter()
    for r in docs.collect():
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 1]
        want[(r.doc_id, len(ids), tuple(ids))] += 1
    rows = packing.pack(docs, with_ids=True).collect()
    assert sorted(r.sequence_id for r in rows) == list(range(len(rows)))
    assert all(r.offset == 0 and len(r.ids) == r.length and r.length & (r.length - 1) == 0 and r.length <= 2048 for r in rows)
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in rows)
    lengths = [r.length for r in sorted(rows, key=lambda r: r.sequence_id)]
    assert lengths == sorted(lengths, reverse=True)
    if max(want.values(), default=0) == 1:
        whole = defaultdict(list)
        for r in sorted(rows, key=lambda r: r.start):
            assert r.start == len(whole[r.doc_id])
            whole[r.doc_id] += r.ids
        assert {(k, len(v), tuple(v)) for k, v in whole.items()} == set(want)
    assert Counter((r.doc_id, r.doc_tokens) for r in rows if r.start == 0) == Counter((k, n) for (k, n, _), c in want.items() for _ in range(c))


def test_packing(spark):
    check_packing(spark, spark.read.parquet(f"{SF}/documents.parquet"))
    check_packing(spark, docs_of(spark, ODD))
    assert packing.pack(docs_of(spark, [])).count() == 0


def test_cached_ids_equal_the_tokenizer():
    c, t = packing.CachedIds(cache=5), Tokenizer.from_file(packing.TOKENIZER)
    texts = ["", " ", "  a  b\n\n c\t\x1c\x1d x  　y", "<|endoftext|> hi <|endoftext|>", "it's I'LL don't've 123abc ½ ² x₁", "\x85a b ﻿z é́", "a" * 3000 + " " * 3000, "x\x1c y \x1d z\x1f ", "a\xa0 b", " lead trail ", "one\n two"]
    for text in texts:
        assert c.ids(text) == np.array(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), repr(text)


def test_binary_pieces():
    for n in (1, 2, 3, 2047, 2048, 2049, 5000):
        pieces = list(packing.binary_pieces(n))
        assert sum(k for _, k in pieces) == n and all(s == sum(k for _, k in pieces[:i]) for i, (s, _) in enumerate(pieces))


# --- toxicity


def test_classifier_chain_held_out(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    big = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    train, test = labels.filter("doc_id % 4 <> 0"), labels.filter("doc_id % 4 = 0").withColumnRenamed("toxic", "truth")
    model = toxicity.train(big, train, sample_rows=3_000)
    rows = toxicity.score(big, model).selectExpr("row.doc_id", "p[1] >= 0.35 AS said").join(test, "doc_id").collect()
    caught = sum(r.said for r in rows if r.truth)
    assert caught >= 0.9 * sum(r.truth for r in rows) and sum(r.said for r in rows if not r.truth) <= 0.005 * len(rows)
    assert len(model.links[1]) == 1
    kept = toxicity.drop_toxic(docs, spark.read.parquet(f"{d}/labels.parquet"))
    assert kept.columns == docs.columns and 0.8 * docs.count() < kept.count() < docs.count()


def test_chain_feeds_out_of_fold_probabilities():
    rng = np.random.default_rng(0)
    n = 600
    first = rng.random(n) < 0.5
    rows = [[0] if a else [1] for a in first]
    labels = np.column_stack((first, first)).astype(float)
    labels[:50, 1] = np.nan
    chain = toxicity.fit_chain(("a", "b"), [b"x", b"y"], rows, labels)
    p = chain.probabilities([[0], [1], []])
    assert (p[0] > 0.9).all() and (p[1] < 0.1).all() and chain.links[1][0] > 0


def test_chain_against_a_plain_refit_of_each_fold():
    """The later model is fitted on probabilities from models that haven't seen the row, nothing else."""
    rng = np.random.default_rng(4)
    n, n_terms, folds = 90, 12, 3
    x = rng.random((n, n_terms)) < 0.3
    first = (x[:, 0] | x[:, 1]) ^ (rng.random(n) < 0.15)
    second = (first & x[:, 2]) ^ (rng.random(n) < 0.1)
    labels = np.stack((first, second), axis=1).astype(float)
    labels[::11, 0], labels[5::13, 1] = np.nan, np.nan
    terms = [f"t{i}".encode() for i in range(n_terms)]
    chain = toxicity.fit_chain(["a", "b"], terms, [np.flatnonzero(r).tolist() for r in x], labels, folds)

    def refit(use, dense, y):
        row, col = np.nonzero(x[use])
        return toxicity.fit_linear(row, col, n_terms, dense[use], y[use])

    def probability(model, dense):
        w, u, b = model
        return 1 / (1 + np.exp(-(x @ w + dense @ u + b)))

    none, known = np.zeros((n, 0)), ~np.isnan(labels[:, 0])
    outside = np.zeros(n)
    for k in range(folds):
        own = np.arange(n) % folds == k
        outside[own] = probability(refit(known & ~own, none, labels[:, 0]), none)[own]
    inside = probability(refit(known, none, labels[:, 0]), none)
    w, u, b = refit(~np.isnan(labels[:, 1]), outside[:, None], labels[:, 1])
    assert chain.weights[1] == pytest.approx(w, rel=1e-6, abs=1e-9) and chain.links[1] == pytest.approx(u, rel=1e-6) and chain.intercepts[1] == pytest.approx(b, rel=1e-6)
    assert abs(refit(~np.isnan(labels[:, 1]), inside[:, None], labels[:, 1])[1][0] - u[0]) > 1e-2


def test_toxicity_odd_rows(spark):
    labels = spark.createDataFrame([(3, 1, 0), (5, 0, 1), (6, None, None), (6, 1, 0), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.judge_toxicity(docs_of(spark, ODD), labels).count() == len(ODD)
    none = spark.createDataFrame([], labels.schema)
    assert toxicity.drop_toxic(docs_of(spark, ODD), none).count() == len(ODD)
    assert toxicity.judge_toxicity(docs_of(spark, []), labels).count() == 0
    assert toxicity.drop_toxic(docs_of(spark, ODD), labels).columns == docs_of(spark, ODD).columns


# --- nearest neighbours


def brute_nearest(ids, x, k=5, every=50):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for i, q in enumerate(ids):
        if q % every == 0:
            s = u @ u[i]
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != q][:k]
            out[q] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def test_recall(spark, monkeypatch):
    monkeypatch.setattr(ann, "ROWS_A_LEAF", 60)
    monkeypatch.setattr(ann, "CANDIDATE_ROWS", 50)
    monkeypatch.setattr(ann, "QUERY_ROWS", 7)
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = df.collect()
    want = brute_nearest(np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float))
    got = defaultdict(list)
    for r in ann.nearest(df).orderBy("query_id", "rank").collect():
        assert r.rank == len(got[r.query_id]) + 1
        got[r.query_id].append((r.vec_id, r.score))
    hits = sum(len({v for v, _ in got[q]} & {v for v, _ in w}) for q, w in want.items())
    assert hits >= 0.9 * sum(map(len, want.values())) and set(got) == set(want)
    scores = {(q, v): s for q, w in want.items() for v, s in w}
    assert all(abs(s - scores[q, v]) < 1e-12 for q, w in got.items() for v, s in w if (q, v) in scores)


def test_probes_follow_how_the_rows_cluster():
    """Tight clusters need few leaves, a cloud without any most of them; the number reaches the recall asked for."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16))
    tight, cloud = (ann.unit(x) for x in (np.repeat(centres, 50, axis=0) + 0.02 * rng.normal(size=(2_000, 16)), rng.normal(size=(2_000, 16))))
    found = {}
    for name, x in (("tight", tight), ("cloud", cloud)):
        order = rng.permutation(len(x))
        asked, rows = x[order[:200]], x[order[200:]]
        index = ann.fit(rows, 40)
        found[name] = n = ann.probes_needed(index, rows, asked, 5, 0.96)
        near = np.argsort(-(asked @ rows.T), axis=1)[:, :5]
        own, probed = index.assign(rows), np.argsort(-(asked @ index.leaves.T), axis=1)[:, :n]
        assert np.mean([(own[near[i]][:, None] == probed[i]).any(axis=1).mean() for i in range(len(asked))]) >= 0.96
    assert found["tight"] <= 10 and found["cloud"] > 2 * found["tight"]
    assert ann.probes_needed(index, rows, asked[:0], 5, 0.96) == 40


def test_nearest_odd_rows(spark):
    schema = "vec_id long, embedding array<float>, label int, vec string"
    rows = [(0, [1.0, 0.0, 1.0]), (50, [0.0, 2.0, 0.0]), (1, None), (2, [0.0, 0.0, 0.0]), (3, [1.0, None, 1.0]), (4, [float("nan"), 1.0, 1.0]), (5, [float("inf"), 1.0, 1.0]), (6, [1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (7, [2.0, 0.0, 2.0]), (8, [1.0, 0.0, 1.0]), (8, [1.0, 0.0, 1.0])]
    got = [tuple(r) for r in ann.nearest(spark.createDataFrame([(a, b, 0, "clash") for a, b in rows], schema)).orderBy("query_id", "rank").collect()]
    assert [(q, n, v) for q, n, v, _ in got] == [(0, 1, 7), (0, 2, 8), (0, 3, 8), (0, 4, 50), (50, 1, 0), (50, 2, 7), (50, 3, 8), (50, 4, 8)]
    assert ann.nearest(spark.createDataFrame([], schema)).count() == 0
    same = spark.createDataFrame([(i, [1.0, 2.0], 0, "") for i in range(300)], schema)
    assert [r.vec_id for r in ann.nearest(same).filter("query_id = 0").orderBy("rank").collect()] == [1, 2, 3, 4, 5]


def test_repeated_query_rows(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), *((i, [1.0, 0.1 * (i - 6)]) for i in range(7, 20)), (50, [5.0, -0.9]), (50, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r)[:3] for r in ann.nearest(df).orderBy("query_id", "rank").collect()]
    # vec_id 50 is asked with [0, 1] and never answers itself; as a candidate its first row is 0.98 near to 0.
    assert [v for q, _, v in got if q == 0] == [7, 50, 8, 9, 10] and [v for q, _, v in got if q == 50] == [19, 18, 17, 16, 15]


def test_near_copies_that_share_their_codes(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=16)
    x = np.concatenate((base + 1e-4 * rng.normal(size=(1_000, 16)), rng.normal(size=(2_000, 16))))
    ids = rng.permutation(len(x))
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    want, got = brute_nearest(ids, x), defaultdict(list)
    for r in ann.nearest(df).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    hits = sum(len(set(got[q]) & {v for v, _ in w}) for q, w in want.items())
    assert hits >= 0.99 * sum(map(len, want.values()))


def test_very_large_and_very_small_vectors(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(120, 8))
    size = np.array([1.0, 1e200, 1e-200, 1e300])[np.arange(120) % 4]
    schema = "vec_id long, embedding array<double>"
    plain, odd = (spark.createDataFrame([(i, (v * s).tolist()) for i, (v, s) in enumerate(zip(x, sizes, strict=True))], schema) for sizes in (np.ones(120), size))
    want, got = ({(r.query_id, r.rank): (r.vec_id, r.score) for r in ann.nearest(t).collect()} for t in (plain, odd))
    assert set(got) == set(want) and all(got[k][0] == v[0] and got[k][1] == pytest.approx(v[1], rel=1e-12) for k, v in want.items())

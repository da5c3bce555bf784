"""Phrases, n-gram joins and ranked search against brute force."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from rivernet.llm import collocation, grid_search, near_dedup, ngram_join

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, key string, n int, rep int, grp int, score int"


def docs_of(spark, rows):
    """rows: (doc_id, text, lang); further columns clash with names that operators use."""
    return spark.createDataFrame([(i, t, g, "x", 1, 2, 3, 4) for i, t, g in rows], SCHEMA).repartition(3)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def prose(seed, n, words, vocabulary=30):
    rng = random.Random(seed)
    names = [f"w{i}" for i in range(vocabulary)]
    return [" ".join(rng.choice(names) + rng.choice(["", "", "", ".", ",", "\n", "!"]) for _ in range(rng.randrange(words))) for _ in range(n)]


def table_of(name):
    return duckdb.sql(f"SELECT * FROM '{SF}/{name}.parquet'")


# --- op11 ---


def phrases_by_hand(rows, least, top):
    total, f = Counter(), Counter()
    for _, text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(words)
            for m in range(1, 6):
                f.update((lang or "und", tuple(words[i : i + m])) for i in range(len(words) - m + 1))
    out = []
    candidates = {p: a for p, a in f.items() if a >= least and len(p[1]) > 1}
    for (lang, p), a in candidates.items():
        inside = any(g == lang and len(q) > len(p) and 100 * b >= 100 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for (g, q), b in candidates.items())
        if not inside:
            cuts = [(SCALE * a * total[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            out.append((lang, -score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]], total[lang]))
    rows, place = [], Counter()
    for lang, score, a, p, left, right, n in sorted(out):
        place[lang] += 1
        if place[lang] <= top:
            rows.append((lang, place[lang], p.decode(), -a, left, right, n, -score))
    return sorted(rows)


SCALE = collocation.SCALE


@pytest.mark.parametrize("most", [collocation.MOST_KNOWN, 0])
def test_collocations_against_brute_force(spark, monkeypatch, most):
    """Also with a bitmap and whole keys where words are too many to share (most = 0), and with filters of several ranges."""
    monkeypatch.setattr(collocation, "MOST_KNOWN", most)
    monkeypatch.setattr(collocation, "FILTER_WORDS", 500)
    rows = [(i, t, [None, "en", "de"][i % 3]) for i, t in enumerate(prose(1, 90, 80, 12))]
    rows += [(7, "A b c d e f g. a B c d e f g", "en")] * 6 + [(None, None, "en"), (None, "", None), (5, "ÄB ÄB ÄB ÄB ÄB", "de"), (5, "ÄB\tÄB ÄB", "de"), (6, " .,;\n", "fr")]
    got = [tuple(r) for r in collocation.collocations(docs_of(spark, rows), least=5, top=40).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()]
    assert sorted(got) == phrases_by_hand(rows, 5, 40)
    assert {r[0] for r in got} >= {"en", "de", "und"}


def test_collocations_long_text_and_empty_table(spark):
    rows = [(1, "alpha beta gamma " * 200_000, "en")]
    got = [tuple(r) for r in collocation.collocations(docs_of(spark, rows)).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()]
    assert sorted(got) == phrases_by_hand(rows, 100, 2000)
    assert collocation.collocations(docs_of(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("bits", [1, 7, 12, 13, 25, 40, 64])
def test_packing_and_filters_keep_everything(bits):
    packing = collocation.Packing(bits)
    rng = np.random.default_rng(bits)
    for m in range(2, 6):
        ids = rng.integers(0, 1 << bits, (300, m), dtype=np.uint64, endpoint=False) if bits < 64 else rng.integers(0, 1 << 63, (300, m), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        packed = packing.pack(ids)
        permuted = packing.permute(packed)
        assert (packing.restore(permuted) == packed).all()
        assert len(np.unique(permuted, axis=0)) == len(np.unique(packed, axis=0))
        length, back = packing.unpack(packed)
        assert (length == m).all() and (back[:, :m] == ids).all()
        entries, counts = collocation.counted(permuted)
        counts = counts + rng.choice([0, 300, 1 << 40], len(counts))
        high = min(3, packing.part_bits - 1)
        part = (entries[:, 0] >> np.uint64(packing.part_bits - high)).astype(int)
        for p in np.unique(part):
            rows, n = collocation.from_filter(packing, collocation.to_filter(packing, entries[part == p], counts[part == p], high), high, int(p))
            assert (rows == entries[part == p]).all() and (n == counts[part == p]).all()


def test_filters_with_long_runs():
    """Rows that meet in a few slots: runs of over 254."""
    packing = collocation.Packing(20)
    rows = np.zeros((1000, packing.parts), np.uint64)
    rows[:, 1] = np.arange(1000)
    back, n = collocation.from_filter(packing, collocation.to_filter(packing, rows, np.full(1000, 254), 0), 0, 0)
    assert (back == rows).all() and (n == 254).all()


# --- op12 ---


def components_by_hand(rows, width, percent):
    sets = []
    for doc_id, text, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
        sets.append((doc_id, {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()))
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    linked = lambda a, b: a and b and 100 * len(a & b) >= percent * len(a | b)
    for i, (x, a) in enumerate(sets):
        for y, b in sets[:i]:
            if x is not None and y is not None and linked(a, b):
                u, v = find(x), find(y)
                parent[max(u, v)] = min(u, v)
    return sorted(((d, len(s), None if d is None else find(d) if s else d) for d, s in sets), key=repr)


def families(seed):
    """Near copies of a few texts: several words changed, dropped or added, some in a row."""
    rng = random.Random(seed)
    out = []
    for base in prose(seed, 6, 120, 500):
        words = base.split() + ["end"] * 3
        for _ in range(20):
            w = list(words)
            for _ in range(rng.randrange(4)):
                at = rng.randrange(len(w))
                w[at : at + rng.randrange(2)] = [rng.choice(["new", "x", "y"])] * rng.randrange(2)
            out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("few", "ngrams"), [(ngram_join.FEW, 2_000), (2, 2_000), (2, 300)])
def test_ngram_join_against_brute_force(spark, monkeypatch, few, ngrams):
    """Also with lists of over two groups taken as long ones, and with classes cut into several blocks."""
    monkeypatch.setattr(ngram_join, "FEW", few)
    monkeypatch.setattr(ngram_join, "CLASS_NGRAMS", ngrams)
    texts = families(3) + prose(4, 40, 12, 5) + ["one two three", "One  two\tthree", "four", "", None, " \n"]
    rows = [(500 - i, t, "en") for i, t in enumerate(texts)]
    got = sorted((tuple(r) for r in ngram_join.ngram_join(docs_of(spark, rows)).collect()), key=repr)
    assert got == components_by_hand(rows, 4, 85)
    assert len({c for _, _, c in got}) < len(rows) - 60


def test_a_class_meets_its_pivot_first(spark, monkeypatch):
    """Of a class cut into blocks, what isn't like the pivot is linked among itself and with what is."""
    monkeypatch.setattr(ngram_join, "CLASS_NGRAMS", 250)
    base = [f"w{i}" for i in range(60)]
    steps = [" ".join([*base[k:], *(f"z{i}" for i in range(k))]) for k in range(0, 50, 2)]  # a chain: each like the next one, the last not like the first
    other = [" ".join([*(f"q{i}" for i in range(50)), str(k)]) for k in range(6)]
    texts = steps + other
    rows = [(10 + i, t, "en") for i, t in enumerate(texts)]
    classes = spark.createDataFrame([(r[0], 1, 57) for r in rows], "rep long, cls long, size long")
    links = ngram_join.confirmed_in_classes(docs_of(spark, rows), classes, 4, 85).collect()
    parent = {r[0]: r[0] for r in rows}
    find = lambda x: x if parent[x] == x else find(parent[x])
    for a, b in links:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    assert sorted((i, find(i)) for i in parent) == [(d, c) for d, _, c in sorted(components_by_hand(rows, 4, 85))]


def test_ngram_join_odd_rows(spark):
    base = "a b c d e f g h i j k l m n o p q r s t u v w x y z aa bb cc dd"
    rows = [(None, base, "en"), (3, base, "en"), (3, base, "en"), (2, base + " ee", "en"), (9, "other words are here now", "en"), (9, base, "en"), (9, "", "en"), (8, "other words are here now", "en"), (7, "very long " * 50_000 + "end", "en"), (6, "very long " * 50_000, "en")]
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_join(docs_of(spark, rows)).collect() if r.n_shingles}
    assert got == {None: None, 3: 2, 2: 2, 9: 2, 8: 2, 7: 6, 6: 6} or got == {None: None, 3: 2, 2: 2, 9: 2, 8: 2, 7: 7, 6: 6}
    assert ngram_join.ngram_join(docs_of(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize(("chunk", "most"), [(1 << 22, 1 << 22), (300, 3)])
def test_the_table_tells_frequent_ngrams_from_rare_ones(spark, monkeypatch, chunk, most):
    """With 8,192 cells frequent n-grams stand out of more rare ones than there are cells; also in small chunks and by counters."""
    for name, value in (("CHUNK_NGRAMS", chunk), ("SORTED", most), ("CELLS", 1 << 13), ("SLICES", 1 << 13), ("VALUES", 1 << 19)):
        monkeypatch.setattr(ngram_join, name, value)
    rng = random.Random(8)
    common = [" ".join(f"c{k}x{i}" for i in range(4)) for k in range(5)]
    texts = [" ".join([rng.choice(common), *(f"{n}r{i}" for i in range(40))]) for n in range(1_000)]
    table = ngram_join.frequency_table(docs_of(spark, [(i, t, "en") for i, t in enumerate(texts)]), 4)
    cell = lambda text: int(ngram_join.shingle_sets([text.encode()], 4)[1][0] & np.uint64(0xFFFFFFFF)) // ((1 << 32) // (1 << 13))
    for c in common:
        assert table[cell(c)] == sum(t.startswith(c) for t in texts).bit_length()
    assert np.count_nonzero(table) == len({cell(c) for c in common})


def test_ngram_join_where_ids_are_too_many_to_broadcast(spark, monkeypatch):
    """Texts are then dealt out once they are known to take part, and never for the prefixes."""
    dealt = []

    def marked(docs, ids, real=near_dedup.marked):
        out = real(docs, ids)
        dealt.append(({r.doc_id for r in out.collect()}, {r.doc_id for r in ids.collect()}))
        return out

    for module in (ngram_join, near_dedup):
        monkeypatch.setattr(module, "BROADCAST_ROWS", 5)
    monkeypatch.setattr(near_dedup, "marked", marked)
    texts = families(3)[:40] + [" ".join(f"{n}r{i}" for i in range(30)) for n in range(150)]
    rows = [(500 - i, t, "en") for i, t in enumerate(texts)] + [(None, texts[0], "en")]
    got = sorted((tuple(r) for r in ngram_join.ngram_join(docs_of(spark, rows)).collect()), key=repr)
    assert got == components_by_hand(rows, 4, 85)
    assert dealt and all(ids <= out and len(out) <= len(ids) + 2 for out, ids in dealt) and any(ids for _, ids in dealt)
    assert not any(ids & set(range(500 - len(texts) + 1, 461)) for _, ids in dealt)


def test_prefixes_hold_a_common_ngram():
    """Sets at the threshold share SHARED of their first n-grams, or all they must, in any order."""
    rng = np.random.default_rng(5)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        a, b = set(range(n)), set(range(int(rng.integers(0, n)), n + int(rng.integers(0, 8))))
        if b and 100 * len(a & b) >= 85 * len(a | b):
            order = rng.permutation(200)
            first = [set(sorted(s, key=lambda x: order[x])[: int(ngram_join.prefix_size(np.array([len(s)]), 85)[0])]) for s in (a, b)]
            least = ngram_join.least_overlap(np.array([len(a)]), np.array([len(b)]), 85)[0]
            assert len(a & b) >= least and len(first[0] & first[1]) >= min(least, ngram_join.SHARED)


def test_pieces_of_long_lists(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(ngram_join, "LIST_ROWS", 5)
    keys = [1, 1, 2] + [3] * 23 + [4, 5, 5]
    batches = [pa.RecordBatch.from_pydict({"ngram": keys[i : i + 3]}) for i in range(0, len(keys), 3)]
    pieces = [p.column("ngram").to_pylist() for p in ngram_join.by_pieces(iter(batches))]
    assert sum(pieces, []) == keys and max(map(len, pieces)) <= 8
    assert all(a[-1] != b[0] or a[-1] == 3 for a, b in zip(pieces[:-1], pieces[1:], strict=True))


# --- op13 ---


def terms_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(text))


def ranks_by_hand(rows, items, top):
    docs = [(d, Counter(terms_of(t))) for d, t, *_ in rows]
    docs = [(d, c, sum(c.values())) for d, c in docs if c]
    n_docs, n_terms = len(docs), sum(n for *_, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in items:
        found = []
        for d, c, n in docs:
            m = 10 + 90 * n * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms_of(text)) if c[t])
            if score > 0 and d is not None:
                found.append((-score, d))
        out += [(item, k + 1, d, -s) for k, (s, d) in enumerate(sorted(found)[:top])]
    return sorted(out)


@pytest.mark.parametrize("columns", [grid_search.COLUMNS, 8])
def test_ranked_search_against_brute_force(spark, monkeypatch, columns):
    """Also with many small grids, and items in several blocks."""
    texts = prose(8, 150, 60, 40) + ["w1 w1 w1"] * 15 + ["", None, "-- ..", "W1 Ünd w2-w3_w4", "ünd ünd"]
    rows = [(900 - 3 * i, t, "en") for i, t in enumerate(texts)] + [(None, "w1 w2", "en"), (900, "w1 w1 w5", "en"), (900, "w1 w1 w5", "en")]
    items = [(i, t) for i, t in enumerate(prose(9, 25, 12, 45))] + [(100, None), (101, ""), (102, "nowhere"), (103, "Ünd ünd w1")]
    if columns == 8:
        monkeypatch.setattr(grid_search, "COLUMNS", 8)
        monkeypatch.setattr(grid_search, "ITEMS", 10)
    found = grid_search.ranked(docs_of(spark, rows), spark.createDataFrame([(i, t, 5) for i, t in items], "item_id long, text string, term int"))
    assert sorted(tuple(r) for r in found.collect()) == ranks_by_hand(rows, items, 10)


def test_ranked_search_empty_tables_and_long_texts(spark):
    rows = [(1, "alpha " * 300_000 + "beta", "en"), (2, "alpha gamma", "en")]
    items = spark.createDataFrame([(1, "beta alpha")], "item_id long, text string")
    found = grid_search.ranked(docs_of(spark, rows), items)
    assert sorted(tuple(r) for r in found.collect()) == ranks_by_hand(rows, [(1, "beta alpha")], 10)
    assert grid_search.ranked(docs_of(spark, rows).limit(0), items).count() == 0
    assert grid_search.ranked(docs_of(spark, rows), items.limit(0)).count() == 0


def test_treap_holds_its_cells():
    rng = np.random.default_rng(3)
    cells = np.unique(rng.integers(0, 16, (60, 2)), axis=0)
    impact = rng.integers(1, 1000, len(cells))
    treap = grid_search.Treap(cells[:, 0], cells[:, 1], impact, 4)
    grid = np.zeros((16, 16), np.int64)
    grid[cells[:, 0], cells[:, 1]] = impact
    for row in range(16):
        for column in range(16):
            part = np.zeros(1, np.int64)
            for level in range(4):
                size = 16 >> level
                assert treap.bounds(level, part)[0] == grid[row // size * size : row // size * size + size, column // size * size : column // size * size + size].max()
                part = treap.below(level, part, np.array([2 * (row >> (3 - level) & 1) + (column >> (3 - level) & 1)]))
            assert treap.bounds(4, part)[0] == grid[row, column]


@pytest.mark.parametrize(("beam", "states"), [(1, 8), (16, 1 << 14), (1000, 1 << 14)])
def test_search_of_a_grid(monkeypatch, beam, states):
    """Narrow and wide beams and small portions find the same; equal scores by the lesser id."""
    monkeypatch.setattr(grid_search, "BEAM", beam)
    monkeypatch.setattr(grid_search, "STATES", states)
    rng = np.random.default_rng(7)
    best, whole = grid_search.Best(9, 5), []
    rows = np.where(rng.random((9, 6)) < 0.8, rng.permuted(np.tile(np.arange(20), (9, 1)), axis=1)[:, :6], -1)
    for k in range(4):
        grid = rng.integers(1, 4, (20, 30)) * (rng.random((20, 30)) < 0.3)
        r, c = np.nonzero(grid)
        ids = rng.permutation(1000)[:30]
        grid_search.search(grid_search.Treap(r, c, grid[r, c], 5), rows, best, ids)
        whole += [(item, -score, int(d)) for item in range(9) for d, score in zip(ids, grid[rows[item][rows[item] >= 0]].sum(axis=0), strict=True) if score]
    for item in range(9):
        want = sorted((s, d) for i, s, d in whole if i == item)[:5]
        assert [(-int(s), int(d)) for s, d in zip(best.score[item], best.doc[item], strict=True) if s > 0] == want


@pytest.mark.parametrize("name", ["op11_quotient_collocations", "op12_grouped_prefix", "op13_treap_search"])
def test_queries_against_their_sql(spark, name):
    from rivernet.llm.queries import oracle_sql, queries

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries()[name](spark, SF)
    want = con.execute(oracle_sql()[name]).fetchall()
    names = [d[0] for d in con.description]
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(want)

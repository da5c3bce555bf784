import hashlib
import re
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from rivernet.llm import fingerprint, mixing, pii, token_count, url_filter

SF = "/root/testdata/sf0.001"


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, extra string")


ODD = [
    (1, None, "en", "a", 0, "x"), (2, "", "en", "a", 0, "x"), (3, "one", "en", None, 3, "x"), (3, "one", "en", None, 3, "x"),
    (None, "no id here at all", None, "b", 17, None), (5, "word " * 30_000, "en", "b", 150_000, "x"), (6, "é" * 5_000, "fr", "a", 5_000, "x"), (7, " \t\n ", "en", "a", 4, "x"),
]


def simhash(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    votes = [0] * 64
    for i, w in enumerate(words):
        h = xxhash.xxh64_intdigest(w.encode(), 42)
        if i + 1 < len(words):
            h = xxhash.xxh64_intdigest(words[i + 1].encode(), h)
        for b in range(64):
            votes[b] += 1 if h >> b & 1 else -1
    return sum(1 << b for b in range(64) if votes[b] > 0)


def check_simhash(spark, docs):
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    prints = [simhash(t) for _, t in rows]
    want = Counter()
    for i, (k, t) in enumerate(rows):
        half, after = len(t) // 2, rows[(i + 1) % len(rows)][1]
        edited = t[: len(t) - half] + after[:half]
        e, n = simhash(edited), prints[(i + 1) % len(rows)]
        near = sum((prints[i] ^ p).bit_count() <= 3 for p in prints) - 1 if k is not None and k % 20 == 0 else None
        like = lambda a, b: 1 - (a ^ b).bit_count() / 64
        want[(k, len(t), hashlib.sha256(edited.encode()).hexdigest(), f"{prints[i]:016x}", f"{e:016x}", like(prints[i], e), like(prints[i], n), near)] += 1
    assert Counter(map(tuple, fingerprint.fingerprint_documents(docs).collect())) == want


def test_simhash_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(fingerprint.with_next, "__defaults__", (20, 100))
    check_simhash(spark, spark.read.parquet(f"{SF}/documents.parquet"))


def test_simhash_odd_rows(spark):
    check_simhash(spark, docs_of(spark, ODD))
    check_simhash(spark, docs_of(spark, ODD[:1]))
    assert fingerprint.fingerprint_documents(docs_of(spark, [])).count() == 0


def test_block_tables_find_all(spark):
    base = [0, 0b111, 0b1111, 1 << 63, (1 << 63) | 3, (1 << 40) | (1 << 20) | 1, -1 & (1 << 64) - 1]
    signed = [x - (1 << 64) if x >> 63 else x for x in base]
    df = spark.createDataFrame([(x,) for x in signed], "fingerprint long")
    got = sorted((r.query, r.fingerprint, r.bits) for r in fingerprint.within_radius(df, df).collect())
    assert got == sorted((a, b, (x ^ y).bit_count()) for a, x in zip(signed, base) for b, y in zip(signed, base) if (x ^ y).bit_count() <= 3)


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    ]
    out = [(m.start(), k, m.end(), name) for k, (name, p, ok) in enumerate(rules) for m in re.finditer(p, text) if ok(m.group())]
    return [(name, s, e) for s, _, e, name in sorted(out)]


PRIVATE = [
    "a@b.c@d.e x_y%z@q.w.e, a@b.c_d@e.f @a.b a@b a@@b.c é.x@mail.example.com",
    "1.2.3.4 1.2.3.4.5.6.7.8 256.1.1.1 01.002.3.0000255 1.2.3 9.9.9.9",
    "4111 1111 1111 1111 and 4111-1111-1111-1112 5500005555555559-1 0000000000000000000000",
    "+1 (555) 123-4567 +44.20.7946.0958, ++49 30 1234567 +12 +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7",
    "é😀 4111111111111111 é +33 1 23 45 67 89 x@y.zz", "a" * 50_000 + " @ " + "1" * 50_000 + "." + "a@b." * 3_000 + "c", "", None,
]


def test_base_spans_against_brute_force(spark):
    rows = [(i, t, "en", "a", 0, "x") for i, t in enumerate(PRIVATE)] + [(r.doc_id + 100, r.text, "en", "a", 0, "x") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: r for r in pii.find_personal_data(docs_of(spark, rows)).collect()}
    assert len(got) == len(rows)
    for k, t, *_ in rows:
        want = base_spans(t or "")
        text = ",".join(f"{n}:{s}:{e}" for n, s, e in want)
        r = got[k]
        assert [x for x in r.spans.split(",") if x and not x.startswith("term")] == text.split(",") * bool(text), k
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(x[0] == n for x in want) for n in ("email", "ip", "card", "phone"))


def test_terms_that_give_an_entity_away(spark):
    rows = [(i, f"Agent Falcon( wrote from bob@x.example today and number {i}", "en", "a", 0, "x") for i in range(4)]
    rows += [(10 + i, "today and number of the agent wrote from home", "en", "a", 0, "x") for i in range(30)]
    docs = docs_of(spark, rows)
    found = {r.doc_id: r for r in pii.find_personal_data(docs).collect()}
    assert found[0].spans == "term:6:13,email:25:38" and found[12].spans == ""
    out = {r.doc_id: r for r in pii.sanitise(docs).collect()}
    assert out[1].text == "Agent  wrote from <EMAIL> today and number 1" and out[1].extra == "x" and out[1].n_chars == len(out[1].text)
    assert out[12].text == rows[6][1]
    assert pii.sanitise(docs_of(spark, ODD)).count() == len(ODD)
    assert pii.find_personal_data(docs_of(spark, [])).count() == 0 and pii.sanitise(docs_of(spark, [])).count() == 0


@pytest.mark.parametrize("most", [500_000, 0])
def test_terms_in_documents_without_the_entity(spark, monkeypatch, most):
    monkeypatch.setattr(pii, "BROADCAST_ROWS", most)
    rows = [(i, "falcon osprey bob@x.example today", "en", "a", 0, "x") for i in range(10)]
    rows += [(10, "a Falcon flew today", "en", "a", 0, "x"), (11, "a Falcon flew today", "en", "a", 0, "x")]
    rows += [(20 + i, f"today of number {i}", "en", "a", 0, "x") for i in range(90)]
    docs = docs_of(spark, rows)
    found = {r.doc_id: r.spans for r in pii.find_personal_data(docs).collect()}
    # falcon: ln(10 * 102 / (12 * 10)) / ln(102 / 10) = 0.92; osprey: 1
    assert found[10] == found[11] == "term:2:8" and found[0] == "term:0:6,term:7:13,email:14:27" and found[20] == ""
    out = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert out[10] == out[11] == "a  flew today" and out[20] == "today of number 0" and len(out) == len(rows)


def disclosing(texts, least=3):
    """Levels of terms, from sets of words and values of each document."""
    import math

    docs = [(set(re.split(r"[\x20\x09-\x0D]+", t.lower().strip())), {t[s:e].lower() for _, s, e in base_spans(t)}) for t in texts]
    n, words, values, both = len(docs), Counter(), Counter(), Counter()
    for w, v in docs:
        words.update(w)
        values.update(v)
        both.update((a, b) for a in w for b in v)
    levels = {}
    for (w, v), k in both.items():
        if k >= least and values[v] >= least and values[v] < n:
            x = math.log(k * n / (words[w] * values[v])) / math.log(n / values[v])
            if x >= 0.7:
                levels[w] = max(levels.get(w, 4), 5 if x >= 0.9 else 4)
    return levels


@pytest.mark.parametrize("alternatives", [64, 0])
def test_disclosing_terms_against_brute_force(spark, monkeypatch, alternatives):
    import random

    monkeypatch.setattr(pii, "ALTERNATIVES", alternatives)
    rng = random.Random(3)
    names, places = [f"name{i}" for i in range(12)], [f"Place{i}" for i in range(30)]
    texts = []
    for i in range(300):
        k = rng.randrange(12)
        who = rng.choice([f"{names[k]}@x.example", "call +49 30 1234567" + str(k % 3), "", ""])
        texts.append(f"{places[k + rng.randrange(3)]} {rng.choice(['met', 'saw', 'left'])} {who}\n{places[rng.randrange(30)]} {rng.choice(names) if rng.random() < 0.1 else ''} end")
    texts += [texts[0]] * 4
    levels = disclosing(texts)
    assert len(levels) > 10
    got = {r.doc_id: r for r in pii.find_personal_data(docs_of(spark, [(i, t, "en", "a", 0, "x") for i, t in enumerate(texts)])).collect()}
    for i, t in enumerate(texts):
        base = base_spans(t)
        terms = [("term", m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", t) if m[0].lower() in levels and not any(s < m.end() and m.start() < e for _, s, e in base)]
        want = sorted([(s, ("email", "ip", "card", "phone", "term").index(k), e, k) for k, s, e in base + terms])
        assert got[i].spans == ",".join(f"{k}:{s}:{e}" for s, _, e, k in want), t


@pytest.mark.parametrize("alternatives", [64, 65, 0])
def test_terms_are_found_alike_however_many_there_are(spark, monkeypatch, alternatives):
    """Words whose lower-cased forms differ from what a search without case finds (dotted capital I, final sigma), among 63, 64 and 65 terms of a text."""
    monkeypatch.setattr(pii, "ALTERNATIVES", alternatives)
    for many in (61, 62, 63):
        words = ["\u0130STANBULX", "\u03a3\u0395\u03a3", *(f"Word{i}q" for i in range(many))]
        text = " ".join(words) + " me@b.example"
        rows = [(i, text if i < 4 else f"other text {i}", "en", "a", 0, "x") for i in range(40)] + [(90, "\u0130STANBULX i\u0307stanbulx \u03c3\u03b5\u03c2 \u03c3\u03b5\u03c3 word0Q istanbulx", "en", "a", 0, "x")]
        found = {r.doc_id: r for r in pii.find_personal_data(docs_of(spark, rows)).collect()}
        assert found[0].n_term == many + 2 and found[0].spans == found[3].spans and found[30].n_term == 0
        assert found[90].spans == "term:0:9,term:10:20,term:21:24,term:29:35"


def test_long_lists_that_several_texts_share(spark):
    import time

    began = time.time()
    values = [f"u{i}@b.example" for i in range(20_000)]
    rows = [(k, " ".join(values[k:] + values[:k]) + f" list{k} Falcon", "en", "a", 0, "x") for k in range(4)] + [(10 + i, f"Falcon text {i}" if i < 2 else f"plain text {i}", "en", "a", 0, "x") for i in range(60)]
    found = {r.doc_id: r for r in pii.find_personal_data(docs_of(spark, rows)).collect()}
    # falcon: ln(4 * 64 / (6 * 4)) / ln(64 / 4) = 0.85
    assert all(found[k].n_email == 20_000 and found[k].n_term == 1 for k in range(4))
    assert found[10].spans == found[11].spans == "term:0:6" and found[20].spans == ""
    assert time.time() - began < 60


def test_very_many_matches_in_a_text(spark):
    import time

    n = 100_000
    text = " ".join(f"a{i}@b.example" for i in range(n))
    docs = docs_of(spark, [(1, text, "en", "a", len(text), "x"), (2, "é" * 9_000 + " me@b.example " + "\U0001f600" * 5_000, "en", "a", 0, "x")])
    began = time.time()
    r, s = sorted(pii.find_personal_data(docs).collect())
    assert r.n_email == n and r.base_sha256 == hashlib.sha256(",".join(f"email:{m.start()}:{m.end()}" for m in re.finditer(r"\S+", text)).encode()).hexdigest()
    assert s.spans == "email:9001:9013"
    out = {x.doc_id: x.text for x in pii.sanitise(docs).collect()}
    assert out[1] == " ".join(["<EMAIL>"] * n) and out[2] == "é" * 9_000 + " <EMAIL> " + "\U0001f600" * 5_000
    assert time.time() - began < 120


def test_urls(spark):
    rows = [
        (1, "https://a.example.net/en/x?q=1"), (2, "http://EXAMPLE.NET/EN/x"), (3, "http://x.org/fr/a"), (4, "ftp://h.com/free-poker/now"), (5, "http://h.com/freepoker"), (6, "http://h.com/a-casino-b"),
        (7, None), (8, ""), (9, "no scheme sex bet"), (10, "http://net"), (11, "http://example.com/de/"), (12, "http://h.com/free?free#free"), (12, "http://h.com/free?free#free"), (None, "x://y?z://w/"),
    ]
    got = [tuple(r)[:5] for r in url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string").withColumn("host", __import__("pyspark").sql.functions.lit("clash"))).collect()]
    assert got == [
        (1, "a.example.net", "/en/x", "example.net/en/", "allow"), (2, "example.net", "/EN/x", "net/", "block"), (3, "x.org", "/fr/a", "org/fr/", "allow"), (4, "h.com", "/free-poker/now", None, "block"),
        (5, "h.com", "/freepoker", None, "allow"), (6, "h.com", "/a-casino-b", None, "block"), (7, "", "", None, "allow"), (8, "", "", None, "allow"), (9, "", "", None, "block"), (10, "net", "", None, "allow"),
        (11, "example.com", "/de/", "example.com/de/", "block"), (12, "h.com", "/free", None, "allow"), (12, "h.com", "/free", None, "allow"), (None, "y", "", None, "allow"),
    ]
    assert url_filter.judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_urls_with_a_vocabulary_of_thousands(spark):
    import random

    rng = random.Random(1)
    terms = sorted({"".join(rng.choices("abcd", k=rng.randint(2, 7))) for _ in range(6_000)})
    table = spark.createDataFrame([(t.upper(), i % 3 == 0) for i, t in enumerate(terms)] + [(None, True), ("", True), (terms[1], True)], "term string, strict boolean")
    strict, soft = url_filter.vocabulary_of(table)
    assert len(terms) > 2_000 and set(strict) | set(soft) == set(terms) and terms[1] in strict
    urls = ["http://h.com/" + "/".join("".join(rng.choices("abcd", k=rng.randint(1, 7))) for _ in range(rng.randint(1, 4))) for _ in range(300)]
    got = url_filter.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), strict=strict, soft=soft).collect()
    for r in got:
        words = set(re.split("[^a-z0-9]+", urls[r.page_id]))
        assert (r.strict, r.soft) == (len(words & set(strict)), len(words & set(soft)))
        assert r.verdict == ("block" if r.strict or r.soft >= 2 else "allow")


@pytest.mark.parametrize("as_tables", [True, False])
def test_urls_with_more_terms_and_rules_than_one_task_takes(spark, monkeypatch, as_tables):
    """Blocks of terms and joined rules give what one automaton and one expression give."""
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url")
    odd = [(-1, "http://a.b.example.net/en/x-casino"), (-2, "x://www.example.com/de/free?bet=1"), (-3, None), (-3, None), (-4, "no scheme free-bet"), (-5, "http://" + "a." * 500 + "org/fr/" + "free/" * 3_000), (None, "http://net/casino")]
    pages = pages.unionByName(spark.createDataFrame(odd, "page_id long, url string"))
    key = lambda r: repr(tuple(r))
    want = sorted(url_filter.judge_urls(pages).collect(), key=key)
    monkeypatch.setattr(url_filter, "MOST_TERMS", 4)
    monkeypatch.setattr(url_filter, "MOST_RULES", 3)
    if as_tables:
        terms = spark.createDataFrame([(t.upper(), True) for t in url_filter.STRICT] + [(t, None) for t in url_filter.SOFT] + [(None, True), ("", False)], "term string, strict boolean")
        rules = spark.createDataFrame(list(url_filter.RULES) + [(None, "/", "block"), ("org", None, "block")], "host string, path string, verdict string")
        got = url_filter.judge_urls(pages, rules, terms=terms)
        with pytest.raises(ValueError, match="give judge_urls the table"):
            url_filter.vocabulary_of(terms)
    else:
        got = url_filter.judge_urls(pages)
    assert sorted(got.collect(), key=key) == want


def greedy(word, vocab):
    n = 0
    while word:
        k = next((k for k in range(len(word), 0, -1) if word[:k] in vocab), 0)
        if not k:
            return 1
        word, n = word[k:], n + 1
    return n


@pytest.mark.parametrize("vocab", [{"a", "ab", "abc", "abcd", "bc", "cde", "d", "e"}, {"ab", "aba", "bab"}, {"a", "b", "aaab", "aab"}])
def test_automaton_against_greedy(vocab):
    from itertools import product

    counter = token_count.PieceCounter(sorted(vocab))
    for n in range(1, 7):
        for w in map("".join, product("abcde" if n < 6 else "ab", repeat=n)):
            assert counter.count(w) == greedy(w, vocab), w


def test_token_counts(spark):
    import json

    with open(token_count.DEFAULT_VOCABULARY) as f:
        vocab = set(json.load(f)["model"]["vocab"])
    s = token_count.byte_symbols()
    rows = [*ODD, (9, "x" * 3000 + " Hello, wörld!", "en", "a", 0, "x")]
    got = sorted((r.doc_id or 0, r.n_words, r.n_tokens) for r in token_count.count_tokens(docs_of(spark, rows), cache_words=2).collect())
    want = []
    for k, t, *_ in rows:
        c = Counter((t or "").encode().split())
        want.append((k or 0, sum(c.values()), sum(n * greedy(s[32] + "".join(s[b] for b in w), vocab) for w, n in c.items())))
    assert got == sorted(want)
    assert token_count.count_tokens(docs_of(spark, [])).count() == 0


def test_mixing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again)) and len(rows) == docs.count()
    assert all(0 <= r.taken <= 2 * r["size"] for r in rows)
    total = sum(r["size"] for r in rows)
    by = {}
    for r, d in zip(sorted(rows, key=lambda r: r.doc_id), docs.orderBy("doc_id").collect(), strict=True):
        x = by.setdefault(d.source, [0, r.target, r.source_size])
        x[0] += r.taken
    assert abs(sum(t for _, t, _ in by.values()) - 1.5 * total) < 1e-6 * total
    assert all(abs(n - t) <= mixing.BLOCK and t <= 2 * s for n, t, s in by.values())
    texts = mixing.mix_documents(docs)
    assert texts.columns == docs.columns
    taken, whole = {r.doc_id: r.taken for r in rows}, {r.doc_id: r.text for r in docs.collect()}
    got = Counter()
    mixed = texts.collect()
    for r in mixed:
        got[r.doc_id] += len(r.text.encode().split())
        assert r.text in whole[r.doc_id] and r.n_chars == len(r.text)
    assert got == Counter({k: v for k, v in taken.items() if v})
    first = {r.doc_id: r.first_slot for r in rows}
    seen = list(dict.fromkeys(r.doc_id for r in mixed))
    assert [first[k] for k in seen] == sorted(first[k] for k in seen)


def test_mixing_order_follows_the_points(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sized = docs.select("doc_id", "source", F.size(F.split("text", " ")).cast("long").alias("size"))
    targets = mixing.source_targets(sized).cache()
    share = {r.sid: r.quota / r.quotas for r in targets.collect()}
    slots = mixing.slot_schedule(targets).orderBy("slot").collect()
    assert len(slots) == len({r.slot for r in slots}) == targets.agg(F.max("quotas")).first()[0]
    assert Counter(r.sid for r in slots) == Counter({r.sid: r.quota for r in targets.collect()})
    counts = Counter()
    for i, r in enumerate(slots, 1):
        counts[r.sid] += 1
        assert r.rank == counts[r.sid] - 1
        if i % 97 == 0:
            assert all(abs(counts[s] - i * x) <= 6 for s, x in share.items())
    before = {r.doc_id: r.first_slot for r in mixing.mix(docs).collect()}
    monkeypatch.setattr(mixing, "PHI", 0.4142135623730951)
    after = {r.doc_id: r.first_slot for r in mixing.mix(docs).collect()}
    assert before != after and sorted(before, key=lambda k: (before[k] is None, before[k])) != sorted(after, key=lambda k: (after[k] is None, after[k]))


def test_mixing_keeps_blanks_and_repeated_rows(spark):
    text = " a\tb\n\nc  d\x0be f "
    got = spark.createDataFrame([(text,)], "text string").select(*(mixing.words_between(F.col("text"), F.lit(s), F.lit(n)) for s, n in ((0, 2), (1, 3), (4, 2), (0, 6), (5, 9)))).first()
    assert list(got) == ["a\tb", "b\n\nc  d", "e f", "a\tb\n\nc  d\x0be f", "f"]
    rows = [(1, "x " * 200, "en", "a", 400, "e")] * 3 + [(1, "x " * 200, "en", "a", 400, "other"), (None, "y " * 300, "en", "b", 600, None)]
    mixed = mixing.mix_documents(docs_of(spark, rows)).collect()
    assert sum(len(r.text.split()) for r in mixed if r.source == "a") == sum(r.taken for r in mixing.mix(docs_of(spark, rows)).collect() if r.doc_id == 1)
    assert {r.extra for r in mixed if r.source == "a"} <= {"e", "other"}


def test_mixing_odd_rows(spark):
    rows = mixing.mix(docs_of(spark, ODD)).collect()
    assert len(rows) == len(ODD) and all(r.taken <= 2 * r["size"] for r in rows)
    assert mixing.mix_documents(docs_of(spark, ODD)).columns[-1] == "extra"
    assert mixing.mix(docs_of(spark, [])).count() == 0 and mixing.mix_documents(docs_of(spark, [])).count() == 0
    assert [r.taken for r in mixing.mix(docs_of(spark, ODD[:2])).collect()] == [0, 0]

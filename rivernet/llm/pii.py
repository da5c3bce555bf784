"""Personal data: patterns, and terms that give a protected value away.

Patterns find e-mail addresses, IP addresses, card and phone numbers.  A value
found in several documents is a protected entity; a term of those documents
discloses it as far as its pointwise mutual information with the entity, over
all documents, comes near the entity's own information.  Terms over the lower
threshold are generalised, over the upper one removed, in every document that
holds them: without the entity, too, they give it away.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, cut, let, running, text_of, words_of

KINDS = ("email", "ip", "card", "phone", "term", "term")
GENERALISED, REMOVED = 4, 5
GENERALISE_AT, REMOVE_AT, LEAST_TOGETHER = 0.7, 0.9, 3
BROADCAST_ROWS, SALTS, STRIP, ALTERNATIVES = 500_000, 32, 4096, 64
# Possessive forms of the patterns; a look-behind keeps each run from being tried again at every character.
LOCAL, LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
PATTERNS = (
    rf"(?:\G|(?<!{LOCAL})){LOCAL}++@{LABEL}++(?:\.{LABEL}++)++",
    r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    r"[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
IP = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])){3}$"
FOUND = "array<struct<start:int,kind:int,end:int,value:string>>"
TOKENS = ("<EMAIL>", "<IP>", "<CARD>", "<PHONE>", "<TERM>", "")


def matches(text: Column, pattern: Column, kind: int) -> Column:
    """All matches from left to right as array<struct<start, kind, end, value>>, in code points."""
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("between"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("value"))
    length = lambda p: F.length(p["between"]) + F.coalesce(F.length(p["value"]), F.lit(0))

    def spans(parts: Column, ends: Column) -> Column:
        span = lambda p, i: F.struct((F.get(ends, i) - F.length(p["value"])).alias("start"), F.lit(kind).alias("kind"), F.get(ends, i).alias("end"), p["value"].alias("value"))
        return F.filter(F.transform(parts, span), lambda s: s["value"].isNotNull())

    return let(parts, lambda p: let(running(F.transform(p, length), lambda a, b: a + b), lambda ends: spans(p, ends)))


def _luhn(digits: Column) -> Column:
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    values = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 1, doubled(c.cast("int"))).otherwise(c.cast("int")))
    return F.aggregate(values, F.lit(0), lambda a, b: a + b) % 10 == 0


def _holds(kind: int, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == 1:
        return value.rlike(IP)
    if kind == 2:
        return F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(False)
    return F.length(digits).between(9, 15)


def _valid(kind: int, span: Column) -> Column:
    return _holds(kind, span["value"])


def base_spans(text: Column) -> Column:
    """Spans of the four patterns, by start, then kind."""
    none = F.array().cast(FOUND)
    digit = text.rlike("[0-9]")
    when = (F.contains(text, F.lit("@")), digit & F.contains(text, F.lit(".")), digit, digit & F.contains(text, F.lit("+")))
    found = []
    for kind, (pattern, likely) in enumerate(zip(PATTERNS, when, strict=True)):
        spans = matches(text, F.lit(pattern), kind)
        found.append(F.when(likely, spans if kind == 0 else F.filter(spans, partial(_valid, kind))).otherwise(none))
    return F.array_sort(F.concat(*found))


def spans_text(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat(F.get(names, s["kind"]), F.lit(":"), s["start"], F.lit(":"), s["end"])), ",")


def marked(docs: DataFrame) -> DataFrame:
    """text (null: empty), mark and n (which tell texts apart), base (its spans)."""
    rows = docs.withColumn("text", text_of())
    return rows.withColumns({"mark": F.xxhash64("text"), "n": F.length("text"), "base": base_spans(F.col("text"))})


def _held_by(seed: int) -> Column:
    """Aggregate: a hash of the set of texts of a group's rows, each text once."""
    return F.bit_xor(F.xxhash64("mark", "n", F.lit(seed)))


def disclosing_terms(rows: DataFrame, least: int = LEAST_TOGETHER, generalise_at: float = GENERALISE_AT) -> DataFrame:
    """term, disclosure: the terms over the threshold, each with the most it discloses of any entity.

    ``rows`` are documents as from ``marked``.  Terms are lower-cased words, by
    hash.  Every document counts, copies too; a pair counts from ``least``
    documents on.  disclosure = pmi(term, entity) / -ln p(entity).

    A term that lies in more than N ** (1 - threshold) * n_entity ** threshold
    of N documents can't reach the threshold, so frequent words drop out before
    pairs are counted.  Entities that the same texts hold are one class, and so
    are terms: lists of many values that several texts share make one pair, not
    the product of their lengths.
    """
    total = rows.count()
    # Copies of a text count through ``copies``; the texts come in once rare entities are gone.
    some = rows.filter(F.size("base") > 0)
    values = F.transform("base", lambda s: F.xxhash64(F.lower(s["value"])))
    texts = cut(some.select("mark", "n", F.array_distinct(values).alias("values")).groupBy("mark", "n").agg(F.count("*").alias("copies"), F.first("values").alias("values")))
    holding = texts.select("mark", "n", "copies", F.explode("values").alias("entity"))
    known = cut(holding.groupBy("entity").agg(F.sum("copies").alias("n_entity"), _held_by(1).alias("e1"), _held_by(2).alias("e2")).filter(F.col("n_entity") >= least))
    of_entities = ["n_entity", "e1", "e2"]
    by_text = cut(holding.join(known, "entity").select("mark", "n", "copies", *of_entities).distinct())
    at_most = lambda n: F.pow(F.lit(float(max(total, 1))), F.lit(1 - generalise_at)) * F.pow(n, F.lit(generalise_at)) * (1 + 1e-9)
    most = known.agg(at_most(F.max("n_entity")).alias("most")).first()["most"] or 0.0
    hashes = F.array_distinct(F.transform(words_of(F.col("text")), lambda w: F.xxhash64(F.lower(w))))
    terms = cut(rows.select(F.explode(hashes).alias("term")).groupBy("term").agg(F.count("*").alias("n_term")).filter(F.col("n_term").between(least, most)))
    marks = by_text.select(F.col("mark").alias("m"), F.col("n").alias("k")).distinct()
    held = some.select("mark", "n", "text").join(marks, (F.col("mark") == F.col("m")) & (F.col("n") == F.col("k")), "left_semi").dropDuplicates(["mark", "n"])
    words = held.select("mark", "n", F.explode(hashes).alias("term"))
    words = cut(words.join(F.broadcast(terms) if terms.count() <= BROADCAST_ROWS else terms, "term"))
    of_terms = ["n_term", "t1", "t2"]
    classes = cut(words.groupBy("term").agg(F.first("n_term").alias("n_term"), _held_by(1).alias("t1"), _held_by(2).alias("t2")))
    held_classes = words.select("mark", "n", "term").join(classes, "term").select("mark", "n", *of_terms).distinct()
    pairs = held_classes.join(by_text, ["mark", "n"]).filter(F.col("n_term") <= at_most(F.col("n_entity")))
    together = pairs.groupBy(*of_terms, *of_entities).agg(F.sum("copies").alias("n_both")).filter(F.col("n_both") >= least)
    pmi = F.ln(F.col("n_both") * F.lit(float(total)) / (F.col("n_term") * F.col("n_entity")))
    scored = together.withColumn("disclosure", F.try_divide(pmi, F.ln(F.lit(float(total)) / F.col("n_entity")))).filter(F.col("disclosure") >= generalise_at)
    return classes.join(scored.groupBy(*of_terms).agg(F.max("disclosure").alias("disclosure")), of_terms).select("term", "disclosure")


def telling_words(rows: DataFrame, levels: DataFrame, few: bool) -> DataFrame:
    """mark, n, word, level: the words of each text whose lower-cased form is in ``levels(term, level)``, as they stand there, once each.

    ``few`` levels are broadcast; many are met by salted keys, as a term may be in a great part of the texts.
    """
    words = rows.select("mark", "n", F.explode(F.array_distinct(words_of(F.col("text")))).alias("word")).withColumn("term", F.xxhash64(F.lower("word")))
    hit = words.join(F.broadcast(levels), "term") if few else _salted(words.distinct(), levels)
    return hit.select("mark", "n", "word", "level").distinct()


def _salted(words: DataFrame, levels: DataFrame) -> DataFrame:
    salted = levels.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return words.withColumn("salt", F.pmod(F.col("mark"), F.lit(SALTS)).cast("int")).join(salted, ["term", "salt"]).drop("salt")


def term_spans(rows: DataFrame, least: int = LEAST_TOGETHER, generalise_at: float = GENERALISE_AT, remove_at: float = REMOVE_AT) -> DataFrame:
    """mark_of, n_of, terms: the spans of disclosing terms in each text that holds any, with their entity or without.

    A word is a term if the hash of its lower-cased form is one's.  A text with
    up to ALTERNATIVES different ones is searched for just these words, as they
    stand there; of one with more every word is looked up: the same words.
    """
    level = F.when(F.col("disclosure") >= remove_at, F.lit(REMOVED)).otherwise(F.lit(GENERALISED))
    levels = cut(disclosing_terms(rows, least, generalise_at).groupBy("term").agg(F.max(level).alias("level")))
    few = levels.count() <= BROADCAST_ROWS
    quoted = F.concat(F.lit("\\Q"), F.replace(F.col("word"), F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    words = lambda k: F.array_sort(F.collect_list(F.when(F.col("level") == k, quoted))).alias(f"of_{k}")
    by_text = cut(telling_words(rows, levels, few).groupBy(F.col("mark").alias("m"), F.col("n").alias("k")).agg(*map(words, (GENERALISED, REMOVED)), (F.count("*") > ALTERNATIVES).alias("many")))
    of = [F.col("mark").alias("mark_of"), F.col("n").alias("n_of")]
    texts = rows.select("mark", "n", "text").join(by_text, (F.col("mark") == F.col("m")) & (F.col("n") == F.col("k"))).dropDuplicates(["mark", "n"])
    whole = lambda c: F.concat(F.lit("(?<![^\\x20\\x09-\\x0D])(?:"), F.array_join(c, "|"), F.lit(")(?![^\\x20\\x09-\\x0D])"))
    none = F.array().cast(FOUND)
    found = [F.when(F.size(f"of_{k}") > 0, matches(F.col("text"), whole(f"of_{k}"), k)).otherwise(none) for k in (GENERALISED, REMOVED)]
    some = texts.filter("NOT many").select(*of, F.concat(*found).alias("terms"))
    if by_text.filter("many").isEmpty():
        return some
    word = F.lit(f"{WHITE[0]}^{WHITE[1:]}")
    each = F.transform(matches(F.col("text"), word, GENERALISED), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.xxhash64(F.lower(s["value"])).alias("term")))
    every = texts.filter("many").select("mark", "n", F.explode(each).alias("w")).select("mark", "n", "w.*")
    span = F.struct("start", F.col("level").alias("kind"), "end", F.lit("").alias("value"))
    met = every.join(F.broadcast(levels), "term") if few else _salted(every, levels)
    return some.unionByName(met.groupBy(*of).agg(F.collect_list(span).alias("terms")))


def apart(base: Column, terms: Column) -> Column:
    """The base spans, and the terms that meet none of them, by start, then kind."""
    is_base = lambda s: s["kind"] < GENERALISED

    def kept(spans: Column) -> Column:
        before = running(F.transform(spans, lambda s: F.when(is_base(s), s["end"]).otherwise(0)), F.greatest)
        after = F.reverse(running(F.reverse(F.transform(spans, lambda s: F.when(is_base(s), s["start"]).otherwise(2**31 - 1))), F.least))
        free = lambda b, a: F.filter(spans, lambda s, i: is_base(s) | ((F.get(b, i) <= s["start"]) & (F.get(a, i) >= s["end"])))
        return let(before, lambda b: let(after, lambda a: free(b, a)))

    return let(F.array_sort(F.concat(base, terms)), kept)


def with_spans(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """Adds spans: the base spans and those terms that meet none of them."""
    joined = rows.join(terms, (F.col("mark") == F.col("mark_of")) & (F.col("n") == F.col("n_of")), "left")
    return joined.withColumn("spans", F.when(F.col("terms").isNull(), F.col("base")).otherwise(apart(F.col("base"), F.col("terms")))).drop("mark_of", "n_of", "terms")


def find_personal_data(docs: DataFrame, least: int = LEAST_TOGETHER) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term of every row.

    Null and empty texts have no spans.  Repeated rows give the same spans each.
    Offsets are code points, the end exclusive.  Very long texts are searched
    whole; an empty table gives an empty result; further columns are left out.
    """
    rows = marked(docs.select("doc_id", "text"))
    slim = cut(rows.select("doc_id", "mark", "n", F.transform("base", lambda s: s.dropFields("value").withField("value", F.lit(""))).alias("base")))
    out = with_spans(slim, term_spans(rows, least))
    n_of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return out.select(
        "doc_id", *(n_of(k).alias(f"n_{KINDS[k]}") for k in range(4)), F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"),
        spans_text(F.col("spans")).alias("spans"), (n_of(GENERALISED) + n_of(REMOVED)).alias("n_term"),
    )


def masked(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind's token; what overlaps goes with the earlier span.

    Texts are read by strips of STRIP code points, so that reaching a place doesn't take a walk from the start.
    """
    tokens = F.array(*map(F.lit, TOKENS))

    def piece(strips: Column, start: Column, end: Column) -> Column:
        first = F.floor(start / STRIP).cast("int")
        near = F.array_join(F.slice(strips, first + 1, F.floor((end - 1) / STRIP).cast("int") - first + 1), "")
        return F.when(end <= start, F.lit("")).otherwise(F.substring(near, start - first * STRIP + 1, end - start))

    def put(strips: Column, ends: Column) -> Column:
        at = lambda i: F.when(i == 0, 0).otherwise(F.get(ends, i - 1))
        new = lambda s, i: F.when(s["start"] >= at(i), F.concat(piece(strips, at(i), s["start"]), F.get(tokens, s["kind"]))).otherwise("")
        return F.concat(F.array_join(F.transform(spans, new), ""), piece(strips, F.get(ends, F.size(ends) - 1), F.length(text)))

    strips = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{STRIP}}}"), F.lit(0))
    return let(strips, lambda s: let(running(F.transform(spans, lambda x: x["end"]), F.greatest), lambda ends: put(s, ends)))


def sanitise(docs: DataFrame, least: int = LEAST_TOGETHER) -> DataFrame:
    """``docs`` with personal data and disclosing terms masked in text; n_chars, if there, follows.

    Null texts stay null, repeated rows are masked alike, very long texts whole.
    An empty table stays empty; columns may have any names.
    """
    rows = marked(docs.select(F.struct("*").alias("_row"), "text"))
    out = with_spans(rows, term_spans(rows.select("text", "mark", "n", "base"), least))
    out = out.withColumn("_text", F.when(F.size("spans") == 0, F.col("_row.text")).otherwise(masked(F.col("text"), F.col("spans"))))
    own = {"text": F.col("_text"), "n_chars": F.length("_text").cast("long")}
    return out.select(*(own.get(c, F.col("_row")[c]).alias(c) for c in docs.columns))

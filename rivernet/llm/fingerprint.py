"""SimHash fingerprints and permuted block tables.

A text's terms are its pairs of neighbouring words (and its last word alone),
each weighted by how often it occurs.  Every occurrence votes with the 64 bits
of the term's hash; the votes of two bits share one long sum, so one plain
aggregate counts them all.  Fingerprints within ``radius`` bits agree on three
of ``radius + 3`` blocks whole: one table per choice of three blocks finds them.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, text_of, words_of

BITS, LANES = 64, 0x0000000100000001
RADIUS, MATCHED = 3, 3
ROWS_A_BUCKET, MOST_BUCKETS = 2_000, 10_000


def term_hashes(words: Column) -> Column:
    """xxhash64 of each word with its follower; of the last word alone."""
    return F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1)))


def fingerprints(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, fingerprint (long) for every row; ``keys`` tell the rows apart.  A text without words has fingerprint 0."""
    words = texts.select(*keys, words_of(F.coalesce(F.col(text), F.lit(""))).alias("_words"))
    terms = words.select(*keys, F.explode_outer(term_hashes(F.col("_words"))).alias("_h"))
    lane = lambda i: F.sum(F.shiftrightunsigned("_h", i).bitwiseAND(F.lit(LANES))).alias(f"_v{i}")
    votes = terms.groupBy(*keys).agg(F.count("_h").alias("_n"), *map(lane, range(BITS // 2)))
    bits = F.lit(0).cast("long")
    for i in range(BITS // 2):
        low, high = F.col(f"_v{i}").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(f"_v{i}", 32)
        for count, place in ((low, i), (high, i + 32)):
            bits = bits.bitwiseOR(F.when(2 * count > F.col("_n"), F.shiftleft(F.lit(1).cast("long"), place)).otherwise(F.lit(0).cast("long")))
    return votes.select(*keys, bits.alias("fingerprint"))


def as_text(fingerprint: Column) -> Column:
    return F.lpad(F.lower(F.hex(fingerprint)), 16, "0")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / BITS


def block_masks(radius: int = RADIUS) -> list[int]:
    """Masks (as signed longs) of every choice of three blocks out of radius + 3."""
    n = radius + MATCHED
    edges = [BITS * i // n for i in range(n + 1)]
    blocks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    signed = lambda x: x - (1 << BITS) if x >> (BITS - 1) else x
    return [signed(sum(c)) for c in combinations(blocks, MATCHED)]


def within_radius(queries: DataFrame, known: DataFrame, radius: int = RADIUS) -> DataFrame:
    """query, fingerprint, bits: all of ``known`` within ``radius`` bits of each of ``queries`` (both distinct fingerprints).

    A pair that several tables hold comes from the first of them alone.
    """
    masks = F.array(*(F.lit(m).cast("long") for m in block_masks(radius)))
    spread = lambda df, name: df.select(F.col("fingerprint").alias(name), F.explode(masks).alias(f"mask_{name}")).withColumn(f"key_{name}", F.col(name).bitwiseAND(F.col(f"mask_{name}")))
    a, b = spread(queries, "query"), spread(known, "found")
    apart = F.col("query").bitwiseXOR(F.col("found"))
    first = F.get(F.filter(masks, lambda m: apart.bitwiseAND(m) == 0), F.lit(0))
    near = (F.col("mask_query") == F.col("mask_found")) & (F.col("key_query") == F.col("key_found"))
    pairs = a.join(b, near & (F.bit_count(apart) <= radius) & (first == F.col("mask_query")))
    return pairs.select("query", F.col("found").alias("fingerprint"), F.bit_count(apart).alias("bits"))


def _ranges(docs: DataFrame, rows: int, most: int) -> tuple[Column, list[tuple[int, int | None]]]:
    """Bucket of a doc_id (0 for null, then ascending ranges) and (bucket, largest doc_id) of every bucket with rows."""
    ids = docs.agg(F.count("doc_id").alias("n")).first()["n"]
    n = max(1, min(most, ids // rows))
    fractions = [i / n for i in range(1, n)]
    edges = sorted(set(docs.agg(F.percentile_approx("doc_id", fractions, 100 * n).alias("e")).first()["e"] or [])) if n > 1 else []
    # Two levels: about the root of the edges is looked at twice.
    step = max(1, int(len(edges) ** 0.5))
    groups = [edges[i : i + step] for i in range(0, len(edges), step)]
    doc_id = F.col("doc_id")
    if groups:
        longs = lambda values: F.array(*(F.lit(v).cast("long") for v in values))
        below = lambda values: F.size(F.filter(values, lambda e: e < doc_id))
        group = F.greatest(below(longs(g[0] for g in groups)) - 1, F.lit(0))
        bucket = 1 + group * step + below(F.get(F.array(*map(longs, groups)), group))
    else:
        bucket = F.lit(1)
    bucket = F.when(doc_id.isNull(), F.lit(0)).otherwise(bucket).cast("int")
    heads = docs.groupBy(bucket.alias("bucket")).agg(F.max("doc_id").alias("head")).collect()  # one row a bucket, at most ``most``
    return bucket, sorted((r["bucket"], r["head"]) for r in heads)


def with_next(docs: DataFrame, rows: int = ROWS_A_BUCKET, most: int = MOST_BUCKETS) -> DataFrame:
    """bucket, nth, last, doc_id, text, next_text: each text with the next one's, by descending doc_id, round the end.

    Rows lie in ranges of doc_id; a row marked ``last`` closes a range and holds
    the next range's first text.  Equal doc_ids follow by text, nulls come last.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", text_of().alias("text"))
    bucket, heads = _ranges(docs, rows, most)
    if not heads:
        return docs.select(F.lit(0).alias("bucket"), F.lit(0).alias("nth"), F.lit(False).alias("last"), "doc_id", "text", F.col("text").alias("next_text"))
    after = [(heads[i][0], heads[i - 1][1]) for i in range(len(heads))]
    ends = spark.createDataFrame(after, "bucket int, head long")
    ids = [h for _, h in heads if h is not None]
    first = docs.filter(F.col("doc_id").isin(ids) | F.col("doc_id").isNull()).groupBy("doc_id").agg(F.min("text").alias("text"))
    ends = ends.join(first, F.col("head").eqNullSafe(F.col("doc_id"))).select("bucket", F.lit(True).alias("last"), "doc_id", "text")
    every = docs.select(bucket.alias("bucket"), F.lit(False).alias("last"), "doc_id", "text").unionByName(ends)
    order = W.partitionBy("bucket").orderBy("last", F.col("doc_id").desc_nulls_last(), "text")
    return every.withColumn("nth", F.row_number().over(order)).withColumn("next_text", F.lead("text").over(order))


def fingerprint_documents(docs: DataFrame, radius: int = RADIUS, every: int = 20) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_near.

    ``n_near``: for rows whose doc_id ``every`` divides, how many other rows have
    a fingerprint within ``radius`` bits; null for the rest.  Null texts count
    as empty, rows with a null doc_id come last in the order, repeated rows
    follow each other.  The one row of a table is its own next document, an empty
    table gives an empty result.  Very long texts enter whole; further columns
    are left out.
    """
    n = F.length("text").cast("long")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), (n - half).cast("int")), F.substring("next_text", F.lit(1), half))
    rows = with_next(docs).select("bucket", "nth", "last", "doc_id", "text", n.alias("n_chars"), F.when(~F.col("last"), edited).alias("edited"))
    sha = F.sha2(F.col("edited"), 256)
    keys = ["bucket", "nth", "last", "doc_id", "n_chars", "edited_sha256", "kind"]
    texts = rows.withColumn("edited_sha256", sha).select(*keys[:-1], F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("text")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("text")))).alias("t"))
    texts = texts.select(*keys[:-1], "t.kind", "t.text").filter("kind = 0 OR NOT last")
    prints = fingerprints(texts, keys)
    pick = lambda k, name: F.max(F.when(F.col("kind") == k, F.col("fingerprint"))).alias(name)
    both = prints.groupBy(*keys[:-1]).agg(pick(0, "fingerprint"), pick(1, "edited_fingerprint"))
    both = both.withColumn("next", F.lead("fingerprint").over(W.partitionBy("bucket").orderBy("nth")))
    both = cut(both.filter("NOT last").drop("bucket", "nth", "last"))
    known = both.groupBy("fingerprint").agg(F.count("*").alias("rows"))
    asked = both.filter(F.col("doc_id") % every == 0).select("fingerprint").distinct()
    found = within_radius(asked, known.select("fingerprint"), radius).join(known, "fingerprint")
    n_near = found.groupBy("query").agg((F.sum("rows") - 1).alias("n_near"))
    out = both.join(n_near, (F.col("fingerprint") == F.col("query")) & (F.col("doc_id") % every == 0), "left")
    return out.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("fingerprint")).alias("fingerprint"), as_text(F.col("edited_fingerprint")).alias("edited_fingerprint"),
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next")).alias("near_next"), "n_near",
    )

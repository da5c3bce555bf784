"""Mixing sources to target weights by a low-discrepancy schedule.

Every source's documents, shuffled, form one stream of words that is cut into
equal blocks.  Slot k of the mix takes the golden-ratio point frac(k * phi)
through the cumulative quotas to a source; the slot's rank within its source is
the block it reads, wrapping round where a source is read more than once.  The
mix is in the order of slots: every stretch of it holds each source near its share.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ENDS, WHITE, cut, n_words, text_of

WEIGHTS, SHARE, MOST, BLOCK = (3, 1, 2), 1.5, 2, 64
PHI = 0.6180339887498949
SHUFFLE_BITS, CHUNK, CELLS = 12, 8192, 1024
# Fixed values of the shuffle: multiplier and modulus of the order key, and what sizes add so that rows of one doc_id don't meet in one part.
MULTIPLIER, MODULUS, SPREAD = 2654435761, 1 << 32, 7919


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """One row a source: sid, source, weight, source_size, target, blocks, quota, lo, hi, quotas.

    Sources rank by code point, null last, and take the weights in turn.  Targets
    share ``share`` times all words by weight; one above ``most`` times its
    source's size stops there and the excess is shared again (in one pass over
    the sources ordered by size per weight).  Quotas are targets in blocks.
    """
    by_name, by_ratio = W.orderBy(F.col("source").asc_nulls_last()), W.orderBy(F.col("source_size") / F.col("weight"), "sid")
    every = W.partitionBy()
    pick = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("sid") - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("sid", F.row_number().over(by_name)).withColumn("weight", pick).withColumn("cap", most * F.col("source_size"))
    before = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(by_ratio.rowsBetween(0, W.unboundedFollowing))
    s = s.withColumn("total", share * F.sum("source_size").over(every)).withColumn("full", F.col("cap") <= (F.col("total") - before) / left * F.col("weight"))
    level = F.try_divide(
        F.max("total").over(every) - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(every),
        F.sum(F.when(~F.col("full"), F.col("weight"))).over(every),
    )
    s = s.withColumn("target", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(level * F.col("weight")))
    s = s.withColumn("blocks", F.ceil(F.col("source_size") / block)).withColumn("passes", F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)))
    rest = F.round((F.col("target") - F.col("passes") * F.col("source_size")) / block).cast("long")
    s = s.withColumn("quota", F.col("passes") * F.col("blocks") + F.least(rest, F.col("blocks")))
    s = s.withColumn("hi", F.sum("quota").over(by_name)).withColumn("lo", F.col("hi") - F.col("quota")).withColumn("quotas", F.sum("quota").over(every))
    return s.select("sid", "source", "weight", "source_size", "target", "blocks", "quota", "lo", "hi", "quotas")


def slot_schedule(targets: DataFrame, chunk: int = CHUNK, cells: int = CELLS) -> DataFrame:
    """sid, slot, rank, block, pass: the blocks that the mix takes, ``quota`` of each source.

    The points come through a grid of cells, so that finding a slot's source is
    an equi-join.  Ranks are counted within chunks of slots and added up over
    the chunks.  Slots of a source beyond its quota stay empty; what the margin
    of spare slots leaves open comes behind them all.
    """
    spark = targets.sparkSession
    quotas = targets.agg(F.max("quotas")).first()[0] or 0
    n_slots = quotas + quotas // 64 + 256 if quotas else 0
    point = F.col("slot") * F.lit(PHI)
    slots = spark.range(n_slots).withColumnRenamed("id", "slot")
    slots = slots.withColumn("at", F.floor((point - F.floor(point)) * quotas)).withColumn("cell", F.expr(f"at * {cells}L div {max(quotas, 1)}L"))
    spans = targets.filter("quota > 0").select("sid", "quota", "blocks", "lo", "hi", F.explode(F.expr(f"sequence(lo * {cells}L div quotas, (hi - 1) * {cells}L div quotas)")).alias("cell"))
    drawn = slots.join(spans, "cell").filter("at >= lo AND at < hi").select("sid", "quota", "blocks", "slot", F.expr(f"slot div {chunk}").alias("chunk"))
    counts = drawn.groupBy("sid", "chunk").agg(F.count("*").alias("n"))
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(W.partitionBy("sid").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    ranked = drawn.withColumn("nth", F.row_number().over(W.partitionBy("sid", "chunk").orderBy("slot"))).join(counts.select("sid", "chunk", "before"), ["sid", "chunk"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("nth") - 1).filter("rank < quota").select("sid", "slot", "rank", "blocks")
    reached = counts.groupBy("sid").agg(F.sum("n").alias("n"))
    short = targets.join(reached, "sid", "left").withColumn("n", F.coalesce("n", F.lit(0))).filter("n < quota")
    tail = short.select("sid", "lo", "blocks", F.explode(F.expr("sequence(n, quota - 1)")).alias("rank")).select("sid", (F.lit(n_slots) + F.col("lo") + F.col("rank")).alias("slot"), "rank", "blocks")
    return ranked.unionByName(tail).select("sid", "slot", "rank", F.expr("rank % blocks").alias("block"), F.expr("rank div blocks").alias("pass"))


def shuffled_streams(sized: DataFrame, targets: DataFrame, bits: int = SHUFFLE_BITS) -> DataFrame:
    """Adds sid and ``at``, the words before each row in its source's shuffled stream.

    The sums run within ranges of the shuffle key, then over the ranges, so that
    no task holds a whole source.
    """
    key = F.pmod(F.pmod(F.coalesce("doc_id", F.lit(0)) + SPREAD * F.col("size"), F.lit(1 << 31)) * F.lit(MULTIPLIER), F.lit(MODULUS))
    rows = sized.join(targets.select("sid", F.col("source").alias("name")), F.col("source").eqNullSafe(F.col("name"))).drop("name")
    rows = rows.withColumn("key", key).withColumn("part", F.shiftright("key", 32 - bits))
    past = lambda w: F.coalesce(F.sum("size").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = rows.groupBy("sid", "part").agg(F.sum("size").alias("size"))
    parts = parts.select("sid", "part", past(W.partitionBy("sid").orderBy("part")).alias("base"))
    order = [c for c in sized.columns if c not in ("doc_id", "source")]
    rows = rows.withColumn("inside", past(W.partitionBy("sid", "part").orderBy("key", "doc_id", *order)))
    return rows.join(parts, ["sid", "part"]).withColumn("at", F.col("base") + F.col("inside")).drop("key", "part", "base", "inside")


def mixed_words(sized: DataFrame, targets: DataFrame, block: int = BLOCK) -> DataFrame:
    """The columns of ``sized``, sid, at, pass, skip, words, slot: for each pass that takes words of a row how
    many, after how many of them, and the first slot that does."""
    rows = shuffled_streams(sized.filter("size > 0"), targets)
    keep = rows.columns
    pieces = rows.withColumn("block", F.explode(F.expr(f"sequence(at div {block}, (at + size - 1) div {block})")))
    pieces = pieces.withColumn("skip", F.greatest(F.col("block") * block - F.col("at"), F.lit(0))).withColumn("part", F.least(F.col("size"), (F.col("block") + 1) * block - F.col("at")) - F.col("skip"))
    both = pieces.join(slot_schedule(targets).drop("rank"), ["sid", "block"])
    return both.groupBy(*keep, "pass").agg(F.min("skip").alias("skip"), F.sum("part").alias("words"), F.min("slot").alias("slot"))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """doc_id, size, source_size, target, taken, first_slot (null if nothing is taken) for every row.

    Null and empty texts have size 0 and take nothing.  A null source is a
    source of its own; a null doc_id shuffles as 0.  Repeated rows are placed
    one by one.  An empty table gives an empty result.
    """
    sized = cut(docs.select("doc_id", "source", n_words(text_of()).alias("size")))
    targets = cut(source_targets(sized, weights, share, most, block))
    taken = mixed_words(sized, targets, block).groupBy("doc_id", "source", "size", "at").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"))
    rows = shuffled_streams(sized, targets).join(targets.select("sid", "source_size", "target"), "sid")
    taken = taken.select(F.col("doc_id").alias("id"), F.col("source").alias("name"), F.col("size").alias("words"), F.col("at").alias("start"), "taken", "first_slot")
    same = F.col("doc_id").eqNullSafe(F.col("id")) & F.col("source").eqNullSafe(F.col("name")) & (F.col("at") == F.col("start")) & (F.col("size") == F.col("words"))
    return rows.join(taken, same, "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), "first_slot")


def words_between(text: Column, skip: Column, words: Column) -> Column:
    """``words`` words of a text after the first ``skip``, with the blanks between them as they are."""
    pieces = F.split(F.ltrim(text, F.lit(ENDS)), f"(?<={WHITE[:-1]})(?={WHITE[0]}^{WHITE[1:-1]})")
    return F.rtrim(F.array_join(F.slice(pieces, (skip + 1).cast("int"), words.cast("int")), ""), F.lit(ENDS))


def mix_documents(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """The mix itself, in the order of slots: a row of ``docs`` for each pass that takes words of it.

    A row taken in part holds the words of the blocks that the pass takes;
    ``n_chars``, if there, follows the text.  Rows are known by two hashes of
    all their columns (but maps), so that of rows that are the same in all of
    them each is placed and drawn on its own.
    """
    hashed = [c for c in docs.columns if "map<" not in docs.schema[c].dataType.simpleString()]
    marks = {"_mark": F.xxhash64(F.lit(1), *hashed), "_mark2": F.xxhash64(F.lit(2), *hashed)}
    sized = cut(docs.select("doc_id", "source", n_words(text_of()).alias("size"), *(c.alias(n) for n, c in marks.items())))
    targets = cut(source_targets(sized, weights, share, most, block))
    drawn = ["_skip", "_words", "_size", "_slot"]
    plan = mixed_words(sized, targets, block).select("_mark", "_mark2", F.col("skip").alias("_skip"), F.col("words").alias("_words"), F.col("size").alias("_size"), F.col("slot").alias("_slot"))
    kept = docs.select(F.struct("*").alias("_row"), *(c.alias(n) for n, c in marks.items())).dropDuplicates(list(marks))
    both = kept.join(plan, list(marks)).select("_row", *drawn)
    text = F.when(F.col("_words") == F.col("_size"), F.col("_row.text")).otherwise(words_between(F.col("_row.text"), F.col("_skip"), F.col("_words")))
    own = {"text": F.col("_text"), "n_chars": F.length("_text").cast("long")}
    out = both.select("_row", "_slot", text.alias("_text")).select("_slot", *(own.get(c, F.col("_row")[c]).alias(f"_of_{c}") for c in docs.columns))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slots = 2 * (targets.agg(F.max("quotas")).first()[0] or 1) + 512  # beyond the last one
    placed = out.repartitionById(n, F.expr(f"cast(least(_slot * {n}L div {slots // 2}L, {n - 1}) as int)")).sortWithinPartitions("_slot")
    return placed.select(*(F.col(f"_of_{c}").alias(c) for c in docs.columns))


def oracle_sql(block: int = BLOCK) -> str:
    """DuckDB: the same schedule, its ranks by one window."""
    return rf"""
WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s1 AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
s2 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM s1),
s3 AS (SELECT *, ([3, 1, 2])[((sid - 1) % 3 + 1)::INT] AS weight, 2 * source_size AS cap FROM s2),
s4 AS (SELECT *, 1.5::DOUBLE * sum(source_size) OVER () AS total,
  coalesce(sum(cap) OVER (ORDER BY source_size / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  sum(weight) OVER (ORDER BY source_size / weight, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS remaining FROM s3),
s5 AS (SELECT *, cap <= (total - before::DOUBLE) / remaining::DOUBLE * weight AS filled FROM s4),
s6 AS (SELECT *, CASE WHEN filled THEN cap::DOUBLE ELSE
  (max(total) OVER () - (sum(CASE WHEN filled THEN cap ELSE 0 END) OVER ())::DOUBLE) / (sum(CASE WHEN NOT filled THEN weight END) OVER ())::DOUBLE * weight END AS target FROM s5),
s7 AS (SELECT *, ceil(source_size / {block})::BIGINT AS blocks, CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size)::BIGINT END AS passes FROM s6),
s8 AS (SELECT *, passes * blocks + least(round((target - passes * source_size) / {block})::BIGINT, blocks) AS quota FROM s7),
s9 AS (SELECT *, (sum(quota) OVER (ORDER BY sid))::BIGINT AS hi, (sum(quota) OVER ())::BIGINT AS quotas FROM s8),
slots AS (SELECT k, floor((k * {PHI}::DOUBLE - floor(k * {PHI}::DOUBLE)) * quotas)::BIGINT AS slot_at
  FROM (SELECT unnest(range((SELECT max(quotas + quotas // 64 + 256) FROM s9))) AS k), (SELECT max(quotas) AS quotas FROM s9)),
ranked AS (SELECT sid, k, quota, blocks, row_number() OVER (PARTITION BY sid ORDER BY k) - 1 AS rank
  FROM slots JOIN s9 ON slot_at >= hi - quota AND slot_at < hi),
tail AS (SELECT sid, (SELECT max(quotas + quotas // 64 + 256) FROM s9) + lo + unnest(range(n, quota)) AS k, blocks, unnest(range(n, quota)) AS rank
  FROM (SELECT s9.sid, any_value(s9.blocks) AS blocks, any_value(s9.quota) AS quota, any_value(s9.hi - s9.quota) AS lo, count(ranked.sid) AS n FROM s9 LEFT JOIN ranked USING (sid) GROUP BY s9.sid)),
taken_blocks AS (SELECT sid, rank % blocks AS block, count(*) AS times, min(k) AS k FROM
  (SELECT sid, k, blocks, rank FROM ranked WHERE rank < quota UNION ALL SELECT sid, k, blocks, rank FROM tail) GROUP BY ALL),
placed AS (SELECT doc_id, size, sid, source_size, target, coalesce(sum(size) OVER (PARTITION BY sid
    ORDER BY (((coalesce(doc_id, 0) + {SPREAD} * size) % 2147483648) * {MULTIPLIER}) % {MODULUS}, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_at
  FROM sized JOIN s9 ON sized.source IS NOT DISTINCT FROM s9.source),
pieces AS (SELECT doc_id, sid, start_at, size, unnest(range(start_at // {block}, (start_at + size - 1) // {block} + 1)) AS block FROM placed WHERE size > 0),
taken AS (SELECT doc_id, sid, start_at, sum((least(start_at + size, (block + 1) * {block}) - greatest(start_at, block * {block})) * times)::BIGINT AS taken, min(k)::BIGINT AS first_slot
  FROM pieces JOIN taken_blocks USING (sid, block) GROUP BY doc_id, sid, start_at)
SELECT p.doc_id, p.size, p.source_size, p.target, coalesce(t.taken, 0) AS taken, t.first_slot
FROM placed p LEFT JOIN taken t ON p.sid = t.sid AND p.start_at = t.start_at AND p.doc_id IS NOT DISTINCT FROM t.doc_id AND p.size > 0"""

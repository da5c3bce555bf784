"""Phrases whose words keep together, counted in counting quotient filters.

Words that are frequent enough get ids; the ids of a phrase are packed into one
number, which an invertible permutation spreads evenly.  Its upper bits, the
quotient, are a slot of a filter, the rest is kept in full, so that counters are
exact and phrases come back out of the filter.  Every task sends sorted filters
by ranges of the quotient; filters of one range are merged like sorted lists.
(Pandey, Bender, Johnson and Patro, "A general-purpose counting filter", 2017.)
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut
from .shingles import mixed
from .tokens import byte_set, runs_of, some_texts

LEAST, LONGEST, TOP, SCALE = 100, 5, 2_000, 1_000
BREAK = byte_set(*map(ord, ".,;:!?"), range(0x0A, 0x0E))
WORD = ~(BREAK | byte_set(0x20, 0x09))
TEXT_BYTES, FILTER_WORDS = 1 << 23, 1 << 22  # text of one filter; words of all texts for each range of quotients
MOST_KNOWN, BITMAP_BITS = 1 << 22, 26
ROUNDS = 3


# --- packed phrases, permuted ---


@dataclass(frozen=True)
class Packing:
    """Phrases of up to ``longest`` ids of ``id_bits`` bits, and their length, in ``parts`` numbers of ``part_bits`` bits."""

    id_bits: int
    longest: int = LONGEST

    @property
    def parts(self) -> int:
        return max(2, -(-(3 + self.longest * self.id_bits) // 60))

    @property
    def part_bits(self) -> int:
        return -(-(3 + self.longest * self.id_bits) // self.parts)

    @property
    def mask(self) -> np.uint64:
        return np.uint64((1 << self.part_bits) - 1)

    def pack(self, ids: np.ndarray) -> np.ndarray:
        """uint64 [phrases, parts] of ids [phrases, words]; the words lie bit by bit behind the length, over the bounds of parts."""
        out = np.zeros((len(ids), self.parts), np.uint64)
        out[:, 0] = np.uint64(ids.shape[1])
        for k in range(ids.shape[1]):
            self._put(out, 3 + k * self.id_bits, ids[:, k])
        return out

    def _put(self, out: np.ndarray, at: int, ids: np.ndarray) -> None:
        left, bits = ids.astype(np.uint64), self.id_bits
        while bits:
            part, low = divmod(at, self.part_bits)
            n = min(bits, self.part_bits - low)
            out[:, part] |= (left & np.uint64((1 << n) - 1)) << np.uint64(low)
            left, at, bits = left >> np.uint64(n) if n < 64 else np.zeros_like(left), at + n, bits - n

    def unpack(self, packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lengths, and ids [phrases, longest] of which the first few count."""
        ids = np.zeros((len(packed), self.longest), np.uint64)
        for k in range(self.longest):
            at, got = 3 + k * self.id_bits, 0
            while got < self.id_bits:
                part, low = divmod(at + got, self.part_bits)
                n = min(self.id_bits - got, self.part_bits - low)
                ids[:, k] |= ((packed[:, part] >> np.uint64(low)) & np.uint64((1 << n) - 1)) << np.uint64(got)
                got += n
        return (packed[:, 0] & np.uint64(7)).astype(np.int64), ids

    def permute(self, packed: np.ndarray) -> np.ndarray:
        """A bijection: every part in turn takes in a function of its neighbour."""
        out = packed.copy()
        for step in range(ROUNDS * self.parts):
            k = step % self.parts
            out[:, k] = (out[:, k] + mixed(out[:, k - 1] + np.uint64(step + 1))) & self.mask
        return out

    def restore(self, permuted: np.ndarray) -> np.ndarray:
        out = permuted.copy()
        for step in reversed(range(ROUNDS * self.parts)):
            k = step % self.parts
            out[:, k] = (out[:, k] - mixed(out[:, k - 1] + np.uint64(step + 1))) & self.mask
        return out


# --- counting quotient filters ---


def counted(permuted: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different rows and how often each is there (or the sums of ``counts``)."""
    if not len(permuted):
        return permuted, np.zeros(0, np.int64)
    order = np.lexsort(permuted.T[::-1])
    rows = permuted[order]
    new = np.flatnonzero(np.concatenate(([True], (rows[1:] != rows[:-1]).any(axis=1))))
    total = np.diff(np.append(new, len(rows))) if counts is None else np.add.reduceat(counts[order], new)
    return rows[new], total


def to_filter(packing: Packing, rows: np.ndarray, counts: np.ndarray, high: int) -> bytes:
    """A filter of sorted rows that share their ``high`` upper bits.

    It has about one slot a row: for each slot's quotient the length of its run;
    then the remainders, by bytes; then the counters, a byte each and the few
    that need more behind them.
    """
    slot_bits = min(max(0, len(rows).bit_length() - 1), packing.part_bits - high)
    rest = packing.part_bits - high - slot_bits
    slot = ((rows[:, 0] >> np.uint64(rest)) & np.uint64((1 << slot_bits) - 1)).astype(np.int64)
    runs = np.bincount(slot, minlength=1 << slot_bits)
    large = counts >= 255
    parts = [_large(runs), _bytes_of(rows[:, 0] & np.uint64((1 << rest) - 1), rest)]
    parts += [_bytes_of(rows[:, k], packing.part_bits) for k in range(1, packing.parts)]
    parts += [np.where(large, 255, counts).astype(np.uint8).tobytes(), counts[large].astype(np.int64).tobytes()]
    return np.array([len(rows), slot_bits, int(large.sum()), int((runs >= 255).sum())], np.int64).tobytes() + b"".join(parts)


def _large(runs: np.ndarray) -> bytes:
    return np.minimum(runs, 255).astype(np.uint8).tobytes() + runs[runs >= 255].astype(np.int64).tobytes()


def _width(bits: int) -> int:
    return -(-bits // 8)


def _bytes_of(values: np.ndarray, bits: int) -> bytes:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : _width(bits)]).tobytes()


def from_filter(packing: Packing, data: bytes, high: int, prefix: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted rows and counters of a filter whose rows have the ``high`` upper bits ``prefix``."""
    n, slot_bits, n_large, n_runs = np.frombuffer(data, np.int64, 4)
    at = 32

    def take(size: int) -> np.ndarray:
        nonlocal at
        at += size
        return np.frombuffer(data, np.uint8, size, at - size)

    def wide(values: np.ndarray, more: int) -> np.ndarray:
        out = values.astype(np.int64)
        out[values == 255] = take(8 * more).view(np.int64)
        return out

    def numbers(bits: int) -> np.ndarray:
        out = np.zeros((n, 8), np.uint8)
        out[:, : _width(bits)] = take(int(n) * _width(bits)).reshape(n, _width(bits))
        return out.view("<u8").reshape(-1).astype(np.uint64)

    runs = wide(take(1 << int(slot_bits)), int(n_runs))
    rest = packing.part_bits - high - int(slot_bits)
    rows = np.zeros((n, packing.parts), np.uint64)
    slot = np.repeat(np.arange(len(runs), dtype=np.uint64), runs)
    rows[:, 0] = np.uint64(prefix) << np.uint64(packing.part_bits - high) | slot << np.uint64(rest) | numbers(rest)
    for k in range(1, packing.parts):
        rows[:, k] = numbers(packing.part_bits)
    return rows, wide(take(int(n)), int(n_large))


# --- words and what is known of them ---


class Known:
    """A set of 64-bit keys: sorted, with the place of each, or above MOST_KNOWN a bitmap of fixed size that may hold others too."""

    def __init__(self, keys: DataFrame, column: str):
        self.count = keys.count()
        self.sorted = self.bitmap = None
        if self.count <= MOST_KNOWN:
            self.sorted = np.sort(np.asarray(keys.select(column).toArrow().column(0)).astype(np.int64).view(np.uint64))
        else:
            bit = F.shiftright(F.col(column), 64 - BITMAP_BITS).bitwiseAND(F.lit((1 << BITMAP_BITS) - 1))
            words = keys.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(bit & 63 AS INT))")).alias("bits"))
            self.bitmap = np.zeros(1 << (BITMAP_BITS - 6), np.uint64)
            for at, bits in zip(*(np.asarray(c) for c in words.toArrow().columns), strict=True):
                self.bitmap[at] = np.int64(bits).view(np.uint64)

    @property
    def id_bits(self) -> int:
        """Bits of an id: a place in the sorted keys, or the key itself."""
        return 64 if self.sorted is None else max(1, self.count.bit_length())

    def look_up(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether each key may be in the set, its id)"""
        if self.sorted is None:
            bit = keys >> np.uint64(64 - BITMAP_BITS)
            return (self.bitmap[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool), keys
        if not self.count:
            return np.zeros(len(keys), bool), keys
        at = np.minimum(np.searchsorted(self.sorted, keys), self.count - 1)
        return self.sorted[at] == keys, at.astype(np.uint64)

    def keys(self, ids: np.ndarray) -> np.ndarray:
        return ids if self.sorted is None else self.sorted[np.minimum(ids, np.uint64(max(0, self.count - 1))).astype(np.int64)] if self.count else ids


def word_key(hashes: np.ndarray, lang: np.ndarray, seed: int) -> np.ndarray:
    return mixed(hashes + mixed(lang + np.uint64(seed)))


def pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64 bits of two ids; different pairs may share one, which only makes the first look less sharp."""
    return mixed(a + mixed(b + np.uint64(1)))


def _langs(column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Names (null: und), the name's place of each row, a hash of each name."""
    coded = column.fill_null("und").dictionary_encode()
    names = coded.dictionary.to_pylist()
    return names, np.asarray(coded.indices).astype(np.int64), np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in names], np.uint64)


def _words(rows: pa.RecordBatch, texts: list[bytes], seed: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """data, start, end, key, piece, lang and the names of lang: every word of the texts in order."""
    names, lang, salt = _langs(rows.column("lang"))
    data = b"\n".join(texts).lower()
    start, end, h = runs_of(data, WORD)
    of = np.searchsorted(np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))), start, "right")
    breaks = np.flatnonzero(BREAK[np.frombuffer(data, np.uint8)])
    of_word = lang[of] if len(of) else np.empty(0, np.int64)
    return data, start, end, word_key(h, salt[of_word] if len(of) else np.empty(0, np.uint64), seed), np.searchsorted(breaks, start), of_word, names


def word_counts(docs: DataFrame, seed: int) -> DataFrame:
    """lang, word, key, n of ``docs(lang, text)``."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in some_texts(batches, "text", TEXT_BYTES):
            data, start, end, key, _, lang, names = _words(rows, texts, seed)
            one, first, n = np.unique(key, return_index=True, return_counts=True)
            words = pa.array([data[s:e] for s, e in zip(start[first].tolist(), end[first].tolist(), strict=True)], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(names, pa.string()).take(pa.array(lang[first])), words, pa.array(n.astype(np.int64))], names=["key", "lang", "word", "n"])

    found = docs.select("lang", "text").mapInArrow(words, "key long, lang string, word string, n long")
    return found.groupBy("lang", "word", "key").agg(F.sum("n").alias("n"))


def phrase_counts(docs: DataFrame, words: Known, seed: int, lengths: tuple[int, ...], pairs: Known | None, least: int, ranges: int) -> DataFrame:
    """ids (keys of words), n: phrases of the given numbers of words that occur ``least`` times or more.

    All words of a phrase must be ``words``, and with ``pairs`` all two words in
    a row one of these: others can't be frequent enough.
    """
    packing = Packing(words.id_bits, max(lengths))
    high = min(ranges.bit_length() - 1, packing.part_bits - 1)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((words, pairs))

    def filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pairs = shared.value
        for rows, texts in some_texts(batches, "text", TEXT_BYTES):
            _, _, _, key, piece, _, _ = _words(rows, texts, seed)
            known, ids = words.look_up(key)
            on = known[1:] & known[:-1] & (piece[1:] == piece[:-1])  # word i goes on with word i + 1
            if pairs is not None and len(ids) > 1:
                at = np.flatnonzero(on)
                on[at] = pairs.look_up(pair_key(words.keys(ids[at]), words.keys(ids[at + 1])))[0]
            some, go = [], on
            for m in range(2, max(lengths) + 1):
                go = on if m == 2 else go[:-1] & on[m - 2 :]
                if m in lengths:
                    start = np.flatnonzero(go)
                    some.append(packing.permute(packing.pack(np.stack([ids[start + k] for k in range(m)], axis=1))))
            entries, counts = counted(np.concatenate(some))
            part = (entries[:, 0] >> np.uint64(packing.part_bits - high)).astype(np.int64)
            bounds = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(part))
            blobs = [to_filter(packing, entries[s:e], counts[s:e], high) for s, e in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(part[bounds[:-1]]), pa.array(blobs, pa.binary())], names=["part", "filter"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, _ = shared.value
        for part, blobs in _by_part(batches):
            entries, counts = _merge(packing, [from_filter(packing, b, high, part) for b in blobs])
            often = counts >= least
            length, ids = packing.unpack(packing.restore(entries[often]))
            keys = words.keys(ids.reshape(-1)).reshape(ids.shape)[np.arange(packing.longest) < length[:, None]]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(length))), pa.int32()), pa.array(keys.view(np.int64)))
            yield pa.RecordBatch.from_arrays([lists, pa.array(counts[often].astype(np.int64))], names=["ids", "n"])

    sent = docs.select("lang", "text").mapInArrow(filters, "part long, filter binary")
    return sent.repartition("part").sortWithinPartitions("part").mapInArrow(merged, "ids array<long>, n long")


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    part, blobs = None, []
    for batch in batches:
        for p, b in zip(batch.column("part").to_pylist(), batch.column("filter").to_pylist(), strict=True):
            if p != part and blobs:
                yield part, blobs
                blobs = []
            part = p
            blobs.append(b)
    if blobs:
        yield part, blobs


def _merge(packing: Packing, filters: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    return counted(np.concatenate([r for r, _ in filters]), np.concatenate([c for _, c in filters]))


def candidate_phrases(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """Phrases (ids, n) and words (key, lang, word, n, total: all words of lang) that occur ``least`` times or more."""
    docs = docs.select("lang", "text")
    seed = 0
    while True:
        counts = cut(word_counts(docs, seed))
        if counts.groupBy("key").agg(F.count("*").alias("words")).filter("words > 1").isEmpty():
            break
        seed += 1  # two words, of one language or of two, share a key: take other keys
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    frequent = cut(counts.filter(F.col("n") >= least).select("key", "lang", "word", "n").join(totals, "lang"))
    n_words = counts.agg(F.sum("n")).first()[0] or 0
    ranges = max(1, n_words // FILTER_WORDS)
    words = Known(frequent, "key")
    two = cut(phrase_counts(docs, words, seed, (2,), None, least, ranges))
    pairs = Known(_pair_keys(two), "pair")
    more = cut(phrase_counts(docs, words, seed, tuple(range(3, LONGEST + 1)), pairs, least, ranges))
    return two.unionByName(more), frequent


def _pair_keys(two: DataFrame) -> DataFrame:
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = np.asarray(b.column("ids").flatten()).view(np.uint64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pair_key(ids[:, 0], ids[:, 1]).view(np.int64))], names=["pair"])

    return two.select("ids").mapInArrow(keys, "pair long").distinct()


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's phrases whose words keep together most.

    Null texts are empty, a null lang is ``und``.  Every row counts, repeated
    ones too.  Very long texts enter whole; an empty table gives an empty
    result; further columns are ignored.
    """
    phrases, words = candidate_phrases(docs, least)
    phrases = phrases.withColumn("size", F.size("ids"))
    known = phrases.select("ids", "n").unionByName(words.select(F.array("key").alias("ids"), "n"))
    ends = F.array(F.slice("ids", F.lit(1), F.col("size") - 1), F.slice("ids", F.lit(2), F.col("size") - 1))
    longer = phrases.filter("size > 2").select(F.explode(ends).alias("ids"), "n").groupBy("ids").agg(F.max("n").alias("most"))
    # The part of a longer phrase is as frequent as that phrase only if the part one word longer is, so looking at these is enough.
    free = phrases.join(longer, "ids", "left").filter(F.col("most").isNull() | (F.col("most") < F.col("n"))).drop("most")
    cuts = free.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select("ids", F.col("n").alias("a"), "k", F.slice("ids", F.lit(1), F.col("k")).alias("left"), F.slice("ids", F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    both = cuts.join(known.select(F.col("ids").alias("left"), F.col("n").alias("l")), "left").join(known.select(F.col("ids").alias("right"), F.col("n").alias("r")), "right")
    of_first = words.select(F.col("key").alias("of_key"), "lang", F.col("total").alias("total"))
    both = both.withColumn("of_key", F.get("ids", F.lit(0))).join(of_first, "of_key")
    score = F.expr(f"(CAST(a AS DECIMAL(19,0)) * CAST(total AS DECIMAL(15,0)) * CAST({SCALE} AS DECIMAL(4,0))) div (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0)))")
    least_cut = both.withColumn("score", score).groupBy("ids").agg(F.min(F.struct("score", "k", "a", "l", "r", "lang", "total")).alias("c")).select("ids", "c.*")
    near = least_cut.withColumn("place", F.rank().over(W.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc()))).filter(F.col("place") <= top).drop("place")
    spelt = near.select("*", F.posexplode("ids").alias("at", "key")).join(words.select("key", "word"), "key").groupBy("ids").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("parts"), F.first(F.struct("lang", "a", "l", "r", "total", "score")).alias("c"))
    out = spelt.select("c.*", F.array_join(F.col("parts.word"), " ").alias("phrase"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase"))
    return out.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


def oracle_sql(least: int = LEAST, top: int = TOP) -> str:
    """DuckDB: all phrases of all pieces, counted; sums in HUGEINT."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    phrases = "\nUNION ALL ".join(f"SELECT lang, unnest(list_transform(range(1, len(w) - {m - 2}), lambda i: w[i:i + {m - 1}])) AS p FROM pieces" for m in range(1, LONGEST + 1))
    return rf"""
WITH split AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{lower}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
pieces AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM split),
totals AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM pieces GROUP BY lang),
counts AS MATERIALIZED (SELECT lang, p, count(*) AS f FROM ({phrases}) GROUP BY lang, p HAVING count(*) >= {least}),
candidates AS (SELECT lang, p, f AS a, len(p) AS m FROM counts WHERE len(p) > 1),
inner_parts AS (SELECT lang, a, unnest(list_transform(range(2, m), lambda size: list_transform(range(1, m - size + 2), lambda i: p[i:i + size - 1]))) AS parts FROM candidates WHERE m > 2),
inside AS (SELECT lang, part AS p, max(a) AS most FROM (SELECT lang, a, unnest(parts) AS part FROM inner_parts) GROUP BY ALL),
free AS (SELECT c.* FROM candidates c LEFT JOIN inside i ON i.lang = c.lang AND i.p = c.p WHERE most IS NULL OR 100 * most < 100 * a),
cuts AS (SELECT lang, p, a, m, unnest(range(1, m)) AS k FROM free),
scored AS (SELECT c.lang, c.p, c.k, c.a, x.f AS l, y.f AS r, t.n, ({SCALE}::HUGEINT * c.a * t.n) // (x.f::HUGEINT * y.f) AS score FROM cuts c JOIN counts x ON x.lang = c.lang AND x.p = c.p[1:c.k]
  JOIN counts y ON y.lang = c.lang AND y.p = c.p[c.k + 1:c.m] JOIN totals t ON t.lang = c.lang),
lowest AS (SELECT *, row_number() OVER (PARTITION BY lang, p ORDER BY score, k) AS nth FROM scored),
ranked AS (SELECT *, array_to_string(p, ' ') AS phrase FROM lowest WHERE nth = 1)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM ranked) WHERE rank <= {top}"""

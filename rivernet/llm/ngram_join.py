"""Jaccard join of word n-gram sets by grouped prefixes.

A set's n-grams are ordered from rare to frequent.  Two sets of a similarity of
at least the threshold share SHARED of their first few n-grams, their prefixes.
Sets of one size with the same prefix form a group; only groups are joined, by
the n-grams of their prefixes, and pairs are filtered by size, by the places of
the shared n-grams and by their number.  What is left is expanded to the members of the groups and
every link is confirmed on whole sets.  (Bouros, Ge and Mamoulis,
"Spatio-textual similarity joins", 2012.)

The order comes from a count of the n-grams of all texts by 32 bits of their
hash.  Which of them over FEW texts hold is noted in a table of CELLS cells,
however many texts there are; the rest are rare.  Any order gives the same links: the table
only decides how short the lists of sets that share an n-gram are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import near_dedup
from .common import cut
from .near_dedup import BROADCAST_ROWS, components, stars
from .shingles import mixed, shingle_sets
from .tokens import some_texts

WIDTH, PERCENT = 4, 85
CELLS, SLICES = 1 << 24, 1 << 10
VALUES = (1 << 32) // SLICES  # 32-bit values in a slice, which has CELLS / SLICES cells
CHUNK_NGRAMS, SORTED = 1 << 22, 1 << 22  # values sent as one; those of a slice that are counted by sorting
SHARED = 4  # n-grams that the prefixes of a pair must have in common; they are so much longer
FEW = 16  # groups in the list of an n-gram whose pairs are taken one by one
LIST_ROWS, CLASS_NGRAMS, TEXT_BYTES = 20_000, 4_000_000, 1 << 21


def prefix_size(size: np.ndarray, percent: int) -> np.ndarray:
    """N-grams of a set of ``size`` of which a set that is alike must hold SHARED: those that may all be missing, and so many more."""
    return np.minimum(size, size - -(-size * percent // 100) + SHARED)


def least_overlap(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """The smallest intersection with 100 * intersection >= percent * union."""
    return -(-percent * (a + b) // (100 + percent))


def frequency_table(docs: DataFrame, width: int) -> np.ndarray:
    """uint8[CELLS]: the bit length of the number of texts that hold the most frequent n-gram of each cell; 0 if it's up to FEW.

    Tasks send the sorted values of CHUNK_NGRAMS n-grams by slices, as the gaps
    between them.  A slice is counted in one task, by sorting or, if it is longer, in VALUES counters.
    """
    few = FEW

    def valued(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for _, some in some_texts(batches, "text", TEXT_BYTES):
            held.append((shingle_sets(some, width)[1] & np.uint64(0xFFFFFFFF)).astype(np.uint32))
            n += len(held[-1])
            if n >= CHUNK_NGRAMS:
                yield sliced(np.sort(np.concatenate(held)))
                held, n = [], 0
        if n:
            yield sliced(np.sort(np.concatenate(held)))

    def sliced(values: np.ndarray) -> pa.RecordBatch:
        bounds = np.searchsorted(values, np.arange(SLICES, dtype=np.uint64) * np.uint64(VALUES)).tolist() + [len(values)]
        at, widths, gaps = [], [], []
        for k in range(SLICES):
            part = values[bounds[k] : bounds[k + 1]]
            if len(part):
                gap = np.diff(part, prepend=np.uint32(k * VALUES))
                kind = np.min_scalar_type(gap.max())
                at.append(k)
                widths.append(kind.itemsize)
                gaps.append(gap.astype(kind).tobytes())
        return pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(widths, pa.int32()), pa.array(gaps, pa.binary())], names=["slice", "width", "gaps"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, counts, held, n = None, None, [], 0

        def noted() -> pa.RecordBatch:
            if counts is None:
                value, number = np.unique(np.concatenate(held), return_counts=True)
                often = number > few
                value, number = value[often], number[often]
            else:
                number = counts + np.bincount(np.concatenate(held), minlength=VALUES)
                value = np.flatnonzero(number > few)
                number = number[value]
            most = np.zeros(CELLS // SLICES, np.int64)
            np.maximum.at(most, value // (VALUES * SLICES // CELLS), number)
            return pa.RecordBatch.from_arrays([pa.array([last]), pa.array([_bit_length(most).tobytes()])], names=["slice", "bits"])

        for batch in batches:
            for at, kind, gaps in zip(*(batch.column(c).to_pylist() for c in ("slice", "width", "gaps")), strict=True):
                if at != last:
                    if last is not None:
                        yield noted()
                    last, counts, held, n = at, None, [], 0
                held.append(np.cumsum(np.frombuffer(gaps, f"u{kind}"), dtype=np.int32))
                n += len(held[-1])
                if n >= SORTED:
                    counts = np.bincount(np.concatenate(held), minlength=VALUES) + (0 if counts is None else counts)
                    held, n = [np.empty(0, np.int32)], 0
        if last is not None:
            yield noted()

    parts = docs.select("text").mapInArrow(valued, "slice long, width int, gaps binary")
    whole = parts.repartition("slice").sortWithinPartitions("slice").mapInArrow(counted, "slice long, bits binary")
    table = np.zeros((SLICES, CELLS // SLICES), np.uint8)
    for r in whole.collect():  # SLICES rows
        table[r["slice"]] = np.frombuffer(r["bits"], np.uint8)
    return table.reshape(-1)


def _bit_length(counts: np.ndarray) -> np.ndarray:
    return np.frexp(counts.astype(np.float64))[1].astype(np.uint8)


def prefixes(docs: DataFrame, table: np.ndarray, width: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, set_a, set_b (a 128-bit hash of the set), key_a, key_b (one of prefix and size), prefix (array, rare first) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(table)  # CELLS bytes

    def prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for rows, some in some_texts(batches, "text", TEXT_BYTES):
            offsets, h = shingle_sets(some, width)
            size = np.diff(offsets)
            total = lambda x, bounds: np.diff(np.concatenate((np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)))[bounds])
            sets = [total(mixed(x), offsets).view(np.int64) for x in (h, h ^ np.uint64(0xC3C3C3C3C3C3C3C3))]
            of = np.repeat(np.arange(len(size)), size)
            h = h[np.lexsort((h, bits[((h & np.uint64(0xFFFFFFFF)) // np.uint64((1 << 32) // CELLS)).astype(np.int64)], of))]
            length = prefix_size(size, percent)
            h, ends = h[np.arange(len(h)) - np.repeat(offsets[:-1], size) < np.repeat(length, size)], np.concatenate(([0], np.cumsum(length)))
            keys = [mixed(total(mixed(h ^ np.uint64(salt)), ends) + mixed(size.astype(np.uint64))).view(np.int64) for salt in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)]
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(h.view(np.int64)))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id").cast(pa.int64()), pa.array(size), *map(pa.array, sets + keys), lists], names=["doc_id", "n_shingles", "set_a", "set_b", "key_a", "key_b", "prefix"])

    return docs.select("doc_id", "text").mapInArrow(prefix, "doc_id long, n_shingles long, set_a long, set_b long, key_a long, key_b long, prefix array<long>")


def group_links(groups: DataFrame, percent: int) -> DataFrame:
    """a, b, listed: pairs of groups that may hold links, by the n-grams of both prefixes.

    ``groups(rep, size, prefix)``.  Of an n-gram with up to FEW groups all pairs
    come that pass the filters of size and place.  Of one with more (listed),
    links which connect all groups whose sizes are near enough in a row; no
    pairs are made of them.  A pair that shares none of the latter must share
    SHARED of the former (or as many as it must have in common at all).
    """
    rows = groups.select("rep", "size", F.posexplode("prefix").alias("place", "ngram")).select("ngram", "rep", F.col("size").cast("int").alias("size"), "place")
    dealt = rows.repartition("ngram").sortWithinPartitions("ngram", "size", "rep")
    names = ["a", "b", "listed", "need"]

    shared = SHARED

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # ngram, size and head of the last row, whose list the next piece may go on with
        for batch in by_pieces(batches):
            ngram, rep, size, place = (np.asarray(batch.column(c)) for c in ("ngram", "rep", "size", "place"))
            size, place = size.astype(np.int64), place.astype(np.int64)
            new = np.concatenate(([True], ngram[1:] != ngram[:-1]))
            bounds = np.append(np.flatnonzero(new), len(ngram))
            of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            length = np.diff(bounds)[of]
            goes_on = last is not None and ngram[0] == last[0]
            if goes_on:
                length[of == 0] = FEW + 1
            a, b, listed, need = [], [], [], []
            few = np.flatnonzero((length > 1) & (length <= FEW))
            for gap in range(1, FEW):
                i, j = few[:-gap], few[gap:]
                i, j = i[of[i] == of[j]], j[of[i] == of[j]]
                if not len(i):
                    break
                most, least = np.minimum(size[i] - place[i], size[j] - place[j]) + np.minimum(place[i], place[j]), least_overlap(size[i], size[j], percent)
                ok = (100 * size[i] >= percent * size[j]) & (most >= least)
                a.append(rep[i[ok]])
                b.append(rep[j[ok]])
                listed.append(np.zeros(len(a[-1]), bool))
                need.append(np.minimum(least[ok], shared))
            starts = new | (100 * np.append(size[:1], size[:-1]) < percent * size)
            head = rep[np.maximum.accumulate(np.where(starts, np.arange(len(rep)), 0))]
            if goes_on and 100 * last[1] >= percent * size[0]:
                head[: np.append(np.flatnonzero(starts[1:]) + 1, len(rep))[0]] = last[2]
            many = np.flatnonzero((length > FEW) & (head != rep))
            a.append(head[many])
            b.append(rep[many])
            listed.append(np.ones(len(many), bool))
            need.append(np.zeros(len(many), np.int64))
            last = ngram[-1], size[-1], head[-1]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b)), pa.array(np.concatenate(listed)), pa.array(np.concatenate(need))], names=names)

    found = dealt.mapInArrow(links, "a long, b long, listed boolean, need long").filter("a <> b")
    pairs = found.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.bool_or("listed").alias("listed"), F.count("*").alias("n"), F.max("need").alias("need"))
    return pairs.filter("listed OR n >= need").select("a", "b", "listed")


def by_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by ngram as pieces that cut no list, but for lists of over LIST_ROWS rows: these come in pieces of their own."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < LIST_ROWS:
            continue
        t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        keys = np.asarray(t.column("ngram"))
        end = int(np.searchsorted(keys, keys[-1])) or t.num_rows
        yield t.slice(0, end)
        held = [t.slice(end)] if end < t.num_rows else []
        n = t.num_rows - end
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def confirmed_pairs(docs: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """a, b: those of ``pairs(a, b)`` whose sets are alike; the sets of all partners of ``a`` meet in one group, FEW * prefix of them at most."""
    partners = pairs.select(F.col("a").alias("grp"), F.col("b").alias("rep"), F.lit(False).alias("center"))
    return stars(docs, partners.unionByName(pairs.select(F.col("a").alias("grp"), F.col("a").alias("rep"), F.lit(True).alias("center")).distinct()), width, percent)


def confirmed_in_classes(docs: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """a, b: links of ``near_dedup.confirmed_in_classes`` in classes cut at CLASS_NGRAMS n-grams."""
    return near_dedup.confirmed_in_classes(docs, classes, width, percent, CLASS_NGRAMS)


def ngram_join(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row.

    Null and empty texts, and texts without words, have an empty set and are
    linked with nothing; fewer words than ``width`` make one n-gram.  A null
    doc_id has component_id null and links nothing.  Rows that repeat a doc_id
    count as one document with several texts: what any of them is linked with,
    the doc_id is.  Very long texts enter whole; an empty table gives an empty
    result; further columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    rows = cut(prefixes(docs, frequency_table(docs, width), width, percent))
    some = rows.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    of_set = ["set_a", "set_b", "n_shingles"]
    sets = cut(some.groupBy(*of_set).agg(F.min("doc_id").alias("rep"), F.min("key_a").alias("key_a"), F.min("key_b").alias("key_b")))  # equal sets have equal keys
    heads = sets.select("rep", F.col("n_shingles").alias("size"), "key_a", "key_b")
    by = ["size", "key_a", "key_b"]
    groups = cut(heads.groupBy(*by).agg(F.min("rep").alias("grp"), F.max("rep").alias("last")))
    firsts = groups.select(F.col("grp").alias("rep")).distinct()
    lists = some.select(F.col("doc_id").alias("rep"), F.col("n_shingles").alias("size"), "prefix")
    links = cut(group_links(lists.join(F.broadcast(firsts) if groups.count() <= BROADCAST_ROWS else firsts, "rep", "left_semi"), percent))
    several = groups.filter("grp <> last")
    members = heads.select(*by, "rep").join(several.select(*by, "grp"), by).select(F.col("grp").alias("a"), F.col("rep").alias("b")).filter("a <> b")
    whole = several.select("grp").distinct()
    has = lambda c: whole.select(F.col("grp").alias(c), F.lit(True).alias(f"{c}_several"))
    links = cut(links.join(has("a"), "a", "left").join(has("b"), "b", "left").select("a", "b", F.coalesce(F.col("listed") | F.col("a_several") | F.col("b_several"), F.lit(False)).alias("in_class")))
    classes = components(links.filter("in_class").select("a", "b").unionByName(members)).select(F.col("node").alias("rep"), F.col("label").alias("cls"))
    classes = classes.join(heads.groupBy("rep").agg(F.max("size").alias("size")), "rep")
    found = confirmed_pairs(docs, links.filter("NOT in_class").select("a", "b"), width, percent).unionByName(confirmed_in_classes(docs, classes, width, percent))
    repeated = some.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id")
    twice = some.join(repeated, "doc_id").join(sets, of_set).filter("rep <> doc_id").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    label = components(found.unionByName(twice)).select(F.col("node").alias("rep"), "label")
    named = sets.join(label, "rep", "left").select(*(F.col(c).alias(f"of_{c}") for c in of_set), F.coalesce("label", "rep").alias("label"))
    same = [F.col(c) == F.col(f"of_{c}") for c in of_set]
    out = rows.join(named, same[0] & same[1] & same[2] & F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("label", "doc_id").alias("component_id"))


def oracle_sql(width: int = WIDTH, percent: int = PERCENT) -> str:
    """DuckDB: all pairs of documents that share an n-gram, links by recursion."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
ngrams AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {width} THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - {width - 2}), lambda i: array_to_string(w[i:i + {width - 1}], ' ')) END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM ngrams GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM ngrams a JOIN ngrams b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared >= {percent} * (x.n + y.n - shared)),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM sizes UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.other),
least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component_id, doc_id) AS component_id FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN least USING (doc_id)"""

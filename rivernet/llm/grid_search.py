"""Ranked lexical search on a K2-treap over the grid of terms and documents.

Documents are dealt in ranges.  The grid of a range has a row a term and a
column a document; it is halved in both directions until single cells are left.
Every part that holds anything has four bits for its quarters and the largest
impact in it (what a term adds to a document's score).  A query's terms descend
their rows' paths together over ranges of columns: a range's bound is the sum of
the maxima of the parts that its rows pass.  First the best ranges go down by
themselves, which gives scores to beat; then all whose bound can reach these.
(Brisaboa, de Bernardo, Konow, Navarro and Seco, "Aggregated 2D range queries on
clustered points", 2016.)
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut
from .tokens import byte_set, runs_of, some_texts

TOP = 10
SCALE, K1, B, HUNDRED, PER_THOUSAND = 1_000_000_000, 1000, 90, 100, 8  # the score: w * (SCALE * tf div (K1 * tf + PER_THOUSAND * m))
TERM = byte_set(range(0x30, 0x3A), range(0x41, 0x5B), range(0x61, 0x7B), range(0x80, 0x100))
COLUMNS, TEXT_BYTES = 4096, 1 << 22
BEAM, STATES, ITEMS = 16, 1 << 14, 5_000
_EMPTY = -1
_ONES = np.array([bin(i).count("1") for i in range(16)], np.int64)


@dataclass
class Level:
    """The parts of one size: which quarters of each hold anything, where their first is on the next level, and the largest impact."""

    quarters: np.ndarray
    first: np.ndarray
    most: np.ndarray


class Treap:
    """The K2-treap of cells (row, column, impact), no cell twice, on a grid of 2 ** height rows and columns."""

    def __init__(self, row: np.ndarray, column: np.ndarray, impact: np.ndarray, height: int):
        code = _spread(row) << 1 | _spread(column)
        order = np.argsort(code, kind="stable")
        code, most = code[order], impact[order].astype(np.int64)
        levels = [Level(np.empty(0, np.uint8), np.empty(0, np.int64), most)]
        for _ in range(height):
            above = code >> 2
            new = np.flatnonzero(np.diff(above, prepend=-1))
            quarters = np.bitwise_or.reduceat((1 << (code & 3)).astype(np.uint8), new) if len(new) else np.empty(0, np.uint8)
            most = np.maximum.reduceat(most, new) if len(new) else most
            levels.append(Level(quarters, new, most))
            code = above[new]
        self.height, self.levels = height, levels[::-1]

    def below(self, level: int, part: np.ndarray, quarter: np.ndarray) -> np.ndarray:
        """Parts on the next level in the given quarters (0 to 3) of parts; -1 where nothing is."""
        at = self.levels[level]
        mask = at.quarters[part].astype(np.int64)
        held = (part >= 0) & ((mask >> quarter & 1) == 1)
        return np.where(held, at.first[part] + _ONES[mask & ((1 << quarter) - 1)], -1)

    def bounds(self, level: int, part: np.ndarray) -> np.ndarray:
        return np.where(part >= 0, self.levels[level].most[part], 0)


def _spread(x: np.ndarray) -> np.ndarray:
    """Bit i goes to place 2 i."""
    x = x.astype(np.int64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | x << shift) & mask
    return x


class Best:
    """The highest scores of each item so far, equal ones by the lesser column id."""

    def __init__(self, items: int, top: int):
        self.score, self.doc, self.top = np.full((items, top), _EMPTY), np.full((items, top), np.iinfo(np.int64).max), top

    def bar(self) -> np.ndarray:
        """A score from which a document may still come in (equal ones may have the lesser id)."""
        return np.maximum(self.score[:, -1], 1)

    def take(self, item: np.ndarray, doc: np.ndarray, score: np.ndarray) -> None:
        if not len(item):
            return
        every = np.arange(len(self.score)).repeat(self.top)
        item, doc, score = (np.concatenate(x) for x in ((every, item), (self.doc.reshape(-1), doc), (self.score.reshape(-1), score)))
        order = np.lexsort((doc, -score, item))
        item, doc, score = item[order], doc[order], score[order]
        nth = np.arange(len(item)) - np.searchsorted(item, item)
        keep = nth < self.top
        self.doc, self.score = doc[keep].reshape(-1, self.top), score[keep].reshape(-1, self.top)


def search(treap: Treap, rows: np.ndarray, best: Best, column_ids: np.ndarray) -> None:
    """Brings into ``best`` what the grid's columns score for each item; ``rows`` are the items' rows, -1 behind their last."""
    if not len(treap.levels[0].most):
        return
    n, hopes = len(rows), Best(len(rows), best.top)
    hopes.score, hopes.doc = best.score, best.doc
    bar = lambda: np.maximum(best.bar(), hopes.bar())

    def go_down(item: np.ndarray, column: np.ndarray, part: np.ndarray, level: int, beam: int | None) -> None:
        """Follows states (item, range of columns, a part for every row) from ``level`` to single columns."""
        while level < treap.height:
            half = np.where(rows[item] >= 0, rows[item] >> (treap.height - level - 1) & 1, 0)
            halves = [treap.below(level, part, 2 * half + side) for side in (0, 1)]
            level += 1
            item, column, part = np.concatenate((item, item)), np.concatenate((2 * column, 2 * column + 1)), np.concatenate(halves)
            bound = treap.bounds(level, part).sum(axis=1)
            keep = np.flatnonzero(bound >= bar()[item])
            if beam is not None:
                keep = keep[np.lexsort((-bound[keep], item[keep]))]
                keep = keep[np.arange(len(keep)) - np.searchsorted(item[keep], item[keep]) < beam]
            item, column, part, bound = item[keep], column[keep], part[keep], bound[keep]
            if beam is None and len(item) > STATES:  # in portions, the highest bounds first: what they score raises the bar
                order = np.argsort(-bound, kind="stable")
                for at in range(0, len(order), STATES):
                    some = order[at : at + STATES]
                    some = some[bound[some] >= bar()[item[some]]]
                    go_down(item[some], column[some], part[some], level, None)
                return
            if not len(item):
                return
        (best if beam is None else hopes).take(item, column_ids[column], treap.bounds(treap.height, part).sum(axis=1))

    start = np.where(rows >= 0, 0, -1)
    go_down(np.arange(n), np.zeros(n, np.int64), start, 0, BEAM)
    go_down(np.arange(n), np.zeros(n, np.int64), start, 0, None)


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, term: the different terms of each item, by hash."""

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in some_texts(batches, "text", TEXT_BYTES):
            of, h = _terms_of(texts)
            key = np.unique(np.stack((of.view(np.uint64), h)), axis=1)
            yield pa.RecordBatch.from_arrays([rows.column("item_id").take(pa.array(key[0].view(np.int64))), pa.array(key[1].view(np.int64))], names=["item_id", "term"])

    kind = items.schema["item_id"].dataType.simpleString()
    return items.select("item_id", "text").mapInArrow(terms, f"item_id {kind}, term long").distinct()


def _terms_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every term of the texts, in order."""
    start, _, h = runs_of(b"\n".join(texts).lower(), TERM)
    first = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    return np.searchsorted(first, start, "right"), h


def postings(docs: DataFrame, terms: np.ndarray) -> DataFrame:
    """doc_id, n (its terms with repeats), row and tf (arrays) of the sorted ``terms`` that each document with any term holds."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for rows, texts in some_texts(batches, "text", TEXT_BYTES):
            of, h = _terms_of(texts)
            n = np.bincount(of, minlength=len(texts))
            row = np.minimum(np.searchsorted(known, h), max(0, len(known) - 1))
            hit = known[row] == h if len(known) else np.zeros(len(h), bool)
            cell, tf = np.unique(of[hit] * (len(known) + 1) + row[hit], return_counts=True)
            ends = np.searchsorted(cell, np.arange(len(texts) + 1) * (len(known) + 1))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x.astype(np.int32))) for x in (cell % (len(known) + 1), tf)]
            out = pa.RecordBatch.from_arrays([rows.column("doc_id").cast(pa.int64()), pa.array(n), *lists], names=["doc_id", "n", "row", "tf"])
            yield out.filter(pa.array(n > 0))

    return docs.select("doc_id", "text").mapInArrow(rows_of, "doc_id long, n long, row array<int>, tf array<int>")


def document_frequencies(cells: DataFrame, terms: int) -> np.ndarray:
    """Documents that hold each of the ``terms`` terms."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(terms, np.int64)
        for batch in batches:
            total += np.bincount(np.asarray(batch.column("row").flatten()), minlength=terms)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["row", "df"])

    out = np.zeros(terms, np.int64)
    for r in cells.select("row").mapInArrow(counted, "row long, df long").groupBy("row").agg(F.sum("df").alias("df")).collect():  # a row a term asked for
        out[r["row"]] = r["df"]
    return out


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` documents for each item, highest score first, then lowest doc_id.

    Only scores above 0 count.  Null and empty texts have no terms: as documents
    they count nowhere, as items they find nothing.  Rows that repeat a doc_id
    are documents of their own; a null doc_id
    can't be named and isn't ranked, but counts in all statistics.  Items whose
    item_id repeats are asked as one, with the terms of all.  Very long texts
    enter whole; empty tables give an empty result; further columns are ignored.

    Items are asked ITEMS at a time, which bounds what tasks share; each block
    of them has a grid over all documents.
    """
    asked = cut(item_terms(items.filter("item_id IS NOT NULL")))
    ids = cut(asked.select("item_id").distinct())
    blocks = max(1, -(-ids.count() // ITEMS))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)))
    found = [_ranked(docs, asked.filter(F.col("block") == k).select("item_id", "term"), top) for k in range(blocks)]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def _ranked(docs: DataFrame, asked: DataFrame, top: int) -> DataFrame:
    spark = docs.sparkSession
    pairs = asked.toArrow()  # a row for each term of at most about ITEMS items
    item_ids = sorted(set(pairs.column("item_id").to_pylist()))
    terms, row = np.unique(np.asarray(pairs.column("term")).view(np.uint64), return_inverse=True)
    cells = cut(postings(docs, terms))
    sums = cells.agg(F.count("*").alias("N"), F.sum("n").alias("L")).first()
    n_docs, n_terms = sums["N"], sums["L"] or 1
    df = document_frequencies(cells, len(terms))
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)
    place = {x: i for i, x in enumerate(item_ids)}
    of = np.fromiter((place[x] for x in pairs.column("item_id").to_pylist()), np.int64, len(row))
    order = np.argsort(of, kind="stable")
    of, row = of[order], row[order]
    nth = np.arange(len(of)) - np.searchsorted(of, of)
    rows = np.full((len(item_ids), int(nth.max(initial=-1)) + 1), -1, np.int64)
    rows[of, nth] = row
    columns = COLUMNS
    height = max(1, (max(columns, len(terms)) - 1).bit_length())
    shared = spark.sparkContext.broadcast((rows, weight))

    def best_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, weight = shared.value
        best = Best(len(rows), top)
        for part in _ranges(batches, columns):
            n, tf = np.asarray(part.column("n")), np.asarray(part.column("tf").flatten()).astype(np.int64)
            row, column = np.asarray(part.column("row").flatten()).astype(np.int64), np.repeat(np.arange(part.num_rows), np.diff(np.asarray(part.column("row").offsets)))
            m = HUNDRED - B + (B * n * n_docs) // n_terms
            impact = weight[row] * ((SCALE * tf) // (K1 * tf + PER_THOUSAND * m[column]))
            search(Treap(row, column, impact, height), rows, best, np.asarray(part.column("doc_id")))
        item, k = np.nonzero(best.score > 0)
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(best.doc[item, k]), pa.array(best.score[item, k])], names=["item", "doc_id", "score"])

    found = cells.filter("doc_id IS NOT NULL").mapInArrow(best_of, "item long, doc_id long, score long")
    nth = F.row_number().over(W.partitionBy("item").orderBy(F.col("score").desc(), "doc_id"))
    out = found.withColumn("rank", nth).filter(F.col("rank") <= top)
    names = spark.createDataFrame([(i, x) for i, x in enumerate(item_ids)], f"item long, item_id {asked.schema['item_id'].dataType.simpleString()}")
    return out.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def _ranges(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[pa.RecordBatch]:
    """``columns`` documents at a time."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, columns - n)
            batch = batch.slice(part.num_rows)
            held.append(part)
            n += part.num_rows
            if n == columns:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def oracle_sql(top: int = TOP) -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    terms = lambda id_, t: rf"SELECT row, {id_}, unnest(regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT *, row_number() OVER () AS row FROM {t})"
    return f"""
WITH tokens AS MATERIALIZED ({terms("doc_id", "documents")}),
asked AS MATERIALIZED (SELECT DISTINCT item_id, term FROM ({terms("item_id", "benchmark")})),
lengths AS (SELECT row, doc_id, count(*) AS n FROM tokens GROUP BY row, doc_id),
whole AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM lengths),
held AS (SELECT row, term, count(*) AS tf FROM tokens WHERE term IN (SELECT term FROM asked) GROUP BY row, term),
weights AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM held GROUP BY term), whole),
impacts AS (SELECT row, term, w * (({SCALE}::BIGINT * tf) // ({K1} * tf + {PER_THOUSAND} * ({HUNDRED} - {B} + ({B} * n * n_docs) // n_terms))) AS impact FROM held JOIN weights USING (term) JOIN lengths USING (row), whole),
scores AS (SELECT item_id, row, sum(impact)::BIGINT AS score FROM asked JOIN impacts USING (term) GROUP BY item_id, row)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores JOIN lengths USING (row) WHERE score > 0) WHERE rank <= {top}"""

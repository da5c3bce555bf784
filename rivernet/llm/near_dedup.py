"""Near-duplicates by a chosen-path set similarity join.

Documents with one shingle set collapse to their smallest doc_id.  The rest get
one-permutation MinHash values.  Every tree branches them: a node picks minwise
positions and sends a document to the child of its value there; small nodes are
compared exhaustively, and independent trees repeat until the recall of a pair
at the threshold is beyond 0.999.  Nodes compare MinHash values and only yield
candidate classes; within a class every link is then confirmed on whole shingle
sets.  (Christiani and Pagh, "Set similarity search beyond MinHash", 2017.)
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoints import Rounds
from .common import cut
from .shingles import mixed, shingle_sets
from .tokens import some_texts

WIDTH, PERCENT = 5, 80
POSITIONS, TREES, BRANCHES, LEAF, DEPTH = 128, 7, 2, 24, 6
LIKELY = 0.6  # share of equal MinHash values that makes a candidate: five deviations under 0.8
NODE_ROWS, CLASS_SHINGLES, BROADCAST_ROWS, BROADCAST_NODES = 20_000, 4_000_000, 500_000, 50_000
MARKS = 1 << 26
LEVELS = 3  # times that a node of over NODE_ROWS rows is branched before it is dealt
TEXT_BYTES = 1 << 21
CHUNK_TEXTS, CHUNK_BYTES, CHUNK_ROWS = 256, 1 << 21, 20_000

_rng = np.random.default_rng(7)
_ROOTS = _rng.permutation(POSITIONS)
_PROBES = _rng.integers(0, POSITIONS, (4 * POSITIONS, POSITIONS))


def minhash(offsets: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """uint16 [texts, POSITIONS]: the smallest hash of each bin; an empty bin borrows from bins in a fixed random order."""
    n = len(offsets) - 1
    out, full = np.zeros((n, POSITIONS), np.uint16), np.zeros((n, POSITIONS), bool)
    doc = np.repeat(np.arange(n), np.diff(offsets))
    cell = doc * POSITIONS + (hashes >> np.uint64(57)).astype(np.int64)
    first = np.flatnonzero(np.diff(cell, prepend=-1))
    out.reshape(-1)[cell[first]] = (hashes[first] & np.uint64(0xFFFF)).astype(np.uint16)
    full.reshape(-1)[cell[first]] = True
    filled = full.copy()
    for probe in [*_PROBES, *(np.roll(np.arange(POSITIONS), -k) for k in range(POSITIONS))]:
        row, col = np.nonzero(~filled & full.any(axis=1)[:, None])
        if not len(row):
            break
        ok = full[row, probe[col]]
        row, col = row[ok], col[ok]
        out[row, col], filled[row, col] = out[row, probe[col]], True
    return out


def _chunks(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, list[bytes]]]:
    """(row of the first, texts) of some hundred texts at a time; null is empty."""
    texts, start, size = [], 0, 0
    for i, value in enumerate(batch.column(column)):
        data = value.as_buffer().to_pybytes() if value.is_valid else b""
        texts.append(data)
        size += len(data)
        if len(texts) >= CHUNK_TEXTS or size >= CHUNK_BYTES:
            yield start, texts
            texts, start, size = [], i + 1, 0
    if texts:
        yield start, texts


def sketches(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles, set_a, set_b (a hash of the whole set), minhash."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("minhash", pa.binary())])

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in _chunks(batch, "text"):
                offsets, h = shingle_sets(texts, width)
                total = lambda x: np.diff(np.concatenate((np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)))[offsets]).view(np.int64)  # noqa: B023, E731
                values = minhash(offsets, h)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(start, len(texts)).cast(pa.int64()), pa.array(np.diff(offsets)), pa.array(total(mixed(h))), pa.array(total(mixed(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)))), pa.array([v.tobytes() for v in values], pa.binary())],
                    schema=schema,
                )

    return docs.select("doc_id", "text").mapInArrow(sketch, "doc_id long, n_shingles long, set_a long, set_b long, minhash binary")


class Classes:
    """Union-find over 0..n-1 that keeps the links which joined two classes."""

    def __init__(self, n: int):
        self.parent, self.links = np.arange(n), []

    def find(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return i

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            u, v = self.find(x), self.find(y)
            if u != v:
                self.parent[max(u, v)] = min(u, v)
                self.links.append((x, y))

    def roots(self) -> np.ndarray:
        while (up := self.parent[self.parent]).tobytes() != self.parent.tobytes():
            self.parent = up
        return self.parent


def _sorted_groups(keys: np.ndarray) -> np.ndarray:
    """Bounds of equal runs."""
    return np.concatenate((np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1)), [len(keys)]))


def branch(values: np.ndarray, node: np.ndarray, row: np.ndarray, seed: int, likely: int) -> list[tuple[int, int]]:
    """Candidate links (rows of ``values``) in the subtrees of sorted ``node``: links of a spanning forest."""
    classes = Classes(len(values))
    alike = lambda a, b: (values[a] == values[b]).sum(axis=1, dtype=np.int32) >= likely
    for depth in range(DEPTH + 1):
        bounds = _sorted_groups(node)
        size = np.diff(bounds)
        of = np.repeat(np.arange(len(size)), size)
        small = size[of] <= LEAF
        r, g = row[small], of[small]
        for gap in range(1, LEAF):
            pair = np.flatnonzero(g[gap:] == g[:-gap])
            if not len(pair):
                break
            for at in range(0, len(pair), CHUNK_ROWS):
                a, b = r[pair[at : at + CHUNK_ROWS]], r[pair[at : at + CHUNK_ROWS] + gap]
                ok = alike(a, b)
                classes.join(a[ok], b[ok])
        if small.all():
            break
        row, of = row[~small], of[~small]
        bounds = _sorted_groups(of)
        pivot = np.repeat(row[bounds[:-1]], np.diff(bounds))
        ok = np.concatenate([alike(row[at : at + CHUNK_ROWS], pivot[at : at + CHUNK_ROWS]) for at in range(0, len(row), CHUNK_ROWS)])
        classes.join(row[ok], pivot[ok])
        root = classes.roots()[row]
        several = np.minimum.reduceat(root, bounds[:-1]) < np.maximum.reduceat(root, bounds[:-1])
        keep = np.repeat(several, np.diff(bounds))
        row, of = row[keep], of[keep]
        if not len(row):
            break
        if depth == DEPTH:  # nodes that no branching makes small: everything outside the largest class against all
            bounds = _sorted_groups(of)
            for s, e in zip(bounds[:-1], bounds[1:], strict=True):
                rows = row[s:e]
                _against_all(rows, classes, lambda i, rows=rows: rows[alike(np.full(len(rows), i), rows)])
            break
        nodes, rows = [], []
        for slot in range(BRANCHES):
            place = (mixed(of.astype(np.uint64) * np.uint64(2654435761) + np.uint64(1_000_003 * seed + 1009 * depth + slot)) % np.uint64(POSITIONS)).astype(np.int64)
            nodes.append((of * BRANCHES + slot) * 65536 + values[row, place])
            rows.append(row)
        node, row = np.concatenate(nodes), np.concatenate(rows)
        order = np.argsort(node, kind="stable")
        node, row = node[order], row[order]
        size = np.diff(bounds := _sorted_groups(node))
        keep = np.repeat(size > 1, size)
        node, row = node[keep], row[keep]
        if not len(row):
            break
    return classes.links


def _against_all(rows: np.ndarray, classes: Classes, linked: Callable[[int], np.ndarray]) -> None:
    """Joins all links among ``rows``: each row outside the largest class meets every row once."""
    done = np.zeros(len(rows), bool)
    while True:
        root = classes.roots()[rows]
        names, count = np.unique(root, return_counts=True)
        if len(names) == 1:
            return
        rest = np.flatnonzero(~done & (root != names[count.argmax()]))
        if not len(rest):
            return
        at = rest[0]
        done[at] = True
        near = linked(int(rows[at]))
        classes.join(np.full(len(near), rows[at]), near)


def by_group(batches: Iterator[pa.RecordBatch], key: str, rows: int) -> Iterator[pa.RecordBatch]:
    """Sorted batches joined so that no group is cut; about ``rows`` rows at a time, more where a group is larger."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < rows:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        last = t.column(key)[-1]
        keys = np.asarray(t.column(key))
        end = int(np.searchsorted(keys, last.as_py()))
        if end:
            yield t.slice(0, end).combine_chunks().to_batches()[0]
        held = t.slice(end).combine_chunks().to_batches()
        n = sum(b.num_rows for b in held)
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def compared(rows: DataFrame, likely: int) -> DataFrame:
    """``rows(rep, minhash, node, cls)`` with ``pivot``, the least row of each node, and ``near``, whether they are a likely pair; what is near takes the pivot's ``cls``."""
    first = cut(rows.groupBy("node").agg(F.min(F.struct("rep", "minhash", "cls")).alias("first")))
    few = first.limit(BROADCAST_NODES + 1).count() <= BROADCAST_NODES
    both = rows.join(F.broadcast(first) if few else first, "node").select("rep", "minhash", "node", "cls", F.col("first.rep").alias("pivot"), F.col("first.minhash").alias("pivot_minhash"), F.col("first.cls").alias("pivot_cls"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, pivots = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, POSITIONS) for c in ("minhash", "pivot_minhash"))
            near = (values == pivots).sum(axis=1, dtype=np.int32) >= likely
            cls, pivot_cls = np.asarray(batch.column("cls")), np.asarray(batch.column("pivot_cls"))
            columns = [*(batch.column(c) for c in ("rep", "minhash", "node")), pa.array(np.where(near, pivot_cls, cls)), batch.column("pivot"), batch.column("pivot_cls"), pa.array(near)]
            yield pa.RecordBatch.from_arrays(columns, names=["rep", "minhash", "node", "cls", "pivot", "pivot_cls", "near"])

    return both.mapInArrow(meet, "rep long, minhash binary, node binary, cls long, pivot long, pivot_cls long, near boolean")


def branched(rows: DataFrame) -> DataFrame:
    """rep, minhash, node, cls: rows go to the children of their node, one for each of BRANCHES positions of the node's choice."""
    at = lambda slot: F.pmod(F.xxhash64("node", F.lit(slot)), F.lit(POSITIONS)).cast("int")
    child = lambda slot: F.concat(F.col("node"), F.lit(bytes([slot])), F.substring(F.col("minhash"), 2 * at(slot) + 1, F.lit(2)))
    return rows.select("rep", "minhash", F.explode(F.array(*map(child, range(BRANCHES)))).alias("node"), "cls")


def candidate_links(nodes: DataFrame, trees: int = TREES, percent: int = PERCENT) -> DataFrame:
    """a, b: links of likely pairs, enough to connect each class of them.

    A node of over NODE_ROWS rows is branched before it is dealt, up to LEVELS
    times.  All its rows first meet its pivot, wherever they lie; ``cls`` tells
    which are linked so, and a child whose rows all are is done with.  So near
    copies of one text, which share most of their values and whose nodes no
    branching makes small, cost a comparison a row and level.  In nodes that
    stay large all the same only rows outside the pivot's class meet the others.
    """
    likely = int(POSITIONS * (LIKELY + (percent - 80) / 100))
    at_root = F.explode(F.array(*(F.concat(F.lit(bytes([t])), F.expr(f"substring(minhash, {2 * int(_ROOTS[t]) + 1}, 2)")) for t in range(trees))))
    rows = nodes.select("rep", "minhash", at_root.alias("node"), F.col("rep").alias("cls"))
    small = lambda df: df.select(F.xxhash64("node").alias("grp"), "rep", "minhash")
    groups, met = [], []
    for level in range(LEVELS + 1):
        counts = cut(rows.groupBy("node").agg(F.count("*").alias("n"), F.min("cls").alias("least"), F.max("cls").alias("most")))
        several = counts.filter("least < most")
        large = several.filter(F.col("n") > NODE_ROWS).select("node")
        if level:
            rows = rows.join(several.select("node"), "node", "left_semi")
        if large.isEmpty():
            groups.append(small(rows))
            break
        groups.append(small(rows.join(large, "node", "left_anti")))
        hot = cut(compared(rows.join(large, "node", "left_semi"), likely))
        met.append(hot.filter("near AND rep <> pivot").select(F.col("rep").alias("a"), F.col("pivot").alias("b")))
        if level == LEVELS:
            sides = hot.select("node", "rep", "minhash", F.lit(1).alias("size"), (F.col("cls") != F.col("pivot_cls")).alias("apart"))
            groups.append(meet_apart(sides, "node", NODE_ROWS).select("grp", "rep", "minhash"))
        else:
            rows = cut(branched(hot))
    dealt = reduce(DataFrame.unionByName, groups).repartition("grp").sortWithinPartitions("grp")

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_group(batches, "grp", CHUNK_ROWS):
            rep = np.asarray(batch.column("rep"))
            values = np.frombuffer(b"".join(batch.column("minhash").to_pylist()), np.uint16).reshape(-1, POSITIONS)
            group = np.asarray(batch.column("grp"))
            found = branch(values, group, np.arange(len(rep)), int(group[0]) & 0xFFFF, likely)
            a, b = np.array(found, np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([pa.array(rep[a]), pa.array(rep[b])], names=["a", "b"])

    return reduce(DataFrame.unionByName, [dealt.mapInArrow(links, "a long, b long"), *met]).filter("a <> b")


def components(links: DataFrame) -> DataFrame:
    """node, label: the smallest id reachable; nodes without links are left out.

    Alternating large and small stars; each round's links are written and read again.
    """
    rounds = Rounds(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    state = None
    while True:
        e = rounds.table
        new = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
        if (new["n"], new["h"]) == state:
            return e.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("label"))).distinct()
        state = (new["n"], new["h"])
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        rounds.put(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())


def alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union of two sorted sets that aren't empty."""
    both = np.count_nonzero(x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y)
    return 100 * both >= percent * (len(x) + len(y) - both)


def marked(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is in ``ids(doc_id)`` and some others (one in a hundred, at 700,000 ids): only they need to be dealt out.

    A bitmap of MARKS hashed ids goes to all tasks; it has a fixed size at any number of ids.
    """
    mark = F.pmod(F.xxhash64("doc_id"), F.lit(MARKS)) + 1
    bits = ids.select(F.bitmap_bucket_number(mark).alias("bucket"), F.bitmap_bit_position(mark).alias("bit")).repartition("bucket").groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
    byte = F.conv(F.hex(F.substring("bits", (F.bitmap_bit_position(mark) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = docs.withColumn("bucket", F.bitmap_bucket_number(mark)).join(F.broadcast(bits), "bucket")
    return held.filter(F.bit_get(byte, (F.bitmap_bit_position(mark) % 8).cast("int")) == 1).select(*docs.columns)


def _sets_of(docs: DataFrame, members: DataFrame, width: int) -> DataFrame:
    """``members(grp, rep, center)`` with shingles, the sorted set of the text of doc_id = rep.  Texts meet their groups first, so that sets are dealt once."""
    by_rep = members.groupBy(F.col("rep").alias("doc_id")).agg(F.collect_list(F.struct("grp", "center")).alias("grps"))  # a few dozen, or the blocks of a class
    few = by_rep.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    docs = docs.select("doc_id", "text")
    texts = docs.join(F.broadcast(by_rep), "doc_id") if few else marked(docs, by_rep).join(by_rep, "doc_id")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, some in some_texts(batches, "text", TEXT_BYTES):
            offsets, h = shingle_sets(some, width)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id").cast(pa.int64()), rows.column("grps"), pa.array([h[s:e].tobytes() for s, e in zip(offsets[:-1], offsets[1:], strict=True)], pa.binary())], names=["rep", "grps", "shingles"])

    rows = texts.mapInArrow(sets, "rep long, grps array<struct<grp:bigint,center:boolean>>, shingles binary").filter("length(shingles) > 0")
    return rows.select(F.explode("grps").alias("g"), "rep", "shingles").select("g.grp", "g.center", "rep", "shingles")


def stars(docs: DataFrame, members: DataFrame, width: int, percent: int) -> DataFrame:
    """a, b: the center of each group of ``members(grp, rep, center)`` with those of the group whose sets are like its own."""
    rows = _sets_of(docs, members, width)

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_group(batches, "grp", 512):
            grp, rep, center, data = np.asarray(batch.column("grp")), np.asarray(batch.column("rep")), np.asarray(batch.column("center")), batch.column("shingles")
            set_of = lambda i: np.frombuffer(data[int(i)].as_buffer(), np.uint64)  # noqa: B023, E731
            own: dict[int, list[int]] = {}  # rows of the center: several, if its doc_id has several texts
            for i in np.flatnonzero(center):
                own.setdefault(int(grp[i]), []).append(int(i))
            found = [(rep[own[int(grp[i])][0]], rep[i]) for i in np.flatnonzero(~center) if any(alike(set_of(k), set_of(i), percent) for k in own.get(int(grp[i]), ()))]
            a, b = np.array(found, np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return rows.repartition("grp").sortWithinPartitions("grp").mapInArrow(links, "a long, b long")


def all_links(docs: DataFrame, members: DataFrame, width: int, percent: int) -> DataFrame:
    """a, b: links among all sets of each group of ``members(grp, rep)``, enough to connect those that are linked."""
    rows = _sets_of(docs, members.withColumn("center", F.lit(False)), width).select("grp", "rep", "shingles")

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_group(batches, "grp", 512):
            grp, rep, data = np.asarray(batch.column("grp")), np.asarray(batch.column("rep")), batch.column("shingles")
            bounds = np.concatenate((np.flatnonzero(np.diff(grp, prepend=grp[:1] - 1)), [len(grp)]))
            found = []
            for s, e in zip(bounds[:-1], bounds[1:], strict=True):
                found += [(rep[s + a], rep[s + b]) for a, b in linked_sets([np.frombuffer(data[i].as_buffer(), np.uint64) for i in range(s, e)], percent)]
            a, b = np.array(found, np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return rows.repartition("grp").sortWithinPartitions("grp").mapInArrow(links, "a long, b long").filter("a <> b")


def meet_apart(rows: DataFrame, key: str, most: int) -> DataFrame:
    """Adds ``grp`` to ``rows(key, apart, rep, size, ...)``: rows of a key that are apart meet all its rows, others only those.

    Rows are cut into blocks of about half of ``most`` by ``size``, and pairs of
    blocks meet of which one holds rows that are apart: a key whose rows are
    nearly all alike takes a number of groups in proportion to them.  A key
    without rows that are apart takes none.
    """
    number = lambda n: F.ceil(F.sum(n) / (most / 2)).cast("int")
    place = lambda blocks: F.pmod(F.xxhash64("rep"), F.col(blocks)).cast("int")
    every = lambda blocks: F.sequence(F.lit(0), F.col(blocks) - 1)
    sizes = rows.groupBy(key).agg(number(F.when(F.col("apart"), F.col("size")).otherwise(0)).alias("few"), F.greatest(F.lit(1), number(F.when(F.col("apart"), 0).otherwise(F.col("size")))).alias("many"))
    sides = rows.join(sizes.filter("few > 0"), key)
    among = lambda i, j: F.xxhash64(key, F.lit("among"), F.least(i, j), F.greatest(i, j))
    with_near = lambda i, j: F.xxhash64(key, F.lit("with"), i, j)
    own = sides.withColumn("own", F.when(F.col("apart"), place("few")).otherwise(place("many")))
    grps = F.when(F.col("apart"), F.concat(F.transform(every("few"), lambda j: among(F.col("own"), j)), F.transform(every("many"), lambda j: with_near(F.col("own"), j)))).otherwise(F.transform(every("few"), lambda i: with_near(i, F.col("own"))))
    return own.withColumn("grp", F.explode(grps)).drop("few", "many", "own")


def confirmed_in_classes(docs: DataFrame, classes: DataFrame, width: int, percent: int, most: int) -> DataFrame:
    """a, b: links confirmed on whole sets, enough to connect the sets of each class (``classes(rep, cls, size)``) that are linked.

    A class of up to ``most`` shingles is one group.  Of a larger one all first
    meet its pivot, its least id, block by block.  Only those that aren't like
    the pivot then meet all others (``meet_apart``): copies of one text are near
    all like the pivot, so that a class of a great part of all texts takes a
    number of groups in proportion to it.
    """
    large = cut(classes.groupBy("cls").agg(F.sum("size").alias("n"), F.min("rep").alias("pivot")).filter(F.col("n") > most))
    small = classes.join(large.select("cls"), "cls", "left_anti").select(F.xxhash64("cls").alias("grp"), "rep")
    if large.isEmpty():
        return all_links(docs, small, width, percent)
    big = cut(classes.join(large.withColumn("blocks", F.ceil(F.col("n") / (most / 2)).cast("int")), "cls"))
    around = big.filter("rep <> pivot").select(F.xxhash64("cls", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).alias("grp"), "rep", F.lit(False).alias("center"))
    pivots = big.filter("rep = pivot").select(F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "cls", "rep").select(F.xxhash64("cls", "block").alias("grp"), "rep", F.lit(True).alias("center"))
    near = cut(stars(docs, around.unionByName(pivots), width, percent))
    known = near.select(F.col("b").alias("rep"), F.lit(True).alias("is_near")).distinct()
    sides = big.join(known, "rep", "left").select("cls", "rep", "size", (F.col("is_near").isNull() & (F.col("rep") != F.col("pivot"))).alias("apart"))
    rest = meet_apart(sides, "cls", most).select("grp", "rep")
    return near.unionByName(all_links(docs, small.unionByName(rest), width, percent))


def linked_sets(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links of a spanning forest over all pairs with 100 * intersection >= percent * union."""
    n = len(sets)
    size = np.fromiter(map(len, sets), np.int64, n)
    enough = lambda both, i, j: 100 * both >= percent * (size[i] + size[j] - both)
    classes = Classes(n)
    if n == 2:
        if enough(len(np.intersect1d(*sets, assume_unique=True)), 0, 1):
            classes.join(np.array([0]), np.array([1]))
        return classes.links
    token, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)[1:]
    order = np.argsort(token, kind="stable")
    holder = np.repeat(np.arange(n), size)[order]  # the documents of each token, token after token
    first, at = np.concatenate(([0], np.cumsum(count))), np.concatenate(([0], np.cumsum(size)))

    def linked(i: int) -> np.ndarray:
        mine = token[at[i] : at[i + 1]]
        length = count[mine]
        where = np.repeat(first[mine] - np.concatenate(([0], np.cumsum(length)[:-1])), length) + np.arange(length.sum())
        both = np.bincount(holder[where], minlength=n)
        return np.flatnonzero(enough(both, i, np.arange(n)) & (both > 0))

    _against_all(np.arange(n), classes, linked)
    return classes.links


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, trees: int = TREES) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row.

    A null doc_id links with nothing (component_id null, kept).  Texts without
    words (null, empty) have no shingles and are linked with nothing.  Rows that
    repeat a doc_id count as one document.  Very long texts enter whole; an empty
    table gives an empty result; further columns are left out.
    """
    all_rows = cut(sketches(docs, width))
    sets = all_rows.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("rep"), F.first("minhash").alias("minhash"))
    sets = cut(sets)
    likely = components(candidate_links(sets.select("rep", "minhash"), trees, percent))
    same_id = all_rows.filter("n_shingles > 0").select("doc_id", "set_a", "set_b").join(sets.select("set_a", "set_b", "rep"), ["set_a", "set_b"])
    twice = same_id.filter("rep <> doc_id").join(all_rows.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"), "doc_id").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    size = sets.groupBy("rep").agg(F.max("n_shingles").alias("size"))
    classes = likely.select(F.col("node").alias("rep"), F.col("label").alias("cls")).join(size, "rep")
    found = confirmed_in_classes(docs.select("doc_id", "text"), classes, width, percent, CLASS_SHINGLES)
    label = components(found.unionByName(twice)).select(F.col("node").alias("rep"), "label")
    named = sets.join(label, "rep", "left").select(F.col("set_a").alias("a_of"), F.col("set_b").alias("b_of"), F.coalesce("label", "rep").alias("label"))
    joined = all_rows.join(named, (F.col("set_a") == F.col("a_of")) & (F.col("set_b") == F.col("b_of")) & F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), "left")
    component = F.coalesce("label", "doc_id")
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def drop_near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, trees: int = TREES) -> DataFrame:
    """``docs`` with one document of each class of near-duplicates: that of the smallest doc_id, once.

    Of several rows with one doc_id that of the least hash over all columns but
    maps stays; rows that differ in maps only count as equal, and either stays.
    Rows without a doc_id, and texts without words, stay.  Very long texts enter
    whole; an empty table gives an empty result; columns may have any names.
    """
    found = cut(near_duplicates(docs, width, percent, trees))
    gone = found.filter("NOT kept").select(F.col("doc_id").alias("_gone"))
    several = found.filter("kept AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("doc_id").alias("_several"))
    small = lambda df: F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df
    # Rows go through the joins as a whole, so that their columns' names meet none of ours.
    left = docs.select(F.col("doc_id").alias("_id"), F.struct("*").alias("_row")).join(small(gone), F.col("_id") == F.col("_gone"), "left_anti")
    several = small(several)
    hashed = [F.col("_row")[c] for c in docs.columns if "map<" not in docs.schema[c].dataType.simpleString()]
    twice = left.join(several, F.col("_id") == F.col("_several"), "left_semi")
    once = twice.groupBy("_id").agg(F.min_by("_row", F.xxhash64(*hashed)).alias("_row"))
    return left.join(several, F.col("_id") == F.col("_several"), "left_anti").select("_row.*").unionByName(once.select("_row.*"))


def oracle_sql(percent: int = PERCENT) -> str:
    """DuckDB: pairs of words, all pairs of documents that share one, links by recursion."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w
  ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared >= {percent} * (x.n + y.n - shared)),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM sizes UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.other),
least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component_id, doc_id) AS component_id, coalesce(component_id, doc_id) = doc_id AS kept
FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN least USING (doc_id)"""

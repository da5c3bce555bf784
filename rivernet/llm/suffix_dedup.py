"""Removal of long byte strings that occur more than once.

This is not external induced sorting of all suffixes, whose tuples alone exceed
the disk allowed (README); it keeps that method's outline on a sample.  Of the
suffixes only those are taken whose first ``PREFIX`` bytes hash lowest in some
string of ``STRETCH`` or of ``LENGTH`` bytes.  Their tuples are dealt and sorted
by the hash of that prefix, their name; names that occur once drop out.  A
second round names the strings that a sample stands for; what both rounds leave
open is compared within its name, and names of very many strings are sampled
once more by longer prefixes.  Two strings count as equal if their names and
their own hashes, 128 bits in all, are.  No task holds a shard: sorting streams,
and spills to disk.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, text_of
from .near_dedup import by_group
from .shingles import _BASE, _BASE_INV, _BYTE, mixed, powers

LENGTH, STRETCH, PREFIX = 400, 290, 120  # STRETCH: bytes of about 50 words
SEGMENT, PLACE_BITS = 1 << 19, 22
BROADCAST_ROWS, FEW_CONTENTS, GROUP_ROWS, FEW_BYTES = 500_000, 2_000, 1_000, 24
SHARE, HEAVY_AT, HEAVY = 1 / 64, 8, 10_000  # where to look for names that many rows hold; decides the dealing only


def _prefix_sums(buf: np.ndarray) -> np.ndarray:
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * powers(_BASE, len(buf)), out=out[1:])
    return out


def _hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the strings [start, end), the same wherever they lie."""
    return mixed((sums[end] - sums[start]) * powers(_BASE_INV, len(sums))[start])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """min(values[i : i + width]) for every i, by prefix and suffix minima of blocks."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def sample(data: bytes, bounds: np.ndarray, length: int = LENGTH, prefix: int = PREFIX, stretch: int = STRETCH) -> tuple[np.ndarray, ...]:
    """(place, first, last, name, content, context) of the samples of texts that lie end to end in ``data``.

    A sample at ``place`` stands for the strings of ``length`` bytes that start
    at first..last: its prefix hashes lowest in each of them.  ``name`` is the
    prefix's hash, ``content`` that of all those strings and the place in them,
    ``context`` that of all strings of ``stretch`` bytes that hold the prefix.
    A sample that is lowest in such strings only stands for none: it has last
    one before first.
    """
    none = (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),) * 3
    if len(data) < stretch:
        return none
    sums = _prefix_sums(np.frombuffer(data, np.uint8))
    names = _hashes(sums, slice(0, len(data) - prefix + 1), slice(prefix, len(data) + 1))
    low = np.uint64((1 << PLACE_BITS) - 1)
    ranked = (names & ~low) | np.arange(len(names), dtype=np.uint64)
    starts, ends = np.concatenate(([0], bounds)).astype(np.int64), np.append(bounds, len(data)).astype(np.int64)

    def owners(size: int) -> tuple[np.ndarray, ...]:
        """Starts of the strings of ``size`` bytes, the place of the lowest prefix in each, and their texts."""
        if len(data) < size:
            return (np.empty(0, np.int64),) * 3
        owner = (sliding_min(ranked, size - prefix + 1) & low).astype(np.int64)
        text = np.searchsorted(bounds, np.arange(len(owner)), "right")
        at = np.flatnonzero(np.arange(len(owner)) + size <= ends[text])
        return at, owner[at], text[at]

    at, own, of = owners(length)
    new = np.flatnonzero(np.concatenate((np.ones(1, bool), (own[1:] != own[:-1]) | (of[1:] != of[:-1])))) if len(at) else np.empty(0, np.int64)
    first, last, place = at[new], at[np.append(new[1:], len(at)) - 1] if len(at) else at, own[new]
    short = owners(stretch)
    rest = short[1][~np.isin(short[1], place)]
    rest = np.unique(rest)
    content = mixed(_hashes(sums, first, last + length) + mixed((place - first).astype(np.uint64) * np.uint64(1 << 20) + (last - first).astype(np.uint64)))
    place = np.concatenate((place, rest))
    text = np.searchsorted(bounds, place, "right")
    left, right = np.maximum(place - stretch + prefix, starts[text]), np.minimum(place + stretch, ends[text])
    context = mixed(_hashes(sums, left, right) + mixed((place - left).astype(np.uint64) * np.uint64(1 << 20) + (right - left).astype(np.uint64)))
    return place, np.concatenate((first, rest)), np.concatenate((last, rest - 1)), names[place], np.concatenate((content, np.zeros(len(rest), np.uint64))), context


def _texts(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, bytes]]:
    """(rows, offset of each piece in its text, pieces end to end with their bounds) of about SEGMENT bytes.

    A longer text comes in pieces that overlap by LENGTH - 1 bytes.
    """
    rows, offsets, parts, size = [], [], [], 0
    for i, value in enumerate(column):
        data = value.as_buffer().to_pybytes() if value.is_valid else b""
        for at in range(0, max(1, len(data) - LENGTH + 1), 4 * SEGMENT):
            piece = data[at : at + 4 * SEGMENT + LENGTH - 1]
            rows.append(i)
            offsets.append(at)
            parts.append(piece)
            size += len(piece)
            if size >= SEGMENT:
                yield np.array(rows), np.array(offsets), parts
                rows, offsets, parts, size = [], [], [], 0
    if rows:
        yield np.array(rows), np.array(offsets), parts


def sample_tuples(texts: DataFrame) -> DataFrame:
    """mark, n_bytes, place, back, more, name, content, context of every sample of ``texts(mark, n_bytes, text)``.

    A sample's strings of LENGTH bytes start at place - back and the ``more`` places behind.
    """

    def tuples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mark, n_bytes = (np.asarray(batch.column(c)) for c in ("mark", "n_bytes"))
            for rows, offsets, parts in _texts(batch.column("text")):
                ends = np.cumsum([len(p) for p in parts])
                place, first, last, *hashes = sample(b"".join(parts), ends[:-1])
                of = np.searchsorted(ends, place, "right")
                shift = (offsets - np.concatenate(([0], ends[:-1])))[of]
                columns = [mark[rows[of]], n_bytes[rows[of]], place + shift, (place - first).astype(np.int16), (last - first).astype(np.int16), *(h.view(np.int64) for h in hashes)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["mark", "n_bytes", "place", "back", "more", "name", "content", "context"])

    return texts.select("mark", "n_bytes", "text").mapInArrow(tuples, "mark long, n_bytes long, place long, back short, more short, name long, content long, context long")


def heavy_names(samples_of_some: DataFrame) -> np.ndarray:
    """Names that a share of the rows holds many times already, at most HEAVY of them, sorted."""
    counts = samples_of_some.groupBy("name").agg(F.count("*").alias("n")).filter(F.col("n") >= HEAVY_AT)
    return np.array(sorted(r.name for r in counts.orderBy(F.col("n").desc(), "name").limit(HEAVY).collect()), np.int64)


def repeated_samples(samples: DataFrame, heavy: np.ndarray) -> DataFrame:
    """Sample tuples whose name occurs more than once, by an external sort that streams.

    Heavy names are known to repeat: their rows are spread over the tasks and
    come through as they are.
    """
    known = F.broadcast(samples.sparkSession.createDataFrame([(int(x),) for x in heavy], "heavy long"))
    salted = samples.join(known, F.col("name") == F.col("heavy"), "left").withColumn("deal", F.when(F.col("heavy").isNull(), F.col("name")).otherwise(F.xxhash64("mark", "place"))).withColumn("sure", F.col("heavy").isNotNull()).drop("heavy")

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last, open_ = None, None, False  # the last row, if it may yet turn out to repeat
        for batch in batches:
            if not batch.num_rows:
                continue
            k, sure = np.asarray(batch.column("name")), np.asarray(batch.column("sure"))
            same = np.concatenate(([last is not None and k[0] == last], k[1:] == k[:-1]))
            if same[0] and open_:
                yield held
            keep = same | np.append(same[1:], False) | sure
            yield batch.filter(pa.array(keep)).select(names)
            last, open_, held = k[-1], not keep[-1], batch.slice(batch.num_rows - 1, 1).select(names)

    names = samples.columns
    return salted.repartition("deal").sortWithinPartitions("name").mapInArrow(runs, samples.schema)


def open_tuples(texts: DataFrame, opened: DataFrame) -> DataFrame:
    """deal, name, content, wanted, offset, data: the bytes [start, end) of the texts named in ``opened(mark, n_bytes, start, end, ...)``.

    offset is the place of the sample in them.
    """
    carried = ["deal", "name", "content", "wanted", "offset"]
    by_text = opened.groupBy("mark", "n_bytes").agg(F.collect_list(F.struct("start", "end", *carried)).alias("open"))
    few = by_text.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    marks = by_text.select(F.col("mark").alias("m"), F.col("n_bytes").alias("n"))
    some = texts.join(F.broadcast(marks) if few else marks, (F.col("mark") == F.col("m")) & (F.col("n_bytes") == F.col("n")), "left_semi")
    rows = some.dropDuplicates(["mark", "n_bytes"]).join(by_text, ["mark", "n_bytes"]).select("text", "open")
    types = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.binary())
    batch_of = lambda held: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=[*carried, "data"])

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple] = []
            size = 0
            for value, samples in zip(batch.column("text"), batch.column("open"), strict=True):
                data = value.as_buffer()
                for s in samples.as_py():
                    part = data[s["start"] : s["end"]]
                    held.append((*(s[c] for c in carried), part.to_pybytes()))
                    size += len(part)
                    if size >= SEGMENT:
                        yield batch_of(held)
                        held, size = [], 0
            if held:
                yield batch_of(held)

    return rows.mapInArrow(strings, "deal long, name long, content long, wanted boolean, offset int, data binary")


def _slices(batch: pa.RecordBatch, key: str, rows: int) -> Iterator[pa.RecordBatch]:
    """Slices of a sorted batch of about ``rows`` rows that cut no group."""
    k = np.asarray(batch.column(key))
    ends = np.append(np.flatnonzero(k[1:] != k[:-1]) + 1, len(k))
    start = 0
    while start < len(k):
        end = int(ends[np.searchsorted(ends, min(start + rows, len(k)))])
        yield batch.slice(start, end - start)
        start = end


def _width(length: int) -> int:
    """Places of the sample in a string that make a range: as many as there are ranges, so that a content has the fewest rows in all."""
    return math.isqrt(length - PREFIX) + 1


def common_cores(tuples: DataFrame, length: int) -> DataFrame:
    """name, content, range, key: what all strings share, by its hash, in which the sample's place lies in one range."""
    width = _width(length)

    def cores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            name, content, offset = (np.asarray(batch.column(c)) for c in ("name", "content", "offset"))
            parts = batch.column("data").to_pylist()
            size = np.fromiter(map(len, parts), np.int64, len(parts))
            base, sums = np.cumsum(size) - size, _prefix_sums(np.frombuffer(b"".join(parts), np.uint8))
            for k, low in enumerate(range(0, length - PREFIX + 1, width)):
                high = min(low + width - 1, length - PREFIX)
                at = np.flatnonzero((offset >= low) & (offset - (size - length) <= high))
                key = _hashes(sums, (base + offset - low)[at], (base + offset + length - high)[at]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(name[at]), pa.array(content[at]), pa.array(np.full(len(at), k, np.int32)), pa.array(key)], names=["name", "content", "range", "key"])

    return tuples.mapInArrow(cores, "name long, content long, range int, key long")


def repeated_in_parts(tuples: DataFrame, length: int, rest: bool) -> DataFrame:
    """name, content, tag, s, e: strings s..e of wanted rows that several contents in one ``deal`` of a name hold; ``tag`` tells rows apart.

    With ``rest``, key marks further rows of single strings for what lies in
    different deals: of each string that one content of a deal holds (alone:
    whether it is wanted), and one row for each that several do; but only in
    the ranges that ``tuples`` name in ``open``.
    """
    width = _width(length)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in by_group(batches, "deal", GROUP_ROWS) for part in _slices(whole, "deal", GROUP_ROWS)):
            deal, name, content, tag, wanted = (np.asarray(batch.column(c)) for c in ("deal", "name", "content", "tag", "wanted"))
            parts = batch.column("data").to_pylist()
            size = np.fromiter(map(len, parts), np.int64, len(parts))
            n = size - length + 1
            inside = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
            start = np.repeat(np.cumsum(size) - size, n) + inside
            key = _hashes(_prefix_sums(np.frombuffer(b"".join(parts), np.uint8)), start, start + length).view(np.int64)
            row = np.repeat(np.arange(len(parts)), n)
            order = np.lexsort((content[row], key, name[row], deal[row]))
            of, by = row[order], key[order]
            new = np.flatnonzero(np.concatenate(([True], (by[1:] != by[:-1]) | (name[of[1:]] != name[of[:-1]]) | (deal[of[1:]] != deal[of[:-1]]))))
            end = np.append(new[1:], len(by))
            several = content[of[new]] != content[of[end - 1]]
            twice = np.empty(len(by), bool)
            twice[order] = np.repeat(several, end - new)
            hit = twice & wanted[row]
            goes_on = np.zeros(len(by) + 1, bool)
            goes_on[1:-1] = hit[1:] & hit[:-1] & (row[1:] == row[:-1])
            s, e = np.flatnonzero(hit & ~goes_on[:-1]), np.flatnonzero(hit & ~goes_on[1:])
            columns = [pa.array(name[row[s]]), pa.array(content[row[s]]), pa.array(tag[row[s]]), pa.array(inside[s]), pa.array(inside[e])]
            names = ["name", "content", "tag", "s", "e"]
            if rest:
                columns, names = [*columns, pa.nulls(len(s), pa.int64()), pa.nulls(len(s), pa.bool_())], [*names, "key", "alone"]
            yield pa.RecordBatch.from_arrays(columns, names=names)
            if rest:
                of = (np.asarray(batch.column("offset"))[row] - inside) // width
                is_open = (np.asarray(batch.column("open"))[row] >> of & 1).astype(bool)
                one = order[new[several]]
                k = np.concatenate((one[is_open[one]], np.flatnonzero(~twice & is_open)))
                alone = wanted[row[k]] & ~twice[k]
                yield pa.RecordBatch.from_arrays([pa.array(name[row[k]]), pa.array(content[row[k]]), pa.array(tag[row[k]]), pa.array(inside[k]), pa.array(inside[k]), pa.array(key[k]), pa.array(alone)], names=names)

    return tuples.repartition("deal").sortWithinPartitions("deal").mapInArrow(found, "name long, content long, tag long, s int, e int" + ", key long, alone boolean" * rest)


def held_twice(texts: DataFrame, opened: DataFrame, names: DataFrame, length: int) -> DataFrame:
    """name, content, s, e: the strings of wanted rows of ``opened`` that several contents of one of ``names(name, contents)`` hold."""
    known = opened.join(names.select("name", (F.col("contents") > FEW_CONTENTS).alias("large")), "name").withColumn("deal", F.col("name"))
    found = repeated_in_parts(open_tuples(texts, known.filter("NOT large")).withColumn("tag", F.col("content")), length, False).select("name", "content", "s", "e")
    if names.filter(F.col("contents") > FEW_CONTENTS).isEmpty():
        return found
    large = cut(open_tuples(texts, known.filter("large")).drop("deal").withColumn("tag", F.col("content")))
    return found.unionByName(in_large_names(large, length, _halfway(PREFIX, length)).select("name", F.col("tag").alias("content"), "s", "e"))


def _halfway(prefix: int, length: int) -> int:
    return (prefix + length) // 2


def refined(tuples: DataFrame, length: int, prefix: int) -> DataFrame:
    """name, content, tag, wanted, base, name2, tag2, more, offset, data: samples by a longer prefix of the strings in ``tuples``.

    The name goes into name2, so samples of different names stay apart; tag2 is
    the hash of a sample's strings.  These are base and the ``more`` behind it of
    the row named by name and tag.
    """

    def samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, GROUP_ROWS):
                batch = whole.slice(at, GROUP_ROWS)
                parts = batch.column("data").to_pylist()
                ends = np.cumsum([len(p) for p in parts])
                data = b"".join(parts)
                place, first, last, names, strings, _ = sample(data, ends[:-1], length, prefix, length)
                of = np.searchsorted(ends, place, "right")
                base = first - np.concatenate(([0], ends[:-1]))[of]
                row = pa.array(of)
                columns = [batch.column(c).take(row) for c in ("name", "content", "tag", "wanted")]
                columns += [pa.array(base.astype(np.int32)), pa.array(mixed(names ^ mixed(np.asarray(batch.column("name"))[of].view(np.uint64))).view(np.int64)), pa.array(strings.view(np.int64))]
                columns += [pa.array((last - first).astype(np.int32)), pa.array((place - first).astype(np.int32)), pa.array([data[s:e] for s, e in zip(first.tolist(), (last + length).tolist(), strict=True)], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["name", "content", "tag", "wanted", "base", "name2", "tag2", "more", "offset", "data"])

    return tuples.select("name", "content", "tag", "wanted", "data").mapInArrow(samples, "name long, content long, tag long, wanted boolean, base int, name2 long, tag2 long, more int, offset int, data binary")


def in_large_names(tuples: DataFrame, length: int, prefix: int) -> DataFrame:
    """name, tag, s, e: the strings of wanted rows that several contents of a name hold; for names with more than FEW_CONTENTS contents.

    ``tuples(name, content, tag, wanted, offset, data)``.  The strings are
    sampled anew by a longer prefix, halfway to their length: what shares the
    name's prefix alone then has different names.  A sample that several
    contents have is repeated as a whole; it goes on as two rows, of different
    contents, for others to meet.  Names that are still large are sampled once
    more.  Only strings that share all but FEW_BYTES are compared one by one.
    """
    if length - prefix < FEW_BYTES:
        return by_strings(tuples, length)
    by = ["name2", "tag2"]
    rows = cut(refined(tuples, length, prefix))
    one = F.struct("content", "name", "tag", "base", "wanted", "offset", "data")
    groups = cut(rows.groupBy(*by).agg(F.min(one).alias("one"), F.max("content").alias("last"), F.bool_or("wanted").alias("wanted")).withColumn("several", F.col("one.content") != F.col("last")))
    end = F.col("base") + F.col("more")
    wholly = rows.filter("wanted").join(groups.filter("several").select(*by), by).select("name", "tag", F.col("base").alias("s"), end.alias("e"))
    sizes = cut(groups.groupBy("name2").agg(F.count("*").alias("contents")).filter("contents > 1"))
    contents = F.explode(F.when(F.col("several"), F.array("one.content", "last")).otherwise(F.array("one.content")))
    ones = groups.join(sizes, "name2").select(F.col("name2").alias("name"), contents.alias("content"), F.col("tag2").alias("tag"), (~F.col("several") & F.col("wanted")).alias("wanted"), "one.offset", "one.data", "contents")
    found = repeated_in_parts(ones.filter(F.col("contents") <= FEW_CONTENTS).drop("contents").withColumn("deal", F.col("name")), length, False).select("name", "tag", "s", "e")
    if not sizes.filter(F.col("contents") > FEW_CONTENTS).isEmpty():
        found = found.unionByName(in_large_names(cut(ones.filter(F.col("contents") > FEW_CONTENTS).drop("contents")), length, _halfway(prefix, length)))
    of = rows.filter("wanted").select(F.col("name2").alias("of_name"), F.col("tag2").alias("of_tag"), "name", "tag", "base")
    inner = found.select(F.col("name").alias("of_name"), F.col("tag").alias("of_tag"), "s", "e").join(of, ["of_name", "of_tag"])
    return wholly.unionByName(inner.select("name", "tag", (F.col("base") + F.col("s")).alias("s"), (F.col("base") + F.col("e")).alias("e")))


def by_strings(tuples: DataFrame, length: int) -> DataFrame:
    """The same string by string, without a group of all contents of a name.

    Names are dealt in parts of about FEW_CONTENTS contents; strings that lie in
    one part each are then met by their hash, where what a range of them has in
    common is found in several contents at all.
    """
    parts = tuples.groupBy("name").agg(F.ceil(F.count("*") / FEW_CONTENTS).alias("parts"))
    tuples = tuples.join(parts, "name").withColumn("deal", F.xxhash64("name", F.pmod(F.xxhash64("content"), F.col("parts")))).drop("parts")
    cores, by = common_cores(tuples, length), ["name", "range", "key"]
    shared = cores.groupBy(*by).agg(F.min("content").alias("low"), F.max("content").alias("high")).filter("low <> high").select(*by)
    opened_ranges = cores.join(shared, by).groupBy("name", "content").agg(F.bit_or(F.expr("shiftleft(1L, range)")).alias("open"))
    ranged = tuples.join(opened_ranges, ["name", "content"], "left").withColumn("open", F.coalesce("open", F.lit(0).cast("long")))
    large = cut(repeated_in_parts(ranged, length, True))
    single = large.filter("key IS NOT NULL")
    keys = single.groupBy("name", "key").agg(F.min("content").alias("low"), F.max("content").alias("high")).filter("low <> high").select("name", "key")
    met = single.filter("alone").join(keys, ["name", "key"])
    columns = ["name", "tag", "s", "e"]
    return large.filter("key IS NULL").select(*columns).unionByName(met.select(*columns))


def repeated_ranges(texts: DataFrame, samples: DataFrame) -> DataFrame:
    """mark, n_bytes, range: bytes [start, end) of each text that lie in repeated strings; overlapping, unordered."""
    id_ = ["name", "content"]
    samples = samples.filter("more >= 0").withColumn("start", F.col("place") - F.col("back"))
    contents = cut(samples.groupBy(*id_).agg(F.count("*").alias("n"), F.min(F.struct("mark", "n_bytes", "start", (F.col("start") + F.col("more") + LENGTH).alias("end"), F.col("back").cast("int").alias("offset"))).alias("one")))
    names = cut(contents.groupBy("name").agg(F.count("*").alias("contents")).filter("contents > 1"))
    partly = held_twice(texts, contents.select(*id_, "one.*", (F.col("n") == 1).alias("wanted")), names, LENGTH)
    wholly = contents.filter("n > 1").select(*id_, F.lit(0).alias("s"), F.lit(None).cast("int").alias("e"))
    covered = samples.select("mark", "n_bytes", "start", "more", *id_).join(partly.unionByName(wholly), id_)
    return covered.select("mark", "n_bytes", F.struct((F.col("start") + F.col("s")).alias("start"), (F.col("start") + F.coalesce("e", "more") + LENGTH).alias("end")).alias("range")).distinct()


def sharing_texts(texts: DataFrame, samples: DataFrame) -> DataFrame:
    """mark, n_bytes of the texts that hold STRETCH bytes which another text holds too.

    Most show by an equal context; only what those don't settle is compared.
    """
    of = ["mark", "n_bytes"]
    contexts = cut(samples.groupBy("name", "context").agg(F.min(F.struct(*of, "place")).alias("one"), F.max(F.struct(*of)).alias("last")).withColumn("equal", F.struct("one.mark", "one.n_bytes") != F.col("last")))
    names = contexts.groupBy("name").agg(F.count("*").alias("contents"), F.min(F.struct("one.mark", "one.n_bytes")).alias("low"), F.max("last").alias("high")).filter("contents > 1 AND low <> high")
    seen = cut(samples.join(contexts.filter("equal").select("name", "context"), ["name", "context"]).select(*of).distinct())
    left = contexts.filter("NOT equal").select("name", "one.mark", "one.n_bytes").join(seen, of, "left_anti").select("name").distinct()
    names = cut(names.join(left, "name", "left_semi").select("name", "contents"))
    start = F.greatest(F.col("one.place") - (STRETCH - PREFIX), F.lit(0))
    opened = contexts.select("name", F.xxhash64("one.mark", "one.n_bytes").alias("content"), "one.mark", "one.n_bytes", start.alias("start"), (F.col("one.place") + STRETCH).alias("end"), (F.col("one.place") - start).cast("int").alias("offset"), (~F.col("equal")).alias("wanted"))
    found = held_twice(texts, opened, names, STRETCH).select("name", "content").distinct()
    return opened.select("name", "content", *of).join(found, ["name", "content"]).select(*of).unionByName(seen).distinct()


def marked(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty), and mark and n_bytes, which tell texts apart."""
    rows = docs.select("doc_id", text_of().alias("text"))
    return rows.withColumns({"mark": F.xxhash64("text"), "n_bytes": F.octet_length("text").cast("long")})


def merged(ranges: list[dict]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted((r["start"], r["end"]) for r in ranges):
        if out and s <= out[-1][1]:
            out[-1] = out[-1][0], max(e, out[-1][1])
        else:
            out.append((s, e))
    return out


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, shared (and kept, the bytes left) of every row.

    shared: the text holds STRETCH bytes (a passage of about 50 words) which
    another text, equal ones apart, holds too, removed or not.  Null texts
    count as empty; texts shorter than LENGTH bytes stay whole.  Repeated rows
    are occurrences of their own, so of a text of LENGTH bytes or more nothing
    stays; a null or repeated doc_id is carried as it is.  Long texts are read
    in overlapping pieces.  An empty table gives an empty result; further
    columns are ignored.
    """
    texts = marked(docs)
    heavy = heavy_names(sample_tuples(marked(docs.sample(SHARE, 1))))
    samples = cut(repeated_samples(sample_tuples(texts), heavy))
    ranges = repeated_ranges(texts, samples).withColumn("shared", F.lit(False))
    shared = sharing_texts(texts, samples).select("mark", "n_bytes", F.lit(None).cast("struct<start:bigint,end:bigint>").alias("range"), F.lit(True).alias("shared"))
    by_text = ranges.unionByName(shared).groupBy("mark", "n_bytes").agg(F.collect_list("range").alias("ranges"), F.bool_or("shared").alias("shared"))
    by_text = by_text.withColumnsRenamed({"mark": "m", "n_bytes": "n"})
    rows = texts.join(by_text, (F.col("mark") == F.col("m")) & (F.col("n_bytes") == F.col("n")), "left").select("doc_id", "text", "ranges", F.coalesce("shared", F.lit(False)).alias("shared"))
    numbers = ["doc_id", "n_bytes", "n_removed", "n_spans"]
    schema = pa.schema([*((n, pa.int64()) for n in numbers), ("kept_sha256", pa.string()), ("shared", pa.bool_())] + [("kept", pa.binary())] * with_text)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text, ranges, shared in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("ranges"), batch.column("shared").to_pylist(), strict=True):
                data = text.as_buffer().to_pybytes()
                spans = merged(ranges.as_py()) if ranges.is_valid else []
                edges = [0, *(x for s in spans for x in s), len(data)]
                kept = b"".join(data[s:e] for s, e in zip(edges[::2], edges[1::2], strict=True)) if spans else data
                out.append((doc_id, len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), shared) + (kept,) * with_text)
            columns = list(zip(*out, strict=True)) or [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return rows.mapInArrow(remove, ", ".join(f"{n} long" for n in numbers) + ", kept_sha256 string, shared boolean" + ", kept binary" * with_text)


def oracle_sql(length: int = LENGTH, stretch: int = STRETCH) -> str:
    """DuckDB: every string of ``length`` bytes (by its hash) against all others, and of ``stretch`` bytes against other texts'; bytes as pairs of hex digits."""
    strings = lambda n: f"SELECT row, t, i, hash(substr(h, 2 * i + 1, {2 * n})) AS k FROM (SELECT row, t, h, unnest(range(0, greatest(length(h) // 2 - {n - 1}, 0))) AS i FROM texts)"
    return f"""
WITH texts AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS row, hex(encode(coalesce(text, ''))) AS h, hash(coalesce(text, '')) AS t FROM documents),
strings AS MATERIALIZED ({strings(length)}),
stretches AS MATERIALIZED ({strings(stretch)}),
sharing AS (SELECT DISTINCT row, true AS shared FROM stretches WHERE k IN (SELECT k FROM stretches GROUP BY k HAVING min(t) <> max(t))),
covered AS (SELECT row, i FROM strings WHERE k IN (SELECT k FROM strings GROUP BY k HAVING count(*) > 1)),
runs AS (SELECT row, min(i) AS s, max(i) + {length} AS e FROM (SELECT row, i, sum(fresh) OVER (PARTITION BY row ORDER BY i) AS run FROM
  (SELECT row, i, (i > coalesce(lag(i) OVER (PARTITION BY row ORDER BY i) + {length}, -1))::INT AS fresh FROM covered)) GROUP BY row, run),
gaps AS (SELECT row, s, e, coalesce(lag(e) OVER (PARTITION BY row ORDER BY s), 0) AS before FROM runs),
cuts AS (SELECT row, sum(e - s) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * before + 1, 2 * (s - before)), '' ORDER BY s) || substr(any_value(h), 2 * max(e) + 1) AS kept
  FROM gaps JOIN texts USING (row) GROUP BY row)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256, coalesce(shared, false) AS shared
FROM texts LEFT JOIN cuts USING (row) LEFT JOIN sharing USING (row)"""

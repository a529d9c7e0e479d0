"""Operator 7: SimHash near-duplicates by bit-sliced comparison.

Fingerprints are made in Arrow batches. Documents of one fingerprint are a class; classes are dealt by tables of
bit-band combinations such that two fingerprints within the radius share a band key in at least one table
(pigeonhole), so the search is exact. Within a bucket, blocks of classes keep their bits as vertical planes; the
distances from a fingerprint to 64 others grow together in carry-save counters, and words whose lanes have all
passed the radius are dropped after each group of planes. A bucket of any size is compared block by block in
separate tasks, and each comparison returns a spanning forest of its links, never all pairs.

Defined results: null and empty texts have fingerprint zero, linked like any other; rows repeating a doc_id are
one node; rows without a doc_id take part but name no component (null if nothing else is reachable).
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from propval.llm.common import lean, materialize, small_batches, table
from propval.llm.components import components

SHINGLE = 4
RADIUS = 4
SEED = 42
BITS = 64
BLOCK = 2048  # classes of one side of a comparison
LANES = 64  # fingerprints that one word of a plane holds
GROUP = 8  # planes between two checks for words to abandon
PAIR_WORDS = 1 << 16  # (fingerprint, word) pairs compared at once
HASHES = 1 << 15  # shingle hashes summed at once

_FOLD = bytes(ord(c.lower()) if "A" <= c <= "Z" else (0x20 if 9 <= i <= 13 else i) for i, c in enumerate(map(chr, range(256))))


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit SimHash of a text: bit set where over half of the shingles' XXH64 have it."""
    words = text.encode().translate(_FOLD).split(b" ") if text else []
    words = [w for w in words if w]
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(line, seed)]
    else:
        ends = list(itertools.accumulate([len(w) + 1 for w in words]))
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[a:b - 1], seed) for a, b in zip([0, *ends], ends[shingle - 1:])]
    total = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), HASHES):
        part = np.array(hashes[i:i + HASHES], "<u8")
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int((total * 2 > len(hashes)).astype(np.uint64) @ (np.uint64(1) << np.arange(BITS, dtype=np.uint64)))


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Columns ``keep`` of every row with ``fp``, the fingerprint's bits as a signed long."""
    small_batches(docs.sparkSession)
    schema = docs.select(*keep).schema.add("fp", "long")
    at = keep.index(text) if text in keep else len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(at)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep)], pa.array(fps)], names=[*keep, "fp"])

    return docs.select(*keep, *([] if text in keep else [F.col(text).alias("_text")])).mapInArrow(lean(run), schema)


def band_tables(classes: int, radius: int) -> list[list[tuple[int, int]]]:
    """Tables of (first bit, width) bands: any two fingerprints within ``radius`` agree on all bands of some table.

    With radius + m bands at least m agree; m grows with the number of classes so that a bucket of unrelated
    fingerprints holds some 64 of them.
    """
    for m in range(1, 5):
        n = radius + m
        if BITS * m / n >= math.log2(max(classes, 2)) - 6 or m == 4:
            cuts = [round(i * BITS / n) for i in range(n + 1)]
            return [[(cuts[i], cuts[i + 1] - cuts[i]) for i in chosen] for chosen in itertools.combinations(range(n), m)]


def _band_key(bands: list[tuple[int, int]]):
    mask = sum(((1 << w) - 1) << a for a, w in bands)
    return F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long"))


def planes_of(words: np.ndarray) -> np.ndarray:
    """(BITS, n words) planes of (n words, LANES) fingerprints: lane j of plane b is bit b of fingerprint j."""
    bits = np.unpackbits(words.astype("<u8").view(np.uint8).reshape(len(words), LANES, 8), axis=2, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.transpose(2, 0, 1), axis=2, bitorder="little").view("<u8")[:, :, 0])


def near_lanes(planes: np.ndarray, fps: np.ndarray, at: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For pairs (fps[i], word at[i]): the pairs that stay and the lanes within ``radius`` as bit masks.

    Counters are carry-save: one word per binary digit, a lane each; digits above the radius raise ``over``.
    """
    digits = radius.bit_length()
    alive = np.arange(len(fps))
    counter = np.zeros((digits, len(fps)), np.uint64)
    over = np.zeros(len(fps), np.uint64)
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    for first in range(0, BITS, GROUP):
        for b in range(first, first + GROUP):
            carry = planes[b][at] ^ (np.uint64(0) - ((fps >> np.uint64(b)) & np.uint64(1)))
            for d in range(digits):
                counter[d], carry = counter[d] ^ carry, counter[d] & carry
            over |= carry
        above, equal = np.zeros(len(fps), np.uint64), np.full(len(fps), full)
        for d in reversed(range(digits)):
            if radius >> d & 1:
                equal &= counter[d]
            else:
                above |= equal & counter[d]
                equal &= ~counter[d]
        dead = over | above
        stay = dead != full
        if not stay.all():
            alive, fps, at, over, counter, dead = alive[stay], fps[stay], at[stay], over[stay], counter[:, stay], dead[stay]
        if not len(alive):
            break
    return alive, (~dead if len(alive) else over)


def _hook(label: np.ndarray, i: int, js: np.ndarray) -> None:
    roots = np.unique(np.append(label[js], label[i]))
    if len(roots) > 1:
        label[np.isin(label, roots)] = roots[0]


def link_block(left: np.ndarray, right: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest (ends a, b) of the links within one block, or between two blocks."""
    other = left if right is None else right
    words = -(-len(other) // LANES)
    lanes = np.zeros(words * LANES, np.uint64)
    lanes[:len(other)] = other
    planes = planes_of(lanes.reshape(words, LANES))
    nodes = left if right is None else np.concatenate([left, right])
    shift = 0 if right is None else len(left)
    label = np.arange(len(nodes))
    step = max(1, PAIR_WORDS // words)
    for first in range(0, len(left), step):
        part = left[first:first + step]
        q, w = np.repeat(np.arange(len(part)), words), np.tile(np.arange(words), len(part))
        alive, near = near_lanes(planes, part[q], w, radius)
        for k in np.flatnonzero(near):
            i = first + int(q[alive[k]])
            js = int(w[alive[k]]) * LANES + np.flatnonzero(np.unpackbits(near[k:k + 1].view(np.uint8), bitorder="little"))
            js = js[js < len(other)]
            if right is None:
                js = js[js != i]
            if len(js) and (label[js + shift] != label[i]).any():
                _hook(label, i, js + shift)
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def link_small(blocks: list[np.ndarray], radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forests of many blocks of at most LANES fingerprints, one word each, compared together."""
    sizes = np.array([len(b) for b in blocks])
    lanes = np.zeros((len(blocks), LANES), np.uint64)
    flat, at = np.concatenate(blocks), np.repeat(np.arange(len(blocks)), sizes)
    lane = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    lanes[at, lane] = flat
    alive, near = near_lanes(planes_of(lanes), flat, at, radius)
    valid = (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(LANES) - sizes.astype(np.uint64)))[at[alive]]
    near = near & valid & ~(np.uint64(1) << lane[alive].astype(np.uint64))
    ends: list[list] = [[], []]
    linked = np.flatnonzero(near)
    for word in np.unique(at[alive[linked]]) if len(linked) else []:
        label = np.arange(sizes[word])
        for k in linked[at[alive[linked]] == word]:
            _hook(label, int(lane[alive[k]]), np.flatnonzero(np.unpackbits(near[k:k + 1].view(np.uint8), bitorder="little")))
        moved = np.flatnonzero(label != np.arange(len(label)))
        ends[0].append(lanes[word, moved])
        ends[1].append(lanes[word, label[moved]])
    join = lambda x: np.concatenate(x) if x else np.zeros(0, np.uint64)
    return join(ends[0]), join(ends[1])


def _compare(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        def out(a, b):
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            small: list[np.ndarray] = []
            for left, right in zip(batch.column(0), batch.column(1)):
                a = left.values.to_numpy().view(np.uint64)
                b = right.values.to_numpy().view(np.uint64) if right.is_valid else None
                if b is None and len(a) <= LANES:
                    small.append(a)
                    if len(small) == 1024:
                        yield out(*link_small(small, radius))
                        small = []
                else:
                    yield out(*link_block(a, b, radius))
            if small:
                yield out(*link_small(small, radius))

    return run


def fingerprint_links(classes: DataFrame, count: int, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """(a, b) longs: links that connect exactly the fingerprints reachable within ``radius``; ``classes`` has fp once."""
    keys = [F.struct(F.lit(i).alias("tab"), _band_key(bands).alias("key")) for i, bands in enumerate(band_tables(count, radius))]
    banded = classes.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.tab", "k.key")
    sizes = banded.groupBy("tab", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    parts = F.ceil(F.col("n") / block).cast("int")
    spread = banded.join(sizes, ["tab", "key"]).select(
        "tab", "key", "fp", parts.alias("parts"), F.pmod(F.xxhash64("fp"), parts).cast("int").alias("part"))
    # dealt anew by block: a bucket of any size is many rows here, of at most about BLOCK fingerprints each
    blocks = spread.repartition("tab", "key", "part").groupBy("tab", "key", "part").agg(
        F.first("parts").alias("parts"), F.collect_list("fp").alias("fps"))
    blocks = materialize(blocks, "simhash-blocks")
    many = blocks.filter("parts > 1")
    pairs = many.alias("l").join(many.alias("r"), (F.col("l.tab") == F.col("r.tab")) & (F.col("l.key") == F.col("r.key"))
                                 & (F.col("l.part") < F.col("r.part"))).select(F.col("l.fps").alias("l"), F.col("r.fps").alias("r"))
    pairs = pairs.repartition(F.xxhash64("l", "r"))
    own = blocks.select(F.col("fps").alias("l"), F.lit(None).cast("array<long>").alias("r"))
    run = lean(_compare(radius))
    return own.mapInArrow(run, "a long, b long").unionAll(pairs.mapInArrow(run, "a long, b long"))


def fingerprint_groups(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(_fp, root): every distinct fingerprint of column fp and the smallest fingerprint that links reach from it."""
    classes = materialize(fps.select("fp").distinct(), "simhash-classes")
    found = components(fingerprint_links(classes, classes.count(), radius), "a", "b")
    return classes.join(found, classes["fp"] == found["node"], "left").select(
        F.col("fp").alias("_fp"), F.coalesce("component", "fp").alias("root"))


def near_duplicates(docs: DataFrame, key: str, text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row per row of ``docs``: its key, fp and component_id (the smallest key reachable)."""
    rows = materialize(fingerprints(docs, [key], text, shingle), "simhash-rows")
    least = rows.groupBy("fp").agg(F.min(key).alias("least"))
    groups = materialize(fingerprint_groups(rows, radius).join(least, F.col("_fp") == F.col("fp")).select("_fp", "root", "least"), "simhash-groups")
    ids = groups.join(groups.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("_fp", "component_id")
    return rows.join(ids, rows["fp"] == ids["_fp"]).select(key, "fp", "component_id")


def keep_one(docs: DataFrame, key: str, text: str, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` that have the smallest key of their component; one of them where rows repeat it.

    Of a component without any key, one row stays. ``docs`` must not have columns named fp or _row.
    """
    rows = materialize(fingerprints(docs, docs.columns, text, shingle).withColumn("_row", F.monotonically_increasing_id()), "simhash-documents")
    groups = materialize(fingerprint_groups(rows, radius), "simhash-groups")
    placed = rows.select(F.col(key).isNull().alias("none"), F.col(key).alias("key"), "_row", "fp").join(
        groups, F.col("fp") == F.col("_fp")).select("root", F.struct("none", "key", "_row").alias("place"))
    first = placed.groupBy("root").agg(F.min("place").alias("first"))
    # the rows that go; written, so that Spark broadcasts them only if they are small
    gone = materialize(placed.join(first, "root").filter("place <> first").select(F.col("place._row").alias("_row")), "simhash-gone")
    return rows.join(gone, "_row", "left_anti").select(*docs.columns)


def q_op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document: 4-word shingles, 4 differing bits at most."""
    found = near_duplicates(table(spark, sf_dir, "documents"), "doc_id")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

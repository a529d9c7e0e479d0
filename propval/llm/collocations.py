"""Operator 13: phrase collocation mining over depth-truncated suffix subtrees, partitioned by their prefixes (ERA).

Every word position starts a suffix of its piece, cut after ``LONGEST`` words: a leaf. Tasks count the leaves of
their texts in blocks and write a block's leaves as one row per prefix (lang, first word), the rest of each leaf and
its count packed into one text. Vertical partitioning then deals the prefixes into groups whose leaves fit a budget:
prefixes are hashed to cells, small cells share a group, and a cell beyond the budget is unpacked and split by its
prefixes extended by a second word, and where even that is too much by whole leaves.
Each group builds its subtree by itself: leaves in order, so that a node is a run of leaves and its count the
total of the run. Nodes above a split are partial and add up over the groups.

Scores come from joins among the frequent nodes. All counts are exact; products are exact decimals.

Defined results: a null text has no words; a null lang is ``und``; repeated rows count each time; pieces, words and
languages of any length pass whole; ties are ordered as the contract says; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.column import Column
from pyspark.sql.window import Window

from propval.llm.common import materialize, table
from propval.operators.stats import broadcast_if_small

LONGEST = 3  # words of a phrase, and the depth of the tree
LEAST = 10  # occurrences of a candidate
TOP = 2000  # phrases reported for each language
SUBSUMED = 50  # hundredths of a phrase's occurrences that lie in a longer candidate and make it redundant
BLOCK_WORDS = 1_000_000  # words counted at once in a task
BUDGET = 400_000  # leaves of a group, at most
GROUPS = 512  # groups of equal size that all leaves would make, at least: what is larger is hot and split
ROWS = 50_000  # rows that a task hands over at once
CELLS = 4096  # cells of prefixes
SPREAD = 64  # parts of a language in the first round of the ranking

# Pieces end at [.,;:!?\x0A-\x0D], words at [\x20\x09]; A-Z are lower-cased.
PIECE_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
_LOWER = bytes(range(256)).lower()
FOLD = bytes(ord(".") if b in PIECE_ENDS else b for b in _LOWER)
UNKNOWN = "und"
WORDS = [f"w{i}" for i in range(1, LONGEST + 1)]
PACKED = "lang string, w1 string, occurrences long, leaves long, tails string"  # tails: lines of second word, third word (. for none), count
NODE = "lang string, w1 string, w2 string, w3 string, f long, whole boolean"


class _Numbers(dict):
    """Numbers of words in order of appearance, from 1; a piece's end is 0."""

    def __init__(self):
        super().__init__({b".": 0})

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def _tokens(data: bytes) -> list[bytes]:
    """Words in lower case, ``.`` at the end of each piece."""
    return (data.translate(FOLD).replace(b".", b" . ") + b" .").split()


def _heads(*keys: np.ndarray) -> np.ndarray:
    """First rows of the runs of equal keys."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    fresh = np.ones(len(keys[0]), bool)
    fresh[1:] = False
    for k in keys:
        fresh[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(fresh)


def _sorted(columns: list[np.ndarray]) -> np.ndarray:
    """The order of rows by several columns of small numbers."""
    bits = [int(c.max(initial=0)).bit_length() for c in columns]
    if sum(bits) > 62:
        return np.lexsort(columns[::-1])
    key = np.zeros(len(columns[0]), np.int64)
    for c, b in zip(columns, bits):
        key = (key << b) | c
    return np.argsort(key, kind="stable")


def _block_leaves(numbers: _Numbers, lang: str, seq: np.ndarray) -> pa.RecordBatch:
    """Distinct leaves of one block of texts in one language, with their counts, packed by first word."""
    padded = np.concatenate([seq, [0, 0]])
    at = np.flatnonzero(seq)
    x, y = padded[at], padded[at + 1]
    z = np.where(y > 0, padded[at + 2], 0)
    order = _sorted([x, y, z])
    x, y, z = x[order], y[order], z[order]
    head = _heads(x, y, z)
    n = np.diff(np.append(head, len(x)))
    names = pa.array(list(numbers), pa.binary()).cast(pa.large_string())
    x, y, z = x[head], y[head], z[head]
    tails = pc.binary_join_element_wise(names.take(pa.array(y)), names.take(pa.array(z)), pa.array(n).cast(pa.large_string()), pa.scalar(" ", pa.large_string()))
    first = _heads(x)
    packed = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(np.append(first, len(x)), pa.int64()), tails), pa.scalar("\n", pa.large_string()))
    return pa.RecordBatch.from_arrays(
        [pa.array([lang] * len(first), pa.string()), names.take(pa.array(x[first])).cast(pa.string()), pa.array(np.add.reduceat(n, first)),
         pa.array(np.diff(np.append(first, len(x)))), packed.cast(pa.string())], names=["lang", "w1", "occurrences", "leaves", "tails"])


def leaves(docs: DataFrame, lang: str, text: str) -> DataFrame:
    """(lang, w1, occurrences, leaves, tails): suffixes cut after three words, counted block by block (a prefix has a row a block)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, held, size = _Numbers(), {}, 0

        def flush():
            for k, parts in held.items():
                whole = _block_leaves(numbers, k, np.concatenate(parts))
                for a in range(0, whole.num_rows, ROWS):
                    yield whole.slice(a, ROWS)

        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = _tokens(data.as_py())
                held.setdefault(name, []).append(np.fromiter(map(numbers.__getitem__, found), np.int64, len(found)))
                size += len(found)
                if size >= BLOCK_WORDS:
                    yield from flush()
                    numbers, held, size = _Numbers(), {}, 0
        yield from flush()

    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text).cast("binary").alias("data"))
    return rows.filter("length(data) > 0").mapInArrow(run, PACKED)


def _cell(*columns: str, of: int | Column) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(of) if isinstance(of, int) else of)


def grouped(found: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(level, g1, g2, g3, lang, w1, tails): groups of whole prefixes of one word (level 1), of two (2) or of leaves (3)."""
    spark = found.sparkSession
    found = found.withColumn("cell", _cell("lang", "w1", of=CELLS))
    cells = {r["cell"]: r["n"] for r in found.groupBy("cell").agg(F.sum("leaves").alias("n")).collect()}  # at most CELLS
    total = sum(cells.values())
    budget = max(1, min(budget, total // GROUPS))
    plan, group, held = [], 0, 0
    for cell, n in sorted(cells.items()):
        if n > budget:
            plan.append((cell, None, -(-2 * n // budget)))
            continue
        if held + n > budget:
            group, held = group + 1, 0
        held += n
        plan.append((cell, group, 1))
    dealt = found.join(F.broadcast(spark.createDataFrame(plan, "cell long, g long, parts long")), "cell")
    zero = F.lit(0).cast("long")
    whole = dealt.filter("g is not null").select(F.lit(1).alias("level"), F.col("g").alias("g1"), zero.alias("g2"), zero.alias("g3"), "lang", "w1", "tails")
    single = dealt.filter("g is null").select("cell", "parts", "lang", "w1", F.explode(F.split("tails", "\n")).alias("tails"))
    single = single.withColumn("second", F.substring_index("tails", " ", 1))
    single = single.withColumn("g2", _cell("lang", "w1", "second", of=F.col("parts")))
    split = single.groupBy("cell", "g2").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > budget)
    split = materialize(split.select("cell", "g2", F.ceil(2 * F.col("n") / F.lit(budget)).alias("pieces")), "splits")
    single = single.join(broadcast_if_small(split), ["cell", "g2"], "left")  # at most one split for each budget of leaves
    leaf = _cell("lang", "w1", "tails", of=F.col("pieces"))
    single = single.select(F.when(F.col("pieces").isNotNull(), 3).otherwise(2).alias("level"), F.col("cell").alias("g1"), "g2",
                           F.coalesce(leaf, zero).alias("g3"), "lang", "w1", "tails")
    return whole.unionByName(single)


def subtree(packed: pa.Table, level: int, least: int) -> pa.Table:
    """The nodes of the suffix tree over a group's leaves, with the totals of the leaves below them.

    Nodes of ``level`` words and more are whole and kept from ``least`` on; those above may go on in other groups.
    """
    lines = pc.split_pattern(packed.column("tails").combine_chunks().cast(pa.large_string()), "\n")
    row = np.repeat(np.arange(len(packed)), np.diff(lines.offsets.to_numpy()))
    fields = pc.split_pattern(lines.flatten(), " ").flatten()  # second word, third word, count of each leaf
    size = len(row)
    step = np.arange(size) * 3
    first = packed.column("w1").combine_chunks().cast(pa.large_string())
    coded = pa.concat_arrays([pa.array(["."], pa.large_string()), first, fields.take(pa.array(step)), fields.take(pa.array(step + 1))]).dictionary_encode()
    code = coded.indices.to_numpy().astype(np.int64)  # 0: no word
    n = fields.take(pa.array(step + 2)).cast(pa.int64()).to_numpy()
    first, rest = code[1:len(packed) + 1], code[len(packed) + 1:].reshape(LONGEST - 1, size)
    lang = packed.column("lang").combine_chunks().dictionary_encode()
    columns = [lang.indices.to_numpy().astype(np.int64)[row], first[row], *rest]
    order = _sorted(columns)
    columns = [c[order] for c in columns]
    head = _heads(*columns)
    total = np.add.reduceat(n[order], head)
    columns = [c[head] for c in columns]  # from here on one row a leaf
    out = []
    for depth in range(1, LONGEST + 1):
        node = _heads(*columns[:depth + 1])
        f = np.add.reduceat(total, node)
        whole = depth >= level
        kept = (columns[depth][node] > 0) & ((f >= least) | (not whole))
        node, f = node[kept], f[kept]
        names = [coded.dictionary.take(pa.array(columns[d][node])).cast(pa.string()) if d <= depth else pa.nulls(len(node), pa.string())
                 for d in range(1, LONGEST + 1)]
        out.append(pa.table([lang.dictionary.take(pa.array(columns[0][node])), *names, pa.array(f), pa.array([whole] * len(node), pa.bool_())],
                            names=["lang", *WORDS, "f", "whole"]))
    return pa.concat_tables(out)


def frequent_nodes(found: DataFrame, least: int = LEAST, budget: int = BUDGET) -> DataFrame:
    """(lang, w1, w2, w3, f): every phrase of one to three words with at least ``least`` occurrences."""
    def build(key: tuple, packed: pa.Table) -> pa.Table:
        return subtree(packed, key[0].as_py(), least)

    nodes = materialize(grouped(found, budget).groupBy("level", "g1", "g2", "g3").applyInArrow(build, NODE), "nodes")
    partial = nodes.filter("not whole").groupBy("lang", *WORDS).agg(F.sum("f").alias("f")).filter(F.col("f") >= least)
    return nodes.filter("whole").select("lang", *WORDS, "f").unionByName(partial.select("lang", *WORDS, "f"))


def scored(nodes: DataFrame) -> DataFrame:
    """Phrases of two and three words with a, l, r and score, and ``cover``: the most frequent longer phrase around them."""
    one = nodes.filter("w2 is null").select("lang", F.col("w1").alias("x"), F.col("f").alias("fx"))
    two = nodes.filter("w2 is not null and w3 is null").select("lang", F.col("w1").alias("x"), F.col("w2").alias("y"), F.col("f").alias("fxy"))
    three = nodes.filter("w3 is not null").select("lang", *WORDS, F.col("f").alias("a"))

    def looked_up(rows: DataFrame, table_: DataFrame, names: list[str], value: str, out: str) -> DataFrame:
        keys = dict(zip(table_.columns[1:-1], names))
        return rows.join(table_.select("lang", *[F.col(k).alias(v) for k, v in keys.items()], F.col(value).alias(out)), ["lang", *names])

    def ratio(left: str, right: str) -> Column:
        x, y, z = (f"cast({c} as decimal(38, 0))" for c in ("a", left, right))
        return F.expr(f"cast(1000000 * {x} * {x} as decimal(38, 0)) div ({y} * {z})")

    pairs = two.select("lang", F.col("x").alias("w1"), F.col("y").alias("w2"), F.col("fxy").alias("a"))
    around = three.select("lang", "w1", "w2", "a").unionAll(three.select("lang", F.col("w2").alias("w1"), F.col("w3").alias("w2"), "a"))
    around = around.groupBy("lang", "w1", "w2").agg(F.max("a").alias("cover"))
    pairs = looked_up(looked_up(pairs, one, ["w1"], "fx", "l"), one, ["w2"], "fx", "r").join(around, ["lang", "w1", "w2"], "left")
    pairs = pairs.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", "l", "r", ratio("l", "r").alias("score"), "cover")
    triples = looked_up(looked_up(three, one, ["w1"], "fx", "l1"), two, ["w2", "w3"], "fxy", "r1")
    triples = looked_up(looked_up(triples, two, ["w1", "w2"], "fxy", "l2"), one, ["w3"], "fx", "r2")
    triples = triples.withColumns({"s1": ratio("l1", "r1"), "s2": ratio("l2", "r2")})
    early = F.col("s1") <= F.col("s2")
    triples = triples.select("lang", F.concat_ws(" ", *WORDS).alias("phrase"), "a", F.when(early, F.col("l1")).otherwise(F.col("l2")).alias("l"),
                             F.when(early, F.col("r1")).otherwise(F.col("r2")).alias("r"), F.least("s1", "s2").alias("score"),
                             F.lit(None).cast("long").alias("cover"))
    return pairs.unionByName(triples)


def collocations(docs: DataFrame, lang: str, text: str, top: int = TOP, least: int = LEAST, subsumed: int = SUBSUMED, budget: int = BUDGET) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the ``top`` phrases of each language."""
    found = materialize(leaves(docs, lang, text), "leaves")
    total = found.groupBy("lang").agg(F.sum("occurrences").alias("n"))
    kept = scored(materialize(frequent_nodes(found, least, budget), "frequent")).filter(f"cover is null or 100 * cover < {subsumed} * a").drop("cover")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # a language's rows are first cut to the best of each of SPREAD parts, so that no task ranks a whole language
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SPREAD))).orderBy(*order)
    best = kept.withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return best.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def q_op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 strongest phrases of two and three words of each language, over all whole documents."""
    return collocations(table(spark, sf_dir, "documents"), "lang", "text")

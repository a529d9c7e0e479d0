"""Operator 12: target-distribution importance resampling over hashed word n-grams, drawn by Gumbel top-k.

A feature is a run of 1 to ``LONGEST`` words; its bucket is the CRC-32 of its bytes modulo ``BUCKETS``. The CRC is
linear up to a constant: byte b that has d bytes of its span after it adds a fixed word, whatever the other bytes
are. A table of these words by distance and byte is built once. The bytes of all spans of a slice then pick theirs at
once, ``bitwise_xor.reduceat`` folds them span by span, and a constant of the span's length finishes. Spans longer
than the table fold blockwise: the register after a block enters the next one as its first four bytes.

Two passes hash the texts: the first counts buckets per task (a task ships at most ``BUCKETS`` rows), the second
sums each document's gains. Documents are never shuffled with their texts. The draw sorts narrow rows by range.

Defined results: a null or empty text has no feature, weight 0 and no rank; a null doc_id hashes as ``42:``;
repeated rows are drawn one by one, ties to the smaller doc_id, null last; an empty table gives no rows, and an empty
target has every gain from its smoothed counts; very long texts are hashed in parts that share their border words.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from propval.llm.common import materialize, numbered, ranked, slices, table
from propval.llm.words import words

BUCKETS = 10_000
LONGEST = 3  # words of a feature
SEED = 42
SHARE = 5  # hundredths of the documents that may be drawn
LEAST_WORDS = 20  # of a document that may be drawn
REACH = 96  # distances of the position table
SLICE_WORDS = 40_000  # words hashed at once

_MASK = np.uint32(0xFF)


def position_table(reach: int) -> np.ndarray:
    """[d, b]: what byte b adds to the CRC-32 of a span in which d bytes follow it."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):  # the reflected polynomial, bit by bit
        step = np.where(step & 1, np.uint32(0xEDB88320) ^ (step >> np.uint32(1)), step >> np.uint32(1))
    out = np.empty((reach, 256), np.uint32)
    out[0] = step
    for d in range(1, reach):
        out[d] = step[out[d - 1] & _MASK] ^ (out[d - 1] >> np.uint32(8))
    return out


class SpanCrc:
    """CRC-32 of many spans of one byte array."""

    def __init__(self, reach: int = REACH):
        self.reach = reach
        self.table = position_table(reach)
        self.flat = self.table.ravel()
        self.constant = np.array([zlib.crc32(bytes(n)) for n in range(reach + 1)], np.uint32)
        self.steps = np.arange(1 << 16, dtype=np.int32)

    def _fold(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """XOR of the contributions of each span; no span is empty or longer than the table."""
        first = np.cumsum(size) - size
        total = int(first[-1] + size[-1])
        if total > len(self.steps):
            self.steps = np.arange(2 * total, dtype=np.int32)
        steps = self.steps[:total]
        at = np.repeat((start - first).astype(np.int32), size)
        at += steps
        index = np.repeat((first + size - 1).astype(np.int32), size)  # the last step of the span
        index -= steps
        index <<= 8
        index |= data[at]
        return np.bitwise_xor.reduceat(self.flat[index], first)

    def __call__(self, data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        size = stop - start
        out = np.empty(len(start), np.uint32)
        long = size > self.reach
        if long.any():
            out[long] = self._long(data, start[long], size[long])
            short = np.flatnonzero(~long)
            if len(short):
                out[short] = self._fold(data, start[short], size[short]) ^ self.constant[size[short]]
        elif len(start):
            out = self._fold(data, start, size) ^ self.constant[size]
        return out

    def _long(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        order = np.argsort(size, kind="stable")
        start, size = start[order], size[order]
        head = (size - 1) % self.reach + 1  # what comes before the whole blocks
        register = self._fold(data, start, head)
        at, left = start + head, (size - head) // self.reach
        done = 0
        while done < len(size):  # spans in order of their blocks: those that are through lie in front
            done = int(np.searchsorted(left, 0, "right"))
            if done == len(size):
                break
            live = slice(done, None)
            r = register[live]
            carried = np.bitwise_xor.reduce([self.table[self.reach - 1 - k, (r >> np.uint32(8 * k)) & _MASK] for k in range(4)])
            register[live] = carried ^ self._fold(data, at[live], np.full(len(size) - done, self.reach))
            at[live] += self.reach
            left[live] -= 1
        zeros = {n: zlib.crc32(bytes(n)) for n in np.unique(size).tolist()}
        out = np.empty(len(size), np.uint32)
        out[order] = register ^ np.array([zeros[n] for n in size.tolist()], np.uint32)
        return out


def _parts(texts: list[bytes | None], longest: int) -> Iterator[tuple[int, list[bytes], int]]:
    """(row, words, new words) of each text in parts; a part starts with the last words of the one before."""
    for i, t in enumerate(texts):
        found = words(t)
        for a in range(0, len(found), SLICE_WORDS):
            before = min(a, longest - 1)
            part = found[a - before:a + SLICE_WORDS]
            yield i, part, len(part) - before


def features(texts: list[bytes | None], crc: SpanCrc, buckets: int, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, bucket) of every feature of the texts, slice by slice.

    A feature belongs to the part that its last word is new in.
    """
    parts = list(_parts(texts, longest))
    for a, b in slices([len(p[1]) for p in parts], SLICE_WORDS):
        mine = parts[a:b]
        data = np.frombuffer(b"\n".join(b" ".join(p[1]) for p in mine) + b"\n", np.uint8)
        stop = np.flatnonzero((data == 0x20) | (data == 0x0A))  # words hold neither
        start = np.concatenate([[0], stop[:-1] + 1])
        n = np.array([len(p[1]) for p in mine])
        part = np.repeat(np.arange(len(mine)), n)
        nth = np.arange(len(part)) - np.repeat(np.cumsum(n) - n, n)
        old = np.repeat(n - [p[2] for p in mine], n)
        row = np.array([p[0] for p in mine])[part]
        for k in range(1, longest + 1):
            last = np.flatnonzero((nth >= k - 1) & (nth >= old))
            if len(last):
                yield row[last], (crc(data, start[last - k + 1], stop[last]) % np.uint32(buckets)).astype(np.int64)


def bucket_counts(docs: DataFrame, text: str, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """(bucket, n): features of all texts in each bucket that has any."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crc, counts = SpanCrc(), np.zeros(buckets, np.int64)
        for batch in batches:
            for _, bucket in features(batch.column(0).to_pylist(), crc, buckets, longest):
                counts += np.bincount(bucket, minlength=buckets)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(counts[used])], names=["bucket", "n"])

    found = docs.select(F.col(text).cast("binary").alias("_data")).mapInArrow(run, "bucket int, n long")
    return found.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, text: str, target: DataFrame, target_text: str, buckets: int = BUCKETS, longest: int = LONGEST) -> list[int]:
    """Log ratio in thousandths, rounded down, of each bucket's smoothed share of the target to that of the documents."""
    def counted(df: DataFrame, column: str) -> list[int]:
        out = [0] * buckets
        for r in bucket_counts(df, column, buckets, longest).collect():  # at most one row a bucket
            out[r["bucket"]] = r["n"]
        return out

    s, t = counted(docs, text), counted(target, target_text)
    total_s, total_t = sum(s), sum(t)
    return [math.floor(1000 * math.log(float((t[i] + 1) * (total_s + buckets)) / float((s[i] + 1) * (total_t + buckets)))) for i in range(buckets)]


def weigh(docs: DataFrame, keep: list[str], text: str, gain: list[int], longest: int = LONGEST) -> DataFrame:
    """Columns ``keep`` of every row with n_words, n_features and weight, the sum of its features' gains."""
    sent = docs.sparkSession.sparkContext.broadcast(np.array(gain, np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crc, gain = SpanCrc(), sent.value
        for batch in batches:
            texts = batch.column(len(keep)).to_pylist()
            n, weight = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            n_words = np.array([len(words(t)) for t in texts], np.int64)
            for row, bucket in features(texts, crc, len(gain), longest):
                low = int(row[0])  # rows of a slice are consecutive; sums are whole numbers far below 2^53
                size = int(row[-1]) - low + 1
                n[low:low + size] += np.bincount(row - low, minlength=size)
                weight[low:low + size] += np.bincount(row - low, gain[bucket], size).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n_words), pa.array(n), pa.array(weight)],
                                             names=[*keep, "n_words", "n_features", "weight"])

    schema = docs.select(*keep).schema.add("n_words", "long").add("n_features", "long").add("weight", "long")
    return docs.select(*keep, F.col(text).cast("binary").alias("_data")).mapInArrow(run, schema)


def noise(key: Column, seed: int) -> Column:
    """Gumbel noise of a row in thousandths, rounded down, from the SHA-256 of seed and key."""
    told = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(F.encode(told, "UTF-8"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def resample(docs: DataFrame, keep: list[str], key: str, text: str, target: DataFrame, target_text: str, share: int = SHARE,
             least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """Columns ``keep`` of every row with n_words, n_features, weight, score and rank (null: not drawn).

    Of the N rows of ``least_words`` words and more, the floor(share * N / 100) highest scores are drawn.
    """
    gain = gains(docs, text, target, target_text, buckets, longest)
    rows, name = numbered(docs.select(*dict.fromkeys([*keep, key, text])))
    columns = list(dict.fromkeys([*(name[c] for c in keep), name[key]]))
    weighed = weigh(rows, columns, name[text], gain, longest)
    weighed = materialize(weighed.withColumn("score", F.col("weight") + noise(F.col(name[key]), seed))
                          .withColumn("_row", F.monotonically_increasing_id()), "weighed")
    candidates = weighed.filter(F.col("n_words") >= least_words)
    drawn = share * candidates.count() // 100
    order = [F.col("score").desc(), F.col(name[key]).asc_nulls_last(), F.col("_row")]
    out = ranked(candidates, *order).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = weighed.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    numbers = ["n_words", "n_features", "weight", "score", "rank"]
    return out.unionByName(rest).select(*(F.col(name[c]).alias(c) for c in keep), *numbers)


def draw(docs: DataFrame, key: str, text: str, target: DataFrame, target_text: str, **options) -> DataFrame:
    """The drawn documents with all their columns."""
    rows, name = numbered(docs)
    found = resample(rows, rows.columns, name[key], name[text], target, target_text, **options)
    return found.filter("rank is not null").select(*rows.columns).toDF(*docs.columns)


def q_op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance weight, noisy score and rank of every whole document, towards the benchmark texts."""
    docs, target = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return resample(docs, ["doc_id"], "doc_id", "text", target, "text").select("doc_id", "n_features", "weight", "score", "rank")

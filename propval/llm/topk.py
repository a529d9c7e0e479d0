"""Operator 3: exact top-k inner products of norm-sorted vectors with SVD-rotated partial sums.

Vectors are sorted by descending length and packed into blocks; queries are packed likewise. The block of the
longest vectors is searched first and gives every query a floor, its k-th best score so far. A later block is
dropped for a query block when no length product reaches a floor; inside a block the first LEAD rotated components
are multiplied, and the Cauchy-Schwarz bound of the rest rules out vectors before their exact products are taken.
The rotation (right singular vectors of a bounded sample) changes no inner product, only how early the bound bites.

Defined results: vectors that are null or hold null or non-finite components, and rows without vec_id, take no part;
vectors of different length are compared as if padded with zeros; a query never meets rows of its own vec_id; equal
query rows give one list; queries with fewer candidates than k list all; no rows give no rows. Scores must fit a long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from propval.llm.common import materialize, table
from propval.llm.multi_index import _stack

K = 10
SCALE = 1024
SAMPLE = 20_000  # vectors the rotation is fitted on, at most
BLOCK = 2048  # vectors of a block
QUERIES = 1024  # queries of a block
GROUP_BYTES = 32 << 20  # of the query blocks that one pass over the vectors serves, about (one block at least)
LEAD = 16  # rotated components of the partial sum
DENSE = 0.05  # share of survivors above which a whole block is multiplied


def integer_vectors(rows: DataFrame, key: str, vector: str, scale: int = SCALE) -> DataFrame:
    """vec_id, vec (array<double> of whole numbers) and length2 of the rows that take part."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    fine = F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & F.forall(
        "vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.select(F.col(key).cast("long").alias("vec_id"), v.alias("vec")).filter(fine)
    rows = rows.withColumn("vec", F.transform("vec", lambda x: F.floor(x * scale).cast("double")))
    return rows.withColumn("length2", F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))


def rotation(vectors: DataFrame, count: int, width: int, sample: int = SAMPLE) -> np.ndarray:
    """Right singular vectors (columns, strongest first) of at most ``sample`` vectors drawn by a hash."""
    share = min(1.0, sample / max(count, 1))
    drawn = vectors.filter(F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("vec").limit(sample)
    points = _stack(drawn.toArrow().column(0).combine_chunks(), width)
    return np.linalg.svd(points.T @ points)[0] if len(points) else np.eye(width)


def _pack(width: int, limit: int):
    """Consecutive rows of a partition as blocks: number, longest length, ids, tags, and vectors as bytes."""
    names = ["block", "longest", "ids", "tags", "vecs"]

    def block(pieces: list[pa.RecordBatch], number: int) -> pa.RecordBatch:
        t = pa.Table.from_batches(pieces).combine_chunks()
        vecs = _stack(t.column("vec").chunk(0), width)
        lists = [pa.array([t.column(c).to_numpy()], pa.list_(pa.int64())) for c in ("vec_id", "tag")]
        longest = float(np.sqrt((vecs ** 2).sum(1).max()))
        return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([longest]), *lists, pa.array([vecs.tobytes()], pa.binary())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, rows, held = TaskContext.get().partitionId() << 33, 0, []
        for batch in batches:
            while batch.num_rows:
                piece = batch.slice(0, limit - rows)
                batch = batch.slice(piece.num_rows)
                held.append(piece)
                rows += piece.num_rows
                if rows == limit:
                    yield block(held, number)
                    number, rows, held = number + 1, 0, []
        if rows:
            yield block(held, number)

    return run, "block long, longest double, ids array<long>, tags array<long>, vecs binary"


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best scores, ties to the smaller id."""
    if len(scores) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= edge)
    else:
        keep = np.arange(len(scores))
    return keep[np.lexsort((ids[keep], -scores[keep]))][:k]


def _exact(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Whole-number inner products: in doubles while these are exact, else in Python's integers."""
    if len(q) and len(v) and q.shape[1] * float(np.abs(q).max()) * float(np.abs(v).max()) < 2.0 ** 53:
        return (q @ v.T).astype(np.int64)
    exact = np.array([[int(x) for x in row] for row in q], object).reshape(q.shape) @ np.array([[int(x) for x in row] for row in v], object).reshape(v.shape).T
    return exact.astype(np.int64)


def search_block(queries: np.ndarray, qids: np.ndarray, floors: np.ndarray, vectors: np.ndarray, ids: np.ndarray,
                 turn: np.ndarray, k: int = K, lead: int = LEAD) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, positions, scores) of the best of this block for each query, none of them below its floor."""
    rq, rv = queries @ turn, vectors @ turn
    tail = lambda x: np.sqrt((x[:, lead:] ** 2).sum(1))
    length = lambda x: np.sqrt((x ** 2).sum(1))
    tq, tv, lq, lv = tail(rq), tail(rv), length(rq), length(rv)
    bounded = np.isfinite(floors)
    for i in np.flatnonzero(~bounded):
        yield from _pick(i, np.arange(len(ids)), _exact(queries[i:i + 1], vectors)[0], qids, floors, ids, k)
    at = np.flatnonzero(bounded)
    if not len(at):
        return
    bound = rq[at, :lead] @ rv[:, :lead].T + tq[at, None] * tv[None]
    slack = 1e-9 * lq[at, None] * lv[None] + 1e-6  # rounding of the rotated sums
    alive = bound + slack >= floors[at, None]
    if alive.mean() > DENSE:
        scores = _exact(queries[at], vectors)
        for n, i in enumerate(at):
            js = np.flatnonzero(alive[n])
            yield from _pick(i, js, scores[n, js], qids, floors, ids, k)
    else:
        for n, i in enumerate(at):
            js = np.flatnonzero(alive[n])
            if len(js):
                yield from _pick(i, js, _exact(queries[i:i + 1], vectors[js])[0], qids, floors, ids, k)


def _pick(i, js, scores, qids, floors, ids, k):
    ok = (ids[js] != qids[i]) & (scores >= floors[i])
    js, scores = js[ok], scores[ok]
    best = _best(scores, ids[js], k)
    if len(best):
        yield int(i), js[best], scores[best]


def _search(turn: np.ndarray, k: int):
    width = len(turn)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, qids, tags = [batch.column(c)[row].values.to_numpy() for c in (0, 2, 3)]
                vecs, qvecs = [np.frombuffer(batch.column(c)[row].as_py()).reshape(-1, width) for c in (1, 4)]
                floors = batch.column(5)[row].as_py()
                floors = np.full(len(qids), -np.inf) if floors is None else np.array([-np.inf if f is None else f for f in floors])
                out: list[list] = [[], [], [], []]
                for i, js, scores in search_block(qvecs, qids, floors, vecs, ids, turn, k):
                    for held, part in zip(out, (np.full(len(js), qids[i]), np.full(len(js), tags[i]), ids[js], scores)):
                        held.append(part)
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["query_id", "tag", "vec_id", "score"])

    return run, "query_id long, tag long, vec_id long, score long"


def top_k(rows: DataFrame, key: str, vector: str, is_query: Column, k: int = K, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` largest inner products of every query with all rows.

    ``is_query`` is a condition on ``vec_id``. Blocks of queries meet blocks of vectors; the number of meetings is
    what the stated query set asks for, less those that the bounds rule out.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    vectors = materialize(integer_vectors(rows, key, vector, scale), "topk-vectors")
    count, width = vectors.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    width = width or 1
    turn = rotation(vectors, count, width)
    # descending length; the id's hash spreads vectors of one length over partitions
    sorted_ = vectors.select("vec_id", F.xxhash64("vec_id").alias("tag"), "vec", "length2").repartitionByRange(
        max(1, min(parts, -(-count // BLOCK))), F.desc("length2"), "tag").sortWithinPartitions(F.desc("length2"), "tag")
    run, schema = _pack(width, BLOCK)
    blocks = materialize(sorted_.select("vec_id", "tag", "vec").mapInArrow(run, schema).drop("tags"), "topk-blocks")
    asked = vectors.filter(is_query).select("vec_id", F.xxhash64("vec").alias("tag"), "vec").distinct()
    run, schema = _pack(width, QUERIES)
    asked = materialize(asked.repartition(max(1, -(-count // (100 * QUERIES)))).mapInArrow(run, schema).select(
        F.col("block").alias("qblock"), F.col("longest").alias("qlongest"), F.col("ids").alias("qids"), F.col("tags").alias("qtags"),
        F.col("vecs").alias("qvecs")), "topk-queries")
    run, schema = _search(turn, k)
    wide = ["ids", "vecs", "qids", "qtags", "qvecs", "floors"]
    head = blocks.orderBy(F.desc("longest"), "block").limit(1).select("block").collect()
    head = F.col("block") == F.lit(head[0]["block"] if head else -1)
    opening = materialize(asked.withColumn("one", F.lit(1)).join(F.broadcast(  # one block of BLOCK vectors
        blocks.filter(head).withColumn("one", F.lit(1))), "one").withColumn("floors", F.lit(None).cast("array<double>"))
        .select(*wide).mapInArrow(run, schema), "topk-opening")
    floors = opening.groupBy("query_id", "tag").agg(F.count(F.lit(1)).alias("n"), F.min("score").cast("double").alias("floor")).filter(F.col("n") >= k)
    # the floors back beside their queries, each at its place in its block
    placed = asked.select("qblock", "qtags", F.posexplode("qids").alias("pos", "query_id")).select(
        "qblock", "pos", "query_id", F.get("qtags", "pos").alias("tag")).join(floors, ["query_id", "tag"], "left")
    per_block = placed.groupBy("qblock").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "floor"))), lambda x: x["floor"]).alias("floors"),
        F.min(F.coalesce("floor", F.lit(float("-inf")))).alias("least"))
    # a group of query blocks goes to every task, a pass over the other blocks for each: neither side is shuffled or copied.
    # A pair is dropped when no product of lengths reaches a floor
    ask = materialize(asked.join(per_block, "qblock"), "topk-floors")
    numbers = sorted(r["qblock"] for r in ask.select("qblock").collect())  # one number a block of queries
    size = max(1, GROUP_BYTES // (QUERIES * (8 * width + 24)))
    found = opening
    for i in range(0, len(numbers), size):
        pairs = blocks.filter(~head).join(F.broadcast(ask.filter(F.col("qblock").isin(numbers[i:i + size]))),
                                          F.col("longest") * F.col("qlongest") * (1 + 1e-9) + 1e-6 >= F.col("least"))
        # written one after the other, so that one group at a time is in memory
        found = found.unionAll(materialize(pairs.select(*wide).mapInArrow(run, schema), "topk-found"))
    w = Window.partitionBy("query_id", "tag").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(w))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def q_op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best of all vectors for every vec_id that 100 divides."""
    return top_k(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 100 == 0)

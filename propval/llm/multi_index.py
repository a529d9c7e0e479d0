"""Operator 5: embedding near-duplicates by an inverted multi-index.

Two codebooks, one for each half of the normalised vectors, form a product grid of cells. Every distinct vector
lives in the cell of its nearest codewords. A search walks the grid by the multi-sequence order of how far the
vector's halves are from the other codewords' borders, and stops at the distance beyond which a partner lies with
a probability under 1 - ``recall`` (a displacement of the link radius in a random direction moves a vector across
a border at distance m with the probability of a normal deviate above m * sqrt(dim) / radius). Every pair met is
verified by its cosine in double precision.

The codebooks are fitted on a bounded sample (SAMPLE vectors); every vector is indexed. Equal vectors of a label
are one class, never expanded into pairs. The members and visitors of a cell meet in blocks, and a pair of
blocks returns counts and a spanning forest of its links, never all pairs.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and rows without label
or vec_id, link with nothing (0 links, component its own vec_id, null if that is null); vectors of different length
never link; rows repeating a vec_id with another vector are one node of the components; no rows give no rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from propval.llm.common import materialize, table
from propval.llm.components import components

COSINE = 0.93
RECALL = 0.99  # share of links that the traversal aims to meet
SAMPLE = 20_000  # vectors the codebooks are fitted on, at most
CELL = 48  # vectors of the largest label that a cell holds if they spread evenly
CODEWORDS = (4, 512)  # least and most codewords of a half
ROUNDS = 12  # of k-means
BLOCK = 1024  # vectors of one side of a comparison
SLICE = 4096  # vectors encoded at once


def kmeans(points: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = points[rng.choice(len(points), min(k, len(points)), replace=False)]
    for _ in range(rounds):
        near = np.argmin((centres ** 2).sum(1) - 2 * points @ centres.T, axis=1)
        n = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return np.unique(centres, axis=0)


def border_gaps(half: np.ndarray, codebook: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest codeword of each point, and its squared distance to the border of every other codeword's region."""
    d = (half ** 2).sum(1)[:, None] - 2 * half @ codebook.T + (codebook ** 2).sum(1)
    home = np.argmin(d, axis=1)
    apart = 2 * np.linalg.norm(codebook[:, None] - codebook[None], axis=2)[home]
    gap = np.divide(d - d[np.arange(len(d)), home][:, None], apart, out=np.zeros_like(d), where=apart > 0)
    return home, np.maximum(gap, 0.0) ** 2


def multi_sequence(a: np.ndarray, b: np.ndarray, limit: float) -> list[tuple[int, int]]:
    """Cells (i, j) in the order of a[i] + b[j] while the sum is within ``limit``.

    Both sequences are sorted; a heap holds the frontier, and a cell opens its right neighbour and, from the first
    column, the cell below, so that every cell is reached once and none beyond the frontier is looked at.
    """
    ia, ib = np.argsort(a, kind="stable").tolist(), np.argsort(b, kind="stable").tolist()
    sa, sb = a[ia].tolist(), b[ib].tolist()
    frontier, cells = [(sa[0] + sb[0], 0, 0)], []
    while frontier and frontier[0][0] <= limit:
        _, x, y = heapq.heappop(frontier)
        cells.append((ia[x], ib[y]))
        if y + 1 < len(sb):
            heapq.heappush(frontier, (sa[x] + sb[y + 1], x, y + 1))
        if y == 0 and x + 1 < len(sa):
            heapq.heappush(frontier, (sa[x + 1] + sb[0], x + 1, 0))
    return cells


def _stack(vectors: pa.Array, width: int) -> np.ndarray:
    """Rows of float64, shorter vectors padded with zeros."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    n = np.diff(vectors.offsets.to_numpy())
    if (n == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(n), width))
    out[np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows at length 1; each is scaled by its largest component first, so that no square over- or underflows."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows ** 2).sum(axis=1, keepdims=True))


def pack(vectors: np.ndarray) -> list[bytes]:
    """Each row as bytes of single precision where that loses nothing, of double precision otherwise."""
    single = vectors.astype(np.float32)
    return [x.tobytes() for x in (single if np.array_equal(single, vectors) else vectors)]


def unpack(packed: list[bytes], width: int) -> np.ndarray:
    return np.array([np.frombuffer(x, np.float32 if len(x) == 4 * width else np.float64) for x in packed], np.float64).reshape(-1, width)


CELL_KEY = ["label", "dim", "cell"]
CELLS = "label long, dim int, cell int, home boolean, rep long, tag long, n long, vec binary, own int, visits array<int>"


def _index(width: int, first: np.ndarray, second: np.ndarray, limit: float):
    """A row for each cell that a class visits: cell, whether it is its home, and what the comparison needs."""
    cut, codes = first.shape[1], len(second)
    names = [f.split()[0] for f in CELLS.split(", ")]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.list_(pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                label, dim, rep, tag, n = [c.to_pylist() for c in batch.columns[:5]]
                raw = _stack(batch.column(5), width)
                packed, vecs = pack(raw), unit(raw)
                (h1, g1), (h2, g2) = border_gaps(vecs[:, :cut], first), border_gaps(vecs[:, cut:], second)
                rows = []
                for i in range(len(vecs)):
                    own = int(h1[i]) * codes + int(h2[i])
                    cells = {own} | {x * codes + y for x, y in multi_sequence(g1[i], g2[i], limit)}
                    for c in cells:
                        rows.append((label[i], dim[i], c, c == own, rep[i], tag[i], n[i], packed[i], own, sorted(cells) if c == own else None))
                    if len(rows) >= SLICE or i == len(vecs) - 1:
                        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names=names)
                        rows = []

    return run


def _verify(cosine: float, width: int):
    """For a block of a cell's members and one of its visitors: added links per class and a spanning forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for members, visitors in zip(batch.column(0), batch.column(1)):
                m, v = members.values, visitors.values
                col = lambda x, name: x.field(name).to_numpy(zero_copy_only=False)
                vec = lambda x: unit(unpack(x.field("vec").to_pylist(), width))
                (mr, mt, mn), (vr, vt, vn) = [[col(x, c) for c in ("rep", "tag", "n")] for x in (m, v)]
                hit = vec(v) @ vec(m).T >= cosine
                hit &= ~((vr[:, None] == mr[None]) & (vt[:, None] == mt[None]))
                i, j = np.nonzero(hit)
                if not len(i):
                    continue
                add_v = np.bincount(i, mn[j], len(vr)).astype(np.int64)
                # a member that does not visit its visitor's home would not count it otherwise
                own, visits = col(v, "own"), m.field("visits")
                start, flat = visits.offsets.to_numpy(), visits.values.to_numpy()
                known = np.array([own[a] in flat[start[b]:start[b + 1]] for a, b in zip(i, j)])
                add_m = np.bincount(j[~known], vn[i[~known]], len(mr)).astype(np.int64)
                nodes = np.concatenate([vr, mr])
                label = np.arange(len(nodes))
                for a in np.unique(i):
                    js = j[np.searchsorted(i, a):np.searchsorted(i, a, "right")] + len(vr)
                    roots = np.unique(np.append(label[js], label[a]))
                    if len(roots) > 1:
                        label[np.isin(label, roots)] = roots[0]
                moved = np.flatnonzero(label != np.arange(len(nodes)))
                add, tags = np.concatenate([add_v, add_m]), np.concatenate([vt, mt])
                some = np.flatnonzero(add)
                none = lambda n: pa.nulls(n, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nodes[some]), pa.array(tags[some]), pa.array(add[some]), none(len(some))], names=["rep", "tag", "add", "other"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nodes[moved]), none(len(moved)), none(len(moved)), pa.array(nodes[label[moved]])], names=["rep", "tag", "add", "other"])

    return run


def fit(classes: DataFrame, count: int, width: int, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Codebooks of the two halves, from at most ``sample`` vectors drawn by a hash."""
    share = min(1.0, sample / max(count, 1))
    drawn = classes.filter(F.pmod(F.xxhash64("tag", F.lit(5)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("embedding").limit(sample)
    points = unit(_stack(drawn.toArrow().column(0).combine_chunks(), width))
    largest = classes.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    k = int(min(CODEWORDS[1], max(CODEWORDS[0], math.sqrt(largest / CELL))))
    cut = (width + 1) // 2
    return kmeans(points[:, :cut], k), kmeans(points[:, cut:], k)


def _rows_of(keys: list[str], cells: DataFrame, name: str) -> DataFrame:
    """Blocks of rows of one cell, gathered by ``keys``."""
    return cells.groupBy(*keys).agg(F.collect_list(F.struct("rep", "tag", "n", "vec", "own", "visits")).alias(name))


def cell_pairs(cells: DataFrame, block: int = BLOCK) -> DataFrame:
    """(members, visitors): every block of a cell's members beside every block of its visitors.

    A cell of any size is spread over many blocks. The sizes are written, so that Spark broadcasts them only if small.
    """
    count = lambda c: F.greatest(F.ceil(c / block), F.lit(1)).cast("int")
    sizes = materialize(cells.groupBy(*CELL_KEY).agg(
        count(F.count_if("home")).alias("parts"), count(F.count(F.lit(1))).alias("halls")), "vector-cell-sizes")
    dealt = cells.join(sizes, CELL_KEY)
    keys = [*CELL_KEY, "hall"]
    visitors = dealt.withColumn("hall", F.pmod(F.xxhash64("rep", "tag"), "halls").cast("int")).repartition(*keys)
    members = (dealt.filter("home").withColumn("part", F.pmod(F.xxhash64("tag", "rep"), "parts").cast("int"))
               .withColumn("hall", F.explode(F.sequence(F.lit(0), F.col("halls") - 1))).repartition(*keys))
    return _rows_of([*keys, "part"], members, "members").join(_rows_of(keys, visitors, "visitors"), keys).select("members", "visitors")


def near_vectors(rows: DataFrame, key: str, vector: str, label: str, cosine: float = COSINE, recall: float = RECALL) -> DataFrame:
    """One row per row: key, n_links, component_id, kept."""
    e = F.col("embedding")
    fine = (F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (F.size(e) > 0)
            & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(e, lambda x: x != 0))
    rows = rows.select(F.col(key).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"),
                       F.transform(F.col(vector), lambda x: x.cast("double")).alias("embedding"))
    rows = rows.withColumn("embedding", F.when(F.coalesce(fine, F.lit(False)), e))
    classes = materialize(rows.filter("embedding is not null").groupBy("label", "embedding").agg(
        F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n")).withColumn("tag", F.xxhash64("embedding")), "vector-classes")
    count, width = classes.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    if not count:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
                           F.col("vec_id").isNotNull().alias("kept"))
    first, second = fit(classes, count, width)
    radius = math.sqrt(2 - 2 * cosine)
    reach = NormalDist().inv_cdf(1 - (1 - recall) / 2) * radius / math.sqrt(width)
    cells = classes.select("label", F.size("embedding").alias("dim"), "rep", "tag", "n", "embedding").mapInArrow(
        _index(width, first, second, reach ** 2), CELLS)
    found = materialize(cell_pairs(cells).mapInArrow(_verify(cosine, width), "rep long, tag long, add long, other long"), "vector-links")
    links = found.filter("add is not null").groupBy("rep", "tag").agg(F.sum("add").alias("others"))
    nodes = components(found.filter("other is not null"), "rep", "other")
    known = (classes.join(links, ["rep", "tag"], "left").join(nodes, F.col("rep") == F.col("node"), "left")
             .select("label", "embedding", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"),
                     F.coalesce("component", "rep").alias("component_id")))
    out = rows.join(known, ["label", "embedding"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def q_op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, component and keeper of every embedding, within its label, at cosine 0.93."""
    return near_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")

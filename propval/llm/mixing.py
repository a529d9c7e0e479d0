"""Operator 8: mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources that hold them). A flow network
source-of-words -> pattern -> source -> sink routes words to the sources' quotas; a pattern's r-th copy
costs r - 1 per word, so repetition is spread convexly. Each pattern then repeats all its documents as often
as its flow fills, and a seeded order decides which documents give the rest.

Patterns that share no source do not compete: each connected part of patterns and sources is a network of its own,
solved in a task of its own. A part of one pattern and one source has one path, whose flow is a plain expression;
where every document has one source, as in the query, all parts are of that kind and the flow has no choice to make.
No pattern, source or target reaches the driver, however many there are. Selection is distributed:
a seeded number in [0, 1) deals a pattern's documents into buckets, bucket sums find the boundary bucket, and
only that bucket's documents are walked in order.

Defined results: null and empty texts have size 0 and take 0 words; null sources form a source of their own;
repeated rows are separate documents that share their seeded number (ties go by size); an empty table gives no
rows; very long texts count whole; other columns stay untouched beside the result.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from propval.llm.common import materialize, ranked, table
from propval.llm.components import components
from propval.operators.stats import broadcast_if_small

WORD = r"[^\x20\x09-\x0D]+"
ZONE_ROWS = 128  # documents the boundary bucket aims at
MAX_BUCKETS = 1 << 16  # buckets of one pattern
WEIGHT_CYCLE = (3.0, 1.0, 2.0)  # fixed values: the weights of the sources in order, repeating


class Network:
    """Min-cost flow by successive shortest paths with potentials (Dijkstra), on the nodes of one connected part."""

    def __init__(self, n: int):
        self.edges: list[list] = []  # [head, residual capacity, cost]; edge i ^ 1 is the reverse of edge i
        self.out: list[list[int]] = [[] for _ in range(n)]

    def add(self, tail: int, head: int, capacity: int, cost: int) -> int:
        for a, b, c, k in ((tail, head, capacity, cost), (head, tail, 0, -cost)):
            self.out[a].append(len(self.edges))
            self.edges.append([b, c, k])
        return len(self.edges) - 2

    def flow(self, edge: int) -> int:
        return self.edges[edge ^ 1][1]

    def run(self, source: int, sink: int) -> int:
        n, total = len(self.out), 0
        potential = [0] * n
        while True:
            dist, via = [None] * n, [-1] * n
            dist[source], queue = 0, [(0, source)]
            while queue:
                d, u = heapq.heappop(queue)
                if d > dist[u]:
                    continue
                for e in self.out[u]:
                    v, capacity, cost = self.edges[e]
                    if capacity and (dist[v] is None or d + cost + potential[u] - potential[v] < dist[v]):
                        dist[v], via[v] = d + cost + potential[u] - potential[v], e
                        heapq.heappush(queue, (dist[v], v))
            if dist[sink] is None:
                return total
            far = max(x for x in dist if x is not None)
            potential = [p + (far if x is None else x) for p, x in zip(potential, dist)]
            path, v = [], sink
            while v != source:
                path.append(via[v])
                v = self.edges[via[v] ^ 1][0]
            step = min(self.edges[e][1] for e in path)
            for e in path:
                self.edges[e][1] -= step
                self.edges[e ^ 1][1] += step
            total += step


def route(patterns: Sequence[tuple[Sequence[str], int]], quotas: Mapping[str, int], copies: int) -> list[int]:
    """Words each (sources, size) pattern gives so that the quotas fill at the least repetition."""
    names = {s: len(patterns) + 1 + i for i, s in enumerate(sorted(quotas))}
    sink = len(patterns) + len(names) + 1
    net = Network(sink + 1)
    supply = [[net.add(0, 1 + p, size, r) for r in range(copies)] for p, (_, size) in enumerate(patterns)]
    for p, (members, size) in enumerate(patterns):
        for s in members:
            if quotas.get(s, 0):
                net.add(1 + p, names[s], size * copies, 0)
    for s, node in names.items():
        net.add(node, sink, int(quotas[s]), 0)
    net.run(0, sink)
    return [sum(net.flow(e) for e in edges) for edges in supply]


def shared_targets(sources: DataFrame, total: float, most: float) -> DataFrame:
    """``sources`` (size, weight) with ``target``: ``total`` dealt out by weight, no source above ``most`` times its
    size, the excess dealt anew until none is above.

    A source's share grows with every deal, so one number, the words of a unit of weight, tells which are full.
    """
    full = F.col("size") * F.lit(float(most))

    def dealt(unit: float) -> Column:
        return F.lit(unit) * F.col("weight")

    unit = 0.0
    while True:
        over = dealt(unit) > full
        held, open_ = sources.agg(F.sum(F.when(over, full).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight")))).first()
        following = (total - held) / open_ if open_ else unit
        if following <= unit:
            return sources.withColumn("target", F.least(dealt(unit), full))
        unit = following


def _swap(sizes: np.ndarray, n: np.ndarray, chosen: list[int], need: int) -> None:
    """Exchange one chosen document for one that is not, if that brings the sum nearer to the quota."""
    taken = np.flatnonzero((np.array(chosen) > 0) & (sizes > 0))
    free = np.flatnonzero((np.array(chosen) < n) & (sizes > 0))
    if not len(taken) or not len(free):
        return
    free = free[np.argsort(sizes[free], kind="stable")]
    at = np.searchsorted(sizes[free], sizes[taken] + need)
    pairs = [(abs(int(sizes[free[k]] - sizes[t]) - need), int(t), int(free[k]))
             for t, i in zip(taken, at) for k in (i - 1, i) if 0 <= k < len(free)]
    gap, out, into = min(pairs)
    if gap < abs(need):
        chosen[out] -= 1
        chosen[into] += 1


def _fill(batch: pd.DataFrame) -> pd.DataFrame:
    """Of one boundary bucket, in seeded order: as many of each class of equal rows as still fit, then one more row
    if that comes nearer."""
    batch = batch.sort_values(["_u", "_size"], kind="stable").reset_index(drop=True)
    need, chosen, least = int(batch["_need"].iloc[0]), [], None
    for i, (size, n) in enumerate(zip(batch["_size"], batch["_n"])):
        fits = min(n, need // size) if size else 0
        chosen.append(int(fits))
        need -= fits * size
        if size and fits < n and (least is None or size < batch["_size"].iloc[least]):
            least = i
    if least is not None and abs(int(batch["_size"].iloc[least]) - need) < need:
        chosen[least] += 1
        need -= int(batch["_size"].iloc[least])
    if need:
        _swap(batch["_size"].to_numpy(), batch["_n"].to_numpy(), chosen, need)
    return pd.DataFrame({"_p": batch["_p"], "_u": batch["_u"], "_size": batch["_size"], "_chosen": chosen})


def prepare(docs: DataFrame, keep: Sequence[str], members: Column, size: Column, key: Sequence[Column], seed: int) -> DataFrame:
    """Columns ``keep`` of ``docs`` with _pattern, _size, the seeded number _u and a row number, written once so that they are stable."""
    return materialize(docs.select(
        *keep, F.array_sort(F.array_distinct(members)).alias("_pattern"), F.coalesce(size.cast("long"), F.lit(0)).alias("_size"),
        (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *key), 11) / float(1 << 53)).alias("_u"),
        F.monotonically_increasing_id().alias("_row")), "mix-documents")


def _part_flows(copies: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        quotas = {s: int(q) for s, q in zip(rows["_member"], rows["_quota"])}
        patterns = rows.groupby("_p", sort=True).agg({"_member": list, "_size": "first"})
        given = route([(sorted(m), int(n)) for m, n in zip(patterns["_member"], patterns["_size"])], quotas, copies)
        return pd.DataFrame({"_p": patterns.index, "_words": given})

    return run


def routed(patterns: DataFrame, quotas: DataFrame, copies: int) -> DataFrame:
    """(_p, _words): what each pattern gives. ``patterns`` has _p, _pattern and _size, ``quotas`` _member and _quota, both written."""
    pairs = patterns.select("_p", "_size", F.size("_pattern").alias("_n"), F.explode("_pattern").alias("_member")).join(quotas, "_member", "left")
    pairs = materialize(pairs.na.fill(0, ["_quota"]), "mix-pairs")
    shared = pairs.groupBy("_member").agg(F.max("_n").alias("_most"))
    marked = materialize(pairs.join(shared, "_member"), "mix-marked")
    alone = marked.filter("_n = 1 and _most = 1").select("_p", F.least(F.col("_size") * copies, "_quota").alias("_words"))
    rest = marked.filter("_n > 1 or _most > 1")
    members = materialize(rest.select("_member").distinct().select("_member", (-1 - F.monotonically_increasing_id()).alias("_m")), "mix-members")
    links = materialize(rest.join(members, "_member"), "mix-links")
    parts = components(links, "_p", "_m").select(F.col("node").alias("_p"), F.col("component").alias("_part"))
    flows = links.join(parts, "_p").groupBy("_part").applyInPandas(_part_flows(copies), "_p long, _words long")
    return alone.unionByName(flows)


def mix(prepared: DataFrame, quotas: DataFrame, copies: int) -> DataFrame:
    """``prepared`` with ``times`` and ``taken``: whole documents, ``copies`` times at most, the quotas filled.

    ``quotas`` has _member and _quota; sources without a row there get nothing.
    """
    patterns = prepared.groupBy("_pattern").agg(F.sum("_size").alias("_size"), F.count(F.lit(1)).alias("_docs"))
    patterns = materialize(patterns.withColumn("_p", F.monotonically_increasing_id()), "mix-patterns")
    given = materialize(routed(patterns, quotas, copies), "mix-flows")
    whole = F.when(F.col("_size") > 0, F.least(F.lit(copies), F.floor(F.col("_words") / F.col("_size")))).otherwise(0).cast("long")
    buckets = F.greatest(F.lit(1), F.least(F.lit(MAX_BUCKETS), F.floor(F.col("_docs") / ZONE_ROWS)))
    plan = patterns.join(given, "_p").withColumn("_whole", whole).select(
        "_pattern", "_p", "_whole", (F.col("_words") - F.col("_whole") * F.col("_size")).alias("_rest"), buckets.alias("_buckets"))
    dealt = prepared.join(broadcast_if_small(materialize(plan, "mix-plan")), "_pattern", "left")
    dealt = dealt.withColumn("_bucket", F.floor(F.col("_u") * F.col("_buckets")))
    sums = dealt.filter("_rest > 0").groupBy("_p", "_bucket").agg(F.sum("_size").alias("_sum"), F.first("_rest").alias("_all"))
    w = Window.partitionBy("_p").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    need = (F.col("_all") - F.col("_upto") + F.col("_sum")).alias("_need")
    edges = (sums.withColumn("_upto", F.sum("_sum").over(w)).filter("_upto > _all")
             .groupBy("_p").agg(F.min(F.struct("_bucket", need)).alias("_e")).select("_p", F.col("_e._bucket").alias("_edge"), "_e._need"))
    edges = broadcast_if_small(materialize(edges, "mix-edges"))  # one row per pattern
    dealt = dealt.join(edges, "_p", "left")
    zone = dealt.filter("_bucket = _edge").select("_p", "_u", "_size", "_need", "_row")
    classes = zone.groupBy("_p", "_u", "_size").agg(F.count(F.lit(1)).alias("_n"), F.first("_need").alias("_need"))
    chosen = classes.groupBy("_p").applyInPandas(_fill, "_p long, _u double, _size long, _chosen long").filter("_chosen > 0")
    nth = F.row_number().over(Window.partitionBy("_p", "_u", "_size").orderBy("_row"))
    extra = (zone.join(chosen, ["_p", "_u", "_size"]).withColumn("_nth", nth).filter("_nth <= _chosen")
             .select("_row", F.lit(1).alias("_extra")))
    # about ZONE_ROWS rows a pattern: Spark broadcasts the written table if its files are small, and joins it otherwise
    dealt = dealt.join(materialize(extra, "mix-extra"), "_row", "left")
    before = (F.col("_rest") > 0) & (F.col("_edge").isNull() | (F.col("_bucket") < F.col("_edge")))
    times = (F.coalesce("_whole", F.lit(0)) + F.coalesce("_extra", before.cast("int"), F.lit(0))).cast("int")
    return dealt.select(*prepared.columns, times.alias("times"), (F.col("_size") * times).alias("taken"))


def mix_documents(docs: DataFrame, keep: Sequence[str], share: float = 1.5, most: int = 2, seed: int = 8,
                  key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Columns ``keep`` of all ``docs`` with size, source_size, target, taken and times.

    Sources in the order of their code points, null last, weigh WEIGHT_CYCLE in turn and share ``share`` times all
    words; no source's target is above ``most`` times its own words.
    """
    member = F.when(F.col(source).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(source)))
    drawn = [F.col(key), F.crc32(F.encode(text, "UTF-8"))]
    prepared = prepare(docs, keep, F.array(member), F.regexp_count(text, F.lit(WORD)), drawn, seed)
    sources = prepared.groupBy(F.get("_pattern", F.lit(0)).alias("_member")).agg(F.sum("_size").alias("size"))
    sources = ranked(materialize(sources, "mix-sources"), (F.col("_member") == "n").asc(), F.col("_member").asc())
    cycle = F.array(*[F.lit(w) for w in WEIGHT_CYCLE])
    sources = materialize(sources.withColumn("weight", F.get(cycle, ((F.col("rank") - 1) % len(WEIGHT_CYCLE)).cast("int"))), "mix-weights")
    words = sources.agg(F.sum("size")).first()[0] or 0
    targets = materialize(shared_targets(sources, share * words, most), "mix-targets")
    mixed = mix(prepared, targets.select("_member", F.rint("target").cast("long").alias("_quota")), most)
    known = broadcast_if_small(targets.select(F.array("_member").alias("_pattern"), F.col("size").alias("source_size"), "target"))
    return mixed.join(known, "_pattern", "left").select(
        *keep, F.col("_size").alias("size"), "source_size", "target", "taken", "times")


def q_op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to 150 % of their words by the sources' cycled weights, none above twice its words."""
    return mix_documents(table(spark, sf_dir, "documents"), ["doc_id"])

"""Operator 4 [native]: secrets by fixed patterns, and random strings by character Markov models.

Two first-order Markov models over characters, one of random strings and one of ordinary identifiers, are
counted from labelled samples with DataFrame aggregates. Random samples are seeded strings over each usual alphabet
and the values that the fixed patterns find; ordinary ones are words of a bounded sample of the texts, joined to
identifiers, and numbers and dates. Each sample counts alike, whatever its size. Runs of token characters outside
the fixed patterns' spans are scored character by character by the log-likelihood ratio of the two models; a stretch
is a secret when its sum reaches a threshold, and ends where the sum has fallen by ``FALL`` from its height, so that
ordinary words joined to a random string neither hide it nor belong to it. The main path uses Spark SQL expressions
only; the driver sees just the cells of the transition matrices (at most (ALPHABET + 1)^2 rows a sample).

Positions come from splitting a text at a pattern: match i starts after the first i pieces and i - 1 matches.

Defined results: a null text counts as empty and has no spans; repeated rows and null ids give one row each;
spans of one start are ordered by kind; an empty table gives no rows (and untrained, uniform models).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from propval.llm.common import materialize, table

# The patterns of the base kinds, the shortest length each keeps (of the group named), in rank order.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # runs of [0-9a-f]+ of 24 and more: equal, as runs are maximal
KINDS = (("assign", ASSIGN, 2, 6), ("access", ACCESS, 0, 20), ("hex", HEX, 0, 24))
CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}"
WORD = r"[A-Za-z0-9]+"
ORDINARY = r"^([A-Z]?[a-z]+|[A-Z]{1,12}|[0-9]{1,14})$"
RANDOM = "random"
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ALPHABETS = {"hex": DIGITS + LOWER[:6], "base32": UPPER + "234567", "base36": LOWER + DIGITS, "base62": UPPER + LOWER + DIGITS,
             "base64": UPPER + LOWER + DIGITS + "+/"}
JOINTS = ["_", "-", "/", "=", "", "+", "_", "-"]
RANK = {name: i for i, name in enumerate([k[0] for k in KINDS] + [RANDOM])}

ALPHABET = 128  # ASCII; candidates hold nothing else
START = 0  # code of the position before the first character
SMOOTHING = 0.5  # added to each character's count
BACKOFF = 8.0  # transitions' worth of trust in the characters' own frequencies
THRESHOLD = 20.0  # nats by which the random model must be likelier
FALL = 8.0  # nats below its height at which a stretch ends
SHORTEST = 12  # characters of a stretch
STRINGS = 1000  # seeded strings of each alphabet, and seeded numbers and dates
LENGTH = 40  # characters of a seeded string
SAMPLE = 4000  # texts, about, whose words are the ordinary sample


def _group(match: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(match, pattern, group) if group else match


def pattern_spans(text: Column, pattern: str) -> Column:
    """array<struct<start, stop, token>> of the leftmost non-overlapping matches, in code points."""
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    paired = F.arrays_zip(F.slice(pieces, 1, F.size(found)).alias("piece"), found.alias("token"))
    empty = F.array().cast("array<struct<start:int,stop:int,token:string>>")

    def step(acc, x):
        start = acc["at"] + F.length(x["piece"])
        stop = start + F.length(x["token"])
        return F.struct(stop.alias("at"), F.concat(acc["spans"], F.array(F.struct(
            start.alias("start"), stop.alias("stop"), x["token"].alias("token")))).alias("spans"))

    walked = F.aggregate(paired, F.struct(F.lit(0).alias("at"), empty.alias("spans")), step, lambda acc: acc["spans"])
    return F.when(text.rlike(pattern), walked).otherwise(empty)


def base_spans(text: Column) -> list[Column]:
    """One column per base kind: its spans that reach the kind's shortest length."""
    def kept(name: str, pattern: str, group: int, least: int) -> Column:
        return F.filter(pattern_spans(text, pattern), lambda s: F.length(_group(s["token"], pattern, group)) >= least).alias(name)

    return [kept(*kind) for kind in KINDS]


def _blanked(text: Column, spans: Column) -> Column:
    """``text`` with a space for every character of the spans (sorted by start)."""
    def step(acc, s):
        gap = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        blank = F.repeat(F.lit(" "), F.greatest(s["stop"] - F.greatest(acc["at"], s["start"]), F.lit(0)))
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), F.concat(acc["out"], gap, blank).alias("out"))

    whole = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(
        acc["out"], F.substring(text, acc["at"] + 1, F.greatest(F.length(text) - acc["at"], F.lit(0)))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def annotate(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """Columns ``keep`` with the base spans of each kind and the candidate runs outside them, from one scan of whole texts."""
    t = F.coalesce(F.col(text), F.lit(""))
    names = [n for n, *_ in KINDS]
    found = docs.select(*keep, t.alias("_text")).select(*keep, "_text", *base_spans(F.col("_text")))
    found = found.withColumn("_rest", _blanked(F.col("_text"), F.array_sort(F.concat(*names))))
    return found.select(*keep, *names, pattern_spans(F.col("_rest"), CANDIDATE).alias("_candidates"))


def found_values(annotated: DataFrame) -> DataFrame:
    """(token, random, sample): what the base spans hold."""
    def values(name: str, pattern: str, group: int) -> Column:
        return F.transform(F.col(name), lambda s: _group(s["token"], pattern, group))

    return annotated.select(F.explode(F.concat(*[values(n, p, g) for n, p, g, _ in KINDS])).alias("token"), F.lit(1).alias("random"),
                            F.lit("found").alias("sample"))


def seeded_strings(spark: SparkSession, n: int = STRINGS, length: int = LENGTH) -> DataFrame:
    """(token, random, sample): ``n`` strings over each alphabet, characters by a hash of row and place."""
    def string(name: str, chars: str) -> Column:
        return F.array_join(F.transform(F.sequence(F.lit(1), F.lit(length)), lambda j: F.substring(
            F.lit(chars), F.pmod(F.xxhash64(F.col("id"), j, F.lit(name)), F.lit(len(chars))).cast("int") + 1, F.lit(1))), "")

    rows = F.array(*[F.struct(string(k, v).alias("token"), F.lit(1).alias("random"), F.lit(k).alias("sample")) for k, v in ALPHABETS.items()])
    return spark.range(n).select(F.explode(rows).alias("s")).select("s.*")


def numbers_and_dates(spark: SparkSession, n: int = STRINGS) -> DataFrame:
    """(token, random, sample): seeded dates, times and numbers in usual forms, alone and joined."""
    day = F.date_add(F.lit("1980-01-01").cast("date"), F.pmod(F.xxhash64("id"), F.lit(20_000)).cast("int"))
    number = F.pmod(F.xxhash64("id", F.lit(1)), F.pow(F.lit(10.0), (F.col("id") % 13 + 1).cast("double")).cast("long")).cast("string")
    clock = F.lpad(F.pmod(F.xxhash64("id", F.lit(2)), F.lit(240_000)).cast("string"), 6, "0")
    forms = [day.cast("string"), F.date_format(day, "yyyyMMdd"), F.date_format(day, "yyyy_MM_dd"), F.concat_ws("_", F.date_format(day, "yyyyMMdd"), clock),
             F.concat_ws("-", day.cast("string"), clock), number, F.concat_ws("-", number, clock), F.concat_ws("/", F.date_format(day, "yyyy/MM/dd"), number)]
    return spark.range(n).select(F.explode(F.array(*forms)).alias("token"), F.lit(0).alias("random"), F.lit("numbers").alias("sample"))


def ordinary_identifiers(docs: DataFrame, text: str, sample: int = SAMPLE) -> DataFrame:
    """(token, random, sample): words of about ``sample`` distinct texts, three at a time joined to an identifier."""
    every = max(1, docs.count() // sample)
    texts = docs.select(F.col(text).alias("t")).filter(F.col("t").isNotNull()).withColumn("h", F.xxhash64("t")).filter(F.pmod("h", F.lit(every)) == 0)
    texts = texts.groupBy("h").agg(F.first("t").alias("t"))  # copies count once
    words = F.filter(F.regexp_extract_all("t", F.lit(WORD), F.lit(0)), lambda w: w.rlike(ORDINARY))
    joints = F.array(*[F.lit(j) for j in JOINTS])

    def joined(i: Column) -> Column:
        seam = [F.get(joints, F.pmod(F.xxhash64(F.col("h"), i, F.lit(k)), F.lit(len(JOINTS))).cast("int")) for k in (0, 1)]
        return F.concat(F.get("w", i), seam[0], F.coalesce(F.get("w", i + 1), F.lit("")), seam[1], F.coalesce(F.get("w", i + 2), F.lit("")))

    rows = texts.select("h", words.alias("w")).filter(F.size("w") > 0)
    tokens = rows.select(F.explode(F.transform(F.sequence(F.lit(0), F.size("w") - 1, F.lit(3)), joined)).alias("token"))
    return tokens.select("token", F.lit(0).alias("random"), F.lit("words").alias("sample"))


def labelled_samples(docs: DataFrame, text: str, annotated: DataFrame) -> DataFrame:
    """All samples: seeded random strings and found values (1), identifiers of the texts and numbers (0)."""
    spark = docs.sparkSession
    return (found_values(annotated).unionByName(seeded_strings(spark)).unionByName(numbers_and_dates(spark))
            .unionByName(ordinary_identifiers(docs, text)))


def _codes(token: Column) -> Column:
    return F.transform(F.split(token, ""), lambda c: F.when(F.ascii(c) < ALPHABET, F.ascii(c)).otherwise(START))


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratio of each transition (row: previous character or START, column: character).

    ``samples`` has columns token, random (1 or 0) and, where it has several samples of a class, sample: each counts
    alike. Other labels and null tokens are ignored. All rows count.
    """
    sample = F.col("sample") if "sample" in samples.columns else F.lit("")
    codes = samples.filter("token is not null and random in (0, 1)").select("random", sample.alias("sample"), _codes(F.col("token")).alias("c"))
    steps = codes.select("random", "sample", F.explode(F.arrays_zip(
        F.concat(F.array(F.lit(START)), F.slice("c", 1, F.greatest(F.size("c") - 1, F.lit(0)))).alias("a"), F.col("c").alias("b"))).alias("s"))
    cells = steps.groupBy("random", "sample", "s.a", "s.b").agg(F.count(F.lit(1)).alias("n")).collect()
    total: dict[tuple, int] = {}
    for r in cells:
        total[r["random"], r["sample"]] = total.get((r["random"], r["sample"]), 0) + r["n"]
    largest = {k: max((n for (c, _), n in total.items() if c == k), default=0) for k in (0, 1)}
    used = sorted({r["b"] for r in cells})
    counts: dict[tuple, float] = {}
    for r in cells:  # every sample raised to the weight of its class's largest
        key = r["random"], r["a"], r["b"]
        counts[key] = counts.get(key, 0.0) + r["n"] * largest[r["random"]] / total[r["random"], r["sample"]]
    single = {}
    for k in (0, 1):
        n = {b: sum(counts.get((k, a, b), 0) for a in (START, *used)) + SMOOTHING for b in used}
        single[k] = {b: n[b] / sum(n.values()) for b in used}
    out = [0.0] * (ALPHABET * ALPHABET)
    for a in (START, *used):
        mass = [sum(counts.get((k, a, b), 0) for b in used) + BACKOFF for k in (0, 1)]
        for b in used:
            p = [(counts.get((k, a, b), 0) + BACKOFF * single[k][b]) / mass[k] for k in (0, 1)]
            out[a * ALPHABET + b] = math.log(p[1] / p[0])
    return out


def _constant(numbers: list[float]) -> Column:
    """An array that Spark folds to one literal: a plan with a literal for each number would fill the driver."""
    return F.split(F.lit(" ".join(map(repr, numbers))), " ").cast("array<double>")


def log_ratio(token: Column, ratios: list[float]) -> Column:
    """Sum of the transitions' log-likelihood ratios along a token."""
    cells = _constant(ratios)
    zero = F.struct(F.lit(START).alias("a"), F.lit(0.0).alias("sum"))
    return F.aggregate(_codes(token), zero, lambda acc, c: F.struct(
        c.alias("a"), (acc["sum"] + F.get(cells, acc["a"] * ALPHABET + c)).alias("sum")), lambda acc: acc["sum"])


def random_stretches(token: Column, ratios: list[float], threshold: float = THRESHOLD, fall: float = FALL) -> Column:
    """array<struct<start, stop>> of a token's stretches whose ratios reach ``threshold``, in characters of the token.

    The sum starts anew where it is not above 0, and a stretch ends where the sum has fallen by ``fall`` from its
    height; it reaches from its start to that height.
    """
    cells = _constant(ratios)
    none = F.array().cast("array<struct<start:int,stop:int>>")

    def closed(acc):
        good = (acc["best"] >= threshold) & (acc["stop"] - acc["start"] >= SHORTEST)
        return F.when(good, F.concat(acc["out"], F.array(F.struct(acc["start"].alias("start"), acc["stop"].alias("stop"))))).otherwise(acc["out"])

    def step(acc, c):
        total = acc["sum"] + F.get(cells, acc["a"] * ALPHABET + c)
        at = acc["at"] + 1
        end = (total <= 0) | (total < acc["best"] - fall)
        higher = ~end & (total > acc["best"])
        return F.struct(
            c.alias("a"), at.alias("at"), F.when(end, 0.0).otherwise(total).alias("sum"), F.when(end, at).otherwise(acc["start"]).alias("start"),
            F.when(end, 0.0).when(higher, total).otherwise(acc["best"]).alias("best"),
            F.when(end | higher, at).otherwise(acc["stop"]).alias("stop"), F.when(end, closed(acc)).otherwise(acc["out"]).alias("out"))

    zero = F.struct(F.lit(START).alias("a"), F.lit(0).alias("at"), F.lit(0.0).alias("sum"), F.lit(0).alias("start"), F.lit(0.0).alias("best"),
                    F.lit(0).alias("stop"), none.alias("out"))
    return F.aggregate(_codes(token), zero, step, closed)


def score(annotated: DataFrame, ratios: list[float], threshold: float = THRESHOLD) -> DataFrame:
    """``annotated`` with ``spans``: all base spans and the random stretches beside them, by start and kind."""
    def tagged(col: Column, kind: str) -> Column:
        return F.transform(col, lambda s: F.struct(
            s["start"].alias("start"), F.lit(RANK[kind]).alias("rank"), s["stop"].alias("stop"), F.lit(kind).alias("kind")))

    inside = F.flatten(F.transform("_candidates", lambda c: F.transform(random_stretches(c["token"], ratios, threshold), lambda s: F.struct(
        (c["start"] + s["start"]).alias("start"), (c["start"] + s["stop"]).alias("stop")))))
    base = F.concat(*[tagged(F.col(n), n) for n, *_ in KINDS])
    return annotated.withColumn("_base", F.array_sort(base)).withColumn(
        "spans", F.array_sort(F.concat(base, tagged(inside, RANDOM))))


def span_text(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def find_secrets(docs: DataFrame, text: str, keep: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """Columns ``keep`` of every row with the arrays assign, access, hex, _base and spans."""
    found = materialize(annotate(docs, text, keep), "secret-spans")
    return score(found, train(labelled_samples(docs, text, found)), threshold)


def redact(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """``text`` with every span (or union of overlapping spans) replaced by ``mark``."""
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        gap = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        more = F.when(s["start"] >= acc["at"], F.concat(acc["out"], gap, F.lit(mark))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), more.alias("out"))

    whole = F.aggregate(spans, zero, step, lambda acc: F.concat(
        acc["out"], F.substring(text, acc["at"] + 1, F.greatest(F.length(text) - acc["at"], F.lit(0)))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def q_op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest and positions of the secrets in every whole document."""
    found = find_secrets(table(spark, sf_dir, "documents"), "text", ["doc_id"])
    return found.select(
        "doc_id", *[F.size(n).cast("long").alias(f"n_{n}") for n, *_ in KINDS],
        F.sha2(F.encode(span_text("_base"), "UTF-8"), 256).alias("base_sha256"), span_text("spans").alias("spans"))

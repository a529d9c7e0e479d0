"""Every query on empty tables and on odd rows, against plain Python."""

import hashlib
import itertools
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from tokenizers import Tokenizer

import __spark_entry__ as entry
from propval.llm import mixing, secret_scan, sharding, simhash, toxicity
from tests.llm.conftest import DOCS, by_key, plain

QUERIES = {k: v for k, v in entry.queries().items() if re.match(r"op\d+_|pipeline$", k)}


def query(n):
    return next(v for k, v in QUERIES.items() if k.startswith(f"op{n}_"))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables_give_no_rows(spark, empty, name):
    assert QUERIES[name](spark, empty).collect() == []


def test_all_queries_are_registered():
    assert sorted(QUERIES) == sorted(["pipeline", *(next(k for k in QUERIES if k.startswith(f"op{n}_")) for n in range(1, 14))])


def test_op1(spark, tiny):
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for d, t, *_ in DOCS:
        n = len(lib.encode(t or "", add_special_tokens=False).ids)
        want.append((d, len((t or "").encode()), n, n > 512))
    assert by_key(plain(query(1)(spark, tiny))) == by_key(want)


def test_op2(spark, tiny):
    got = plain(query(2)(spark, tiny))
    assert len(got) == len(DOCS)
    for d, held, score, predicted in got:
        assert held == (d is None or zlib.crc32(str(d).encode()) % 5 == 0)
        assert 0 <= score <= 1 and predicted == (score >= 0.5)


def test_op2_sample_is_not_emptied(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(20)] + [(4, "text 4"), (20, ""), (30, "x" * 5000), (31, "y" * 4000)], "id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1000)], "id long, label int")  # most without a document
    texts, y = toxicity.pick_sample(docs, labels, 30, 2000)
    assert sorted(y) == [0] * 10 + [1] * 10 and set(texts) == {f"text {i}" for i in range(20)}  # whole texts, none that does not fit
    texts, y = toxicity.pick_sample(docs.filter("id >= 30"), labels, 30, 2000)
    assert sorted(texts) == ["x" * 5000, "y" * 4000] and sorted(y) == [0, 1]  # a class is never emptied
    texts, y = toxicity.pick_sample(docs, labels, 3, 2000)
    assert sorted(y) == [0, 0, 0, 1, 1, 1]


def test_op3(spark, tiny):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{tiny}/embeddings.parquet").collect()]
    fine = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows
            if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, v in fine:
        if q % 100 == 0:
            scores = sorted(((-sum(a * b for a, b in zip(v, w)), i) for i, w in fine if i != q))[:10]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    assert by_key(plain(query(3)(spark, tiny))) == by_key(want)


KINDS = [("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I, 2, 6),
         ("access", r"AKIA[A-Z0-9]+", 0, 0, 20), ("hex", r"[0-9a-f]+", 0, 0, 24)]


def base_spans(text):
    found = [(m.start(), k, m.end(), name) for k, (name, p, flags, g, n) in enumerate(KINDS)
             for m in re.finditer(p, text, flags) if len(m.group(g)) >= n]
    return sorted(found)


def test_op4(spark, tiny):
    got = query(4)(spark, tiny).collect()
    want = []
    for d, t, *_ in DOCS:
        spans = base_spans(t or "")
        text = ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)
        want.append((d, *[sum(s[3] == k[0] for s in spans) for k in KINDS], hashlib.sha256(text.encode()).hexdigest()))
    assert by_key([tuple(r)[:5] for r in got]) == by_key(want)
    for r in got:
        kept = [s for s in r.spans.split(",") if s and not s.startswith("random:")]
        assert hashlib.sha256(",".join(kept).encode()).hexdigest() == r.base_sha256


def test_op4_random_strings_from_labelled_samples(spark):
    rng = np.random.default_rng(0)
    chars = np.array(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"))
    secret = ["".join(rng.choice(chars, 24)) for _ in range(300)]
    syllables = ["ra", "ton", "mer", "li", "sen", "ko", "pa", "tive", "al"]
    plain_ = ["_".join("".join(rng.choice(syllables, 4)) for _ in range(2)) for _ in range(300)]
    samples = spark.createDataFrame([(s, 1) for s in secret[:200]] + [(s, 0) for s in plain_[:200]] + [(None, 1), ("x", None)], "token string, random int")
    ratios = secret_scan.train(samples)
    held = spark.createDataFrame([(s, 1) for s in secret[200:]] + [(s, 0) for s in plain_[200:]], "token string, random int")
    scored = held.select("random", (secret_scan.log_ratio(held.token, ratios) >= secret_scan.THRESHOLD).alias("hit")).collect()
    assert np.mean([r.hit == bool(r.random) for r in scored]) > 0.98


def test_op4_redaction(spark):
    df = spark.createDataFrame([("ab password=hunter22 cd", [(3, 20), (12, 20)]), ("xy", [])], "t string, s array<struct<start:int,stop:int>>")
    assert [r[0] for r in df.select(secret_scan.redact(df.t, df.s)).collect()] == ["ab [secret] cd", "xy"]


def test_op4_plan_is_native(spark, tiny):
    plan = query(4)(spark, tiny)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def components(nodes, linked):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            m = min(label[a], label[b])
            if label[a] != m or label[b] != m:
                label[a] = label[b] = m
                changed = True
    return label


def test_op5(spark, tiny):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{tiny}/embeddings.parquet").collect()]
    ok = [i is not None and v and lab is not None and all(x is not None and np.isfinite(x) for x in v) and any(v) for i, v, lab in rows]
    linked, n_links = [], [0] * len(rows)
    for a, b in itertools.permutations(range(len(rows)), 2):
        (ia, va, la), (ib, vb, lb) = rows[a], rows[b]
        if ok[a] and ok[b] and la == lb and len(va) == len(vb):
            x, y = np.array(va, float), np.array(vb, float)
            if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93:
                n_links[a] += 1
                linked.append((ia, ib))
    label = components({i for i, _, _ in rows if i is not None}, linked)
    want = [(i, n, None if i is None else label[i], i is not None and label[i] == i) for (i, _, _), n in zip(rows, n_links)]
    assert by_key(plain(query(5)(spark, tiny))) == by_key(want)


def test_op6(spark, tiny):
    rows = [(r.page_id, (r.html or "").encode()) for r in spark.read.parquet(f"{tiny}/pages.parquet").collect()]
    least = {}
    for i, p in rows:
        if len(p) >= 100 and i is not None:
            least[p] = min(i, least.get(p, i))
    want = []
    for i, p in rows:
        first = least.get(p)
        revisit = first is not None and i != first
        want.append((i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    assert by_key(plain(query(6)(spark, tiny))) == by_key(want)


def fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    shingles = [" ".join(words[i:i + 4]) for i in range(max(len(words) - 3, min(len(words), 1)))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_op7(spark, tiny):
    fps = [fingerprint(t) for _, t, *_ in DOCS]
    assert fps == [simhash.fingerprint(t) for _, t, *_ in DOCS]
    linked = [(a, b) for a in range(len(fps)) for b in range(len(fps)) if bin(fps[a] ^ fps[b]).count("1") <= 4]
    label = components(range(len(fps)), linked)
    ids = {c: min((d for (d, *_), x in zip(DOCS, label.values()) if x == c and d is not None), default=None) for c in label.values()}
    want = [(d, f"{f:016x}", ids[label[i]]) for i, ((d, *_), f) in enumerate(zip(DOCS, fps))]
    assert by_key(plain(query(7)(spark, tiny))) == by_key(want)


def test_op8(spark, tiny):
    got = query(8)(spark, tiny).collect()
    size = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    assert by_key([(r.doc_id, r["size"]) for r in got]) == by_key([(d, size(t)) for d, t, *_ in DOCS])
    sizes = {}
    for _, t, _, s, _ in DOCS:
        sizes[s] = sizes.get(s, 0) + size(t)
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    targets, rest = {}, 1.5 * sum(sizes.values())
    while len(targets) < len(order):
        left = [s for s in order if s not in targets]
        unit = rest / sum(weight[s] for s in left)
        over = [s for s in left if unit * weight[s] > 2 * sizes[s]] or left
        capped = unit * weight[over[0]] > 2 * sizes[over[0]]
        for s in over:
            targets[s] = 2 * sizes[s] if capped else unit * weight[s]
        rest = 1.5 * sum(sizes.values()) - sum(targets.values())
    source = {d: s for d, _, _, s, _ in DOCS if d is not None}
    for r in got:
        assert r.taken in (0, r["size"], 2 * r["size"])
        if r.doc_id is not None:
            assert r.source_size == sizes[source[r.doc_id]] and r.target == pytest.approx(targets[source[r.doc_id]])
    assert by_key(plain(query(8)(spark, tiny))) == by_key([tuple(r) for r in got])


def test_op9(spark, tiny):
    got = query(9)(spark, tiny).collect()
    facts = [(d, len((t or "").encode()) + 1, None if t is None else zlib.crc32(t.encode())) for d, t, *_ in DOCS]
    assert by_key([(r.doc_id, r["size"], r.text_crc32) for r in got]) == by_key(facts)

    def shard(d, n):
        key = "n" if d is None else f"v{d}"
        draw = [int(hashlib.md5(f"{key}#{s}".encode()).hexdigest()[:13], 16) for s in range(n)]
        return max(range(n), key=lambda s: draw[s])

    for r in got:
        assert (r.law, r.shard, r.grown_shard) == ("key", shard(r.doc_id, 16), shard(r.doc_id, 17))
    for s in {r.shard for r in got}:
        mine = sorted(r.slot for r in got if r.shard == s)
        assert mine == list(range(len(mine)))


def test_op9_weights(spark):
    df = spark.range(30_000).withColumnRenamed("id", "k")
    n = {r.shard: r["count"] for r in sharding.assign(df, "k", [1.0, 2.0, 0.0, 3.0]).groupBy("shard").count().collect()}
    assert set(n) == {0, 1, 3}
    assert [n[0] / 5000, n[1] / 10000, n[3] / 15000] == pytest.approx([1, 1, 1], rel=0.05)
    moved = sharding.assign(df, "k", [1.0] * 4, grown=[1.0] * 5).filter("shard <> grown_shard")
    assert {r.grown_shard for r in moved.select("grown_shard").distinct().collect()} == {4}


def test_op10(spark, tiny):
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = plain(query(10)(spark, tiny))
    want = [(d, len(lib.encode(t or "")), lib.encode(t or ""), True) for d, t, *_ in DOCS]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_pipeline_stages_keep_columns(spark, tiny):
    import corpus_pipeline as cp
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, tiny)
        assert out.columns == docs.columns, name
        assert out.dtypes == docs.dtypes, name
        out.collect()
    kept = plain(cp.drop_near_duplicates(spark, docs, tiny).select("doc_id", "text"))
    groups = {}
    for d, t, *_ in DOCS:
        groups.setdefault(simhash.fingerprint(t), []).append((d is None, d, t))
    assert len(kept) == len(groups)  # no two fingerprints of these rows are near
    assert by_key([r[0] for r in map(lambda r: ((r[0],),), kept)]) == by_key([(min(g, key=lambda x: (x[0], x[1] or 0))[1],) for g in groups.values()])
    clean = {r.doc_id: r for r in cp.redact_secrets(spark, docs, tiny).collect() if r.doc_id is not None}
    assert clean[8].text.startswith("[secret] and [secret] and [secret]") and clean[8].n_chars == len(clean[8].text)
    assert clean[6].text == DOCS[8][1]
    assert spark.createDataFrame([], docs.schema).count() == 0


def test_pipeline_run(spark, tiny):
    import corpus_pipeline as cp
    out = cp.run(spark, tiny)
    assert out.columns == ["doc_id", "n_pieces", "ids"] and out.count() > 0


def test_mixing_flow_spreads_repetition():
    # two sources share the second pattern; the first copies fill both quotas at no cost
    assert mixing.route([(["a"], 10), (["a", "b"], 10), (["b"], 10)], {"a": 15, "b": 15}, 2) in ([10, 10, 10],)
    assert sum(mixing.route([(["a"], 10), (["a", "b"], 10)], {"a": 25, "b": 10}, 2)) == 35
    given = mixing.route([(["a"], 10), (["a"], 30)], {"a": 50}, 3)
    assert sum(given) == 50 and given[0] <= 20 and given[1] <= 60  # no third copy while a second one is free


def test_batches_are_bounded_by_bytes(spark):
    """Whatever the texts' length: by rows alone, these 60 are one batch of 18 MB; one text is longer than a batch."""
    import pyarrow as pa
    import public_tokenizers
    from propval.llm import sentencepiece_viterbi, toxicity
    from propval.llm.common import BATCH_BYTES

    def measure(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes]), pa.array([b.num_rows])], names=["size", "n"])

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.range(60, numPartitions=1).selectExpr("id as doc_id", "repeat('ab ', 100000 * (1 + 17 * int(id = 30))) as text")
    scorer = toxicity.Scorer(np.zeros(8, np.float32), 0.0)
    for build in (lambda: simhash.fingerprints(docs, ["doc_id"]), lambda: toxicity.score(docs, ["doc_id"], "text", scorer),
                  lambda: sentencepiece_viterbi.encode(docs.filter("doc_id < 3"), ["doc_id"], "text", public_tokenizers.path("piece_bpe_32k.model"))):
        spark.conf.unset(name)
        out = build()
        found = docs.mapInArrow(measure, "size long, n long").collect()
        assert sum(r.n for r in found) == 60
        assert max(r.size for r in found if r.n > 1) < 2 * BATCH_BYTES + 6_000_000
        assert len(found) > 3
        assert out.count() in (3, 60)


def test_workers_give_back_what_a_task_freed():
    from propval.llm import common
    seen = []
    whole = list(common.lean(lambda batches: (seen.append(b) or b for b in batches))(iter([1, 2, 3])))
    assert whole == seen == [1, 2, 3]


def test_training_sums_in_parts():
    """A range of segments is summed at a time, with the same digits as all of them at once."""
    rng = np.random.default_rng(5)
    values = rng.normal(size=3 * toxicity.CELLS)
    starts = np.unique(np.concatenate([[0], rng.integers(1, toxicity.CELLS // 2, 500), [2 * toxicity.CELLS + 7]]))
    asked = []

    def part(a, b):
        asked.append(b - a)
        return values[a:b]

    assert (toxicity.segment_sums(part, starts, len(values)) == np.add.reduceat(values, starts)).all()
    assert sum(asked) == len(values) and len(asked) > 1 and sorted(asked)[-2] <= toxicity.CELLS

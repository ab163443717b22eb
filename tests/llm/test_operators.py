"""Each operator on messy little tables (nulls, empty and long texts, ties, repeated rows, clashing columns), against brute force."""

import collections
import json
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from relspark.llm import ann, chat, decontam, langid, license_scan, lmscore, neardup, packing, queries, toxicity, warc

from ..compare import DATA, check

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
BASE = "the quick brown fox jumps over the lazy dog while many small birds sing in old trees near water " * 3


def words(text):
    return (text or "").encode().translate(LOWER).split()


@pytest.fixture(scope="module")
def messy(spark):
    near = BASE + " and then it ended"
    rows = [(1, BASE), (2, BASE.upper()), (3, near), (4, None), (5, ""), (6, " \t\n"), (7, "one two"), (8, "One  two"), (9, "une histoire très différente avec İstanbul ① <|endoftext|>"), (10, "x" * 300 + " " + "long words here " * 3000), (11, "Released under the MIT License. mit license, Apache License, Version 2.0"), (11, "Released under the MIT License. mit license, Apache License, Version 2.0"), (None, BASE), (None, None), (12, "licensed under the Apache License, Version inserted 2.0"), (13, "CC BY-NC cc by nc")]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({"id": F.lit("x"), "score": F.lit("clash"), "node": F.lit(1), "row": F.lit(2), "n": F.lit(None).cast("int")})


def plain(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def shingle_set(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_superminhash_is_a_minhash():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 900, dtype=np.uint64)
    for size, shared in ((4, 3), (60, 45), (600, 400)):
        a, b = np.sort(pool[:size]), np.sort(pool[size - shared : 2 * size - shared])
        sig = neardup.superminhash([a, b, a[:0]], 400)
        want = shared / (2 * size - shared)
        assert abs((sig[0] == sig[1]).mean() - want) < 4 * math.sqrt(want * (1 - want) / 400) + 0.02
        assert (sig[2] == sig[2].max()).all()
    one = neardup.superminhash([a], 400)[0]
    assert (one == neardup.superminhash([b[:1], a], 400)[1]).all()


def components_of(rows):
    sets = [(i, shingle_set(t)) for i, t in rows]
    group = list(range(len(rows)))
    for x in range(len(rows)):
        for y in range(x):
            a, b = sets[x][1], sets[y][1]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                group = [group[y] if g == group[x] else g for g in group]
    return collections.Counter((i, len(s), min((rows[k][0] for k in range(len(rows)) if group[k] == group[x] and rows[k][0] is not None), default=None) if s else i) for x, (i, s) in enumerate(sets))


@pytest.mark.parametrize("bound", [500_000, 0])
def test_near_duplicates(spark, messy, bound):
    got = neardup.near_duplicates(messy, how=neardup.NearDup(union_find_links=bound)).collect()
    assert collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == components_of(plain(messy))
    assert all(r["kept"] == (r["doc_id"] == r["component_id"] or r["doc_id"] is None) for r in got)
    assert neardup.near_duplicates(messy.limit(0)).count() == 0


def test_near_duplicates_chain_and_passage(spark):
    """A chain whose ends aren't alike, and documents that only share a passage."""
    chain = [(k, " ".join(f"w{j}" for j in range(2 * k, 2 * k + 60))) for k in range(30)]
    passage = " ".join(f"p{j}" for j in range(70))
    common = [(100 + k, passage + " " + " ".join(f"d{k}x{j}" for j in range(40))) for k in range(120)]
    docs = spark.createDataFrame(chain + common, "doc_id long, text string")
    for bound in (500_000, 5):
        got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs, how=neardup.NearDup(union_find_links=bound)).collect()}
        assert all(got[k] == 0 for k in range(30)) and all(got[100 + k] == 100 + k for k in range(120))


def test_near_duplicates_at_the_threshold(spark):
    """A group of near copies of which many pairs fall just short of the threshold."""
    rng = np.random.default_rng(4)
    rows = []
    for d in range(140):
        w = [f"w{i}" for i in range(100)]
        for at in rng.integers(0, 100, 3):
            w[at] = f"x{d}y{at}"
        rows.append((d, " ".join(w)))
    # without bands that find all links, the prefix filter completes the groups that some band has opened
    for how in (neardup.NearDup(), neardup.NearDup(bands=20, rows=3)):
        got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), how=how).collect()
        assert collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == components_of(rows)


def test_near_duplicates_of_mixed_sizes(spark):
    """Boilerplate lines in many mixes, so that many sets are near the threshold and sizes differ."""
    rng = np.random.default_rng(9)
    lines = [" ".join(f"l{i}w{j}" for j in range(int(rng.integers(4, 12)))) for i in range(14)]
    rows = [(d, " ".join(lines[i] for i in sorted(rng.choice(14, int(rng.integers(6, 14)), replace=False)))) for d in range(150)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), how=neardup.NearDup(bands=60, rows=3)).collect()
    assert collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == components_of(rows)


def test_repeated_rows_stay_linear(spark):
    """600 rows of two near texts under two ids: a row each comes back, and verification reads each set once."""
    near = BASE + " and then it ended"
    docs = spark.createDataFrame([(1, BASE)] * 300 + [(2, near)] * 300, "doc_id long, text string")
    got = neardup.near_duplicates(docs).collect()
    assert len(got) == 600 and {r["component_id"] for r in got} == {1}
    sizes = [len(neardup.shingles(*neardup.word_hashes([t.encode()], neardup.WordHashes()), 5)[0]) for t in (BASE, near)]
    signed = neardup._signed(docs, "doc_id", "text", neardup.NearDup()).groupBy("digest", "more").agg(F.min("id").alias("low")).withColumn("node", F.monotonically_increasing_id())
    sets = neardup._sets(docs, "doc_id", "text", signed, neardup.NearDup()).collect()
    assert sorted(len(r["hashes"]) for r in sets) == sorted(sizes)
    left = neardup.near_dup_stage(spark, docs, "").collect()
    assert [r["doc_id"] for r in left] == [1]


def test_only_centres_are_copied_to_their_pairs(spark, monkeypatch):
    """Of 30 near copies each full set is read once, and the sets of a few centres are what goes to all pairs."""
    docs = spark.createDataFrame([(k, f"{BASE} and then it ended{k}") for k in range(30)], "doc_id long, text string")
    read, verified = [], neardup.verified
    monkeypatch.setattr(neardup, "verified", lambda pairs, firsts, sets, percent: (read.append((firsts.count(), sets.count(), pairs.count())), verified(pairs, firsts, sets, percent))[1])
    assert {r["component_id"] for r in neardup.near_duplicates(docs).collect()} == {0}
    ((centres, every, pairs),) = read
    assert centres < 5 and every == 30 and 29 <= pairs < 30 * centres


def test_near_duplicates_in_rounds_leave_no_shuffle_files(spark, messy, monkeypatch):
    master = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    whole = sorted(map(tuple, neardup.near_duplicates(messy).collect()), key=str)
    monkeypatch.setattr(neardup, "ROUND", 1)
    rounds, verified = [], neardup.verified
    monkeypatch.setattr(neardup, "verified", lambda *args: (rounds.append(1), verified(*args))[1])
    found = neardup.near_duplicates(messy)
    assert sorted(map(tuple, found.collect()), key=str) == whole and len(rounds) >= neardup.MOST_ROUNDS
    held = master.shuffleStatuses().size()
    neardup.keep(spark.range(1000).groupBy((neardup.F.col("id") % 7).alias("k")).count())
    assert master.shuffleStatuses().size() <= held


def shuffled(spark):
    """Bytes written to shuffles by all stages of the session."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(60_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


@pytest.mark.parametrize("kind", ["long", "string"])
def test_only_texts_whose_sets_are_wanted_are_shuffled(spark, kind):
    rng = np.random.default_rng(4)
    rows = [(d, " ".join(map(str, rng.integers(0, 1 << 40, 400)))) for d in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("doc_id", F.col("doc_id").cast(kind))
    signed = neardup._signed(docs, "doc_id", "text", neardup.NearDup()).withColumnsRenamed({"id": "low", "n_shingles": "n"})
    nodes = neardup.keep(signed.withColumn("node", F.col("low").cast("long")).where("node % 25 = 0").drop("bands"))
    own = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled(spark)
        sets = neardup._sets(docs, "doc_id", "text", nodes, neardup.NearDup())
        assert sorted((r["node"], len(r["hashes"])) for r in sets.collect()) == [(d, 396) for d in range(0, 500, 25)]
        assert shuffled(spark) - before < sum(len(t) for _, t in rows) / 4
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", own)


def test_filter_of_ids_loses_none(spark, monkeypatch):
    texts = spark.range(40_000).select(F.col("id").alias("low"), F.lit("x").alias("text")).union(spark.createDataFrame([(None, "x"), (7, "y")], "low long, text string"))
    wanted = texts.where("low % 10 = 7").select("low").distinct()
    got = neardup._likely(texts, wanted)
    assert got.columns == texts.columns and got.join(wanted, "low", "left_semi").count() == 4001 and got.count() < 4001 + 40_000 / 10
    assert neardup._likely(texts, wanted.limit(0)).count() == 0
    monkeypatch.setattr(neardup, "MOST_FILTER_BITS", 1 << 10)  # too few bits for all: more texts pass, and none is lost
    assert neardup._likely(texts, wanted).join(wanted, "low", "left_semi").count() == 4001


def test_dedup_stage_keeps_one(spark, messy):
    left = neardup.near_dup_stage(spark, messy, "")
    assert left.columns == messy.columns
    ids = [r["doc_id"] for r in left.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 4, 5, 6, 7, 9, 10, 11, 12, 13] and ids.count(None) == 2
    other = "an id that has two texts keeps both of them because they are not alike"
    docs = spark.createDataFrame([(1, BASE), (2, BASE), (2, other), (2, other), (3, BASE.upper())], "doc_id long, text string").withColumns({"id": F.lit(1), "version": F.lit("v"), "_text_of_id": F.lit(2), "group": F.lit(0)})
    left = neardup.near_dup_stage(spark, docs, "")
    assert left.columns == docs.columns and sorted(plain(left)) == [(1, BASE), (2, other)]


def test_warc_round_trip(spark):
    body = "<p>" + "é" * 80 + "</p>"
    rows = [(1, "u", body), (2, None, body), (3, "a\r\nb", None), (4, "u", "short"), (5, "u", "short"), (None, "u", body), (6, "u", body), (6, "u", body)] + [(k, f"http://x/{k}", f"<html>page {k} " + "text " * (k % 90) + "</html>") for k in range(10, 400)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).repartition(2)
    from relspark.llm._store import shared_dir

    manifest = warc.write_archives(pages, shared_dir(spark), sample_bytes=30_000, roll_bytes=20_000)
    assert manifest.agg(F.sum("records")).first()[0] == len(rows) and manifest.count() > 2
    got = {r["page_id"]: r for r in warc.read_archives(manifest).collect()}
    assert got[2]["record_type"] == "revisit" and got[2]["refers_to"] == 1 and got[2]["payload_bytes"] == len(body.encode())
    assert got[4]["record_type"] == got[5]["record_type"] == got[1]["record_type"] == "response" and got[3]["payload_bytes"] == 0
    assert all(bytes(got[i]["payload"]).decode() == h for i, _, h in rows if i in got and got[i]["record_type"] == "response" and h)
    assert any(open(r["path"].removeprefix("file://"), "rb").read(4) == b"\x5d\x2a\x4d\x18" for r in manifest.collect())
    assert warc.read_archives(warc.write_archives(pages.limit(0), shared_dir(spark))).count() == 0


def test_lm_scores(spark, messy):
    got = lmscore.lm_score(messy, lmscore.vocabulary_file(), F.col("doc_id") % 3 != 0).collect()
    tokens = [(i, [*words(t), None]) for i, t in plain(messy)]
    c = collections.Counter(w for i, ws in tokens if i is not None and i % 3 for w in ws)
    n, v = sum(c.values()), len(c)
    want = collections.Counter((i, len(ws), sum(w in c for w in ws), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 6)) for i, ws in tokens)
    assert collections.Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    none = lmscore.lm_score(messy.where("doc_id = 7"), lmscore.vocabulary_file(), F.lit(False)).first()
    assert none["base_score"] == 0.0 and none["train_tokens"] == 0
    assert lmscore.lm_score(messy.limit(0), lmscore.vocabulary_file(), F.lit(True)).count() == 0


def test_lm_scores_do_not_depend_on_buckets(spark):
    rows = [(None, "The same row again")] * 40 + [(i, f"the word{i % 7} and Word{i % 3} " * (i % 4)) for i in range(40)] + [(41, None), (42, "x" * 3000), (42, "x" * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want, got = ([(r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in lmscore.lm_score(docs, lmscore.vocabulary_file(), F.col("doc_id") % 4 != 0, bucket_chars=chars).collect()] for chars in (12_000_000, 40))
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    want, got = sorted(want, key=key), sorted(got, key=key)
    assert len(got) == len(rows) and [r[:4] for r in want] == [r[:4] for r in got]
    assert np.allclose([r[4:] for r in want], [r[4:] for r in got], rtol=1e-12)


def test_lattice_sums_all_segmentations():
    lat = lmscore.Lattice(lmscore.vocabulary_file())

    def brute(rest, start=True):
        if not rest:
            return 1.0
        total = lat.prior[lat.byte[rest[0]]] * brute(rest[1:])
        return total + sum(lat.prior[lat.ids[rest[:m]]] * brute(rest[m:]) for m in range(1, len(rest) + 1) if rest[:m] in lat.ids)

    tests = [b"the", "été".encode(), b"ab1", b"q"]
    assert np.allclose(lat.log_probability(tests, lat.prior), [math.log(brute(b" " + w)) for w in tests])
    long = b"abc" * 30
    parts = lat.log_probability([long, long[:60]], lat.prior)
    assert parts[0] < parts[1] and np.isclose(lat._long(b" the", *(lambda p: (np.append(np.log(p), -np.inf), np.log(p[lat.byte] + np.where(lat.single >= 0, p[lat.single], 0))))(lat.prior)), lat.log_probability([b"the"], lat.prior)[0])
    with np.errstate(divide="ignore"):
        counts = lat.expected([b"the", b"a"], np.array([3, 2]), lat.prior)
    assert 5 <= counts.sum() <= 5 + 3 * 3 + 2


def test_long_words_teach_pieces():
    """Expected counts are the slopes of the log-probability, for words of any length."""
    lat = lmscore.Lattice(lmscore.vocabulary_file())
    many = list(lat.ids.values())
    some = [lat.ids[x] for x in (b"the", b"he", b"th", b"ing", b" the", b"t")]
    for word in (b"thing", b"the" * 21, b"thething" * 8, b"thething" * 200, "中文没有空格".encode() * 20):
        got = lat.expected([word], np.array([2]), lat.prior)
        for i in [*some, int(np.argmax(np.where(np.isin(np.arange(lat.size), many), got, 0)))]:
            up, down = lat.prior.copy(), lat.prior.copy()
            up[i], down[i] = up[i] * 1.0001, down[i] / 1.0001
            slope = (lat.log_probability([word], up) - lat.log_probability([word], down))[0] / (2 * math.log(1.0001))
            assert np.isclose(got[i], 2 * slope, rtol=1e-4, atol=1e-6)
    assert np.allclose(lat.expected([b"the" * 30, b"a"], np.array([1, 3]), lat.prior), lat.expected([b"the" * 30], np.array([1]), lat.prior) + lat.expected([b"a"], np.array([3]), lat.prior))


def test_packing(spark, messy):
    from tokenizers import Tokenizer

    path, capacity = packing.tokenizer_file(), 64
    rows = [r.asDict() for r in packing.pack(messy, path, capacity=capacity).collect()]
    tok, want = Tokenizer.from_file(path), collections.Counter()
    for i, t in plain(messy):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), capacity):
            part = np.array(ids[k : k + capacity], "<u4")
            want[i, k // capacity, k, len(part), zlib.crc32(part.tobytes())] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    bins = collections.defaultdict(list)
    for r in rows:
        assert len(r["ids"]) == r["length"]
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        b.sort()
        assert all(x[0] + x[1] == y[0] for x, y in zip(b, b[1:])) and b[0][0] == 0 and sum(n for _, n in b) <= capacity
    assert packing.pack(messy.limit(0), path).count() == 0


def test_bins_are_as_full_as_can_be():
    rng = np.random.default_rng(3)
    for _ in range(30):
        counts = collections.Counter(rng.integers(1, 60, 200).tolist())
        bins = packing.plan_bins(dict(counts), 60)
        used = collections.Counter()
        for times, chosen in bins:
            assert sum(n * k for n, k in chosen.items()) <= 60
            for n, k in chosen.items():
                used[n] += times * k
        assert used == counts
        assert sum(t for t, _ in bins) <= max(-(-sum(n * c for n, c in counts.items()) // 60), sum(c for n, c in counts.items() if n > 30)) * 1.05 + 1
    assert sorted(packing._fullest([9, 7, 5], {9: 1, 7: 1, 5: 2}, 17, 0)) == [5, 5, 7]


def test_ids_are_the_tokenizers():
    memo = packing.PartIds(packing.tokenizer_file(), most_bytes=4000)
    rng = np.random.default_rng(3)
    odd = ["don't WE'LL it's 'sir \"'tis", "Ünïcödé ßtraße ÆØÅ ÿ", "e\u0301cole ne\u0308", "İstanbul Ÿ ŸŸ", "a\u00a0b\u2028c\x85d", "<|endoftext|> a<|startoftext|>b", "<|", "12345 a1b2", "\x1c\x1f\x00", "日本語 テスト", "x" * 500, "×÷ª º µ", "_under_score__", "tab\tnew\nline\x0b\x0cx", "😀😀 ok"]
    pool = [w for t in odd for w in t.split(" ")] + [chr(c) for c in range(33, 400)]
    texts = odd + [" ".join(rng.choice(pool, 12)) for _ in range(300)]
    for text in texts:
        parts = [memo.parts(text.encode())]
        memo.learn(parts)
        got = np.frombuffer(b"".join(map(memo.known.__getitem__, parts[0])), "<u4").tolist()
        assert got == memo.whole.encode(text, add_special_tokens=False).ids, text
    assert memo.older and memo.parts(None) == memo.parts(b"") == []


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(400, 24)) * rng.uniform(0.5, 2, (400, 1))
    v[7] = v[8] = v[9]
    rows = [(i, [float(x) for x in a]) for i, a in enumerate(v)] + [(900, None), (901, [0.0] * 24), (902, [float("nan")] * 24), (903, [None] * 24), (904, []), (905, [1.0, 2.0]), (906, [2.0, 1.0]), (None, [1.0] * 24), (9, [float(x) for x in v[9]])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    got = collections.defaultdict(list)
    for r in ann.search(df, F.col("vec_id") % 3 == 0, top=5).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    hits = 0
    for q in range(0, 400, 3):
        scores = {i: float(v[i] @ v[q]) for i in range(400) if i != q}
        best = sorted(scores, key=lambda i: (-round(scores[i], 9), i))[:5]
        assert len(got[q]) == 5 and all(abs(scores[i] - s) < 1e-9 for i, s in got[q]) and [s for _, s in got[q]] == sorted((s for _, s in got[q]), reverse=True)
        hits += len({i for i, _ in got[q]} & set(best))
    assert hits >= 0.9 * 5 * 134
    assert got[906] == [(905, 4.0)] and not {900, 901, 903, 904} & set(got)
    assert ann.search(df.limit(0), F.lit(True)).count() == 0


def test_nearest_neighbours_of_repeated_ids(spark):
    """Ids that repeat more than 2 * top times, with one vector or many, hide no other id."""
    frame = lambda rows: spark.createDataFrame([(i, [x, 0.0, 0.0, 0.0]) for i, x in rows], "vec_id long, embedding array<double>")
    step = 2.0**-26  # so small that all vectors share every bucket
    same = frame([(i, 1 + i * step) for i in (0, 1, 2, 3) for _ in range(30)])
    got = ann.search(same, F.col("vec_id") == 0, top=5).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(i, 1 + i * step) for i in (3, 2, 1)]
    many = frame([(0, 1.0), *((1, 1 + (1 + k) * step) for k in range(50)), *((i, 1 - i * step) for i in range(2, 9))])
    got = ann.search(many, F.col("vec_id") == 0, top=5).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(1, 1 + 50 * step), *((i, 1 - i * step) for i in range(2, 6))]


def test_language_id(spark, messy):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    model = langid.fit(docs.where(toxicity.remainder("doc_id", 3) != 1))
    got = langid.predict(docs, model).where(toxicity.remainder("doc_id", 3) == 1).select("lang", "lang_pred", "lang_score").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.93 and all(0 <= r["lang_score"] <= 1 for r in got)
    odd = {r["doc_id"]: r for r in langid.predict(messy.withColumn("lang_pred", F.lit(3)), model).collect()}
    assert odd[4]["lang_pred"] == odd[5]["lang_pred"] == odd[6]["lang_pred"] == "und" and odd[9]["lang_pred"] != "und"
    assert langid.predict(messy, langid.fit(docs.limit(0))).where("lang_pred <> 'und'").count() == 0


def grams(text, bits):
    """Coordinate -> count of the 1- to 4-grams of a text, character by character."""
    line = " " + " ".join(re.sub("[A-Z]", lambda m: m[0].lower(), text).translate({c: " " for c in [*range(0x41), *map(ord, "[\\]^_`{|}~\x7f")]}).split(" ")).strip(" ") + " "
    line = re.sub(" +", " ", line)
    raw, out = line.encode(), collections.Counter()
    for n in (1, 2, 3, 4):
        for k in range(len(raw) - n + 1):
            if n < 3 or b" " not in raw[k + 1 : k + n - 1]:
                code = 0
                for c in raw[k : k + n]:
                    code = (code * 257 + c + 1) % (1 << 64)
                out[(code * 0x9E3779B97F4A7C15 % (1 << 64)) >> (64 - bits)] += 1
    return out


def test_language_id_against_plain_cosines(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").where("length(text) < 2000").limit(120)
    model = langid.fit(docs, bits=14, sample_rows=60)
    columns = model.centroids.T.tolist()
    for r in langid.predict(docs, model).collect():
        own = {c: (1 + math.log(n)) * float(model.idf[c]) for c, n in grams(r["text"], 14).items()}
        norm = math.sqrt(sum(x * x for x in own.values()))
        cosines = [sum(x * centre[c] for c, x in own.items()) / norm for centre in columns]
        assert abs(max(cosines) - r["lang_score"]) < 1e-4
        near = {model.language[k] for k, x in enumerate(cosines) if x > max(cosines) - 1e-5}
        assert r["lang_pred"] in near and r["lang_rejected"] == (r["lang_score"] < model.floor[r["lang_pred"]])


def test_language_id_ties_repeats_and_bytes(spark):
    rows = [(k, "the same text in two languages", lang) for k, lang in enumerate(["zz", "aa"] * 3)] + [(9, "ein anderer satz", "de")] * 500 + [(10, "42 !", "de"), (11, "wort " * 5000, "de"), (None, "noch ein satz", "de"), (12, "kein", None), (13, None, "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert set(model.language) == {"aa", "de", "zz"} and model.language.count("de") == 3
    got = {r["text"]: r["lang_pred"] for r in langid.predict(docs, model).collect()}
    assert got["the same text in two languages"] == "aa" and got["42 !"] == "und" and got["ein anderer satz"] == "de"
    small = langid.fit(docs, sample_bytes=1)  # the first text of each language alone
    assert sorted(small.language) == ["aa", "de", "zz"]


def test_language_id_learns_every_language(spark):
    rng = np.random.default_rng(6)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    rows = [(4 * k + j, " ".join(own), f"l{k:03}") for k in range(420) for own in [["".join(rng.choice(letters, 7)) for _ in range(12)]] for j in range(1 + (k < 400))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for bound in (2000, 100):
        model = langid.fit(docs, bits=12, most_dense=bound)
        assert isinstance(model.centroids, langid.Sparse) == (bound == 100) and len(set(model.language)) == 420
        assert langid.predict(docs, model).where("lang <> lang_pred OR lang_score < 0.999").isEmpty()
    assert len(set(langid.fit(docs, bits=12, sample_rows=10).language)) == 420


def test_chat(spark):
    call = lambda *calls: json.dumps({"tool_calls": [{"id": i, "name": n, "arguments": a, "depends": d} for i, n, a, d in calls]})
    rows = [
        (1, 0, "assistant", call(("a", "reply", {"prompt": "x"}, ["b"]), ("b", "reply", {"prompt": ""}, ["c"]))),
        (1, 1, "tool", '{"tool_call_id": "a", "content": {"z": 1, "a": 2}}'),
        (1, 2, "assistant", call(("c", "zip", 3, []))),
        (2, 0, "assistant", call(("a", "reply", {"prompt": "x"}, ["b"]), ("b", "reply", {"q": 1}, ["a"]))),
        (None, None, "user", None),
        (None, 3, "tool", '{"tool_call_id": "zz"}'),
        (3, 0, "user", "hi {"),
        (3, 1, "assistant", "{broken"),
        (3, 0, "user", "hi {"),
    ]
    got = {(r["conv_id"], r["call_id"]): r for r in chat.link_tool_calls(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    key = lambda *k: (got[k]["order_turn"], got[k]["order_index"], got[k]["order_depth"])
    assert key(1, "c") < key(1, "b") < key(1, "a") and not got[1, "a"]["cyclic"] and got[2, "a"]["cyclic"] and got[2, "b"]["cyclic"]
    assert got[1, "a"]["json"] == '{"arguments":{"prompt":"x"},"conv_id":1,"id":"a","name":"reply","result":{"a":2,"z":1}}'
    assert not got[1, "b"]["valid"] and not got[1, "c"]["valid"] and got[2, "b"]["error"] == "$.prompt: missing; $.q: not allowed"
    assert got[3, "turn-0"]["status"] == "linked" and got[3, "turn-0"]["n_calls"] == 2 and got[None, "zz"]["status"] == "orphan"
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.link_tool_calls(empty).count() == 0


def test_chat_keeps_what_it_cannot_link(spark):
    rows = [(1, 0, None, "no role"), (1, 1, "critic", None), (1, 2, "tool", "{broken"), (1, 3, "tool", '{"content": 1}'), (1, 4, "assistant", '{"tool_calls": [7, {"id": "a", "name": "reply", "arguments": {"prompt": "x"}}, "y"]}'), (None, None, None, None), (2, 0, "tool", "twice"), (2, 0, "tool", "twice")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for plain in (True, False):
        got = chat.link_tool_calls(df, plain=plain).collect()
        loose = sorted((r["conv_id"] or 0, r["order_turn"], r["order_index"], json.loads(r["json"])["result"]) for r in got if r["status"] == "unlinked")
        assert loose == [(0, -1, 0, ""), (1, 0, 0, "no role"), (1, 1, 0, ""), (1, 2, 0, "{broken"), (1, 3, 0, '{"content": 1}'), (1, 4, 0, 7), (1, 4, 2, "y"), (2, 0, 0, "twice"), (2, 0, 0, "twice")]
        assert [(r["call_id"], r["status"], r["valid"]) for r in got if r["status"] != "unlinked"] == [("a", "unanswered", True)]
        assert not any(r["valid"] or r["call_id"] or r["n_calls"] or r["n_results"] for r in got if r["status"] == "unlinked")


def test_schema_problems():
    s = {"type": "object", "properties": {"n": {"type": "integer", "minimum": 1}, "l": {"type": "array", "items": {"type": "string", "enum": ["a"]}}}, "required": ["n"]}
    assert chat.problems({"n": 1, "l": ["a"], "x": 0}, s) == []
    assert chat.problems({"n": True}, s) and chat.problems({"n": 0}, s) and chat.problems({"n": 2, "l": ["b"]}, s) and chat.problems([], s)


def test_decontamination(spark, messy):
    items = spark.createDataFrame([(1, "birds sing in old trees near water the quick brown"), (2, "one two"), (3, None), (4, ""), (5, "never seen words at all in here"), (None, "one two"), (6, "long words here long words here long")], "item_id long, text string").withColumn("h", F.lit(0))
    got = {(r["doc_id"], r["item_id"]): (r["n_shared"], r["n_item"]) for r in decontam.contaminated(messy, items).collect()}
    docs, want = collections.defaultdict(set), {}
    for i, t in plain(messy):
        docs[i] |= shingle_set(t)
    for q, t in [(r["item_id"], r["text"]) for r in items.collect()]:
        own = shingle_set(t)
        for i, s in docs.items():
            if own and i is not None and q is not None and 100 * len(own & s) >= 75 * len(own):
                want[i, q] = (len(own & s), len(own))
    assert got == want and want
    assert decontam.contaminated(messy, items.limit(0)).count() == 0 and decontam.contaminated(messy.limit(0), items).count() == 0


def test_decontamination_stage_without_ids(spark, tmp_path):
    """Rows without an id are judged by their text; a column named digest isn't touched."""
    leak = BASE + "only here"
    spark.createDataFrame([(1, BASE)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(1, leak), (2, "clean text with some more words"), (None, leak), (None, leak), (None, "clean text with some more words"), (None, None), (None, "")], "doc_id long, text string").withColumn("digest", F.lit("own"))
    left = decontam.decontam_stage(spark, docs, str(tmp_path))
    clean = "clean text with some more words"
    assert left.columns == docs.columns
    assert collections.Counter(map(tuple, left.collect())) == collections.Counter([(2, clean, "own"), (None, clean, "own"), (None, None, "own"), (None, "", "own")])


def test_sketch_recall(spark):
    """With the density that the search picks, long documents keep a shingle of every contained item."""
    rng = np.random.default_rng(2)
    texts = [(d, " ".join(f"w{x}" for x in rng.integers(0, 10**9, n))) for d, n in enumerate([30, 100, 1000, 20_000])]
    items = [(100 * d + k, " ".join(t.split()[a : a + 40])) for d, t in texts for k in range(12) for a in [rng.integers(0, max(1, len(t.split()) - 40))]]
    items = [(i, t) for i, t in items if len(t.split()) >= 25]
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(i // 100, i) for i, _ in items}
    assert decontam.density_for(24, 1e-6) == 0 and decontam.density_for(3, 1e-6) is None


def test_toxicity(spark, messy):
    docs = spark.createDataFrame([(i, ("you are a scum " if i % 4 == 0 else "what a fine day ") + f"word{i % 50} thing{i % 7}") for i in range(400)] + [(1000, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(None, 1), (5, None), (6, 7), (1000, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert all((got[i] >= 0.5) == (i % 4 == 0) for i in range(400)) and 0 <= got[1000] <= 1 and len(model.index) < 200
    assert toxicity.score(messy, model).count() == messy.count()
    assert {r["score"] for r in toxicity.score(messy, toxicity.fit(docs, labels.limit(0))).collect()} == {0.0}


def plain_ftrl(rows, how):
    """The same updates, coordinate by coordinate, in 64-bit floats."""
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(i):
        if i != "bias" and abs(z[i]) <= how.l1:
            return 0.0
        return (math.copysign(how.l1, z[i]) * (z[i] != 0) - z[i]) / ((how.beta + math.sqrt(n[i])) / how.alpha + how.l2)

    order = np.random.default_rng(17)
    for _ in range(how.epochs):
        for k in order.permutation(len(rows)):
            x, y = [*rows[k][0].tolist(), "bias"], rows[k][1]
            w = {i: weight(i) for i in x}
            g = 1 / (1 + math.exp(-max(-35, min(35, sum(w.values()))))) - y
            for i in x:
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / how.alpha
                z[i] += g - sigma * w[i]
                n[i] += g * g
    return weight("bias"), {i: weight(i) for i in z if i != "bias" and abs(z[i]) > how.l1}


def test_toxicity_against_plain_ftrl():
    rng = np.random.default_rng(8)
    rows = [(np.unique(np.append(rng.integers(0, 300, 20), 300 + y)), y) for y in rng.integers(0, 2, 150).tolist()]
    how = toxicity.Ftrl(bits=12, l1=0.5)
    model = toxicity.train(rows, how)
    bias, weights = plain_ftrl(rows, how)
    assert abs(model.bias - bias) < 1e-3
    got = dict(zip(model.index.tolist(), model.weight.tolist()))
    for i in set(got) | set(weights):
        assert abs(got.get(i, 0.0) - weights.get(i, 0.0)) < 2e-3


def test_toxicity_features_and_repeated_ids(spark):
    words = b"you ARE, a scum".translate(toxicity.TABLE).split()
    memo = toxicity.WordHashes()
    index, owner = toxicity.features(*toxicity.word_hashes([b"you ARE, a scum", b"", b"you are"], memo, toxicity.TABLE), 22)
    assert len(words) == 4 and np.bincount(owner, minlength=3).tolist() == [4 + 3 + 2, 0, 2 + 1]
    rows = [(i, f"good {i}") for i in range(20)] + [(50, "bad thing"), (50, "other text")] * 3
    labels = spark.createDataFrame([(i, 0) for i in range(20)] + [(50, 1)], "doc_id long, toxic int")
    models = [toxicity.fit(spark.createDataFrame(r, "doc_id long, text string").repartition(k), labels, how=toxicity.Ftrl(l1=0.1)) for r, k in ((rows, 1), (rows[::-1], 5))]
    assert models[0].bias == models[1].bias and (models[0].index == models[1].index).all() and (models[0].weight == models[1].weight).all()


@pytest.mark.parametrize("name", ["toxicity", "language_id", "near_dedup", "decontamination"])
def test_stages_keep_all_columns(spark, messy, name, tmp_path):
    """Clashing names, null ids, repeated rows and empty tables pass through every filtering stage."""
    import corpus_pipeline

    stage = dict(corpus_pipeline.STAGES)[name]
    spark.createDataFrame([(k, BASE if k % 2 else "une histoire", "en" if k % 2 else "fr", "s", 1) for k in range(30)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "long words here long words here long words")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clash = messy.withColumns({c: F.lit("mine") for c in ("_toxicity", "lang_pred", "_lang", "_lang_score", "lang_rejected", "_text_of_id", "version", "group", "h", "item", "digest", "leak", "s")})
    left = stage(spark, clash, str(tmp_path))
    assert left.columns == clash.columns
    kept = collections.Counter((r["doc_id"], r["text"]) for r in left.collect())
    assert not kept - collections.Counter(plain(messy)) and all(r["_toxicity"] == r["lang_pred"] == r["leak"] == "mine" for r in left.collect())
    gone = {i for i, _ in plain(messy)} - {i for i, _ in kept}
    if name in ("toxicity", "decontamination", "near_dedup"):
        assert gone == {"toxicity": set(), "decontamination": {10}, "near_dedup": {2, 3, 8}}[name]
    else:
        assert {4, 5, 6} <= gone and 1 not in gone and kept[(11, messy.where("doc_id = 11").first()["text"])] in (0, 2)
    assert stage(spark, clash.limit(0), str(tmp_path)).count() == 0


def base_places(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    found = [(k, label) for phrase, label in license_scan.PHRASES for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
    at = [k for k, _ in found]
    return len(w), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


def test_license_scan(spark, messy):
    rows = license_scan.scan_licenses(messy).collect()
    assert collections.Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in rows) == collections.Counter((i, *base_places(t)) for i, t in plain(messy))
    by = {r["doc_id"]: r for r in rows}
    assert by[12]["labels"] == "apache-2" and by[12]["base_labels"] == "" and 0.75 <= by[12]["score"] < 1 and by[4]["score"] == 0
    assert license_scan.scan_licenses(messy.limit(0)).count() == 0


def test_license_phrases_are_the_contracts(spark):
    rows = [(1, "MIT License"), (2, "x Under the MIT-License, under_the mit license"), (3, "under a mit license"), (4, "Apache License, Version 2; CC-BY-NC")]
    got = license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).drop("score").collect()
    assert sorted(map(tuple, got)) == [(1, 2, 0, None, None, "", "mit"), (2, 9, 2, 1, 5, "mit", "mit"), (3, 4, 0, None, None, "", "mit"), (4, 7, 2, 0, 4, "apache-2,cc-by-nc", "apache-2,cc-by-nc")]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_duckdb(spark, name):
    check(spark, queries.queries()[name], queries.oracle_sql()[name], "sf0.001")


def test_pipeline(spark):
    import corpus_pipeline

    got = corpus_pipeline.run(spark, f"{DATA}/sf0.001")
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    kept = {r["doc_id"] for r in got.select("doc_id").distinct().collect()}
    leaks = {r["doc_id"] for r in decontam.decontam_query(spark, f"{DATA}/sf0.001").collect()}
    assert 0.7 * docs.count() < len(kept) < docs.count() and not kept & leaks
    copies = docs.where(F.col("doc_id").isin(list(kept))).groupBy("text").count().where("count > 1")
    assert copies.isEmpty()


def plain_scan(text, slack=2, cover=0.75, stretch=1.5):
    """Labels and score by walking over every template, without hashes or joins."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    base = base_places(text)
    labels, best = set(filter(None, base[4].split(","))), 1.0 if base[1] else 0.0
    for notice, label in license_scan.NOTICES:
        t = notice.split()
        lines = collections.defaultdict(list)
        for at in range(len(t) - 1):
            for p in range(len(w) - 1):
                if w[p : p + 2] == t[at : at + 2]:
                    lines[p - at].append((at, p))
        spans, before = [], None
        for d in sorted(lines):
            lo, hi = min(p for _, p in lines[d]), max(p for _, p in lines[d])
            if before is None or d - before[0] > slack or lo - before[1] > len(t) - 1:
                spans.append([])
            spans[-1] += lines[d]
            before = d, hi
        for span in spans:
            first = [(at, min(p for a, p in span if a == at)) for at in sorted({a for a, _ in span})]
            rising = [x for k, x in enumerate(first) if k == 0 or x[1] > first[k - 1][1]]
            ps = [p for _, p in rising]
            if max(ps) - min(ps) + 1 <= (len(t) - 1) * stretch:
                best = max(best, len(rising) / (len(t) - 1))
                if len(rising) >= cover * (len(t) - 1):
                    labels.add(label)
    return ",".join(sorted(labels)), round(best, 9)


def test_license_scan_against_plain_walks(spark, messy):
    rng = np.random.default_rng(12)
    notices = [t.split() for t, _ in license_scan.NOTICES]
    rows = [(1, "the license " * 15), (2, "the license of the software " * 6), (3, None), (4, license_scan.NOTICES[0][0].upper())]
    for k in range(80):
        own = list(notices[k % len(notices)])
        for _ in range(int(rng.integers(0, 6))):
            at = int(rng.integers(0, len(own)))
            own[at : at + int(rng.integers(0, 2))] = ["odd"] * int(rng.integers(0, 3))
        if k % 5 == 0:
            own = own + notices[(k + 3) % len(notices)] + own[: len(own) // 2]
        if k % 7 == 0:
            own = own[::-1]
        rows.append((10 + k, " ".join(["some", "words"] * int(rng.integers(0, 4)) + own + ["the", "end"])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(messy.select("doc_id", "text"))
    got = license_scan.scan_licenses(docs).collect()
    want = collections.Counter((i, *plain_scan(t)) for i, t in plain(docs))
    assert collections.Counter((r["doc_id"], r["labels"], round(r["score"], 9)) for r in got) == want
    assert next(r["labels"] for r in got if r["doc_id"] == 1 and r["n_words"] == 30) == ""


def test_odd_json_in_messages(spark):
    call = lambda i, a: '{"tool_calls": [{"id": "%s", "name": "reply", "arguments": %s}]}' % (i, a)
    rows = [(1, 0, "assistant", call("a", '{"prompt": "\\ud800"}')), (1, 1, "tool", '{"tool_call_id": "a", "content": "x\\udfff"}'), (2, 0, "assistant", call("n", "NaN")), (3, 0, "assistant", call("d", "[" * 60000 + "]" * 60000)), (4, 0, "assistant", call("\\ud801", '{"prompt": "\\ud83d\\ude00"}')), (5, 0, "assistant", call("e", "1e999"))]
    got = {(r["conv_id"], r["call_id"]): r for r in chat.link_tool_calls(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("name", F.lit(1))).collect()}
    linked = got[1, "a"]
    assert linked["status"] == "linked" and linked["valid"] and json.loads(linked["json"])["arguments"] == {"prompt": "\ud800"} and "\\udfff" in linked["json"]
    assert json.loads(got[4, "\\ud801"]["json"])["arguments"] == {"prompt": "\U0001f600"}
    assert all("NaN" not in r["json"] or r["name"] is None for r in got.values()) and {k[0] for k in got} == {1, 2, 3, 4, 5}
    for r in got.values():
        json.loads(r["json"], parse_constant=lambda x: 1 / 0)

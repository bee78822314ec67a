"""The other operators against brute force, round trips and held-out accuracy, with odd rows."""

import glob
import hashlib
import math
import os
import tracemalloc
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ondaframe.llm import components, ecoc_langid, ftrl_toxicity, interleaved, lsh_forest, probminhash, queries, url_gbt, warc_files, warc_revisits

SF = "/root/testdata/sf0.01"
ODD_DOCS = [(1, None, "en", 9), (2, "", "fr", 9), (2, "", "fr", 9), (3, "x" * 200_000, "en", 9), (4, "one two", None, 9), (5, "one two", None, 9), (None, "one two", "en", 9), (6, " \n ", "es", 9), (7, "é 漢字 \U0001f600", "de", 9), (8, None, None, 9)]
ODD_SCHEMA = "doc_id bigint, text string, lang string, score int"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD_DOCS, ODD_SCHEMA)



def test_media_of_documents(spark, odd):
    rows = interleaved.document_media(odd).collect()
    assert len(rows) == len(ODD_DOCS)
    want = sorted((d is not None, d or 0, (t or "")) for d, t, *_ in ODD_DOCS)
    texts = {}
    for _, d, t in want:
        texts.setdefault(d, set()).add(t)
    for r in rows:
        t = next(iter(texts[r.doc_id or 0])).encode()
        size = max(1, -(-len(t) // 576)) * 576
        p = t + b"\xff" * (size - len(t))
        m = b"P5\n576 %d\n255\n" % (size // 576) + p
        assert (r.n_bytes, r.payload_bytes, r.media_bytes) == (len(t), size, len(m))
        assert r.payload_sha256 == hashlib.sha256(p).hexdigest() and r.media_sha256 == hashlib.sha256(m).hexdigest()
        assert r.tail_crc32 == zlib.crc32(p[-32:])
        assert r.feature == interleaved.feature(interleaved.read_stored(m)) and r.pos == 1 and r.caption == f"{len(t)} bytes & padding"
    assert interleaved.document_media(odd.limit(0)).count() == 0


def test_parsing_keeps_order_positions_and_captions():
    html = '<html><head><title>no</title></head><body>Lead <b>in</b><script>x="<p>"</script><p>A &amp; B<img src="a.png" alt="alt a">after</p><figure><figcaption>Cap <i>first</i></figcaption><img src="sha256:b"><img src="c"></figure><figure><video src="d"></video><figcaption>later</figcaption></figure><img><p>End'
    got = [(i["pos"], i["kind"], i["text"] or i["ref"], i["caption"]) for i in interleaved.parse(html)]
    assert got == [(0, "text", "Lead in", None), (1, "text", "A & B", None), (2, "media", "a.png", "alt a"), (3, "text", "after", None), (4, "media", "sha256:b", "Cap first"), (5, "media", "c", "Cap first"), (6, "media", "d", "later"), (7, "text", "End", None)]
    for html in ("<html><head><title>t</title><body><p>hi</p><img src='a'></body></html>", "<head><title>t</title><p>hi<img src='a'>", "<noscript><p>hi<img src='a'>", "<p>hi</p><template><img src='a'>", "<html><head><noscript><link></head><body>hi<img src='a'>"):
        assert [i["text"] or i["ref"] for i in interleaved.parse(html) if i["text"] != "t"] == ["hi", "a"], html
    assert interleaved.parse("a<script>x<p>b") == interleaved.parse("a")
    assert interleaved.parse(None) == interleaved.parse("") == interleaved.parse("<p></p>") == []


def test_resolving_by_digest(spark):
    seq = spark.createDataFrame([(1, "<p>t</p><img src='sha256:aa'><img src='sha256:zz'><img src='http://x'>"), (2, None), (3, "<img src='sha256:aa'>")], "k bigint, html string")
    media = spark.createDataFrame([("aa", 10), ("aa", 10), ("bb", 11)], "digest string, size int")
    got = {(r.k, r.pos): r.size for r in interleaved.resolve(interleaved.parse_sequences(seq, "k"), media, "k", "digest", ["size"]).collect()}
    assert got == {(1, 0): None, (1, 1): 10, (1, 2): None, (1, 3): None, (2, None): None, (3, 0): 10}


def test_hot_digests_resolve_like_others(spark):
    seq = spark.createDataFrame([(k, f"<img src='sha256:{'aa' if k % 3 else 'b' + str(k)}'>") for k in range(900)], "k bigint, html string")
    media = spark.createDataFrame([("aa", 1)] * 5 + [(f"b{k}", k) for k in range(0, 900, 6)], "digest string, size int")
    got = {r.k: r.size for r in interleaved.resolve(interleaved.parse_sequences(seq, "k"), media, "k", "digest", ["size"]).collect()}
    assert got == {k: 1 if k % 3 else k if k % 6 == 0 else None for k in range(900)}
    with pytest.raises(ValueError):
        interleaved.resolve(interleaved.parse_sequences(seq, "k"), media.withColumnRenamed("size", "text"), "k", "digest", ["text"])


def test_pages_parse_whole(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    rows = interleaved.parse_sequences(pages, "page_id").collect()
    assert len(rows) == pages.count() and all(r["items"] for r in rows)
    assert not any("track(" in (i.text or "") for r in rows for i in r["items"])


def test_revisits_as_the_sql(spark):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    got = queries.op2_warc_revisits(spark, SF)
    cols = sorted(got.columns)
    want = con.execute(f"select {', '.join(cols)} from ({queries.ORACLE_SQL['op2_warc_revisits']})").fetchall()
    key = lambda r: tuple("" if x is None else str(x) for x in r)
    assert sorted(map(key, got.select(*cols).collect())) == sorted(map(key, want))


def test_revisits_of_odd_records(spark):
    h = {"etag": "a", "content-length": "5", "x": "1"}
    u = "HTTP://www.Ex.org/p/?utm_source=q&b=1#f"
    rows = [
        (1, "response", u, 10, 200, "a", "m", h, "d1"), (2, "response", "https://ex.org/p/?b=1", 20, 200, "b", "m2", {}, "d2"), (9, "response", "https://ex.org/p/?b=1", 20, 200, "c", "m3", None, "d9"),
        (3, "revisit", u, 20, 304, "W/a", None, {"date": "now", "content-length": "0"}, None), (4, "revisit", u, 21, 304, None, "m3", {}, None), (5, "revisit", u, 21, 304, None, None, None, None),
        (6, "revisit", u, 10, 304, "a", None, {}, None), (7, "revisit", None, 30, 304, "a", None, {}, None), (8, "revisit", u, None, 304, "a", None, {}, None), (4, "revisit", u, 21, 304, None, "m3", {}, None), (10, "response", u, None, 200, "z", None, {}, "dz"),
    ]
    df = spark.createDataFrame(rows, "record_id int, kind string, url string, ts int, status int, etag string, last_modified string, headers map<string,string>, digest string")
    for buckets in (1, 3, 256):
        got = warc_revisits.resolve(df, buckets).collect()
        assert len(got) == 7
        by = {r.record_id: r for r in got}
        assert {k: (r.outcome, r.response_id, r.digest) for k, r in by.items()} == {3: ("resolved", 1, "d1"), 4: ("resolved", 9, "d9"), 5: ("mismatch", 9, None), 6: ("orphan", None, None), 7: ("orphan", None, None), 8: ("orphan", None, None)}
        assert by[3].headers == {"etag": "a", "content-length": "5", "x": "1", "date": "now"}
    assert warc_revisits.resolve(df.limit(0)).count() == 0


def test_canonical_urls(spark):
    same = [
        ("http://A.com:80/y", "a.com/y"), ("https://a.com:443/y/", "http://www.a.com/y#f"), ("http://a.com/b/../y/./z", "a.com/y/z"), ("http://a.com/%c3%a9?q=%2f", "http://a.com/%C3%A9?q=%2F"),
        ("http://a.com/../../y", "a.com/y"), ("http://a.com/?utm_source=x", "a.com"),
    ]
    apart = [("http://a.com:8080/y", "http://a.com/y"), ("https://a.com:80/y", "https://a.com/y"), ("http://a.com/?a=1&b=2", "http://a.com/?b=2&a=1"), ("http://a.com/%zz", "http://a.com/%ZZ"), ("http://a.com/.y", "http://a.com/y")]
    df = spark.createDataFrame(same + apart, "a string, b string")
    got = [r.on for r in df.select((warc_revisits.canonical(F.col("a")) == warc_revisits.canonical(F.col("b"))).alias("on")).collect()]
    assert got == [True] * len(same) + [False] * len(apart)


def test_only_full_responses_count(spark):
    rows = [(1, "response", "a.com/y", 10, 200, "a"), (2, "response", "a.com/y", 11, 500, "a"), (3, "response", "a.com/y", 12, 206, "a"), (4, "response", "a.com/y", 13, None, "a"), (5, "revisit", "http://a.com:80/y", 14, 304, "a")]
    df = spark.createDataFrame([(*r, None, {}, f"d{r[0]}", "x", 1) for r in rows], "record_id int, kind string, url string, ts int, status int, etag string, last_modified string, headers map<string,string>, digest string, outcome string, bucket int")
    assert [(r.outcome, r.response_id, r.digest) for r in warc_revisits.resolve(df).collect()] == [("resolved", 1, "d1")]


def test_warc_files_round_trip(spark, tmp_path):
    rows = [
        ("<urn:1>", "response", "http://a.com/y", 1_700_000_000, 200, {"etag": '"x"', "last-modified": "d"}, "sha1:A", b"<p>\r\n\r\nbytes \xff\x00</p>"), ("<urn:2>", "revisit", "http://a.com:80/y", 1_700_000_100, 304, {"etag": 'W/"x"', "date": "now"}, None, None),
        ("<urn:3>", "response", None, None, 404, None, None, b""), ("<urn:4>", "metadata", "http://a.com/y", 1_700_000_000, 200, {}, None, b"left out"),
    ]
    schema = "record_id string, kind string, url string, ts bigint, status int, headers map<string,string>, digest string, payload binary"
    warc_files.write(spark.createDataFrame(rows, schema).coalesce(1), str(tmp_path / "w"))
    back = warc_files.read(spark, str(tmp_path / "w"))
    got = {r.record_id: r for r in back.collect()}
    assert sorted(got) == ["<urn:1>", "<urn:2>", "<urn:3>"] and all(r.whole for r in got.values())
    for i, kind, url, ts, status, headers, digest, payload in rows[:3]:
        r = got[i]
        assert (r.kind, r.url, r.ts, r.status, r.headers, r.digest, bytes(r.payload)) == (kind, url, ts, status, headers or {}, digest, payload or b"")
    assert [(r.outcome, r.response_id, r.headers["date"]) for r in warc_revisits.resolve(back).collect()] == [("resolved", "<urn:1>", "now")]


def brute_classes(docs):
    sh = probminhash.Shingler(5)
    prof, by_text, parent, where = {}, {}, {}, {}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for d, t in docs:
        parent[d], prof[d] = d, sh.shingles(t)
        if t in by_text:
            parent[find(d)] = find(by_text[t])
        by_text[t] = d
        for k in prof[d][0].tolist():
            where.setdefault(k, []).append(d)
    for a, b in {(x, y) for ds in where.values() for x in ds for y in ds if x < y}:
        if find(a) != find(b) and probminhash.probability_jaccard(*prof[a], *prof[b]) >= 0.8 - 1e-12:
            parent[find(a)] = find(b)
    groups = {}
    for d, _ in docs:
        groups.setdefault(find(d), []).append(d)
    return {d: min(g) for g in groups.values() for d in g}


def test_near_duplicates_as_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute_classes([(r.doc_id, r.text) for r in docs.collect()])
    assert {r.doc_id: r.class_id for r in probminhash.classes(docs).collect()} == want


def test_near_duplicates_of_chains_hubs_and_odd_rows(spark, odd):
    rnd = np.random.default_rng(3)
    words = [f"w{i}" for i in range(3000)]
    base = [words[i] for i in rnd.integers(0, 3000, 300)]
    docs, now = [], list(base)
    for k in range(12):  # each close to the next, the ends far apart
        docs.append((100 + k, " ".join(now)))
        for i in rnd.integers(0, 300, 5):
            now[i] = words[rnd.integers(0, 3000)]
    shared = " ".join(base[:60])
    for k in range(40):  # a passage in common, no more
        docs.append((200 + k, shared + " " + " ".join(words[i] for i in rnd.integers(0, 3000, 60))))
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    for block in (4, 2048):
        s = probminhash.Settings(block=block, broadcast_ids=1 if block == 4 else 1000)
        assert {r.doc_id: r.class_id for r in probminhash.classes(df, s).collect()} == brute_classes(docs)
    got = sorted(((r.doc_id, r.class_id) for r in probminhash.classes(odd).collect()), key=str)
    assert got == sorted([(1, 1), (2, 1), (2, 1), (8, 1), (3, 3), (4, 4), (5, 4), (None, 4), (6, 6), (7, 7)], key=str)
    assert probminhash.classes(odd.limit(0)).count() == 0


def test_probability_jaccard_and_its_estimate():
    rnd = np.random.default_rng(0)
    off = []
    for _ in range(60):
        keys = np.sort(rnd.integers(0, 2**63, 200).astype(np.uint64))
        a, b = rnd.integers(0, 4, 200).astype(float), rnd.integers(0, 4, 200).astype(float)
        j = probminhash.probability_jaccard(keys[a > 0], a[a > 0], keys[b > 0], b[b > 0])
        brute = sum(1 / np.maximum(a / a[i], b / b[i]).sum() for i in range(200) if a[i] and b[i])
        assert abs(j - brute) < 1e-9
        own = np.concatenate([np.zeros((a > 0).sum(), int), np.ones((b > 0).sum(), int)])
        s = probminhash.sketch(np.concatenate([keys[a > 0], keys[b > 0]]), np.concatenate([a[a > 0], b[b > 0]]), own, 2, 256)
        off.append((s[0] == s[1]).mean() - j)
    assert abs(np.mean(off)) < 0.02 and np.std(off) < 0.05


def test_components_of_long_and_wide_graphs(spark):
    chain = [(i, i + 1) for i in range(70)]
    star = [(1000, 1000 + i) for i in range(1, 60)]
    df = spark.createDataFrame(chain[::-1] + star + [(5, 5), (2000, 2001), (2001, 2000)], "u bigint, v bigint")
    want = {i: 0 for i in range(1, 71)} | {1000 + i: 1000 for i in range(1, 60)} | {2001: 2000}
    assert {r.u: r.label for r in components.components(df).collect()} == want
    assert components.components(df.limit(0)).count() == 0


def exact_nearest(x, q, k):
    d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
    d[q] = np.inf
    return np.lexsort((np.arange(len(d)), d))[:k], d


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_forest_recall(spark, sf):
    rows = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").orderBy("vec_id").collect()
    x = np.array([r.embedding for r in rows], dtype=float)
    got = {}
    for r in queries.op6_lsh_forest(spark, f"/root/testdata/{sf}").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = []
    for q, found in got.items():
        near, d = exact_nearest(x, q, 10)
        assert [f[0] for f in sorted(found)] == list(range(1, 11))
        assert all(abs(s - d[v]) < 1e-12 for _, v, s in found)
        assert [(s, v) for _, v, s in sorted(found)] == sorted((s, v) for _, v, s in found)
        hits.append(len({v for _, v, _ in found} & set(near.tolist())) / 10)
    assert len(got) == -(-len(x) // 100) and np.mean(hits) >= 0.9


def test_forest_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, []), (8, [0.5, 0.0, 0.0]), (9, [1.0, 1.0]), (1, [1.0, 0.0]), (None, [1.0, 2.0]), (100, [-1.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1.0) for i, v in rows], "vec_id bigint, embedding array<float>, score double")
    v = lsh_forest.usable(df, "vec_id", "embedding")
    got = [(r.query_id, r["rank"], r.vec_id) for r in lsh_forest.search(v, v.where(F.pmod("id", F.lit(100)) == 0), 3).collect()]
    assert sorted(got) == [(0, 1, 1), (0, 2, 1), (0, 3, 9), (100, 1, 0), (100, 2, 1), (100, 3, 1)]
    assert lsh_forest.search(v.limit(0), v, 3).count() == 0 and lsh_forest.search(v, v.limit(0), 3).count() == 0
    small = lsh_forest.Settings(shard=2, block=1)
    again = [(r.query_id, r["rank"], r.vec_id) for r in lsh_forest.search(v, v.where(F.pmod("id", F.lit(100)) == 0), 3, small).collect()]
    assert sorted(again) == sorted(got)


def test_forest_of_equal_vectors(spark):
    x = np.random.default_rng(5).standard_normal((500, 64))
    for at, copies in ((0, 7), (100, 8), (200, 9), (300, 10), (400, 12)):
        x[at : at + copies] = x[at]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id bigint, v array<double>").coalesce(1)
    got, hits = {}, []
    for r in lsh_forest.search(df, df.where(F.pmod("id", F.lit(100)) == 0), 10).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    for q, copies in ((0, 7), (100, 8), (200, 9), (300, 10), (400, 12)):
        found = [v for _, v in sorted(got[q])]
        assert len(found) == 10 and found[: copies - 1] == list(range(q + 1, q + copies))[:10]
        d = np.linalg.norm(x - x[q], axis=1)
        d[q] = np.inf
        hits.append(len(set(found) & set(np.lexsort((np.arange(500), d))[:10].tolist())) / 10)
    assert np.mean(hits) >= 0.9


def test_toxicity_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.y for r in spark.read.parquet(f"{sf}/labels.parquet").groupBy("doc_id").agg(F.max("toxic").alias("y")).collect()}
    rows = queries.op7_ftrl_toxicity(spark, sf).collect()
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert sum(r.predicted == labels[r.doc_id] for r in held) / len(held) > 0.97
    assert sum(r.predicted and not labels[r.doc_id] for r in held) <= 0.005 * len(held)


def test_toxicity_of_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 0), (3, 1), (3, 0), (4, None), (None, 1), (99, 1)], "doc_id bigint, toxic int")
    for known in (labels, labels.limit(0)):
        model = ftrl_toxicity.fit(odd, known, F.lit(True))
        rows = ftrl_toxicity.score(odd.withColumn("held", F.lit(True)), model, ["doc_id", "held", "lang"]).collect()
        assert len(rows) == len(ODD_DOCS) and all(0 <= r.score <= 1 for r in rows)
    assert ftrl_toxicity.score(odd.limit(0), model, ["doc_id"]).count() == 0


def plain_ftrl(rows, s):
    """FTRL-proximal, coordinate by coordinate."""
    z, n, bias, seen = {}, {}, 0.0, 0.0

    def weight(i):
        if abs(z.get(i, 0.0)) <= s.l1:
            return 0.0
        return -(z[i] - math.copysign(s.l1, z[i])) / ((s.beta + math.sqrt(n[i])) / s.alpha + s.l2)

    for _ in range(s.epochs):
        for idx, y in rows:
            w = {i: weight(i) for i in idx.tolist()}
            g = (1 / (1 + math.exp(-(bias + sum(w.values())))) - y) * (s.toxic_weight if y else 1)
            for i, wi in w.items():
                old = n.get(i, 0.0)
                n[i] = old + g * g
                z[i] = z.get(i, 0.0) + g - (math.sqrt(n[i]) - math.sqrt(old)) / s.alpha * wi
            seen += g * g
            bias -= s.alpha * g / (s.beta + math.sqrt(seen))
    return bias, {i: weight(i) for i in z if weight(i)}


def test_training_is_plain_ftrl():
    rnd = np.random.default_rng(8)
    rows = [(np.unique(rnd.integers(0, 64, 12) + 40 * y), int(y)) for y in rnd.integers(0, 2, 150)]
    s = ftrl_toxicity.Settings(bits=8, l1=0.5, epochs=2)
    bias, idx, w = ftrl_toxicity.train(rows, s)
    want_bias, want = plain_ftrl(rows, s)
    assert abs(bias - want_bias) < 1e-9 and sorted(want) == idx.tolist() and 0 < len(want) < 104
    assert np.allclose([want[i] for i in idx.tolist()], w, atol=1e-9)


def test_features_are_words_stems_pairs_and_skip_grams():
    h = ftrl_toxicity.WordHasher()
    a, b, c = h.words("Alpha beta"), h.words("beta, -- gamma!"), h.words("alpha BETA gamma")
    assert len(ftrl_toxicity.features(a, 20)) == 6 + 1 and len(ftrl_toxicity.features(c, 20)) == 9 + 2 + 1
    both = set(ftrl_toxicity.features(a, 20).tolist()) | set(ftrl_toxicity.features(b, 20).tolist())
    assert len(set(ftrl_toxicity.features(c, 20).tolist()) - both) == 1  # the skip-gram


def test_toxicity_unpacks_few_texts_at_a_time(spark, monkeypatch):
    """Scoring a batch of 32 MB of text takes far less than that in Python objects, and batches out are small."""
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    caught = []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema, *more: caught.append(f) or self)
    model = (-1.0, np.array([ftrl_toxicity.features(ftrl_toxicity.WordHasher().words("bad"), 20)[0]], np.int32), np.array([5.0]))
    ftrl_toxicity.score(docs, model, ["doc_id"])
    texts = [f"{'good ' * 1600}{'bad' if k % 2 else ''}" for k in range(4000)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(range(4000), pa.int64())], ["_t", "doc_id"])
    assert batch.nbytes > 30 << 20
    del texts
    tracemalloc.start()
    before = tracemalloc.get_traced_memory()[0]
    got = list(caught[0](iter([batch])))
    peak = tracemalloc.get_traced_memory()[1] - before
    tracemalloc.stop()
    assert peak < 20 << 20 and max(b.num_rows for b in got) <= 256
    assert [y for b in got for y in b.column(2).to_pylist()] == [0, 1] * 2000


def test_language_on_held_out_documents(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    rows = queries.op9_ecoc_langid(spark, SF).collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.98 and all(0 <= r.score <= 1 for r in rows)


def test_language_of_odd_rows(spark, odd):
    model = ecoc_langid.fit(odd, F.lit(True))
    rows = {(r.doc_id, r.lang): r for r in ecoc_langid.predict(odd, model, ["doc_id", "lang"]).collect()}
    assert rows[1, "en"].lang_pred == rows[2, "fr"].lang_pred == rows[6, "es"].lang_pred == "und"
    assert rows[7, "de"].lang_pred in ("en", "de", "es", "fr")
    none = ecoc_langid.fit(odd.where("lang = 'xx'"), F.lit(True))
    assert {r.lang_pred for r in ecoc_langid.predict(odd, none, ["doc_id"]).collect()} == {"und"}
    assert {r.lang_pred for r in ecoc_langid.predict(spark.createDataFrame([(1, "½ ²"), (2, "12 !")], "doc_id bigint, text string"), model, ["doc_id"]).collect()} == {"und"}
    assert ecoc_langid.predict(odd.limit(0), model, ["doc_id"]).count() == 0
    with pytest.raises(ValueError):
        ecoc_langid.predict(odd, model, ["score"])
    one = ecoc_langid.fit(odd.where("doc_id = 3"), F.lit(True))
    assert {r.lang_pred for r in ecoc_langid.predict(odd.where("doc_id = 3"), one, ["doc_id"]).collect()} == {"en"}


def test_every_language_is_learnt(spark):
    rnd = np.random.default_rng(4)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    docs = []
    for k in range(70):
        words = ["".join(rnd.choice(letters, rnd.integers(4, 9))) for _ in range(30)]
        docs += [(k * 100 + i, f"l{k:02}", " ".join(rnd.choice(words, 40))) for i in range(13 - (k > 60))]
    df = spark.createDataFrame(docs, "doc_id bigint, lang string, text string")
    model = ecoc_langid.fit(df, F.col("doc_id") % 100 > 1)
    assert len(model.languages) == len(model.codes) == 70
    rows = ecoc_langid.predict(df.where(F.col("doc_id") % 100 <= 1), model, ["doc_id", "lang"]).collect()
    assert len(rows) == 140 and sum(r.lang == r.lang_pred for r in rows) >= 138
    many = ecoc_langid.codewords(300).astype(int)
    assert many.shape == (300, 256) and ((many[:, None] != many).sum(axis=2) + 256 * np.eye(300, dtype=int)).min() > 80


def test_codewords_stay_apart():
    for n in range(2, 20):
        c = ecoc_langid.codewords(n).astype(int)
        assert c.shape[0] == n
        apart = [(c[i] != c[j]).sum() for i in range(n) for j in range(i)]
        assert min(apart) >= c.shape[1] / 2


def test_decoding_is_the_nearest_codeword(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(200)
    model = ecoc_langid.fit(docs, F.lit(True))
    s, table = ecoc_langid.Settings(), ecoc_langid.NgramTable(16, 4)
    w = np.zeros((1 << 16, model.codes.shape[1]))
    w[model.buckets] = model.weights
    bit = np.maximum(model.accuracy - 0.5, 1e-3) / np.maximum(model.accuracy - 0.5, 1e-3).sum()
    got = {r.doc_id: r for r in ecoc_langid.predict(docs, model, ["doc_id"]).collect()}
    for r in docs.collect():
        g = [x for word in (r.text or "").lower().split() for x in table.grams(word).tolist()]
        if not any(c.isalpha() for c in r.text or ""):
            assert got[r.doc_id].lang_pred == "und"
            continue
        margin = w[g].sum(axis=0) / len(g)
        loss = [sum(np.log1p(np.exp(-k * m)) * b for k, m, b in zip(code, margin, bit, strict=True)) for code in model.codes.astype(float)]
        share = np.exp(-8 * np.array(loss)) / np.exp(-8 * np.array(loss)).sum()
        order = np.sort(share)
        assert abs(got[r.doc_id].score - order[-1]) < 1e-4
        if order[-1] - order[-2] > 1e-3:
            assert got[r.doc_id].lang_pred == model.languages[int(share.argmax())] and abs(order[-1] - order[-2] - s.margin) < 1e-3 or got[r.doc_id].ambiguous == bool(order[-1] - order[-2] < s.margin)


def plain_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    path = rest[cut:]
    end = min([path.find(c) for c in "?#" if c in path] or [len(path)])
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), path[:end]


def plain_rule(host, path):
    fit = [(len(r), r, v) for r, v in queries.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return max(fit)[1:] if fit else (None, None)


def test_url_rules_and_verdicts(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    rows = queries.op8_url_gbt(spark, SF).collect()
    url = {r.page_id: r.url for r in pages.collect()}
    assert len(rows) == len(url)
    for r in rows:
        host, path = plain_url(url[r.page_id])
        rule, verdict = plain_rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or ("block" if r.score >= 0.5 else "allow"))
    plan = queries.op8_url_gbt(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_trees_learn_the_rules(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    host, path = url_gbt.parts(F.col("url"))
    cut = pages.select("page_id", "url", host.alias("host"), path.alias("path")).withColumn("r", url_gbt.rule_of(F.col("host"), F.col("path"), queries.RULES)).where("r is not null").withColumn("y", (F.col("r.verdict") == "block").cast("int"))
    test = F.pmod(F.xxhash64("page_id"), F.lit(4)) == 0
    model = url_gbt.fit(cut.where(~test).select("url", "host", "path", "y"))
    got = url_gbt.score(cut.where(test), model).select("y", "score").collect()
    assert sum((r.score >= 0.5) == r.y for r in got) / len(got) > 0.9


def test_a_tree_takes_the_best_splits(spark):
    rnd = np.random.default_rng(2)
    x = rnd.integers(0, 4, (300, 3))
    g, h = rnd.normal(size=300) + (x[:, 1] > 1) * (1 + x[:, 0]), rnd.random(300)
    s = url_gbt.Settings()
    df = spark.createDataFrame([(*map(int, r), float(a), float(b)) for r, a, b in zip(x, g, h, strict=True)], "a int, b int, c int, g double, h double").coalesce(1)

    def grow(rows, depth):
        G, H = g[rows].sum(), h[rows].sum()
        best = None
        for k in range(3) if depth else ():
            for cut in range(3):
                low = rows[x[rows, k] <= cut]
                if 0 < len(low) < len(rows):
                    a, b = g[low].sum(), h[low].sum()
                    gain = a * a / (b + s.l2) + (G - a) ** 2 / (H - b + s.l2) - G * G / (H + s.l2)
                    if gain > 1e-6 and (best is None or gain > best[0] + 1e-9):
                        best = gain, k, cut
        if not best:
            return s.rate * G / (H + s.l2)
        _, k, cut = best
        return "abc"[k], cut, grow(rows[x[rows, k] <= cut], depth - 1), grow(rows[x[rows, k] > cut], depth - 1)

    def same(a, b):
        return abs(a - b) < 1e-9 if not isinstance(a, tuple) else a[:2] == b[:2] and same(a[2], b[2]) and same(a[3], b[3])

    assert same(grow(np.arange(300), s.depth), url_gbt._grow(df, ["a", "b", "c"], s))


def test_odd_urls(spark):
    urls = [None, "", "no scheme/x", "http://", "HTTP://EXAMPLE.ORG/es/1", "a://b.com?x=1#y", "x://org/en/1", "http://é.İ.com/fr/é?a&b", "http://a.com/" + "d1-" * 20000, "http://notcom/fr/", "u://h\n.com/de/\nx"]
    df = spark.createDataFrame([(i, u, "h", 1) for i, u in enumerate(urls)] + [(0, None, "h", 1)], "page_id bigint, url string, host string, score int")
    rows = url_gbt.judge(df, queries.RULES).collect()
    assert len(rows) == len(urls) + 1
    for r in rows:
        assert (r.host, r.path) == plain_url(urls[r.page_id]) and r.rule == plain_rule(r.host, r.path)[0] and r.verdict in ("allow", "block")
    assert url_gbt.judge(df.limit(0), queries.RULES).count() == 0


def test_pipeline_keeps_clean_documents_and_packs_them(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before, now = {r.doc_id for r in docs.collect()}, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, SF).cache()
        assert now.columns == columns
        kept = {r.doc_id for r in now.select("doc_id").collect()}
        assert kept <= before
        gone = before - kept
        if name == "toxicity":
            marked = [d for d in gone if d in labels]  # most documents have no label
            assert sum(labels[d] == 1 for d in marked) >= 0.9 * len(marked) > 0 and len(gone) < 0.2 * len(before)
        if name == "language":
            assert len(gone) < 0.02 * len(before)
        if name == "near_duplicates":
            want = brute_classes([(r.doc_id, r.text) for r in last.collect()])
            assert kept == set(want.values())
        before, last = kept, now
    packed = corpus_pipeline.STAGES[-1][1](spark, now, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == before
    assert corpus_pipeline.run(spark, SF).select("doc_id").distinct().count() == len(before)


def test_pipeline_keeps_documents_of_close_languages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    words = {x: " ".join(r.text for r in docs.where((F.col("lang") == x) & F.col("text").isNotNull()).orderBy("doc_id").limit(20).collect()).split() for x in ("de", "en", "es", "fr")}
    mixed = [(1_000_000 + k, " ".join([*words[a][k * 9 : k * 9 + 9], *words[b][k * 9 : k * 9 + 9]]), None) for a, b in (("en", "fr"), ("de", "es")) for k in range(100)]
    both = docs.unionByName(spark.createDataFrame([(d + 1000 * (k >= 100), t, x) for k, (d, t, x) in enumerate(mixed)], "doc_id bigint, text string, lang string"))
    kept = {r.doc_id for r in corpus_pipeline.language(spark, both, SF).select("doc_id").collect()}
    assert kept == {r.doc_id for r in both.collect() if r.text and any(c.isalpha() for c in r.text)}


def test_pipeline_keeps_one_row_of_each_class(spark):
    import corpus_pipeline

    rnd = np.random.default_rng(6)
    a, b, c, d, e, f = (" ".join(f"w{i}" for i in rnd.integers(0, 3000, 200)) for _ in range(6))
    near = a + " more"
    docs = [(7, a), (3, near), (3, near), (3, near), (None, near), (None, b), (None, b), (5, c), (None, c + " more"), (None, d), (None, d + " more"), (9, e), (9, f), (None, None), (4, "")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)
    kept = corpus_pipeline.near_duplicates(spark, df, SF)
    assert kept.columns == df.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    alike = [x for x in got if x[1] in (d, d + " more")]
    assert len(alike) == 1 and alike[0][0] is None
    assert sorted((x for x in got if x not in alike), key=str) == sorted([(3, near), (None, b), (5, c), (9, e), (9, f), (4, "")], key=str)


def test_pipeline_of_odd_rows(spark):
    import corpus_pipeline

    extra = "score int, predicted string, lang_pred string, ambiguous int, row int, at int, class_id int, h int, pos int"
    rows = [(*r[:3], "web", 5, *([k] + [str(k)] * 2 + [k] * 6)) for k, r in enumerate(ODD_DOCS)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, " + extra)
    want = df.where("text is not null and text rlike '[a-z漢]'")
    docs = df
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == df.columns and docs.dtypes == df.dtypes
    kept = {(r.doc_id, r.score) for r in docs.collect()}
    assert kept <= {(r.doc_id, r.score) for r in want.collect()} and {d for d, _ in kept} == {3, 4, 7}
    assert {r.doc_id for r in corpus_pipeline.packing(spark, docs, SF).collect()} == {3, 4, 7}
    none = df.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, SF)
        assert none.count() == 0


def test_word_sums_are_those_of_single_words():
    table = ecoc_langid.NgramTable(12, 4)
    w = np.random.default_rng(0).standard_normal((1 << 12, 3)).astype(np.float32)
    words = ["a", "été", "wort", "x" * 50, "漢字"]
    sums, count = table.word_sums(words, w)
    for k, x in enumerate(words):
        g = table.grams(x)
        assert count[k] == len(g) and np.allclose(sums[k], w[g].sum(axis=0), atol=1e-4)


def test_forest_recall_on_a_full_shard():
    """Uniform vectors, the hardest case: no prefix means much."""
    s = lsh_forest.Settings()
    x = np.random.default_rng(1).random((s.shard, 64))
    forest = lsh_forest.Forest(x, s)
    asked = np.arange(0, s.shard, 820)
    hits, seen = [], []
    for q, rows in zip(asked.tolist(), forest.candidates(x[asked], [np.array([q]) for q in asked.tolist()], 10), strict=True):
        near, _ = exact_nearest(x, q, 10)
        hits.append(len(np.intersect1d(near, rows)) / 10)
        seen.append(len(rows) / s.shard)
    assert np.mean(hits) >= 0.9 and np.mean(seen) < 0.75
    print(np.mean(hits), np.mean(seen))

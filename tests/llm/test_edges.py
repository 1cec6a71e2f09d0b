"""Nulls, empty and very long texts, ties, repeated rows, empty tables, extra columns with clashing names."""

import hashlib
import io
import time
import zipfile
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillon.llm import bloom, components, decontaminate, encoding, exact_dedup, licenses, near_dedup, packing, pii, quality, queries, sharding, token_files, warc
from quillon.llm.common import scratch_path

from . import brute

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau upsilon".split()
LONG = " ".join(WORDS[i * 7 % 20] + str(i % 977) for i in range(60_000))
TEXTS = [
    (1, None),
    (2, ""),
    (3, "  \n "),
    (4, "Same Text here with more than five words"),
    (5, "same text here with more than five words"),
    (6, LONG),
    (7, LONG + " tail"),
    (8, "one two"),
    (9, "ONE two"),
    (10, "mail a@b.io or +1 (743) 555-3824, 10.0.0.1 and 4111 1111 1111 1111"),
    (11, "é" * 50 + " <|endoftext|> naïve İstanbul ŽŽ 12.5€ it's o'clock'll"),
    (12, "Released under the MIT Licence!!"),
]
EXTRA = ["sha", "kept", "rep", "key", "component_id", "gone_id", "best", "nth", "n", "score", "shard", "slot"]


def docs(spark, rows):
    df = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string")
    return df.withColumns({c: F.lit(7) for c in EXTRA})


@pytest.fixture(scope="module")
def some(spark):
    return docs(spark, TEXTS).cache()


@pytest.fixture(scope="module")
def none(spark):
    return docs(spark, [])


@pytest.fixture(scope="module")
def bench(spark):
    rows = [(1, " ".join(LONG.split()[500:530])), (2, "one two"), (3, None), (4, ""), (2, "one two")]
    return spark.createDataFrame(rows, "item_id long, text string").withColumn("n", F.lit(1))


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_exact(some, none):
    got = {r.doc_id: r for r in exact_dedup.exact_groups(some).collect()}
    assert {i: r.keep_id for i, r in got.items()} == {1: 2, 2: 2, 3: 3, 4: 5, 5: 5, 6: 6, 7: 7, 8: 9, 9: 9, 10: 10, 11: 11, 12: 12}
    assert got[1].sha == hashlib.sha256(b"").digest()
    twice = exact_dedup.drop_exact(some.unionByName(some))
    assert twice.columns == some.columns
    assert sorted(r.doc_id for r in twice.collect()) == [2, 3, 5, 6, 7, 9, 10, 11, 12]
    assert exact_dedup.exact_groups(none).count() == 0 and exact_dedup.drop_exact(none).count() == 0
    again = exact_dedup.exact_groups(some.unionByName(some)).where("doc_id = 5").collect()
    assert sorted(r.kept for r in again) == [False, True] and again[0].group_size == 4


def test_near(some, none):
    assert {tuple(r) for r in near_dedup.near_components(some).select("doc_id", "n_shingles", "component_id").collect()} == {r[:3] for r in brute.near(TEXTS)}
    left = near_dedup.drop_near(some)
    assert left.columns == some.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(r[0] for r in brute.near(TEXTS) if r[3])
    assert near_dedup.near_components(none).count() == 0 and near_dedup.drop_near(none).count() == 0


def variants(n, changed, seed):
    draw = np.random.default_rng(seed)
    base = [f"w{i}" for i in range(200)]
    out = []
    for i in range(n):
        words = list(base)
        for k in draw.choice(200, changed, replace=False):
            words[k] = f"v{i}x{k}"
        out.append((1000 * seed + i, " ".join(words)))
    return out


def test_near_families(spark):
    """Families near the threshold: links that the pivot doesn't have are found by the exact rest."""
    chain = [f"c{i}" for i in range(260)]
    found = variants(40, 1, 1) + variants(40, 3, 2) + variants(40, 6, 3) + [(9000 + i, " ".join(chain[6 * i : 6 * i + 200])) for i in range(10)]
    got = {tuple(r) for r in near_dedup.near_components(docs(spark, found)).select("doc_id", "n_shingles", "component_id").collect()}
    assert got == {r[:3] for r in brute.near(found)}


def strangers(n, seed):
    """Texts that share many words in a row with variants(), too few to link."""
    draw = np.random.default_rng(seed)
    out = []
    for i in range(n):
        words = [f"w{k}" for k in range(200)]
        for k in draw.choice(200, 12, replace=False):
            words[k] = f"z{i}x{k}"
        out.append((i, " ".join(words)))
    return out


def emitted(monkeypatch, spark, found):
    """Components, and the rows of each kind of table that near_components() writes."""
    many, write = {}, near_dedup.materialise

    def noted(df, tag):
        out = write(df, tag)
        many[tag] = many.get(tag, 0) + out.count()
        return out

    monkeypatch.setattr(near_dedup, "materialise", noted)
    got = {tuple(r) for r in near_dedup.near_components(docs(spark, found)).select("doc_id", "n_shingles", "component_id").collect()}
    assert got == {r[:3] for r in brute.near(found)}
    return many


def test_near_pairs_stay_linear(spark, monkeypatch):
    """Low ids that link with nobody, in the buckets of a family that links: what is written grows with the rows, not with their square."""
    once = emitted(monkeypatch, spark, strangers(50, 8) + variants(40, 1, 1) + variants(40, 3, 2))
    four = emitted(monkeypatch, spark, strangers(150, 8) + variants(120, 1, 1) + variants(120, 3, 2))
    for tag in ("star", "links", "promising", "rest"):
        assert four.get(tag, 0) <= 6 * once.get(tag, 0) + 300, tag
    assert four["star"] <= 40 * 390 and four["links"] <= 20 * 390


def test_near_large_buckets(spark, monkeypatch):
    """Buckets of more than a block: further stars, and units of two blocks."""
    monkeypatch.setattr(near_dedup, "MEMBERS", 16)
    monkeypatch.setattr(near_dedup, "SHINGLES", 2000)
    emitted(monkeypatch, spark, strangers(70, 8) + variants(60, 3, 2) + variants(60, 6, 3))


def test_superminhash_estimates():
    draw = np.random.default_rng(5)
    pool = draw.integers(0, 2**63, 3000).astype(np.uint64)
    for size in (1, 3, 50, 1000):
        a, b = np.unique(pool[:size]), np.unique(pool[size // 4 : size + size // 4])
        x, y = near_dedup.superminhash([a, b], 400)
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((x == y).mean() - true) < 0.08
        assert (np.sort(x >> np.uint64(48))[-1] < 400) and (near_dedup.superminhash([a[::-1].copy()], 400)[0] == x).all()


def test_components(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 80), (7, 7)]
    got = dict(rows(components.connected_components(spark.createDataFrame(pairs, "a long, b long"))))
    assert got == {i: 0 for i in range(41)} | {80: 80, 90: 80, 100: 80}


def key_array(df):
    return np.array([r.key for r in df.collect()], dtype=np.int64).view(np.uint64)


def test_bloom(spark, monkeypatch):
    keys = spark.range(3000).select(F.xxhash64("id").alias("key"))
    have = key_array(keys)
    for most in (1 << 25, 500):  # one block, six blocks
        monkeypatch.setattr(bloom, "BLOCK_KEYS", most)
        filters = bloom.members(keys, "key")
        assert len(filters) == (1 if most > 3000 else 6)
        inside = np.any([x.mine(have) & x.contains(have) for x in filters], axis=0)
        others = have + np.uint64(1)
        assert inside.all() and np.any([x.mine(others) & x.contains(others) for x in filters], axis=0).mean() < 0.02
        both = keys.unionByName(keys.select(F.expr("key + 1").alias("key")))
        key = lambda batch: batch.column("key").to_numpy().view(np.uint64)
        yes, no = bloom.picked(both, filters, key, True).count(), bloom.picked(both, filters, key, False).count()
        assert yes + no == 6000 and 3000 <= yes < 3100


def test_bloom_repeats(spark):
    keys = spark.range(9000).select(F.xxhash64("id").alias("key"))
    twice = key_array(bloom.repeated(keys.unionByName(keys.limit(100)), "key", 9100))
    assert set(key_array(keys.limit(100))) <= set(twice) and len(twice) == len(set(twice)) < 600
    # A very common key costs two entries a flush: what a slice gets doesn't grow with its rows.
    batch = pa.record_batch([pa.array(np.full(400_000, 7))], ["key"])
    sizes = [len(x) for x in bloom._gathered(iter([batch]))]
    assert sizes == [400_000] and list(bloom.twice(np.array([7, 7, 9], np.uint64))) == [7]


def test_sharding(some, none):
    got = sharding.assign(some.unionByName(some)).collect()
    assert len(got) == 24
    assert {r.doc_id: r.size for r in got}[1] == 8 and {r.doc_id: r.text_crc32 for r in got}[2] == 0
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in by.values())
    assert sharding.assign(none).count() == 0


def test_weights_confine_movement(spark):
    ids = spark.range(4000).withColumnRenamed("id", "doc_id")
    tree = sharding.even_tree()
    heavier = tuple(x if x.shard != 5 else sharding.Leaf(x.region, x.rack, 5, 3.0) for x in tree)
    both = sharding.shard_of(sharding.shard_of(ids, "doc_id", tree, "a"), "doc_id", heavier, "b").collect()
    own = {x.shard for x in tree if x.region == tree[5].region}
    moved = [r for r in both if r.a != r.b]
    assert moved and all(r.b in own for r in moved)
    assert sum(r.b == 5 for r in both) > 2 * sum(r.a == 5 for r in both)


def test_decontamination(some, none, bench):
    want = brute.contamination(TEXTS, [(r.item_id, r.text) for r in bench.collect()])
    assert set(rows(decontaminate.digest_columns(decontaminate.hits(some, bench)))) == want
    left = decontaminate.drop_contaminated(some, bench)
    assert left.columns == some.columns and sorted(r.doc_id for r in left.collect()) == sorted(w[0] for w in want if not w[5])
    assert decontaminate.hits(none, bench).count() == 0
    assert decontaminate.hits(some, bench.limit(0)).where("n_hit > 0").count() == 0


def test_decontamination_in_blocks(some, bench, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 10)
    want = brute.contamination(TEXTS, [(r.item_id, r.text) for r in bench.collect()])
    assert set(rows(decontaminate.digest_columns(decontaminate.hits(some, bench)))) == want


def test_pii(some, none):
    got = {r.doc_id: r for r in pii.digest_columns(pii.find(some)).collect()}
    assert (got[10].n_email, got[10].n_ip, got[10].n_card, got[10].n_phone) == (1, 1, 1, 1)
    for i, text in TEXTS:
        told = ",".join(f"{k}:{a}:{b}" for k, a, b in brute.personal(text))
        assert got[i].base_sha256 == hashlib.sha256(told.encode()).hexdigest()
    assert pii.find(none).count() == 0


HARD = [
    "a@b.c_x@d.e.f a.b@@c.d x@y.z-",
    "1.2.3.4.5.6.7.8 256.1.1.1 1.1.1.256 001.002.003.004 99999999999999999999.1.1.1",
    "4111-1111 11111111 1 4111111111111111 4111 1111  1111 1111 " + "4" * 200,
    "+1 (2) 3-4.5 678 9+12345678-+ +12 +123456789012345 6",
    "a@b.co x 10.1.1.1",
    "9" * 3_000 + "@" + "a" * 3_000,
    "é+49 30 1234567é a@b.de",
]


def test_pii_hard(spark):
    df = spark.createDataFrame(list(enumerate(HARD)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.digest_columns(pii.find(df)).collect()}
    for i, text in enumerate(HARD):
        told = ",".join(f"{k}:{a}:{b}" for k, a, b in brute.personal(text))
        assert got[i].base_sha256 == hashlib.sha256(told.encode()).hexdigest(), text[:60]


def test_pii_long(spark):
    """Texts with very many matches, in seconds: short numbers, addresses, cards and phones, 1 MB each."""
    numbers = " ".join(str(10 + i % 89_990) for i in range(180_000))
    mixed = " ".join(f"a{i}@b.io 10.0.{i % 300}.{i % 7} 4111 1111 1111 1111, (743) 555-{1000 + i % 9000}; +1 743 555 {1000 + i % 9000}" for i in range(11_000))
    df = spark.createDataFrame([(1, numbers), (2, mixed), (3, "7" * 1_000_000)], "doc_id long, text string")
    began = time.perf_counter()
    got = {r.doc_id: r for r in pii.digest_columns(pii.find(df)).collect()}
    assert time.perf_counter() - began < 60
    assert got[3].base_sha256 == hashlib.sha256(b"").hexdigest()
    for i, text in ((1, numbers), (2, mixed)):
        told = ",".join(f"{k}:{a}:{b}" for k, a, b in brute.personal(text))
        assert got[i].base_sha256 == hashlib.sha256(told.encode()).hexdigest()


def test_pii_kinds_dont_overlap_themselves(spark):
    texts = ["a@b.c(at)d.e x(at)d.e@f.g joe (at) ex.com.", "1:2:3:4:5:6:7:8.1.1.1 9.9.9.9:1:2:3:4:5:6:7 1:2:3:4:5:6:7:8.", "+1 (743) 555-3824 or (743) 555-3824 x 4111 1111 1111 111, 4111111111111111"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.candidates(df).collect():
        assert r.spans
        for kind in range(4):
            mine = [x for x in r.spans if x.kind == kind]
            assert all(x.end <= y.start for x, y in zip(mine, mine[1:], strict=False))


def test_pii_learns():
    """Labelers that agree get more weight than one that votes at random."""
    patterns = [(3, 1, 1, 1, 1, 900), (3, 0, 1, 1, 1, 60), (3, 0, -1, -1, -1, 500), (3, 0, 1, -1, 1, 10), (3, 1, 1, 0, 1, 300)]
    _, _, post = pii.reliabilities(patterns)
    assert post[0] > 0.9 and post[1] > 0.5 > post[2]
    w = pii.train_spans(patterns, post)
    logit = lambda p: sum(a * b for a, b in zip(w, pii._inputs(p), strict=True))
    assert logit(patterns[1]) > 0 > logit(patterns[2])


def taught(texts, labels):
    rows = list(zip(texts, labels, strict=True))
    return quality.train(labels, lambda nth: [rows[k] for k in np.random.default_rng(nth).permutation(len(rows))])


def convolution(net, text):
    """The network's probability of one text, by plain loops."""
    step, pooled, begin = quality.CHUNK - quality.OVERLAP, [], 0
    padded = text + b"\0" * 8
    while text:
        end = min(begin + quality.CHUNK, len(text))
        best = [max(sum(float(net.filters[t][padded[a + t]][f]) for t in range(4)) for a in range(begin, end, 2)) for f in range(quality.FILTERS)]
        pooled.append([max(0.0, b + float(net.bias[f])) for f, b in enumerate(best)])
        if end == len(text):
            break
        begin += step
    logit = net.head_bias
    for f in range(quality.FILTERS):
        if pooled:
            logit += float(net.head[f]) * sum(x[f] for x in pooled) / len(pooled) + float(net.head[quality.FILTERS + f]) * max(x[f] for x in pooled)
    return 1 / (1 + np.exp(-logit))


def test_quality_equals_plain_convolution(monkeypatch):
    draw = np.random.default_rng(3)
    net = quality.Network.new(11)
    net.bias[:] = draw.normal(0, 0.2, quality.FILTERS)
    texts = [b"", b"a", "é€ words".encode(), draw.bytes(511), draw.bytes(512), draw.bytes(513), draw.bytes(2500)]
    for block in (1024, 2):
        monkeypatch.setattr(quality, "BLOCK", block)
        got = quality.scorer(net)(pa.array(texts, pa.binary()))
        assert np.allclose(got, [convolution(net, t) for t in texts], atol=1e-4)


def test_quality_streams_a_large_sample(spark, monkeypatch):
    monkeypatch.setattr(quality, "STEPS", 6)
    df = docs(spark, [(i, f"text {i} " + "ab "[i % 2] * 300) for i in range(50)])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(50)], "doc_id long, quality int, toxic int")
    one = quality.fit(df, labels)
    monkeypatch.setattr(quality, "HELD_BYTES", 100)
    two = quality.fit(df, labels)
    assert (one.filters == two.filters).all() and (one.head == two.head).all()


def test_quality_learns_from_every_chunk(spark):
    """What tells the classes apart stands in one chunk of many; labels and rows may repeat."""
    plain = b"just some words here " * 500
    rows = [(i, (plain[: 500 * (i % 19)] + (b"###### ?? " * 30 if i % 2 else b"words here " * 30) + plain[: 500 * (19 - i % 19)]).decode()) for i in range(40)]
    df = docs(spark, rows + rows[:3])
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(40)] + [(0, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    net = quality.fit(df, labels)
    got = {r.doc_id: r.score for r in quality.score_documents(df, net).collect()}
    assert min(s for i, s in got.items() if i % 2 == 0) > max(s for i, s in got.items() if i % 2)
    assert quality.training_rows(df, labels, "doc_id", "text", "quality", 5).count() == 5


def test_quality(some, none, spark):
    net = taught([b"good words here now"] * 20 + [b"$$$ ### *** %%%"] * 20, [1] * 20 + [0] * 20)
    got = {r.doc_id: r.score for r in quality.score_documents(some, net).collect()}
    assert set(got) == {i for i, _ in TEXTS} and all(0 <= s <= 1 for s in got.values()) and got[1] == got[2]
    left = quality.keep_good(some, net)
    assert left.columns == some.columns and left.count() == sum(s >= quality.CUT for s in got.values())
    assert quality.score_documents(none, net).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {round(r.score, 6) for r in quality.score_documents(some, quality.fit(some, labels)).collect()} == {0.5}


def test_quality_covers_the_whole_text():
    begin, end, doc = quality.chunk_edges(np.array([0, 1, 512, 513, 5000]))
    for k, n in enumerate([0, 1, 512, 513, 5000]):
        seen = np.zeros(n, bool)
        for a, b, d in zip(begin, end, doc, strict=True):
            if d == k:
                seen[a:b] = True
        assert seen.all()
    net = taught([b"plain text"] * 9 + [b"!!!! ????"] * 9, [1] * 9 + [0] * 9)
    score = quality.scorer(net)
    long = b"plain text " * 3000
    assert score(pa.array([long + b"!!!! ???? " * 40], pa.binary()))[0] != score(pa.array([long], pa.binary()))[0]


def test_warc_rows(spark, tmp_path):
    pages = [(1, "http://a/ b\r\nc", "x"), (2, None, None), (3, "http://b", ""), (4, "http://c", "x"), (5, "http://d", "é" * 200_000), (4, "http://c", "x")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({"digest": F.lit(1), "refers_to": F.lit(2)})
    path = scratch_path(spark, "test")
    warc.write_packages(warc.captures(df), path, package_bytes=64)
    got = sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_packages(spark, path).collect())
    assert got == [(1, 1, "response", None), (2, 0, "response", None), (3, 0, "revisit", 2), (4, 1, "revisit", 1), (4, 1, "revisit", 1), (5, 400_000, "response", None)]
    few = sorted((r.page_id, r.refers_to) for r in warc.captures(df, least_bytes=1).collect())
    assert few == [(1, None), (2, None), (3, None), (4, 1), (4, 1), (5, None)]
    empty = scratch_path(spark, "test")
    warc.write_packages(warc.captures(df.limit(0)), empty)
    assert warc.read_packages(spark, empty).count() == 0


@pytest.mark.parametrize("zip64", [False, True])
def test_zip_packages(zip64):
    members = [("archive/data.warc.gz", b"abc" * 1000), ("indexes/index.cdxj", b"line\n"), ("empty", b"")]
    raw = warc.zip_stored(members, comment=b"note", zip64=zip64)
    assert zipfile.ZipFile(io.BytesIO(raw)).testzip() is None
    asked = []

    def read(at, n):
        asked.append(n)
        return raw[at : at + n]

    package = warc.ZipPackage(read, len(raw))
    assert {n: package.whole(n) for n in package.members} == dict(members)
    asked.clear()
    assert package.range("archive/data.warc.gz", 3, 4) == b"abca" and sum(asked) == 34
    with pytest.raises(ValueError):
        package.range("empty", 0, 1)
    other = io.BytesIO()
    with zipfile.ZipFile(other, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a", "b" * 100)
    with pytest.raises(ValueError):
        warc.ZipPackage(lambda at, n: other.getvalue()[at : at + n], len(other.getvalue())).whole("a")


def test_licenses(some, none, spark):
    got = {r.doc_id: r for r in licenses.scan(some).collect()}
    assert got[12].license_id == "MIT" and got[12].n_notices == 1 and got[1].license_id is None and got[2].n_notices == 0
    mit = dict((t[:12], t) for _, t in licenses.TEXTS)["MIT License\n"]
    told = mit.replace("MIT License\n", "MIT   LICENCE\n\nCopyright (c) 2020 Some One\n").replace("sublicense", "sub-license").replace('"', "'")
    row = licenses.scan(spark.createDataFrame([(1, told), (2, told + " more")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.license_id for r in row] == ["MIT", None]
    assert licenses.scan(none).count() == 0
    assert all("licen" in text.lower() for _, text in licenses.NOTICES)


def test_canonical_licence_text(spark):
    texts = [
        "licence licence licence", "license license license",
        "(c) 2020 one line that is a whole document", "(c) 2021 another line that is a whole document", "",
        "Copyright (c) 2020 A\nsome words", "some words", "(c) You must keep this\nsome words", "x" * 300 + " copyright 2020\nsome words",
        "copyright 2020 " + "y " * 200 + "\nsome words", " ".join(["sub licence copyright owner"] * 50_000), " ".join(["sublicense copyright holder"] * 50_000),
    ]
    a = [r.canonical_sha256 for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert a[0] == a[1] and a[10] == a[11] and a[5] == a[6]
    assert len({a[0], a[2], a[3], a[4], a[5], a[7], a[8], a[9], a[10]}) == 9


def test_windows_of_several_items(spark):
    """Items that share a passage, one without an id, ids as text: distinct windows, all their items."""
    rows = [("b", "one two three four"), ("a", "one two three four"), (None, "five six"), ("10", "seven"), ("9", "x " + " ".join(WORDS)), ("8", "y " + " ".join(WORDS))]
    bench = spark.createDataFrame(rows, "item_id string, text string")
    df = docs(spark, [(1, "zero one two three four five six " * 3), (2, "nothing"), (3, None), (4, " ".join(WORDS)), (5, "five six")])
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontaminate.hits(df, bench).collect()}
    assert got == {1: (21, 18, ["a", "b"]), 2: (1, 0, []), 3: (0, 0, []), 4: (20, 20, ["8", "9"]), 5: (2, 2, [])}
    assert sorted(r.doc_id for r in decontaminate.drop_contaminated(df, bench).collect()) == [2, 3]


def test_blocks_are_taken_one_by_one(some, bench, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 10)
    taken, built = [], []
    blocks, build = decontaminate._blocks, decontaminate.build_tables
    monkeypatch.setattr(decontaminate, "_blocks", lambda *a: (taken.append(1) or x for x in blocks(*a)))
    monkeypatch.setattr(decontaminate, "build_tables", lambda x: built.append(len(taken)) or build(x))
    decontaminate.hits(some, bench)
    assert len(taken) > 1 and built == list(range(1, len(taken) + 1))


def test_only_known_patterns_are_read_by_chunk(tmp_path):
    import json

    spec = json.load(open(queries.tokenizer_path()))
    assert encoding.Encoder._by_chunk(spec)
    spec["pre_tokenizer"]["pretokenizers"][0]["pattern"] = {"Regex": "[a-z]+"}
    assert not encoding.Encoder._by_chunk(spec)


def test_sentences_longer_than_a_window_are_cut_inside_only():
    sentence = np.zeros(100, bool)
    sentence[5] = True
    ids = np.full(400, 9, dtype="<u4")
    ids[[40, 90, 110, 390]] = 5
    places, fee = packing.candidate_cuts(ids, np.array([60, 400]), sentence, 128)
    assert [p for p, f in zip(places, fee, strict=True) if f == packing.TRUNCATE] == [175, 239, 303, 367]
    assert np.diff(places).max() <= 128


def test_token_files_of_one_doc_id(spark, tokenizer):
    """Rows that share a doc_id have starts in the order of the file, whatever follows."""
    texts = [f"{w} {i}" for i, w in enumerate(WORDS * 10)]
    path = scratch_path(spark, "test")
    token_files.write_token_files(docs(spark, [(7, t) for t in texts]), path, queries.tokenizer_path())
    want, at = [], 0
    for t in sorted(texts):
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 1]
        want.append((7, at, len(ids), brute.crc(ids)))
        at += len(ids)
    assert rows(token_files.check_columns(spark, path)) == want


def test_sharding_of_one_doc_id(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SLOT_GROUP", 5)
    got = sharding.assign(docs(spark, [(7, str(i)) for i in range(400)] + [(None, str(i)) for i in range(200)])).collect()
    for key in (7, None):
        mine = [r for r in got if r.doc_id == key]
        assert len({r.shard for r in mine}) == 1
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in by.values())


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path())


def test_encoder_equals_the_library(tokenizer):
    enc = encoding.Encoder(queries.tokenizer_path())
    assert enc.chunked
    texts = [t or "" for _, t in TEXTS] + ["", "　a b\x1cc\x85d", "é J̌  ́x", "'S 'lL don't WE'VE", "ß µ ª × ÷ ÿ Ÿ ΑΣ ς", "a.b!?c ...", "123 4五", "<|startoftext|>x<|endoftext|>"]
    flat, ends = enc.encode(pa.array([t.encode() for t in texts], pa.binary()))
    at = 0
    for t, end in zip(texts, ends.tolist(), strict=True):
        assert flat[at:end].tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t[:40]
        at = end


def test_other_tokenizers_are_encoded_whole():
    import public_tokenizers

    enc = encoding.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert not enc.chunked
    flat, ends = enc.encode(pa.array([b"a b", b"", b" c"], pa.binary()))
    assert flat.tolist() == [i for t in ("a b", "", " c") for i in enc.tokenizer.encode(t, add_special_tokens=False).ids] and ends[1] == ends[0]


def test_token_files(some, none, spark, tokenizer):
    path = scratch_path(spark, "test")
    token_files.write_token_files(some.unionByName(some.where("doc_id = 10")), path, queries.tokenizer_path())
    got = rows(token_files.check_columns(spark, path))
    want, at = [], 0
    for i, t in sorted([*TEXTS, TEXTS[9]]):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((i, at, len(ids), brute.crc(ids)))
        at += len(ids)
    assert got == want
    starts = token_files.token_starts(spark, path)
    assert sorted((r.doc_id, r.start) for r in starts.collect()) == [(w[0], w[1]) for w in want]
    empty = scratch_path(spark, "test")
    token_files.write_token_files(none, empty, queries.tokenizer_path())
    assert token_files.check_columns(spark, empty).count() == 0


def test_token_file_format(spark, some, tmp_path):
    import glob

    import pyarrow.parquet as pq

    path = scratch_path(spark, "test")
    token_files.write_token_files(some, path, queries.tokenizer_path())
    meta = [pq.ParquetFile(f).metadata for f in glob.glob(path + "/*.parquet")]
    col = next(m.row_group(0).column(2) for m in meta if m.num_rows)
    assert col.has_offset_index and col.compression == "ZSTD"
    assert set(col.encodings) & {"RLE_DICTIONARY", "DELTA_BINARY_PACKED"}


def best_cost(places, fee, size):
    cost = [0] + [None] * (len(places) - 1)
    for j in range(1, len(places)):
        cost[j] = min(cost[i] + size - (places[j] - places[i]) for i in range(j) if places[j] - places[i] <= size) + fee[j]
    return cost[-1]


@pytest.mark.parametrize("seed", range(5))
def test_cuts_are_optimal(seed):
    draw = np.random.default_rng(seed)
    places = np.unique(np.r_[0, np.cumsum(draw.integers(1, 12, 120))])
    fee = draw.integers(0, 9, len(places))
    path = packing.cuts(places, fee, 40)
    steps = np.diff(places[path])
    assert (steps <= 40).all() and path[0] == 0 and path[-1] == len(places) - 1
    assert int(sum(40 - s for s in steps) + fee[path[1:]].sum()) == best_cost(places.tolist(), fee.tolist(), 40)


def test_packing(some, none):
    got = packing.pack(some, queries.tokenizer_path()).collect()
    whole = {}
    for r in got:
        whole.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens))
    assert set(whole) == {i for i, _ in TEXTS}
    for parts in whole.values():
        assert sum(n for _, n, _ in parts) == parts[0][2]
    assert packing.pack(none, queries.tokenizer_path()).count() == 0
    assert packing.tail_sizes(2048 + 21) == [2048, 16, 4, 1]


def test_crc_of_slices():
    ids = np.array([1, 2, 3], "<u4")
    assert zlib.crc32(ids.tobytes()) == brute.crc([1, 2, 3])

"""Each registered query against a brute-force version over whole tables."""

import base64
import hashlib
import zlib
from collections import defaultdict

import pyarrow.parquet as pq
import pytest

from quillon.llm import queries

from . import brute

SF = "/root/testdata/sf0.01"


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture(scope="module")
def docs():
    t = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    return list(zip(t["doc_id"], t["text"], strict=True))


def run(spark, name, sf=SF):
    return queries.QUERIES[name](spark, sf)


def test_op1(spark, docs):
    df = run(spark, "op1_shards")
    assert df.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    got = rows(df)
    text = dict(docs)
    assert sorted(r[0] for r in got) == sorted(text)
    slots = defaultdict(list)
    for doc_id, size, crc, law, shard, slot, grown in got:
        raw = text[doc_id].encode()
        assert (size, crc, law) == (len(raw) + 8, zlib.crc32(raw), "key")
        assert 0 <= shard < 24 and grown in (shard, 24)
        slots[shard].append(slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert len(slots) == 24 and max(map(len, slots.values())) < 2.2 * len(got) / 24
    assert 0 < sum(r[6] == 24 for r in got) < 2.5 * len(got) / 25


def test_op2(spark, docs):
    assert set(rows(run(spark, "op2_near_duplicates"))) == brute.near(docs)


def test_op3(spark, docs):
    text = dict(docs)
    found = 0
    for doc_id, *counts, sha, spans in rows(run(spark, "op3_personal_data")):
        base = brute.personal(text[doc_id])
        assert counts == [sum(x[0] == k for x in base) for k, _ in brute.PII]
        told = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert sha == hashlib.sha256(told.encode()).hexdigest()
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(spans.split(",")) | set()
        found += len(base)
    assert found > 50


def test_op4(spark, docs):
    got = rows(run(spark, "op4_quality"))
    labels = dict(zip(*pq.read_table(f"{SF}/labels.parquet", columns=["doc_id", "quality"]).to_pydict().values(), strict=True))
    assert len(got) == len(docs)
    held = [(s, labels[i]) for i, out, s, _ in got if out and i in labels]
    assert all(out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= s <= 1 and p == (s >= 0.3) for i, out, s, p in got)
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    auc = sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad))
    assert auc > 0.95
    assert sum(s >= 0.3 for s in good) / len(good) > 0.97


def test_op5(spark):
    t = pq.read_table(f"{SF}/pages.parquet", columns=["page_id", "html"]).to_pydict()
    first = {}
    for i, html in sorted(zip(t["page_id"], t["html"], strict=True)):
        first.setdefault(html or "", i)
    want = set()
    for i, html in zip(t["page_id"], t["html"], strict=True):
        raw, own = (html or "").encode(), first[html or ""]
        want.add((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if own == i else "revisit", None if own == i else own))
    assert set(rows(run(spark, "op5_warc"))) == want


def test_op7(spark, docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer_path())
    ids = {i: [*tok.encode(t, add_special_tokens=False).ids, 1] for i, t in docs}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for doc_id, start, length, crc, whole, seq, offset in rows(run(spark, "op7_packing")):
        assert length > 0 and whole == len(ids[doc_id]) and crc == brute.crc(ids[doc_id][start : start + length])
        pieces[doc_id].append((start, length))
        sequences[seq].append((offset, length))
    for found, whole in [(pieces[i], len(ids[i])) for i in ids] + [(x, None) for x in sequences.values()]:
        at = 0
        for start, length in sorted(found):
            assert start == at
            at += length
        assert at == whole if whole else at <= 2048
    used = [sum(n for _, n in x) for x in sequences.values()]
    padding = sum(0 if n & (n - 1) == 0 else 2048 - n for n in used)
    assert padding < 0.02 * sum(used)


def test_op8(spark, docs):
    assert set(rows(run(spark, "op8_exact_duplicates"))) == brute.exact(docs)


def test_op9(spark, docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer_path())
    want, at = set(), 0
    for i, t in sorted(docs):
        ids = [*tok.encode(t, add_special_tokens=False).ids, 1]
        want.add((i, at, len(ids), brute.crc(ids)))
        at += len(ids)
    assert set(rows(run(spark, "op9_token_files"))) == want


def test_op10(spark, docs):
    t = pq.read_table(f"{SF}/benchmark.parquet").to_pydict()
    bench = list(zip(t["item_id"], t["text"], strict=True))
    got = set(rows(run(spark, "op10_decontamination")))
    assert got == brute.contamination(docs, bench)
    assert any(r[-1] for r in got)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "pages", "benchmark"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = con.sql(queries.SQL[name])
    df = run(spark, name)
    assert sorted(df.columns) == sorted(want.columns)
    assert sorted(rows(df.select(*want.columns)), key=str) == sorted(want.fetchall(), key=str)

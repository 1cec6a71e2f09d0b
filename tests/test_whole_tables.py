"""Queries over whole tables, against plain Python over every row."""

import re
from collections import defaultdict

import pyarrow as pa
import pyarrow.parquet as pq

from quillon.operators.panel import shapes
from quillon.plans import records, screening, views  # noqa: F401

SF = "/root/testdata/sf0.001"


def users():
    out = defaultdict(list)
    for r in sorted(pq.read_table(f"{SF}/events.parquet").to_pylist(), key=lambda r: r["event_id"]):
        out[r["user_id"]].append(r)
    return out


def rows(spark, name):
    return {tuple(r) for r in screening.QUERIES[name](spark, SF).collect()}


def test_routed_attempts(spark):
    want = set()
    for user, events in users().items():
        for n, e in enumerate(events, 1):
            state = "ok" if e["value"] >= 200 else "stop" if e["value"] < 1 else "exhausted"
            if state != "exhausted" or n == len(events):
                want.add((user, state, e["event_type"], n))
                break
    assert rows(spark, "routed_attempts") == want
    assert {x[1] for x in want} == {"ok", "stop", "exhausted"}


def test_malformed_vote(spark):
    want = set()
    for user, events in users().items():
        kinds = defaultdict(list)
        for e in events:
            kinds[e["event_type"]].append(e)
        votes = sorted((-len({e["event_id"] % 3 for e in x}), -len(x), -max(e["value"] for e in x), k) for k, x in kinds.items())
        first, second = votes[0], (votes + [None])[1]
        want.add((user, None if second and first[:2] == second[:2] else first[3], -first[0], -first[1]))
    assert rows(spark, "malformed_vote") == want
    assert any(x[1] is None for x in want) and any(x[1] for x in want)


def contacts(source, key, text):
    for n, line in enumerate(text.split("\n")):
        for kind, shape in (("email", shapes.EMAIL), ("web", shapes.WEB), ("phone", shapes.PHONE)):
            for m in shape.finditer(line):
                digits = len(re.sub(r"\D", "", m[0]))
                if shapes.IDENTIFIER.search(line[max(0, m.start() - 24) : m.end() + 24]):
                    continue
                if kind != "phone":
                    yield (source, key, n, kind, m[0].lower().rstrip(".,;") if kind == "web" else m[0].lower())
                elif digits in (10, 11) or (m[0].startswith("+91") and digits in (12, 13)):
                    yield (source, key, n, kind, re.sub(r"\s+", " ", m[0]))


def test_contact_extract_all(spark, tmp_path):
    odd = [
        "Call 98765 43210, +91 1800-123-4567 or care@A.co.in; see https://www.Shop.example/x?a=1., www.b.in:80/y",
        "LIC NO 10012345678901 a@b.co" + " " * 30 + "FSSAI 1234567890 and\t12345\t 67890",
        ".a@b.co-x@y.zz éa.b@c.de é-a@b.com a@b @c.de a@b.c1 1234567890123 " + "a." * 5000 + "@",
    ]
    for name, key, column in (("documents", "doc_id", "text"), ("pages", "page_id", "html")):
        for sf in (SF, str(tmp_path)):
            if sf != SF:
                pq.write_table(pa.table({key: range(len(odd)), column: odd}), f"{sf}/{name}.parquet")
    for sf in (SF, "/root/testdata/sf0.01", str(tmp_path)):
        want = []
        for name, key, column in (("documents", "doc_id", "text"), ("pages", "page_id", "html")):
            t = pq.read_table(f"{sf}/{name}.parquet", columns=[key, column]).to_pydict()
            want += [x for i, text in zip(t[key], t[column], strict=True) for x in contacts(name, i, text or "")]
        assert sorted(map(tuple, screening.QUERIES["contact_extract_all"](spark, sf).collect())) == sorted(want)
    assert {x[3] for x in want} == {"email", "web", "phone"}


def test_union_all_passes(spark):
    kinds = [e["event_type"] for events in users().values() for e in events]
    got = rows(spark, "union_all_passes")
    assert got == {(k, "a" if k in ("click", "view") else "b", kinds.count(k)) for k in kinds}
    assert sum(x[2] for x in got) == len(kinds)

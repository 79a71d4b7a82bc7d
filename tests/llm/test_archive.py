"""The archive read back, byte for byte, and the rule ledger; both against their SQL."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA, SMALL
from tidepool.llm import quality_rules, queries, warc

PAGES = "page_id long, url string, html string"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("pages", "documents"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got = queries.QUERIES[name](spark, DATA)
    cols = sorted(got.columns)
    want = con.sql("select " + ", ".join(f'"{c}"' for c in cols) + f" from ({queries.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(tuple, got.select(*cols).collect()), key=repr) == sorted(want, key=repr)


def test_records_are_whole(spark):
    big = "é" * 700
    rows = [(1, "http://a/\r\nX: 1", big), (2, "http://b/", big), (2, "http://c/", big), (None, None, big), (3, "u", None), (4, "u", ""), (5, "u", "a" * 999), (6, "u", "a" * 999), (7, "u", "\r\n\r\nWARC-Type: revisit\r\n"), (8, "u", "z" * 3_000_000), (9, "u", "z" * 3_000_000)]
    pages = spark.createDataFrame(rows, PAGES).selectExpr("*", "1 as id", "2 as payload", "3 as row")
    read = warc.read_archive(spark, warc.write_archive(pages))
    got = read.collect()
    assert len(got) == len(rows) and len({re.search(b"Record-ID: <[^>]+>", bytes(r.header))[0] for r in got}) == len(rows)
    bodies = {}
    for i, u, h in rows:
        bodies.setdefault(i, []).append((h or "").encode())
    for r in got:
        head, record = bytes(r.header), bytes(r.record)
        kind, size = re.search(rb"WARC-Type: (\w+)", head)[1], int(re.search(rb"\r\nContent-Length: (\d+)\r\n", head)[1])
        assert head.startswith(b"WARC/1.1\r\n") and head.endswith(b"\r\n\r\n") and head.count(b"\r\n\r\n") == 1
        assert record == head + (bytes(r.payload) if kind == b"response" else b"") + b"\r\n\r\n" and len(record) == len(head) + size + 4
        assert bytes(r.payload) in bodies[r.record_id] and hashlib.sha1(r.payload).hexdigest().encode() in head
    parsed = sorted((tuple(r) for r in warc.parse_records(read).collect()), key=repr)
    kinds = {1: ("revisit", 2), 2: ("response", None), None: ("revisit", 2), 8: ("revisit", 9)}
    want = [(i, len(h or "" if i is None else (h or "").encode()) if i is not None else 1400, hashlib.sha1((h or "").encode()).hexdigest(), *kinds.get(i, ("response", None))) for i, _, h in rows]
    assert parsed == sorted(want, key=repr)
    assert spark.read.parquet(warc.write_archive(pages).payloads).count() == 5
    assert warc.parse_records(warc.read_archive(spark, warc.write_archive(pages.limit(0)))).count() == 0


@pytest.mark.parametrize("harm", ["substring(payload, 1, octet_length(payload) - 1)", "concat(payload, X'00')"])
def test_damage_is_found(spark, harm):
    pages = spark.createDataFrame([(1, "u", "abc"), (2, "u", "abcd")], PAGES)
    read = warc.read_archive(spark, warc.write_archive(pages))
    broken = read.withColumn("payload", F.expr(harm)).withColumn("record", F.concat("header", "payload", F.lit(b"\r\n\r\n")))
    with pytest.raises(Exception, match="not as its header"):
        warc.parse_records(broken).collect()


def test_ledger_policies_and_ablations(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(None, None), (-1, ""), (-2, "a b c " * 50_000), (-3, "## " * 60), (-3, "## " * 60), (-4, "\n\n \t\n")], "doc_id long, text string")
    led = quality_rules.ledger(docs.unionByName(odd).selectExpr("*", "1 as failed", "2 as n_words")).cache()
    assert led.count() == docs.count() + 6 and quality_rules.ledger(docs.limit(0)).count() == 0
    names = list(quality_rules.rules())
    rows = [r.failed for r in led.collect()]
    assert {r.doc_id: r.failed for r in led.collect()}[-1] == 1 and {r.doc_id: r.n_repeat_words for r in led.collect()}[-2] == 150_000
    policies = [quality_rules.BASE, quality_rules.WEB, quality_rules.Policy("soft", 2, ("few_words",), ("short_words", "symbols", "few_letters"), 1)]

    def rejects(p, bits):
        own = {n for k, n in enumerate(names) if bits >> k & 1}
        return bool(own & set(p.hard)) or len(own & set(p.soft)) > p.bears and bool(p.soft)

    for p in policies:
        kept = quality_rules.apply_policy(led, p).collect()
        assert [r.kept for r in kept] == [not rejects(p, r.failed) for r in kept] and kept[0].policy == f"{p.name}-{p.version}"
        want = {}
        for n in (*p.hard, *p.soft):
            bit = 1 << names.index(n)
            want[n] = (sum(1 for b in rows if b & bit), sum(1 for b in rows if rejects(p, b) and not rejects(p, b & ~bit)))
        assert {r.rule: (r.fails, r.alone) for r in quality_rules.ablations(led, p).collect()} == want

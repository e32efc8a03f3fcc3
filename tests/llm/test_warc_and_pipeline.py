import hashlib
import os

import pytest

import corpus_pipeline
from rootgrain.llm import ngramjoin, queries, warc


def pages(spark):
    big = "<html>" + "é" * 800 + "</html>"
    rows = [(1, "http://a.example/x", big), (2, "http://b.example/", big), (3, "http://a.example/y?q=1", big + "!"), (4, None, None), (5, "http://c.example/", ""), (6, "http://d.example/", "short"), (7, "http://d.example/", "short"), (8, "http://e.example/", "WARC/1.1\r\n\r\nWARC-Type: response\r\n\r\n"), (2, "http://b.example/", big)]
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, record_type string").repartition(3)


def test_round_trip(spark):
    got = {r.page_id: r for r in warc.round_trip(pages(spark)).collect()}
    want = {r.page_id: (r.html or "").encode() for r in pages(spark).collect()}
    assert set(got) == set(want)
    assert {k: r.record_type for k, r in got.items()} == {k: "revisit" if k == 1 else "response" for k in want}
    assert got[1].refers_to == 2
    for k, r in got.items():
        digest = hashlib.sha1(want[k]).hexdigest()
        assert r.response.http_length == len(want[k]) and r.response.declared_digest.endswith(digest)
        assert k == 1 or r.response.payload_digest == digest
        assert r.request.http_head.startswith("GET ") and len(r.metadata) == 1


def test_key_with_a_name_of_a_capture(spark):
    page = "<p>" + "x" * 2000
    rows = spark.createDataFrame([(1, page, "u"), (2, page, "u"), (3, None, None)], "record_id long, html string, url string")
    got = {r.record_id: (r.record_type, r.refers_to, r.response.payload_bytes) for r in warc.round_trip(rows, key="record_id").collect()}
    assert got == {1: ("revisit", 2, 0), 2: ("response", None, 2003), 3: ("response", None, 0)}
    assert warc.round_trip(rows.limit(0), key="record_id").count() == 0


def test_a_very_long_page(spark):
    rows = spark.createDataFrame([(1, "é" * 3_000_000, "u")], "page_id long, html string, url string")
    assert [(r.page_id, r.response.payload_bytes) for r in warc.round_trip(rows).collect()] == [(1, 6_000_000)]


def test_captures_without_request_or_metadata(spark):
    folder = warc.shared_dir(spark) + "/test-warc-lone"
    record = lambda kind, name, more="": f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{name}>\r\n{more}Content-Length: 2\r\n\r\nhi\r\n\r\n"
    local = folder.removeprefix("file://")
    os.makedirs(local, exist_ok=True)
    with open(f"{local}/a.warc", "w", newline="") as f:
        f.write(record("response", "r1") + record("request", "q9", "WARC-Concurrent-To: <gone>\r\n") + record("warcinfo", "i"))
    got = warc.captures(warc.read(spark, folder)).collect()
    assert [(r.record_id, r.request, r.metadata) for r in got] == [("<r1>", None, [])]


def test_truncated_archive_fails():
    with pytest.raises(ValueError):
        list(warc._parsed(iter([b"WARC/1.1\r\nContent-Length: 10\r\n\r\nabc"])))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")
def test_pipeline_keeps_clean_documents_and_columns(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, folder)
        assert kept.columns == docs.columns, name
        kept = spark.createDataFrame(kept.collect(), docs.schema)
    assert 0 < kept.count() <= docs.count()
    groups = ngramjoin.near_duplicates(kept)
    assert groups.where("component_id != doc_id").count() == 0
    packed = corpus_pipeline.pack(spark, kept, folder)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in kept.select("doc_id").collect()}
    # which pieces there are depends on how the rows lie in partitions, which documents does not
    run = corpus_pipeline.run(spark, folder)
    assert {tuple(r) for r in run.select("doc_id", "doc_tokens").collect()} == {tuple(r) for r in packed.select("doc_id", "doc_tokens").collect()}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_queries_equal_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        path = f"{folder}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path if os.path.isfile(path) else path + '/*.parquet'}')")
    df = queries.QUERIES[name](spark, folder)
    result = con.execute(queries.ORACLE[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(str([r[c] for c in columns]) for r in df.collect()) == sorted(str(list(r)) for r in result.fetchall())

from headway.llm import warc


def expected(rows, least=0):
    best = {}
    for p, h in rows:
        best[h] = max(p, best.get(h, p))
    out = []
    for p, h in rows:
        b = h.encode()
        r = best[h] if len(b) >= least and best[h] != p else None
        out.append((p, len(b), warc.digest(b), "response" if r is None else "revisit", r))
    return sorted(out, key=str)


def test_query(spark):
    rows = [(r.page_id, r.html) for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    assert sorted((tuple(r) for r in warc.op6_warc(spark, "/root/testdata/sf0.001").collect()), key=str) == expected(rows)


def test_edges(spark, tmp_path):
    rows = [(1, "http://b.example.com/x y\n", "same"), (9, None, "same"), (4, "http://a.example.com:80/p?q#f", ""), (5, "https://a.example.com/p?q", None), (6, "not a url", "é" * 50000), (7, "http://[bad/", "z"), (6, "not a url", "é" * 50000)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, size int").repartition(2)
    folder = f"file://{tmp_path}"
    directory = warc.write_index(warc.write_archives(df, f"{folder}/a", archive_bytes=200), f"{folder}/i", lines=2)
    got = warc.read(warc.search(directory, warc.keys_of(df))).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == expected([(p, h or "") for p, _, h in rows])
    assert {r.page_id: r.payload.decode() for r in got if r.record_type == "response"} == {9: "same", 5: "", 6: "é" * 50000, 7: "z"}
    assert sorted(r["page_id"] for r in warc.lookup(directory, "http://a.example.com/p?q")) == [4, 5]
    assert [r["page_id"] for r in warc.lookup(directory, "http://b.example.com/x y\n")] == [1]
    assert [r["page_id"] for r in warc.lookup(directory, "urn:page:9")] == [9] and warc.lookup(directory, "http://no.example.com/") == []
    # as WARC says: gzip members, one for each record
    import gzip
    import glob

    raw = b"".join(gzip.decompress(open(f, "rb").read()) for f in glob.glob(f"{tmp_path}/a/*.gz"))
    assert raw.count(b"WARC/1.1\r\n") == 7
    small = warc.read(warc.search(warc.write_index(warc.write_archives(df, f"{folder}/b", least=5), f"{folder}/j"), warc.keys_of(df))).collect()
    assert sorted((tuple(r)[:5] for r in small), key=str) == expected([(p, h or "") for p, _, h in rows], 5)
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read(warc.search(warc.write_index(warc.write_archives(none, f"{folder}/c"), f"{folder}/k"), warc.keys_of(df))).count() == 0


def test_shared_key(spark, tmp_path):
    """A key of many captures spans blocks and index files; all are found, and those beside it by their own keys only."""
    df = spark.createDataFrame([(k, "http://a.example/" + ("hot" if 20 <= k < 80 else f"{k:03d}"), f"page {k}") for k in range(100)], "page_id long, url string, html string").repartition(3)
    folder = f"file://{tmp_path}"
    directory = warc.write_index(warc.write_archives(df, f"{folder}/a"), f"{folder}/i", lines=7)
    assert directory.where("first_key <= 'example,a)/hot' AND last_key >= 'example,a)/hot'").select("uri").distinct().count() > 1
    assert sorted(r.page_id for r in warc.search(directory, warc.keys_of(df)).collect()) == list(range(100))
    assert sorted(r["page_id"] for r in warc.lookup(directory, "http://a.example/hot")) == list(range(20, 80))
    assert [r["page_id"] for r in warc.lookup(directory, "http://a.example/007")] == [7]

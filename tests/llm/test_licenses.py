import duckdb

from headway.llm import licenses as L


def brute(rows):
    out = {}
    for doc, text in rows:
        for k, line in enumerate((text or "").split("\n")):
            own = set(L._bigrams(L._words(line)))
            for name, t in L.TEMPLATES:
                other = set(L._bigrams(L._words(t)))
                d = 2 * len(own & other) / (len(own) + len(other))
                if d >= L.THRESHOLD:
                    out[doc, k, name] = max(d, out.get((doc, k, name), 0))
    return out


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "x\nlicensed UNDER the apache license -- version 2.0\n\n"), (4, L.TEMPLATES[6][1] + " at all\nMIT"), (5, " ".join(["Released under the MIT License."] * 400)), (6, "Released under the MIT License." + " Öé "), (7, "word " * 9000)]
    df = spark.createDataFrame([(d, t, "n") for d, t in rows], "doc_id long, text string, license string")
    got = {(r.doc_id, r.line, r.license): r.dice for r in L.scan(df).collect()}
    assert got == brute(rows) and {d for d, *_ in got} == {3, 4, 5, 6}
    assert L.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_windows(spark):
    """Notices over several lines or inside longer ones, and full texts; each best stretch against all stretches."""
    mit, apache = L.FULL[0][1], L.TEMPLATES[0][1]
    header = "\n".join(" * " + x for x in L.FULL[3][1].split("\n"))
    rows = [
        (1, "intro\n# Licensed under the Apache\n# License, Version 2.0.\nrest"), (2, "some words before it " * 3 + apache + " and many words after it" * 3), (3, "Copyright (c) someone\n\n" + mit.replace("Software", "Program", 1)),
        (4, "/*\n" + header + "\n */\ncode"), (5, apache), (6, "the license of nothing in particular\n" * 20), (1, "no notice"), (None, "This work is licensed under the\nGNU General Public\nLicense, version 3. Bye"),
    ]
    got = {(r.doc_id, r.line, r.license): r.dice for r in L.windows(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {(1, 1, "Apache-2.0"), (2, 0, "Apache-2.0"), (3, 2, "MIT"), (4, 1, "Apache-2.0"), (None, 0, "GPL-3.0")} <= set(got) and {d for d, *_ in got} == {1, 2, 3, 4, None}
    for doc, text in rows[:3]:
        b = L._words(text)
        for name in {n for d, _, n in got if d == doc}:
            best = 0
            for own in [set(L._bigrams(L._words(t))) for n, t in L.TEMPLATES + L.FULL if n == name]:
                for i in range(len(b)):
                    for j in range(i + 2, min(len(b), i + 1 + L.bounds(len(own), 0.8)[-1]) + 1):
                        own_b = set(L._bigrams(b[i:j]))
                        best = max(best, 2 * len(own & own_b) / (len(own) + len(own_b)))
            assert max(v for (d, _, n), v in got.items() if d == doc and n == name) == best


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted(tuple(r) for r in L.op4_licenses(spark, sf).collect())
    assert got == sorted((*k, v) for k, v in brute(rows).items()) and got
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert sorted(duckdb.sql(L.ORACLES["op4_licenses"]).fetchall()) == got

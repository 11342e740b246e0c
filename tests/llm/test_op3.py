import duckdb

from lexmill.llm import op3_revisits as op

SF = "/root/testdata/sf0.01"


def test_same_as_sql(spark):
    duckdb.sql(f"create or replace view pages as select * from read_parquet('{SF}/pages.parquet')")
    want = sorted(duckdb.sql(op.SQL).fetchall(), key=str)
    df = op.revisits(spark.read.parquet(f"{SF}/pages.parquet"))
    assert sorted((tuple(r) for r in df.collect()), key=str) == want
    assert {r[2] for r in want} >= {"full", "resolved", "mismatch"}


def test_hot_url_over_many_ranges_and_odd_rows(spark):
    rows = [(2 * i, "response" if i % 50 == 0 else "revisit", "HTTP://www.A.com:80/x/?utm_a=1#f", i, {"etag": '"e"', "date": str(i), "content-length": "9"}) for i in range(1, 2000)]
    rows += [(1, "response", "a.com/x", 0, {"etag": 'W/"e"', "content-length": "5", "x": "kept"}), (3, "revisit", None, 5, None), (5, "revisit", "q.com", None, {}), (7, "revisit", "q.com", 1, {}), (9, "response", None, 1, None)]
    rows += [(11, "revisit", "a.com/x", 5000, None), (13, "revisit", "a.com/x", 5000, {"etag": '"f"'}), (13, "revisit", "a.com/x", 5000, {"etag": '"f"'}), (15, "revisit", "a.com/x", 0, {"etag": '"e"'})]
    df = spark.createDataFrame([(*r, 1) for r in rows], "record_id long, kind string, url string, at long, headers map<string,string>, status int").repartition(7)
    got = {r.record_id: r for r in op.resolve(df).collect()}
    assert op.resolve(df).count() == len(rows)
    for i in range(1, 2000):
        r, at = got[2 * i], (i - 1) // 50 * 50
        if i % 50:
            assert (r.status, r.source_id) == ("resolved", 2 * at if at else 1), i
            assert r.headers["date"] == str(i) and r.headers["content-length"] == ("9" if at else "5")
    assert got[2].headers["x"] == "kept"
    assert [got[i].status for i in (3, 5, 7, 9, 11, 13, 15)] == ["no_url", "no_date", "no_earlier", "full", "no_validator", "mismatch", "no_earlier"]
    assert op.resolve(df.limit(0)).count() == 0

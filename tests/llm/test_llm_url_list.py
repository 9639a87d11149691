import datetime as dt

from cliptide.llm import url_list
from oracle_check import compare, duck

D = lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n)


def test_query_matches_sql(spark):
    assert compare(spark, duck("/root/testdata/sf0.001"), "/root/testdata/sf0.001", "op6_url_list").startswith("ok")


def test_validity(spark):
    log = [
        ("a.org", D(1), 1, True), ("a.org", D(3), 2, True), ("a.org", D(5), 3, False), ("a.org", D(9), 4, True),
        ("b.org", D(2), 1, False), ("b.org", D(4), 2, True), ("b.org", D(4), 3, False), ("c.org", D(4), 2, False), ("c.org", D(4), 2, True),
        (None, D(1), 1, True), ("d.org", None, 1, True), ("d.org", D(1), 1, None),
    ]
    got = url_list.validity(spark.createDataFrame(log, "entry string, day date, seq long, listed boolean")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([("a.org", D(1), D(5)), ("a.org", D(9), None), ("c.org", D(4), None)], key=str)


def test_screen(spark):
    log = [("bad.org", D(1), 1, True), ("bad.org", D(10), 2, False), ("x.bad.org/ads", D(5), 3, True), ("bad.org", D(20), 4, True)]
    asks = [
        (1, "http://www.bad.org/p", D(0)), (2, "http://www.bad.org/p", D(1)), (3, "http://BAD.org", D(9)), (4, "http://bad.org", D(10)),
        (5, "https://u@x.bad.org:8080/ads/1?q", D(7)), (6, "https://x.bad.org/ads", D(15)), (7, "http://notbad.org/", D(5)), (8, None, D(5)),
        (9, "no url", D(5)), (10, "http://bad.org", None), (2, "http://www.bad.org/p", D(1)), (None, "http://bad.org./", D(30)), (11, "", D(5)),
    ]
    captures = spark.createDataFrame(asks, "page_id long, url string, day date")
    changes = spark.createDataFrame(log, "entry string, day date, seq long, listed boolean")
    got = url_list.screen(captures, changes).collect()
    assert len(got) == len(asks)
    assert {(r.page_id, r.entry, r.n_active) for r in got if r.blocked} == {
        (2, "bad.org", 1), (3, "bad.org", 1), (5, "x.bad.org/ads", 2), (6, "x.bad.org/ads", 1), (None, "bad.org", 1),
    }
    assert sum(r.page_id == 2 for r in got if r.blocked) == 2
    assert url_list.screen(captures.limit(0), changes).count() == 0
    assert not any(r.blocked for r in url_list.screen(captures, changes.limit(0)).collect())


def test_no_python_in_the_plan(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    plan = url_list.screen(*url_list.derived_log(pages))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan

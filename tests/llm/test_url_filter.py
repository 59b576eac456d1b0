"""Url verdicts against a plain loop and against the registered SQL."""

import random

import duckdb
import pytest

from vertexloom.llm import url_filter as U
from vertexloom.llm.oracle import URL_FILTER
from vertexloom.llm.queries import URL_RULES
from vertexloom.operators.scratch import Scratch

SCHEMA = "page_id long, url string, html string, host string, rule string"


def canonical(target):
    return f'<html><head><LINK href="{target}" rel="canonical"></head></html>'


def redirect(target):
    return f"<meta content='0; URL={target}' http-equiv=Refresh>"


def judge(spark, rows, rules=URL_RULES):
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    found = U.judge_urls(pages, rules, Scratch(spark))
    return sorted((tuple(r) for r in found.select("page_id", "host", "path", "rule", "verdict", "reason").collect()), key=str)


def sql(rows):
    duck = duckdb.connect()
    duck.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    if rows:
        duck.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    return sorted(duck.execute(URL_FILTER).fetchall(), key=str)


ROWS = [
    (1, "http://a.example.net/es/1", None),  # blocked by a rule
    (2, "http://b.example.org/x/1#top", canonical("http://a.example.net/es/1")),  # alias of it
    (3, "HTTPS://C.Example.ORG/deep/page?utm_source=f&k=1", redirect("/other")),
    (4, "https://c.example.org/other", canonical("http://b.example.org/x/1")),  # an alias in three steps
    (5, "http://free.com/", canonical("http://a.example.net/es/1")),  # explicit allow goes first
    (6, "http://www.example.com/en/a", None),
    (7, "http://m.example.com/en/a", None),
    (8, "http://example.com/en", None),
    (9, "http://d.example.org/p", redirect("mailto:x@y")),
    (21, "http://g.example.org/p", canonical("//a.example.net/es/1")),
    (10, "http://e.example.org/p", canonical("next?a=1&amp;b=2")),
    (11, "http://e.example.org/next?a=1&b=2", redirect("http://net/fr/")),  # a blocked url that is no page
    (12, None, canonical("http://a.example.net/es/1")),
    (13, "no scheme/en/", "<link rel=canonical>"),
    (14, "", ""),
    (15, "http://b.example.org/x/1", None),
    (15, "http://b.example.org/x/1", None),
    (16, "x://COM", None),
    (17, "http://notcom/", None),
    (18, "http://com/?q=http://a.example.net/es/", None),
    (19, "http://f.example.org/?utm_source=a&utm_medium=b", "<meta http-equiv='refresh' content='5'>"),
    (None, "http://f.example.org/", canonical("#top")),
    (20, "http://é.example.org/" + "a" * 50_000, None),
]


def test_planted_cases(spark):
    found = judge(spark, ROWS)
    assert found == sql(ROWS)
    verdicts = {r[0]: (r[4], r[5]) for r in found}
    assert {i for i, v in verdicts.items() if v == ("block", "alias")} == {2, 3, 4, 10, 11, 15, 21}
    assert verdicts[1] == ("block", "rule") and verdicts[5] == ("allow", "rule")
    assert verdicts[6][0] == "allow" and verdicts[7] == ("block", "rule") and verdicts[8] == ("allow", "rule")
    assert verdicts[17] == ("allow", "default") and verdicts[12] == verdicts[14] == ("allow", "default")


@pytest.mark.parametrize("limit", [U.LISTED_RULES, 0])
def test_random_links_equal_sql(spark, monkeypatch, limit):
    monkeypatch.setattr(U, "LISTED_RULES", limit)  # 0: rules joined by a shuffle
    monkeypatch.setattr(U, "fair_share", lambda df, n: 3)  # hot keys in slices
    rng = random.Random(5)
    hosts = ["a.example.net", "b.example.org", "C.example.org", "www.example.com", "m.example.com"]

    def url():
        return f"http://{rng.choice(hosts)}/{rng.choice(['en', 'es', 'xx'])}/{rng.randrange(12)}{rng.choice(['', '', '#t', '?utm_a=1'])}"

    rows = [(i, url(), rng.choice([None, "", canonical(url()), redirect(url())])) for i in range(150)]
    found = judge(spark, rows)
    assert found == sql(rows)
    assert {r[5] for r in found} == {"rule", "alias", "default"}


def test_rules(spark):
    rows = [(1, "http://x.y/a/b", None), (2, "http://x.y/a", None), (3, "http://z.x.y/a/b/c", None), (4, "http://y/", None)]
    rules = [("X.y", "/a", False), ("x.y", "/a/b", True), ("x.y", "/a/b", False), ("y", "", False), ("", "", False)]
    assert [r[3:5] for r in judge(spark, rows, rules)] == [("x.y/a/b", "allow"), ("x.y/a", "block"), ("x.y/a/b", "allow"), ("y", "block")]
    assert [r[4] for r in judge(spark, rows, [])] == ["allow"] * 4


def test_empty_table(spark):
    assert judge(spark, []) == []


def test_no_python_in_the_plan(spark):
    pages = spark.createDataFrame([(1, "http://b.org/?utm_x=1", "")], "page_id long, url string, html string")
    plan = U.judge_urls(pages, URL_RULES, Scratch(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan

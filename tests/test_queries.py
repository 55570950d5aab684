"""Registered queries against their SQL on the smallest tables."""

from urllib.parse import unquote

import duckdb
import pytest

from labelsieve import fixtures
from labelsieve import queries as q

D = "/root/testdata/sf0.001"
TABLES = ["lineitem", "events", "documents", "part"]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return c


def rows(names, data):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(([round(r[k], 9) if isinstance(r[k], float) else r[k] for k in order] for r in data), key=str)


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_against_sql(spark, duck, name):
    got = q.queries()[name](spark, D)
    found = duck.execute(q.oracle_sql()[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == sorted(got.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(names, found.fetchall())


@pytest.mark.parametrize("name", sorted(set(q.queries()) - set(q.oracle_sql())))
def test_queries_without_sql_run(spark, name):
    assert q.queries()[name](spark, D).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_links_carry_whole_labels(spark):
    texts = {r["label_id"]: r["text"] for r in fixtures.labels(spark, D).collect()}
    got = q.queries()["translate_links"](spark, D).collect()
    assert len(got) == len(texts)
    for r in got:
        assert unquote(r["baidu"]) == "https://fanyi.baidu.com/#zh/en/" + texts[r["label_id"]]
        assert unquote(r["google"]) == "https://translate.google.com/?sl=zh-CN&tl=en&text=" + texts[r["label_id"]] + "&op=translate"

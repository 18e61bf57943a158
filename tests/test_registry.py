"""Every core query against its SQL on the smallest tables, and the shape of some plans."""

import math
import os

import pytest

from loomline.plans import registry, timeline
from loomline.session import table

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for f in os.listdir(FOLDER):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{FOLDER}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_rows_as_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    mine = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    rel = duck.sql(registry.SQL[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert mine == sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_others_run(spark, name):
    assert registry.QUERIES[name](spark, FOLDER).count() > 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark):
    context = plan(timeline.speech_context_bucketed(spark, FOLDER))
    assert "NestedLoop" not in context and "Cartesian" not in context and "Python" not in context
    for name in ("bigram_similarity_consecutive", "detect_language", "quality_report", "vtt_cues", "code_regions", "scene_changes"):
        text = plan(registry.QUERIES[name](spark, FOLDER))
        assert "Python" not in text and "Arrow" not in text and "Cartesian" not in text, name
    scan = plan(table(spark, FOLDER, "ocr_event").filter("code_likelihood AND timestamp_s > 5").select("event_id"))
    assert "PushedFilters: [IsNotNull(code_likelihood)" in scan and "text" not in scan.split("ReadSchema")[1]


def test_flagship(spark):
    assert registry.flagship(spark, FOLDER).count() > 0

"""Every query against its SQL, and the pipeline against its stages' rules."""

import duckdb
import pytest

import corpus_pipeline
from tesserae.llm import decontaminate, registry
from tesserae.llm.jaccard_join import SIMILARITY


def rows_of(df, names):
    clean = lambda v: None if v is None or v != v else v
    return sorted((tuple(clean(r[c]) for c in names) for r in df), key=str)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations", "labels"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    out = registry.QUERIES[name](spark, sf)
    rel = con.execute(registry.ORACLES[name]())
    names = [d[0] for d in rel.description]
    want = [dict(zip(names, r, strict=True)) for r in rel.fetchall()]
    assert sorted(out.columns) == sorted(names)
    assert rows_of(out.collect(), names) == rows_of(want, names)


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    n = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf).cache()
        n.append(docs.count())
        if name != "mixture":
            assert docs.columns == names, name
        if name == "benchmark":
            items = spark.read.parquet(f"{sf}/benchmark.parquet")
            assert decontaminate.report(docs, items).filter("contaminated").count() == 0
        if name == "near_duplicates":
            sets = []
            for r in docs.collect():
                w = (r["text"] or "").lower().split()
                sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
            for i, x in enumerate(sets):
                assert not any(x and len(x & y) >= SIMILARITY * len(x | y) for y in sets[:i])
    assert all(a >= b for a, b in zip(n, n[1:-1], strict=False)) and n[-1] > 0
    assert corpus_pipeline.run(spark, sf).count() == n[-1]

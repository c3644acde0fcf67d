"""Registered queries against their SQL, and the pipeline against its stages."""

from __future__ import annotations

import duckdb
import pytest

import corpus_pipeline
from cloakframe.llm.common import table
from cloakframe.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    with duckdb.connect() as db:
        for t in ("documents", "benchmark", "pages", "labels", "embeddings"):
            db.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
        found = db.execute(SQL[name])
        names = [c[0] for c in found.description]
        want = sorted(map(repr, (dict(zip(names, r)) for r in found.fetchall())))
    got = sorted(repr({c: r[c] for c in names}) for r in QUERIES[name](spark, SF).collect())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    source = "pages" if name in ("op3_main_text", "op9_warc") else "documents"
    got = QUERIES[name](spark, SF)
    # packing gives a row for each piece
    rows = got.where("piece = 0").count() if name == "op13_packing" else got.count()
    assert rows == table(spark, SF, source).count()


def test_pipeline(spark):
    docs = table(spark, SF, "documents")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF).checkpoint()
        assert after.columns == docs.columns
        ids, old = ({r.doc_id for r in d.select("doc_id").collect()} for d in (after, before))
        assert ids <= old and 0.8 * len(old) < after.count() == len(ids)
        before = after
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert {r.doc_id for r in out.collect()} == ids
    assert all(stage(spark, docs.limit(0), SF).count() == 0 for _, stage in corpus_pipeline.STAGES)


def test_pipeline_keeps_clashing_columns(spark):
    docs = table(spark, SF, "documents").selectExpr("*", "1 as doc", "2 as node", "3 as doc_key", "4 as _doc", "5 as score", "6 as secrets")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.count() > 0

"""The operators' queries against DuckDB, and the pipeline's stages."""

import glob
import os

import duckdb
import pytest

from tessera.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_duckdb(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    want = con.sql(queries.oracle_sql()[name])
    df = queries.queries()[name](spark, DATA)
    assert sorted(df.columns) == sorted(want.columns)
    got = df.select(*want.columns).collect()
    near = lambda rows: sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)
    assert near(map(tuple, got)) == near(want.fetchall())


def test_pipeline(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    first, columns, count = docs, docs.columns, docs.count()
    for _, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA).cache()
        assert docs.columns == columns and docs.count() <= count
        count = docs.count()
    packed = pipeline.STAGES[-1][1](spark, docs, DATA).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in docs.filter("octet_length(text) > 0").collect()}
    again = pipeline.run(spark, DATA).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, packed)) and first.count() >= count


def test_pipeline_on_odd_and_empty_tables(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    prose = [" ".join(f"w{i}x{k % (7 + i)}" for k in range(40)) for i in range(12)]
    rows = [(i, t, "en", "s", len(t), "a", "b", 1) for i, t in enumerate(prose)] + [(100, prose[0], None, None, None, None, None, None), (0, prose[0], "en", "s", 1, "a", "b", 1), (101, None, "en", "s", None, "a", "b", 2), (102, "", "en", "s", 0, "a", "b", 2), (None, "lost id", "en", "s", 7, "a", "b", 2)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row string, cuts string, __tokens int")
    for docs in (odd, odd.limit(0)):
        columns = docs.columns
        for name, stage in pipeline.STAGES[:-1]:
            docs = stage(spark, docs, DATA).cache()
            assert docs.columns == columns, name
            if name == "ngram_jaccard_join" and docs.count():
                assert sorted(r.doc_id for r in docs.filter("doc_id is not null").collect()) == [*range(12), 101, 102]
        assert pipeline.STAGES[-1][1](spark, docs, DATA).count() <= 2 * len(rows)

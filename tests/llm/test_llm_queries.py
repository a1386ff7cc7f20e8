"""Registered queries and the pipeline on the smallest tables."""

import duckdb
import pytest

from plumewire.llm import oracle, queries

TABLES = "documents pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_against_sql(spark, small, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    want = con.sql(oracle.SQL[name])
    got = queries.QUERIES[name](spark, small)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = sorted(repr(r) for r in want.select(*(f'"{c}"' for c in columns)).fetchall())
    assert sorted(repr(tuple(r)) for r in got.select(*columns).collect()) == rows


def test_pipeline(spark, small):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{small}/documents.parquet")
    n = docs.count()
    out = P.run(spark, small)
    got = out.collect()
    assert 0 < len(got) < n
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert len({r.doc_id for r in got}) == len(got)  # nothing comes twice
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in ordered] == sorted(r.doc_id for r in got)
    assert all(b.start == a.start + a.n_tokens for a, b in zip(ordered, ordered[1:]))
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, docs, small).columns == docs.columns


def test_pipeline_on_odd_rows(spark, small, tmp_path):
    """Null ids and texts, repeated rows, a long text, further columns with clashing names; then an empty table."""
    import corpus_pipeline as P

    good = " ".join(f"word{i % 97}x{i % 89}" for i in range(400))
    rows = [(1, good, "a", 1), (1, good, "b", 2), (None, good, None, None), (2, None, "c", 3), (3, "", "d", 4), (4, " ".join(f"v{i}" for i in range(30_000)), "e", 5), (5, "short", "f", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __pw_id string, __pw_times long")
    for name, table in (("odd", docs), ("none", docs.limit(0))):
        docs_dir = f"{tmp_path}/{name}"
        table.write.parquet(f"file://{docs_dir}/documents.parquet")
        for t in ("benchmark", "labels"):
            spark.read.parquet(f"{small}/{t}.parquet").write.parquet(f"file://{docs_dir}/{t}.parquet")
        got = [r.doc_id for r in P.run(spark, f"file://{docs_dir}").collect()]
        assert set(got) == ({1, 4} if name == "odd" else set())

import duckdb

SF = "/root/testdata/sf0.001"


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())


def test_flagship_matches_oracle_small(spark):
    import __spark_entry__ as E
    names = ["lex_block_uni", "neg_mark", "vocab", "cosine_knn", "retrofit_class", "ir_summary"]
    con = duckdb.connect()
    for t in ["documents", "benchmark", "embeddings", "labels"]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for n in names:
        s = E.queries()[n](spark, SF).toPandas()
        d = con.execute(E.oracle_sql()[n]).df()
        cols = sorted(s.columns)
        assert cols == sorted(d.columns), n
        key = lambda r: repr(r)
        sr = sorted((tuple(r) for r in s[cols].itertuples(index=False)), key=key)
        dr = sorted((tuple(r) for r in d[cols].itertuples(index=False)), key=key)
        assert sr == dr, n

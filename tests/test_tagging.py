"""Y4 tagger enrichment through mapInPandas."""

import pytest

from lexivec.operators.tagging import enrich_tags, length_tagger


def test_enrich_tags_aligned(spark):
    df = spark.createDataFrame([(1, ["a", "word", "elongated"]), (2, []), (3, ["xyz"])], "doc_id int, tok array<string>")
    got = {r["doc_id"]: (r["pos"], r["chunk"], r["ner"]) for r in enrich_tags(df, length_tagger).collect()}
    assert got[1] == (["S", "M", "L"], ["O"] * 3, ["O"] * 3)
    assert got[2] == ([], [], [])
    assert got[3] == (["S"], ["O"], ["O"])


def test_enrich_tags_rejects_misaligned(spark):
    def bad(docs):
        return [d[:-1] for d in docs], [list(d) for d in docs], [list(d) for d in docs]
    df = spark.createDataFrame([(1, ["a", "b"])], "doc_id int, tok array<string>")
    with pytest.raises(Exception, match="not aligned"):
        enrich_tags(df, bad).collect()

import hashlib

import numpy as np
from conftest import DOCS, ODD, SF001, doc
from lexivec.llm import fingerprint as fp


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_sketch_estimates_likeness_and_containment():
    rng = np.random.default_rng(1)
    w = [f"w{i}" for i in rng.integers(0, 10**6, 6000)]
    whole, part = " ".join(w), " ".join(w[:400])
    a, b = fp.sketch(whole), fp.sketch(part)
    assert abs(fp.containment(b, a) - 1) < 1e-9
    assert abs(fp.containment(a, b) - 396 / 5996) < 0.02
    assert abs(fp.likeness(a, b) - 396 / 5996) < 0.02
    assert fp.likeness(a, a) == 1 and fp.likeness(fp.sketch(""), fp.sketch(" ")) == 1 and fp.likeness(a, fp.sketch("")) == 0


def test_sketches_hold_what_lies_below_the_fraction_and_merge():
    rng = np.random.default_rng(2)
    for n, m in ((50, 3000), (4, 7), (2000, 2500)):
        a, b = " ".join(map(str, rng.integers(0, 999, n))), " ".join(map(str, rng.integers(0, 999, m)))
        for fraction in (1, 2, 8):
            low = [h for h in fp.shingle_hashes(a).tolist() if h < 2**64 // fraction]
            assert fp.sketch(a, fraction=fraction).tolist() == low
            both = np.union1d(fp.shingle_hashes(a), fp.shingle_hashes(b))
            assert fp.merge(fp.sketch(a, fraction=fraction), fp.sketch(b, fraction=fraction)).tolist() == [h for h in both.tolist() if h < 2**64 // fraction]
            assert np.array_equal(fp.from_string(fp.to_string(fp.sketch(a, fraction=fraction))), fp.sketch(a, fraction=fraction))


def expected(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for k, r in enumerate(rows):
        text, after = r[1] or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(text) // 2
        out.append((r[0], len(text), hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()))
    return out


def test_edited_text_takes_the_next_document(spark):
    import pandas as pd
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    rows = [tuple(r) for r in pd.read_parquet(f"{SF001}/documents.parquet").itertuples(index=False)]
    for n in (1, 3, 50):
        got = fp.edited_likeness(docs, n).collect()
        assert sorted((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == sorted(expected(rows))
    texts = {r[0]: r[1] for r in rows}
    order = sorted(texts, reverse=True)
    for r in got:
        a, b = shingles(texts[r["doc_id"]]), shingles(texts[order[(order.index(r["doc_id"]) + 1) % len(order)]])
        assert abs(r["near_next"] - (len(a & b) / len(a | b) if a | b else 1)) < 1e-9
        text, after = texts[r["doc_id"]], texts[order[(order.index(r["doc_id"]) + 1) % len(order)]]
        edited = shingles(text[: len(text) - len(text) // 2] + after[: len(text) // 2])
        assert abs(r["near_edited"] - (len(a & edited) / len(a | edited) if a | edited else 1)) < 1e-9
        assert r["fingerprint"] == fp.to_string(fp.sketch(texts[r["doc_id"]], fraction=1))
    assert len({round(r["near_edited"], 2) for r in got}) > 10


def test_smaller_fractions_estimate_the_same(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    whole = {r["doc_id"]: r for r in fp.edited_likeness(docs).collect()}
    kept, off = 0, []
    for r in fp.edited_likeness(docs, fraction=4).collect():
        m = len(fp.from_string(r["fingerprint"]))
        if m >= 60:
            kept += 1
            off.append(abs(r["near_edited"] - whole[r["doc_id"]]["near_edited"]))
    assert kept > 20 and max(off) < 0.25 and sum(off) / kept < 0.06


def test_a_hot_or_null_id_is_dealt_to_many_ranges(spark):
    rows = [doc(None if i % 3 == 0 else 7 if i % 3 == 1 else i, f"text number {i} of {i % 50}") for i in range(900)]
    df = fp.id_and_text(spark.createDataFrame(rows, DOCS))
    ranged = fp._in_order(df, 16).groupBy("_range").count().collect()
    assert max(r["count"] for r in ranged) < 150 and sum(r["count"] for r in ranged) == 900 + len(ranged)
    got = fp.edited_likeness(spark.createDataFrame(rows, DOCS), 16).collect()
    assert len(got) == 900
    import xxhash

    def place(r):
        h = xxhash.xxh64_intdigest(r[1].encode(), seed=42)
        return (r[0] is None, -(r[0] or 0), h - (1 << 64) if h >> 63 else h)

    want = expected(sorted(rows, key=place))
    assert sorted(map(str, want)) == sorted(str((r["doc_id"], r["n_chars"], r["edited_sha256"])) for r in got)


def test_odd_rows(spark, odd, empty):
    got = fp.edited_likeness(odd, 4).collect()
    assert len(got) == len(ODD)
    unique = [r for r in ODD if r[0] not in (None, 5)]
    by_id = {r["doc_id"]: r for r in got}
    assert all(by_id[r[0]]["n_chars"] == len(r[1] or "") for r in unique)
    assert by_id[2]["fingerprint"] == "" and by_id[2]["near_edited"] == 1.0
    assert fp.edited_likeness(empty).count() == 0 and fp.fingerprints(empty).count() == 0
    one = spark.createDataFrame([doc(1, "abcd")], DOCS)
    assert fp.edited_likeness(one).first()["edited_sha256"] == hashlib.sha256(b"abab").hexdigest()
    same = {r["fingerprint"] for r in fp.fingerprints(odd, fraction=1).where("doc_id = 5 or doc_id = -3").collect()}
    assert len(same) == 2  # equal texts, equal fingerprints

import hashlib
import re
import time

import pytest
from conftest import ODD, SF01
from hypothesis import given, settings
from hypothesis import strategies as st
from lexivec.llm import pii
from lexivec.llm.queries import op12_pii

# The contract's patterns as they stand there.
BASE = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def luhn(d):
    return sum(sum(map(int, str(int(c) * (1 + k % 2)))) for k, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = []
    for kind, pattern in enumerate(BASE):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == 1 and max(map(int, m[0].split("."))) > 255 or kind == 2 and not (16 <= len(d) <= 19 and luhn(d)) or kind == 3 and not 8 <= len(d) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


DISGUISED = [
    ("write to the.92 (at) mail2 [dot] example [dot] com now", "email", "the.92 (at) mail2 [dot] example [dot] com", "the.92@mail2.example.com"),
    ("email me at john dot smith at example dot com please", "email", "john dot smith at example dot com", "john.smith@example.com"),
    ("mail anna -at- example -dot- com today", "email", "anna -at- example -dot- com", "anna@example.com"),
    ("ask bob@example dot com", "email", "bob@example dot com", "bob@example.com"),
    ("ask bob.92 at mail2.example.com, please", "email", "bob.92 at mail2.example.com", "bob.92@mail2.example.com"),
    ("a <at> b {dot} org", "email", "a <at> b {dot} org", "a@b.org"),
    ("bob (@) example [.] com", "email", "bob (@) example [.] com", "bob@example.com"),
    ("bob_x @ example . com", "email", "bob_x @ example . com", "bob_x@example.com"),
    ("marie arobase exemple point fr", "email", "marie arobase exemple point fr", "marie@exemple.fr"),
    ("hans Klammeraffe beispiel Punkt de", "email", "hans Klammeraffe beispiel Punkt de", "hans@beispiel.de"),
    ("x аnna@exаmple.com", "email", "аnna@exаmple.com", "anna@example.com"),  # Cyrillic a
    ("ａｎｎａ＠ｅｘａｍｐｌｅ．ｃｏｍ", "email", "ａｎｎａ＠ｅｘａｍｐｌｅ．ｃｏｍ", "anna@example.com"),
    ("an​na@exa­mple.com", "email", "an​na@exa­mple.com", "anna@example.com"),
    ("call plus one five five five one two three four five six seven ok", "phone", "plus one five five five one two three four five six seven", "+15551234567"),
    ("call +1 (555) five five five, one two three four.", "phone", "+1 (555) five five five, one two three four", "+1 (555) 5551234"),
    ("tel ＋٤٩ 30 1234567.", "phone", "＋٤٩ 30 1234567", "+49 30 1234567"),
    ("pay four" + " one" * 15 + " now", "card", "four" + " one" * 15, "4" + "1" * 15),
    ("pay vier-eins-" + "eins-" * 13 + "eins now", "card", "vier-eins-" + "eins-" * 13 + "eins", "4" + "1" * 15),
    ("pay 41ll 1111 1111 111I now", "card", "41ll 1111 1111 111I", "4111 1111 1111 1111"),
    ("pay ４１１１−１１１１−１１１１−１１１１", "card", "４１１１−１１１１−１１１１−１１１１", "4111-1111-1111-1111"),
    ("host 192 dot 168 dot 1 dot 20 up", "ip", "192 dot 168 dot 1 dot 20", "192.168.1.20"),
    ("host one nine two dot one six eight dot one dot double two", "ip", "one nine two dot one six eight dot one dot double two", "192.168.1.22"),
    ("host 10[.]0[.]0[.]1", "ip", "10[.]0[.]0[.]1", "10.0.0.1"),
]


@pytest.mark.parametrize("text, kind, source, value", DISGUISED)
def test_disguises(text, kind, source, value):
    assert [(pii.KINDS[k], text[a:b], own, v) for k, a, b, own, v in pii.spans(text)] == [(kind, source, False, value)]


@pytest.mark.parametrize("text", [
    "look at the site example.com and at home", "un point de plus, one or two things at once", "the colon zwölf point at the end", "lunch @ example.com", "meet me at noon. dot the eyes", "one dot two", "",
    "Привет, мир. Ελληνικά κείμενα.", "version 1.2.3", "l0l 101 oil 10l", "a plus one and two plus three", "(at) [dot] {at}"])
def test_clean_prose_stays_clean(text):
    assert pii.spans(text) == []


def test_base_spans_stay_and_words_do_not_stretch_them():
    text = "un +1 (743) 555-3824 un deux"
    assert [s[:4] for s in pii.spans(text)] == [(3, 3, 20, True)]
    text = "аnna@example.com"  # the base span lacks the Cyrillic letter; both are told
    assert [s[:4] for s in pii.spans(text)] == [(0, 0, 16, False), (0, 1, 16, True)]
    text = "made the dot anna@example.com dot end"
    assert [s[:4] for s in pii.spans(text)] == [(0, 13, 29, True)]


@given(st.text("a1.@-+ ()_2é", max_size=60))
@settings(max_examples=600, deadline=None)
def test_base_like_the_patterns(text):
    assert pii.detected(text) == brute(text)


@given(st.lists(st.sampled_from([*"a1.@+- ", "one", " at ", " dot ", "(at)", "[.]", "​", "а", "４", "4111 1111 1111 1111", "192.168.0.1", "plus ", "double ", "é", "un"]), max_size=30).map("".join))
@settings(max_examples=600, deadline=None)
def test_spans_are_sound(text):
    found = pii.spans(text)
    assert [f[:3] for f in found if f[3]] == brute(text) and found == sorted(found) and len({f[:3] for f in found}) == len(found)
    for kind, a, b, own, value in found:
        assert 0 <= a < b <= len(text)
        assert own == (value == text[a:b]) and (kind, 0, len(value)) in brute(value)


@given(st.text("a1é​а４.@", max_size=30))
def test_offsets_of_folding(text):
    plain, at, changed = pii.folded(text)
    if at is None:
        assert plain == text
    else:
        assert len(plain) == len(at) == len(changed) and all(p == text[k] or c for p, k, c in zip(plain, at, changed))


def test_very_long_runs_take_linear_time():
    for text in ("1" * 300_000, "a" * 300_000, "1." * 150_000, "+1" + " " * 300_000, "a@" * 150_000, "one " * 75_000, "( " * 150_000, "o1l" * 100_000, "at " * 100_000, "​" * 300_000, "1 dot " * 50_000, " @ " * 100_000):
        t = time.time()
        pii.spans(text)
        assert time.time() - t < 10


def digest(spans):
    return hashlib.sha256(",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def test_whole_table_like_the_patterns(spark):
    import pandas as pd
    texts = dict(pd.read_parquet(f"{SF01}/documents.parquet")[["doc_id", "text"]].itertuples(index=False, name=None))
    got = op12_pii(spark, SF01).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    for r in got:
        base = brute(texts[r["doc_id"]] or "")
        assert r["base_sha256"] == digest(base) and [r[f"n_base_{k}"] for k in pii.KINDS] == [sum(b[0] == n for b in base) for n in range(4)]
        assert r["spans"] == ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in base)  # these texts hold no disguises
        assert [r[f"n_{k}"] for k in pii.KINDS] == [r[f"n_base_{k}"] for k in pii.KINDS]


def test_odd_rows(odd, empty, spark):
    from conftest import DOCS, doc
    got = pii.digests(pii.find(odd))
    assert got.count() == len(ODD) and {r["spans"] for r in got.collect()} == {""} and {r["base_sha256"] for r in got.collect()} == {digest([])}
    assert pii.digests(pii.find(empty)).collect() == []
    row = pii.digests(pii.find(spark.createDataFrame([doc(None, "x" * 100_000 + " a@b.cd " + "é" * 100_000 + " a (at) b.cd")] * 2, DOCS))).collect()
    assert len(row) == 2 and row[0] == row[1] and row[0]["spans"] == "email:100001:100007,email:200009:200020" and row[0]["n_email"] == 2 and row[0]["n_base_email"] == 1

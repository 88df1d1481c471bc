import random
import re

import pytest
from conftest import DOCS, ODD, SF01, doc
from hypothesis import given, settings
from hypothesis import strategies as st
from lexivec.llm import lines
from lexivec.llm.queries import op10_line_dedup


def brute(rows, least=50):
    """Numbers of the words that go from each row, by one pass in rank order
    over plain word lists; shares no code with the operator."""
    import xxhash
    ranked = []
    for k, (i, text, *_) in enumerate(rows):
        h = xxhash.xxh64_intdigest((text or "").encode(), seed=42)
        ranked.append(((i is None, i or 0, h - (1 << 64) if h >> 63 else h), k))
    ranked.sort()
    first, parted = {}, {}
    for rank, k in ranked:
        text = rows[k][1] or ""
        tokens = [(m.start(), m.end()) for m in re.finditer(r"[^ \t\n\v\f\r]+", text)]
        lower = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text[a:b]) for a, b in tokens]
        bounds = [0]
        for n, (a, b) in enumerate(tokens):
            gap = text[b : tokens[n + 1][0]] if n + 1 < len(tokens) else "\n"
            if "\n" in gap or text[b - 1] in ".!?":
                bounds.append(n + 1)
        parted[k] = (lower, bounds, rank)
        for u in range(len(bounds) - 1):
            first.setdefault(tuple(lower[bounds[u] : bounds[u + 1]]), (rank, k, u))
    out = {}
    for rank, k in ranked:
        lower, bounds, _ = parted[k]
        n = len(bounds) - 1
        unit = [tuple(lower[bounds[u] : bounds[u + 1]]) for u in range(n)]
        again = [(first[w][0], first[w][2]) != (rank, u) for u, w in enumerate(unit)]
        gone, u = set(), 0
        while u < n:
            if not again[u]:
                u += 1
                continue
            v = u
            while v + 1 < n and again[v + 1]:
                v += 1
            longest = max(range(u, v + 1), key=lambda x: (len(unit[x]), -x))
            s_rank, s_doc, s_unit = first[unit[longest]]
            s_lower, s_bounds, _ = parted[s_doc]
            s_u, s_v = s_unit - (longest - u), s_unit + (v - longest)
            before = after = 0
            same = s_rank == rank

            def src(x):
                return s_lower[s_bounds[x] : s_bounds[x + 1]] if 0 <= x < len(s_bounds) - 1 else []

            if u > 0 and src(s_u) == list(unit[u]) and not (same and u - 1 <= s_v):
                while before < min(len(unit[u - 1]), len(src(s_u - 1))) and unit[u - 1][-1 - before] == src(s_u - 1)[-1 - before]:
                    before += 1
            if v + 1 < n and src(s_v) == list(unit[v]) and not (same and s_v + 1 >= u):
                while after < min(len(unit[v + 1]), len(src(s_v + 1))) and unit[v + 1][after] == src(s_v + 1)[after]:
                    after += 1
            before, after = (x if x > 2 else 0 for x in (before, after))
            a, b = bounds[u] - before, bounds[v + 1] + after
            if b - a >= least:
                gone |= set(range(a, b))
            u = v + 1
        out[k] = gone
    return [out[k] for k in range(len(rows))]


def words_gone(text, spans):
    """Numbers of the words inside the spans; no span cuts a word."""
    out, tokens = set(), list(re.finditer(r"[^ \t\n\v\f\r]+", text))
    for a, b in spans:
        for n, m in enumerate(tokens):
            if a <= m.start() and m.end() <= b:
                out.add(n)
            else:
                assert m.end() <= a or m.start() >= b
    return out


def check(df, rows, least=50):
    got = lines.remove_repeats(df, least).collect()
    want = sorted(((r[0], r[1], sorted(g)) for r, g in zip(rows, brute(rows, least))), key=str)
    texts = {}
    found = []
    by_spans = {}
    for r in got:
        by_spans.setdefault(r["doc_id"], []).append(r)
    originals = {}
    for r in rows:
        originals.setdefault(r[0], []).append(r[1])
    for i, own in by_spans.items():
        for r in own:
            spans = [tuple(s) for s in r["_removed"]]
            source = next(t for t in originals[i] if (None if t is None else lines.cut(t, spans)) == r["text"] and (not spans or spans[-1][1] <= len(t)))
            originals[i].remove(source)
            found.append((i, source, sorted(words_gone(source or "", spans))))
            texts[i] = r["text"]
    assert sorted(found, key=str) == want
    return {r["doc_id"]: r["text"] for r in got}


def sentence(rng, words=None):
    return " ".join(f"w{rng.randrange(5000)}" for _ in range(words or rng.randint(5, 14))).capitalize() + "."


def prose(rng, n):
    return " ".join(sentence(rng) + ("\n" if rng.random() < 0.2 else "") for _ in range(n))


def test_planted_passages_go_and_clean_documents_stay(spark):
    rng = random.Random(1)
    rows, planted = [], {}
    source = [prose(rng, 30) for _ in range(4)]
    rows += [doc(k, t) for k, t in enumerate(source)]
    for k in range(40):
        words = source[k % 4].split(" ")
        at = rng.randrange(len(words) - 90)
        passage = " ".join(words[at : at + rng.randint(70, 90)])  # begins and ends inside a sentence
        passage = {0: passage, 1: passage.replace(" ", "\n", 1), 2: passage.upper(), 3: re.sub(r"(?<!\n) (?!\n)", "  ", passage)}[k % 3 if k < 36 else 3]
        host = prose(rng, 12).split(" ")
        cut = rng.randrange(1, len(host))
        rows.append(doc(100 + k, " ".join(host[:cut]) + " " + passage + " " + " ".join(host[cut:])))
        planted[100 + k] = (host, passage)
    rows += [doc(500 + k, prose(rng, 25) + " All rights reserved by the owners of this site. See the terms.") for k in range(20)]  # a stock phrase
    got = check(spark.createDataFrame(rows, DOCS), rows)
    assert all(got[i] == t for i, t, *_ in rows if i < 100 or i >= 500)
    for i, (host, passage) in planted.items():
        left = got[i].split()
        assert len(left) <= len(" ".join(host).split()) + 12, i  # at most the rest of a sentence that a line end parts, and two words at an end
    assert sum(got[i].split() == " ".join(h).split() for i, (h, _) in planted.items()) >= 15


def test_one_changed_word(spark):
    rng = random.Random(2)
    text = " ".join(sentence(rng) for _ in range(14))
    words = text.split()
    changed = [*words]
    changed[len(words) // 2] = "changed"
    rows = [doc(1, text), doc(2, "Mine first. " + " ".join(changed) + " Mine last.")]
    got = check(spark.createDataFrame(rows, DOCS), rows)
    assert got[1] == text and got[2] == "Mine first. changed Mine last."


def test_whole_lines_take_their_feed(spark):
    p = [" ".join(f"p{k}w{i}" for i in range(60)) for k in range(3)]
    rows = [doc(i, f"Own start {i}.\n{p[i % 3]}\nOwn end {i} here.") for i in range(9)]
    rows += [doc(40, p[0]), doc(41, "  " + p[1] + " \n\nlast"), doc(42, "first\n\n" + p[2])]
    got = check(spark.createDataFrame(rows, DOCS), rows)
    assert all(got[i] == rows[i][1] for i in range(3)) and all(got[i] == f"Own start {i}.\nOwn end {i} here." for i in range(3, 9))
    assert got[40] == "" and got[41] == "\nlast" and got[42] == "first\n"


@pytest.mark.parametrize("broadcast", [True, False])
def test_tables_like_brute_force(spark, broadcast, monkeypatch):
    import pandas as pd
    if not broadcast:
        monkeypatch.setattr(lines, "BROADCAST_ROWS", 3)
    rows = list(pd.read_parquet(f"{SF01}/documents.parquet")[["doc_id", "text"]].itertuples(index=False, name=None))
    check(spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "text"), rows)


def test_query_tells_spans_of_the_source(spark):
    import pandas as pd
    texts = dict(pd.read_parquet(f"{SF01}/documents.parquet")[["doc_id", "text"]].itertuples(index=False, name=None))
    got = op10_line_dedup(spark, SF01).collect()
    assert len(got) == len(texts) and sum(r["removed_chars"] > 0 for r in got) > 20
    for r in got:
        spans = [tuple(map(int, s.split("-"))) for s in r["removed_spans"].split(",") if s]
        assert r["removed_chars"] == sum(b - a for a, b in spans) and lines.cut(texts[r["doc_id"]] or "", spans) == r["text"]


def test_random_small_corpora_like_brute_force(spark):
    rng = random.Random(7)
    for _ in range(3):
        rows = []
        for i in range(40):
            text = " ".join(rng.choice(["A b.", "c", "d e f.", "G h", "\n", "x y z!", "b.", "q"]) for _ in range(rng.randint(0, 25)))
            rows.append(doc(rng.choice([i, i, 3, None]), rng.choice([text, text, None])))
        check(spark.createDataFrame(rows, DOCS), rows, 4)


def test_odd_rows(odd, empty, spark):
    got = lines.remove_repeats(odd, 1)
    assert got.columns == [*odd.columns, "_removed"] and got.count() == len(ODD)
    by = {(r["doc_id"], r["text"]) for r in got.collect()}
    assert (2, None) in by and (1, "") in by and (-3, "one two three") in by and (5, "") in by and (5, "another text of this id") in by
    check(odd.select("doc_id", "text"), [r[:2] for r in ODD], 1)
    assert lines.remove_repeats(empty).count() == 0
    passage = " ".join(f"w{i}" for i in range(60))
    twins = spark.createDataFrame([doc(1, passage), doc(1, passage), doc(2, passage), doc(None, passage), doc(None, passage)], DOCS)
    assert sorted((r["doc_id"] or 9, len(r["text"]) > 0) for r in lines.remove_repeats(twins).collect()) == [(1, True), (1, True), (2, False), (9, False), (9, False)]


def test_many_copies_of_one_passage(spark):
    rng = random.Random(3)
    passage = " ".join(sentence(rng) for _ in range(8))
    rows = [doc(i, (f"Start{i} of mine {passage} end{i}." if i % 3 == 0 else f"Other text number {i} here.")) for i in range(600)]
    got = check(spark.createDataFrame(rows, DOCS), rows)
    assert all(got[i] == f"Start{i} end{i}." for i in range(3, 600, 3)) and got[0] == rows[0][1]


@given(st.text("ab. \n", max_size=60), st.data())
@settings(max_examples=300, deadline=None)
def test_spans_are_sorted_and_apart(text, data):
    own = lines.units(text)
    assert [w for *_, u in own for w in u] == text.lower().encode().split()
    found = []
    at = 0
    while at < len(own) and data.draw(st.booleans()):
        first = data.draw(st.integers(at, len(own) - 1))
        last = data.draw(st.integers(first, len(own) - 1))
        before = data.draw(st.integers(0, len(own[first - 1][2]))) if first else 0
        after = data.draw(st.integers(0, len(own[last + 1][2]))) if last + 1 < len(own) else 0
        found.append((first, last, before, after))
        at = last + 2
    gone = lines.spans(text, found)
    assert all(0 <= a < b <= len(text) for a, b in gone) and all(x[1] <= y[0] for x, y in zip(gone, gone[1:]))
    starts = [0]
    for *_, u in own:
        starts.append(starts[-1] + len(u))
    want = {n for f, l, b, a in found for n in range(starts[f] - b, starts[l + 1] + a)}
    assert words_gone(text, gone) == want
    assert lines.cut(text, gone).split() == [w for n, w in enumerate(text.split()) if n not in want]

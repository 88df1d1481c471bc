import hashlib
import random

import public_tokenizers as P
import pytest
from conftest import ODD
from hypothesis import given, settings
from hypothesis import strategies as st
from lexivec.llm import bpe, tokens
from tokenizers import Tokenizer

WORD, BYTE = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json")
LIBRARY = {WORD: Tokenizer.from_file(WORD), BYTE: Tokenizer.from_file(BYTE)}
LETTERS = [*"abcdefgh'stredvmllé̀ΣσςİıßÅÅ  \t\n\r\x0b\x1c\x85\xa0 　…१²½ﬁ한가", "Ᲊ", "\U0001f600", "<|endoftext|>", "<|startoftext|>", "'re", "aaaa", "!!!"]


def ids(path, texts):
    return [e.ids for e in LIBRARY[path].encode_batch(texts, add_special_tokens=False)]


def test_random_texts_like_the_library():
    r = random.Random(3)
    texts = ["".join(r.choice(LETTERS) for _ in range(r.randint(0, 40))) for _ in range(5000)] + ["", "a" * 5000, "ab" * 3000, "aab" * 777]
    own = bpe.loaded(WORD).encode(texts)
    assert own.to_pylist() == ids(WORD, texts)
    assert bpe.loaded(WORD).decode(own).to_pylist() == [LIBRARY[WORD].decode(i, skip_special_tokens=False) for i in ids(WORD, texts)]
    assert tokens.loaded(BYTE, P.PATTERN).counts(texts) == [len(i) for i in ids(BYTE, texts)]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=60))
def test_any_text_like_the_library(text):
    assert bpe.loaded(WORD).encode([text]).to_pylist() == ids(WORD, [text])
    assert tokens.loaded(BYTE, P.PATTERN).counts([text]) == [len(ids(BYTE, [text])[0])]


@pytest.mark.parametrize("module", [bpe, tokens])
def test_workers_forget_beyond_their_bound(module, monkeypatch):
    monkeypatch.setattr(module, "REMEMBERED", 10)
    texts = [f"word{i} next{i} {i}" for i in range(200)]
    for at in range(0, 200, 20):
        part = texts[at : at + 20]
        if module is bpe:
            assert bpe.loaded(WORD).encode(part).to_pylist() == ids(WORD, part)
        else:
            assert tokens.loaded(BYTE, P.PATTERN).counts(part) == [len(i) for i in ids(BYTE, part)]


def test_odd_rows(odd, empty):
    texts = [r[1] or "" for r in ODD]
    key = lambda r: (r[0] is not None, r)
    got = sorted([tuple(r) for r in tokens.token_counts(odd, BYTE, P.PATTERN).collect()], key=key)
    assert got == sorted([(r[0], len(t.encode()), len(i), len(i) > 1024) for r, t, i in zip(ODD, texts, ids(BYTE, texts))], key=key)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = sorted([tuple(r) for r in bpe.digests(bpe.round_trip(odd, WORD)).collect()], key=key)
    assert got == sorted([(r[0], len(i), sha(" ".join(map(str, i))), sha(LIBRARY[WORD].decode(i, skip_special_tokens=False))) for r, i in zip(ODD, ids(WORD, texts))], key=key)
    assert sorted(r["ids"] for r in bpe.encode(odd, WORD).collect()) == sorted(ids(WORD, texts))
    assert tokens.token_counts(empty, BYTE, P.PATTERN).count() == 0 and bpe.round_trip(empty, WORD).count() == 0

"""BPE encoding and decoding in batched numpy merge rounds.

The symbols of all words that a batch meets for the first time lie in one flat
array.  In each round every neighbouring pair is looked up by binary search
over the sorted pair keys, each word picks its pair of lowest rank, and all
its occurrences merge at once; words without a known pair leave the rounds.
The vocabulary file is only read: tables come from its ``vocab`` and
``merges``; no tokenizer library encodes here.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivec.llm.common import id_and_text, in_slices

#: Distinct words that a worker remembers from batch to batch; beyond it, it starts afresh.
REMEMBERED = 1 << 17
#: White space as the file's normaliser sees it, and its pre-token pattern.
SPACE = "[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+"
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: printable
    Latin-1 as itself, the rest in order from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def newer() -> str:
    """Character class of the letters and numbers that Python's Unicode tables
    don't know yet."""
    import regex
    known = regex.compile(r"[\p{L}\p{N}]").match
    spans: list[list[int]] = []
    for c in range(0x110000):
        if unicodedata.category(chr(c)) == "Cn" and known(chr(c)):
            if spans and spans[-1][1] == c - 1:
                spans[-1][1] = c
            else:
                spans.append([c, c])
    return "[" + ("".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans) or "^\\s\\S") + "]"


@lru_cache(maxsize=2)
def loaded(path: str) -> WordBpe:
    """The file's tables, once in a worker."""
    return WordBpe(path)


class WordBpe:
    """Encodes and decodes with a BPE file that marks word ends, lower-cases
    and drops white space."""

    def __init__(self, path: str):
        import regex
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        tokens = [""] * self.size
        for t, i in [*vocab.items(), *self.special.items()]:
            tokens[i] = t
        self.tokens = pa.array(tokens)
        letters = byte_letters()
        # A letter that the vocabulary lacks makes no token: -1.
        self.inner = np.array([vocab.get(c, -1) for c in letters], np.int64)
        self.last = np.array([vocab.get(c + end, -1) for c in letters], np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)[order]
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.space = re.compile(SPACE)
        self.find = regex.compile(PRE_TOKEN).findall
        self.newer = re.compile(newer())
        self._forget()

    def _forget(self) -> None:
        self.index = {t: k for k, t in enumerate(self.special)}
        self.ids = np.array(list(self.special.values()), np.int32)
        self.ends = np.arange(len(self.special) + 1)

    def words(self, text: str) -> list[str]:
        """Pre-tokens of a text; a special string in it is one of its own."""
        out: list[str] = []
        for k, part in enumerate(self.split.split(text)):
            if k % 2:
                out.append(part)
            elif self.newer.search(part):  # rare scripts: the library's own tables decide
                out += self._newer_words(part)
            elif part:
                plain = self.space.sub(" ", unicodedata.normalize("NFC", part))
                out += self.find(plain.replace("Σ", "σ").lower())  # letter by letter: no final sigma
        return out

    @staticmethod
    def _newer_words(text: str) -> list[str]:
        from tokenizers import Regex, normalizers, pre_tokenizers
        plain = normalizers.Sequence([normalizers.NFC(), normalizers.Replace(Regex(r"\s+"), " "), normalizers.Lowercase()]).normalize_str(text)
        return [w for w, _ in pre_tokenizers.Split(Regex(PRE_TOKEN), "removed", invert=True).pre_tokenize_str(plain)]

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, and each word's number of ids."""
        data = [w.encode() for w in words]
        sizes = np.array([len(d) for d in data], np.int64)
        raw = np.frombuffer(b"".join(data), np.uint8)
        symbols, word = self.inner[raw], np.repeat(np.arange(len(words)), sizes)
        ends = np.cumsum(sizes)[sizes > 0] - 1
        symbols[ends] = self.last[raw[ends]]
        symbols, word = symbols[symbols >= 0], word[symbols >= 0]
        none = len(self.keys)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            rank = np.full(len(symbols), none, np.int64)  # of the pair that starts at each place
            key = symbols[:-1] * self.size + symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, key), none - 1)
            known = (self.keys[at] == key) & (word[:-1] == word[1:])
            rank[:-1][known] = self.ranks[at[known]]
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            lowest = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.r_[first, len(word)]))
            over = lowest == none
            if over.any():
                done.append((word[over], symbols[over]))
            hit = (rank == lowest) & ~over
            if (hit[1:] & hit[:-1]).any():  # a a a: pairs overlap, every other one merges
                place = np.arange(len(hit))
                start = np.maximum.accumulate(np.where(hit & ~np.r_[False, hit[:-1]], place, 0))
                hit &= (place - start) % 2 == 0
            found = np.flatnonzero(hit)
            symbols[found] = self.merged[at[found]]
            keep = ~over
            keep[found + 1] = False
            symbols, word = symbols[keep], word[keep]
        of, ids = (np.concatenate(x) for x in zip(*done)) if done else (np.empty(0, np.int64),) * 2
        order = np.argsort(of, kind="stable")
        return ids[order].astype(np.int32), np.bincount(of, minlength=len(words))

    def encode(self, texts: list[str]) -> pa.ListArray:
        if len(self.index) > REMEMBERED:
            self._forget()
        cut = [self.words(t) for t in texts]
        index = self.index
        new = list(dict.fromkeys(w for ws in cut for w in ws if w not in index))
        if new:
            ids, n = self.merge(new)
            index.update(zip(new, range(len(index), len(index) + len(new))))
            self.ids = np.concatenate([self.ids, ids])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(n)])
        at = np.fromiter((index[w] for ws in cut for w in ws), np.int64)
        sizes = self.ends[at + 1] - self.ends[at]
        starts = np.cumsum(sizes) - sizes
        flat = self.ids[np.repeat(self.ends[at] - starts, sizes) + np.arange(int(sizes.sum()))]
        n_words = np.cumsum([0, *map(len, cut)])
        offsets = np.r_[0, np.cumsum(sizes)][n_words]
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """The file names no decoder: tokens joined by spaces."""
        tokens = pa.ListArray.from_arrays(ids.offsets, self.tokens.take(ids.values))
        return pc.binary_join(tokens, " ")


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids`` for each row of ``docs``; null or blank text: no ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for b in in_slices(batches, 500):
            yield pa.RecordBatch.from_arrays([b.column(0), bpe.encode(b.column(1).to_pylist())], names=["doc_id", "ids"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, ids array<int>")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids, decoded``: encoding, and the decoding of those ids, in
    one pass over the texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for b in in_slices(batches, 500):
            ids = bpe.encode(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), ids, bpe.decode(ids)], names=["doc_id", "ids", "decoded"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(coded: DataFrame) -> DataFrame:
    """Digest columns of a :func:`round_trip`."""
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))

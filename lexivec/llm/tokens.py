"""Token counts without token ids.

A byte-level BPE token never crosses a pre-token, so a document's count is the
sum over its pre-tokens of the pieces each makes.  Each task counts the pieces
of a distinct pre-token once, joins those counts to the frequencies of each
document's pre-tokens, and sums.  Frequencies never leave the task: sent to a
global table they would outweigh the texts (see README).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from lexivec.llm.common import batch, id_and_text, in_slices

#: Distinct pre-tokens that a worker remembers from batch to batch; beyond it, it starts afresh.
REMEMBERED = 1 << 18


@lru_cache(maxsize=2)
def loaded(path: str, pattern: str) -> PieceCounter:
    """The tokenizer, once in a worker."""
    return PieceCounter(path, pattern)


class PieceCounter:
    """Counts tokens of texts as the tokenizers library does with the file."""

    def __init__(self, path: str, pattern: str):
        import regex
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.find = regex.compile(pattern).findall
        special = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.pieces: dict[str, int] = {}

    def frequencies(self, text: str) -> tuple[Counter, int]:
        """Pre-tokens of the text with their frequencies, and how often a
        special string, which is one token, stands in it."""
        found: Counter = Counter()
        if self.special is None or not self.special.search(text):
            found.update(self.find(text))
            return found, 0
        parts = self.special.split(text)
        for part in parts:
            found.update(self.find(part))
        return found, len(parts) - 1

    def counts(self, texts: list[str]) -> list[int]:
        documents = [self.frequencies(t) for t in texts]
        if len(self.pieces) > REMEMBERED:
            self.pieces = {}
        new = list({p for found, _ in documents for p in found if p not in self.pieces})
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            self.pieces.update(zip(part, (len(e.ids) for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False))))
        pieces = self.pieces
        return [n + sum(k * pieces[p] for p, k in found.items()) for found, n in documents]


def token_counts(docs: DataFrame, path: str, pattern: str, limit: int = 1024) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for each row of ``docs``.

    ``path`` names the tokenizer's file on every executor, ``pattern`` is its
    pre-token pattern.  Null text: empty, no tokens.  No shuffle.
    """
    out = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = loaded(path, pattern)
        for b in in_slices(batches, 1000):
            ids, texts = (c.to_pylist() for c in b.columns)
            yield batch(out, [(i, len(t.encode()), n, n > limit) for i, t, n in zip(ids, texts, counter.counts(texts))])

    return id_and_text(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")

"""Enrich token arrays with tagger output (POS, chunk, NER).

The reference pipes batches of documents through an external tagger binary and
gets three aligned tag arrays back.  Here the tagger is any caller-supplied
Python callable; Spark hands it one Arrow batch of token lists at a time
(``mapInArrow``: narrow, no shuffle, batches of at most ``TOKENS`` tokens or
one document).  No tagger is shipped;
:func:`length_tagger` is a stand-in used by the tests and the registered query.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from lexivec.session import in_slices

TOKENS = 100_000  # that a tagger gets at once, but one whole document
TAG_COLS = ("pos", "chunk", "ner")

# tokens of a batch -> (pos lists, chunk lists, ner lists), each aligned with the tokens
Tagger = Callable[[Sequence[Sequence[str]]], tuple[Sequence[Sequence[str]], Sequence[Sequence[str]], Sequence[Sequence[str]]]]


def enrich_tags(df: DataFrame, tagger: Tagger, tok_col: str = "tok") -> DataFrame:
    """Add ``pos``, ``chunk`` and ``ner`` arrays aligned with ``tok_col``.

    The tagger sees whole documents (never a prefix) a batch at a time; a tag
    array whose length differs from its token array fails the task."""
    tag_type = ArrayType(StringType())
    at = df.columns.index(tok_col)
    schema = StructType(list(df.schema.fields) + [StructField(c, tag_type) for c in TAG_COLS])

    def run(batches):
        for b in in_slices(batches, at, TOKENS):
            toks = [t if t is not None else [] for t in b.column(at).to_pylist()]
            tags = tagger(toks)
            found = []
            for name, arrays in zip(TAG_COLS, tags):
                arrays = [list(a) for a in arrays]
                if len(arrays) != len(toks) or any(len(a) != len(t) for a, t in zip(arrays, toks)):
                    raise ValueError(f"tagger returned {name} tags not aligned with the tokens")
                found.append(pa.array(arrays, pa.list_(pa.string())))
            yield pa.RecordBatch.from_arrays([*b.columns, *found], names=schema.names)

    return df.mapInArrow(run, schema)


def length_tagger(docs: Sequence[Sequence[str]]):
    """Stand-in tagger: POS = length class ``S`` (<=3), ``M`` (<=6), ``L``;
    chunk and NER are ``O`` (outside) for every token."""
    pos = [["S" if len(w) <= 3 else "M" if len(w) <= 6 else "L" for w in d] for d in docs]
    outside = [["O"] * len(d) for d in docs]
    return pos, outside, outside

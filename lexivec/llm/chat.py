"""Chat formatting with offset-aligned loss masks.

A whole conversation is rendered by one template, encoded once with offsets,
and the sorted spans of the assistant's texts are met with the token spans by
binary search.  The template's marks are special tokens, so no token crosses
from a text into a mark; control strings inside texts are escaped by one
backslash, which reading back takes off again.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivec.llm.common import shuffle_parts

START, MIDDLE, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
# Heads and tails of control strings: <|...  <s> </s> <<SYS>> <</SYS>> [INST] [/INST].  A backslash after the head takes them apart.
_TAIL = r"(?=\||/?s>|/?SYS>>|/?INST\])"
_CONTROL = re.compile(rf"([<\[])(\\*){_TAIL}")
_ESCAPED = re.compile(rf"([<\[])\\(\\*){_TAIL}")
LOSS_ROLE = "assistant"


def escape(text: str) -> str:
    return _CONTROL.sub(r"\1\2\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans of the assistant's texts."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape(role)}{MIDDLE}", escape(text)
        if role == LOSS_ROLE:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    out = []
    for part in formatted.split(END)[:-1]:
        role, _, text = part.removeprefix(START).partition(MIDDLE)
        out.append((unescape(role), unescape(text)))
    return out


def in_spans(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which tokens lie in a span: both lists are sorted, one binary search."""
    if not spans:
        return np.zeros(len(starts), bool)
    s = np.array(spans)
    k = np.searchsorted(s[:, 0], starts, "right") - 1
    return (k >= 0) & (ends <= s[np.maximum(k, 0), 1]) & (ends > starts)


def masked_texts(formatted: str, starts: np.ndarray, ends: np.ndarray, loss: np.ndarray) -> list[str]:
    """The stretches of text under the mask.  Tokens that share a character's
    bytes have the same span, so stretches join where they touch."""
    a, b = starts[loss], ends[loss]
    if not len(a):
        return []
    upto = np.maximum.accumulate(b)
    first = np.flatnonzero(np.r_[True, a[1:] > upto[:-1]])
    last = np.r_[first[1:], len(a)] - 1
    return [formatted[a[i] : upto[j]] for i, j in zip(first, last)]


def _tokenizer(path: str):
    from tokenizers import AddedToken, Tokenizer
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    t.add_special_tokens([AddedToken(x, special=True, normalized=False) for x in (START, MIDDLE, END)])
    return t


def format_conversations(rows: DataFrame, path: str) -> DataFrame:
    """``conv_id, formatted, ids, starts, ends, loss`` for each conversation:
    its tokens' ids, their spans in ``formatted`` (code points) and whether
    they count for the loss (the assistant's texts).

    Turns are ordered by ``turn``, nulls first, ties by role and text; null
    role or text: empty.  Rows without conv_id are one conversation.  A
    conversation is held whole by one task, as its encoding asks.
    """
    out = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("ids", pa.list_(pa.int32())), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("loss", pa.list_(pa.bool_()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path)

        def done(held: list[tuple]) -> pa.RecordBatch:
            rendered = [render(turns) for _, turns in held]
            cols: list[list] = [[] for _ in out]
            for (conv, _), (text, spans), e in zip(held, rendered, tokenizer.encode_batch([t for t, _ in rendered], add_special_tokens=False)):
                span = np.array(e.offsets, np.int32).reshape(-1, 2)
                for c, v in zip(cols, (conv, text, e.ids, span[:, 0], span[:, 1], in_spans(span[:, 0], span[:, 1], spans))):
                    c.append(v)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, out)], schema=out)

        held: list[tuple] = []
        for b in batches:
            for conv, role, text in zip(*(c.to_pylist() for c in b.columns)):
                if not held or held[-1][0] != conv:
                    if len(held) == 200:
                        yield done(held)
                        held = []
                    held.append((conv, []))
                held[-1][1].append((role, text))
        if held:
            yield done(held)

    slim = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                       F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    dealt = slim.repartition(shuffle_parts(rows), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(run, "conv_id long, formatted string, ids array<int>, starts array<int>, ends array<int>, loss array<boolean>")


def read_back(formatted: DataFrame) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars`` read from :func:`format_conversations`'s output."""
    out = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in out]
            lists = [b.column(k) for k in (2, 3, 4)]
            for k, (conv, text) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                starts, ends, loss = (np.asarray(c[k].values.to_numpy(zero_copy_only=False)) for c in lists)
                turns = parse(text)
                under = "".join(unescape(t) for t in masked_texts(text, starts, ends, loss.astype(bool)))
                told = "".join(f"{role}\n{said}\n" for role, said in turns)
                for c, v in zip(cols, (conv, len(turns), hashlib.sha256(told.encode()).hexdigest(), len(under), hashlib.sha256(under.encode()).hexdigest(), len(text))):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, out)], schema=out)

    return formatted.select("conv_id", "formatted", "starts", "ends", "loss").mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")

import hashlib

import public_tokenizers as P
from conftest import SF001
from hypothesis import given, settings
from hypothesis import strategies as st
from lexivec.llm import chat
from pyspark.sql import functions as F

PATH = P.path("byte_bpe_50k.json")
TURNS = "conv_id long, turn long, role string, text string"
PARTS = st.sampled_from(["<", "|", "\\", "<|", "<|im_end|>", "<|im_start|>", "<|im_sep|>", "<|endoftext|>", "</s>", "<s>", "[INST]", "[/INST]", "[", "INST]", "<<SYS>>", "<</SYS>>", "a", " ", "\n", "é"])


@settings(max_examples=500, deadline=None)
@given(st.lists(PARTS, max_size=12).map("".join))
def test_escaping_is_reversible_and_leaves_no_control_string(text):
    escaped = chat.escape(text)
    assert chat.unescape(escaped) == text
    assert not any(s in escaped for s in ("<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "<|im_sep|>"]), st.one_of(st.lists(PARTS, max_size=8).map("".join), st.text(st.characters(exclude_categories=["Cs"]), max_size=20))), max_size=6))
def test_mask_holds_each_assistant_text(turns):
    import numpy as np
    text, spans = chat.render(turns)
    assert chat.parse(text) == turns
    e = chat._tokenizer(PATH).encode(text, add_special_tokens=False)
    s = np.array(e.offsets, np.int64).reshape(-1, 2)
    under = chat.masked_texts(text, s[:, 0], s[:, 1], chat.in_spans(s[:, 0], s[:, 1], spans))
    assert [chat.unescape(t) for t in under] == [t for role, t in turns if role == "assistant" and t]


def digest(s):
    return hashlib.sha256(s.encode()).hexdigest()


def expected(rows):
    out, convs = {}, {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    for conv, turns in convs.items():
        turns.sort()
        said = "".join(t for *_, role, t in turns if role == "assistant")
        out[conv] = (len(turns), digest("".join(f"{r}\n{t}\n" for *_, r, t in turns)), len(said), digest(said))
    return out


def test_tables_read_back(spark):
    rows = spark.read.parquet(f"{SF001}/conversations.parquet").select("conv_id", "turn", "role", "text")
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat.read_back(chat.format_conversations(rows, PATH)).collect()}
    assert got == expected(map(tuple, rows.collect()))


def test_odd_rows(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", ""), (1, 1, "assistant", "tie"), (2, None, None, None), (2, 5, "assistant", "</s>[INST] ok [/INST]"), (None, 0, "assistant", "x"), (None, 0, "assistant", "x"),
            (3, 2, "assistant", "late " * 5000), (3, 0, "system", "<|im_end|>"), (3, 1, "assistant", " a \U0001f600​ ")]
    df = spark.createDataFrame(rows, TURNS).withColumn("ids", F.lit(1)).withColumn("loss", F.lit(True))
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat.read_back(chat.format_conversations(df, PATH)).collect()}
    assert got == expected(rows)
    assert chat.format_conversations(df.where("false"), PATH).count() == 0

"""Results cached by what they are made of, and the chain that
prepares a labelled corpus.

A result's folder is named by a digest of the function, its parameters and the
state of its source files, so another parameter is another result and none is
overwritten while it is read.  Each build writes a folder of its own and counts
from the moment Spark has committed it; of several the first by name is read.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexivec.functions import text as T
from lexivec.operators.corpus import encode_labels, holdout_split, merge_classes
from lexivec.operators.tagging import Tagger, enrich_tags
from lexivec.operators.vectors import l2_normalize
from lexivec.sources.readers import read_semeval, read_word_vectors

SENTIMENT = ("positive", "negative", "neutral")


def _folder(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def source_state(spark: SparkSession, path: str) -> list:
    """Name, length and time of change of each file at ``path`` (a file or a
    folder); a missing one raises."""
    fs, where = _folder(spark, path)
    if not fs.exists(where):
        raise FileNotFoundError(path)
    files, out = fs.listFiles(where, True), []
    while files.hasNext():
        f = files.next()
        out.append([f.getPath().toString(), f.getLen(), f.getModificationTime()])
    return sorted(out)


def cache_key(spark: SparkSession, name: str, sources: list[str], params: dict) -> str:
    """Digest of a result's name, parameters (values that JSON holds) and
    source files."""
    made_of = [name, params, [source_state(spark, s) for s in sources]]
    return hashlib.sha256(json.dumps(made_of, sort_keys=True).encode()).hexdigest()[:32]


def _committed(spark: SparkSession, base: str) -> str | None:
    fs, where = _folder(spark, base)
    if not fs.exists(where):
        return None
    names = sorted(s.getPath().getName() for s in fs.listStatus(where))
    return next((f"{base}/{n}" for n in names if fs.exists(_folder(spark, f"{base}/{n}/_SUCCESS")[1])), None)


def cached(spark: SparkSession, root: str, build: Callable[..., DataFrame], sources: list[str], name: str | None = None,
           force: bool = False, **params) -> DataFrame:
    """``build(spark, *sources, **params)`` as a Parquet table under ``root``,
    built where no committed one of the same name, parameters and source
    files is there.  ``force`` builds another one and returns it."""
    label = name or f"{build.__module__}.{build.__qualname__}"
    base = f"{root.rstrip('/')}/{label}/{cache_key(spark, label, sources, params)}"
    have = None if force else _committed(spark, base)
    if have is None:
        have = f"{base}/{uuid.uuid4().hex}"
        build(spark, *sources, **params).write.parquet(have)
    return spark.read.parquet(have)


def pretrained_vectors(spark: SparkSession, path: str, normalize: bool = True, **reading) -> DataFrame:
    """Word vectors of a text file, of unit length if told so (zero
    vectors stay); use with :func:`cached`."""
    v = read_word_vectors(spark, path, normalize=False, **reading)
    return v.withColumn("vec", l2_normalize(F.col("vec"))) if normalize else v


def preprocess(spark: SparkSession, path: str, labels=SENTIMENT, merged=("objective", "neutral", "objective-OR-neutral"), merged_as: str = "neutral",
               tagger: Tagger | None = None, tokenize: Callable[[Column], Column] | None = None) -> DataFrame:
    """K1: a SemEval file as ``(sid, uid, label, text, target, tok, tok_neg)``
    and, with a ``tagger``, ``pos, chunk, ner``.

    Some classes become one, a label's place in ``labels`` is its target (a
    label outside them raises), the text is normalised without lower-casing
    and cut at white space, tokens are tagged and negated contexts marked.
    Malformed lines are left out (``read_semeval`` returns them)."""
    rows, _rejects = read_semeval(spark, path)
    label = merge_classes(F.col("label"), list(merged), merged_as)
    rows = rows.withColumn("label", label).select("sid", "uid", "label", "text", encode_labels(F.col("label"), list(labels)).alias("target"),
                                                  T.split_tokens(T.normalize_text("text", lower_case=False, tokenize=tokenize)).alias("tok"))
    return (enrich_tags(rows, tagger) if tagger else rows).withColumn("tok_neg", T.mark_negation("tok"))


def write_train_valid(df: DataFrame, key: str, cols: list[str], train_path: str, valid_path: str, valid_num: float = 3000, seed: str = "42", sep: str = " ") -> None:
    """The hold-out split as two folders of text lines; no row is in
    both, none is lost."""
    from lexivec.sources.sinks import write_lines
    split = holdout_split(df, key, valid_num, seed)
    for side, path in (("train", train_path), ("valid", valid_path)):
        write_lines(split.where(F.col("split") == side), cols, path, sep)

"""Corpus/table operators: vocabulary, id sequences, label coding, filters, splits.

Global orders (frequency ranks, hash-ordered samples) use
:func:`lexivec.operators.ordering.global_index`, never a single-task window.
Per-class positions are global positions minus the class's first position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexivec.operators.lookup import lookup_tokens
from lexivec.operators.ordering import global_index, hash_order, order_cut
from lexivec.session import sized_broadcast


def vocabulary(docs: DataFrame, toks: Column, min_count: int = 1, trim_rule=None) -> DataFrame:
    """Token frequencies ``(word, cnt)`` with ``cnt >= min_count``.
    Map-side partial counts, then one shuffle of (word, partial count).

    Y5: ``trim_rule(word, cnt) -> Column`` may return ``'keep'`` (kept
    whatever the count), ``'discard'`` (dropped) or null (``min_count``
    decides), like a Word2Vec vocabulary trim callback, but as a column
    expression evaluated inside the plan."""
    ex = docs.select(F.explode(toks).alias("word"))
    counts = ex.groupBy("word").agg(F.count(F.lit(1)).alias("cnt"))
    default = F.col("cnt") >= min_count
    if trim_rule is None:
        return counts.where(default)
    rule = trim_rule(F.col("word"), F.col("cnt"))
    return counts.where(F.when(rule == "keep", True).when(rule == "discard", False).otherwise(default))


def word_index(vocab: DataFrame) -> DataFrame:
    """Ids from 1 by frequency descending (ties by word): ``(word, idx, cnt)``."""
    return global_index(vocab, [F.col("cnt").desc(), F.col("word")], "idx")


def top_words(vocab: DataFrame, k: int) -> DataFrame:
    """The ``k`` most frequent words with their ids 1..k (same ids as
    :func:`word_index`).  A distributed top-k (each task keeps k rows, then
    one merge of bounded size) instead of a global order over the vocabulary."""
    top = vocab.orderBy(F.col("cnt").desc(), F.col("word")).limit(k)
    return top.withColumn("idx", F.row_number().over(Window.orderBy(F.col("cnt").desc(), F.col("word"))).cast("long"))


def to_ids(docs: DataFrame, toks: Column, index: DataFrame, max_words: int | None = None,
           id_col: str = "doc_id") -> DataFrame:
    """N5 texts->sequences: map tokens to ids, dropping unknown ids and ids
    ``>= max_words``.  Documents are not shuffled while the index fits a
    broadcast (:func:`lookup_tokens`); a null token array gives no ids."""
    kept = index if max_words is None else index.where(F.col("idx") < max_words)
    found = lookup_tokens(docs, toks, kept.select(F.col("word").alias("key"), F.col("idx").cast("int").alias("value")), id_col)
    return found.select(id_col, F.array_compact("found").alias("ids"))


def pad_sequences(ids: Column, maxlen: int, value: int = 0) -> Column:
    """V5: pre-pad with ``value`` and keep the last ``maxlen`` ids (Keras defaults)."""
    n = F.size(ids)
    kept = F.slice(ids, F.greatest(n - maxlen, F.lit(0)) + 1, maxlen)
    return F.concat(F.array_repeat(F.lit(value), F.greatest(F.lit(maxlen) - n, F.lit(0))), kept)


def distinct_id_ngrams(ids: Column, n: int) -> Column:
    """Distinct n-grams of an id list, as ``a,b`` strings in first-seen order."""
    from lexivec.functions.text import ngrams
    return F.array_distinct(ngrams(F.transform(ids, lambda x: x.cast("string")), n, sep=","))


def ngram_dictionary(seqs: DataFrame, ids_col: str, ngram_range: int, start: int) -> DataFrame:
    """Distinct id n-grams (2..ngram_range) over the corpus with dense ids
    from ``start`` (sorted n-gram order: the reference's set order is arbitrary)."""
    parts = [seqs.select(F.explode(distinct_id_ngrams(F.col(ids_col), n)).alias("ngram")) for n in range(2, ngram_range + 1)]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return global_index(u.distinct(), [F.col("ngram")], "token", start=start)


def add_ngrams(seqs: DataFrame, ids_col: str, dictionary: DataFrame, ngram_range: int,
               id_col: str = "doc_id") -> DataFrame:
    """V6: append ids of known n-grams.  For each start position ``i`` (only
    while ``i <= len - ngram_range``) and n = 2..ngram_range, in that order."""
    from lexivec.functions.text import ngrams
    dic = sized_broadcast(dictionary.select(F.col("ngram").alias("_g"), F.col("token").alias("_tok")))
    s = seqs.select(id_col, F.col(ids_col).alias("_ids")).repartition(id_col)
    toks = F.transform("_ids", lambda x: x.cast("string"))
    # n-gram lists for n = 2..R zipped by start position, cut to the starts
    # i <= len - R; arrays are HOF arguments (never captured in a lambda), so
    # the work stays linear in the sequence length.
    zipped = F.arrays_zip(*[ngrams(toks, n, sep=",").alias(f"g{n}") for n in range(2, ngram_range + 1)])
    starts = F.slice(zipped, 1, F.greatest(F.size("_ids") - ngram_range + 1, F.lit(0)))
    ex = s.select(id_col, F.posexplode(starts).alias("i", "_z"))
    ex = ex.select(id_col, "i", F.inline(F.array(*[F.struct(F.lit(n).alias("n"), F.col(f"_z.g{n}").alias("_g"))
                                                   for n in range(2, ngram_range + 1)])))
    hits = ex.join(dic, "_g").groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("i", "n", "_tok"))).alias("_xs"))
    out = s.join(hits, id_col, "left")
    extra = F.coalesce(F.transform("_xs", lambda x: x["_tok"].cast("int")), F.array().cast("array<int>"))
    return out.select(id_col, F.concat(F.col("_ids").cast("array<int>"), extra).alias("ids"))


def encode_labels(label: Column, labels: list[str]) -> Column:
    """Index of ``label`` in the ordered class list; unknown labels raise."""
    arr = F.array(*[F.lit(x) for x in labels])
    pos = F.array_position(arr, label)
    return F.when(pos > 0, (pos - 1).cast("int")).otherwise(F.raise_error(F.concat(F.lit("unknown label: "), label)))


def decode_labels(target: Column, labels: list[str]) -> Column:
    """Inverse of :func:`encode_labels`."""
    return F.element_at(F.array(*[F.lit(x) for x in labels]), target + 1)


def merge_classes(label: Column, classes: list[str], new_class: str) -> Column:
    """P25: relabel a set of classes to one."""
    return F.when(label.isin(*classes), F.lit(new_class)).otherwise(label)


def one_hot(target: Column, k: int) -> Column:
    """One-hot int array of length k."""
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (i == target).cast("int"))


def _field(name: str):
    return lambda s: s[name]


def keep_on(df: DataFrame, keep_on_col: str, keep: list[str], parallel: list[str]) -> DataFrame:
    """Keep positions whose ``keep_on_col`` value is in ``keep``, across all
    parallel array columns (pure, unlike the in-place reference)."""
    z = F.filter(F.arrays_zip(*[F.col(c) for c in parallel]), lambda s: s[keep_on_col].isin(*keep))
    return df.select(*[c for c in df.columns if c not in parallel],
                     *[F.transform(z, _field(c)).alias(c) for c in parallel])


def drop_on(df: DataFrame, drop_on_col: str, drop: list[str], parallel: list[str]) -> DataFrame:
    """Complement of :func:`keep_on`."""
    z = F.filter(F.arrays_zip(*[F.col(c) for c in parallel]), lambda s: ~s[drop_on_col].isin(*drop))
    return df.select(*[c for c in df.columns if c not in parallel],
                     *[F.transform(z, _field(c)).alias(c) for c in parallel])


def stratified_split(df: DataFrame, cls: str, order: list, ratio: float = 0.9) -> DataFrame:
    """Per class, the first ``floor(n * ratio)`` rows (in ``order``) go to
    train, the rest to test.  Adds ``split``.  Skew-safe: positions come from
    one global range-partitioned order, per-class offsets from a class table."""
    g = global_index(df, [F.col(cls)] + list(order), "_g")
    stats = g.groupBy(cls).agg(F.min("_g").alias("_first"), F.count(F.lit(1)).alias("_n"))
    j = g.join(sized_broadcast(stats), cls)
    in_train = (F.col("_g") - F.col("_first")) < F.floor(F.col("_n") * F.lit(ratio))
    return j.withColumn("split", F.when(in_train, F.lit("train")).otherwise(F.lit("test"))).drop("_g", "_first", "_n")


def holdout_split(df: DataFrame, key: str, valid_num: float = 3000, seed: str = "42") -> DataFrame:
    """Exactly ``valid_num`` rows (or ``floor(ratio*n)`` when
    ``0 <= valid_num <= 1``) to ``valid`` by hash order, the rest ``train``.

    The last valid place of the order is found first (:func:`order_cut`), so
    rows are neither sorted nor moved: the split is a comparison beside them.
    ``key`` names a row; rows that share one fall on the same side, with the
    last place's all valid.  A null key comes first."""
    n = int(df.count() * valid_num) if 0 <= valid_num <= 1 else int(valid_num)
    cut = order_cut(df, key, n, seed)
    if cut is None:
        return df.withColumn("split", F.lit("valid" if n > 0 else "train"))
    h, k = F.coalesce(hash_order(F.col(key), seed), F.lit("")), F.col(key)
    inside = (h < cut[0]) | ((h == cut[0]) & (k.isNull() if cut[1] is None else k <= F.lit(cut[1])))
    return df.withColumn("split", F.when(inside, F.lit("valid")).otherwise(F.lit("train")))


def truncate(df: DataFrame, n: int | None, order: list) -> DataFrame:
    """First ``n`` rows in ``order``; 0 or None keeps everything."""
    return df if not n else df.orderBy(*order).limit(n)


def systematic_sample(df: DataFrame, order: list, k: int) -> DataFrame:
    """Every k-th row of the sorted frame (positions 0, k, 2k, ...)."""
    g = global_index(df, order, "_g", start=0)
    return g.where(F.col("_g") % k == 0).drop("_g")


def sample_lexicon(lexicon: DataFrame, n: int, seed: str = "42", key: str = "term") -> DataFrame:
    """T4: ``n`` terms without replacement in a deterministic hash order
    (``md5(term || seed)``; the same order in any engine)."""
    return lexicon.orderBy(hash_order(F.col(key), seed), F.col(key)).limit(n)


def class_sample(df: DataFrame, cls: str, key: str, k: int, seed: str = "42") -> DataFrame:
    """At most ``k`` rows per class in hash order (shuffle + truncate).

    Each task ranks (class, key) alone and keeps ``k`` a class before the
    exchange (Spark's group limit), so a class of any size reaches its last
    task as ``k`` rows a task; whole rows meet the chosen keys by a semi join.
    ``key`` names a row: rows that share one are chosen together."""
    h = F.coalesce(hash_order(F.col(key), seed), F.lit(""))
    place = F.row_number().over(Window.partitionBy("_c").orderBy("_h", "_k"))
    asked = df.select(F.col(cls).alias("_c"), F.col(key).alias("_k"), h.alias("_h"))
    chosen = asked.withColumn("_i", place).where(F.col("_i") <= k).select("_c", "_k")
    same = F.col("_c").eqNullSafe(F.col(cls)) & F.col("_k").eqNullSafe(F.col(key))
    return df.join(sized_broadcast(chosen), same, "left_semi")


def embedding_matrix(index: DataFrame, vectors: DataFrame, max_words: int, dim: int) -> DataFrame:
    """V4: ``(idx, vec)`` for ids below ``max_words``; words without a vector
    get zeros."""
    idx = index.where(F.col("idx") < max_words).select("word", "idx")
    j = idx.join(vectors.select("word", "vec"), "word", "left")
    return j.select("idx", "word", F.coalesce("vec", F.array_repeat(F.lit(0.0), dim)).alias("vec"))


def dict_vectorize(df: DataFrame, map_col: str, id_col: str = "doc_id", sep: str = "=") -> tuple[DataFrame, DataFrame]:
    """M8: feature maps ``name -> value`` as sparse vectors over sorted feature
    names (a dictionary vectorizer with sorted names).  Numeric values are
    kept; string values become one-hot features ``name=value`` with 1.0.

    Returns ``(vectors, names)``: ``vectors(id, indices, values)`` with
    indices ascending, and ``names(name, idx)`` from 0 (its row count is the
    vector size).  Indices come from one global order of the distinct names
    (no single-task window); entries are regrouped per row id, so a group
    never holds more than one row's own map."""
    ex = df.select(id_col, F.explode_outer(map_col).alias("_k", "_v"))
    if isinstance(df.schema[map_col].dataType.valueType, T.StringType):
        name, val = F.concat_ws(sep, "_k", "_v"), F.lit(1.0)
    else:
        name, val = F.col("_k"), F.col("_v").cast("double")
    ex = ex.select(id_col, F.when(F.col("_k").isNotNull(), name).alias("name"), val.alias("val"))
    names = global_index(ex.where(F.col("name").isNotNull()).select("name").distinct(), [F.col("name")], "idx", start=0)
    j = ex.join(sized_broadcast(names), "name", "left")
    entry = F.when(F.col("idx").isNotNull(), F.struct(F.col("idx").cast("int").alias("i"), F.col("val").alias("v")))
    g = j.groupBy(id_col).agg(F.array_sort(F.collect_list(entry)).alias("_e"))
    vectors = g.select(id_col, F.transform("_e", lambda e: e["i"]).alias("indices"),
                       F.transform("_e", lambda e: e["v"]).alias("values"))
    return vectors, names

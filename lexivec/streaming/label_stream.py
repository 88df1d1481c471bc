"""Streaming normalise -> tokenise -> distant label.

:func:`opinion_tweets` is the stream of a tweet log: a text source, the log's
row parser, a lookup of tokens in a static table and a file sink, all without
state in append mode.  :func:`label_stream` labels tables of documents against
lexicons of any size: ``readStream`` over the text table, the same
column functions as the batch path, and ``foreachBatch`` applying the batch
distant-label operator.  A document is one row, so every document is complete
inside its micro-batch and no streaming state is needed.  Each batch writes
to its own ``batch_id=N`` folder with overwrite, so a retried batch replaces
its own output (idempotent sink).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexivec.functions import text as T
from lexivec.functions import tweets as W
from lexivec.operators import lexicon as L
from lexivec.operators.lookup import lookup_tokens
from lexivec.session import ensure_checkpoint_dir, sized_broadcast
from lexivec.sources.readers import parse_tweet_log


def label_stream(spark: SparkSession, source_dir: str, schema, positives: DataFrame, negatives: DataFrame,
                 out_dir: str | None = None, id_col: str = "doc_id", text_col: str = "text",
                 max_files_per_trigger: int = 1, glob: str | None = None) -> DataFrame:
    """Run the labelling stream to completion (``availableNow``) over the
    parquet files of ``source_dir`` (a folder or a glob path, optionally
    filtered by file ``glob``) and return its output; a source without files
    gives no rows."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    run = f"{base}/label_stream/{uuid.uuid4().hex}"
    out_dir = out_dir or f"{run}/out"
    # Word table prepared once (size-checked, cached) and reused by every batch.
    words = sized_broadcast(L.label_words(positives, negatives).cache())

    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    stream = reader.parquet(source_dir)
    normed = stream.select(id_col, T.tokens(T.normalize_text(text_col)).alias("tok"))

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        from lexivec.sources.tables import spread
        res = L.distant_label(spread(batch), F.col("tok"), None, None, id_col=id_col, words=words)
        res.write.mode("overwrite").parquet(f"{out_dir}/batch_id={batch_id}")

    # Without files no batch runs; the output has its columns all the same.
    write_batch(spark.createDataFrame([], normed.schema), -1)
    q = (normed.writeStream.foreachBatch(write_batch)
         .option("checkpointLocation", f"{run}/checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(out_dir).drop("batch_id")


def labelled_tweets(lines: DataFrame, positives: DataFrame, negatives: DataFrame, preserve_case: bool = True) -> DataFrame:
    """``(tweet_id, text, label, first_pos)`` of the log lines (column
    ``value``, batch or stream) that hold a word of either set.

    URLs and user names become placeholders, the tweet tokenizer cuts the
    text, and the first token of ``positives`` or ``negatives`` (both
    ``(term)``; the first wins where both hold it) gives the label.  Tokens
    are looked up inside their row's batch, so a stream needs no state; word
    sets beyond a broadcast's bound need :func:`label_stream`, a stream over
    them doesn't start."""
    text = T.replace_users(T.replace_urls("text"))
    cut = F.filter(F.split(F.array_join(W.tweet_tokens(text, preserve_case), " "), r"\s+"), lambda w: w != "")
    rows = parse_tweet_log(lines).select(F.struct("tweet_id", "text").alias("tweet"), cut.alias("tok"))
    words = L.label_words(positives, negatives).select(F.col("_key").alias("key"), F.col("_lab").alias("value"))
    found = lookup_tokens(rows, F.col("tok"), words, id_col="tweet")
    hit = F.transform("found", lambda w: w.isNotNull())
    return found.where(F.array_contains(hit, True)).select("tweet.tweet_id", "tweet.text", F.array_compact("found")[0].alias("label"),
                                                           (F.array_position(hit, True) - 1).alias("first_pos"))


def opinion_tweets(spark: SparkSession, log_dir: str, positives: DataFrame, negatives: DataFrame, out_dir: str, checkpoint: str,
                   preserve_case: bool = True, max_files_per_trigger: int | None = None, trigger: dict | None = None):
    """Start the stream of a growing tweet log: :func:`labelled_tweets` of
    each new file of ``log_dir``, appended to the Parquet table ``out_dir``.

    Returns the running query; ``trigger`` is ``writeStream.trigger``'s (all
    files present, then stop, if not told).  ``checkpoint`` keeps what was
    read: after a failure or new files a run goes on where the last ended,
    and the file sink's log counts each batch once."""
    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    found = labelled_tweets(reader.load(log_dir), positives, negatives, preserve_case)
    return (found.writeStream.format("parquet").outputMode("append").option("path", out_dir).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())

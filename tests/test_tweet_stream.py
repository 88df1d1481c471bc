"""The stream of a tweet log against its batch form and a plain loop."""

import pytest
from pyspark.sql import functions as F

from lexivec.sources import readers as RD
from lexivec.sources import sinks
from lexivec.streaming.label_stream import labelled_tweets, opinion_tweets

TWEETS = [("1", "so happy :) today"), ("2", "meh :( but :)"), ("3", "nothing here"), ("4", "it's \\ 'quoted'\n:) \t tab"),
          ("5", ""), ("6", None), ("7", "@you see http://a.b/c?d=:-1 and :)"), ("8", "été :("), ("2", "meh :( but :)")]
WANT = {("1", "positives", 2), ("2", "negatives", 1), ("4", "positives", 5), ("7", "positives", 4), ("8", "negatives", 1)}


@pytest.fixture()
def words(spark):
    return spark.createDataFrame([(":)",), ("both",)], "term string"), spark.createDataFrame([(":(",), ("both",)], "term string")


def test_log_round_trip(spark, tmp_path):
    df = spark.createDataFrame(TWEETS, "tweet_id string, text string")
    sinks.write_tweet_log(df, str(tmp_path / "log"))
    back = RD.parse_tweet_log(spark.read.text(str(tmp_path / "log"))).collect()
    assert sorted((r.tweet_id, r.text) for r in back) == sorted((i, t or "") for i, t in TWEETS)


def test_stream_goes_on_where_it_ended(spark, tmp_path, words):
    log, out, state = (str(tmp_path / n) for n in ("log", "out", "state"))
    df = spark.createDataFrame(TWEETS, "tweet_id string, text string")
    sinks.write_tweet_log(df.limit(2).coalesce(1), log)
    opinion_tweets(spark, log, *words, out, state).awaitTermination()
    first = {(r.tweet_id, r.label) for r in spark.read.parquet(out).collect()}
    assert first == {("1", "positives"), ("2", "negatives")}
    later = str(tmp_path / "later")
    sinks.write_tweet_log(spark.createDataFrame(TWEETS[2:], df.schema), later)
    spark.read.text(later).write.mode("append").text(log)
    for _ in range(2):  # the second run finds nothing new
        opinion_tweets(spark, log, *words, out, state, max_files_per_trigger=1).awaitTermination()
    rows = [(r.tweet_id, r.label, r.first_pos) for r in spark.read.parquet(out).collect()]
    assert set(rows) == WANT and len(rows) == 6  # tweet 2 stands in the log twice
    batch = labelled_tweets(spark.read.text(log), *words)
    assert sorted((r.tweet_id, r.label, r.first_pos) for r in batch.collect()) == sorted(rows)


def test_broken_lines_and_words_in_both_sets(spark, words):
    lines = spark.createDataFrame([("no tuple",), ("('id', u'1')\t('text', u'both')",), ("('x', 1)\t('text', u':(')",), ("('id', u'2')\t('text', u'open",), (None,)], "value string")
    got = {(r.tweet_id, r.label) for r in labelled_tweets(lines, *words).collect()}
    assert got == {("1", "positives"), (None, "negatives")}
    assert labelled_tweets(lines, words[0].limit(0), words[1].limit(0)).count() == 0
    assert labelled_tweets(lines.limit(0), *words).select(F.count("*")).first()[0] == 0

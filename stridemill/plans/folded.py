"""Queries by sketches, streams, expansions and stored vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import expand, search, sketches
from ..runtime import shared_folder
from ..sources import vectors
from ..streaming import folds
from .catalogue import C, _query, _table, _vectors


@_query("SELECT CAST(floor(value) AS BIGINT) AS value, count(*) AS n FROM events GROUP BY 1 HAVING count(*) > 0.01 * (SELECT count(value) FROM events)")
def heavy_values(spark, sf_dir):
    """Whole values that more than 1 % of all events have: candidates by a sketch, then counted."""
    events = _table(spark, sf_dir, "events").select(F.floor("value").alias("whole"))
    return sketches.heavy_hitters(events, "whole", 0.01)


_WORDS = "SELECT doc_id, lang, unnest(list_filter(string_split(coalesce(text, ''), ' '), lambda w: w <> '')) AS w FROM documents"


def _words(text):
    return F.filter(F.split(F.coalesce(text, F.lit("")), " "), lambda w: w != "")


@_query(f"WITH w AS ({_WORDS}), n AS (SELECT lang, count(*) AS whole FROM w GROUP BY 1) SELECT w.lang, w AS value, count(*) AS n FROM w JOIN n ON w.lang IS NOT DISTINCT FROM n.lang GROUP BY 1, 2, whole HAVING count(*) > 0.01 * whole")
def heavy_words(spark, sf_dir):
    """Words that are more than 1 % of their language's."""
    words = expand.expanded(_table(spark, sf_dir, "documents").select("lang", _words(F.col("text")).alias("words")), F.col("words"), "word").select("lang", "word")
    return sketches.heavy_hitters(words, "word", 0.01, ["lang"])


@_query("SELECT event_type, count(DISTINCT user_id) AS users, true AS within FROM events GROUP BY 1")
def distinct_users(spark, sf_dir):
    """Whether the sketch's estimate is within 5 % (or 3) of the distinct users of each type."""
    events = _table(spark, sf_dir, "events")
    exact = events.groupBy("event_type").agg(F.countDistinct("user_id").alias("users"))
    both = exact.join(sketches.distinct_counts(events, "user_id", ["event_type"]), "event_type")
    return both.select("event_type", "users", (F.abs(F.col("estimate") - F.col("users")) <= F.greatest(F.lit(3.0), 0.05 * F.col("users"))).alias("within"))


@_query("SELECT l_returnflag, CAST(q AS DOUBLE) AS quantile, n, true AS within FROM (SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1), (SELECT unnest([0.01, 0.5, 0.99]) AS q)")
def sketched_quantiles(spark, sf_dir):
    """Whether ranks of the sketch's quantiles are within the error that it states."""
    lines = _table(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice")
    found = sketches.approximate_quantiles(lines, "l_extendedprice", (0.01, 0.5, 0.99), ["l_returnflag"])
    less, upto = F.sum((F.col("l_extendedprice") < F.col("value")).cast("long")), F.sum((F.col("l_extendedprice") <= F.col("value")).cast("long"))
    ranked = lines.join(F.broadcast(found), "l_returnflag").groupBy("l_returnflag", "quantile", "n", "error").agg(less.alias("less"), upto.alias("upto"))
    at = F.col("quantile") * (F.col("n") - 1)
    return ranked.select("l_returnflag", "quantile", "n", ((F.col("less") - F.col("error") - 1 <= at) & (at <= F.col("upto") + F.col("error"))).alias("within"))


@_query("SELECT event_id, unnest(json_keys(props)) AS item_key, json_extract_string(props, '$.' || unnest(json_keys(props))) AS item_value FROM events WHERE props IS NOT NULL")
def expanded_props(spark, sf_dir):
    """A row for each key of each event's properties."""
    events = _table(spark, sf_dir, "events")
    return expand.expanded(events, F.from_json("props", "map<string,string>")).select("event_id", "item_key", "item_value")


@_query(f"WITH w AS (SELECT doc_id, count(*) AS n FROM ({_WORDS}) GROUP BY 1), d AS (SELECT doc_id, text, coalesce(n, 0) AS n FROM documents LEFT JOIN w USING (doc_id)) SELECT doc_id, CAST(sum(n) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - n AS BIGINT) AS first, n AS words FROM d")
def word_offsets(spark, sf_dir):
    """Where each document's words begin if all documents' words are laid one after another."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.size(_words(F.col("text"))).cast("long").alias("words"))
    return expand.offsets(docs, ["doc_id"], F.col("words")).select("doc_id", "first", "words")


@_query("SELECT conv_id, turn, length(w) AS size, count(*) AS n FROM (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS w FROM conversations WHERE text IS NOT NULL) GROUP BY 1, 2, 3")
def expanded_turns(spark, sf_dir):
    """How many words of each length each turn has: an opaque function that makes any number of rows of one."""

    def split(batch):
        own = [(t.split(" ") if t is not None else []) for t in batch.column("text").to_pylist()]
        return [len(w) for w in own], {"size": [len(w) for x in own for w in x]}

    made = expand.expanded_python(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), ["text"], split, "size long")
    return made.groupBy("conv_id", "turn", "size").agg(F.count("*").alias("n"))


def _stored(spark, sf_dir):
    """The table's vectors, written as 16-bit shards and read back."""
    vectors.register(spark)
    place = shared_folder(spark, "vectors")
    corpus, _ = _vectors(spark, sf_dir)
    corpus.write.format("vector_shards").option("shards", C).mode("append").save(place)
    return spark.read.format("vector_shards").load(place)


_ROUNDED = "SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x = 0 THEN 0.0::DOUBLE ELSE round_even(x::DOUBLE * pow(2, 7 - floor(log2(abs(x::DOUBLE)))), 0) / pow(2, 7 - floor(log2(abs(x::DOUBLE)))) END) AS e FROM embeddings"


@_query(f"SELECT vec_id, CAST(vec_id % {C} AS INTEGER) AS colocation_index, CAST(e AS FLOAT[]) AS embedding FROM ({_ROUNDED})")
def vectors_in_16_bits(spark, sf_dir):
    """What comes back of the vectors, bit by bit."""
    return _stored(spark, sf_dir).select("vec_id", "colocation_index", "embedding")


@_query(f"WITH r AS ({_ROUNDED}), s AS (SELECT q.vec_id AS query_id, c.vec_id AS best_index, list_inner_product(q.e, c.e) AS sim FROM r q JOIN r c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id), t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, best_index) AS rn FROM s) SELECT query_id, best_index, round(sim, 6) AS best_similarity FROM t WHERE rn = 1")
def search_in_16_bits(spark, sf_dir):
    """The search over stored vectors: products of rounded entries, summed in doubles."""
    stored = _stored(spark, sf_dir).select("vec_id", "embedding")
    found = search.search_dot(stored, stored.filter("vec_id % 20 = 0"), C)
    return found.select("query_id", "best_index", F.round("best_similarity", 6).alias("best_similarity"))


#: Files that a table is replayed in, and so batches of its stream.
FILES = 4


def _replayed(spark, sf_dir):
    """Events as a stream in order of time; a last row of another kind lets all windows end."""
    events = _table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    end = spark.range(1).select(F.expr("timestamp'2200-01-01 00:00:00'").alias("ts"), F.lit(None).cast("long").alias("user_id"), F.lit("end").alias("event_type"), F.lit(0.0).alias("value"))
    return folds.replayed(events.unionByName(end), "ts", shared_folder(spark, "replay"), FILES)


def _run(spark, result):
    place = shared_folder(spark, "stream")
    folds.run(result, place, shared_folder(spark, "stream-checkpoint")).awaitTermination()
    return folds.results(spark, place, result.schema).drop("batch")


@_query("WITH e AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, CAST(epoch_us(min(ts)) AS BIGINT) AS start_us, CAST(epoch_us(max(ts)) AS BIGINT) + 21600000000 AS end_us, count(*) AS n, round(sum(value), 2) AS total FROM s GROUP BY user_id, k")
def stream_sessions(spark, sf_dir):
    """Every user's sessions, folded from a stream."""
    result = folds.sessions(_replayed(spark, sf_dir), "ts", "6 hours", "1 day", ["user_id"], n=F.count("*"), total=F.round(F.sum("value"), 2))
    return _run(spark, result).filter("user_id IS NOT NULL").select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n", "total")


@_query("SELECT event_type, CAST(epoch_us(date_trunc('day', ts)) AS BIGINT) AS start_us, count(*) AS n, max(value) AS top FROM events GROUP BY 1, 2")
def stream_days(spark, sf_dir):
    """Each day's events by type, folded from a stream."""
    result = folds.windows(_replayed(spark, sf_dir), "ts", "1 day", "1 day", ["event_type"], n=F.count("*"), top=F.max("value"))
    return _run(spark, result).filter("event_type <> 'end'").select("event_type", F.unix_micros("start").alias("start_us"), "n", "top")

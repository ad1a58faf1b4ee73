"""The query catalogue: name -> Spark query, and the DuckDB statement that checks it.

T = 8 workers and C = 4 shards throughout.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import runtime
from ..errors import EngineError
from ..functions import split
from ..operators import fold, loops, nbody, search
from ..operators.sharded import ShardedVector
from ..operators.vector import PositionalVector
from ..sources import generators
from ..sources.frame import KEY, IndexedFrame
from .schedule import Dynamic, Static

T, C = 8, 4
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE_SQL[function.__name__] = sql
        return function

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _frame(spark: SparkSession, sf_dir: str, name: str, key: str) -> IndexedFrame:
    """The tables' own keys are dense (a test checks them), so that isn't looked at again in each query."""
    return IndexedFrame.from_table(_table(spark, sf_dir, name), key, check=False)


def _own(i: str, n: str, t: int) -> str:
    """SQL for the owner of task ``i``."""
    return f"CAST(CASE WHEN {i} < ({n}%{t})*({n}//{t}+1) THEN {i}//({n}//{t}+1) ELSE ({n}%{t})+({i}-({n}%{t})*({n}//{t}+1))//greatest({n}//{t},1) END AS BIGINT)"


# Sources and scheduling


@_query("SELECT range AS task_index FROM range(1000)")
def range_source(spark, sf_dir):
    return IndexedFrame.from_range(spark, 0, 1000).df


@_query("SELECT range AS task_index FROM range(250,750)")
def range_offset(spark, sf_dir):
    return IndexedFrame.from_range(spark, 250, 750).df


@_query("SELECT range AS task_index, range*range AS value FROM range(256)")
def exact_iter(spark, sf_dir):
    return IndexedFrame.from_indexer(spark, 256, lambda i: i * i).df


@_query("SELECT k AS thread_index, n//8*k+least(k,n%8) AS first, n//8+CAST(k<n%8 AS BIGINT) AS count FROM range(8) r(k), (SELECT count(*) n FROM orders)")
def split_ranges(spark, sf_dir):
    return loops.split_ranges(spark, _frame(spark, sf_dir, "orders", "o_orderkey").length, T)


@_query(f"SELECT o_orderkey AS task_index, {_own('o_orderkey', 'n', T)} AS thread_index FROM orders, (SELECT count(*) n FROM orders)")
def for_n_owner(spark, sf_dir):
    return loops.for_n(_frame(spark, sf_dir, "orders", "o_orderkey")).select(KEY, "thread_index")


@_query(f"SELECT {_own('o_orderkey', 'n', T)} AS thread_index, min(o_orderkey) AS first, count(*) AS count FROM orders, (SELECT count(*) n FROM orders) GROUP BY 1")
def for_n_coverage(spark, sf_dir):
    return loops.for_slices(_frame(spark, sf_dir, "orders", "o_orderkey"))


@_query("SELECT count(*) AS count, count(DISTINCT event_id) AS distinct_count, min(event_id) AS lo, max(event_id) AS hi FROM events")
def for_n_dynamic_coverage(spark, sf_dir):
    frame = _frame(spark, sf_dir, "events", "event_id").map().with_schedule(Dynamic(T))
    return loops.coverage(loops.for_n_dynamic(frame))


@_query("SELECT k AS thread_index, greatest(n-8,0)+k AS task_index FROM range(8) r(k), (SELECT count(*) n FROM orders) WHERE greatest(n-8,0)+k < n")
def dynamic_static_tail(spark, sf_dir):
    return loops.static_tail(spark, _frame(spark, sf_dir, "orders", "o_orderkey").length, T)


@_query(f"SELECT {_own('o_orderkey', 'n', T)} AS thread_index, min(o_orderkey) AS first, count(*) AS count, round(sum(o_totalprice),2) AS total FROM orders, (SELECT count(*) n FROM orders) GROUP BY 1")
def for_slices(spark, sf_dir):
    return loops.for_slices(_frame(spark, sf_dir, "orders", "o_orderkey"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@_query(f"SELECT {_own('CAST(r_regionkey AS BIGINT)', 'n', T)} AS thread_index, CAST(min(r_regionkey) AS BIGINT) AS first, count(*) AS count FROM region, (SELECT count(*) n FROM region) GROUP BY 1")
def for_slices_sparse(spark, sf_dir):
    return loops.for_slices(_frame(spark, sf_dir, "region", "r_regionkey"))


@_query(f"SELECT k AS thread_index, {_own('k', str(T), C)} AS colocation_index FROM range(8) r(k)")
def for_threads(spark, sf_dir):
    return loops.for_threads(spark, T, C)


@_query(f"SELECT k AS thread_index, {_own('k', '10', C)} AS colocation_index, CAST(k - (10//4*{_own('k', '10', C)}+least({_own('k', '10', C)},10%4)) AS BIGINT) AS local_thread FROM range(10) r(k)")
def locate_thread(spark, sf_dir):
    return loops.located_threads(spark, 10, C)


@_query("SELECT c AS colocation_index, 10//4*c+least(c,10%4) AS first, 10//4+CAST(c<10%4 AS BIGINT) AS count FROM range(4) r(c)")
def threads_per_shard(spark, sf_dir):
    return loops.threads_per_shard(spark, 10, C)


@_query("SELECT c AS colocation_index, n//4*c+least(c,n%4) AS first, n//4+CAST(c<n%4 AS BIGINT) AS count FROM range(4) r(c), (SELECT count(*) n FROM events)")
def colocation_split(spark, sf_dir):
    return loops.split_ranges(spark, _frame(spark, sf_dir, "events", "event_id").length, C, "colocation_index")


@_query("SELECT k AS step, 5+(k*7)%17 AS value FROM range(17) r(k)")
def coprime_permutation(spark, sf_dir):
    return spark.range(17).select(F.col("id").alias("step"), split.permuted_col(F.col("id"), 5, 17, 3).alias("value"))


@_query("SELECT o_orderkey AS task_index, o_orderkey > 0 AND bit_count(o_orderkey) = 1 AS power, least(CAST(o_orderkey AS HUGEINT) + 9223372036854775000, 9223372036854775807)::BIGINT AS total FROM orders")
def index_helpers(spark, sf_dir):
    frame = _frame(spark, sf_dir, "orders", "o_orderkey")
    i = F.col(KEY)
    return frame.map(power=split.is_power_of_two_col(i), total=split.saturating_add_col(i, F.lit(9223372036854775000))).df


# Adaptors and folds


@_query("SELECT o_orderkey AS task_index, o_orderkey*2 AS value FROM orders")
def map(spark, sf_dir):
    return _frame(spark, sf_dir, "orders", "o_orderkey").map(value=F.col(KEY) * 2).df


@_query("SELECT event_id AS task_index, value FROM events WHERE event_type='purchase'")
def filter(spark, sf_dir):
    return _frame(spark, sf_dir, "events", "event_id").filter(F.col("event_type") == "purchase").map(value=F.col("value")).df


@_query("SELECT p_partkey AS task_index, p_partkey*p_partkey AS value FROM part WHERE p_partkey%2=0")
def filter_map(spark, sf_dir):
    return _frame(spark, sf_dir, "part", "p_partkey").filter(F.col(KEY) % 2 == 0).map(value=F.col(KEY) * F.col(KEY)).df


@_query("SELECT a.event_id AS task_index, round(a.value+b.value,4) AS pair_sum FROM events a JOIN (SELECT (SELECT count(*) FROM events)-1-event_id AS event_id, value FROM events) b USING(event_id)")
def zip(spark, sf_dir):
    frame = _frame(spark, sf_dir, "events", "event_id").map(value=F.col("value"))
    return frame.zip(frame.reversed()).map(pair_sum=F.round(F.col("left") + F.col("right"), 4)).df


@_query(f"SELECT p_partkey AS task_index, {_own('p_partkey', 'n', T)} AS thread_index, {_own(_own('p_partkey', 'n', T), str(T), C)} AS colocation_index, p_retailprice AS value FROM part, (SELECT count(*) n FROM part)")
def for_each_with_prong(spark, sf_dir):
    return _frame(spark, sf_dir, "part", "p_partkey").map(value=F.col("p_retailprice")).with_prong(C).df.select(KEY, "thread_index", "colocation_index", "value")


@_query(f"SELECT t.k AS thread_index, CAST(coalesce(s.v,0) AS BIGINT) AS slot FROM range(8) t(k) LEFT JOIN (SELECT {_own('o_orderkey', 'n', T)} k, sum(o_orderkey) v FROM orders, (SELECT count(*) n FROM orders) GROUP BY 1) s USING(k)")
def fold_scratch(spark, sf_dir):
    return fold.fold_with_scratch(_frame(spark, sf_dir, "orders", "o_orderkey"), True, {"slot": 0}, slot=F.sum(KEY))


@_query("SELECT CAST(sum(o_orderkey*2) AS BIGINT) AS total, count(*) AS items FROM orders WHERE o_orderstatus='F'")
def fold_total(spark, sf_dir):
    frame = _frame(spark, sf_dir, "orders", "o_orderkey").filter(F.col("o_orderstatus") == "F").map(value=F.col(KEY) * 2)
    return fold.fold_total(frame, total=F.sum("value"), items=F.count("*"))


@_query(f"SELECT {_own('event_id', 'n', T)} AS thread_index, count(*) AS items, min(value) AS lo, max(value) AS hi FROM events, (SELECT count(*) n FROM events) GROUP BY 1")
def fold_struct(spark, sf_dir):
    return fold.fold_with_scratch(_frame(spark, sf_dir, "events", "event_id"), items=F.count("*"), lo=F.min("value"), hi=F.max("value"))


@_query(f"SELECT {_own('o_orderkey', 'n', T)} AS thread_index, CAST(sum(o_orderkey) AS BIGINT) AS value FROM orders, (SELECT count(*) n FROM orders) GROUP BY 1")
def fold_python(spark, sf_dir):
    frame = _frame(spark, sf_dir, "orders", "o_orderkey").map(value=F.col(KEY))
    return fold.fold_python(frame, lambda: 0, lambda s, rows: s + int(rows["value"].sum()), lambda a, b: a + b, "long", slots=T)


@_query("SELECT p_partkey AS task_index, p_partkey*3 AS value FROM part WHERE p_partkey%3=1")
def map_python(spark, sf_dir):
    frame = _frame(spark, sf_dir, "part", "p_partkey").map(value=F.col(KEY))
    return frame.filter_python(lambda rows: rows["value"] % 3 == 1).map_python(lambda rows: rows.assign(value=rows["value"] * 3), f"{KEY} long, value long").df


@_query("SELECT o_orderkey AS task_index, CAST(2 AS BIGINT)*o_orderkey AS value FROM orders")
def map_dynamic(spark, sf_dir):
    return _frame(spark, sf_dir, "orders", "o_orderkey").map(value=F.col(KEY) * 2).with_schedule(Dynamic(T)).placed()


@_query("SELECT o_orderkey AS task_index, CAST(2 AS BIGINT)*o_orderkey AS value FROM orders")
def map_static(spark, sf_dir):
    return _frame(spark, sf_dir, "orders", "o_orderkey").map(value=F.col(KEY) * 2).with_schedule(Static(T)).placed()


# Sharded and positional vectors


@_query("SELECT o_orderkey AS global_index, o_orderkey%4 AS colocation_index, o_orderkey//4 AS local_index FROM orders")
def rr_placement(spark, sf_dir):
    return ShardedVector.from_table(_table(spark, sf_dir, "orders"), "o_orderkey", "o_totalprice", C).placement().drop("value")


@_query("SELECT o_orderkey AS global_index, (o_orderkey//4)*4+o_orderkey%4 AS back FROM orders")
def rr_inverse(spark, sf_dir):
    return ShardedVector.from_table(_table(spark, sf_dir, "orders"), "o_orderkey", "o_totalprice", C).inverse()


@_query("SELECT c AS colocation_index, count(p_partkey) AS len FROM range(4) r(c) LEFT JOIN part ON p_partkey%4=c GROUP BY 1")
def rr_len_at(spark, sf_dir):
    return _parts(spark, sf_dir, "p_name").lengths()


def _parts(spark, sf_dir, value) -> ShardedVector:
    return ShardedVector.from_table(_table(spark, sf_dir, "part"), "p_partkey", value, C)


@_query("SELECT p_partkey AS global_index, p_name AS value FROM part WHERE p_partkey%4=37%4 AND p_partkey//4=37//4")
def rr_get(spark, sf_dir):
    return _parts(spark, sf_dir, "p_name").get(37)


@_query("SELECT p_partkey AS global_index, p_partkey%4 AS colocation_index, p_partkey//4 AS local_index, p_name AS value FROM part WHERE p_partkey%4=2")
def rr_get_colocation(spark, sf_dir):
    return _parts(spark, sf_dir, "p_name").shard(2)


@_query("SELECT p_partkey AS global_index, p_partkey%4 AS colocation_index, p_partkey//4 AS local_index, p_size AS value FROM part WHERE p_partkey<50")
def rr_resize_shrink(spark, sf_dir):
    return _parts(spark, sf_dir, "p_size").resize(50, 0).placement()


@_query("SELECT CAST(r_regionkey AS BIGINT) AS global_index, r_name AS value FROM region UNION ALL SELECT k, 'X' FROM range((SELECT count(*) FROM region),12) r(k)")
def rr_resize_grow(spark, sf_dir):
    return ShardedVector.from_table(_table(spark, sf_dir, "region"), "r_regionkey", "r_name", C).resize(12, "X").rows()


@_query("SELECT CAST(n_nationkey AS BIGINT) AS global_index, n_name AS value FROM nation")
def rr_push_pop(spark, sf_dir):
    vector = ShardedVector.from_table(_table(spark, sf_dir, "nation"), "n_nationkey", "n_name", C)
    return vector.push("NEW").pop()[0].rows()


@_query("SELECT p_partkey AS global_index, CAST(42 AS BIGINT) AS value FROM part")
def rr_fill(spark, sf_dir):
    return _parts(spark, sf_dir, "p_partkey").fill(42).rows()


@_query("SELECT p_partkey AS global_index, p_partkey*p_partkey+1 AS value FROM part")
def rr_fill_with(spark, sf_dir):
    return _parts(spark, sf_dir, "p_partkey").fill_with(lambda g: g * g).update(lambda v: v + 1).rows()


@_query("SELECT CAST(p_partkey AS BIGINT) AS global_index, p_name AS value FROM part WHERE false")
def rr_clear(spark, sf_dir):
    return _parts(spark, sf_dir, "p_name").clear().rows()


def _regions(spark, sf_dir) -> PositionalVector:
    return PositionalVector.from_table(_table(spark, sf_dir, "region"), "r_regionkey", "r_name")


def _nations(spark, sf_dir) -> PositionalVector:
    return PositionalVector.from_table(_table(spark, sf_dir, "nation"), "n_nationkey", "n_name")


@_query("SELECT CAST(r_regionkey+CAST(r_regionkey>=2 AS INT) AS BIGINT) AS pos, r_name AS value FROM region UNION ALL SELECT 2,'NEW'")
def vec_insert(spark, sf_dir):
    return _regions(spark, sf_dir).insert(2, "NEW").df


@_query("SELECT CAST(r_regionkey-CAST(r_regionkey>2 AS INT) AS BIGINT) AS pos, r_name AS value FROM region WHERE r_regionkey<>2")
def vec_remove(spark, sf_dir):
    return _regions(spark, sf_dir).remove(2)[0].df


@_query("SELECT CAST(r_regionkey AS BIGINT) AS pos, r_name AS value FROM region UNION ALL SELECT (SELECT count(*) FROM region), 'NEW'")
def vec_push(spark, sf_dir):
    return _regions(spark, sf_dir).push("NEW").df


@_query("SELECT r_name AS value FROM region WHERE r_regionkey = (SELECT max(r_regionkey) FROM region)")
def vec_pop(spark, sf_dir):
    return _regions(spark, sf_dir).pop()[1]


@_query("SELECT CAST(CASE r_regionkey WHEN 1 THEN 3 WHEN 3 THEN 1 ELSE r_regionkey END AS BIGINT) AS pos, r_name AS value FROM region")
def vec_swap(spark, sf_dir):
    return _regions(spark, sf_dir).swap(1, 3).df


@_query("SELECT (SELECT count(*) FROM nation)-1-n_nationkey AS pos, n_name AS value FROM nation")
def vec_reverse(spark, sf_dir):
    return _nations(spark, sf_dir).reverse().df


@_query("SELECT CAST(n_nationkey AS BIGINT) AS pos, n_name AS value FROM nation WHERE n_nationkey<10")
def vec_truncate(spark, sf_dir):
    return _nations(spark, sf_dir).truncate(10).df


@_query("SELECT CAST(n_nationkey AS BIGINT) AS pos, n_name AS value FROM nation UNION ALL SELECT (SELECT count(*) FROM nation)+r_regionkey, r_name FROM region")
def vec_extend(spark, sf_dir):
    return _nations(spark, sf_dir).extend(_regions(spark, sf_dir)).df


@_query("SELECT CAST(n_nationkey AS BIGINT) AS pos, n_name AS value FROM nation UNION ALL SELECT k, 'item ' || k FROM range(25,40) r(k)")
def vec_resize_with(spark, sf_dir):
    return _nations(spark, sf_dir).resize_with(40, lambda pos: F.concat(F.lit("item "), pos.cast("string"))).df


@_query("SELECT CAST(n_nationkey AS BIGINT) AS pos, n_name AS value FROM nation WHERE n_nationkey BETWEEN 3 AND 6")
def vec_get_range(spark, sf_dir):
    return _nations(spark, sf_dir).get(range(3, 7))


@_query("SELECT arg_min(p_name,p_partkey) AS first, arg_max(p_name,p_partkey) AS last FROM part")
def vec_first_last(spark, sf_dir):
    return PositionalVector.from_table(_table(spark, sf_dir, "part"), "p_partkey", "p_name").first_last()


@_query("SELECT count(*)>0 AS found FROM nation WHERE n_regionkey=3")
def vec_contains(spark, sf_dir):
    return PositionalVector.from_table(_table(spark, sf_dir, "nation"), "n_nationkey", "n_regionkey").contains(3)


@_query("SELECT CAST(n_nationkey AS BIGINT) AS pos, 'filled' AS value FROM nation")
def vec_fill(spark, sf_dir):
    return _nations(spark, sf_dir).fill("filled").df


@_query("SELECT CAST(n_nationkey AS BIGINT) AS pos, CAST(n_nationkey*n_nationkey AS BIGINT) AS value FROM nation")
def vec_fill_with(spark, sf_dir):
    return _nations(spark, sf_dir).fill_with(lambda pos: pos * pos).df


# Vector search: every twentieth vector against all others

_SCORES = """SELECT q.vec_id AS query_id, e.vec_id AS best_index, list_inner_product(CAST(q.embedding AS DOUBLE[]),CAST(e.embedding AS DOUBLE[])) AS sim
FROM embeddings q JOIN embeddings e ON q.vec_id%20=0 AND e.vec_id<>q.vec_id"""


def _vectors(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    corpus = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return corpus, corpus.filter("vec_id % 20 = 0")


@_query(f"WITH s AS ({_SCORES}), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, best_index) rn FROM s WHERE NOT isnan(sim)) SELECT query_id, best_index, best_index%4 AS colocation_index, round(sim,6) AS best_similarity FROM r WHERE rn=1")
def search_dot(spark, sf_dir):
    corpus, queries = _vectors(spark, sf_dir)
    return search.search_dot(corpus, queries, C).withColumn("best_similarity", F.round("best_similarity", 6))


@_query("WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS best_index, 1-list_cosine_similarity(CAST(q.embedding AS DOUBLE[]),CAST(e.embedding AS DOUBLE[])) AS dist FROM embeddings q JOIN embeddings e ON q.vec_id%20=0 AND e.vec_id<>q.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, best_index) rn FROM s) SELECT query_id, best_index, round(dist,6) AS best_distance FROM r WHERE rn=1")
def search_cosine(spark, sf_dir):
    corpus, queries = _vectors(spark, sf_dir)
    return search.search_cosine(corpus, queries).withColumn("best_distance", F.round("best_distance", 6))


@_query(f"WITH s AS ({_SCORES}), r AS (SELECT *, row_number() OVER (PARTITION BY query_id, best_index%4 ORDER BY sim DESC, best_index) rn FROM s) SELECT query_id, best_index%4 AS colocation_index, best_index, round(sim,6) AS best_similarity FROM r WHERE rn=1")
def search_shard_best(spark, sf_dir):
    corpus, queries = _vectors(spark, sf_dir)
    found = search.best_by_shard(corpus, queries, "dot", C)
    return found.select("query_id", "colocation_index", "best_index", F.round("score", 6).alias("best_similarity"))


@_query(f"WITH s AS ({_SCORES}), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, best_index) rn FROM s WHERE NOT isnan(sim)) SELECT query_id, best_index, best_index%4 AS colocation_index, round(sim,6) AS best_similarity FROM r WHERE rn=1")
def search_sharded(spark, sf_dir):
    corpus, queries = _vectors(spark, sf_dir)
    return search.search_sharded(corpus, queries, C).withColumn("best_similarity", F.round("best_similarity", 6))


@_query(f"SELECT round(avg(b),6) AS avg_similarity FROM (SELECT query_id, max(sim) b FROM ({_SCORES}) GROUP BY 1)")
def search_avg_best(spark, sf_dir):
    corpus, queries = _vectors(spark, sf_dir)
    return search.search_dot(corpus, queries, C).agg(F.round(F.avg("best_similarity"), 6).alias("avg_similarity"))


# N-body: every part is a body

_BODIES = """SELECT p_partkey AS id, (p_partkey*37%101)/101.0::DOUBLE AS x, (p_partkey*53%103)/103.0::DOUBLE AS y, (p_partkey*71%107)/107.0::DOUBLE AS z,
0.5::DOUBLE AS vx, 0.25::DOUBLE AS vy, 0.125::DOUBLE AS vz, 1e6*(1+p_size)::DOUBLE AS m FROM part"""
_PULL = "6.674e-11*i.m*j.m*power((j.x-i.x)*(j.x-i.x)+(j.y-i.y)*(j.y-i.y)+(j.z-i.z)*(j.z-i.z)+1e-9,-1.5)"
_FORCES = f"SELECT i.id, {', '.join(f'sum({_PULL}*(j.{a}-i.{a})) AS f{a}' for a in 'xyz')} FROM bodies i, bodies j GROUP BY 1"


def _bodies(spark, sf_dir) -> DataFrame:
    i = F.col("p_partkey")
    place = {a: ((i * k) % p / F.lit(float(p))).alias(a) for a, k, p in (("x", 37, 101), ("y", 53, 103), ("z", 71, 107))}
    speed = [F.lit(v).alias(f"v{a}") for a, v in (("x", 0.5), ("y", 0.25), ("z", 0.125))]
    return _table(spark, sf_dir, "part").select(i.alias("id"), *place.values(), *speed, (F.lit(1e6) * (1 + F.col("p_size"))).alias("m"))


_ROUNDED_FORCES = "SELECT id, round(fx) AS fx, round(fy) AS fy, round(fz) AS fz FROM f"


def _moved(bodies: str, forces: str) -> str:
    """SQL for bodies a step later."""
    speed = {a: f"b.v{a}+f.f{a}/b.m*0.01" for a in "xyz"}
    columns = [f"b.{a}+({speed[a]})*0.01 AS {a}" for a in "xyz"] + [f"{speed[a]} AS v{a}" for a in "xyz"]
    return f"SELECT b.id, {', '.join(columns)}, b.m FROM {bodies} b JOIN {forces} f USING(id)"


def _forces_of(bodies: str) -> str:
    return _FORCES.replace("bodies i, bodies j", f"{bodies} i, {bodies} j")


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("id", *(F.round(c, 8).alias(c) for a in nbody.AXES for c in (a, f"v{a}")))


_ROUNDED = ", ".join(f"round({c},8) AS {c}" for a in "xyz" for c in (a, f"v{a}"))


@_query(f"WITH bodies AS ({_BODIES}), f AS ({_FORCES}) {_ROUNDED_FORCES}")
def nbody_force(spark, sf_dir):
    return nbody.forces(_bodies(spark, sf_dir)).select("id", *(F.round(f"f{a}").alias(f"f{a}") for a in "xyz"))


@_query(f"WITH bodies AS ({_BODIES}), f AS ({_FORCES}) {_ROUNDED_FORCES}")
def nbody_force_blocks(spark, sf_dir):
    """Both sides dealt into blocks, as they are where bodies are too many to broadcast."""
    found = nbody.forces(_bodies(spark, sf_dir), broadcast_bytes=0, block=4096)
    return found.select("id", *(F.round(f"f{a}").alias(f"f{a}") for a in "xyz"))


@_query(f"WITH bodies AS ({_BODIES}), f AS ({_FORCES}) SELECT id, {_ROUNDED} FROM ({_moved('bodies', 'f')})")
def nbody_step(spark, sf_dir):
    return _rounded(nbody.step(_bodies(spark, sf_dir)))


@_query(
    f"WITH bodies AS ({_BODIES}), f AS ({_FORCES}), b1 AS MATERIALIZED ({_moved('bodies', 'f')}), f1 AS ({_forces_of('b1')}), b2 AS MATERIALIZED ({_moved('b1', 'f1')}), "
    f"f2 AS ({_forces_of('b2')}) SELECT id, {_ROUNDED} FROM ({_moved('b2', 'f2')})"
)
def nbody_k_steps(spark, sf_dir):
    return _rounded(nbody.simulate(_bodies(spark, sf_dir), 3))


# Runtime


@_query()
def topology(spark, sf_dir):
    return runtime.topology(spark)


@_query("SELECT k AS thread_index, CAST(k*k AS VARCHAR) AS value FROM range(4) r(k)")
def broadcast_workers(spark, sf_dir):
    return runtime.broadcast_to_workers(spark, 4, lambda k: k * k)


@_query("SELECT CAST(1 AS BIGINT) AS pool, count(*) AS reached FROM orders UNION ALL SELECT 2, count(*) FROM events")
def two_pools(spark, sf_dir):
    """Two loops that overlap; the first to start is joined last."""
    counted = lambda pool, name: _table(spark, sf_dir, name).agg(F.lit(pool).cast("long").alias("pool"), F.count("*").alias("reached"))
    first, second = runtime.started(lambda: counted(1, "orders")), runtime.started(lambda: counted(2, "events"))
    two = second.join()
    return first.join().unionByName(two)


# Deferred loops, visits, updates in place


@_query(f"SELECT o_orderkey AS task_index, {_own('o_orderkey', 'n', T)} AS thread_index FROM orders, (SELECT count(*) n FROM orders)")
def deferred_for_n(spark, sf_dir):
    frame = _frame(spark, sf_dir, "orders", "o_orderkey")
    return runtime.started(lambda: loops.for_n(frame).select(KEY, "thread_index")).join()


@_query("SELECT event_id AS task_index, value FROM events")
def deferred_for_n_dynamic(spark, sf_dir):
    frame = _frame(spark, sf_dir, "events", "event_id").map(value=F.col("value")).with_schedule(Dynamic(T))
    return runtime.started(lambda: loops.for_n_dynamic(frame)).join()


@_query(f"SELECT {_own('o_orderkey', 'n', T)} AS thread_index, min(o_orderkey) AS first, count(*) AS count FROM orders, (SELECT count(*) n FROM orders) GROUP BY 1")
def deferred_for_slices(spark, sf_dir):
    frame = _frame(spark, sf_dir, "orders", "o_orderkey")
    with runtime.started(lambda: loops.for_slices(frame)) as slices:
        return slices.join()


def _visited(spark, frame: IndexedFrame) -> DataFrame:
    """What accumulators have seen of a visit with effects, batch by batch."""
    seen, total = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def effect(rows):
        seen.add(len(rows))
        total.add(int(rows[KEY].sum()))

    visited = frame.for_each_batches(effect)
    return spark.createDataFrame([(min(seen.value, visited), total.value)], "visits long, total long")


_VISITS = "SELECT count(*) AS visits, CAST(sum(o_orderkey) AS BIGINT) AS total FROM orders"


@_query(_VISITS)
def for_each(spark, sf_dir):
    return _visited(spark, _frame(spark, sf_dir, "orders", "o_orderkey").map())


@_query(_VISITS)
def for_each_static(spark, sf_dir):
    return _visited(spark, _frame(spark, sf_dir, "orders", "o_orderkey").map().with_schedule(Static(T)))


@_query(_VISITS)
def for_each_dynamic(spark, sf_dir):
    return _visited(spark, _frame(spark, sf_dir, "orders", "o_orderkey").map().with_schedule(Dynamic(T)))


def _priced(spark, sf_dir) -> IndexedFrame:
    return _frame(spark, sf_dir, "part", "p_partkey").map(value=F.col("p_size").cast("long"))


@_query("SELECT p_partkey AS task_index, CAST(p_size AS BIGINT)*2+1 AS value FROM part")
def update(spark, sf_dir):
    return _priced(spark, sf_dir).update(value=F.col("value") * 2 + 1).df


@_query("SELECT p_partkey AS task_index, CAST(p_size AS BIGINT)*2+1 AS value FROM part")
def update_static(spark, sf_dir):
    return _priced(spark, sf_dir).update_static(value=F.col("value") * 2 + 1).df


@_query("SELECT p_partkey AS task_index, CAST(p_size AS BIGINT)*2+1 AS value FROM part")
def update_dynamic(spark, sf_dir):
    return _priced(spark, sf_dir).update_dynamic(value=F.col("value") * 2 + 1).placed()


_PRONG_SQL = f"SELECT p_partkey AS task_index, CAST(p_size AS BIGINT)+100*{_own('p_partkey', 'n', T)}+10000*{_own(_own('p_partkey', 'n', T), str(T), C)} AS value FROM part, (SELECT count(*) n FROM part)"


def _by_prong(thread, shard):
    return {"value": F.col("value") + 100 * thread + 10000 * shard}


@_query(_PRONG_SQL)
def update_with_prong(spark, sf_dir):
    return _priced(spark, sf_dir).update_with_prong(_by_prong, C).df


@_query(_PRONG_SQL)
def update_with_prong_dynamic(spark, sf_dir):
    return _priced(spark, sf_dir).with_schedule(Dynamic(T)).update_with_prong(_by_prong, C).placed()


@_query("SELECT p_partkey AS task_index, p_partkey*p_partkey-1 AS value FROM part")
def map_index_python(spark, sf_dir):
    return _priced(spark, sf_dir).map_index_batches(lambda i: i * i - 1, "long").df


@_query(f"SELECT p_partkey AS task_index, 3*p_partkey+{_own('p_partkey', 'n', T)}*{_own(_own('p_partkey', 'n', T), str(T), C)} AS value FROM part, (SELECT count(*) n FROM part)")
def map_prong_python(spark, sf_dir):
    return _priced(spark, sf_dir).map_prong_batches(lambda i, thread, shard: 3 * i + thread * shard, "long", C).df


@_query("SELECT count(*) AS left_over, (SELECT count(*) FROM events) AS length, count(*) = 0 AS is_empty FROM events WHERE value > 50 AND nullif(event_id%3, 0) = 1")
def filter_length(spark, sf_dir):
    """The rows that a filter leaves, where its predicate is null for some; the source's length stays."""
    frame = _frame(spark, sf_dir, "events", "event_id")
    kept = frame.filter((F.col("value") > 50) & (F.nullif(F.col(KEY) % 3, F.lit(0)) == 1))
    return kept.df.agg(F.count("*").alias("left_over"), F.lit(kept.length).cast("long").alias("length"), (F.count("*") == 0).alias("is_empty"))


# Schedules, splits, shards


@_query("SELECT k AS slice_index, n//8*k+least(k,n%8) AS first, n//8+CAST(k<n%8 AS BIGINT) AS count FROM range(8) r(k), (SELECT count(*) n FROM nation) WHERE n//8+CAST(k<n%8 AS BIGINT) > 0")
def dispatch_slices(spark, sf_dir):
    return _frame(spark, sf_dir, "nation", "n_nationkey").slices()


@_query("SELECT k AS slice_index, n//32*k+least(k,n%32) AS first, n//32+CAST(k<n%32 AS BIGINT) AS count FROM range(32) r(k), (SELECT count(*) n FROM nation) WHERE n//32+CAST(k<n%32 AS BIGINT) > 0")
def dispatch_slices_dynamic(spark, sf_dir):
    return _frame(spark, sf_dir, "nation", "n_nationkey").with_schedule(Dynamic(T)).slices()


@_query("SELECT w AS workers, n//w AS smallest, (n+w-1)//w AS largest, n AS length FROM range(1,40) r(w), (SELECT count(*) n FROM orders)")
def split_sizes(spark, sf_dir):
    n = _frame(spark, sf_dir, "orders", "o_orderkey").length
    rows = [(w, split.smallest_block(n, w), split.largest_block(n, w), n) for w in range(1, 40)]
    return spark.createDataFrame(rows, "workers long, smallest long, largest long, length long")


@_query(f"SELECT k AS thread_index, CASE WHEN k < 10 THEN {_own('k', '10', C)} ELSE 4 END AS colocation_index FROM range(14) r(k)")
def thread_colocation(spark, sf_dir):
    """The shard of workers, and of numbers that no worker has."""
    return spark.range(14).select(F.col("id").alias("thread_index"), loops.shard_of(F.col("id"), 10, C).alias("colocation_index"))


_SHARDS = "w AS (SELECT k AS t, {own} AS c FROM range(10) r(k)), l AS (SELECT t, c, t-(10//4*c+least(c,10%4)) AS lt, 10//4+CAST(c<10%4 AS BIGINT) AS tc, n//4*c+least(c,n%4) AS f, n//4+CAST(c<n%4 AS BIGINT) AS nl FROM w, (SELECT count(*) n FROM {table}))".replace(
    "{own}", _own("k", "10", C)
)
_SHARD_TAIL = "SELECT CAST(t AS BIGINT) AS thread_index, CAST(c AS BIGINT) AS colocation_index, CAST(f+greatest(nl-tc,0)+lt AS BIGINT) AS task_index FROM l WHERE greatest(nl-tc,0)+lt < nl"


@_query(f"WITH {_SHARDS.replace('{table}', 'orders')} {_SHARD_TAIL}")
def static_tail_by_shard(spark, sf_dir):
    return loops.static_tail_by_shard(spark, _frame(spark, sf_dir, "orders", "o_orderkey").length, 10, C)


@_query(f"WITH {_SHARDS.replace('{table}', 'region')} {_SHARD_TAIL}")
def static_tail_by_shard_sparse(spark, sf_dir):
    return loops.static_tail_by_shard(spark, _frame(spark, sf_dir, "region", "r_regionkey").length, 10, C)


@_query(
    f"WITH w AS (SELECT k, {_own('k', str(T), C)} AS own, (2*k+1)%4 AS stride FROM range(8) r(k)), v AS (SELECT k, j, (j*stride)%4 AS c, own FROM w, range(1,5) s(j)) "
    "SELECT k AS thread_index, CAST(0 AS BIGINT) AS step, own AS colocation_index FROM w UNION ALL SELECT k, row_number() OVER (PARTITION BY k ORDER BY j), c FROM v WHERE c <> own"
)
def probing_order(spark, sf_dir):
    return loops.probing_order(spark, T, C)


# Vectors without and with elements, sizes, generated inputs


@_query("SELECT CAST(0 AS BIGINT) AS len, true AS is_empty, CAST(0 AS BIGINT) AS capacity, CAST(2 AS BIGINT) AS shard, CAST(1 AS BIGINT) AS after_push")
def vec_new(spark, sf_dir):
    made = PositionalVector.empty(spark, "string", shard=2)
    return spark.createDataFrame([(len(made), made.is_empty(), made.capacity(), made.reserve(10).shard, len(made.push("x")))], "len long, is_empty boolean, capacity long, shard long, after_push long")


@_query("SELECT n AS len, false AS is_empty, greatest(n, 4) AS capacity, greatest(n+1, 2*greatest(n, 4)) AS grown FROM (SELECT count(*) n FROM nation)")
def vec_len(spark, sf_dir):
    vector = _nations(spark, sf_dir)
    return spark.createDataFrame([(len(vector), vector.is_empty(), vector.capacity(), vector.capacity(len(vector) + 1, vector.capacity()))], "len long, is_empty boolean, capacity long, grown long")


@_query("SELECT CAST(n_nationkey AS BIGINT) AS pos, n_name AS value FROM nation WHERE n_nationkey = 7")
def vec_index(spark, sf_dir):
    return _nations(spark, sf_dir).at(7)


@_query("SELECT CAST(4 AS BIGINT) AS shards, CAST(0 AS BIGINT) AS len, true AS is_empty, CAST(0 AS BIGINT) AS at_3")
def rr_new(spark, sf_dir):
    made = ShardedVector.empty(spark, "long", C)
    return spark.createDataFrame([(made.shards, len(made), made.is_empty(), made.length_at(3))], "shards long, len long, is_empty boolean, at_3 long")


@_query("SELECT n AS len, false AS is_empty, n//4+CAST(0<n%4 AS BIGINT) AS at_0, n//4+CAST(3<n%4 AS BIGINT) AS at_3 FROM (SELECT count(*) n FROM part)")
def rr_len(spark, sf_dir):
    vector = _parts(spark, sf_dir, "p_size")
    return spark.createDataFrame([(len(vector), vector.is_empty(), vector.length_at(0), vector.length_at(3))], "len long, is_empty boolean, at_0 long, at_3 long")


@_query("SELECT CAST(n_nationkey AS BIGINT) AS global_index, n_name AS value FROM nation UNION ALL SELECT n, 'NEW' FROM (SELECT count(*) n FROM nation)")
def rr_push(spark, sf_dir):
    return ShardedVector.from_table(_table(spark, sf_dir, "nation"), "n_nationkey", "n_name", C).push("NEW").rows()


@_query("SELECT CAST(n_nationkey AS BIGINT) AS global_index, n_name AS value FROM nation WHERE n_nationkey < (SELECT count(*)-1 FROM nation)")
def rr_pop(spark, sf_dir):
    return ShardedVector.from_table(_table(spark, sf_dir, "nation"), "n_nationkey", "n_name", C).pop()[0].rows()


@_query(
    "WITH m AS (SELECT CAST(r_regionkey AS BIGINT) AS k, r_name AS v, (SELECT count(*) FROM nation) - 20 AS lead FROM region) "
    "SELECT CAST(0 AS BIGINT) AS half, CAST(n_nationkey AS BIGINT) AS pos, n_name AS value FROM nation "
    "UNION ALL SELECT 1, CAST(n_nationkey AS BIGINT), n_name FROM nation WHERE n_nationkey < 22 "
    "UNION ALL SELECT CASE WHEN k < 3 THEN 1 ELSE (k-3)%2 END, CASE WHEN k < 3 THEN 22+k ELSE 25+(k-3)//2 END, v FROM m"
)
def append_halves(spark, sf_dir):
    """Regions appended to two halves of 25 and 22 elements: three to the shorter one, then by turns."""
    first = _nations(spark, sf_dir)
    halves = search.appended((first, first.truncate(22)), _regions(spark, sf_dir))
    return halves[0].df.select(F.lit(0).cast("long").alias("half"), "*").unionByName(halves[1].df.select(F.lit(1).cast("long").alias("half"), "*"))


@_query("SELECT count(*) AS vectors, min(vec_id) AS first, max(vec_id) AS last, count(*) AS different, CAST(sum(len(embedding)) AS BIGINT) AS entries, CAST(sum(len(embedding)) AS BIGINT) AS in_range, true AS centred FROM embeddings")
def random_embeddings(spark, sf_dir):
    """Random vectors, one for each of the table's: of the same lengths, all different, with entries in [-1, 1] around 0."""
    stored = _table(spark, sf_dir, "embeddings")
    width = stored.agg(F.max(F.size("embedding"))).first()[0] or 1
    made = generators.embeddings(spark, stored.count(), width)
    entries = F.size("embedding").cast("long")
    inside = F.size(F.filter("embedding", lambda x: (x >= -1) & (x <= 1))).cast("long")
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x)
    return made.agg(
        F.count("*").alias("vectors"), F.min("vec_id").alias("first"), F.max("vec_id").alias("last"), F.countDistinct(F.xxhash64("embedding")).alias("different"),
        F.sum(entries).alias("entries"), F.sum(inside).alias("in_range"), (F.abs(F.sum(total) / F.sum(entries)) < 0.05).alias("centred"),
    )


@_query("SELECT count(*) AS bodies, min(p_partkey) AS first, max(p_partkey) AS last, count(*) AS in_range, count(*) AS masses, count(*) AS different FROM part")
def random_bodies(spark, sf_dir):
    """Random bodies, one for each part."""
    inside = F.lit(True)
    for c in ("x", "y", "z", "vx", "vy", "vz"):
        inside = inside & (F.col(c) >= 0) & (F.col(c) < 1)
    made = generators.bodies(spark, _table(spark, sf_dir, "part").count())
    return made.agg(
        F.count("*").alias("bodies"), F.min("id").alias("first"), F.max("id").alias("last"), F.count_if(inside).alias("in_range"),
        F.count_if((F.col("m") >= 1e20) & (F.col("m") < 1e25)).alias("masses"), F.countDistinct("x").alias("different"),
    )


@_query("SELECT true AS cores, true AS nodes, true AS one_shard_per_node, true AS one_quality, true AS memory, true AS capabilities, true AS idle, '" + runtime.__version__ + "' AS version")
def topology_shape(spark, sf_dir):
    """What holds of the topology wherever it's asked, and that nothing is in progress after it was."""
    ok = {"cores": F.col("logical_cores") >= 1, "nodes": F.col("numa_nodes") >= 1, "one_shard_per_node": F.col("colocations") == F.col("numa_nodes"), "one_quality": F.col("quality_levels") == 1, "memory": F.col("memory_bytes") > 0, "capabilities": F.contains("capabilities", F.lit("columnar"))}
    return runtime.topology(spark).select(*(c.alias(name) for name, c in ok.items()), F.lit(all(done <= tasks for _, tasks, done in runtime.progress(spark))).alias("idle"), "version")


@_query("SELECT unnest(['workers', 'shards', 'zip', 'position', 'slots']) AS refused, true AS raised")
def refusals(spark, sf_dir):
    """Parameters that no plan can be made for, refused before anything runs."""
    frame = IndexedFrame.from_range(spark, 0, 5)
    tries = {
        "workers": lambda: Static(0), "shards": lambda: frame.sharded(0), "zip": lambda: frame.zip(IndexedFrame.from_range(spark, 0, 4)),
        "position": lambda: _regions(spark, sf_dir).at(99), "slots": lambda: fold.fold_python(frame, int, lambda s, r: s, int.__add__, "long", slots=1),
    }

    def raised(work) -> bool:
        try:
            work()
        except EngineError:
            return True
        return False

    return spark.createDataFrame([(name, raised(work)) for name, work in tries.items()], "refused string, raised boolean")

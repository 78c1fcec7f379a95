"""Vector search: exact inner product, priors, caps, splits, merges, language metrics."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions import scoring as K
from .topk import Best, Vectors

#: Most queries that go against all rows at once; more are taken in blocks.  Vectors take less room than pairs.
QUERIES_AT_ONCE, NEAREST_AT_ONCE = 5_000, 50_000


@dataclass(frozen=True)
class SearchParams:
    """Parameters of a search."""

    k: int = 10
    per_page: int = 3
    per_doc: int = 5
    free_score: float = 1.5
    over_retrieve: int = 3
    cross_penalty: float = 0.0
    hard_negatives: int = 0


#: Steps behind which a plan has partitions of its own.
_WIDE = re.compile(r"^[\s:+\-]*(?:Join|Aggregate|Repartition|Sort|Window|Deduplicate|Union|GlobalLimit|LocalLimit)", re.MULTILINE)


def spread(rows: DataFrame) -> DataFrame:
    """Rows of a scan over all cores, where a few large files would leave half of them idle or more; else as they are.

    Only a plan without a shuffle is asked for its partitions: asking another one would run it."""
    if _WIDE.search(rows._jdf.queryExecution().optimizedPlan().toString()):
        return rows
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if 2 * rows.rdd.getNumPartitions() <= cores else rows


def against_all(queries: DataFrame, rows: DataFrame, id_col: str) -> DataFrame:
    """A stated query set against all rows: the query side is broadcast in blocks of checked size, so rows stay where they are."""
    n = queries.count()
    rows = spread(rows)
    if n <= QUERIES_AT_ONCE:
        return rows.crossJoin(F.broadcast(queries))
    blocks = -(-n // QUERIES_AT_ONCE)
    out = None
    for b in range(blocks):
        part = rows.crossJoin(F.broadcast(queries.filter(F.pmod(F.xxhash64(id_col), F.lit(blocks)) == b)))
        out = part if out is None else out.unionByName(part)
    return out


def dot(a: Column, b: Column) -> Column:
    """K7: inner product, accumulated in double in the order of the elements."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def best_of_tasks(queries: DataFrame, rows: DataFrame, k: int, query_id: str, row_id: str) -> DataFrame:
    """(query id, row id, cosine): of each task's rows the k nearest ones of each query; queries are broadcast in blocks of checked size.

    As many tasks as cores: what they emit grows with the queries, not with the pairs, and no pair is sorted or spilled."""
    spark, n = rows.sparkSession, queries.count()
    rows = spread(rows.select(row_id, "vec", "norm")).coalesce(spark.sparkContext.defaultParallelism)
    kinds = [(query_id, queries.schema[query_id].dataType), (row_id, rows.schema[row_id].dataType)]
    schema, out = StructType([StructField(name, kind) for name, kind in (*kinds, ("cosine", DoubleType()))]), None
    blocks = max(1, -(-n // NEAREST_AT_ONCE))
    for b in range(blocks):
        part = queries if blocks == 1 else queries.filter(F.pmod(F.xxhash64(query_id), F.lit(blocks)) == b)
        sent = spark.sparkContext.broadcast(part.filter(F.col(query_id).isNotNull()).select(query_id, "q_vec", "q_norm").toArrow())

        def run(batches, sent=sent):
            q = sent.value.combine_chunks()
            ids = q.column(0).to_pylist()
            vectors = Vectors(pa.concat_arrays(q.column(1).chunks) if ids else pa.array([], pa.list_(pa.float64())), pa.array(q.column(2).to_pylist(), pa.float64()))
            best, fields = Best(ids, vectors, k), pa.schema([(query_id, q.schema.field(0).type), (row_id, pa.null()), ("cosine", pa.float64())])
            for r in batches:
                fields = fields.set(1, pa.field(row_id, r.schema.field(0).type))
                r = r.filter(r.column(0).is_valid())
                if ids and r.num_rows:
                    best.add(r.column(0).to_pylist(), Vectors(r.column(1), r.column(2), vectors.width))
            yield from best.rows(fields)

        found = rows.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out


def nearest(queries: DataFrame, rows: DataFrame, k: int, query_id: str = "query_id", row_id: str = "row_id") -> DataFrame:
    """Exact top k by cosine for each query; the query's own row is left out."""
    pairs = best_of_tasks(queries, rows, k, query_id, row_id)
    w = Window.partitionBy(query_id).orderBy(F.desc("cosine"), row_id)
    return pairs.withColumn("rank", F.dense_rank().over(w)).filter(F.col("rank") <= k).dropDuplicates([query_id, row_id])


def scored(pairs: DataFrame, params: SearchParams = SearchParams()) -> DataFrame:
    """K4, K6: base score 2 cos - 1 and its adjustment by priors; a price for the other language where asked."""
    p = K.prior(F.col("query_lang"), F.col("tabular"), F.col)
    cross = F.when(F.coalesce(F.col("language"), F.lit("")) != F.col("query_lang"), params.cross_penalty).otherwise(0.0)
    return pairs.withColumn("base_score", 2 * F.col("cosine") - 1).withColumn("prior", p).withColumn("score", F.col("base_score") + F.col("prior") - cross)


def diversified(df: DataFrame, score: str = "score", tie: str = "chunk_id", params: SearchParams = SearchParams()) -> DataFrame:
    """Greedy caps by page, then by document, as two windows; scores above free_score pass; then 2k a query."""
    high = F.col(score) > params.free_score
    by = lambda *cols: Window.partitionBy("query_id", *cols).orderBy(F.desc(score), tie)
    df = df.withColumn("_rp", F.row_number().over(by("page_id"))).filter((F.col("_rp") <= params.per_page) | high)
    df = df.withColumn("_rd", F.row_number().over(by("doc_id"))).filter((F.col("_rd") <= params.per_doc) | high)
    return df.withColumn("rank", F.row_number().over(by())).filter(F.col("rank") <= 2 * params.k).drop("_rp", "_rd")


def split_and_cap(df: DataFrame, k: int, negatives: int, order: str = "rank") -> DataFrame:
    """The first k authoritative candidates and the first `negatives` others of each query."""
    auth = F.col("source_authority") == "authoritative"
    w = Window.partitionBy("query_id", auth).orderBy(order)
    return df.withColumn("is_authoritative", F.coalesce(auth, F.lit(False))).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= F.when(F.col("is_authoritative"), k).otherwise(negatives)).drop("_r")


def merge_fallback(first: DataFrame, second: DataFrame, penalty: float = 0.1) -> DataFrame:
    """Candidates of a second search added to the first, which is preferred for a chunk of both; scores of the second are lowered."""
    both = first.withColumn("source_no", F.lit(0)).unionByName(second.withColumn("score", F.col("score") - penalty).withColumn("source_no", F.lit(1)))
    one = Window.partitionBy("query_id", "chunk_id").orderBy("source_no")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return both.withColumn("_r", F.row_number().over(one)).filter("_r = 1").drop("_r").withColumn("rank", F.row_number().over(order))


def merge_bilingual(df: DataFrame, k: int) -> DataFrame:
    """K // 2 of each language, then one candidate for each place (document, page, box), the best first."""
    half = Window.partitionBy("query_id", "language").orderBy(F.desc("score"), "chunk_id")
    place = Window.partitionBy("query_id", "doc_id", "page_id", F.substring(F.col("bbox_text"), 1, 50)).orderBy(F.desc("score"), "chunk_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    df = df.withColumn("_h", F.row_number().over(half)).filter(F.col("_h") <= k // 2)
    df = df.withColumn("_p", F.row_number().over(place)).filter("_p = 1")
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).drop("_h", "_p")


def language_metrics(df: DataFrame) -> DataFrame:
    """Agreement of candidates with the query's language, and other languages in the first 5 and 10, by query."""
    same = F.coalesce(F.col("language"), F.lit("")) == F.col("query_lang")
    cross = lambda n: F.sum(F.when((F.col("rank") <= n) & ~same, 1).otherwise(0)) / F.least(F.lit(n), F.count("*"))
    return df.groupBy("query_id").agg(F.avg(same.cast("double")).alias("consistency"), cross(5).alias("cross_5"), cross(10).alias("cross_10"))


def purity(df: DataFrame) -> DataFrame:
    """Authoritative share of the candidates of a query."""
    return df.groupBy("query_id").agg(F.avg((F.col("source_authority") == "authoritative").cast("double")).alias("purity"), F.count("*").alias("considered"))


def fused(df: DataFrame, method: str = "max") -> DataFrame:
    """One score of a candidate over several scorings; an unknown method counts as max."""
    agg = {"mean": F.avg, "sum": F.sum}.get(method, F.max)
    return df.groupBy("query_id", "chunk_id").agg(agg("score").alias("fused_score"))


def reranked(df: DataFrame, k: int) -> DataFrame:
    """Order by a given score, ties in the order before."""
    w = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "rank")
    return df.withColumn("new_rank", F.row_number().over(w)).filter(F.col("new_rank") <= k)

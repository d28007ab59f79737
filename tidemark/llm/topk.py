"""Exact top-k search by exhaustive term-at-a-time accumulation.

Queries and candidates are dealt out as a grid of cells, so that each cell holds a bounded block of either. In a
cell the candidates become postings (term -> rows with a non-zero weight, and those weights); each query scatters
its weighted postings into a dense score array, partition selection keeps its best rows, and a merge over the
cells of a query gives the result. Every pair of query and candidate is scored: there is no pruning to tune.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import own_columns

RESULT = "q_row long, query_id long, vec_id long, score long"


def scaled_vectors(vectors: DataFrame, id_column: str, vector_column: str, scale: int) -> DataFrame:
    """vec_id and the integer components floor(scale * x); rows that can take no part are left out."""
    renamed = vectors.select(F.col(f"`{id_column}`").alias("vec_id"), F.col(f"`{vector_column}`").alias("x"))
    x = F.col("x").cast("array<double>")
    usable = F.col("vec_id").isNotNull() & x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return renamed.where(usable).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v * float(scale))).cast("array<long>").alias("w"))


def _postings(lists: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """term -> (rows, weights) of the non-zero components."""
    lists = lists.combine_chunks()
    sizes = np.diff(np.asarray(lists.offsets))
    weights = np.asarray(lists.flatten(), np.int64)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    terms = np.arange(len(weights)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    held = np.flatnonzero(weights)
    held = held[np.argsort(terms[held], kind="stable")]
    named, starts = np.unique(terms[held], return_index=True)
    return {int(t): (rows[part], weights[part]) for t, part in zip(named, np.split(held, starts[1:]))} if len(held) else {}


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Rows of the k highest scores, ties to the smaller id, by partition selection."""
    if len(scores) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        above, level = np.flatnonzero(scores > edge), np.flatnonzero(scores == edge)
        need = k - len(above)
        if len(level) > need:
            level = level[np.argpartition(ids[level], need - 1)[:need]]
        rows = np.concatenate([above, level])
    else:
        rows = np.arange(len(scores))
    return rows[np.lexsort((ids[rows], -scores[rows]))]


def _cell(k: int):
    def search(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if queries.num_rows and candidates.num_rows:
            ids = np.asarray(candidates["vec_id"].combine_chunks(), np.int64)
            postings = _postings(candidates["w"])
            vectors = queries["w"].combine_chunks()
            for row, query, vector in zip(queries["q_row"].to_pylist(), queries["vec_id"].to_pylist(), vectors):
                terms = np.asarray(vector.values, np.int64)
                scores = np.zeros(len(ids), np.int64)
                for term in np.flatnonzero(terms):
                    if (posting := postings.get(int(term))) is not None:
                        scores[posting[0]] += posting[1] * terms[term]
                others = np.flatnonzero(ids != query)
                best = others[_best(scores[others], ids[others], k)]
                out += [(row, query, int(ids[b]), int(scores[b])) for b in best]
        columns = list(zip(*out)) or [(), (), (), ()]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("q_row", "query_id", "vec_id", "score"), columns)})

    return search


def exact_topk(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_column: str = "vec_id", vector_column: str = "embedding", candidate_block: int = 8192, query_block: int = 2048) -> DataFrame:
    """The k candidates of highest integer inner product for every query row, ties to the smaller id.

    ``is_query`` is a condition on ``vec_id``. A vector that is null or holds a null or non-finite component, or that
    has a null id, takes no part. Vectors of different length meet on the components both have. A query does not
    match rows of its own id; repeated candidate rows each count, repeated query rows are each answered. Fewer than
    k candidates give fewer rows, an empty table none. Scores are 64-bit; components are kept within 64 bits and
    sums wrap beyond. Cost is queries x candidates by definition; the two block sizes bound a cell's memory only.
    """
    base = scaled_vectors(vectors, id_column, vector_column, scale).withColumn("is_query", F.coalesce(is_query, F.lit(False)))
    n, q = base.agg(F.count("*"), F.count_if("is_query")).first()
    parts, stripes = -(-n // candidate_block) or 1, -(-q // query_block) or 1
    numbered = base.withColumn("q_row", F.monotonically_increasing_id())
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    candidates = numbered.select("vec_id", "w", (F.col("q_row") % parts).cast("int").alias("part"), every(stripes).alias("stripe"))
    queries = numbered.where("is_query").select("q_row", "vec_id", "w", (F.col("q_row") % stripes).cast("int").alias("stripe"), every(parts).alias("part"))
    found = queries.groupBy("stripe", "part").cogroup(candidates.groupBy("stripe", "part")).applyInArrow(_cell(k), RESULT)
    order = Window.partitionBy("q_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op5_exact_topk(spark, sf_dir: str) -> DataFrame:
    vectors = own_columns(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), vec_id="long", embedding="array<double>")
    return exact_topk(vectors, F.col("vec_id") % 50 == 0)


OP5_SQL = """
with usable as (
  select row_number() over () as r, vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as w from embeddings
  where vec_id is not null and embedding is not null and not list_contains(list_transform(embedding, lambda x: x is null or not isfinite(x)), true)),
terms as (select r, vec_id, unnest(w) as w, generate_subscripts(w, 1) as t from usable),
pairs as (
  select q.r as q_row, q.vec_id as query_id, c.r as c_row, c.vec_id, cast(sum(q.w * c.w) as bigint) as score
  from terms q join terms c on q.t = c.t and q.vec_id <> c.vec_id where q.vec_id % 50 = 0 group by all),
ranked as (select *, row_number() over (partition by q_row order by score desc, vec_id) as rank from pairs)
select query_id, cast(rank as integer) as rank, vec_id, score from ranked where rank <= 5
"""

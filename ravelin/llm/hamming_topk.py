"""Exact top-k search over binary codes by incremental multi-index hashing.

Each code is dealt into consecutive substrings, each the key of one index. A round looks at one more
substring radius: the values at exactly r bits from the query's substring, first in one half of the m indexes,
then in the other. A code that neither h indexes up to radius r nor the others up to r - 1 have shown
differs in m * r + h bits at least, so all nearer codes have been met and verified by then. A query ends once its k-th verified distance lies in what is covered; the others go on to radius r + 1.
When a round would ask for more substring values than there are codes, the queries left (outliers) are
compared with all codes instead, SCANNED of them at a time.

Only distinct codes are searched and only distinct queries search; a code shared by many rows is one
entry with a count and its k + 1 smallest ids, which is all that a result can need. A query carries k + 1
codes at most, those of least distance, then least id. Queries, their substring values and what they have met grow with
the rows, so they are joined by sorting: Spark takes the values for as small as the queries and would gather them on the driver.

Vectors become sign bits (bit j is 1 where component j is above 0, and not where it is no number). Null vectors, vectors of another
length and null ids take no part. A query's own row is not among its results; other rows of the same
vector are, at distance 0. Ties go to the smaller id. With fewer than k other rows all are returned.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ravelin.llm.common import stored

K = 10
BITS = 64
QUERY_EVERY = 100
#: Queries that are compared with all codes at a time; as many rows are broadcast.
SCANNED = 4096


def codes(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", bits: int = BITS) -> DataFrame:
    """(id, code): sign bits of the vectors, component j at bit j."""
    bit = F.aggregate(F.transform(vector_col, lambda x, j: F.when((x > 0) & ~F.isnan(x), F.call_function("shiftleft", F.lit(1).cast("long"), j)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))
    return df.where(F.col(id_col).isNotNull() & (F.size(vector_col) == bits)).select(F.col(id_col).cast("long").alias("id"), bit.alias("code"))


def masks(r: int, width: int) -> list[int]:
    return [sum(1 << b for b in c) for c in combinations(range(width), r)]


def _by_sorting(df: DataFrame) -> DataFrame:
    return df.hint("merge")


def _substrings(code: str, parts: int) -> list:
    """Consecutive substrings, as equal in width as can be."""
    at = [BITS * j // parts for j in range(parts + 1)]
    return [F.shiftright(F.col(code), a).bitwiseAND(F.lit((1 << (b - a)) - 1)).cast("int") for a, b in zip(at, at[1:])]


def search(rows: DataFrame, queries: DataFrame, k: int = K, subcodes: int | None = None) -> DataFrame:
    """(query_id, rank, id, distance) of rows(id, code) for every row of queries(id, code).

    By default the substrings are about as long as the logarithm of the number of rows, so that a
    substring value has a row or two at every size.
    """
    total = rows.select("id").count()
    subcodes = subcodes or max(3, min(16, math.ceil(BITS / math.log2(max(total, 2)))))
    widths = [BITS * (j + 1) // subcodes - BITS * j // subcodes for j in range(subcodes)]
    if max(widths) > 30:
        raise ValueError("a substring has 30 bits at most")
    distinct = stored(rows.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least")), "codes")
    index = stored(distinct.select("code", "n", "least", F.posexplode(F.array(*_substrings("code", subcodes))).alias("j", "sub")), "index")
    active = stored(queries.select(F.col("code").alias("q"), F.lit(BITS).alias("limit")).distinct(), "queries")
    n_codes, enough, best = distinct.count(), min(k + 1, total), None
    apart = F.bit_count(F.col("q").bitwiseXOR(F.col("code")))
    order = Window.partitionBy("q").orderBy("d", "least")

    def nearest(met: DataFrame) -> DataFrame:
        """Of met(q, code, n, least, d), the k + 1 codes of each query that come first; one of their rows may be the query's own."""
        return met.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k + 1).drop("_r")

    half = subcodes // 2
    for r, of in [(r, of) for r in range(max(widths) + 1) for of in (range(half), range(half, subcodes))]:
        if sum(math.comb(widths[j], r) for j in of) > n_codes:
            while best is None or not active.isEmpty():
                some = stored(active.orderBy("q").limit(SCANNED), "queries")
                scan = distinct.crossJoin(F.broadcast(some)).where(apart <= F.col("limit")).select("q", "code", "n", "least", apart.alias("d"))  # SCANNED rows at most
                found = nearest(scan)
                best = stored(found if best is None else best.join(_by_sorting(some), "q", "left_anti").unionByName(found), "nearest")
                active = stored(active.join(_by_sorting(some.select("q")), "q", "left_anti"), "queries")
            break
        own = F.array(*_substrings("q", subcodes))
        near = F.array(*[F.split(F.lit(",".join(map(str, masks(r, w)))), ",").cast("array<int>") for w in sorted(set(widths))])  # one literal, not one for each mask
        which = F.array(*[F.lit(sorted(set(widths)).index(w)) for w in widths])
        probes = active.select("q", "limit", F.explode(F.slice(F.transform(own, lambda x, j: F.struct(j.alias("j"), x.alias("own"), F.get(near, F.get(which, j)).alias("near"))), of[0] + 1, len(of))).alias("p"))
        probes = probes.select("q", "limit", "p.j", F.explode(F.transform("p.near", lambda m: F.col("p.own").bitwiseXOR(m))).alias("sub"))
        met = probes.join(_by_sorting(index), ["j", "sub"]).where(apart <= F.col("limit")).select("q", "code", "n", "least", apart.alias("d")).distinct()
        if best is not None:
            met = best.join(_by_sorting(active), "q", "left_semi").unionByName(met).distinct()
        found = stored(nearest(met), "nearest")
        upto = F.sum("n").over(Window.partitionBy("q").orderBy("d").rangeBetween(Window.unboundedPreceding, 0))
        state = found.withColumn("_n", upto).groupBy("q").agg(F.min(F.when(F.col("_n") >= enough, F.col("d"))).alias("kth"))
        covered = subcodes * r + of[-1]
        best = found if best is None else stored(best.join(_by_sorting(active), "q", "left_anti").unionByName(found), "nearest")
        ahead = active.select("q").join(_by_sorting(state), "q", "left")
        active = stored(ahead.where(F.col("kth").isNull() | (F.col("kth") > covered)).select("q", F.coalesce("kth", F.lit(BITS)).alias("limit")), "queries")
        if active.isEmpty():
            break
    best = best.drop("least")
    wanted = best.select("code").distinct()
    order = Window.partitionBy("code").orderBy("id")
    ids = rows.join(_by_sorting(wanted), "code").withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k + 1).groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    per_code = best.join(_by_sorting(ids), "code").groupBy("q").agg(F.sort_array(F.collect_list(F.struct("d", "code", "ids"))).alias("found"))
    flat = F.slice(F.array_sort(F.flatten(F.transform("found", lambda x: F.transform(x["ids"], lambda i: F.struct(x["d"].alias("d"), i.alias("id")))))), 1, k + 1)
    answer = per_code.select("q", flat.alias("top"))
    mine = queries.select(F.col("id").alias("query_id"), F.col("code").alias("q")).join(_by_sorting(answer), "q")
    others = F.slice(F.filter("top", lambda x: x["id"] != F.col("query_id")), 1, k)
    return mine.select("query_id", F.posexplode(others).alias("rank", "x")).select("query_id", (F.col("rank") + 1).alias("rank"), F.col("x.id").alias("id"), F.col("x.d").alias("distance"))


SQL = f"""
WITH c AS (SELECT vec_id AS id, list_sum(list_transform(range(0, 64), lambda j: CASE WHEN embedding[j + 1] > 0 THEN (1::HUGEINT << j) ELSE 0::HUGEINT END))::HUGEINT AS code FROM embeddings WHERE len(embedding) = 64 AND vec_id IS NOT NULL),
p AS (SELECT a.id AS query_id, b.id, bit_count(xor(a.code::UBIGINT, b.code::UBIGINT))::INT AS distance FROM c a JOIN c b ON a.id % {QUERY_EVERY} = 0 AND a.id <> b.id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM p)
SELECT query_id, rank::INT AS rank, id AS vec_id, distance FROM r WHERE rank <= {K}
"""

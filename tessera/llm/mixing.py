"""Mixing of sources to target weights as a min-cost flow.

Documents are summed by membership pattern, the set of sources that they belong
to.  A small network then carries words from patterns to sources: a pattern
gives its size once for free, a second time at cost 1 and a third at cost 2, so
repetition is spread as evenly as the quotas allow.  Since each layer costs the
same everywhere, filling the network layer by layer along augmenting paths (which
may reroute what flows already) is a cheapest flow.  What a pattern gives is then
taken from its documents: all of them as often as it is a whole number of times,
and the rest from the first in a seeded order, found by descending through ranges of
hashes (a 256th of the one before each time, whatever the number of documents), with
one more document that fills the gap best.  A source none of whose patterns has
another source needs no network: it gets its quota.

Edge cases: null texts have size 0 and count as documents of their source; a
null source is a source (the last).  An empty source array counts as a null
source.  Equal rows are separate documents, taken equally often.  Sources of size 0 have target 0.
Extra columns are kept, but for those named as the results.  The driver holds one sum
a pattern, and sends them back by broadcast only while they are at most ``SENT``.
"""

from __future__ import annotations

import json
from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._links import kept

#: Rows of patterns that are broadcast at most; more are joined.
SENT = 20_000
#: Hashes that a range may have before it is cut again.
RANGE = 1000
WORD = r"[^\x20\x09-\x0D]+"


def in_order(sources) -> list:
    """Sources by code point, null last."""
    return sorted((s for s in sources if s is not None)) + [None] * any(s is None for s in sources)


def targets(sizes: dict, weights: dict, total: float, most: float) -> dict:
    """Shares of ``total`` by weight; none above ``most`` times its size, the excess reshared by weight."""
    out, free, left = {s: 0.0 for s in sizes}, set(sizes), float(total)
    while free:
        weight = sum(weights[s] for s in free)
        full = {s for s in free if left * weights[s] / weight > most * sizes[s]}
        if not full:
            for s in free:
                out[s] = left * weights[s] / weight
            break
        for s in full:
            out[s] = float(most * sizes[s])
            left -= out[s]
        free -= full
    return out


def route(patterns: dict[tuple, float], quota: dict, most: int) -> dict[tuple, dict]:
    """Words that each pattern gives to each of its sources: a cheapest flow that fills the quotas as far as it can."""
    flow: dict[tuple, dict] = {p: {s: 0.0 for s in p} for p in patterns}
    shared = {s for p in patterns if len(p) > 1 for s in p}
    for p, n in patterns.items():
        if not shared.intersection(p):
            flow[p][p[0]] = min(quota[p[0]], most * n)
    patterns = {p: n for p, n in patterns.items() if shared.intersection(p)}
    need = {s: quota[s] for s in shared}
    givers: dict = {}
    for p in patterns:
        for s in p:
            givers.setdefault(s, []).append(p)
    scale = max([1.0, *need.values()])
    for layer in range(1, most + 1):
        spare = {p: layer * n - sum(flow[p].values()) for p, n in patterns.items()}
        while True:
            # breadth first from patterns with room, over sources, back over what sources get from others
            seen_p = {p: None for p, n in spare.items() if n > 1e-9 * scale}
            seen_s: dict = {}
            todo, end = deque(seen_p), None
            while todo and end is None:
                p = todo.popleft()
                for s in p:
                    if s in seen_s:
                        continue
                    seen_s[s] = p
                    if need.get(s, 0.0) > 1e-9 * scale:
                        end = s
                        break
                    for q in givers[s]:
                        if q not in seen_p and flow[q][s] > 1e-9 * scale:
                            seen_p[q] = s
                            todo.append(q)
            if end is None:
                break
            path, s = [], end
            while s is not None:
                p = seen_s[s]
                path.append((p, s, seen_p[p]))
                s = seen_p[p]
            amount = min([need[end], spare[path[-1][0]], *(flow[p][back] for p, _, back in path if back is not None)])
            for p, s, back in path:
                flow[p][s] += amount
                if back is not None:
                    flow[p][back] -= amount
            need[end] -= amount
            spare[path[-1][0]] -= amount
    return flow


def mix(docs: DataFrame, weights, sources: Column | None = None, text: str = "text", most: int = 3, share: float = 1.0, seed: int = 17, order: str = "doc_id", carry: tuple[str, ...] | None = None) -> DataFrame:
    """Adds ``size``, ``source_size``, ``target``, ``copies`` and ``taken`` to every row (or to columns ``carry``).

    ``sources`` is a row's source or array of sources (default: column
    ``source``).  ``weights`` maps the list of sources to their weights.
    ``source_size`` and ``target`` are sums over a row's sources.
    """
    docs = docs.drop(*{"size", "source_size", "target", "copies", "taken"} - {text, order})
    sources = F.col("source") if sources is None else sources
    if not docs.select(sources.alias("s")).dtypes[0][1].startswith("array"):
        sources = F.array(sources)
    members = F.when(F.size(sources) > 0, F.array_sort(F.array_distinct(sources))).otherwise(F.array(F.lit(None).cast("string")))
    sized = docs.withColumns({"__pattern": F.to_json(members), "size": F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")})
    sized = sized.withColumn("__hash", F.xxhash64(F.lit(seed), F.col(order), F.col(text)))
    carry = None if carry is None else [c for c in carry if c in docs.columns]
    plan_of = kept(sized.select(*(carry or ()), "__pattern", "__hash", "size"))
    if carry is not None:
        sized = plan_of
    sums = plan_of.groupBy("__pattern").agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("rows")).collect()
    patterns = {tuple(json.loads(r["__pattern"])): float(r.n) for r in sums}
    sizes: dict = {}
    for p, n in patterns.items():
        for s in p:
            sizes[s] = sizes.get(s, 0.0) + n
    quota = targets(sizes, weights(in_order(sizes)), share * sum(patterns.values()), most)
    flow = route(patterns, quota, most)
    plan = {}
    for r in sums:
        p = tuple(json.loads(r["__pattern"]))
        gives = sum(flow[p].values())
        whole = min(most, int(gives // r.n)) if r.n else 0
        plan[r["__pattern"]] = (int(sum(sizes[s] for s in p)), float(sum(quota[s] for s in p)), whole, float(gives - whole * r.n) if whole < most else 0.0)
    cuts = _cuts(plan_of.select("__pattern", "__hash", "size"), {p: x[3] for p, x in plan.items()}, sum(r.rows for r in sums))
    rows = [(p, *plan[p][:3], *cuts.get(p, (None, None))) for p in plan]
    given = _sent(docs.sparkSession.createDataFrame(rows, "__pattern string, source_size long, target double, __whole int, __upto long, __also long"), len(rows))
    out = sized.join(given, "__pattern")
    once_more = F.coalesce(F.col("__hash") <= F.col("__upto"), F.lit(False)) | F.coalesce(F.col("__hash") == F.col("__also"), F.lit(False))
    out = out.withColumn("copies", F.col("__whole") + once_more.cast("int"))
    return out.withColumn("taken", F.col("size") * F.col("copies")).drop("__pattern", "__hash", "__whole", "__upto", "__also")


def _sent(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= SENT else df


def _cuts(rows: DataFrame, rest: dict[str, float], n: int) -> dict[str, tuple]:
    """Per pattern: the hash up to which documents are taken once more, and that of one more document that fills the gap best.

    Sums of 256 ranges of hashes a pattern find the one in which ``rest`` words
    are reached; it is cut again until it has few hashes, whose running sum finds
    the document.  Equal hashes go together.
    """
    spark = rows.sparkSession
    part = Window.partitionBy("__pattern")
    keyed = rows.join(_sent(spark.createDataFrame([(p, x) for p, x in rest.items() if x > 0], "__pattern string, rest double"), len(rest)), "__pattern")
    keyed = kept(keyed.groupBy("__pattern", "rest", "__hash").agg(F.sum("size").alias("size")))
    place = F.col("__hash").bitwiseXOR(F.lit(-(2**63)))  # hashes ascend as unsigned numbers
    inside, bits = keyed.withColumn("before", F.lit(0).cast("long")), 0
    most = n
    while most > RANGE and bits < 64:
        bits += 8
        sums = inside.groupBy("__pattern", "rest", "before", F.shiftrightunsigned(place, 64 - bits).alias("at")).agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("hashes"))
        sums = sums.withColumn("from", F.col("before") + F.sum("n").over(part.orderBy("at")) - F.col("n"))
        last = kept(sums.where("from <= rest").groupBy("__pattern").agg(F.max_by(F.struct(F.col("at"), F.col("from").alias("before"), "hashes"), "at").alias("r")))
        most = last.agg(F.max("r.hashes")).head()[0] or 0
        chosen = _sent(last.select("__pattern", F.col("r.at").alias("__at"), F.col("r.before").alias("before")), len(rest))
        inside = keyed.withColumn("__at", F.shiftrightunsigned(place, 64 - bits)).join(chosen, ["__pattern", "__at"]).drop("__at")
    inside = inside.withColumn("end", F.col("before") + F.sum("size").over(part.orderBy("__hash").rowsBetween(Window.unboundedPreceding, 0)))
    found = inside.groupBy("__pattern", "rest", "before").agg(F.max(F.when(F.col("end") <= F.col("rest"), F.struct("__hash", "end"))).alias("cut"), F.min("__hash").alias("low"))
    found = kept(found.select("__pattern", F.coalesce("cut.__hash", F.col("low") - 1).alias("upto"), (F.col("rest") - F.coalesce("cut.end", "before")).alias("gap")))
    left = keyed.join(_sent(found, len(rest)), "__pattern").where("__hash > upto and size > 0")
    best = left.groupBy("__pattern").agg(F.min(F.struct(F.abs(F.col("size") - F.col("gap")).alias("off"), "__hash")).alias("b"))
    more = {r["__pattern"]: r.b for r in best.collect()}
    out = {}
    for r in found.collect():
        b = more.get(r["__pattern"])
        out[r["__pattern"]] = (r.upto, b["__hash"] if b is not None and b.off < r.gap else None)
    return out


def rotating(sources: list) -> dict:
    """Weights 1, 2, 3, repeating."""
    return {s: 1 + k % 3 for k, s in enumerate(sources)}


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    """The mix of all documents under rotating weights."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs, rotating, carry=("doc_id",)).select("doc_id", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"), "copies")

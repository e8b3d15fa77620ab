"""Mixes of sources by target weights (problem 8).

Documents are aggregated by the set of target sources they belong to. Token capacity of these patterns, in
layers of repetitions whose cost grows from layer to layer, is routed to the sources' quotas by a min-cost
flow over the few patterns; then documents are picked in a seeded order, by their token position within
their pattern, until each route has its tokens.
"""

from __future__ import annotations

from collections import defaultdict, deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import durable

#: The flow runs over that many targets and membership patterns at most: with s target sources there are up to 2^s.
#: More of them raise an error, none is dropped.
MAX_PATTERNS = 4096
#: Documents whose tokens are summed up one after the other in a task, on average.
RUN = 50_000


def min_cost_flow(layers: dict[tuple[int, int], int], quotas: dict[str, int], allowed: dict[tuple[int, int], list[str]]) -> dict[tuple[int, int, str], int]:
    """Tokens routed from (pattern, first repetition) layers to sources: as many as fit, then as cheaply as possible.

    A layer that begins with the r-th use of a pattern's documents costs r a token, so repetitions are spread
    evenly. Successive shortest paths; the graph has patterns x layers + sources nodes, whatever the number of
    documents.
    """
    graph: dict = defaultdict(dict)  # node -> {node: [capacity, cost]}

    def edge(a, b, capacity, cost):
        graph[a][b] = [capacity, cost]
        graph[b][a] = [0, -cost]

    for layer, tokens in layers.items():
        edge("from", layer, tokens, layer[1])
        for s in allowed[layer]:
            edge(layer, s, tokens, 0)
    for s, quota in quotas.items():
        edge(s, "to", quota, 0)
    while True:
        cost, back, queue, queued = {"from": 0}, {}, deque(["from"]), {"from"}
        while queue:
            a = queue.popleft()
            queued.discard(a)
            for b, (capacity, c) in graph[a].items():
                if capacity > 0 and cost[a] + c < cost.get(b, float("inf")):
                    cost[b], back[b] = cost[a] + c, a
                    if b not in queued:
                        queue.append(b)
                        queued.add(b)
        if "to" not in back:
            break
        path, b = [], "to"
        while b != "from":
            path.append((back[b], b))
            b = back[b]
        most = min(graph[a][b][0] for a, b in path)
        for a, b in path:
            graph[a][b][0] -= most
            graph[b][a][0] += most
    return {(*layer, s): graph[s][layer][0] for layer in layers for s in allowed[layer] if graph[s][layer][0] > 0}


def repetition_layers(limits: list[int]) -> list[tuple[int, int]]:
    """(first, last) repetition of each layer up to the highest limit: 1, 2, 3-4, 5-8 and so on, also cut behind every limit."""
    top = max(limits, default=0)
    ends = sorted({*(1 << i for i in range(max(0, top - 1).bit_length() + 1)), *limits})
    ends = [e for e in ends if 0 < e <= top]
    return list(zip([1, *(e + 1 for e in ends)], ends))


def mix_sources(docs: DataFrame, targets: DataFrame, seed: int = 17, total: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(uses, shares) of a mix of ``total`` tokens (default: as many as all documents have).

    ``docs``: doc_id, sources (array of names), n_tokens. ``targets``: source, target_share, max_repeats,
    at most MAX_PATTERNS rows, each source once. uses: doc_id, source, n_tokens, copies of every document in the mix. shares: source,
    target_share, target_tokens, n_docs, mix_tokens, mix_share, top_copies for each target.

    Documents of no target, with null sources or without tokens are never used, but their tokens count in
    the default total. A document's copies for a source never exceed max_repeats; what a source can't
    supply stays missing and shows in its share, others don't fill in for it. A route ends within one
    document of its tokens. A repeated doc_id is two documents. Null shares or repeats count as 0.
    """
    spark = docs.sparkSession
    wanted = targets.select("source", "target_share", "max_repeats").where("source IS NOT NULL").limit(MAX_PATTERNS + 1).collect()
    if len(wanted) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} target sources")
    goal = {r["source"]: (float(r["target_share"] or 0), int(r["max_repeats"] or 0)) for r in wanted}
    names = F.array(*map(F.lit, sorted(goal))).cast("array<string>")
    member = F.array_sort(F.array_intersect(F.array_distinct(F.coalesce("sources", F.array().cast("array<string>"))), names))
    order = F.xxhash64(F.lit(seed), "doc_id")
    counted = durable(docs.select("doc_id", member.alias("pattern"), F.coalesce("n_tokens", F.lit(0)).cast("bigint").alias("n_tokens"), order.alias("draw")))
    found = counted.groupBy("pattern").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n")).limit(MAX_PATTERNS + 1).collect()
    if len(found) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} combinations of target sources")
    total = sum(r["tokens"] for r in found) if total is None else total
    found = sorted((r for r in found if r["pattern"] and r["tokens"]), key=lambda r: r["pattern"])
    quotas = {s: round(share * total) for s, (share, _) in goal.items()}
    layers, allowed = {}, {}
    for p, r in enumerate(found):
        for first, last in repetition_layers([goal[s][1] for s in r["pattern"]]):
            layers[p, first] = r["tokens"] * (last - first + 1)
            allowed[p, first] = [s for s in r["pattern"] if goal[s][1] >= last]
    flow = min_cost_flow(layers, quotas, allowed)
    routes, filled = defaultdict(list), defaultdict(int)
    for (p, first, s), tokens in sorted(flow.items()):
        lo = filled[p, first]
        routes[p].append((s, lo, lo + tokens))
        filled[p, first] = lo + tokens
    plan = [(r["pattern"], max(1, r["n"] // RUN), r["tokens"], routes[p]) for p, r in enumerate(found) if routes[p]]
    schema = "pattern array<string>, parts int, tokens bigint, routes array<struct<source: string, lo: bigint, hi: bigint>>"
    plan_df = F.broadcast(spark.createDataFrame(plan, schema))  # at most MAX_PATTERNS rows
    # A document's token position in the seeded order: the tokens of the parts before its own, plus those before it in its part.
    placed = counted.where("n_tokens > 0").join(plan_df, "pattern")
    placed = placed.withColumn("part", F.floor((F.shiftrightunsigned("draw", 11) / F.lit(float(1 << 53))) * F.col("parts")).cast("int"))
    parts = placed.groupBy("pattern", "part").agg(F.sum("n_tokens").alias("part_tokens"))
    before = F.sum("part_tokens").over(Window.partitionBy("pattern").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.withColumn("part_start", F.coalesce(before, F.lit(0))).drop("part_tokens")
    inside = F.sum("n_tokens").over(Window.partitionBy("pattern", "part").orderBy("draw", "doc_id").rowsBetween(Window.unboundedPreceding, -1))
    placed = placed.withColumn("inside", F.coalesce(inside, F.lit(0))).join(parts, ["pattern", "part"])
    at = F.col("part_start") + F.col("inside")
    # A route holds the tokens from lo to hi of its layer, in which the pattern's documents come again and again.
    passed = lambda end: F.ceil((end - at) / F.col("tokens"))
    taken = F.transform("routes", lambda r: F.struct(r["source"].alias("source"), (passed(r["hi"]) - passed(r["lo"])).alias("copies")))
    uses = placed.select("doc_id", "n_tokens", F.filter(taken, lambda r: r["copies"] > 0).alias("taken"))
    uses = uses.select("doc_id", "n_tokens", "taken", F.explode(F.array_distinct(F.transform("taken", lambda r: r["source"]))).alias("source"))
    copies = F.aggregate(F.filter("taken", lambda r: r["source"] == F.col("source")), F.lit(0).cast("bigint"), lambda n, r: n + r["copies"])
    uses = uses.select("doc_id", "source", "n_tokens", copies.cast("int").alias("copies"))
    got = uses.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("n_tokens") * F.col("copies")).alias("mix_tokens"), F.max("copies").alias("top_copies")
    )
    goals = spark.createDataFrame([(s, share, quotas[s], repeats) for s, (share, repeats) in sorted(goal.items())], "source string, target_share double, target_tokens bigint, max_repeats int")
    zero = F.lit(0)
    shares = goals.join(F.broadcast(got), "source", "left")  # one row per target
    shares = shares.withColumns({"n_docs": F.coalesce("n_docs", zero), "mix_tokens": F.coalesce("mix_tokens", zero), "top_copies": F.coalesce("top_copies", zero)})
    whole = got.agg(F.sum("mix_tokens").alias("whole"))
    shares = shares.crossJoin(F.broadcast(whole)).withColumn("mix_share", F.coalesce(F.try_divide("mix_tokens", "whole"), F.lit(0.0))).drop("whole")
    return uses, shares

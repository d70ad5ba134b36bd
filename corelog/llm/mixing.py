"""Mixing overlapping sources to target weights by min-cost flow (operator 8)."""

from __future__ import annotations

import heapq
from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corelog.llm.common import fresh, row_key, small, written

#: A document is used at most so many times.
EPOCHS = 4
#: Cost of a token's use number 1, 2, ...: convex, so second uses are bought only when first uses run out.
COSTS = (0, 1, 3, 6)
#: Cost of a token of quota that stays unfilled: above every path through the graph.
SHORT = 1_000_000
#: Target weights are tokens of the source to this power, scaled to 1, where no weights are given.
TEMPER = 0.7
#: Patterns that the driver's flow takes. There are as many as combinations of sources occur, however many documents there are.
MAX_PATTERNS = 200_000
#: Documents of a pattern are ordered in chunks of about so many.
CHUNK = 4096


class Flow:
    """Min-cost flow by the primal-dual method: shortest distances by Dijkstra on reduced costs, then a blocking flow along
    all shortest paths at once. Whole-number capacities and costs; there are as many rounds as path costs differ."""

    def __init__(self):
        self.to: list[int] = []
        self.cap: list[int] = []
        self.cost: list[int] = []
        self.out: list[list[int]] = []

    def add(self, u: int, v: int, cap: int, cost: int) -> int:
        while len(self.out) <= max(u, v):
            self.out.append([])
        for a, b, c, w in ((u, v, cap, cost), (v, u, 0, -cost)):
            self.out[a].append(len(self.to))
            self.to.append(b)
            self.cap.append(c)
            self.cost.append(w)
        return len(self.to) - 2

    def run(self, s: int, t: int) -> tuple[int, int]:
        """(flow, cost). Potentials keep reduced costs at 0 or more."""
        n, to, cap, cost, out = len(self.out), self.to, self.cap, self.cost, self.out
        potential = [0] * n
        flow = total = 0
        if not n or max(s, t) >= n:
            return 0, 0
        while True:
            dist: list[int | None] = [None] * n
            dist[s] = 0
            heap, done = [(0, s)], [False] * n
            while heap:
                d, u = heapq.heappop(heap)
                if done[u]:
                    continue
                done[u] = True
                base = d + potential[u]
                for e in out[u]:
                    if cap[e] and not done[to[e]]:
                        v = to[e]
                        far = base + cost[e] - potential[v]
                        if dist[v] is None or far < dist[v]:
                            dist[v] = far
                            heapq.heappush(heap, (far, v))
            if dist[t] is None:
                return flow, total
            for v in range(n):
                potential[v] += dist[t] if dist[v] is None else min(dist[v], dist[t])
            pushed = self._shortest(s, t, potential)
            flow += pushed
            total += pushed * (potential[t] - potential[s])

    def _shortest(self, s: int, t: int, potential: list[int]) -> int:
        """The greatest flow along arcs of reduced cost 0, by levels."""
        to, cap, cost, out = self.to, self.cap, self.cost, self.out
        flow = 0
        while True:
            level = {s: 0}
            front = [s]
            while front and t not in level:
                nxt = []
                for u in front:
                    for e in out[u]:
                        v = to[e]
                        if cap[e] and v not in level and cost[e] + potential[u] == potential[v]:
                            level[v] = level[u] + 1
                            nxt.append(v)
                front = nxt
            if t not in level:
                return flow
            at = dict.fromkeys(level, 0)
            path: list[int] = []
            u = s
            while True:
                if u == t:
                    push = min(cap[e] for e in path)
                    flow += push
                    for e in path:
                        cap[e] -= push
                        cap[e ^ 1] += push
                    k = next(i for i, e in enumerate(path) if not cap[e])
                    u = to[path[k] ^ 1]
                    del path[k:]
                    continue
                arcs = out[u]
                while at[u] < len(arcs):
                    e = arcs[at[u]]
                    v = to[e]
                    if cap[e] and level.get(v) == level[u] + 1 and cost[e] + potential[u] == potential[v]:
                        break
                    at[u] += 1
                if at[u] < len(arcs):
                    path.append(arcs[at[u]])
                    u = to[path[-1]]
                elif path:
                    u = to[path.pop() ^ 1]
                    at[u] += 1
                else:
                    break


def route(tokens: dict[tuple[str, ...], int], quotas: dict[str, int], epochs: int = EPOCHS, costs: tuple[int, ...] = COSTS) -> dict[tuple[str, ...], dict[str, int]]:
    """For each membership pattern, how many tokens go to each of its sources' quotas, at least total cost.

    The graph: start -> pattern, one arc for each use with the pattern's tokens as capacity and the use's cost; pattern ->
    each of its sources; source -> end with its quota; start -> source at cost SHORT for what can't be filled.
    """
    f = Flow()
    patterns, sources = sorted(tokens), sorted(quotas)
    node = {p: i + 2 for i, p in enumerate(patterns)}
    at = {s: i + 2 + len(patterns) for i, s in enumerate(sources)}
    arcs = []
    for p in patterns:
        for e in range(epochs):
            f.add(0, node[p], tokens[p], costs[e])
        for s in p:
            if s in at:
                arcs.append((p, s, f.add(node[p], at[s], epochs * tokens[p], 0)))
    for s in sources:
        f.add(0, at[s], quotas[s], SHORT)
        f.add(at[s], 1, quotas[s], 0)
    f.run(0, 1)
    out: dict[tuple[str, ...], dict[str, int]] = {p: {} for p in patterns}
    for p, s, e in arcs:
        if f.cap[e ^ 1]:
            out[p][s] = f.cap[e ^ 1]
    return out


def quotas(tokens: dict[str, int], weights: dict[str, float] | None, budget: int) -> dict[str, int]:
    """Whole-number token quotas by source, of sum `budget`: the largest remainders get what rounding leaves."""
    weights = {s: float(n) ** TEMPER for s, n in tokens.items() if n > 0} if weights is None else {s: w for s, w in weights.items() if w > 0}
    total = sum(weights.values())
    if not total:
        return {}
    exact = {s: budget * w / total for s, w in weights.items()}
    out = {s: int(x) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (out[s] - exact[s], s))[: budget - sum(out.values())]:
        out[s] += 1
    return out


def _fraction(seed: int) -> Column:
    """A uniform whole number of 0 to 2^52 - 1 for a content, from a seeded md5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.col("content"))), 1, 13), 16, 10).cast("bigint")


def mix(df: DataFrame, **options) -> DataFrame:
    """(doc_key, source, copies): the selected documents, the quota that each copy counts for, and how often it is used there.
    See chosen_rows, whose options and cases these are."""
    return chosen_rows(df, **options).drop("rows")


def chosen_rows(
    df: DataFrame,
    *,
    weights: dict[str, float] | None = None,
    budget: float = 1.0,
    seed: int = 17,
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """(doc_key, source, copies, rows): the selected documents, the quota that each copy counts for, how often it is used there,
    and how many rows of df have that key and source.

    Documents of equal text are one content; the set of sources in which it stands is its membership pattern. Tokens are
    words between white space. The budget is that share of all contents' tokens; weights are the share of each source in
    it (default: its tokens to the power TEMPER). Contents and tokens are counted by pattern, in Spark; the flow over
    patterns, of which there are as many as combinations occur, is the driver's. Then each pattern's contents, in the
    order of a seeded hash, are laid end to end `uses` times and dealt to the pattern's sources in stretches of the routed
    size: a content belongs to the stretch in which it begins. So a source gets its quota to within one content a pattern.

    The order is a sum over prefixes in two steps, chunks of the hash first, so that no task holds a whole pattern.
    NULL text and texts without words have no tokens and are not selected. A NULL source is the source ''. Repeated rows
    are one content. A content of several rows is selected by one of them: the one of the assigned source with the least
    key. Ties of the hash go by content. Empty table: empty result.
    """
    c = F.col(text)
    words = F.size(F.filter(F.split(F.regexp_replace(c, "[ \\t\\r\\n]+", " "), " "), lambda x: x != ""))
    rows = df.select(
        row_key(text=text).alias("doc_key"),
        F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"),
        F.md5(c).alias("content"),
        words.cast("bigint").alias("tokens"),
    ).where("tokens > 0")
    once = rows.groupBy("content", "source", "doc_key").agg(F.first("tokens").alias("tokens"), F.count("*").alias("rows"))
    seats = once.groupBy("content", "source").agg(F.min(F.struct("doc_key", "rows")).alias("seat"), F.first("tokens").alias("tokens"))
    contents = seats.groupBy("content").agg(F.first("tokens").alias("tokens"), F.array_sort(F.collect_list(F.struct("source", "seat.doc_key", "seat.rows"))).alias("seats"))
    contents = written(contents.select("content", "tokens", "seats", F.col("seats.source").alias("pattern")), "contents")
    groups = contents.groupBy("pattern").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n"))
    found = groups.limit(MAX_PATTERNS + 1).collect()
    if len(found) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns: group the sources first")
    of = {tuple(r["pattern"]): r["tokens"] for r in found}
    by_source: dict[str, int] = defaultdict(int)
    for p, n in of.items():
        for s in p:
            by_source[s] += n
    routed = route(of, quotas(by_source, weights, int(budget * sum(of.values()))))
    # Stretches [begin, end) of each pattern's line of tokens, use after use.
    plan = []
    for r in found:
        p, begin = tuple(r["pattern"]), 0
        for s, n in sorted(routed[p].items()):
            plan.append((list(p), r["tokens"], max(1, -(-r["n"] // CHUNK)), s, begin, begin + n))
            begin += n
    spark = df.sparkSession
    plan = spark.createDataFrame(plan, "pattern array<string>, total long, chunks long, source string, begin long, end long")
    chunks = small(written(plan.select("pattern", "chunks").distinct(), "chunks"))
    placed = contents.join(chunks, "pattern").withColumn("h", _fraction(seed)).withColumn("chunk", F.expr("(h * chunks) DIV 4503599627370496"))
    sums = placed.groupBy("pattern", "chunk").agg(F.sum("tokens").alias("tokens"))
    before = Window.partitionBy("pattern").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("pattern", "chunk", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("pattern", "chunk").orderBy("h", "content").rowsBetween(Window.unboundedPreceding, -1)
    at = placed.withColumn("inner", F.coalesce(F.sum("tokens").over(inside), F.lit(0))).join(sums, ["pattern", "chunk"])
    at = at.select("pattern", "seats", (F.col("base") + F.col("inner")).alias("at"))
    # Use u of a content begins at u * total + at: it counts for the stretch that holds that point.
    dealt = at.join(small(written(plan, "plan")), "pattern").withColumn("copies", F.expr("(end - at + total - 1) DIV total - (begin - at + total - 1) DIV total"))
    # DIV rounds towards 0; both numerators are at least 0 as at < total.
    dealt = dealt.where("copies > 0")
    seat = F.element_at(F.filter("seats", lambda x: x["source"] == F.col("source")), 1)
    return dealt.select(seat["doc_key"].alias("doc_key"), "source", "copies", seat["rows"].alias("rows"))


def mix_documents(df: DataFrame, *, text: str = "text", source: str = "source", copies: str | None = "copies", **options) -> DataFrame:
    """The rows of df that mix() selects: df's columns, and the number of uses if it is given a name.

    Rows that are not selected go. Without a name for the uses, a row stands as often as it is used. Selected rows keep
    all their values: the row is that of the source whose quota it fills. Of rows with equal id, text and source one is
    used, the least by its values as JSON. Cases are as in chosen_rows(). A clash of names raises ValueError.
    """
    if copies and copies.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"column exists already: {copies}")
    key, at, used, rows, nth = fresh(df, "key", "at", "used", "rows", "nth")
    chosen = written(chosen_rows(df, text=text, source=source, **options), "chosen").toDF(key, at, used, rows)
    keyed = df.withColumns({key: row_key(text=text), at: F.coalesce(F.col(source).cast("string"), F.lit(""))})
    out = keyed.join(small(chosen), [key, at])
    # Repeated rows alone are ranked; they are few or none as a rule, and so is what is shuffled for it.
    w = Window.partitionBy(key, at).orderBy(F.to_json(F.struct(*df.columns)))
    again = out.where(F.col(rows) > 1).withColumn(nth, F.row_number().over(w)).where(F.col(nth) == 1).drop(nth)
    out = out.where(F.col(rows) == 1).unionByName(again) if chosen.where(F.col(rows) > 1).limit(1).count() else out
    if copies:
        return out.select(*df.columns, F.col(used).cast("bigint").alias(copies))
    return out.withColumn(nth, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(used).cast("bigint")))).select(*df.columns)

"""Closures and orders over edge tables."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage through a table in the shared checkpoint folder (its own one where none is set, as in tests)."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    path = f"{base.rstrip('/')}/closure-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dependents(edges: DataFrame, seeds: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(key, depth): all that reach a seed (column key) along ``edges`` (from_key, to_key), with the least number of steps.

    Each round joins the newest keys only, and drops those that are known: cycles end by themselves.
    """
    edges = materialise(edges.select("from_key", "to_key"))
    known = materialise(seeds.select("key").distinct().withColumn("depth", F.lit(0)))
    frontier = known
    for depth in range(1, max_rounds + 1):
        step = edges.join(frontier.select(F.col("key").alias("to_key")), "to_key").select(F.col("from_key").alias("key")).distinct()
        frontier = materialise(step.join(known.select("key"), "key", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            return known
        known = known.unionByName(frontier)
    raise RuntimeError("the closure did not end")


def topological_order(nodes: DataFrame, edges: DataFrame, plan: str = "plan_id") -> DataFrame:
    """(plan, key, seq, cyclic): Kahn's order, the ready key of least (rank, ordinal, key) first; a cycle's keys come last.

    ``nodes`` (plan, key, rank, ordinal), ``edges`` (plan, src, dst): src before dst.  One plan is one group: its order is
    sequential by nature, and plans are small beside the table of plans.
    """
    import heapq

    packed = nodes.select(plan, F.lit(0).alias("t"), F.col("key").alias("a"), F.lit(None).cast("string").alias("b"), "rank", "ordinal").unionByName(
        edges.select(plan, F.lit(1).alias("t"), F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(0).cast("long").alias("rank"), F.lit(0).cast("long").alias("ordinal"))
    )

    def order(part: pd.DataFrame) -> pd.DataFrame:
        node = part[part.t == 0]
        base = {r.a: (int(r.rank), int(r.ordinal), r.a) for r in node.itertuples()}
        after: dict[str, set[str]] = {k: set() for k in base}
        waiting = dict.fromkeys(base, 0)
        for r in part[part.t == 1].itertuples():
            if r.a in base and r.b in base and r.a != r.b and r.b not in after[r.a]:
                after[r.a].add(r.b)
                waiting[r.b] += 1
        ready = [base[k] for k, n in waiting.items() if n == 0]
        heapq.heapify(ready)
        done: list[str] = []
        while ready:
            key = heapq.heappop(ready)[2]
            done.append(key)
            for k in after[key]:
                waiting[k] -= 1
                if waiting[k] == 0:
                    heapq.heappush(ready, base[k])
        seen = set(done)
        left = [k for _, _, k in sorted(base[k] for k in base if k not in seen)]
        return pd.DataFrame({plan: part[plan].iloc[0], "key": done + left, "seq": range(len(base)), "cyclic": [False] * len(done) + [True] * len(left)})

    kind = dict(nodes.dtypes)[plan]
    return packed.groupBy(plan).applyInPandas(order, f"{plan} {kind}, key string, seq long, cyclic boolean")


def cyclic_keys(edges: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """Keys on a cycle, or between cycles: what is left when sources and sinks are peeled off, round by round."""
    left = materialise(edges.select("src", "dst").where("src <> dst").distinct())
    n = left.count()
    for _ in range(max_rounds):
        heads, tails = left.select(F.col("dst").alias("src")).distinct(), left.select(F.col("src").alias("dst")).distinct()
        left = materialise(left.join(heads, "src", "left_semi").join(tails, "dst", "left_semi").select("src", "dst"))
        now = left.count()
        if now == n:
            return left.select(F.col("src").alias("key")).distinct()
        n = now
    raise RuntimeError("the peeling did not end")


def _walks(links: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Of ``links`` (name, base): the walks (start, at, n) that end, n links on, at what is no name; and those without end, if any.

    Each round a walk goes on from where it is by the steps known from there, so their number doubles.  While a walk has
    its end before it, one of those behind it finds the same end in the next round: a round that ends none leaves cycles.
    """
    names = links.select(F.col("name").alias("base"), F.lit(True).alias("_on"))
    step = materialise(links.join(names, "base", "left").select(F.col("name").alias("start"), F.col("base").alias("at"), F.lit(1).cast("long").alias("n"), F.col("_on").isNull().alias("done")))
    known = None
    while True:
        done, on = step.where("done"), step.where("NOT done")
        known = done if known is None else known.unionByName(done)
        n_done, n_on = step.agg(F.count_if("done"), F.count_if(~F.col("done"))).first()
        if not n_on or not n_done:
            return known.drop("done"), on.drop("done") if n_on else None
        to = known.unionByName(on).select(F.col("start").alias("at"), F.col("at").alias("_at"), F.col("n").alias("_n"), F.col("done").alias("_done"))
        step = materialise(on.join(to, "at").select("start", F.col("_at").alias("at"), (F.col("n") + F.col("_n")).alias("n"), F.col("_done").alias("done")))


def _rings(links: DataFrame, endless: DataFrame) -> DataFrame:
    """(name, size) of the names on cycles, from the walks (start, at) without end."""
    n = -1
    while True:
        # The places that walks are at get fewer until only those on cycles are left, which are as many after each step.
        before, n = n, endless.select("at").distinct().count()
        if n == before:
            break
        to = endless.select(F.col("start").alias("at"), F.col("at").alias("_at"))
        endless = materialise(endless.join(to, "at").select("start", F.col("_at").alias("at")))
    ring = endless.select(F.col("at").alias("name")).distinct()
    # Each name learns the least name of twice as many links; when none learns anything, all of a cycle know the same one.
    seen = materialise(links.join(ring, "name", "left_semi").select("name", F.col("base").alias("at"), F.col("name").alias("least"), F.lit(True).alias("new")))
    while seen.where("new").limit(1).count():
        to = seen.select(F.col("name").alias("at"), F.col("at").alias("_at"), F.col("least").alias("_least"))
        seen = materialise(seen.join(to, "at").select("name", F.col("_at").alias("at"), F.least("least", "_least").alias("least"), (F.col("_least") < F.col("least")).alias("new")))
    return seen.join(seen.groupBy("least").agg(F.count("*").alias("size")), "least").select("name", "size")


def chains(spark, links: DataFrame) -> DataFrame:
    """(start, target, length, cyclic) of chains of ``links`` (name, base), followed to their end.

    A walk stops at the first base that it has visited: its length is that of the way to a cycle and around it once.  A
    null base ends a chain without target, ``cyclic`` is null then; so does a null name.  The work grows with the links
    times the logarithm of the longest chain.  Names with several bases are walked by recursion (``_branches``).
    """
    links = materialise(links.select("name", "base").distinct())
    named = links.where("name IS NOT NULL")
    n, names = named.agg(F.count("*"), F.count_distinct("name")).first()
    if n > names:
        return _branches(spark, links)
    ended, endless = _walks(named)
    none = F.lit(None).cast("string")
    out = ended.select("start", F.col("at").alias("target"), F.col("n").alias("length"), F.when(F.col("at").isNotNull(), False).alias("cyclic"))
    out = out.unionByName(links.where("name IS NULL").limit(1).select(F.col("name").alias("start"), none.alias("target"), F.lit(1).cast("long").alias("length"), F.lit(None).cast("boolean").alias("cyclic")))
    if endless is None:
        return out
    rings = materialise(_rings(named, endless))
    cyclic = lambda rows: rows.select("start", none.alias("target"), "length", F.lit(True).alias("cyclic"))
    out = out.unionByName(cyclic(rings.select(F.col("name").alias("start"), F.col("size").alias("length"))))
    # The way to a cycle ends where the cycle begins.
    ways = named.join(endless.select(F.col("start").alias("name")), "name", "left_semi").join(rings, "name", "left_anti")
    to, _ = _walks(ways)
    return out.unionByName(cyclic(to.join(rings, F.col("at") == F.col("name")).select("start", (F.col("n") + F.col("size")).alias("length"))))


def _branches(spark, links: DataFrame) -> DataFrame:
    """``chains`` where a name has several bases: the longest of its walks.  They are too many to follow beyond Spark's
    limit of rows in a recursion (``spark.sql.cteRecursionRowLimit``); the query fails there."""
    longest = links.count()
    walked = spark.sql(
        """WITH RECURSIVE walk(start, at, path, cyclic) MAX RECURSION LEVEL {levels} AS (
            SELECT name, base, array(name), base = name FROM {links}
            UNION ALL
            SELECT w.start, l.base, array_append(w.path, l.name), array_contains(w.path, l.base) OR l.base = l.name
            FROM walk w JOIN {links} l ON l.name = w.at
            WHERE NOT w.cyclic)
        SELECT start, at, path, cyclic FROM walk""",
        links=links,
        levels=longest + 1,
    )
    last = walked.groupBy("start").agg(F.max_by(F.struct("at", F.size("path").alias("length"), "cyclic"), F.size("path")).alias("r"))
    return last.select("start", F.when(~F.col("r.cyclic"), F.col("r.at")).alias("target"), F.col("r.length").cast("long").alias("length"), F.col("r.cyclic").alias("cyclic"))

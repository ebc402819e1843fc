"""Mixing overlapping sources to target weights with a min-cost flow.

Documents are aggregated by membership pattern (the set of sources a document
belongs to), so the flow network has one node for each pattern and source,
however many documents there are. Token capacity flows pattern -> source ->
sink; the n-th copy of a pattern's tokens costs n - 1, a convex price that makes
the flow use fresh tokens before repeats. The flow of each pattern is then
turned into copies of documents by a seeded order.

Up to ``limit`` patterns, their table is small by that check: the driver solves
the flow and plans are broadcast. Beyond, sources are ranked and levelled by
aggregates, each connected group of sources is solved by a task, and plans are
joined by key, heavy patterns dealt over several tasks. Both ways give the same plan.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skerry.llm.common import packed, partitions, spread_join, stored, text_key, word_count
from skerry.llm.components import components

#: Membership patterns up to which the driver solves the flow and plans are broadcast.
LIMIT = 20_000
#: Places in the seeded order have 40 bits; sums are taken over bins of the upper 14, then within one bin.
PLACE_BITS, BIN_SHIFT = 40, 26
PATTERN = "array<struct<none:boolean,name:string>>"


def targets(sizes: dict, weights: dict, budget: Fraction, most: int = 2) -> dict:
    """Share budget by weight; a source takes most times its size at the most, and the excess is shared again by weight."""
    out, free = {}, {s for s in sizes}
    left = Fraction(budget)
    while free:
        total = sum(weights[s] for s in free)
        full = {s for s in free if left * weights[s] > most * sizes[s] * total}
        if not full:
            return out | {s: left * weights[s] / total for s in free}
        for s in full:
            out[s] = Fraction(most * sizes[s])
            left -= out[s]
        free -= full
    return out


def min_cost_flow(capacity: dict, members: dict, demand: dict, most: int = 2) -> dict:
    """Words of each (pattern, copy, source): successive cheapest augmenting paths.

    capacity: words of a pattern; members: its sources; demand: whole words a
    source wants. Costs are the copy's number. A source that takes words of a full
    copy from another pays what that one gets back, so a path costs what its last
    copy does: paths are found by the number of that copy, with residual arcs
    between the sources of a pattern in all copies opened so far. The flow is as
    large as it can be and, at that size, the cheapest.
    """
    flow: dict = {}
    want = dict(demand)
    by_source: dict = {}
    for p, sources in members.items():
        for s in sources:
            by_source.setdefault(s, []).append(p)
    room = {(p, c): n for p, n in capacity.items() for c in range(most)}
    for top in range(most):  # what no source can reach now stays out of reach, so earlier copies need no second look
        for start in sorted(by_source):
            while want.get(start, 0) > 0:
                seen, queue, hit = {start: None}, [start], None
                while queue and hit is None:  # breadth first: the fewest reroutings
                    s = queue.pop(0)
                    for p, copy in ((p, c) for p in by_source[s] for c in range(top + 1)):
                        if room[p, copy] > 0:
                            hit = (s, p, copy)
                            break
                        for other in members[p]:
                            if other not in seen and flow.get((p, copy, other), 0) > 0:
                                seen[other] = (s, p, copy)
                                queue.append(other)
                if hit is None:
                    break
                s, p, copy = hit
                path, amount, at = [], min(want[start], room[p, copy]), s
                while seen[at] is not None:
                    before, through, k = seen[at]
                    amount = min(amount, flow[(through, k, at)])
                    path.append((before, through, k, at))
                    at = before
                room[p, copy] -= amount
                flow[(p, copy, s)] = flow.get((p, copy, s), 0) + amount
                for before, through, k, to in path:  # 'to' hands its share of the pattern to 'before'
                    flow[(through, k, to)] -= amount
                    flow[(through, k, before)] = flow.get((through, k, before), 0) + amount
                want[start] -= amount
    return flow


def seeded(seed: int, *by: Column) -> Column:
    """A place below 2**40 from what tells rows apart."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *by), 64 - PLACE_BITS)


def _taken(capacity: dict, demand: dict, most: int) -> dict:
    """Words that the flow takes of each pattern (a tuple of its sources' ranks), all copies together."""
    order = {p: capacity[p] for p in sorted(capacity)}
    flow = min_cost_flow(order, {p: p for p in order}, demand, most)
    return {p: sum(flow.get((p, c, s), 0) for c in range(most) for s in p) for p in order}


def _plan_here(patterns: DataFrame, weights: Sequence[int], share: Fraction, most: int) -> DataFrame:
    """The plan of a table of few patterns: source_size, target, whole copies of all documents, and words beyond those."""
    rows = patterns.collect()
    names = sorted({(s["none"], s["name"] or "") for r in rows for s in r["pattern"]})
    rank = {s: i for i, s in enumerate(names)}
    of = [tuple(sorted(rank[s["none"], s["name"] or ""] for s in r["pattern"])) for r in rows]
    words = {p: r["words"] for p, r in zip(of, rows)}
    sizes = {i: sum(n for p, n in words.items() if i in p) for i in rank.values()} if any(len(p) > 1 for p in of) else {p[0]: n for p, n in words.items() if p}
    target = targets(sizes, {i: weights[i % len(weights)] for i in sizes}, share * sum(words.values()), most)
    taken = _taken(words, {i: round(t) for i, t in target.items()}, most)
    plan = []
    for r, p in zip(rows, of):
        whole = min(taken[p] // words[p], most) if words[p] else 0
        plan.append((r["pattern"], sum(sizes[i] for i in p), float(sum(target[i] for i in p)), int(whole), int(taken[p] - whole * words[p]), r["n"]))
    return patterns.sparkSession.createDataFrame(plan, f"pattern {PATTERN}, source_size long, target double, whole int, rest long, n long")


def _ranked(sources: DataFrame, weights: Sequence[int]) -> DataFrame:
    """source, size, rank (by code point, null last) and weight; only row counts of sorted ranges reach the driver."""
    spark = sources.sparkSession
    parts = partitions(spark)
    ranged = sources.repartitionByRange(parts, "source").sortWithinPartitions("source")
    ranged = stored(ranged.select("source", "size", F.spark_partition_id().alias("range"), F.expr("monotonically_increasing_id() % 8589934592").alias("step")), "ranges")
    counts = dict(ranged.groupBy("range").count().collect())  # a row for each range
    before, sums = 0, []
    for i in sorted(counts):
        sums.append((i, before))
        before += counts[i]
    ranged = ranged.join(F.broadcast(spark.createDataFrame(sums, "range int, before long")), "range")
    rank = F.col("before") + F.col("step")
    given = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    return stored(ranged.select("source", "size", rank.alias("rank"), given.cast("long").alias("weight")), "ranked")


def _level(ranked: DataFrame, budget: Fraction, most: int) -> Fraction:
    """Words for each unit of weight at which the sources that are not full share what the full ones leave."""
    level = budget / (ranked.agg(F.sum("weight")).first()[0] or 1)
    while True:
        big = lambda n: F.lit(n).cast("decimal(38,0)")
        full = F.col("weight") * big(level.numerator) > F.col("size") * big(most * level.denominator)
        capped, free = ranked.agg(F.sum(F.when(full, F.col("size") * most)), F.sum(F.when(~full, F.col("weight")))).first()
        if not free:
            return level
        new = (budget - (capped or 0)) / free
        if new == level:
            return level
        level = new


def _plan_by_tasks(patterns: DataFrame, weights: Sequence[int], share: Fraction, most: int) -> DataFrame:
    """The same plan, worked out by aggregates, joins and a task for each connected group of sources."""
    total = patterns.agg(F.sum("words")).first()[0] or 0
    each = patterns.select("pattern", "words", F.explode("pattern").alias("source"))
    ranked = _ranked(each.groupBy("source").agg(F.sum("words").alias("size")), weights)
    level = _level(ranked, share * total, most)
    wants = {w: level * w for w in weights}
    full = F.col("weight") * F.lit(level.numerator).cast("decimal(38,0)") > F.col("size") * F.lit(most * level.denominator).cast("decimal(38,0)")
    pick = lambda f: F.create_map(*[x for w, t in wants.items() for x in (F.lit(w).cast("long"), F.lit(f(t)))])[F.col("weight")]
    known = ranked.select("source", "size", "rank", F.when(full, F.col("size") * most).otherwise(pick(round)).alias("want"), F.when(full, F.col("size") * float(most)).otherwise(pick(float)).alias("target"))
    joined = each.join(known.hint("merge"), "source").groupBy("pattern").agg(
        F.first("words").alias("words"), F.sort_array(F.collect_list(F.struct("rank", "want"))).alias("asks"), F.sum("size").alias("source_size"), F.sum("target").alias("target")
    )
    joined = stored(joined, "asks")
    pairs = F.transform(F.slice("asks", 2, F.size("asks")), lambda x: F.struct(F.col("asks")[0]["rank"].alias("a"), x["rank"].alias("b")))
    roots = components(joined.where("size(asks) > 1").select(F.explode(pairs).alias("e")).select("e.*"))
    grouped = joined.withColumn("node", F.col("asks")[0]["rank"]).join(roots, "node", "left").withColumn("group", F.coalesce("root", "node"))
    slim = grouped.select("group", "words", F.col("asks.rank").alias("ranks"), F.col("asks.want").alias("wants"))

    def solve(pdf):
        import pandas as pd

        of = [tuple(int(i) for i in ranks) for ranks in pdf["ranks"]]
        demand = {i: int(w) for p, ws in zip(of, pdf["wants"]) for i, w in zip(p, ws)}
        taken = _taken({p: int(n) for p, n in zip(of, pdf["words"])}, demand, most)
        return pd.DataFrame({"ranks": [list(p) for p in of], "taken": [taken[p] for p in of]})

    solved = slim.groupBy("group").applyInPandas(solve, "ranks array<long>, taken long")
    plan = joined.withColumn("ranks", F.col("asks.rank")).join(solved, "ranks")
    whole = F.when(F.col("words") > 0, F.least(F.expr("taken div words"), F.lit(most))).otherwise(F.lit(0)).cast("int")
    plan = plan.select("pattern", "source_size", "target", whole.alias("whole"), "words", "taken").withColumn("rest", F.col("taken") - F.col("whole") * F.col("words"))
    lone = patterns.where("size(pattern) = 0").select("pattern", F.lit(0).cast("long").alias("source_size"), F.lit(0.0).alias("target"), F.lit(0).alias("whole"), F.lit(0).cast("long").alias("rest"), "n")
    return plan.join(patterns.select("pattern", "n"), "pattern").select("pattern", "source_size", "target", "whole", "rest", "n").unionByName(lone)


def mix(docs: DataFrame, sources: Column, size: Column, weights: Sequence[int] = (5, 2, 1), share: Fraction = Fraction(3, 2), most: int = 2, seed: int = 17, id_col: str = "doc_id", tell_apart: Sequence[str] = (), limit: int = LIMIT) -> DataFrame:
    """docs with size, source_size, target and copies (0 to most) for each row.

    ``sources`` is an array of the sources a row belongs to (a null among them
    is a source of its own); sources by code point, null last, take the weights
    in turn. A row of several sources reports the sums over them. A row without
    sources has target 0 and no copies. Null sizes count as 0; documents of
    size 0 keep one copy, since they cost nothing. The seeded order goes by
    identifier, size and the columns named in ``tell_apart``; rows alike in all
    of those share a place and fare alike. Columns of docs named like a new one give way.
    """
    named = F.transform(F.coalesce(sources, F.array().cast("array<string>")), lambda s: F.struct(s.isNull().alias("none"), s.alias("name")))
    count = F.coalesce(size, F.lit(0)).cast("long")
    place = seeded(seed, F.col(f"`{id_col}`"), count, *[F.col(f"`{c}`") for c in tell_apart])
    rows = packed(docs, pattern=F.array_sort(F.array_distinct(named)).cast(PATTERN), place=place, size=count)
    slim = stored(rows.select("pattern", "place", "size"), "mix")
    patterns = stored(slim.groupBy("pattern").agg(F.sum("size").alias("words"), F.count("*").alias("n")), "patterns")
    few = patterns.limit(limit + 1).count() <= limit
    attach = (lambda many, plan: many.join(F.broadcast(plan.drop("n")), "pattern")) if few else lambda many, plan: spread_join(many, plan, ["pattern"]).drop("n")
    plan = stored((_plan_here if few else _plan_by_tasks)(patterns, weights, share, most), "plan")
    # Where the rest of each pattern ends in the seeded order: in which bin, then at which place of it.
    cuts, inside = plan.where("rest > 0").select("pattern", "rest", "n", F.lit(0).cast("long").alias("before")), slim
    for shift in (BIN_SHIFT, 0):
        sums = attach(inside, stored(cuts, "cuts")).groupBy("pattern", "rest", F.shiftright("place", shift).alias("bin"))
        sums = sums.agg(F.first("before").alias("start"), F.sum("size").alias("words"), F.count("*").alias("n"))
        running = F.sum("words").over(Window.partitionBy("pattern").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        sums = sums.withColumn("before", F.col("start") + running - F.col("words"))
        cuts = stored(sums.where("before < rest and before + words >= rest").select("pattern", "rest", "before", "words", "bin", "n"), "cut")
        inside = attach(slim, cuts.select("pattern", "bin", "n")).where(F.shiftright("place", shift) == F.col("bin")).select("pattern", "place", "size")
        cuts = cuts if shift == 0 else cuts.select("pattern", "rest", "n", "before")
    nearer = F.col("before") + F.col("words") - F.col("rest") <= F.col("rest") - F.col("before")  # the last documents only if that comes nearer
    last = cuts.select("pattern", (F.col("bin") - F.when(nearer, 0).otherwise(1)).alias("last"))
    plan = stored(plan.join(last, "pattern", "left"), "plan")
    copies = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.col("whole") + (F.col("place") <= F.coalesce("last", F.lit(-1))).cast("int"))
    out = attach(rows, plan).withColumn("copies", F.least(copies, F.lit(most)).cast("int"))
    new = ("size", "source_size", "target", "copies")
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns if c.lower() not in new], *new)


def mix_by_source(docs: DataFrame, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id", **how) -> DataFrame:
    """mix() for a table where each row names one source and its size is its number of words; rows are told apart by their text, too."""
    rows = packed(docs, doc_id=F.col(f"`{id_col}`"), sources=F.array(F.col(f"`{source_col}`").cast("string")), words=word_count(F.col(f"`{text_col}`")), sig=text_key(F.col(f"`{text_col}`")))
    mixed = mix(rows, F.col("sources"), F.col("words"), tell_apart=["sig"], **how)
    new = ("size", "source_size", "target", "copies")
    return mixed.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns if c.lower() not in new], *new)

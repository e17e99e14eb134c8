"""Sharding by balanced label propagation: linked documents move towards their neighbours' shards under quotas.

Documents with the same link are neighbours, and in one shard they are alike, so a label is kept for each (link, shard)
with the number of documents there: a group has as many rows as shards, however large it is. In a round every label asks
to go where its neighbours are; the demands between shards (shards times shards numbers) are cut to flows that keep
every shard within its quota, counting the room that leavers make; a join hands the flows out. Rounds go on until
nothing gained by a move is left. Large groups settle before small ones are dealt, so that those don't stand in the way.
"""

from __future__ import annotations

import json
from collections import defaultdict, deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weir.llm.common import rank_parts, ranked, stash

#: Rounds without a gain after which the labels stay.
IDLE = 5


def flows(demand: dict[tuple[int, int], int], room: list[int]) -> dict[tuple[int, int], int]:
    """How much of each demand (from, to) can move at once, so that no shard takes in more than its room and what leaves
    it: demands are used up along the shortest cycles first, a cycle through free room being one, until none is left."""
    left = {k: n for k, n in demand.items() if n > 0}
    free = list(room)
    out: dict[tuple[int, int], int] = defaultdict(int)
    ends = defaultdict(list)
    for a, b in sorted(left):
        ends[a].append(b)

    def path(start: int) -> list[int] | None:
        """The fewest moves on from start: back to it, or to a shard with free room."""
        before, queue = {start: -1}, deque([start])
        while queue:
            a = queue.popleft()
            for b in ends[a]:
                if not left.get((a, b)):
                    continue
                if b == start or free[b]:
                    back = [b, a]
                    while before[back[-1]] >= 0:
                        back.append(before[back[-1]])
                    return back[::-1]
                if b not in before:
                    before[b] = a
                    queue.append(b)
        return None

    for start in sorted(ends):
        while way := path(start):
            steps = list(zip(way, way[1:], strict=False))
            amount = min(left[s] for s in steps)
            if way[-1] != start:
                amount = min(amount, free[way[-1]])
                free[way[-1]] -= amount
                free[start] += amount
            for s in steps:
                left[s] -= amount
                out[s] += amount
    return dict(out)


def _sums_before(df: DataFrame, by: list[str], order: list[str], value: str, parts: int) -> DataFrame:
    """df with `before`: the sum of value over the rows before, within by, in some fixed order; added up over hashed
    parts, so nothing meets in one task."""
    df = df.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(parts)))
    sums = df.groupBy(*by, "_part").agg(F.sum(value).alias("_sum"))
    upto = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*by, "_part", F.coalesce(F.sum("_sum").over(upto), F.lit(0)).alias("_skip"))
    inside = Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return df.join(sums, [*by, "_part"]).withColumn("before", F.col("_skip") + F.col("_in")).drop("_part", "_skip", "_in")


def _asks(labels: DataFrame, closed: list[int], spare: int, turn: int, idle: int) -> DataFrame:
    """(link, shard, goal, n): labels that should go elsewhere. A group's homes are the open shards where it has most
    documents, as many as it needs; one that stands in closed shards only asks for the roomiest, `spare`. Ties go by
    a hash of the round, and the longer nothing was gained, the more documents count as a tie."""
    noise = F.pmod(F.xxhash64("link", "shard", F.lit(turn)), F.lit(1024)) / 1024 * (1 + 0.75 * idle)
    is_open = ~F.col("shard").isin(closed)
    order = Window.partitionBy("link").orderBy(is_open.desc(), (F.col("n") + noise).desc(), "shard")
    placed = labels.withColumn("place", F.row_number().over(order)).withColumn("open", is_open)
    homes = placed.where("open or place = 1").where("place <= needs")
    homes = homes.groupBy("link").agg(F.collect_list(F.struct("place", "shard", "n", "open")).alias("homes"))  # as many as shards
    homes = homes.select("link", F.array_sort("homes").alias("homes"))
    away = placed.join(homes, "link")
    home = F.element_at("homes", (F.pmod(F.col("place"), F.size("homes")) + 1).cast("int"))
    away = away.withColumn("home", home).withColumn("stays", F.exists("homes", lambda h: (h["shard"] == F.col("shard")) & h["open"]))
    goal = F.when(F.col("home.open"), F.col("home.shard")).otherwise(F.lit(spare)).alias("goal")
    return away.where("not stays").select("link", "shard", goal, "n").where("goal != shard")


def _by_pair(numbers: dict[tuple[int, int], int], shards: int) -> Column:
    """The number of (shard, goal), by an array of shards times shards."""
    flat = [int(numbers.get((a, b), 0)) for a in range(shards) for b in range(shards)]
    values = F.from_json(F.lit("[" + ",".join(map(str, flat)) + "]"), "array<bigint>")
    return F.element_at(values, (F.col("shard") * shards + F.col("goal") + 1).cast("int"))


def deal(room: list[int], total: int) -> list[tuple[int, int, list[int]]]:
    """(start, stop, shards): ranks that go one after another to the shards that have room then."""
    left, at, out = list(room), 0, []
    while at < total:
        some = [s for s, r in enumerate(left) if r]
        level = min(min(left[s] for s in some), -(-(total - at) // len(some)))
        out.append((at, at + level * len(some), some))
        at += level * len(some)
        for s in some:
            left[s] -= level
    return out


def propagate(groups: DataFrame, room: list[int], total: int) -> DataFrame:
    """groups (link, size), total documents -> labels (link, shard, n), at most so many in a shard as it has room."""
    shards, parts, most = len(room), rank_parts(total), max(room)
    ranks = _sums_before(groups.select("link", "size"), [], ["link"], "size", parts)
    pieces_of = deal(room, total)
    pieces = F.from_json(F.lit(json.dumps([{"start": a, "stop": b, "to": c} for a, b, c in pieces_of])), "array<struct<start:bigint,stop:bigint,to:array<int>>>")
    lo, hi = F.greatest("before", "start"), F.least(F.col("before") + F.col("size"), F.col("stop"))
    needs = F.ceil(F.col("size") / max(1, most)).cast("int").alias("needs")
    start = ranks.select("link", "size", "before", needs, F.inline(pieces)).select("link", "needs", "start", "to", lo.alias("lo"), hi.alias("hi")).where("lo < hi")
    start = start.select("*", F.explode(F.sequence(F.lit(0), F.least(F.col("hi") - F.col("lo"), F.size("to")).cast("int") - 1)).alias("k"))
    at = F.pmod(F.col("lo") - F.col("start") + F.col("k"), F.size("to")).cast("int") + 1
    labels = start.select("link", "needs", F.element_at("to", at).alias("shard"), F.ceil((F.col("hi") - F.col("lo") - F.col("k")) / F.size("to")).cast("long").alias("n"))
    labels = labels.groupBy("link", "shard").agg(F.sum("n").alias("n"), F.max("needs").alias("needs"))
    cells = F.count(F.lit(1)).over(Window.partitionBy("link"))
    labels = stash(labels.withColumn("whole", cells <= F.col("needs")), "labels")
    done, closed, idle, turn = [], [], 0, 0
    room = list(room)
    for a, b, some in pieces_of:
        for k, s in enumerate(some):
            room[s] -= (min(b, total) - a - k + len(some) - 1) // len(some)
    level = best = 0
    while idle < IDLE:
        turn += 1
        done.append(labels.where("whole"))
        labels = labels.where("not whole")
        before = labels.agg(F.sum(F.col("n") * F.col("n"))).first()[0] or 0
        asks = stash(_asks(labels, closed, max(range(shards), key=lambda s: room[s]), turn, idle), "asks")
        demand = {(r.shard, r.goal): r.n for r in asks.groupBy("shard", "goal").agg(F.sum("n").alias("n")).collect()}
        if not demand and not closed:
            break
        flow = flows(demand, room)
        full = [s for s in range(shards) if any(n > flow.get(k, 0) for k, n in demand.items() if k[1] == s)]
        if not any(flow.values()):
            idle, closed = idle + 1, [] if closed else full
            continue
        first = _sums_before(asks, ["shard", "goal"], ["link"], "n", parts)
        some = F.least("n", _by_pair(flow, shards) - F.col("before"))
        grants = stash(first.withColumn("x", some).where("x > 0").select("link", "shard", "goal", "x"), "grants")
        taken = grants.select("link", "shard", (-F.col("x")).alias("n")).unionByName(grants.select("link", F.col("goal").alias("shard"), F.col("x").alias("n")))
        needs = labels.select("link", "shard", "n", "needs").unionByName(taken.withColumn("needs", F.lit(None).cast("int")))
        moved = needs.groupBy("link", "shard").agg(F.sum("n").alias("n"), F.max("needs").alias("needs")).where("n > 0")
        moved = moved.withColumn("needs", F.max("needs").over(Window.partitionBy("link")))
        labels = stash(moved.select("link", "shard", "n", "needs", (cells <= F.col("needs")).alias("whole")), "labels")
        for (a, b), x in flow.items():
            room[a] += x
            room[b] -= x
        level += (labels.agg(F.sum(F.col("n") * F.col("n"))).first()[0] or 0) - before
        idle, closed, best = (0, full, level) if level > best else (idle + 1, [] if closed else full, best)
    for d in done:
        labels = labels.unionByName(d)
    return stash(labels.select("link", "shard", "n"), "labels")


def balanced_shards(nodes: DataFrame, shards: int = 40, id_col: str = "id", link_col: str = "link") -> DataFrame:
    """One row per row of nodes: (id, link, shard), with shard counts at most one apart.

    Documents with the same non-null link are neighbours. Null links and links of one document only: no neighbours; such
    documents fill each shard up to its quota after the others have settled. Empty input: empty result. Ids should be
    unique; repeated ids are placed as separate rows. A group larger than a shard fills several.
    """
    own = nodes.select(F.col(id_col).alias("id"), F.col(link_col).alias("link"))
    total = own.count()
    quota = [total // shards + (s < total % shards) for s in range(shards)]  # as many numbers as shards
    # a group's members are ranked in hashed parts of it; what is joined by link is joined by link and part
    part = F.pmod(F.xxhash64("id"), F.lit(rank_parts(total))).alias("part")
    counts = own.where("link is not null").select("link", part).groupBy("link", "part").agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("link")
    upto = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = stash(counts.select("link", "part", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"), F.sum("n").over(whole).alias("size")).where("size > 1"), "parts")
    groups = counts.where("before = 0").select("link", "size")
    linked = groups.agg(F.sum("size")).first()[0] or 0

    room, labels = list(quota), None
    sizes = groups.withColumn("class", F.floor(F.log2("size") / 2))  # ever four times as large: a few classes
    for r in sorted(sizes.groupBy("class").agg(F.sum("size").alias("n")).collect(), key=lambda r: -r["class"]):
        settled = propagate(sizes.where(F.col("class") == r["class"]), room, r.n)
        for s, n in settled.groupBy("shard").agg(F.sum("n")).collect():
            room[s] -= n
        labels = settled if labels is None else labels.unionByName(settled)
    if linked:
        sorted_labels = F.array_sort(F.collect_list(F.struct("shard", "n")))  # as many as shards
        spots = labels.groupBy("link").agg(sorted_labels.alias("l")).select("link", F.transform("l", lambda x: x["shard"]).alias("shards"), F.transform("l", lambda x: x["n"]).alias("ns"))
        cuts = F.transform("ns", lambda n, i: F.aggregate(F.slice("ns", F.lit(1), i + 1), F.lit(0).cast("bigint"), lambda a, b: a + b))
        spots = counts.join(spots.select("link", "shards", cuts.alias("cuts")), "link").select("link", "part", "before", "shards", "cuts")
        placed = own.select("id", "link", part).join(spots, ["link", "part"], "left")
    else:
        placed = own.select("id", "link", F.lit(0).alias("part"), F.lit(0).alias("before"), F.lit(None).cast("array<int>").alias("shards"), F.lit(None).cast("array<bigint>").alias("cuts"))
    placed = stash(placed, "placed")
    rank = F.row_number().over(Window.partitionBy("link", "part").orderBy("id")) - 1 + F.col("before")
    moving = placed.where("cuts is not null").withColumn("rank", rank)
    moving = moving.select("id", "link", F.element_at("shards", F.size(F.filter("cuts", lambda c: c <= F.col("rank"))) + 1).alias("shard"))

    ends, at = [], 0
    for s in range(shards):
        at += room[s]
        ends.append(at)
    alone = ranked(placed.where("cuts is null").select("id", "link"), [], ["id"], "rank", total - linked)
    place = F.size(F.filter(F.array(*[F.lit(c).cast("long") for c in ends]), lambda c: c <= F.col("rank"))).cast("int")
    return moving.unionByName(alone.select("id", "link", place.alias("shard")))

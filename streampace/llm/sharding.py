"""Shards of even row counts that keep equal texts together, by balanced label propagation.

Documents with equal texts are linked. All members of a group have the same text, so the state is how
many of a group lie in each shard: at most as many rows a group as there are shards, whatever its size.
Groups of more than a sixteenth of a quota are placed first, the largest first: a group takes whole empty
shards while it is larger than a quota, and what is left goes where it fits most tightly, so it lies in as
few shards as there is room for. The other linked documents are dealt round robin over the room left. In
each round the members of a group propose to move to the shard that holds most of their neighbours. Moves
between two shards are matched in both directions and beyond that fill the target's free capacity, which
is its quota of rows less its linked rows, so no quota is ever exceeded. Unlinked documents then fill every
shard up to its quota. Row counts differ by one at most.

Null texts are linked with one another and have size 8 and no checksum. Null ids are allowed and repeated
rows are placed one by one. Texts of any length count by their bytes. Columns may have any names; ``shard`` and
``slot`` are replaced. An empty table gives an empty result. Only DataFrame operations are used.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from streampace.llm.common import aside, lookup, running_start, with_row
from streampace.plans.durable import durable

LAW = "rows"
ROUNDS = 8
PARTS = 16      # groups of more than this part of a quota are placed as wholes
_BEYOND = 1 << 62


def placed_whole(groups: DataFrame, shards: int, total: int) -> tuple[DataFrame | None, int, list[int]]:
    """Large groups as ``(group, n, shard, k)``, the size up to which groups are not large, and the room left.

    There are fewer than ``PARTS * shards`` large groups, which come to the driver; of tiny tables all do.
    """
    least = max(total // (shards * PARTS), 1)
    large = groups.filter(F.col("n") > least).select(F.hex("group").alias("name"), "n").collect()
    room = [total // shards + (s < total % shards) for s in range(shards)]
    parts = []
    for name, n in sorted(large, key=lambda g: (-g.n, g.name)):
        left = n
        while left:
            fits = [s for s in range(shards) if room[s] >= left]
            to = min(fits, key=lambda s: (room[s], s)) if fits else max(range(shards), key=lambda s: (room[s], -s))
            k = min(left, room[to])
            parts.append(F.struct(F.lit(name).alias("name"), F.lit(n).cast("long").alias("n"), F.lit(to).alias("shard"),
                                  F.lit(k).cast("long").alias("k")))
            room[to] -= k
            left -= k
    if not parts:
        return None, least, room
    whole = groups.sparkSession.range(1).select(F.inline(F.array(*parts)))
    return whole.select(F.unhex("name").alias("group"), "n", "shard", "k"), least, room


def dealt(groups: DataFrame, shards: int, room: Sequence[int] | None = None) -> DataFrame:
    """Round robin over all members of ``groups(group, n)``: ``(group, n, shard, k)``.

    With ``room`` a shard leaves the round when it is full.
    """
    turns, first, level = [], 0, 0
    for full in [_BEYOND // shards] if room is None else sorted(set(room) - {0}):
        active = [s for s in range(shards) if room is None or room[s] >= full]
        last = first + len(active) * (full - level)
        turns.append(F.struct(F.lit(first).cast("long").alias("first"), F.lit(last).cast("long").alias("last"),
                              F.array(*map(F.lit, active)).alias("active")))
        first, level = last, full
    if not turns:
        return groups.limit(0).select("group", "n", F.lit(0).alias("shard"), F.col("n").alias("k"))
    placed = running_start(groups, [], ["group"], {"start": "n"})
    turn = placed.withColumn("turn", F.explode(F.filter(F.array(*turns), lambda t: (
        t["first"] < F.col("start") + F.col("n")) & (t["last"] > F.col("start"))))).select(
        "group", "n", F.col("turn.first").alias("first"), F.col("turn.active").alias("active"),
        F.size("turn.active").alias("wide"), F.greatest("start", "turn.first").alias("lo"),
        F.least(F.col("start") + F.col("n"), F.col("turn.last")).alias("hi"))
    each = turn.withColumn("i", F.explode(F.sequence(
        F.lit(0), F.least(F.col("hi") - F.col("lo"), F.col("wide")).cast("int") - 1)))
    out = each.select(
        "group", "n", F.element_at("active", (F.pmod(F.col("lo") - F.col("first") + F.col("i"), F.col("wide")) + 1).cast("int")
                                   ).alias("shard"),
        (F.floor((F.col("hi") - F.col("lo") - 1 - F.col("i")) / F.col("wide")) + 1).alias("k"))
    # A group may be dealt in two turns.
    return out if len(turns) == 1 else out.groupBy("group", "n", "shard").agg(F.sum("k").alias("k"))


def quotas(state: DataFrame, shards: int, total: int) -> DataFrame:
    """``(shard, quota, load)``: the rows a shard will hold, and its linked rows so far."""
    every = state.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"))
    loads = state.groupBy("shard").agg(F.sum("k").alias("load"))
    quota = F.lit(total // shards) + (F.col("shard") < total % shards).cast("long")
    return every.join(F.broadcast(loads), "shard", "left").select(
        "shard", quota.alias("quota"), F.coalesce("load", F.lit(0)).alias("load"))


def round_of_moves(state: DataFrame, shards: int, total: int, turn: int = 0) -> tuple[DataFrame, int]:
    """The state after one round, stored, and the number of documents that moved.

    Of the moves between two shards those of small groups come first, as they can be whole; between
    equally good shards the choice changes with ``turn``.
    """
    most = Window.partitionBy("group").orderBy(F.desc("k"), F.xxhash64("group", "shard", F.lit(turn)), "shard")
    asks = durable(state.withColumn("to", F.first("shard").over(most)).filter("shard <> to"), "asks")
    flow = durable(asks.groupBy("shard", "to").agg(F.sum("k").alias("x")), "flow")
    # At most shards x shards rows, so the tables below are broadcast.
    back = flow.select(F.col("shard").alias("to"), F.col("to").alias("shard"), F.col("x").alias("y"))
    matched = flow.join(F.broadcast(back), ["shard", "to"], "left").withColumn(
        "swap", F.least("x", F.coalesce("y", F.lit(0)))).withColumn("more", F.col("x") - F.col("swap"))
    free = quotas(state, shards, total).select(F.col("shard").alias("to"), (F.col("quota") - F.col("load")).alias("free"))
    wanted = F.sum("more").over(Window.partitionBy("to"))
    share = F.when(wanted <= F.col("free"), F.col("more")).otherwise(
        F.floor(F.col("more") * F.col("free") / wanted))
    allowed = durable(matched.join(F.broadcast(free), "to").select(
        "shard", "to", (F.col("swap") + F.coalesce(share, F.lit(0))).alias("allowed")), "allowed")
    classed = asks.withColumn("class", F.floor(F.log2("n")))
    smaller = Window.partitionBy("shard", "to").orderBy("class").rowsBetween(Window.unboundedPreceding, -1)
    # At most 64 classes for each pair of shards.
    after_smaller = classed.groupBy("shard", "to", "class").agg(F.sum("k").alias("k")).select(
        "shard", "to", "class", F.coalesce(F.sum("k").over(smaller), F.lit(0)).alias("first"))
    queued = running_start(classed, ["shard", "to", "class"], ["group"], {"before": "k"}).join(
        F.broadcast(after_smaller), ["shard", "to", "class"])
    left = F.col("allowed") - F.col("first") - F.col("before")
    moves = durable(queued.join(F.broadcast(allowed), ["shard", "to"]).select(
        "group", "n", "shard", "to", F.greatest(F.lit(0), F.least(F.col("k"), left)).alias("k")
    ).filter("k > 0"), "moves")
    moved = moves.agg(F.coalesce(F.sum("k"), F.lit(0))).first()[0]
    if not moved:
        return state, 0
    after = state.unionByName(moves.select("group", "n", "shard", (-F.col("k")).alias("k"))).unionByName(
        moves.select("group", "n", F.col("to").alias("shard"), "k"))
    return durable(after.groupBy("group", "n", "shard").agg(F.sum("k").alias("k")).filter("k > 0"), "state"), moved


def propagated(groups: DataFrame, shards: int, total: int, rounds: int = ROUNDS) -> DataFrame:
    """How many members of each linked group lie in each shard: ``(group, n, shard, k)``, stored."""
    whole, least, room = placed_whole(groups, shards, total)
    state = dealt(groups.filter(F.col("n") <= least), shards, room)
    state = durable(state if whole is None else state.unionByName(whole), "state")
    for turn in range(rounds):
        state, moved = round_of_moves(state, shards, total, turn)
        if not moved:
            break
    return state


def cut_links(state: DataFrame) -> int:
    """Members that lie outside the main shard of their group, summed over all groups."""
    return state.groupBy("group").agg((F.first("n") - F.max("k")).alias("cut")).agg(
        F.coalesce(F.sum("cut"), F.lit(0))).first()[0]


def assign_shards(docs: DataFrame, shards: int = 24, doc_id: str = "doc_id", text: str = "text",
                  carry: Sequence[str] = (), rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` and the columns ``carry``."""
    content = F.col(text).cast("binary")
    rows = durable(docs.select(
        *carry, F.col(doc_id).alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(content).alias("text_crc32"), F.coalesce(F.unhex(F.sha2(content, 256)), F.lit(b"")).alias("group"),
    ).withColumn("row", F.monotonically_increasing_id()).withColumn("one", F.lit(1).cast("long")), "rows")
    total = rows.count()
    groups = durable(rows.groupBy("group").agg(F.count(F.lit(1)).alias("n")), "groups")
    known = durable(lookup(rows, groups.withColumn("members", F.col("n")), "group", "n"), "known")
    state = propagated(groups.filter("n > 1"), shards, total, rounds)

    inside = Window.partitionBy("group").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    spans = running_start(state, ["shard"], ["group"], {"slot_from": "k"}).select(
        "group", "n", F.struct(F.coalesce(F.sum("k").over(inside), F.lit(0)).alias("first"), "k", "shard",
                               "slot_from").alias("span"))
    spans = durable(spans.groupBy("group", "n").agg(F.collect_list("span").alias("spans")), "spans")
    linked = durable(running_start(known.filter("members > 1"), ["group"], ["doc_id"], {"rank": "one"}, ["row"]), "linked")
    mine = F.filter("spans", lambda s: (F.col("rank") >= s["first"]) & (F.col("rank") < s["first"] + s["k"]))[0]
    together = lookup(linked, spans, "group", "n").withColumn("span", mine).withColumns({
        "shard": F.col("span.shard"), "slot": F.col("span.slot_from") + F.col("rank") - F.col("span.first")})

    # One row per shard comes to the driver: where the unlinked rows of each shard begin.
    loads, starts, at = {}, [], 0
    for shard, quota, load in sorted(quotas(state, shards, total).collect()):
        loads[shard] = load
        starts.append(at)
        at += quota - load
    alone = durable(running_start(known.filter("members = 1"), [], ["doc_id"], {"rank": "one"}, ["group", "row"]), "alone")
    first = F.array(*[F.lit(s).cast("long") for s in starts])
    shard = F.size(F.filter(first, lambda s: s <= F.col("rank"))) - 1
    filled = alone.withColumn("shard", shard).withColumn("slot", F.col("rank") - F.element_at(
        first, F.col("shard") + 1) + F.element_at(F.array(*[F.lit(loads[s]).cast("long") for s in range(shards)]),
                                                  F.col("shard") + 1))
    columns = [*carry, "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot",
               F.lit(None).cast("int").alias("grown_shard")]
    return together.select(*columns).unionByName(filled.select(*columns))


def sharded(docs: DataFrame, shards: int = 24, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``shard`` and ``slot``; columns of these names are replaced."""
    plain = docs.drop("shard", "slot") if {"shard", "slot"} & set(docs.columns) else docs
    plain, back = aside(plain, ["_row"])
    stored = with_row(plain)
    marks = assign_shards(stored.select(doc_id, text, "_row"), shards, doc_id, text, ["_row"])
    return back(stored.join(marks.select("_row", "shard", "slot"), "_row").drop("_row"))

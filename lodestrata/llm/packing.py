"""Problem 9: filling fixed-capacity containers, mixture-controlled.

Items are dealt to lanes by a hash of their id, so a source that holds a third
of all rows is spread over every lane and a lane has a bounded load. In a lane
the sources are queues. A window of containers is filled by deficit
round-robin: each source earns its target share of the window's tokens and
gives items while its deficit lasts; what is earned and not spent goes on to
the next window. A lane starts with the deficits that the lanes before it
left, which a running sum over per-lane token counts gives without running
them; no more is made good than one window gives a source. Within a window the
chosen items are placed best-fit, largest first, and containers that stay open
are carried to the next window. What is left in open containers at the end of
all lanes is packed once more, together.

An item above the capacity is split: its full containers stand on their own
and its rest is an item like any other.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.staging import stage

#: Tokens a lane holds, containers a window has; both bound a task's memory and run time.
LANE_TOKENS, WINDOW = 8_000_000, 128
_OUT = "lane bigint, slot bigint, window bigint, item bigint, piece int, source string, n_tokens bigint, open boolean"


class Containers:
    """Open containers by free room; best fit by bisection."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.rooms, self.next = capacity, [], 0
        self.load: dict[int, list] = {}

    def put(self, row: tuple, size: int) -> int:
        at = bisect_left(self.rooms, (size, -1))
        if at < len(self.rooms):
            room, slot = self.rooms.pop(at)
        else:
            room, slot, self.next = self.capacity, self.next, self.next + 1
            self.load[slot] = []
        self.load[slot].append(row)
        if room > size:
            insort(self.rooms, (room - size, slot))
        return slot


def pack_lane(
    items: list[tuple[str, int, int, int]], capacity: int, shares: dict[str, float], deficits: dict[str, float], window: int
) -> list[tuple]:
    """(slot, window, item, piece, source, size, open) for items (source, size, item, piece) in order."""
    queues: dict[str, deque] = {}
    for row in items:
        queues.setdefault(row[0], deque()).append(row)
    names = sorted(queues)
    boxes, number = Containers(capacity), 0
    quantum = capacity * window
    # what other lanes left is made good within a window: a target that the corpus cannot give would add up over them
    owed = {s: max(-1.0, min(1.0, deficits.get(s, 0.0) / (quantum * shares[s]))) * quantum * shares[s] if shares.get(s) else 0.0 for s in names}
    while any(queues[s] for s in names):
        chosen, room = [], quantum
        alive = [s for s in names if queues[s]]
        weight = sum(shares.get(s, 0.0) for s in alive) or len(alive)
        even = sum(shares.get(s, 0.0) for s in alive) <= 0
        for s in alive:
            owed[s] += quantum * (1.0 if even else shares.get(s, 0.0)) / weight
        turn = deque(sorted(alive, key=lambda s: (-owed[s], s)))
        while turn and room > 0:
            s = turn.popleft()
            while queues[s] and room > 0 and owed[s] >= queues[s][0][1]:
                row = queues[s].popleft()
                owed[s] -= row[1]
                room -= row[1]
                chosen.append(row)
        if not chosen:  # every head is larger than its source's deficit: the most owed one goes
            s = max(alive, key=lambda s: (owed[s], s))
            row = queues[s].popleft()
            owed[s] -= row[1]
            chosen.append(row)
        for row in sorted(chosen, key=lambda r: (-r[1], r[2], r[3])):
            boxes.put((number, row), row[1])
        number += 1
    still_open = {slot for _, slot in boxes.rooms}
    return [
        (slot, w, row[2], row[3], row[0], row[1], slot in still_open) for slot, rows in boxes.load.items() for w, row in rows
    ]


def _lane_function(capacity: int, window: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rank", "item", "piece"], kind="stable")
        shares = dict(zip(pdf["source"], pdf["share"], strict=True))
        deficits = dict(zip(pdf["source"], pdf["deficit"], strict=True))
        rows = pack_lane(
            list(zip(pdf["source"], pdf["n_tokens"], pdf["item"], pdf["piece"], strict=True)), capacity, shares, deficits, window
        )
        out = pd.DataFrame(rows, columns=["slot", "window", "item", "piece", "source", "n_tokens", "open"])
        out.insert(0, "lane", key[0])
        return out

    return run


def pack(
    items: DataFrame,
    capacity: int,
    targets: dict[str, float] | None = None,
    lane_tokens: int = LANE_TOKENS,
    window: int = WINDOW,
) -> DataFrame:
    """Containers for ``items``: item BIGINT (unique), source STRING, n_tokens BIGINT.

    Returns container STRING, window STRING, item, piece, first_token,
    n_tokens, source. Each item with tokens stands in one container, whole,
    unless it is larger than ``capacity``; then its pieces of ``capacity``
    tokens fill containers and the rest is packed as an item. Items of null
    or no tokens are left out; a null source is a source of its own, shown as
    null. ``targets`` gives each source's share of the tokens of a window, as
    long as the source has items (sources without a share go last); without it
    the shares of the corpus hold, so that no source runs out before the
    others. An empty table gives no rows.
    """
    sized = items.select(
        F.col("item").cast("bigint").alias("item"),
        F.coalesce(F.col("source"), F.lit("\0")).alias("source"),
        F.col("n_tokens").cast("bigint").alias("n_tokens"),
    ).where("n_tokens > 0")
    sized = stage(sized, "sizes")
    full = sized.where(F.col("n_tokens") >= capacity).select(
        "item", "source", F.explode(F.sequence(F.lit(0), (F.col("n_tokens") / capacity).cast("int") - 1)).alias("piece")
    )
    whole = full.select(
        F.concat_ws("-", F.lit("f"), "item", "piece").alias("container"),
        F.lit("f").alias("window"),
        "item",
        "piece",
        F.lit(capacity).cast("bigint").alias("n_tokens"),
        "source",
    )
    rest = sized.select(
        "item",
        "source",
        F.floor(F.col("n_tokens") / capacity).cast("int").alias("piece"),
        (F.col("n_tokens") % capacity).alias("n_tokens"),
    ).where("n_tokens > 0")
    totals = rest.groupBy("source").agg(F.sum("n_tokens").cast("double").alias("n"))
    total = rest.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    lanes = max(1, -(-total // lane_tokens))
    if targets is None:
        shares = totals.select("source", (F.col("n") / F.lit(float(total or 1))).alias("share"))
    else:
        named = [("\0" if s is None else s, float(v)) for s, v in targets.items()]
        shares = items.sparkSession.createDataFrame(named, "source string, share double")
    dealt = rest.withColumn("rank", F.xxhash64("item", "piece")).withColumn("lane", F.pmod("rank", F.lit(lanes)))
    first = stage(_run(dealt, capacity, shares, window), "lanes")
    settled = first.where("not open")
    tail = first.where("open").select("item", "piece", "source", "n_tokens", F.xxhash64("item", "piece").alias("rank"))
    load = first.where("open").agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    again = tail.withColumn("lane", F.pmod("rank", F.lit(max(1, -(-load // lane_tokens)))))
    second = _run(again, capacity, shares, window)
    packed = settled.select(F.lit("a").alias("round"), *settled.columns).unionByName(
        second.select(F.lit("b").alias("round"), *second.columns)
    )
    mixed = packed.select(
        F.concat_ws("-", "round", "lane", "slot").alias("container"),
        F.concat_ws("-", "round", "lane", "window").alias("window"),
        "item",
        "piece",
        "n_tokens",
        "source",
    )
    return whole.unionByName(mixed).select(
        "container",
        "window",
        "item",
        "piece",
        (F.col("piece").cast("bigint") * capacity).alias("first_token"),
        "n_tokens",
        F.when(F.col("source") != "\0", F.col("source")).alias("source"),
    )


def _run(dealt: DataFrame, capacity: int, shares: DataFrame, window: int) -> DataFrame:
    """Pack each lane; the deficits that earlier lanes leave come from a running sum. ``shares``: source, share."""
    loads = dealt.groupBy("lane", "source").agg(F.sum("n_tokens").alias("tokens"))
    by_lane = loads.groupBy("lane").agg(F.sum("tokens").alias("all_tokens"))
    earlier = Window.partitionBy("source").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    share = F.coalesce("share", F.lit(0.0))
    deficits = (
        loads.join(by_lane, "lane")
        .join(shares, "source", "left")
        .select(
            "lane",
            "source",
            share.alias("share"),
            F.coalesce(F.sum(share * F.col("all_tokens") - F.col("tokens")).over(earlier), F.lit(0.0)).alias("deficit"),
        )
    )
    return (
        dealt.join(deficits, ["lane", "source"], "left")
        .select("lane", "source", "n_tokens", "item", "piece", "rank", F.coalesce("deficit", F.lit(0.0)).alias("deficit"), share.alias("share"))
        .groupBy("lane")
        .applyInPandas(_lane_function(capacity, window), _OUT)
    )


def first_fit_reference(sizes: Iterator[int], capacity: int) -> int:
    """Containers that best-fit-decreasing needs for all items at once (for tests)."""
    boxes = Containers(capacity)
    for size in sorted(sizes, reverse=True):
        boxes.put((size,), size)
    return boxes.next

"""Filling containers of fixed capacity: bounded-space online best fit, then a merge of what is left open.

Items are spread over buckets by a hash of their id (about ``ROWS_PER_BUCKET`` each, so the number of tasks follows the
data) and packed in order of id. A bucket keeps at most ``OPEN`` windows: an item goes to the fullest window that has
room; if none has, the fullest is emitted and a new one opened. The windows still open at the end of each bucket are
merged as wholes, ``FAN_IN`` buckets at a time, best fit in decreasing order, level by level, until one group is left. A
level emits what the smallest window left can't join and, but for the ``OPEN`` emptiest, the rest, so a group never holds
more than ``FAN_IN`` x ``OPEN`` windows, whatever the size of the corpus.
The result depends on the ids and sizes only, not on the cluster, so a task that is run again repeats its answer.

Defined cases: an item without id, and one without size (null or empty text), needs no container and is left out; an item above the
capacity, and no other, is split into full pieces and a rest; of repeated ids each row is an item; an empty table or
no profiles give no rows. Capacities must be positive.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from math import ceil

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

ROWS_PER_BUCKET = 25_000
OPEN = 128
FAN_IN = 32


class Packer:
    """One bucket's windows for one capacity."""

    def __init__(self, capacity: int, name: str):
        self.capacity, self.name = capacity, name
        self.open: list[tuple[int, int]] = []  # (room, window), ordered
        self.made = 0

    def place(self, size: int) -> int:
        """The window that takes an item of at most the capacity."""
        at = bisect_left(self.open, (size, -1))
        if at < len(self.open):
            room, window = self.open.pop(at)
        else:
            if len(self.open) >= OPEN:
                self.open.pop(0)  # the fullest is emitted
            room, window = self.capacity, self.made
            self.made += 1
        if room > size:
            insort(self.open, (room - size, window))
        return window


def _pack_buckets(profiles: list[tuple[str, int]]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bucket, packers = None, []
        for pdf in batches:
            rows = []
            for b, item, size in zip(pdf["bucket"].tolist(), pdf["id"].tolist(), pdf["n_tokens"].tolist()):
                if b != bucket:
                    rows += [(p.name, f"{bucket}-{w}", None, -1, p.capacity - room) for p in packers for room, w in p.open]
                    bucket, packers = b, [Packer(c, n) for n, c in profiles]
                for p in packers:
                    piece = 0
                    rest = size
                    while rest > p.capacity:
                        rows.append((p.name, f"{b}-{p.place(p.capacity)}", item, piece, p.capacity))
                        rest, piece = rest - p.capacity, piece + 1
                    rows.append((p.name, f"{b}-{p.place(rest)}", item, piece, rest))
            yield pd.DataFrame(rows, columns=["profile", "container", "id", "piece", "n_tokens"]).astype({"id": object})
        rows = [(p.name, f"{bucket}-{w}", None, -1, p.capacity - room) for p in packers for room, w in p.open]
        yield pd.DataFrame(rows, columns=["profile", "container", "id", "piece", "n_tokens"]).astype({"id": object})

    return run


def _merge_group(capacities: dict[str, int]):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        capacity = capacities[key[0]]
        pdf = pdf.sort_values(["used", "container"], ascending=[False, True])
        room: list[tuple[int, int]] = []
        heads: list[str] = []
        used: list[int] = []
        out = []
        for name, size in zip(pdf["container"], pdf["used"]):
            at = bisect_left(room, (size, -1))
            if at < len(room):
                left, head = room.pop(at)
            else:
                left, head = capacity, len(heads)
                heads.append(name)
                used.append(0)
            used[head] += size
            insort(room, (left - size, head))
            out.append((name, head))
        least = min(used)  # at most one window is not more than half full, so little can still be joined
        fitting = sorted((u, h) for h, u in enumerate(used) if u + (least if u > least else 0) <= capacity and u < capacity)[:OPEN]
        still = {h for _, h in fitting}
        return pd.DataFrame({"profile": key[0], "container": [n for n, _ in out], "head": [heads[h] for _, h in out], "used": [used[h] for _, h in out], "open": [h in still for _, h in out]})

    return run


def pack(items: DataFrame, profiles: list[tuple[str, int]], id_col: str = "id", size_col: str = "n_tokens") -> DataFrame:
    """``profile, container, id, piece, n_tokens``: every piece of every item in a container of each profile."""
    sized = cut(items.select(F.col(id_col).alias("id"), F.col(size_col).cast("long").alias("n_tokens")).where((F.col(size_col) > 0) & F.col(id_col).isNotNull()), "sizes")
    kind = sized.schema["id"].dataType.simpleString()
    buckets = max(1, ceil(sized.count() / ROWS_PER_BUCKET))
    spread = sized.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int"))
    spread = spread.repartitionById(buckets, "bucket").sortWithinPartitions("bucket", "id", "n_tokens")
    packed = cut(spread.mapInPandas(_pack_buckets(profiles), f"profile string, container string, id {kind}, piece int, n_tokens bigint"), "packed")
    placed = packed.where("piece >= 0")
    heads = packed.where("piece < 0").select("profile", "container", F.col("n_tokens").alias("used"), F.split("container", "-")[0].cast("int").alias("grp"))
    merged = heads.select("profile", "container", F.col("container").alias("head"))
    if buckets == 1:
        groups = [1]
    else:
        groups, left = [], buckets
        while left > 1:
            left = ceil(left / FAN_IN)
            groups.append(left)
    for left in groups:
        step = heads.withColumn("grp", (F.col("grp") / FAN_IN).cast("int")).groupBy("profile", "grp")
        moved = cut(step.applyInPandas(_merge_group(dict(profiles)), "profile string, container string, head string, used bigint, open boolean"), "merged")
        merged = merged.join(moved.select("profile", F.col("container").alias("head"), F.col("head").alias("new")), ["profile", "head"], "left").select("profile", "container", F.coalesce("new", "head").alias("head"))
        heads = moved.where("open").groupBy("profile", F.col("head").alias("container")).agg(F.max("used").alias("used")).withColumn("grp", (F.split("container", "-")[0].cast("int") / FAN_IN).cast("int"))
    return placed.join(merged, ["profile", "container"], "left").select("profile", F.coalesce("head", "container").alias("container"), "id", "piece", "n_tokens")


def utilisation(packed: DataFrame, profiles: DataFrame) -> DataFrame:
    """Of each profile: containers, tokens and the share of capacity that stays unused."""
    used = packed.groupBy("profile").agg(F.countDistinct("container").alias("containers"), F.sum("n_tokens").alias("tokens"), F.count_if(F.col("piece") > 0).alias("splits"))
    room = F.col("containers") * F.col("capacity_tokens")
    return used.join(profiles.select("profile", "capacity_tokens"), "profile").select("profile", "capacity_tokens", "containers", "tokens", "splits", F.round(1 - F.col("tokens") / room, 6).alias("unused_share"))

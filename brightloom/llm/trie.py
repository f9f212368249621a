"""Trie join: all pairs of tokens within a bounded edit distance, by Levenshtein automata over sharded tries.

The vocabulary (distinct tokens, not rows) is cut into shards by prefix: a prefix that more than ``SHARD`` tokens share is
split by its next letter, and neighbouring prefixes are put together up to that number. A probe walks the small trie of
these prefixes first and goes only to the shards that its automaton can still reach, so a shard meets only probes that
may have neighbours in it. A task holds one shard's trie and ``PROBES`` probes at a time.

Tokens are walked from both ends: of at most d edits, one end half of the probe has at most d // 2. So a walk allows
d // 2 edits in the first half and d in all, from the front and, over tries of reversed tokens, from the back; together
they find every pair, wherever it differs, and neither has to enter most of the upper levels.

Insertions, deletions, substitutions and swaps of neighbours cost 1. Automaton states are the distinct rows of the edit
table relative to the diagonal; transitions are computed once for each (state, characteristic vector) and shared by all
probes. Walks run level by level over arrays of (probe, node, state), so a step of all probes is a few array operations.
"""

from __future__ import annotations

import os

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARD = 4_000
PROBES = 2_000
DEPTH = 24
_BATCH = 1_024


class Automaton:
    """Lazily determinised parametric automaton for distance ``bound`` with swaps."""

    def __init__(self, bound: int):
        self.bound, self.width = bound, 2 * bound + 1
        over = bound + 1
        row = tuple(k - bound if k >= bound else over for k in range(self.width))
        # a state: this row and the one before as offsets -bound..bound from the diagonal, and the last vector
        self.rows = [(row, (over,) * self.width, 0)]
        self.ids = {self.rows[0]: 0}
        self.table = np.full((64, 1 << self.width), -2, np.int32)
        self.least = np.array([0])

    def step(self, state: int, vector: int) -> int:
        """Next state, or -1 if the bound can't be kept. Bit k of ``vector``: the read letter is the word's at offset k - bound of the new row (1-based column)."""
        row, before, last = self.rows[state]
        over, width = self.bound + 1, self.width
        new: list[int] = []
        for k in range(width):
            best = row[k] + (0 if vector >> k & 1 else 1)  # diagonal
            if k + 1 < width:
                best = min(best, row[k + 1] + 1)  # from above
            if k:
                best = min(best, new[k - 1] + 1)  # from the left
                # a swap: the letter read now is the word's one column earlier, the last letter read is the word's here
                if vector >> (k - 1) & 1 and k + 1 <= width and last >> (k + 1) & 1:
                    best = min(best, before[k] + 1)
            new.append(min(best, over))
        if min(new) > self.bound:
            return -1
        key = (tuple(new), row, vector)
        out = self.ids.setdefault(key, len(self.rows))
        if out == len(self.rows):
            self.rows.append(key)
        return out

    def move(self, states: np.ndarray, vectors: np.ndarray) -> np.ndarray:
        """``step`` for arrays; unknown transitions are computed once."""
        out = self.table[states, vectors]
        missing = np.flatnonzero(out == -2)
        if len(missing):
            for pair in np.unique(states[missing].astype(np.int64) << self.width | vectors[missing]).tolist():
                state, vector = pair >> self.width, pair & ((1 << self.width) - 1)
                to = self.step(state, vector)
                self.table[state, vector] = to
                if to >= len(self.table):
                    self.table = np.vstack([self.table, np.full_like(self.table, -2)])
            self.least = np.array([min(r[0]) for r in self.rows])
            out = self.table[states, vectors]
        return out

    def distances(self) -> np.ndarray:
        """Distance of each known state at each offset from the diagonal."""
        return np.array([r[0] for r in self.rows], np.int8)


class Trie:
    """Sorted distinct tokens with the nodes of each level; a level's nodes lie in the order of their tokens."""

    def __init__(self, tokens: list[str]):
        self.tokens = sorted(set(tokens))
        self.sizes = np.array([len(t) for t in self.tokens], np.int64)
        self.letters = np.frombuffer("".join(self.tokens).encode("utf-32-le"), np.uint32)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.common = np.array([0] + [len(os.path.commonprefix([a, b])) for a, b in zip(self.tokens, self.tokens[1:])], np.int64)
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.made = np.zeros(1, np.int64)  # first token of each node of the last level; level 0 is the root

    def level(self, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(letters, first child of each node above, end token or -1) of the nodes at ``depth``, counted from 1."""
        while len(self.levels) < depth:
            h = len(self.levels) + 1
            first = np.flatnonzero((self.sizes >= h) & ((self.common < h) | (np.arange(len(self.sizes)) == 0)))
            above = self.made
            children = np.searchsorted(first, np.append(above, len(self.sizes)))
            ends = np.where(self.sizes[first] == h, first, -1)
            self.levels.append((self.letters[self.starts[first] + h - 1], children, ends))
            self.made = first
        return self.levels[depth - 1]


def walk(trie: Trie, probes: list[str], automaton: Automaton, alive: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(probe, token, distance) for the trie's tokens within the bound that have at most half of the edits in the first half;
    with ``alive`` those that such a token may start with."""
    bound = automaton.bound
    found = [[], [], []]
    if not trie.tokens:
        return (np.zeros(0, np.int64),) * 3
    order = sorted(range(len(probes)), key=lambda i: len(probes[i]))
    for low in range(0, len(order), _BATCH):
        some = order[low : low + _BATCH]
        sizes = np.array([len(probes[i]) for i in some], np.int64)
        padded = np.zeros((len(some), int(sizes.max(initial=0)) + 2 * bound + 1), np.uint32)
        for row, i in enumerate(some):
            padded[row, bound : bound + len(probes[i])] = np.frombuffer(probes[i].encode("utf-32-le"), np.uint32)
        probe, node, state = np.arange(len(some)), np.zeros(len(some), np.int64), np.zeros(len(some), np.int32)
        depth = 0
        while len(probe):
            if depth == 0:
                ends = np.where((trie.sizes[:1] == 0), 0, -1)
            hit = np.flatnonzero(ends[node] >= 0)
            if len(hit):
                offset = sizes[probe[hit]] - depth
                near = np.abs(offset) <= bound
                d = np.where(near, automaton.distances()[state[hit], np.clip(offset + bound, 0, 2 * bound)], bound + 1)
                keep = np.ones(len(hit), bool) if alive else d <= bound
                for into, values in zip(found, (np.array(some)[probe[hit]][keep], ends[node[hit]][keep], d[keep])):
                    into.append(values)
            depth += 1
            live = depth <= sizes[probe] + bound
            probe, node, state = probe[live], node[live], state[live]
            letters, children, ends = trie.level(depth)
            first, count = children[node], children[node + 1] - children[node]
            total = int(count.sum())
            if not total:
                break
            at = np.repeat(np.arange(len(node)), count)
            child = np.arange(total) - np.repeat(np.cumsum(count) - count, count) + first[at]
            who, letter = probe[at], letters[child]
            vector = np.zeros(total, np.int64)
            for k in range(2 * bound + 1):
                vector |= (padded[who, np.minimum(depth - 1 + k, padded.shape[1] - 1)] == letter).astype(np.int64) << k
            to = automaton.move(state[at], vector)
            keep = (to >= 0) & ((depth >= sizes[who] // 2) | (automaton.least[to] <= bound // 2))
            probe, node, state = who[keep], child[keep], to[keep]
    return tuple(np.concatenate(f) if f else np.zeros(0, np.int64) for f in found)


def bound_of(size: int, bounds: list[tuple[int, int]]) -> int:
    """The distance allowed to a token of that length."""
    return max((d for n, d in bounds if size >= n), default=0)


def _reach(size: int, bounds: list[tuple[int, int]]) -> int:
    """The distance at which a token may have a neighbour; the longer one of a pair decides."""
    return max((d for n, d in bounds if size + d >= n), default=0)


def _grouped(tokens: list[str], bounds: list[tuple[int, int]]) -> dict[int, list[str]]:
    out: dict[int, list[str]] = {}
    for token in tokens:
        if reach := _reach(len(token), bounds):
            out.setdefault(reach, []).append(token)
    return out


def neighbours(index: list[str], probes: list[str], bounds: list[tuple[int, int]]) -> pd.DataFrame:
    """``a, b, distance``: the tokens of ``index`` near each probe, without itself, as far as walks from the front find them."""
    trie, parts = Trie(index), []
    for bound, some in _grouped(probes, bounds).items():
        p, t, d = walk(trie, some, Automaton(bound))
        parts += [(some[i], trie.tokens[j], int(k)) for i, j, k in zip(p.tolist(), t.tolist(), d.tolist()) if k and k <= bound_of(max(len(some[i]), len(trie.tokens[j])), bounds)]
    return pd.DataFrame(parts, columns=["a", "b", "distance"])


def _shards(words: DataFrame) -> dict[str, dict[str, int]]:
    """Of each kind: shard number by prefix. A token belongs to its longest listed prefix. Only prefixes whose parent has more than ``SHARD`` tokens come to the driver."""
    prefixes = F.transform(F.sequence(F.lit(1), F.least(F.length("token"), F.lit(DEPTH))), lambda n: F.substring(F.col("token"), F.lit(1), n))
    counts = words.select("kind", F.explode(prefixes).alias("prefix")).groupBy("kind", "prefix").agg(F.count(F.lit(1)).alias("n"))
    totals = {r[0]: r[1] for r in words.groupBy("kind").count().collect()}  # one row per kind
    large = [(k, "") for k, n in totals.items() if n > SHARD]
    leaves: dict[str, dict[str, int]] = {k: {"": 0} for k in totals}
    while large:
        inner = words.sparkSession.createDataFrame(large, "kind string, parent string")
        below = counts.withColumn("parent", F.expr("left(prefix, length(prefix) - 1)")).join(F.broadcast(inner), ["kind", "parent"]).select("kind", "prefix", "n").collect()
        for k, p, n in below:
            leaves[k][p] = n
        large = [(k, p) for k, p, n in below if n > SHARD and len(p) < DEPTH]
    out: dict[str, dict[str, int]] = {}
    for kind, sizes in leaves.items():
        shard, filled, out[kind] = 0, 0, {}
        inner = {p[:-1] for p in sizes if p}
        for prefix in sorted(sizes):
            n = 1 if prefix in inner else sizes[prefix]  # of a split prefix only the token that ends there is left
            if filled and filled + n > SHARD:
                shard, filled = shard + 1, 0
            out[kind][prefix] = shard
            filled += n
    return out


def trie_join(vocabulary: DataFrame, bounds: dict[str, list[tuple[int, int]]]) -> DataFrame:
    """``kind, a, b, distance`` for ordered pairs of different tokens of a kind.

    ``vocabulary`` has ``kind`` and distinct ``token`` and is read several times: give a written table. ``bounds`` lists
    for each kind (least length of the longer token, distance). Null and empty tokens have no neighbours.
    """
    both = F.explode(F.array(F.struct(F.concat(F.lit("f"), "kind").alias("kind"), "token"), F.struct(F.concat(F.lit("b"), "kind").alias("kind"), F.reverse("token").alias("token"))))
    words = vocabulary.where(F.length("token") > 0).select(both.alias("w")).select("w.*")  # from the front and from the back
    bounds = {end + kind: b for kind, b in bounds.items() for end in "fb"}
    shards = _shards(words)

    def place(batches):
        tries = {k: (Trie(list(s)), s, max(map(len, s))) for k, s in shards.items()}
        automata = {}
        for pdf in batches:
            out: list[tuple[str, int, int, str]] = []
            for kind, group in pdf.groupby("kind")["token"]:
                trie, shard, deep = tries[kind]
                tokens = group.tolist()
                for t in tokens:
                    own = next(shard[t[:n]] for n in range(min(deep, len(t)), -1, -1) if t[:n] in shard)
                    out.append((kind, own, 0, t))
                for bound, some in _grouped(tokens, bounds[kind]).items():
                    p, leaf, _ = walk(trie, some, automata.setdefault(bound, Automaton(bound)), alive=True)
                    out += [(kind, s, 1, some[i]) for i, s in {(i, shard[trie.tokens[j]]) for i, j in zip(p.tolist(), leaf.tolist())}]
            yield pd.DataFrame(out, columns=["kind", "shard", "probe", "token"])

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        kind = pdf["kind"].iloc[0]
        probe = pdf["probe"].to_numpy() == 1
        return neighbours(pdf["token"][~probe].tolist(), pdf["token"][probe].tolist(), bounds[kind]).assign(kind=kind)[["kind", "a", "b", "distance"]]

    placed = words.mapInPandas(place, "kind string, shard int, probe int, token string")
    parts = {(k, s): n for k, s, n in placed.where("probe = 1").groupBy("kind", "shard").count().collect()} if any(len(set(s.values())) > 1 for s in shards.values()) else {}
    total = parts or {(k, 0): n for k, n in ((r[0], r[1]) for r in words.groupBy("kind").count().collect())}
    cells = words.sparkSession.createDataFrame([(k, s, -(-n // PROBES)) for (k, s), n in total.items()] or [("", 0, 1)], "kind string, shard int, parts int")
    own = F.array(F.pmod(F.xxhash64("token"), F.col("parts")).cast("int"))
    spread = placed.join(F.broadcast(cells), ["kind", "shard"]).select("kind", "shard", "probe", "token", F.explode(F.when(F.col("probe") == 1, own).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))).alias("part"))
    # little data but much work: partitions that adaptive execution won't merge by their size
    wide = 4 * int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = spread.repartition(wide, "kind", "shard", "part").groupBy("kind", "shard", "part").applyInPandas(join, "kind string, a string, b string, distance int")
    turn = lambda c: F.when(F.col("kind").startswith("b"), F.reverse(c)).otherwise(F.col(c)).alias(c)
    return pairs.select(F.substring("kind", 2, 1 << 30).alias("kind"), turn("a"), turn("b"), "distance").distinct()

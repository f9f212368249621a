from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from brightloom.llm import mixing, packing, tokens


def test_token_counts(spark):
    texts = ["Hello world", "", None, "naïve ∑ text " * 3000, " \n"]
    df = spark.createDataFrame([(i, t, "s", "x") for i, t in enumerate(texts)] + [(None, "no id", "s", "x")], "doc_id bigint, text string, source string, id string")
    got = {r.id: r.n_tokens for r in tokens.token_counts(df, keep=("source",)).collect()}
    encode = tokens.encoder().encode_ordinary
    assert got == {i: len(encode(t)) if t else 0 for i, t in enumerate(texts)}


def packed(spark, sizes, profiles):
    df = spark.createDataFrame([(i, s, 0) for i, s in sizes], "id bigint, n_tokens bigint, bucket int")
    return packing.pack(df, profiles).collect()


@pytest.mark.parametrize("per_bucket", [7, 100_000])
def test_packing_keeps_every_token(spark, monkeypatch, per_bucket):
    monkeypatch.setattr(packing, "ROWS_PER_BUCKET", per_bucket)
    monkeypatch.setattr(packing, "OPEN", 5)
    monkeypatch.setattr(packing, "FAN_IN", 2)
    sizes = [(i, (i * 37) % 23) for i in range(120)] + [(500, 95), (501, 20), (501, 20)]
    rows = packed(spark, sizes, [("small", 20), ("large", 60)])
    for name, capacity in (("small", 20), ("large", 60)):
        mine = [r for r in rows if r.profile == name]
        used, items = defaultdict(int), defaultdict(list)
        for r in mine:
            used[r.container] += r.n_tokens
            items[r.id].append((r.piece, r.n_tokens))
        assert max(used.values()) <= capacity
        want = defaultdict(int)
        for i, s in sizes:
            want[i] += s
        assert {i: sum(n for _, n in v) for i, v in items.items()} == {i: s for i, s in want.items() if s}
        assert all(len(v) == 1 for i, v in items.items() if want[i] <= capacity and i != 501)
        assert len(used) <= 1.25 * sum(want.values()) / capacity + 2
    assert sorted(packed(spark, sizes[::-1], [("small", 20), ("large", 60)])) == sorted(rows)


def test_packing_nothing(spark):
    assert packed(spark, [], [("p", 5)]) == []
    assert packed(spark, [(1, 0), (2, None)], [("p", 5)]) == []
    assert packed(spark, [(1, 3)], []) == []


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 4), min_size=1, max_size=8), st.integers(0, 120))
def test_knapsack_and_fill(counts, goal):
    reach = {0}
    for n, c in counts.items():
        reach = {r + k * n for r in reach for k in range(c + 1)}
    best = max(r for r in reach if r <= goal)
    for got in (mixing.knapsack(counts, goal), mixing.fill(counts, goal)):
        assert all(0 < c <= counts[n] for n, c in got.items())
        assert sum(n * c for n, c in got.items()) == best


def test_leftovers_that_never_merge_stay_bounded(monkeypatch):
    import pandas as pd

    monkeypatch.setattr(packing, "OPEN", 8)
    pdf = pd.DataFrame({"profile": "p", "container": [f"{i:05}-0" for i in range(5000)], "used": [55 + i % 5 for i in range(5000)]})
    got = packing._merge_group({"p": 100})(("p", 0), pdf)
    assert len(got) == 5000 and set(got["container"]) == set(pdf["container"])
    assert got.loc[got["open"], "head"].nunique() <= 8


@pytest.mark.parametrize("hot", [10, 1_000_000])
def test_mixture_meets_targets_and_caps(spark, monkeypatch, hot):
    monkeypatch.setattr(mixing, "HOT", hot)
    rows = [(i, "a", 5 + i % 3) for i in range(200)] + [(1000 + i, "b", 7) for i in range(40)] + [(2000, "unlisted", 9), (2001, None, 9), (2002, "a", 0)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "id bigint, source string, n_tokens bigint, place int, part int")
    got, plans = mixing.mix(df, {"a": (0.6, 1), "b": (0.4, 3), "gone": (0.0, 2)})
    got = got.collect()
    used = {s: sum(r.n_tokens * r.uses for r in got if r.source == s) for s in "ab"}
    assert used == {s: plans[s].tokens for s in "ab"}
    assert abs(used["a"] / sum(used.values()) - 0.6) < 0.01
    assert max(r.uses for r in got if r.source == "a") == 1 and max(r.uses for r in got if r.source == "b") <= 3
    again, _ = mixing.mix(df.repartition(5), {"a": (0.6, 1), "b": (0.4, 3), "gone": (0.0, 2)})
    assert sorted(again.collect()) == sorted(got)


def test_targets_that_cant_be_met(spark):
    df = spark.createDataFrame([(1, "a", 10), (2, "b", 10)], "id bigint, source string, n_tokens bigint")
    got, plans = mixing.mix(df, {"a": (0.5, 1), "b": (0.5, 4)}, total=60)
    assert {r.source: r.uses for r in got.collect()} == {"a": 1, "b": 3}
    assert plans["a"].tokens < plans["a"].budget and plans["b"].tokens == plans["b"].budget
    empty, _ = mixing.mix(df.where("id > 9"), {"a": (0.5, 1)})
    assert empty.count() == 0

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from brightloom.llm.names import osa
from brightloom.llm.trie import Automaton, Trie, neighbours, trie_join, walk


def brute(a, b):
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


WORD = st.text("abcd", min_size=1, max_size=9)


@settings(max_examples=60, deadline=None)
@given(st.lists(WORD, min_size=1, max_size=40, unique=True), WORD, st.integers(1, 3))
def test_automaton_finds_what_brute_force_finds(words, probe, bound):
    both = {}
    for turn in (1, -1):
        trie = Trie([w[::turn] for w in words])
        _, token, distance = walk(trie, [probe[::turn]], Automaton(bound))
        both |= {trie.tokens[t][::turn]: d for t, d in zip(token.tolist(), distance.tolist())}
    assert both == {w: brute(w, probe) for w in words if brute(w, probe) <= bound}


@settings(max_examples=200, deadline=None)
@given(WORD, WORD, st.integers(1, 3))
def test_bounded_distance(a, b, bound):
    assert osa(a, b, bound) == min(brute(a, b), bound + 1)


@pytest.mark.parametrize(("shard", "probes"), [(10_000, 10_000), (20, 40)])
def test_join_over_shards(spark, monkeypatch, shard, probes):
    random.seed(5)
    words = sorted({"".join(random.choice("abc") for _ in range(random.randint(1, 8))) for _ in range(150)})
    df = spark.createDataFrame([("w", x) for x in words] + [("v", x) for x in words[:30]], "kind string, token string")
    monkeypatch.setattr("brightloom.llm.trie.SHARD", shard)
    monkeypatch.setattr("brightloom.llm.trie.PROBES", probes)
    found = [(r.kind, r.a, r.b, r.distance) for r in trie_join(df, {"w": [(3, 1), (6, 2)], "v": [(4, 1)]}).collect()]
    bound = {"w": lambda n: 2 if n >= 6 else 1 if n >= 3 else 0, "v": lambda n: 1 if n >= 4 else 0}
    wanted = {(k, a, b, brute(a, b)) for k, some in (("w", words), ("v", words[:30])) for a in some for b in some if a != b and brute(a, b) <= bound[k](max(len(a), len(b)))}
    assert len(found) == len(set(found)) and set(found) == wanted


def test_both_ends_changed_and_other_scripts():
    both = {(a, b) for turn in (1, -1) for a, b, _ in neighbours([w[::turn] for w in ("kowalskix", "иванов")], [w[::turn] for w in ("mowalskiy", "ивонов", "x" * 5000)], [(6, 2)]).itertuples(index=False)}
    assert {(a, b) for a, b in both} | {(a[::-1], b[::-1]) for a, b in both} >= {("mowalskiy", "kowalskix"), ("ивонов", "иванов")}


def test_no_words(spark):
    df = spark.createDataFrame([("w", None), ("w", "")], "kind string, token string")
    assert trie_join(df, {"w": [(1, 1)]}).count() == 0

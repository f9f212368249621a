from itertools import product

from brightloom.llm import variety

SCHEMA = "record_id bigint, name string, url string, category string, topic_tags array<string>, id int, h int, place int, size int"


def cost(flow, size, categories, tags):
    total = 0.0
    for names, target in ((categories, size / len(categories)), (tags, size / len(tags))):
        for n in names:
            used = sum(v for k, v in flow.items() if n in k)
            total += sum((u + 0.5) / target for u in range(used))
    return total


def test_quotas_are_optimal():
    counts = {("a", "x"): 3, ("a", "y"): 1, ("b", "x"): 2, ("b", "z"): 1, ("c", "x"): 1}
    for size in range(1, 8):
        found = variety.quotas(counts, size)
        assert sum(found.values()) == size and all(v <= counts[k] for k, v in found.items())
        best = min(cost(dict(zip(counts, f)), size, "abc", "xyz") for f in product(*[range(v + 1) for v in counts.values()]) if sum(f) == size)
        assert abs(cost(found, size, "abc", "xyz") - best) < 1e-9


def test_pruned_tags_leave_the_optimum(spark):
    counts = {(c, f"t{i}"): 1 + i % 2 for c in "abc" for i in range(ord(c) - 96, 40, ord(c) - 96)}
    size = 6
    kept = {k: n for c in "abc" for k, n in sorted((k, n) for k, n in counts.items() if k[0] == c)[:size]}
    tags = {t for _, t in counts}
    whole, part = variety.quotas(counts, size), variety.quotas(kept, size, len(tags))
    assert abs(cost(whole, size, "abc", tags) - cost(part, size, "abc", tags)) < 1e-9


def test_many_combinations_are_quick():
    from time import time

    counts = {(f"c{c}", f"t{t}"): 1 + (c * t) % 5 for c in range(100) for t in range(2000) if (c + t) % 3 == 0}
    began = time()
    assert sum(variety.quotas(counts, 1500).values()) == 1500
    assert time() - began < 60


def records(spark, rows):
    return spark.createDataFrame([(i, n, f"http://x.example/{n}", c, t, 1, 2, 3, 4) for i, (n, c, t) in enumerate(rows, 1)], SCHEMA)


def test_subset_covers_the_variety(spark):
    rows = [(f"big {i}", "Big", ["common"]) for i in range(300)] + [(f"small {i}", f"Small {i % 5}", ["common", f"t{i % 7}"]) for i in range(35)] + [("none", None, None), ("empty", " ", [])]
    got = variety.varied_subsets(records(spark, rows), [20, 400]).collect()
    small = [r for r in got if r["size"] == 20]
    assert len(small) == 20 and len({r.record_id for r in small}) == 20
    assert {r.category for r in small} == {"big", "(none)", *[f"small {i}" for i in range(5)]}
    assert len([r for r in got if r["size"] == 400]) == len(rows)
    assert [r.category for r in small].count("big") <= 6


def test_copies_count_once_and_ties_are_stable(spark):
    rows = [("same name", "A", ["x"])] * 30 + [("other", "A", ["x"])]
    first = {(r.record_id, r.place) for r in variety.varied_subsets(records(spark, rows), [10]).collect()}
    again = {(r.record_id, r.place) for r in variety.varied_subsets(records(spark, rows).repartition(7), [10]).collect()}
    assert {i for i, _ in first} == {1, 31} and first == again


def test_empty(spark):
    assert variety.varied_subsets(records(spark, []), [5]).count() == 0

from brightloom.llm import copies

SCHEMA = "record_id bigint, name string, url string, h string, key string, rows int, keep_id int"
SAME = [
    ("Weekly Straße Survey - Dravoria", "https://www.Data.example/a-b?x=1&y=2"),
    ("dravoria  weekly\tSTRASSE survey", "http://data.example/A-B/?y=2&x=1"),
    ("Dravoria: (Weekly) Straße_Survey​", "HTTPS://data.example/a-b?x=1&y=2"),
]
ACCENTS = [("Sölvula Panel", None), ("Sölvula panel", None)]


def run(spark, rows):
    df = spark.createDataFrame([(i, n, u, "h", "k", 1, 2) for i, (n, u) in enumerate(rows, 1)], SCHEMA)
    return {(r.keep_id, r.copy_id) for r in copies.copies(df).collect()}, {(r.record_id, r.copies) for r in copies.unique_records(df).collect()}


def test_formatting_doesnt_matter(spark):
    pairs, records = run(spark, SAME + ACCENTS)
    assert pairs == {(1, 2), (1, 3), (4, 5)}
    assert records == {(1, 3), (4, 2)}


def test_what_does_matter(spark):
    rows = [("Panel 2001", "http://a.example/x"), ("Panel 2002", "http://a.example/x"), ("Panel 2001", "http://a.example/x/mirror"), ("Solvula", None), ("Sölvula", None), ("Panel 2001", None), (None, "http://a.example/x"), (None, None), ("Dup", None), ("Pud", None)]
    pairs, records = run(spark, rows)
    assert pairs == set() and len(records) == len(rows)


def test_nulls_agree_with_nulls_blank_is_not_null(spark):
    pairs, _ = run(spark, [(None, None), (None, None), ("", None), ("...", None), (None, "")])
    assert pairs == {(1, 2), (3, 4)}


def test_empty_and_long_and_hot(spark):
    assert run(spark, []) == (set(), set())
    long = "word " * 20000
    pairs, records = run(spark, [(long, "u"), (long.upper(), "u")] + [("same", "u")] * 50)
    assert pairs == {(1, 2)} | {(3, i) for i in range(4, 53)}
    assert records == {(1, 2), (3, 50)}

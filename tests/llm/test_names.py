import random

from brightloom.llm import names

SHEET = "sheet_id string, name string, current_company string, phd_institution string, phd_year int, phd_field string, current_title string, location string, is_professor boolean, org string, key string"


def people(spark, rows):
    full = [(i, n, c, inst, y, f, t, loc, p, "x", "y") for i, n, c, inst, y, f, t, loc, p in rows]
    return spark.createDataFrame(full, SHEET)


def pairs(spark, sheet):
    spelled = names.companies(sheet.selectExpr("current_company AS spelling"))
    return {(r.key_a, r.key_b) for r in names.person_pairs(names.persons(sheet, spelled)).collect()}


BASE = [("s90", "Rosa Tavelund", "Orwyck Labs", "Norenne", 1999, "Finance", "Professor", "Quilula", True), ("s91", "Rosa Belamint", "Orwyck Labs", "Norenne", 1980, "Finance", "Professor", "Quilula", True)] + [
    (f"s8{i}", f"{g} Otherwise{i}", None, "Elsewhere", 1950 + i, None, None, None, False) for i, g in enumerate(("Rosa", "Ingrid", "William", "William", "William", "Ingrid", "Ingrid", "Rosa"))
]


VARIANTS = ["Rosa Tavelund", "ROSA TAVELUND", "Tavelund, Rosa", "tavelund, r.", "R. Tavelund", "Rosa Tavleund", "Rosa M. Tavelund (she/her)", "Prof. Dr. Rosa Tavelund, PhD", "Tavelund Rosa", "Tavelund Roas"]


def test_variants_of_a_person(spark):
    rows = [(f"s99{i}", v, "Orwyck Labs GmbH", "Norenne University", 1999, "Finance", None, "Quilula", True) for i, v in enumerate(VARIANTS)]
    ids = ["s90", *[r[0] for r in rows]]
    assert pairs(spark, people(spark, [*BASE, *rows])) == {(a, b) for a in ids for b in ids if a < b}


def test_namesakes_are_kept_apart(spark):
    sheet = people(spark, [*BASE, ("s99", "Rosa Tavelund", "Orwyck Labs", "Norenne", 1975, "Finance", None, "Quilula", True)])
    assert pairs(spark, sheet) == set()


def test_nickname_and_repeated_rows(spark):
    row = ("Bill Umberfoss", None, "Norenne", 1990, "Finance", None, None, False)
    sheet = people(spark, [*BASE, ("s1", *row), ("s2", *row), ("s3", "William Umberfoss", *row[1:])])
    assert pairs(spark, sheet) == {("s1", "s2"), ("s1", "s3"), ("s2", "s3")}


def test_nulls_blank_titles_and_empty(spark):
    rows = [("s1", None, None, None, None, None, None, None, None), ("s2", "  ", None, None, None, None, None, None, None), ("s3", "Prof. Dr.", None, None, None, None, None, None, None), ("s4", "Solo", None, None, None, None, None, None, None)]
    assert pairs(spark, people(spark, rows)) == set()
    assert pairs(spark, people(spark, [])) == set()


def test_long_names(spark):
    long = "Rosa " + "verylong" * 500
    sheet = people(spark, [*BASE, ("s1", long, None, "Norenne", 1999, None, None, None, True), ("s2", long, None, "Norenne", 1999, None, None, None, True)])
    assert pairs(spark, sheet) == {("s1", "s2")}


def test_large_blocks_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(names, "BLOCK", 4)
    rows = [(f"a{i}", "Rosa Tavelund", None, "Norenne", 1999, None, None, f"Place{i // 6}" if i % 2 else None, True) for i in range(12)]
    one = pairs(spark, people(spark, [*BASE[1:], *rows]))
    together = {(f"a{i}", f"a{j}") for i in range(12) for j in range(12) if f"a{i}" < f"a{j}" and (rows[i][7] is None or rows[j][7] is None or rows[i][7] == rows[j][7])}
    assert one == together


def test_large_blocks_lose_no_near_attribute(spark, monkeypatch):
    monkeypatch.setattr(names, "BLOCK", 4)
    fillers = [(f"b{i:02}", f"{g} Tavelund", None, None, None, None, None, None, None) for i, g in enumerate(("Rita", "Ruth", "Ralf", "Rene", "Remo", "Rafael"))]
    near = [("c1", "Rosa Tavelund", None, "Norenneborough", None, None, None, None, None), ("c2", "Rosa Tavelund", None, "Norenebrough", None, None, None, None, None)]
    assert ("c1", "c2") in pairs(spark, people(spark, [*fillers, *near]))


def test_large_blocks_of_rows_with_one_attribute(spark, monkeypatch):
    monkeypatch.setattr(names, "BLOCK", 8)
    rows = [(f"x{i:03}", f"Rosa Tavelund{'abcdefghij'[i % 10]}{'abcdefghijklmnopqrstuvwxyz'[i // 10]}", None, f"Inst{i}", None, None, None, None, None) for i in range(40)]
    near = [("c1", "Rosa Tavelund", None, "Norenneborough", None, None, None, None, None), ("c2", "Rosa Tavelund", None, "Norenneborough", None, None, None, None, True)]
    assert ("c1", "c2") in pairs(spark, people(spark, [*rows, *near]))


def test_any_order_of_tokens(spark):
    same = ("Orwyck Labs", "Norenne", 1999, "Finance", None, "Quilula", True)
    others = [(f"o{i}", n, None, "Elsewhere", 1940 + i, None, None, None, False) for i, n in enumerate(("John Ambrose", "John Belamint", "Paul Ottevil", "Paul Rendag", "Gabriel Umber", "Gabriel Ambrose", "Bosten, John", "Cavell, Paul"))]
    rows = [("s1", "John Paul Smith", *same), ("s2", "Smith John Paul", *same), ("s3", "Smith, John Paul", *same), ("s4", "Gabriel García Márquez", *same), ("s5", "García Márquez Gabriel", *same), ("s6", "Garcia-Marquez, Gabriel", *same), ("s7", "Marquez-Garcia Gabriel", *same)]
    found = pairs(spark, people(spark, [*others, *rows]))
    assert found == {("s1", "s2"), ("s1", "s3"), ("s2", "s3")} | {(f"s{i}", f"s{j}") for i in range(4, 8) for j in range(i + 1, 8)}


GIVEN = "Katherine Robert Margaret William Elizabeth Alexander Michael Ekaterina Søren Ingrid Thomas Priya Kenji Antonia Giuseppe".split()
NICK = {v: k for k, vs in names.NICKNAMES.items() for v in vs.split()}


def typo(rng, word):
    at = rng.randrange(1, len(word))
    return rng.choice((word[:at] + word[at + 1 :], word[:at] + rng.choice("aeiourst") + word[at:], word[: at - 1] + word[at] + word[at - 1] + word[at + 1 :]))


def typed(rng, given, middle, last):
    if rng.random() < 0.3:
        given = given[0] + "." if rng.random() < 0.4 else NICK.get(given.lower(), given).title()
    if len(given) > 3 and rng.random() < 0.15:
        given = typo(rng, given)
    if rng.random() < 0.15:
        last = typo(rng, last)
    mid = rng.choice(("", middle, middle[0] + "."))
    natural = " ".join(filter(None, (given, mid, last)))
    turned = " ".join(filter(None, (last, given, mid)))
    return rng.choice((natural, natural, natural, turned, turned.replace(" ", ", ", 1), natural.upper(), f"Prof. {natural}"))


def test_recall_and_precision_on_typed_names(spark):
    rng = random.Random(8)
    syllables = [a + b for a in "bdfgklmnprstvz" for b in "aeiou"]
    rows, truth = [], set()
    for p in range(350):
        given, middle, last = rng.choice(GIVEN), rng.choice(GIVEN), "".join(rng.choices(syllables, k=3)).title() + rng.choice(("sen", "vik", "oth", "ard"))
        facts = (f"Norenne{rng.randrange(40)}", rng.randrange(1970, 2024), rng.choice(("Finance", "Statistics")), rng.choice(("Professor", "Analyst")), f"Place{rng.randrange(60)}", rng.random() < 0.2)
        ids = [f"{p:04}-{k}" for k in range(rng.choice((1, 2, 3, 5)))]
        for i in ids:
            inst, year, field, title, place, professor = (f if rng.random() < 0.8 else None for f in facts)
            rows.append((i, typed(rng, given, middle, last), None, inst, year, field, title, place, professor))
        truth |= {(a, b) for a in ids for b in ids if a < b}
    found = pairs(spark, people(spark, rows))
    assert len(found & truth) >= 0.97 * len(truth)
    assert len(found & truth) >= 0.99 * len(found)


COMPANIES = {
    "orwyck": ["Orwyck Labs", "ORWYCK LABS", "orwyck-labs", "OrwyckLabs", "Orwyck Laboratories", "Labs Orwyck", "The Orwyck Labs Company", "Orwyck Labs GmbH", "Orwyck Labs G.m.b.H.", "Orwyck Labs (Norenne office)", "Orwick Labs", "Orwyck", "Orwyck Ltd."],
    "bank": ["Central Bank of Norenne", "Norenne, Central Bank of", "Central Bank Norenne", "C. Bank of Norenne", "Central Bank of Norenne, Dept. of Economics", "Central Bnk of Norenne"],
    "other bank": ["Central Bank of Quilula", "Quilula Central Bank"],
    "two": ["Norenne and Quilula Consulting", "Quilula & Norenne Consulting", "Norenne/Quilula Consulting Grp"],
    "school": ["Tammula School of Economics", "Tammula School of Econ.", "TSoE"],
}


def test_organisations(spark):
    flat = [(s,) for v in COMPANIES.values() for s in v] + [(None,), (" ",), ("Orwyck Labs",)]
    spelled = names.companies(spark.createDataFrame(flat, "spelling string"))
    found = {(r.key_a, r.key_b) for r in names.company_pairs(spelled).collect()}
    assert found == {(a, b) for v in COMPANIES.values() for a in v for b in v if a < b}


def test_other_scripts_and_abbreviations(spark):
    flat = ["Банк Россиянка", "БАНК РОССИЯНКА", "Банк  Россиянка", "東京大学", "東京大学 ", "Orwyck Logistics", "Orwyck Logist.", "Norenne Marketplace Services", "Norenne Mktplace Services", "Orwyck Media", "Velmosk Analytics", "Velmosk Analytics Inc.", "VELMOSK ANALYTICS", "Velmosk  Analytics", "Zelmosk Analytics"]
    spelled = names.companies(spark.createDataFrame([(s,) for s in flat], "spelling string"))
    found = {(r.key_a, r.key_b) for r in names.company_pairs(spelled).collect()}
    groups = [flat[:3], flat[3:5], flat[5:7], flat[7:9], flat[10:]]
    assert found == {(a, b) for g in groups for a in g for b in g if a < b}


def test_shared_brand_needs_a_vote(spark):
    flat = ["Orwyck Labs", "Orwyck Media", "Orwyck"]
    spelled = names.companies(spark.createDataFrame([(s,) for s in flat], "spelling string"))
    assert names.company_pairs(spelled).count() == 0
    members = spark.createDataFrame([("p1", "1", "orwyck"), ("p1", "2", "media orwyck")], "person string, id string, org string")
    assert {(r.key_a, r.key_b) for r in names.company_pairs(names.vote(spelled, members)).collect()} == {("Orwyck", "Orwyck Media")}

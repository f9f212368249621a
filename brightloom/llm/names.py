"""Variant spellings of names typed by people: organisations and persons.

Tokens of all distinct names go through the trie join (``trie``); a rare token within the distance bound of a more common
one is read as it. What is left of a name is compared under every order of its tokens.

*Organisations*: without legal forms, departments, offices, articles and short joining words, with common abbreviations
written out. Of spellings that agree but for one token, an abbreviation is read as the word that it abbreviates. Spellings
with equal token sets are one organisation. A set of one token (a brand) and an acronym stand for the organisation that
alone has that token, or those initials; where several have, they stay by themselves.

*Persons*: how often a token and its neighbours stand as given name or as surname tells which orders of a name's tokens
are likely; every likely order is a reading of the name. Candidates share a surname, a part of one, or a neighbour, and
the initial of a given name, in any of their readings. Two rows are the same person if the given names agree (equal, a
nickname, a typo or an initial), no attribute conflicts, and enough attributes agree for how alike the names are. Rows
then form connected components; the pairs of a component that don't conflict are the result. Equal rows are compared
once. All pairs of a block are compared unless their attributes conflict; a block of more than ``BLOCK`` rows is cut
into parts whose pairs are joined in different tasks, and so are large components and organisations.

Defined cases: null and blank names have no links; a null attribute neither agrees nor conflicts; a name that consists of
titles only is blank, and a name of one word has no links; repeated rows are linked like others; empty tables give no
rows; further columns are ignored. Letters of any script count.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .components import components
from .trie import trie_join

BLOCK = 200

#: Legal forms and words that join or adorn a name of an organisation.
LEGAL = frozenset("inc incorporated llc ltd limited gmbh sa corp corporation co company ag plc bv nv oy ab spa srl kg grp group holding holdings the of and for de des du la le von fuer".split())  # noqa: SIM905
#: Common abbreviations in names of organisations. Economic and economics share a stem.
SHORT = {
    "cap": "capital", "centre": "center", "ctr": "center", "cntr": "center", "dept": "department", "econ": "economics", "economic": "economics", "inst": "institute", "intl": "international", "laboratories": "labs",
    "laboratory": "labs", "lab": "labs", "min": "ministry", "mkt": "market", "natl": "national", "pol": "policy", "res": "research", "sch": "school", "svc": "services", "svcs": "services", "service": "services",
    "sys": "systems", "technical": "tech", "technology": "tech", "univ": "university", "mgmt": "management",
}
#: Nicknames and the given names they stand for.
NICKNAMES = {
    "abby": "abigail", "al": "albert alan", "alex": "alexander aleksandra alexandra", "andy": "andrew", "barb": "barbara", "becky": "rebecca", "ben": "benjamin", "beppe": "giuseppe", "bert": "albert robert", "beth": "elizabeth",
    "betty": "elizabeth", "bill": "william", "billy": "william", "bob": "robert", "bobby": "robert", "cathy": "catherine katherine", "charlie": "charles", "chris": "christopher christine christina", "chuck": "charles", "cindy": "cynthia",
    "dan": "daniel", "danny": "daniel", "dave": "david", "deb": "deborah", "debbie": "deborah", "dick": "richard", "dima": "dmitri", "don": "donald", "ed": "edward edmund", "eddie": "edward", "fran": "francisco frances francis",
    "fred": "frederick", "gabi": "gabriela", "gabe": "gabriel", "greg": "gregory", "hank": "henry", "hans": "johannes", "harry": "henry harold", "jack": "john", "jake": "jacob", "jan": "johannes", "jen": "jennifer", "jenny": "jennifer",
    "jim": "james", "jimmy": "james", "joe": "joseph", "jon": "jonathan", "kasia": "katarzyna", "kate": "katherine katarzyna ekaterina", "kathy": "katherine", "katie": "katherine", "katya": "ekaterina", "ken": "kenneth", "kit": "christopher katherine",
    "larry": "lawrence", "liz": "elizabeth", "lisa": "elizabeth", "maggie": "margaret", "marge": "margaret", "matt": "matthew matthias", "matze": "matthias", "meg": "margaret", "memo": "guillermo", "mike": "michael mikhail", "misha": "mikhail", "mick": "michael",
    "nate": "nathaniel nathan", "ned": "edward edmund", "nick": "nicholas", "ola": "aleksandra", "paco": "francisco", "pancho": "francisco", "pat": "patricia patrick", "peggy": "margaret", "pepe": "jose giuseppe", "pete": "peter", "rick": "richard", "rich": "richard",
    "rob": "robert", "ron": "ronald", "sam": "samuel samantha", "sasha": "alexander aleksandra", "steve": "steven stephen", "sue": "susanna susan", "susie": "susanna susan", "ted": "theodore edward", "theo": "theodore", "tim": "timothy", "tom": "thomas tomas",
    "tommy": "thomas", "tori": "victoria", "toni": "antonia", "tony": "anthony antonio", "trish": "patricia", "vicky": "victoria", "vika": "victoria", "will": "william", "willy": "william", "zack": "zachary",
}
_FORMS = {k: frozenset(v.split()) for k, v in NICKNAMES.items()}
_LATIN = str.maketrans({"ø": "o", "ł": "l", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe", "ı": "i"})
_TITLE = regex.compile(r"\b(?:prof(?:essor)?|dr|ph\.?\s?d|m\.?\s?sc|b\.?\s?sc|d\.?\s?sc|m\.?\s?d|mba|mr|mrs|ms|sir|jr|sr)\b\.?")
_WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")
_DOTTED = regex.compile(r"\b(?:\p{L}\.\s?){2,}")


def plain(text: str) -> str:
    """Lower case without accents."""
    return "".join(c for c in unicodedata.normalize("NFD", text.lower().translate(_LATIN)) if not unicodedata.combining(c)).translate(_LATIN)


def osa(a: str, b: str, bound: int) -> int:
    """Edit distance with swaps, or ``bound`` + 1 if it is larger."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > bound:
        return bound + 1
    two, one = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(one[j] + 1, row[j - 1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, two[j - 2] + 1)
            row.append(best)
        if min(row) > bound:
            return bound + 1
        two, one = one, row
    return min(one[-1], bound + 1)


def paired(rows: DataFrame, key: list[str], ident: str, size: int | None = None) -> DataFrame:
    """Rows of groups with several members, placed for a join of all pairs of a group: a group is cut into parts of about
    ``size`` rows, and each pair of parts (``low, high``) is a cell of its own, so that a hot group is spread over the
    tasks. Join two copies on the key, ``low`` and ``high`` and keep ``APART``."""
    sizes = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("members")).where("members > 1").withColumn("parts", F.ceil(F.col("members") / (size or BLOCK)).cast("int")).drop("members")
    placed = rows.join(sizes, key).withColumn("part", F.pmod(F.xxhash64(ident), F.col("parts")).cast("int"))
    cells = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.struct(F.least("part", p).alias("low"), F.greatest("part", p).alias("high")))
    return placed.withColumn("cell", F.explode(cells)).withColumns({"low": F.col("cell.low"), "high": F.col("cell.high")}).drop("cell", "parts")


APART = "low = high OR part_a <> part_b"  # two members of different parts meet in the cell of their parts only


def _side(rows: DataFrame, shared: list[str], name: str) -> DataFrame:
    """A copy of ``rows`` whose columns other than those shared end in ``name``."""
    return rows.select(*shared, *[F.col(c).alias(f"{c}_{name}") for c in rows.columns if c not in shared])


# ---- organisations


def company_tokens(name: str) -> tuple[list[str], str, str]:
    """(tokens, initials with and without joining words separated by a bar, acronym letters or empty)."""
    text = unicodedata.normalize("NFC", name).strip()
    text = regex.sub(r"\([^)]*\)", " ", text)
    text = regex.sub(r"(?i),?\s*\b(?:dept|department|faculty|division|office)\b\.? (?:of|for)\b.*$", "", text)
    bare = regex.sub(r"[\s.]", "", text)
    capitals = len(regex.findall(r"\p{Lu}", bare))
    acronym = plain(bare) if not regex.search(r"\s", text.replace(". ", ".")) and bare.isalpha() and 2 <= len(bare) <= 8 and capitals >= 2 and capitals >= 0.6 * len(bare) else ""
    if not regex.search(r"\s", text):
        text = regex.sub(r"(?<=\p{Ll})(?=\p{Lu})", " ", text)
    text = plain(_DOTTED.sub(lambda m: m[0].replace(".", "").replace(" ", "") + " ", text))
    words = _WORD.findall(text)
    core = [w for w in words if w not in LEGAL]
    long_words = [w for w in words if w not in ("the", "inc", "llc", "ltd", "gmbh", "sa", "corp", "co")]
    initials = "".join(w[0] for w in long_words) + "|" + "".join(w[0] for w in core)
    return words, initials, acronym


def _abbreviations(words: DataFrame, weight: DataFrame, near: DataFrame) -> DataFrame:
    """``spelling, token, full``: tokens that abbreviate a word, or misspell its first letter, in a spelling that agrees in all
    other tokens. An abbreviation starts like its word and has its letters in order; one of one or two letters counts if only
    one word fits."""
    sets = words.groupBy("spelling").agg(F.array_sort(F.collect_set("token")).alias("ts")).where(F.size("ts").between(2, 12))
    sets = sets.groupBy("ts").agg(F.count(F.lit(1)).alias("spellings"))
    alone = cut(sets.select(F.explode("ts").alias("token"), "ts").join(weight, "token").select("token", "n", "ts", F.array_join(F.array_remove("ts", F.col("token")), " ").alias("rest")), "rests")
    shaped = paired(alone.withColumn("letter", F.substring("token", 1, 1)).drop("ts"), ["rest", "letter"], "token")
    shared = ["rest", "letter", "low", "high"]
    pattern = F.concat(F.lit("^"), F.regexp_replace("token_a", "(.)", "$1.*"))
    fits = F.col("token_b").startswith(F.col("token_a")) | ((F.length("token_a") > 2) & F.regexp_like("token_b", pattern))
    short = _side(shaped, shared, "a").join(_side(shaped, shared, "b"), shared).where(APART).where((F.length("token_b") >= F.length("token_a") + 2) & (F.col("n_b") >= F.col("n_a")) & fits)
    short = short.groupBy("rest", F.col("token_a").alias("token")).agg(F.max(F.struct("n_b", "token_b"))["token_b"].alias("full"), F.count_distinct("token_b").alias("k")).where("k = 1 OR length(token) > 2").drop("k")
    swapped = near.where((F.col("distance") == 1) & (F.substring("a", 1, 1) != F.substring("b", 1, 1)) & (F.length("a") >= 4))
    a, b = alone.select("rest", F.col("token").alias("a"), F.col("n").alias("na")).where("na = 1"), alone.select("rest", F.col("token").alias("b"), F.col("n").alias("nb")).where("nb >= 4")
    first = swapped.join(a, "a").join(b, ["rest", "b"]).groupBy("rest", F.col("a").alias("token")).agg(F.max(F.struct("nb", "b"))["b"].alias("full"))
    meant = short.unionByName(first).dropDuplicates(["rest", "token"])
    found = alone.join(meant, ["rest", "token"]).select("ts", "token", "full")
    with_sets = words.groupBy("spelling").agg(F.array_sort(F.collect_set("token")).alias("ts"))
    return with_sets.join(found, "ts").select("spelling", "token", "full")


def companies(spellings: DataFrame) -> DataFrame:
    """``spelling, org``: the organisation of each distinct spelling (column ``spelling``); blank ones are left out."""

    def parse(batches):
        for pdf in batches:
            rows = [(s, *company_tokens(s)) for s in pdf["spelling"]]
            yield pd.DataFrame(rows, columns=["spelling", "tokens", "initials", "acronym"])

    distinct = spellings.where("trim(spelling) <> ''").select("spelling").distinct()
    parsed = cut(distinct.mapInPandas(parse, "spelling string, tokens array<string>, initials string, acronym string"), "companies")
    words = parsed.select("spelling", F.explode(F.array_distinct("tokens")).alias("token"))
    weight = cut(words.groupBy("token").agg(F.count(F.lit(1)).alias("n")), "tokens")
    near = cut(trie_join(weight.select(F.lit("company").alias("kind"), "token"), {"company": [(2, 1), (9, 2)]}), "near")
    w = weight.select(F.col("token").alias("b"), F.col("n").alias("nb"))
    alike = near.where((F.substring("a", 1, 1) == F.substring("b", 1, 1)) | F.col("b").isin(*LEGAL))  # brands differ by their first letter
    better = alike.where(~F.col("a").isin(*LEGAL, *SHORT) & (F.length("a") > 1)).join(weight.select(F.col("token").alias("a"), F.col("n").alias("na")), "a").join(w, "b")
    # a typo is rarer than what it stands for; farther ones must be much rarer
    better = better.where("(distance = 1 AND ((na <= 2 AND nb > na) OR nb >= 6 * na OR (na <= 2 AND nb = na AND b < a AND length(a) >= 6))) OR (distance = 2 AND na <= 2 AND nb >= 8)")
    read_as = better.groupBy("a").agg(F.max(F.struct(-F.col("distance"), F.col("nb"), F.col("b")))["b"].alias("hub"))
    meant = words.join(read_as, words["token"] == read_as["a"], "left").select("spelling", F.coalesce("hub", "token").alias("token")).where(~F.col("token").isin(*LEGAL))
    written_out = F.create_map(*[F.lit(x) for kv in SHORT.items() for x in kv])
    meant = cut(meant.select("spelling", F.coalesce(written_out[F.col("token")], "token").alias("token")).distinct(), "meant")
    known = cut(meant.groupBy("token").agg(F.count(F.lit(1)).alias("n")), "known")
    mended = meant.join(_abbreviations(meant, known, near), ["spelling", "token"], "left").select("spelling", F.coalesce("full", "token").alias("token"))
    mended = mended.join(known, "token").where("length(token) > 2 OR NOT token RLIKE '^[a-z0-9]*$' OR (length(token) = 2 AND n > 2)")
    keys = mended.groupBy("spelling").agg(F.array_join(F.array_sort(F.collect_set("token")), " ").alias("key"), F.count_distinct("token").alias("size"))
    keyed = cut(parsed.select("spelling", "initials", "acronym").join(keys, "spelling", "left"), "keys")
    full = keyed.where("size >= 2 AND acronym = ''")
    only = lambda df, by: df.groupBy(by).agg(F.min("key").alias("target"), F.count_distinct("key").alias("orgs")).where("orgs = 1").drop("orgs")
    by_token = only(full.select("key", F.explode(F.split("key", " ")).alias("brand")).distinct(), "brand")
    by_initials = only(full.select("key", F.explode(F.split("initials", "\\|")).alias("letters")).distinct(), "letters")
    out = keyed.join(by_token, (F.col("size") == 1) & (F.col("acronym") == "") & (keyed["key"] == by_token["brand"]), "left").withColumnRenamed("target", "brand_target")
    out = out.join(by_initials, (F.col("acronym") != "") & (F.col("acronym") == by_initials["letters"]), "left")
    alone = F.when(F.col("acronym") != "", F.concat(F.lit("acronym "), "acronym")).otherwise(F.coalesce("key", F.concat(F.lit("as is "), "spelling")))
    return out.select("spelling", F.coalesce("brand_target", F.when(F.col("acronym") != "", F.col("target")), alone).alias("org"))


def vote(spelled: DataFrame, members: DataFrame) -> DataFrame:
    """``spelling, org`` again, where a brand or an acronym that several organisations share stands for the one that rows of the same persons name most."""
    vague = "org LIKE 'acronym %' OR NOT org LIKE '% %'"
    told = members.where("org IS NOT NULL").select("person", "org", "id")
    unclear = told.where(vague).select("person", F.col("org").alias("vague"))
    clear = told.where(f"NOT ({vague})").select("person", "org").distinct()
    heads = F.array_join(F.array_sort(F.filter(F.transform(F.split("org", " "), lambda t: F.substring(t, 1, 1)), lambda c: ~c.isin("o", "f"))), "")
    letters = F.array_join(F.array_sort(F.filter(F.split(F.substring("vague", 9, 99), ""), lambda c: ~c.isin("o", "f"))), "")
    fits = F.when(F.col("vague").startswith("acronym "), heads == letters).otherwise(F.array_contains(F.split("org", " "), F.col("vague")))
    votes = unclear.join(clear, "person").where(fits).groupBy("vague", "org").agg(F.count(F.lit(1)).alias("n"))
    won = votes.groupBy("vague").agg(F.max(F.struct("n", "org"))["org"].alias("won"), F.max("n").alias("n"), F.sum("n").alias("total")).where("2 * n > total")
    return spelled.join(won.select(F.col("vague").alias("org"), "won"), "org", "left").select("spelling", F.coalesce("won", "org").alias("org"))


def company_pairs(spelled: DataFrame) -> DataFrame:
    """``key_a < key_b``: the pairs of spellings of one organisation."""
    shared = ["org", "low", "high"]
    placed = paired(spelled.select("org", F.col("spelling").alias("key")), ["org"], "key")
    return _side(placed, shared, "a").join(_side(placed, shared, "b"), shared).where(APART).where("key_a < key_b").select("key_a", "key_b")


# ---- persons


def person_words(name: str | None) -> tuple[list[str], int]:
    """(words of a name without titles, how many of them stand before a comma; 0 without one). A hyphen joins a word."""
    text = plain(regex.sub(r"\([^)]*\)|\[[^\]]*\]", " ", name or ""))
    text = _TITLE.sub(" ", text)
    head, comma, tail = text.partition(",")
    split = lambda s: ["-".join(regex.findall(r"[^\W\d_]+", w)) for w in s.split()]
    first, second = [w for w in split(head) if w], [w for w in split(tail.replace(",", " ")) if w]
    return (first + second, len(first)) if comma and first and second else (first or second, 0)


UNLIKELY = 0.05


def readings(words: list[str], comma: int, given_like: dict[str, float]) -> list[tuple[str, str, str]]:
    """(given name, middle names, surname) of each likely order of the words. ``given_like`` tells how often a word is a given
    name; an order counts unless it is less than ``UNLIKELY`` times as likely as the best one."""
    if comma:
        return [(words[comma], " ".join(words[comma + 1 :]), " ".join(words[:comma]).replace("-", " "))]
    if len(words) < 2:
        return [("", "", w.replace("-", " ")) for w in words]
    g = lambda w: 0.9 if len(w) == 1 else 0.02 if "-" in w else min(0.98, max(0.02, given_like.get(w, 0.5)))
    orders = {(0, tuple(range(1, len(words) - 1)), (len(words) - 1,)), (1, tuple(range(2, len(words))), (0,))}
    if len(words) > 2 and not any("-" in w for w in words):  # a double surname without its hyphen
        orders |= {(0, tuple(range(1, len(words) - 2)), (len(words) - 2, len(words) - 1)), (2, tuple(range(3, len(words))), (0, 1))}
    likely = {}
    for order in orders:
        given, middle, last = order
        weight = g(words[given])
        for i in middle:
            weight *= g(words[i])
        for i in last:
            weight *= 1 - g(words[i])
        likely[order] = weight
    best = max(likely.values())
    pick = lambda places: " ".join(words[i] for i in places)
    return sorted((words[a], pick(m), pick(s).replace("-", " ")) for (a, m, s), weight in likely.items() if weight >= UNLIKELY * best)


@lru_cache(100_000)
def roots(given: str) -> frozenset[str]:
    """The given names that a given name may stand for; one that is no nickname itself may be a typo of one."""
    known = _FORMS.get(given)
    if known is None and len(given) > 3:
        known = frozenset().union(*[full for nick, full in _FORMS.items() if len(nick) > 3 and osa(given, nick, 1) == 1])
    return (known or frozenset()) | {given}


def given_match(a: str, b: str) -> int:
    """3 equal or nickname, 2 typo, 1 initial or two typos in a short name, 0 different."""
    if not a or not b:
        return 0
    if len(a) == 1 or len(b) == 1:
        letters = {r[0] for r in roots(a if len(b) == 1 else b)}
        return 1 if (b if len(b) == 1 else a) in letters else 0
    ra, rb = roots(a), roots(b)
    if ra & rb:
        return 3
    bound = 1 if min(len(a), len(b)) <= 5 else 2
    if osa(a, b, bound) <= bound or any(len(x) > 3 and len(y) > 3 and osa(x, y, 1) <= 1 for x in ra for y in rb):
        return 2
    return 1 if a[0] == b[0] and min(len(a), len(b)) >= 4 and osa(a, b, 2) <= 2 else 0


def surname_match(a: str, b: str) -> int:
    """3 equal under any order of its parts, 2 one typo or one part of a double name (or nearly), 1 two typos, 0 different."""
    if a == b:
        return 3
    if len(a) < 3 or len(b) < 3:
        return 0
    pa, pb = a.split(), b.split()
    if len(pa) > 1 and len(pa) == len(pb) and a[0] != b[0]:
        a, b = " ".join(sorted(pa)), " ".join(sorted(pb))
        if a == b:
            return 3
    d = osa(a, b, 2)
    if d <= 1:
        return 2
    if len(pa) != len(pb):
        short, long = sorted((pa, pb), key=len)
        near = [min(osa(x, y, 1) if min(len(x), len(y)) > 3 else 2 * (x != y) for y in long) for x in short]
        if max(near) <= 1:
            return 2
    return 1 if d == 2 and min(len(a), len(b)) >= 5 else 0


_EXACT = ("phd_year", "phd_field", "current_title", "location", "is_professor")
_WEIGHT = {"phd_year": 2, "phd_field": 1, "current_title": 1, "location": 2, "is_professor": 0}


def agreement(a: dict, b: dict) -> int:
    """How much two rows agree: -1 a conflict, else a sum of weights."""
    total = 0
    for c in _EXACT:
        x, y = a[c], b[c]
        if x is not None and y is not None:
            if x != y:
                return -1
            total += _WEIGHT[c]
    for c, slack in (("inst", 2), ("org", 0)):
        x, y = a[c], b[c]
        if x and y:
            if x == y:
                total += 3
            elif slack and osa(x, y, slack) <= slack:
                total += 2
            elif c == "org" and _org_near(x, y):
                total += 1
            else:
                return -1
    return total


def _org_near(x: str, y: str) -> bool:
    """Keys of organisations that may still be one: an acronym or a brand without its own key, or a leftover typo."""
    if x.startswith("acronym ") or y.startswith("acronym "):
        letters, other = (x, y) if x.startswith("acronym ") else (y, x)
        heads = sorted(w[0] for w in other.split())
        mine = sorted(c for c in letters[8:] if c not in "of")
        return not other.startswith("acronym ") and [h for h in heads if h not in "of"] == mine
    px, py = set(x.split()), set(y.split())
    if len(px) == 1 or len(py) == 1:
        return px <= py or py <= px
    left, right = sorted(px - py), sorted(py - px)
    return len(left) == len(right) == 1 and osa(left[0], right[0], 2) <= 2


def same_person(a: dict, b: dict) -> bool:
    """Whether two rows were typed for one person, by their names and attributes."""
    s = surname_match(a["surname"], b["surname"])
    g = given_match(a["given"], b["given"]) if s else 0
    if not g:
        return False
    ma, mb = a["middle"], b["middle"]
    if ma and mb and ma[0] != mb[0] and osa(ma, mb, 2) > 2:
        return False
    score = agreement(a, b)
    if score < 0:
        return False
    if ma and mb and (ma == mb or ma[0] == mb[0]):
        score += 1
    need = {(3, 3): 1, (3, 2): 2, (2, 3): 2, (2, 2): 3, (1, 3): 3, (3, 1): 3, (2, 1): 4, (1, 2): 4, (1, 1): 6}[g, s]
    if s == 1 and min(len(a["surname"]), len(b["surname"])) < 7:
        need += 2
    return score >= need


_FIELDS = ("given", "middle", "surname", "inst", "org", *_EXACT)
_BODY = ", ".join(f"{c} string" for c in ("inst", "org", *_EXACT))


def _parse_people(pdfs):
    for pdf in pdfs:
        parts = [person_words(n) for n in pdf.pop("name")]
        inst = [None if t is None else " ".join(w for w in _WORD.findall(plain(t)) if w not in ("university", "univ", "of", "the")) or None for t in pdf.pop("phd_institution")]
        yield pdf.assign(words=[w for w, _ in parts], comma=[c for _, c in parts], inst=inst)


def _initials(given: str, hubs: dict[str, list[str]]) -> set[str]:
    return {r[0] for g in (given, *hubs.get(given, ())) for r in roots(g) if r}


def _read(pdfs):
    """Rows of readings with the keys of their blocks: each part of the surname and its commoner neighbours, with each initial."""
    for pdf in pdfs:
        rows = pdf.to_dict("records")
        out = []
        for r in rows:
            words, found = list(r.pop("words")), r.pop("told")
            told = {} if found is None else {t["token"]: t for t in found}
            hubs = {w: list(t["hubs"]) for w, t in told.items()}
            for given, middle, surname in readings(words, r["comma"], {w: t["given_like"] for w, t in told.items()}):
                places = {p for part in surname.split() for p in (part, *hubs.get(part, ())) if len(p) > 1}
                keys = sorted(f"{p}|{c}" for p in places for c in _initials(given, hubs))
                if keys:
                    out.append({**r, "given": given, "middle": middle, "surname": surname, "keys": keys})
        yield pd.DataFrame(out, columns=["id", *_FIELDS, "keys"])


def _verify(pairs):
    for pdf in pairs:
        rows = pdf.astype(object).where(pdf.notna(), None)
        left = [dict(zip(_FIELDS, r)) for r in zip(*[rows[f"{c}_a"] for c in _FIELDS])]
        right = [dict(zip(_FIELDS, r)) for r in zip(*[rows[f"{c}_b"] for c in _FIELDS])]
        keep = [same_person(x, y) for x, y in zip(left, right)]
        yield pd.DataFrame({"u": pdf.loc[keep, "id_a"], "v": pdf.loc[keep, "id_b"]})


def _told(reps: DataFrame) -> DataFrame:
    """``id, told``: of each word of a row how often it, and the words near it, stand as a given name rather than as a surname,
    and its commoner neighbours."""
    parts = F.transform("words", lambda w, i: F.struct(w.alias("word"), (i == F.when(F.col("comma") > 0, F.col("comma")).otherwise(0)).cast("int").alias("g"), F.when(F.col("comma") > 0, i < F.col("comma")).otherwise(i == F.size("words") - 1).cast("int").alias("s")))
    rows = reps.where(F.size("words") > 1).select("id", F.explode(parts).alias("p")).select("id", F.explode(F.split("p.word", "-")).alias("token"), F.when(F.col("p.word").contains("-"), 0).otherwise(F.col("p.g")).alias("g"), F.when(F.col("p.word").contains("-"), 1).otherwise(F.col("p.s")).alias("s")).where("token <> ''")
    words = cut(rows.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.sum("g").alias("g"), F.sum("s").alias("s")), "words")
    near = trie_join(words.select(F.lit("name").alias("kind"), "token"), {"name": [(4, 1), (6, 2)]})
    other = words.select(F.col("token").alias("b"), F.col("n").alias("nb"), F.col("g").alias("gb"), F.col("s").alias("sb"))
    own = words.select(F.col("token").alias("a"), F.col("n").alias("na"))
    around = near.join(other, "b").join(own, "a").groupBy(F.col("a").alias("token")).agg(F.sum("gb").alias("gb"), F.sum("sb").alias("sb"), F.array_compact(F.collect_list(F.when(F.expr("nb > na OR (nb = na AND b < a)"), F.col("b")))).alias("hubs"))
    nicknames = F.col("token").isin(sorted(NICKNAMES.keys() | set().union(*_FORMS.values()))).cast("int") * 3
    g, s = F.col("g") + F.coalesce("gb", F.lit(0)) + nicknames, F.col("s") + F.coalesce("sb", F.lit(0))
    table = words.join(around, "token", "left").select("token", ((g + 0.5) / (g + s + 1)).alias("given_like"), F.coalesce("hubs", F.array().cast("array<string>")).alias("hubs"))
    return rows.select("id", "token").distinct().join(table, "token").groupBy("id").agg(F.collect_list(F.struct("token", "given_like", "hubs")).alias("told"))


def _links(read: DataFrame) -> DataFrame:
    """``u, v``: rows that share a block, have no conflicting attribute and pass ``same_person`` in a pair of readings."""
    placed = paired(read.withColumn("key", F.explode("keys")), ["key"], "id")
    shared = ["key", "low", "high"]
    pairs = _side(placed, shared, "a").join(_side(placed, shared, "b"), shared).where("id_a < id_b").where(APART)
    pairs = pairs.where(F.array_min(F.array_intersect("keys_a", "keys_b")) == F.col("key"))  # a pair of readings counts in one block
    for c in _EXACT:  # same_person refuses any other pair
        pairs = pairs.where(F.coalesce(F.col(f"{c}_a") == F.col(f"{c}_b"), F.lit(True)))
    # a swap counts 1 there and 2 here
    pairs = pairs.where(F.coalesce(F.levenshtein("inst_a", "inst_b", 4) >= 0, F.lit(True)))
    return pairs.select("id_a", "id_b", *[f"{c}_{k}" for k in "ab" for c in _FIELDS]).mapInPandas(_verify, "u string, v string")


def persons(sheet: DataFrame, spelled: DataFrame, id_col: str = "sheet_id") -> DataFrame:
    """``id, person``, attributes: a class for each row, shared by the rows that were typed for the same person."""
    base = sheet.select(F.col(id_col).cast("string").alias("id"), "name", "phd_institution", "phd_year", "phd_field", "current_title", "location", F.col("is_professor").cast("string").alias("is_professor"), F.col("current_company").alias("spelling"))
    blank = lambda c: F.nullif(F.trim(F.lower(c)), F.lit("")).alias(c)
    base = base.join(spelled, "spelling", "left").select("id", "name", "phd_institution", F.col("phd_year").cast("string").alias("phd_year"), blank("phd_field"), blank("current_title"), blank("location"), "is_professor", "org").where("trim(name) <> '' AND id IS NOT NULL")
    parsed = base.mapInPandas(_parse_people, f"id string, words array<string>, comma int, {_BODY}").where(F.size("words") > 0)
    people = cut(parsed.withColumn("profile", F.to_json(F.struct("words", "comma", "inst", "org", *_EXACT))), "people")
    # rows that say the same are compared once
    reps = cut(people.groupBy("profile").agg(F.min("id").alias("id"), *[F.first(c).alias(c) for c in ("words", "comma", "inst", "org", *_EXACT)]), "reps")
    read = reps.drop("profile").join(_told(reps), "id", "left").mapInPandas(_read, f"id string, given string, middle string, surname string, {_BODY}, keys array<string>")
    joined = components(_links(cut(read, "read")))
    classes = reps.select("profile", "id").join(joined, "id", "left").select("profile", F.coalesce("component", "id").alias("person"))
    return people.join(classes, "profile").select("id", "person", "inst", "org", *_EXACT)


def person_pairs(members: DataFrame) -> DataFrame:
    """``key_a < key_b``: the pairs of rows of a person whose attributes don't conflict."""
    shared = ["person", "low", "high"]
    placed = paired(members.select("person", "id", *_EXACT), ["person"], "id")
    pairs = _side(placed, shared, "a").join(_side(placed, shared, "b"), shared).where("id_a < id_b").where(APART)
    for c in _EXACT:
        pairs = pairs.where(F.coalesce(F.col(f"{c}_a") == F.col(f"{c}_b"), F.lit(True)))
    return pairs.select(F.col("id_a").alias("key_a"), F.col("id_b").alias("key_b"))

"""Hybrid search over a catalog: query language, keyword ranking, fusion, boosts, facets and filters.

A query string is scalar, so it is parsed on the driver into a plain specification; everything that touches items is a
DataFrame operator. The keyword score is BM25 over weighted fields (the reference's scorer lives in a library outside
it, so only its order of magnitude is comparable).
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut

#: Names of query fields and their aliases.
ALIASES = {
    "author": "author", "authors": "author", "by": "author", "writer": "author", "year": "year", "date": "year", "published": "year", "yr": "year",
    "topic": "topic", "area": "topic", "field": "topic", "domain": "topic", "type": "type", "kind": "type", "category": "type",
}
#: A small default synonym table; callers pass their own.
SYNONYMS = {
    "iv": ["instrumental variables"], "did": ["difference in differences", "diff-in-diff"], "rct": ["randomized controlled trial", "experiment"], "ml": ["machine learning"], "causal": ["causality", "causation"],
    "survey": ["questionnaire", "poll"], "price": ["pricing", "cost"], "trade": ["export", "import"], "wage": ["earnings", "salary"], "panel": ["longitudinal"],
}
FIELD_BOOSTS = {"name": 3.0, "tags": 1.5, "description": 1.0, "category": 0.8}


@dataclass
class Parsed:
    """A parsed query."""

    phrases: list[str] = field(default_factory=list)
    negated_phrases: list[str] = field(default_factory=list)
    negated_terms: list[str] = field(default_factory=list)
    terms: list[str] = field(default_factory=list)
    fields: dict[str, list[str]] = field(default_factory=dict)

    @property
    def clean(self) -> str:
        return " ".join([*self.terms, *self.phrases])

    def describe(self) -> str:
        """The query in words."""
        parts = [f"{k}: {' or '.join(v)}" for k, v in self.fields.items()]
        parts += [f'exactly "{p}"' for p in self.phrases] + [f"without {t}" for t in (*self.negated_terms, *self.negated_phrases)]
        return "; ".join(([" ".join(self.terms)] if self.terms else []) + parts)


def parse(query: str) -> Parsed:
    """Phrases, ``field:value`` filters, negations and terms of a query; unknown fields are dropped; a dash negates only at the start of a word."""
    out = Parsed()
    rest = query or ""

    def phrase(m: re.Match) -> str:
        (out.negated_phrases if m[1] else out.phrases).append(m[2].lower().strip())
        return " "

    def fielded(m: re.Match) -> str:
        name = ALIASES.get(m[1].lower())
        if name:
            out.fields.setdefault(name, []).append((m[2] or m[3]).lower())
        return " "

    rest = re.sub(r'(?<!\S)(\w+):"([^"]+)"()', fielded, rest)
    rest = re.sub(r'(?<!\S)(-?)"([^"]+)"', phrase, rest)
    rest = re.sub(r'(?<!\S)(\w+):()(\S+)', fielded, rest)
    for word in rest.split():
        if word.startswith("-") and len(word) > 2:
            out.negated_terms.append(word[1:].lower())
        elif word != "-":
            out.terms.append(word.lower())
    return out


def without_filter(query: str, name: str, value: str) -> str:
    """The query without one field filter."""
    words = [w for w in query.split() if not (":" in w and ALIASES.get(w.split(":", 1)[0].lower()) == name and w.split(":", 1)[1].lower() == value.lower())]
    return " ".join(words)


def matches(parsed: Parsed) -> Column:
    """Filter of items (name, description, tags array, authors, year, type, topics array): fields all, their values any."""
    text = F.lower(F.concat_ws(" ", "name", "description", F.array_join("tags", " "), "authors"))
    any_of = lambda tests: reduce(lambda a, b: a | b, tests)
    tests = [F.lit(True)]
    for name, values in parsed.fields.items():
        if name == "author":
            tests.append(any_of([F.coalesce(F.lower("authors").contains(v), F.lit(False)) for v in values]))
        elif name == "topic":
            tests.append(any_of([F.coalesce(F.lower(F.array_join("topics", ",")).contains(v), F.lit(False)) for v in values]))
        elif name == "year":
            tests.append(F.coalesce(F.col("year").cast("string").isin(values), F.lit(False)))
        else:
            tests.append(F.coalesce(F.lower("type").isin(values), F.lit(False)))
    tests += [text.contains(p) for p in parsed.phrases] + [~text.contains(t) for t in (*parsed.negated_terms, *parsed.negated_phrases)]
    return reduce(lambda a, b: a & b, tests)


def expand(words: list[str], synonyms: dict[str, list[str]] = SYNONYMS) -> list[str]:
    """Words and their synonyms, in order, each once."""
    return list(dict.fromkeys([*words, *[s for w in words for s in synonyms.get(w, [])]]))


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda w: w != "")


def postings(items: DataFrame, boosts: dict[str, float] = FIELD_BOOSTS) -> DataFrame:
    """``term, id, weight``: term frequencies weighted by field, one row per term and item."""
    weigh = lambda b: lambda t: F.struct(t.alias("term"), F.lit(b).alias("w"))
    parts = [F.transform(tokens(F.array_join(F.col(c), " ") if c == "tags" else F.col(c)), weigh(b)) for c, b in boosts.items()]
    rows = items.select("id", F.explode(F.flatten(F.array_compact(F.array(*parts)))).alias("t"))
    return rows.groupBy(F.col("t.term").alias("term"), "id").agg(F.sum("t.w").alias("weight"))


def index(items: DataFrame, boosts: dict[str, float] = FIELD_BOOSTS) -> DataFrame:
    """The postings as a written table; build it once and give it to any number of queries."""
    return cut(postings(items, boosts), "index")


def near_terms(posts: DataFrame, words: list[str], fuzzy: float = 0.2, prefix: float = 0.375, typo: float = 0.45) -> DataFrame:
    """``term, factor``: the terms of an index that a query's words mean: themselves, terms that start with them, and terms within
    the edit distance ``fuzzy`` x length (rounded); the longer or farther, the less they count."""
    size, tests = F.length("term"), []
    for w in dict.fromkeys(words):
        most = int(fuzzy * len(w) + 0.5)
        away = F.levenshtein("term", F.lit(w))
        starts = F.when(F.col("term").startswith(w), prefix * size / (size + 0.3 * (size - len(w))))
        near = F.when(away <= most, typo * size / (size + away)) if most else F.lit(None).cast("double")
        tests.append(F.when(F.col("term") == w, 1.0).otherwise(F.greatest(starts, near)))
    vocabulary = posts.select("term").distinct()
    return vocabulary.select("term", F.explode(F.array_compact(F.array(*tests) if tests else F.array().cast("array<double>"))).alias("f")).groupBy("term").agg(F.sum("f").alias("factor"))


def bm25(posts: DataFrame, terms: dict[str, float] | DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """``id, score`` of items with any of the terms; ``terms`` gives each term's factor (0.9 for synonyms), as a table for ``near_terms``."""
    lengths = posts.groupBy("id").agg(F.sum("weight").alias("length"))
    stats = lengths.agg(F.struct(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean")).alias("s")).scalar()
    if isinstance(terms, dict):
        factor = F.create_map(*[F.lit(x) for kv in terms.items() for x in kv])[F.col("term")] if terms else F.lit(None).cast("double")
        hit = posts.where(F.col("term").isin(list(terms))).withColumn("factor", factor)
    else:
        hit = posts.join(terms, "term")
    df, factor = hit.groupBy("term").agg(F.count(F.lit(1)).alias("df")), F.col("factor")
    joined = hit.join(df, "term").join(lengths, "id").withColumn("s", stats).withColumns({"n": F.col("s.n"), "mean": F.col("s.mean")})
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("weight") * (k1 + 1) / (F.col("weight") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    return joined.groupBy("id").agg(F.round(F.sum(factor * idf * tf), 9).alias("score"))  # rounded, so that ties don't hang on the order of sums


def query_terms(query: str, synonyms: dict[str, list[str]] = SYNONYMS) -> dict[str, float]:
    """Query words at weight 1 and the words of their synonyms at 0.9."""
    words = re.findall(r"\w+", query.lower())
    extra = [t for w in words for s in synonyms.get(w, []) for t in re.findall(r"\w+", s)]
    return {**{t: 0.9 for t in extra}, **{w: 1.0 for w in words}}


def exact_boost(score: Column, query: str) -> Column:
    """Factors for the name (whole 3, prefix 2, whole word 1.5), a tag 1.2, all words 1.3, a long description 1.05, papers and packages 1.1."""
    q = query.lower().strip()
    name, words = F.lower("name"), [w for w in q.split() if len(w) > 2]
    word = F.regexp_replace(F.lit(q), "([^\\w\\s])", "\\\\$1")
    factor = F.when(name == q, 3.0).when(name.startswith(q), 2.0).when(F.regexp_like(name, F.concat(F.lit("\\b"), word, F.lit("\\b"))), 1.5).otherwise(1.0)
    tag = F.when(F.exists(F.coalesce("tags", F.array()), lambda t: F.lower(t).contains(q)), 1.2).otherwise(1.0)
    text = F.concat_ws(" ", name, F.lower("description"))
    every = F.when(reduce(lambda a, b: a & b, [text.contains(w) for w in words]), 1.3).otherwise(1.0) if words else F.lit(1.0)
    long = F.when(F.length("description") > 100, 1.05).otherwise(1.0)
    kind = F.when(F.col("type").isin("paper", "package"), 1.1).otherwise(1.0)
    return score * factor * tag * every * long * kind


def rrf(keyword: DataFrame, semantic: DataFrame, k: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of two scored lists (``id, score``). A strong best keyword shifts the weights to 1.5 and
    0.7, a strong best vector then sets its own to 1.3. The lists are top-k results, so their ranks come from small sorts."""
    best_k, best_s = keyword.agg(F.max("score")).scalar(), semantic.agg(F.max("score")).scalar()
    wk = F.when(best_k > 15, 1.5).otherwise(1.0)
    ws = F.when(best_s > 0.7, 1.3).when(best_k > 15, 0.7).otherwise(1.0)
    w = Window.partitionBy(F.lit(1)).orderBy(F.desc("score"), "id")
    a = keyword.select("id", F.row_number().over(w).alias("ra"))
    b = semantic.select("id", F.row_number().over(w).alias("rb"))
    joined = a.join(b, "id", "full_outer")
    part = lambda weight, rank: F.coalesce(weight / (k + F.col(rank)), F.lit(0.0))
    return joined.select("id", (part(wk, "ra") + part(ws, "rb")).alias("score"), "ra", "rb")


#: Words that tell beginners' and researchers' queries; they count inside words too.
BEGINNER = "intro|beginner|start|basic|learn|what is|simple|getting started|tutorial|guide for"
ADVANCED = "paper|research|advanced|theory|proof|optimal|state of the art|sota|novel|algorithm"
#: Intents in the order in which they are tried: pattern (without regard to case), favoured types, factor.
INTENTS = [
    (r"how to|guide|beginner|intro|learn|getting started|tutorial|walkthrough|step by step|hands-on|quickstart|example|crash course|101\b|basics", ("resource", "roadmap", "book"), 1.5),
    (r"paper|study|evidence|finding|analysis|research|literature|empirical|methodology|framework|theory|survey|review|meta-analysis|systematic", ("paper",), 1.8),
    (r"\bdataset\b|download data|csv|benchmark data|corpus|training data|data source|open data|public data|kaggle", ("dataset",), 1.8),
    (r"install|npm|pip|code|library|package|cran|pypi|implementation", ("package",), 1.8),
    (r"job|interview|resume|salary|hire|career|role|position|company", ("career",), 1.8),
    (r"video|talk|presentation|lecture|conference|youtube|watch", ("talk",), 1.5),
    (r"community|forum|slack|discord|newsletter|blog|podcast|follow", ("community",), 1.5),
    (r"book|textbook|reading|read|author", ("book",), 1.5),
    (r"causal|RCT|A\/B test|treatment effect|DiD|diff-in-diff|regression discontinuity|instrumental variable|IV\b|propensity|confounder|identification|natural experiment|quasi-experiment", ("paper", "package"), 1.6),
    (r"pricing|revenue|demand estimation|elasticity|willingness to pay|conjoint", ("paper", "package"), 1.6),
    (r"CLV|customer lifetime|churn|retention|BTYD|Pareto\/NBD|BG\/NBD|RFM", ("paper", "package", "book"), 1.6),
    (r"recommend|collaborative filtering|matrix factorization|personalization|content-based", ("paper", "package", "dataset"), 1.6),
    (r"advertis|ad tech|RTB|programmatic|ad auction|bidding|impression|click-through", ("paper", "package"), 1.6),
    (r"energy|electricity|grid|renewable|solar|wind|utility|power plant|emissions", ("paper", "dataset", "package"), 1.5),
    (r"defense|military|security|procurement|SIPRI|arms|cyber|DoD", ("paper", "dataset"), 1.5),
    (r"machine learning|ML\b|neural|deep learning|transformer|BERT|GPT|XGBoost|random forest", ("paper", "package"), 1.4),
    (r"bayesian|posterior|prior|MCMC|PyMC|Stan\b|hierarchical model", ("paper", "package", "book"), 1.5),
    (r"time series|forecast|ARIMA|prophet|seasonality|trend", ("paper", "package"), 1.5),
    (r"fraud|anomaly detection|risk scoring|outlier|suspicious|anti-fraud", ("paper", "package", "dataset"), 1.6),
    (r"matching|marketplace|two-sided|platform|gig economy|uber|airbnb", ("paper", "package"), 1.5),
    (r"auction|bidding|VCG|GSP|mechanism design|reserve price|second price", ("paper", "package"), 1.6),
    (r"health|medical|clinical|patient|hospital|pharma|drug", ("paper", "dataset", "package"), 1.5),
    (r"insurance|actuarial|underwriting|claims|loss ratio|mortality|morbidity", ("paper", "package", "dataset"), 1.5),
    (r"sports|baseball|basketball|football|soccer|sabermetrics|player value|WAR\b", ("paper", "dataset", "package"), 1.5),
    (r"logistics|supply chain|inventory|fulfillment|routing|delivery|last mile", ("paper", "package", "dataset"), 1.5),
    (r"privacy|differential privacy|GDPR|anonymization|federated|secure", ("paper", "package"), 1.5),
    (r"ranking|learn to rank|NDCG|position bias|click model|search engine", ("paper", "package"), 1.5),
    (r"embedding|representation learning|word2vec|node2vec|graph neural", ("paper", "package"), 1.4),
    (r"survival|hazard|cox regression|kaplan-meier|time-to-event|censored", ("paper", "package"), 1.5),
    (r"segment|cluster|k-means|DBSCAN|cohort|persona|customer segment", ("paper", "package"), 1.5),
    (r"attribution|marketing mix|MMM|incrementality|media mix|channel", ("paper", "package", "book"), 1.6),
    (r"choice model|discrete choice|logit|multinomial|conjoint|stated preference", ("paper", "package", "book"), 1.5),
    (r"optim|linear programming|convex|gradient descent|solver|constraint", ("paper", "package"), 1.4),
    (r"NLP|text|sentiment|topic model|LDA|named entity|tokeniz", ("paper", "package"), 1.4),
    (r"experiment|sample size|power analysis|sequential test|bandit|MAB", ("paper", "package"), 1.5),
]


def audience_boost(audience: Column, query: str) -> Column:
    """Factor for how an item's audience fits the query."""
    text = F.coalesce(audience, F.lit(""))
    junior, senior = text.contains("Junior-DS") | text.contains("Beginner"), text.contains("Senior-DS") | text.contains("PhD")
    out = F.lit(1.0)
    if re.search(ADVANCED, query, re.I):
        out = F.when(senior, 1.2).otherwise(out)
    if re.search(BEGINNER, query, re.I):
        out = F.when(junior, 1.25).when(senior, 0.85).otherwise(out)
    return out


def intent_factor(query: str, rules: list[tuple[str, tuple[str, ...], float]] = INTENTS, kind: str = "type") -> Column:
    """The factor of the first rule whose pattern the query matches, for items of its types."""
    for pattern, types, factor in rules:
        if re.search(pattern, query, re.I):
            return F.when(F.coalesce(F.col(kind).isin(*types), F.lit(False)), factor).otherwise(1.0)
    return F.lit(1.0)


@dataclass
class Facets:
    """Facet state: chosen values by facet, any of a facet, all facets."""

    values: dict[str, list] = field(default_factory=dict)
    year_range: tuple[int, int] | None = None

    def toggle(self, name: str, value) -> None:
        chosen = self.values.setdefault(name, [])
        chosen.remove(value) if value in chosen else chosen.append(value)

    def clear(self) -> None:
        self.values, self.year_range = {}, None

    @property
    def active(self) -> bool:
        return bool(self.year_range or any(self.values.values()))

    def condition(self, multi: tuple[str, ...] = ("audience", "topics")) -> Column:
        """Filter over item columns; those in ``multi`` are arrays."""
        tests = [F.lit(True)]
        for name, chosen in self.values.items():
            if chosen:
                tests.append(F.coalesce(F.arrays_overlap(F.col(name), F.array(*[F.lit(v) for v in chosen])) if name in multi else F.col(name).isin(chosen), F.lit(False)))
        if self.year_range:
            tests.append(F.coalesce(F.col("year").between(*self.year_range), F.lit(False)))
        return reduce(lambda a, b: a & b, tests)


def facet_counts(items: DataFrame, single: list[str], multi: list[str]) -> DataFrame:
    """``facet, value, n``: one pass that turns each item into its facet values, then one grouping."""
    one = [F.array(F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value"))) for c in single]
    label = lambda c: lambda v: F.struct(F.lit(c).alias("facet"), v.alias("value"))
    many = [F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), label(c)) for c in multi]
    rows = items.select(F.explode(F.concat(*one, *many)).alias("f")).select("f.facet", "f.value").where("value IS NOT NULL")
    return rows.groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))


def sort_results(results: DataFrame, mode: str, type_order: list[str] = ("package", "dataset", "paper", "resource", "talk", "book", "career", "community")) -> DataFrame:
    """Results by relevance, by name, or by type in a fixed order and then relevance."""
    if mode == "name":
        return results.orderBy("name", "id")
    if mode == "type":
        place = F.array_position(F.array(*[F.lit(t) for t in type_order]), F.col("type"))
        return results.orderBy(F.when(place == 0, 99).otherwise(place), F.desc("score"), "id")
    return results.orderBy(F.desc("score"), "id")


def fuzzy_names(items: DataFrame, query: str, threshold: float = 0.4) -> DataFrame:
    """Items whose name has a word within the relative edit distance of the query."""
    q = query.lower()
    near = F.array_min(F.transform(tokens(F.col("name")), lambda t: F.levenshtein(t, F.lit(q)) / F.greatest(F.length(t), F.lit(len(q)))))
    return items.select("id", "name", F.round(near, 4).alias("distance")).where(F.col("distance") <= threshold)


def search(items: DataFrame, query: str, top: int = 400, keep: int = 200, facets: Facets | None = None, filter_mode: str = "pre", semantic: DataFrame | None = None, intents: list | None = None) -> DataFrame:
    """The whole way from a query string to ordered results. ``filter_mode="post"`` filters after the top-k cut, as the
    reference does; ``"pre"`` filters before it, so a selective filter loses no results. Term statistics are those of the
    whole corpus either way: a filter never changes a score."""
    parsed = parse(query)
    text = parsed.clean
    wanted = matches(parsed) & (facets.condition() if facets else F.lit(True))
    base = items.where(wanted) if filter_mode == "pre" else items
    scored = bm25(index(items), query_terms(text))
    if filter_mode == "pre":
        scored = scored.join(base.select("id"), "id", "left_semi")
    scored = scored.orderBy(F.desc("score"), "id").limit(top)
    boosted = scored.join(base, "id").withColumn("score", F.round(exact_boost(F.col("score"), text), 9)).select("id", "score")
    fused = rrf(boosted, semantic).select("id", "score") if semantic is not None else boosted
    out = fused.join(items, "id")
    if filter_mode == "post":
        out = out.where(wanted)
    out = out.withColumn("score", F.col("score") * intent_factor(query, INTENTS if intents is None else intents))
    return out.orderBy(F.desc("score"), "id").limit(keep)

"""Text expressions: slugs, paths, URLs, snippets, classification chains (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def slug_a(name: Column, limit: int = 100) -> Column:
    """Slug for search and paper ids: runs of other characters become one dash, one dash is cut at each end."""
    dashed = F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-")
    return F.substring(F.regexp_replace(dashed, "^-|-$", ""), 1, limit)


def slug_b(name: Column) -> Column:
    """Slug for carousels: accents folded, other than word characters, blanks and dashes dropped, runs collapsed."""
    kept = F.regexp_replace(F.lower(fold_accents(name)), "[^a-z0-9_\\s-]", "")
    return F.regexp_replace(F.regexp_replace(F.trim(kept), "[\\s-]+", "-"), "^-|-$", "")


def slug_c(name: Column, limit: int = 80) -> Column:
    """Slug for image files: word characters and dashes, blanks and underscores become one dash."""
    kept = F.regexp_replace(F.lower(name), "[^a-z0-9_\\s-]", "")
    return F.substring(F.regexp_replace(F.trim(kept), "[\\s_]+", "-"), 1, limit)


def _accents() -> tuple[str, str]:
    import unicodedata

    pairs = [(chr(p), unicodedata.normalize("NFD", chr(p))[0]) for p in range(0xC0, 0x250)]
    pairs = [(a, b) for a, b in pairs if a != b and b.isascii()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def fold_accents(text: Column) -> Column:
    """Latin letters without accents, composed or decomposed; other characters outside ASCII are dropped."""
    source, target = _accents()
    return F.regexp_replace(F.translate(text, source, target), "[^\\x00-\\x7F]", "")


def item_key(name: Column) -> Column:
    """Item identity: lower case, outer spaces cut; a blank name is none."""
    return F.nullif(F.lower(F.trim(name)), F.lit(""))


def path_to_name(path: Column) -> Column:
    """Last segment of a path of two segments or more, with blanks for dashes and underscores."""
    segments = F.split(F.btrim(path, F.lit("/")), "/")
    return F.when(F.size(segments) >= 2, F.regexp_replace(F.lower(F.element_at(segments, -1)), "[-_]", " "))


def host(url: Column) -> Column:
    """Host of a url in lower case, without ``www.``; null if there is none."""
    found = F.regexp_extract(F.lower(F.trim(url)), "^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.nullif(F.regexp_replace(found, "^www\\.", ""), F.lit(""))


#: Two-level suffixes below which a registrable domain has three labels.
TWO_LEVEL = ("co.uk", "ac.uk", "org.uk", "gov.uk", "com.au", "edu.au", "co.jp", "co.in", "com.br")


def root_domain(url: Column) -> Column:
    """Registrable domain of a url."""
    labels = F.split(host(url), "\\.")
    last_two = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")
    last_three = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 2, F.lit(1)), 3), ".")
    return F.when(last_two.isin(*TWO_LEVEL), last_three).otherwise(last_two)


def domain_class(url: Column) -> Column:
    """Coarse kind of a url's host."""
    h = F.coalesce(host(url), F.lit(""))
    out = F.when(h == "", "none")
    for kind in ("github", "arxiv", "youtube", "kaggle", "medium", "substack"):
        out = out.when(h.contains(kind), kind)
    return out.otherwise("other")


def normalise_url(url: Column) -> Column:
    """A url for matching: lower case, trimmed, without scheme, ``www.`` and trailing slashes."""
    bare = F.regexp_replace(F.lower(F.trim(url)), "^https?://", "")
    return F.regexp_replace(F.regexp_replace(bare, "^www\\.", ""), "/+$", "")


def doi(text: Column) -> Column:
    """First DOI of a text or url, without trailing punctuation."""
    found = F.regexp_extract(text, "(?i)(10\\.[0-9]{4,9}/[^\\s\"<>]+)", 1)
    return F.nullif(F.regexp_replace(found, "[.,;:)]+$", ""), F.lit(""))


def github_repo(url: Column) -> Column:
    """``owner/repo`` of a GitHub url, without the suffix ``.git``."""
    return F.nullif(F.regexp_replace(F.regexp_extract(url, "(?i)github\\.com/([^/\\s]+/[^/\\s?#]+)", 1), "\\.git$", ""), F.lit(""))


def video_thumbnail(url: Column) -> Column:
    """Thumbnail address of a video page's url."""
    ident = F.regexp_extract(url, "(?:v=|youtu\\.be/|embed/)([A-Za-z0-9_-]{11})", 1)
    return F.when(ident != "", F.concat(F.lit("https://img.youtube.com/vi/"), ident, F.lit("/maxresdefault.jpg")))


def csv_field(text: Column) -> Column:
    """A CSV field, quoted only when it must be."""
    s = F.coalesce(text.cast("string"), F.lit(""))
    return F.when(s.rlike('[,"\\n]'), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def smart_truncate(text: Column, limit: int = 150) -> Column:
    """Cut at a sentence end beyond half of the limit, else at a blank beyond 70 % of it, else hard; an ellipsis marks a cut."""

    def shorten(head: Column) -> Column:
        stop = F.lit(limit) - F.instr(F.reverse(head), ".") + 1
        blank = F.lit(limit) - F.instr(F.reverse(head), " ") + 1
        by_stop = F.contains(head, F.lit(".")) & (stop > limit * 0.5)
        by_blank = F.contains(head, F.lit(" ")) & (blank > limit * 0.7)
        return F.when(by_stop, F.substring(head, F.lit(1), stop)).when(by_blank, F.concat(F.substring(head, F.lit(1), blank - 1), F.lit("..."))).otherwise(F.concat(head, F.lit("...")))

    return F.when(F.length(text) <= limit, text).otherwise(let(F.substring(text, 1, limit), shorten))


def snippet(text: Column, query: str, limit: int = 150, before: int = 40) -> Column:
    """A window around the first match of the query, or of its first matching word of more than two letters; cut at
    blanks where one is near, with an ellipsis at each cut. Without a match the text's start."""
    whole = query.lower().strip()
    words = [w for w in whole.split() if len(w) > 2]

    def find(low: Column) -> Column:
        hit = F.nullif(F.instr(low, whole), F.lit(0)) if whole else F.lit(None).cast("int")
        for word in words:
            hit = F.coalesce(hit, F.nullif(F.instr(low, word), F.lit(0)))
        return hit

    def end_cut(row: Column) -> Column:
        moved = row["moved"]
        last = F.length(moved) - F.instr(F.reverse(moved), " ") + 1
        word_cut = F.contains(moved, F.lit(" ")) & (last - 1 > F.length(moved) - 20) & (last > 1)
        return F.when(row["whole"], moved).when(word_cut, F.concat(F.substring(moved, F.lit(1), last - 1), F.lit("..."))).otherwise(F.concat(moved, F.lit("...")))

    def front_cut(row: Column) -> Column:
        window, start = row["window"], row["start"]
        shift = F.instr(window, " ")
        moved = F.when((shift > 1) & (shift <= 15), F.substring(window, shift + 1, F.length(window))).otherwise(window)
        return F.struct(F.when(start > 0, F.concat(F.lit("..."), F.ltrim(moved))).otherwise(window).alias("moved"), row["whole"].alias("whole"))

    def window(start: Column) -> Column:
        return F.struct(F.substring(text, start + 1, F.lit(limit)).alias("window"), start.alias("start"), (start + limit >= F.length(text)).alias("whole"))

    def around(hit: Column) -> Column:
        start = F.greatest(hit - 1 - before, F.lit(0))
        return F.when(hit.isNull(), smart_truncate(text, limit)).otherwise(let(let(let(start, window), front_cut), end_cut))

    return let(let(F.lower(text), find), around)


def highlight(text: Column, query: str) -> Column:
    """Text with ``<mark>`` around the whole query, or around its words of more than two letters; markup is escaped."""
    import re

    escaped = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    words = [query.strip(), *[w for w in query.split() if len(w) > 2]]
    pattern = "|".join(re.sub(r"([^\w\s])", r"\\\1", w) for w in dict.fromkeys(w for w in words if w))
    return F.regexp_replace(escaped, f"(?i)({pattern})", "<mark>$1</mark>") if pattern else escaped


def long_words(text: Column, least: int = 3) -> Column:
    """Words of at least ``least`` letters, in lower case."""
    return F.filter(F.split(F.lower(text), "\\s+"), lambda w: F.length(w) >= least)


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two texts' word sets."""
    x, y = (F.array_distinct(F.filter(F.split(F.lower(t), "\\s+"), lambda w: w != "")) for t in (a, b))
    return F.size(F.array_intersect(x, y)) / F.nullif(F.size(F.array_union(x, y)), F.lit(0))


def first_match(text: Column, rules: list[tuple[str, tuple[str, ...]]], default: str) -> Column:
    """The first rule with a keyword that the text contains; rules keep their order."""
    low = F.lower(F.coalesce(text, F.lit("")))
    out = None
    for label, keywords in rules:
        hit = low.contains(keywords[0])
        for k in keywords[1:]:
            hit = hit | low.contains(k)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(default)


def content_hash(*cols: Column) -> Column:
    """First 16 hex digits of SHA-256 over the columns; null and empty differ."""
    parts = [F.coalesce(c.cast("string"), F.lit("\u0000")) for c in cols]
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)


def embedding_text(name: Column, description: Column, category: Column, topics: Column, tags: Column, long_text: Column | None = None) -> Column:
    """Text to embed: name and a long text where there is one, else the labelled parts."""
    clean = lambda c: F.nullif(F.trim(c), F.lit(""))
    label = lambda prefix, c: F.when(clean(c).isNotNull(), F.concat(F.lit(prefix), clean(c)))
    join = lambda c: F.when(F.size(c) > 0, F.array_join(c, ", "))
    parts = F.concat_ws(". ", clean(name), clean(description), label("Category: ", category), label("Topics: ", join(topics)), label("Tags: ", join(tags)))
    return parts if long_text is None else F.when(F.length(F.trim(long_text)) > 200, F.concat_ws(". ", clean(name), clean(long_text))).otherwise(parts)

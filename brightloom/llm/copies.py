"""Records that are the same but for formatting: progressive partition refinement.

1. Byte-identical (name, url) variants are pre-aggregated with a map-side combine, so a record entered millions of
   times the same way is one row from here on.
2. Variants are grouped by cheap JVM-side invariants: the stripped lengths and letter histograms of name and url, over
   Latin, Cyrillic and Han letters without accents (equal for composed and decomposed forms). They are computed once,
   into a written table. Only classes with several members go on.
3. The costly exact key (Unicode normalisation, case folding, word order, url parts) is computed for those alone, and
   the classes are split by it.

Joins back to rows have one row per key on one side; the side with hot keys is split by AQE's skew handling.

Defined cases: null agrees with null only, also within a field (null name and url twice are copies); text that is
nothing but punctuation normalises to the empty string, which differs from null; an empty table gives no rows; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

_WORD = regex.compile(r"[\p{L}\p{N}\p{M}]+")
_INNER = regex.compile(r"[­’ʼ'`´]")
_BLANK = regex.compile(r"[\s\p{Z}\p{C}]+")


def _fold_table() -> tuple[str, str]:
    """Characters whose canonical decomposition starts with another letter, and that letter; made by rule."""
    source, target = [], []
    for point in range(0xC0, 0x2000):
        ch = chr(point)
        base = unicodedata.normalize("NFD", ch)[0]
        if base != ch and unicodedata.category(ch)[0] == "L":
            source.append(ch)
            target.append(base)
    return "".join(source), "".join(target)


def _letters(text: Column, source: str, target: str) -> Column:
    """ASCII, Cyrillic and Han letters and ASCII digits of ``text`` without case and accents."""
    folded = F.upper(F.translate(F.lower(text), source, target))  # upper case last, as it writes ß as SS
    return F.regexp_replace(folded, "[^A-Z0-9\\p{IsCyrillic}\\p{IsHan}]+", "")


def cheap_invariant(name: Column, url: Column) -> Column:
    """A 64-bit hash of stripped lengths and letter histograms; equal for all copies of a record."""
    source, target = _fold_table()
    bare = F.regexp_replace(F.regexp_replace(F.lower(url), "[\\s\\p{Z}\\p{C}]+", ""), "^https?://(www\\.)?", "")
    parts = []
    for text in (_letters(name, source, target), _letters(bare, source, target)):
        histogram = F.array_join(F.array_sort(F.split(text, "")), "")
        parts += [text.isNull(), F.coalesce(F.length(text), F.lit(-1)), F.coalesce(histogram, F.lit(""))]
    return F.xxhash64(*parts)


def name_key(name: str) -> str:
    """Words of a name in sorted order, without case and with composed accents."""
    text = unicodedata.normalize("NFC", unicodedata.normalize("NFC", name).casefold())
    return " ".join(sorted(_WORD.findall(_INNER.sub("", text))))


def url_key(url: str) -> str:
    """A url without scheme, ``www.``, trailing slash, punctuation, case and order of parameters."""
    text = _BLANK.sub("", unicodedata.normalize("NFC", unicodedata.normalize("NFC", url).casefold()))
    for prefix in ("https://", "http://", "www."):
        text = text.removeprefix(prefix)
    path, _, query = text.partition("?")
    pack = lambda s: "".join(_WORD.findall(s))
    return pack(path) + "?" + "&".join(sorted(filter(None, map(pack, query.split("&")))))


def _exact_key():
    @F.pandas_udf("string")
    def key(name: pd.Series, url: pd.Series) -> pd.Series:
        return pd.Series([f"{'-' if n is None else '+' + name_key(n)}\x1f{'-' if u is None else '+' + url_key(u)}" for n, u in zip(name, url)], dtype=object)

    return key


def classes(records: DataFrame, id_col: str = "record_id", name_col: str = "name", url_col: str = "url") -> DataFrame:
    """One row per distinct (name, url) spelling: ``name, url, keep_id, copies`` of the record it belongs to, and ``rows`` of the spelling."""
    variants = records.select(F.col(id_col).alias("rid"), F.col(name_col).alias("name"), F.col(url_col).alias("url")).groupBy("name", "url").agg(F.min("rid").alias("first_id"), F.count(F.lit(1)).alias("rows"))
    cheap = cut(variants.withColumn("h", cheap_invariant(F.col("name"), F.col("url"))), "cheap")
    sizes = cheap.groupBy("h").agg(F.count(F.lit(1)).alias("members"))
    several = cheap.join(sizes.where("members > 1").select("h"), "h", "left_semi")
    alone = cheap.join(sizes.where("members = 1").select("h"), "h", "left_semi")
    keyed = several.withColumn("key", _exact_key()(F.col("name"), F.col("url")))
    groups = keyed.groupBy("key").agg(F.min("first_id").alias("keep_id"), F.sum("rows").alias("copies"))
    refined = keyed.join(groups, "key").select("name", "url", "keep_id", "copies", "rows", "first_id")
    return refined.unionByName(alone.select("name", "url", F.col("first_id").alias("keep_id"), F.col("rows").alias("copies"), "rows", "first_id"))


def copies(records: DataFrame, id_col: str = "record_id", name_col: str = "name", url_col: str = "url") -> DataFrame:
    """``keep_id, copy_id`` for each record that is a copy of an earlier one."""
    found = classes(records, id_col, name_col, url_col).where("copies > 1").select(F.col("name").alias("n"), F.col("url").alias("u"), "keep_id")
    rows = records.select(F.col(id_col).alias("copy_id"), F.col(name_col).alias("name"), F.col(url_col).alias("url"))
    same = rows["name"].eqNullSafe(found["n"]) & rows["url"].eqNullSafe(found["u"])
    return rows.join(found, same).where(F.col("copy_id") != F.col("keep_id")).select("keep_id", "copy_id").distinct()


def unique_records(records: DataFrame, id_col: str = "record_id", name_col: str = "name", url_col: str = "url") -> DataFrame:
    """One row per record: ``record_id`` of its first copy, its name and url there, and the number of copies."""
    spelled = classes(records, id_col, name_col, url_col)
    return spelled.where("first_id = keep_id").select(F.col("keep_id").alias("record_id"), "name", "url", "copies")

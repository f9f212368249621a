"""Readers and writers of the formats around the catalog: JSON arrays, JSON lines, CSV, Markdown tables, envelopes, vectors."""

from __future__ import annotations

import struct
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def read_json_array(spark: SparkSession, path: str, schema: str, kind: str | None = None) -> DataFrame:
    """A file (or folder of files) that holds one JSON array of objects, with an optional type tag. Broken files give no rows."""
    df = spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    return df if kind is None else df.withColumn("type", F.lit(kind))


def read_catalog(spark: SparkSession, paths: dict[str, str], schemas: dict[str, str]) -> DataFrame:
    """Files of several content types as one table; fields that a type lacks are null. Missing files are skipped."""
    parts = []
    for kind, path in paths.items():
        try:
            parts.append(read_json_array(spark, path, schemas[kind], kind))
        except Exception as error:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(error):
                raise
    if not parts:
        return spark.createDataFrame([], "name string, type string")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def string_or_list(column: Column) -> Column:
    """A field that holds text or a JSON list, as comma-separated text."""
    listed = F.from_json(column, "array<string>")
    return F.when(F.ltrim(column).startswith("["), F.array_join(listed, ", ")).otherwise(column)


def read_csv(spark: SparkSession, path: str, schema: str, booleans: tuple[str, ...] = ()) -> DataFrame:
    """CSV with a header and doubled quotes; the boolean columns are false where they are empty."""
    df = spark.read.schema(schema).option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return df.withColumns({c: F.coalesce(F.col(c).cast("string").try_cast("boolean") if hasattr(Column, "try_cast") else F.col(c).cast("boolean"), F.lit(False)) for c in booleans})


def write_csv(df: DataFrame, path: str, quote_all: bool = False) -> None:
    """CSV with a header; quotes only where needed unless all are asked for."""
    df.write.mode("overwrite").option("header", True).option("quoteAll", quote_all).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def read_events(envelopes: DataFrame, most: int = 50, largest: int = 50_000) -> DataFrame:
    """Events of wire envelopes (a ``value`` column of JSON text): oversized ones are refused, the first ``most`` events of each are kept.

    Without its own time an event takes the arrival time, without a path its payload's."""
    event = "struct<t:string,ts:bigint,sid:string,p:string,d:string>"
    parsed = envelopes.where(F.length("value") <= largest).select(F.from_json("value", f"struct<v:int,events:array<{event}>>").alias("e"), *[c for c in envelopes.columns if c != "value"])
    rows = parsed.where("e.events IS NOT NULL").select(F.explode(F.slice("e.events", 1, most)).alias("x"), *[c for c in parsed.columns if c != "e"])
    arrived = F.col("received_ms") if "received_ms" in envelopes.columns else F.unix_millis(F.current_timestamp())
    return rows.where("x.t IS NOT NULL").select(F.col("x.t").alias("type"), F.col("x.sid").alias("session_id"), F.coalesce("x.p", F.get_json_object("x.d", "$.path")).alias("path"), F.coalesce("x.ts", arrived).alias("timestamp"), F.col("x.d").alias("data"))


def read_markdown_tables(lines: DataFrame) -> DataFrame:
    """``doc, section, name, url, cells`` of the table rows of Markdown lines (``doc, pos, line``); headings name the section.

    Within a document lines keep their order by ``pos``; rule rows and header rows (before a rule) are left out."""
    w = Window.partitionBy("doc").orderBy("pos")
    line = F.trim("line")
    heading = F.when(line.rlike("^#+\\s"), F.trim(F.regexp_replace(line, "^#+\\s+", "")))
    rule = line.rlike("^\\|?[\\s:|-]*-[\\s:|-]*\\|[\\s:|-]*$")
    marked = lines.withColumn("section", F.last(heading, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("rule", rule).withColumn("before_rule", F.lead("rule").over(w))
    rows = marked.where(line.startswith("|") & ~F.col("rule") & ~F.coalesce("before_rule", F.lit(False)))
    cells = F.transform(F.split(F.regexp_replace(line, "^\\||\\|$", ""), "\\|"), lambda c: F.trim(F.regexp_replace(c, "\\*\\*|`", "")))
    first = F.element_at("cells", 1)
    out = rows.withColumn("cells", cells)
    link = F.nullif(F.regexp_extract(first, "\\[([^\\]]+)\\]\\(([^)]+)\\)", 1), F.lit(""))
    return out.select("doc", "section", F.coalesce(link, first).alias("name"), F.nullif(F.regexp_extract(first, "\\[([^\\]]+)\\]\\(([^)]+)\\)", 2), F.lit("")).alias("url"), "cells")


def write_requests(items: DataFrame, path: str, custom_id: Column, body: Column) -> None:
    """JSON lines of requests with an id to join the results by."""
    items.select(F.to_json(F.struct(custom_id.alias("custom_id"), body.alias("body"))).alias("value")).write.mode("overwrite").text(path)


def read_results(spark: SparkSession, path: str, body: str) -> DataFrame:
    """``custom_id`` and the result of JSON lines; lines that can't be parsed are left out."""
    raw = spark.read.text(path).select(F.from_json("value", f"struct<custom_id:string,body:{body}>").alias("r"))
    return raw.where("r.custom_id IS NOT NULL").select("r.custom_id", "r.body.*")


def write_float_vectors(vectors: DataFrame, path: str) -> None:
    """Vectors (``id, vec``) as little-endian float32 records, one binary value a row, in Parquet."""

    def pack(batches):
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "raw": [np.asarray(v, "<f4").tobytes() for v in pdf["vec"]]})

    vectors.select("id", "vec").mapInPandas(pack, "id bigint, raw binary").write.mode("overwrite").parquet(path)


def read_float_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Vectors written by ``write_float_vectors``."""

    def unpack(batches):
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "vec": [np.frombuffer(b, "<f4").tolist() for b in pdf["raw"]]})

    return spark.read.parquet(path).mapInPandas(unpack, "id bigint, vec array<float>")


def quantized_block(vectors: np.ndarray) -> bytes:
    """The interchange form of quantised vectors: count and width, each vector's bounds, then the codes."""
    low, high = vectors.min(1), vectors.max(1)
    width = np.where(high > low, high - low, 1)
    codes = np.floor((vectors - low[:, None]) / width[:, None] * 255).astype(np.uint8)
    return struct.pack("<II", *vectors.shape) + np.stack([low, high], 1).astype("<f4").tobytes() + codes.tobytes()


def parse_quantized_block(raw: bytes) -> np.ndarray:
    """Vectors of a quantised block."""
    count, width = struct.unpack_from("<II", raw)
    bounds = np.frombuffer(raw, "<f4", count * 2, 8).reshape(count, 2)
    codes = np.frombuffer(raw, np.uint8, count * width, 8 + count * 8).reshape(count, width)
    spread = np.where(bounds[:, 1] > bounds[:, 0], bounds[:, 1] - bounds[:, 0], 1)
    return codes / 255.0 * spread[:, None] + bounds[:, :1]


def read_quantized(spark: SparkSession, path: str) -> DataFrame:
    """``file, pos, vec`` of quantised block files (each file is one block of bounded size)."""

    def unpack(batches):
        for pdf in batches:
            for name, raw in zip(pdf["path"], pdf["content"]):
                v = parse_quantized_block(bytes(raw))
                yield pd.DataFrame({"file": name, "pos": range(len(v)), "vec": v.tolist()})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(unpack, "file string, pos int, vec array<double>")


def fresh(df: DataFrame, stored_ms: str, now_ms: int, ttl_days: int = 7) -> DataFrame:
    """Cached rows that haven't outlived their time."""
    return df.where(F.col(stored_ms) > now_ms - ttl_days * 86_400_000)


def append_submissions(existing: DataFrame, incoming: DataFrame, url: str = "url") -> DataFrame:
    """Existing rows and those incoming ones whose url isn't there yet."""
    from ..operators.catalog import not_yet_listed

    return existing.unionByName(not_yet_listed(incoming, existing, url), allowMissingColumns=True)

"""Sizes of texts in tokens of a public tokenizer. The rank file's path is a parameter; all workers read it once."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the public pattern that splits text before byte-pair merges.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoder(ranks: str = RANKS):
    """The tokenizer of a rank file."""
    import tiktoken

    with open(ranks, "rb") as lines:
        table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("public", pat_str=SPLIT, mergeable_ranks=table, special_tokens={})


def token_counts(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), ranks: str = RANKS) -> DataFrame:
    """``id, n_tokens`` and the columns in ``keep``. Null and empty texts have 0 tokens; whole texts are counted. A row without id is left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(ranks).encode_ordinary
        for pdf in batches:
            sizes = [len(encode(t)) if t else 0 for t in pdf.pop("text")]
            yield pdf.assign(n_tokens=pd.Series(sizes, index=pdf.index, dtype="int64"))

    rows = documents.select(documents[id_col].alias("id"), *[documents[k].alias(f"k{i}") for i, k in enumerate(keep)], documents[text_col].alias("text")).where("id IS NOT NULL")
    out = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "text"]
    counted = rows.mapInPandas(run, ", ".join([*out, "n_tokens bigint"]))
    return counted.select("id", *[counted[f"k{i}"].alias(k) for i, k in enumerate(keep)], "n_tokens")

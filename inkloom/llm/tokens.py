"""Problem 7: ids of every text by a public tokenizer."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkloom.session import spread

#: Folder of the public vocabulary files; override by parameter or environment.
TOKENIZERS = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")

#: A vocabulary file above this size is refused rather than broadcast.
VOCABULARY_LIMIT = 64 << 20

_loaded: dict[str, object] = {}


def vocabulary(spark: SparkSession, name: str, folder: str = TOKENIZERS):
    """The vocabulary file's ending, its bytes, broadcast, and a key of them; their size is fixed by the file and checked."""
    for ending in (".tiktoken", ".model"):
        path = os.path.join(folder, name + ending)
        if os.path.exists(path):
            if os.path.getsize(path) > VOCABULARY_LIMIT:
                raise ValueError(f"{path} is larger than {VOCABULARY_LIMIT} bytes")
            with open(path, "rb") as file:
                content = file.read()
            return ending, spark.sparkContext.broadcast(content), hashlib.blake2b(content, digest_size=16).hexdigest() + ending
    raise ValueError(f"no rank file or model named {name} in {folder}")


def encoder(ending: str, data, key: str):
    """The worker's encoder of these bytes, built once per Python process."""
    if key not in _loaded:
        if ending == ".tiktoken":
            from inkloom.llm.bpe import ByteBpe

            _loaded[key] = ByteBpe(data.value)
        else:
            import sentencepiece

            _loaded[key] = sentencepiece.SentencePieceProcessor(model_proto=data.value)
    return _loaded[key]


def counts(ending: str, data, key: str, texts: list[str | None]) -> list[int]:
    tool = encoder(ending, data, key)
    if ending == ".tiktoken":
        return tool.count(texts)
    return [len(x) for x in tool.encode([t or "" for t in texts], num_threads=1)]


def encode(spark: SparkSession, text: Column, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> Column:
    """Ids of ``text`` as ``array<int>`` by a byte-level rank file.

    Special tokens have no meaning: their spelling is ordinary text. Null and
    empty texts give an empty array; any length is encoded whole, equal texts
    give equal ids.
    """
    ending, data, key = vocabulary(spark, name, folder)
    if ending != ".tiktoken":
        raise ValueError(f"{name} is no rank file")

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tool = encoder(ending, data, key)
        for texts in batches:
            yield pd.Series(tool.encode(texts.tolist()), dtype=object)

    return ids(text)


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, ids`` of every document by byte_bpe_50k."""
    documents = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return documents.select("doc_id", encode(spark, F.col("text")).alias("ids"))

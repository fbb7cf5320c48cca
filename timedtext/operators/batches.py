"""The one place for Python over rows: a user's batch function, and stand-in text vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def map_batches(df: DataFrame, fn: Callable[[list[str]], list[str]], column: str = "text", out: str = "text", on_error: str = "keep") -> DataFrame:
    """The function over batches of a text column, order kept. on_error keep: where it raises on a batch its rows are
    tried one by one, and those that fail keep their text; raise: the error ends the query."""
    schema = df.schema if out in df.columns else df.schema.add(out, "string")

    def one(text: str) -> str:
        try:
            return fn([text])[0]
        except Exception:
            if on_error != "keep":
                raise
            return text

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = pdf[column].fillna("").tolist()
            try:
                result = list(fn(texts))
                if len(result) != len(texts):
                    raise ValueError("the function must give as many texts as it gets")
            except Exception:
                if on_error != "keep":
                    raise
                result = [one(t) for t in texts]
            yield pdf.assign(**{out: result})

    return df.mapInPandas(run, schema)


def text_vectors(df: DataFrame, dim: int = 256, column: str = "text") -> DataFrame:
    """embedding: normalised counts of hashed words and word pairs. A stand-in for an encoder; not cross-lingual."""
    from pyspark.ml.feature import HashingTF, NGram, Normalizer, RegexTokenizer
    from pyspark.ml.functions import vector_to_array
    from pyspark.sql import functions as F

    words = RegexTokenizer(inputCol="__t", outputCol="__w", pattern=r"(?U)\W+").transform(df.withColumn("__t", F.coalesce(column, F.lit(""))))
    pairs = NGram(n=2, inputCol="__w", outputCol="__p").transform(words).withColumn("__all", F.concat("__w", "__p"))
    counts = HashingTF(numFeatures=dim, inputCol="__all", outputCol="__c").transform(pairs)
    unit = Normalizer(inputCol="__c", outputCol="__v").transform(counts)
    return unit.withColumn("embedding", vector_to_array("__v", "float32")).drop("__t", "__w", "__p", "__all", "__c", "__v")

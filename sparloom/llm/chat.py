"""Chat examples as token ids of a public tokenizer, with the reason where one cannot be trained on.

An example's prompt is its first two messages in a plain template, its full text
adds the answer; both are encoded, and what their ids share from the start is
ignored in the labels. Reasons come from :func:`sparloom.operators.selection.encode_reason`.

Defined results: null messages, null contents and blank answers have a reason and
no ids beyond; nothing is cut to fit, a text that is too long is left out or fatal.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType

from sparloom.functions.arrays import common_prefix, mask_prefix
from sparloom.llm.encode import TOKENIZER_DIR, VOCABULARY, encoder
from sparloom.operators.selection import encode_reason


def turn(message: Column) -> Column:
    return F.concat(F.lit("<|"), message["role"], F.lit("|>\n"), message["content"], F.lit("\n"))


def template(messages: Column) -> tuple[Column, Column]:
    """(prompt with the answer's head, full text); null where a part is null."""
    prompt = F.concat(turn(F.get(messages, F.lit(0))), turn(F.get(messages, F.lit(1))), F.lit("<|assistant|>\n"))
    return prompt, F.concat(prompt, F.get(messages, F.lit(2))["content"], F.lit("\n<|end|>"))


def ids_of(vocabulary: str):
    """A column function from texts to ids, null for null."""
    @F.pandas_udf(ArrayType(IntegerType()))
    def run(texts: pd.Series) -> pd.Series:
        own = encoder(vocabulary)
        return texts.map(lambda t: own.encode(t) if isinstance(t, str) else None)

    return run


def encoded(df: DataFrame, messages: str, max_length: int, vocabulary: str = f"{TOKENIZER_DIR}/{VOCABULARY}") -> DataFrame:
    """``df`` with reason, input_ids and labels (null where there is a reason)."""
    prompt, full = template(F.col(messages))
    ids = ids_of(vocabulary)
    rows = df.withColumn("prompt_", prompt).withColumn("full_", full)
    rows = rows.withColumn("prompt_ids_", ids("prompt_")).withColumn("full_ids_", ids("full_"))
    rows = rows.withColumn("reason", encode_reason(F.col(messages), *(F.col(c) for c in ("prompt_", "full_", "prompt_ids_", "full_ids_")), max_length))
    good = F.col("reason").isNull()
    labels = mask_prefix(F.col("full_ids_"), common_prefix(F.col("prompt_ids_"), F.col("full_ids_")))
    return rows.withColumn("input_ids", F.when(good, F.col("full_ids_"))).withColumn("labels", F.when(good, labels)).drop("prompt_", "full_", "prompt_ids_", "full_ids_")

"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import os
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..runtime import new_path, prepare, shared_dir  # noqa: F401
from ..runtime import written as materialize  # noqa: F401

#: ASCII white space: x20 and x09-x0D.
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def giving_way(df: DataFrame, *names: str) -> DataFrame:
    """df without columns that an operator adds or uses itself: on a clash of names the input's column gives way. Python workers of df's session can import the package from then on."""
    prepare(df.sparkSession)
    return df.drop(*(n for n in names if n in df.columns))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where the vocabulary lies; QUERN_TOKENIZERS names another folder."""
    folder = os.environ.get("QUERN_TOKENIZERS")
    if folder:
        return str(Path(folder) / name)
    import public_tokenizers

    return public_tokenizers.path(name)


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit words with their bits mixed (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))

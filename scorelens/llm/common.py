"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import functools
import math

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelens.session import scratch_path

#: The white space of all word and line rules here: \x20 and \x09-\x0D.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LONG = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back: cuts lineage,
    survives lost executors and keeps column pruning."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def blocks_of(rows: int, per_block: int) -> int:
    return max(1, math.ceil(rows / per_block))


def with_id(df: DataFrame, id_col: str, name: str) -> DataFrame:
    """The id as long under ``name``; a null id ranks below all others."""
    return df.withColumn(name, F.coalesce(F.col(id_col).cast("long"), F.lit(LEAST_LONG)))


def came_in(name: str):
    """The id as it came in: what ``with_id`` made of null is null again."""
    return F.when(F.col(name) != LEAST_LONG, F.col(name))


def replace_columns(df: DataFrame, new: list[str]) -> list[str]:
    """Input columns that stay when an operator adds ``new``: a clashing input column is replaced."""
    taken = {c.lower() for c in new}
    return [c for c in df.columns if c.lower() not in taken]


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores until no input column is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def guarded(operator):
    """An operator over a DataFrame whose own column names can't clash with the input's.

    Own names start with two underscores; input columns that start so are set aside under other names
    (arguments that name them too) and get their names back in the result."""

    @functools.wraps(operator)
    def run(docs: DataFrame, *args, **kwargs) -> DataFrame:
        aside = {c: free_name(docs, f"aside{c}") for c in docs.columns if c.startswith("__")}
        if not aside:
            return operator(docs, *args, **kwargs)
        name = lambda x: aside.get(x, x) if isinstance(x, str) else [name(c) for c in x] if isinstance(x, list) else x
        out = operator(docs.withColumnsRenamed(aside), *map(name, args), **{k: name(v) for k, v in kwargs.items()})
        return out.withColumnsRenamed({new: old for old, new in aside.items()})

    return run


def held_out(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo 4, is 2: rows that no classifier learns from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, element by element."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class WordHashes(dict):
    """64-bit hash of each word, remembered; forgets all beyond ``most`` words."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions starts[i], starts[i]+1, ... for lengths[i] each, concatenated."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)

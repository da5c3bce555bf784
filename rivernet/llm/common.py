"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import cut, ensure_checkpoint_dir

__all__ = ["ENDS", "WHITE", "cut", "ensure_checkpoint_dir", "let", "n_words", "running", "table", "text_of", "words_of"]

RUN = 512
WHITE = "[\\x20\\x09-\\x0D]+"
ENDS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """The text column; null counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def words_of(text: Column) -> Column:
    """Runs of characters other than the six ASCII blanks; no words give an empty array."""
    trimmed = F.btrim(text, F.lit(ENDS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WHITE))


def n_words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(ENDS))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, WHITE))).cast("long")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, add: Callable[[Column, Column], Column], kind: str = "int") -> Column:
    """Running totals of an array by an associative ``add``.

    A fold copies what it has gathered at every step; so it runs within RUN
    elements, and then over these runs, which keeps long arrays near linear.
    """
    last = lambda xs: F.get(xs, F.size(xs) - 1)
    step = lambda xs, x: F.array_append(xs, F.when(F.size(xs) == 0, x).otherwise(add(last(xs), x)))
    none = F.array().cast(f"array<{kind}>")
    cut_up = lambda xs: F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / RUN).cast("int")), lambda i: F.slice(xs, i * RUN + 1, F.lit(RUN)))
    within = lambda xs: F.transform(cut_up(xs), lambda run: F.aggregate(run, none, step))
    over = lambda runs: let(F.aggregate(F.transform(runs, last), none, step), lambda ends: F.flatten(F.transform(runs, lambda run, i: F.when(i == 0, run).otherwise(F.transform(run, lambda x: add(F.get(ends, i - 1), x))))))
    return let(values, lambda xs: F.when(F.size(xs) == 0, none).otherwise(let(within(xs), over)))

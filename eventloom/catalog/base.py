"""What the query modules share: table access and SQL fragments that state the same functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import FOLD_FROM, FOLD_TO, STOP_WORDS

Query = Callable[[SparkSession, str], DataFrame]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(column, name: str):
    """Rounded to six decimals under a name: floating sums agree between engines to that."""
    return F.round(column, 6).alias(name)


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_fold(x: str) -> str:
    return f"translate(regexp_replace({x}, '[̀-ͯ]', '', 'g'), {q(FOLD_FROM)}, {q(FOLD_TO)})"


def sql_identity(x: str) -> str:
    return f"trim(regexp_replace({sql_fold(f'coalesce({x}, {q(str())})')}, '[^a-z0-9]+', ' ', 'g'))"


def sql_tokens(x: str) -> str:
    words = ", ".join(q(w) for w in STOP_WORDS)
    return f"list_filter(string_split_regex({sql_fold(f'coalesce({x}, {q(str())})')}, '[^a-z0-9]+'), lambda t: length(t) > 2 AND t NOT IN ({words}))"

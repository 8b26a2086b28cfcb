"""Table loading, the query registry, and SQL fragments shared by the oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from groundwell.operators.search_index import IndexStore, files_tag, tag_of
from groundwell.operators.sizing import widen

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable[[Query], Query]:
        def keep(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql:
                self.oracles[f.__name__] = sql
            return f

        return keep


#: Tables whose rows are heavy: texts, pages and vectors.
WIDE = ("documents", "pages", "embeddings")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return widen(df) if name in WIDE else df


def index_store(spark: SparkSession, sf_dir: str, name: str) -> tuple[IndexStore, str]:
    """Where indexes are kept (``groundwell.index.dir``, else beside the warehouse's tables), and the tag of a table's files."""
    root = spark.conf.get("groundwell.index.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/groundwell_index"
    return IndexStore(spark, root), tag_of("v1", files_tag(spark, f"{sf_dir}/{name}.parquet"))


def norm_sql(x: str) -> str:
    """DuckDB for the normalised text of ``x``."""
    return f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"


def toks_sql(x: str) -> str:
    return f"list_filter(string_split({norm_sql(x)}, ' '), lambda y: y <> '')"


def in_list(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"

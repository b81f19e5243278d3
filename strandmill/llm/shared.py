"""Folds of ids, and graph components over link tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import smallest_reachable
from ..operators.tables import forget, free_name, hot_keys, keep_rows, spread_join, stored

__all__ = ["components", "crc_mod", "forget", "free_name", "hot_keys", "keep_rows", "spread_join", "stored"]


def crc_mod(id_col: str, modulus: int):
    """crc32 of the id's decimal text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected ``links``: (node, comp), comp the smallest node reachable.

    Every round is a written table; nothing is collected but one count.  Rounds
    go on until no label moves.  Nodes without a link are not returned; an empty
    table gives an empty table.
    """
    both = links.select(F.col(a).alias("src"), F.col(b).alias("dst")).where("src <> dst")
    both = stored(both.union(both.select("dst", "src")).distinct(), "links")
    return smallest_reachable(both).withColumnRenamed("label", "comp")

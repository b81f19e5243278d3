"""Bounded labelled samples for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import crc_mod, stored


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, most: int, id_col: str = "doc_id", text_col: str = "text", folds: int = 3, held_fold: int = 1) -> DataFrame:
    """(label, text) of at most ``most`` labelled documents outside the held-out fold.

    Labelled ids are taken in hash order; of contradicting labels of an id the
    largest counts, of several texts the first in order.  The id list is bounded
    by ``most`` and may be broadcast; rows of one id are reduced before they
    are shuffled.
    """
    ids = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (crc_mod(id_col, folds) != held_fold))
    ids = ids.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    ids = stored(ids.orderBy(F.xxhash64("id"), "id").limit(most), "labelled")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.join(F.broadcast(ids), "id").groupBy("id", "label").agg(F.min("text").alias("text")).select("label", "text")

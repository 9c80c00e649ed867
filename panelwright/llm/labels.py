"""Joining labels to documents without moving the texts where the labels are few."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import held_out

#: Up to so many labelled rows (about 100 bytes each in memory) are broadcast; beyond, both sides are dealt by doc_id.
BROADCAST_ROWS = 200_000


def training_rows(docs: DataFrame, labels: DataFrame, column: str, most: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, text, label, fold) of the documents whose label may be learned from.

    Held-out ids (crc32 of the id mod 5 is 0) are left out, and so are null labels. Several labels of one
    id count as the largest. fold is that remainder, 1 to 4.
    """
    known = labels.where(~held_out(F.col("doc_id")) & F.col(column).isNotNull() & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.max(F.col(column).cast("int")).alias("label"))
    known = known.withColumn("fold", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5).cast("int"))
    few = known.count() <= most
    return docs.select("doc_id", "text").join(F.broadcast(known) if few else known, "doc_id").select("doc_id", "text", "label", "fold")

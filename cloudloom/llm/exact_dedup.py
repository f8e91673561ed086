"""Exact dedup by a content sort, with DataFrame operations only.

Sampled splitters deal the rows out by range: by the first characters of the normalised text, then by its hash, so
that splitters stay short whatever the length of the texts. Inside a range an external sort places equal
texts side by side, where neighbours are compared in full. Copies of a text that a large share of rows carries
are dealt to several ranges by id; such pieces are merged by SHA-256 in an aggregate that combines before its shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cloudloom.llm.tables import attach, bucket_count
from cloudloom.llm.words import lower_ascii
from cloudloom.session import cut_lineage

HEAD = 64  # characters of a splitter
HOT_ROWS = 256  # rows of one text that stay in one piece
RANGE_BYTES = 32 << 20  # text behind one range


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", hot_rows: int = HOT_ROWS) -> DataFrame:
    """All columns of `docs`, with keep_id, group_size, kept and text_sha256 (of the normalised text).

    Texts are equal when identical after lower-casing A-Z; null counts as empty. The row with the smallest (or
    `keep="largest"`) id of a group stays; a null id stays only if there is no other, and of repeated rows one stays.
    No rows give no rows. Columns of `docs` named like a result are replaced.
    """
    sign = {"smallest": 1, "largest": -1}[keep]
    text = F.coalesce(F.col(f"_row.{text_col}"), F.lit(""))
    # equal texts have equal proxies, which need no look at the whole text
    proxy = F.xxhash64(F.octet_length(text), lower_ascii(F.substring(text, 1, HEAD)), lower_ascii(F.substring(text, -HEAD, HEAD)))
    rows = docs.select(F.struct("*").alias("_row")).withColumn("_proxy", proxy)
    hot = rows.groupBy("_proxy").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot_rows)
    hot = cut_lineage(hot.select("_proxy", F.ceil(F.col("_n") / hot_rows).alias("_pieces")))
    rows = attach(rows, hot, ["_proxy"]).drop("_proxy")

    ident = F.col(f"_row.{id_col}")
    best = (F.min if sign > 0 else F.max)(ident)
    whole = F.sha2(lower_ascii(text).cast("binary"), 256)
    merged = cut_lineage(
        rows.filter("_pieces IS NOT NULL").groupBy(whole.alias("_sha")).agg(best.alias("_keep"), F.count(F.lit(1)).alias("_size"))
    )

    parts = max(bucket_count(docs, text_col, RANGE_BYTES), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    head, digest = lower_ascii(F.substring(text, 1, HEAD)), F.xxhash64(lower_ascii(text))
    piece = F.when(F.col("_pieces").isNotNull(), F.pmod(F.xxhash64(ident), F.col("_pieces"))).otherwise(F.lit(-1))
    dealt = rows.select("_row", head.alias("_head"), digest.alias("_digest"), piece.alias("_piece"))
    dealt = dealt.repartitionByRange(parts, "_head", "_digest", "_piece").withColumn("_text", lower_ascii(text))
    # the range partitioning already holds what the window asks for: it sorts, and adds no exchange
    group = Window.partitionBy("_head", "_digest", "_piece", "_text")
    first = group.orderBy(ident.asc_nulls_last() if sign > 0 else ident.desc_nulls_last())
    found = dealt.select(
        "_row",
        "_piece",
        F.row_number().over(first).alias("_rank"),
        best.over(group).alias("_best"),
        F.count(F.lit(1)).over(group).alias("_count"),
        F.sha2(F.col("_text").cast("binary"), 256).alias("_sha"),
    )
    found = attach(found, merged, ["_sha"])
    in_piece = F.col("_piece") >= 0
    keep_id = F.when(in_piece, F.col("_keep")).otherwise(F.col("_best"))
    results = {
        "keep_id": keep_id,
        "group_size": F.when(in_piece, F.col("_size")).otherwise(F.col("_count")),
        # rows with one id share a piece, so of a hot group only the piece of its best id keeps one
        "kept": (F.col("_rank") == 1) & (~in_piece | ident.eqNullSafe(keep_id)),
        "text_sha256": F.col("_sha"),
    }
    own = [c for c in docs.columns if c not in results]
    return found.select(*[F.col("_row")[c].alias(c) for c in own], *[e.alias(n) for n, e in results.items()])


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The rows of `docs` that stay, with their own columns (see `exact_groups`)."""
    packed = docs.select(F.struct("*").alias("_doc"), F.col(id_col), F.col(text_col))
    return exact_groups(packed, id_col, text_col, keep).filter("kept").select("_doc.*")

"""Line dedup: lines that many documents hold stay in one of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastrum.llm.common import SPACE_CHARS, ascii_lower, salted_join, written


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of docs with the kept lines as text, and n_lines and n_dropped (long).

    A line's key is the line without ASCII white space at its ends, A-Z in lower
    case.  A key of at least min_chars code points that at least min_docs different
    ids hold loses all its lines except those of the largest id.  Keys are compared
    by 128 bits of hash.

    Null and empty texts are one empty line.  Rows that share an id count as one
    document, and the key's lines stay in each row of the largest id.  A null id
    counts as no document: such a row loses lines that others make common.  An empty
    table gives an empty one.  Columns of docs named n_lines or n_dropped are
    replaced.

    Plan: lines are exploded and hashed; pairs of key and document are made distinct
    before they are counted by key, so a line that a third of the documents hold is
    spread over all tasks until a count per task is left.  Common keys are written
    and joined with places by salted keys.  Positions to drop are gathered per
    document (bounded by its lines) and texts are put together again by position.
    """
    split = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")
    placed = docs.select(F.col(id_col).alias("_rs_id"), F.xxhash64(text_col).alias("_rs_th"), F.posexplode(split).alias("_rs_pos", "_rs_line"))
    key = ascii_lower(F.trim("_rs_line", F.lit(SPACE_CHARS)))
    placed = placed.select("_rs_id", "_rs_th", "_rs_pos", key.alias("_rs_key")).where(F.length("_rs_key") >= min_chars)
    placed = placed.select("_rs_id", "_rs_th", "_rs_pos", F.xxhash64("_rs_key").alias("_rs_h1"), F.xxhash64(F.lit(1), "_rs_key").alias("_rs_h2"))

    holders = placed.select("_rs_h1", "_rs_h2", "_rs_id").distinct().groupBy("_rs_h1", "_rs_h2")
    common = holders.agg(F.count("_rs_id").alias("_rs_n"), F.max("_rs_id").alias("_rs_keeper")).where(F.col("_rs_n") >= min_docs)
    gone = salted_join(placed, written(common), ["_rs_h1", "_rs_h2"], "_rs_n").where(~F.col("_rs_id").eqNullSafe(F.col("_rs_keeper")))
    gone = gone.groupBy("_rs_id", "_rs_th").agg(F.collect_set("_rs_pos").alias("_rs_gone"))

    rest = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    rows = docs.select(*rest).withColumn("_rs_th", F.xxhash64(text_col))
    joined = rows.join(gone.withColumnsRenamed({"_rs_th": "_rs_th2"}), rows[id_col].eqNullSafe(gone["_rs_id"]) & (rows["_rs_th"] == F.col("_rs_th2")), "left")
    count = F.size(split)
    stay = F.array_except(F.sequence(F.lit(0), count - 1), F.col("_rs_gone"))
    text = F.when(F.col("_rs_gone").isNull(), F.coalesce(F.col(text_col), F.lit(""))).otherwise(F.array_join(F.transform("_rs_order", lambda i: F.get("_rs_split", i)), "\n"))
    counted = joined.withColumns({"_rs_split": split, "_rs_order": stay, "n_lines": count.cast("long"), "n_dropped": F.when(F.col("_rs_gone").isNull(), 0).otherwise(F.size("_rs_gone")).cast("long")})
    return counted.withColumn(text_col, text).select(*rest, "n_lines", "n_dropped")

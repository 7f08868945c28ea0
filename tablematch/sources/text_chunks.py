"""Rows as text chunks and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tablematch.config import DEFAULTS, Settings
from tablematch.functions.text import row_text
from tablematch.operators.clean import data_columns


def chunk_rows(df: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """(_rid, chunk_index, chunk): each row as header line and `column: value; …` line, cut every 800 characters."""
    names = data_columns(df)
    text = F.concat(F.lit(" | ".join(names) + "\n"), row_text(names))
    size = settings.chunk_chars
    starts = F.sequence(F.lit(0), F.floor((F.length("text") - 1) / size).cast("int"))
    pieces = F.transform(starts, lambda i: F.substring(F.col("text"), i * size + 1, F.lit(size)))
    return df.select("_rid", text.alias("text")).select("_rid", F.posexplode(pieces).alias("chunk_index", "chunk"))


def join_chunks(chunks: DataFrame) -> DataFrame:
    """Whole row texts again; a row's chunks are as many as its own text needs."""
    parts = F.sort_array(F.collect_list(F.struct("chunk_index", "chunk")))
    return chunks.groupBy("_rid").agg(F.array_join(F.transform(parts, lambda x: x["chunk"]), "").alias("text"))


def chunk_records(chunks: DataFrame, columns: list[str]) -> DataFrame:
    """Row texts as records (_rid, record): the value of a column is what stands between its label and the next one,
    so values may contain the separators."""
    text = F.col("body")
    out = join_chunks(chunks).withColumn("body", F.concat(F.lit("; "), F.substring(F.col("text"), F.instr("text", "\n") + 1, F.length("text"))))
    values = []
    for i, c in enumerate(columns):
        label = f"; {c}: "
        start = F.instr(text, F.lit(label)) + len(label)
        rest = F.substring(text, start, F.length(text))
        if i + 1 < len(columns):
            end = F.instr(rest, F.lit(f"; {columns[i + 1]}: "))
            rest = F.when(end > 0, F.substring(rest, F.lit(1), end - 1)).otherwise(rest)
        values += [F.lit(c), F.when(F.instr(text, F.lit(label)) > 0, F.trim(rest))]
    return out.select("_rid", F.map_filter(F.create_map(*values), lambda k, v: v.isNotNull()).alias("record"))

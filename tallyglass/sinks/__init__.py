"""Writers: CSV with fixed columns, Parquet refresh, JSON lines, manifests, run logs, markdown."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyglass.functions.text import markdown_cell, safe_path


def _flat(df: DataFrame, columns: list[str]) -> DataFrame:
    """Just the columns, in order: nested values as JSON, booleans as 0 and 1, null as empty."""

    def value(c: str) -> Column:
        kind = df.schema[c].dataType
        if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
            return F.to_json(c)
        if isinstance(kind, T.BooleanType):
            return F.col(c).cast("int").cast("string")
        return F.col(c).cast("string")

    return df.select(*[F.coalesce(value(c), F.lit("")).alias(c) for c in columns])


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None, files: int | None = None) -> None:
    """CSV with header. The number of files is a choice: one only for results known to be small."""
    out = _flat(df, columns or df.columns)
    out = out.coalesce(files) if files else out
    out.write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def write_tables(tables: dict[str, DataFrame], root: str, append: bool = False, partition_by: dict[str, str] | None = None) -> None:
    """Tables as Parquet folders, refreshed in full unless appended."""
    for name, df in tables.items():
        writer = df.write.mode("append" if append else "overwrite")
        if partition_by and name in partition_by:
            writer = writer.partitionBy(partition_by[name])
        writer.parquet(f"{root}/{name}")


def write_counted(tables: dict[str, DataFrame], root: str, append: bool = False) -> dict[str, int]:
    """Write tables as ``write_tables`` does; the rows written of each, counted by the write itself."""
    out = {}
    for name, df in tables.items():
        seen = Observation(f"written-{name}")
        write_tables({name: df.observe(seen, F.count(F.lit(1)).alias("rows"))}, root, append)
        out[name] = seen.get["rows"]
    return out


def write_json_lines(df: DataFrame, path: str, sorted_keys: bool = True) -> None:
    out = df.select(*sorted(df.columns)) if sorted_keys else df
    out.write.mode("overwrite").json(path)


def write_per_document(df: DataFrame, path: str, document: str) -> None:
    """JSON in one folder per document, named by its path with separators as two underscores."""
    name = safe_path(F.replace(F.col(document), F.lit("/"), F.lit("__")))
    df.withColumn("document_file", name).write.mode("overwrite").partitionBy("document_file").json(path)


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, rows) of tables."""
    parts = [df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table_name"), "rows") for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def append_run(run: DataFrame, path: str) -> None:
    """A run log: rows are only ever added."""
    run.withColumn("logged_at", F.current_timestamp()).write.mode("append").parquet(path)


def vector_rows(chunks: DataFrame, embeddings: DataFrame, fields: list[str], model: str, dimensions: int) -> DataFrame:
    """(id, embedding, metadata): what a vector store is loaded with; null metadata is empty text."""
    meta = [F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f) for f in fields]
    meta += [F.lit(model).alias("embedding_model"), F.lit(str(dimensions)).alias("embedding_dimensions")]
    return chunks.join(embeddings.select("chunk_id", "embedding"), "chunk_id").select(F.col("chunk_id").alias("id"), "embedding", F.struct(*meta).alias("metadata"))


def manifest(df: DataFrame, status: str) -> DataFrame:
    """Counts of records by status."""
    return df.groupBy(status).agg(F.count("*").alias("n")).orderBy(status)


def markdown(df: DataFrame, columns: dict[str, str | Callable[[], Column] | Column], limit: int = 100, ranked: bool = True) -> str:
    """The first rows as a markdown table: header -> column. Cells are escaped; rows are numbered."""
    cells = [markdown_cell(c if isinstance(c, Column) else F.col(c) if isinstance(c, str) else c()).alias(f"c{k}") for k, c in enumerate(columns.values())]
    rows = df.select(*cells).limit(limit).collect()
    heads = ["Rank"] * ranked + list(columns)
    lines = ["| " + " | ".join(heads) + " |", "| " + " | ".join(["---"] * len(heads)) + " |"]
    for k, r in enumerate(rows, 1):
        lines.append("| " + " | ".join([str(k)] * ranked + list(r)) + " |")
    return "\n".join(lines)


def envelope(df: DataFrame, name: str = "rows", limit: int = 100) -> str:
    """JSON ``{"rows": [...], "count": n}`` of a limited result."""
    rows = [json.loads(x) for x in df.limit(limit).toJSON().collect()] if hasattr(df, "toJSON") else []
    return json.dumps({name: rows, "count": len(rows)}, ensure_ascii=False)

"""Sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.sources.schemas import conformed, violations


def write_table(df: DataFrame, root: str, name: str) -> None:
    """Overwrites a table, with its columns, types and defaults; a missing value that must be there or a repeated primary key
    aborts before anything is written."""
    df = conformed(df, name)
    if broken := {r["rule"]: r["n"] for r in violations(df, name).collect()}:  # a row a column at most
        raise ValueError(f"{name}: {broken}")
    df = df.repartitionByRange("word_id").sortWithinPartitions("word_id") if name == "words" else df
    df.write.mode("overwrite").parquet(f"{root}/{name}")


def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of rows with one key, the last by order."""
    top = df.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in df.columns if c not in keys]), F.struct(*order)).alias("row"))
    return top.select(*keys, "row.*").select(*df.columns)


def json_rows(df: DataFrame, columns: list[str], keep: list[str] | None = None) -> DataFrame:
    """One compact JSON array a row; keep: columns that stay beside it."""
    parts = [F.expr(f"substring(to_json(named_struct('v', `{c}`), map('ignoreNullFields', 'false')), 6, length(to_json(named_struct('v', `{c}`), map('ignoreNullFields', 'false'))) - 6)") for c in columns]
    return df.select(F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]")).alias("value"), *(keep or []))


def json_array_lines(df: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """(line, value): one compact JSON array of all rows' arrays, a line each, in order."""
    rows = json_rows(df.select(*columns, *[F.col(c).alias(f"_order{k}") for k, c in enumerate(order)]), columns, [f"_order{k}" for k in range(len(order))])
    return enclosed(rows, [f"_order{k}" for k in range(len(order))], "[", "]", "")


def json_map_lines(df: DataFrame, key: str, value: str) -> DataFrame:
    """(line, value): one JSON object by key, indented by two, with characters beyond ASCII as they are. Keys must not repeat
    (schemas.duplicates tells)."""
    quote = lambda c: F.expr(f"substring(to_json(named_struct('v', cast(`{c}` as string))), 6, length(to_json(named_struct('v', cast(`{c}` as string)))) - 6)")
    text = F.when(F.col(value).isNull(), F.lit("null")).otherwise(quote(value))
    return enclosed(df.select(F.concat(quote(key), F.lit(": "), text).alias("value"), F.col(key).alias("_order0")), ["_order0"], "{", "}", "  ")


def enclosed(rows: DataFrame, order: list[str], first: str, last: str, indent: str) -> DataFrame:
    """(line, value): lines by order, which no two share, between two brackets, with a comma after all but the last. `line` sorts
    them; sorted by ranges, no task holds them all."""
    by = F.struct(*order)
    comma = F.when(by == rows.agg(F.max(by)).scalar(), "").otherwise(",")
    body = rows.select(F.struct(F.lit(1).alias("part"), by.alias("by")).alias("line"), F.concat(F.lit(indent), "value", comma).alias("value"))
    kind = body.schema["line"].dataType["by"].dataType
    edge = lambda part, text: rows.sparkSession.range(1).select(F.struct(F.lit(part).alias("part"), F.lit(None).cast(kind).alias("by")).alias("line"), F.lit(text).alias("value"))
    return edge(0, first).union(body).union(edge(2, last)).orderBy("line")


def not_done(todo: DataFrame, done: DataFrame, key: str, present: DataFrame | None = None) -> DataFrame:
    """Units of work without an output; present: only those whose input is there."""
    rest = todo.join(done, key, "left_anti")
    return rest if present is None else rest.join(present, key, "left_semi")


def numbered(df: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """Adds a 1-based number within each group."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))

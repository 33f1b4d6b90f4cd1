"""Typed whitespace tables, role-annotated CSV, session and split tables."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracekit.roles import RoleSpec


@dataclass(frozen=True)
class TypedColumn:
    """One line of the side file: a numeric range, or a list of categories."""

    low: float | None = None
    high: float | None = None
    choices: tuple[str, ...] | None = None


def parse_meta(lines: Sequence[str]) -> list[TypedColumn]:
    """``C min max`` or ``D v1 v2 ...``; braces count as blanks."""
    out = []
    for line in lines:
        words = line.replace("{", " ").replace("}", " ").split()
        if not words:
            continue
        if words[0] == "C":
            out.append(TypedColumn(float(words[1]), float(words[2])))
        elif words[0] == "D":
            out.append(TypedColumn(choices=tuple(words[1:])))
        else:
            raise ValueError(f"unknown column kind {words[0]}")
    return out


def read_meta(spark: SparkSession, path: str) -> list[TypedColumn]:
    """The side file has one line per column; it is read whole on the driver."""
    return parse_meta([r.value for r in spark.read.text(path).collect()])


def _choices(spec: TypedColumn) -> Column:
    return F.array(*[F.lit(v) for v in spec.choices])


def parse_typed_rows(lines: DataFrame, meta: Sequence[TypedColumn], text: str = "value") -> DataFrame:
    """Whitespace cells to columns c0, c1, ...; categories become indices (null if unknown)."""
    keep = [c for c in lines.columns if c != text]
    cells = F.split(F.trim(F.col(text)), r"\s+")

    def cell(i, spec):
        value = F.get(cells, i)
        if spec.choices is None:
            return value.cast("double").alias(f"c{i}")
        at = F.array_position(_choices(spec), value)
        return F.when(at > 0, at - 1).cast("int").alias(f"c{i}")

    return lines.where(F.trim(F.col(text)) != "").select(*keep, *[cell(i, s) for i, s in enumerate(meta)])


def read_typed_tsv(spark: SparkSession, path: str, meta_path: str) -> tuple[DataFrame, list[TypedColumn]]:
    meta = read_meta(spark, meta_path)
    return parse_typed_rows(spark.read.text(path), meta), meta


def format_typed_rows(df: DataFrame, meta: Sequence[TypedColumn]) -> DataFrame:
    """Indices back to categories, cells joined by blanks."""
    cells = [
        F.col(f"c{i}").cast("string") if s.choices is None else F.get(_choices(s), F.col(f"c{i}").cast("int"))
        for i, s in enumerate(meta)
    ]
    others = [c for c in df.columns if c not in {f"c{i}" for i in range(len(meta))}]
    return df.select(*others, F.concat_ws(" ", *cells).alias("value"))


def write_typed_tsv(df: DataFrame, meta: Sequence[TypedColumn], path: str) -> None:
    format_typed_rows(df, meta).select("value").write.text(path)


def csv_roles(meta_json: str) -> tuple[str, list[str]]:
    """(read schema, names of the non-continuous columns) from ``{"columns": [{"name", "type"}]}``."""
    columns = json.loads(meta_json)["columns"]
    schema = ", ".join(
        f"`{c['name']}` {'double' if c['type'] == 'continuous' else 'string'}" for c in columns
    )
    return schema, [c["name"] for c in columns if c["type"] != "continuous"]


def read_csv_with_roles(spark: SparkSession, path: str, meta_path: str) -> tuple[DataFrame, list[str]]:
    text = "\n".join(r.value for r in spark.read.text(meta_path, wholetext=True).collect())
    schema, discrete = csv_roles(text)
    return spark.read.schema(schema).csv(path, header=True), discrete


def write_sessions(df: DataFrame, params: DataFrame, path: str) -> None:
    """Session tensors as nested arrays, with the fitted field parameters next to them."""
    df.write.parquet(f"{path}/sessions")
    params.write.parquet(f"{path}/fields")


def read_sessions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/sessions"), spark.read.parquet(f"{path}/fields")


def roles_from_types(df: DataFrame, target: str) -> RoleSpec:
    """Text columns are categorical, everything else numeric."""
    text = tuple(f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name != target)
    return RoleSpec(discrete=text, target=target)


def write_splits(df: DataFrame, roles: RoleSpec, path: str, split: str = "split") -> DataFrame:
    """Numeric and categorical columns and the target as one table per split; returns the info rows."""
    numeric = sorted(c for c in roles.numeric(df.columns) if c != split)
    discrete = [c for c in roles.discrete if c != roles.target]
    df.select(
        F.struct(*numeric).alias("x_num"),
        F.struct(*[F.col(c).cast("string").alias(c) for c in discrete]).alias("x_cat"),
        F.col(roles.target).alias("y"),
        split,
    ).write.partitionBy(split).parquet(path)
    return (
        df.groupBy(split)
        .agg(F.count(F.lit(1)).alias("size"))
        .withColumns({"n_num_features": F.lit(len(numeric)), "n_cat_features": F.lit(len(discrete))})
    )


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows.select("x_num.*", "x_cat.*", "y", "split")

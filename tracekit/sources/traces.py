"""Readers for signal logs and frame logs.

Each ``read_*`` is a text or CSV scan followed by the matching ``parse_*``, so
the same expressions serve files and lines that are already in a DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracekit.functions.codecs import bit_columns, can_id_bits, payload_bits

SIGNAL_SCHEMA = "name string, value string, timestamp double"


def with_line_order(df: DataFrame, name: str = "seq") -> DataFrame:
    """File order as a comparable struct: path, offset of the split, line within the split."""
    return df.select(
        "*",
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("start"),
            F.monotonically_increasing_id().alias("line"),
        ).alias(name),
    )


def parse_signal_log(lines: DataFrame, text: str = "value") -> DataFrame:
    """JSON objects {name, value, timestamp}; value stays text until it is pivoted."""
    keep = [c for c in lines.columns if c != text]
    return lines.select(*keep, F.from_json(F.col(text), SIGNAL_SCHEMA).alias("_j")).select(*keep, "_j.*")


def read_signal_log(spark: SparkSession, path) -> DataFrame:
    return with_line_order(spark.read.schema(SIGNAL_SCHEMA).json(path))


def _words(c: Column) -> Column:
    return F.split(F.trim(c), r"\s+")


def parse_frame_log(lines: DataFrame, text: str = "value") -> DataFrame:
    """``Timestamp: t ID: hhhh flag DLC: n b0 b1 ...``; blank lines are skipped."""
    keep = [c for c in lines.columns if c != text]
    parts = F.col("_p")
    dlc = F.get(parts, 6).cast("int")
    return (
        lines.where(F.trim(F.col(text)) != "")
        .select(*keep, _words(F.col(text)).alias("_p"))
        .select(
            *keep,
            F.get(parts, 1).cast("double").alias("ts"),
            F.get(parts, 3).alias("can_id"),
            dlc.alias("dlc"),
            F.slice(parts, 8, F.greatest(dlc, F.lit(0))).alias("data"),
        )
    )


def parse_candump(lines: DataFrame, text: str = "value") -> DataFrame:
    """``(ts) iface ID#DATA``; a frame without data has dlc 0 and an empty payload."""
    keep = [c for c in lines.columns if c != text]
    line = F.trim(F.col(text))
    pattern = r"^\(([0-9.]+)\)\s+\S+\s+([0-9A-Fa-f]+)#([0-9A-Fa-f]*)"
    body = F.regexp_extract(line, pattern, 3)
    dlc = F.floor(F.length(body) / 2).cast("int")
    data = F.regexp_extract_all(body, F.lit("(..)"), 1)
    return lines.where(line != "").select(
        *keep,
        F.regexp_extract(line, pattern, 1).cast("double").alias("ts"),
        F.regexp_extract(line, pattern, 2).alias("can_id"),
        dlc.alias("dlc"),
        data.alias("data"),
    )


def parse_ragged_frames(
    lines: DataFrame, text: str = "value", strict: bool = False
) -> tuple[DataFrame, DataFrame]:
    """``ts,id,dlc,b0,...[,label]`` checked line by line; returns (frames, rejected lines)."""
    keep = [c for c in lines.columns if c != text]
    cells = F.split(F.trim(F.col(text)), ",")
    dlc = F.get(cells, 2).try_cast("int")
    extra = F.size(cells) - 3 - dlc
    sound = F.coalesce((dlc >= 0) & extra.isin(0, 1), F.lit(False))
    tagged = lines.select(*keep, F.col(text).alias("_line"), cells.alias("_c"), dlc.alias("dlc"), sound.alias("_ok"))
    rejects = tagged.where(~F.col("_ok")).select(*keep, F.col("_line").alias(text))
    if strict and rejects.limit(1).count():
        raise ValueError("a line does not have 3 + dlc cells (or one more for its label)")
    frame = F.struct(
        *keep,
        F.get("_c", 0).cast("double").alias("ts"),
        F.get("_c", 1).alias("can_id"),
        "dlc",
        F.slice("_c", 4, F.greatest(F.col("dlc"), F.lit(0))).alias("data"),
        F.when(F.size("_c") == 4 + F.col("dlc"), F.element_at("_c", -1)).alias("label"),
    )
    # one struct per sound line: a filter would be pushed below the split and repeat it
    return tagged.select(F.inline(F.when(F.col("_ok"), F.array(frame)))), rejects


def align_frames(frames: DataFrame) -> DataFrame:
    """Payload array to the eight nullable columns DATA_0..DATA_7."""
    others = [c for c in frames.columns if c not in ("ts", "can_id", "dlc", "data", "label")]
    label = [F.col("label").alias("Label")] if "label" in frames.columns else []
    return frames.select(
        *others,
        F.col("ts").alias("Timestamp"),
        F.col("can_id").alias("CAN_ID"),
        F.col("dlc").alias("DLC"),
        *[F.get("data", i).alias(f"DATA_{i}") for i in range(8)],
        *label,
    )


def parse_classed_frames(rows: DataFrame) -> DataFrame:
    """Timestamp, Arbitration_ID, DLC, spaced Data, Class[, SubClass]; DLC 0 has no payload."""
    known = {"Timestamp", "Arbitration_ID", "DLC", "Data", "Class", "SubClass"}
    keep = [c for c in rows.columns if c not in known]
    dlc = F.col("DLC").cast("int")
    data = F.when(dlc > 0, F.split(F.trim("Data"), " ")).otherwise(F.array().cast("array<string>"))
    classes = [F.col(c).alias(n) for c, n in (("Class", "label"), ("SubClass", "sub_label")) if c in rows.columns]
    return rows.select(
        *keep,
        F.col("Timestamp").cast("double").alias("ts"),
        F.col("Arbitration_ID").alias("can_id"),
        dlc.alias("dlc"),
        data.alias("data"),
        *classes,
    )


def parse_signal_rows(rows: DataFrame) -> DataFrame:
    """Identifiers such as ``id5`` to integers (any leading i and d characters go)."""
    return rows.withColumn("ID", F.regexp_replace("ID", "^[id]+", "").cast("int"))


def read_frame_log(spark: SparkSession, path) -> DataFrame:
    return parse_frame_log(with_line_order(spark.read.text(path)))


def read_candump(spark: SparkSession, path) -> DataFrame:
    return parse_candump(with_line_order(spark.read.text(path)))


def read_ragged_frames(spark: SparkSession, path, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    return parse_ragged_frames(with_line_order(spark.read.text(path)), strict=strict)


def read_classed_frames(spark: SparkSession, path, sub_class: bool = False) -> DataFrame:
    """Hex cells are read as text: inference would turn ``00`` into a number."""
    schema = "Timestamp double, Arbitration_ID string, DLC int, Data string, Class string"
    schema += ", SubClass string" if sub_class else ""
    return parse_classed_frames(with_line_order(spark.read.schema(schema).csv(path, header=True)))


def read_signal_csv(spark: SparkSession, path, n_signals: int = 4) -> DataFrame:
    signals = ", ".join(f"Signal{i + 1} double" for i in range(n_signals))
    rows = spark.read.schema(f"Label int, Time double, ID string, {signals}").csv(path, header=True)
    return parse_signal_rows(with_line_order(rows))


def read_frames_dir(spark: SparkSession, root: str, reader: Callable) -> DataFrame:
    """All files under a folder of vehicles; ``vehicle`` is the sub-folder name."""
    frames = reader(spark, f"{root}/*/*")
    frames = frames[0] if isinstance(frames, tuple) else frames
    return frames.withColumn("vehicle", F.element_at(F.split("seq.file", "/"), -2))


def read_many(spark: SparkSession, paths: Sequence[str], schema: str, header: bool = True) -> DataFrame:
    return spark.read.schema(schema).csv(list(paths), header=header)


def to_bits(frames: DataFrame, id_bits: int = 11) -> DataFrame:
    """Frame table to bit arrays."""
    return frames.select(
        *[c for c in frames.columns if c not in ("can_id", "data")],
        can_id_bits("can_id", id_bits).alias("id_bits"),
        payload_bits("data").alias("data_bits"),
    )


def expand_bits(bits: DataFrame, id_bits: int = 11) -> DataFrame:
    """Bit arrays to the wide layout Timestamp, CAN_ID_0.., DLC, DATA_0.., Label."""
    ids, data = bit_columns("id_bits", "data_bits", id_bits)
    others = [c for c in bits.columns if c not in ("ts", "dlc", "id_bits", "data_bits", "label")]
    label = [F.col("label").alias("Label")] if "label" in bits.columns else []
    return bits.select(*others, F.col("ts").alias("Timestamp"), *ids, F.col("dlc").alias("DLC"), *data, *label)


def write_bits(bits: DataFrame, path: str, id_bits: int = 11) -> None:
    expand_bits(bits, id_bits).write.csv(path, header=True)


def convert_tree(
    spark: SparkSession, src: str, dst: str, reader: Callable, transform: Callable = lambda d: d
) -> None:
    """One read over src/<dataset>/<file>, one output folder per dataset and input file."""
    frames = reader(spark, f"{src}/*/*")
    frames = frames[0] if isinstance(frames, tuple) else frames
    bits = F.split("seq.file", "/")
    tagged = frames.select(
        *[c for c in frames.columns if c != "seq"],
        F.element_at(bits, -2).alias("dataset"),
        F.element_at(bits, -1).alias("source_file"),
    )
    transform(tagged).write.partitionBy("dataset", "source_file").parquet(dst)

"""Tables from CSV of any usual delimiter, ARFF and Parquet; a synthetic source; CSV sinks."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trivane.config import DataConfig
from trivane.operators.encoding import alphabetical_codes
from trivane.operators.labels import binarize_continuous, binarize_existing, clean

DELIMITERS = (",", ";", "\t", "|")


def sniff_delimiter(spark: SparkSession, path: str, lines: int = 5) -> str:
    """The delimiter that the first lines hold equally often and most; ';' if none."""
    head = [r.value for r in spark.read.text(path).limit(lines).collect() if r.value]
    best = (0, ";")
    for d in DELIMITERS:
        n = [x.count(d) for x in head]
        if n and n[0] and len(set(n)) == 1 and n[0] > best[0]:
            best = (n[0], d)
    return best[1]


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """CSV with a header. Give the schema for large inputs: inferring it reads the file twice."""
    reader = spark.read.option("header", True).option("sep", sniff_delimiter(spark, path))
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


_ATTRIBUTE = re.compile(r"@attribute\s+('[^']*'|\"[^\"]*\"|\S+)\s+(.*)", re.I)


def arff_schema(header: list[str]) -> T.StructType:
    out = []
    for line in header:
        if m := _ATTRIBUTE.match(line.strip()):
            kind = m[2].strip().lower()
            numeric = kind.startswith(("numeric", "real", "integer"))
            out.append(T.StructField(m[1].strip("'\""), T.DoubleType() if numeric else T.StringType()))
    return T.StructType(out)


def read_arff(spark: SparkSession, path: str, rows: str | None = None, header_lines: int = 10_000) -> DataFrame:
    """Dense ARFF: the header is read on the driver, the rows by tasks. '?' is null, quotes around nominal values go.

    ``rows`` is where the rows are if not behind the header in the same file. A header of more than
    ``header_lines`` lines is an error.
    """
    lines = spark.read.text(path)
    header = []
    for r in lines.limit(header_lines).toLocalIterator():
        header.append(r.value)
        if r.value.strip().lower().startswith("@data"):
            break
    else:
        raise ValueError(f"no @data in the first {header_lines} lines of {path}")
    lines = spark.read.text(rows) if rows else lines
    schema = arff_schema(header)
    texts = ", ".join(f"`{f.name}` string" for f in schema.fields)
    options = {"quote": "'", "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}
    data = lines.where(~F.trim("value").rlike(r"^(@|%|$)"))
    parsed = data.select(F.from_csv("value", texts, options).alias("r")).select("r.*")
    value = lambda f: F.when(F.col(f"`{f.name}`") != "?", F.col(f"`{f.name}`"))
    return parsed.select(*[(value(f).try_cast("double") if isinstance(f.dataType, T.DoubleType) else value(f)).alias(f.name) for f in schema.fields])


def load_table(spark: SparkSession, data: DataConfig) -> DataFrame:
    """Read by extension, make the label, code texts alphabetically, and drop rows with missing or infinite features."""
    path = data.data_path
    read = {"arff": read_arff, "parquet": lambda s, p: s.read.parquet(p)}.get(path.rsplit(".", 1)[-1].lower(), read_csv)
    df = read(spark, path)
    return prepare(df, data)


def prepare(df: DataFrame, data: DataConfig) -> DataFrame:
    if data.continuous_label:
        df = binarize_continuous(df, data.continuous_label, data.threshold, data.threshold_op)
    else:
        column = data.label_col or next((c for c in ("label", "class", "target", "y") if c in df.columns), df.columns[-1])
        df = binarize_existing(df, column, data.positive_label)
        df = df if column == "label" else df.drop(column)
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    df = alphabetical_codes(df, texts)
    return clean(df, [c for c in df.columns if c != "label"])


def synthetic(spark: SparkSession, rows: int = 12_000, features: int = 32, informative: int = 8, seed: int = 42, partitions: int = 8) -> DataFrame:
    """row_id, feat_00, ..., label: normal features, a label that the first ``informative`` of them explain."""
    df = spark.range(0, rows, 1, partitions).withColumnRenamed("id", "row_id")
    df = df.withColumns({f"feat_{i:02d}": F.randn(seed + i) for i in range(features)})
    total = sum((F.col(f"feat_{i:02d}") * (1.0 if i % 2 else -1.0) for i in range(informative)), F.lit(0.0))
    return df.withColumn("label", (total + F.randn(seed + features) > 0).cast("int"))


def synthetic_by_key(df: DataFrame, key: str, features: int = 32, informative: int = 8) -> DataFrame:
    """key, feat_00, ..., label for each row of a table: features uniform in [-1, 1), the label explained by the first ``informative`` and noise. MD5 of key and number draws them, so they stay with the key."""
    draw = lambda i: F.conv(F.substring(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(i)))), 1, 8), 16, 10).cast("long") / 2147483648.0 - 1
    out = df.select(key, *[draw(i).alias(f"feat_{i:02d}") for i in range(features)], draw(features).alias("__noise"))
    total = sum((F.col(f"feat_{i:02d}") * (1.0 if i % 2 else -1.0) for i in range(min(informative, features))), F.lit(0.0))
    return out.withColumn("label", (total + F.col("__noise") > 0).cast("int")).drop("__noise")


def write_csv(df: DataFrame, path: str, single: bool = True) -> None:
    """CSV with a header; ``single`` for the small result tables of a run."""
    (df.coalesce(1) if single else df).write.mode("overwrite").option("header", True).csv(path)

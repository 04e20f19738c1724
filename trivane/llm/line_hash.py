"""Exact repeats of paragraphs, lines or the sentences of lines across documents, by hash.

Units are normalised and hashed; the earliest occurrence of each digest in
(document, start) order stays, the others go. Units travel as digests, and only
those whose digest occurs twice are joined back. A passage that begins and ends inside
lines has no whole line of its own, but it has whole sentences.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trivane.llm.wordhash import text_chunks

_SPACE = re.compile(r"[ \t\r\x0b\x0c\n]+")
_STOP = re.compile(r"[.!?][ \t]+")
_PARAGRAPH = re.compile(r"\n(?:[ \t\r\x0b\x0c]*\n)+")


def normalise(unit: str) -> str:
    """Lower case, white space trimmed and each run of it one space."""
    return _SPACE.sub(" ", unit).strip(" ").lower()


def split_units(text: str, unit: str = "line") -> Iterator[tuple[int, int]]:
    """(start, end) in code points; the line ends that separate units belong to none.

    A sentence ends with the white space that follows its stop, or with its line.
    """
    start = 0
    if unit == "paragraph":
        for m in _PARAGRAPH.finditer(text):
            yield start, m.start()
            start = m.end()
        yield start, len(text)
        return
    for part in text.split("\n"):
        end = start + len(part)
        if unit == "sentence":
            at = start
            for m in _STOP.finditer(part):
                yield at, start + m.end()
                at = start + m.end()
            if at < end or at == start:
                yield at, end
        else:
            yield start, end
        start = end + 1


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with __row: the id and a hash of the text, which tells texts under one id apart."""
    return docs.withColumn("__row", F.struct(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("hash")))


def unit_spans(docs: DataFrame, id_col: str, text_col: str, unit: str, min_words: int) -> DataFrame:
    """row struct (id, hash of the text), start long, end long, digest binary, of each unit of min_words words or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, start, end, digest = [], [], [], []
            for lo, _, texts in text_chunks(batch.column(1)):
                for i, text in enumerate(texts, lo):
                    for a, b in split_units(text or "", unit):
                        form = normalise(text[a:b]) if b > a else ""
                        if form and form.count(" ") + 1 >= min_words:
                            row.append(i)
                            start.append(a)
                            end.append(b)
                            digest.append(hashlib.md5(form.encode("utf-8", "surrogatepass")).digest())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(digest, pa.binary())], names=["row", "start", "end", "digest"])

    read = _keyed(docs, id_col, text_col).select(F.col("__row").alias("row"), F.col(text_col).alias("__text"))
    schema = T.StructType([T.StructField("row", read.schema["row"].dataType), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("digest", T.BinaryType())])
    return read.mapInArrow(run, schema)


def repeated_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "line", min_words: int = 5) -> DataFrame:
    """row struct (id, hash of the text), start, end of every unit that is not the earliest of its digest.

    The digest of a hot unit is one row after the map-side aggregation, so the first
    occurrences are a small table; the join back only meets repeated digests, and
    a skewed one can be split, as its other side is one row. Ranks are (id, hash of the text, start); a null id
    comes first. Rows that repeat an id and its text are one document.
    """
    units = unit_spans(docs, id_col, text_col, unit, min_words)
    first = units.groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct("row", "start")).alias("first")).where("n > 1").drop("n")
    hit = units.join(first, "digest")
    return hit.where(~(F.col("row").eqNullSafe(F.col("first.row")) & (F.col("start") == F.col("first.start")))).select("row", "start", "end")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "line", min_words: int = 5) -> DataFrame:
    """``docs`` with spans array<struct<start, end>> (what goes, in order, original offsets) and kept_text string.

    unit is paragraph, line or sentence. A removed line or paragraph goes with the line end that follows it (or, for the
    last one, with the one before it); a sentence goes alone, and its line stays, if only as an empty one.
    Null texts give an empty kept_text; empty texts, short units and
    texts without repeats stay as they are; an empty table gives no rows. Rows that share an id but not a text lose
    their own repeats only. Columns of ``docs`` named spans or kept_text are replaced. A very long text is
    cut in all its units, which travel as digests.
    """
    spans = repeated_units(docs, id_col, text_col, unit, min_words).groupBy(F.col("row.id").alias("__id"), F.col("row.hash").alias("__hash")).agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"))
    rest = [c for c in docs.columns if c not in ("spans", "kept_text")]
    joined = _keyed(docs.select(*rest), id_col, text_col)
    joined = joined.join(spans, F.col("__row.id").eqNullSafe(F.col("__id")) & (F.col("__row.hash") == F.col("__hash")), "left").drop("__row", "__id", "__hash")
    joined = joined.withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<start: bigint, end: bigint>>")))
    text, with_end = F.coalesce(F.col(text_col), F.lit("")), unit != "sentence"

    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([cut_text(t, s, with_end) for t, s in zip(texts, spans, strict=True)], dtype=object)

    cut_udf = F.pandas_udf(cut, "string")
    return joined.withColumn("kept_text", F.when(F.size("spans") == 0, text).otherwise(cut_udf(text, F.col("spans"))))


def cut_text(text: str, spans, with_end: bool = True) -> str:
    """``text`` without the spans, each taken with one line end if with_end."""
    out, at = [], 0
    for span in spans:
        out.append(text[at : span["start"]])
        at = max(at, span["end"] + with_end)
    kept = "".join([*out, text[at:]])
    ends = with_end and len(spans) and spans[len(spans) - 1]["end"] == len(text)
    return kept[:-1] if ends and kept.endswith("\n") else kept

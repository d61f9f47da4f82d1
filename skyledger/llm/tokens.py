"""Encoding of the whole corpus by a public byte-level BPE vocabulary."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm.bpe import encoder, vocabulary_path


MARK_WORDS = 1 << 17  # of 64 bits each: bounds what is broadcast to about 2 MB, whatever the corpus


def unique_documents(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """`df` with one row per key; of rows with one key the least by the remaining columns in their order counts.

    Only keys are counted. The repeated ones set bits in a table of at most `MARK_WORDS` rows, which
    goes to every executor: a row whose bit is not set is certainly the only one and stays where it
    is; the others (repeated, or sharing a bit with a repeated key) are settled by an aggregation.
    """
    rest = [c for c in df.columns if c != key]
    if not rest:
        return df.distinct()
    word = F.expr(f"pmod(shiftright(xxhash64(`{key}`), 6), {MARK_WORDS})")
    bit = F.expr(f"shiftleft(1L, cast(xxhash64(`{key}`) & 63 as int))")
    again = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    marks = again.groupBy(word.alias("_word")).agg(F.bit_or(bit).alias("_bits"))
    x = df.withColumn("_at", word).join(F.broadcast(marks), F.col("_at") == F.col("_word"), "left")
    marked = F.coalesce(F.col("_bits").bitwiseAND(bit) != 0, F.lit(False))
    once = x.where(~marked).select(*df.columns)
    settled = x.where(marked).groupBy(key).agg(F.min(F.struct(*rest)).alias("_r")).select(key, "_r.*")
    return once.unionByName(settled)


def token_ids(documents: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids): the ids of each text without special tokens.

    Null and empty texts give the empty list; spellings of special tokens are ordinary text. Rows
    with a null doc_id are left out, repeated doc_ids come once, an empty table gives no rows;
    other columns are not read. Texts of any length are encoded whole. No text moves but those of repeated ids.
    """
    path = path or vocabulary_path()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            ids = [enc.encode(t.as_py()) for t in b.column(1)]
            offsets = np.zeros(len(ids) + 1, dtype=np.int32)
            np.cumsum([len(x) for x in ids], out=offsets[1:])
            flat = np.fromiter((i for x in ids for i in x), dtype=np.int32, count=int(offsets[-1]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["doc_id", "ids"])

    docs = unique_documents(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null"))
    return docs.mapInArrow(encode, "doc_id bigint, ids array<int>")


def token_counts(documents: DataFrame, path: str | None = None, carry: list[str] | None = None) -> DataFrame:
    """(doc_id, carry..., n_tokens): the size of each text in tokens; 0 for null and empty texts."""
    path = path or vocabulary_path()
    carry = carry or []
    kept = [f for f in documents.schema.fields if f.name in carry]
    schema = "doc_id bigint, " + "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept) + "n_tokens bigint"
    names = ["doc_id", *[f.name for f in kept], "n_tokens"]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            n = pa.array([len(enc.encode(t.as_py())) for t in b.column(b.num_columns - 1)], pa.int64())
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(b.num_columns - 1)], n], names)

    docs = unique_documents(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), *[f.name for f in kept], F.col("text").cast("string").alias("text")).where("doc_id is not null"))
    return docs.mapInArrow(measure, schema)

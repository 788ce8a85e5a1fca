"""Token counts of whole texts, huge ones in overlapping chunks.

A text of up to `chunk_chars` is encoded in one go. A longer one is cut into
chunks that overlap, which Spark spreads over the cluster. Each chunk is
encoded with offsets; a splice point is an offset in the overlap at which both
neighbours' encodings start a token just after white space. Neither vocabulary
joins across white space that way, so the encodings agree on both sides of the
point and the chunks' counts add up exactly. Texts with an overlap that has no
such point (long runs without white space) come again with chunks and overlaps
`WIDEN` times as large, and in the end whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, id_text, slices, stored
from .encoder import encoder

WIDEN = 8
#: Splice candidates that a chunk reports for each of its two overlaps; if
#: neighbours share none of them, the text is widened.
CANDIDATES = 16
COUNTS = "doc_id long, n_bytes long, n_tokens long"
CHUNKS = "doc_id long, h long, n_bytes long, k int, chunks int, start long, overlap int, text string"
PART = "struct<at:bigint,n:bigint>"
ENCODED = f"doc_id long, h long, n_bytes long, k int, chunks int, n_tokens long, left array<{PART}>, right array<{PART}>"


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = 32_768, overlap_chars: int = 512) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_tokens, over_limit.

    Counts are those of the tokenizers library without added special tokens.
    Null texts count as empty (0 bytes, 0 tokens); repeated rows and ids give a
    row each; a null id stays null; no rows give none; other columns are left out.
    """
    rows = id_text(docs, id_col, text_col)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        for batch in slices(batches):
            text = batch.column(1)
            n = own.encode(text, counts_only=True)[1]
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.binary_length(text).cast(pa.int64()), pa.array(n)], names=["doc_id", "n_bytes", "n_tokens"])

    if not encoder(tokenizer).proven:  # a splice isn't proven either
        return rows.mapInArrow(count, COUNTS).withColumn("over_limit", F.col("n_tokens") > limit)
    small = rows.where(F.length("text") <= chunk_chars).mapInArrow(count, COUNTS)
    huge = stored(rows.where(F.length("text") > chunk_chars).withColumn("h", F.xxhash64("text")))  # read again by each widening
    counted = small.unionByName(count_huge(huge, tokenizer, chunk_chars, overlap_chars))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def count_huge(huge: DataFrame, tokenizer: str, chunk_chars: int, overlap_chars: int) -> DataFrame:
    """COUNTS of (doc_id, text, h) rows, by chunks until all of them align."""
    done = []
    while True:
        found = cut(splice(encoded_chunks(huge, tokenizer, chunk_chars, overlap_chars)))
        done.append(found.where("aligned"))
        failed = found.where(~F.col("aligned")).select("doc_id", "h")
        if failed.isEmpty():
            break
        huge = huge.join(failed.withColumnRenamed("doc_id", "d").withColumnRenamed("h", "g"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g")), "left_semi")
        chunk_chars, overlap_chars = chunk_chars * WIDEN, overlap_chars * WIDEN
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    # a repeated row was counted once and comes back as often as it was there
    return out.select(F.explode(F.sequence(F.lit(1), "copies")), "doc_id", "n_bytes", "n_tokens").drop("col")


def encoded_chunks(huge: DataFrame, tokenizer: str, chunk_chars: int, overlap_chars: int) -> DataFrame:
    """A row per chunk with its token count and splice candidates."""

    def chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for doc, text, h in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "h")), strict=True):
                n, size = -(-len(text) // chunk_chars), len(text.encode())
                for k in range(n):
                    start = k * chunk_chars
                    row = {"doc_id": doc, "h": h, "n_bytes": size, "k": k, "chunks": n, "start": start, "overlap": overlap_chars, "text": text[start : start + chunk_chars + overlap_chars]}
                    yield pa.RecordBatch.from_pylist([row], schema=CHUNK_SCHEMA)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = encoder(tokenizer).library
        for batch in slices(batches):
            out = []
            for row in batch.to_pylist():
                text, start, overlap = row.pop("text"), row.pop("start"), row.pop("overlap")
                got = library.encode(text, add_special_tokens=False)
                at = [a for a, _ in got.offsets]
                row["n_tokens"] = len(at)
                row["left"] = candidates(text, at, start, 0, overlap) if row["k"] else []
                row["right"] = candidates(text, at, start, chunk_chars, chunk_chars + overlap) if row["k"] + 1 < row["chunks"] else []
                out.append(row)
            yield pa.RecordBatch.from_pylist(out, schema=ENCODED_SCHEMA)

    rows = huge.select("doc_id", "text", "h").mapInArrow(chunk, CHUNKS)
    return rows.repartition(F.xxhash64("doc_id", "h", "k")).mapInArrow(encode, ENCODED)


def candidates(text: str, at: list[int], start: int, lo: int, hi: int) -> list[dict]:
    """Token starts in text[lo:hi] that white space precedes, as offsets in the whole text, with the tokens before each."""
    out = []
    for n, a in enumerate(at):
        if a >= hi or len(out) == CANDIDATES:
            break
        # a token may carry its blank in front (byte level) or start after it
        if a > lo and (text[a - 1] in " \n\t" or (text[a] == " " and not text[a - 1].isspace())) and not text[a : a + 2].isspace() and at[n - 1] < a:
            out.append({"at": start + a, "n": n})
    return out


def splice(chunks: DataFrame) -> DataFrame:
    """(doc_id, h, n_bytes, n_tokens, copies, aligned) of encoded chunks."""
    once = chunks.groupBy("doc_id", "h", "k").agg(*(F.first(c).alias(c) for c in ("n_bytes", "chunks", "n_tokens", "left", "right")), F.count("*").alias("copies"))
    # a window holds one text's chunks: as many as its length over chunk_chars
    after = F.lead("left").over(Window.partitionBy("doc_id", "h").orderBy("k"))
    both = once.withColumn("after", after).withColumn("own", F.expr("try_element_at(filter(right, r -> exists(after, x -> x.at = r.at)), 1)"))
    both = both.withColumn("theirs", F.expr("try_element_at(filter(after, x -> x.at = own.at), 1)"))
    last = F.col("k") == F.col("chunks") - 1
    part = F.when(last, F.col("n_tokens")).otherwise(F.col("own.n") - F.col("theirs.n"))
    return both.groupBy("doc_id", "h").agg(F.first("n_bytes").alias("n_bytes"), F.sum(part).alias("n_tokens"), F.max("copies").alias("copies"), F.bool_and(last | F.col("own").isNotNull()).alias("aligned"))


CHUNK_SCHEMA = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("n_bytes", pa.int64()), ("k", pa.int32()), ("chunks", pa.int32()), ("start", pa.int64()), ("overlap", pa.int32()), ("text", pa.string())])
_part = pa.list_(pa.struct([("at", pa.int64()), ("n", pa.int64())]))
ENCODED_SCHEMA = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("n_bytes", pa.int64()), ("k", pa.int32()), ("chunks", pa.int32()), ("n_tokens", pa.int64()), ("left", _part), ("right", _part)])

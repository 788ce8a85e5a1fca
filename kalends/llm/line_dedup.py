"""Fuzzy line dedup: MinHash signatures, banding, exact Jaccard, union-find.

A line is a \\n-separated part of a text, lower-cased and with its white space
collapsed; lines that are then empty, or under `min_chars` characters, are left
alone. Equal lines are one node from the start. A node's character shingles
(of a line shorter than SHINGLE, the line itself) are hashed once; one-permutation
MinHash keeps the least hash of each of BANDS * ROWS bins, an empty bin taking
that of another, and each band of ROWS bins is a bucket key. Nodes of a bucket
are compared by exact Jaccard similarity of their shingle sets until no bucket
holds an uncompared pair of different components; of each component the first
occurrence by document and line stays.

Nodes are 64-bit hashes of lines: two different lines share one with a chance
of n * n / 3.7e19 for n lines. The texts are read once for signatures, which
are a table in the shared folder, once for the lines that share a band with
others, and once for the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, Likeness, bucket_components, private, shared_keys, slices, stored
from .token_files import mix

SHINGLE, BANDS, ROWS, THRESHOLD, MIN_CHARS, BLOCK = 8, 12, 4, 0.8, 1, 100
#: By attempt, the bin that each empty bin turns to; each has an order of its own, so that the rows of a band stay independent.
DONORS = np.random.default_rng(5).permuted(np.tile(np.arange(BANDS * ROWS), (BANDS * ROWS, 1)), axis=1).T
#: Lines whose signatures a task remembers to have given; the store is emptied beyond it, which bounds memory.
SEEN = 500_000
FOUND = "doc_id long, t long, line int, h long, size long, keys array<long>"


def normal(lines: pa.Array) -> pa.Array:
    """Lower case, white space collapsed to one blank and none at the ends."""
    lower = pc.utf8_lower(lines)
    odd = pc.match_substring(lower, "  ")
    for blank in "\t\x0b\f\r":
        odd = pc.or_(odd, pc.match_substring(lower, blank))
    if pc.any(odd).as_py():
        lower = pc.replace_with_mask(lower, odd, pc.replace_substring_regex(lower.filter(odd), r"[\t\x0B\f\r ]+", " "))
    return pc.utf8_trim(lower, " ")


def padded(line: str) -> str:
    """A line of SHINGLE characters at least; lines hold no line break themselves."""
    return line.ljust(SHINGLE, "\n")


def shingle_hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all lines' shingles in a row, the line of each); lines have SHINGLE characters at least."""
    h = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    lengths = np.array([len(x) for x in lines])
    with np.errstate(over="ignore"):
        base, span = np.uint64(0x9E3779B97F4A7C15), 1
        while span < SHINGLE:  # hashes of 2, 4 and 8 characters from those of half as many
            h = h[:-span] * base + h[span:]
            base, span = base * base, span * 2
    ends = lengths.cumsum()
    inside = np.ones(len(h), bool)
    for k in range(1, SHINGLE):
        inside[ends[:-1] - k] = False
    return mix(h[inside], 5), np.repeat(np.arange(len(lines)), lengths - SHINGLE + 1)


def signatures(lines: list[str]) -> np.ndarray:
    """Band keys, a row for each line; in blocks whose arrays stay in the processor's cache."""
    out = np.empty((len(lines), BANDS), np.int64)
    for k in range(0, len(lines), BLOCK):
        some = lines[k : k + BLOCK]
        values = least_of_bins(*shingle_hashes(some), len(some))
        key = np.broadcast_to(mix(np.arange(BANDS, dtype=np.uint64), 6), (len(some), BANDS))
        for r in range(ROWS):
            key = mix(key ^ values[:, r::ROWS], 7)
        out[k : k + BLOCK] = key.view(np.int64)
    return out


def least_of_bins(h: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """One-permutation MinHash: the least hash of each bin; an empty bin takes that of the first full one among its own donors."""
    bins = BANDS * ROWS
    none = np.uint64(2**64 - 1)
    least = np.full(n * bins, none, np.uint64)
    np.minimum.at(least, owner * bins + ((h >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64), h)
    least = least.reshape(n, bins)
    some = np.flatnonzero((least == none).any(axis=1))
    if len(some):
        full = least[some]
        filled = full.copy()
        for k in range(bins):  # of bins; each has the donors of its row, in order
            empty = filled == none
            if not empty.any():
                break
            filled = np.where(empty, full[:, DONORS[k]], filled)
        least[some] = filled
    return least


def shingles(line: str) -> set[str]:
    line = padded(line)
    return {line[i : i + SHINGLE] for i in range(len(line) - SHINGLE + 1)}


def numbered_shingles(line: str) -> np.ndarray | set[str]:
    """A line's distinct shingles: of characters of one byte each as whole numbers in order, of others as texts. Both are exact."""
    try:
        x = np.frombuffer(padded(line).encode("latin-1"), np.uint8).astype(np.uint64)
    except UnicodeEncodeError:
        return shingles(line)
    span = 1
    while span < SHINGLE:  # numbers of 2, 4 and 8 characters from those of half as many
        x = x[:-span] << np.uint64(8 * span) | x[span:]
        span *= 2
    x.sort()
    first = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=first[1:])
    return x[first]


def texts(x: np.ndarray | set[str]) -> set[str]:
    """The shingles of `numbered_shingles` as texts."""
    if isinstance(x, set):
        return x
    whole = x.astype(">u8").tobytes().decode("latin-1")
    return {whole[i : i + SHINGLE] for i in range(0, len(whole), SHINGLE)}


def features(lines: list[str]) -> list[np.ndarray]:
    """Each line's distinct shingles, hashed."""
    h, owner = shingle_hashes([padded(x) for x in lines])
    return [np.unique(x) for x in np.split(h, np.searchsorted(owner, np.arange(1, len(lines))))]


def jaccard(x: set[str], y: set[str], threshold: float = 0.0) -> float:
    """The similarity of two sets; 0 where their sizes alone keep it under the threshold."""
    if min(len(x), len(y)) < threshold * max(len(x), len(y)):
        return 0.0
    both = len(x & y)
    return both / (len(x) + len(y) - both)


def similarity(x: np.ndarray | set[str], y: np.ndarray | set[str], threshold: float = 0.0) -> float:
    """`jaccard` of the values of `numbered_shingles`."""
    if isinstance(x, set) or isinstance(y, set):
        return jaccard(texts(x), texts(y), threshold)
    if min(len(x), len(y)) < threshold * max(len(x), len(y)):
        return 0.0
    every = np.concatenate((x, y))
    every.sort()
    both = int(np.count_nonzero(every[1:] == every[:-1]))
    return both / (len(x) + len(y) - both)


def line_table(rows: DataFrame, min_chars: int) -> DataFrame:
    """A row per line of rows (doc_id, text, t): its place, node h and length; band keys where a task meets a node first."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in slices(batches):
            parts = pc.split_pattern(batch.column("text"), "\n")
            counts = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.repeat(np.arange(batch.num_rows), counts)
            line = np.arange(len(at)) - np.repeat(counts.cumsum() - counts, counts)
            text = normal(parts.flatten())
            size = pc.utf8_length(text).to_numpy(zero_copy_only=False)
            keep = np.flatnonzero(size >= max(1, min_chars))
            text = text.take(pa.array(keep))
            h = np.array([xxhash.xxh64_intdigest(x) for x in text.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()], np.uint64).view(np.int64)
            if len(seen) > SEEN:
                seen.clear()
            fresh = [k for k, x in enumerate(h.tolist()) if x not in seen and not seen.add(x)]
            keys = signatures([padded(x) for x in text.take(pa.array(fresh, pa.int64())).to_numpy(zero_copy_only=False).tolist()])
            ends = np.zeros(len(keep) + 1, np.int32)
            ends[np.array(fresh, np.int64) + 1] = BANDS
            new = np.zeros(len(keep), bool)
            new[fresh] = True
            lists = pa.ListArray.from_arrays(pa.array(ends.cumsum(dtype=np.int32)), pa.array(keys.reshape(-1)), mask=pa.array(~new))
            places = [batch.column(c).take(pa.array(at[keep])) for c in ("doc_id", "t")]
            yield pa.RecordBatch.from_arrays([*places, pa.array(line[keep].astype(np.int32)), pa.array(h), pa.array(size[keep].astype(np.int64)), lists], names=["doc_id", "t", "line", "h", "size", "keys"])

    return stored(rows.mapInArrow(read, FOUND))


def linked(rows: DataFrame, table: DataFrame, places: DataFrame, threshold: float) -> DataFrame:
    """(node, component) of the nodes that verified links join; places: each node's first place."""
    buckets = shared_keys(table.where("keys is not null").select(F.explode("keys").alias("key"), F.col("h").alias("id"), "size"))
    nodes = buckets.select(F.col("id").alias("h")).distinct()
    first = stored(places.select("h", F.col("first").alias("p")).join(nodes, "h", "left_semi"))
    # one row per document, its lines being bounded by its own text
    wanted = first.groupBy(F.col("p.doc_id").alias("d"), F.col("p.t").alias("t")).agg(F.collect_list(F.struct(F.col("p.line").alias("line"), "h")).alias("wanted"))
    wanted = F.broadcast(wanted) if first.count() <= BROADCAST_IDS else wanted
    holding = rows.join(wanted.withColumnRenamed("t", "own"), (F.col("t") == F.col("own")) & F.col("doc_id").eqNullSafe(F.col("d")))
    parts = holding.select(F.split("text", "\n").alias("parts"), "wanted").select(F.transform("wanted", lambda w: F.struct(w["h"].alias("id"), F.get("parts", w["line"]).alias("value"))).alias("of"))

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "value"):
            yield pa.RecordBatch.from_arrays([batch.column("id"), normal(batch.column("value"))], names=["id", "value"])

    items = parts.select(F.inline("of")).mapInArrow(tidy, "id long, value string")
    # rows that repeat an id and a text give their lines again
    items = stored(items.groupBy("id").agg(F.first("value").alias("value")))
    return bucket_components(buckets, items, Likeness(numbered_shingles, lambda x, y: similarity(x, y, threshold) >= threshold, features, threshold))


def dedup_lines(docs: DataFrame, threshold: float = THRESHOLD, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text", counts: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """docs with `text` less its repeated lines, and two columns, `counts`, of its lines and those removed.

    Null texts stay null and have no lines; a text all of whose lines go is
    empty; lines without a character but white space stay. A null id orders
    before others. Rows that repeat both id and text count as one document and
    are treated alike; rows that repeat an id alone are told apart by their
    texts. Long texts are handled whole. No rows give none. Columns named as
    `counts` are replaced, others stay.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text is not null").withColumn("t", F.xxhash64("text"))
    table = line_table(rows, min_chars)
    # by nodes, for a node may have very many places; partial minima come before the shuffle
    place = F.struct("doc_id", "t", "line")
    places = stored(table.groupBy("h").agg(F.min(place).alias("first"), F.count("*").alias("n")))
    named = linked(rows, table, places, threshold)
    # a component's first place stays
    nodes = places.join(named.withColumnRenamed("node", "h"), "h", "left")
    several = stored(nodes.where("component is not null or n > 1").select("h", "first", F.coalesce("component", "h").alias("c")))
    firsts = stored(several.groupBy("c").agg(F.min("first").alias("kept")))
    keep = several.join(firsts, "c").select("h", "kept")
    again = table.select("doc_id", "t", "line", "h").join(keep, "h").where(place != F.col("kept"))
    own, doc, of, gone = private(docs, "own", "doc", "of", "gone")
    # one row per document, its lines being bounded by its own text
    removed = again.groupBy(F.col("doc_id").alias(doc), F.col("t").alias(of)).agg(F.collect_set("line").alias(gone))
    names = [c for c in docs.columns if c.lower() not in {x.lower() for x in counts}]
    keyed = docs.select(*names).withColumn(own, F.xxhash64(F.col(text_col).cast("string")))
    joined = keyed.join(removed, (F.col(own) == F.col(of)) & F.col(id_col).cast("long").eqNullSafe(F.col(doc)), "left")
    text = F.col(text_col).cast("string")
    kept = F.array_join(F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains(gone, i)), "\n")
    breaks = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))
    numbers = [F.coalesce(breaks + 1, F.lit(0)).cast("long").alias(counts[0]), F.coalesce(F.size(gone), F.lit(0)).cast("long").alias(counts[1])]
    columns = [F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(kept).alias(c) if c.lower() == text_col.lower() else F.col(c) for c in names]
    return joined.select(*columns, *numbers)

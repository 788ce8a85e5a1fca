"""Token ids in raw shard files with a minimal perfect hash index.

Files, all in one folder that driver and executors share:

* `ids-SSSSS.bin`: the ids of a range of documents in ascending doc_id order,
  each document's ids and its end id, as little-endian unsigned integers and
  nothing else, of 16 bits if the vocabulary has no more ids, else of 32;
* `index-BBBBB.bin`: for the keys whose hash falls into bucket B, the levels of
  a minimal perfect hash (bit sets with running popcounts) and, in its order,
  each key's fingerprint, shard, first id in the shard and number of ids, as
  plain arrays behind a header that names their places;
* `shards.parquet`: each shard's number of ids and the ids of all before it;
* `manifest.json`: width, buckets, documents and end id, written last. A folder
  is opened by its path, in any session.

A key is a doc_id and its occurrence (0 unless ids repeat); a row without a
doc_id has its text's hash as key. A look-up hashes the key, reads one word per
level until its bit is set, compares the fingerprint and has the place: constant
time, whatever the corpus. Tasks write under a name of their own and rename, so
that tasks run twice leave one whole file.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, id_text, shared_dir, slices
from .encoder import encoder

#: Keys of an index file at most, on average; small tables have some files too.
BUCKET_KEYS, SMALL_KEYS, SMALL_BUCKETS = 500_000, 2_000, 64
#: A key: a doc_id, or the text's hash of a row without one.
KEY = "own long, absent boolean, occurrence int"
PLACED = f"{KEY}, shard int, first long, n_tokens long"
KEYS = ["own", "absent", "occurrence"]


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A bijective 64-bit mixer (public-domain splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def keys_of(keys: pd.DataFrame) -> np.ndarray:
    """64-bit keys of rows KEY."""
    own, absent = keys["own"].to_numpy(np.int64).view(np.uint64), keys["absent"].to_numpy(bool)
    return mix(own ^ mix(keys["occurrence"].to_numpy().astype(np.uint64), 1) ^ mix(np.where(absent, 3, 0).astype(np.uint64), 1), 2)


class PerfectHash:
    """Distinct 64-bit keys to 0..n-1, by levels of bit sets without collisions."""

    LOAD, MOST_LEVELS = 2, 64

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray, int]]):
        self.levels = levels  # (words, set bits before each word, bits)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, base = [], 0
        for level in range(cls.MOST_LEVELS):
            if not len(keys):
                return cls(levels)
            bits = -(-max(64, cls.LOAD * len(keys)) // 64) * 64
            at = mix(keys, 16 + level) % np.uint64(bits)
            alone = np.bincount(at.astype(np.int64), minlength=bits) == 1
            words = np.packbits(alone.reshape(-1, 8)[:, ::-1], axis=1).reshape(-1).view("<u8")
            ones = np.bitwise_count(words).astype(np.int64)
            levels.append((words, base + ones.cumsum() - ones, bits))
            base += int(ones.sum())
            keys = keys[~alone[at.astype(np.int64)]]
        raise ValueError("two keys are equal")

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; -1, or any number, for keys not built from."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (words, before, bits) in enumerate(self.levels):
            at = mix(keys[left], 16 + level) % np.uint64(bits)
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            hit = (words[word] >> bit) & np.uint64(1) == 1
            lower = words[word] & ((np.uint64(1) << bit) - np.uint64(1))
            out[left[hit]] = (before[word] + np.bitwise_count(lower).astype(np.int64))[hit]
            left = left[~hit]
        return out


def put(path: str, data: bytes) -> None:
    files, base = pafs.FileSystem.from_uri(path)
    temporary = f"{base}.{uuid.uuid4().hex}"
    with files.open_output_stream(temporary) as f:
        f.write(data)
    files.move(temporary, base)


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys, 7) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def index_file(keys: np.ndarray, shard: np.ndarray, first: np.ndarray, n: np.ndarray) -> bytes:
    """Header's size, the header (each array's name, place, type and length), the arrays."""
    mph = PerfectHash.build(keys)
    order = np.empty(len(keys), np.int64)
    order[mph(keys)] = np.arange(len(keys))
    arrays = {"fingerprint": fingerprints(keys)[order].astype("<u4"), "shard": shard[order].astype("<i4"), "first": first[order].astype("<i8"), "n": n[order].astype("<i8")}
    for k, (words, before, _) in enumerate(mph.levels):
        arrays |= {f"words{k}": words.astype("<u8"), f"before{k}": before.astype("<i8")}
    places, at = {}, 0
    for name, x in arrays.items():
        places[name] = (at, x.dtype.str, len(x))
        at += x.nbytes
    header = json.dumps({"arrays": places, "bits": [bits for _, _, bits in mph.levels]}).encode()
    return struct.pack("<q", len(header)) + header + b"".join(x.tobytes() for x in arrays.values())


class Index:
    """One bucket's index file, read whole by `find` and word by word by `place`."""

    def __init__(self, path: str):
        files, base = pafs.FileSystem.from_uri(path)
        self.file = files.open_input_file(base)
        size = struct.unpack("<q", self.file.read_at(8, 0))[0]
        header = json.loads(self.file.read_at(size, 8))
        self.base, self.arrays, self.bits = 8 + size, header["arrays"], header["bits"]

    def read(self, name: str, start: int = 0, count: int | None = None) -> np.ndarray:
        at, kind, length = self.arrays[name]
        size, count = np.dtype(kind).itemsize, length if count is None else count
        return np.frombuffer(self.file.read_at(count * size, self.base + at + start * size), kind)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """Which keys are there, and shard, first and n of those."""
        at = PerfectHash([(self.read(f"words{k}"), self.read(f"before{k}"), bits) for k, bits in enumerate(self.bits)])(keys)
        ok = at >= 0
        ok[ok] = self.read("fingerprint")[at[ok]] == fingerprints(keys[ok])
        return ok, {c: self.read(c)[at[ok]] for c in ("shard", "first", "n")}

    def place(self, key: np.ndarray) -> tuple[int, int, int] | None:
        """Shard, first and n of one key, from a word of each level until its bit is set; None if it isn't there."""
        for k, bits in enumerate(self.bits):
            at = int((mix(key, 16 + k) % np.uint64(bits))[0])
            word = int(self.read(f"words{k}", at >> 6, 1)[0])
            if word >> (at & 63) & 1:
                i = int(self.read(f"before{k}", at >> 6, 1)[0]) + (word & ((1 << (at & 63)) - 1)).bit_count()
                same = self.read("fingerprint", i, 1)[0] == fingerprints(key)[0]
                return tuple(int(self.read(c, i, 1)[0]) for c in ("shard", "first", "n")) if same else None
        return None


def ids_at(f: pa.NativeFile, first: int, n: int, width: str) -> np.ndarray:
    size = np.dtype(width).itemsize
    return np.frombuffer(f.read_at(n * size, first * size), width).astype("<u4")


def bucket_of(buckets: int) -> Column:
    return F.pmod(F.xxhash64(*KEYS), F.lit(buckets)).cast("int")


class TokenFiles:
    """A written folder, opened by its path."""

    def __init__(self, path: str):
        self.path = path
        files, base = pafs.FileSystem.from_uri(path)
        with files.open_input_stream(f"{base}/manifest.json") as f:
            manifest = json.loads(f.read())
        self.width, self.buckets, self.documents, self.end_id = (manifest[c] for c in ("width", "buckets", "documents", "end_id"))

    def get(self, spark: SparkSession, doc_id: int | None, occurrence: int = 0, text: str | None = None) -> np.ndarray | None:
        """One document's ids by its key (for a null doc_id, its text), None if it isn't there."""
        own = F.xxhash64(F.lit(text or "")) if doc_id is None else F.lit(doc_id).cast("long")
        row = spark.range(1).select(own.alias("own"), F.lit(doc_id is None).alias("absent"), F.lit(occurrence).alias("occurrence")).withColumn("bucket", bucket_of(self.buckets)).first()
        files, base = pafs.FileSystem.from_uri(self.path)
        if files.get_file_info(f"{base}/index-{row['bucket']:05d}.bin").type == pafs.FileType.NotFound:
            return None
        found = Index(f"{self.path}/index-{row['bucket']:05d}.bin").place(keys_of(pd.DataFrame([row.asDict()])))
        if found is None:
            return None
        with files.open_input_file(f"{base}/ids-{found[0]:05d}.bin") as f:
            return ids_at(f, found[1], found[2], self.width)

    def read(self, keys: DataFrame) -> DataFrame:
        """(doc_id, occurrence, start, n_tokens, ids_crc32) of the keys that are there, rows KEY, from the files."""
        path, width = self.path, self.width

        def locate(group: pd.DataFrame) -> pd.DataFrame:
            ok, at = Index(f"{path}/index-{group['bucket'].iloc[0]:05d}.bin").find(keys_of(group))
            return group.loc[ok, KEYS].assign(shard=at["shard"], first=at["first"], n_tokens=at["n"])

        def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            files, base = pafs.FileSystem.from_uri(path)
            name, f, kept = None, None, [*KEYS, "shard", "first", "n_tokens"]
            for batch in batches:
                crc = []
                for shard, first, n in zip(*(batch.column(c).to_pylist() for c in ("shard", "first", "n_tokens")), strict=True):
                    if name != shard:
                        if f:
                            f.close()
                        name, f = shard, files.open_input_file(f"{base}/ids-{shard:05d}.bin")
                    crc.append(zlib.crc32(ids_at(f, first, n, width).tobytes()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(crc, pa.int64())], names=[*kept, "ids_crc32"])
            if f:
                f.close()

        placed = keys.select(*KEYS, bucket_of(self.buckets).alias("bucket")).groupBy("bucket").applyInPandas(locate, PLACED)
        by_shard = placed.repartition("shard").sortWithinPartitions("shard", "first")
        read = by_shard.mapInArrow(fetch, f"{PLACED}, ids_crc32 long")
        bases = keys.sparkSession.read.parquet(f"{path}/shards.parquet").select("shard", "base")
        return read.join(bases, "shard").select(F.when(~F.col("absent"), F.col("own")).alias("doc_id"), "occurrence", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int = 2, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple[TokenFiles, DataFrame]:
    """(the written files, their keys as rows KEY).

    Null and empty texts have the end id alone. Rows with a null id come first
    and are keyed by their text's hash; a repeated key is written as often as it
    comes, ordered by its text's hash. Long texts are written whole. No rows
    give no shards. Other columns are left out.
    """
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/token-ids-{uuid.uuid4().hex}"
    files, base = pafs.FileSystem.from_uri(path)
    files.create_dir(base)
    width = "<u2" if max(encoder(tokenizer).library.get_vocab_size(), end_id + 1) <= 2**16 else "<u4"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, shard = encoder(tokenizer), TaskContext.get().partitionId()
        files, base = pafs.FileSystem.from_uri(path)
        temporary = f"{base}/ids-{shard:05d}.{uuid.uuid4().hex}"
        first, last, occurrence, f = 0, (None, None), 0, None
        for batch in slices(batches):
            f = f or files.open_output_stream(temporary)
            ids, counts = own.encode(batch.column("text"))
            ends = counts.cumsum()
            f.write(np.insert(ids, ends, np.uint32(end_id)).astype(width).tobytes())
            seen = []
            for key in zip(batch.column("absent").to_pylist(), batch.column("own").to_pylist(), strict=True):
                occurrence = occurrence + 1 if key == last else 0
                last = key
                seen.append(occurrence)
            counts = counts + 1
            starts = first + counts.cumsum() - counts
            first += int(counts.sum())
            columns = [batch.column("own"), batch.column("absent"), pa.array(seen, pa.int32()), pa.array([shard] * len(seen), pa.int32()), pa.array(starts), pa.array(counts)]
            yield pa.RecordBatch.from_arrays(columns, names=[*KEYS, "shard", "first", "n_tokens"])
        if f:
            f.close()
            files.move(temporary, f"{base}/ids-{shard:05d}.bin")

    hashed = F.xxhash64("text")
    rows = id_text(docs, id_col, text_col).select(F.coalesce("doc_id", hashed).alias("own"), F.col("doc_id").isNull().alias("absent"), "text")
    # equal keys meet in one range, so a shard holds all their occurrences; rows without an id spread by their texts
    ordered = rows.repartitionByRange(F.desc("absent"), "own").sortWithinPartitions(F.desc("absent"), "own", hashed)
    placed = cut(ordered.mapInArrow(write, PLACED))
    n = placed.count()
    buckets = max(1, min(n // SMALL_KEYS, SMALL_BUCKETS), n // BUCKET_KEYS)

    def build(group: pd.DataFrame) -> pd.DataFrame:
        put(f"{path}/index-{group['bucket'].iloc[0]:05d}.bin", index_file(keys_of(group), *(group[c].to_numpy() for c in ("shard", "first", "n_tokens"))))
        return pd.DataFrame({"bucket": group["bucket"].iloc[:1], "n": [len(group)]})

    indexed = placed.withColumn("bucket", bucket_of(buckets)).groupBy("bucket").applyInPandas(build, "bucket int, n long").agg(F.sum("n")).first()[0]
    if (indexed or 0) != n:
        raise RuntimeError("an index file is missing keys")
    # one row per shard, so this window is small; shards are ranges in ascending order
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("shard").agg(F.sum("n_tokens").alias("ids"))
    sizes.select("shard", "ids", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base")).write.mode("overwrite").parquet(f"{path}/shards.parquet")
    put(f"{path}/manifest.json", json.dumps({"width": width, "buckets": buckets, "documents": n, "end_id": end_id}).encode())
    return TokenFiles(path), placed.select(*KEYS)

"""A content-addressed store of token ids.

Each document's ids, with the end id appended, are cut into chunks where a rolling hash of the
last WINDOW ids has MASK's bits clear, so equal passages give equal chunks wherever they stand.
A chunk's address is a hash of its ids. Files, all Parquet, under one folder:

staged/    kind=chunk: key, ids: each unique chunk once; ids little-endian, 2 bytes each if the vocabulary allows, else 4
manifest/  in ascending doc_id order: part (the number of a range of documents), inside (ids of the range before the
           document), doc_id, n_tokens, hashes and sizes of its chunks (the recipe), and root, the Merkle root over the hashes
starts/    for each range the ids of all ranges before it: a document starts at before + inside

Ids are shuffled once, to where their chunk is stored, and a task sends a chunk at most once, so a
chunk of a third of all documents stays small; recipes are dealt by a hash of their own, never by
chunk. Starts come from sums of range partitions, of which the driver sees one number each.

Reading back checks every stored chunk against its address and every recipe against its root.
The checksum of a document is put together from checksums of its chunks: CRC-32 is linear, so
each chunk's part is its checksum times x to the number of bits after it, and parts are XORed.

Null and empty texts are one end id. Rows without a doc_id come first. Rows that repeat a doc_id are documents of their own, in
order of their roots. An empty table gives an empty store.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumisift.llm import words
from lumisift.llm.bpe import codec
from lumisift.llm.common import HOT_SHARE, SLICE_ROWS, hot_join, id_text, remove, slices
from lumisift.llm.words import mix

END_ID = 0
#: Pieces that a generation of a worker's cache holds: more than elsewhere, encoding is most of the work here.
CACHED_PIECES = 600_000
WINDOW, MASK, SHORTEST, LONGEST = 16, (1 << 10) - 1, 256, 4096
_POLYNOMIAL = 0xEDB88320


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the chunks."""
    n = len(ids)
    if n <= SHORTEST:
        return [n] if n else []
    words._grow(n + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(mix(ids.astype(np.uint64) + np.uint64(1)) * words._UP[:n], out=total[1:])
    rolled = mix((total[WINDOW:] - total[:-WINDOW]) * words._DOWN[: n + 1 - WINDOW])
    out, begin = [], 0
    for end in (np.flatnonzero((rolled & np.uint64(MASK)) == 0) + WINDOW).tolist():
        while end - begin > LONGEST:
            begin += LONGEST
            out.append(begin)
        if end - begin >= SHORTEST:
            out.append(end)
            begin = end
    while n - begin > LONGEST:
        begin += LONGEST
        out.append(begin)
    if begin < n:
        out.append(n)
    return out


def address(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def merkle_root(hashes: list[bytes]) -> bytes:
    """Leaves and inner nodes are hashed with different prefixes; an odd node goes up as it is."""
    level = [address(b"\0" + h) for h in hashes] or [address(b"")]
    while len(level) > 1:
        level = [address(b"\1" + level[i] + level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of polynomials over GF(2) modulo that of CRC-32, bits reflected."""
    a, out = a.copy(), np.zeros_like(a)
    for bit in range(31, -1, -1):
        out ^= np.where((b >> np.uint32(bit)) & np.uint32(1), a, np.uint32(0))
        a = (a >> np.uint32(1)) ^ np.where(a & np.uint32(1), np.uint32(_POLYNOMIAL), np.uint32(0))
    return out


def _x_power_table() -> list[np.ndarray]:
    out = [np.array([0x00800000], dtype=np.uint32)]  # x to the 8th: one byte
    for _ in range(63):
        out.append(_times(out[-1], out[-1]))
    return out


_BYTES = _x_power_table()


def moved(crc: np.ndarray, after: np.ndarray) -> np.ndarray:
    """crc's share in the CRC-32 of data that has so many more bytes after it."""
    crc, after = crc.astype(np.uint32), after.astype(np.int64)
    for k in range(64):
        on = (after >> k) & 1 == 1
        if on.any():
            crc = np.where(on, _times(crc, np.broadcast_to(_BYTES[k], crc.shape)), crc)
        if not (after >> k).any():
            break
    return crc


_STAGED = pa.schema([("kind", pa.string()), ("key", pa.binary()), ("ids", pa.binary()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("hashes", pa.list_(pa.binary())), ("sizes", pa.list_(pa.int32())), ("root", pa.binary())])
_MANIFEST = "part int, inside long, doc_id long, n_tokens long, hashes array<binary>, sizes array<int>, root binary"
_STAGED_SQL = "kind string, key binary, ids binary, doc_id long, n_tokens long, hashes array<binary>, sizes array<int>, root binary"


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, CACHED_PIECES)
        end = np.array([END_ID], dtype=c.dtype).tobytes()
        sent: set[bytes] = set()
        for batch in batches:
            pa.default_memory_pool().release_unused()
            coded = zip(batch.column("doc_id").to_pylist(), c.encode_column(batch.column("text")), strict=True)
            while rows := list(islice(coded, SLICE_ROWS)):
                chunks, recipes = {}, []
                for doc, data in rows:
                    data += end
                    width, begin, hashes, sizes = c.dtype.itemsize, 0, [], []
                    for stop in cuts(c.ids(data)):
                        own = data[begin * width : stop * width]
                        hashes.append(address(own)), sizes.append(stop - begin)
                        if hashes[-1] not in sent:
                            chunks[hashes[-1]] = own
                            sent.add(hashes[-1])
                        begin = stop
                    recipes.append((doc, len(data) // width, hashes, sizes, merkle_root(hashes)))
                n, m = len(chunks), len(recipes)
                yield pa.RecordBatch.from_arrays([pa.array(["chunk"] * n + ["recipe"] * m), pa.array([*chunks, *(r[4] for r in recipes)], pa.binary()), pa.array([*chunks.values(), *[None] * m], pa.binary()), *(pa.array([*[None] * n, *(r[i] for r in recipes)], k.type) for i, k in enumerate(list(_STAGED)[3:]))], schema=_STAGED)
        pa.default_memory_pool().release_unused()

    return run


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the copies of a chunk that tasks sent to this partition, the first."""
    seen: set[bytes] = set()
    for batch in batches:
        keep = []
        for kind, key in zip(batch.column("kind").to_pylist(), batch.column("key").to_pylist(), strict=True):
            keep.append(kind != "chunk" or key not in seen)
            if kind == "chunk":
                seen.add(key)
        yield batch.filter(pa.array(keep, pa.bool_()))


def write(docs: DataFrame, tokenizer: str, path: str) -> None:
    spark = docs.sparkSession
    staged = id_text(docs).mapInArrow(_encode(tokenizer), _STAGED_SQL)
    # chunks meet by address; recipes, whose roots identical documents share, are spread by doc_id
    place = F.when(F.col("kind") == "chunk", F.xxhash64("key")).otherwise(F.xxhash64("doc_id"))
    dealt = staged.withColumn("place", place).repartition("place").drop("place").mapInArrow(_once, _STAGED_SQL)
    dealt.write.partitionBy("kind").option("compression", "zstd").parquet(f"{path}/staged")
    ordered = _staged(spark, path, "recipe").select("doc_id", "n_tokens", "hashes", "sizes", "root").repartitionByRange("doc_id", "root").sortWithinPartitions("doc_id", "root")
    ordered.mapInArrow(_numbered, _MANIFEST).write.option("compression", "zstd").parquet(f"{path}/manifest")
    sums = {r.part: r.n for r in spark.read.schema(_MANIFEST).parquet(f"{path}/manifest").groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}  # a number for each partition
    before, at = [], 0
    for part in sorted(sums):
        before.append((part, at))
        at += sums[part]
    spark.createDataFrame(before, "part int, before long").coalesce(1).write.parquet(f"{path}/starts")
    remove(spark, f"{path}/staged/kind=recipe")


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one range with its number and, for each document, the ids before it in the range."""
    part, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.column("n_tokens").to_numpy()
        ends = at + np.cumsum(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part, dtype=np.int32)), pa.array(ends - n, pa.int64()), *batch.columns], names=["part", "inside", *batch.schema.names])
        at = int(ends[-1]) if len(ends) else at


def _staged(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Only the files and columns of one kind are read; a store of nothing has no files at all."""
    return spark.read.schema(_STAGED_SQL).parquet(f"{path}/staged").where(F.col("kind") == kind)


def chunks(spark: SparkSession, path: str) -> DataFrame:
    return _staged(spark, path, "chunk").select(F.col("key").alias("hash"), "ids")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    starts = F.broadcast(spark.read.schema("part int, before long").parquet(f"{path}/starts"))  # a row for each range
    rows = spark.read.schema(_MANIFEST).parquet(f"{path}/manifest").join(starts, "part")
    return rows.select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "hashes", "sizes", "root")


def _checked(dtype: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, crcs = batch.column("hash").to_pylist(), []
            for h, data in zip(hashes, batch.column("ids").to_pylist(), strict=True):
                if address(data) != h:
                    raise ValueError(f"chunk {h.hex()} is damaged")
                crcs.append(zlib.crc32(np.frombuffer(data, dtype=dtype).astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column("hash"), pa.array(crcs, pa.int64())], names=["hash", "crc"])

    return run


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each chunk of each document: its hash, and the bytes after it."""
    for batch in batches:
        rows = []
        for doc, start, n, hashes, sizes, root in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "start", "n_tokens", "hashes", "sizes", "root")), strict=True):
            if merkle_root(hashes) != root or sum(sizes) != n:
                raise ValueError(f"the recipe of document {doc} is damaged")
            left = n
            for h, size in zip(hashes, sizes, strict=True):
                left -= size
                rows.append((doc, start, n, h, 4 * left, size))
        cols = list(zip(*rows, strict=True)) or [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "start", "n_tokens", "hash", "after", "size"])


def _shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        share = moved(batch.column("crc").to_numpy(zero_copy_only=False), batch.column("after").to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "start", "n_tokens", "size")), pa.array(share.astype(np.int64))], names=["doc_id", "start", "n_tokens", "size", "share"])


def _hot_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Addresses that a thousandth of all recipes' entries or more name, such as that of an empty document: at most HOT_SHARE."""
    named = manifest(spark, path).select(F.explode("hashes").alias("hash"))
    total = named.count()
    return F.broadcast(named.groupBy("hash").agg(F.count("*").alias("n")).where(F.col("n") * HOT_SHARE >= total).select("hash"))


def summary(spark: SparkSession, path: str, dtype: str = "<u2") -> DataFrame:
    """From the files: doc_id, start, n_tokens, ids_crc32. A chunk that is missing or damaged, or a wrong recipe, is an error."""
    own = chunks(spark, path)
    crcs, hot = (c.mapInArrow(_checked(dtype), "hash binary, crc long") for c in (own, own.join(_hot_chunks(spark, path), "hash")))
    used = manifest(spark, path).mapInArrow(_parts, "doc_id long, start long, n_tokens long, hash binary, after long, size long")
    whole = hot_join(used, crcs, hot, "hash").select("doc_id", "start", "n_tokens", "size", "crc", "after").mapInArrow(_shares, "doc_id long, start long, n_tokens long, size long, share long")
    read = whole.groupBy("doc_id", "start", "n_tokens").agg(F.expr("bit_xor(share)").alias("ids_crc32"), F.sum("size").alias("found"))
    missing = F.raise_error(F.concat(F.lit("chunks are missing of document "), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    return read.select("doc_id", "start", F.when(F.col("found") == F.col("n_tokens"), F.col("n_tokens")).otherwise(missing.cast("long")).alias("n_tokens"), "ids_crc32")


def _rebuilt(dtype: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for doc, root, n, parts in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "root", "n_tokens", "parts")), strict=True):
                if any(address(p["ids"]) != p["hash"] for p in parts) or merkle_root([p["hash"] for p in parts]) != root:
                    raise ValueError(f"document {doc} is damaged")
                ids = np.frombuffer(b"".join(p["ids"] for p in parts), dtype=dtype)
                if len(ids) != n:
                    raise ValueError(f"chunks are missing of document {doc}")
                out.append(ids.astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), pa.array(out, pa.list_(pa.int32()))], names=["doc_id", "start", "ids"])

    return run


def documents(spark: SparkSession, path: str, dtype: str = "<u2") -> DataFrame:
    """The ids of each document, put together again and checked against addresses and root: doc_id, start, ids array<int>, end id included. A document's chunks meet in one row."""
    used = manifest(spark, path).select("doc_id", "start", "n_tokens", "root", F.posexplode("hashes").alias("pos", "hash"))
    own = chunks(spark, path)
    met = hot_join(used, own, own.join(_hot_chunks(spark, path), "hash"), "hash")
    parts = met.groupBy("doc_id", "start", "n_tokens", "root").agg(F.array_sort(F.collect_list(F.struct("pos", "hash", "ids"))).alias("parts"))
    return parts.mapInArrow(_rebuilt(dtype), "doc_id long, start long, ids array<int>")


def stored_summary(docs: DataFrame, tokenizer: str, path: str) -> DataFrame:
    """Writes the store and reads it back."""
    write(docs, tokenizer, path)
    return summary(docs.sparkSession, path, codec(tokenizer).dtype.str)

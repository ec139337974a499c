"""Operator 1, token-id output in training order.

Every document's ids are cut into sequences of a fixed length. A keyed Feistel
permutation with cycle-walking gives each sequence a ticket; ranges of tickets
are the shards, and the place among the tickets in use is the global slot. A
shard is one file of fixed-stride records, so slot s is read by one seek.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapewise.llm import tokens
from tapewise.llm._common import documents, materialize, scratch_path, slices

SEQ_LEN = 256
KEY = "training-order-1"
ROUNDS = 6
END_ID = 0


class Feistel:
    """Keyed permutation of 0 .. n-1: a balanced Feistel network over the least
    even number of bits that holds n, walked until it falls below n."""

    def __init__(self, n: int, key: str = KEY, rounds: int = ROUNDS):
        self.n = n
        self.half = max(1, ((max(n - 1, 1)).bit_length() + 1) // 2)
        self.mask = np.uint64((1 << self.half) - 1)
        self.keys = [np.uint64(int.from_bytes(hashlib.blake2b(f"{key}:{r}".encode(), digest_size=8).digest(), "little")) for r in range(rounds)]

    def _f(self, x: np.ndarray, k: np.uint64) -> np.ndarray:
        x = (x ^ k) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        return (x ^ (x >> np.uint64(29))) & self.mask

    def _once(self, x: np.ndarray) -> np.ndarray:
        s = np.uint64(self.half)
        a, b = x >> s, x & self.mask
        for k in self.keys:
            a, b = b, a ^ self._f(b, k)
        return (a << s) | b

    def _back(self, x: np.ndarray) -> np.ndarray:
        s = np.uint64(self.half)
        a, b = x >> s, x & self.mask
        for k in reversed(self.keys):
            a, b = b ^ self._f(a, k), a
        return (a << s) | b

    def _walk(self, x: np.ndarray, step) -> np.ndarray:
        with np.errstate(over="ignore"):
            y = step(np.asarray(x, dtype=np.uint64))
            while (out := y >= self.n).any():
                y[out] = step(y[out])
        return y.astype(np.int64)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self._walk(x, self._once)

    def inverse(self, y: np.ndarray) -> np.ndarray:
        return self._walk(y, self._back)


def _shard_name(shard: int) -> str:
    return f"shard-{shard:06d}.bin"


def write_shards(docs: DataFrame, out: str, doc: str = "doc_id", text: str = "text", *, seq_len: int = SEQ_LEN, key: str = KEY, shards: int | None = None, path: str = tokens.DEFAULT) -> DataFrame:
    """Write the sequences of all ``docs`` in training order below ``out`` (a
    URI that the executors share) and return a row for each: ``doc``, start,
    n_tokens, ids_crc32, ticket, shard, record, slot.

    A document is its ids and the end id, in sequences of ``seq_len`` ids; the
    last is padded with the end id and tells its own length by ``n_tokens``.
    Records are little-endian unsigned ids of 2 bytes (4 if the vocabulary needs
    them). ``docs`` has to be a table or a scan, whose partitions are the same
    each time they are read.

    Tickets are a permutation of an interval that holds ceil((bytes + 1) /
    seq_len) numbers a document, as no text has more ids than bytes. So texts
    are tokenised once and ids move once, straight to their shard. The files are
    written under another name and renamed: a task that runs again on another
    executor writes the same bytes.

    Null and empty texts have the end id alone. Repeated rows are sequences of
    their own. An empty table gives no rows and no files.
    """
    spark = docs.sparkSession
    kind = docs.schema[doc].dataType.simpleString()
    docs = docs.select(F.col(doc).alias("key"), F.coalesce(text, F.lit("")).alias("text"))
    need = F.floor((F.octet_length("text") + seq_len) / seq_len).cast("long")
    parts = sorted((r["pid"], r["n"]) for r in docs.groupBy(F.spark_partition_id().alias("pid")).agg(F.sum(need).alias("n")).collect())  # a row a partition
    base, total = {}, 0
    for pid, n in parts:
        base[pid] = total
        total += n
    count = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    perm, width = Feistel(max(total, 1), key), 2 if tokens.vocabulary_size(path) <= 1 << 16 else 4

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at = base.get(TaskContext.get().partitionId(), 0)
        for batch in slices(batches):
            rows, starts, sizes, blobs, crcs, index = [], [], [], [], [], []
            for i, t in enumerate(batch.column(1)):
                s = t.as_py()
                ids = np.append(tokens.token_ids(s, path), np.uint32(END_ID)).astype(f"<u{width}")
                for j, a in enumerate(range(0, len(ids), seq_len)):
                    blob = ids[a : a + seq_len].tobytes()
                    rows.append(i)
                    starts.append(a)
                    sizes.append(len(blob) // width)
                    blobs.append(blob)
                    crcs.append(zlib.crc32(blob))
                    index.append(at + j)
                at += (len(s.encode()) + seq_len) // seq_len
            ticket = perm(np.array(index, dtype=np.int64))
            shard = np.array([t * count // total for t in ticket.tolist()], dtype=np.int32)
            cols = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(starts, pa.int64()), pa.array(sizes, pa.int32()), pa.array(crcs, pa.int64()), pa.array(ticket), pa.array(shard), pa.array(blobs, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["key", "start", "n_tokens", "ids_crc32", "ticket", "shard", "ids"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(out)
        file = name = shard = None
        record = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if file is None:
                shard = batch.column(5)[0].as_py()
                store.create_dir(root, recursive=True)
                name = f"{root}/.{_shard_name(shard)}.{uuid.uuid4().hex}"
                file = store.open_output_stream(name)
            for blob in batch.column(6):
                raw = blob.as_py()
                file.write(raw + END_ID.to_bytes(width, "little") * (seq_len - len(raw) // width))
            places = pa.array(np.arange(record, record + batch.num_rows))
            record += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], places], names=[*batch.schema.names[:6], "record"])
        if file is not None:
            file.close()
            store.move(name, f"{root}/{_shard_name(shard)}")

    fields = f"key {kind}, start long, n_tokens int, ids_crc32 long, ticket long, shard int"
    cuts = docs.mapInArrow(cut, fields + ", ids binary")
    # the shard is the partition: one task writes one file, in the order of the tickets
    dealt = cuts.repartitionById(count, F.col("shard")).sortWithinPartitions("ticket")
    done = materialize(dealt.mapInArrow(write, fields + ", record long"), "sequences")
    held = done.groupBy("shard").agg(F.count("*").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    first = F.broadcast(held.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n"))  # a row a shard
    return done.join(first, "shard").select(F.col("key").alias(doc), "start", "n_tokens", "ids_crc32", "ticket", "shard", "record", (F.col("first") + F.col("record")).alias("slot"))


def read_slots(out: str, first: int, n: int, *, seq_len: int = SEQ_LEN, path: str = tokens.DEFAULT) -> np.ndarray:
    """Records of slots ``first`` .. ``first + n - 1``: file sizes give the
    shard, one seek the record, so a reader resumes anywhere."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(out)
    width = 2 if tokens.vocabulary_size(path) <= 1 << 16 else 4
    stride, rows = width * seq_len, []
    files = sorted((x for x in store.get_file_info(fs.FileSelector(root)) if x.base_name.startswith("shard-")), key=lambda x: x.base_name)
    start = 0
    for info in files:
        size = info.size // stride
        lo, hi = max(first, start), min(first + n, start + size)
        if lo < hi:
            with store.open_input_file(info.path) as f:
                f.seek((lo - start) * stride)
                rows.append(np.frombuffer(f.read((hi - lo) * stride), dtype=f"<u{width}").reshape(-1, seq_len))
        start += size
    return np.concatenate(rows) if rows else np.empty((0, seq_len), dtype=f"<u{width}")


def op1_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token ids, written in training order to shards in the
    shared folder; a row for each sequence written."""
    return write_shards(documents(spark, sf_dir).select("doc_id", "text"), scratch_path(spark, "shards"))

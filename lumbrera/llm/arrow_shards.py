"""Token ids as Arrow files of equal-length sequences.

A shard is a pair of Arrow IPC files (the random-access form of the stream format), uncompressed, so that a reader can map them and
reach sequence k without copying:

* ``shard-NNNNN.arrow``: ids fixed_size_list<uint16 or uint32>[seq_len], mask fixed_size_list<bool>[seq_len]. Every record batch
  but the last holds ``BATCH_ROWS`` sequences, so sequence k is row k mod BATCH_ROWS of batch k div BATCH_ROWS. The last sequence is padded with
  zeros; the mask is false there.
* ``shard-NNNNN.index.arrow``: doc_id, start and n_tokens of each document, start counted within the shard.

Shards hold documents in ascending doc_id order, shard after shard. Each is written under a name of its own attempt and then moved
into place, so a task that runs twice leaves one file. Folders are reached through pyarrow.fs, by URI.

Null texts count as empty, and every document gets the end id. A null doc_id sorts first. Repeated doc_ids are ordered by their texts. Empty tables make no files.
Ids outside unsigned 16 bits take 32-bit lists. Other columns are not read.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from lumbrera.llm.common import bounded_batches, chunks, fresh_path, in_order, ragged, strings

SEQ_LEN = 2048
BATCH_ROWS = 64
CHUNK = 2 << 20
CACHE_WORDS = 500_000
MANIFEST = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("file", T.StringType()), T.StructField("n_docs", T.LongType()), T.StructField("n_ids", T.LongType())])


class WordCache:
    """The tokenizers library over distinct words, whose ids a worker keeps from batch to batch.

    The tokenizer drops white space and never joins over it, nor over a letter and punctuation other than an apostrophe, so a text's ids
    are its parts' ids one after another. That is checked on a probe when the tokenizer is loaded; if it fails, whole texts are encoded. At most
    ``CACHE_WORDS`` parts are kept; then the cache starts anew.
    """

    def __init__(self, spec: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.lib = Tokenizer.from_str(spec)
        probe = "TWO words'll  do.\nit: náive ΣΣ <|endoftext|>x 12\t34..5 a.'s don't!? É... (x)"
        parts = [w for w in pc.split_pattern(apart(pa.array([probe])), " ").values.to_pylist() if w]
        self.split = self.lib.encode(probe, add_special_tokens=False).ids == [i for w in parts for i in self.lib.encode(w, add_special_tokens=False).ids]
        self.clear()

    def clear(self) -> None:
        self.slot: dict[str, int] = {}
        self.size, self.start = np.zeros(CACHE_WORDS, np.int32), np.zeros(CACHE_WORDS, np.int64)
        self.ids, self.used = np.zeros(4 * CACHE_WORDS, np.int32), 0

    def learn(self, words: list[str]) -> None:
        """Put new words into the cache."""
        for k in range(0, len(words), 4096):
            part = words[k : k + 4096]
            found = [e.ids for e in self.lib.encode_batch_fast(part, add_special_tokens=False)]
            sizes = np.fromiter(map(len, found), np.int64, len(part))
            n, at = int(sizes.sum()), len(self.slot)
            while self.used + n > len(self.ids):
                self.ids = np.r_[self.ids, self.ids * 0]
            while at + len(part) > len(self.size):
                self.size, self.start = np.r_[self.size, self.size * 0], np.r_[self.start, self.start * 0]
            self.size[at : at + len(part)], self.start[at : at + len(part)] = sizes, self.used + np.cumsum(sizes) - sizes
            self.ids[self.used : self.used + n] = np.fromiter(chain.from_iterable(found), np.int32, n)
            self.used += n
            self.slot.update(zip(part, range(at, at + len(part)), strict=True))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts (no nulls), one after another, and their counts."""
        if not self.split:
            found = [self.lib.encode(t, add_special_tokens=False).ids for t in texts.to_pylist()]
            return np.array([i for x in found for i in x], np.int64), np.array([len(x) for x in found], np.int64)
        parts = pc.split_pattern(apart(texts), " ")
        at = parts.offsets.to_numpy()
        words = pc.dictionary_encode(parts.values.slice(at[0], at[-1] - at[0]))
        distinct = words.dictionary.to_pylist()
        new = [w for w in distinct if w not in self.slot]
        if len(self.slot) + len(new) > CACHE_WORDS:
            self.clear()
            new = distinct
        self.learn(new)
        slots = np.fromiter(map(self.slot.__getitem__, distinct), np.int64, len(distinct))
        which = slots[words.indices.to_numpy()] if len(distinct) else slots
        per = self.size[which].astype(np.int64)
        return self.ids[ragged(self.start[which], per)], np.diff(np.r_[0, np.cumsum(per)][at - at[0]])


def apart(texts: pa.Array) -> pa.Array:
    """Lower case, as the tokenizer has it, where no special token can be meant; a space between a Latin letter and the punctuation after it, and for line feeds."""
    texts = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
    return pc.replace_substring_regex(pc.replace_substring(texts, "\n", " "), r'([A-Za-zÀ-ÖØ-öø-ÿ])([.,!?:;#$%&*()"]+)', r"\1 \2")


@lru_cache(maxsize=1)
def word_cache(spec: str) -> WordCache:
    return WordCache(spec)


def write_shards(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, seq_len: int = SEQ_LEN, partitions: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the shards into ``folder`` (a URI that all executors reach); the manifest: shard, file, n_docs, n_ids and start (ids of all shards before)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()
    wide = max(Tokenizer.from_str(spec).get_vocab_size(with_added_tokens=True), end_id + 1) > 65536
    held = spark.sparkContext.broadcast(spec)
    dealt, splits = in_order(docs.select(id_col, F.coalesce(text_col, F.lit("")).alias("_text")), id_col, "_text", partitions)
    dealt = dealt.repartitionById(len(splits) - 1, "_shard").sortWithinPartitions(F.col(id_col).asc_nulls_first(), "_text").select("_shard", id_col, "_text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        own = word_cache(held.value)
        for whole in batches:
            for b in chunks(whole, 2, CHUNK):
                if out is None:
                    out = ShardWriter(folder, b.column(0)[0].as_py(), seq_len, wide)
                flat, size = own.encode(strings(b.column(2)))
                out.add(b.column(1), np.insert(flat, np.cumsum(size), end_id), size + 1)
        if out is not None:
            n_docs, n_ids = out.close()
            yield pa.RecordBatch.from_arrays([pa.array([out.shard], pa.int32()), pa.array([out.name]), pa.array([n_docs]), pa.array([n_ids])], ["shard", "file", "n_docs", "n_ids"])

    # One row a shard: bounded by the number of shards, not by the documents.
    rows, start, manifest = dealt.mapInArrow(work, MANIFEST).collect(), 0, []
    for r in sorted(rows, key=lambda r: r["shard"]):
        manifest.append((*r, start))
        start += r["n_ids"]
    return spark.createDataFrame(manifest, T.StructType([*MANIFEST.fields, T.StructField("start", T.LongType())]))


class ShardWriter:
    def __init__(self, folder: str, shard: int, seq_len: int, wide: bool) -> None:
        self.fs, self.root = fs.FileSystem.from_uri(folder)
        self.fs.create_dir(self.root, recursive=True)
        self.shard, self.seq_len, self.kind = shard, seq_len, pa.uint32() if wide else pa.uint16()
        self.name = f"shard-{shard:05d}"
        self.temp = f"{self.root}/_{self.name}-{uuid.uuid4().hex}"
        schema = pa.schema([("ids", pa.list_(self.kind, seq_len)), ("mask", pa.list_(pa.bool_(), seq_len))])
        self.data = self.fs.open_output_stream(self.temp)
        self.ipc = pa.ipc.new_file(self.data, schema)
        self.index = self.fs.open_output_stream(self.temp + ".index")
        self.index_ipc = None
        self.rest, self.held, self.n_docs, self.n_ids = [], 0, 0, 0

    def add(self, keys: pa.Array, ids: np.ndarray, size: np.ndarray) -> None:
        ends = self.n_ids + np.cumsum(size)
        cols = [keys, pa.array(ends - size), pa.array(size)]
        if self.index_ipc is None:
            self.index_ipc = pa.ipc.new_file(self.index, pa.schema([("doc_id", keys.type), ("start", pa.int64()), ("n_tokens", pa.int64())]))
        self.index_ipc.write_batch(pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens"]))
        self.n_docs, self.n_ids = self.n_docs + len(keys), int(ends[-1])
        self.rest.append(ids.astype(self.kind.to_pandas_dtype()))
        self.held += len(ids)
        block = self.seq_len * BATCH_ROWS
        if self.held >= block:
            flat = np.concatenate(self.rest)
            for k in range(0, len(flat) - block + 1, block):
                self.put(flat[k : k + block], block)
            self.rest = [flat[len(flat) // block * block :]]
            self.held = len(self.rest[0])

    def put(self, flat: np.ndarray, real: int) -> None:
        mask = np.arange(len(flat)) < real
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.seq_len) for x in (flat, mask)]
        self.ipc.write_batch(pa.RecordBatch.from_arrays(lists, ["ids", "mask"]))

    def close(self) -> tuple[int, int]:
        if self.held:
            flat = np.concatenate(self.rest)
            self.put(np.pad(flat, (0, -len(flat) % self.seq_len)), len(flat))
        self.ipc.close()
        self.data.close()
        self.index_ipc.close()
        self.index.close()
        self.fs.move(self.temp, f"{self.root}/{self.name}.arrow")
        self.fs.move(self.temp + ".index", f"{self.root}/{self.name}.index.arrow")
        return self.n_docs, self.n_ids


class ShardReader:
    """Random access to one shard. On a local or mounted folder the file is mapped and nothing is copied."""

    def __init__(self, folder: str, name: str) -> None:
        where, root = fs.FileSystem.from_uri(folder)
        local = isinstance(where, fs.LocalFileSystem)
        opened = (lambda p: pa.memory_map(p)) if local else where.open_input_file
        self.ipc = pa.ipc.open_file(opened(f"{root}/{name}.arrow"))
        self.index = pa.ipc.open_file(opened(f"{root}/{name}.index.arrow"))
        self.seq_len = self.ipc.schema.field("ids").type.list_size

    def sequence(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of sequence k."""
        b = self.ipc.get_batch(k // BATCH_ROWS)
        ids, mask = (b.column(c).slice(k % BATCH_ROWS, 1).flatten() for c in (0, 1))
        return ids.to_numpy(), mask.to_numpy(zero_copy_only=False)

    def ids(self, start: int, size: int) -> np.ndarray:
        """A stretch of the shard's ids, over as many batches as it spans."""
        block, out = self.seq_len * BATCH_ROWS, []
        while size > 0:
            flat = self.ipc.get_batch(start // block).column(0).flatten().to_numpy()
            out.append(flat[start % block : start % block + size])
            start, size = start + len(out[-1]), size - len(out[-1])
        return out[0] if len(out) == 1 else np.concatenate(out) if out else np.zeros(0, np.uint16)


def read_documents(manifest: DataFrame, folder: str, key_type: str = "bigint", batch_docs: int = 1024) -> DataFrame:
    """Documents back from the shards: doc_id, start (over all shards), n_tokens, ids_crc32 of the ids as little-endian unsigned 32-bit integers."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, base in zip(b.column("file").to_pylist(), b.column("start").to_pylist(), strict=True):
                shard = ShardReader(folder, name)
                for k in range(shard.index.num_record_batches):
                    part = shard.index.get_batch(k)
                    for at in range(0, part.num_rows, batch_docs):
                        p = part.slice(at, batch_docs)
                        starts, sizes = p.column(1).to_numpy(), p.column(2).to_numpy()
                        flat = shard.ids(int(starts[0]), int(sizes.sum())).astype("<u4")
                        raw, edge = memoryview(flat.tobytes()), ((starts - starts[0]) * 4).tolist()
                        crc = [zlib.crc32(raw[e : e + 4 * n]) for e, n in zip(edge, sizes.tolist(), strict=True)]
                        yield pa.RecordBatch.from_arrays([p.column(0), pa.array(starts + base), p.column(2), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    n = manifest.count()
    return manifest.repartition(max(1, n), "shard").mapInArrow(work, f"doc_id {key_type}, start bigint, n_tokens bigint, ids_crc32 bigint")


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Write the shards to the shared folder and read the documents back from them."""
    folder = fresh_path(docs.sparkSession, "shards")
    manifest = write_shards(docs, folder, tokenizer_path, end_id)
    return read_documents(manifest, folder, docs.schema["doc_id"].dataType.simpleString())

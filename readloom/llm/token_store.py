"""Operator 1: token ids as binary shards, with a shared zstandard dictionary.

One shard holds the documents of one range of keys, in ascending order::

    magic "RLTOK2\\0\\0" | frame of document 0 | frame of document 1 | ... | index | tail

* frame: the document's ids (end id included) as little-endian unsigned 16- or 32-bit integers, compressed by itself
  with the data set's dictionary, so that a short document is read and decompressed alone;
* index: for every document whether its key is null, the key, the offset, the length and the number of ids (zstandard
  over 64-bit columns);
* tail: length of the index, number of documents, bytes of an id, SHA-256 of the dictionary, magic.

The dictionary lies beside the shards as ``dict-<hash>.zdict``.  A shard is written under a name that no other attempt
uses and is moved into place when whole; the manifest, a Parquet table, names the shards that count.  Lost or repeated
tasks leave at most files that no manifest names.
"""

from __future__ import annotations

import hashlib
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from readloom.llm.common import arrow_map, filesystem, fresh_dir, table
from readloom.llm.pretokens import PieceEncoder, is_steady

MAGIC = b"RLTOK2\0\0"
TAIL = struct.Struct("<QQI32s8s")

#: Bounds of the dictionary: its size, the documents that it is trained on (those with the least hashes of key and
#: text), the characters that one of them gives (a stretch that the hash chooses) and the bytes of one sample of its ids.
#: The dictionary only saves bytes: what the shards hold doesn't depend on it.
DICT_BYTES, DICT_DOCS, DICT_CHARS, SAMPLE_BYTES = 64 << 10, 1500, 5500, 2048

MANIFEST = "part int, path string, n_docs long, n_tokens long, n_bytes long, dict_sha256 string"
_encoders: dict[tuple, object] = {}


def piece_encoder(tokenizer_json: bytes, id_bytes: int):
    """A function from texts to the bytes of their ids, by the tokenizers library; one for each worker.

    Every distinct pre-token is encoded by the library once.  A text with characters on whose class Unicode versions
    differ, or that holds the string of an added token, goes to the library whole.
    """
    key = (hashlib.sha256(tokenizer_json).digest(), id_bytes)
    if key not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        tok = Tokenizer.from_str(tokenizer_json.decode())
        added = [t.content for t in tok.get_added_tokens_decoder().values()]
        kind = f"<u{id_bytes}"
        vocabulary = tok.get_vocab()
        opens = np.zeros(max(vocabulary.values()) + 1, bool)  # ids of tokens that begin with a space
        opens[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True

        def whole(texts: list[str]) -> list[bytes]:
            # the library's results are large: a few at a time
            return [np.array(e.ids, kind).tobytes() for i in range(0, len(texts), 2000) for e in tok.encode_batch_fast(texts[i : i + 2000], add_special_tokens=False)]

        def resolve(pieces: list[str]) -> list[bytes]:
            """A space and letters: these stay apart when they stand in a row, so that many are encoded as one text."""
            rows = [p for p in pieces if p[0] == " " and p[1:].isalpha()]
            found = {}
            for i in range(0, len(rows), 500):
                group = rows[i : i + 500]
                ids = np.array(tok.encode_batch_fast(["".join(group)], add_special_tokens=False)[0].ids, kind)
                cuts = np.flatnonzero(opens[ids]) * id_bytes
                if len(cuts) == len(group):
                    raw, ends = ids.tobytes(), [*cuts[1:].tolist(), len(ids) * id_bytes]
                    found.update(zip(group, map(raw.__getitem__, map(slice, cuts.tolist(), ends))))
            rest = [p for p in pieces if p not in found]
            found.update(zip(rest, whole(rest)))
            return [found[p] for p in pieces]

        pieces = PieceEncoder(public_tokenizers.PATTERN, resolve)

        def encode_all(texts: list[str]) -> list[bytes]:
            steady = [is_steady(t) and not any(a in t for a in added) for t in texts]
            found = iter(pieces.encode_all([t for t, s in zip(texts, steady) if s]))
            return [next(found) if s else whole([t])[0] for t, s in zip(texts, steady)]

        _encoders[key] = encode_all
    return _encoders[key]


def id_width(tokenizer_json: bytes) -> int:
    from tokenizers import Tokenizer

    return 2 if Tokenizer.from_str(tokenizer_json.decode()).get_vocab_size() <= 1 << 16 else 4


def train_dictionary(arrays: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A zstandard dictionary over serialised id arrays; b"" (no dictionary) only if there is no id at all.

    Long arrays are cut into samples.  Where these are too few for the trainer, they are the dictionary's content as
    they are.
    """
    import zstandard

    samples = [x[i : i + SAMPLE_BYTES] for x in arrays for i in range(0, len(x), SAMPLE_BYTES)]
    content = b"".join(samples)
    try:
        return zstandard.train_dictionary(max(256, min(size, len(content) // 8)), samples).as_bytes()
    except zstandard.ZstdError:
        return content[-size:]


def _zdict(raw: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(raw) if raw else None


class ShardWriter:
    def __init__(self, root: str, name: str, dictionary: bytes, id_bytes: int, level: int = 3):
        import zstandard

        self.fs, base = filesystem(root)
        self.uri, self.path = f"{root}/{name}", f"{base}/{name}"
        self.temp = f"{base}/_{uuid.uuid4().hex}.tmp"
        self.fs.create_dir(base, recursive=True)
        self.out = self.fs.open_output_stream(self.temp)
        self.out.write(MAGIC)
        self.at, self.index, self.tokens = len(MAGIC), [], 0
        self.id_bytes, self.sha = id_bytes, hashlib.sha256(dictionary).digest()
        self.pack = zstandard.ZstdCompressor(level=level, dict_data=_zdict(dictionary), write_content_size=True, write_dict_id=False)

    def add(self, key: int | None, ids: bytes) -> None:
        frame, n = self.pack.compress(ids), len(ids) // self.id_bytes
        self.out.write(frame)
        self.index.append((key is None, key or 0, self.at, len(frame), n))
        self.at += len(frame)
        self.tokens += n

    def close(self) -> tuple[int, int, int]:
        """(documents, tokens, bytes)"""
        import zstandard

        index = zstandard.compress(np.array(self.index, "<i8").reshape(-1, 5).T.tobytes(), 3)
        self.out.write(index)
        self.out.write(TAIL.pack(len(index), len(self.index), self.id_bytes, self.sha, MAGIC))
        self.out.close()
        self.fs.move(self.temp, self.path)
        return len(self.index), self.tokens, self.at + len(index) + TAIL.size


class ShardReader:
    """Random access to the documents of a shard: ``len``, ``null`` (keys), ``keys``, ``n_tokens`` and ``ids(i)``."""

    def __init__(self, uri: str):
        import zstandard

        self.fs, path = filesystem(uri)
        self.file = self.fs.open_input_file(path)
        size = self.file.size()
        n_index, n_docs, self.id_bytes, sha, magic = TAIL.unpack(self.file.read_at(TAIL.size, size - TAIL.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is no token shard")
        index = zstandard.decompress(self.file.read_at(n_index, size - TAIL.size - n_index))
        null, self.keys, self.offsets, self.lengths, self.n_tokens = np.frombuffer(index, "<i8").reshape(5, n_docs)
        self.null = null.astype(bool)
        self.sha = sha.hex()
        dictionary = b""
        if sha != hashlib.sha256(b"").digest():
            with self.fs.open_input_file(f"{path.rpartition('/')[0]}/dict-{self.sha}.zdict") as f:
                dictionary = f.read()
            if hashlib.sha256(dictionary).digest() != sha:
                raise ValueError(f"the dictionary of {uri} is not the one it was written with")
        self.unpack = zstandard.ZstdDecompressor(dict_data=_zdict(dictionary))

    def __len__(self) -> int:
        return len(self.keys)

    def ids(self, i: int) -> np.ndarray:
        frame = self.file.read_at(int(self.lengths[i]), int(self.offsets[i]))
        return np.frombuffer(self.unpack.decompress(frame), f"<u{self.id_bytes}")

    def all_ids(self, block: int = 4 << 20) -> Iterator[np.ndarray]:
        """The ids of every document in turn, reading about ``block`` bytes at a time."""
        i, n = 0, len(self)
        while i < n:
            j = max(i + 1, int(np.searchsorted(self.offsets, self.offsets[i] + block)))
            start = int(self.offsets[i])
            raw = self.file.read_at(int(self.offsets[j - 1] + self.lengths[j - 1]) - start, start)
            for k in range(i, j):
                at = int(self.offsets[k]) - start
                yield np.frombuffer(self.unpack.decompress(raw[at : at + int(self.lengths[k])]), f"<u{self.id_bytes}")
            i = j

    def close(self) -> None:
        self.file.close()


def write_token_shards(docs: DataFrame, root: str, tokenizer_path: str, key: str = "doc_id", text: str = "text", end_id: int = 0, dict_docs: int = DICT_DOCS, level: int = 3) -> DataFrame:
    """Encodes every text of ``docs`` and writes the shards below ``root``; returns the manifest, read from there.

    A null text is empty; every document gets ``end_id`` appended, so an empty one has one id.  Documents are ordered
    by key (null first), repeated keys by a hash of the text.  Other columns are not read.  An empty table gives an
    empty manifest.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, "rb") as f:
        raw = f.read()
    width = id_width(raw)
    docs = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    encode_all = piece_encoder(raw, width)
    end = end_id.to_bytes(width, "little")
    # the share of the rows that goes to be ordered holds the least hashes, and twice as many as are wanted
    rows = docs.count()
    most = int(min(1.0, (2.0 * dict_docs + 64.0) / max(rows, 1)) * (1 << 52))
    h = F.pmod(F.xxhash64("key", F.octet_length("text"), F.substring("text", 1, 64)), F.lit(1 << 52))
    long = F.length("text") - DICT_CHARS
    stretch = F.when(long > 0, F.substring("text", (F.pmod("h", F.greatest(long, F.lit(1))) + 1).cast("int"), F.lit(DICT_CHARS))).otherwise(F.col("text"))
    least = docs.withColumn("h", h).filter(F.col("h") <= most).select("h", "key", stretch.alias("text"))
    sampled = least.orderBy("h", "key", "text").limit(dict_docs).select("text").collect()
    samples = [ids + end for ids in encode_all([t for (t,) in sampled])]
    dictionary = train_dictionary(samples)
    sha = hashlib.sha256(dictionary).hexdigest()
    fs, base = filesystem(root)
    fs.create_dir(base, recursive=True)
    if dictionary:
        with fs.open_output_stream(f"{base}/dict-{sha}.zdict") as f:
            f.write(dictionary)
    shared = spark.sparkContext.broadcast((raw, dictionary))  # a vocabulary and at most DICT_BYTES

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, zdict = shared.value
        encode_all = piece_encoder(tokenizer, width)
        part, shard = TaskContext.get().partitionId(), None
        for batch in batches:
            for k, ids in zip(batch.column(0).to_pylist(), encode_all(batch.column(1).to_pylist())):
                shard = shard or ShardWriter(root, f"part-{part:06d}-{uuid.uuid4().hex}.tok", zdict, width, level)
                shard.add(k, ids + end)
        if shard:
            n, tokens, size = shard.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [shard.uri], "n_docs": [n], "n_tokens": [tokens], "n_bytes": [size], "dict_sha256": [sha]})

    salt = F.xxhash64("text")  # splits a key that very many rows repeat
    shards = docs.withColumn("salt", salt).repartitionByRange("key", "salt").sortWithinPartitions("key", "salt", "text").select("key", "text").transform(arrow_map, write, MANIFEST)
    shards.write.mode("overwrite").parquet(f"{root}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{root}/manifest")


def read_token_shards(manifest: DataFrame) -> DataFrame:
    """Every document of the shards: doc_id, start (ids before it), n_tokens and ids_crc32, from the files alone."""
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = manifest.withColumn("start", before).select("path", "start")  # one row for each shard

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shard = ShardReader(path)
                crc = np.fromiter((zlib.crc32(ids.astype("<u4").tobytes()) for ids in shard.all_ids()), "i8", len(shard))
                n = shard.n_tokens
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(shard.keys, pa.int64(), mask=shard.null), "start": start + np.cumsum(n) - n, "n_tokens": np.array(n), "ids_crc32": crc})
                shard.close()

    spark = manifest.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return files.repartition(tasks).transform(arrow_map, read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query: documents -> shards in the shared folder -> what the files hold."""
    import public_tokenizers

    root = fresh_dir(spark, "tokens")
    return read_token_shards(write_token_shards(table(spark, sf_dir, "documents"), root, public_tokenizers.path("byte_bpe_50k.json")))

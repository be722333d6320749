"""Token-id files: fixed-width bit packing with block offsets.

One file holds the ids of consecutive documents. Layout, little-endian:

    magic "MTTOK1\\0\\0" | header: 6 unsigned 64-bit: bits, block, n_ids, n_docs, part, number
    | doc ids, n_docs signed 64-bit | null marks, n_docs bytes | starts, n_docs + 1 unsigned 64-bit, within the file
    | block offsets, n_blocks + 1 unsigned 64-bit, from the start of the packed data | packed data | 8 zero bytes

Each id takes the least number of bits that holds the vocabulary's largest id; every block of ``block`` ids starts at a
byte, so a block is found by its offset and unpacked alone, with whole-array shifts.

The writer range-partitions by doc_id, and each task streams its documents in order into files of bounded size. A task
writes under a name of its own attempt and reports the names; what a lost attempt left is in no report and is not read.

Defined cases: a null or empty text has the end id alone. Null doc_ids come first; rows of equal doc_id stand in the
order of their texts. An added token's string in a text is that token, as in the library's call. Input columns other than doc_id and text are
ignored. An empty table writes no file and gives an empty result.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshtide.llm.bpe import ship
from meshtide.llm.shared import Scratch, arrow_map, per_worker

MAGIC = b"MTTOK1\0\0"
HEADER = "<8s6Q"
BLOCK = 4096
FILE_IDS = 1 << 22
CACHED = 1_000_000
LINES = 200
# texts not to be cut: a NUL, spaces other than single blanks and line feeds between words
ODD = r"^[ \n]|[ \n]$|[ \n][ \n]|[\x00\t\x0b-\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def width_of(n_ids: int) -> int:
    """Bits of a vocabulary of ``n_ids`` ids."""
    return max(1, (n_ids - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Bit i * bits is the lowest of id i."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if bits % 8 == 0:
        return raw[:, :bits // 8].tobytes()
    return np.packbits(np.unpackbits(raw, axis=1, bitorder="little")[:, :bits], bitorder="little").tobytes()


def unpack(data: np.ndarray, n: int, bits: int, first: int = 0) -> np.ndarray:
    """Ids first..first+n of a packed run; ``data`` has 8 bytes to spare at its end."""
    at = (np.arange(first, first + n, dtype=np.int64)) * bits
    words = np.ndarray((max(len(data) - 7, 0),), "<u8", data, 0, (1,))
    return ((words[at >> 3] >> (at & 7).astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.uint32)


def pack_file(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, bits: int, part: int, number: int, block: int = BLOCK) -> bytes:
    packed = [pack(ids[i:i + block], bits) for i in range(0, len(ids), block)]
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in packed])]).astype("<u8")
    starts = np.concatenate([[0], np.cumsum(lengths)]).astype("<u8")
    return b"".join([
        struct.pack(HEADER, MAGIC, bits, block, len(ids), len(doc_ids), part, number),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(), bytes(d is None for d in doc_ids), starts.tobytes(), offsets.tobytes(),
        *packed, bytes(8)])


@dataclass
class TokenFile:
    """Random access over the bytes of one file."""

    data: bytes

    def __post_init__(self) -> None:
        magic, self.bits, self.block, self.n_ids, self.n_docs, self.part, self.number = struct.unpack_from(HEADER, self.data)
        if magic != MAGIC:
            raise ValueError("not a token file")
        at = struct.calcsize(HEADER)
        self.doc_ids = np.frombuffer(self.data, "<i8", self.n_docs, at)
        at += 8 * self.n_docs
        self.is_null = np.frombuffer(self.data, bool, self.n_docs, at)
        at += self.n_docs
        self.starts = np.frombuffer(self.data, "<u8", self.n_docs + 1, at).astype(np.int64)
        at += 8 * (self.n_docs + 1)
        n_blocks = -(-self.n_ids // self.block)
        self.offsets = np.frombuffer(self.data, "<u8", n_blocks + 1, at).astype(np.int64)
        self.packed = np.frombuffer(self.data, np.uint8, offset=at + 8 * (n_blocks + 1))

    def ids(self, first: int, last: int) -> np.ndarray:
        """Ids at positions first..last of the file; touches only their blocks."""
        out = []
        for b in range(first // self.block, -(-last // self.block)):
            lo, hi = max(first - b * self.block, 0), min(last - b * self.block, self.block)
            out.append(unpack(self.packed[self.offsets[b]:self.offsets[b + 1] + 8], hi - lo, self.bits, lo))
        return np.concatenate([np.zeros(0, np.uint32), *out])

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, start in the file, ids), a bounded run of blocks at a time."""
        i = 0
        while i < self.n_docs:
            j = i + 1
            while j < self.n_docs and self.starts[j + 1] - self.starts[i] <= 1 << 20:
                j += 1
            ids = self.ids(int(self.starts[i]), int(self.starts[j]))
            for k in range(i, j):
                a, b = self.starts[k] - self.starts[i], self.starts[k + 1] - self.starts[i]
                yield None if self.is_null[k] else int(self.doc_ids[k]), int(self.starts[k]), ids[a:b]
            i = j


def write_bytes(folder: str, data: bytes) -> str:
    """Write a new file into a folder given by URI or absolute path; its name."""
    from pyarrow.fs import FileSystem, LocalFileSystem

    local = folder.removeprefix("file:")
    if local.startswith("/"):
        fs, path = LocalFileSystem(), "/" + local.lstrip("/")
    else:
        fs, path = FileSystem.from_uri(folder.replace("s3a://", "s3://", 1))
    name = f"{uuid.uuid4().hex}.tok"
    fs.create_dir(path, recursive=True)
    with fs.open_output_stream(f"{path}/{name}") as out:
        out.write(data)
    return name


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())


class Encoder:
    """A tokenizer with a bounded cache of parts that no token crosses.

    A batch of texts is cut and looked up by Arrow kernels; only distinct new parts are tokenized, and no part becomes a
    Python string of its own. The ids of all texts are then one gather from the cache.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # the library takes an added token's string for the token; a text that holds one goes to it whole, as one with other spaces
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.odd = "|".join([ODD, *map(re.escape, added)])
        self.line_feed, = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.forget()

    def forget(self) -> None:
        self.parts = pa.array(["", "\n"], pa.large_string())
        self.ids = pa.array([[], [self.line_feed]], pa.large_list(pa.uint32()))

    def encode(self, texts: list[str]) -> list[bytes]:
        ids, lengths = self.encode_all(pa.array(texts, pa.string()))
        ends = np.cumsum(lengths)
        return [ids[a:b].tobytes() for a, b in zip(ends - lengths, ends, strict=True)]

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each text has."""
        texts = texts.cast(pa.large_string())
        odd = pc.match_substring_regex(texts, self.odd)
        # a blank belongs to what follows it and a line feed is a match of its own, so texts are cut before blanks and around line feeds
        marked = pc.replace_substring(pc.if_else(odd, "", texts), "\n", "\0\n\0")
        parts = pc.split_pattern(pc.replace_substring(marked, " ", "\0 "), "\0")
        first = parts.offsets.to_numpy() - parts.offsets[0].as_py()
        number, held = self.numbers(parts.flatten()).to_numpy(), self.ids
        at = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        if len(at):
            whole = [self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids for i in at.tolist()]
            number = number.copy()
            number[first[at]] = np.arange(len(held), len(held) + len(at))
            held = pa.concat_arrays([held, pa.array(whole, held.type)])
        found = held.take(pa.array(number))
        return found.flatten().to_numpy(), np.diff(found.offsets.to_numpy()[first])

    def numbers(self, parts: pa.Array) -> pa.Array:
        """Places in the cache of parts of texts without odd spaces; new parts are learnt."""
        number = pc.index_in(parts, self.parts)
        if number.null_count:
            new = parts.filter(number.is_null()).unique()
            if len(self.parts) + len(new) > CACHED:
                self.forget()
                new = parts.unique()
                new = new.filter(pc.index_in(new, self.parts).is_null())
            self.learn(new)
            number = pc.index_in(parts, self.parts)
        return number

    def learn(self, new: pa.Array) -> None:
        """Put the ids of new distinct parts into the cache.

        Many parts go to the tokenizer as lines of one text: a line feed is a token of its own, which no other part has,
        so its id marks where a part ends.
        """
        starts = pa.array([*range(0, len(new), LINES), len(new)], pa.int64())
        lines = pc.binary_join(pa.LargeListArray.from_arrays(starts, new).cast(pa.list_(pa.large_string())), pa.scalar("\n", pa.large_string())).to_pylist()
        found = []
        for e in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False):
            found += [np.array(e.ids, np.uint32), np.array([self.line_feed], np.uint32)]
        ids = np.concatenate([np.zeros(0, np.uint32), *found])
        ends = np.flatnonzero(ids == self.line_feed)
        offsets = np.concatenate([[0], ends - np.arange(len(ends))])
        learnt = pa.LargeListArray.from_arrays(pa.array(offsets), pa.array(ids[ids != self.line_feed]))
        self.parts, self.ids = pa.concat_arrays([self.parts, new]), pa.concat_arrays([self.ids, learnt])


def encoder(name: str) -> Encoder:
    return per_worker(("tokenizer", name), lambda: Encoder(SparkFiles.get(name)))


def write_tokens(docs: DataFrame, path: str, folder: str, end_id: int) -> DataFrame:
    """Encode ``docs`` into files of ``folder``; the lazy report of (name, part, number, n_ids), to be run once."""
    from tokenizers import Tokenizer

    name, bits = ship(docs, path), width_of(max(Tokenizer.from_file(path).get_vocab_size(), end_id + 1))

    def run(batches):
        own, part, number = encoder(name), TaskContext.get().partitionId(), 0
        doc_ids, lengths, held = [], [], []

        def flush():
            ids = np.concatenate(held)
            out = {"name": [write_bytes(folder, pack_file(doc_ids, lengths, ids, bits, part, number))], "part": [part], "number": [number], "n_ids": [len(ids)]}
            for x in (doc_ids, lengths, held):
                x.clear()
            return out

        size = 0
        for b in batches:
            ids, n = own.encode_all(b["text"])
            doc_ids += b["doc_id"].to_pylist()
            lengths += (n + 1).tolist()
            held.append(np.insert(ids, np.cumsum(n), end_id))
            size += len(held[-1])
            if size >= FILE_IDS:
                yield flush()
                number, size = number + 1, 0
        if doc_ids:
            yield flush()

    ordered = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return arrow_map(ordered, run, "name string, part int, number int, n_ids long", holds=True)


def read_tokens(spark: SparkSession, folder: str, report: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the reported files."""

    def run(batches):
        for b in batches:
            for name, content in zip(b["path"].to_pylist(), b["content"], strict=True):
                out = {"name": [], "doc_id": [], "own": [], "n_tokens": [], "ids_crc32": []}
                for doc_id, start, ids in TokenFile(content.as_py()).documents():
                    for k, v in zip(out, (name.rsplit("/", 1)[-1], doc_id, start, len(ids), crc32(ids)), strict=True):
                        out[k].append(v)
                yield out

    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    read = arrow_map(files.select("path", "content"), run, "name string, doc_id long, own long, n_tokens long, ids_crc32 long")
    # a file starts after the files before it in its part, and after all earlier parts
    parts = report.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    starts = report.withColumn("inside", F.sum("n_ids").over(Window.partitionBy("part").orderBy("number")) - F.col("n_ids")).join(parts, "part")
    starts = starts.select("name", (F.col("before") + F.col("inside")).alias("base"))
    return read.join(starts, "name").select("doc_id", (F.col("base") + F.col("own")).alias("start"), "n_tokens", "ids_crc32")


def digests(docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    """The query's columns, from the files."""
    spark = docs.sparkSession
    with Scratch(spark) as scratch:
        folder = scratch.new_folder()
        report = scratch.cut(write_tokens(docs, path, folder, end_id))
        if report.isEmpty():
            return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
        scratch.keep(folder)
        scratch.keep(report)
    return read_tokens(spark, folder, report)

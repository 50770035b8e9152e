"""Token-ID output: length-delimited binary records with masked checksums, and an index of offsets.

A record is: payload length (unsigned 64-bit, little-endian), masked CRC-32 of those 8 bytes (unsigned 32-bit),
payload, masked CRC-32 of the payload. The payload is one byte, the bytes of an id (2 where all ids of the document are
below 65536, else 4), and the document's ids as little-endian unsigned integers, the end id last. Where it gets smaller so, the
byte is 128 more, and the number of ids (unsigned 64-bit, little-endian) and a Zstandard frame of them follow: each record is
still read alone. A mask rotates the CRC right by 15 bits and adds 0xA282EAD8. Files hold at most
`file_bytes` of records (one longer record has a file of its own). The index, in Parquet, has for each document its
file, offset and length, so that documents can be read in any order.

Texts are dealt into ranges of doc_id; each task encodes, frames and writes its range, so no task holds more than a
batch. File names carry the task attempt: a repeated attempt writes new files, and only the index rows of the
attempt that was committed are kept. Files are written and read through pyarrow's file systems, by the URI of the
shared folder.

Defined cases: null or empty text is a record with the end id alone. A null doc_id comes first in order. Rows that
repeat a doc_id each get a record, one after another. A very long text is one record, encoded word by word. An empty table
gives an empty index. Extra columns are not read, whatever their names.
"""

from __future__ import annotations

import codecs
import json
import os
import re
import string
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_batches, broadcast_if, new_folder, tidy

PUNCTUATION = string.punctuation
INDEX = "doc_id long, part int, local_start long, n_tokens long, ids_crc32 long, file string, offset long, length long"
#: Entries that a task's caches of words, and of their letters and punctuation, hold before they start anew.
CACHE_WORDS, CACHE_PIECES = 200_000, 200_000
#: How ids are compressed, and what a payload's first byte has more then.
ZSTD, COMPRESSED = pa.Codec("zstd", 1), 128
#: Words of a text that are looked up at once.
TOGETHER = 20_000
#: ASCII punctuation from a small letter on to the end of its word.
TAIL = re.compile(rb"[!-/:-@\[-`{-~](?<=[a-z].)[!-/:-@\[-`{-~]*(?=\s|$)")
#: The tokenizer settings under which words, and letters and the punctuation after them, have ids of their own.
WORDS_APART = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


class WordEncoder(dict):
    """Word (UTF-8, without ASCII white space) -> its ids as bytes.

    With the settings WORDS_APART, the tokenizer drops white space and merges within words only, so a text's ids are those
    of its words in turn; it likewise parts a word's letters from punctuation that follows them. With others, whole texts
    are encoded.

    The words of a text that are letters only and not known yet are merged by one call of the library, of a tokenizer
    with the same model that parts at blanks and normalises nothing; the others one by one.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        settings = {k: part and json.loads(part.__getstate__()) for k in WORDS_APART for part in [getattr(self.tokenizer, k)]}
        self.words_apart = type(self.tokenizer.model).__name__ == "BPE" and settings == WORDS_APART
        self.merge = self.tokenizer.model.tokenize
        self.spell = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.pieces: dict[str, bytes] = {}
        self.added = [x.content.lower().encode() for x in self.tokenizer.get_added_tokens_decoder().values()]
        if not self.words_apart:
            return
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        # Which ids end a word; none do in models without a mark for it.
        vocabulary, mark = self.tokenizer.get_vocab(with_added_tokens=False), self.tokenizer.model.end_of_word_suffix
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if mark and token.endswith(mark)]] = True
        # The model's character for each byte of the letters below U+0180, ASCII ones being their own.
        spelled = [chr(b) for b in range(128)] + ["?"] * 128
        for letter in map(chr, range(0x80, 0x180)):
            for byte, own in zip(letter.encode(), self.spell(letter)[0][0], strict=True):
                spelled[byte] = own
        self.spelled = "".join(spelled)

    def ids(self, text: bytes) -> bytes:
        if not self.words_apart:
            return packed(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids)
        words = self.words(text)
        return b"".join(b"".join(self.known(words[i : i + TOGETHER])) for i in range(0, len(words), TOGETHER))

    def words(self, text: bytes) -> list[bytes]:
        """Words in turn, their ids being the text's: with small ASCII letters, and punctuation at the end for itself.

        Texts keep their case where it may decide: before a combining mark (from U+0300 to U+037F at most, for those that
        compose with ASCII), which composes with some small letters only, and with tokens that stand for themselves.
        """
        low = text.lower()
        if b"\xcc" in text or b"\xcd" in text or any(x in low for x in self.added):
            return text.split()
        return TAIL.sub(rb" \g<0>", low).split()

    def known(self, words: list[bytes]) -> list[bytes]:
        """Each word's ids."""
        found = list(map(self.get, words))
        if places := [i for i, ids in enumerate(found) if ids is None]:
            new = {words[i] for i in places}
            if len(self) + len(new) > CACHE_WORDS:
                self.clear()
            if plain := [x for x in b" ".join(new).decode().split(" ") if is_plain(x)]:
                self.merge_all(plain)
            for i in places:
                found[i] = self[words[i]]
        return found

    def merge_all(self, plain: list[str]) -> None:
        """Adds words of letters that is_plain accepts."""
        joined = " ".join(plain)
        spelled, _ = codecs.charmap_decode(joined.lower().encode(), "strict", self.spelled)
        ids = np.array(self.model.encode_batch_fast([spelled], add_special_tokens=False)[0].ids, "<u4")
        ends = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
        if len(ends) == len(plain):  # else they are merged one by one, when they are asked for
            found = ids.tobytes()
            self.update(zip(joined.encode().split(b" "), [found[a:b] for a, b in zip([0, *ends], ends)]))

    def piece(self, text: str, letters: bool) -> bytes:
        """Ids of lower-case letters, or of punctuation."""
        if (ids := self.pieces.get(text)) is None:
            if len(self.pieces) >= CACHE_PIECES:
                self.pieces.clear()
            if letters:
                found = [x.id for x in self.merge(text if text.isascii() else self.spell(text)[0][0])]
            else:
                found = self.tokenizer.encode(text, add_special_tokens=False).ids
            ids = self.pieces[text] = packed(found)
        return ids

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        text = word.decode()
        letters = text.rstrip(PUNCTUATION)
        if is_plain(letters):
            ids = self.piece(letters.lower(), True)
            if len(letters) < len(text):
                ids += self.piece(text[len(letters) :], False)
        else:
            ids = packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
        self[word] = ids
        return ids


def is_plain(letters: str) -> bool:
    """Whether these are Latin letters that normalising leaves alone but for case, one by one."""
    return letters.isalpha() and (letters.isascii() or max(letters) < "\u0180" and "\u0130" not in letters)


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def masked(crc: int) -> int:
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def payload_of(ids: bytes) -> bytes:
    """From ids of 32 bits."""
    wide = np.frombuffer(ids, "<u4")
    size, plain = (2, wide.astype("<u2").tobytes()) if wide.max(initial=0) < 1 << 16 else (4, ids)
    small = ZSTD.compress(plain, asbytes=True)
    return struct.pack("<BQ", size + COMPRESSED, len(wide)) + small if len(small) + 8 < len(plain) else bytes([size]) + plain


def ids_of(payload: bytes) -> bytes:
    """Ids of 32 bits."""
    size, plain = payload[0], memoryview(payload)[1:]
    if size > COMPRESSED:
        size -= COMPRESSED
        (n,) = struct.unpack_from("<Q", plain)
        plain = ZSTD.decompress(plain[8:], n * size, asbytes=True)
    return bytes(plain) if size == 4 else np.frombuffer(plain, "<u2").astype("<u4").tobytes()


def framed(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(zlib.crc32(head))), payload, struct.pack("<I", masked(zlib.crc32(payload)))))


def unframed(record: bytes, where: str) -> bytes:
    (size,), (head_crc,) = struct.unpack_from("<Q", record), struct.unpack_from("<I", record, 8)
    if head_crc != masked(zlib.crc32(record[:8])) or len(record) != size + 16:
        raise ValueError(f"{where}: the record's length does not hold")
    payload = record[12:-4]
    if struct.unpack_from("<I", record, size + 12)[0] != masked(zlib.crc32(payload)):
        raise ValueError(f"{where}: the record's ids do not hold")
    return payload


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri else fs.FileSystem.from_uri(uri.replace("file:", "file://", 1) if uri.startswith("file:") else f"file://{uri}")


def writer(folder: str, tokenizer: str, end_id: int, file_bytes: int):
    @tidy
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, task = WordEncoder(tokenizer), TaskContext.get()  # the caches end with the task
        system, root = opened(folder)
        system.create_dir(root, recursive=True)
        part, files, at, total, out, end = task.partitionId(), 0, 0, 0, None, packed([end_id])
        name = ""
        try:
            for batch in batches:
                rows = []
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    ids = words.ids(text or b"") + end
                    record = framed(payload_of(ids))
                    if out is None or at and at + len(record) > file_bytes:
                        if out is not None:
                            out.close()
                        name = f"part-{part:06d}-{files:05d}-{task.taskAttemptId()}.rec"
                        out, at, files = system.open_output_stream(f"{root}/{name}"), 0, files + 1
                    out.write(record)
                    n = len(ids) // 4
                    rows.append((doc_id, part, total, n, zlib.crc32(ids), name, at, len(record)))
                    at, total = at + len(record), total + n
                if rows:
                    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
                    names = [x.split()[0] for x in INDEX.split(", ")]
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        finally:
            if out is not None:
                out.close()

    return write


def write_records(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1, ranges: int | None = None, file_bytes: int = 16 << 20) -> DataFrame:
    """Writes docs' ids below folder in ascending doc_id order; returns the index: doc_id, start, n_tokens, file, offset, length."""
    spark = docs.sparkSession
    arrow_batches(spark)
    ranges = ranges or max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).repartitionByRange(ranges, "doc_id").sortWithinPartitions("doc_id")
    dealt.mapInArrow(writer(f"{folder}/records", tokenizer, end_id, file_bytes), INDEX).write.parquet(f"{folder}/parts")
    index = spark.read.parquet(f"{folder}/parts")
    # One row for each range that was written: as many as tasks, whatever the number of documents.
    parts = index.groupBy("part").agg(F.sum("n_tokens").alias("_tokens"))
    before = F.coalesce(F.sum("_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = parts.select("part", before.alias("_before"))
    index.join(broadcast_if(offsets, ranges, 100_000), "part").select(
        "doc_id", (F.col("_before") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32", "file", "offset", "length"
    ).write.parquet(f"{folder}/index")
    return spark.read.parquet(f"{folder}/index")


def reader(folder: str):
    @tidy
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = opened(folder)
        name, file = None, None
        for batch in batches:
            counts, crcs = [], []
            for where, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True):
                if where != name:
                    if file is not None:
                        file.close()
                    name, file = where, system.open_input_file(f"{root}/{where}")
                ids = ids_of(unframed(file.read_at(length, offset), f"{where} at {offset}"))
                counts.append(len(ids) // 4)
                crcs.append(zlib.crc32(ids))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), pa.array(counts, pa.int64()), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
        if file is not None:
            file.close()

    return read


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each record, from the files' bytes; checksums are verified."""
    arrow_batches(spark)
    index = spark.read.parquet(f"{folder}/index").select("doc_id", "start", "file", "offset", "length")
    return index.mapInArrow(reader(f"{folder}/records"), "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_to_files(docs: DataFrame, tokenizer: str, **settings) -> DataFrame:
    """Writes docs to a new folder of the shared one and reads the records back."""
    folder = new_folder(docs.sparkSession, "tokens")
    write_records(docs, folder, tokenizer, **settings)
    return read_records(docs.sparkSession, folder)

"""Token ids in binary files of fixed-width bit packing.

A file is a row of records, each ended by one line feed. A record holds a block of documents:

    magic       8 bytes   b"FWIDBLK1"
    bits        uint32    bits of an id: the fewest that hold the largest id of the vocabulary
    block       uint32    ids in a packed block
    documents   uint64
    ids         uint64
    payload     uint64    bytes of all packed blocks
    doc ids     int64 for each document, and one byte each that is 1 where the id is null
    ends        uint64 for each document: ids up to and including it
    offsets     uint64 for each packed block and one more: where it starts in the payload
    payload     blocks, each packed from the lowest bit of its first byte up and filled to a whole byte

All numbers are little-endian. Offsets give any slice of ids without reading the rest, and a block is unpacked by numpy at once.
Files are written by Spark's own writer through the commit protocol, so a lost executor leaves no half file, and read by its
binary file reader; both work on any store Spark reads. They are in ascending doc_id order (nulls first), within a file and from file
to file by name.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import shared_folder, stored
from .common import arrow_map, held, parts_for

MAGIC = b"FWIDBLK1"
HEAD = struct.Struct("<8sIIQQQ")
BLOCK = 4096
DOCUMENTS = 512
CACHED = 300_000
LONG = 100
PROBES = ["Two  words, it's 12.\nÉté naïve... (x) A. b", "STRASSE straße 3.4 a,b"]
#: A character that is no Latin letter and not printed ASCII or usual white space.
_ODD = re.compile("[^\t\n\r -~\xa1-\xac\xae-\u024f]")
_LATIN = re.compile("[a-z\xdf-\u024f]+")
#: Byte-level form: bytes that print stand for themselves, the others, in order, for the characters from 256 on.
_SHOWN = {b: 256 + i for i, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b))}
_GAPS = re.compile("[ \t\n\r\x0b\x0c]+")
#: A dot or comma beside another mark.
_MARKS = re.compile(r"[^\w\s][.,]|[.,](?=[^\w\s])|_[.,]")


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    return np.packbits(((ids.astype(np.uint64)[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).reshape(-1), bitorder="little").tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    one = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return (one.astype(np.uint64) << np.arange(bits, dtype=np.uint64)).sum(axis=1).astype(np.uint32)


def record(doc_ids: list[int | None], ids: list[np.ndarray], bits: int, block: int = BLOCK) -> bytes:
    flat = np.concatenate([*ids, np.zeros(0, np.uint32)])
    blocks = [pack(flat[i:i + block], bits) for i in range(0, len(flat), block)]
    offsets = np.cumsum([0, *map(len, blocks)], dtype="<u8")
    return b"".join([HEAD.pack(MAGIC, bits, block, len(ids), len(flat), int(offsets[-1])), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), bytes(d is None for d in doc_ids),
                     np.cumsum([len(x) for x in ids], dtype="<u8").tobytes(), offsets.tobytes(), *blocks])


class Record:
    """A view of the record that starts at `at`."""

    def __init__(self, data: bytes, at: int = 0):
        self.data = data
        magic, self.bits, self.block, n, self.n_ids, payload = HEAD.unpack_from(data, at)
        if magic != MAGIC:
            raise ValueError(f"no record at byte {at}")
        at += HEAD.size
        null = np.frombuffer(data, np.uint8, n, at + 8 * n)
        self.doc_ids = [None if z else d for d, z in zip(np.frombuffer(data, "<i8", n, at).tolist(), null.tolist(), strict=True)]
        self.ends = np.frombuffer(data, "<u8", n, at + 9 * n).astype(np.int64)
        at += 17 * n
        self.offsets = np.frombuffer(data, "<u8", -(-self.n_ids // self.block) + 1, at).astype(np.int64)
        self.payload = at + 8 * len(self.offsets)
        self.stop = self.payload + payload + 1

    def slice(self, first: int, stop: int) -> np.ndarray:
        """Ids first to stop - 1: only the blocks that hold them are unpacked."""
        if first >= stop:
            return np.zeros(0, np.uint32)
        a, b = first // self.block, (stop - 1) // self.block + 1
        parts = [unpack(self.data[self.payload + self.offsets[i]:self.payload + self.offsets[i + 1]], min(self.block, self.n_ids - i * self.block), self.bits) for i in range(a, b)]
        return np.concatenate(parts)[first - a * self.block:stop - a * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.slice(int(self.ends[i - 1]) if i else 0, int(self.ends[i]))


def records(data: bytes) -> Iterator[Record]:
    at = 0
    while at < len(data):
        r = Record(data, at)
        yield r
        at = r.stop


class WordEncoder:
    """Ids of texts by a tokenizer that drops white space, so that what stands between white space is encoded by itself and looked
    up when it comes again. Every distinct piece is encoded by the tokenizer; at most two generations of `CACHED` pieces are held.

    In a plain text (Latin letters and ASCII, no two marks side by side) the tokenizer lowers every letter by itself and a dot or
    comma before white space is a match of its own, so both are done for the whole text and fewer pieces differ. A tokenizer that does not
    encode `PROBES` that way is given whole texts."""

    def __init__(self, model: str):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_str(model)
        self.model = self.tokenizer.model
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.by_piece = True            # any other tokenizer gets whole texts
        self.by_piece = [x.tolist() for x in self.encode(PROBES)] == [e.ids for e in self._whole(PROBES)]

    def _whole(self, texts: list[str | None]) -> list:
        return self.tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)

    def word(self, p: str) -> bytes:
        """A word of small Latin letters is in normal form and one match of the tokenizer's pattern, so its bytes, as the characters that
        stand for them, go to the tokenizer's model directly."""
        return b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(p if p.isascii() else p.encode().decode("latin-1").translate(_SHOWN))])

    def split(self, text: str | None) -> list[str]:
        if not text:
            return []
        if _ODD.search(text) or "<|" in text:
            return _GAPS.split(text)
        text = text.lower()
        if not _MARKS.search(text):
            text = text.replace(". ", " . ").replace(", ", " , ").replace(".\n", " .\n")
        return text.split()

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        if not self.by_piece:
            return [np.array(e.ids, np.uint32) for e in self._whole(texts)]
        split = [self.split(t) for t in texts]
        need = set().union(*split)
        if len(self.young) + len(need) > CACHED:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        new = []
        for p in need:
            if p not in young:
                if p in old:
                    young[p] = old[p]
                else:
                    new.append(p)
        whole = []
        for p in new:
            if _LATIN.fullmatch(p) and p.isalpha() and p == p.lower():
                young[p] = self.word(p)
            else:
                whole.append(p)
        for p, e in zip(whole, self.tokenizer.encode_batch_fast(whole, add_special_tokens=False), strict=True):
            young[p] = np.array(e.ids, "<u4").tobytes()
        out = [np.frombuffer(b"".join(map(young.__getitem__, pieces)), "<u4") for pieces in split]
        for p in new:
            if len(p) > LONG:
                del young[p]
        return out


def write(docs: DataFrame, model: str, end_id: int, folder: str) -> None:
    """Encodes every row of `docs` (doc_id, text; a null text is empty) with the tokenizer in `model`, a JSON text, appends `end_id`
    to each and writes the ids to `folder`. Texts are dealt to range partitions of about 32 MB of input, one file each."""
    import json
    content = json.loads(model)
    bits = max(max(content["model"]["vocab"].values()), max((t["id"] for t in content["added_tokens"]), default=0), end_id).bit_length()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        encoder = held(shared, WordEncoder)
        for b in batches:
            ids, texts = b["doc_id"].to_pylist(), b["t"].to_pylist()
            for i in range(0, len(ids), DOCUMENTS):
                rows = [np.r_[x, np.uint32(end_id)].astype(np.uint32) for x in encoder.encode(texts[i:i + DOCUMENTS])]
                yield {"value": [record(ids[i:i + DOCUMENTS], rows, bits)]}

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("t"), F.xxhash64("text").alias("tie"))
    order = ["doc_id", "tie"]
    placed = plain.repartitionByRange(parts_for(docs, 32 << 20), *order).sortWithinPartitions(*order)
    arrow_map(placed, run, "value binary").select(F.col("value").cast("string").alias("value")).write.text(folder)


def file_number(path: str) -> int:
    """The number of the partition that wrote a file. Names are no order: part-100000 sorts before part-99999."""
    return int(path.rsplit("/", 1)[-1].split("-", 2)[1].split(".")[0])


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the files of `folder`. Files are whole rows of one reader; the
    ids before each file come from the files' totals, one row each, in the order of their numbers."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            for path, data in zip(b["path"].to_pylist(), b["content"].to_pylist(), strict=True):
                before = 0
                for r in records(data):
                    docs = [r.document(i) for i in range(len(r.doc_ids))]
                    yield {"file": [file_number(path)] * len(docs), "doc_id": r.doc_ids, "local": np.r_[0, r.ends[:-1]] + before, "n_tokens": [len(x) for x in docs],
                           "ids_crc32": [zlib.crc32(x.astype("<u4").tobytes()) for x in docs]}
                    before += r.n_ids

    files = spark.read.format("binaryFile").load(folder).where("length > 0").select("path", "content")
    rows, _ = stored(arrow_map(files, run, "file long, doc_id long, local long, n_tokens long, ids_crc32 long"), "documents")
    totals = rows.groupBy("file").agg(F.sum("n_tokens").alias("ids"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)     # one row per file
    offsets, _ = stored(totals.select("file", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("before")), "offsets")
    return rows.join(F.broadcast(offsets), "file").select("doc_id", (F.col("before") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def written_and_read(docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    """Writes the ids of `docs` to a new folder on shared storage and reads them back. An empty table gives no rows; repeated rows
    come out repeated, one after the other; other columns do not matter."""
    with open(path, encoding="utf-8") as f:
        model = f.read()
    folder = shared_folder(docs.sparkSession, "token-files")
    write(docs, model, end_id, folder)
    return read(docs.sparkSession, folder)

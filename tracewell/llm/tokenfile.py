"""Token files: documents as token ids in patched frame-of-reference blocks.

Texts are ranged by id, so every task holds a stretch of the ids in order. A task encodes its
texts and streams two columns into one file: the ids of the tokens, and one (doc_id, length) per
document. A column is cut into blocks; a block stores its minimum and packs the differences at
the width that a percentile of them needs; wider ones go to the block's exception list, their
upper bits with their places. An index at the file's end gives where each block starts, so any
block can be read alone.

Files go to the folder all executors share. A task that runs twice writes two files under
different names, and only the names that came back in the result of the finished task are read.

Defined results: null and empty texts have only the end id; equal doc_ids stay neighbours in
any order; null doc_ids come first and are kept; an empty table has no documents. Other columns
are not read.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.memory import IdMemory
from tracewell.llm.text import LOWER, PIECE_BYTES, pieces, remembered, strings
from tracewell.session import cut_lineage, scratch_path
from tracewell.sources.files import resolve

BLOCK = 4096
PERCENTILE = 0.98
MAGIC = b"PFORBLK1"


def bit_lengths(values: np.ndarray) -> np.ndarray:
    """Bits that each unsigned 64-bit integer needs."""
    out = np.zeros(values.shape, np.uint8)
    rest = values.copy()
    for step in (32, 16, 8, 4, 2, 1):
        high = rest >= (np.uint64(1) << np.uint64(step))
        out += high.astype(np.uint8) * np.uint8(step)
        rest = np.where(high, rest >> np.uint64(step), rest)
    return out + (rest > 0).astype(np.uint8)


def pack(values: np.ndarray, width: int) -> bytes:
    """The low `width` bits of each value, least significant first."""
    if width == 0:
        return b""
    bits = np.unpackbits(
        values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : -(-width // 8)], axis=1, bitorder="little"
    )[:, :width]
    return np.packbits(bits.ravel(), bitorder="little").tobytes()


def unpack(raw: bytes, width: int, n: int) -> np.ndarray:
    if width == 0:
        return np.zeros(n, np.uint64)
    bits = np.unpackbits(np.frombuffer(raw, np.uint8), count=n * width, bitorder="little").reshape(n, width)
    out = np.zeros((n, 8), np.uint8)
    packed = np.packbits(bits, axis=1, bitorder="little")
    out[:, : packed.shape[1]] = packed
    return out.view("<u8").ravel()


HEAD = "<IQBI"  # values, minimum, width, exceptions
HEAD_BYTES = struct.calcsize(HEAD)


def encode_block(values: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    """One block of unsigned 64-bit integers, any number from one on."""
    low = values.min()
    rest = values - low
    widths = bit_lengths(rest)
    rank = min(len(values) - 1, int(np.ceil(percentile * len(values))) - 1)
    width = int(np.partition(widths, max(rank, 0))[max(rank, 0)])
    where = np.flatnonzero(widths > width)
    high = rest[where] >> np.uint64(width) if width < 64 else rest[where]
    return b"".join(
        [
            struct.pack(HEAD, len(values), int(low), width, len(where)),
            pack(rest, width),
            where.astype("<u4").tobytes(),
            high.astype("<u8").tobytes(),
        ]
    )


def decode_block(raw: bytes) -> np.ndarray:
    n, low, width, exceptions = struct.unpack_from(HEAD, raw)
    at = HEAD_BYTES
    size = -(-n * width // 8)
    out = unpack(raw[at : at + size], width, n)
    at += size
    where = np.frombuffer(raw, "<u4", exceptions, at)
    high = np.frombuffer(raw, "<u8", exceptions, at + 4 * exceptions)
    if exceptions:
        out[where] |= high << np.uint64(width)
    return out + np.uint64(low)


class ColumnWriter:
    """Cuts a growing column into blocks; holds less than a block and one append."""

    def __init__(self, sink, name: str):
        self.sink, self.name, self.rest, self.index, self.total = sink, name, [], [], 0
        self.waiting = 0

    def append(self, values: np.ndarray) -> None:
        self.rest.append(values.astype(np.uint64))
        self.waiting += len(values)
        if self.waiting >= BLOCK:
            whole = np.concatenate(self.rest)
            keep = len(whole) % BLOCK
            for at in range(0, len(whole) - keep, BLOCK):
                self._write(whole[at : at + BLOCK])
            self.rest, self.waiting = [whole[len(whole) - keep :]], keep

    def _write(self, values: np.ndarray) -> None:
        raw = encode_block(values)
        self.index.append([self.sink.tell(), len(raw), self.total])
        self.sink.write(raw)
        self.total += len(values)

    def close(self) -> dict:
        if self.waiting:
            self._write(np.concatenate(self.rest))
        return {"name": self.name, "values": self.total, "blocks": self.index}


class TokenFile:
    """Reads one file: its index at once, its blocks as they are asked for."""

    def __init__(self, path: str):
        system, inner = resolve(path)
        self.source = system.open_input_file(inner)
        size = self.source.size()
        length, magic = struct.unpack("<Q8s", self.source.read_at(16, size - 16))
        if magic != MAGIC:
            raise ValueError(f"{path} is no token file")
        footer = json.loads(self.source.read_at(length, size - 16 - length))
        self.columns = {c["name"]: c for c in footer}

    def blocks(self, name: str):
        for at, length, _ in self.columns[name]["blocks"]:
            yield decode_block(self.source.read_at(length, at))

    def read(self, name: str, first: int, count: int) -> np.ndarray:
        """Values first .. first + count: only the blocks that hold them."""
        found = [
            decode_block(self.source.read_at(length, at))[max(0, first - start) : max(0, first + count - start)]
            for at, length, start in self.columns[name]["blocks"]
            if start < first + count and start + BLOCK > first
        ]
        return np.concatenate(found) if found else np.zeros(0, np.uint64)


class Encoder:
    """Ids of texts by the tokenizers library, each different word encoded once per worker.

    Only where no token can lie across, a text is cut: at blanks and line ends, and between
    two ASCII characters of which one is a letter, the other a digit, or one is neither, an
    apostrophe apart. The vocabulary's own rules cut there too, so the ids are those of the
    whole text. Texts that spell a special token are encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.memory = IdMemory(self.encode, 1_000_000)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words and how many each has. A special token parts words of one call."""
        if not self.special:
            found = [f.ids for f in self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]
            return np.array([i for ids in found for i in ids], np.uint32), np.array([len(f) for f in found], np.int64)
        mark = self.special[0].decode()
        end = self.tokenizer.token_to_id(mark)
        texts = [b"".join(w + self.special[0] for w in words[k : k + 1000]).decode() for k in range(0, len(words), 1000)]
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        ids = np.concatenate([np.array(f.ids, np.uint32) for f in found])
        at = np.flatnonzero(ids == end)
        return ids[ids != end], np.diff(at, prepend=-1) - 1

    def __call__(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, first id of each row and the total)."""
        n = len(data)
        if n == 0:
            return np.zeros(0, np.uint32), np.zeros(len(offs), np.int64)
        data = LOWER[data]
        kind = KIND[data]
        cut = np.zeros(n + 1, bool)
        cut[1:n] = CUT[kind[:-1] * 8 + kind[1:]]
        cut[offs] = True
        bounds = np.flatnonzero(cut)
        first_word = np.searchsorted(bounds, offs)
        ids, ends = self.memory(strings(data, bounds))
        return ids, ends[first_word]


#: classes of bytes: blank, letter, digit, apostrophe or not ASCII (never cut at), others
BLANK, LETTER, DIGIT, GLUE, OTHER = range(5)
KIND = np.full(256, OTHER, np.uint8)
KIND[[0x20, 0x0A]] = BLANK
KIND[0x61:0x7B] = LETTER
KIND[0x30:0x3A] = DIGIT
KIND[[0x27, *range(0x80, 0x100)]] = GLUE
CUT = np.zeros(64, bool)
for _a in range(5):
    for _b in range(5):
        CUT[_a * 8 + _b] = _a != _b and GLUE not in (_a, _b) or (BLANK in (_a, _b) and _a != _b)


def encoded(column: pa.Array, path: str, end_id: int | None):
    """(first row, end row, ids, offsets) of pieces of a text column, an end id after each text."""
    coder = remembered(("encoder", path), lambda: Encoder(path))
    # larger pieces repeat more words
    for row, end, data, offs in pieces(column, 4 * PIECE_BYTES):
        raw = data.tobytes()
        if any(s in raw for s in coder.special):
            texts = [raw[a:b].decode() for a, b in zip(offs[:-1], offs[1:])]
            found = [f.ids for f in coder.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            ids = np.array([i for f in found for i in f], np.uint32)
            at = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int64)
        else:
            ids, at = coder(data, offs)
        if end_id is not None:
            ids = np.insert(ids, at[1:], np.uint32(end_id))
            at = at + np.arange(len(at))
        yield row, end, ids, at


MANIFEST = "part int, path string, documents long, tokens long"


def write_token_files(
    docs: DataFrame, tokenizer: str, folder: str, end_id: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Writes the files and returns their table: part (in id order), path, documents, tokens."""
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # ids only decide the ranges; texts follow in one shuffle
    ranged = chosen.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    ranged = ranged.select(F.spark_partition_id().alias("part"), "doc_id", "text")

    def run(batches):
        sink = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            if sink is None:
                part = batch.column(0)[0].as_py()
                path = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.pfor"
                system, inner = resolve(path)
                system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
                sink = system.open_output_stream(inner)
                ids = ColumnWriter(sink, "ids")
                names, lengths = ColumnWriter(sink, "doc_id"), ColumnWriter(sink, "length")
                known = ColumnWriter(sink, "has_id")
            column = batch.column(1)
            names.append(column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) ^ SIGN)
            known.append(pc.is_valid(column).to_numpy(zero_copy_only=False))
            for _, _, found, at in encoded(batch.column(2), tokenizer, end_id):
                ids.append(found)
                lengths.append(np.diff(at))
        if sink is None:
            return
        footer = json.dumps([c.close() for c in (ids, names, lengths, known)]).encode()
        sink.write(footer + struct.pack("<Q8s", len(footer), MAGIC))
        sink.close()
        yield pa.record_batch(
            [pa.array([part], pa.int32()), [path], pa.array([names.total]), pa.array([ids.total])],
            ["part", "path", "documents", "tokens"],
        )

    return cut_lineage(ranged.mapInArrow(run, MANIFEST))


#: order of signed integers as unsigned ones
SIGN = np.uint64(1 << 63)


def read_token_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone.

    A file's first start is the sum of the tokens of the files before it: the table has one row
    per file, so its running sum is small.
    """
    ordered = manifest.orderBy("part").collect()  # one row per written file
    at, placed = 0, []
    for r in ordered:
        placed.append((r.path, at))
        at += r.tokens
    spark = manifest.sparkSession
    files = spark.createDataFrame(placed, "path string, base long")
    files = files.repartition(max(1, len(placed)), "path") if len(placed) > 1 else files

    def run(batches):
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield from described(TokenFile(path), base)

    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def described(file: TokenFile, base: int):
    """Batches of rows of one file: ids stream through, a block at a time."""
    ids, held = file.blocks("ids"), np.zeros(0, np.uint32)
    columns = zip(file.blocks("doc_id"), file.blocks("length"), file.blocks("has_id"))
    for names, lengths, known in columns:
        crcs = []
        for n in lengths.astype(np.int64).tolist():
            crc, left = 0, n
            while left:
                if not len(held):
                    held = next(ids).astype("<u4")
                crc = zlib.crc32(held[:left].tobytes(), crc)
                taken = min(left, len(held))
                held, left = held[taken:], left - taken
            crcs.append(crc)
        sizes = lengths.astype(np.int64)
        starts = base + np.cumsum(sizes) - sizes
        base += int(sizes.sum())
        yield pa.record_batch(
            [
                pa.array((names ^ SIGN).view(np.int64), mask=known == 0),
                pa.array(starts), pa.array(sizes), pa.array(crcs, pa.int64()),
            ],
            ["doc_id", "start", "n_tokens", "ids_crc32"],
        )


def token_files(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes token files of the documents and returns what reading them back gives."""
    folder = scratch_path(docs.sparkSession, "tokens")
    return read_token_files(write_token_files(docs, tokenizer, folder, end_id, id_col, text_col))

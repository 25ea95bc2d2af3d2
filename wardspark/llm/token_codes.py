"""Token ids as directly addressable codes in files.

Every id is cut into 8-bit chunks. Level 0 holds the low chunk of every token;
a bitmap says which go on; level k+1 holds the next chunk of those only. A rank
directory (ones before every block of 512 bits) finds a token's place on the
next level, so any token is read without decoding its neighbours.

File: ``DAC1``, then 8-byte little-endian counts (documents, tokens, levels), the
document ids (with a null flag each), the end offset of every document, and per
level: length, chunks, bitmap, rank directory.

Documents are range-sorted by id and written in ascending order, equal ids by
text. Null text is empty, null ids come first, repeated rows are written each. Texts
are encoded whole, however long; every document ends with the end id. Other columns
are ignored, whatever their names. An empty table gives no file. Readers go by the
manifest and refuse a file that is not the one it lists.
"""

from __future__ import annotations

import hashlib
import re
import struct
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardspark.llm import common

BLOCK = 512
END_ID = 2
MANIFEST = "part int, segment int, name string, documents long, tokens long, sha256 string"
RESULT = "doc_id long, start long, n_tokens long, ids_crc32 long"


# ---- the code --------------------------------------------------------------
def encode(ids: np.ndarray) -> bytes:
    out, rest = [], ids if ids.dtype in (np.uint32, np.uint64) else ids.astype(np.uint64)
    while True:
        more = rest >> rest.dtype.type(8)
        on = more > 0
        bits = np.packbits(on, bitorder="little")
        blocks = np.add.reduceat(on, np.arange(0, len(on), BLOCK), dtype=np.int64) if len(on) else np.zeros(0, np.int64)
        ranks = np.concatenate([[0], np.cumsum(blocks)]).astype("<u8")
        out.append(struct.pack("<Q", len(rest)) + rest.astype(np.uint8).tobytes() + bits.tobytes() + ranks.tobytes())
        rest = more[on]
        if not len(rest):
            break
    return struct.pack("<Q", len(out)) + b"".join(out)


class Codes:
    """Random access to an encoded sequence."""

    def __init__(self, data: memoryview | bytes):
        data = memoryview(data)
        (levels,), at, self.levels = struct.unpack_from("<Q", data), 8, []
        for _ in range(levels):
            (n,) = struct.unpack_from("<Q", data, at)
            at += 8
            chunks = np.frombuffer(data, np.uint8, n, at)
            at += n
            bits = np.frombuffer(data, np.uint8, (n + 7) // 8, at)
            at += len(bits)
            ranks = np.frombuffer(data, "<u8", (n + BLOCK - 1) // BLOCK + 1, at)
            at += ranks.nbytes
            self.levels.append((chunks, bits, ranks))

    def __len__(self) -> int:
        return len(self.levels[0][0])

    @staticmethod
    def _rank(bits: np.ndarray, ranks: np.ndarray, i: int) -> int:
        """Ones before position i, from the directory and one block."""
        start = i // BLOCK * BLOCK
        inside = np.unpackbits(bits[start // 8 : i // 8 + 1], bitorder="little")[: i - start]
        return int(ranks[i // BLOCK]) + int(inside.sum())

    def __getitem__(self, i: int) -> int:
        value, shift = 0, 0
        for chunks, bits, ranks in self.levels:
            value |= int(chunks[i]) << shift
            if not bits[i // 8] >> (i % 8) & 1:
                break
            i, shift = self._rank(bits, ranks, i), shift + 8
        return value

    def slice(self, start: int, end: int) -> np.ndarray:
        """Ids of a range; each level is one run of neighbouring chunks."""
        out, at, shift = np.zeros(end - start, np.uint64), np.arange(end - start), 0
        for chunks, bits, ranks in self.levels:
            if end <= start:
                break
            out[at] |= chunks[start:end].astype(np.uint64) << np.uint64(shift)
            on = np.unpackbits(bits[start // 8 : (end + 7) // 8], bitorder="little")[start % 8 : start % 8 + end - start].astype(bool)
            first = self._rank(bits, ranks, start) if on.any() else 0
            at, start, shift = at[on], first, shift + 8
            end = start + len(at)
        return out


# ---- tokenising --------------------------------------------------------------
class Encoder(dict):
    """ids of a whole text through the tokenizers library, piece by piece.

    The byte-level pre-tokenizer always cuts before a single space between other
    characters, between a letter or digit and a full stop or comma, and around a
    lone line end; what lies between cuts is encoded alone, once, and kept. The store
    is emptied when it holds ``most`` pieces. A piece is looked up without its
    leading space; one that has none is marked by ``MARK``. A piece of letters is one
    word to the pre-tokenizer, too: the library's model gets it at once, its bytes
    spelled as byte-level tokenizers do.

    Texts in which those places are less plain are cut before single spaces only,
    texts that hold a special token or the mark not at all.
    """

    MARK = "\x01"

    def __init__(self, path: str, most: int = 800_000):
        common.cpu_quiet()
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        super().__init__()
        self.tokenizer, self.most = Tokenizer.from_file(path), most
        # Cutting is right only for byte-level tokenizers without normaliser that leave the first space alone.
        pre = self.tokenizer.pre_tokenizer
        self.cuts = self.tokenizer.normalizer is None and "ByteLevel(add_prefix_space=False" in repr(pre) and "use_regex=True" in repr(pre)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model if self.cuts and isinstance(self.tokenizer.model, BPE) else None

    def _ids(self, text: str) -> bytes:
        return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def __missing__(self, piece: str) -> bytes:
        text, letters = (piece[1:], piece[1:]) if piece[:1] == self.MARK else (" " + piece, piece)
        if self.model is not None and letters.isalpha() and max(letters) < OLD:
            made = _packed([t.id for t in self.model.tokenize(text.encode().decode("latin-1").translate(SPELLED))])
        else:
            made = self._ids(text)
        if len(piece) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[piece] = made
        return made

    def text(self, text: str) -> bytes:
        """Ids as little-endian 32-bit integers."""
        if not text:
            return b""
        mark = self.MARK
        if not self.cuts or mark in text or any(s in text for s in self.special):
            return self._ids(text)
        if text[0].isspace() or text[-1].isspace() or any(x in text for x in UNPLAIN):
            first, *rest = re.split(r"(?<=\S) (?=\S)", text)
            return self[mark + first] + b"".join(map(self.__getitem__, rest))
        if not LOOSE_STOP.search(text):
            text = text.replace(".", f" {mark}.").replace(",", f" {mark},")
        return b"".join(map(self.__getitem__, f"{mark}{text}".replace("\n", f" {mark}\n {mark}").split(" ")))


def _packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes() if LITTLE else struct.pack(f"<{len(ids)}I", *ids)


#: Whether this machine's own integers are those of the files.
LITTLE = sys.byteorder == "little" and array("I").itemsize == 4
#: Letters below are letters to every library, whatever its version of Unicode.
OLD = "\u0250"
#: How byte-level tokenizers spell bytes: printable ones as they are, the others in order from U+0100.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
SPELLED = {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in _SHOWN)}
#: White space other than the lone space or line end.
UNPLAIN = ["  ", " \n", "\n ", "\n\n", *(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n")]
#: A full stop or comma that does not follow a letter or digit.
LOOSE_STOP = re.compile(r"[.,](?<![^\W_].)")


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


# ---- files -------------------------------------------------------------------
def segment_bytes(doc_ids: list[int | None], ends: list[int], ids: np.ndarray) -> bytes:
    known = np.array([i is not None for i in doc_ids], np.uint8)
    plain = np.array([i or 0 for i in doc_ids], "<i8")
    return b"DAC1" + struct.pack("<QQ", len(doc_ids), len(ids)) + plain.tobytes() + known.tobytes() + np.array(ends, "<u8").tobytes() + encode(ids)


def open_segment(data: bytes) -> tuple[list[int | None], np.ndarray, Codes]:
    if data[:4] != b"DAC1":
        raise ValueError("not a token file")
    n, _ = struct.unpack_from("<QQ", data, 4)
    at = 20
    plain, known = np.frombuffer(data, "<i8", n, at), np.frombuffer(data, np.uint8, n, at + 8 * n)
    ends = np.frombuffer(data, "<u8", n, at + 9 * n).astype(np.int64)
    return [int(i) if k else None for i, k in zip(plain, known, strict=True)], ends, Codes(memoryview(data)[at + 17 * n :])


def _writer(folder: str, path: str, end_id: int, limit: int):
    kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, enc, end = TaskContext.get().partitionId(), 0, encoder(path), np.array([end_id], "<u4").tobytes()
        doc_ids, ends, parts, size = [], [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal n, doc_ids, ends, parts, size
            name = f"part-{part:05d}-{n:05d}.dac"
            data = segment_bytes(doc_ids, ends, np.frombuffer(b"".join(parts), "<u4"))
            common.write_file(folder, name, data)
            row = [part, n, name, len(doc_ids), size, hashlib.sha256(data).hexdigest()]
            n, doc_ids, ends, parts, size = n + 1, [], [], [], 0
            return pa.record_batch([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=[x.split()[0] for x in MANIFEST.split(", ")])

        for batch in common.slices(batches):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                made = enc.text(text) + end
                parts.append(made)
                size += len(made) // 4
                doc_ids.append(doc_id)
                ends.append(size)
                if size >= limit:
                    yield close()
        if doc_ids:
            yield close()

    return run


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, limit: int = 2_000_000) -> DataFrame:
    """Writes the token files into ``folder``; returns the manifest, committed last. A file holds about ``limit`` tokens."""
    spark = docs.sparkSession
    rows = common.texts(docs).repartitionByRange(common.partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    return common.saved(rows.mapInArrow(_writer(folder, tokenizer, end_id, limit), MANIFEST), f"{folder}/_manifest")


def _reader(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base, sha in zip(*[batch.column(c).to_pylist() for c in ("name", "base", "sha256")], strict=True):
                data = common.read_file(folder, name)
                if hashlib.sha256(data).hexdigest() != sha:
                    raise ValueError(f"{name} is not the file of the manifest")
                doc_ids, ends, codes = open_segment(data)
                starts = np.concatenate([[0], ends[:-1]])
                crc = [zlib.crc32(codes.slice(int(a), int(b)).astype("<u4").tobytes()) for a, b in zip(starts, ends, strict=True)]
                cols = [pa.array(doc_ids, pa.int64()), pa.array(starts + base), pa.array(ends - starts), pa.array(crc, pa.int64())]
                yield pa.record_batch(cols, names=[x.split()[0] for x in RESULT.split(", ")])

    return run


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files.

    The tokens before a file: those of the parts before, added up over one row a
    part (a writing task), and those of the files of its part before it.
    """
    spark = manifest.sparkSession
    parts = manifest.groupBy("part").agg(F.sum("tokens").alias("all"))
    before = F.sum("all").over(Window.orderBy("part")) - F.col("all")
    own = F.sum("tokens").over(Window.partitionBy("part").orderBy("segment")) - F.col("tokens")
    files = manifest.withColumn("own", own).join(F.broadcast(parts.select("part", before.alias("base"))), "part")
    files = files.select("name", (F.col("base") + F.col("own")).alias("base"), "sha256")
    return files.repartition(common.partitions(spark), "name").mapInArrow(_reader(folder), RESULT)


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = common.work_dir(spark, "tokens")
    return read(write(common.table(spark, sf_dir, "documents"), folder, vocabulary()), folder)


"""Token ids as length-delimited binary records with masked checksums, and an offset index for shuffled reads.

A record file is a row of frames, and nothing else:

    8 bytes  n, the payload's length, little-endian
    4 bytes  masked CRC-32 of those 8 bytes
    n bytes  the payload
    4 bytes  masked CRC-32 of the payload
    1 byte   0x0A

A CRC c is masked as ((c >> 15 | c << 17) + 0xA282EAD8) mod 2^32, so that a checksum over data that hold checksums is
still telling. A payload is the document's id (8 bytes, signed), 1 byte that says whether there is one, 1 byte w for
the width of a token id, and the ids, w bytes each, the end id last. All numbers are little-endian.

Frames go out through Spark's own text writer, as text whose line ends are the frames' last bytes. So files are
committed, retried and placed on any file system as those of any other Spark write.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import pairwise
from typing import BinaryIO

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import UPPER, fresh_path, worker_state, written

LOWER = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())
TOKENIZER = "word_bpe_49k.json"
END_ID = 1
MASK = 0xA282EAD8
#: Units whose ids a worker keeps, and the longest of them in bytes: about 120 MB. When these are full, rarer units are encoded anew.
KEPT_UNITS, KEPT_BYTES = 500_000, 32
#: Bytes of text whose units are found together.
TOGETHER = 1 << 20
#: Stands between units that are encoded in one call; units that hold it are encoded alone.
SEPARATOR = "|"


#: Bytes that a reader takes at a time.
CHUNK = 4 << 20


class CorruptRecord(ValueError):
    pass


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"%b%b%b%b\n" % (head, struct.pack("<I", masked(head)), payload, struct.pack("<I", masked(payload)))


def pack(doc_id: int | None, ids: bytes, width: int) -> bytes:
    return struct.pack("<qBB", doc_id or 0, doc_id is not None, width) + ids


def unpack(payload: bytes | memoryview) -> tuple[int | None, np.ndarray]:
    doc_id, known, width = struct.unpack_from("<qBB", payload)
    return doc_id if known else None, np.frombuffer(payload, dtype=f"<u{width}", offset=10).astype("<u4")


def read_frame(data: bytes | memoryview, at: int = 0) -> tuple[memoryview, int]:
    """The payload of the frame at a byte, and where the next begins. Raises CorruptRecord for anything but a whole frame."""
    view = memoryview(data)
    if len(view) < at + 12:
        raise CorruptRecord(f"no whole frame at byte {at}")
    n, check = struct.unpack_from("<QI", view, at)
    if masked(bytes(view[at : at + 8])) != check:
        raise CorruptRecord(f"the length at byte {at} fails its checksum")
    end = at + 12 + n
    if len(view) < end + 5:
        raise CorruptRecord(f"the frame at byte {at} is cut off")
    payload = view[at + 12 : end]
    if masked(bytes(payload)) != struct.unpack_from("<I", view, end)[0] or view[end + 4] != 10:
        raise CorruptRecord(f"the payload at byte {at} fails its checksum")
    return payload, end + 5


#: Words of the letters a to z and of Latin-1 beyond ASCII, as UTF-8: their class, and each lower case, depend on nothing else.
LETTERS = re.compile(rb"(?:[a-z]|\xC3[\x80-\x96\x98-\xB6\xB8-\xBF])+")
#: Kinds of bytes: white space; others that never part a word; digits; those letters; punctuation but for the apostrophe.
SPACE, OTHER, DIGIT, LETTER, MARK = range(5)
KIND = np.full(256, OTHER, dtype=np.uint8)
for _bytes, _kind in ((b" \t\n\r\x0b\x0c", SPACE), (b"0123456789", DIGIT), (bytes(range(97, 123)), LETTER), (b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~", MARK)):
    KIND[list(_bytes)] = _kind
#: For a byte's kind and that of the next: whether a unit ends between them.
_K = np.arange(5)
PARTS = (_K[:, None] == SPACE) != (_K[None, :] == SPACE)
PARTS |= (_K[:, None] >= DIGIT) & (_K[None, :] >= DIGIT) & ((_K[:, None] != _K[None, :]) | (_K[:, None] == DIGIT))
PARTS = PARTS.ravel()
GAP = re.compile(rb"[ \t\n\r\x0b\x0c]")
#: The first n bytes of a word of eight, as a mask.
FIRST = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=np.uint64)
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], dtype=np.uint64)


def pieces(raw: bytes, most: int) -> Iterator[bytes]:
    """raw, cut at white space into pieces of at most so many bytes where there is any."""
    at = 0
    while len(raw) - at > most:
        cut = max(raw.rfind(c, at + 1, at + most) for c in (b" ", b"\n"))
        if cut < 0:
            found = GAP.search(raw, at + most)
            if not found:
                break
            cut = found.start()
        yield raw[at:cut]
        at = cut
    yield raw[at:]


class Encoder:
    """Encodes texts with a tokenizer file of the tokenizers library.

    This vocabulary's tokens never cross white space, nor a step from a Latin-1 letter, ASCII digit or ASCII mark (the
    apostrophe aside) to one of another kind or from a digit to a digit; letters count as lower case. So the ids of a text
    are those of its units between such steps. The units of many texts are found at once; equal ones are told by
    their bytes, looked up once, and encoded only if they are new. Texts that hold a special token are encoded whole.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        # words of these letters in lower case need no normalising, and spaces alone part them
        self.letters = Tokenizer(self.tokenizer.model)
        self.letters.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        size = self.tokenizer.get_vocab_size()
        self.kind = "<u2" if size <= 1 << 16 else "<u4"
        self.width = int(self.kind[-1])
        self.special = [t.content.encode().translate(LOWER) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kept: dict[bytes, bytes] = {}
        #: Whether an id ends a pre-token.
        self.ends = np.zeros(size, dtype=bool)
        self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        separator = self._alone(SEPARATOR)
        if len(separator) != self.width:
            raise ValueError("this vocabulary has no token for the separator")
        self.separator = np.frombuffer(separator, dtype=self.kind)[0]

    def _alone(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.kind).tobytes()

    def _words(self, units: list[bytes]) -> list[bytes]:
        """The ids of units of letters, a hundred in each call, each as far as the id that ends a word."""
        got = []
        joined = [b" ".join(units[i : i + 100]).decode().lower() for i in range(0, len(units), 100)]
        for e in self.letters.encode_batch_fast(joined, add_special_tokens=False):
            ids = np.array(e.ids, dtype=self.kind)
            raw, last = ids.tobytes(), ((np.flatnonzero(self.ends[ids]) + 1) * self.width).tolist()
            got += [raw[a:b] for a, b in zip([0, *last[:-1]], last, strict=True)]
        return got

    def _parted(self, units: list[bytes]) -> list[bytes]:
        """The ids of units without the separator, a hundred in each call, told apart by it."""
        got = []
        joined = [f" {SEPARATOR} ".join([u.decode() for u in units[i : i + 100]]) for i in range(0, len(units), 100)]
        for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False):
            ids = np.array(e.ids, dtype=self.kind)
            raw, at = ids.tobytes(), (np.flatnonzero(ids == self.separator) * self.width).tolist()
            got += [raw[a:b] for a, b in zip([0, *(x + self.width for x in at)], [*at, len(raw)], strict=True)]
        return got

    def _encode(self, units: list[bytes]) -> list[bytes]:
        """The ids of units, which are in lower case."""
        bar = SEPARATOR.encode()
        letters = [u for u in units if LETTERS.fullmatch(u)]
        got = dict(zip(letters, self._words(letters), strict=True))
        apart = [u for u in units if u not in got and bar not in u]
        got |= dict(zip(apart, self._parted(apart), strict=True))
        return [got[u] if u in got else self._alone(u.decode()) for u in units]

    def _looked_up(self, units: list[bytes]) -> list[bytes]:
        found = list(map(self.kept.get, units))
        new = [i for i, x in enumerate(found) if x is None]
        if new:
            room = KEPT_UNITS - len(self.kept)
            for i, x in zip(new, self._encode([units[i] for i in new]), strict=True):
                found[i] = x
                if room > 0 and len(units[i]) <= KEPT_BYTES:
                    self.kept[units[i]] = x
                    room -= 1
        return found

    def _units(self, raw: list[bytes]) -> list[bytes]:
        """The ids of texts in lower case that hold no special token; of no texts, none."""
        data = b" " + b" ".join(raw) + b" " + bytes(32)
        view = np.frombuffer(data, dtype=np.uint8)
        kind = KIND[view[: len(data) - 32]]
        two = np.flatnonzero(view[: len(kind)] == 0xC3)
        two = two[(view[two + 1] != 0x97) & (view[two + 1] != 0xB7)]
        kind[two] = kind[two + 1] = LETTER
        cut = np.flatnonzero(PARTS[kind[:-1] * 5 + kind[1:]]) + 1
        first = cut[:-1] if len(cut) else cut
        starts_ = kind[first] != SPACE
        start, end = first[starts_], cut[1:][starts_]
        n = end - start
        # a unit's key is its length and its first 32 bytes; longer units are each their own
        eight = np.lib.stride_tricks.as_strided(view[:8].view("<u8"), (len(data) - 7,), (1,))
        mixed = n.astype(np.uint64)
        keys = [n]
        most = int(n.max()) if len(n) else 0
        for j in range(min(4, -(-most // 8))):
            at = np.minimum(start + 8 * j, len(data) - 8)
            keys.append(eight[at] & FIRST[np.clip(n - 8 * j, 0, 8)])
            mixed = (mixed ^ keys[-1]) * MIX[j]
            mixed ^= mixed >> np.uint64(32)
        if most > 32:
            long = np.flatnonzero(n > 32)
            mixed[long] = long.astype(np.uint64) | np.uint64(1 << 63)
            keys.append(np.where(n > 32, np.arange(len(n)), 0))
        code, distinct = pd.factorize(mixed)
        of = np.zeros(len(distinct), dtype=np.int64)
        of[code[::-1]] = np.arange(len(code) - 1, -1, -1)  # a code's first unit
        same = np.ones(len(code), dtype=bool)
        for k in keys:
            same &= k == k[of[code]]
        if not same.all():  # two units of one mixed key: number the others anew
            other = np.flatnonzero(~same)
            code[other] = len(of) + np.arange(len(other))
            of = np.concatenate([of, other])
        ids = self._looked_up([data[a:b] for a, b in zip(start[of].tolist(), end[of].tolist(), strict=True)])
        # each unit's ids, in a row
        flat = np.frombuffer(b"".join(ids), dtype=self.kind)
        size = np.array([len(x) for x in ids], dtype=np.int64) // self.width
        begin = np.cumsum(size) - size
        each = size[code]
        upto = np.cumsum(each)
        out = flat[np.repeat(begin[code] - (upto - each), each) + np.arange(upto[-1] if len(upto) else 0)].tobytes()
        # the bytes at which texts end, and so the ids
        edge = np.cumsum([0, *(len(r) + 1 for r in raw)])
        upto = np.concatenate([[0], upto])[np.searchsorted(start, edge, side="right")] * self.width
        return [out[a:b] for a, b in pairwise(upto.tolist())]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of texts; a null text has none. Memory grows with TOGETHER and the longest run without white space, not with the texts."""
        out: list[list[bytes]] = [[] for _ in texts]
        wait: list[tuple[int, bytes]] = []
        held = 0
        for i, t in enumerate(texts):
            raw = (t or "").encode().translate(LOWER)
            if any(s in raw for s in self.special):
                out[i].append(self._alone(t))
                continue
            for piece in pieces(raw, TOGETHER):
                wait.append((i, piece))
                held += len(piece)
                if held >= TOGETHER:
                    self._told(wait, out)
                    wait, held = [], 0
        self._told(wait, out)
        return [b"".join(x) for x in out]

    def _told(self, wait: list[tuple[int, bytes]], out: list[list[bytes]]) -> None:
        for (i, _), ids in zip(wait, self._units([p for _, p in wait]), strict=True):
            out[i].append(ids)


def write_records(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the token ids of all rows of docs into record files at path, in ascending order of id, nulls first.

    Rows are ranged by id and then by text, so that rows that repeat an id follow each other. A null text is encoded
    as an empty one, which has the end id alone. An empty table writes no record. tokenizer is the path of a tokenizer
    file, the same on all workers; the default is public_tokenizers' word_bpe_49k.json there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        file = tokenizer or public_tokenizers.path(TOKENIZER)
        encoder = worker_state(f"encoder {file}", lambda: Encoder(file))
        end = np.array([end_id], dtype=f"<u{encoder.width}").tobytes()
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                ids = encoder.encode(part.column(1).to_pylist())
                rows = [frame(pack(d, x + end, encoder.width))[:-1] for d, x in zip(part.column(0).to_pylist(), ids, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["frame"])

    two = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    ranged = two.withColumn("h", F.xxhash64("text")).repartitionByRange("id", "h").sortWithinPartitions("id", "h").select("id", "text")
    frames = ranged.mapInArrow(run, "frame binary")
    frames.select(F.col("frame").cast("string")).write.option("compression", "none").option("lineSep", "\n").text(path)


def frames_of(stream: BinaryIO) -> Iterator[tuple[int, int, memoryview]]:
    """(offset, bytes, payload) of each frame of a stream, which is read a chunk at a time: no more than a frame and a chunk are held."""
    data, at, base = b"", 0, 0
    while True:
        size = 0
        if len(data) - at >= 12:
            size = 17 + struct.unpack_from("<Q", data, at)[0]
            if masked(data[at : at + 8]) != struct.unpack_from("<I", data, at + 8)[0]:
                raise CorruptRecord(f"the length at byte {base + at} fails its checksum")
            if len(data) - at >= size:
                payload, after = read_frame(data, at)
                yield base + at, size, payload
                at = after
                continue
        more = stream.read(max(CHUNK, size - (len(data) - at)))
        if not more:
            break
        data, base, at = data[at:] + more, base + at, 0
    if at < len(data):
        raise CorruptRecord(f"the frame at byte {base + at} is cut off")


def scan_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, number, record, offset, bytes, doc_id, n_tokens, ids_crc32, before) of each frame of the files at path, all checksums tested.

    number orders the files; before counts the ids of the file's earlier records. Spark lists the files; a task
    streams its files, of any size, in chunks. Where the file system is one that pyarrow can't open, Spark reads the
    files, each whole.
    """
    import pyarrow.fs

    try:
        pyarrow.fs.FileSystem.from_uri(path)
        streamed = True
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        streamed = False

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs

        for batch in batches:
            for i in range(batch.num_rows):
                file, total, rows = batch.column(0)[i].as_py(), 0, []
                if streamed:
                    system, where = pyarrow.fs.FileSystem.from_uri(file)
                    stream = system.open_input_stream(where)
                else:
                    stream = pa.BufferReader(batch.column(1)[i].as_buffer())
                for number, (at, size, payload) in enumerate(frames_of(stream)):
                    doc_id, ids = unpack(payload)
                    rows.append((file, number, at, size, doc_id, len(ids), zlib.crc32(ids), total))
                    total += len(ids)
                    if len(rows) == 10_000:
                        yield _scanned(rows)
                        rows = []
                stream.close()
                if rows:
                    yield _scanned(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    found = files.select("path", *([] if streamed else ["content"])).mapInArrow(run, "file string, record long, offset long, bytes long, doc_id long, n_tokens long, ids_crc32 long, before long")
    return found.withColumn("number", F.regexp_extract("file", r"part-(\d+)-[^/]*$", 1).cast("long"))


def _scanned(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), SCAN.types, strict=True)], schema=SCAN)


SCAN = pa.schema([("file", pa.string()), *((n, pa.int64()) for n in ("record", "offset", "bytes", "doc_id", "n_tokens", "ids_crc32", "before"))])


def write_index(spark: SparkSession, path: str, index: str) -> None:
    """Writes the offset index of the record files at path: scan_records and start, the ids in all records before, as Parquet."""
    found, _ = written(scan_records(spark, path), "frames")
    sums = found.groupBy("number").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.orderBy("number").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    starts = sums.select("number", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    found.join(starts, "number").withColumn("start", F.col("base") + F.col("before")).drop("base", "before", "number").write.parquet(index)


def read_at(file: str, offset: int, size: int) -> tuple[int | None, np.ndarray]:
    """The id and the token ids of one record, by a row of the index: a seek and a read. For shuffled reads outside Spark."""
    import pyarrow.fs

    system, where = pyarrow.fs.FileSystem.from_uri(file)
    with system.open_input_file(where) as f:
        f.seek(offset)
        return unpack(read_frame(f.read(size))[0])


def token_records(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Writes docs as record files and their index, and returns doc_id, start, n_tokens, ids_crc32, file, offset and bytes of each record as read back.

    path is a folder for both, in the shared folder if not given; see write_records for nulls, repeats and empty tables.
    """
    spark = docs.sparkSession
    path = path or fresh_path(spark, "records")
    write_records(docs, f"{path}/records")
    write_index(spark, f"{path}/records", f"{path}/index")
    return spark.read.parquet(f"{path}/index").select("doc_id", "start", "n_tokens", "ids_crc32", "file", "offset", "bytes")

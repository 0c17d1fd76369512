"""Token ids in seekable zstandard files.

A shard is a run of independent zstandard frames, one for each document, followed by a seek table in a skippable frame that
ends the file (the seekable format's layout: compressed size, size and checksum of each frame, then number of frames, a
descriptor and a magic number). A second skippable frame before it holds the documents' ids, so that a reader finds a
document by its id with two short reads at the file's end and then reads and decompresses only that document's frame.
Ids are little-endian unsigned integers of 16 or 32 bits, as the vocabulary needs.

Shards cover consecutive ranges of document ids that hold about equally many bytes of text, so that the order over all shards is
the order of ids without any global sort of texts: texts are tokenised where they are read, and only ids' compact arrays are
shuffled, each shard to a task of its own. An id with so many rows that they make several shards is cut further by a checksum.
A shard is written under a temporary name in the shared folder and renamed, so a task that runs twice leaves one file.

Defined results: null texts are empty; an empty document is its end id alone; rows with equal document ids keep all their
copies, ordered by ranges of their tokens' checksums where there are several shards of them, and by their tokens; null ids come
first; a text of any length is one frame; an empty table gives no shard and no rows; columns other than id and text are not read.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeline.llm.bytes import give_back, hashes, mixed, pieces, utf8
from gaugeline.llm.storage import Scratch, keep, open_fs, work_folder

TOKENIZER = "byte_bpe_50k.json"
END_ID = 0
SEEKABLE_MAGIC, SKIPPABLE, INDEX_FRAME = 0x8F92EAB1, 0x184D2A5E, 0x184D2A50
NO_ID = -(1 << 63)
#: Distinct text pieces whose ids a worker remembers during a task. After it they are dropped: a worker outlives its task.
REMEMBERED = 400_000
#: The byte alphabet of byte-level vocabularies: printable Latin-1 characters stand for themselves, the others, in order, for 256 and up.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_NAMES = {b: chr(b) for b in _PLAIN} | {b: chr(256 + k) for k, b in enumerate(sorted({*range(256)} - {*_PLAIN}))}
# Where the byte-level pattern surely ends a piece, whatever stands around: before a single space or newline that follows a
# printable ASCII byte or a letter's last byte, and between an ASCII letter and ASCII punctuation other than an apostrophe.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~']] = True
#: White space outside ASCII and control characters: texts that hold them are encoded whole.
_ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")


class Encoder:
    """Ids of texts, exactly as the tokenizer gives them for the whole texts.

    The pre-tokenizer never joins what stands on the two sides of certain byte pairs, so a text can be cut there; equal
    pieces, mostly words, are then encoded once and looked up afterwards.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.known: dict[int, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, np.uint32).tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _pieces(self, texts: list[bytes]) -> list[bytes]:
        """Ids of pieces. One that is letters only, with a space before them or not, is a single word to the pre-tokenizer, and goes
        straight to the library's model, under the byte alphabet's names; the others go all the way."""
        out: list[bytes] = [b""] * len(texts)
        rest, model = [], self.model
        for i, t in enumerate(texts):
            if t[t[0] == 32 :].isalpha() or t[t[0] == 32 :].decode("utf-8", "replace").isalpha():
                ids = [x.id for x in model.tokenize(t.decode("latin-1").translate(BYTE_NAMES))]
                out[i] = struct.pack(f"<{len(ids)}I", *ids)
            else:
                rest.append(i)
        for at in range(0, len(rest), 4096):
            some = rest[at : at + 4096]
            for i, ids in zip(some, self._whole([texts[i].decode("utf-8", "surrogatepass") for i in some]), strict=True):
                out[i] = ids
        return out

    @staticmethod
    def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Starts of the pieces."""
        cut = np.zeros(len(data) + 1, bool)
        if len(data) > 1:
            before, here = data[:-1], data[1:]
            cut[1:-1] = (_SPACE[here] & ~_SPACE[before]) | (_MARK[here] & _LETTER[before])
        cut[offsets] = True
        return np.flatnonzero(cut[:-1])

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids and the n+1 offsets of texts among them."""
        starts = self.cuts(data, offsets)
        ends = np.append(starts[1:], len(data))[: len(starts)]
        codes, distinct = pd.factorize(hashes(data, starts, ends))
        first = np.zeros(len(distinct), np.int64)
        first[codes[::-1]] = np.arange(len(codes))[::-1]  # the last to be set is the first to occur
        if len(self.known) > REMEMBERED:
            self.known.clear()
        keys = distinct.tolist()
        known = self.known
        new = [k for k, h in enumerate(keys) if h not in known]
        buffer = data.tobytes()
        known.update(zip([keys[k] for k in new], self._pieces([buffer[a:b] for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)]), strict=True))
        each = [known[h] for h in keys]
        size = np.fromiter(map(len, each), np.int64, len(each)) >> 2
        flat = np.frombuffer(b"".join(each), np.uint32)
        base = np.concatenate([[0], np.cumsum(size)])[:-1]
        per_piece = size[codes] if len(codes) else np.zeros(0, np.int64)
        total = np.concatenate([[0], np.cumsum(per_piece)])
        ids = flat[np.repeat(base[codes] - total[:-1], per_piece) + np.arange(total[-1])] if len(codes) else flat
        return ids, total[np.searchsorted(starts, offsets)]

    def encode_column(self, column: pa.Array) -> list[np.ndarray]:
        """Ids of each text of a column."""
        data, offsets = utf8(column)
        odd = [i for i in np.flatnonzero(np.diff(offsets)) if _odd(data[offsets[i] : offsets[i + 1]])]
        ids, at = self.encode(data, offsets)
        out = [ids[at[i] : at[i + 1]] for i in range(len(column))]
        if odd:
            for i, whole in zip(odd, self._whole([column[int(i)].as_py() for i in odd]), strict=True):
                out[i] = np.frombuffer(whole, np.uint32)
        return out


def _odd(data: np.ndarray) -> bool:
    """Whether a text has white space other than ASCII's, or a special token's string; a byte that may start one is looked for first."""
    raw = data.tobytes()
    if b"<|" in raw:
        return True
    if not any(lead in raw for lead in (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a", b"\xe2\x80", b"\xe2\x81", b"\xe3\x80", b"\x1c", b"\x1d", b"\x1e", b"\x1f")):
        return False
    return bool(_ODD_SPACE.search(raw.decode("utf-8", "surrogatepass")))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


# ------------------------------------------------------------------ file format


def write_shard(documents: Iterator[tuple[int, bytes]], out, level: int = 3) -> list[tuple[int, int, int]]:
    """Write (id, bytes) in order to a binary file; returns (compressed size, size, checksum) of each frame."""
    packer = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
    ids, entries = [], []
    for doc_id, raw in documents:
        frame = packer.compress(raw)
        out.write(frame)
        ids.append(doc_id)
        entries.append((len(frame), len(raw), zlib.crc32(raw)))
    index = np.array(ids, "<i8").tobytes()
    out.write(struct.pack("<II", INDEX_FRAME, len(index)) + index)
    table = b"".join(struct.pack("<III", *e) for e in entries) + struct.pack("<IBI", len(entries), 0x80, SEEKABLE_MAGIC)
    out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
    return entries


class Shard:
    """Random access to a shard: ``f`` needs seek, tell and read. Frames are read and decompressed only when asked for."""

    def __init__(self, f) -> None:
        self.f = f
        f.seek(0, os.SEEK_END)
        end = f.tell()
        f.seek(end - 9)
        n, descriptor, magic = struct.unpack("<IBI", f.read(9))
        if magic != SEEKABLE_MAGIC or not descriptor & 0x80:
            raise ValueError("no seek table")
        at = end - 9 - 12 * n - 8
        f.seek(at - 8 * n - 8)
        index, table = f.read(8 + 8 * n), f.read(8 + 12 * n)
        if struct.unpack("<II", table[:8]) != (SKIPPABLE, 12 * n + 9) or struct.unpack("<II", index[:8]) != (INDEX_FRAME, 8 * n):
            raise ValueError("damaged seek table")
        self.ids = np.frombuffer(index, "<i8", n, 8)
        self.entries = np.frombuffer(table, "<u4", 3 * n, 8).reshape(n, 3)
        self.at = np.concatenate([[0], np.cumsum(self.entries[:, 0], dtype=np.int64)])
        self._unpacker = zstandard.ZstdDecompressor()

    def __len__(self) -> int:
        return len(self.ids)

    def read(self, k: int) -> bytes:
        """Bytes of the k-th document, checked against the table's checksum."""
        self.f.seek(int(self.at[k]))
        raw = self._unpacker.decompress(self.f.read(int(self.entries[k, 0])))
        if len(raw) != self.entries[k, 1] or zlib.crc32(raw) != self.entries[k, 2]:
            raise ValueError(f"document {self.ids[k]}: checksum differs")
        return raw

    def find(self, doc_id: int) -> list[bytes]:
        """Bytes of all documents of this id."""
        low, high = np.searchsorted(self.ids, [doc_id, doc_id], "left")[0], np.searchsorted(self.ids, doc_id, "right")
        return [self.read(k) for k in range(low, high)]


# ------------------------------------------------------------------ distributed writing and reading


@dataclass(frozen=True)
class Ranges:
    """Ranges of ids, by their least ids (repeated: ranges of checksums of one id), and the shard of each range."""

    bounds: np.ndarray
    shard: np.ndarray

    def of(self, keys: np.ndarray, checksums: np.ndarray) -> np.ndarray:
        """The range of each row; ``checksums``: of 32 bits."""
        left, right = np.searchsorted(self.bounds, keys, "left"), np.searchsorted(self.bounds, keys, "right")
        return np.where(right > left, left + 1 + (checksums * (right - left) >> 32), left)

    @property
    def n_shards(self) -> int:
        return int(self.shard[-1]) + 1


def shard_ranges(docs: DataFrame, id_col: str, text_col: str, shard_bytes: int) -> Ranges:
    """Ranges for shards of about ``shard_bytes`` bytes of text: quantiles of ids, four to a shard, put together by their bytes."""
    with Scratch(docs.sparkSession) as scratch:
        # A row has some bytes besides its text's.
        slim = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("key"), (F.coalesce(F.octet_length(text_col), F.lit(0)) + 16).cast("long").alias("size"))
        slim = scratch.keep(slim, "token-sizes")
        total = slim.agg(F.sum("size")).first()[0] or 0
        pieces_ = 4 * max(1, -(-total // shard_bytes))
        one = Ranges(np.zeros(0, np.int64), np.zeros(1, np.int64))
        if pieces_ == 4:
            return one
        quantiles = slim.select(F.percentile_approx("key", [k / pieces_ for k in range(1, pieces_)], 20 * pieces_)).first()[0]
        fine = Ranges(np.array(sorted(quantiles), np.int64), np.arange(pieces_))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(pieces_, np.int64)
            for batch in batches:
                keys, size = batch.column("key").to_numpy(), batch.column("size").to_numpy()
                # Rows of one id are shared out evenly here; which goes where is known once they have tokens.
                np.add.at(sums, fine.of(keys, mixed(np.arange(len(keys)).astype(np.uint64)).astype(np.int64) & 0xFFFFFFFF), size)
            used = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(sums[used])], ["piece", "size"])

        size = np.zeros(pieces_, np.int64)
        for r in slim.mapInArrow(run, "piece long, size long").groupBy("piece").agg(F.sum("size")).collect():
            size[r[0]] = r[1]
    # A range belongs to the shard in which its middle byte lies.
    shard = (np.cumsum(size) - size // 2) // shard_bytes
    return Ranges(fine.bounds, np.unique(shard, return_inverse=True)[1])


def encode_table(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, ranges: Ranges | None = None) -> DataFrame:
    """doc_id, tokens (little-endian 16-bit ids, or 32-bit where the vocabulary needs them), with the end id appended; and shard, if there are ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer_path)
        kind = "<u2" if own.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        tail = np.array([end_id], kind).tobytes()
        for part in pieces(batches, text_col):
            tokens = [ids.astype(kind).tobytes() + tail for ids in own.encode_column(part.column(text_col))]
            ids = part.column(id_col).cast(pa.int64())
            columns = [ids, pa.array(tokens, pa.binary())]
            if ranges is not None:
                range_ = ranges.of(ids.fill_null(NO_ID).to_numpy(), np.fromiter(map(zlib.crc32, tokens), np.int64, len(tokens)))
                columns.append(pa.array(ranges.shard[range_], pa.int32()))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "tokens", "shard"][: len(columns)])
        own.known.clear()
        give_back()

    return docs.select(id_col, text_col).mapInArrow(run, "doc_id long, tokens binary" + (", shard int" if ranges is not None else ""))


def write_tokens(docs: DataFrame, folder: str, tokenizer_path: str, shard_bytes: int = 16 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write shards into ``folder`` and return their manifest: shard, path, n_docs, n_ids, first_id, width."""
    from tokenizers import Tokenizer

    width = 2 if Tokenizer.from_file(tokenizer_path).get_vocab_size() <= 1 << 16 else 4
    ranges = shard_ranges(docs, id_col, text_col, shard_bytes)
    sharded = encode_table(docs, tokenizer_path, id_col, text_col, ranges=ranges).select("shard", F.coalesce("doc_id", F.lit(NO_ID)).alias("key"), "tokens")
    ordered = sharded.repartitionById(ranges.n_shards, F.col("shard")).sortWithinPartitions("shard", "key", "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_fs(folder)
        fs.create_dir(base, recursive=True)
        rows = ((int(s), int(k), t) for b in batches for s, k, t in zip(b.column("shard").to_numpy(), b.column("key").to_numpy(), b.column("tokens").to_pylist(), strict=True))
        row = next(rows, None)
        while row is not None:
            number, first = row[0], row[1]
            counts = [0, 0]

            def of_shard() -> Iterator[tuple[int, bytes]]:
                nonlocal row
                while row is not None and row[0] == number:
                    counts[0] += 1
                    counts[1] += len(row[2]) // width
                    yield row[1], row[2]
                    row = next(rows, None)

            name = f"{base}/tokens-{number:05d}.zst"
            with fs.open_output_stream(part := f"{name}.{uuid.uuid4().hex}") as out:
                write_shard(of_shard(), out)
            fs.move(part, name)
            columns = {"shard": [number], "path": [f"{folder}/tokens-{number:05d}.zst"], "n_docs": [counts[0]], "n_ids": [counts[1]], "first_id": [first], "width": [width]}
            yield pa.RecordBatch.from_pydict(columns, pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("first_id", pa.int64()), ("width", pa.int32())]))

    return keep(ordered.mapInArrow(run, "shard int, path string, n_docs long, n_ids long, first_id long, width int"), "token-manifest")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, shard, frame of every document, decoded from the files. ``start`` counts the ids of all documents
    before it: those of earlier shards come from the manifest, which has a row for each shard."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("path", "shard", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("shard_start"), "width", F.count("*").over(before).cast("int").alias("place"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, number, start, width in zip(*(batch.column(c).to_pylist() for c in ("path", "shard", "shard_start", "width")), strict=True):
                fs, name = open_fs(path)
                with fs.open_input_file(name) as f:
                    shard = Shard(f)
                    for at in range(0, len(shard), 2048):
                        rows = []
                        for k in range(at, min(at + 2048, len(shard))):
                            ids = np.frombuffer(shard.read(k), f"<u{width}")
                            rows.append((int(shard.ids[k]), start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), number, k))
                            start += len(ids)
                        columns = list(zip(*rows, strict=True))
                        ids = pa.array([None if x == NO_ID else x for x in columns[0]], pa.int64())
                        yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, pa.int64()) for c in columns[1:4]), *(pa.array(c, pa.int32()) for c in columns[4:])], ["doc_id", "start", "n_tokens", "ids_crc32", "shard", "frame"])

    # A task for each shard.
    spread = files.repartitionById(max(1, manifest.count()), F.col("place"))
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, shard int, frame int")


def token_rows(spark: SparkSession, docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Write the table's tokens to new files in the shared folder and return what the files hold of each document."""
    return read_tokens(write_tokens(docs, work_folder(spark, "tokens"), tokenizer_path))

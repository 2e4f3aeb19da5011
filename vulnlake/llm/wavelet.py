"""Token ids as wavelet matrices: one compressed file per shard with access, counting and occurrence lookup.

File layout (little endian): ``WMX1``; u32 header size; JSON header (zstd); zstd blocks, one per bit plane, each the plane's
bits and its rank directory (ones before every 512th bit). The header holds, besides sizes, the documents' ids and their
ends within the shard. Shards are cut between documents, in ascending doc_id order; a longer document is one shard.

Edge cases. A null text is empty: the document holds only its end id. Null doc_ids come first. Rows with the same doc_id
follow each other, ordered by text. An empty table writes no file and gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import itertools
import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from vulnlake.llm.common import ship, shared_folder, shuffle_partitions, table, text_of
from vulnlake.llm.registry import query

MAGIC = b"WMX1"
STEP = 512  # bits between entries of the rank directory
SHARD_TOKENS = 1 << 20
#: Bound on a task's table of chunk -> ids; a full one is emptied.
TABLE_ENTRIES = 800_000
SLICE_BYTES = 6 << 20


class WaveletMatrix:
    """Bit planes from the highest; each level keeps zeros before ones, in order."""

    def __init__(self, planes: list[np.ndarray], ranks: list[np.ndarray], zeros: list[int], n: int):
        self.planes, self.ranks, self.zeros, self.n = planes, ranks, zeros, n

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        n, levels = len(ids), max(1, int(ids.max(initial=0)).bit_length())
        level = ids.astype(np.uint16 if levels <= 16 else np.uint32)
        planes, ranks, zeros = [], [], []
        for p in range(levels - 1, -1, -1):
            bit = (level >> p) & 1 == 1
            packed = np.packbits(bit, bitorder="little")
            planes.append(packed)
            ranks.append(cls.directory(packed))
            low = level[~bit]
            zeros.append(len(low))
            level = np.concatenate((low, level[bit]))
        return cls(planes, ranks, zeros, n)

    @staticmethod
    def directory(packed: np.ndarray) -> np.ndarray:
        ones = np.bitwise_count(packed)
        starts = np.arange(0, len(ones), STEP // 8)
        sums = np.add.reduceat(ones, starts, dtype=np.uint32) if len(ones) else np.zeros(0, np.uint32)
        return np.concatenate((np.zeros(1, np.uint32), np.cumsum(sums, dtype=np.uint32)))

    def bit(self, level: int, i: int) -> int:
        return int(self.planes[level][i >> 3]) >> (i & 7) & 1

    def rank1(self, level: int, i: int) -> int:
        """Ones before position i of a level."""
        whole, at = i >> 3, i // STEP
        ones = int(self.ranks[level][at]) + int(np.bitwise_count(self.planes[level][at * STEP // 8 : whole]).sum())
        return ones + (int(self.planes[level][whole]) & ((1 << (i & 7)) - 1)).bit_count() if i & 7 else ones

    def select(self, level: int, one: int, k: int) -> int:
        """Position of the k-th (from 0) bit of a kind in a level: binary search over ranks."""
        lo, hi = 0, self.n
        while lo < hi:
            mid = (lo + hi) // 2
            r = self.rank1(level, mid + 1)
            if (r if one else mid + 1 - r) > k:
                hi = mid
            else:
                lo = mid + 1
        return lo

    def access(self, i: int) -> int:
        value = 0
        for level, z in enumerate(self.zeros):
            b, r = self.bit(level, i), self.rank1(level, i)
            value, i = value << 1 | b, z + r if b else i - r
        return value

    def span(self, value: int, lo: int, hi: int) -> tuple[int, int]:
        """Where the occurrences of a value in [lo, hi) lie on the last level."""
        if value >> len(self.zeros):
            return 0, 0
        for level, z in enumerate(self.zeros):
            a, b = self.rank1(level, lo), self.rank1(level, hi)
            lo, hi = (z + a, z + b) if value >> (len(self.zeros) - 1 - level) & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, value: int, lo: int = 0, hi: int | None = None) -> int:
        a, b = self.span(value, lo, self.n if hi is None else hi)
        return b - a

    def occurrence(self, value: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of a value."""
        lo, hi = self.span(value, 0, self.n)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        i = lo + k
        for level in range(len(self.zeros) - 1, -1, -1):
            i = self.select(level, 1, i - self.zeros[level]) if value >> (len(self.zeros) - 1 - level) & 1 else self.select(level, 0, i)
        return i

    def decode(self) -> np.ndarray:
        """All ids: from the last level up, zeros and ones go back to their places."""
        level = np.zeros(self.n, np.uint16 if len(self.zeros) <= 16 else np.uint32)
        for at in range(len(self.zeros) - 1, -1, -1):
            bit = np.unpackbits(self.planes[at], count=self.n, bitorder="little").view(bool)
            above = np.empty_like(level)
            above[~bit] = level[: self.zeros[at]]
            above[bit] = level[self.zeros[at] :] | level.dtype.type(1 << (len(self.zeros) - 1 - at))
            level = above
        return level


def to_bytes(ids: np.ndarray, doc_ids: list[int | None], ends: list[int]) -> bytes:
    import zstandard

    m, z = WaveletMatrix.build(ids), zstandard.ZstdCompressor(level=1)
    blocks = [z.compress(p.tobytes() + r.tobytes()) for p, r in zip(m.planes, m.ranks)]
    head = z.compress(json.dumps({"n": m.n, "zeros": m.zeros, "blocks": [len(b) for b in blocks], "doc_ids": doc_ids, "ends": ends}).encode())
    return b"".join((MAGIC, struct.pack("<I", len(head)), head, *blocks))


def from_bytes(data: bytes) -> tuple[WaveletMatrix, list[int | None], list[int]]:
    import zstandard

    z = zstandard.ZstdDecompressor()
    if data[:4] != MAGIC:
        raise ValueError("not a wavelet matrix file")
    size = struct.unpack_from("<I", data, 4)[0]
    head, at, planes, ranks = json.loads(z.decompress(data[8 : 8 + size])), 8 + size, [], []
    for length in head["blocks"]:
        raw = np.frombuffer(z.decompress(data[at : at + length]), np.uint8)
        cut, at = (head["n"] + 7) // 8, at + length
        planes.append(raw[:cut])
        ranks.append(np.frombuffer(raw[cut:].tobytes(), np.uint32))
    return WaveletMatrix(planes, ranks, head["zeros"], head["n"]), head["doc_ids"], head["ends"]


#: White space by Unicode, and control characters that some libraries take for it.
BLANK = r"[\t-\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
MARK = "\x01"


class Codes(dict):
    """Numbers keys in the order in which they are first looked up."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


class Encoder:
    """Ids of whole texts; the library sees each distinct chunk of a task once.

    The byte-level splitting rule always starts a new piece at a lone space or line feed between two other characters, so
    a text may be cut there, and before a comma or full stop between a letter or digit and such a place. Texts with other
    runs of white space go to the library whole."""

    def __init__(self, tokenizer_file: str):
        import os
        import re

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(tokenizer_file)
        special = [re.escape(x.content) for x in self.tok.get_added_tokens_decoder().values()]
        self.odd = "|".join([BLANK * 2, rf"\A{BLANK}", rf"{BLANK}\z", r"\A\z", MARK, *special])
        # Chunks are encoded many at a time, as one text, and told apart by the tokens that a separator begins.
        vocabulary = self.tok.get_vocab()
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)
        for piece, i in vocabulary.items():
            self.opens[i] = piece[0] in "ĠĊ"
        self.clear()

    def clear(self) -> None:
        stops = self.whole([",", "."])
        self.codes, self.ids, self.starts = Codes({MARK + ",": 0, MARK + ".": 1}), np.concatenate(stops), np.cumsum([0, *map(len, stops)])

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, chunks: list[str]) -> None:
        """Appends the ids of chunks (each a separator and characters, none of them a separator)."""
        ids, starts = [self.ids], [self.starts]
        for at in range(0, len(chunks), 2048):
            part = chunks[at : at + 2048]
            got = self.whole(["".join(part)])[0]
            firsts = np.flatnonzero(self.opens[got])
            if len(firsts) != len(part):
                each = self.whole(part)
                got, firsts = np.concatenate(each), np.cumsum([0, *(len(x) for x in each[:-1])])
            ids.append(got)
            starts.append(np.append(firsts[1:], len(got)) + starts[-1][-1])
        self.ids, self.starts = np.concatenate(ids), np.concatenate(starts)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(texts)
        rows = pa.array(texts, pa.large_string())
        odd = np.flatnonzero(pc.match_substring_regex(rows, self.odd).to_numpy(zero_copy_only=False)).tolist()
        for i, ids in zip(odd, self.whole([texts[i] for i in odd])):
            out[i] = ids
        skip = set(odd)
        plain = [i for i in range(len(texts)) if i not in skip]
        if not plain:
            return out
        if len(self.codes) > TABLE_ENTRIES:
            self.clear()
        # A unit is a chunk without its space; one after a line feed begins with it, a stop cut off from its word with MARK.
        # The first of a text has no separator.
        rows = rows.take(pa.array(plain))
        cut = rows
        for stop in (", ", ". ", ".\n"):
            cut = pc.replace_substring(cut, stop, f" {MARK}{stop}")
        cut = pc.if_else(pc.match_substring_regex(rows, r"[^\pL\pN][,.][ \n]"), rows, cut)
        units = pc.split_pattern(pc.replace_substring(cut, "\n", " \n"), " ")
        at, coded = np.asarray(units.offsets), units.flatten().dictionary_encode()
        known, distinct = len(self.codes), coded.dictionary.to_pylist()
        table = np.fromiter(map(self.codes.__getitem__, distinct), np.int64, len(distinct))
        if len(self.codes) > known:
            self.learn([u if u[:1] == "\n" else " " + u for u in itertools.islice(self.codes, known, None)])
        local = coded.indices.to_numpy()
        firsts = self.whole([distinct[k] for k in local[at[:-1]]])
        lo = self.starts[table].astype(np.int32)
        n = (self.starts[table + 1] - lo).astype(np.int32)
        lo, n = lo[local], n[local]
        n[at[:-1]] = 0  # the first units are spelt differently
        ends = np.cumsum(n, dtype=np.int64)
        flat = self.ids[np.arange(int(ends[-1]), dtype=np.int32) + np.repeat(lo - (ends - n).astype(np.int32), n)]
        ends = np.append(0, ends)
        for k, (i, first) in enumerate(zip(plain, firsts)):
            out[i] = np.concatenate((first, flat[ends[at[k]] : ends[at[k + 1]]]))
        return out


def store(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system that all executors share, and the path in it."""
    if uri.startswith("file:"):
        uri = "/" + uri.removeprefix("file:").lstrip("/")
    return pa.fs.FileSystem.from_uri(uri)


def slices(b: pa.RecordBatch, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``most`` bytes of text, a longer text alone."""
    size = np.cumsum(pc.binary_length(b.column("text")).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < b.num_rows:
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, side="right")))
        yield b.slice(at, end - at)
        at = end


MANIFEST = "part int, seq int, n_tokens long, n_docs long, n_bytes long"


def write_ids(docs: DataFrame, tokenizer_file: str, folder: str, *, end_id: int = 0, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Writes every document's ids and the end id to ``folder``/shards, in ascending doc_id order; gives the manifest.

    One shuffle deals the texts out by ranges of doc_id. A shard appears under its name only when whole, so a repeated
    task replaces it by the same bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = Encoder(tokenizer_file), TaskContext.get()
        fs, root = store(f"{folder}/shards")
        part, seq, held, names, size = task.partitionId(), 0, [], [], 0

        def flush() -> list:
            nonlocal seq, size
            data = to_bytes(np.concatenate(held), list(names), np.cumsum([len(x) for x in held]).tolist())
            fs.create_dir(root, recursive=True)
            name = f"{root}/{part:06d}-{seq:06d}.wmx"
            with fs.open_output_stream(f"{name}.{task.taskAttemptId()}") as out:
                out.write(data)
            fs.move(f"{name}.{task.taskAttemptId()}", name)
            row = [part, seq, size, len(held), len(data)]
            seq, size = seq + 1, 0
            held.clear(), names.clear()
            return row

        rows = []
        for b in batches:
            for some in slices(b):
                for doc_id, ids in zip(some.column("doc_id").to_pylist(), encoder.encode(some.column("text").to_pylist())):
                    if held and size + len(ids) + 1 > shard_tokens:
                        rows.append(flush())
                    held.append(np.append(ids, np.uint32(end_id)))
                    names.append(doc_id)
                    size += len(ids) + 1
        if held:
            rows.append(flush())
        if rows:
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [x.split()[0] for x in MANIFEST.split(", ")])

    # Texts only stream through a task, so tasks may be large: the fewer they are, the fewer chunks are encoded again.
    spark = docs.sparkSession
    ordered = text_of(docs).repartitionByRange(max(4, shuffle_partitions(spark) // 3), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    ordered.mapInArrow(run, MANIFEST).write.parquet(f"{folder}/manifest")
    return manifest(spark, folder)


def manifest(spark, folder: str) -> DataFrame:
    """Shards with ``start``, the ids in all shards before. Sums by part come first: one row per part in the last window."""
    m = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    parts = m.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = parts.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.coalesce(F.sum("n_tokens").over(W.partitionBy("part").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return m.withColumn("inside", inside).join(before, "part").select("part", "seq", "n_tokens", "n_docs", "n_bytes", (F.col("before") + F.col("inside")).alias("start"))


def shards(spark, folder: str) -> DataFrame:
    """part, seq, content: one row per file, read by Spark from any file system it knows."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wmx").option("recursiveFileLookup", True).load(folder)
    name = F.regexp_extract("path", r"(\d+)-(\d+)\.wmx$", 1), F.regexp_extract("path", r"(\d+)-(\d+)\.wmx$", 2)
    return files.select(name[0].cast("int").alias("part"), name[1].cast("int").alias("seq"), "content")


def read_back(spark, folder: str) -> DataFrame:
    """A row per document, from the files: doc_id, start, n_tokens, ids_crc32, part, seq."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, seq, content in zip(b.column("part").to_pylist(), b.column("seq").to_pylist(), b.column("content")):
                matrix, doc_ids, ends = from_bytes(content.as_buffer())
                ids = matrix.decode().astype("<u4")
                starts = [0, *ends[:-1]]
                crc = [zlib.crc32(ids[a:z]) for a, z in zip(starts, ends)]
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(ends), pa.int32()), pa.array([seq] * len(ends), pa.int32()), pa.array(doc_ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(np.diff(ends, prepend=0), pa.int64()), pa.array(crc, pa.int64())],
                                                 ["part", "seq", "doc_id", "at", "n_tokens", "ids_crc32"])

    rows = shards(spark, folder).mapInArrow(run, "part int, seq int, doc_id long, at long, n_tokens long, ids_crc32 long")
    base = manifest(spark, folder).select("part", "seq", F.col("start").alias("base"))
    return rows.join(base, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "part", "seq")


def occurrences(spark, folder: str, value: int) -> DataFrame:
    """Every place of a token id (part, seq, doc_id, position in the document), by rank and select in each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, seq, content in zip(b.column("part").to_pylist(), b.column("seq").to_pylist(), b.column("content")):
                matrix, doc_ids, ends = from_bytes(content.as_buffer())
                at = np.array([matrix.occurrence(value, k) for k in range(matrix.count(value))], np.int64)
                doc = np.searchsorted(ends, at, side="right")
                begins = np.array([0, *ends[:-1]], np.int64)[doc] if len(at) else at
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(at), pa.int32()), pa.array([seq] * len(at), pa.int32()), pa.array([doc_ids[i] for i in doc], pa.int64()), pa.array(at - begins, pa.int64())], ["part", "seq", "doc_id", "position"])

    return shards(spark, folder).mapInArrow(run, "part int, seq int, doc_id long, position long")


@query("op1_wavelet_ids")
def op1_wavelet_ids(spark, sf_dir):
    import public_tokenizers

    folder = shared_folder(spark, "wavelet")
    write_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), folder)
    return read_back(spark, folder)


ship(__name__)

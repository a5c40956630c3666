"""Binary alignments (BAM) as a data source: stretches of a file's compressed blocks are partitions, each read by itself.

A partition finds the first block that begins in its stretch, and in it the first record: the place from which a chain of records
makes sense. It reads the records that begin in its blocks, the last one on into the next stretch. Files are opened through
Arrow's file systems, so that a path may be a local one or the address of a store.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from spanforge.session import importable_on_workers
from spanforge.sources import sam

SPLIT_BYTES = 32 << 20
#: Records that must follow each other for a place to be a record's, and the most bytes of one.
CHAIN, MOST_BYTES = 6, 1 << 26
#: Fixed values of the format: letters of operations and of bases by number, sizes and codes of optional values.
OPERATIONS, BASES = "MIDNSHP=X", "=ACMGRSVTWYHKDBN"
VALUES = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def block_size(head: bytes) -> int:
    """The size of the compressed block that begins with head, 0 if none does."""
    if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04":
        return 0
    at, end = 12, 12 + struct.unpack_from("<H", head, 10)[0]
    while at + 4 <= min(end, len(head)):
        size = struct.unpack_from("<H", head, at + 2)[0]
        if head[at : at + 2] == b"BC" and size == 2 and at + 6 <= len(head):
            return struct.unpack_from("<H", head, at + 4)[0] + 1
        at += 4 + size
    return 0


def blocks(file: pa.NativeFile, at: int) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of each block from offset at on."""
    file.seek(at)
    while head := file.read(18):
        extra = struct.unpack_from("<H", head, 10)[0]
        head += file.read(max(0, 12 + extra - 18))
        size = block_size(head)
        if not size:
            raise ValueError(f"no block at byte {at}")
        body = file.read(size - len(head))
        # After the extra fields comes the deflated content, then its checksum and size.
        yield at, zlib.decompress((head + body)[12 + extra : size - 8], -15)
        at += size


def first_block(file: pa.NativeFile, at: int, size: int) -> int:
    """The offset of the first block that begins at byte at or later; the file's size if none does."""
    file.seek(at)
    seen = file.read(1 << 18)
    k = seen.find(b"\x1f\x8b\x08\x04")
    while k >= 0:
        n = block_size(seen[k : k + 64])
        if n and (at + k + n == size or block_size(seen[k + n : k + n + 64])):
            return at + k
        k = seen.find(b"\x1f\x8b\x08\x04", k + 1)
    return size


def header(file: pa.NativeFile) -> tuple[str, list[str], int]:
    """(text, names of contigs, bytes of content before the first record)."""
    content, stream = b"", blocks(file, 0)

    def need(n: int) -> None:
        nonlocal content
        while len(content) < n:
            content += next(stream)[1]

    need(12)
    if content[:4] != b"BAM\1":
        raise ValueError("not a BAM file")
    n = struct.unpack_from("<i", content, 4)[0]
    need(12 + n)
    text, at = content[8 : 8 + n].split(b"\0")[0].decode(), 8 + n
    many, names = struct.unpack_from("<i", content, at)[0], []
    at += 4
    for _ in range(many):
        need(at + 4)
        n = struct.unpack_from("<i", content, at)[0]
        need(at + 8 + n)
        names.append(content[at + 4 : at + 3 + n].decode())
        at += 8 + n
    return text, names, at


def _makes_sense(b: bytes, at: int, contigs: int) -> int:
    """The size of the record at b[at:], its own four bytes included; 0 if it can't be one, -1 if b ends before that is known."""
    if at + 36 > len(b):
        return -1
    size, ref, pos, name, _, _, ops, _, seq, mate, mate_pos, _ = struct.unpack_from("<iiiBBHHHiiii", b, at)
    least = 32 + name + 4 * ops + (seq + 1) // 2 + seq
    if not (0 < name and 0 <= seq and least <= size <= MOST_BYTES and -1 <= ref < contigs and -1 <= mate < contigs and pos >= -1 and mate_pos >= -1):
        return 0
    text = b[at + 36 : at + 36 + name]
    if len(text) < name:
        return -1
    return size + 4 if text[-1] == 0 and all(33 <= c <= 126 for c in text[:-1]) else 0


def first_record(b: bytes, contigs: int, to_the_end: bool) -> int:
    """The first place from which records follow each other; -1 if there is none. to_the_end: b ends with the file."""
    for start in range(len(b)):
        at, n = start, 0
        while n < CHAIN:
            if at == len(b) and to_the_end:
                return start
            size = _makes_sense(b, at, contigs)
            if size < 0:
                if n and not to_the_end:
                    return start
                break
            if not size:
                break
            at, n = at + size, n + 1
        if n == CHAIN:
            return start
    return -1


def line(b: bytes, contigs: list[str]) -> str:
    """A record, without its size, as a line of SAM text."""
    ref, pos, name, mapq, _, n_ops, flag, n, mate, mate_pos, length = struct.unpack_from("<iiBBHHHiiii", b)
    at = 32 + name
    ops = "".join(f"{x >> 4}{OPERATIONS[x & 15]}" for x in struct.unpack_from(f"<{n_ops}I", b, at)) or "*"
    at += 4 * n_ops
    seq = "".join(BASES[x >> 4] + BASES[x & 15] for x in b[at : at + (n + 1) // 2])[:n] or "*"
    at += (n + 1) // 2
    quality = "*" if not n or b[at] == 255 else bytes(x + 33 for x in b[at : at + n]).decode()
    at += n
    place = lambda k: contigs[k] if k >= 0 else "*"
    fields = [b[32 : 31 + name].decode(), str(flag), place(ref), str(pos + 1), str(mapq), ops, "=" if mate == ref and mate >= 0 else place(mate), str(mate_pos + 1), str(length), seq, quality]
    while at < len(b):
        tag, kind = b[at : at + 2].decode(), chr(b[at + 2])
        at += 3
        if kind in "ZH":
            end = b.index(0, at)
            fields.append(f"{tag}:{kind}:{b[at:end].decode()}")
            at = end + 1
        elif kind == "A":
            fields.append(f"{tag}:A:{chr(b[at])}")
            at += 1
        elif kind == "B":
            code, many = VALUES[chr(b[at])], struct.unpack_from("<i", b, at + 1)[0]
            values = struct.unpack_from(f"<{many}{code}", b, at + 5)
            fields.append(f"{tag}:B:{chr(b[at])},{','.join(map(str, values))}")
            at += 5 + many * struct.calcsize(code)
        else:
            code = VALUES[kind]
            fields.append(f"{tag}:{'f' if kind == 'f' else 'i'}:{struct.unpack_from('<' + code, b, at)[0]}")
            at += struct.calcsize(code)
    return "\t".join(fields)


@dataclass
class Stretch(InputPartition):
    path: str
    begin: int
    end: int


class Reader(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.path, self.split = path, split

    def partitions(self) -> list[Stretch]:
        system, path = opened(self.path)
        info = system.get_file_info(path)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path))
        prefix = self.path[: len(self.path) - len(path)] if self.path.endswith(path) else ""
        return [Stretch(prefix + f.path, a, min(f.size, a + self.split)) for f in found if f.type == fs.FileType.File and f.path.endswith(".bam") for a in range(0, f.size, self.split)]

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        system, path = opened(partition.path)
        with system.open_input_file(path) as file:
            lines = []
            for x in _records(file, partition.begin, partition.end):
                lines.append(x)
                if len(lines) == 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(lines)], names=["value"])
                    lines = []
            if lines:
                yield pa.RecordBatch.from_arrays([pa.array(lines)], names=["value"])


def _records(file: pa.NativeFile, begin: int, end: int) -> Iterator[str]:
    """The records, as lines, that begin in blocks of [begin, end)."""
    size = file.size()
    _, contigs, skip = header(file)
    start = first_block(file, begin, size) if begin else 0
    stream = blocks(file, start)
    content, at, owned = b"", skip if not begin else -1, 0
    done = False

    def more() -> bool:
        """One block more of content; owned is where what isn't this stretch's begins."""
        nonlocal content, owned, done
        offset, data = next(stream, (size, b""))
        done = offset >= size
        content += data
        if offset < end:
            owned = len(content)
        return not done

    while at < 0:
        # Enough to tell a record by those that follow it.
        ahead = more()
        if not owned:
            return
        if ahead and len(content) < 1 << 17:
            continue
        at = first_record(content, len(contigs), not ahead)
        if at < 0 and not ahead:
            return
    while True:
        while not done and (at >= owned or len(content) < at + 4) and owned == len(content):
            more()
        if at >= owned:
            return
        while len(content) < at + 4 and more():
            pass
        if len(content) < at + 4:
            return
        n = struct.unpack_from("<i", content, at)[0]
        while len(content) < at + 4 + n and more():
            pass
        yield line(content[at + 4 : at + 4 + n], contigs)
        at += 4 + n
        if at > 1 << 20:
            content, owned, at = content[at:], max(0, owned - at), 0


class BamSource(DataSource):
    """Lines of SAM text, in the column value; options path and split (bytes of a partition)."""

    @classmethod
    def name(cls) -> str:
        return "spanforge-bam"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema: object) -> Reader:
        return Reader(self.options["path"], int(self.options.get("split", SPLIT_BYTES)))


def lines(spark: SparkSession, path: str, split: int = SPLIT_BYTES) -> DataFrame:
    """(value): the records of a BAM file, or of those in a folder, as lines of SAM text."""
    importable_on_workers(spark)
    spark.dataSource.register(BamSource)
    return spark.read.format(BamSource.name()).option("path", path).option("split", str(split)).load()


def alignments(spark: SparkSession, path: str, split: int = SPLIT_BYTES, soft_clip: str = "reference", longest_intron: int = sam.LONGEST_INTRON) -> DataFrame:
    """sam.alignments of the records of a BAM file."""
    return sam.from_lines(lines(spark, path, split), soft_clip, longest_intron)

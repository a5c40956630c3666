"""BAM against the SAM reader on the same records, in one partition and in many."""

import random
import struct
import zlib

import pytest

from spanforge.sources import bam, sam

CONTIGS = ["chr1", "chr2"]


def encoded(text):
    """A line of SAM text as a BAM record."""
    name, flag, ref, pos, mapq, cigar, mate, mate_pos, length, seq, quality, *tags = text.split("\t")
    at = lambda x: -1 if x == "*" else CONTIGS.index(x)
    ref_id = at(ref)
    ops, number = [], ""
    for c in "" if cigar == "*" else cigar:
        if c.isdigit():
            number += c
        else:
            ops.append(int(number) << 4 | bam.OPERATIONS.index(c))
            number = ""
    n = 0 if seq == "*" else len(seq)
    codes = [bam.BASES.index(c) for c in seq[:n]] + [0] * (n % 2)
    body = struct.pack("<iiBBHHHiiii", ref_id, int(pos) - 1, len(name) + 1, int(mapq), 0, len(ops), int(flag), n, ref_id if mate == "=" else at(mate), int(mate_pos) - 1, int(length))
    body += name.encode() + b"\0" + struct.pack(f"<{len(ops)}I", *ops) + bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2], strict=True))
    body += b"\xff" * n if quality == "*" else bytes(ord(c) - 33 for c in quality)
    for t in tags:
        tag, kind, value = t.split(":", 2)
        body += tag.encode() + {"i": lambda v: b"i" + struct.pack("<i", int(v)), "A": lambda v: b"A" + v.encode(), "Z": lambda v: b"Z" + v.encode() + b"\0", "f": lambda v: b"f" + struct.pack("<f", float(v)), "B": lambda v: b"B" + v[0].encode() + struct.pack(f"<i{len(v.split(',')) - 1}i", len(v.split(",")) - 1, *map(int, v.split(",")[1:]))}[kind](value)
    return struct.pack("<i", len(body)) + body


def write_bam(path, lines, block):
    text = "@HD\tVN:1.6\n" + "".join(f"@SQ\tSN:{c}\tLN:100000\n" for c in CONTIGS)
    content = b"BAM\1" + struct.pack("<i", len(text)) + text.encode() + struct.pack("<i", len(CONTIGS))
    for c in CONTIGS:
        content += struct.pack("<i", len(c) + 1) + c.encode() + b"\0" + struct.pack("<i", 100000)
    content += b"".join(encoded(x) for x in lines)
    out = b""
    for part in [*(content[k : k + block] for k in range(0, len(content), block)), b""]:
        packer = zlib.compressobj(6, zlib.DEFLATED, -15)
        data = packer.compress(part) + packer.flush()
        out += b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(data) + 25) + data + struct.pack("<II", zlib.crc32(part), len(part))
    path.write_bytes(out)


def records(n):
    rng = random.Random(n)
    out = []
    for k in range(n):
        m = rng.randint(1, 30)
        cigar = rng.choice([f"{m}M", f"{m}M100N{rng.randint(1, 20)}M", f"3S{m}M", f"{m}M2I5M1D4M", "*"])
        ref = rng.choice([*CONTIGS, "*"]) if cigar != "*" else "*"
        mate = rng.choice(["*", "=", "chr2" if ref == "chr1" else "chr1"]) if ref != "*" else "*"
        size = 0 if rng.random() < 0.2 else rng.randint(1, 60)
        tags = [f"NH:i:{rng.randint(1, 3)}", "XS:A:+", "RG:Z:a b", "XB:B:i,1,-2", "ZF:f:0.5"][: rng.randint(0, 5)]
        out.append("\t".join([f"read{k}", str(rng.choice([0, 16, 4, 99])), ref, str(rng.randint(1, 9000)) if ref != "*" else "0", "255", cigar, mate, str(rng.randint(1, 9000)) if mate != "*" else "0", "0", "".join(rng.choice("ACGTN") for _ in range(size)) or "*", "*" if size == 0 or rng.random() < 0.5 else "".join(chr(33 + rng.randint(0, 40)) for _ in range(size)), *tags]))
    return out


@pytest.mark.parametrize(("n", "block", "split"), [(400, 700, 1 << 30), (400, 700, 900), (3000, 65000, 20_000), (30, 90, 50), (0, 500, 100), (1, 500, 10)])
def test_lines_equal_those_written(spark, tmp_path, n, block, split):
    text = records(n)
    write_bam(tmp_path / "a.bam", text, block)
    df = bam.lines(spark, str(tmp_path / "a.bam"), split)
    got = [r.value for r in df.collect()]
    assert sorted(got) == sorted(text)
    assert split > 1 << 20 or n < 30 or df.rdd.getNumPartitions() > 1


def test_alignments_equal_those_of_the_text(spark, tmp_path):
    text = records(500)
    (tmp_path / "bams").mkdir()
    write_bam(tmp_path / "bams" / "a.bam", text[:200], 400)
    write_bam(tmp_path / "bams" / "b.bam", text[200:], 5000)
    (tmp_path / "a.sam").write_text("@HD\tVN:1.6\n" + "\n".join(text) + "\n")
    want = sam.alignments(spark, str(tmp_path / "a.sam"))
    got = bam.alignments(spark, str(tmp_path / "bams"), split=1500)
    assert got.schema == want.schema and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and got.count() > 100

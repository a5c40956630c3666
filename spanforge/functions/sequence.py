"""Nucleotide sequences as string columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The standard genetic code (fixed values), bases in the order T, C, A, G.
BASES = "TCAG"
AMINO_ACIDS = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


def reverse_complement(s: Column) -> Column:
    return F.reverse(F.translate(s, "ACGTacgt", "TGCAtgca"))


def translate(s: Column) -> Column:
    """Amino acids of the whole codons, '*' for stops, 'X' for codons with other letters."""
    # The codons first, in one pass: a place in a string is found by counting from its start.
    codons = F.regexp_extract_all(F.upper(s), F.lit("(?s)..."), F.lit(0))

    def code(codon: Column) -> Column:
        one, two, three = (F.instr(F.lit(BASES), F.substring(codon, j, 1)) for j in (1, 2, 3))
        known = (one > 0) & (two > 0) & (three > 0)
        return F.when(known, F.substring(F.lit(AMINO_ACIDS), (one - 1) * 16 + (two - 1) * 4 + three, F.lit(1))).otherwise("X")

    return F.array_join(F.transform(codons, code), "")


def share_of(s: Column, letters: str) -> Column:
    """Share of the characters that are among the letters; null for an empty sequence."""
    return F.try_divide(F.length(s) - F.length(F.translate(s, letters, "")), F.length(s))


def gc_share(s: Column) -> Column:
    return share_of(s, "GCgc")


def soft_masked(s: Column) -> Column:
    """Share of lower-case letters."""
    return F.try_divide(F.length(s) - F.length(F.regexp_replace(s, "[a-z]", "")), F.length(s))


def kmer_code(s: Column) -> Column:
    """A k-mer as a number in base 4; null where it has another letter."""
    return F.when(s.rlike("^[ACGTacgt]+$"), F.conv(F.translate(F.upper(s), "ACGT", "0123"), 4, 10).cast("long"))


def spliced(contig: Column, exons: Column, strand: Column) -> Column:
    """The exons' bases, (lo, hi) 1-based closed in genome order, joined; reverse complement on '-'."""
    joined = F.array_join(F.transform(exons, lambda e: F.substring(contig, e["lo"], e["hi"] - e["lo"] + 1)), "")
    return F.when(strand == "-", reverse_complement(joined)).otherwise(joined)


def consensus_site(donor: Column, acceptor: Column) -> Column:
    """Whether the intron's first and last two bases are a known splice site."""
    return F.concat(F.upper(donor), F.upper(acceptor)).isin("GTAG", "GCAG", "ATAC")


def wrapped(name: Column, s: Column, width: int = 60) -> Column:
    """A FASTA record."""
    return F.concat(F.lit(">"), name, F.lit("\n"), F.regexp_replace(F.regexp_replace(s, f"(.{{{width}}})", "$1\n"), "\n$", ""))

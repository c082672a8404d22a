"""Column expressions on nucleotide sequences, all inside the JVM.

Coordinates are 0-based and half-open.  Sequences are compared as upper-cased
characters: N differs from a base and equals N.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = "ACGTNacgtn"
COMPLEMENTS = "TGCANtgcan"


def revcomp(s: Column) -> Column:
    """Reverse complement; characters other than ACGTN in either case stay."""
    return F.reverse(F.translate(s, BASES, COMPLEMENTS))


def revcomp_text(s: str) -> str:
    return s.translate(str.maketrans(BASES, COMPLEMENTS))[::-1]


def upper_ascii(s: Column) -> Column:
    """a-z upper-cased; other characters stay, so that lengths do."""
    return F.translate(s, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def encode_text(s: Column) -> Column:
    """A stand-in sequence for any text: letters become bases in turn, all else N."""
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    turned = F.translate(s, letters, ("ACGT" * 7)[:26] * 2)
    return F.regexp_replace(turned, "[^ACGT]", "N")


def kmers(s: Column, k: int, step: int = 1) -> Column:
    """Array of structs (at, kmer) of each window."""
    last = F.length(s) - k
    places = F.when(last >= 0, F.sequence(F.lit(0), last, F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.struct(i.alias("at"), F.substring(s, i + 1, F.lit(k)).alias("kmer")))


def mismatch_places(a: Column, b: Column, length: Column) -> Column:
    """0-based places at which two strings of a length differ."""
    return F.filter(F.sequence(F.lit(0), length - 1), lambda i: F.substring(a, i + 1, F.lit(1)) != F.substring(b, i + 1, F.lit(1)))


def offsets_3p(places: Column, length: Column, strand: Column) -> Column:
    """Distances of mismatches from the primer's 3' end, ascending."""
    return F.array_sort(F.transform(places, lambda i: F.when(strand == "+", length - 1 - i).otherwise(i)))


def parse_locus(s: Column) -> Column:
    """Struct (chrom, start, end) of ``chrom:start-end`` with optional commas, null if it isn't one."""
    pattern = r"^([^:\s]+):([\d,]+)-([\d,]+)$"
    t = F.trim(s)
    part = lambda i: F.replace(F.regexp_extract(t, pattern, i), F.lit(","), F.lit(""))
    return F.when(t.rlike(pattern), F.struct(F.regexp_extract(t, pattern, 1).alias("chrom"), part(2).cast("long").alias("start"), part(3).cast("long").alias("end")))


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (a_start < b_end) & (b_start < a_end)


def contained(start: Column, end: Column, in_start: Column, in_end: Column) -> Column:
    return (start >= in_start) & (end <= in_end)


def flanked(start: Column, end: Column, flank: int, length: Column) -> tuple[Column, Column]:
    """An interval widened by a flank, clamped to a sequence."""
    return F.greatest(F.lit(0).cast("long"), start - flank), F.least(length, end + flank)


def haplotype_id(sample: Column, number: Column) -> Column:
    return F.concat(sample, F.lit("#hap"), number)


def s3_to_https(url: Column) -> Column:
    return F.regexp_replace(url, r"^s3://([^/]*)/?(.*)$", "https://$1.s3.amazonaws.com/$2")


def percent(x: Column, digits: int = 2) -> Column:
    """A share as text like 95.00%, rounded half to even."""
    return F.format_string(f"%.{digits}f%%", F.bround(x * 100, digits))

"""Column expressions on sequences: everything stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Complements, the gap sign included. Fixed values.
FROM_BASES, TO_BASES = "ATGCatgc-", "TACGtacg-"
#: A prime below 2**55, so that 239 times a hash fits a long.
HASH_MODULUS = (1 << 55) - 55


def normalise(seq) -> Column:
    """Upper-case bases."""
    return F.upper(seq)


def digits(seq) -> Column:
    """A, C, G, T as 0 to 3."""
    return F.translate(F.upper(seq), "ACGT", "0123")


def reverse_complement(seq) -> Column:
    """The other strand, read backwards; other letters (N) stay."""
    return F.reverse(F.translate(seq, FROM_BASES, TO_BASES))


def flip_id(name: Column) -> Column:
    """Id of the other strand: a leading minus is put or taken away."""
    return F.when(name.startswith("-"), F.substring(name, 2, 1 << 30)).otherwise(F.concat(F.lit("-"), name))


def compress_runs(seq) -> Column:
    """Each run of one letter as that letter."""
    return F.regexp_replace(seq, r"(?s)(.)\1+", "$1")


def only_bases(seq) -> Column:
    return seq.rlike(r"\A[ACGTacgt]*\z")


def dna_letters(text) -> Column:
    """The A, C, G and T of a text, in upper case."""
    return F.regexp_replace(F.upper(text), "[^ACGT]", "")


def part(seq: Column, start, end) -> Column:
    """Letters ``start`` to ``end`` - 1, from 0."""
    start, end = (F.lit(x) if isinstance(x, int) else x for x in (start, end))
    return F.substring(seq, (start + 1).cast("int"), (end - start).cast("int"))


def occurs_at(seq: Column, offset, other: Column) -> Column:
    return F.substring(seq, F.lit(offset) + 1, F.length(other)) == other


def common_prefix(a: Column, b: Column) -> Column:
    """Length of what both begin with; null if either is null."""
    bits = F.array(*[F.lit(1 << k) for k in range(30, -1, -1)])
    # The longest equal prefix, a binary digit of its length at a time: prefixes of equal prefixes are equal.
    longer = lambda n, bit: F.when((n + bit <= F.least(F.length(a), F.length(b))) & (F.substring(a, F.lit(1), n + bit) == F.substring(b, F.lit(1), n + bit)), n + bit).otherwise(n)
    return F.when(a.isNotNull() & b.isNotNull(), F.aggregate(bits, F.lit(0), longer))


def base4_value(seq) -> Column:
    """Value of up to 31 bases as a number in base 4."""
    return F.conv(digits(seq), 4, 10).cast("long")


def polynomial_hash(seq: Column, base: int = 239, modulus: int = HASH_MODULUS) -> Column:
    """h = h * base + code, over all letters."""
    letters = F.filter(F.split(seq, ""), lambda c: c != "")
    return F.aggregate(letters, F.lit(0).cast("long"), lambda h, c: (h * base + F.ascii(c)) % modulus)


def _code_times(letter: Column, factor: int, modulus: int) -> Column:
    """The letter's code times ``factor``, by 7 bits of the code at a time: the whole product is no long for codes over 255."""
    code, by = F.ascii(letter).cast("long"), F.lit(factor)
    part = lambda k: F.shiftright(code, k).bitwiseAND(F.lit(127)) * by % modulus
    return ((part(14) * 128 + part(7)) % modulus * 128 + part(0)) % modulus


def push_right(h: Column, letter: Column, base: int = 239, modulus: int = HASH_MODULUS) -> Column:
    """Hash of a sequence with one more letter at its end."""
    return (h * base + F.ascii(letter)) % modulus


def push_left(h: Column, letter: Column, size: int, base: int = 239, modulus: int = HASH_MODULUS) -> Column:
    """Hash of a sequence of ``size`` letters with one more letter before it."""
    return (h + _code_times(letter, pow(base, size, modulus), modulus)) % modulus


def shift_right(h: Column, gone: Column, new: Column, size: int, base: int = 239, modulus: int = HASH_MODULUS) -> Column:
    """Hash of the next window of ``size`` letters: ``gone`` leaves at the left, ``new`` comes at the right."""
    rest = (h + modulus - _code_times(gone, pow(base, size - 1, modulus), modulus)) % modulus
    return push_right(rest, new, base, modulus)


def shift_left(h: Column, gone: Column, new: Column, size: int, base: int = 239, modulus: int = HASH_MODULUS) -> Column:
    """Hash of the window before: ``gone`` leaves at the right, ``new`` comes at the left. The inverse of the base undoes a step."""
    rest = (h + modulus - F.ascii(gone)) % modulus
    # The kept letters are rest / base: times the inverse of the base, bit by bit, as the whole product is no long.
    bits = F.array(*[F.lit(int(b)) for b in f"{pow(base, -1, modulus):b}"])
    kept = F.aggregate(bits, F.lit(0).cast("long"), lambda acc, bit: (acc * 2 + rest * bit) % modulus)
    return push_left(kept, new, size - 1, base, modulus)


def canonical(kmer: Column) -> Column:
    """The lesser of a k-mer and its reverse complement."""
    return F.least(kmer, reverse_complement(kmer))


def is_canonical(kmer: Column) -> Column:
    return kmer <= reverse_complement(kmer)


def anchor_score(length: Column, m: Column, n: Column) -> Column:
    return length.cast("double") / (m.cast("double") * n.cast("double"))


def shifted_poisson(k, mean: Column) -> Column:
    """Probability of ``k`` >= 1 under 1 + Poisson(mean - 1)."""
    k = F.lit(k) if isinstance(k, int) else k
    return F.exp(1 - mean) * F.pow(mean - 1, k - 1) / F.factorial((k - 1).cast("int"))


def project(pos: Column, s0: Column, s1: Column, d0: Column, d1: Column) -> Column:
    """A position between s0 and s1 carried over to d0 .. d1; a flat stretch gives d0."""
    along = (pos - s0).cast("double") * (d1 - d0).cast("double") / F.when(s1 != s0, (s1 - s0).cast("double"))
    return F.when(s1 == s0, d0.cast("double")).otherwise(d0 + along)


def wrap(seq: Column, width: int = 60) -> Column:
    """Lines of ``width`` letters."""
    return F.rtrim(F.regexp_replace(seq, f"(.{{{width}}})", "$1\n"), F.lit("\n")) if width else seq


def zero_pad(number: Column, width: int) -> Column:
    return F.lpad(number.cast("string"), width, "0")


def split_fields(text: Column, separators: str = r"\s+") -> Column:
    """Fields between separators, without empty ones."""
    return F.filter(F.split(text, separators), lambda x: x != "")


def mask(text: Column, chars: str, by: str = "_") -> Column:
    """``text`` with each of ``chars`` replaced."""
    return F.translate(text, chars, by * len(chars))


def join_fields(values: Column, separator: str = ",") -> Column:
    return F.array_join(F.transform(values, lambda x: x.cast("string")), separator)

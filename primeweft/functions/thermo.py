"""Nearest-neighbour melting temperatures.

All are JVM expressions: stacks are looked up by fixed-length windows and summed as
integers, so that no order of summation matters.  `duplex_tm` scores a primer against
a window without gaps: it knows mismatches, but neither loops nor bulges.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unified nearest-neighbour parameters (SantaLucia 1998), enthalpy in
# 100 cal/mol and entropy in 0.1 cal/K/mol, both negated.
STACK_H = {"AA": 79, "TT": 79, "AT": 72, "TA": 72, "CA": 85, "TG": 85, "GT": 84, "AC": 84, "CT": 78, "AG": 78, "GA": 82, "TC": 82, "CG": 106, "GC": 98, "GG": 80, "CC": 80}
STACK_S = {"AA": 222, "TT": 222, "AT": 204, "TA": 213, "CA": 227, "TG": 227, "GT": 224, "AC": 224, "CT": 210, "AG": 210, "GA": 222, "TC": 222, "CG": 272, "GC": 244, "GG": 199, "CC": 199}
END_H = {"A": -23, "T": -23, "G": -1, "C": -1}
END_S = {"A": -41, "T": -41, "G": 28, "C": 28}
SYMMETRY_S = 14
# Single internal mismatches (Allawi and SantaLucia 1997 to 1998, Peyret 1999), top
# strand 5' to 3' over bottom strand 3' to 5', enthalpy in kcal/mol and entropy in cal/K/mol.
MISMATCHES = {
    "AG/TT": (1.0, 0.9), "AT/TG": (-2.5, -8.3), "CG/GT": (-4.1, -11.7), "CT/GG": (-2.8, -8.0), "GG/CT": (3.3, 10.4), "GG/TT": (5.8, 16.3), "GT/CG": (-4.4, -12.3), "GT/TG": (4.1, 9.5), "TG/AT": (-0.1, -1.7), "TG/GT": (-1.4, -6.2), "TT/AG": (-1.3, -5.3),
    "AA/TG": (-0.6, -2.3), "AG/TA": (-0.7, -2.3), "CA/GG": (-0.7, -2.3), "CG/GA": (-4.0, -13.2), "GA/CG": (-0.6, -1.0), "GG/CA": (0.5, 3.2), "TA/AG": (0.7, 0.7), "TG/AA": (3.0, 7.4),
    "AC/TT": (0.7, 0.2), "AT/TC": (-1.2, -6.2), "CC/GT": (-0.8, -4.5), "CT/GC": (-1.5, -6.1), "GC/CT": (2.3, 5.4), "GT/CC": (5.2, 13.5), "TC/AT": (1.2, 0.7), "TT/AC": (1.0, 0.7),
    "AA/TC": (2.3, 4.6), "AC/TA": (5.3, 14.6), "CA/GC": (1.9, 3.7), "CC/GA": (0.6, -0.6), "GA/CC": (5.2, 14.2), "GC/CA": (-0.7, -3.8), "TA/AC": (3.4, 8.0), "TC/AA": (7.6, 20.2),
    "AA/TA": (1.2, 1.7), "CA/GA": (-0.9, -4.2), "GA/CA": (-2.9, -9.8), "TA/AA": (4.7, 12.9),
    "AC/TC": (0.0, -4.4), "CC/GC": (-1.5, -7.2), "GC/CC": (3.6, 8.9), "TC/AC": (6.1, 16.4),
    "AG/TG": (-3.1, -9.5), "CG/GG": (-4.9, -15.3), "GG/CG": (-6.0, -15.8), "TG/AG": (1.6, 3.6),
    "AT/TT": (-2.7, -10.8), "CT/GT": (-5.0, -15.8), "GT/CT": (-2.2, -8.4), "TT/AT": (0.2, -1.5),
}
#: What primers without any duplex get.
NO_DUPLEX = -273.0


def stacks() -> dict[str, tuple[int, int]]:
    """Enthalpy and entropy, in the units of the tables above, of every known stack of two pairs, read either way."""
    pairs = str.maketrans("ACGT", "TGCA")
    out = {f"{k}/{k.translate(pairs)}": (h, STACK_S[k]) for k, h in STACK_H.items()}
    for k, (h, s) in MISMATCHES.items():
        out[k] = out[k[::-1]] = (round(-10 * h), round(-10 * s))
    return out


@dataclass(frozen=True)
class Conditions:
    """Concentrations: cations and dNTP in mM, oligo in nM."""

    mv: float = 50.0
    dv: float = 1.5
    dntp: float = 0.6
    oligo: float = 50.0

    @property
    def monovalent(self) -> float:
        return self.mv + 120.0 * math.sqrt(max(0.0, self.dv - self.dntp))


def _sum_of(s: Column, table: dict[str, int]) -> Column:
    entries = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    places = F.sequence(F.lit(1), F.length(s) - 1)
    return F.aggregate(places, F.lit(0), lambda a, i: a + F.coalesce(F.element_at(entries, F.substring(s, i, F.lit(2))), F.lit(0)))


def _ends(s: Column, table: dict[str, int]) -> Column:
    entries = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.element_at(entries, F.substring(s, 1, 1)), F.lit(0)) + F.coalesce(F.element_at(entries, F.substring(s, -1, 1)), F.lit(0))


def oligo_tm(s: Column, c: Conditions = Conditions()) -> Column:  # noqa: B008
    """Melting temperature in degrees Celsius of an upper-cased oligo of two bases or more, else null.

    Stacks with other characters count nothing.
    """
    same = s == F.reverse(F.translate(s, "ACGT", "TGCA"))
    h = _sum_of(s, STACK_H) + _ends(s, END_H)
    entropy = _sum_of(s, STACK_S) + _ends(s, END_S) + F.when(same, SYMMETRY_S).otherwise(0)
    dh = h * F.lit(-100.0)
    ds = entropy * F.lit(-0.1) + F.lit(0.368) * (F.length(s) - 1) * F.lit(math.log(c.monovalent / 1000.0))
    strength = F.when(same, F.lit(math.log(c.oligo / 1e9))).otherwise(F.lit(math.log(c.oligo / 4e9)))
    return F.when(F.length(s) >= 2, dh / (ds + F.lit(1.987) * strength) - F.lit(273.15))


def pair_tm(forward: Column, reverse: Column) -> Column:
    """The lower temperature of a pair's primers."""
    return F.least(oligo_tm(forward), oligo_tm(reverse))


def duplex_tm(primer: Column, window: Column, c: Conditions, end: bool = False) -> Column:
    """Temperature of an upper-cased primer on the strand that pairs with a window, oriented alike and as long; null for nulls.

    From the first matched base to the last, matched stacks and single mismatches count
    by their parameters, a stack of two mismatches nothing.  ``end``: of the stablest
    duplex that ends with the matched last base.
    """
    table = stacks()
    n = F.length(primer)
    other = F.translate(window, "ACGT", "TGCA")
    base = lambda s, i: F.substring(s, i, F.lit(1))
    same = F.transform(F.sequence(F.lit(1), n), lambda i: (base(primer, i) == base(window, i)) & F.instr(F.lit("ACGT"), base(primer, i)).cast("boolean"))

    def each(which: int) -> Column:
        entries = F.create_map(*[F.lit(x) for k, v in table.items() for x in (k, v[which])])
        at = lambda i: F.concat(F.substring(primer, i, F.lit(2)), F.lit("/"), F.substring(other, i, F.lit(2)))
        return F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.coalesce(F.try_element_at(entries, at(i)), F.lit(0)))

    def closing(x: Column, values: dict[str, int]) -> Column:
        return F.when(x.isin("A", "T"), values["A"]).otherwise(values["C"])

    def between(lo: Column, hi: Column) -> Column:
        total = lambda xs: F.aggregate(F.slice(xs, lo, hi - lo), F.lit(0), lambda a, x: a + x)
        h = total(each(0)) + closing(base(primer, lo), END_H) + closing(base(primer, hi), END_H)
        s = total(each(1)) + closing(base(primer, lo), END_S) + closing(base(primer, hi), END_S)
        below = s * F.lit(-0.1) + F.lit(0.368) * (hi - lo) * F.lit(math.log(c.monovalent / 1000.0)) + F.lit(1.987) * F.lit(math.log(c.oligo / 4e9))
        return F.when((hi > lo) & (h > 0) & (below < 0), h * F.lit(-100.0) / below - F.lit(273.15)).otherwise(NO_DUPLEX)

    if end:
        starts = F.filter(F.sequence(F.lit(1), n - 1), lambda i: F.get(same, i - 1))
        tm = F.when(F.get(same, n - 1), F.array_max(F.transform(starts, lambda i: between(i, n)))).otherwise(NO_DUPLEX)
    else:
        lo = F.array_position(same, F.lit(True)).cast("int")
        hi = (n + 1 - F.array_position(F.reverse(same), F.lit(True))).cast("int")
        tm = F.when(lo > 0, between(lo, hi)).otherwise(NO_DUPLEX)
    return F.when(primer.isNotNull() & window.isNotNull(), F.when((n >= 2) & (F.length(window) == n), F.coalesce(tm, F.lit(NO_DUPLEX))).otherwise(NO_DUPLEX))

"""Diversity indices as column expressions over species counts.

With ``n_i`` records of species *i* and ``N`` records in all: Shannon (1948) is
``-sum p_i ln p_i``, Simpson (1949) is ``sum p_i^2``, and the expected number of species
in a sample of ``m`` records (Hurlbert 1971) is ``sum 1 - C(N-n_i, m) / C(N, m)``.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SAMPLE = 50


def absent_chance_sql(n: str, total: str, sample: int = SAMPLE) -> str:
    """Chance that a species with ``n`` of ``total`` records is missing from the sample.

    ``C(N-n, m) / C(N, m)`` is symmetric in n and m, so the product needs only as many
    ratios as the smaller of the two: a species recorded twice costs two. A product is
    exact to rounding at any size, where differences of log-gamma lose digits as counts
    grow; a factor of zero keeps it at zero for species too frequent to be missed.
    """
    return (f"aggregate(sequence(0, cast(least({n}, {sample}) as int) - 1), 1D, "
            f"(chance, k) -> chance * ({total} - greatest({n}, {sample}) - k) / ({total} - k))")


def expected_species_sql(pairs: str, total: str, sample: int = SAMPLE) -> str:
    """Expected species in the sample from an array of (``_n`` records, ``_s`` species)."""
    return (f"aggregate({pairs}, 0D, (acc, p) -> acc + p._s * "
            f"(1D - {absent_chance_sql('p._n', total, sample)}))")


def shannon(total: Column, sum_n_ln_n: Column) -> Column:
    """``ln N - (sum n_i ln n_i) / N``: the same number without knowing N beforehand."""
    return F.ln(total) - sum_n_ln_n / total


def simpson(total: Column, sum_n_squared: Column) -> Column:
    return sum_n_squared / (total * total)

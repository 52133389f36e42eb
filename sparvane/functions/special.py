"""Special functions as column expressions, each beside SQL for DuckDB that states the same value."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lanczos' coefficients for g = 7.
_G = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)
STEPS = 1000


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function for x of 0.5 or more."""
    z = x - 1
    total = sum((F.lit(c) / (z + i) for i, c in enumerate(_G) if i), F.lit(_G[0]))
    t = z + 7.5
    return 0.9189385332046727 + (z + 0.5) * F.log(t) - t + F.log(total)


def t_two_sided(t: Column, df: Column) -> Column:
    """Two-sided p-value of Student's t, to about 1e-9; null where either is null.

    With t = sqrt(df) tan(a), the chance of a smaller one is the integral of cos(x)**(df - 1)
    from 0 to a over that to a right angle: Simpson's rule above, gamma functions below.
    """
    end = F.atan2(F.abs(t), F.sqrt(df))
    step = end / STEPS
    weight = lambda i: F.when((i == 0) | (i == STEPS), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)
    area = F.aggregate(F.sequence(F.lit(0), F.lit(STEPS)), F.lit(0.0), lambda s, i: s + weight(i) * F.pow(F.cos(step * i), df - 1)) * step / 3
    whole = F.exp(log_gamma(df / 2) - log_gamma((df + 1) / 2)) * 0.886226925452758
    return F.when(t.isNotNull() & df.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - F.try_divide(area, whole))))


def t_two_sided_sql(t: str, df: str) -> str:
    area = f"list_sum(list_transform(generate_series(0, {STEPS}), lambda i: (CASE WHEN i = 0 OR i = {STEPS} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * cos(atan2(abs({t}), sqrt({df})) / {STEPS} * i) ** (({df}) - 1))) * (atan2(abs({t}), sqrt({df})) / {STEPS}) / 3"
    return f"CASE WHEN ({t}) IS NOT NULL AND ({df}) IS NOT NULL THEN least(1.0, greatest(0.0, 1 - {area} / (exp(lgamma(({df}) / 2) - lgamma((({df}) + 1) / 2)) * 0.886226925452758))) END"


def normal_two_sided(z: Column) -> Column:
    """Two-sided p-value of a standard normal, to about 1e-9, by Simpson's rule on its density."""
    size = F.least(F.abs(z), F.lit(12.0))
    step = size / STEPS
    weight = lambda i: F.when((i == 0) | (i == STEPS), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)
    area = F.aggregate(F.sequence(F.lit(0), F.lit(STEPS)), F.lit(0.0), lambda s, i: s + weight(i) * F.exp(-step * step * i * i / 2)) * step / 3
    return F.greatest(F.lit(0.0), 1 - area * 0.7978845608028654)


def normal_two_sided_sql(z: str) -> str:
    size = f"least(abs({z}), 12.0)"
    area = f"list_sum(list_transform(generate_series(0, {STEPS}), lambda i: (CASE WHEN i = 0 OR i = {STEPS} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-(({size} / {STEPS} * i) ** 2) / 2))) * ({size} / {STEPS}) / 3"
    return f"greatest(0.0, 1 - {area} * 0.7978845608028654)"


@cache
def rank_sums(n: int, m: int) -> list[int]:
    """In how many ways n of n + m items get each value of U = rank sum - n (n + 1) / 2."""
    ways = [[0] * (n * m + 1) for _ in range(n + 1)]
    ways[0][0] = 1
    for item in range(n + m):  # an item of rank item + 1 adds item - (number taken before) to U
        for k in range(min(n, item + 1), 0, -1):
            gain = item - (k - 1)
            for u in range(n * m, gain - 1, -1):
                ways[k][u] += ways[k - 1][u - gain]
    return ways[n]


@cache
def signed_rank_sums(n: int) -> list[int]:
    """In how many ways signs of n ranks give each sum of the positive ones."""
    ways = [1] + [0] * (n * (n + 1) // 2)
    for rank in range(1, n + 1):
        for s in range(len(ways) - 1, rank - 1, -1):
            ways[s] += ways[s - rank]
    return ways


def exact_tail(value: Column, size: Column, ways: dict[int, list[int]]) -> Column:
    """Twice the chance of the value or a larger one, at most 1, from a table of ways by size; null for other sizes."""
    def tail(counts: list[int]) -> Column:
        down = [sum(counts[i:]) / sum(counts) for i in range(len(counts))]
        return F.get(F.array(*map(F.lit, down)), F.ceil(value).cast("int"))

    chance = F.coalesce(*(F.when(size == k, tail(w)) for k, w in ways.items()))
    return F.when(chance > 0.5, 1.0).otherwise(2 * chance)

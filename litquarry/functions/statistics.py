"""Statistics as column expressions: intervals for shares, agreement, set overlap, cosine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The 97.5 % quantile of the normal distribution, to two places as published reports use it.
Z95 = 1.96


def wilson(hits: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Wilson bounds of a share, within 0 and 1; both 0 where there is nothing."""
    p, zz = hits / n, z * z
    mid = (p + zz / (2 * n)) / (1 + zz / n)
    half = z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n)
    bound = lambda x: F.when(n > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))).otherwise(F.lit(0.0))
    return bound(mid - half), bound(mid + half)


#: 97.5 % quantiles of Student's t for 1 to 9 degrees of freedom, and of the normal distribution.
T_FEW = (12.706204736, 4.302652730, 3.182446305, 2.776445105, 2.570581836, 2.446911851, 2.364624252, 2.306004135, 2.262157163)
Z975 = 1.959963984540054


def t_quantile(freedom: Column) -> Column:
    """The 97.5 % quantile of Student's t; from ten degrees of freedom on by four terms of its expansion around the normal one."""
    z, n = Z975, freedom.cast("double")
    terms = (
        (z**3 + z) / 4,
        (5 * z**5 + 16 * z**3 + 3 * z) / 96,
        (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384,
        (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160,
    )
    far = F.lit(z)
    for k, x in enumerate(terms, 1):
        far = far + F.lit(x) / F.pow(n, F.lit(float(k)))
    few = F.get(F.array(*map(F.lit, T_FEW)), freedom.cast("int") - 1)
    return F.when(freedom < 1, F.lit(None)).when(freedom <= len(T_FEW), few).otherwise(far)


def share(part: Column, whole: Column, scale: float = 1.0) -> Column:
    return F.when(whole > 0, scale * part / whole).otherwise(F.lit(0.0))


def set_metrics(mine: Column, theirs: Column, *, both_empty: float = 0.0) -> dict[str, Column]:
    """Precision, recall, F1 and Jaccard of two arrays as sets."""
    both = F.size(F.array_intersect(mine, theirs))
    return count_metrics(F.size(F.array_distinct(mine)), F.size(F.array_distinct(theirs)), both, both_empty=both_empty)


def count_metrics(a: Column, b: Column, both: Column, *, both_empty: float = 0.0) -> dict[str, Column]:
    """Precision, recall, F1 and Jaccard of two sets by their sizes and that of what they share."""
    union = a + b - both
    return {
        "precision": share(both, a),
        "recall": share(both, b),
        "f1": F.when(both > 0, 2.0 * both / (a + b)).otherwise(F.lit(0.0)),
        "jaccard": F.when(union > 0, both / union).otherwise(F.lit(both_empty)),
    }


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; null where a vector is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def kappa_band(kappa: Column) -> Column:
    """The usual six words for an agreement coefficient."""
    return (
        F.when(kappa.isNull(), F.lit(None)).when(kappa < 0, "poor").when(kappa <= 0.2, "slight").when(kappa <= 0.4, "fair")
        .when(kappa <= 0.6, "moderate").when(kappa <= 0.8, "substantial").otherwise("almost perfect")
    )


def same_within(a: Column, b: Column, tolerance: float = 1e-3) -> Column:
    """Two arrays of numbers are equal in sorted order, each by less than the tolerance; null is an empty array."""
    x, y = (F.array_sort(F.coalesce(c, F.array().cast("array<double>"))) for c in (a, b))
    close = F.forall(F.zip_with(x, y, lambda p, q: F.coalesce(F.abs(p - q) < tolerance, F.lit(False))), lambda ok: ok)
    return (F.size(x) == F.size(y)) & close


def histogram_bin(x: Column, bins: int = 5) -> Column:
    """The bin of a share among equal ones from 0 to 1, the last closed; a rounding guard keeps edges in the upper bin."""
    return F.least(F.floor(F.round(x * bins, 9)), F.lit(bins - 1)).cast("int")

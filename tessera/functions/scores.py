"""Score expressions (functions returning ``Column``), evaluated JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera import constants as C


def rating_quality(avg_rating: Column | str = "avg_rating", num_rates: Column | str = "num_rates",
                   z: float = C.WILSON_Z, bound: str = "upper") -> Column:
    """Wilson score interval bound of ``avg/10`` out of ``n`` ratings.

    The reproduced code adds the square-root term, i.e. the *upper* bound; ``bound="lower"``
    gives the textbook lower bound. Everything is computed in double (an int ``n**2`` would
    overflow for large n)."""
    a = F.col(avg_rating) if isinstance(avg_rating, str) else avg_rating
    n = (F.col(num_rates) if isinstance(num_rates, str) else num_rates).cast("double")
    p = a / F.lit(10.0)
    z2 = F.lit(z ** 2)
    root = F.lit(z) * F.sqrt(p * (F.lit(1.0) - p) / n + z2 / (F.lit(4.0) * (n * n)))
    centre = p + z2 / (F.lit(2.0) * n)
    num = centre + root if bound == "upper" else centre - root
    return num / (F.lit(1.0) + z2 / n)


def minmax(value: Column, lo: Column, hi: Column, constant: float = 1.0) -> Column:
    """(v - lo) / (hi - lo); a constant column (hi == lo) maps to ``constant``."""
    return F.when(hi != lo, (value - lo) / (hi - lo)).otherwise(F.lit(constant))


def minmax_direction(value: Column, lo: Column, hi: Column, higher_is_better: bool = True) -> Column:
    """List normalisation with a direction flag: all-equal -> 1 (higher better) or 0."""
    if higher_is_better:
        return F.when(hi != lo, (value - lo) / (hi - lo)).otherwise(F.lit(1.0))
    return F.when(hi != lo, F.lit(1.0) - (value - lo) / (hi - lo)).otherwise(F.lit(0.0))


def final_score(pop_n: Column, dist_n: Column, rq_n: Column,
                w_pop: float = C.REC_POPULARITY_WEIGHT, w_dist: float = C.REC_DISTANCE_WEIGHT,
                w_rq: float = C.REC_RATING_QUALITY_WEIGHT) -> Column:
    """w_pop*pop_n + w_dist*(1 - dist_n) + w_rq*rq_n, in this evaluation order."""
    return pop_n * F.lit(w_pop) + (F.lit(1.0) - dist_n) * F.lit(w_dist) + rq_n * F.lit(w_rq)


def explanation(dist_n: Column, pop_n: Column, rq_n: Column) -> Column:
    """Similarity phrase first; popularity / rating phrases only when a similarity phrase exists."""
    sim = F.lit(1.0) - dist_n
    hi, mid, lo = C.EXPLAIN_SIM_THRESHOLDS
    first = (F.when(sim > hi, F.lit(C.EXPLAIN_VERY_SIMILAR))
             .when(sim > mid, F.lit(C.EXPLAIN_MANY_SHARED))
             .when(sim > lo, F.lit(C.EXPLAIN_SOME_SHARED)))
    t = C.EXPLAIN_SECONDARY_THRESHOLD
    second = F.when(first.isNotNull() & (pop_n > t), F.lit(C.EXPLAIN_POPULAR))
    third = F.when(first.isNotNull() & (rq_n > t), F.lit(C.EXPLAIN_WELL_RATED))
    return F.concat(F.concat_ws(C.EXPLAIN_JOINER, first, second, third), F.lit("."))

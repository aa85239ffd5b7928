"""Scalar column functions. All of them stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def primitive_motif(motif, enabled: bool = True) -> Column:
    """True if ``motif`` is not a shorter word written several times.

    A word is periodic exactly when it occurs in its own doubling before the
    second copy begins. ``enabled=False`` accepts every word.
    """
    m = _col(motif)
    if not enabled:
        return F.lit(True)
    return _first_return(m) == F.length(m) + 1


def _first_return(m: Column) -> Column:
    # position (1-based) of the first occurrence of m in m||m after position 1
    return F.call_function("locate", m, F.concat(m, m), F.lit(2))


def match_count(a, b) -> Column:
    """Number of positions at which two words of one length agree."""
    a, b = _col(a), _col(b)
    n = F.length(a)
    agree = F.filter(
        F.sequence(F.lit(1), n),
        lambda i: F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1)),
    )
    return F.when(n > 0, F.size(agree)).otherwise(F.lit(0))


def units_match(a, b, miss: int) -> Column:
    """True if two units agree in all but at most ``miss`` positions."""
    return match_count(a, b) >= F.length(_col(a)) - F.lit(miss)


def midpoint(start, end) -> Column:
    """Integer midpoint of an interval, rounded down."""
    return F.call_function("div", _col(start) + _col(end), F.lit(2))


def rotate(word, shift) -> Column:
    """``word`` rotated left by ``shift`` characters."""
    w, t = _col(word), _col(shift).cast("int")
    return F.concat(
        F.substring(w, t + F.lit(1), F.length(w)), F.substring(w, F.lit(1), t)
    )

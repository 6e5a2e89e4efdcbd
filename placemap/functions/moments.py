"""Closed forms for two-dimensional covariance matrices."""

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def chi2_q2(level: float | Column) -> Column | float:
    """Quantile of the chi-square distribution with two degrees of freedom."""
    if isinstance(level, Column):
        return F.lit(-2.0) * F.log(1 - level)
    return -2.0 * math.log(1 - level)


def eig2(sxx: Column, sxy: Column, syy: Column) -> tuple[Column, Column]:
    """Eigenvalues of a symmetric 2x2 matrix, larger first; rounding below zero is lifted to zero."""
    middle = (sxx + syy) / 2
    spread = F.hypot((sxx - syy) / 2, sxy)
    zero = F.lit(0.0)
    return F.greatest(middle + spread, zero), F.greatest(middle - spread, zero)


def major_axis_degrees(sxx: Column, sxy: Column, syy: Column) -> Column:
    """Direction of the larger eigenvector, in (-90, 90]; 0 for a circular matrix."""
    return F.degrees(F.lit(0.5) * F.atan2(2 * sxy, sxx - syy))

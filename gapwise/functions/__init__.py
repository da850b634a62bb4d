"""Column expressions that operators share."""

from gapwise.functions.columns import (  # noqa: F401
    autocorrelation,
    average_rank,
    guarded_corr,
    mad,
    micros,
    ratio,
    rms,
    robust_scale,
    shape_stats,
)

"""The tail functions as Arrow-batched columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from . import special as sp


def _column(f, n: int):
    if n == 1:
        return pandas_udf(lambda a: pd.Series(f(a.to_numpy(float))), DoubleType())
    return pandas_udf(lambda a, b: pd.Series(f(a.to_numpy(float), b.to_numpy(float))), DoubleType())


norm_two_sided_col = _column(lambda z: 2 * sp.norm_sf(np.abs(z)), 1)
norm_ppf_col = _column(sp.norm_ppf, 1)
p_to_z_col = _column(sp.p_to_z, 1)
chi2_sf_col = _column(sp.chi2_sf, 2)
t_two_sided_col = _column(sp.t_two_sided, 2)

"""HTML character references.

Spark has no built-in HTML entity decoder, and the named-entity table has over
two thousand entries, so decoding runs through the standard library in an
Arrow-batched pandas UDF.  Only values that contain '&' go to Python; the rest
stay on the JVM fast path.
"""

from __future__ import annotations

import sys

import html

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Worker-side functions of this module travel by value, so executors need no
# copy of the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@F.pandas_udf(StringType())
def _unescape_batch(s: pd.Series) -> pd.Series:
    return s.map(lambda v: html.unescape(v) if isinstance(v, str) else v)


def html_unescape(col) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    # Python UDFs are evaluated for every row even under a CASE, so values
    # without '&' are shipped as nulls (a few bytes) and kept on the JVM side.
    needs = F.when(F.instr(c, "&") > 0, c)
    return F.when(needs.isNull(), c).otherwise(_unescape_batch(needs))

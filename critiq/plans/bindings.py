"""Driver-table bindings: how the review-quality inputs are read off the
driver's tables.  No review table is supplied, so labels, completions and
gold tags are CASE rules over the documents' own columns; their work grows
with the tables.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed
from . import sqlgen as q

P_ENGLISH, P_METHOD = fixed.PROTECTED_PHRASES

# (condition as Spark SQL / DuckDB SQL, label string) -- joined with '; '
ISSUE_RULES = [
    ("n_chars < 500", "H5. The results do not surpass the latest SOTA"),
    ("text LIKE '%!%'", "H8. " + P_METHOD),
    ("lang <> 'en'", P_ENGLISH),
    ("n_chars > 4000", '"X is not clear", H3. The results are not novel'),
    ("lang = 'de'", " H3. The results are not novel;  The results are not novel"),
    ("source IN ('src2', 'src9')", "The paper is missing relevant/ references"),
    ("n_chars BETWEEN 1000 AND 1500", "Other"),
    ("n_chars BETWEEN 2000 AND 2600", "'The topic is too niche'; This method is too simple,"),
]


def issue_string_sql() -> str:
    parts = ", ".join(f"CASE WHEN {c} THEN {q.lit(l)} END" for c, l in ISSUE_RULES)
    return f"nullif(concat_ws('; ', {parts}), '')"


def issue_string() -> Column:
    parts = [F.when(F.expr(c), F.lit(l)) for c, l in ISSUE_RULES]
    return F.nullif(F.concat_ws("; ", *parts), F.lit(""))

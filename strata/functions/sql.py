"""The engine's functions by name in ``spark.sql``.

Scalars are SQL functions, which the optimizer writes out into the query that calls them: no Python runs.  ``sqs`` is a table function over
counts, a partition for each bin:

    select * from sqs(table(select time_bin(mid_ma, 5) as time_bin, genus, count(*) as n from occurrences group by 1, 2) partition by (time_bin), 0.5)
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import Row

#: Name and parameters to result and body.
SCALARS = {
    "time_bin(age double, width double)": ("double", "rint(age / width) * width + 0.0d"),
    "grid_cell(lat double, lng double, width double)": ("string", "concat_ws(',', cast(rint(lat / width) * width + 0.0d as string), cast(rint(lng / width) * width + 0.0d as string))"),
    "era(age double)": ("string", "case when age > 0 and age <= 66 then 'Cenozoic' when age > 66 and age <= 252 then 'Mesozoic' when age > 252 and age <= 541 then 'Paleozoic' end"),
    "hemisphere(lat double)": ("string", "case when lat > 0 then 'Northern' when lat is not null then 'Southern' end"),
}


class Sqs:
    """Genera needed, the most frequent first, for a share of a bin's occurrences; counts of rows ``(time_bin, genus, n)`` in whole numbers."""

    def __init__(self):
        self.bin, self.quota, self.counts = None, None, []

    def eval(self, row: Row, quota: float):
        self.bin, self.quota = row["time_bin"], quota
        self.counts.append(row["n"])

    def terminate(self):
        if self.quota is None:
            return
        total, so_far, needed = sum(self.counts), 0, 0
        for n in sorted(self.counts, reverse=True):
            if so_far >= self.quota * total:
                break
            so_far, needed = so_far + n, needed + 1
        yield self.bin, needed


def register_functions(spark: SparkSession) -> None:
    """Makes the functions known to this session, in place of those registered before."""
    for head, (kind, body) in SCALARS.items():
        spark.sql(f"create or replace temporary function {head} returns {kind} return {body}")
    spark.udtf.register("sqs", F.udtf(Sqs, returnType="time_bin double, sqs_diversity long"))

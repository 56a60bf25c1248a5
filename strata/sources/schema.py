"""The canonical occurrence table."""

from __future__ import annotations

from pyspark.sql import types as T

_NUMBERS = {"max_ma", "min_ma", "mid_ma", "lat", "lng"}

#: The canonical columns in their order.
COLUMNS = ("occurrence_id", "scientific_name", "rank", "max_ma", "min_ma", "mid_ma", "lat", "lng", "phylum", "class", "order", "family", "genus",
           "environment", "source_db", "reference_no", "primary_reference")

SCHEMA = T.StructType([T.StructField(c, T.DoubleType() if c in _NUMBERS else T.StringType()) for c in COLUMNS])

#: Raw column names that differ from canonical ones.
PBDB_RENAMES = {"occurrence_no": "occurrence_id", "identified_name": "scientific_name", "identified_rank": "rank"}
NEOTOMA_RENAMES = {"occurrenceid": "occurrence_id", "taxonname": "scientific_name"}

#: Texts that stand for a missing value in raw CSV files.
NA_TEXTS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")

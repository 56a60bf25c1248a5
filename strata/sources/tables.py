"""The occurrence view over the star-schema tables (the engine's demonstration data)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The same view for DuckDB.
OCCURRENCES_SQL = """occ as (
  select concat(cast(l_orderkey as varchar), '-', cast(l_linenumber as varchar), '-', cast(l_partkey as varchar)) as occurrence_id,
    p_name as scientific_name, 'genus' as "rank", days/4.0e0+2.0e0 as max_ma, days/4.0e0-2.0e0 as min_ma, days/4.0e0 as mid_ma,
    case when l_quantity=49 then null else cast((l_suppkey*37)%181 as double)-90.0e0 end as lat,
    case when l_quantity=49 then null else cast((l_suppkey*73)%361 as double)-180.0e0 end as lng,
    p_type as phylum, p_brand as "class", concat(p_brand, '/', cast(p_size % 5 as varchar)) as "order", p_name as family,
    case when l_quantity=50 then null else concat('G', cast(l_partkey as varchar)) end as genus,
    concat(l_returnflag, l_linestatus) as environment, l_linestatus as source_db, cast(l_orderkey as varchar) as reference_no,
    o_orderpriority as primary_reference
  from (select *, date_diff('day', cast(l_shipdate as date), date '2001-12-31') as days from lineitem)
  join part on l_partkey=p_partkey join orders on l_orderkey=o_orderkey)"""


def occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical occurrences from lineitem, part and orders."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    line = read("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus", "l_shipdate")
    part = read("part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    orders = read("orders").select("o_orderkey", "o_orderpriority")
    days = F.datediff(F.lit("2001-12-31").cast("date"), F.col("l_shipdate").cast("date"))
    text = lambda c: F.col(c).cast("string")
    place = lambda f, m, o: F.when(F.col("l_quantity") != 49, ((F.col("l_suppkey") * f) % m).cast("double") - o)
    joined = line.join(part, F.col("l_partkey") == F.col("p_partkey")).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(
        F.concat_ws("-", text("l_orderkey"), text("l_linenumber"), text("l_partkey")).alias("occurrence_id"),
        F.col("p_name").alias("scientific_name"), F.lit("genus").alias("rank"),
        (days / 4.0 + 2.0).alias("max_ma"), (days / 4.0 - 2.0).alias("min_ma"), (days / 4.0).alias("mid_ma"),
        place(37, 181, 90.0).alias("lat"), place(73, 361, 180.0).alias("lng"),
        F.col("p_type").alias("phylum"), F.col("p_brand").alias("class"),
        F.concat(F.col("p_brand"), F.lit("/"), (F.col("p_size") % 5).cast("string")).alias("order"),
        F.col("p_name").alias("family"),
        F.when(F.col("l_quantity") != 50, F.concat(F.lit("G"), text("l_partkey"))).alias("genus"),
        F.concat("l_returnflag", "l_linestatus").alias("environment"), F.col("l_linestatus").alias("source_db"),
        text("l_orderkey").alias("reference_no"), F.col("o_orderpriority").alias("primary_reference"),
    )


def raw_pbdb(occ: DataFrame) -> DataFrame:
    """Occurrences as rows of a raw file: its names, all as text, ``NA`` for nulls, no middle of the age, and columns to be dropped."""
    names = {"occurrence_id": "occurrence_no", "scientific_name": "identified_name", "rank": "identified_rank"}
    kept = [c for c in occ.columns if c not in ("mid_ma", "source_db")]
    return occ.select(F.lit("0").alias("paleolat"), *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("NA")).alias(names.get(c, c)) for c in kept), F.lit("x").alias("license"))


def raw_neotoma(occ: DataFrame) -> DataFrame:
    """Occurrences as JSON records: ages in years, as numbers or nested, and a text for those without a genus."""
    age = (F.col("mid_ma") * 1_000_000).cast("long").cast("string")
    shown = F.when(F.col("genus").isNull(), F.lit('"unknown"')).when(F.col("source_db") == "O", F.concat(F.lit('{"age":'), age, F.lit("}"))).otherwise(age)
    place = F.to_json(F.struct(F.struct(F.array("lng", "lat").alias("coordinates")).alias("geography")))
    record = F.concat(F.lit('{"age":'), shown, F.lit(',"site":'), place, F.lit(","), F.substring(F.to_json(F.struct(F.col("occurrence_id").alias("occurrenceid"), F.col("scientific_name").alias("taxonname"))), 2, 1 << 20))
    return occ.select(F.parse_json(record).alias("row"))


def record_pbdb(occ: DataFrame, folder: str) -> str:
    """Writes ``raw_pbdb`` as recorded CSV answers, those of an interval below ``interval=<name>``; the folder."""
    interval = F.when(F.col("mid_ma") <= 66, "Cenozoic").when(F.col("mid_ma") <= 252, "Mesozoic").when(F.col("mid_ma") <= 541, "Paleozoic").otherwise("Older")
    raw = raw_pbdb(occ.withColumn("interval", interval)).drop("paleolat", "license")
    raw.write.partitionBy("interval").csv(folder, header=True, escape='"')
    return folder


def record_neotoma(occ: DataFrame, folder: str, page: int) -> tuple[str, int]:
    """Writes ``raw_neotoma`` as recorded JSON answers of about ``page`` records below ``offset=<number>``; the folder and the number of pages."""
    pages = max(1, -(-occ.count() // page))
    rows = raw_neotoma(occ).select(F.to_json("row").alias("record"))
    number = F.pmod(F.xxhash64("record"), F.lit(pages)) * page
    answers = rows.groupBy(number.alias("offset")).agg(F.concat(F.lit('{"data":['), F.array_join(F.collect_list("record"), ","), F.lit("]}")).alias("value"))
    answers.write.partitionBy("offset").text(folder)
    return folder, pages

"""The award fact DataFrame bound onto the driver tables.

One row per (recipient, award) = one ``lineitem`` row. The mapping of fact
columns onto the star schema is fixed here; every operator downstream only sees
the fact column names, so another data set needs only another binding.

Join order is chosen for scale: the order-level side (orders ⋈ customer ⋈
nation ⋈ region) is built first, so the lineitem-sized side is shuffled once,
on ``orderkey``. ``nation`` and ``region`` are fixed 25- and 5-row dimensions
(their size does not grow with the scale factor), so they are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read_table

# Fixed values of the binding (see SURVEY §7.2).
ORG_SEGMENT = "MACHINERY"
STATUS_TO_GENDER = {"F": "female", "O": "male"}
OTHER_GENDER = "other"
ORG_GENDER = "organization"
DECADE_WIDTH = 2  # the data spans 1995-2001, so a 2-year bucket plays the decade

FACT_COLUMNS = (
    "id", "name", "gender", "is_org", "category", "award_year", "decade",
    "birth_country", "birth_continent", "age_at_award", "prize_amount",
    "prize_amount_adjusted", "lifespan", "is_alive",
)


def geography(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation ⋈ region: fixed-size dimension (25 rows), safe to broadcast."""
    nation = read_table(spark, sf_dir, "nation", ["n_nationkey", "n_name", "n_regionkey"])
    region = read_table(spark, sf_dir, "region", ["r_regionkey", "r_name"])
    return nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey, "left").select(
        "n_nationkey", "n_name", "r_name"
    )


def holders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recipient dimension: customer with its country and continent."""
    customer = read_table(spark, sf_dir, "customer", ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"])
    geo = geography(spark, sf_dir)
    return customer.join(F.broadcast(geo), customer.c_nationkey == geo.n_nationkey, "left").select(
        F.col("c_custkey"),
        F.col("c_name"),
        F.col("c_mktsegment"),
        F.col("n_name").alias("birth_country"),
        F.col("r_name").alias("birth_continent"),
    )


def _gender(is_org: Column, status: Column) -> Column:
    expr = F.when(is_org, F.lit(ORG_GENDER))
    for code, label in STATUS_TO_GENDER.items():
        expr = expr.when(status == code, F.lit(label))
    return expr.otherwise(F.lit(OTHER_GENDER))


def award_orders(spark: SparkSession, sf_dir: str, decade_width: int = DECADE_WIDTH) -> DataFrame:
    """Order-grain part of the fact (every column that does not need lineitem)."""
    orders = read_table(
        spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority"]
    )
    who = holders(spark, sf_dir)
    joined = orders.join(who, orders.o_custkey == who.c_custkey, "inner")
    is_org = F.col("c_mktsegment") == F.lit(ORG_SEGMENT)
    year = F.year(F.col("o_orderdate"))
    return joined.select(
        F.col("o_orderkey"),
        F.col("o_orderdate"),
        F.col("o_custkey").alias("id"),
        F.col("c_name").alias("name"),
        _gender(is_org, F.col("o_orderstatus")).alias("gender"),
        is_org.alias("is_org"),
        F.col("o_orderpriority").alias("category"),
        year.alias("award_year"),
        (F.floor(year / F.lit(decade_width)) * F.lit(decade_width)).cast("int").alias("decade"),
        F.col("birth_country"),
        F.col("birth_continent"),
    )


def award_facts(
    spark: SparkSession, sf_dir: str, decade_width: int = DECADE_WIDTH, with_text: bool = False
) -> DataFrame:
    """The full fact: lineitem ⋈ (orders ⋈ customer ⋈ nation ⋈ region).

    ``with_text`` adds ``motivation`` (the part name, via ``l_partkey``); it is
    a separate join so reports that do not read text do not pay for it."""
    cols = ["l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]
    if with_text:
        cols.append("l_partkey")
    items = read_table(spark, sf_dir, "lineitem", cols)
    head = award_orders(spark, sf_dir, decade_width)
    fact = items.join(head, items.l_orderkey == head.o_orderkey, "inner")
    order_day = F.to_date(F.col("o_orderdate"))
    ship_day = F.to_date(F.col("l_shipdate"))
    lifespan = F.when(ship_day >= order_day, F.round(F.datediff(ship_day, order_day) / F.lit(365.25), 1))
    is_org = F.col("is_org")
    out = [
        F.col("id"), F.col("name"), F.col("gender"), is_org, F.col("category"),
        F.col("award_year"), F.col("decade"), F.col("birth_country"), F.col("birth_continent"),
        F.col("l_quantity").cast("int").alias("age_at_award"),
        F.col("l_extendedprice").alias("prize_amount"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("prize_amount_adjusted"),
        lifespan.alias("lifespan"),
        (lifespan.isNull() & ~is_org).alias("is_alive"),
    ]
    if with_text:
        part = read_table(spark, sf_dir, "part", ["p_partkey", "p_name"])
        fact = fact.join(part, fact.l_partkey == part.p_partkey, "left")
        out.append(F.coalesce(F.col("p_name"), F.lit("")).alias("motivation"))
    return fact.select(*out)


def order_facts(spark: SparkSession, sf_dir: str, decade_width: int = DECADE_WIDTH) -> DataFrame:
    """The fact at order grain with ``n_items`` = its number of fact rows.

    For reports that only count rows by order-level attributes (category,
    year, gender, country, ...), lineitem is reduced to one count per order
    *before* the join: the partial aggregate runs map-side, so the largest
    shuffle carries one row per order instead of one per line item. Counting
    ``sum(n_items)`` gives exactly the row counts of ``award_facts``; distinct
    values are those of the fact because orders without items drop out of the
    inner join."""
    items = read_table(spark, sf_dir, "lineitem", ["l_orderkey"]).groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n_items"))
    head = award_orders(spark, sf_dir, decade_width)
    return items.join(head, items.l_orderkey == head.o_orderkey, "inner").drop("l_orderkey", "o_orderkey", "o_orderdate")


def persons(df: DataFrame) -> DataFrame:
    """Recipients that are not organisations."""
    return df.filter(~F.col("is_org"))


def text_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text corpus bound onto ``documents``: name=source, category=lang, motivation=text."""
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text", "lang", "source"])
    return docs.select(
        F.col("doc_id").alias("id"),
        F.col("source").alias("name"),
        F.col("lang").alias("category"),
        F.coalesce(F.col("text"), F.lit("")).alias("motivation"),
    )

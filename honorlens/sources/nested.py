"""Nested recipient documents → flat fact.

A document is ``{RECORDS_FIELD: [recipient, ...]}``; a recipient holds a list of
awards. The explicit schema means no inference pass over the input, and the
flatten is pure column expressions plus one ``explode`` (inner: a recipient
without awards yields no row)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import age_at, bucket, lifespan_years, parse_partial_date

# Field names of the source document format (they must match the
# input documents): the record list, the per-record award list, and the two
# external-reference objects.
RECORDS_FIELD = "laureates"
AWARDS_FIELD = "nobelPrizes"
PAGE_REF_FIELD = "wikipedia"
ENTITY_REF_FIELD = "wikidata"

_EN = T.StructType([T.StructField("en", T.StringType())])
_PLACE = T.StructType([T.StructField("city", _EN), T.StructField("country", _EN), T.StructField("continent", _EN)])
_DATED_PLACE = T.StructType([T.StructField("date", T.StringType()), T.StructField("place", _PLACE)])
_AFFILIATION = T.StructType([T.StructField("name", _EN), T.StructField("country", _EN)])
AWARD = T.StructType([
    T.StructField("awardYear", T.StringType()),
    T.StructField("category", _EN),
    T.StructField("motivation", _EN),
    T.StructField("prizeAmount", T.StringType()),
    T.StructField("prizeAmountAdjusted", T.StringType()),
    T.StructField("portion", T.StringType()),
    T.StructField("dateAwarded", T.StringType()),
    T.StructField("affiliations", T.ArrayType(_AFFILIATION)),
])
RECIPIENT = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("orgName", _EN),
    T.StructField("founded", _DATED_PLACE),
    T.StructField("givenName", _EN),
    T.StructField("familyName", _EN),
    T.StructField("gender", T.StringType()),
    T.StructField("birth", _DATED_PLACE),
    T.StructField("death", T.StructType([T.StructField("date", T.StringType())])),
    T.StructField(PAGE_REF_FIELD, T.StructType([T.StructField("slug", T.StringType())])),
    T.StructField(ENTITY_REF_FIELD, T.StructType([T.StructField("id", T.StringType())])),
    T.StructField(AWARDS_FIELD, T.ArrayType(AWARD)),
])
DOCUMENT = T.StructType([T.StructField(RECORDS_FIELD, T.ArrayType(RECIPIENT))])


def get_path(path: str, default=None) -> Column:
    """Nested field access with a default (a typed struct cannot tell a
    missing key from a JSON null; both take the default — N7)."""
    c = F.col(path)
    return c if default is None else F.coalesce(c, F.lit(default))


def read_documents(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Read one document file or a directory/glob of page files and return
    one row per recipient. A file is one JSON document, which one task reads whole;
    with ``lines`` it has a document a line, and large files are split."""
    raw = spark.read.schema(DOCUMENT).option("multiLine", not lines).option("encoding", "UTF-8").json(path)
    return recipients(raw)


def recipients(raw_documents: DataFrame, col: str = RECORDS_FIELD) -> DataFrame:
    """Concatenates the record arrays of all pages — one row per recipient."""
    return _exploded(raw_documents, col, "r").select("r.*")


def _exploded(df: DataFrame, col: str, out: str, *keep: Column) -> DataFrame:
    """A row per element of the array ``col``, as an inner ``explode`` gives them.

    For an inner one Spark adds a filter on the array's size and moves it down: below joins and
    shuffles, where an array that is parsed from text is parsed once more, row by row in the join.
    """
    return df.select(*keep, F.posexplode_outer(col).alias("_at", out)).filter(F.col("_at").isNotNull()).drop("_at")


def parse_documents(json_strings: DataFrame, col: str = "json") -> DataFrame:
    """F21s: JSON text column → recipients, with the explicit document schema."""
    return recipients(json_strings.select(F.from_json(F.col(col), DOCUMENT).alias("d")).select("d.*"))


def flatten(rec: DataFrame, decade_width: int = 10) -> DataFrame:
    """One row per (recipient, award) with the typed fact columns."""
    is_org = F.col("orgName").isNotNull()

    def either(org_path: str, person_path: str) -> Column:  # P3
        return F.when(is_org, F.col(org_path)).otherwise(F.col(person_path))

    name = F.when(is_org, get_path("orgName.en", "Unknown Org")).otherwise(
        F.trim(F.concat_ws(" ", get_path("givenName.en", ""), get_path("familyName.en", "")))  # F1s
    )
    birth = parse_partial_date(either("founded.date", "birth.date"))
    death = F.when(~is_org, parse_partial_date(F.col("death.date")))
    base = _exploded(
        rec, AWARDS_FIELD, "p",  # P2, inner
        F.col("id"), name.alias("name"),
        F.when(is_org, F.lit("organization")).otherwise(get_path("gender", "unknown")).alias("gender"),
        is_org.alias("is_org"), birth.alias("birth_date"), death.alias("death_date"),
        either("founded.place.city.en", "birth.place.city.en").alias("birth_city"),
        either("founded.place.country.en", "birth.place.country.en").alias("birth_country"),
        either("founded.place.continent.en", "birth.place.continent.en").alias("birth_continent"),
        F.col(f"{PAGE_REF_FIELD}.slug").alias("wiki_slug"), F.col(f"{ENTITY_REF_FIELD}.id").alias("wikidata_id"),
    )
    year = F.col("p.awardYear").try_cast("int")  # P10
    first_aff = F.try_element_at(F.col("p.affiliations"), F.lit(1))  # P4
    return base.select(
        "id", "name", "gender", "is_org", "birth_date", "death_date", "birth_city", "birth_country",
        "birth_continent",
        F.coalesce(F.col("p.category.en"), F.lit("Unknown")).alias("category"),
        year.alias("award_year"),
        bucket(year, decade_width).alias("decade"),
        F.coalesce(F.nullif(F.col("p.motivation.en"), F.lit("")), F.lit("")).alias("motivation"),
        F.col("p.prizeAmount").try_cast("double").alias("prize_amount"),
        F.col("p.prizeAmountAdjusted").try_cast("double").alias("prize_amount_adjusted"),
        F.coalesce(F.col("p.portion"), F.lit("1")).alias("portion"),
        F.col("p.dateAwarded").alias("date_awarded"),
        first_aff["name"]["en"].alias("affiliation"),
        first_aff["country"]["en"].alias("affiliation_country"),
        age_at(F.col("birth_date"), F.col("p.awardYear")).alias("age_at_award"),  # P6
        lifespan_years(F.col("birth_date"), F.col("death_date")).alias("lifespan"),  # P7
        (F.col("death_date").isNull() & ~F.col("is_org")).alias("is_alive"),  # P9
        "wiki_slug", "wikidata_id",
    )

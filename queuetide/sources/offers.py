"""Nested flight offers: reading, flattening, reporting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.calendar import hhmm
from .arrays import array_elements

OFFER = (
    "STRUCT<id: STRING, numberOfBookableSeats: INT, price: STRUCT<total: STRING, currency: STRING>, "
    "itineraries: ARRAY<STRUCT<segments: ARRAY<STRUCT<carrierCode: STRING, number: STRING, "
    "departure: STRUCT<iataCode: STRING, at: STRING>, arrival: STRUCT<iataCode: STRING, at: STRING>>>>>>"
)


def offers_of(documents: DataFrame, text: str = "value", keep: list[str] | None = None) -> DataFrame:
    """One row per offer of each document; the root is a list or ``{"data": [...]}``."""
    listed = F.from_json(F.col(text), f"ARRAY<{OFFER}>")
    wrapped = F.from_json(F.col(text), f"data ARRAY<{OFFER}>")["data"]
    is_list = F.ltrim(F.col(text)).startswith("[")
    return documents.select(*(keep or []), F.posexplode(F.when(is_list, listed).otherwise(wrapped)).alias("position", "offer"))


def load_offers(spark: SparkSession, path: str, lists: bool = False, cut: str = "}") -> DataFrame:
    """Offers of every file below ``path``, with file and position as input order.

    With ``lists`` every file's root is a list: files of any size are then read in byte
    ranges, which begin behind ``cut`` (see ``array_elements``), and positions rise, but not
    one by one. Otherwise a file is read as a whole.
    """
    if lists:
        return array_elements(spark, path, cut).select("file", "position", F.from_json("element", OFFER).alias("offer"))
    files = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    return offers_of(files, keep=["file"])


def flatten_offers(df: DataFrame, offer: str = "offer", keep: list[str] | None = None) -> DataFrame:
    """First segment's departure and carrier, last segment's arrival, first itinerary."""
    o = F.col(offer)
    if dict(df.dtypes)[offer] == "string":
        df = df.withColumn(offer, F.from_json(o, OFFER))
    segments = F.get(o["itineraries"], F.lit(0))["segments"]
    first, last = F.get(segments, F.lit(0)), F.try_element_at(segments, F.lit(-1))
    return df.select(
        *(keep or []),
        first["departure"]["iataCode"].alias("origin"),
        last["arrival"]["iataCode"].alias("destination"),
        first["carrierCode"].alias("carrier"),
        F.concat(first["carrierCode"], first["number"]).alias("flight"),
        o["price"]["total"].alias("price"),
        o["price"]["total"].try_cast("double").alias("price_value"),
        o["price"]["currency"].alias("currency"),
        first["departure"]["at"].alias("time_iso"),
        F.try_to_timestamp(F.rtrim(first["departure"]["at"], F.lit("Z"))).cast("timestamp_ntz").alias("departs"),
        F.coalesce(o["numberOfBookableSeats"], F.lit(0)).alias("seats"),
    )


def report_lines(numbered: DataFrame) -> DataFrame:
    """``01. ORIGIN : DESTINATION - PRICE CURRENCY - HH:MM`` from numbered offers.

    ``numbered`` carries ``number`` (from 1) and ``total`` rows.
    """
    width = F.length(F.col("total").cast("string"))
    text = F.col("number").cast("string")
    padded = F.lpad(text, F.greatest(width, F.length(text)), F.lit("0"))
    num, origin, destination, price, currency, at = (
        F.coalesce(c, F.lit("null")) for c in (F.col("num"), *map(F.col, ("origin", "destination", "price", "currency")), hhmm("time_iso")))
    return numbered.withColumn("num", padded).withColumn("line", F.concat(
        num, F.lit(". "), origin, F.lit(" : "), destination, F.lit(" - "), price, F.lit(" "), currency, F.lit(" - "), at))

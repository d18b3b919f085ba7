"""IP addresses to countries by range, and what follows from a country."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

#: Language spoken first in a country.
LANGUAGES = {"de": "de", "at": "de", "ch": "de", "fr": "fr", "be": "fr", "es": "es", "mx": "es", "ar": "es", "us": "en", "gb": "en", "ca": "en", "au": "en", "it": "it", "pl": "pl", "cz": "cs", "sk": "sk", "nl": "nl", "pt": "pt", "br": "pt", "se": "sv", "dk": "da", "no": "no", "fi": "fi", "hu": "hu", "ro": "ro", "bg": "bg", "gr": "el", "tr": "tr", "ru": "ru", "ua": "uk", "jp": "ja", "kr": "ko", "cn": "zh", "il": "iw"}


def ipv4(ip: Column) -> Column:
    """The number of a dotted address, null for anything else."""
    p = F.split(ip, r"\.")
    ok = F.regexp_like(ip, F.lit(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"))
    n = sum((F.get(p, k).cast("long") * 256 ** (3 - k) for k in range(4)), F.lit(0))
    return F.when(ok & F.forall(p, lambda x: x.cast("int") <= 255), n)


@F.pandas_udf(StructType([StructField("hi", LongType()), StructField("lo", LongType())]))
def ipv6(ips: pd.Series) -> pd.DataFrame:
    """Both halves of an address as signed longs; IPv4 addresses are mapped."""

    def one(text):
        try:
            a = ipaddress.ip_address(text)
        except ValueError:
            return None, None
        n = int(a) if a.version == 6 else int(a) | 0xFFFF << 32
        return tuple(int.from_bytes((x & 2**64 - 1).to_bytes(8, "big"), "big", signed=True) for x in (n >> 64, n))

    return pd.DataFrame([one(x) for x in ips], columns=["hi", "lo"], dtype="object")


def range_lookup(rows: DataFrame, ranges: DataFrame, value: str, slot_bits: int = 16) -> DataFrame:
    """rows with country of the range (start, end, country) that holds value, both ends inclusive.

    Ranges do not overlap. Both sides meet by the number's high bits, so this is an
    equi join with a residual test; a range is copied to each slot it spans.
    """
    width = 1 << slot_bits
    spread = ranges.select("start", "end", F.col("country").alias("_country"), F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))).alias("_slot"))
    keyed = rows.withColumn("_k", F.floor(F.col(value) / width))
    return keyed.join(spread, (F.col("_k") == F.col("_slot")) & (F.col(value) >= F.col("start")) & (F.col(value) <= F.col("end")), "left").withColumn("country", F.coalesce("_country", F.lit(""))).drop("_k", "_slot", "_country", "start", "end")


def language_of(country: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.lower(country)), F.lit("all"))


def countries(spark: SparkSession) -> DataFrame:
    """(code, name, flag) of the ISO 3166 countries that the JVM knows: some 250 rows. A flag is its code in regional indicators."""
    locale = spark._jvm.java.util.Locale
    sign = lambda code: "".join(chr(0x1F1E6 + ord(c) - ord("A")) for c in code)
    rows = [(c, locale("", c).getDisplayCountry(locale.ENGLISH), sign(c)) for c in locale.getISOCountries()]
    return spark.createDataFrame(rows, "code string, name string, flag string")


def named(rows: DataFrame, known: DataFrame, column: str = "country") -> DataFrame:
    """rows with country_name and flag; unknown codes name themselves and have no flag."""
    k = F.broadcast(known.select(F.col("code").alias("_code"), F.col("name").alias("_name"), F.col("flag").alias("_flag")))  # a row a country
    out = rows.join(k, F.upper(F.col(column)) == F.col("_code"), "left")
    return out.withColumn("country_name", F.coalesce("_name", F.col(column))).withColumn("flag", F.coalesce("_flag", F.lit(""))).drop("_code", "_name", "_flag")


def place_of(places: Column, country: Column) -> Column:
    """Of an array of struct<country, ..> the first in the user's country, else the first."""
    return F.coalesce(F.get(F.filter(places, lambda p: p["country"] == country), F.lit(0)), F.get(places, F.lit(0)))

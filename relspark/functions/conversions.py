"""Conversions of spreadsheet cells and literals, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that read as true or false.
TRUE_WORDS = ("TRUE", "YES", "WAAR", "JA", "WEL")
FALSE_WORDS = ("FALSE", "NO", "ONWAAR", "NEE", "NIET")
SHORT, HEAD, TAIL = 254, 243, 10  # Fixed values: longest id, and what stays of a longer one


def to_boolean(text: Column) -> Column:
    word = F.upper(F.trim(text))
    return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)


def to_integer(text: Column) -> Column:
    return F.trim(text).try_cast("bigint")


def to_float(text: Column) -> Column:
    return F.trim(text).try_cast("double")


def serial_to_date(serial: Column) -> Column:
    """A spreadsheet's day number as a date; day 0 is 1899-12-30."""
    return F.date_add(F.lit("1899-12-30").cast("date"), F.floor(serial).cast("int"))


def serial_to_timestamp(serial: Column) -> Column:
    """Days and their fraction, to the second."""
    return F.timestamp_seconds(F.round(serial * 86400).cast("bigint") - 25569 * 86400)


def number_to_text(number: Column) -> Column:
    """A number without a trailing ``.0``."""
    whole = number == F.floor(number)
    return F.when(whole & (F.abs(number) < 1e15), F.floor(number).cast("string")).otherwise(number.cast("string"))


def iso_date(text: Column) -> Column:
    return F.trim(text).try_cast("date")


def iso_timestamp(text: Column) -> Column:
    """To the second."""
    return F.date_trunc("second", F.trim(text).try_cast("timestamp"))


def short_id(text: Column) -> Column:
    """Ids of over 254 characters end in a digest of the whole; shorter ones stay."""
    return F.when(F.length(text) > SHORT, F.concat(F.substring(text, 1, HEAD), F.lit("_"), F.substring(F.sha1(text.cast("binary")), 1, TAIL))).otherwise(text)


def split_cells(df: DataFrame, key: str, cell: str, delimiter: str | None, *, flipped: bool = False, trim: bool = True) -> DataFrame:
    """(src, tgt) of every non-empty part of every cell; rows without a key or a part give none."""
    values = F.split(F.col(cell), F.concat(F.lit("\\Q"), F.lit(delimiter), F.lit("\\E"))) if delimiter else F.array(cell)
    pairs = df.select(F.col(key).alias("src"), F.explode(values).alias("tgt"))
    pairs = pairs.withColumn("tgt", F.trim("tgt")) if trim else pairs
    pairs = pairs.where("src IS NOT NULL AND tgt IS NOT NULL AND tgt <> ''").distinct()
    return pairs.select(F.col("tgt").alias("src"), F.col("src").alias("tgt")) if flipped else pairs

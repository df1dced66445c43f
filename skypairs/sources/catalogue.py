"""Reading catalogues and tables, and writing tables about tilings."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tiles import explode_neighbours, pixel_centre_vectors, pixel_table, with_decoded


def read_catalogue(spark: SparkSession, path: str, ra: str = "ra", dec: str = "dec",
                   fmt: str = "parquet", keep: tuple[str, ...] = (), **options) -> DataFrame:
    """The two angle columns of a catalogue in degrees (and those in ``keep``). Only these columns
    are read from columnar files."""
    return spark.read.format(fmt).options(**options).load(path).select(ra, dec, *keep)


def read_without(spark: SparkSession, path: str, *unwanted: str, fmt: str = "parquet") -> DataFrame:
    """A table without some of its columns; unknown names are ignored."""
    return spark.read.format(fmt).load(path).drop(*unwanted)


def read_columns(spark: SparkSession, path: str, schema: str, sep: str = " ") -> DataFrame:
    """A text table with a header line and columns parted by runs of ``sep``."""
    # each line as one column, so that the reader drops the header of every file
    lines = spark.read.schema("line string").option("sep", "\u0001").option("quote", "").option("header", True).csv(path)
    runs = f"(?:{re.escape(sep)})+"
    squeezed = F.regexp_replace(F.regexp_replace("line", f"^{runs}|{runs}$", ""), runs, sep.replace("\\", "\\\\").replace("$", "\\$"))
    return (lines.where(F.length("line") > 0)
            .select(F.from_csv(squeezed, schema, {"sep": sep}).alias("row")).select("row.*"))


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    df.write.mode("overwrite").format(fmt).save(path)


def centre_table(spark: SparkSession, tiling: str, nbase: int) -> DataFrame:
    """(face, x, y, z) of every pixel centre of a tiling; HEALPix has twelve base faces."""
    df = pixel_centre_vectors(pixel_table(spark, tiling, nbase), tiling, nbase)
    return with_decoded(df, nbase, tiling=tiling).select("face", "x", "y", "z")


def neighbour_table(pixels: DataFrame, tiling: str, nbase: int, ipix: str = "ipix") -> DataFrame:
    """(face, i, j, x, y, z) of the given pixels and of their neighbours."""
    df = explode_neighbours(pixels.select(ipix), tiling, nbase, ipix, "at", with_self=True)
    df = with_decoded(pixel_centre_vectors(df, tiling, nbase, "at"), nbase, "at", tiling)
    return df.select("face", "i", "j", "x", "y", "z")

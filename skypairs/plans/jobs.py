"""The jobs a user runs, with the settings of a job file as plain arguments."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..functions.binning import Binning
from ..operators.pairs import pair_counts, pair_counts_on_tiling
from ..operators.quality import random_sky, sample_with_centres
from ..operators.reduce import reduced_pair_counts
from ..sources.catalogue import read_catalogue, write_table


@dataclass(frozen=True)
class PairCountJob:
    """``cover="cells"`` joins on cubes, complete by construction; a tiling name joins on pixels."""
    data: str
    n_bins: int
    bin_min: float
    bin_max: float
    imin: int
    imax: int
    bin_type: str = "log"
    ra_name: str = "ra"
    dec_name: str = "dec"
    cover: str = "cells"
    reduce_tiling: str = "similar_radius"
    metric: str = "chord"

    @property
    def binning(self) -> Binning:
        full = Binning.of_type(self.bin_type, self.bin_min, self.bin_max, self.n_bins, self.metric)
        return full.slice(self.imin, self.imax)

    def exact(self, spark: SparkSession, num_partitions: int | None = None) -> DataFrame:
        catalogue = read_catalogue(spark, self.data, self.ra_name, self.dec_name)
        if self.cover == "cells":
            return pair_counts(catalogue, self.binning, self.ra_name, self.dec_name,
                               num_partitions=num_partitions)
        return pair_counts_on_tiling(catalogue, self.binning, self.cover, self.ra_name, self.dec_name,
                                     num_partitions=num_partitions)

    def reduced(self, spark: SparkSession, num_partitions: int | None = None) -> DataFrame:
        catalogue = read_catalogue(spark, self.data, self.ra_name, self.dec_name)
        return reduced_pair_counts(catalogue, self.binning, self.reduce_tiling, None, self.ra_name,
                                   self.dec_name, num_partitions=num_partitions)


def write_pixel_sample(spark: SparkSession, path: str, tiling: str, nbase: int, n: int,
                       seed: int | None = None) -> None:
    """Random directions with their pixel and its centre, as a parquet table."""
    write_table(sample_with_centres(random_sky(spark, n, seed), tiling, nbase), path)

"""Camera-trap captures: subsets, counts and samples."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .prefix import union_all
from .relational import random_rows

# Species names that count as lions.
LIONS = ("lionFemale", "lionMale")


def capture_subsets(captures: DataFrame, lions=LIONS) -> DataFrame:
    """(subset, CaptureEventID) of the named subsets; a capture may be in several."""
    tests = {"babies": F.col("Babies") > .9, "uneven": (F.col("Evenness") > .8) & (F.col("NumVotes") > 20),
             "eating": F.col("Eating") > .9, "lion": F.col("Species").isin(*lions)}
    names = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in tests.items()]))
    return captures.select(F.explode(names).alias("subset"), "CaptureEventID")


def captures_per(captures: DataFrame, fields: dict) -> DataFrame:
    return union_all([captures.groupBy(F.col(c).cast("string").alias("key")).agg(F.count("*").alias("n"))
                     .select(F.lit(name).alias("what"), "key", "n") for name, c in fields.items()])


def season_counts(links: DataFrame, golds: DataFrame) -> DataFrame:
    """(what, key, n): images per season (the first part of a link), per season and per species among the captures that have a gold label."""
    season = F.split_part("URL_Info", F.lit("/"), F.lit(1)).alias("season")
    images = links.select("CaptureEventID", season)
    labelled = golds.select("CaptureEventID", "Species").join(images, "CaptureEventID")
    return union_all([captures_per(images, {"season": "season"}), captures_per(labelled, {"gold season": "season", "gold species": "Species"})])


def sample_captures(subset: DataFrame, links: DataFrame, n: int, seed=0) -> DataFrame:
    """n random captures of a subset, with the first image of each."""
    picked = random_rows(subset.select("CaptureEventID").distinct(), "CaptureEventID", n, seed)
    return links.join(picked, "CaptureEventID").groupBy("CaptureEventID").agg(F.min("image").alias("image"))

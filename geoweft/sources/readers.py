"""Readers of the file formats: JSON posts and users, pruned user rows, edge lists, homes, gazetteers, models, predictions, folds."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema


def read_posts(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of posts, gzip or plain; over a directory all files ending in .gz, at any depth."""
    reader = spark.read.schema(schema.POST)
    if Path(path).is_dir():
        reader = reader.option("recursiveFileLookup", True).option("pathGlobFilter", "*.gz")
    return reader.json(path)


def read_users(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.USER).json(path)


def read_sparse_users(spark: SparkSession, path: str) -> DataFrame:
    """Pruned user rows (a user id, then eight columns per post), one row per post. Posts with a bad id are skipped, the rest of the line kept."""
    cells = F.split("value", "\t", -1)
    lines = spark.read.text(path).select(cells.alias("c")).where(F.size("c") > 8)
    starts = F.sequence(F.lit(1), F.size("c") - 8, F.lit(8))
    each = lines.select(F.col("c")[0].try_cast("bigint").alias("user_id"), F.explode(F.transform(starts, lambda i: F.slice("c", i + 1, 8))).alias("p"))
    point = F.split(F.col("p")[3], " ")
    ids = F.filter(F.transform(F.split(F.col("p")[4], " "), lambda x: x.try_cast("bigint")), lambda x: x.isNotNull())
    out = each.select(
        "user_id", F.col("p")[1].try_cast("bigint").alias("id"), F.col("p")[0].alias("text"), F.col("p")[2].alias("location"),
        F.get(point, F.lit(0)).try_cast("double").alias("lat"), F.get(point, F.lit(1)).try_cast("double").alias("lon"), ids.alias("mentions"),
        F.filter(F.split(F.col("p")[5], " "), lambda x: x != "").alias("hashtags"), (F.lower(F.col("p")[6]) == "true").alias("is_retweet"),
        F.when(F.col("p")[7] != "", F.col("p")[7]).alias("place"),
    )
    return out.where("user_id IS NOT NULL AND id IS NOT NULL")


def read_table(spark: SparkSession, path: str, columns: str, separator: str = "\t", skip: int = 0) -> DataFrame:
    """Separated values with named, typed columns; lines whose number of cells differs, or whose values have the wrong type, drop out."""
    fields = [c.split() for c in columns.split(", ")]
    cells = F.split("value", separator.replace("|", "\\|"), -1)
    lines = spark.read.text(path)
    if skip:  # the first lines of each file, by position
        lines = lines.select("value", F.col("_metadata.file_path").alias("f"), F.monotonically_increasing_id().alias("at"))
        lines = lines.withColumn("r", F.rank().over(Window.partitionBy("f").orderBy("at"))).where(F.col("r") > skip).select("value")
    typed = lines.where(F.size(cells) == len(fields)).select(*[F.get(cells, F.lit(i)).try_cast(kind).alias(name) for i, (name, kind) in enumerate(fields)])
    numbers = [name for name, kind in fields if kind in ("bigint", "double", "int")]
    return typed.where(" AND ".join(f"{n} IS NOT NULL" for n in numbers)) if numbers else typed


def read_homes(spark: SparkSession, path: str, held_out: DataFrame | None = None) -> DataFrame:
    """Home locations, without the users of a hold-out set."""
    rows = read_table(spark, path, "user_id bigint, lat double, lon double")
    return rows if held_out is None else rows.join(held_out.select("user_id"), "user_id", "left_anti")


def read_edges(spark: SparkSession, path: str, weighted: bool = False, directed: bool = True) -> DataFrame:
    """An edge list parted by blanks; repeated edges count once. Undirected lists are returned in both directions."""
    rows = read_table(spark, path, "src bigint, dst bigint, weight bigint" if weighted else "src bigint, dst bigint", " ")
    rows = (rows if weighted else rows.withColumn("weight", F.lit(1).cast("bigint"))).dropDuplicates(["src", "dst"])
    if directed:
        return rows
    return rows.unionByName(rows.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")).dropDuplicates(["src", "dst"])


#: Column orders of the gazetteer formats.
GAZETTEERS = {
    "geonames": ("\t", ["city", "region", "country", "lat", "lon"]),
    "geolite": (",", ["lat", "lon", "country", "region", "city"]),
    "google": ("\t", ["lat", "lon", "country", "region", "_", "_", "city"]),
    "dbpedia": ("\t", ["city", "region", "country", "lat", "lon"]),
}


def read_gazetteer(spark: SparkSession, path: str, source: str = "geonames") -> DataFrame:
    """``place_id, city, region, country, lat, lon`` of a gazetteer file; ``geo-median`` is another name of ``geolite``.

    Rows without numbers for a point (headers too) drop out; dbpedia lists several regions in one cell, each becomes a row. Ids follow the file's order.
    """
    source = {"geo-median": "geolite"}.get(source, source)
    if source not in GAZETTEERS:
        raise ValueError(f"unknown gazetteer {source}; known are {', '.join(sorted(GAZETTEERS))}")
    separator, order = GAZETTEERS[source]
    schema = ", ".join(f"c{i} string" for i in range(len(order)))
    # tab-parted files know no quotes; in comma-parted ones a quoted cell may hold commas
    line = F.from_csv("value", schema, {"sep": separator, "quote": '"' if separator == "," else "\u0000", "mode": "PERMISSIVE"})
    rows = spark.read.text(path).select(F.monotonically_increasing_id().alias("place_id"), line.alias("c"))
    clean = lambda name: F.trim(F.regexp_replace(F.col(f"c.c{order.index(name)}"), '^"|"$', ""))
    out = rows.select("place_id", *[clean(n).alias(n) for n in ("city", "region", "country")], *[clean(n).try_cast("double").alias(n) for n in ("lat", "lon")])
    out = out.where("lat IS NOT NULL AND lon IS NOT NULL AND NOT isnan(lat) AND NOT isnan(lon)")
    return out.withColumn("region", F.explode(F.split("region", r"\|"))) if source == "dbpedia" else out


def read_abbreviations(spark: SparkSession, path: str) -> dict[str, str]:
    """Abbreviation to name; blank abbreviations drop out. The file is a short list."""
    rows = spark.read.option("header", True).csv(path).select("abbreviation", "name").where("trim(abbreviation) <> ''").limit(100_001).collect()
    if len(rows) > 100_000:
        raise ValueError("the list of abbreviations is too long for one map")
    return {r["abbreviation"].strip(): r["name"] for r in rows}


def read_model(spark: SparkSession, path: str) -> DataFrame:
    """A trained model; rows whose id is no number are skipped."""
    return spark.read.parquet(path) if not str(path).endswith((".tsv", ".tsv.gz")) else read_table(spark, path, "user_id bigint, lat double, lon double")


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """post_id, lat, lon; a JSON header line drops out."""
    return read_table(spark, path, "post_id bigint, lat double, lon double")


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, "post_id bigint, user_id bigint, lat double, lon double")


def read_settings(path: str) -> dict:
    return json.loads(Path(path).read_text())


def read_folds(spark: SparkSession, folder: str) -> DataFrame:
    """The gold table of a fold set: post_id, user_id, lat, lon, fold."""
    return spark.read.schema("post_id BIGINT, user_id BIGINT, lat DOUBLE, lon DOUBLE, fold INT").parquet(f"{folder}/gold")


def read_fold_files(spark: SparkSession, folder: str) -> DataFrame:
    """The gold posts of a folder of fold files, by its manifest ``folds.info.tsv``: post_id, user_id, lat, lon, fold."""
    out = None
    for fold in sorted(r["fold"] for r in read_table(spark, f"{folder}/folds.info.tsv", "fold int, posts string, users string, records string").collect()):
        part = read_gold(spark, f"{folder}/fold_{fold}.gold-locations.tsv").withColumn("fold", F.lit(fold))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError(f"no folds in {folder}")
    return out


def read_held_out(spark: SparkSession, folder: str, fold: int, what: str = "user") -> DataFrame:
    """The ids of a fold's held-out users, or posts (``what="post"``)."""
    return read_table(spark, f"{folder}/fold_{fold}.{what}-ids.txt", f"{what}_id bigint")


def read_fold_predictions(spark: SparkSession, folder: str, folds: list[int]) -> DataFrame:
    """fold, post_id, lat, lon of the result files of each fold; a missing file counts as empty, of repeated posts the last line holds."""
    out = spark.createDataFrame([], "fold int, post_id bigint, lat double, lon double")
    for fold in folds:
        try:
            rows = read_predictions(spark, f"{folder}/fold_{fold}.results.tsv.gz").withColumn("at", F.monotonically_increasing_id())
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            continue
        last = rows.groupBy("post_id").agg(F.max_by(F.struct("lat", "lon"), "at").alias("p"))
        out = out.unionByName(last.select(F.lit(fold).alias("fold"), "post_id", "p.lat", "p.lon"))
    return out

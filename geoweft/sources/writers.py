"""Writers of the file formats. Nothing is overwritten unless ``force`` is set."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import squash
from ..operators.graph import in_network
from ..operators.skew import skew_safe_semi


def _mode(force: bool) -> str:
    return "overwrite" if force else "errorifexists"


def write_users(users: DataFrame, path: str, force: bool = False) -> None:
    """User records as gzipped JSON lines."""
    users.write.mode(_mode(force)).json(path, compression="gzip")


def write_sparse_users(posts: DataFrame, path: str, force: bool = False) -> None:
    """Pruned user rows: records (user_id, part, posts) as lines of a user id and eight columns per post."""
    column = lambda p, name: F.coalesce(p[name].cast("string"), F.lit(""))
    flag = lambda p: F.when(p["is_retweet"], "True").otherwise("False")
    cells = F.transform("posts", lambda p: F.concat_ws("\t", squash(column(p, "text")), column(p, "post_id"), squash(column(p, "location")), column(p, "point"), column(p, "mentions"), column(p, "hashtags"), flag(p), squash(column(p, "place"))))
    posts.select(F.concat_ws("\t", F.col("user_id").cast("string"), F.array_join(cells, "\t")).alias("value")).write.mode(_mode(force)).text(path, compression="gzip")


def write_edges(edges: DataFrame, path: str, weighted: bool = False, force: bool = False) -> None:
    columns = ["src", "dst", *(["weight"] if weighted else [])]
    edges.select(F.concat_ws(" ", *[F.col(c).cast("string") for c in columns]).alias("value")).write.mode(_mode(force)).text(path)


def write_model(model: DataFrame, path: str | None, force: bool = False) -> None:
    """A model as Parquet, or as gzipped lines where the path says .tsv; nothing is written without a path."""
    if path is None:
        return
    rows = model.select("user_id", "lat", "lon")
    if ".tsv" in path:
        rows.write.mode(_mode(force)).csv(path, sep="\t", compression="gzip")
    else:
        rows.write.mode(_mode(force)).parquet(path)


def write_predictions(predictions: DataFrame, path: str, header: dict | None = None, force: bool = False) -> None:
    """post_id, lat, lon with six decimals; unlocated posts are left out. The header goes into a file beside the lines."""
    located = predictions.where("lat IS NOT NULL AND lon IS NOT NULL")
    located.select(F.col("post_id"), *[F.format_string("%.6f", F.col(c)).alias(c) for c in ("lat", "lon")]).write.mode(_mode(force)).csv(path, sep="\t", compression="gzip")
    if header is not None and "://" not in path:
        Path(path, "_header.json").write_text(json.dumps(header))


def write_folds(gold: DataFrame, folder: str, force: bool = False) -> None:
    """The gold table by fold, and the held-out users of each fold."""
    gold.write.mode(_mode(force)).partitionBy("fold").parquet(f"{folder}/gold")
    gold.select("user_id", "fold").distinct().write.mode(_mode(force)).partitionBy("fold").parquet(f"{folder}/users")


def write_report(score: DataFrame, path: str, force: bool = False) -> None:
    score.write.mode(_mode(force)).json(path)


def write_network_users(users: DataFrame, key: str, edges: DataFrame, path: str, force: bool = False) -> None:
    """The user records whose user has an edge, as gzipped JSON lines."""
    write_users(in_network(users, key, edges), path, force)


def write_fold_files(gold: DataFrame, records: DataFrame, key: str, folder: str, force: bool = False) -> None:
    """Per fold: ids of its gold posts and users, its gold locations, and the records of its users; and a manifest ``folds.info.tsv``.

    ``gold``: post_id, user_id, lat, lon, fold. The few folds are written one after another.
    """
    mode, names = _mode(force), []
    for fold in sorted(r[0] for r in gold.select("fold").distinct().collect()):
        mine, stem = gold.where(F.col("fold") == fold), f"fold_{fold}"
        users = mine.select("user_id").distinct()
        mine.select(F.col("post_id").cast("string")).distinct().write.mode(mode).text(f"{folder}/{stem}.post-ids.txt")
        users.select(F.col("user_id").cast("string")).write.mode(mode).text(f"{folder}/{stem}.user-ids.txt")
        mine.select("post_id", "user_id", "lat", "lon").write.mode(mode).csv(f"{folder}/{stem}.gold-locations.tsv", sep="\t")
        write_users(skew_safe_semi(records, users.select(F.col("user_id").alias(key)), key), f"{folder}/{stem}.users.json.gz", force)
        names.append((fold, f"{stem}.post-ids.txt", f"{stem}.user-ids.txt", f"{stem}.users.json.gz"))
    gold.sparkSession.createDataFrame(names, "fold int, posts string, users string, records string").coalesce(1).write.mode(mode).csv(f"{folder}/folds.info.tsv", sep="\t")


def write_fold_predictions(predictions: DataFrame, folder: str, folds: list[int], force: bool = False) -> None:
    """``fold, post_id, lat, lon`` as one result file per fold."""
    for fold in folds:
        write_predictions(predictions.where(F.col("fold") == fold), f"{folder}/fold_{fold}.results.tsv.gz", force=force)


def write_error_sample(sample: DataFrame, path: str, force: bool = False) -> None:
    """``post_id, km, lat, lon`` of sampled errors, tab-parted."""
    sample.select("post_id", "km", "lat", "lon").write.mode(_mode(force)).csv(path, sep="\t")

"""File formats, streams and the driver's entry points."""

import gzip
import json
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from geoweft.operators import datasets
from geoweft.plans import methods
from geoweft.sources import readers, writers
from geoweft.streaming import posts as streams


def test_posts_of_a_folder(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    with gzip.open(tmp_path / "deep" / "a.json.gz", "wt") as f:
        f.write(json.dumps({"id": 1, "user": {"id": 7}, "entities": {"user_mentions": [{"id_str": "8"}]}}) + "\n" + json.dumps({"id": 2}) + "\n")
    (tmp_path / "other.txt").write_text("not read")
    rows = readers.read_posts(spark, str(tmp_path)).select("id", datasets.path("user.id").alias("u"), datasets.path("entities.user_mentions[].id_str").alias("m")).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [(1, 7, ["8"]), (2, None, [])]


def test_sparse_users_round_trip(spark, tmp_path):
    raw = spark.createDataFrame([("5", 1, "a\tb", "here", ([1.5, 2.5],), ["6", "7"], ["x"], None, ("city", "P", "C")), ("5", 2, None, None, None, None, None, "r", None)], "user_id string, id bigint, text string, location string, geo struct<coordinates:array<double>>, mentions array<string>, hashtags array<string>, retweeted_status string, place struct<place_type:string,full_name:string,country:string>")
    sparse = datasets.sparse_posts(raw)
    records = datasets.user_records(sparse, "user_id", "post_id", ["text", "location", "point", "mentions", "hashtags", "is_retweet", "place"])
    writers.write_sparse_users(records, str(tmp_path / "u"))
    (tmp_path / "u" / "bad.txt").write_text("9\t" + "\t".join(["t", "nan", "", "", "", "", "False", ""]) + "\t" + "\t".join(["ok", "3", "", "", " 4 x", "", "True", ""]))
    got = {r["id"]: r for r in readers.read_sparse_users(spark, str(tmp_path / "u")).collect()}
    assert set(got) == {1, 2, 3} and got[1]["text"] == "a b" and (got[1]["lat"], got[1]["lon"]) == (1.5, 2.5) and got[1]["mentions"] == [6, 7]
    assert got[2]["is_retweet"] and got[2]["mentions"] == [] and got[3]["mentions"] == [4]
    with pytest.raises(Exception):
        writers.write_sparse_users(records, str(tmp_path / "u"))


def test_tables(spark, tmp_path):
    edges = spark.createDataFrame([(1, 2, 3), (2, 1, 4)], "src bigint, dst bigint, weight bigint")
    writers.write_edges(edges, str(tmp_path / "e"), weighted=True)
    assert readers.read_edges(spark, str(tmp_path / "e"), weighted=True).count() == 2
    (tmp_path / "b.elist").write_text("1 2\n1 2\nbroken\n2 1 9\n")
    assert {tuple(r) for r in readers.read_edges(spark, str(tmp_path / "b.elist"), directed=False).collect()} == {(1, 2, 1), (2, 1, 1)}
    model = spark.createDataFrame([(1, 1.0, 2.0)], "user_id bigint, lat double, lon double")
    writers.write_model(model, None)
    for name in ("m.tsv", "m"):
        writers.write_model(model, str(tmp_path / name))
        assert [tuple(r) for r in readers.read_model(spark, str(tmp_path / name)).collect()] == [(1, 1.0, 2.0)]
    writers.write_predictions(spark.createDataFrame([(1, 1.0, 2.0), (2, None, None)], "post_id bigint, lat double, lon double"), str(tmp_path / "p"), {"method": "x"})
    assert [tuple(r) for r in readers.read_predictions(spark, str(tmp_path / "p")).collect()] == [(1, 1.0, 2.0)]
    gold = spark.createDataFrame([(1, 2, 3.0, 4.0, 0)], "post_id bigint, user_id bigint, lat double, lon double, fold int")
    writers.write_folds(gold, str(tmp_path / "f"))
    assert [tuple(r) for r in readers.read_folds(spark, str(tmp_path / "f")).collect()] == [(1, 2, 3.0, 4.0, 0)]


def test_gazetteer_files(spark, tmp_path):
    (tmp_path / "g.tsv").write_text("city\tregion\tcountry\tlat\tlon\nParis\tIle\tFrance\t48.8\t2.3\n")
    (tmp_path / "d.tsv").write_text("Twin\tA|B\tC\t1.0\t2.0\nBad\tA\tC\tNaN\t2.0\n")
    (tmp_path / "l.csv").write_text('copyright\nlat,lon,country,region,city\n1.5,2.5,"FR","A8","Paris"\n')
    assert [r["city"] for r in readers.read_gazetteer(spark, str(tmp_path / "g.tsv")).collect()] == ["Paris"]
    assert {r["region"] for r in readers.read_gazetteer(spark, str(tmp_path / "d.tsv"), "dbpedia").collect()} == {"A", "B"}
    assert [(r["city"], r["lat"]) for r in readers.read_gazetteer(spark, str(tmp_path / "l.csv"), "geo-median").collect()] == [("Paris", 1.5)]
    with pytest.raises(ValueError):
        readers.read_gazetteer(spark, "x", "unknown")
    (tmp_path / "s.csv").write_text("id,name,abbreviation,country\n1,Ohio,OH,US\n2,None, ,US\n")
    assert readers.read_abbreviations(spark, str(tmp_path / "s.csv")) == {"OH": "Ohio"}


def test_quoted_cells_of_a_gazetteer(spark, tmp_path):
    (tmp_path / "g.csv").write_text('Copyright (c) nobody\nlat,lon,country,region,city\n1.5,2.5,"AA","B, east","Old, Town"\n3.0,4.0,AA,B,Plain\n')
    got = [tuple(r)[1:] for r in readers.read_gazetteer(spark, str(tmp_path / "g.csv"), "geolite").orderBy("lat").collect()]
    assert got == [("Old, Town", "B, east", "AA", 1.5, 2.5), ("Plain", "B", "AA", 3.0, 4.0)]


def test_first_lines_are_skipped_by_position(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("1\t2.0\n5\t6.0\n7\t8.0\n")
    assert sorted(tuple(r) for r in readers.read_table(spark, str(tmp_path / "t.tsv"), "a bigint, b double", skip=1).collect()) == [(5, 6.0), (7, 8.0)]


def test_predictions_of_folds(spark, tmp_path):
    rows = spark.createDataFrame([(0, 1, 1.0, 2.0), (0, 2, None, 2.0), (2, 3, 5.0, 6.0)], "fold int, post_id bigint, lat double, lon double")
    writers.write_fold_predictions(rows, str(tmp_path / "f"), [0, 2])
    assert sorted(tuple(r) for r in readers.read_fold_predictions(spark, str(tmp_path / "f"), [0, 1, 2]).collect()) == [(0, 1, 1.0, 2.0), (2, 3, 5.0, 6.0)]
    (tmp_path / "g").mkdir()
    (tmp_path / "g" / "fold_0.results.tsv.gz").mkdir()
    (tmp_path / "g" / "fold_0.results.tsv.gz" / "part.csv").write_text("9\t1.0\t1.0\n9\t2.0\t2.0\n")
    assert [tuple(r) for r in readers.read_fold_predictions(spark, str(tmp_path / "g"), [0]).collect()] == [(0, 9, 2.0, 2.0)]
    with pytest.raises(Exception, match="exist"):
        writers.write_fold_predictions(rows, str(tmp_path / "f"), [0])


def test_a_method_is_fitted_saved_and_loaded(spark, tmp_path):
    edges = spark.createDataFrame([(1, 2, 1), (2, 1, 1), (2, 3, 1), (3, 2, 1)], "src bigint, dst bigint, weight bigint")
    home = spark.createDataFrame([(1, 10.0, 20.0)], "user_id bigint, lat double, lon double")
    (tmp_path / "settings.json").write_text('{"rounds": 1}')
    method = methods.Method("spatial_label_propagation", str(tmp_path / "settings.json"))
    with pytest.raises(ValueError):
        method.save(str(tmp_path / "none"))
    method.fit(methods.Inputs(spark, None, edges, edges, home, None)).save(str(tmp_path / "m.tsv.gz"))
    again = methods.Method("spatial_label_propagation").load(spark, str(tmp_path / "m.tsv.gz"))
    posts = spark.createDataFrame([(7, 2), (8, 3), (9, None)], "post_id bigint, user_id bigint")
    assert [tuple(r) for r in again.infer_posts(posts).collect()] == [(7, 2, 10.0, 20.0)]  # one round reaches user 2 only
    records = spark.createDataFrame([(2, [1, 2]), (3, [5])], "user_id bigint, posts array<bigint>")
    got = {r["user_id"]: [x and tuple(x) for x in r["locations"]] for r in again.infer_users(records).collect()}
    assert got == {2: [(10.0, 20.0)] * 2, 3: [None]}
    with pytest.raises(KeyError):
        methods.Method("none")


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(1, "5", "2024-01-01 00:00:00", ["6", "6"]), (1, "5", "2024-01-01 01:00:00", ["6"]), (2, "9", "2024-01-02 00:00:00", None), (None, "5", "2024-01-02 00:00:00", [])], "id bigint, user_id string, received_at string, mentions array<string>")
    rows.withColumn("received_at", F.col("received_at").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / "in"))

    def run(make, name, mode="append"):
        source = spark.readStream.schema("id bigint, user_id string, received_at timestamp, mentions array<string>").parquet(str(tmp_path / "in"))
        query = make(source).writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        query.awaitTermination()
        return spark.table(name).collect()

    assert sorted(r["id"] for r in run(streams.first_deliveries, "firsts")) == [1, 2]
    model = spark.createDataFrame([(5, 1.0, 2.0)], "user_id bigint, lat double, lon double")
    assert {tuple(r) for r in run(lambda s: streams.infer_stream(s, model), "inferred")} == {(1, 5, 1.0, 2.0), (None, 5, 1.0, 2.0)}
    assert [(r["src"], r["dst"], r["weight"]) for r in run(streams.mention_counts, "counts", "complete")] == [(5, 6, 3)]


def test_entry_points_work_without_the_llm_subpackage():
    code = "import sys; sys.modules['geoweft.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'p2_found' in q and 'p7_ids' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], check=True)


def test_every_oracle_belongs_to_a_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())

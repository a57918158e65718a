"""Real files in and out."""

import json

from pyspark.sql import functions as F

from aerolake.functions import text as X
from aerolake.plans.fixtures import view
from aerolake.plans.queries_sampling import chunk_points
from aerolake.sources import ingest as G
from aerolake.sources import sinks as W
from tests.conftest import SF

CAM = "extrinsic\n0 -1 0 1\n1 0 0 2\n0 0 1 3\n0 0 0 1\n\nintrinsic\n50 0 8\n0 50 8\n0 0 1\n\nh w fov\n16 20 18.5\n"


def test_scene_tree(spark, tmp_path):
    for scene in ("a", "b"):
        for folder in ("images", "cams", "depth"):
            (tmp_path / scene / folder).mkdir(parents=True)
        for i in (1, 2, 10):
            (tmp_path / scene / "images" / f"f{i}.jpg").write_bytes(b"x")
        (tmp_path / scene / "cams" / "f2.txt").write_text(CAM)
        (tmp_path / scene / "cams" / "f10.txt").write_text("extrinsic\n1 2 3 4\n")
        (tmp_path / scene / "depth" / "f10.exr").write_bytes(b"x")
        (tmp_path / scene / "depth" / "notes.md").write_text("no frame")
    got = G.scan_scenes(G.list_files(spark, str(tmp_path))).orderBy("scene", "frame").collect()
    assert [(r.scene, r.stem, r.has_cam, r.has_depth) for r in got][:3] == [("a", "f1", False, False), ("a", "f2", True, False), ("a", "f10", True, True)]
    cams, bad = G.ingest_cameras(spark, str(tmp_path))
    c = cams.where("scene = 'a'").first()
    assert (c.stem, c.height, c.width, c.fov, c.k[0]) == ("f2", 16, 20, 18.5, 50.0)
    # inverse of a quarter turn: -R^T t
    assert [c.t_c2w[i] for i in (3, 7, 11)] == [-2.0, 1.0, -3.0]
    assert {(r.stem, r.reason) for r in bad.collect()} == {("f10", "missing_section")}


def test_natural_order(spark):
    df = spark.createDataFrame([(s,) for s in ("f10", "f9", "F2b", "2x", "f2")], "s string")
    assert [r.s for r in df.orderBy(X.natural_key("s")).collect()] == ["2x", "f2", "F2b", "f9", "f10"]


def test_metrics_json(spark, tmp_path):
    p = tmp_path / "m1" / "ds" / "s1" / "eval"
    p.mkdir(parents=True)
    (p / "metrics.json").write_text(json.dumps({"pose": {"ate": {"ate_rmse": 1.5}}, "point_cloud": {"fscore": {"0.5": {"fscore": "high"}}}}))
    got = G.ingest_metrics(spark, str(tmp_path), {"a": ("pose", "ate", "ate_rmse"), "f": ("point_cloud", "fscore", "0.5", "fscore"), "none": ("x",)})
    assert {(r.method, r.dataset, r.scene, r.metric): r.value for r in got.collect()} == {
        ("m1", "ds", "s1", "a"): 1.5, ("m1", "ds", "s1", "f"): None, ("m1", "ds", "s1", "none"): None}


def test_payload_update_touches_only_its_chunks(spark, tmp_path):
    path = str(tmp_path / "p")
    df = chunk_points(spark, SF).select("scene", "chunk_id", "point_id", "x")
    W.write_chunk_payload(df, path)
    n = df.count()
    W.update_chunk_payload(df.where("chunk_id = 0").withColumn("x", F.lit(-1.0)), path)
    back = W.read_chunk_payload(spark, path, ["x"])
    assert back.count() == n and back.where("x = -1").select("chunk_id").distinct().collect() == [(0,)]


def test_csv_and_image_lines_round_trip(spark, tmp_path):
    m = spark.createDataFrame([("s", "precision@0.5", 0.25), ("s", "ate", 1.0)], "scene string, metric string, value double")
    W.write_metrics_csv(W.flatten_metrics(m), str(tmp_path / "m"))
    assert spark.read.csv(str(tmp_path / "m"), header=True).first().asDict() == {"scene": "s", "ate": "1.0", "precision@0p5": "0.25"}
    obs = spark.createDataFrame([("s", 3, 0, 1.5, 2.5, 7), ("s", 3, 1, 3.0, 4.0, 9)], "scene string, frame int, p2d_idx long, u double, v double, point3d_id long")
    im = spark.createDataFrame([("s", 3, 1.0, 0.0, 0.0, 0.0, 1.0, 2.0, 3.0, 1, "f.jpg")],
                               "scene string, frame int, qw double, qx double, qy double, qz double, tx double, ty double, tz double, camera_id int, name string")
    text = W.recon_image_lines(obs, im).select(F.lit("/r/s/images.txt").alias("path"), F.col("line").alias("value"))
    images, back = G.parse_recon_images(text)
    assert images.first().name == "f.jpg" and [(r.p2d_idx, r.x, r.point_id) for r in back.orderBy("p2d_idx").collect()] == [(0, 1.5, 7), (1, 3.0, 9)]


def test_one_images_file_over_many_tasks(spark, tmp_path):
    """Records of two lines, blank second lines, comments and a missing last line: by lines as by whole files."""
    (tmp_path / "s").mkdir()
    rows = ["# header", "# two lines a record"]
    for i in range(400):
        rows.append(f"{i} 1 0 0 0 {i} 2 3 1 im{i}.jpg")
        rows.append("" if i % 7 == 3 else " ".join(f"{i + k} {k} {k - 1}" for k in range(i % 5 + 1)))
        if i % 50 == 9:
            rows.append("# between records")
    (tmp_path / "s" / "images.txt").write_text("\n".join(rows[:-1]))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    try:
        lines = G.read_text_lines(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() > 4
        by_line = [sorted(map(tuple, t.collect()), key=str) for t in G.parse_recon_images(lines)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    whole = [sorted(map(tuple, t.collect()), key=str) for t in G.parse_recon_images(G.read_text_files(spark, str(tmp_path)))]
    assert by_line == whole and len(whole[0]) == 400 and len(whole[1]) > 900


def test_recon_cameras(spark):
    f = spark.createDataFrame([("/r/s/cameras.txt", "# c\n1 PINHOLE 640 480 500 510 320 240\n")], "path string, value string")
    c = G.parse_recon_cameras(f).first()
    assert (c.model, c.width, c.params) == ("PINHOLE", 640, [500.0, 510.0, 320.0, 240.0])


def test_chunk_lists_of_many_scenes(spark, tmp_path):
    """Folders do not follow the number of scenes, and a scene lies in one of them."""
    rows = spark.range(600).select(F.floor(F.col("id") / 2).alias("scene"), (F.col("id") % 2).alias("chunk_id"), F.array(F.col("id").cast("int")).alias("indices"))
    W.write_chunk_lists(rows, str(tmp_path / "lists"))
    back = spark.read.schema("scene LONG, chunk_id LONG, indices ARRAY<INT>, block LONG").json(str(tmp_path / "lists"))
    assert sorted(map(tuple, back.drop("block").collect())) == sorted(map(tuple, rows.collect()))
    assert len(list((tmp_path / "lists").glob("*=*"))) <= W.LIST_BLOCKS
    assert back.groupBy("scene").agg(F.countDistinct("block").alias("n")).where("n > 1").isEmpty()


def test_logs_of_many_scenes_share_files(spark, tmp_path):
    """Files do not follow the number of logs, and every log keeps its own order over several read tasks."""
    rows = spark.range(3000).select(F.concat(F.lit("/l/s"), (F.col("id") % 300).cast("string"), F.lit("/poses.txt")).alias("path"), "id",
                                    F.when(F.col("id") == 299, "").otherwise(F.concat(F.lit("1 0 0 "), F.col("id").cast("string"), F.lit(" 0 1 0 0 0 0 1\t0"))).alias("value"))
    root = str(tmp_path / "logs")
    W.write_tagged_lines(rows, root, [F.col("id").desc()])
    assert len(list((tmp_path / "logs").glob("*.txt"))) <= 4
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        lines = G.read_tagged_lines(spark, root)
        assert lines.rdd.getNumPartitions() > 8
        got = {(r.scene, r.pos): int(r.t_c2w[3]) for r in G.parse_pose_log(lines).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    want = {(f"s{s}", k): i for s in range(300) for k, i in enumerate(i for i in range(2999, -1, -1) if i % 300 == s and i != 299)}
    assert got == want

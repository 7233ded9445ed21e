"""Scans and sinks on files the tests write themselves."""

import pytest
from pyspark.sql import functions as F

from driftgauge import schemas
from driftgauge.sources import readers, writers


def test_sample_bundles_prune_partitions(spark, tmp_path):
    rows = [("d", b, 42, s, i, "g", 0, [1.0], [2.0]) for i, (b, s) in enumerate([("x", "train"), ("x", "ood"), ("y", "ood")])]
    df = spark.createDataFrame(rows, schemas.SAMPLES.replace(" string, seed int", " string, seed int"))
    path = str(tmp_path / "samples")
    writers.write_samples(df, path)
    got = readers.read_samples(spark, path, ["sample_id", "feats"], backbone="x", split="ood")
    assert [r.sample_id for r in got.collect()] == [1]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "backbone" in plan.split("PartitionFilters")[1][:200]
    assert "logits" not in plan.split("ReadSchema")[1]
    # rewriting one cell leaves the others alone
    writers.write_samples(df.where("backbone = 'y'").withColumn("sample_id", F.lit(99).cast("bigint")), path)
    assert sorted(r.sample_id for r in readers.read_samples(spark, path).collect()) == [0, 1, 99]


def test_csv_schema_mismatch_stops(spark, tmp_path):
    (tmp_path / "log.csv").write_text("backbone,seed,epoch,id_val_acc,msp_auroc\nx,42,notanumber,0.5,0.5\n")
    with pytest.raises(Exception):
        readers.read_csv(spark, str(tmp_path / "log.csv"), schemas.EPOCH_LOG).collect()
    with pytest.raises(Exception):
        readers.read_csv(spark, str(tmp_path / "absent.csv"), schemas.EPOCH_LOG).collect()


def test_score_table_scan_keys_from_paths(spark, tmp_path):
    head = "Method,AUROC,FPR95,Threshold,AUROC_CI_low,AUROC_CI_high,FPR95_CI_low,FPR95_CI_high\n"
    for stem in ("resnet18", "vit_b_16", "efficientnet_v2_s_224", "resnet18_supcon"):
        (tmp_path / f"{stem}_score_comparison.csv").write_text(head + "MSP,0.5,0.9,0.1,,,,\n")
    got = readers.scan_score_tables(spark, str(tmp_path / "*_score_comparison.csv"), "d")
    assert sorted((r.backbone, r.method, r.auroc, r.ci_low) for r in got.collect()) == [("efficientnet_v2_s", "msp", 0.5, None), ("resnet18", "msp", 0.5, None)]


def test_image_list_and_missing_files(spark, tmp_path):
    (tmp_path / "list.txt").write_text("a/x.png 1\n\n  b/y.png 0 \n")
    rows = readers.read_image_list(spark, str(tmp_path / "list.txt")).collect()
    assert [(r.path, r.label) for r in rows] == [("a/x.png", 1), ("b/y.png", 0)]
    (tmp_path / "bad.txt").write_text("a/x.png one\n")
    with pytest.raises(Exception):
        readers.read_image_list(spark, str(tmp_path / "bad.txt")).collect()
    img = tmp_path / "img"
    img.mkdir()
    (img / "x.png").write_bytes(b"1")
    expected = spark.createDataFrame([("a/x.png",), ("a/w.png",)], "path string")
    assert [r.path for r in readers.missing_files(expected, spark, str(img)).collect()] == ["a/w.png"]


def test_nested_annotations(spark, tmp_path):
    (tmp_path / "a.json").write_text(
        '{"images": [{"id": 1, "file_name": "a.tiff", "width": 100, "height": 80}],\n'
        ' "annotations": [{"id": 7, "image_id": 1, "category_id": 2, "bbox": [1, 2, 51, 52]}]}'
    )
    images, boxes = readers.read_annotations(spark, str(tmp_path / "a.json"))
    r = boxes.join(images, "image_id").first()
    assert (r.ann_id, r.x0, r.y1, r.file_name, r.width) == (7, 1, 52, "a.tiff", 100)


def test_train_meta_left_join(spark, tmp_path):
    (tmp_path / "m0_train_meta.json").write_text('{"best_id_val_acc": 0.97}')
    meta = readers.read_train_meta(spark, str(tmp_path / "*_train_meta.json"))
    names = spark.createDataFrame([("m0",), ("m1",)], "backbone string")
    assert {r.backbone: r.id_acc for r in names.join(meta, "backbone", "left").collect()} == {"m0": 0.97, "m1": None}


def test_severity_slice(spark):
    stack = spark.range(0, 30).toDF("idx")
    assert sorted(r.idx for r in readers.severity_slice(stack, "idx", 2, 10).collect()) == list(range(10, 20))
    with pytest.raises(ValueError, match="expected 10 rows"):
        readers.severity_slice(stack.where("idx < 25"), "idx", 3, 10)


def test_write_once(spark, tmp_path):
    path = str(tmp_path / "t")
    calls = []

    def build(n):
        calls.append(n)
        return spark.range(n)

    assert writers.once(spark, path, lambda: build(3)).count() == 3
    assert writers.once(spark, path, lambda: build(5)).count() == 3
    assert calls == [3]


def test_scores_accept_streams(spark, tmp_path):
    from driftgauge.functions.scores import msp

    path = str(tmp_path / "s")
    spark.createDataFrame([(1, [0.0, 0.0])], "sample_id bigint, logits array<double>").write.parquet(path)
    stream = spark.readStream.schema("sample_id bigint, logits array<double>").parquet(path)
    assert stream.select("sample_id", msp(F.col("logits")).alias("score")).isStreaming


def test_write_once_after_a_crash(spark, tmp_path):
    path = str(tmp_path / "once")
    spark.range(4).write.parquet(path)
    (tmp_path / "once" / "_SUCCESS").unlink()  # what a crashed first build leaves behind
    assert writers.once(spark, path, lambda: spark.range(7).select("id")).count() == 7
    assert writers.once(spark, path, lambda: spark.range(9).select("id")).count() == 7

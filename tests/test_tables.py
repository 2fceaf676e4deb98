import pytest
from conftest import rows
from pyspark.sql import functions as F

from unimass.functions import columns as col
from unimass.operators import curves as cu
from unimass.operators import roi as ro
from unimass.operators import rules as ru
from unimass.session import stage_root
from unimass.sources import listings as ls
from unimass.sources import scans as sn


def members(spark, data):
    return spark.createDataFrame([("s", v, r) for v, r in data], "subject string, voxel_id int, roi string")


def test_roi_algebra(spark):
    m = members(spark, [(1, "FFA"), (2, "FFA"), (2, "FBA"), (3, "FBA"), (4, "PPA"), (4, "FFA"), (4, "FBA")])
    labels = spark.createDataFrame([("s", 9, "face")], "subject string, voxel_id int, label string")
    assert rows(ro.roi_exclusive(m, labels=labels), "voxel_id", "roi") == [
        (1, "FFA"), (2, "FFA&FBA"), (3, "FBA"), (4, "FFA&FBA"), (9, "face")]
    assert rows(ro.roi_combinations(m), "voxel_id", "comb")[3] == (4, "FBA&FFA&PPA")
    assert rows(ro.absent_rois(m, ["FFA", "OFA"]), "roi") == [("OFA",)]


def test_atlas_labels_and_narrowing(spark):
    atlas = spark.createDataFrame([("s", 1, "floc-faces_t2", 2), ("s", 2, "floc-faces_t2", 3), ("s", 3, "floc-faces_t2", 9)],
                                  "subject string, voxel_id int, atlas string, value int")
    labels = spark.createDataFrame([("floc-faces_t2", "FFA-1", 2), ("floc-faces_t2", "FFA-2", 3)],
                                   "atlas string, label string, value int")
    got = ro.define_rois(atlas, labels)
    assert rows(got, "voxel_id", "roi") == [(1, "FFA"), (2, "FFA")]
    t = spark.createDataFrame([("s", 1, "FFA", 2.0), ("s", 2, "FFA", float("nan"))],
                              "subject string, voxel_id int, roi string, t double")
    assert ro.narrow_rois(got, t).count() == 0
    assert rows(ro.narrow_counts(got, t.withColumn("t", F.col("t") + 1)), "n_before", "n_after") == [(2, 1)]


def test_streams_and_seeds(spark):
    vox = spark.createDataFrame([("s", v, v % 3, 0.1 * v, 0.5) for v in range(6)],
                                "subject string, voxel_id int, stream_value int, nc double, ncsnr double")
    labels = spark.createDataFrame([("early", 1), ("ventral", 2)], "label string, value int")
    on = ro.stream_mask(vox, labels, ("early", "ventral"))
    assert on.count() == 4
    assert ro.stream_mask(vox, labels, ("early",), 0.2).count() == 1
    with pytest.raises(ValueError):
        ro.stream_mask(vox, labels, ("early", "nowhere"))
    fit = ro.fit_voxels(on, members(spark, [(0, "PPA"), (1, "PPA"), (3, "FFA")]), vox, order=("early", "ventral"))
    assert rows(fit, "voxel_id", "stream_id") == [(0, -1), (1, 0), (2, 1), (4, 0), (5, 1)]
    with pytest.raises(ValueError):
        ro.require_seeds(ro.ventral_mask(on, members(spark, [(0, "V1")])))


def test_images_of_a_subject(spark):
    info = spark.createDataFrame([("a", 1, 0, 5), ("a", 1, 1, 6), ("a", 1, 2, 7), ("a", 2, 0, 1), ("a", 2, 1, 2), ("a", 2, 2, 99),
                                  ("b", 1, 0, 1), ("b", 1, 1, 2), ("b", 1, 2, 3)], "subject string, image_id int, rep int, trial int")
    limit = spark.createDataFrame([("a", 10), ("b", 10)], "subject string, n_trials int")
    got = ro.subject_images(info, limit)
    assert rows(got) == [("a", 1, [4, 5, 6]), ("b", 1, [0, 1, 2])]
    shared = ro.shared_images(got, 2, info)
    assert rows(shared) == [(1,)]
    assert all(r["shared"] for r in ro.flag_shared(got, shared).collect())


def test_localizer_labels(spark):
    z = {1: (6, 0, 0, 6, 6), 2: (0, 6, 0, -6, 6), 3: (6, 6, 0, 0, 6), 4: (0, 0, 0, 0, 6), 5: (6, 0, 6, 0, 6), 6: (9, 9, 9, 9, 9)}
    names = ("face>object", "body>object", "place>object", "face>body", "visual>baseline")
    maps = spark.createDataFrame([("s", v, n, float(x)) for v, xs in z.items() for n, x in zip(names, xs)],
                                 "subject string, voxel_id int, contrast string, z double")
    p = ru.contrast_pvalues(maps, maps.filter("voxel_id < 6"))
    assert p.filter("voxel_id = 6 AND p < 1").count() == 0
    got = {r["voxel_id"]: next(c for c in ("face", "body", "mixed", "non", "other") if r[c])
           for r in ru.localize_voxels(p).collect()}
    assert got == {1: "face", 2: "body", 3: "mixed", 4: "non", 5: "other"}
    assert {r["contrast"]: r["cutoff"] < 1e-6 for r in ru.raw_cutoffs(p).collect()} == {
        "face>object": True, "body>object": True}


def test_events(spark, tmp_path):
    (tmp_path / "e.tsv").write_text("onset\tduration\ttrial_type\n4\t1\tscene\n0\t1\t Adult \n2\t1\tblank\n")
    got = sn.scan_events(spark, str(tmp_path / "e.tsv")).collect()
    assert [(r["onset"], r["trial_type"]) for r in got] == [(0.0, "faces"), (4.0, "places")]
    for name in ("sub-01/func/sub-01_task-x_run-1_events.tsv", "sub-02/run-12.tsv"):
        (tmp_path / "bids" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "bids" / name).write_text("onset\tduration\ttrial_type\n1\t1\tadult\n")
    placed = sn.scan_events(spark, str(tmp_path / "bids"))
    assert rows(placed, "subject", "run") == [("subj01", 1), ("subj02", 12)]
    bad = spark.createDataFrame([(0.0, 1.0, "foo")], "onset double, duration double, category string")
    with pytest.raises(ValueError, match="foo"):
        sn.canonical_events(bad)
    with pytest.raises(ValueError):
        sn.canonical_events(bad.drop("category"))


def test_label_files_and_upsert(spark, tmp_path):
    (tmp_path / "v.csv").write_text("subject,voxel_id,face,FFA\ns,0,1,0\ns,1,0,1\n")
    got = sn.scan_voxel_labels(spark, str(tmp_path / "v.csv"))
    assert rows(got, "voxel_id", "label") == [(0, "face"), (1, "FFA")]
    with pytest.raises(ValueError):
        sn.scan_voxel_labels(spark, str(tmp_path / "v.csv"), columns=["body"])
    brain = spark.createDataFrame([("s", 0), ("s", 1), ("t", 0)], "subject string, voxel_id bigint")
    path = str(tmp_path / "labels")
    sn.upsert_voxel_labels(got, path, brain, ["s"])
    sn.upsert_voxel_labels(spark.createDataFrame([("t", 0, "face")], got.schema), path, brain, ["t"])
    sn.upsert_voxel_labels(spark.createDataFrame([("s", 1, "face")], got.schema), path, brain, ["s"])
    assert rows(sn.read_voxel_labels(spark, path), "subject", "voxel_id", "label") == [
        ("s", 1, "FFA"), ("s", 1, "face"), ("t", 0, "face")]
    with pytest.raises(ValueError):
        sn.upsert_voxel_labels(spark.createDataFrame([("s", 7, "face")], got.schema), path, brain, ["s"])
    sn.upsert_voxel_labels(got.limit(0), path, brain, ["s"], ["face"])  # no voxel carries it any more
    assert rows(sn.read_voxel_labels(spark, path), "subject", "voxel_id", "label") == [
        ("s", 1, "FFA"), ("t", 0, "face")]
    halves = spark.createDataFrame([("s", 0, "face"), ("t", 0, "body")], got.schema)
    with pytest.raises(ValueError, match="body"):  # one subject having it is not enough
        sn.select_labels(halves, ["face", "body"], strict=True)
    both = spark.createDataFrame([("s", 0, "face"), ("s", 0, "responsive"), ("s", 1, "face")], got.schema)
    assert rows(sn.select_labels(both, ["face"], responsive=True), "voxel_id") == [(0,)]
    with pytest.raises(ValueError):
        sn.select_labels(both, ["body"], strict=True)
    assert sn.any_label(both, ["face", "nothing"]).count() == 2


def test_scratch_tables_end_with_their_scope(spark, tmp_path):
    import os

    from unimass import session

    kept = session.stage_path(spark, "kept")
    with pytest.raises(RuntimeError):
        with session.scratch(spark):
            inner = session.materialize(spark.range(3), "inner")
            where = inner.inputFiles()[0].removeprefix("file://")
            inner.write.parquet(kept)
            assert os.path.exists(where)
            raise RuntimeError
    assert not os.path.exists(where) and spark.read.parquet(kept).count() == 3
    outer = session.materialize(spark.range(2), "outer")
    assert "scratch" not in outer.inputFiles()[0] and outer.count() == 2


def test_a_table_changes_in_one_step(spark, tmp_path, monkeypatch):
    from unimass.sources import publish

    path = str(tmp_path / "table")
    schema = "subject string, label string, x long"
    of = lambda *r: spark.createDataFrame(list(r), schema)
    full = lambda: {tuple(r) for r in publish.published(spark, path, ["subject", "label"]).select("subject", "label", "x").collect()}
    with pytest.raises(ValueError):
        full()
    publish.replace(of(("01", "a", 1), ("02", "a", 2), (None, "b", 3)), path, ["subject", "label"])
    old = [("01", "a", 1), ("02", "a", 2)]
    assert full() == {*old, (None, "b", 3)}

    def broken(*args):
        raise OSError("lost between the write and the switch")

    kept = publish.switch
    monkeypatch.setattr(publish, "switch", broken)
    with pytest.raises(OSError):
        publish.replace(of(("01", "a", 9), ("03", "c", 9)), path, ["subject", "label"], [("02", "a")])
    assert full() == {*old, (None, "b", 3)}  # the old table, whole
    monkeypatch.setattr(publish, "switch", kept)
    number, now, live = publish.manifest(spark, path)
    publish.replace(of(("01", "a", 9), ("03", "c", 9)), path, ["subject", "label"], [("02", "a")])
    assert full() == {("01", "a", 9), ("03", "c", 9), (None, "b", 3)}
    with pytest.raises(Exception, match="(?i)exist"):  # a second writer from the same manifest
        publish.switch(spark, path, number + 1, now, live)
    assert full() == {("01", "a", 9), ("03", "c", 9), (None, "b", 3)}
    publish.vacuum(spark, path)
    assert full() == {("01", "a", 9), ("03", "c", 9), (None, "b", 3)}
    assert len(list((tmp_path / "table" / "data").iterdir())) == 2
    publish.replace(of().limit(0), path, ["subject", "label"], [("03", "c")])
    assert full() == {("01", "a", 9), (None, "b", 3)}


def test_encoding_partitions(spark, tmp_path):
    path = str(tmp_path / "enc")
    enc = spark.createDataFrame([("m", "l", s, 0, "f", 1.0) for s in "ab"],
                                "model string, layer string, subject string, voxel_id int, measure string, value double")
    sn.write_encoding(enc, path)
    sn.write_encoding(enc.filter("subject = 'a'").withColumn("value", F.lit(2.0)), path)
    back = sn.read_encoding(spark, path, "m", "l")
    assert rows(back, "subject", "value") == [("a", 2.0), ("b", 1.0)]
    assert sn.available_subjects(back).count() == 2
    with pytest.raises(ValueError):
        sn.read_encoding(spark, path, "other")
    wanted = spark.createDataFrame([("a", "l"), ("a", "x")], "subject string, layer string")
    assert rows(sn.check_layers(wanted, back)) == [("a", "x")]
    assert rows(sn.layers_to_recompute(wanted, back)) == [("l",), ("x",)]
    with pytest.raises(KeyError):
        sn.require_layers(wanted, back)
    plain = str(tmp_path / "plain")
    sn.write_result(enc, plain, ("model", "layer", "subject"))
    plan = sn.scan_table(spark, plain, ("voxel_id", "value"), subject="a")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(subject" in plan and "ReadSchema: struct<voxel_id:int,value:double>" in plan


def test_metadata_files(spark, tmp_path):
    (tmp_path / "img.csv").write_text(
        'subject,image_id,trial_ids,categories\ns,7,"[1, 2, 3]","[\'person\', \'dog\']"\n')
    assert rows(sn.scan_image_meta(spark, str(tmp_path / "img.csv"))) == [("s", 7, [1, 2, 3], ["person", "dog"])]
    (tmp_path / "stim.csv").write_text("image_id,subject1_rep0,subject1_rep1,subject2_rep0\n5,10,11,12\n")
    assert rows(sn.scan_stim_info(spark, str(tmp_path / "stim.csv"))) == [
        ("subj01", 5, 0, 10), ("subj01", 5, 1, 11), ("subj02", 5, 0, 12)]


def test_voxel_grid(spark):
    mask = spark.createDataFrame([("s", 5), ("s", 0), ("s", 23)], "subject string, flat bigint")
    got = sn.scan_voxels(mask, (2, 3, 4), [[2, 0, 0, -1], [0, 2, 0, 0], [0, 0, 2, 0]])
    assert rows(got, "voxel_id", "i", "j", "k", "x") == [(0, 0, 0, 0, -1.0), (1, 0, 1, 1, -1.0), (2, 1, 2, 3, 1.0)]


def test_responses_of_a_subset(spark):
    resp = spark.createDataFrame([("s", 1, b, [b * 10 + p for p in range(4)]) for b in range(3)],
                                 "subject string, image_id int, voxel_block int, resp array<int>")
    want = spark.createDataFrame([("s", 1), ("s", 9)], "subject string, voxel_id bigint")
    assert rows(sn.scan_responses(resp, want, 4, 10.0), "voxel_id", "resp") == [(1, 0.1), (9, 2.1)]


def test_images_on_disk(spark, tmp_path):
    for name in ("b/2.png", "b/1.png", "a/1.png", "c/9.png"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    images = ls.list_images(spark, str(tmp_path)).cache()
    assert rows(images, "category", "category_idx") == [("a", 0), ("b", 1), ("b", 1), ("c", 2)]
    picked = ls.filter_classes(images, ["c", "a", "c"])
    assert rows(picked, "category", "category_idx") == [("a", 1), ("c", 0)]
    with pytest.raises(ValueError):
        ls.filter_classes(images, ["dog"])
    assert ls.filter_first_n_classes(images, 2).count() == 3
    assert ls.limit_per_class(images, 1).filter("category = 'b'").first()["path"].endswith("1.png")
    names = spark.createDataFrame([("b", "x/2.png", 0), ("b", "1.png", 1), ("a", "none.png", 0)],
                                  "category string, name string, ordinal int")
    assert ls.filter_whitelist(images, names).count() == 2
    assert ls.filter_whitelist(images, names, per_class=1).first()["path"].endswith("2.png")
    with pytest.raises(ValueError):
        ls.filter_whitelist(images, names, strict=True)


def test_models_and_diets(spark):
    dims = ls.dim_models(spark)
    assert dims.select("model").distinct().count() == 12
    assert dims.filter("model = 'vgg16_ecoset' AND layer_ord = 13").first()["layer"] == "fc14"
    diets = ls.dim_diets(spark)
    assert rows(diets.filter("diet = 'VGGFace2'").select("model").distinct()) == [
        ("alexnet_faces",), ("resnet50_vggface2",), ("vgg16_faces",)]
    assert cu.match_diets(diets, "ImageNet").count() == 0
    broken = diets.filter("NOT (diet = 'Ecoset' AND position = 1 AND layer_ord = 3)")
    assert rows(cu.match_diets(broken), "position", "layer_ord") == [(1, 3)]
    with pytest.raises(ValueError):
        cu.match_diets(diets, "nothing")


def test_column_functions(spark):
    df = spark.createDataFrame([(1.0, "alexnet-barlow-twins_ecoset"), (0.0, "resnet50_imagenet-face-obfus")], "v double, m string")
    got = df.select(col.noise_ceiling(F.col("v")).alias("nc"), *col.parse_model_name(F.col("m"))).collect()
    assert (got[0]["nc"], got[0]["arch"], got[0]["diet"]) == (0.75, "alexnet-barlow-twins", "ecoset")
    assert rows(df.select(*col.parse_model_name(F.lit("a_b_c"), last=True)))[0] == ("a_b", "c")
    q = spark.createDataFrame([(-1.9 / 300,), (1e6,), (0.5,)], "v double").select(col.quantize(F.col("v")).alias("q"))
    assert [r["q"] for r in q.collect()] == [-1, 32767, 150]
    one = df.select(col.contrast_file_key(F.lit("face>object")), col.subject_name(F.lit(3)),
                    col.clip_scale(F.lit(None).cast("double"), F.lit(0.0), F.lit(1.0))).first()
    assert tuple(one) == ("face_gt_object", "subj03", 0.0)


def test_stage_folder_comes_from_the_session(spark, tmp_path, monkeypatch):
    from unimass import session

    # the real setting is fixed when a session starts
    monkeypatch.setattr(session, "CHECKPOINT_CONF", "unimass.test.dir")
    spark.conf.set("unimass.test.dir", str(tmp_path) + "/")
    assert session.stage_root(spark) == f"{tmp_path}/{spark.sparkContext.applicationId}"
    assert session.materialize(spark.range(3), "t").count() == 3
    assert any(p.name.startswith("t-") for p in tmp_path.glob("*/*"))
    spark.conf.unset("unimass.test.dir")


def test_block_map_has_every_voxel_of_every_layer(spark):
    from unimass.operators import scores as sc

    enc = spark.createDataFrame([("m", "l1", "s", 0, "f", 0.2), ("m", "l2", "s", 1, "f", 0.4)],
                                "model string, layer string, subject string, voxel_id int, measure string, value double")
    brain = spark.createDataFrame([("s", v, 1.0) for v in range(3)] + [("t", 0, 1.0)],
                                  "subject string, voxel_id int, nc double")
    got = {(r["layer"], r["voxel_id"]): r["value"] for r in sc.block_map(enc, brain, ("f",)).collect()}
    assert got == {("l1", 0): 0.2, ("l1", 1): None, ("l1", 2): None,
                   ("l2", 0): None, ("l2", 1): 0.4, ("l2", 2): None}
    thresholds = spark.createDataFrame([("t", 0.1)], "subject string, threshold double")
    with pytest.raises(ValueError, match="'s'"):
        sc.require_tested(enc, thresholds)


def test_many_small_files_are_written_in_place_and_listed_once(spark, tmp_path):
    files = spark.createDataFrame([(f"{c}/{i}.txt", [c, str(i)]) for c in ("a#1", "b") for i in range(30)], "path string, lines array<string>")
    ls.write_files(files, f"file://{tmp_path}/new")
    ls.write_files(files.limit(5), f"file://{tmp_path}/new")  # a repeated task changes nothing
    assert sorted(p.name for p in (tmp_path / "new").iterdir()) == ["a#1", "b"]
    assert (tmp_path / "new/a#1/7.txt").read_text() == "a#1\n7\n"
    images = ls.list_images(spark, f"{tmp_path}/new")
    assert images.count() == 60
    assert "binaryFile" not in images._jdf.queryExecution().executedPlan().toString()

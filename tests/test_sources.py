import gzip
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.operators import recordings
from seqloom.sources import images, tables


def test_separated_values_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("1.0", "a b"), ("n/a", 'say "x"')], "onset string, letter string")
    tables.write_separated(df.coalesce(1), str(tmp_path / "x"))
    back = tables.read_separated(spark, str(tmp_path / "x"))
    assert back.columns == ["onset", "letter"] and back.count() == 2
    assert tables.read_separated(spark, str(tmp_path / "x"), null_value="n/a").where("onset IS NULL").count() == 1
    lines = spark.createDataFrame([("1\tx",), ("2\ty",)], "value string")
    assert [tuple(r) for r in tables.rows_of_lines(lines, ["k", "v"]).collect()] == [("1", "x"), ("2", "y")]


def test_text_and_json(spark, tmp_path):
    tables.write_text(spark.createDataFrame([("one",), ("two",)], "value string").coalesce(1), str(tmp_path / "t"))
    assert [r.value for r in tables.read_lines(spark, str(tmp_path / "t")).orderBy("line_no").collect()][:2] == ["one", "two"]
    tables.write_json(spark.createDataFrame([(1, "x")], "a int, b string").coalesce(1), str(tmp_path / "j"))
    assert tuple(tables.read_json(spark, str(tmp_path / "j")).first()) == (1, "x")
    tables.write_json(spark.createDataFrame([(1, "x")], "a int, b string").coalesce(1), str(tmp_path / "p"), pretty=True)
    assert len(tables.read_lines(spark, str(tmp_path / "p")).where("trim(value) <> ''").collect()) == 4  # braces and two fields
    assert tuple(tables.read_json(spark, str(tmp_path / "p")).first()) == (1, "x")


def test_names_of_recordings(spark):
    p = "/d/derivatives/prep/sub-01/ses-2/func/sub-01_ses-2_task-spell_run-3_space-MNI_desc-preproc_bold.nii.gz"
    row = spark.createDataFrame([(p,), ("plain.nii",)], "path string").select("path", *tables.recording_fields("path")).collect()
    assert (row[0]["sub"], row[0].ses, row[0].task, row[0].run, row[0].space) == ("01", "2", "spell", "3", "MNI")
    assert row[0].mask_path.endswith("_space-MNI_desc-brain_mask.nii.gz") and row[0].confounds_path.endswith("_run-3_desc-confounds_timeseries.tsv")
    assert row[0].derivatives_path == "/d/derivatives" and row[1]["sub"] is None
    rows = spark.createDataFrame([(1, "a", "b"), (2, "c", "d")], "k int, p string, q string")
    listing = spark.createDataFrame([("b",), ("c",), ("d",)], "path string")
    assert {r.k: r.found for r in tables.first_existing(rows, ["p", "q"], listing).collect()} == {1: "b", 2: "c"}


def _image(values, order="<"):
    head = bytearray(352)
    struct.pack_into(order + "i", head, 0, 348)
    struct.pack_into(order + "8h", head, 40, 4, *values.shape, 1, 1, 1)
    struct.pack_into(order + "h", head, 70, 16)
    struct.pack_into(order + "8f", head, 76, 1, 2.0, 2.5, 3.0, 1.5, 0, 0, 0)
    struct.pack_into(order + "3f", head, 108, 352, 2.0, 1.0)
    return bytes(head) + values.astype(order + "f4").tobytes(order="F")


def test_images(spark, tmp_path):
    values = np.random.default_rng(0).normal(size=(3, 4, 2, 5)).astype("f4")
    (tmp_path / "a.nii").write_bytes(_image(values))
    (tmp_path / "b.nii.gz").write_bytes(gzip.compress(_image(values, ">")))
    head = images.read_headers(spark, str(tmp_path)).collect()
    assert {tuple(h)[1:5] for h in head} == {(3, 4, 2, 5)} and head[0].frame_s == 1.5 and head[0].dz == 3.0
    cells = images.read_images(spark, str(tmp_path))
    assert cells.count() == 2 * values.size
    for r in cells.where("frame = 3").collect():
        assert np.isclose(r.value, values[r.x, r.y, r.z, 3] * 2 + 1)


def test_features_and_labels(spark, tmp_path):
    df = spark.createDataFrame([(1, [[1.0, 2.0], [3.0, 4.0]])], "utterance_id int, frames array<array<double>>")
    raw = bytes(images.feature_bytes(df, length_ms=100).first().content)
    assert struct.unpack(">IIHH", raw[:12]) == (2, 500, 8, 9)
    (tmp_path / "u.ext").write_bytes(raw)
    assert images.read_features(spark, str(tmp_path / "u.ext")).first().frames == [[1.0, 2.0], [3.0, 4.0]]
    labels = spark.createDataFrame([(1, 0, 0, 10, "a"), (1, 1, 10, 25, "l-b+r")], "utterance_id int, pos int, start int, end int, token string")
    text = images.label_text(labels)
    assert text.first().value == '"1.lab"\n0 100 a\n100 250 l-b+r\n.'
    lines = text.select(F.lit("p").alias("path"), F.posexplode(F.split("value", "\n")).alias("line_no", "value"))
    assert [r.token for r in images.read_label_tokens(lines).orderBy("pos").collect()] == ["a", "b"]


def test_from_image_files_to_features_and_labels(spark, tmp_path):
    r = np.random.default_rng(1)
    folder = tmp_path / "derivatives" / "prep"
    folder.mkdir(parents=True)
    values = {}
    for sub in ("01", "02"):
        values[sub] = r.uniform(5, 9, size=(3, 4, 2, 5)).astype("f4")
        (folder / f"sub-{sub}_ses-1_task-spell_run-2_space-MNI_desc-preproc_bold.nii.gz").write_bytes(gzip.compress(_image(values[sub])))
    cells = recordings.image_runs(spark, str(folder))
    assert {tuple(x) for x in cells.select("run_id", "sub").distinct().collect()} == {("01_1_spell_2", "01"), ("02_1_spell_2", "02")}
    roi = spark.createDataFrame([(s, 0, x, 0, 0) for s in values for x in (0, 1)], "sub string, region_idx int, x int, y int, z int")
    rest = spark.createDataFrame([(s, 0, 2, 3, 1) for s in values], "sub string, region_idx int, x int, y int, z int")
    rows = [(f"{s}_1_spell_2", i, t, letter, float(i), 1.0) for s in values for i, (t, letter) in enumerate([("left", "a"), ("right", "b")])]
    rows.append(("elsewhere", 0, "left", "a", 0.0, 1.0))
    ev = spark.createDataFrame(rows, "run_id string, row_idx long, trial_type string, letter string, onset double, duration double")
    found = recordings.features_and_labels(cells, ev, roi, rest)
    got = {(x["sub"], x.frame): x.value for x in found.features.collect()}
    for sub, v in values.items():
        v = v.astype(float) * 2 + 1
        region, other = v[:2, 0, 0].mean(axis=0), v[2, 3, 1]
        want = (region - region[0]) / region[0] - (other - other[0]) / other[0]
        assert np.allclose([got[sub, f] for f in range(5)], want)
    labels = {(x.run_id, x.row_idx, x.region): x.bit for x in found.labels.collect()}
    assert len(labels) == 8 and labels["01_1_spell_2", 0, "left"] == 1 and labels["01_1_spell_2", 0, "right"] == 0
    with pytest.raises(KeyError):
        recordings.features_and_labels(cells, ev, roi.where("sub = '01'"), rest)

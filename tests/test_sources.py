"""Array files and recording folders: round trips against NumPy's own reader and writer."""

import io
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tremolo.sources import npy, recordings


def _saved(a):
    out = io.BytesIO()
    np.save(out, a)
    return out.getvalue()


@pytest.mark.parametrize("kind", ["i1", "u1", "<i2", ">i2", "<u4", ">u4", "<i8", ">i8", "<f4", ">f4", "<f8", ">f8", "?"])
@pytest.mark.parametrize("order", ["C", "F"])
def test_arrays_of_every_type_and_order(kind, order):
    for shape in ((0,), (7,), (7, 1), (3, 4), (2, 3, 4)):
        a = np.asarray(np.arange(np.prod(shape)).reshape(shape) % 100, dtype=kind, order=order)
        got = npy.parse_array(_saved(a))
        assert got.shape == a.shape and got.dtype == a.dtype and (got == a).all()
        back = np.load(io.BytesIO(npy.array_bytes(a)))
        assert back.dtype == a.dtype and back.shape == a.shape and (back == a).all()


def test_files_that_are_no_arrays():
    for content in (b"", b"hello world", _saved(np.arange(9))[:-8], _saved(np.array([(1, 2.0)], dtype="i4,f8")), _saved(np.array(["a"]))):
        with pytest.raises(ValueError):
            npy.parse_array(content)


@pytest.fixture(scope="module")
def folders(tmp_path_factory):
    root = tmp_path_factory.mktemp("rec")
    rng = np.random.default_rng(1)
    want = {}
    for name, rate in (("240101/P1/W1", "20000."), ("240102/P1/W2", "1e4")):
        d = root / name
        d.mkdir(parents=True)
        ticks, units = np.sort(rng.integers(0, 10**6, 50)), rng.integers(0, 3, 50)
        shapes = rng.normal(size=(3, 6, 4)).astype("f4")
        shapes[:, [0, 3], :] = 0
        np.save(d / "spike_times.npy", ticks.astype("u8")[:, None])
        np.save(d / "spike_templates.npy", units.astype(">i4"))
        np.save(d / "templates.npy", np.asfortranarray(shapes))
        np.save(d / "channel_positions.npy", np.arange(8.0).reshape(4, 2))
        (d / "params.py").write_text(f"dat_path = 'x'\nsample_rate = {rate}\nsample_other = 3\n")
        want[f"file:{d}"] = (ticks, units, shapes, float(rate))
    return root, want


def test_recording_folders(spark, folders):
    root, want = folders
    found = recordings.spikes(spark, f"{root}/*/*/*").collect()
    for rec, (ticks, units, _, rate) in want.items():
        own = sorted((r["tick"], r["unit"], r["seconds"]) for r in found if r["rec"] == rec)
        assert own == sorted((int(t), int(u) + 1, t / rate) for t, u in zip(ticks, units, strict=True))
    shapes = recordings.templates(spark, f"{root}/*/*/*").collect()
    for rec, (_, _, a, _) in want.items():
        kept = a[:, [1, 2, 4, 5], :]
        got = np.zeros_like(kept)
        for r in shapes:
            if r["rec"] == rec:
                got[r["unit"] - 1, r["i"], r["electrode"]] = r["v"]
        assert (got == kept).all()
    assert {(r["electrode"], r["x"], r["y"]) for r in recordings.positions(spark, f"{root}/*/*/*").collect()} == {(k, 2.0 * k, 2.0 * k + 1) for k in range(4)}
    heads = npy.read_headers(spark, f"{root}/*/*/*/templates.npy").collect()
    assert [(r["descr"], r["column_major"], r["shape"]) for r in heads] == [("<f4", True, [3, 6, 4])] * 2


def test_saved_recordings_and_metadata(spark, folders, tmp_path):
    root, want = folders
    rows = recordings.spikes(spark, f"{root}/*/*/*").withColumn("meta", recordings.path_metadata(F.col("rec"), {"date": -3, "plate": -2, "well": -1}, ("date",))).select("rec", "unit", "tick", "meta.*")
    assert {(r["date"], r["plate"], r["well"]) for r in rows.select("date", "plate", "well").distinct().collect()} == {("240101", "P1", "W1"), ("240102", "P1", "W2")}
    out = f"file:{tmp_path}/saved"
    first = sorted(want)[0]
    assert recordings.save_recordings(rows.where(F.col("rec") == first), out).count() == 1
    assert [r["rec"] for r in recordings.save_recordings(rows, out).collect()] == [sorted(want)[1]]
    assert recordings.load_recordings(spark, out, min_units=2).count() == 100
    assert recordings.load_recordings(spark, out, min_units=3).count() == 0
    with pytest.raises(Exception, match="no date"):
        spark.createDataFrame([("/a",)], "rec string").select(recordings.path_metadata(F.col("rec"), {"date": -3}, ("date",))).collect()


def test_tables_as_array_files_and_graph_files(spark, tmp_path):
    a = np.random.default_rng(2).normal(size=(5, 3))
    rows = [("m", i, j, 0, float(a[i, j])) for i in range(5) for j in range(3)]
    content = npy.to_arrays(spark.createDataFrame(rows, "name string, i long, j long, k long, value double")).first()["content"]
    assert (np.load(io.BytesIO(bytes(content))) == a).all()
    edges = spark.createDataFrame([(10, 30, 2.0), (30, 10, 2.0), (20, 20, 1.0)], "src long, dst long, w double")
    nodes = spark.createDataFrame([(30,), (10,), (20,)], "id long")
    recordings.write_pajek(edges, nodes, f"file:{tmp_path}/g")
    parts = sorted(p for p in os.listdir(tmp_path / "g") if p.startswith("part"))
    text = "".join((tmp_path / "g" / p).read_text() for p in parts).split("\n")[:-1]
    assert text == ["*vertices 3", '1 "10"', '2 "20"', '3 "30"', "*edges", "1 3 2.0", "2 2 1.0"]
    (tmp_path / "m.csv").write_text("x,y,label\n1,2.5,3\n,x,4\n")
    assert [tuple(r) for r in recordings.read_matrix(spark, f"file:{tmp_path}/m.csv", "label").collect()] == [(1.0, 2.5, 3), (None, None, 4)]

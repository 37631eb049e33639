import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigrid.operators import images
from lexigrid.sources import images as files


def test_on_white(spark):
    df = spark.createDataFrame([(200, 0), (200, 128), (200, 255), (0, 254), (255, 1)], "c int, a int")
    got = [r[0] for r in df.select(images.on_white(F.col("c"), F.col("a"))).collect()]
    assert got[:3] == [255, 227, 200]
    assert got == images.flatten_alpha(np.array([[c, c, c, a] for c, a in df.collect()], "u1"))[:, 0].tolist()


def test_rename_plan(spark):
    names = spark.createDataFrame([(n,) for n in ("1.png", ".png", "a.b.png", "x.PNG", "digit1.png", "y")], "name string")
    plan = {r["name"]: (r["target"], r["new_path"], r["collides"]) for r in images.rename_plan(names, "/d").collect()}
    assert plan == {
        "1.png": ("digit1.png", "/d/digit1.png", True),
        ".png": ("digit.png", "/d/digit.png", False),
        "a.b.png": ("digita.b.png", "/d/digita.b.png", False),
        "digit1.png": ("digitdigit1.png", "/d/digitdigit1.png", False),
    }


def test_renames_are_carried_out_or_refused(spark, tmp_path):
    for n in ("1.png", "2.png"):
        (tmp_path / n).write_text(n)
    names = spark.createDataFrame([("1.png",), ("2.png",)], "name string")
    assert files.apply_renames(images.rename_plan(names, str(tmp_path))) == 2
    assert sorted(p.name for p in tmp_path.iterdir()) == ["digit1.png", "digit2.png"]
    with pytest.raises(ValueError, match="collide"):
        files.apply_renames(images.rename_plan(spark.createDataFrame([("a.png",), ("digita.png",)], "name string"), str(tmp_path)))


def test_files_there_and_back(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(f"c{c}.png", ("", 3, 5, c, {1: 0, 3: 16, 4: 24}[c], bytearray(rng.integers(0, 256, 15 * c, "u1").tobytes()))) for c in (1, 3, 4)]
    made = spark.createDataFrame(rows, "name string, image struct<origin: string, height: int, width: int, nChannels: int, mode: int, data: binary>")
    folder = str(tmp_path / "out")
    for _ in range(2):  # overwrites
        assert files.write_images(made, folder).where("written").count() == 3
    (tmp_path / "out" / "broken.png").write_bytes(b"no image")
    (tmp_path / "out" / "other.PNG").write_bytes(b"not listed")
    assert {r["name"] for r in files.list_images(spark, folder).collect()} == {"c1.png", "c3.png", "c4.png", "broken.png"}
    read = files.read_images(spark, folder)
    assert images.unreadable(read).count() == 1
    back = {r["image"]["origin"].rpartition("/")[2]: r["image"] for r in read.collect()}
    for name, image in rows:
        assert back[name]["data"] == image[5] and back[name]["nChannels"] == image[3]
    whole = {r["image"]["origin"].rpartition("/")[2]: r["image"] for r in images.composite_images(read).collect()}
    want = images.flatten_alpha(np.frombuffer(bytes(rows[2][1][5]), "u1").reshape(-1, 4)).tobytes()
    assert bytes(whole["c4.png"]["data"]) == want and whole["c4.png"]["nChannels"] == 3
    assert whole["c1.png"] == back["c1.png"] and whole["broken.png"]["nChannels"] == -1


def test_what_cannot_be_decoded_is_not_written(spark, tmp_path):
    kind = "name string, image struct<origin: string, height: int, width: int, nChannels: int, mode: int, data: binary>"
    rows = [("a.png", ("", 1, 1, 4, 24, bytearray(b"\1\2\3\0"))), ("b.png", ("b", -1, -1, -1, -1, bytearray())), ("c.png", None), (None, ("", 1, 1, 1, 0, bytearray(b"x")))]
    whole = images.composite_images(spark.createDataFrame(rows, kind))
    assert {r["name"]: r["written"] for r in files.write_images(whole, str(tmp_path)).collect()} == {"a.png": True, "b.png": False, "c.png": False, None: False}
    back = files.read_images(spark, str(tmp_path)).collect()
    assert [bytes(r["image"]["data"]) for r in back] == [b"\xff\xff\xff"]


def test_key_columns_of_any_name(spark):
    pixels = spark.createDataFrame([(1, 2, 3, 200, 100, 50, 255)], "bg int, ra int, bgr int, b int, g int, r int, a int")
    assert images.composite_pixels(pixels).first().asDict() == {"bg": 1, "ra": 2, "bgr": 3, "b": 200, "g": 100, "r": 50}

import os.path

from pyspark.sql import functions as F

from lexigrid.functions import text


def test_extensions_are_pythons(spark):
    names = ["a.b.png", ".png", "..png", "x..png", "1.png", "x", "...", "", "a.", ".a.b", "dir.x"]
    stem, extension = text.stem_and_extension(F.col("n"))
    for row in spark.createDataFrame([(n,) for n in names], "n string").select("n", stem.alias("s"), extension.alias("e")).collect():
        assert (row["s"], row["e"]) == os.path.splitext(row["n"])


def test_tokenize(spark):
    df = spark.createDataFrame([("A b-c\n\\/ é9",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(text.tokenize(F.col("t"))).collect()] == [["a", "b", "c", "9"], [], []]
    assert df.select(text.tokenize(F.col("t"), unicode=True)).first()[0] == ["a", "b", "c", "é9"]


def test_markers_paths_and_decimals(spark):
    df = spark.createDataFrame([("[x.gif] a\nFRAME: menu\nb",)], "t string")
    row = df.select(text.strip_markers(F.col("t")), text.join_path("a", F.lit("b")), text.four_decimals(F.lit(0.5)), text.has_suffix(F.lit(".PNG"))).first()
    assert row[0].split() == ["a", "b"] and row[1:] == ("a/b", "0.5000", False)

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and very long texts, ties and repeated rows, extra columns whose names operators use themselves."""
    long = "Ein langes Wort folgt auf das andere. " * 20_000
    rows = [
        (1, None, "en", "a", None),
        (2, "", None, None, 0),
        (3, " \t ", "en", "a", 3),
        (4, "The same line, which is long enough.\nshort\n", "en", "a", 1),
        (5, "the same line, WHICH is long enough. \nother", "en", "b", 1),
        (6, "\tThe same line, which is long enough.", None, "b", 1),
        (6, "\tThe same line, which is long enough.", None, "b", 1),
        (None, "The same line, which is long enough.", "en", None, 1),
        (7, long, "de", "c", len(long)),
        (8, "12 34 !?", "en", "c", 8),
        (9, "Ünïcödé 漢字 \U0001f600 text \x00 here", "fr", "é", 5),
        (10, "-- . --", None, "", 7),
    ]
    clash = "n_lines int, n_dropped int, lang_pred string, score double, draws string, shard long, place long, target double, id long, h1 long, size long, source_size long, sequence_id long, fp long, component_id long, part long, `a.b` int"
    values = [(*r, 1, 2, "x", 0.5, "d", 1, 1, 1.0, 5, 6, 7, 8, 9, 10, 11, 12, 13) for r in rows]
    return spark.createDataFrame(values, f"{DOCS}, {clash}")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")

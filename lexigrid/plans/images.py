"""Queries on images. The tables have none: names follow from document ids, pixels from the components of embeddings."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import stem_and_extension
from ..operators import cnn, images
from ..session import shared_dir
from ..sources import images as files

FOLDER = "/Dataset"


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    number = F.col("doc_id").cast("string")
    ending = F.element_at(F.array(*map(F.lit, (".png", ".PNG", ".a.png", ""))), (F.col("doc_id") % 4 + 1).cast("int"))
    earlier = F.concat(F.lit("digitdoc"), (F.col("doc_id") - 3).cast("string"), F.lit(".png"))
    return ids.select(F.when(F.col("doc_id") % 10 == 3, earlier).when(F.col("doc_id") == 1, ".png").otherwise(F.concat(F.lit("doc"), number, ending)).alias("name"))


_NAMES = """names AS (SELECT CASE WHEN doc_id % 10 = 3 THEN 'digitdoc' || (doc_id - 3) || '.png' WHEN doc_id = 1 THEN '.png'
  ELSE 'doc' || doc_id || ['.png', '.PNG', '.a.png', ''][CAST(doc_id % 4 AS INTEGER) + 1] END AS name FROM documents)"""


def suffix_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.select_images(_names(spark, sf_dir))


SUFFIX_FILTER = f"WITH {_NAMES} SELECT name FROM names WHERE ends_with(name, '.png')"


def split_ext(spark: SparkSession, sf_dir: str) -> DataFrame:
    stem, extension = stem_and_extension(F.col("name"))
    return _names(spark, sf_dir).select("name", stem.alias("stem"), extension.alias("extension"))


_STEM = r"regexp_extract(name, '^(\.*[^.].*?)(\.[^.]*)?$', 1)"
_EXTENSION = r"regexp_extract(name, '^(\.*[^.].*?)(\.[^.]*)?$', 2)"
SPLIT_EXT = f"WITH {_NAMES} SELECT name, {_STEM} AS stem, {_EXTENSION} AS extension FROM names"


def rename_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.rename_plan(_names(spark, sf_dir), FOLDER)


RENAME_PLAN = f"""WITH {_NAMES}, plan AS (SELECT name, 'digit' || {_STEM} || {_EXTENSION} AS target FROM names WHERE ends_with(name, '.png'))
SELECT name, target, '{FOLDER}/' || name AS old_path, '{FOLDER}/' || target AS new_path,
  count(*) OVER (PARTITION BY target) > 1 OR target IN (SELECT name FROM names) AS collides FROM plan"""


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen pixels of four channels from each embedding."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    byte = [F.greatest(F.lit(0), F.least(F.lit(255), F.floor((F.element_at("embedding", (4 * F.col("pos") + k).cast("int")).cast("double") + 1) * 127.5).cast("int"))) for k in (1, 2, 3, 4)]
    return vectors.withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(15)))).select("vec_id", "pos", *[b.alias(c) for b, c in zip(byte, "bgra", strict=True)])


_BYTE = "CAST(greatest(0, least(255, floor((CAST(embedding[4 * pos + {k}] AS DOUBLE) + 1) * CAST(127.5 AS DOUBLE)))) AS INTEGER) AS {c}"
_PIXELS = f"""px AS (SELECT vec_id, CAST(pos AS INTEGER) AS pos, {", ".join(_BYTE.format(k=k, c=c) for k, c in enumerate("bgra", 1))} FROM embeddings, range(16) r(pos))"""


def alpha_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.composite_pixels(_pixels(spark, sf_dir))


_WHITE = "CAST(round_even({c} * (a / CAST(255 AS DOUBLE)) + CAST(255 AS DOUBLE) * (1 - a / CAST(255 AS DOUBLE)), 0) AS INTEGER) AS {c}"
ALPHA_COMPOSITE = f"WITH {_PIXELS} SELECT vec_id, pos, {', '.join(_WHITE.format(c=c) for c in 'bgr')} FROM px"


def _image_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pixels as 4x4 images of the image source's kind."""
    channels = F.transform(F.array_sort(F.collect_list(F.struct("pos", "b", "g", "r", "a"))), lambda p: F.concat(*[F.lpad(F.hex(p[c]), 2, "0") for c in "bgra"]))
    data = F.unhex(F.array_join(channels, ""))
    rows = _pixels(spark, sf_dir).groupBy("vec_id").agg(data.alias("data"))
    name = F.concat(F.lit("v"), F.col("vec_id").cast("string"), F.lit(".png"))
    image = F.struct(name.alias("origin"), F.lit(4).alias("height"), F.lit(4).alias("width"), F.lit(4).alias("nChannels"), F.lit(24).alias("mode"), F.col("data"))
    return rows.select(name.alias("name"), image.alias("image"))


def _hex_digest(data: DataFrame) -> DataFrame:
    return data.select("name", "image.nChannels", F.md5("image.data").alias("data_md5"))


def _mixed(images: DataFrame) -> DataFrame:
    """Some of them with three channels or one (the first bytes of the data), some as the image source gives what it cannot decode."""
    kind = F.substring("name", 2, 100).substr(F.lit(1), F.length("name") - 5).cast("bigint") % 5
    channels = F.when(kind == 1, 3).when(kind == 2, 1).when(kind == 3, -1).otherwise(4)
    size = F.when(channels > 0, 4).otherwise(-1)
    mode = F.when(kind == 1, 16).when(kind == 2, 0).when(kind == 3, -1).otherwise(24)
    data = F.substring(F.col("image.data"), F.lit(1), F.greatest(channels, F.lit(0)) * 16)
    return images.withColumn("image", F.struct("image.origin", size.alias("height"), size.alias("width"), channels.alias("nChannels"), mode.alias("mode"), data.alias("data")))


def image_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole images through the vectorised function; those without alpha, or that cannot be decoded, come out as they are."""
    return _hex_digest(images.composite_images(_mixed(_image_rows(spark, sf_dir))))


_IMAGE_SQL = """SELECT 'v' || vec_id || '.png' AS name, {n} AS "nChannels", md5(unhex(string_agg({hex}, '' ORDER BY pos))) AS data_md5 FROM ({px}) GROUP BY vec_id"""
_HEX = {n: " || ".join(f"printf('%02x', {c})" for c in "bgra"[:n]) for n in (3, 4)}
IMAGE_COMPOSITE = f"""WITH {_PIXELS}, white AS ({ALPHA_COMPOSITE}), whole AS (
  SELECT vec_id, string_agg({_HEX[4]}, '' ORDER BY pos) AS raw FROM px GROUP BY vec_id), put AS (
  SELECT vec_id, string_agg({_HEX[3]}, '' ORDER BY pos) AS flat FROM white GROUP BY vec_id)
SELECT 'v' || vec_id || '.png' AS name, CAST([3, 3, 1, -1, 3][CAST(vec_id % 5 AS INTEGER) + 1] AS INTEGER) AS "nChannels",
  md5(unhex(CASE vec_id % 5 WHEN 1 THEN raw[1:96] WHEN 2 THEN raw[1:32] WHEN 3 THEN '' ELSE flat END)) AS data_md5 FROM whole JOIN put USING (vec_id)"""


def _written(spark: SparkSession, sf_dir: str) -> str:
    """The images as PNG files in the shared folder."""
    folder = f"{shared_dir(spark)}/lexigrid/images-{uuid.uuid4().hex}"
    files.write_images(_image_rows(spark, sf_dir), folder).where("not written").count()
    return folder


def image_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.list_images(spark, _written(spark, sf_dir)).select("name")


IMAGE_LISTING = "SELECT 'v' || vec_id || '.png' AS name FROM embeddings"


def image_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written, listed, decoded with alpha."""
    decoded = files.read_images(spark, _written(spark, sf_dir))
    return _hex_digest(decoded.select(F.element_at(F.split("image.origin", "/"), -1).alias("name"), "image"))


IMAGE_DECODE = _IMAGE_SQL.format(n=4, hex=" || ".join(f"printf('%02x', {c})" for c in "bgra"), px=f"WITH {_PIXELS} SELECT * FROM px")


def _inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """28x28 pixels from the 64 components of an embedding, by a rule."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    value = F.transform(F.sequence(F.lit(0), F.lit(783)), lambda k: F.get(F.col("embedding"), k % 64).cast("double") * (k % 7 + 1) / F.lit(4.0))
    return vectors.select("vec_id", value.alias("pixels"))


def _maps(upto: str, channels: int):
    """A digest of each feature map: its sum, least and greatest value."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = cnn.layer(_inputs(spark, sf_dir), cnn.formula_weights(), upto)
        each = F.size("out") / channels
        rows = out.select("vec_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(channels - 1)), lambda c: F.slice("out", (c * each + 1).cast("int"), each.cast("int")))).alias("channel", "map"))
        total = F.aggregate("map", F.lit(0.0), lambda a, x: a + x)
        return rows.select("vec_id", "channel", (F.round(total, 4) + 0.0).alias("total"), (F.round(F.array_min("map"), 4) + 0.0).alias("least"), (F.round(F.array_max("map"), 4) + 0.0).alias("greatest"))

    return query


def _values(upto: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = cnn.layer(_inputs(spark, sf_dir), cnn.formula_weights(), upto)
        return out.select("vec_id", F.posexplode("out").alias("unit", "value")).select("vec_id", "unit", (F.round("value", 5) + 0.0).alias("value"))

    return query


def cnn_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = cnn.predict(_inputs(spark, sf_dir), cnn.formula_weights())
    return done.select("vec_id", F.col("digit").cast("int").alias("digit"), F.round(F.array_max("logp"), 5).alias("logp"))


def _step(k: str, factor: int, add: int, period: int, minus: int, over: float) -> str:
    return f"((({k}) * {factor} + {add}) % {period} - {minus}) / CAST({over} AS DOUBLE)"


def _norm(previous: str, new: str) -> str:
    mean, var, gamma, beta = _step("c", 1, 0, 5, 2, 10), f"(1 + {_step('c', 1, 0, 3, 0, 2)})", f"(1 + {_step('c', 1, 0, 3, 0, 10)})", _step("c", 1, 0, 4, 1, 10)
    return f"{new} AS (SELECT vec_id, c, y, x, (v - ({mean})) / sqrt({var} + CAST(1e-5 AS DOUBLE)) * {gamma} + ({beta}) AS v FROM {previous})"


def _pool(previous: str, new: str) -> str:
    return f"{new} AS (SELECT vec_id, c, y // 2 AS y, x // 2 AS x, max(v) AS v FROM {previous} GROUP BY ALL)"


def _relu(previous: str, new: str) -> str:
    return f"{new} AS (SELECT vec_id, c, y, x, greatest(v, 0) AS v FROM {previous})"


def _conv(image: str, channels: int, side: int, out: int, weights: str, bias: str, new: str) -> str:
    size, rows = channels * 25, channels * 5
    cut = f"flatten(list_transform(range({rows}), lambda i: p[(i // 5) * {side * side} + (y + i % 5) * {side} + x + 1 : (i // 5) * {side * side} + (y + i % 5) * {side} + x + 5]))"
    return f"""{new}_w AS (SELECT c, list_transform(range({size}), lambda i: {weights.format(k=f"c * {size} + i")}) AS w FROM range({out}) r(c)),
{new}_p AS (SELECT vec_id, y, x, {cut} AS patch FROM {image}, range({side - 4}) a(y), range({side - 4}) b(x)),
{new} AS (SELECT vec_id, c, y, x, list_dot_product(patch, w) + {bias} AS v FROM {new}_p, {new}_w)"""


def _weights(factor: int, add: int, period: int, minus: int, over: float) -> str:
    return f"(({{k}}) * {factor} + {add}) % {period} * CAST(1 AS DOUBLE) / {over} - CAST({minus} AS DOUBLE) / {over}"


_CTE = {
    "input": "input AS (SELECT vec_id, list_transform(range(784), lambda k: CAST(embedding[k % 64 + 1] AS DOUBLE) * (k % 7 + 1) / CAST(4 AS DOUBLE)) AS p FROM embeddings)",
    "conv1": _conv("input", 1, 28, 10, _weights(7, 3, 11, 5, 25), _step("c", 1, 0, 3, 1, 10), "conv1"),
    "bn1": _norm("conv1", "bn1"),
    "pool1": _pool("bn1", "pool1"),
    "relu1": _relu("pool1", "relu1"),
    "flat1": "flat1 AS (SELECT vec_id, list(v ORDER BY c, y, x) AS p FROM relu1 GROUP BY vec_id)",
    "conv2": _conv("flat1", 10, 12, 20, _weights(13, 5, 19, 9, 200), _step("c", 1, 0, 5, 2, 10), "conv2"),
    "bn2": _norm("conv2", "bn2"),
    "pool2": _pool("bn2", "pool2"),
    "relu2": _relu("pool2", "relu2"),
    "flat2": "flat2 AS (SELECT vec_id, list(v ORDER BY c, y, x) AS p FROM relu2 GROUP BY vec_id)",
    "fc1": f"""fc1 AS (SELECT vec_id, CAST(c AS INTEGER) AS unit, greatest(list_dot_product(p, list_transform(range(320), lambda i: {_weights(11, 7, 23, 11, 100).format(k="c * 320 + i")})) + {_step("c", 1, 0, 7, 3, 10)}, 0) AS value FROM flat2, range(50) r(c))""",
    "flat3": "flat3 AS (SELECT vec_id, list(value ORDER BY unit) AS p FROM fc1 GROUP BY vec_id)",
    "fc2": f"""fc2 AS (SELECT vec_id, CAST(c AS INTEGER) AS unit, list_dot_product(p, list_transform(range(50), lambda i: {_weights(5, 1, 13, 6, 20).format(k="c * 50 + i")})) + {_step("c", 1, 0, 4, 1, 10)} AS value FROM flat3, range(60) r(c))""",
    "log_softmax": "log_softmax AS (SELECT vec_id, unit, value - m - ln(sum(exp(value - m)) OVER (PARTITION BY vec_id)) AS value FROM (SELECT *, max(value) OVER (PARTITION BY vec_id) AS m FROM fc2))",
}


def _upto(name: str) -> str:
    names = list(_CTE)
    return "WITH " + ",\n".join(_CTE[n] for n in names[: names.index(name) + 1])


def _map_sql(name: str) -> str:
    return f"{_upto(name)} SELECT vec_id, CAST(c AS INTEGER) AS channel, round(sum(v), 4) + 0 AS total, round(min(v), 4) + 0 AS least, round(max(v), 4) + 0 AS greatest FROM {name} GROUP BY ALL"


def _value_sql(name: str) -> str:
    return f"{_upto(name)} SELECT vec_id, unit, round(value, 5) + 0 AS value FROM {name}"


FLATTEN = f"{_upto('flat2')} SELECT vec_id, CAST(k AS INTEGER) AS unit, round(p[k + 1], 5) + 0 AS value FROM flat2, range(320) r(k)"
CNN_PREDICT = f"{_upto('log_softmax')} SELECT vec_id, CAST(unit AS INTEGER) AS digit, round(value, 5) AS logp FROM log_softmax QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY value DESC, unit) = 1"

_MAPS = {"conv1": 10, "bn1": 10, "pool1": 10, "relu1": 10, "conv2": 20, "bn2": 20, "pool2": 20, "relu2": 20}

QUERIES = {
    "suffix_filter": suffix_filter,
    "split_ext": split_ext,
    "rename_plan": rename_plan,
    "alpha_composite": alpha_composite,
    "image_composite": image_composite,
    "image_listing": image_listing,
    "image_decode": image_decode,
    **{f"cnn_{name}": _maps(name, n) for name, n in _MAPS.items()},
    "cnn_flatten": _values("relu2"),
    "cnn_linear1": _values("fc1"),
    "cnn_linear2": _values("fc2"),
    "cnn_logsoftmax": _values("log_softmax"),
    "cnn_predict": cnn_predict,
}
ORACLE_SQL = {
    "suffix_filter": SUFFIX_FILTER,
    "split_ext": SPLIT_EXT,
    "rename_plan": RENAME_PLAN,
    "alpha_composite": ALPHA_COMPOSITE,
    "image_composite": IMAGE_COMPOSITE,
    "image_listing": IMAGE_LISTING,
    "image_decode": IMAGE_DECODE,
    **{f"cnn_{name}": _map_sql(name) for name in _MAPS},
    "cnn_flatten": FLATTEN,
    "cnn_linear1": _value_sql("fc1"),
    "cnn_linear2": _value_sql("fc2"),
    "cnn_logsoftmax": _value_sql("log_softmax"),
    "cnn_predict": CNN_PREDICT,
}

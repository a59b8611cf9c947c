"""Reading event catalogues and pixel samples."""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def read_events(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, name_glob: str | None = None,
    with_file: bool = False,
) -> DataFrame:
    """Event CSV with a header; every column is text unless a schema is given.

    ``name_glob`` restricts a folder to file names such as ``enriched_events_*.csv``;
    ``with_file`` adds the file name, whose order is the files' order.
    """
    reader = spark.read.option("header", True).option("multiLine", False)
    if name_glob:
        reader = reader.option("pathGlobFilter", name_glob)
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.csv(path)
    return df.withColumn("source_file", F.col("_metadata.file_name")) if with_file else df


def list_inputs(spark: SparkSession, path: str, name_glob: str = "enriched_events_*.csv") -> DataFrame:
    """Names and sizes of the matching files, in name order. Only the listing is read, no contents."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", name_glob).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), F.col("length").alias("bytes")).orderBy("file_name")


def read_many(spark: SparkSession, path: str, name_glob: str = "*.csv") -> DataFrame:
    """Union of CSV files whose columns differ.

    One line per file is read for its header; files sharing a header are then scanned together, so the number of scans is the
    number of distinct headers, not of files.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", name_glob).load(path).select("path").orderBy("path")
    groups: dict[str, list[str]] = {}
    for row in files.toLocalIterator():
        groups.setdefault(_first_line(spark, row["path"]), []).append(row["path"])
    if not groups:
        raise FileNotFoundError(f"no {name_glob} files in {path}")
    frames = [spark.read.option("header", True).csv(files) for files in groups.values()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def _first_line(spark: SparkSession, path: str) -> str:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).open(where)
    try:
        return jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8")).readLine() or ""
    finally:
        stream.close()


def parse_pixel_sample(df: DataFrame, geo: str = ".geo", drop: tuple[str, ...] = (".geo", "system:index")) -> DataFrame:
    """Longitude and latitude from the GeoJSON point column; index columns dropped."""
    point = F.from_json(F.col(f"`{geo}`"), "type STRING, coordinates ARRAY<DOUBLE>")
    return (
        df.withColumn("_point", point)
        .withColumns({"longitude": F.get("_point.coordinates", 0), "latitude": F.get("_point.coordinates", 1)})
        .drop("_point", *drop)
    )


def flatten_properties(df: DataFrame, properties: str = "properties", keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """Feature records to a flat table: kept columns and the fields of ``properties``."""
    fields = [f.name for f in df.schema[properties].dataType.fields if f.name not in keep]
    return df.select(*keep, *[F.col(f"{properties}.`{f}`") for f in fields])

"""Readers for the text formats the detector and its tools exchange.

All readers are plain ``spark.read`` scans plus column expressions.  Every text reader
takes an ``Observation``: the first action on the result fills it with ``n_lines``, the lines
read (without headers and blank lines where these are no data), and ``n_rejects``, those
that do not parse.  Point readers leave rejects out (``*_with_rejects`` returns them); the
others keep the row with NULL for what does not parse.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import label_to_sign
from ..session import checkpoint_dir

DEFAULT_HEADER_PREFIX = "x"


LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def _tree(spark: SparkSession, path, glob: str | None, recursive: bool) -> DataFrame:
    """Text files, listed by a few tasks a core.  Spark's default is a task for each directory (up to
    10,000), whose start takes longer than its listing."""
    before = spark.conf.get(LISTING)
    spark.conf.set(LISTING, str(min(int(before), 4 * spark.sparkContext.defaultParallelism)))
    try:
        return spark.read.text(path, pathGlobFilter=glob, recursiveFileLookup=recursive)
    finally:
        spark.conf.set(LISTING, before)


def _text(spark: SparkSession, path, num_partitions: int = 0) -> DataFrame:
    df = spark.read.text(path)
    return df.repartition(num_partitions) if num_partitions else df


MAX_BROADCAST_BLOCKS = 1_000_000  # rows of the block table that is broadcast


def _observed(df: DataFrame, bad: Column, observation: Observation | None) -> DataFrame:
    """Count lines and rejects while ``df`` is read."""
    if observation is None:
        return df
    return df.observe(observation, F.count(F.lit(1)).alias("n_lines"), F.count_if(F.coalesce(bad, F.lit(True))).alias("n_rejects"))


def _any_null(cols: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(c).isNull() for c in cols])


def parse_points(lines: DataFrame, dim: int, header_prefix: str | None = DEFAULT_HEADER_PREFIX,
                 sep: str = ",", names: list[str] | None = None,
                 observation: Observation | None = None) -> tuple[DataFrame, DataFrame]:
    """Lines of ``f1,f2,...`` text -> ``x1..xd`` doubles (extra tokens ignored).

    Every line starting with ``header_prefix`` is dropped, wherever it is
    (headers repeat once per written part file).  Returns ``(points, rejects)``:
    blank or short lines and unparsable numbers are rejects.
    """
    names = names or [f"x{i + 1}" for i in range(dim)]
    v = F.col("value")
    df = lines
    if header_prefix:
        df = df.filter(~v.startswith(header_prefix))
    tok = F.split(v, sep)
    parsed = df.select(v.alias("line"), *[F.trim(F.get(tok, i)).try_cast("double").alias(n)
                                          for i, n in enumerate(names)])
    bad = _any_null(names)
    return _observed(parsed, bad, observation).filter(~bad).drop("line"), parsed.filter(bad).select("line")


def read_points_csv(spark: SparkSession, path, dim: int, header_prefix: str | None = DEFAULT_HEADER_PREFIX,
                    num_partitions: int = 0, with_id: bool = False,
                    observation: Observation | None = None) -> DataFrame:
    """Headerless numeric CSV -> ``x1..xd`` (the first ``dim`` tokens of each line).

    ``with_id`` adds a unique ``point_id`` (``monotonically_increasing_id``),
    so exact duplicate rows remain separate points.
    """
    pts, _ = parse_points(_text(spark, path, num_partitions), dim, header_prefix, observation=observation)
    return pts.withColumn("point_id", F.monotonically_increasing_id()) if with_id else pts


def read_points_csv_with_rejects(spark: SparkSession, path, dim: int,
                                 header_prefix: str | None = DEFAULT_HEADER_PREFIX):
    return parse_points(_text(spark, path), dim, header_prefix)


def select_features(df: DataFrame, dim: int, features: list[str] | None = None) -> DataFrame:
    """Keep only the first ``dim`` feature columns (the scan reads only those)."""
    cols = features or df.columns
    return df.select(*cols[:dim])


def read_labeled_points(spark: SparkSession, path, dim: int, label_name: str = "label",
                        observation: Observation | None = None) -> DataFrame:
    """``f1..fd,label`` lines -> ``x1..xd`` and ``label`` +-1 (``noise`` is -1)."""
    v = F.col("value")
    tok = F.split(v, ",")
    df = spark.read.text(path).filter(F.length(F.trim(v)) > 0)
    df = df.select(*[F.get(tok, i).try_cast("double").alias(f"x{i + 1}") for i in range(dim)],
                   F.trim(F.get(tok, dim)).alias("_label"))
    df = _observed(df, _any_null([*[f"x{i + 1}" for i in range(dim)], "_label"]), observation)
    return df.withColumn(label_name, label_to_sign("_label")).drop("_label")


def read_predictions(spark: SparkSession, path, dim: int = 2, observation: Observation | None = None) -> DataFrame:
    """The 4-column comparison format: ``x, y, label, prediction`` (+-1 ints)."""
    v = F.col("value")
    tok = F.split(v, ",")
    df = spark.read.text(path).filter(F.length(F.trim(v)) > 0)
    df = df.select(*[F.get(tok, i).try_cast("double").alias(f"x{i + 1}") for i in range(dim)],
                   F.get(tok, dim).try_cast("int").alias("label"),
                   F.get(tok, dim + 1).try_cast("int").alias("prediction"))
    return _observed(df, _any_null(df.columns), observation)


def read_ds(spark: SparkSession, path, dim: int | None = None, as_text: bool = False,
            observation: Observation | None = None) -> DataFrame:
    """``"<id> f1 f2 ..."`` lines -> ``row_idx`` bigint and the features.

    ``as_text`` keeps the feature tokens as strings (exact text round trip);
    otherwise the first ``dim`` tokens become ``x1..xd`` doubles.
    """
    v = F.col("value")
    tok = F.split(v, " ")
    df = spark.read.text(path).filter(F.length(F.trim(v)) > 0)
    idx = (F.try_element_at(tok, F.lit(1))).try_cast("bigint").alias("row_idx")
    if as_text or dim is None:
        df = df.select(idx, F.slice(tok, 2, F.size(tok) - 1).alias("features"), v.alias("line"))
        return _observed(df, F.col("row_idx").isNull(), observation)
    df = df.select(idx, *[(F.try_element_at(tok, F.lit(i + 2))).try_cast("double").alias(f"x{i + 1}")
                          for i in range(dim)])
    return _observed(df, _any_null(df.columns), observation)


def read_id_list(spark: SparkSession, path, observation: Observation | None = None) -> DataFrame:
    """An id file: the first space-separated token of each line is a 0-based row index."""
    v = F.col("value")
    df = spark.read.text(path).filter(F.length(F.trim(v)) > 0).select(
        (F.try_element_at(F.split(v, " "), F.lit(1))).try_cast("bigint").alias("row_idx"), v.alias("line"))
    return _observed(df, F.col("row_idx").isNull(), observation)


def read_indexed_lines(spark: SparkSession, path, name: str = "row_idx", glob: str | None = None,
                       recursive: bool = False) -> DataFrame:
    """``(row_idx, file, line_no, line)``: text lines with their 0-based number over all files, in
    order of path and place, and within their file.

    No sort and no shuffle of the lines: a block of a file (its path and first byte are
    scan metadata) is read by one task in order, so a line's place is its block's first number
    plus its place in the block.  One pass counts the lines of each block; the table of blocks,
    a row for some 128 MB of text, is numbered and joined back.
    """
    checkpoint_dir(spark)
    raw = _tree(spark, path, glob, recursive).select(
        F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    blocks = raw.groupBy("file", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first")).checkpoint()
    before = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = blocks.select("file", "_block", "_first", before(Window.orderBy("file", "_block")).alias("_all"),
                             before(Window.partitionBy("file").orderBy("_block")).alias("_own"))
    if blocks.count() <= MAX_BROADCAST_BLOCKS:
        numbered = F.broadcast(numbered)
    place = F.col("_at") - F.col("_first")
    return raw.join(numbered, ["file", "_block"]).select(
        (F.col("_all") + place).alias(name), "file", (F.col("_own") + place).alias("line_no"), "line")


def merge_id_file(spark: SparkSession, ids_path, data_path, dim: int) -> DataFrame:
    """The data lines that an id file names, as ``row_idx, x1..xd, line``: ids are 0-based line
    numbers in file order; an id that is listed twice gives its line twice, one that no line has
    gives none."""
    ids = read_id_list(spark, ids_path).filter(F.col("row_idx").isNotNull()).select("row_idx")
    lines = read_indexed_lines(spark, data_path)
    tok = F.split(F.col("line"), ",")
    return ids.join(lines, "row_idx").select(
        "row_idx", *[F.get(tok, i).try_cast("double").alias(f"x{i + 1}") for i in range(dim)], "line")


def read_trajectories(spark: SparkSession, path, glob: str = "*.plt", header_lines: int = 6,
                      observation: Observation | None = None) -> DataFrame:
    """GPS trajectory files -> ``lat, long, alt`` (tokens 0, 1 and 3).

    Every file starts with ``header_lines`` lines that are skipped; files are searched
    recursively.  Line numbers come from the place of each line in its file
    (:func:`read_indexed_lines`), so a large file is read by many tasks.
    """
    lines = read_indexed_lines(spark, path, glob=glob, recursive=True)
    body = lines.filter((F.col("line_no") >= header_lines) & (F.length(F.trim(F.col("line"))) > 0))
    tok = F.split(F.col("line"), ",")
    out = body.select("file", "line_no",
                      F.get(tok, 0).try_cast("double").alias("lat"),
                      F.get(tok, 1).try_cast("double").alias("long"),
                      F.get(tok, 3).try_cast("double").alias("alt"))
    return _observed(out, _any_null(["lat", "long", "alt"]), observation)


def read_timings(spark: SparkSession, path, observation: Observation | None = None) -> DataFrame:
    """Timing log ``alg,x,y`` (algorithm, parameter value, seconds)."""
    tok = F.split(F.col("value"), ",")
    df = spark.read.text(path).filter(F.length(F.trim(F.col("value"))) > 0).select(
        F.get(tok, 0).alias("alg"), F.get(tok, 1).try_cast("double").alias("x"), F.get(tok, 2).try_cast("double").alias("y"))
    return _observed(df, _any_null(df.columns), observation)


def array_features(df: DataFrame, col: str, dim: int, prefix: str = "x",
                   keep: list[str] | None = None) -> DataFrame:
    """Expand an ``array<double>`` (or ``array<float>``) column into scalar
    ``x1..xd`` feature columns (scalar columns keep the distance expressions in
    whole-stage codegen).  Missing elements become NULL and are quarantined
    by the detector."""
    keep = list(keep) if keep is not None else [c for c in df.columns if c != col]
    return df.select(*keep, *[F.get(F.col(col), i).cast("double").alias(f"{prefix}{i + 1}")
                              for i in range(dim)])

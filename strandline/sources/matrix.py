"""Matrices, labels and logs in text files."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.dataset import sample_rows


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(row_id, value) of the file's lines that hold something. A file is one
    matrix and is read in one piece, so that its lines keep their order; many
    files are read side by side (row_id then counts within a file)."""
    text = spark.read.text(path, wholetext=True)
    lines = F.split("value", r"\r?\n")
    return text.select(F.posexplode(F.filter(lines, lambda x: F.trim(x) != "")).alias("row_id", "value"))


def read_csv_matrix(spark: SparkSession, path: str, header: int = 1, sep: str = ",", exclude_index: bool = False, drop_class: bool = True, sample: bool = False) -> DataFrame:
    """(row_id, x0, x1, ...): empty lines go first, then `header` lines; cells are
    trimmed and must be numbers. drop_class drops the last column where there is
    one header line and it names a class. Raises where the file can't be read."""
    lines = _numbered_lines(spark, path)
    head = [r.value for r in lines.where(F.col("row_id") <= header).orderBy("row_id").collect()]
    if len(head) <= header:
        raise ValueError(f"{path} holds no rows")
    width = len(head[header].split(sep))
    first = 1 if exclude_index else 0
    last = width - 1 if drop_class and header == 1 and "class" in head[0] else width
    cells = F.split("value", re.escape(sep))
    out = lines.where(F.col("row_id") >= header).select((F.col("row_id") - header).cast("long").alias("row_id"), *[F.trim(cells[i]).cast("double").alias(f"x{i - first}") for i in range(first, last)])
    return sample_rows(out) if sample else out


def column_names(spark: SparkSession, path: str, sep: str = ",") -> list[str]:
    """Names of a CSV's or ARFF's columns, as its head gives them."""
    if path.endswith(".arff"):
        return arff_names(path)
    first = _numbered_lines(spark, path).where("row_id = 0").head()
    return [] if first is None else [x.strip() for x in first.value.split(sep)]


def read_typed_csv(spark: SparkSession, path: str, types: dict[str, str], sep: str = ",", null: str = "NULL") -> DataFrame:
    """A CSV with a header line, its columns by name: those in `types` as the
    given type, the others as text. Cells that read `null` are null; a column
    that the file lacks and a cell that isn't of its type raise."""
    df = spark.read.csv(path, header=True, sep=sep, nullValue=null)
    if lacking := sorted(set(types) - set(df.columns)):
        raise ValueError(f"{path} has no columns {lacking}")
    plain = lambda c: F.col(f"`{c}`")
    return df.select(*[plain(c).cast(types[c]).alias(c) if c in types else plain(c) for c in df.columns])


def read_index(spark: SparkSession, path: str, test: str = "ksp", **options) -> tuple[DataFrame, int]:
    """A file's matrix as the index that a test reads, written once, and its
    number of rows."""
    from ..operators.dataset import row_count, to_long
    from ..operators.dependence import ESTIMATORS
    from ..operators.ranks import corrected_index, rank_index
    from ..plans.tables import materialize

    if test not in (*ESTIMATORS, "ks"):
        raise ValueError(f"no test {test}")
    wide = read_matrix(spark, path, **options)
    build = rank_index if test in ("ks", "ksp") else corrected_index
    return materialize(build(to_long(wide)), "index"), row_count(wide)


def read_labels(spark: SparkSession, path: str, header: int = 1, sep: str = ",") -> DataFrame:
    """(row_id, is_outlier): the last column is above 0; CSV or ARFF."""
    if path.endswith(".arff"):
        df = read_arff_matrix(spark, path, drop_class=False)
    else:
        df = read_csv_matrix(spark, path, header, sep, drop_class=False)
    return df.select("row_id", (F.col(df.columns[-1]) > 0).alias("is_outlier"))


class ArffReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        return [InputPartition(0)]

    def read(self, partition) -> Iterator[tuple]:
        names, n = arff_names(self.path), 0
        for line in _arff_lines(self.path):
            cells = [c.strip() for c in line.split(",")]
            if not line.startswith(("@", "%")) and len(cells) == len(names):
                yield n, [1.0 if c.strip("'") == "yes" else 0.0 if c.strip("'") == "no" else float(c) for c in cells]
                n += 1


class ArffSource(DataSource):
    """A file every machine can open: local, or on a mounted folder. Rows are the
    lines with as many fields as there are attributes; yes and no are 1 and 0."""

    @classmethod
    def name(cls) -> str:
        return "arff"

    def schema(self) -> str:
        return "row_id long, cells array<double>"

    def reader(self, schema) -> ArffReader:
        return ArffReader(self.options["path"])


def _arff_lines(path: str) -> list[str]:
    with open(path, encoding="utf-8") as f:
        return [x.strip() for x in f if x.strip()]


def arff_names(path: str) -> list[str]:
    """Attribute names in their order."""
    return [re.split(r"\s+", x, maxsplit=2)[1].strip("'\"") for x in _arff_lines(path) if x.lower().startswith("@attribute")]


def read_arff_matrix(spark: SparkSession, path: str, drop_class: bool = True, sample: bool = False) -> DataFrame:
    """As read_csv_matrix; the last column is dropped where any attribute names
    a class or an outlier."""
    spark.dataSource.register(ArffSource)
    names = arff_names(path)
    n = len(names) - 1 if drop_class and any("class" in x.lower() or "outlier" in x.lower() for x in names) else len(names)
    out = spark.read.format("arff").load(path).select("row_id", *[F.col("cells")[i].alias(f"x{i}") for i in range(n)])
    return sample_rows(out) if sample else out


def read_matrix(spark: SparkSession, path: str, **options) -> DataFrame:
    """By the file's suffix."""
    return read_arff_matrix(spark, path, **options) if path.endswith(".arff") else read_csv_matrix(spark, path, **options)


def write_matrix(wide: DataFrame, path: str) -> None:
    """Overwrite: a header 1, 2, ... and a line for each row."""
    cols = [c for c in wide.columns if c != "row_id"]
    wide.select(*[F.col(c).alias(str(i + 1)) for i, c in enumerate(cols)]).write.mode("overwrite").csv(path, header=True)


# -- subspace logs: a line for each step, d,d : score ; d,d,d : score ------------------


def format_log(steps: DataFrame) -> DataFrame:
    """(step, subspaces array<struct<dims, score>>) -> (step, line)."""
    one = lambda s: F.concat(F.array_join(F.transform(s["dims"], lambda d: d.cast("string")), ","), F.lit(" : "), F.format_string("%.4f", s["score"]))
    return steps.select("step", F.array_join(F.transform("subspaces", one), " ; ").alias("line"))


def parse_log(lines: DataFrame) -> DataFrame:
    """(step, line) -> (step, subspaces)."""

    def one(text: Column) -> Column:
        halves = F.split(text, ":")
        dims = F.transform(F.split(F.trim(halves[0]), ","), lambda d: F.trim(d).cast("int"))
        return F.struct(dims.alias("dims"), F.trim(halves[1]).cast("double").alias("score"))

    return lines.select("step", F.transform(F.filter(F.split("line", ";"), lambda x: F.trim(x) != ""), one).alias("subspaces"))


def write_log(steps: DataFrame, path: str) -> None:
    format_log(steps).repartitionByRange("step").sortWithinPartitions("step").select("line").write.mode("append").text(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    lines = _numbered_lines(spark, path)
    return parse_log(lines.select(F.col("row_id").cast("long").alias("step"), F.col("value").alias("line")))


# -- summaries ------------------------------------------------------------------------------


def append_summary(rows: DataFrame, path: str, attributes: list[str]) -> None:
    """Append rows as CSV with these columns; what a row lacks is NULL."""
    have = set(rows.columns)
    rows.select(*[(F.coalesce(F.col(a).cast("string"), F.lit("NULL")) if a in have else F.lit("NULL")).alias(a) for a in attributes]).write.mode("append").csv(path, header=True)


class Catalog:
    """Data sets by name: a path and how to read it. Opening a data set whose
    file is missing raises."""

    def __init__(self):
        self.known: dict[str, dict] = {}

    def add(self, name: str, path: str, **options) -> None:
        self.known[name] = {"path": path, **options}

    def open(self, spark: SparkSession, name: str) -> DataFrame:
        if name not in self.known:
            raise KeyError(f"no data set {name}")
        return read_matrix(spark, **self.known[name])

    def register(self, spark: SparkSession) -> None:
        for name in self.known:
            self.open(spark, name).createOrReplaceTempView(name)

"""Readers and writers for CSV, Parquet and array tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabflow.functions.hashing import normal
from tabflow.operators.clean import nan_to_null


# In exact files NULL has a mark of its own, and backslashes and line breaks inside text are spelled with a backslash.
# Every row is then one line, so files stay splittable, and text comes back as it was.
_NULL = "\\N"
_SPELLED = (("\\", "\\s"), ("\n", "\\n"), ("\r", "\\r"))
_FORMAT = {"escape": '"', "nullValue": _NULL, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
_TIME = "yyyy-MM-dd'T'HH:mm:ss"


def _texts(df: DataFrame, change: Callable[[Column], Column]) -> DataFrame:
    texts = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    return df.select(*[change(F.col(f"`{c}`")).alias(c) if c in texts else F.col(f"`{c}`") for c in df.columns])


def _spell(c: Column) -> Column:
    for plain, spelled in _SPELLED:
        c = F.replace(c, F.lit(plain), F.lit(spelled))
    return c


def _unspell(c: Column) -> Column:
    for plain, spelled in reversed(_SPELLED):
        c = F.replace(c, F.lit(spelled), F.lit(plain))
    return c


def read_csv(spark: SparkSession, path: str, schema: str | object | None = None, names: bool = True, exact: bool = False, multi_line: bool = False) -> DataFrame:
    """CSV with a schema, or with types inferred from all rows (one more pass). ``names=False`` reads a file without a header line.

    ``exact`` reads what ``write_csv`` wrote: NULL, empty text, line breaks, quotes and outer blanks come back as they were.
    Without it, an empty field is NULL; ``multi_line`` allows line breaks inside quotes, at the price of one task per file.
    NaN in the file becomes NULL.
    """
    reader = spark.read.option("timestampNTZFormat", f"{_TIME}[.SSSSSS]").option("escape", '"').option("multiLine", multi_line)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    if exact:
        reader = reader.options(**_FORMAT)
    df = nan_to_null(reader.csv(path, header=names))
    return _texts(df, _unspell) if exact else df


def write_csv(df: DataFrame, path: str, append: bool = False) -> None:
    """CSV with a header line, exact when read back with ``read_csv(exact=True)``; ``append`` adds files to what is there."""
    writer = _texts(df, _spell).write.mode("append" if append else "errorifexists").options(**_FORMAT)
    writer.option("timestampNTZFormat", f"{_TIME}.SSSSSS").csv(path, header=True)


def write_arrays(df: DataFrame, path: str) -> None:
    """Tensors are array columns of a Parquet table."""
    df.write.parquet(path)


def read_arrays(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def matrix_unpack(df: DataFrame, matrix: str, names: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Leading entries of an array column as columns of their own."""
    return df.select(*keep, *[F.col(matrix)[i].alias(n) for i, n in enumerate(names)])


def submission(df: DataFrame, key: str, prediction: str, names: tuple[str, str]) -> DataFrame:
    """Identifier and prediction, under the names wanted."""
    return df.select(F.col(key).alias(names[0]), F.col(prediction).alias(names[1]))


def gen_blobs(rows: DataFrame, key: str, centre_cols: Sequence[str], spread: float = 1.0, seed: int = 8) -> DataFrame:
    """Scatter one point around the centre of each row with normal noise drawn from the key."""
    return rows.withColumns({f"x{i + 1}": F.col(c) + normal(key, f"{seed}{i}") * F.lit(spread) for i, c in enumerate(centre_cols)})

"""Rows as SQL text: literals of every type by Column functions, and an INSERT statement for each row, written by the tasks that hold them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DataType, DateType, DecimalType, FractionalType, IntegralType, MapType, NullType, StringType, StructType, TimestampNTZType, TimestampType


def quoted(text: Column) -> Column:
    """A text in single quotes, quotes inside doubled; everything else, line feeds too, stands for itself."""
    return F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("''")), F.lit("'"))


def name_of(name: str) -> str:
    """A name in double quotes, quotes inside doubled."""
    return '"' + name.replace('"', '""') + '"'


def literal(value: Column, kind: DataType) -> Column:
    """The SQL literal of a value, NULL for null. Arrays are lists in square brackets, structs and maps JSON texts; what is not a number is cast from text where that needs saying."""
    if isinstance(kind, NullType):
        return F.lit("NULL")
    if isinstance(kind, (BooleanType, IntegralType, DecimalType)):
        shown = value.cast("string")
    elif isinstance(kind, FractionalType):
        shown = F.concat(F.lit("CAST('"), value.cast("string"), F.lit("' AS DOUBLE)"))
    elif isinstance(kind, StringType):
        shown = quoted(value)
    elif isinstance(kind, DateType):
        shown = F.concat(F.lit("DATE '"), value.cast("string"), F.lit("'"))
    elif isinstance(kind, TimestampNTZType):
        shown = F.concat(F.lit("TIMESTAMP '"), value.cast("string"), F.lit("'"))
    elif isinstance(kind, TimestampType):  # an instant: written in UTC, with its zone
        shown = F.concat(F.lit("TIMESTAMPTZ '"), F.date_format(F.to_utc_timestamp(value, F.current_timezone()), "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("+00'"))
    elif isinstance(kind, BinaryType):
        shown = F.concat(F.lit("from_hex('"), F.hex(value), F.lit("')"))
    elif isinstance(kind, ArrayType):
        shown = F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: literal(x, kind.elementType)), ", "), F.lit("]"))
    elif isinstance(kind, (StructType, MapType)):
        shown = quoted(F.to_json(value, {"ignoreNullFields": "false"}))
    else:  # intervals and the like: their text
        shown = quoted(value.cast("string"))
    return F.coalesce(shown, F.lit("NULL"))


def inserts(df: DataFrame, name: str) -> DataFrame:
    """value: an INSERT statement for each row, which stands for itself: files of them can be split, and loaded in any order."""
    head = f"INSERT INTO {'.'.join(map(name_of, name.split('.')))} ({', '.join(map(name_of, df.columns))}) VALUES ("
    return df.select(F.concat(F.lit(head), F.concat_ws(", ", *(literal(F.col(f"`{f.name}`"), f.dataType) for f in df.schema)), F.lit(");")).alias("value"))


def write_inserts(df: DataFrame, name: str, path: str) -> None:
    """Writes the statements as text files, each by the task that holds the rows: nothing is shuffled or gathered."""
    inserts(df, name).write.text(path)

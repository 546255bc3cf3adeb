"""File names of recordings, correlations and stacks, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values: <stamp>[_<tag>]_cc_<vs>[_<window>]_<method> or <stamp>_.._auto_<method>; a stamp has a date and maybe a time.
STAMP = r"^(\d{8})(?:_(\d{6}))?(?=_|\.|$)"
SOURCE = r"_cc_(\d+)"
CORRELATION = r"_(?:cc_\d+|auto)_(?:(\d+[hd])_)?([A-Za-z0-9_]+?)(?:\.np[yz])?$"


def base_name(path) -> Column:
    return F.element_at(F.split(F.col(path) if isinstance(path, str) else path, "/"), -1)


def stamp(name: Column) -> Column:
    """The start of a recording, in UTC; midnight where the name has no time, null where it has no date."""
    date, time = F.regexp_extract(name, STAMP, 1), F.regexp_extract(name, STAMP, 2)
    return F.try_to_timestamp(F.nullif(F.concat(date, F.when(time == "", "000000").otherwise(time)), F.lit("000000")), F.lit("yyyyMMddHHmmss"))


def source(name: Column) -> Column:
    """The virtual source's number; -1 for autocorrelations, null where there is none."""
    number = F.regexp_extract(name, SOURCE, 1)
    return F.when(number != "", number.try_cast("int")).when(name.contains("_auto_"), -1)


def method(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, CORRELATION, 2), F.lit(""))


def window(name: Column) -> Column:
    """The label of a stack, like 7d."""
    return F.nullif(F.regexp_extract(name, CORRELATION, 1), F.lit(""))


def strict(value: Column, name: Column) -> Column:
    """value, or an error that has the name where it is null."""
    return F.when(value.isNull(), F.raise_error(F.concat(F.lit("not a recording's name: "), name))).otherwise(value)


def stack_name(end: Column, vs: Column, label: str, method: Column) -> Column:
    form = "yyyyMMdd" if label.endswith("d") else "yyyyMMdd_HHmmss"
    return F.concat_ws("_", F.date_format(end, form), F.lit("cc"), F.lpad(vs.cast("string"), 3, "0"), F.lit(label), method)

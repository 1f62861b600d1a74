"""Tagged values: the typed fact values of profiles and rules, and their comparison with errors as data."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

DDL = "STRUCT<kind: STRING, num: DOUBLE, str: STRING, arr: ARRAY<STRING>>"
#: Kinds: bool and num compare as numbers; a null value is a value, an absent key is not.
KINDS = ("bool", "num", "str", "list", "null")


def code(value: Any) -> str:
    """One string for each value that counts as equal within a list."""
    if isinstance(value, bool | int | float):
        return f"n:{float(value)!r}"
    return "0:" if value is None else f"s:{value}"


def tagged(value: Any) -> tuple:
    """A Python value as a row of DDL."""
    if value is None:
        return ("null", None, None, None)
    if isinstance(value, bool):
        return ("bool", float(value), None, None)
    if isinstance(value, int | float):
        return ("num", float(value), None, None)
    if isinstance(value, list | tuple):
        return ("list", None, None, [code(v) for v in value])
    return ("str", None, str(value), None)


def _struct(kind: str, num: Column | None = None, text: Column | None = None) -> Column:
    return F.struct(F.lit(kind).alias("kind"), (F.lit(None) if num is None else num).cast("double").alias("num"), (F.lit(None) if text is None else text).cast("string").alias("str"), F.lit(None).cast("array<string>").alias("arr"))


def of_bool(c: Column) -> Column:
    return _struct("bool", num=c.cast("int"))


def of_num(c: Column) -> Column:
    return _struct("num", num=c)


def of_str(c: Column) -> Column:
    return _struct("str", text=c)


def coded(v: Column) -> Column:
    """code() of a tagged column."""
    return F.when(v["kind"].isin("bool", "num"), F.concat(F.lit("n:"), v["num"].cast("string"))).when(v["kind"] == "null", F.lit("0:")).otherwise(F.concat(F.lit("s:"), v["str"]))


def equal(actual: Column, expected: Any) -> Column:
    """Equality with a Python value: across kinds False, never an error."""
    if expected is None:
        return actual["kind"] == "null"
    if isinstance(expected, bool | int | float):
        return F.when(actual["kind"].isin("bool", "num"), actual["num"] == float(expected)).otherwise(F.lit(False))
    if isinstance(expected, list | tuple):
        return F.when(actual["kind"] == "list", actual["arr"] == F.array(*[F.lit(code(v)) for v in expected]).cast("array<string>")).otherwise(F.lit(False))
    return F.when(actual["kind"] == "str", actual["str"] == str(expected)).otherwise(F.lit(False))


def compare(op: str, actual: Column, expected: Any) -> Column:
    """The operator's result for a present value; null where the comparison is an error (see error())."""
    if op in ("==", "!="):
        same = equal(actual, expected)
        return same if op == "==" else ~same
    if op in ("in", "not_in"):
        if isinstance(expected, list | tuple):
            found = F.array_contains(F.array(*[F.lit(code(v)) for v in expected]).cast("array<string>"), F.coalesce(coded(actual), F.lit("")))
        elif isinstance(expected, str):
            found = F.when(actual["kind"] == "str", F.contains(F.lit(expected), actual["str"]))
        else:
            return F.lit(None).cast("boolean")
        return found if op == "in" else ~found
    ways = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}
    if isinstance(expected, bool | int | float):
        return F.when(actual["kind"].isin("bool", "num"), ways[op](actual["num"], F.lit(float(expected))))
    if isinstance(expected, str):
        return F.when(actual["kind"] == "str", ways[op](actual["str"], F.lit(expected)))
    return F.lit(None).cast("boolean")


def error(op: str, actual: Column, expected: Any, field: str) -> Column:
    """Why a present value can't be compared; null where it can."""
    text = F.concat(F.lit(f"{field}: cannot apply {op} to "), actual["kind"])
    if op in ("==", "!="):
        return F.lit(None).cast("string")
    if op in ("in", "not_in"):
        if isinstance(expected, list | tuple):
            return F.lit(None).cast("string")
        return F.when(actual["kind"] != "str", text) if isinstance(expected, str) else text
    if isinstance(expected, bool | int | float):
        return F.when(~actual["kind"].isin("bool", "num"), text)
    if isinstance(expected, str):
        return F.when(actual["kind"] != "str", text)
    return text

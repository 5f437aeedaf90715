"""Row checks: each returns the failing rows with the tested column and the context columns asked for."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import ConfigError
from tidemark.session import fresh


def context(df: DataFrame, column: str, columns: list[str] | None) -> list[str]:
    """The tested column first, then the context columns that exist, each once; no list means all columns."""
    names = {c.lower(): c for c in df.columns}
    if column.lower() not in names:
        raise ConfigError(f"there is no column {column}")
    wanted = df.columns if columns is None else [names[c.lower()] for c in columns if c.lower() in names]
    return list(dict.fromkeys([names[column.lower()], *wanted]))


def _some(df: DataFrame, row_condition: str | None) -> DataFrame:
    return df.where(row_condition) if row_condition else df


def not_null(df: DataFrame, column: str, columns: list[str] | None = None, row_condition: str | None = None) -> DataFrame:
    keep = context(df, column, columns)
    return _some(df, row_condition).where(F.col(column).isNull()).select(*keep)


def accepted_range(df: DataFrame, column: str, low: Any = None, high: Any = None, inclusive: bool = True, columns: list[str] | None = None) -> DataFrame:
    """Rows out of the range; null is in it."""
    if low is None and high is None:
        raise ConfigError("accepted_range needs a minimum or a maximum")
    keep = context(df, column, columns)
    c, bad = F.col(column), F.lit(False)
    if low is not None:
        bad = bad | ~((c >= low) if inclusive else (c > low))
    if high is not None:
        bad = bad | ~((c <= high) if inclusive else (c < high))
    return df.where(bad).select(*keep)


def relationships(df: DataFrame, column: str, parent: DataFrame, field: str, columns: list[str] | None = None) -> DataFrame:
    """Rows whose non-null key the parent lacks. The parent goes in as its distinct keys."""
    keep = context(df, column, columns)
    (key,) = fresh(df, "parent")
    keys = parent.select(F.col(field).alias(key)).where(F.col(key).isNotNull()).distinct()
    return df.where(F.col(column).isNotNull()).join(keys, F.col(column) == F.col(key), "left_anti").select(*keep)


def unique(df: DataFrame, column: str, columns: list[str] | None = None, row_condition: str | None = None) -> DataFrame:
    """Rows whose value stands in several rows; nulls are equal to each other.

    The repeated values come from a map-side combined aggregate; rows meet them by a semi-join that
    splits skewed values, where a window over the value would hold each in one task.
    """
    keep = context(df, column, columns)
    rows = _some(df, row_condition)
    (key,) = fresh(df, "value")
    repeated = rows.groupBy(F.col(column).alias(key)).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key)
    return rows.join(repeated, F.col(column).eqNullSafe(F.col(key)), "left_semi").select(*keep)


def match_regex(df: DataFrame, column: str, regex: str, flags: str = "", columns: list[str] | None = None, row_condition: str | None = None) -> DataFrame:
    """Rows in whose value the pattern is not found; null passes."""
    keep = context(df, column, columns)
    pattern = f"(?{flags}){regex}" if flags else regex
    return _some(df, row_condition).where(~F.col(column).rlike(pattern)).select(*keep)


def python_check(df: DataFrame, check: Callable[..., Any], where: str | None = None, **arguments: Any) -> int:
    """Failures that a callable finds: it gets (df, session, **arguments) and gives a number, a boolean
    (True: passed) or a DataFrame of failing rows."""
    result = check(_some(df, where), df.sparkSession, **arguments)
    if isinstance(result, bool):
        return 0 if result else 1
    if isinstance(result, (int, float)):
        return int(result)
    if isinstance(result, DataFrame):
        return result.count()
    raise ConfigError("a python check must return a number, a boolean or a DataFrame")


_JSON_TYPES = {"string": str, "object": dict, "array": list, "boolean": bool, "null": type(None)}


def schema_errors(value: Any, schema: dict | bool, path: str = "$") -> list[str]:
    """Where a JSON value violates a JSON schema (the common keywords)."""
    if schema is True or schema == {}:
        return []
    if schema is False:
        return [f"{path}: nothing is allowed"]
    out: list[str] = []
    types = schema.get("type")
    if types is not None and not any(_is(value, t) for t in ([types] if isinstance(types, str) else types)):
        return [f"{path}: is not of type {types}"]
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{path}: is none of the allowed values")
    if "const" in schema and value != schema["const"]:
        out.append(f"{path}: is not the constant")
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0):
            out.append(f"{path}: is too short")
        if len(value) > schema.get("maxLength", len(value)):
            out.append(f"{path}: is too long")
        if "pattern" in schema and not re.search(schema["pattern"], value):
            out.append(f"{path}: does not match the pattern")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        for word, bad in (
            ("minimum", lambda x: value < x),
            ("maximum", lambda x: value > x),
            ("exclusiveMinimum", lambda x: value <= x),
            ("exclusiveMaximum", lambda x: value >= x),
            ("multipleOf", lambda x: abs(value / x - round(value / x)) > 1e-9),
        ):
            if word in schema and bad(schema[word]):
                out.append(f"{path}: violates {word}")
    if isinstance(value, list):
        if len(value) < schema.get("minItems", 0) or len(value) > schema.get("maxItems", len(value)):
            out.append(f"{path}: has a wrong number of items")
        if schema.get("uniqueItems") and len({json.dumps(v, sort_keys=True) for v in value}) < len(value):
            out.append(f"{path}: repeats items")
        if "items" in schema:
            for i, v in enumerate(value):
                out += schema_errors(v, schema["items"], f"{path}[{i}]")
    if isinstance(value, dict):
        properties = schema.get("properties", {})
        out += [f"{path}: lacks {k}" for k in schema.get("required", ()) if k not in value]
        for k, v in value.items():
            if k in properties:
                out += schema_errors(v, properties[k], f"{path}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{path}: has the unknown {k}")
            elif isinstance(schema.get("additionalProperties"), dict):
                out += schema_errors(v, schema["additionalProperties"], f"{path}.{k}")
    for word, enough in (("allOf", lambda n, all_: n == all_), ("anyOf", lambda n, all_: n > 0), ("oneOf", lambda n, all_: n == 1)):
        if word in schema:
            good = sum(not schema_errors(value, s, path) for s in schema[word])
            if not enough(good, len(schema[word])):
                out.append(f"{path}: violates {word}")
    if "not" in schema and not schema_errors(value, schema["not"], path):
        out.append(f"{path}: violates not")
    return out


def _is(value: Any, kind: str) -> bool:
    if kind in ("number", "integer"):
        number = isinstance(value, (int, float)) and not isinstance(value, bool)
        return number and (kind == "number" or float(value).is_integer())
    return isinstance(value, _JSON_TYPES[kind])


def json_schema(df: DataFrame, column: str, schema: dict, where: str | None = None) -> DataFrame:
    """Rows whose text is no JSON or violates the schema; null is a failing row."""
    (out,) = fresh(df, "valid")

    @F.pandas_udf("boolean")
    def valid(texts: pd.Series) -> pd.Series:
        def one(t: Any) -> bool:
            try:
                return t is not None and not schema_errors(json.loads(t), schema)
            except (ValueError, TypeError):
                return False

        return texts.map(one)

    return _some(df, where).withColumn(out, valid(F.col(column).cast("string"))).where(~F.col(out)).drop(out)


def text_validation(df: DataFrame, column: str, prompt: str, model: Callable[[list[str]], list[str]], where: str | None = None, batch: int = 256) -> DataFrame:
    """Rows for which a text model's answer to the prompt holds 'false'. `model` answers a batch of
    prompts; it is loaded in the workers and no network is used here."""
    schema = df.schema

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k in range(0, len(pdf), batch):
                part = pdf.iloc[k : k + batch]
                answers = model([f"{prompt}\n{v}" for v in part[column]])
                yield part[[("false" in str(a).lower()) for a in answers]]

    return _some(df, where).mapInPandas(judge, schema)


#: What comes before the prompt of a check on free texts.
FREE_TEXT = "Judge the text below by the statement. Answer with true or false only. Statement: "


def unstructured_validation(df: DataFrame, column: str, statement: str, model: Callable[[list[str]], list[str]], where: str | None = None) -> DataFrame:
    return text_validation(df, column, FREE_TEXT + statement, model, where)


def failed_row_count(failures: DataFrame, calculation: str = "count(*)") -> int | None:
    """The test's own count of failed rows, as an aggregate over its result."""
    value = failures.selectExpr(f"{calculation} AS n").first()["n"]
    return None if value is None else int(value)


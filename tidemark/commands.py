"""Driver-side helpers: checks of a project's declarations and generated test definitions."""

from __future__ import annotations

import json
from collections.abc import Iterable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.artifacts import Manifest


def configuration_problems(
    manifest: Manifest,
    owners: bool = True,
    tags: bool = False,
    description: bool = False,
    meta_keys: Iterable[str] = (),
    config_keys: Iterable[str] = (),
) -> list[tuple[str, str]]:
    """(unique_id, what is missing) over models and sources that lack a required declaration."""
    nodes = {**(manifest.manifest.get("nodes") or {}), **(manifest.manifest.get("sources") or {})}
    out = []
    for row in [*manifest.models(), *manifest.sources()]:
        config = (nodes[row["unique_id"]].get("config")) or {}
        missing = [(owners and not row["owner"], "owner"), (tags and not row["tags"], "tags"), (description and not row["description"], "description")]
        missing += [(k not in (row["meta"] or {}), f"meta key {k}") for k in meta_keys]
        missing += [(not config.get(k), f"config key {k}") for k in config_keys]
        out += [(row["unique_id"], what) for bad, what in missing if bad]
    return out


def baseline_test(df: DataFrame, name: str, kind: str = "models", fail_on_added: bool = False, enforce_types: bool = False, lower: bool = False) -> str:
    """A YAML test definition that fixes a table's present columns."""
    lines = [f"{kind}:", f"  - name: {name}", "    columns:"]
    for f in df.schema.fields:
        column, data_type = f.name, f.dataType.simpleString()
        lines += [f"      - name: {column.lower() if lower else column}", f"        data_type: {data_type.lower() if lower else data_type.upper()}"]
    lines += ["    tests:", "      - schema_changes_from_baseline:"]
    arguments = [f"          {k}: true" for k, v in (("fail_on_added", fail_on_added), ("enforce_types", enforce_types)) if v]
    return "\n".join([*lines, *arguments]) + "\n"


def json_schema_of(df: DataFrame, column: str) -> dict[str, Any]:
    """A JSON schema that all texts of a column satisfy, from their inferred type."""
    per = df.where(F.col(column).isNotNull()).select(F.expr(f"from_json(`{column}`, 'variant')").alias("v"))
    merged = per.agg(F.schema_of_variant_agg("v").alias("s")).first()["s"]
    kind = T.StringType() if merged is None else T._parse_datatype_string(merged.replace("OBJECT<", "STRUCT<"))
    return _json_type(kind)


def _json_type(kind: T.DataType) -> dict[str, Any]:
    if isinstance(kind, T.StructType):
        return {"type": "object", "properties": {f.name: _json_type(f.dataType) for f in kind.fields}}
    if isinstance(kind, T.ArrayType):
        return {"type": "array", "items": _json_type(kind.elementType)}
    if isinstance(kind, T.BooleanType):
        return {"type": "boolean"}
    if isinstance(kind, T.IntegralType):
        return {"type": "integer"}
    return {"type": "number"} if isinstance(kind, T.NumericType) else {"type": "string"}


def json_schema_test(df: DataFrame, name: str, column: str) -> str:
    schema = json.dumps(json_schema_of(df, column), sort_keys=True)
    return f"models:\n  - name: {name}\n    columns:\n      - name: {column}\n        tests:\n          - json_schema: {schema}\n"


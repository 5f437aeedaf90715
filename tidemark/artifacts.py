"""Pipeline metadata: manifest, run results and source freshness as rows, loaded by difference."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Mapping
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from tidemark.sources.store import ParquetTable
from tidemark.sources.tables import constant

# The columns of the metadata tables.
_TEXT = lambda names: ", ".join(f"{n} string" for n in names.split())
SCHEMAS = {
    "dbt_models": _TEXT(
        "unique_id alias checksum materialization tags meta owner database_name schema_name depends_on_macros depends_on_nodes description name "
        "package_name original_path path patch_path generated_at metadata_hash unique_key incremental_strategy group_name access"
    ),
    "dbt_sources": _TEXT(
        "unique_id database_name schema_name source_name name identifier loaded_at_field freshness_warn_after freshness_error_after freshness_filter "
        "freshness_description relation_name tags meta owner package_name original_path path source_description description generated_at metadata_hash"
    ),
    "dbt_seeds": _TEXT("unique_id alias checksum tags meta owner database_name schema_name description name package_name original_path path generated_at metadata_hash group_name"),
    "dbt_tests": _TEXT(
        "unique_id database_name schema_name name short_name alias test_column_name severity warn_if error_if test_params test_namespace test_original_name tags "
        "model_tags model_owners meta depends_on_macros depends_on_nodes parent_model_unique_id description package_name type original_path path generated_at "
        "metadata_hash quality_dimension group_name"
    ),
    "dbt_columns": _TEXT("unique_id parent_unique_id name data_type tags meta database_name schema_name table_name description resource_type generated_at metadata_hash"),
    "dbt_exposures": _TEXT(
        "unique_id name maturity type owner_email owner_name url depends_on_macros depends_on_nodes description tags meta package_name original_path path "
        "generated_at metadata_hash label raw_queries depends_on_columns"
    ),
    "dbt_metrics": _TEXT(
        "unique_id name label model type sql timestamp filters time_grains dimensions depends_on_macros depends_on_nodes description tags meta package_name "
        "original_path path generated_at metadata_hash group_name"
    ),
    "dbt_groups": _TEXT("unique_id name owner_email owner_name generated_at metadata_hash"),
    "dbt_run_results": _TEXT("model_execution_id unique_id invocation_id generated_at name message status resource_type")
    + ", execution_time double, "
    + _TEXT("execute_started_at execute_completed_at compile_started_at compile_completed_at")
    + ", rows_affected bigint, full_refresh boolean, compiled_code string, failures bigint, "
    + _TEXT("query_id thread_id materialization adapter_response group_name"),
    "dbt_source_freshness_results": _TEXT("source_freshness_execution_id unique_id max_loaded_at snapshotted_at generated_at")
    + ", max_loaded_at_time_ago_in_s double, "
    + _TEXT("status error warn_after error_after filter compile_started_at compile_completed_at execute_started_at execute_completed_at invocation_id"),
}
SCHEMAS["dbt_snapshots"] = SCHEMAS["dbt_models"]


def _clean(values: Iterable[Any] | str | None) -> list[Any]:
    """Distinct, without nulls, sorted."""
    values = [values] if isinstance(values, str) else values or []
    return sorted({v for v in values if v is not None})


def metadata_hash(row: Mapping[str, Any]) -> str:
    """The same for the same content, whenever it was made."""
    content = {k: v for k, v in row.items() if k not in ("generated_at", "metadata_hash")}
    return hashlib.md5(json.dumps(content, sort_keys=True, default=str).encode()).hexdigest()


def owners(raw: Any, group: str | None = None, groups: Mapping[str, str] | None = None) -> list[str]:
    """A text with commas or a list; without any, the owner of the group."""
    out = [o.strip() for o in raw.split(",")] if isinstance(raw, str) else list(raw or [])
    if not out and group and (groups or {}).get(group):
        out = [groups[group]]
    return _clean(out)


class Manifest:
    """The nodes of a manifest flattened to the rows of the metadata tables."""

    def __init__(self, manifest: Mapping[str, Any], now: datetime, project: str | None = None):
        self.manifest, self.project = manifest, project
        self.stamp = now.strftime("%Y-%m-%d %H:%M:%S")
        self.groups = {g["name"]: (g.get("owner") or {}).get("email") or (g.get("owner") or {}).get("name") for g in (manifest.get("groups") or {}).values()}

    def _of(self, section: str, kind: str | None = None) -> list[Mapping[str, Any]]:
        nodes = (self.manifest.get(section) or {}).values()
        return [n for n in nodes if (kind is None or n.get("resource_type") == kind) and (self.project is None or n.get("package_name") == self.project)]

    def _common(self, n: Mapping[str, Any]) -> dict[str, Any]:
        config = n.get("config") or {}
        meta = {**(n.get("meta") or {}), **(config.get("meta") or {})}
        group = config.get("group") or n.get("group")
        depends = n.get("depends_on") or {}
        return {
            "unique_id": n.get("unique_id"),
            "name": n.get("name"),
            "alias": n.get("alias"),
            "checksum": (n.get("checksum") or {}).get("checksum"),
            "tags": _clean([*_clean(config.get("tags")), *_clean(n.get("tags")), *_clean(meta.get("tags"))]),
            "meta": meta,
            "owner": owners(meta.get("owner") or config.get("owner"), group, self.groups),
            "database_name": n.get("database"),
            "schema_name": n.get("schema"),
            "depends_on_macros": _clean(depends.get("macros")),
            "depends_on_nodes": _clean(depends.get("nodes")),
            "description": n.get("description"),
            "package_name": n.get("package_name"),
            "original_path": n.get("original_file_path"),
            "path": n.get("path"),
            "group_name": group,
            "generated_at": self.stamp,
        }

    def _done(self, rows: list[dict[str, Any]], table: str) -> list[dict[str, Any]]:
        names = [c.split()[0] for c in SCHEMAS[table].split(", ")]
        out = []
        for r in rows:
            kept = {k: r.get(k) for k in names}
            kept["metadata_hash"] = metadata_hash(kept)
            out.append(kept)
        return out

    def models(self, kind: str = "model") -> list[dict[str, Any]]:
        rows = []
        for n in self._of("nodes", kind):
            config = n.get("config") or {}
            rows.append(
                self._common(n)
                | {
                    "materialization": config.get("materialized"),
                    "patch_path": n.get("patch_path"),
                    "unique_key": config.get("unique_key"),
                    "incremental_strategy": config.get("incremental_strategy"),
                    "access": config.get("access") or n.get("access"),
                }
            )
        return self._done(rows, "dbt_models")

    def seeds(self) -> list[dict[str, Any]]:
        return self._done([self._common(n) for n in self._of("nodes", "seed")], "dbt_seeds")

    def sources(self) -> list[dict[str, Any]]:
        rows = []
        for n in self._of("sources"):
            fresh = n.get("freshness") or {}
            rows.append(
                self._common(n)
                | {
                    "source_name": n.get("source_name"),
                    "identifier": n.get("identifier"),
                    "loaded_at_field": n.get("loaded_at_field"),
                    "freshness_warn_after": fresh.get("warn_after"),
                    "freshness_error_after": fresh.get("error_after"),
                    "freshness_filter": fresh.get("filter"),
                    "relation_name": n.get("relation_name"),
                    "source_description": n.get("source_description"),
                }
            )
        return self._done(rows, "dbt_sources")

    def tests(self) -> list[dict[str, Any]]:
        nodes = {**(self.manifest.get("nodes") or {}), **(self.manifest.get("sources") or {})}
        rows = []
        for n in self._of("nodes", "test"):
            config, about = n.get("config") or {}, n.get("test_metadata") or {}
            parents = [p for p in _clean((n.get("depends_on") or {}).get("nodes")) if p in nodes]
            main = n.get("attached_node") or (parents[0] if len(parents) == 1 else None)
            parent = self._common(nodes[main]) if main in nodes else {}
            row = self._common(n)
            rows.append(
                row
                | {
                    "short_name": about.get("name") or n.get("name"),
                    "test_column_name": n.get("column_name") or (about.get("kwargs") or {}).get("column_name"),
                    "severity": config.get("severity"),
                    "warn_if": config.get("warn_if"),
                    "error_if": config.get("error_if"),
                    "test_params": {k: v for k, v in (about.get("kwargs") or {}).items() if k != "model"},
                    "test_namespace": about.get("namespace"),
                    "test_original_name": about.get("name"),
                    "model_tags": parent.get("tags", []),
                    "model_owners": parent.get("owner", []),
                    "parent_model_unique_id": main,
                    "type": "generic" if about else "singular",
                    "quality_dimension": row["meta"].get("quality_dimension"),
                }
            )
        return self._done(rows, "dbt_tests")

    def columns(self, strategy: str = "enriched_only") -> list[dict[str, Any]]:
        """Declared columns: those with a description, tags or meta, or all of them."""
        rows = []
        for n in [*self._of("nodes"), *self._of("sources")]:
            if n.get("resource_type") not in ("model", "source", "snapshot", "seed"):
                continue
            for name, c in (n.get("columns") or {}).items():
                config = c.get("config") or {}
                meta = {**(c.get("meta") or {}), **(config.get("meta") or {})}
                tags = _clean([*_clean(c.get("tags")), *_clean(config.get("tags")), *_clean(meta.get("tags"))])
                if strategy == "enriched_only" and not (c.get("description") or tags or meta):
                    continue
                rows.append(
                    {
                        "unique_id": f"column.{n['unique_id']}.{name}",
                        "parent_unique_id": n["unique_id"],
                        "name": name,
                        "data_type": c.get("data_type"),
                        "tags": tags,
                        "meta": meta,
                        "database_name": n.get("database"),
                        "schema_name": n.get("schema"),
                        "table_name": n.get("alias") or n.get("identifier") or n.get("name"),
                        "description": c.get("description"),
                        "resource_type": n.get("resource_type"),
                        "generated_at": self.stamp,
                    }
                )
        return self._done(rows, "dbt_columns")

    def exposures(self) -> list[dict[str, Any]]:
        rows = []
        for n in self._of("exposures"):
            owner = n.get("owner") or {}
            row = self._common(n)
            extra = {k: n.get(k) for k in ("maturity", "type", "url", "label")}
            rows.append(row | extra | {"owner_email": owner.get("email"), "owner_name": owner.get("name"), "raw_queries": row["meta"].get("raw_queries"), "depends_on_columns": row["meta"].get("depends_on_columns")})
        return self._done(rows, "dbt_exposures")

    def metrics(self) -> list[dict[str, Any]]:
        keys = ("label", "model", "type", "sql", "timestamp", "filters", "time_grains", "dimensions")
        return self._done([self._common(n) | {k: n.get(k) for k in keys} for n in self._of("metrics")], "dbt_metrics")

    def group_rows(self) -> list[dict[str, Any]]:
        rows = []
        for g in self._of("groups"):
            owner = g.get("owner") or {}
            rows.append({"unique_id": g.get("unique_id"), "name": g.get("name"), "owner_email": owner.get("email"), "owner_name": owner.get("name"), "generated_at": self.stamp})
        return self._done(rows, "dbt_groups")

    def tables(self, strategy: str = "enriched_only") -> dict[str, list[dict[str, Any]]]:
        return {
            "dbt_models": self.models(),
            "dbt_snapshots": self.models("snapshot"),
            "dbt_seeds": self.seeds(),
            "dbt_sources": self.sources(),
            "dbt_tests": self.tests(),
            "dbt_columns": self.columns(strategy),
            "dbt_exposures": self.exposures(),
            "dbt_metrics": self.metrics(),
            "dbt_groups": self.group_rows(),
        }


def rows_affected(value: Any) -> int | None:
    """As a number; '-1' and null are unknown."""
    if value is None or str(value) == "-1":
        return None
    return int(value)


def run_result_rows(results: Mapping[str, Any], manifest: Mapping[str, Any], now: datetime, full_refresh: bool = False) -> list[dict[str, Any]]:
    invocation = (results.get("metadata") or {}).get("invocation_id")
    nodes = manifest.get("nodes") or {}
    out = []
    for r in results.get("results") or ():
        node = nodes.get(r.get("unique_id")) or {}
        answer = r.get("adapter_response") or {}
        timing = {t["name"]: t for t in r.get("timing") or () if isinstance(t, Mapping) and "name" in t}
        config = node.get("config") or {}
        row = {
            "model_execution_id": f"{invocation}.{r.get('unique_id')}",
            "unique_id": r.get("unique_id"),
            "invocation_id": invocation,
            "generated_at": now.strftime("%Y-%m-%d %H:%M:%S"),
            "name": node.get("name"),
            "resource_type": node.get("resource_type"),
            "rows_affected": rows_affected(answer.get("rows_affected")),
            "full_refresh": full_refresh,
            "compiled_code": r.get("compiled_code") or node.get("compiled_code"),
            "query_id": answer.get("query_id"),
            "materialization": config.get("materialized"),
            "adapter_response": answer,
            "group_name": config.get("group"),
        } | {k: r.get(k) for k in ("message", "status", "execution_time", "failures", "thread_id")}
        for phase in ("execute", "compile"):
            for edge in ("started_at", "completed_at"):
                row[f"{phase}_{edge}"] = timing.get(phase, {}).get(edge)
        out.append(row)
    return out


def source_freshness_rows(sources: Mapping[str, Any], now: datetime) -> list[dict[str, Any]]:
    invocation = (sources.get("metadata") or {}).get("invocation_id")
    out = []
    for r in sources.get("results") or ():
        criteria = r.get("criteria") or {}
        failed = r.get("status") == "runtime error"
        timing = {t["name"]: t for t in r.get("timing") or ()}
        row = {
            "source_freshness_execution_id": f"{invocation}.{r.get('unique_id')}",
            "unique_id": r.get("unique_id"),
            "generated_at": now.strftime("%Y-%m-%d %H:%M:%S"),
            "status": r.get("status"),
            "error": r.get("error"),
            "invocation_id": invocation,
        }
        if not failed:
            row |= {k: r.get(k) for k in ("max_loaded_at", "snapshotted_at", "max_loaded_at_time_ago_in_s")}
            row |= {"warn_after": criteria.get("warn_after"), "error_after": criteria.get("error_after"), "filter": criteria.get("filter")}
            for phase in ("execute", "compile"):
                for edge in ("started_at", "completed_at"):
                    row[f"{phase}_{edge}"] = timing.get(phase, {}).get(edge)
        out.append(row)
    return out


# Environment variables that tell who runs the job, and their names for it.
ORCHESTRATORS = {
    "airflow": ("AIRFLOW_CTX_DAG_ID", "AIRFLOW_CTX_DAG_ID", "AIRFLOW_CTX_DAG_RUN_ID"),
    "dbt_cloud": ("DBT_CLOUD_PROJECT_ID", "DBT_CLOUD_JOB_ID", "DBT_CLOUD_RUN_ID"),
    "github_actions": ("GITHUB_ACTIONS", "GITHUB_WORKFLOW", "GITHUB_RUN_ID"),
}


def invocation_row(results: Mapping[str, Any], environment: Mapping[str, str], variables: Mapping[str, Any], now: datetime) -> dict[str, Any]:
    """One row on who ran what: the job is read from variables, else from the orchestrator's environment."""
    meta, args = results.get("metadata") or {}, results.get("args") or {}
    who = variables.get("orchestrator") or next((n for n, (mark, _, _) in ORCHESTRATORS.items() if environment.get(mark)), None)
    _, job, run = ORCHESTRATORS.get(who, ("", "", ""))
    url = variables.get("job_url")
    run_id = variables.get("job_run_id") or environment.get(run)
    server, repository = environment.get("GITHUB_SERVER_URL"), environment.get("GITHUB_REPOSITORY")
    run_url = variables.get("job_run_url") or (f"{server}/{repository}/actions/runs/{run_id}" if who == "github_actions" and server and repository else None)
    return {
        "invocation_id": meta.get("invocation_id"),
        "generated_at": now.strftime("%Y-%m-%d %H:%M:%S"),
        "run_started_at": meta.get("generated_at"),
        "command": args.get("which"),
        "dbt_version": meta.get("dbt_version"),
        "full_refresh": bool(args.get("full_refresh")),
        "vars": dict(variables),
        "target_name": args.get("target"),
        "threads": args.get("threads"),
        "selected": _clean(args.get("select")),
        "orchestrator": who,
        "job_id": variables.get("job_id") or environment.get(job),
        "job_name": variables.get("job_name"),
        "job_run_id": run_id,
        "job_url": url,
        "job_run_url": run_url,
        "env": variables.get("env"),
        "git_sha": variables.get("git_sha") or environment.get("GITHUB_SHA"),
    }


def load(store: ParquetTable, rows: list[dict[str, Any]], schema: str, key: str = "unique_id", method: str = "diff") -> str:
    """Bring a metadata table up to date: append, replace, or only what differs by metadata_hash.

    Returns 'unchanged', 'appended', 'replaced' or 'updated'. Equal content is not written at all.
    """
    spark: SparkSession = store.spark
    new = constant(spark, rows, schema)
    if method == "append":
        store.append(new)
        return "appended"
    if method == "replace":
        store.replace(new)
        return "replaced"
    old = store.read()
    gone = old.join(new.select("metadata_hash").distinct(), "metadata_hash", "left_anti")
    added = new.join(old.select("metadata_hash").distinct(), "metadata_hash", "left_anti").select(*new.columns)
    if gone.isEmpty() and added.isEmpty():
        return "unchanged"
    kept = old.join(new.select("metadata_hash").distinct(), "metadata_hash", "left_semi").select(*old.columns)
    store.replace(kept.unionByName(added, allowMissingColumns=True))
    return "updated"


def hashes(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(artifacts_model, metadata_hash) of all metadata tables."""
    from pyspark.sql import functions as F

    out = None
    for name, df in tables.items():
        part = df.select(F.lit(name).alias("artifacts_model"), "metadata_hash")
        out = part if out is None else out.unionByName(part)
    return out

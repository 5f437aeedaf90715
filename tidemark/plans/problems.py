"""The queries of the general data-upkeep problems, over their whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text_time import clean_id, instant_text, utc_instant
from tidemark.operators import hierarchy, history, once, orphans, regular_grid, snapshot_diff, spikes
from tidemark.session import cut, table

SERIES = ["full_table_name", "column_name", "metric_name", "dimension_value"]


# 1. Irregular readings onto a regular grid


def _grid(spark: SparkSession, d: str, statuses: tuple[str, ...]) -> DataFrame:
    m = table(spark, d, "data_monitoring_metrics")
    filled = regular_grid.cells(
        m,
        series=[F.col(c) for c in SERIES],
        start=F.col("bucket_start"),
        end=F.col("bucket_end"),
        value=F.col("metric_value"),
        hours=F.col("bucket_duration_hours"),
        version=F.col("updated_at"),
    )
    return regular_grid.regular_grid(filled, statuses)


def _named(grid: DataFrame, *rest) -> DataFrame:
    return grid.select(
        *[F.coalesce(F.col("series")[i], F.lit("")).alias(c) for i, c in enumerate(SERIES)],
        instant_text(regular_grid.period_start(F.col("hours"), F.col("period"))).alias("bucket_start"),
        *rest,
    )


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _named(_grid(spark, d, (regular_grid.FILLED, regular_grid.UNSUPPORTED)))


def p1_grid(spark: SparkSession, d: str) -> DataFrame:
    """The whole grid with the observed, filled and unsupported cells."""
    return _named(_grid(spark, d, (regular_grid.OBSERVED, regular_grid.FILLED, regular_grid.UNSUPPORTED)), "value", "status")


def p1_observed(spark: SparkSession, d: str) -> DataFrame:
    """The observed cells of the grid with their values."""
    return _named(_grid(spark, d, (regular_grid.OBSERVED,)), "value")


P1_FOUND_SQL = """
WITH r AS (
  SELECT full_table_name t, column_name c, metric_name m, dimension_value v, metric_value x, bucket_duration_hours h,
         CAST(epoch_us(bucket_start) AS BIGINT) s, CAST(epoch_us(bucket_end) AS BIGINT) e
  FROM data_monitoring_metrics),
d AS (
  SELECT t, c, m, v, arg_max(h, n * 1000000 - h) h
  FROM (SELECT t, c, m, v, h, count(*) n FROM r WHERE h > 0 GROUP BY ALL) GROUP BY t, c, m, v),
k AS (
  SELECT d.t, d.c, d.m, d.v, d.h,
         CAST(floor((s0 + floor((e0 - s0) / 2) - 345600000000.0) / (d.h * 3600000000.0)) AS BIGINT) p
  FROM (SELECT r.t, r.c, r.m, r.v, d.h, r.x,
               coalesce(r.s, r.e - d.h * 3600000000) s0, coalesce(r.e, r.s + d.h * 3600000000) e0
        FROM r JOIN d ON r.t IS NOT DISTINCT FROM d.t AND r.c IS NOT DISTINCT FROM d.c
          AND r.m IS NOT DISTINCT FROM d.m AND r.v IS NOT DISTINCT FROM d.v) d
  WHERE x IS NOT NULL),
f AS (SELECT DISTINCT * FROM k),
g AS (SELECT t, c, m, v, h, unnest(range(min(p), max(p) + 1)) p FROM f GROUP BY t, c, m, v, h)
SELECT coalesce(g.t, '') full_table_name, coalesce(g.c, '') column_name, coalesce(g.m, '') metric_name,
       coalesce(g.v, '') dimension_value,
       strftime(TIMESTAMP '1970-01-05 00:00:00' + to_hours(CAST(g.p * g.h AS BIGINT)), '%Y-%m-%d %H:%M:%S') bucket_start
FROM g LEFT JOIN f ON g.t IS NOT DISTINCT FROM f.t AND g.c IS NOT DISTINCT FROM f.c AND g.m IS NOT DISTINCT FROM f.m
  AND g.v IS NOT DISTINCT FROM f.v AND g.p = f.p
WHERE f.p IS NULL
"""

P1_OBSERVED_SQL = (
    P1_FOUND_SQL[: P1_FOUND_SQL.index("f AS (SELECT DISTINCT")]
    .replace("metric_value x,", "metric_value x, updated_at w,")
    .replace("r.x,", "r.x, r.w,")
    .replace("SELECT d.t, d.c, d.m, d.v, d.h,", "SELECT d.t, d.c, d.m, d.v, d.h, d.x, d.w,")
    + """f AS (SELECT *, row_number() OVER (PARTITION BY t, c, m, v, p ORDER BY w DESC NULLS LAST, x DESC) n FROM k WHERE p IS NOT NULL)
SELECT coalesce(t, '') full_table_name, coalesce(c, '') column_name, coalesce(m, '') metric_name, coalesce(v, '') dimension_value,
       strftime(TIMESTAMP '1970-01-05 00:00:00' + to_hours(CAST(p * h AS BIGINT)), '%Y-%m-%d %H:%M:%S') bucket_start, x "value"
FROM f WHERE n = 1"""
)


# 2. References to records that do not exist


def _messages(spark: SparkSession, d: str) -> DataFrame:
    """(message, field, key, at) of every reference, at being the message's earliest generated_at; a message
    that was sent with several pairs of references repeats the one that stayed the same."""
    rows = table(spark, d, "dbt_run_results").select(
        clean_id("model_execution_id").alias("message"),
        clean_id("unique_id").alias("unique_id"),
        clean_id("invocation_id").alias("invocation_id"),
        utc_instant("generated_at").alias("generated_at"),
    )
    # Duplicates fall together before the shuffle; a message may still have very many references, so they
    # are not gathered: its earliest time is joined to them (a skewed message is split by the join).
    pairs = (
        rows.filter(F.col("message").isNotNull())
        .groupBy("message", "unique_id", "invocation_id")
        .agg(F.min("generated_at").alias("seen"))
    )
    first = pairs.groupBy(F.col("message").alias("_message")).agg(F.min("seen").alias("at"))
    fields = F.array(
        F.struct(F.lit("unique_id").alias("field"), F.when(F.col("unique_id").startswith("model."), F.col("unique_id")).alias("key")),
        F.struct(F.lit("invocation_id").alias("field"), F.when(F.col("invocation_id") != "", F.col("invocation_id")).alias("key")),
    )
    return (
        pairs.join(first.hint("merge"), F.col("message") == F.col("_message"))
        .select("message", "at", F.explode(fields).alias("f"))
        .select("message", "at", "f.field", "f.key")
        .filter(F.col("key").isNotNull())
    )


def _existence(spark: SparkSession, d: str) -> DataFrame:
    """(target, key, first, last): the one span in which a key counts as existing. Invocations count from a day before they
    came, for good; models from 14 days before their first to 14 days after their last upload."""
    invocations = table(spark, d, "dbt_invocations").select(clean_id("invocation_id").alias("key"), "created_at")
    came = invocations.groupBy("key").agg(F.min("created_at").alias("came")).select(
        F.lit("invocation_id").alias("target"),
        "key",
        F.expr("came - INTERVAL 1 DAY").cast("timestamp_ntz").alias("first"),
        F.lit(None).cast("timestamp_ntz").alias("last"),
    )
    models = table(spark, d, "dbt_models").select(clean_id("unique_id").alias("key"), utc_instant("generated_at").alias("seen"))
    known = models.filter("seen IS NOT NULL").groupBy("key").agg(F.min("seen").alias("a"), F.max("seen").alias("b")).select(
        F.lit("unique_id").alias("target"), "key", F.expr("a - INTERVAL 14 DAY").alias("first"), F.expr("b + INTERVAL 14 DAY").alias("last")
    )
    return came.unionByName(known)


def _broken(spark: SparkSession, d: str) -> DataFrame:
    """(message, at, field, key, seen) of the broken references."""
    # The messages feed the ledger and are looked up again for the orphans: one scan, and one join.
    references = cut(_messages(spark, d))
    deltas = orphans.reference_deltas(references.select(F.col("field").alias("target"), "key", "at", F.lit(1).alias("delta")))
    ledger = orphans.apply_deltas(None, deltas, orphans.existence_deltas(_existence(spark, d)))
    lost = orphans.orphans(ledger).select(
        F.col("target").alias("_target"), F.col("key").alias("_key"), F.col("at").alias("_at"), "seen"
    )
    on = (
        (F.col("field") == F.col("_target")) & (F.col("key") == F.col("_key")) & F.col("at").eqNullSafe(F.col("_at"))
    )
    return references.join(lost, on).dropDuplicates(["message", "field", "key"])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _broken(spark, d).select(F.col("message").alias("model_execution_id"), F.col("field").alias("ref_field")).distinct()


def p2_current(spark: SparkSession, d: str) -> DataFrame:
    """The orphan report after a second batch of deltas: keys that results refer to and that no longer, or never, exist.

    The first batch are results delivered before 2024-01-15 with all models and invocations. The second brings
    the later results and withdraws the models whose last upload is older than 14 days before the newest one,
    the invocations without a start, and the references of results that were skipped.
    """
    split = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    rows = table(spark, d, "dbt_run_results")
    pairs = F.array(
        F.struct(F.lit("unique_id").alias("target"), F.when(clean_id("unique_id").startswith("model."), clean_id("unique_id")).alias("key")),
        F.struct(F.lit("invocation_id").alias("target"), clean_id("invocation_id").alias("key")),
    )
    refs = rows.select("created_at", "status", F.explode(pairs).alias("r")).select("created_at", "status", "r.*", F.lit(None).cast("timestamp_ntz").alias("at"))
    early, late = refs.filter(F.col("created_at") < split), refs.filter(F.col("created_at") >= split)
    plus, minus = F.lit(1).alias("delta"), F.lit(-1).alias("delta")

    seen = table(spark, d, "dbt_models").select(clean_id("unique_id").alias("key"), utc_instant("generated_at").alias("seen"))
    last = seen.filter("seen IS NOT NULL").groupBy("key").agg(F.max("seen").alias("last_seen"))
    newest = last.agg(F.max("last_seen").alias("newest"))
    models = last.select(F.lit("unique_id").alias("target"), "key", F.lit(None).cast("timestamp_ntz").alias("at"), "last_seen")
    gone = models.join(F.broadcast(newest), F.col("last_seen") < F.expr("newest - INTERVAL 14 DAY"))
    runs = table(spark, d, "dbt_invocations").groupBy(clean_id("invocation_id").alias("key")).agg(F.max("run_started_at").alias("started"))
    runs = runs.select(F.lit("invocation_id").alias("target"), "key", F.lit(None).cast("timestamp_ntz").alias("at"), "started")

    cols = [*orphans.LEDGER, "delta"]
    every = models.select("target", "key", "at", plus).unionByName(runs.select("target", "key", "at", plus)).filter("key <> ''")
    less = gone.select("target", "key").unionByName(runs.filter("started IS NULL").select("target", "key")).filter("key <> ''")
    less = less.select("target", "key", split.alias("at"), minus)
    before = orphans.apply_deltas(None, orphans.reference_deltas(early.select("target", "key", "at", plus)), every.select(*cols))
    withdrawn = refs.filter("status = 'skipped' AND created_at IS NOT NULL").select("target", "key", "at", minus)
    more = orphans.reference_deltas(late.select("target", "key", "at", plus).unionByName(withdrawn))
    found = orphans.current_orphans(orphans.apply_deltas(before, more, less.select(*cols)))
    return found.select(F.col("target").alias("ref_field"), "key", F.col("refs").cast("bigint").alias("references"), F.col("seen").alias("existed"))


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    """Broken references per referenced table and month of the message's earliest generated_at."""
    target = F.when(F.col("field") == "unique_id", "dbt_models").otherwise("dbt_invocations")
    return (
        _broken(spark, d)
        .select("message", target.alias("referenced_table"), F.date_format("at", "yyyy-MM").alias("month"), "seen")
        .groupBy("referenced_table", "month")
        .agg(
            F.count(F.lit(1)).alias("broken_references"),
            F.sum(F.when(F.col("seen"), 0).otherwise(1)).cast("bigint").alias("never_existed"),
        )
    )


_SQL_TIME = "CAST(timezone('UTC', TRY_CAST(CASE WHEN regexp_matches({0}, '(Z|[+-][0-9][0-9]:[0-9][0-9])$') THEN {0} ELSE {0} || 'Z' END AS TIMESTAMPTZ)) AS TIMESTAMP)"
_P2_CTES = f"""
WITH r AS (
  SELECT lower(regexp_replace(model_execution_id, '^\\s+|\\s+$', '', 'g')) id,
         lower(regexp_replace(unique_id, '^\\s+|\\s+$', '', 'g')) u,
         lower(regexp_replace(invocation_id, '^\\s+|\\s+$', '', 'g')) i,
         {_SQL_TIME.format('trim(generated_at)')} g
  FROM dbt_run_results WHERE model_execution_id IS NOT NULL),
m AS (SELECT id, min(g) t FROM r GROUP BY id),
ref AS (SELECT DISTINCT r.id, m.t, 'invocation_id' f, i k FROM r JOIN m ON r.id = m.id WHERE i <> ''
        UNION SELECT DISTINCT r.id, m.t, 'unique_id', u FROM r JOIN m ON r.id = m.id WHERE starts_with(u, 'model.')),
inv AS (SELECT lower(regexp_replace(invocation_id, '^\\s+|\\s+$', '', 'g')) k, min(created_at) c FROM dbt_invocations GROUP BY 1),
mo AS (SELECT lower(regexp_replace(unique_id, '^\\s+|\\s+$', '', 'g')) k, min({_SQL_TIME.format('trim(generated_at)')}) a,
              max({_SQL_TIME.format('trim(generated_at)')}) b FROM dbt_models GROUP BY 1),
bad AS (SELECT ref.*, coalesce(inv.k, mo.k) IS NOT NULL seen FROM ref LEFT JOIN inv ON ref.k = inv.k AND f = 'invocation_id'
  LEFT JOIN mo ON ref.k = mo.k AND f = 'unique_id'
  WHERE (f = 'invocation_id' AND (inv.k IS NULL OR inv.c > t + INTERVAL 1 DAY))
     OR (f = 'unique_id' AND (mo.k IS NULL OR t < a - INTERVAL 14 DAY OR t > b + INTERVAL 14 DAY)))
"""
P2_FOUND_SQL = _P2_CTES + "SELECT DISTINCT id model_execution_id, f ref_field FROM bad"
P2_REPORT_SQL = (
    _P2_CTES
    + """SELECT CASE f WHEN 'unique_id' THEN 'dbt_models' ELSE 'dbt_invocations' END referenced_table,
  strftime(t, '%Y-%m') "month", count(*) broken_references,
  CAST(sum(CASE WHEN seen THEN 0 ELSE 1 END) AS BIGINT) never_existed FROM bad GROUP BY 1, 2"""
)

P2_CURRENT_SQL = f"""
WITH r AS (
  SELECT lower(regexp_replace(unique_id, '^\\s+|\\s+$', '', 'g')) u, lower(regexp_replace(invocation_id, '^\\s+|\\s+$', '', 'g')) i
  FROM dbt_run_results WHERE created_at IS NOT NULL AND status IS DISTINCT FROM 'skipped'),
ref AS (SELECT 'unique_id' f, u k, count(*) n FROM r WHERE starts_with(u, 'model.') GROUP BY 2
        UNION ALL SELECT 'invocation_id', i, count(*) FROM r WHERE i <> '' GROUP BY 2),
mo AS (SELECT lower(regexp_replace(unique_id, '^\\s+|\\s+$', '', 'g')) k, max({_SQL_TIME.format('trim(generated_at)')}) b
       FROM dbt_models GROUP BY 1 HAVING b IS NOT NULL),
inv AS (SELECT lower(regexp_replace(invocation_id, '^\\s+|\\s+$', '', 'g')) k, max(run_started_at) b FROM dbt_invocations GROUP BY 1),
ex AS (SELECT 'unique_id' f, k, b >= (SELECT max(b) FROM mo) - INTERVAL 14 DAY there FROM mo
       UNION ALL SELECT 'invocation_id', k, b IS NOT NULL FROM inv)
SELECT ref.f ref_field, ref.k "key", ref.n "references", ex.k IS NOT NULL existed
FROM ref LEFT JOIN ex ON ref.f = ex.f AND ref.k = ex.k WHERE NOT coalesce(ex.there, false)
"""


# 3. Messages delivered more than once


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    kept = _p3_kept(table(spark, d, "dbt_run_results").select("model_execution_id", "generated_at"))
    return kept.filter(F.col("copies") > 1).select(
        clean_id("model_execution_id").alias("model_execution_id"), instant_text(utc_instant("generated_at")).alias("generated_at")
    )


def _p3_kept(rows: DataFrame) -> DataFrame:
    return once.keep_one(rows, clean_id("model_execution_id"), [utc_instant("generated_at").desc_nulls_last()])


def p3_kept(spark: SparkSession, d: str) -> DataFrame:
    """Every message once, as delivered last, with the number of its copies."""
    kept = _p3_kept(table(spark, d, "dbt_run_results").filter(F.col("model_execution_id").isNotNull()))
    return kept.select(
        clean_id("model_execution_id").alias("model_execution_id"),
        instant_text(utc_instant("generated_at")).alias("generated_at"),
        F.col("copies").cast("bigint").alias("copies"),
    )


def p3_new(spark: SparkSession, d: str) -> DataFrame:
    """The messages of the batch since 2024-01-15 that none of the earlier ones holds, each once."""
    rows = table(spark, d, "dbt_run_results").select("model_execution_id", "generated_at", "created_at")
    day = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    batch = rows.filter((F.col("created_at") >= day) & F.col("model_execution_id").isNotNull())
    stored, identifier = rows.filter(F.col("created_at") < day), clean_id("model_execution_id")
    fresh = once.new_only(batch, identifier, stored, identifier, [utc_instant("generated_at").desc_nulls_last()])
    return fresh.select(identifier.alias("model_execution_id"), instant_text(utc_instant("generated_at")).alias("generated_at"))


_P3_SQL = f"""
SELECT lower(regexp_replace(model_execution_id, '^\\s+|\\s+$', '', 'g')) model_execution_id,
       strftime(max({_SQL_TIME.format('trim(generated_at)')}), '%Y-%m-%d %H:%M:%S') generated_at, count(*) copies
FROM dbt_run_results WHERE model_execution_id IS NOT NULL GROUP BY 1
"""
P3_KEPT_SQL = _P3_SQL
P3_NEW_SQL = f"""
WITH r AS (SELECT lower(regexp_replace(model_execution_id, '^\\s+|\\s+$', '', 'g')) id, created_at < TIMESTAMP '2024-01-15 00:00:00' old,
  {_SQL_TIME.format('trim(generated_at)')} g FROM dbt_run_results WHERE model_execution_id IS NOT NULL AND created_at IS NOT NULL)
SELECT id model_execution_id, strftime(max(g), '%Y-%m-%d %H:%M:%S') generated_at FROM r GROUP BY id HAVING NOT bool_or(old)
"""
P3_FOUND_SQL = f"SELECT model_execution_id, generated_at FROM ({_P3_SQL}) WHERE copies > 1"


# 4. Implausible spikes in measurements


def p4_flags(spark: SparkSession, d: str) -> DataFrame:
    """Every wrong reading with what is wrong with it."""
    return spikes.implausible(
        table(spark, d, "data_monitoring_metrics"),
        identifier=F.col("id"),
        series=[F.col(c) for c in SERIES],
        start=F.col("bucket_start"),
        at=F.col("bucket_end"),
        hours=F.col("bucket_duration_hours"),
        value=F.col("metric_value"),
        version=F.col("updated_at"),
        metric=F.coalesce("metric_type", "metric_name"),
    )


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_flags(spark, d).select("id")


def p4_limits(spark: SparkSession, d: str) -> DataFrame:
    """The readings beyond what their metric can be."""
    return p4_flags(spark, d).filter(F.col("kind") == spikes.LIMIT).select("id")


def p4_stuck(spark: SparkSession, d: str) -> DataFrame:
    """The readings in stuck runs that are within their limits."""
    return p4_flags(spark, d).filter(F.col("kind") == spikes.RUN).select("id")


_P4_CTES = """
WITH l AS (
  SELECT id, full_table_name t, column_name c, metric_name m, dimension_value d, bucket_end e, metric_value v,
    lower(coalesce(metric_type, metric_name, '')) k,
    row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, metric_value DESC, bucket_end DESC) nth
  FROM data_monitoring_metrics WHERE id IS NOT NULL AND metric_value IS NOT NULL AND NOT isnan(metric_value) AND bucket_end IS NOT NULL),
r AS (
  SELECT *, coalesce((regexp_matches(k, 'percent') OR regexp_matches(k, 'count|length|freshness|deviation|variance|duration|^dimension')) AND v < 0
      OR regexp_matches(k, 'percent') AND v > 100, FALSE) beyond,
    v IS DISTINCT FROM lag(v) OVER w fresh, row_number() OVER w n
  FROM l WHERE nth = 1 WINDOW w AS (PARTITION BY t, c, m, d ORDER BY e, id)),
g AS (SELECT *, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY t, c, m, d ORDER BY n) g FROM r),
q AS (SELECT *, count(*) OVER (PARTITION BY t, c, m, d, g) >= 6 long FROM g),
z AS (SELECT *, count(*) OVER s n_all, sum(CASE WHEN long THEN 0 ELSE 1 END) OVER s varied,
    sum(CASE WHEN long OR fresh THEN 0 ELSE 1 END) OVER s repeated FROM q WINDOW s AS (PARTITION BY t, c, m, d))
"""
P4_LIMITS_SQL = _P4_CTES + "SELECT id FROM r WHERE beyond"
P4_STUCK_SQL = _P4_CTES + "SELECT id FROM z WHERE long AND NOT beyond AND varied >= 0.4 * n_all AND repeated <= 0.3 * varied"


# 5. Parent-child links to full hierarchies


def _models(spark: SparkSession, d: str) -> DataFrame:
    """(node, parents) of each model's latest row."""
    rows = table(spark, d, "dbt_models").select(
        clean_id("unique_id").alias("node"), utc_instant("generated_at").alias("at"), "depends_on_nodes"
    )
    latest = (
        rows.filter(F.col("node").isNotNull())
        .groupBy("node")
        .agg(F.max(F.struct("at", F.coalesce("depends_on_nodes", F.lit("")).alias("depends_on_nodes"))).alias("r"))
    )
    return latest.select("node", hierarchy.listed_parents(F.col("r.depends_on_nodes")).alias("parents"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    found = hierarchy.hierarchy(_models(spark, d))
    return found.select(F.col("node").alias("unique_id"), F.col("root").alias("root_id"), F.col("depth").cast("bigint").alias("depth"))


def p5_paths(spark: SparkSession, d: str) -> DataFrame:
    """The longest path from each root to each model."""
    found = hierarchy.hierarchy(_models(spark, d), paths=True).filter("depth >= 0")
    return found.select(
        F.col("node").alias("unique_id"), F.col("root").alias("root_id"), F.concat_ws(" > ", "path").alias("path"), F.col("depth").cast("bigint").alias("depth")
    )


def p5_descendants(spark: SparkSession, d: str) -> DataFrame:
    nodes = _models(spark, d)
    pairs = hierarchy.descendants(nodes, hierarchy.hierarchy(nodes))
    return pairs.select(F.col("node").alias("unique_id"), F.col("descendant").alias("descendant_id"), F.col("depth").cast("bigint").alias("depth"))


_P5_CTES = f"""
WITH RECURSIVE l AS (
  SELECT u, list_distinct(list_transform(regexp_extract_all(x, '["'']([^"'']*)["'']', 1), lambda y: lower(trim(y)))) p
  FROM (SELECT lower(trim(unique_id)) u, max(ROW({_SQL_TIME.format('trim(generated_at)')}, coalesce(depends_on_nodes, ''))) r
        FROM dbt_models WHERE unique_id IS NOT NULL GROUP BY 1) q, LATERAL (SELECT r[2] x)),
e AS (SELECT DISTINCT u child, p parent FROM (SELECT u, unnest(p) p FROM l) WHERE p IN (SELECT u FROM l)),
up AS (
  SELECT child u, parent a FROM e
  UNION
  SELECT up.u, e.parent FROM up JOIN e ON up.a = e.child),
bad AS (SELECT DISTINCT u FROM up WHERE a IN (SELECT u FROM up WHERE u = a)),
"""
P5_FOUND_SQL = (
    _P5_CTES
    + """d AS (
  SELECT u, u r, CAST(0 AS BIGINT) n FROM l WHERE u NOT IN (SELECT child FROM e)
  UNION
  SELECT e.child, d.r, d.n + 1 FROM d JOIN e ON e.parent = d.u WHERE e.child NOT IN (SELECT u FROM bad))
SELECT u unique_id, r root_id, max(n) depth FROM d GROUP BY u, r
UNION ALL SELECT u, 'cycle', CAST(-1 AS BIGINT) FROM bad"""
)

P5_PATHS_SQL = (
    _P5_CTES
    + """d AS (
  SELECT u, u r, [u] p FROM l WHERE u NOT IN (SELECT child FROM e)
  UNION ALL
  SELECT e.child, d.r, list_append(d.p, e.child) FROM d JOIN e ON e.parent = d.u WHERE e.child NOT IN (SELECT u FROM bad)),
b AS (SELECT u, r, p, row_number() OVER (PARTITION BY u, r ORDER BY len(p) DESC, p DESC) k FROM d)
SELECT u unique_id, r root_id, array_to_string(p, ' > ') path, CAST(len(p) - 1 AS BIGINT) depth FROM b WHERE k = 1"""
)
P5_DESCENDANTS_SQL = (
    _P5_CTES
    + """d AS (
  SELECT parent a, child u, CAST(1 AS BIGINT) n FROM e WHERE child NOT IN (SELECT u FROM bad)
  UNION
  SELECT d.a, e.child, d.n + 1 FROM d JOIN e ON e.parent = d.u WHERE e.child NOT IN (SELECT u FROM bad))
SELECT a unique_id, u descendant_id, max(n) depth FROM d GROUP BY a, u"""
)


# 6. History of changing entity attributes


def _p6(spark: SparkSession, d: str) -> dict:
    return {
        "df": table(spark, d, "dbt_models"),
        "key": clean_id("unique_id"),
        "at": utc_instant("generated_at"),
        "attributes": {"checksum": F.lower(F.trim("checksum")), "owner": history.name_set(F.col("owner"))},
    }


def p6_history(spark: SparkSession, d: str) -> DataFrame:
    """Every version of every model with its checksum and owners."""
    return history.attribute_history(**_p6(spark, d)).select(
        F.col("key").alias("unique_id"),
        "checksum",
        "owner",
        instant_text("valid_from").alias("valid_from"),
        F.coalesce(instant_text("valid_to"), F.lit("")).alias("valid_to"),
    )


def p6_changes(spark: SparkSession, d: str) -> DataFrame:
    """Inserted, changed and deleted models; one is deleted if it was last seen 14 days before the newest upload."""
    newest = table(spark, d, "dbt_models").agg(F.max(utc_instant("generated_at"))).first()[0]
    as_of = F.lit(newest).cast("timestamp_ntz") - F.expr("INTERVAL 14 DAY")
    found = history.attribute_events(**_p6(spark, d), as_of=as_of)
    return found.select(F.col("key").alias("unique_id"), "change", instant_text("at").alias("at"), "checksum", "owner")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_history(spark, d).select("unique_id", "valid_from", "valid_to")


_P6_CTES = f"""
WITH o AS (
  SELECT DISTINCT lower(trim(unique_id)) u, {_SQL_TIME.format('trim(generated_at)')} g, lower(trim(checksum)) c,
    CASE WHEN owner IS NOT NULL THEN CAST(to_json(list_sort(list_distinct(list_filter(list_transform(
      CAST(from_json(owner, '["VARCHAR"]') AS VARCHAR[]), lambda x: lower(trim(x))), lambda x: x <> '')))) AS VARCHAR) END w
  FROM dbt_models),
f AS (SELECT u, g, last_value(c IGNORE NULLS) OVER b c, last_value(w IGNORE NULLS) OVER b w,
        row_number() OVER (PARTITION BY u ORDER BY g, c NULLS FIRST, w NULLS FIRST) n
      FROM o WHERE u IS NOT NULL AND g IS NOT NULL
      WINDOW b AS (PARTITION BY u ORDER BY g, c NULLS FIRST, w NULLS FIRST ROWS UNBOUNDED PRECEDING)),
l AS (SELECT *, n = 1 OR c IS DISTINCT FROM lag(c) OVER k OR w IS DISTINCT FROM lag(w) OVER k new, n = max(n) OVER (PARTITION BY u) last
      FROM f WINDOW k AS (PARTITION BY u ORDER BY n)),
v AS (SELECT u unique_id, c checksum, w owner, strftime(g, '%Y-%m-%d %H:%M:%S') valid_from,
        coalesce(strftime(lead(g) OVER (PARTITION BY u ORDER BY n), '%Y-%m-%d %H:%M:%S'), '') valid_to
      FROM l WHERE new)
"""
P6_FOUND_SQL = _P6_CTES + "SELECT unique_id, valid_from, valid_to FROM v"
P6_HISTORY_SQL = _P6_CTES + "SELECT * FROM v"
P6_CHANGES_SQL = (
    _P6_CTES
    + """SELECT u unique_id, CASE WHEN n = 1 THEN 'inserted' ELSE 'changed' END "change", strftime(g, '%Y-%m-%d %H:%M:%S') "at", c checksum, w "owner" FROM l WHERE new
UNION ALL SELECT u, 'deleted', strftime(g, '%Y-%m-%d %H:%M:%S'), c, w FROM l WHERE last AND g < (SELECT max(g) FROM l) - INTERVAL 14 DAY"""
)


# 7. What changed between full snapshots


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    rows = snapshot_diff.snapshot_rows(
        table(spark, d, "schema_columns_snapshot"),
        entity=F.upper(F.trim("full_table_name")),
        day=F.to_date("detected_at"),
        member=F.lower(F.trim("column_name")),
        value=F.upper(F.regexp_replace("data_type", r"\s", "")),
    )
    kind = F.when(F.col("change_kind") == "changed", "type_changed").otherwise(F.concat(F.lit("column_"), F.col("change_kind")))
    return snapshot_diff.snapshot_changes(rows).select(
        F.col("entity").alias("full_table_name"),
        F.col("member").alias("column_name"),
        kind.alias("change_kind"),
        F.date_format("day", "yyyy-MM-dd").alias("detected_on"),
    )


P7_FOUND_SQL = """
WITH s AS (
  SELECT upper(trim(full_table_name)) t, CAST(detected_at AS DATE) d, lower(trim(column_name)) c,
         max(upper(regexp_replace(data_type, '\\s', '', 'g'))) k
  FROM schema_columns_snapshot GROUP BY ALL),
n AS (SELECT t, d, lag(d) OVER (PARTITION BY t ORDER BY d) b FROM (SELECT DISTINCT t, d FROM s)),
cur AS (SELECT s.* FROM s JOIN n ON s.t = n.t AND s.d = n.d WHERE n.b IS NOT NULL),
old AS (SELECT s.t, n.d, s.c, s.k FROM s JOIN n ON s.t = n.t AND s.d = n.b)
SELECT coalesce(cur.t, old.t) full_table_name, coalesce(cur.c, old.c) column_name,
       CASE WHEN old.t IS NULL THEN 'column_added' WHEN cur.t IS NULL THEN 'column_removed' ELSE 'type_changed' END change_kind,
       strftime(coalesce(cur.d, old.d), '%Y-%m-%d') detected_on
FROM cur FULL JOIN old ON cur.t = old.t AND cur.d = old.d AND cur.c = old.c
WHERE old.t IS NULL OR cur.t IS NULL OR cur.k <> old.k
"""

QUERIES = {
    "p1_found": p1_found,
    "p1_grid": p1_grid,
    "p1_observed": p1_observed,
    "p2_found": p2_found,
    "p2_report": p2_report,
    "p2_current": p2_current,
    "p3_found": p3_found,
    "p3_kept": p3_kept,
    "p3_new": p3_new,
    "p4_found": p4_found,
    "p4_flags": p4_flags,
    "p4_limits": p4_limits,
    "p4_stuck": p4_stuck,
    "p5_found": p5_found,
    "p5_paths": p5_paths,
    "p5_descendants": p5_descendants,
    "p6_found": p6_found,
    "p6_history": p6_history,
    "p6_changes": p6_changes,
    "p7_found": p7_found,
}
ORACLES = {
    "p1_found": P1_FOUND_SQL,
    "p1_observed": P1_OBSERVED_SQL,
    "p2_found": P2_FOUND_SQL,
    "p2_report": P2_REPORT_SQL,
    "p2_current": P2_CURRENT_SQL,
    "p3_found": P3_FOUND_SQL,
    "p3_kept": P3_KEPT_SQL,
    "p3_new": P3_NEW_SQL,
    "p4_limits": P4_LIMITS_SQL,
    "p4_stuck": P4_STUCK_SQL,
    "p5_found": P5_FOUND_SQL,
    "p5_paths": P5_PATHS_SQL,
    "p5_descendants": P5_DESCENDANTS_SQL,
    "p6_found": P6_FOUND_SQL,
    "p6_history": P6_HISTORY_SQL,
    "p6_changes": P6_CHANGES_SQL,
    "p7_found": P7_FOUND_SQL,
}

"""Run history: listing, diff, overrides, incremental recompute, retention. The store is in ``store``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Kinds of entities and the column that identifies them.
ENTITY_IDS = {"models": "model_id", "tables": "table_id", "table_edges": "edge_id", "column_edges": "edge_id", "dq_rules": "rule_id"}


def list_runs(runs: DataFrame, entities: DataFrame, limit: int) -> DataFrame:
    """The newest ``limit`` runs (ties by id) with a count column per kind. ``entities(run_id, kind, ...)``."""
    newest = runs.orderBy(F.desc("timestamp"), "run_id").limit(limit)
    counts = entities.groupBy("run_id").pivot("kind", list(ENTITY_IDS)).agg(F.count(F.lit(1)))
    return newest.join(counts, "run_id", "left").na.fill(0, list(ENTITY_IDS))


def merge_live(stored: DataFrame, live: DataFrame, limit: int) -> DataFrame:
    """The newest runs of both lists; a live row replaces the stored one of its run."""
    both = stored.withColumn("__p", F.lit(1)).unionByName(live.withColumn("__p", F.lit(0)))
    w = Window.partitionBy("run_id").orderBy("__p")
    return both.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn", "__p").orderBy(F.desc("timestamp"), "run_id").limit(limit)


def content_hash(df: DataFrame, key: str, ignore: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """(id, hash) of all columns but the ignored ones, in the order of their names."""
    cols = sorted(c for c in df.columns if c not in ignore)
    return df.select(F.col(key).alias("id"), F.sha1(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})).alias("hash"))


def diff(a: DataFrame, b: DataFrame, key: str, kind: str, ignore: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """(kind, id, change): entities added, removed or changed from ``a`` to ``b``. Ids are unique."""
    x, y = content_hash(a, key, ignore).withColumnRenamed("hash", "ha"), content_hash(b, key, ignore).withColumnRenamed("hash", "hb")
    both = x.join(y, "id", "full_outer")
    change = F.when(F.col("ha").isNull(), "added").when(F.col("hb").isNull(), "removed").when(F.col("ha") != F.col("hb"), "changed")
    return both.select(F.lit(kind).alias("kind"), "id", change.alias("change")).filter("change is not null")


def diff_runs(a: dict[str, DataFrame], b: dict[str, DataFrame]) -> DataFrame:
    """Changes of all kinds of entities; run metadata is no entity."""
    parts = [diff(a[k], b[k], key, k) for k, key in ENTITY_IDS.items() if k in a and k in b]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def apply_overrides(entities: DataFrame, key: Column | str, overrides: DataFrame, fields: list[str]) -> DataFrame:
    """``entities`` with the last write of each (target, field) applied. An edit of another field also
    sets ``review_status`` to Accepted, unless a later write sets that itself. ``key`` is the target id
    (for columns ``table_id || '#' || name``); fields are of string type. ``overrides(seq, target, field, new)``."""
    k = F.col(key) if isinstance(key, str) else key
    known = overrides.filter(F.col("field").isin(fields))
    implied = known.filter("field <> 'review_status'").select("seq", "target", F.lit("review_status").alias("field"), F.lit("Accepted").alias("new")) if "review_status" in fields else None
    log = known.select("seq", "target", "field", "new")
    log = log.unionByName(implied) if implied is not None else log
    last = log.groupBy("target").agg(*[F.max_by(F.struct(F.col("new").alias("v")), F.when(F.col("field") == f, F.col("seq"))).alias(f"__{f}") for f in fields], *[F.max(F.when(F.col("field") == f, F.col("seq"))).alias(f"__n_{f}") for f in fields])
    out = entities.withColumn("__key", k).join(last, F.col("__key") == F.col("target"), "left")
    return out.withColumns({f: F.when(F.col(f"__n_{f}").isNotNull(), F.col(f"__{f}.v")).otherwise(F.col(f)) for f in fields}).select(*entities.columns)


def stale_overrides(overrides: DataFrame, targets: DataFrame) -> DataFrame:
    """A warning per override whose (target, field) is not in ``targets(target, field)``."""
    bad = overrides.join(targets.select("target", "field").distinct(), ["target", "field"], "left_anti")
    # a fixed text
    said = F.concat(F.lit("stale override: target '"), "target", F.lit("' field '"), "field", F.lit("' not found on re-apply"))
    return bad.select("seq", F.lit("warning").alias("severity"), said.alias("message"))


def incremental(models: DataFrame, previous: DataFrame, previous_results: DataFrame, work: Callable[[DataFrame], DataFrame], named: DataFrame | None = None) -> DataFrame:
    """Results of ``models(model_id, hash, ...)``: those whose (model_id, hash) stood in ``previous`` and
    that are not in ``named(model_id)`` keep theirs, ``work`` makes the others'. Equal to a full run if
    ``work`` depends on a model's content alone."""
    same = models.join(previous.select("model_id", "hash"), ["model_id", "hash"], "left_semi").select("model_id")
    if named is not None:
        same = same.join(named.select("model_id"), "model_id", "left_anti")
    redo = models.join(same, "model_id", "left_anti")
    return previous_results.join(same, "model_id", "left_semi").unionByName(work(redo))


# What the retention scrub clears, and to what.
SCRUBBED = {"usages": ("evidence", ""), "dq_rules": ("code_evidence", ""), "calculations": ("expression", ""), "column_edges": ("expression", None)}


def scrub(state: dict[str, DataFrame], local: bool, retain_source: bool) -> dict[str, DataFrame]:
    """``state`` without source snippets, and an info issue that counts them, if the run is local and does
    not retain its sources; otherwise as it is."""
    if not local or retain_source:
        return state
    out, counts = dict(state), None
    for kind, (col, to) in SCRUBBED.items():
        if kind in state:
            n = state[kind].agg(F.count_if(F.coalesce(F.length(col), F.lit(0)) > 0).alias(kind))
            counts = n if counts is None else counts.crossJoin(n)
            out[kind] = state[kind].withColumn(col, F.lit(to).cast("string"))
    names = {"usages": "usages", "dq_rules": "rules", "calculations": "calcs", "column_edges": "edges"}
    if counts is not None:
        have = [k for k in names if k in state]
        # a fixed text
        said = F.concat(F.lit("retention scrub: cleared source snippets in local mode ("), F.concat_ws(", ", *[F.concat(F.lit(names[k] + "="), F.col(k).cast("string")) for k in have]), F.lit("); set retain_source=true to keep them"))
        issue = counts.filter(" or ".join(f"{k} > 0" for k in have)).select(F.lit(None).cast("string").alias("model_id"), F.lit("info").alias("severity"), said.alias("message"))
        out["issues"] = state["issues"].select("model_id", "severity", "message").unionByName(issue) if "issues" in state else issue
    return out

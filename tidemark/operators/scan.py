"""Usage-signal scans of code: table references and column usages, per language.

Each scan takes ``code(model_id, code)`` and gives one of three relations:
references ``(model_id, direction, name)``, usages ``(model_id, element, usage_kind, evidence,
confidence)``, or SAS library names ``(model_id, alias, system)``. Scripts are exploded into statements
or lines; steps and bindings are windows over those of one script, so only rows of one script meet.
Arrays are exploded in the outer form and nulls dropped, since for the inner form the optimiser adds
filters that evaluate all patterns once more. Scripts are dealt to tasks by model, since a few MB of them take
minutes to search; what meets within a script then needs no further shuffle.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.ids import path_stem, path_tail
from tidemark.functions.scratch import spread, written

from . import patterns as P
from .corpus import PY_PLAIN, blank


def _hits(text: Column | str, rx: str, *groups: int) -> Column:
    names = ["m", *[f"g{g}" for g in groups]]
    zipped = F.arrays_zip(*[F.regexp_extract_all(text, F.lit(rx), F.lit(g)) for g in (0, *groups)])
    return F.transform(zipped, lambda z: F.struct(*[z[str(i)].alias(n) for i, n in enumerate(names)]))


def _if_any(text: Column | str, rx: str, signs: dict[str, tuple[str, ...]], rows: Column, kind: str) -> Column:
    """``rows`` of type ``kind`` where the text can match: it holds one of the pattern's signs or, where none are known, is
    searched once; else none. Most texts match few patterns, and ``rows`` searches once for each group."""
    text = F.col(text) if isinstance(text, str) else text
    could = [text.contains(x) for x in signs[rx]] if rx in signs else [text.rlike(rx)]
    return F.when(functools.reduce(operator.or_, could), rows).otherwise(F.array().cast(f"array<{kind}>"))


# ------------------------------------------------------------------------------------------- SAS
def sas_libnames(code: DataFrame) -> DataFrame:
    """Library names; of one alias that stands twice the last is taken."""
    bare = spread(code, "model_id").select("model_id", blank("code", "SAS", strings=False).alias("code"))
    rows = bare.select("model_id", F.posexplode_outer(_hits("code", P.SAS_LIBNAME, 1, 2)).alias("ord", "h")).filter("h is not null")
    return rows.groupBy("model_id", F.col("h.g1").alias("alias")).agg(F.max_by(F.trim("h.g2"), "ord").alias("system"))


def sas_statements(code: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """(model_id, i, stmt, step, step_out): statements without comments and strings. ``step`` is the
    position of the innermost DATA step or CREATE TABLE that is open, null outside; ``step_out`` its
    output. Steps end with RUN or QUIT, or with the script."""
    extra = extra or []
    bare = spread(code, "model_id").select("model_id", *extra, blank("code", "SAS").alias("code"))
    s = bare.select("model_id", *extra, F.posexplode_outer(F.split("code", ";")).alias("i", "stmt")).filter("stmt is not null")
    opened = F.when(F.col("stmt").rlike(P.SAS_OPENERS), F.col("i"))
    w = Window.partitionBy("model_id").orderBy("i")
    s = s.withColumn("__open", F.last(opened, True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    s = s.withColumn("__shut", F.last(F.when(F.col("stmt").rlike(P.SAS_CLOSER), F.col("i")), True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    inside = F.col("__open").isNotNull() & (F.col("__shut").isNull() | (F.col("__open") > F.col("__shut")))
    out = F.coalesce(*[F.nullif(F.regexp_extract("stmt", P.SAS_OPENERS, g), F.lit("")) for g in (1, 2)])
    return s.withColumn("step", F.when(inside, F.col("__open"))).withColumn("__out", F.when(opened.isNotNull(), out)).withColumn("step_out", F.when(inside, F.last("__out", True).over(w.rowsBetween(Window.unboundedPreceding, 0)))).drop("__open", "__shut", "__out")


def _merge_tokens(stmt: Column | str) -> Column:
    """Tables of a MERGE statement, without parenthesised options."""
    body = F.regexp_replace(F.regexp_extract(stmt, P.SAS_MERGE, 1), r"\([^)]*\)", " ")
    return F.filter(F.regexp_extract_all(body, F.lit(r"[a-zA-Z0-9_.]+"), F.lit(0)), lambda t: F.lower(t) != "in")


def sas_references(code: DataFrame) -> DataFrame:
    """Distinct inputs (SET, FROM, DATA=, MERGE) and outputs (DATA, CREATE TABLE, OUTPUT OUT=)."""
    s = sas_statements(code)
    ins = F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all("stmt", F.lit(rx), F.lit(1)) for _, rx in P.SAS_INPUTS], _merge_tokens("stmt"))))
    outs = F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all("stmt", F.lit(rx), F.lit(1)) for rx in P.SAS_OUTPUTS])))
    both = F.concat(F.transform(ins, lambda n: F.struct(F.lit("input").alias("direction"), n.alias("name"))), F.transform(outs, lambda n: F.struct(F.lit("output").alias("direction"), n.alias("name"))))
    return s.select("model_id", F.explode_outer(both).alias("r")).filter("r is not null").select("model_id", "r.direction", "r.name").distinct()


def sas_step_tables(statements: DataFrame) -> DataFrame:
    """(model_id, step, table): the first SET of a step, else FROM, else DATA=, else MERGE, else its output."""
    options = []
    for rank, (_, rx) in enumerate(P.SAS_INPUTS):
        first = F.try_element_at(F.regexp_extract_all("stmt", F.lit(rx), F.lit(1)), F.lit(1))
        options.append(F.struct(F.lit(rank).alias("r"), first.alias("n")))
    options.append(F.struct(F.lit(len(P.SAS_INPUTS)).alias("r"), F.try_element_at(_merge_tokens("stmt"), F.lit(1)).alias("n")))
    options.append(F.struct(F.lit(len(P.SAS_INPUTS) + 1).alias("r"), F.col("step_out").alias("n")))
    # the opener's own words name no input, but a CREATE TABLE's FROM stands in the same statement
    rows = statements.filter("step is not null").select("model_id", "step", "i", F.explode_outer(F.filter(F.array(*options), lambda o: o["n"].isNotNull())).alias("o")).filter("o is not null")
    return rows.groupBy("model_id", "step").agg(F.min_by("o.n", F.struct("o.r", "i")).alias("table"))


def _qualified(table: Column, column: Column) -> Column:
    return F.when(table.isNotNull(), F.concat(table, F.lit("."), column)).otherwise(column)


def sas_usages(code: DataFrame, more: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """Usages of SAS scripts. BY keys are join keys, or aggregated if the script runs MEANS, SUMMARY or
    FREQ; ON keys are cross-system joins with two libraries or more. ORDER BY gives nothing and GROUP BY
    only the grain. ``more``: further (kind, pattern, confidence) rows."""
    flags = spread(code, "model_id").withColumn("__libs", F.size(F.array_distinct(F.regexp_extract_all(blank("code", "SAS", strings=False), F.lit(P.SAS_LIBNAME), F.lit(1))))).withColumn("__agg", blank("code", "SAS").rlike(P.SAS_AGGREGATES))
    # read three times below: hits, step tables and measures
    s = written(sas_statements(flags, ["__libs", "__agg"]), "statements")
    rows = []
    for kind, rx, conf in [*P.SAS_USAGES, *(more or [])]:
        real = {"by": F.when(F.col("__agg"), "aggregated").otherwise("join_key"), "on": F.when(F.col("__libs") >= 2, "cross_system_join").otherwise("join_key")}.get(kind, F.lit(kind))
        rows.append(_if_any(F.lower("stmt") if rx in P.SAS_SIGNS else "stmt", rx, P.SAS_SIGNS, _usage_rows(rx, real, conf), "struct<kind:string,cols:string,evidence:string,conf:string>"))
    hits = s.select("model_id", "step", F.explode_outer(F.flatten(F.array(*rows))).alias("u")).filter("u is not null")
    words = F.array(*[F.lit(w) for w in P.SAS_WORDS])
    hits = hits.withColumn("col", F.explode_outer(F.split("u.cols", r"[,\s]+"))).filter("col <> ''").filter(~F.array_contains(words, F.lower("col")))
    tables = sas_step_tables(s)
    plain = hits.join(tables, ["model_id", "step"], "left").select("model_id", _qualified(F.col("table"), F.col("col")).alias("element"), F.col("u.kind").alias("usage_kind"), F.col("u.evidence").alias("evidence"), F.col("u.conf").alias("confidence"))
    return plain.unionByName(_sas_measures(s, tables, words))


def _usage_rows(rx: str, kind: Column, conf: str) -> Column:
    return F.transform(_hits("stmt", rx, 1), lambda h: F.struct(kind.alias("kind"), h["g1"].alias("cols"), F.trim(h["m"]).alias("evidence"), F.lit(conf).alias("conf")))


def _sas_measures(s: DataFrame, tables: DataFrame, words: Column) -> DataFrame:
    """Columns assigned and kept in one step are its output measures."""
    assigned = s.select("model_id", "step", F.explode_outer(F.regexp_extract_all(F.trim("stmt"), F.lit(P.SAS_ASSIGN), F.lit(1))).alias("col")).filter("col is not null").distinct()
    kept = s.select("model_id", "step", F.explode_outer(F.split(F.trim(F.regexp_extract("stmt", P.SAS_KEEP, 1)), r"\s+")).alias("col")).filter("col is not null").filter("col <> ''").distinct()
    both = assigned.alias("a").join(kept.alias("k"), (F.col("a.model_id") == F.col("k.model_id")) & F.col("a.step").eqNullSafe(F.col("k.step")) & (F.col("a.col") == F.col("k.col"))).select("a.model_id", "a.step", "a.col")
    own = both.filter(~F.array_contains(words, F.lower("col"))).join(tables, ["model_id", "step"], "left")
    return own.select("model_id", _qualified(F.col("table"), F.col("col")).alias("element"), F.lit("output_measure").alias("usage_kind"), F.concat("col", F.lit(" = ... ; keep "), "col").alias("evidence"), F.lit("High").alias("confidence"))


# ---------------------------------------------------------------------------------------- Python
def python_references(code: DataFrame) -> DataFrame:
    """Paths read and written as string arguments; queries are not references."""
    bare = spread(code, "model_id").select("model_id", blank("code", "Python").alias("code"))
    both = F.concat(F.transform(_hits("code", P.PY_READ_ANY, 2), lambda h: F.struct(F.lit("input").alias("direction"), h["g2"].alias("name"))), F.transform(_hits("code", P.PY_WRITE, 2), lambda h: F.struct(F.lit("output").alias("direction"), h["g2"].alias("name"))))
    return bare.select("model_id", F.explode_outer(both).alias("r")).filter("r is not null").select("model_id", "r.direction", "r.name").distinct()


def python_usages(code: DataFrame, more: list[tuple[str, str, int, int, str]] | None = None) -> DataFrame:
    """Usages of Python scripts, found on logical lines, so calls may be laid over many lines. A data frame's table is
    that of its last read before the use, else the script's first read before it; that of a column assigned is
    its frame's last read in the script. With two kinds of readers join keys are cross-system joins. Columns assigned
    in a script that writes are output measures of medium confidence, once per element."""
    bare = spread(code, "model_id").select("model_id", F.col("code").alias("full"), blank("code", "Python").alias("code"))
    bare = bare.withColumn("__kinds", F.size(F.array_distinct(F.regexp_extract_all("code", F.lit(P.PY_READ_KIND), F.lit(1))))).withColumn("__writes", F.col("code").rlike(P.PY_WRITE_KIND))
    # ``text`` has no strings with quotes in them, ``sums`` none with slashes either, ``whole`` has both; their
    # logical lines are the same, for strings hold no line end and bracketed parts are taken as wholes
    cut = lambda c: F.transform(F.regexp_extract_all(c, F.lit(P.PY_LOGICAL), F.lit(0)), lambda x: F.when(x.contains("\\"), F.regexp_replace(x, r"\\\r?\n", " ")).otherwise(x))
    texts = F.arrays_zip(*[cut(c).alias(n) for n, c in (("whole", F.col("code")), *((n, F.regexp_replace("full", rx, "$1")) for n, rx in zip(("text", "sums"), PY_PLAIN, strict=True)))])
    lines = bare.select("model_id", "__kinds", "__writes", F.posexplode_outer(texts).alias("line", "t")).filter("t is not null").select("model_id", "__kinds", "__writes", "line", "t.*")
    uses = []
    for kind, rx, col, var, said in [*P.PY_USAGES, *(more or [])]:
        text = "sums" if kind == "denominator" else "text"
        uses.append(_if_any(text, rx, P.PY_SIGNS, _py_rows(text, kind, rx, col, var, said), _PY_ROW))
    measure = F.transform(_hits("text", P.PY_ASSIGN, 1, 2), lambda h: _py_row(F.lit("output_measure"), h["g2"], F.nullif(h["g1"], F.lit("")), F.concat(F.lit('df["'), h["g2"], F.lit('"] = ...; df.to_*()'))))
    uses.append(F.when(F.col("__writes"), _if_any("text", P.PY_ASSIGN, {P.PY_ASSIGN: ("=",)}, measure, _PY_ROW)).otherwise(F.array().cast(f"array<{_PY_ROW}>")))
    # reads come with the uses, as rows whose column is the table they bind
    uses.append(_if_any("whole", P.PY_READ, {P.PY_READ: ("read_",)}, F.transform(_hits("whole", P.PY_READ, 1, 3), lambda h: _py_row(F.lit("read"), path_stem(h["g3"]), h["g1"], F.lit(""))), _PY_ROW))
    rows = lines.select("model_id", "line", "__kinds", F.explode_outer(F.flatten(F.array(*uses))).alias("u")).filter("u is not null")
    bound = F.when(F.col("u.kind") == "read", F.col("u.col"))
    at = F.struct(F.when(F.col("u.kind") == "output_measure", F.lit(2**31 - 1)).otherwise(F.col("line")).alias("line"), F.when(bound.isNull(), 1).otherwise(0).alias("use"))
    first = F.min(F.when(bound.isNotNull(), F.struct("line", bound.alias("bound")))).over(Window.partitionBy("model_id"))
    rows = rows.select("model_id", "__kinds", "u", bound.alias("bound"), at.alias("at"), first.alias("first"))
    # the binding that holds at a use: the last one of its variable at or before its line
    last = F.last("bound", True).over(Window.partitionBy("model_id", "u.var").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    table = F.coalesce(F.when(F.col("u.var").isNotNull(), last), F.when(F.col("first.line") <= F.col("at.line"), F.col("first.bound")))
    held = rows.withColumn("table", table).filter("bound is null")
    kind = F.when((F.col("u.kind") == "join_key") & (F.col("__kinds") >= 2), "cross_system_join").otherwise(F.col("u.kind"))
    out = held.select("model_id", _qualified(F.col("table"), F.col("u.col")).alias("element"), kind.alias("usage_kind"), F.col("u.evidence").alias("evidence"), F.when(F.col("u.kind") == "output_measure", "Medium").otherwise("High").alias("confidence"))
    # one of the measures of an element, all of the others; a row number apart keeps them distinct without a second pass
    nth = F.row_number().over(Window.partitionBy("model_id", "usage_kind", "element").orderBy("evidence"))
    return out.withColumn("__n", nth).filter("__n = 1 or usage_kind <> 'output_measure'").drop("__n")


_PY_ROW = "struct<kind:string,col:string,var:string,evidence:string>"


def _py_row(kind: Column, col: Column, var: Column, evidence: Column) -> Column:
    return F.struct(kind.alias("kind"), col.alias("col"), var.cast("string").alias("var"), evidence.alias("evidence"))


def _py_rows(text: str, kind: str, rx: str, col: int, var: int, said: str) -> Column:
    groups = [col, var] if var else [col]

    def row(h: Column) -> Column:
        before, _, after = said.partition("{}")
        evidence = F.trim(h["m"]) if not said else F.concat(F.lit(before), h[f"g{col}"], F.lit(after)) if "{}" in said else F.lit(said)
        return _py_row(F.lit(kind), h[f"g{col}"], F.nullif(h[f"g{var}"], F.lit("")) if var else F.lit(None), evidence)

    return F.transform(_hits(text, rx, *groups), row)


# --------------------------------------------------------------------------------------------- R
def r_references(code: DataFrame) -> DataFrame:
    """Last path segments of files read and written."""
    bare = spread(code, "model_id").select("model_id", blank("code", "R", strings=False).alias("code"))
    both = F.concat(*[F.transform(F.regexp_extract_all("code", F.lit(rx), F.lit(1)), _directed(d)) for d, rx in (("input", P.R_READ), ("output", P.R_WRITE))])
    return bare.select("model_id", F.explode_outer(both).alias("r")).filter("r is not null").select("model_id", "r.direction", path_tail("r.name").alias("name")).distinct()


def _directed(direction: str):
    return lambda n: F.struct(F.lit(direction).alias("direction"), n.alias("name"))


def r_usages(code: DataFrame, more: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """Join keys, grouping columns, numeric filters, denominators, and ``$`` columns assigned on a data
    frame that the script writes (medium confidence). Elements are bare column names."""
    both = spread(code, "model_id").select("model_id", blank("code", "R", strings=False).alias("code"), blank("code", "R").alias("bare"))
    row = lambda kind, col, said, conf="High": F.struct(F.lit(kind).alias("kind"), col.alias("cols"), said.alias("evidence"), F.lit(conf).alias("conf"), F.lit(None).cast("string").alias("df"))
    joins = F.transform(F.regexp_extract_all("code", F.lit(P.R_JOIN), F.lit(1)), lambda k: row("join_key", k, F.concat(F.lit('by = "'), k, F.lit('"'))))
    groups = F.transform(_hits("bare", P.R_GROUP, 1), lambda h: row("aggregated", h["g1"], F.trim(h["m"])))
    filters = F.flatten(F.transform(F.regexp_extract_all("bare", F.lit(P.R_FILTER), F.lit(1)), lambda f: F.transform(F.regexp_extract_all(f, F.lit(P.R_FILTER_COL), F.lit(1)), lambda c: row("range_filter", c, F.concat(F.lit("filter("), F.trim(f), F.lit(")"))))))
    divisors = F.transform(_hits("bare", P.R_DIVISOR, 1), lambda h: row("denominator", h["g1"], F.trim(h["m"])))
    assigned = F.transform(_hits("bare", P.R_ASSIGN, 1, 2), lambda h: F.struct(F.lit("output_measure").alias("kind"), h["g2"].alias("cols"), F.concat(h["g1"], F.lit("$"), h["g2"], F.lit(" <- ...")).alias("evidence"), F.lit("Medium").alias("conf"), h["g1"].alias("df")))
    of = lambda kind, conf: lambda h: row(kind, h["g1"], F.trim(h["m"]), conf)
    further = [F.transform(_hits("bare", rx, 1), of(kind, conf)) for kind, rx, conf in more or []]
    written = F.regexp_extract_all("code", F.lit(P.R_WRITE_DF), F.lit(1))
    rows = both.select("model_id", written.alias("written"), F.explode_outer(F.concat(joins, groups, filters, divisors, assigned, *further)).alias("u")).filter("u is not null").filter(F.col("u.df").isNull() | F.array_contains("written", F.col("u.df")))
    split = F.when(F.col("u.kind") == "aggregated", F.split("u.cols", r"[,\s]+")).otherwise(F.array("u.cols"))
    return rows.select("model_id", F.explode_outer(split).alias("element"), F.col("u.kind").alias("usage_kind"), F.col("u.evidence").alias("evidence"), F.col("u.conf").alias("confidence")).filter("element is not null").filter("element <> ''")


# ------------------------------------------------------------------------------------------- VBA
def _vba(code: DataFrame) -> tuple[DataFrame, DataFrame]:
    bare = spread(code, "model_id").select("model_id", blank("code", "VBA").alias("code"))
    lines = bare.select("model_id", F.posexplode_outer(F.split("code", r"\r?\n")).alias("line", "text")).filter("text is not null").withColumn("text", F.trim("text"))
    bound = lines.select("model_id", "line", F.explode_outer(_hits("text", P.VBA_BIND, 1, 2)).alias("h")).filter("h is not null").groupBy("model_id", F.col("h.g1").alias("var")).agg(F.max_by("h.g2", "line").alias("sheet"))
    return lines, bound


def vba_references(code: DataFrame) -> DataFrame:
    """Sheets written to are outputs; bound sheets that are read and not written are inputs."""
    lines, bound = _vba(code)
    target = F.regexp_extract("text", P.VBA_ASSIGN, 1)
    wrote = lines.filter(target != "").select("model_id", target.alias("var")).join(bound, ["model_id", "var"]).select("model_id", "sheet").distinct()
    source = F.when(target != "", F.expr("substring(text, locate('=', text) + 1)")).otherwise(F.col("text"))
    read = lines.select("model_id", F.explode_outer(F.regexp_extract_all(source, F.lit(P.VBA_REF), F.lit(1))).alias("var")).filter("var is not null").join(bound, ["model_id", "var"]).select("model_id", "sheet").distinct()
    ins = read.join(wrote, ["model_id", "sheet"], "left_anti").select("model_id", F.lit("input").alias("direction"), F.col("sheet").alias("name"))
    return ins.unionByName(wrote.select("model_id", F.lit("output").alias("direction"), F.col("sheet").alias("name")))


def vba_usages(code: DataFrame, more: list[tuple[str, str]] | None = None) -> DataFrame:
    """Cells that divide or are compared with a number, as ``<sheet>.col<n>``. ``more``: further (kind,
    pattern) rows, whose groups are the sheet's variable and the column number."""
    lines, bound = _vba(code)
    rows = [_vba_rows(kind, rx) for kind, rx in [*P.VBA_USAGES, *(more or [])]]
    hits = lines.select("model_id", F.explode_outer(F.flatten(F.array(*rows))).alias("u")).filter("u is not null").select("model_id", "u.*").join(bound, ["model_id", "var"], "left")
    return hits.select("model_id", F.concat(F.coalesce("sheet", "var"), F.lit(".col"), "n").alias("element"), F.col("kind").alias("usage_kind"), "evidence", F.lit("High").alias("confidence"))


def _vba_rows(kind: str, rx: str) -> Column:
    return F.transform(_hits("text", rx, 1, 2), lambda h: F.struct(F.lit(kind).alias("kind"), h["g1"].alias("var"), h["g2"].alias("n"), F.trim(h["m"]).alias("evidence")))


# ------------------------------------------------------------------------------------------- all
REFERENCES = {"SAS": sas_references, "Python": python_references, "R": r_references, "VBA": vba_references}
USAGES = {"SAS": sas_usages, "Python": python_usages, "R": r_usages, "VBA": vba_usages}


def scan_references(models: DataFrame) -> DataFrame:
    """References of ``models(model_id, language, code)``, each by its language's scan."""
    out = [f(models.filter(F.col("language") == lang)) for lang, f in REFERENCES.items()]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


def scan_usages(models: DataFrame, more: dict[str, list] | None = None) -> DataFrame:
    """Usages of ``models(model_id, language, code)``, each by its language's scan; ``more`` gives further
    patterns by language, in the form that the language's scan takes."""
    out = [f(models.filter(F.col("language") == lang), (more or {}).get(lang)) for lang, f in USAGES.items()]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])

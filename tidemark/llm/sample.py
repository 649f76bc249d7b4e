"""Labelled documents for fitting classifiers: all of them, or bounded samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import marked, marks, staged


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, label_col: str, per_class: int) -> tuple[DataFrame, float]:
    """Up to ``per_class`` labelled rows of each class, those with the smallest id hashes, joined to
    ``docs``, with columns ``label`` and ``order``; and the share of label 1 among all labelled rows.
    Rows with a null label or id are left out; of rows that repeat an id, the one with the smallest hash stands for
    all, and so for a repeated label. ``labels`` holds only what may be learned from. A column of ``docs`` named
    ``label`` or ``order`` gives way to the sample's own."""
    own = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("s_id"), F.col(label_col).cast("int").alias("s_label"), F.xxhash64(F.col(id_col).cast("string")).alias("s_order"))
    ones, rows = own.agg(F.coalesce(F.sum("s_label"), F.lit(0)), F.count("*")).first()
    once = own.distinct()
    few = [once.filter(F.col("s_label") == y).orderBy("s_order", "s_id").limit(per_class) for y in (0, 1)]
    picked = F.broadcast(few[0].unionByName(few[1]))  # 2 * per_class narrow rows at most
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    found = plain.join(picked, plain[names[docs.columns.index(id_col)]] == picked["s_id"]).groupBy("s_id", "s_label", "s_order").agg(F.min_by(F.struct(*names), F.xxhash64(*names)).alias("row"))
    kept = [(n, c) for n, c in zip(names, docs.columns, strict=True) if c not in ("label", "order")]
    return found.select(*[F.col(f"row.{n}").alias(c) for n, c in kept], F.col("s_label").alias("label"), F.col("s_order").alias("order")), (ones / rows if rows else 0.5)


def labelled_rows(docs: DataFrame, labels: DataFrame, id_col: str, label_col: str) -> tuple[DataFrame, float]:
    """All labelled rows, joined to ``docs`` as in ``labelled_sample``; rows without a label are told by a bitmap before the
    shuffle."""
    own = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("s_id"), F.col(label_col).cast("int").alias("s_label"), F.xxhash64(F.col(id_col).cast("string")).alias("s_order"))
    ones, rows = own.agg(F.coalesce(F.sum("s_label"), F.lit(0)), F.count("*")).first()
    once = staged(own.distinct(), "labels")
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = names[docs.columns.index(id_col)]
    plain = docs.toDF(*names)
    if docs.schema[id_col].dataType == labels.schema[id_col].dataType:
        plain = marked(plain, marks(once.select(F.col("s_id").alias(at)).distinct(), at), at).filter("marked").drop("marked")
    found = plain.join(once, plain[at] == once["s_id"]).groupBy("s_id", "s_label", "s_order").agg(F.min_by(F.struct(*names), F.xxhash64(*names)).alias("row"))
    kept = [(n, c) for n, c in zip(names, docs.columns, strict=True) if c not in ("label", "order")]
    return found.select(*[F.col(f"row.{n}").alias(c) for n, c in kept], F.col("s_label").alias("label"), F.col("s_order").alias("order")), (ones / rows if rows else 0.5)


def within(rows: DataFrame, column: str, total: int) -> DataFrame:
    """Of a bounded sample's ``rows``, in the order of ``order`` and ``label``, as many as hold ``total`` items in
    the lists of ``column`` together. Only the sizes pass through the driver."""
    rows = staged(rows, "sample")
    sizes = sorted(rows.select("order", "label", F.size(column)).collect())
    held, last = 0, None
    for order, label, n in sizes:
        held += n
        if held > total:
            break
        last = (order, label)
    if last is None:
        return rows.limit(0)
    return rows.filter((F.col("order") < last[0]) | ((F.col("order") == last[0]) & (F.col("label") <= last[1])))

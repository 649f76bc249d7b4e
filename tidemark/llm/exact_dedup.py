"""Exact duplicates by Patricia-trie owners (operator 7)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from .common import LOWER_TABLE, arrow_type, batch, marked, marks, staged
from .patricia import OwnerTrie

_FOLD = LOWER_TABLE.tobytes()


def _texts(b: pa.RecordBatch) -> Iterator[bytes]:
    for t in b.column(1):
        yield (t.as_buffer().to_pybytes() if t.is_valid else b"").translate(_FOLD)


def exact_owners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", memory_bytes: int = 64 << 20, extra: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: the id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256`` and ``extra``.

    Texts are equal when identical after lower-casing A-Z only; a null text equals the empty one.
    Of equal texts the row with the largest id (``keep='min'``: the smallest) stays; a null id never
    owns a text that also has another id. Rows repeated with their id share all results, so both
    are ``kept``; ``deduplicate`` leaves one of them.

    Each map task first folds the copies within an Arrow batch, so that one text with any number of
    copies sends a row per batch at most. What is left is dealt out by length and content hash; each
    partition inserts the full byte strings into a Patricia trie whose terminal nodes hold the owner.
    Documents then look their owner up by (length, hash); of a text without a copy there is nothing to
    look up, and a hot text's documents stay where they are or are split by the skewed-join rule.
    """
    ids = arrow_type(docs, id_col)
    better = (lambda new, old: old is None or (new is not None and new > old)) if keep == "max" else (lambda new, old: old is None or (new is not None and new < old))
    names = [f"x{i}" for i in range(len(extra))]
    two = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *[F.col(c).alias(n) for c, n in zip(extra, names, strict=True)])
    rep_schema = pa.schema([("size", pa.int64()), ("sha", pa.string()), ("body", pa.binary()), ("id", ids), ("rows", pa.int64())])
    own_schema = pa.schema([("size", pa.int64()), ("sha", pa.string()), ("keep_id", ids), ("rows", pa.int64())])
    member_schema = pa.schema([("id", ids), ("size", pa.int64()), ("sha", pa.string()), *[(n, arrow_type(docs, c)) for c, n in zip(extra, names, strict=True)]])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict[bytes, list] = {}
            for i, body in zip(b.column(0).to_pylist(), _texts(b), strict=True):
                have = seen.get(body)
                if have is None:
                    seen[body] = [i, 1]
                else:
                    have[0], have[1] = (i if better(i, have[0]) else have[0]), have[1] + 1
            bodies = list(seen)
            yield batch(rep_schema, [len(x) for x in bodies], [hashlib.sha256(x).hexdigest() for x in bodies], bodies, [v[0] for v in seen.values()], [v[1] for v in seen.values()])

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = OwnerTrie(better, memory_bytes)
        for b in batches:
            for body, i, rows in zip(b.column(2), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                trie.insert(body.as_buffer().to_pybytes(), i, rows)
        out: list[tuple] = []
        for body, i, rows in trie.items():
            out.append((len(body), hashlib.sha256(body).hexdigest(), i, rows))
            if len(out) == 10_000:
                yield batch(own_schema, *zip(*out, strict=True))
                out = []
        if out:
            yield batch(own_schema, *zip(*out, strict=True))

    def member(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, shas = [], []
            for body in _texts(b):
                sizes.append(len(body))
                shas.append(hashlib.sha256(body).hexdigest())
            yield batch(member_schema, b.column(0), sizes, shas, *[b.column(2 + i) for i in range(len(names))])

    owners = two.select("id", "text").mapInArrow(fold, _ddl(rep_schema)).repartition("size", "sha").mapInArrow(grow, _ddl(own_schema))
    shared = owners.filter("rows > 1")
    out = two.mapInArrow(member, _ddl(member_schema)).join(shared, ["size", "sha"], "left")
    keep_id = F.when(F.col("rows").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return out.select(
        F.col("id").alias(id_col),
        keep_id.alias("keep_id"),
        F.coalesce("rows", F.lit(1)).cast("long").alias("group_size"),
        keep_id.eqNullSafe(F.col("id")).alias("kept"),
        F.col("sha").alias("text_sha256"),
        *[F.col(n).alias(c) for c, n in zip(extra, names, strict=True)],
    )


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"`{f.name}` {from_arrow_type(f.type).simpleString()}" for f in schema)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """The rows of ``docs``, one for each text: that of its owner, with all columns whatever their names. Of
    rows repeated with their id one is left, that with the smallest hash of all columns (equal hashes: of
    equal rows), in whatever order the rows come.

    Rows stay where they are read: a bitmap of fixed size tells which are surely neither copies nor
    repeats, and only the others are joined to the narrow table of rows that go or that repeat.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    id_, text = (names[docs.columns.index(c)] for c in (id_col, text_col))
    own = docs.toDF(*names).withColumn("raw", F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")), 256))
    owners = exact_owners(own, id_, text, keep, extra=("raw",))
    owners = staged(owners.select(F.col(id_).alias("o_id"), F.unhex("raw").alias("o_raw"), F.unhex("text_sha256").alias("sha"), "kept"), "owners")
    again = owners.filter("kept").groupBy(F.col("o_id").alias("a_id"), F.col("sha").alias("a_sha")).agg(F.count("*").alias("n")).filter("n > 1")
    repeats = owners.filter("kept").join(again, F.col("o_id").eqNullSafe(F.col("a_id")) & (F.col("sha") == F.col("a_sha"))).select("o_id", "o_raw", "sha")
    odd = staged(owners.filter("not kept").select("o_id", "o_raw", F.lit(None).cast("binary").alias("sha")).unionByName(repeats).distinct(), "odd")
    flagged = marked(own.withColumn("raw", F.unhex("raw")), marks(odd, "o_id", "o_raw"), id_, "raw")
    looked = flagged.filter("marked").join(odd, F.col(id_).eqNullSafe(F.col("o_id")) & (F.col("raw") == F.col("o_raw")), "left")
    row = F.struct(*names)
    one = looked.filter("sha is not null").groupBy(id_, "sha").agg(F.min_by(row, F.xxhash64(F.to_json(row))).alias("row")).select("row.*")
    left = flagged.filter(~F.col("marked")).select(*names).unionByName(looked.filter("o_raw is null").select(*names)).unionByName(one)
    return left.toDF(*docs.columns)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per row of ``documents``: doc_id, keep_id, group_size, kept and text_sha256."""
    return exact_owners(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(body) AS text_sha256
FROM d WINDOW w AS (PARTITION BY body)
"""

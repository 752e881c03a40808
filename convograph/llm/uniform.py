"""One consistent form for text that looks the same, by DuckDB inside Arrow partitions."""
from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..lineage import Cuts
from .lookalikes import BLANK, same_form

MADE = "__same"


def _partition(column: str, sql: str):
    def run(batches: Iterator) -> Iterator:
        import duckdb
        import pyarrow as pa

        con = duckdb.connect(config={"threads": 1, "memory_limit": "512MB"})
        for batch in batches:
            con.register("batch", pa.Table.from_batches([batch.select([column])]))
            made = con.sql(sql).to_arrow_table().column(0).combine_chunks()
            made = pa.concat_arrays(made.chunks) if isinstance(made, pa.ChunkedArray) else made
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, MADE])

    return run


def uniform_text(df: DataFrame, column: str, out: str) -> DataFrame:
    """Adds ``out``, the consistent form of ``column``: widths, presentation forms and blanks in
    their plain form, accents composed, invisible characters gone, look-alike letters of
    other scripts as Latin ones. Case, accents, digits, punctuation and line breaks stay.
    Null stays null and empty text empty; other columns pass unchanged. One DuckDB connection
    serves a partition, batch by batch, so memory is bounded by Spark's Arrow batch."""
    if out in df.columns and out != column:
        df = df.drop(out)
    sql = f'select cast({same_form(_name(column))} as varchar) from batch'
    schema = T.StructType([*df.schema.fields, T.StructField(MADE, T.StringType())])
    made = df.mapInArrow(_partition(column, sql), schema)
    return made.withColumn(out, F.col(MADE)).drop(MADE)


def _name(column: str) -> str:
    return '"' + column.replace('"', '""') + '"'


def same_looking(df: DataFrame, key: str, text: str, src: str, hot_rows: int = 10_000) -> DataFrame:
    """(src, a_key, b_key): pairs of rows of one chat whose ``text`` is not blank, looks the same and is
    stored differently; a_key < b_key as text, each pair once.

    Texts travel as digests of 128 bits, and only of groups that hold several stored forms.
    Pairs of forms come first, then their rows, so copies of one form are never compared with
    each other: work follows the size of the result. The rows of a form with more
    than ``hot_rows`` are spread over salts. Rows without chat or key have no pairs."""
    cuts = Cuts(df.sparkSession, "uniform")
    rows = df.select("chat_id", F.col(key).cast("string").alias("key"), F.col(text).alias("text")).where(
        "chat_id is not null and key is not null and text is not null")
    rows = cuts.cut(
        uniform_text(rows, "text", "same").where(~F.col("same").rlike(f"^{BLANK}$"))
        .select("chat_id", "key", F.unhex(F.md5("same")).alias("same"), F.unhex(F.md5("text")).alias("form"))
    )
    several = rows.groupBy("chat_id", "same").agg(F.min("form").alias("a"), F.max("form").alias("b")).where("a <> b")
    rows = cuts.cut(rows.join(several, ["chat_id", "same"], "left_semi").distinct())
    forms = rows.groupBy("chat_id", "same", "form").agg(F.count(F.lit(1)).alias("n"))
    more = forms.select("chat_id", "same", F.col("form").alias("form2"), F.col("n").alias("n2"))
    # the form with more rows stands left: it is the one that gets salts
    ahead = (F.col("n") > F.col("n2")) | ((F.col("n") == F.col("n2")) & (F.col("form") < F.col("form2")))
    salts = F.ceil(F.col("n") / hot_rows).cast("int")
    pairs = forms.join(more, ["chat_id", "same"]).where((F.col("form") != F.col("form2")) & ahead).withColumn("salts", salts)
    right = pairs.join(rows.select("chat_id", "same", F.col("form").alias("form2"), F.col("key").alias("key2")),
                       ["chat_id", "same", "form2"])
    right = right.select("chat_id", "same", "form", "key2", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    left = rows.join(forms.withColumn("salts", salts), ["chat_id", "same", "form"]).withColumn(
        "salt", F.pmod(F.xxhash64("key"), F.col("salts")).cast("int"))
    found = left.join(right, ["chat_id", "same", "form", "salt"]).where("key <> key2")
    out = found.select(F.lit(src).alias("src"), F.least("key", "key2").alias("a_key"), F.greatest("key", "key2").alias("b_key"))
    return out.distinct() if src == "node" else out

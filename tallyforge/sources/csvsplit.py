"""CSV files with quoted line breaks, read by many tasks a file.

A line break ends a record only after an even number of quotes. Blocks of a file count their quotes; the parity before
each block is a running sum over blocks. A block is read in order by one task, which joins the lines of its records, so no text is
shuffled; only the two ends of a block, where a record runs over its border, are brought together.

A quote inside a value must be doubled, as exports do; a value that holds one without being quoted would turn the parity. A file's first
record is its header. Blank lines outside quotes are no records.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyforge.runtime import BROADCAST_ROWS, table

#: What a piece of a block is: a whole record, the end of one that an earlier block began, the start of one that a later block ends.
WHOLE, END, START = 0, 1, 2


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(b, part, head, value) from the lines (b, odd, first, value) of blocks in order: ``odd`` tells that a quote is open before the block,
    ``first`` that the block begins a file. A block's first record is ``head`` there; lines of a record are joined."""
    block, held, parity, head, open_before = None, [], 0, False, False

    def row(b, part: int, is_head: bool, lines: list[str]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([b], pa.int64()), pa.array([part], pa.int32()), pa.array([is_head], pa.bool_()), pa.array(["\n".join(lines)], pa.string())], ["b", "part", "head", "value"])

    for batch in batches:
        b, odd, first = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        cuts = [0, *(np.flatnonzero(b[1:] != b[:-1]) + 1).tolist(), len(b)]
        for i, j in zip(cuts, cuts[1:], strict=False):
            if i == j:
                continue
            if b[i] != block:
                if held:
                    yield row(block, END if open_before else START, head, held)
                block, held, parity, open_before, head = int(b[i]), [], int(odd[i]), bool(odd[i]), bool(first[i])
            lines = batch.column(3).slice(i, j - i)
            after = (parity + np.cumsum(pc.count_substring(lines, '"').to_numpy(zero_copy_only=False))) % 2
            parity = int(after[-1])
            ends = np.flatnonzero(after == 0) + 1
            if not len(ends):
                held += lines.to_pylist()
                continue
            at = 0
            if held or open_before:
                yield row(block, END if open_before else WHOLE, head, held + lines.slice(0, ends[0]).to_pylist())
                at, head, open_before, held = 1, False, False, []
            if len(ends) > at:
                offsets = pa.array(np.concatenate([ends[:1] if at else [0], ends[at:]]), pa.int32())
                joined = pc.binary_join(pa.ListArray.from_arrays(offsets, lines), "\n")
                heads = np.zeros(len(joined), bool)
                heads[0], head = head, False
                yield pa.record_batch([pa.array(np.full(len(joined), block), pa.int64()), pa.array(np.zeros(len(joined)), pa.int32()), pa.array(heads), joined], ["b", "part", "head", "value"])
            held = lines.slice(ends[-1]).to_pylist()
    if held:
        yield row(block, END if open_before else START, head, held)


def records(spark: SparkSession, path: str) -> DataFrame:
    """(value): the text of every record but the headers, line breaks inside quotes included."""
    lines = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"')))
    blocks = lines.groupBy("file", "block").agg((F.sum(quotes) % 2).alias("turns"))
    earlier = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    odd = (F.coalesce(F.sum("turns").over(earlier), F.lit(0)) % 2).cast("int")
    blocks = table(blocks.select("file", "block", odd.alias("odd"), ((odd + F.col("turns")) % 2 == 1).alias("_open")).withColumn("b", F.monotonically_increasing_id()), "blocks")
    n, open_ = blocks.agg(F.count("*"), F.count_if((F.col("odd") == 1) | F.col("_open"))).first()

    def read(of: DataFrame, how: str) -> DataFrame:
        # A broadcast leaves lines in their order; a shuffle does not.
        rows = lines.withColumn("_i", F.monotonically_increasing_id()).join(F.broadcast(of) if n <= BROADCAST_ROWS else of, ["file", "block"], how)
        rows = rows if n <= BROADCAST_ROWS else rows.repartition("file", "block").sortWithinPartitions("file", "block", "_i")
        known = F.when(F.col("b").isNull(), F.raise_error(F.lit("the file was split otherwise when its quotes were counted"))).otherwise(F.col("b"))
        text = F.when(F.endswith("value", F.lit("\r")), F.expr("left(value, length(value) - 1)")).otherwise(F.col("value"))
        return rows.select(known.cast("long").alias("b"), "odd", (F.col("block") == 0).alias("first"), text.alias("value")).mapInArrow(pieces, "b long, part int, head boolean, value string")

    alone = read(blocks, "left").where(F.col("part") == WHOLE).where(~F.col("head") & (F.trim("value") != "")).select("value")
    if not open_:
        return alone
    # Records that run over a border: the start of one and all ends up to the next start.
    ends = read(blocks.where("odd = 1 OR _open"), "inner").where(F.col("part") != WHOLE).join(F.broadcast(blocks) if n <= BROADCAST_ROWS else blocks, "b")
    number = F.count_if(F.col("part") == START).over(W.partitionBy("file").orderBy("block", "part").rowsBetween(W.unboundedPreceding, 0))
    parts = ends.select("file", "block", "part", "head", "value", number.alias("_n")).groupBy("file", "_n")
    joined = parts.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "part", "value"))), lambda x: x["value"]), "\n").alias("value"), F.max("head").alias("head"))
    return alone.unionByName(joined.where("NOT head").select("value"))


def rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The records of ``path`` (headers left out) as columns of ``schema``."""
    return records(spark, path).select(F.from_csv("value", schema, {"escape": '"', "sep": ","}).alias("r")).select("r.*")

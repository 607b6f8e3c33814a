"""Sharding along a Hilbert curve over several metadata dimensions.

Every dimension is quantised to `bits` bits between its smallest and largest value (one row of
bounds is all the driver sees), the cell's place on the curve is the sort key, and the sorted rows
are cut into runs of equal counts. Rows near on the curve agree in all dimensions, so the value
ranges of a shard's files are narrow in each of them and filters on any dimension skip files.

The sort is a range exchange on (curve index, hash, id): the hash splits a cell that holds a large
part of all rows. Ranks are a partition's offset plus the place in the partition; the offsets are
one row for each partition.

Defined results: null text has size 1 and CRC 0; a null in a dimension is in its lowest cell; rows
with the same id are ordered by their hash, and repeated rows get slots of their own. An empty
table gives an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from pathlib import PurePosixPath

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

LAW = "rows"


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of cell numbers below 2**bits.

    Axes become a transposed index by undoing the curve's rotations from the highest bit down,
    then a Gray code; the bits of all axes are interleaved.
    """
    x = np.array(cells, dtype=np.int64).T.copy()
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(d):
            turned = (x[i] & q) != 0
            swap = np.where(turned, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(turned, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[-1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def _number_cell(value: Column, low: float | None, high: float | None, bits: int) -> Column:
    top = (1 << bits) - 1
    if low is None or high is None or high <= low:
        return F.lit(0).cast("int")
    cell = F.floor((value.cast("double") - float(low)) / (float(high) - float(low)) * top + 0.5).cast("int")
    return F.coalesce(F.least(F.greatest(cell, F.lit(0)), F.lit(top)), F.lit(0))


def _text_number(value: Column | str, skip: int) -> Column | int:
    """A number that orders like the three characters after the first `skip`."""
    if isinstance(value, str):
        codes = [min(ord(c), 255) + 1 for c in value[skip : skip + 3]] + [0, 0, 0]
        return (codes[0] * 257 + codes[1]) * 257 + codes[2]
    code = [
        F.when(F.length(value) >= skip + k, F.least(F.ascii(F.substring(value, skip + k, 1)), F.lit(255)) + 1).otherwise(0) for k in (1, 2, 3)
    ]
    return (code[0] * 257 + code[1]) * 257 + code[2]


def quantised(df: DataFrame, numbers: dict[str, Callable[[Column], Column]], texts: list[str], bits: int) -> DataFrame:
    """Adds an array column `cells`. numbers: columns and a monotone scale for each."""
    scaled = {k: f(F.col(k)) for k, f in numbers.items()}
    bounds = df.agg(
        *[g(scaled[k].cast("double")).alias(f"{n}_{k}") for k in numbers for n, g in (("min", F.min), ("max", F.max))],
        *[g(k).alias(f"{n}_{k}") for k in texts for n, g in (("min", F.min), ("max", F.max))],
    ).first()
    cells = [_number_cell(scaled[k], bounds[f"min_{k}"], bounds[f"max_{k}"], bits) for k in numbers]
    for k in texts:
        low, high = bounds[f"min_{k}"] or "", bounds[f"max_{k}"] or ""
        skip = next((i for i, (a, b) in enumerate(zip(low, high, strict=False)) if a != b), min(len(low), len(high)))
        cells.append(_number_cell(_text_number(F.col(k), skip), _text_number(low, skip), _text_number(high, skip), bits))
    return df.withColumn("cells", F.array(*cells))


def shard(docs: DataFrame, *, n_shards: int = 8, bits: int = 5, id_col: str = "doc_id", text_col: str = "text",
          texts: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """doc_id, the text dimensions, size, text_crc32, curve (place on the curve), law, shard, slot.

    Counts of shards differ by one at most; slots run from 0 in curve order."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    meta = docs.select(
        F.col(id_col).alias("doc_id"), *[F.col(k) for k in texts], (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(F.col(id_col), text).alias("_spread"),
    )
    meta = stored(meta, "shard-meta")
    cells = quantised(meta, {"doc_id": lambda c: c, "size": lambda c: F.log2(c)}, list(texts), bits)

    @F.pandas_udf("long")
    def curve(x: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index(np.stack(x.to_numpy()), bits) if len(x) else np.empty(0, dtype=np.int64))

    keys = ["curve", "_spread", "doc_id", "size"]
    placed = stored(
        cells.withColumn("curve", curve("cells")).drop("cells").repartitionByRange(*keys).sortWithinPartitions(*keys)
        .withColumn("_at", F.monotonically_increasing_id()),
        "shard-order",
    )
    inside = (1 << 33) - 1
    counts = placed.groupBy(F.shiftright("_at", 33).alias("p")).agg(F.count("*").alias("n")).collect()  # a row for each partition
    offset, begin = 0, []
    for r in sorted(counts):
        begin.append((r["p"], offset))
        offset += r["n"]
    total = max(offset, 1)
    starts = F.broadcast(docs.sparkSession.createDataFrame(begin, "p int, offset long"))
    ranked = placed.join(starts, F.shiftright("_at", 33).cast("int") == F.col("p"), "left").withColumn(
        "_rank", F.col("offset") + F.col("_at").bitwiseAND(F.lit(inside))
    )
    number = F.expr(f"cast(_rank * {n_shards} div {total} as int)")
    first = F.expr(f"(shard * {total} + {n_shards - 1}) div {n_shards}")
    return ranked.withColumn("shard", number).select(
        "doc_id", *texts, "size", "text_crc32", "curve", F.lit(LAW).alias("law"), "shard", (F.col("_rank") - first).cast("long").alias("slot")
    )


def write_shards(docs: DataFrame, path: str, *, id_col: str = "doc_id", max_rows_per_file: int = 1_000_000, **options) -> str:
    """Write the documents as Parquet, a folder for each shard, rows in curve order. Ids must be unique; columns
    named shard or slot are replaced by the places found here."""
    placed = shard(docs, id_col=id_col, **options).select(F.col("doc_id").alias(id_col), "shard", "slot")
    target = str(PurePosixPath(path)) if "://" not in path else path
    joined = docs.drop("shard", "slot").join(placed, id_col)
    joined.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.option(
        "maxRecordsPerFile", max_rows_per_file
    ).partitionBy("shard").parquet(target)
    return target

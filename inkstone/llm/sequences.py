"""Rows in the order of their sequences, however long one sequence is, and digests over them."""

import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: monotonically_increasing_id() puts the partition above these bits.
_PART_BITS = 33


def part_of(at: Column) -> Column:
    return F.shiftright(at, _PART_BITS)


def in_order(rows: DataFrame, coarse: list[Column], fine: list[str], scratch: Scratch) -> DataFrame:
    """The rows written with `at`, a long that rises with the columns `fine`. coarse must rise with the same order; it alone
    deals rows to partitions, so long texts are no part of the sampled bounds, and a long sequence spans partitions. The rows
    of one sequence in one partition have consecutive `at`: a piece, which is no larger than a partition."""
    sorted_rows = rows.repartitionByRange(*coarse).sortWithinPartitions(*fine)
    return scratch.write(sorted_rows.withColumn("at", F.monotonically_increasing_id()))


def joined_sha256(rows: DataFrame, key: str, order: list[str], value: str, separator: str, into: str) -> DataFrame:
    """(key, lowercase SHA-256 hex of the key's values in order, joined by the separator). Keys are streamed: a digest needs
    its values one after another, but a task holds one Arrow batch of them, not the key's whole rows. Null keys are a key."""
    sep, kind = separator.encode(), rows.schema[key].dataType.simpleString()

    def digests(batches: Iterator) -> Iterator:
        import pyarrow as pa

        schema, now, hashed = None, None, None
        for batch in batches:
            schema = schema or pa.schema([batch.schema.field(0).with_name(key), (into, pa.string())])
            keys, found = [], []
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if hashed is None or k != now:
                    if hashed is not None:
                        keys.append(now)
                        found.append(hashed.hexdigest())
                    now, hashed = k, hashlib.sha256()
                else:
                    hashed.update(sep)
                hashed.update(v.encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, schema.field(0).type), pa.array(found, pa.string())], schema=schema)
        if hashed is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], schema.field(0).type), pa.array([hashed.hexdigest()])], schema=schema)

    dealt = rows.repartition(key).sortWithinPartitions(key, *order).select(key, value)
    return dealt.mapInArrow(digests, f"`{key}` {kind}, {into} string")

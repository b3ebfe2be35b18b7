"""Documents dealt into chunks that talk to hash buckets.

Operators that ask "does this piece of text occur elsewhere?" deal documents
into chunks by a hash of their identity, so a chunk can be worked on as a whole
and found again.  Chunks send packed arrays of hashes to buckets, one row a
chunk and bucket; buckets answer to chunks.  All uses of the chunks of one plan
share one exchange of the texts.  Repeats inside a chunk are settled there, so
a piece that a third of all documents share reaches its bucket once a chunk.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Least and greatest bytes of text in a chunk; between them, a 2000th of all.
LEAST, MOST = 3 << 20, 16 << 20
#: Bytes of text whose hashes a bucket should hold at most.
SHARE = 64 << 20


def chunked(docs: DataFrame, text: str = "text", order: str = "doc_id") -> tuple[DataFrame, int]:
    """Adds ``__chunk``, which depends on a row's order column and text alone; and the number of buckets that hashes of these texts are dealt to."""
    size = docs.agg(F.sum(F.octet_length(F.col(text)))).head()[0] or 0
    n = max(1, -(-size // min(MOST, max(LEAST, size // 2000))))
    parts = docs.withColumn("__chunk", F.pmod(F.xxhash64(F.col(order), F.col(text), F.lit(7)), F.lit(n)).cast("int"))
    return parts, max(buckets(docs), -(-size // SHARE))


def buckets(docs: DataFrame) -> int:
    """How many buckets hashes are dealt to at least."""
    return 8 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def sides(h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For ascending hashes: the buckets (ranges of hashes) that have some, and where each begins and ends."""
    bucket = ((h >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)
    found, at = np.unique(bucket, return_index=True)
    return found.astype(np.int32), np.append(at, len(h))


def column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy(zero_copy_only=False)

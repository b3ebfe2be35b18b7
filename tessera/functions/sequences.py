"""Sequence and string functions as column expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reverse_complement(c: Column) -> Column:
    return F.reverse(F.translate(c, "ACGTacgt", "TGCAtgca"))


def canonical(c: Column) -> Column:
    """The lesser of a k-mer and its reverse complement."""
    return F.least(c, reverse_complement(c))


def fragments(c: Column, size: int, step: int = 1) -> Column:
    """All substrings of a size, at a step.

    Characters are split once and joined by array slices: a substring of a
    string is found by walking from its start, which long sequences can't afford.
    """
    letters = F.filter(F.split(c, ""), lambda x: x != "")
    return F.transform(letters, lambda x: x) if size == 1 and step == 1 else _joined(letters, size, step)


def _joined(letters: Column, size: int, step: int) -> Column:
    # the letters from each place on, zipped: a k-mer is one concatenation, with no search
    zipped = F.arrays_zip(*[F.slice(letters, F.lit(k + 1), F.greatest(F.size(letters) - k, F.lit(0))).alias(f"c{k}") for k in range(size)])
    whole = F.filter(F.transform(zipped, lambda z: F.concat(*[z[f"c{k}"] for k in range(size)])), lambda x: x.isNotNull())
    return whole if step == 1 else F.filter(F.transform(whole, lambda x, i: F.when(i % step == 0, x)), lambda x: x.isNotNull())


def count_kmers(seqs: DataFrame, k: int = 4, collapse: bool = False, pseudocount: float = 0.0, frequency: bool = True, fill: bool = False) -> DataFrame:
    """Counts (or shares) of the k-mers over A, C, G and T of each sequence (``seq_id``, ``seq``).

    ``fill`` adds k-mers that only other sequences have, with the pseudocount.
    """
    # dealing sequences first is the only shuffle: counts and shares of a sequence then stay where it is
    rows = seqs.select("seq_id", "seq").repartition("seq_id").select("seq_id", F.explode(fragments(F.upper("seq"), k)).alias("kmer")).where(F.col("kmer").rlike("^[ACGT]+$"))
    rows = rows.withColumn("kmer", canonical(F.col("kmer"))) if collapse else rows
    out = rows.groupBy("seq_id", "kmer").agg((F.count(F.lit(1)) + F.lit(float(pseudocount))).alias("v"))
    if fill:
        kmers = out.agg(F.collect_set("kmer").alias("ks"))  # at most 4 ** k
        grid = seqs.select("seq_id").distinct().crossJoin(F.broadcast(kmers)).select("seq_id", F.explode("ks").alias("kmer"))
        out = grid.join(out, ["seq_id", "kmer"], "left").withColumn("v", F.coalesce("v", F.lit(float(pseudocount))))
    return out.withColumn("v", F.try_divide("v", F.sum("v").over(Window.partitionBy("seq_id")))) if frequency else out


def murmur3(values: pd.Series, seed: int = 0) -> pd.Series:
    """Unsigned 32-bit MurmurHash3 of strings."""

    def one(s: str) -> int:
        data, h = s.encode(), seed & 0xFFFFFFFF
        for i in range(0, len(data) - len(data) % 4, 4):
            h ^= _scramble(int.from_bytes(data[i : i + 4], "little"))
            h = ((h << 13 | h >> 19) * 5 + 0xE6546B64) & 0xFFFFFFFF
        if len(data) % 4:
            h ^= _scramble(int.from_bytes(data[len(data) - len(data) % 4 :], "little"))
        h ^= len(data)
        for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
            h = ((h ^ h >> shift) * factor) & 0xFFFFFFFF
        return h ^ h >> 16

    return values.map(one, na_action="ignore")


def _scramble(k: int) -> int:
    k = (k * 0xCC9E2D51) & 0xFFFFFFFF
    return ((k << 15 | k >> 17) & 0xFFFFFFFF) * 0x1B873593 & 0xFFFFFFFF


def hash_kmer(c: Column, seed: int = 0) -> Column:
    """Strand-independent hash of a k-mer."""
    return F.pandas_udf(lambda v: murmur3(v, seed).astype("Int64"), "long")(canonical(c))


def intergenic(genes: DataFrame, contigs: DataFrame) -> DataFrame:
    """Sequences between successive genes of a contig in file order (``line``); positions are 1-based, empty gaps drop out."""
    w = Window.partitionBy("contig").orderBy("line")
    gaps = genes.withColumns({"from": F.col("pos_end") + 1, "upto": F.lead("pos_start").over(w) - 1, "next": F.lead("gene").over(w)}).where("upto >= `from`")
    return gaps.join(contigs.select(F.col("seq_id").alias("contig"), "seq"), "contig").select("contig", "gene", "next", F.expr("substr(seq, `from`, upto - `from` + 1)").alias("seq"))


def file_name(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\p{L}\p{N}]", "_")


def compression_of(path: str) -> str | None:
    return {"gz": "gzip", "bz2": "bzip2", "zip": "zip"}.get(path.rsplit(".", 1)[-1])


def random_sequences(spark, n: int, size: int, alphabet: str = "ACGT", weights: list[float] | None = None, seed: int = 0) -> DataFrame:
    """Seeded random sequences."""

    def run(frames):
        for f in frames:
            yield pd.DataFrame({"seq_id": f.id, "seq": ["".join(np.random.RandomState(seed + int(i)).choice(list(alphabet), size, p=weights)) for i in f.id]})

    return spark.range(n).mapInPandas(run, "seq_id long, seq string")


def value_range_kind(df: DataFrame, v: str) -> DataFrame:
    """Diverging if values lie on both sides of zero, and the range to show."""
    s = df.agg(F.min(v).alias("lo"), F.max(v).alias("hi"))
    both = (F.col("lo") < 0) & (F.col("hi") > 0)
    top = F.greatest(F.abs("lo"), F.abs("hi"))
    return s.select(F.when(both, "diverging").otherwise("sequential").alias("kind"), F.when(both, -top).otherwise(F.col("lo")).alias("vmin"), F.when(both, top).otherwise(F.col("hi")).alias("vmax"))


def softmax(v: Column, by: str) -> Column:
    w = Window.partitionBy(by)
    return F.exp(v - F.max(v).over(w)) / F.sum(F.exp(v)).over(w) * F.exp(F.max(v).over(w))

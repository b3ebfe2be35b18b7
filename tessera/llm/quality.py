"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document.  The ledger keeps the measurements
and one failure bit a rule; policies are versioned masks over those bits, so a
new policy or an ablation never reads a text again: it is integer arithmetic
and bitwise aggregation over the ledger.

Edge cases: a null or empty text has no words, fails ``few_words`` and has all
measurements 0.  Rows are independent, so repeated rows and ties give repeated
results, an empty table gives an empty ledger, and extra columns are ignored.
Memory follows a block of 0.5 MB of text or the longest text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._blocks import blocks, covered, mix, prefix, span_hash, table, utf8, windows, words

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")

#: (name, SQL condition under which a document fails).  A rule's place is its bit.
RULES = (
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 20 * n_words"),
    ("symbols", "10 * n_symbols > 3 * n_words"),
    ("duplicate_lines", "n_lines > 4 and 10 * n_dup_lines > 3 * n_lines"),
)

#: Policies by version: the rules that reject.
POLICIES = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "short_words", "long_words", "symbols", "duplicate_lines"),
}

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _measure(data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    n = len(off) - 1
    starts, ends, doc = words(data, off)
    sums = prefix(data)
    out = {"n_words": np.bincount(doc, minlength=n)}
    heads = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    out["word_chars"] = np.bincount(doc, heads[ends] - heads[starts], minlength=n).astype(np.int64)
    hit = np.concatenate(([0], np.cumsum(_SYMBOL[data])))
    out["n_symbols"] = hit[off[1:]] - hit[off[:-1]]
    # lines: each row has one more than its newlines
    cut = np.flatnonzero(data == 10)
    first = np.sort(np.concatenate((off[:-1], cut + 1)), kind="stable")
    rows = np.concatenate((np.arange(n), np.searchsorted(off, cut, "right") - 1))
    order = np.lexsort((np.concatenate((off[:-1], cut + 1)), rows))
    first, rows = np.concatenate((off[:-1], cut + 1))[order], rows[order]
    last = np.empty_like(first)
    last[:-1] = first[1:] - 1
    if len(last):
        last[-1] = off[-1]
        final = np.append(rows[1:] != rows[:-1], True)
        last[final] = off[rows[final] + 1]
    solid = np.zeros(len(data) + 1, np.int64)
    solid[starts + 1] = 1
    solid = np.cumsum(solid)  # words that start before a byte
    full = solid[last] > solid[first] if len(first) else np.zeros(0, bool)
    first, last, rows = first[full], last[full], rows[full]
    key = mix(span_hash(sums, first, last) + rows.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    _, at = np.unique(key, return_index=True)
    out["n_lines"] = np.bincount(rows, minlength=n)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(rows[at], minlength=n)
    h, at = windows(span_hash(sums, starts, ends), doc, 3)
    key = mix(h + doc[at].astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    again = covered(at[twice], 3, len(doc))
    out["n_repeat_words"] = np.bincount(doc[again], minlength=n)
    return out


def ledger(docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Keys, measurements and ``fail_bits`` of every row; reads each text once."""
    kept = docs.select(*[F.col(k) for k in keys], F.col(text).alias("__text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "__text")
    schema = f"{kinds}, " + ", ".join(f"{m} long" for m in MEASURES)

    def measure(batches):
        for batch in batches:
            data, off = utf8(batch.column(batch.num_columns - 1))
            for i, j in blocks(off):
                m = _measure(data[off[i] : off[j]], off[i : j + 1] - off[i])
                yield pa.RecordBatch.from_arrays([batch.column(k).slice(i, j - i) for k in range(len(keys))] + [pa.array(m[x], pa.int64()) for x in MEASURES], names=[*keys, *MEASURES])

    rows = kept.mapInArrow(measure, schema)
    bits = F.lit(0).cast("long")
    for k, (_, fails) in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(F.expr(fails), F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
    return rows.withColumn("fail_bits", bits)


def mask(policy: str | tuple[str, ...]) -> int:
    names = [name for name, _ in RULES]
    return sum(1 << names.index(r) for r in (POLICIES[policy] if isinstance(policy, str) else policy))


def passes(policy: str | tuple[str, ...]) -> Column:
    """Whether a ledger row passes a policy."""
    return F.col("fail_bits").bitwiseAND(F.lit(mask(policy))) == 0


def ablations(rows: DataFrame, policy: str = "v1") -> DataFrame:
    """Per rule of a policy: documents that fail it, that fail it alone, and that would be kept without it."""
    bits = F.col("fail_bits").bitwiseAND(F.lit(mask(policy)))
    counts = rows.groupBy(bits.alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = [F.struct(F.lit(name).alias("rule"), F.lit(1 << k).cast("long").alias("bit")) for k, (name, _) in enumerate(RULES) if name in POLICIES[policy]]
    return (
        counts.select("bits", "n", F.explode(F.array(*rules)).alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("failed"),
            F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("failed_alone"),
            F.sum(F.when(F.col("bits").bitwiseAND(F.bitwise_not(F.col("r.bit"))) == 0, F.col("n")).otherwise(0)).alias("kept_without"),
        )
    )


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    """The ledger of all documents with the verdict of the current policy."""
    rows = ledger(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", *MEASURES, "fail_bits", (~passes("base")).alias("base_failed"), passes("v1").alias("kept"))


_WORD = r"[^\x20\x09-\x0D]+"
OP6_SQL = rf"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents),
w as (select rid, doc_id, t, regexp_extract_all(t, '{_WORD}') as ws, string_split(t, chr(10)) as ls from d),
g as (select rid, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] as s
      from (select rid, ws, unnest(range(1, len(ws) - 1)) as i from w where len(ws) >= 3)),
c as (select rid, i, count(*) over (partition by rid, s) as n from g),
p as (select distinct rid, unnest([i, i+1, i+2]) as k from c where n >= 2),
r as (select rid, count(*) as n from p group by rid),
l as (select rid, count(*) as n_lines, count(distinct s) as u
      from (select rid, unnest(ls) as s from w) where regexp_matches(s, '{_WORD}') group by rid),
m as (select w.doc_id, cast(len(ws) as bigint) as n_words,
        cast(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) as bigint) as word_chars,
        cast(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
        cast(coalesce(l.n_lines - l.u, 0) as bigint) as n_dup_lines,
        cast(coalesce(r.n, 0) as bigint) as n_repeat_words,
        cast(coalesce(l.n_lines, 0) as bigint) as n_lines
      from w left join r using (rid) left join l using (rid)),
b as (select *, cast((case when n_words < 50 then 1 else 0 end) + (case when 100 * n_repeat_words > 50 * n_words then 2 else 0 end)
        + (case when word_chars < 2 * n_words then 4 else 0 end) + (case when word_chars > 20 * n_words then 8 else 0 end)
        + (case when 10 * n_symbols > 3 * n_words then 16 else 0 end)
        + (case when n_lines > 4 and 10 * n_dup_lines > 3 * n_lines then 32 else 0 end) as bigint) as fail_bits from m)
select *, (fail_bits & 3) != 0 as base_failed, fail_bits = 0 as kept from b
"""

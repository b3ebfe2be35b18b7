"""Conversations from reply trees, with DataFrame operations alone.

Messages form trees: each names the message that it replies to.  Iterative
self-joins double the reach of every message's pointer towards its root, summing
scores on the way, until all are at a root.  Leaves are ranked by the score of
their branch; the pointers of all rounds then list the messages of the chosen
branches, again by doubling.  Each branch becomes one conversation:

    <|turn|>role
    text<|end|>

Inside roles and texts ``&`` and ``<`` are written ``&amp;`` and ``&lt;`` (and a
newline in a role ``&nl;``), so no control string can occur and reading is exact.
The loss mask is the spans of assistant texts.

Edge cases: null roles and texts are empty; a null conversation is one of its
own.  A message whose parent is missing is a root; messages in a cycle hang on
no root and are in no branch.  Of messages with the same conversation and name
one stays (the least parent, role and text).  Equal scores rank by name.  An
empty table gives no conversation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._links import kept

START, MIDDLE, END = "<|turn|>", "\n", "<|end|>\n"


def escaped(c: Column, line: bool = False) -> Column:
    out = F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    return F.replace(out, F.lit("\n"), F.lit("&nl;")) if line else out


def unescaped(c: Column) -> Column:
    return reduce(lambda x, y: F.replace(x, F.lit(y[0]), F.lit(y[1])), (("&nl;", "\n"), ("&lt;", "<"), ("&amp;", "&")), c)


def branches(messages: DataFrame, keep: int = 1) -> DataFrame:
    """The messages of the ``keep`` best branches of each conversation.

    Messages have ``conv``, ``name``, ``parent``, ``role``, ``text`` and
    ``score``.  Gives ``conv``, ``rank`` (1 is best), ``depth`` (0 is the root),
    ``role`` and ``text``.
    """
    one = Window.partitionBy("c", "z", "name").orderBy("parent", "role", "text")
    keyed = messages.select(F.coalesce("conv", F.lit(0)).alias("c"), F.col("conv").isNull().alias("z"), "name", "parent", "role", "text", F.coalesce("score", F.lit(0.0)).alias("score"))
    keyed = kept(keyed.withColumn("__n", F.row_number().over(one)).where("__n = 1").drop("__n"))
    names = keyed.select("c", "z", F.col("name").alias("jump")).withColumn("there", F.lit(True))
    state = keyed.select("c", "z", "name", F.col("parent").alias("jump"), "score", F.lit(1).cast("long").alias("n")).join(names, ["c", "z", "jump"], "left")
    state = kept(state.select("c", "z", "name", F.when(F.col("there"), F.col("jump")).alias("jump"), "score", "n"))
    rounds, left = [state], state.where("jump is not null").count()
    most = max(1, left).bit_length() + 1
    while left and len(rounds) <= most:
        far = state.select("c", "z", F.col("name").alias("jump"), F.col("jump").alias("next"), F.col("score").alias("more"), F.col("n").alias("m"))
        stay = state.where("jump is null")
        move = state.where("jump is not null").join(far, ["c", "z", "jump"]).select("c", "z", "name", F.col("next").alias("jump"), (F.col("score") + F.col("more")).alias("score"), (F.col("n") + F.col("m")).alias("n"))
        state = kept(stay.unionByName(move))
        left = state.where("jump is not null").count()
        rounds.append(state)
    ended = state.where("jump is null") if left else state
    parents = rounds[0].where("jump is not null").select("c", "z", F.col("jump").alias("name")).distinct()
    leaves = ended.join(parents, ["c", "z", "name"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("c", "z").orderBy(F.desc("score"), "name"))
    chosen = leaves.withColumn("rank", rank).where(F.col("rank") <= keep).select("c", "z", "rank", "name", (F.col("n") - 1).alias("depth"))
    rows = chosen
    for k, state in enumerate(rounds[:-1]):
        step = state.where("jump is not null").select("c", "z", "name", "jump")
        rows = kept(rows.unionByName(rows.join(step, ["c", "z", "name"]).select("c", "z", "rank", F.col("jump").alias("name"), (F.col("depth") - (1 << k)).alias("depth"))))
    out = rows.join(keyed.select("c", "z", "name", "role", "text"), ["c", "z", "name"])
    return out.select(F.when(~F.col("z"), F.col("c")).alias("conv"), "rank", "depth", "role", "text")


def format_branches(rows: DataFrame, learn: str = "assistant") -> DataFrame:
    """``conv``, ``rank``, ``formatted`` and ``loss`` (start and length, in characters, of texts to learn)."""
    head = F.concat(F.lit(START), escaped(F.col("role"), True), F.lit(MIDDLE))
    pieces = rows.select("conv", "rank", "depth", head.alias("head"), escaped(F.col("text")).alias("body"), F.coalesce(F.col("role") == learn, F.lit(False)).alias("learn"))
    size = F.length("head") + F.length("body") + len(END)
    upto = Window.partitionBy("conv", "rank").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    pieces = pieces.withColumn("start", F.sum(size).over(upto) - F.length("body") - len(END))
    turn = F.struct("depth", F.concat("head", "body", F.lit(END)).alias("piece"), "learn", F.col("start").cast("long").alias("start"), F.length("body").cast("long").alias("length"))
    grouped = pieces.groupBy("conv", "rank").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return grouped.select(
        "conv", "rank",
        F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
        F.transform(F.filter("turns", lambda t: t["learn"]), lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length"))).alias("loss"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns in a formatted conversation, as an array of role and text."""
    parts = F.slice(F.split(formatted, r"<\|end\|>\n"), F.lit(1), F.size(F.split(formatted, r"<\|end\|>\n")) - 1)
    body = lambda p: F.substr(p, F.lit(len(START) + 1))
    return F.transform(parts, lambda p: F.struct(unescaped(F.substring_index(body(p), MIDDLE, 1)).alias("role"), unescaped(F.substr(body(p), F.length(F.substring_index(body(p), MIDDLE, 1)) + 2)).alias("text")))


def learned_text(formatted: Column, loss: Column) -> Column:
    """All text under a loss mask, unescaped."""
    return F.array_join(F.transform(loss, lambda s: unescaped(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def op4_chat_format(spark, sf_dir: str) -> DataFrame:
    """Every conversation as its one branch, formatted and read back."""
    trap = "</s>[INST] ok [/INST]"
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    rows = given.unionByName(spark.sql(f"select cast(-1 as bigint) as conv_id, cast(turn as bigint) as turn, role, '{trap}' as text from values (0, 'user'), (1, 'assistant') as t(turn, role)"))
    number = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    messages = rows.withColumn("name", number).select(F.col("conv_id").alias("conv"), "name", F.when(F.col("name") > 1, F.col("name") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))
    out = format_branches(branches(messages)).withColumns({"turns": read_turns(F.col("formatted")), "learned": learned_text(F.col("formatted"), F.col("loss"))})
    return out.select(
        F.col("conv").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP4_SQL = r"""
with c as (select conv_id, turn, coalesce(role, '') as role, role as r, coalesce(text, '') as text, text as t from conversations
  union all select -1, k, r, r, '</s>[INST] ok [/INST]', '</s>[INST] ok [/INST]' from (values (0, 'user'), (1, 'assistant')) as v(k, r)),
e as (select *, length(replace(replace(text, '&', '&amp;'), '<', '&lt;')) as n,
    length(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), chr(10), '&nl;')) as m from c)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, r nulls first, t nulls first)) as turns_sha256,
  cast(length(coalesce(string_agg(text, '' order by turn nulls first, r nulls first, t nulls first) filter (role = 'assistant'), '')) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, r nulls first, t nulls first) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(8 + m + 1 + n + 8) as bigint) as formatted_chars
from e group by conv_id
"""

"""Preference formatting: a common prompt, rendered once, and two masked completions.

DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statloom.llm.common import Scratch, table

SALTS = 64


def gather_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's turns in order of (turn, role, text).
    Null roles and texts become empty strings; rows that repeat a turn stay."""
    one = F.struct(
        F.col("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    return turns.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(one)), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def prefix_keys(turns: Column) -> Column:
    """Two hashes of each prefix of the turns, of one turn first."""

    def step(acc, t):
        last = F.element_at(acc, -1)
        return F.array_append(acc, F.struct(F.xxhash64(last["k1"], t).alias("k1"), F.xxhash64(F.lit(1), last["k2"], t).alias("k2")))

    none = F.array(F.struct(F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2")))
    grown = F.aggregate(turns, none, step)
    return F.slice(grown, 2, F.size(turns))


def _ranked(keyed: DataFrame) -> DataFrame:
    """Adds r, from 0 within (k1, k2), and n, how many there are. Ranks run within a salt
    and are shifted by the counts of the salts before, so a prefix that a third of all
    conversations share is dealt over many tasks."""
    keyed = keyed.withColumn("salt", F.pmod(F.xxhash64("conv_id"), F.lit(SALTS)).cast("int"))
    counts = keyed.groupBy("k1", "k2", "salt").agg(F.count("*").alias("own"))
    all_ = Window.partitionBy("k1", "k2")
    before = all_.orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select("k1", "k2", "salt", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("shift"), F.sum("own").over(all_).alias("n"))
    within = Window.partitionBy("k1", "k2", "salt").orderBy("conv_id")
    ranked = keyed.withColumn("own", F.row_number().over(within) - 1).join(shift, ["k1", "k2", "salt"])
    return ranked.withColumn("r", F.col("own") + F.col("shift")).drop("own", "shift", "salt")


def match_by_prefix(convs: DataFrame) -> DataFrame:
    """(conv_id, depth, k1, k2, pair, second): conversations that share turns from the first
    on, two and two. The deepest prefix is matched first; who is left over there goes on to
    the next shorter one. Only depths at which a prefix is shared take a round."""
    scratch = Scratch(convs.sparkSession, "preferences")
    each = convs.select("conv_id", F.posexplode(prefix_keys(F.col("turns"))).alias("depth", "k")).select("conv_id", "depth", "k.k1", "k.k2")
    often = each.groupBy("depth", "k1", "k2").count().where("count > 1").drop("count")
    left = scratch.put(each.join(often, ["depth", "k1", "k2"]).select("conv_id", "depth", "k1", "k2"))
    done = left.limit(0).select("conv_id", "depth", "k1", "k2", F.lit(0).cast("long").alias("pair"), F.lit(False).alias("second"))
    for row in left.select("depth").distinct().orderBy(F.desc("depth")).collect():
        ranked = _ranked(left.where(F.col("depth") == row.depth)).where("r < n - n % 2")
        now = scratch.put(ranked.select("conv_id", "depth", "k1", "k2", F.shiftright("r", 1).alias("pair"), (F.col("r") % 2 == 1).alias("second")))
        done = done.unionByName(now)
        left = scratch.put(left.where(F.col("depth") < row.depth).join(now.select("conv_id"), "conv_id", "left_anti"))
    return done


def pair_by_opening(convs: DataFrame) -> DataFrame:
    """(chosen_id, rejected_id, chosen, rejected): conversations with the same first
    turn, two and two, those with the longest common prefix first (match_by_prefix), in a
    fixed order (of a hash of conv_id, then conv_id), the first as chosen; the last of an
    odd number, or a single one, has no rejected one.

    Only ids and hashes are matched; the turns join them where they lie and are shuffled
    once, to their pair. Turns without a conv_id are one conversation, which pairs with none."""
    named = convs.where("conv_id is not null")
    row = F.struct("conv_id", "turns")
    own = [F.coalesce("depth", F.lit(-1)).alias("depth"), F.coalesce("k1", F.xxhash64("conv_id")).alias("k1"), F.coalesce("k2", F.xxhash64(F.lit(1), F.col("conv_id"))).alias("k2"), F.coalesce("pair", F.lit(0)).alias("pair")]
    keyed = named.join(match_by_prefix(named), "conv_id", "left").select("conv_id", "turns", *own, F.coalesce("second", F.lit(False)).alias("second"))
    paired = keyed.groupBy("depth", "k1", "k2", "pair").agg(F.max(F.when(~F.col("second"), row)).alias("c"), F.max(F.when(F.col("second"), row)).alias("x"))
    paired = paired.select(F.col("c.conv_id").alias("chosen_id"), F.col("x.conv_id").alias("rejected_id"), F.col("c.turns").alias("chosen"), F.col("x.turns").alias("rejected"))
    nameless = convs.where("conv_id is null")
    return paired.unionByName(nameless.select(F.col("conv_id").alias("chosen_id"), F.col("conv_id").alias("rejected_id"), F.col("turns").alias("chosen"), F.when(F.lit(False), F.col("turns")).alias("rejected")))


def own_rejected(pairs: DataFrame) -> DataFrame:
    """Gives a conversation without a rejected one a variant of its own: up to its last
    assistant turn, in whose place stands the nearest earlier assistant turn of another
    text. rejected_id is then chosen_id. Without such a turn it stays alone."""
    c = F.col("chosen")
    back = F.array_position(F.reverse(F.transform(c, lambda t: t["role"])), "assistant")
    head = F.slice(c, 1, F.greatest(F.size(c) - back, F.lit(0)).cast("int"))
    last = F.get(c, (F.size(c) - back).cast("int"))
    other = F.filter(head, lambda t: (t["role"] == "assistant") & (t["text"] != last["text"]))
    fit = F.col("rejected").isNull() & (back > 0) & (F.size(other) > 0)
    variant = F.concat(head, F.slice(other, -1, 1))
    return pairs.select("chosen_id", F.when(fit, F.col("chosen_id")).otherwise(F.col("rejected_id")).alias("rejected_id"), "chosen", F.when(fit, variant).otherwise(F.col("rejected")).alias("rejected"))


def common_turns(chosen: Column, rejected: Column) -> Column:
    """How many turns, from the first, are equal in role and text."""
    same = F.zip_with(chosen, rejected, lambda a, b: a.eqNullSafe(b))
    first_other = F.array_position(same, False)
    return F.when(first_other > 0, first_other - 1).otherwise(F.least(F.size(chosen), F.size(rejected))).cast("int")


def render(turns: Column) -> Column:
    """Turns as text: <|role|>, a line break, the text, <|end|> and a line break."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit("<|end|>\n"))), "")


def spans(turns: Column) -> Column:
    """(role, start, length) of each turn in the rendered text, in characters; start
    and length cover text and end mark of assistant turns, which carry the loss."""
    sizes = F.transform(turns, lambda t: F.struct(t["role"].alias("role"), (F.length(t["role"]) + 5).alias("head"), (F.length(t["text"]) + 8).alias("body")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("out"))

    def step(acc, t):
        here = F.struct((acc["at"] + t["head"]).cast("int").alias("start"), t["body"].cast("int").alias("length"))
        out = F.when(t["role"] == "assistant", F.array_append(acc["out"], here)).otherwise(acc["out"])
        return F.struct((acc["at"] + t["head"] + t["body"]).cast("int").alias("at"), out.alias("out"))

    return F.aggregate(sizes, start, step)["out"]


def format_preferences(pairs: DataFrame) -> DataFrame:
    """Adds n_prompt_turns, prompt, chosen_text, rejected_text, chosen_mask and
    rejected_mask to (chosen_id, rejected_id, chosen, rejected).

    The prompt is the longest common turn prefix, rendered once. Where one conversation
    is the other's prefix, or both are equal, the prompt ends before their last common
    assistant turn, so that no completion of a chosen one is empty while it has an
    assistant turn. Without a rejected one the prompt ends before the last assistant
    turn, and its text and mask are null. Masks list the (start, length) of the
    characters of a completion that carry loss; the prompt carries none."""
    c, x = F.col("chosen"), F.col("rejected")
    lcp = F.when(x.isNull(), F.size(c)).otherwise(common_turns(c, x))
    # The last assistant turn among the first lcp turns, as a number of turns before it.
    head = F.slice(c, 1, F.greatest("lcp", F.lit(0)))
    roles = F.reverse(F.transform(head, lambda t: t["role"]))
    back = F.array_position(roles, "assistant")
    short = F.when(back > 0, F.col("lcp") - back).otherwise(F.col("lcp"))
    least = F.when(x.isNull(), F.size(c)).otherwise(F.least(F.size(c), F.size(x)))
    n = F.when(F.col("lcp") >= least, short).otherwise(F.col("lcp")).cast("int")
    out = pairs.withColumn("lcp", lcp).withColumn("n_prompt_turns", n)
    rest = lambda t: F.slice(t, F.col("n_prompt_turns") + 1, F.greatest(F.size(t) - F.col("n_prompt_turns"), F.lit(0)))
    return out.select(
        "chosen_id",
        "rejected_id",
        "n_prompt_turns",
        render(F.slice(c, 1, F.col("n_prompt_turns"))).alias("prompt"),
        render(rest(c)).alias("chosen_text"),
        F.when(x.isNotNull(), render(rest(x))).alias("rejected_text"),
        spans(rest(c)).alias("chosen_mask"),
        F.when(x.isNotNull(), spans(rest(x))).alias("rejected_mask"),
    )


def op2_query(spark, sf_dir):
    """One row per pair, or per conversation without a counterpart: sizes and digests
    of prompt and completions, and the characters that carry loss."""
    turns = gather_turns(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    # Written, as matching and pairing both read them: turns are gathered once.
    pairs = pair_by_opening(Scratch(spark, "conversations").put(turns))
    out = format_preferences(own_rejected(pairs))
    sha = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    loss = lambda m: F.aggregate(m, F.lit(0).cast("long"), lambda a, s: a + s["length"])
    return out.select(
        "chosen_id",
        "rejected_id",
        F.col("n_prompt_turns").cast("long").alias("n_prompt_turns"),
        sha("prompt").alias("prompt_sha256"),
        sha("chosen_text").alias("chosen_sha256"),
        sha("rejected_text").alias("rejected_sha256"),
        loss("chosen_mask").alias("chosen_loss_chars"),
        loss("rejected_mask").alias("rejected_loss_chars"),
    )

"""Preference pairs: a shared prompt and two masked completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEARNT = "assistant"  # the role whose turns count in the loss


def _plain(text: Column) -> Column:
    """A turn's text; a blank breaks what would read as a marker; null is empty."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))


def head(turn: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(turn["role"], F.lit("")), F.lit("|>\n"))


def body(turn: Column) -> Column:
    """What a model has to produce of a turn: its text and the end marker."""
    return F.concat(_plain(turn["text"]), F.lit("<|end|>"))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(head(t), body(t), F.lit("\n"))), "")


def learnt_spans(turns: Column) -> Column:
    """``start-end`` (characters of the rendered turns) of every learnt turn's body, joined by commas."""

    def step(acc: Column, t: Column) -> Column:
        start = acc["at"] + F.length(head(t))
        end = start + F.length(body(t))
        span = F.when(t["role"] == LEARNT, F.concat(start.cast("string"), F.lit("-"), end.cast("string")))
        return F.struct((end + 1).alias("at"), F.concat(acc["spans"], F.coalesce(F.array(span), F.array())).alias("spans"))

    spans = F.aggregate(turns, F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans")), step)["spans"]
    return F.array_join(spans, ",")  # turns of other roles left nulls, which the join skips


def preferences(pairs: DataFrame) -> DataFrame:
    """Training rows of ``pairs(chosen, rejected, ...)``, both ``array<struct<role, text>>``.

    ``prompt`` renders the longest common turn prefix once (``n_prompt`` turns; so
    short that each side keeps a turn); ``chosen_text, rejected_text`` render what
    follows, and ``chosen_mask, rejected_mask`` name the characters of it that
    count in the loss: the learnt role's texts with their end markers, not the
    headers and no other role's turns.

    ``status`` is ``pair``, ``identical`` (nothing to prefer: the prompt is all but the
    last turn) or ``incomplete`` (a side is null or empty: the prompt is what there is,
    completions are empty).  A null role or text equals a null one and renders as
    empty.  All is row by row: no shuffle, whatever the length.  Other columns stay;
    columns with the names of the result are replaced.
    """
    none = F.array().cast("array<struct<role:string,text:string>>")
    side = {c: F.coalesce(F.transform(F.col(c), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))), none) for c in ("chosen", "rejected")}
    rows = pairs.withColumns({"__c": side["chosen"], "__r": side["rejected"]})
    fewer = F.least(F.size("__c"), F.size("__r"))
    same = F.zip_with(F.slice("__c", F.lit(1), fewer), F.slice("__r", F.lit(1), fewer), lambda x, y: x.eqNullSafe(y))
    differ = F.array_position(same, F.lit(False))
    common = F.when(differ > 0, differ - 1).otherwise(fewer)
    rows = rows.withColumn("__n", F.greatest(F.least(common, fewer - 1), F.lit(0)).cast("int")).withColumn("__whole", fewer > 0)
    status = F.when(~F.col("__whole"), "incomplete").when((F.size("__c") == F.size("__r")) & (common == fewer), "identical").otherwise("pair")
    rows = rows.withColumn("status", status)
    n = F.col("__n")
    prompt = F.when(F.col("__whole"), F.slice("__c", F.lit(1), n)).otherwise(F.when(F.size("__c") > 0, F.col("__c")).otherwise(F.col("__r")))

    def rest(c: str) -> Column:
        return F.when(F.col("__whole"), F.slice(c, n + 1, F.greatest(F.size(c) - n, F.lit(0)))).otherwise(none)

    new = {
        "n_prompt": F.size(prompt).cast("long"),
        "prompt": rendered(prompt),
        "chosen_text": rendered(rest("__c")),
        "chosen_mask": learnt_spans(rest("__c")),
        "rejected_text": rendered(rest("__r")),
        "rejected_mask": learnt_spans(rest("__r")),
    }
    keep = [c for c in pairs.columns if c not in (*new, "status", "chosen", "rejected")]
    return rows.select(*keep, "status", *[v.alias(k) for k, v in new.items()])


def borrowed_pairs(turns: DataFrame) -> DataFrame:
    """``conv_id, chosen, rejected`` from ``turns(conv_id, turn, role, text)``, which name no preferences.

    Chosen is a conversation up to its last learnt turn.  Rejected has the last
    learnt text of the partner conversation in its place (ids 2k and 2k+1 are
    partners; an empty text without one): an answer to another question.  A
    conversation without a learnt turn has no rejected side.

    A conversation is one record, so its turns meet in one row; they are ordered by
    turn, role and text.  Rows with a null conv_id belong to no conversation and
    give none.
    """
    t = turns.where("conv_id is not null").select(F.col("conv_id").cast("long"), F.struct(*[F.col(c).cast(k).alias(c) for c, k in (("turn", "long"), ("role", "string"), ("text", "string"))]).alias("t"))
    conv = t.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("all"))
    last = F.array_max(F.transform("all", lambda x, i: F.when(x["role"] == LEARNT, i + 1)))
    conv = conv.select("conv_id", "all", last.alias("last"))
    reply = conv.where("last is not null").select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), F.coalesce(F.element_at("all", F.col("last"))["text"], F.lit("")).alias("other"))
    both = conv.join(reply, "conv_id", "left")
    upto = F.slice("all", F.lit(1), F.coalesce("last", F.size("all")))
    plain = F.transform(upto, lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    changed = F.concat(F.slice(plain, F.lit(1), F.col("last") - 1), F.array(F.struct(F.lit(LEARNT).alias("role"), F.coalesce("other", F.lit("")).alias("text"))))
    return both.select("conv_id", plain.alias("chosen"), F.when(F.col("last").isNotNull(), changed).alias("rejected"))

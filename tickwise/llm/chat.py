r"""Chat formatting in token-budgeted windows (DataFrame functions only).

Template.  A turn is written as ``<|role|>\n`` + text + ``<|end|>\n``; inside
role and text every backslash and every ``|`` gets a backslash before it, so
no marker can occur in them and unescaping is exact.

Windows.  Prefix sums of turn tokens cut a conversation into turn-aligned
spans: a new span starts where the prefix sum enters the next stride, and
around a turn too long for the stride's reserve.  Every span of ordinary turns
fits the budget left by the system turn and the history.  A window is the
conversation's first system turn, wherever it stands before the span, a limited
history of the turns just before the span (at most ``history`` tokens), and the
span.  A system turn of more than half the budget stays in the window it stands
in and is not repeated, so the output is at most a small multiple of the input.  Repeated turns are
masked: only assistant texts of the span are targets, so each assistant text is
a target exactly once.  No turn is cut or dropped; a single turn longer than
the budget makes a window of its own that exceeds it.

Rows without conv_id form one conversation of their own; null role or text
counts as empty; repeated rows and equal turn numbers are kept and ordered by
(turn, role, text), null turns first; an empty table gives no windows; further
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUDGET = 512     # tokens of a window
HISTORY = 128    # tokens of repeated turns before the span
OVERHEAD = 4     # tokens that a turn's markers count for

# The template's markers.
OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\|])", r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def n_tokens(text: Column) -> Column:
    """Tokens of a turn: words and single other signs, plus the markers' share."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]")) + OVERHEAD


def _render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(CLOSE), text, F.lit(END))


def format_windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """(conv_id, window, n_repeated, n_tokens, formatted, loss_spans): one row per window.

    ``loss_spans`` holds (start, length) in code points of ``formatted``.
    """
    if not 0 <= history < budget:
        raise ValueError("history must be under the budget")
    clean = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("raw"))
    clean = clean.withColumn("tokens", n_tokens(F.col("raw")).cast("long"))
    clean = clean.select("conv_id", "turn", "role", "raw", "tokens", escape(F.col("role")).alias("erole"),
                         escape(F.col("raw")).alias("text"))
    order = [F.asc_nulls_first("turn"), F.col("role"), F.col("raw")]
    by = Window.partitionBy("conv_id").orderBy(*order)
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    whole = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    placed = clean.select(
        "*", F.row_number().over(by).alias("pos"), F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("at"),
        F.when(F.col("role") == "system", F.struct(F.row_number().over(by).alias("pos"), "tokens", "erole", "text")).alias("own_system"))
    # the first system turn, wherever it stands; one of more than half the budget is not repeated
    first = F.first("own_system", ignorenulls=True).over(whole)
    placed = placed.withColumn("system", F.when(first["tokens"] <= budget // 2, first))
    # budget left for the span; a share of it is kept for the turn that crosses the end of a stride
    room = F.greatest(F.lit(budget - history) - F.coalesce(F.col("system.tokens"), F.lit(0)), F.lit(2 * OVERHEAD))
    placed = (placed.withColumn("stride", F.ceil(room / 2)).withColumn("bucket", F.floor(F.col("at") / F.col("stride")))
              .withColumn("long", F.col("tokens") > room - F.col("stride")))
    step = Window.partitionBy("conv_id").orderBy("pos")
    placed = placed.withColumn("starts", F.coalesce(
        (F.col("bucket") != F.lag("bucket").over(step)) | F.col("long") | F.lag("long").over(step), F.lit(True)))
    upto = step.rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("window", F.sum(F.col("starts").cast("long")).over(upto))
    # history of a span's first turn: turns whose prefix sum lies in the last `history` tokens
    recent = Window.partitionBy("conv_id").orderBy("at").rangeBetween(-history, -1)
    turn = F.struct("pos", "tokens", "erole", "text")
    placed = placed.withColumn("recent", F.collect_list(turn).over(recent)).withColumn(
        "repeated", F.when(F.col("starts") & (F.col("window") > 1), F.concat(
            F.when(F.col("system.pos") < F.col("pos"), F.array(F.struct(
                F.lit(0).alias("pos"), F.col("system.tokens").alias("tokens"), F.col("system.erole").alias("erole"),
                F.col("system.text").alias("text")))).otherwise(F.array().cast("array<struct<pos:int,tokens:bigint,erole:string,text:string>>")),
            F.filter("recent", lambda t: ~t["pos"].eqNullSafe(F.col("system.pos"))))))
    rows = placed.groupBy("conv_id", "window").agg(
        F.array_sort(F.collect_list(F.struct("pos", "tokens", "erole", "text", "role"))).alias("own"),
        F.max("repeated").alias("repeated"))
    prefix = F.coalesce(F.concat_ws("", F.transform("repeated", lambda t: _render(t["erole"], t["text"]))), F.lit(""))
    rows = rows.select(
        "conv_id", "window", "own", prefix.alias("prefix"), F.coalesce(F.size("repeated"), F.lit(0)).alias("n_repeated"),
        F.transform("own", lambda t: _render(t["erole"], t["text"])).alias("parts"),
        (F.aggregate("own", F.lit(0).cast("long"), lambda s, t: s + t["tokens"])
         + F.coalesce(F.aggregate("repeated", F.lit(0).cast("long"), lambda s, t: s + t["tokens"]), F.lit(0))).alias("n_tokens"))
    # (offset behind the turn, spans so far): one pass over the turns of the span
    spans = "array<struct<start:int,length:int>>"
    walked = F.aggregate(
        "own", F.struct(F.length("prefix").alias("off"), F.array().cast(spans).alias("spans")),
        lambda s, t: F.struct(
            (s["off"] + F.length(t["erole"]) + F.length(t["text"]) + len(OPEN + CLOSE + END)).alias("off"),
            F.when(t["role"] == "assistant", F.concat(s["spans"], F.array(F.struct(
                (s["off"] + F.length(t["erole"]) + len(OPEN + CLOSE)).alias("start"),
                F.length(t["text"]).alias("length"))))).otherwise(s["spans"]).alias("spans")))
    return rows.select("conv_id", "window", "n_repeated", "n_tokens",
                       F.concat("prefix", F.concat_ws("", "parts")).alias("formatted"),
                       walked["spans"].alias("loss_spans"))


def read_back(windows: DataFrame) -> DataFrame:
    """Digest of every conversation, read only from the formatted windows and their masks."""
    turns = F.slice(F.split("formatted", r"<\|end\|>\n"), F.col("n_repeated") + 1,
                    F.greatest(F.size(F.split("formatted", r"<\|end\|>\n")) - 1 - F.col("n_repeated"), F.lit(0)))
    head = r"(?s)^<\|((?:[^\\|]++|\\.)*+)\|>\n(.*)$"
    parsed = windows.select(
        "conv_id", "window", F.length("formatted").alias("chars"),
        F.transform(turns, lambda t: F.concat(unescape(F.regexp_extract(t, head, 1)), F.lit("\n"),
                                              unescape(F.regexp_extract(t, head, 2)), F.lit("\n"))).alias("turns"),
        F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"]))).alias("loss"))
    rows = parsed.select("conv_id", "window", "chars", F.size("turns").alias("n"),
                         F.concat_ws("", "turns").alias("turns"), F.concat_ws("", "loss").alias("loss"))
    agg = rows.groupBy("conv_id").agg(
        F.sum("n").cast("long").alias("n_turns"), F.sum("chars").cast("long").alias("formatted_chars"),
        F.array_sort(F.collect_list(F.struct("window", "turns", "loss"))).alias("w"), F.count("*").alias("n_windows"))
    loss = F.concat_ws("", F.transform("w", lambda x: x["loss"]))
    return agg.select("conv_id", "n_turns", F.sha2(F.concat_ws("", F.transform("w", lambda x: x["turns"])), 256).alias("turns_sha256"),
                      F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
                      "formatted_chars", "n_windows")

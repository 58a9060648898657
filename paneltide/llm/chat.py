"""Chat formatting in budgeted windows, with DataFrame functions only.

Turns of a conversation are cut into spans by prefix sums of their tokens: with a stride of
half of what the budget leaves beside the system turn and the history, a span is the
turns that end inside one stride; a turn longer than a stride is a span of its own. A span
is never cut inside a turn. Each window is the conversation's first system turn, a few turns
before the span as far as they fit ``history`` tokens, and the span. The loss mask covers
the texts of the span's assistant turns; repeated turns are masked, so that each
assistant text is a target exactly once.

Template, for each turn: ``<|im_start|>role`` newline text ``<|im_end|>`` newline. In texts
every backslash is doubled and ``<|`` becomes ``<\\|``, so that no text can hold a control
string; roles also have their new lines replaced. Both are undone when windows are read.

Defined cases: a null text or role is empty; rows with equal turn numbers are ordered by
role and text, a null turn comes first; a turn longer than the budget makes a window
that exceeds it, and is not cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paneltide.session import materialized

START, END = "<|im_start|>", "<|im_end|>"
#: Tokens of a window, at most tokens of repeated history, at most repeated turns.
BUDGET, HISTORY, HISTORY_TURNS = 512, 96, 4
#: A turn's tokens: runs of letters or digits and single other signs, plus the marks around it.
TOKEN = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"
MARKS = 4


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def escaped_role(role: Column) -> Column:
    out = F.replace(role, F.lit("%"), F.lit("%25"))
    return F.replace(F.replace(out, F.lit("\n"), F.lit("%0A")), F.lit("<"), F.lit("%3C"))


def unescaped_role(role: Column) -> Column:
    out = F.replace(F.replace(role, F.lit("%3C"), F.lit("<")), F.lit("%0A"), F.lit("\n"))
    return F.replace(out, F.lit("%25"), F.lit("%"))


def spans(
    turns: DataFrame, budget: int = BUDGET, history: int = HISTORY
) -> DataFrame:
    """``turns`` (conv_id, turn, role, text) with place, tokens and the number of the span."""
    clean = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    clean = clean.withColumn("tokens", F.regexp_count("text", F.lit(TOKEN)).cast("long") + MARKS)
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    placed = clean.withColumn("place", F.row_number().over(order))
    everything = Window.partitionBy("conv_id")
    systems = F.min(F.when(F.col("role") == "system", F.col("place"))).over(everything)
    placed = placed.withColumn("system_place", systems)
    system_tokens = F.max(F.when(F.col("place") == F.col("system_place"), F.col("tokens"))).over(everything)
    stride = F.greatest((budget - history - F.coalesce(system_tokens, F.lit(0))) / 2, F.lit(MARKS)).cast("long")
    placed = placed.withColumn("stride", stride)
    upto = Window.partitionBy("conv_id").orderBy("place")
    large = (F.col("tokens") > F.col("stride")).cast("long")
    # a large turn, and the turn after one, begin a new part
    placed = placed.withColumn("_large", large).withColumn("_before", F.coalesce(F.lag(large).over(upto), F.lit(0)))
    placed = placed.withColumn("_part", F.sum(F.col("_large") + F.col("_before")).over(upto))
    inside = Window.partitionBy("conv_id", "_part").orderBy("place")
    ends = F.sum("tokens").over(inside)
    placed = placed.withColumn("_step", F.floor((ends - 1) / F.col("stride")))
    fresh = (F.col("_part") != F.lag("_part", 1, -1).over(upto)) | (F.col("_step") != F.lag("_step", 1, -1).over(upto))
    placed = placed.withColumn("_fresh", fresh.cast("long"))
    return placed.withColumn("span", F.sum("_fresh").over(upto)).drop("_large", "_before", "_part", "_step", "_fresh", "stride")


def windows(
    turns: DataFrame,
    *,
    budget: int = BUDGET,
    history: int = HISTORY,
    history_turns: int = HISTORY_TURNS,
) -> DataFrame:
    """One row per window: conv_id, window, formatted, n_repeated, n_turns, tokens, loss_spans.

    ``loss_spans`` holds (start, length) in code points of ``formatted``, from zero.
    """
    placed = materialized(spans(turns, budget, history))
    by_place = Window.partitionBy("conv_id").orderBy("place")
    turn = F.struct("place", "role", "text", "tokens")
    before = F.collect_list(turn).over(by_place.rowsBetween(-history_turns, -1))
    first = placed.withColumn("_history", before).withColumn("_lag", F.lag("span", 1, 0).over(by_place))
    # the turns before each span's first turn, as far back as they fit
    first = first.where(F.col("span") != F.col("_lag"))
    fitting = F.filter(
        "_history",
        lambda x: (
            F.aggregate(
                F.filter("_history", lambda y: y["place"] >= x["place"]), F.lit(0).cast("long"), lambda acc, y: acc + y["tokens"]
            ) <= history
        ) & ~x["place"].eqNullSafe(F.col("system_place")),
    )
    context = first.select("conv_id", "span", F.explode(fitting).alias("t")).select("conv_id", "span", "t.*")
    opening = placed.where(F.col("place") == F.col("system_place")).select("conv_id", "place", "role", "text", "tokens")
    later = first.where(F.col("place") > F.col("system_place")).select("conv_id", "span")
    context = context.unionByName(later.join(opening, "conv_id"))
    own = placed.select("conv_id", "span", "place", "role", "text", "tokens", F.lit(False).alias("repeated"))
    rows = own.unionByName(context.withColumn("repeated", F.lit(True)))
    head = F.concat(F.lit(START), escaped_role(F.col("role")), F.lit("\n"))
    body = escaped(F.col("text"))
    rows = rows.select(
        "conv_id",
        "span",
        "place",
        "repeated",
        "tokens",
        (F.col("role") == "assistant").alias("answer"),
        head.alias("head"),
        body.alias("body"),
    )
    listed = F.sort_array(F.collect_list(F.struct("place", "repeated", "answer", "tokens", "head", "body")))
    packed = rows.groupBy("conv_id", "span").agg(listed.alias("t"))  # the turns of one window
    size = F.transform("t", lambda x: F.length(x["head"]) + F.length(x["body"]) + F.length(F.lit(END + "\n")))
    packed = packed.withColumn("_size", size)
    packed = packed.withColumn(
        "_start",
        F.aggregate(
            "_size",
            F.array(F.lit(0)),
            lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)),
        ),
    )
    marked = F.filter(
        F.transform(
            "t",
            lambda x, i: F.struct(
                (F.get("_start", i) + F.length(x["head"])).cast("long").alias("start"),
                F.length(x["body"]).cast("long").alias("length"),
                (x["answer"] & ~x["repeated"]).alias("target"),
            ),
        ),
        lambda s: s["target"],
    )
    return packed.select(
        "conv_id",
        F.col("span").alias("window"),
        F.array_join(F.transform("t", lambda x: F.concat(x["head"], x["body"], F.lit(END + "\n"))), "").alias("formatted"),
        F.size(F.filter("t", lambda x: x["repeated"])).cast("long").alias("n_repeated"),
        F.size("t").cast("long").alias("n_turns"),
        F.aggregate("t", F.lit(0).cast("long"), lambda acc, x: acc + x["tokens"]).alias("tokens"),
        F.transform(marked, lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length"))).alias("loss_spans"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """One row per window with the turns and target texts that its formatted text holds.

    ``turns`` are (role, text) of the turns that are not repeated, ``targets`` the texts
    under the loss mask, all unescaped.
    """
    pieces = F.split(F.col("formatted"), r"<\|im_end\|>\n")
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    own = F.slice(pieces, F.col("n_repeated").cast("int") + 1, F.greatest(F.size(pieces) - F.col("n_repeated").cast("int"), F.lit(0)))
    parsed = F.transform(
        own,
        lambda p: F.struct(
            unescaped_role(F.substring_index(F.substr(p, F.lit(len(START) + 1)), "\n", 1)).alias("role"),
            unescaped(F.substr(p, F.locate("\n", p) + 1)).alias("text"),
        ),
    )
    under = F.transform(
        "loss_spans", lambda s: unescaped(F.substr("formatted", (s["start"] + 1).cast("int"), s["length"].cast("int")))
    )
    return formatted.select("conv_id", "window", parsed.alias("turns"), under.alias("targets"), F.length("formatted").alias("n_chars"))


def conversation_report(turns: DataFrame, **options) -> DataFrame:
    """One row per conversation, read back from its windows."""
    made = read_back(windows(turns, **options))
    line = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    window = F.struct(
        "window",
        line.alias("line"),
        F.array_join("targets", "").alias("loss"),
        F.size("turns").cast("long").alias("n"),
        F.col("n_chars").cast("long").alias("n_chars"),
    )
    whole = made.groupBy("conv_id").agg(F.sort_array(F.collect_list(window)).alias("w"))
    loss = F.array_join(F.transform("w", lambda x: x["loss"]), "")

    def total(name: str) -> Column:
        return F.aggregate("w", F.lit(0).cast("long"), lambda acc, x: acc + x[name])

    return whole.select(
        "conv_id",
        total("n").alias("n_turns"),
        F.sha2(F.array_join(F.transform("w", lambda x: x["line"]), ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        total("n_chars").alias("formatted_chars"),
    )

"""Chat formatting in budgeted windows, with DataFrame functions only.

The tokens of a turn are estimated as a quarter of its characters, rounded up, plus
``TURN_TOKENS``. Running sums of them cut a conversation into windows at turns: a turn belongs
to the window in whose stretch of ``STRIDE`` tokens it starts. A window repeats the
system turn, then the last turns before it that start at most ``HISTORY`` tokens back, and
then holds its own turns. With turns of at most ``STRIDE`` tokens and a system turn within
``SYSTEM`` a window stays within ``BUDGET``; a longer turn is kept whole.

A turn is written ``<|turn|>role`` newline text ``<|end|>`` newline, a repeated one begins with
``<|past|>``. In texts and roles & becomes &amp; and < becomes &lt;, and in roles a newline
becomes &#10;, so no mark can appear inside; undoing it in reverse gives back every text. The
loss mask covers the texts of assistant turns in the one window where they are not repeated.

All rows are sorted by ranges and written once; running sums are made per ``BIN`` rows in that
order and then over bins, so a conversation that holds much of the table is split over tasks,
also if its turn numbers are null, equal or far apart. Rows of one conversation are ordered by turn, then role,
then text; nulls come first, repeated rows are separate turns. Null texts and roles count as
empty, null conversation ids as one conversation. An empty table gives an empty table, other
columns are ignored.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillworks.session import cut_lineage

BUDGET = 2048
HISTORY = 256
SYSTEM = 256
STRIDE = (BUDGET - HISTORY - SYSTEM) // 2
TURN_TOKENS = 4
BIN = 512
OWN, PAST, END = "<|turn|>", "<|past|>", "<|end|>\n"


def escape(text):
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def unescape(text):
    return F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def _role_out(role):
    return F.replace(escape(role), F.lit("\n"), F.lit("&#10;"))


def _role_in(role):
    return unescape(F.replace(role, F.lit("&#10;"), F.lit("\n")))


def number_turns(turns: DataFrame) -> DataFrame:
    """conv, position (from 1), start (tokens before), role, text, system, window."""
    rows = turns.select(
        F.col("conv_id").cast("bigint").alias("conv"), F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn(
        "tokens", TURN_TOKENS + F.ceil(F.char_length("text") / 4))
    # equal rows may take any order, so chance may deal them out
    keys = ["conv", F.asc_nulls_first("turn"), "role", "text", F.rand(10)]
    rows = cut_lineage(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(
        "at", F.monotonically_increasing_id())).withColumn("bin", F.floor(F.col("at") / BIN))
    totals = rows.groupBy("conv", "bin").agg(F.sum("tokens").alias("tokens"),
                                             F.count("*").alias("rows"))
    earlier = Window.partitionBy("conv").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = cut_lineage(totals.select(
        "conv", "bin", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).alias("before"),
        F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("above")))
    order = Window.partitionBy("conv", "bin").orderBy("at")
    so_far = order.rowsBetween(Window.unboundedPreceding, -1)
    b = bins.select(F.col("conv").alias("b_conv"), F.col("bin").alias("b_bin"), "before", "above")
    placed = rows.join(b, F.col("conv").eqNullSafe(F.col("b_conv")) & (F.col("bin") == F.col(
        "b_bin"))).select(
        "conv", "role", "text", "tokens",
        (F.col("above") + F.row_number().over(order)).alias("position"),
        (F.col("before") + F.coalesce(F.sum("tokens").over(so_far), F.lit(0))).alias("start"))
    return placed.withColumn("system", (F.col("position") == 1) & (F.col("role") == "system")
                             ).withColumn("window", F.floor(F.col("start") / STRIDE))


def _same(left, right):
    return F.col(left).eqNullSafe(F.col(right))


def windows(turns: DataFrame) -> DataFrame:
    """One row per window: conv_id, window, formatted, loss (array of begin, length in characters)
    and tokens.

    ``turns`` has conv_id, turn, role and text.
    """
    numbered = cut_lineage(number_turns(turns))
    opened = cut_lineage(numbered.groupBy(F.col("conv").alias("w_conv"), F.col("window").alias(
        "w_window")).agg(F.min("start").alias("opens")))
    own = numbered.withColumn("past", F.lit(False))
    # a turn short enough to be history ends before the window after the next begins
    history = numbered.where("not system").join(
        opened, _same("conv", "w_conv") & (F.col("w_window") == F.col("window") + 1)).where(
        F.col("opens") - F.col("start") <= HISTORY).withColumn(
        "window", F.col("w_window")).withColumn("past", F.lit(True)).select(own.columns)
    system = numbered.where("system").join(
        opened, _same("conv", "w_conv") & (F.col("w_window") != F.col("window"))).withColumn(
        "window", F.col("w_window")).withColumn("past", F.lit(True)).select(own.columns)
    head = F.concat(F.when(F.col("past"), PAST).otherwise(OWN), _role_out(F.col("role")),
                    F.lit("\n"))
    pieces = own.unionByName(history).unionByName(system).select(
        "conv", "window", "position", "tokens",
        (~F.col("past") & (F.col("role") == "assistant")).alias("learn"), head.alias("head"),
        escape(F.col("text")).alias("body"))
    grouped = pieces.groupBy("conv", "window").agg(
        F.sort_array(F.collect_list(F.struct("position", "head", "body", "learn"))).alias("p"),
        F.sum("tokens").alias("tokens"))
    # begin of each body: what was written before it
    ends = F.aggregate(
        "p", F.struct(F.lit(0).alias("at"),
                      F.array().cast("array<struct<begin:int,length:int>>").alias("loss")),
        lambda acc, x: F.struct(
            (acc["at"] + F.char_length(x["head"]) + F.char_length(x["body"]) + len(END)).alias("at"),
            F.when(x["learn"], F.concat(acc["loss"], F.array(F.struct(
                (acc["at"] + F.char_length(x["head"])).alias("begin"),
                F.char_length(x["body"]).alias("length"))))).otherwise(acc["loss"]).alias("loss")))
    return grouped.select(
        F.col("conv").alias("conv_id"), "window",
        F.array_join(F.transform("p", lambda x: F.concat(x["head"], x["body"], F.lit(END))),
                     "").alias("formatted"),
        ends["loss"].alias("loss"), "tokens")


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, from windows alone: turns and loss text.

    conv_id, n_turns, turns (role, newline, text, newline of each), loss, formatted_chars.
    """
    pieces = F.slice(F.split("formatted", r"<\|turn\|>|<\|past\|>"), 2, 1 << 30)
    marks = F.regexp_extract_all("formatted", F.lit(r"<\|(turn|past)\|>"), F.lit(1))
    fresh = F.filter(F.arrays_zip(marks.alias("mark"), pieces.alias("piece")),
                     lambda x: x["mark"] == "turn")

    def turn(x):
        cut = F.locate("\n", x["piece"])
        return F.concat(
            _role_in(F.substring(x["piece"], F.lit(1), cut - 1)), F.lit("\n"),
            unescape(F.substring(x["piece"], cut + 1, F.char_length(x["piece"]) - cut - len(END))),
            F.lit("\n"))

    read = formatted.select(
        "conv_id", "window", F.char_length("formatted").alias("chars"), F.size(fresh).alias("n"),
        F.array_join(F.transform(fresh, turn), "").alias("turns"),
        F.array_join(F.transform("loss", lambda x: unescape(F.substring(
            F.col("formatted"), x["begin"] + 1, x["length"]))), "").alias("loss"))
    joined = read.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"),
        F.sort_array(F.collect_list(F.struct("window", "turns", "loss"))).alias("w"))
    return joined.select(
        "conv_id", "n_turns", F.array_join(F.transform("w", lambda x: x["turns"]), "").alias(
            "turns"), F.array_join(F.transform("w", lambda x: x["loss"]), "").alias("loss"),
        "formatted_chars")


def digests(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    return read_back(formatted).select(
        "conv_id", "n_turns", F.sha2("turns", 256).alias("turns_sha256"),
        F.char_length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("bigint").alias("formatted_chars"))

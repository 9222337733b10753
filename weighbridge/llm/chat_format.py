r"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Each assistant turn becomes one example: all turns before it as context, and its own text as
the only trainable part. A conversation whose last turn is not an assistant's gets one more
example without a trainable part, so that every turn can be read back from the output.

Template of a turn: ``### role: text</turn>`` and a line feed. Inside roles and texts the
control strings are escaped: backslash as ``\b``, ``###`` as ``\h``, ``</turn>`` as ``\t``, and in
roles ``:`` as ``\c``. An escaped string holds no control string, and each escape starts with a
backslash, so ``unescaped`` gives back the text exactly.

Rows: a null text or role counts as empty. Turns are ordered by (turn, role, text), null first;
repeated rows are repeated turns. Rows without conv_id form one conversation with a null id.
Other columns are ignored. A conversation is put together in one row, which is the unit of the
output; its examples hold their context again, as the method says.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = "</turn>\n"
_TEXT = (("\\", "\\b"), ("###", "\\h"), ("</turn>", "\\t"))


def escaped(c: Column, role: bool = False) -> Column:
    for plain, code in _TEXT + (((":", "\\c"),) if role else ()):
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def unescaped(c: Column, role: bool = False) -> Column:
    for plain, code in reversed(_TEXT + (((":", "\\c"),) if role else ())):
        c = F.replace(c, F.lit(code), F.lit(plain))
    return c


def _head(role: Column) -> Column:
    return F.concat(F.lit("### "), escaped(role, role=True), F.lit(": "))


def examples(turns: DataFrame) -> DataFrame:
    """One row per example of ``turns(conv_id, turn, role, text)``.

    conv_id, example (from 1), is_last (of its conversation), formatted, mask_start and
    mask_chars: the span of ``formatted``, in code points from 0, that is trained on.
    """
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    talks = turns.select("conv_id", row.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    talks = talks.withColumn("lines", F.transform("ts", lambda t: F.concat(_head(t.role), escaped(t.text), F.lit(END))))
    last = F.size("ts")
    targets = F.filter(F.sequence(F.lit(1), last), lambda i: (F.element_at("ts", i).role == "assistant") | (i == last))
    rows = talks.select("conv_id", "ts", "lines", F.posexplode(targets).alias("k", "i"))
    turn = F.element_at("ts", F.col("i"))
    trained = turn.role == "assistant"
    context = F.array_join(F.slice("lines", 1, F.col("i") - 1), "")
    return rows.select(
        "conv_id", (F.col("k") + 1).alias("example"), (F.col("i") == last).alias("is_last"),
        F.concat(context, F.element_at("lines", F.col("i"))).alias("formatted"),
        F.when(trained, F.length(context) + F.length(_head(turn.role))).alias("mask_start"),
        F.when(trained, F.length(escaped(turn.text))).otherwise(0).alias("mask_chars"),
    )


def trained_text(formatted: Column, start: Column, chars: Column) -> Column:
    """The text under the loss mask, without escapes."""
    return F.when(chars > 0, unescaped(F.substring(formatted, start + 1, chars))).otherwise("")


def read_turns(formatted: Column) -> Column:
    """Array of (role, text) parsed from a formatted example."""
    lines = F.filter(F.split(formatted, "</turn>\n"), lambda x: x != "")

    def turn(line: Column) -> Column:
        colon = F.locate(": ", line)
        return F.struct(
            unescaped(line.substr(F.lit(5), colon - 5), role=True).alias("role"),
            unescaped(line.substr(colon + 2, F.length(line))).alias("text"),
        )

    return F.transform(lines, turn)


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, read back from the examples: turn and loss digests and lengths."""
    turns = F.when(F.col("is_last"), read_turns(F.col("formatted")))
    lines = F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n")))
    read = formatted.select(
        "conv_id", "example", F.length("formatted").cast("long").alias("chars"),
        trained_text(F.col("formatted"), F.col("mask_start"), F.col("mask_chars")).alias("loss"), turns.alias("turns"),
    ).withColumns({"n_turns": F.size("turns"), "said": F.sha2(F.array_join(lines, ""), 256)}).drop("turns")
    whole = read.groupBy("conv_id").agg(
        F.max(F.when(F.col("said").isNotNull(), F.col("n_turns"))).cast("long").alias("n_turns"),
        F.max("said").alias("turns_sha256"),
        F.sort_array(F.collect_list(F.struct("example", "loss"))).alias("parts"),
        F.sum("chars").alias("formatted_chars"),
    )
    loss = F.array_join(F.col("parts.loss"), "")
    return whole.select(
        "conv_id", "n_turns", "turns_sha256", F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars",
    )

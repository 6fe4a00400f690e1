"""Chat formatting with prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes one training example: all turns before it as
context, and its own text as the only trainable span. Turns after the last
assistant turn (or a conversation without one) give one more example without a
trainable span, so the output always holds every turn.

A turn is ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside roles and texts a
backslash is doubled and ``<|`` becomes ``<\\|``, so no text can hold a marker;
removing one backslash before any character brings the original back.

Cases: a null role or text counts as empty. Turns are ordered by turn number
(null first), then role, then text, so ties and repeated rows have a fixed order
and all stay. Rows with a null conversation id form one conversation. An empty
table gives no examples. Only the four named columns are read.

An example is one string, so one conversation's text must fit into a row; the
expansion streams example by example and never holds all of them at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import narrow, or_empty

START, END = "<|im_start|>", "<|im_end|>\n"
TRAINED_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\\n"))


def unescape(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("\\")), F.regexp_replace(text, r"(?s)\\(.)", "$1")).otherwise(text)


def expand(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per example: ``conv_id, example, n_turns, text, loss_start, loss_end``.

    ``example`` counts from 1; ``text[loss_start:loss_end]`` (code points) is the
    trainable span, empty for the example that only closes a conversation.
    ``n_turns`` is the number of turns in the example.
    """
    rows = narrow(conversations, conv_id=conv, turn=turn, role=role, text=text)
    said = rows.select("conv_id", F.struct("turn", or_empty(F.col("role")).alias("role"), or_empty(F.col("text")).alias("text")).alias("t"))
    whole = said.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    last = F.size("turns")
    replies = F.filter(F.sequence(F.lit(1), last), lambda k: F.element_at("turns", k)["role"] == TRAINED_ROLE)
    closing = F.when(F.element_at("turns", -1)["role"] == TRAINED_ROLE, F.array().cast("array<int>")).otherwise(F.array(last))
    pieces = F.transform("turns", lambda t: F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n"), escape(t["text"]), F.lit(END)))
    spans = F.transform("turns", lambda t: F.when(t["role"] == TRAINED_ROLE, F.length(escape(t["text"]))).otherwise(0))
    ends = whole.select("conv_id", pieces.alias("pieces"), spans.alias("spans"), F.concat(replies, closing).alias("upto"))
    each = ends.select("conv_id", "pieces", "spans", F.posexplode("upto").alias("at", "k"))
    formatted = each.select(
        "conv_id",
        (F.col("at") + 1).alias("example"),
        F.col("k").alias("n_turns"),
        F.array_join(F.slice("pieces", F.lit(1), F.col("k")), "").alias("text"),
        F.element_at("spans", F.col("k")).alias("span"),
    )
    loss_end = F.length("text") - len(END)
    return formatted.select("conv_id", "example", "n_turns", "text", (loss_end - F.col("span")).alias("loss_start"), loss_end.alias("loss_end"))


def read_turns(text: Column) -> Column:
    """The turns of a formatted text, as an array of (role, text)."""
    parts = F.split(text, r"<\|im_end\|>\n")
    bodies = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p: F.substring(p, len(START) + 1, 2147483647))

    def turn(body: Column) -> Column:
        head = F.regexp_extract(body, r"(?s)^((?:[^\\\n]++|\\.)*+)\n", 1)
        return F.struct(unescape(head).alias("role"), unescape(F.substring(body, F.length(head) + 2, F.lit(2147483647))).alias("text"))

    return F.transform(bodies, turn)


def read_loss(text: Column, start: Column, end: Column) -> Column:
    """The trainable text of an example, as it was before escaping."""
    return unescape(F.substring(text, start + 1, end - start))


def digests(examples: DataFrame) -> DataFrame:
    """Per conversation, what its examples say when they are read back."""
    turns = F.transform(read_turns(F.col("text")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    read = examples.select(
        "conv_id", "example", "n_turns",
        F.length("text").cast("long").alias("chars"),
        read_loss(F.col("text"), F.col("loss_start"), F.col("loss_end")).alias("loss"),
        "text",
    )
    whole = read.groupBy("conv_id").agg(
        F.max_by("text", "example").alias("text"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example", "loss"))), lambda e: e["loss"]), "").alias("loss"),
        F.sum("chars").alias("formatted_chars"),
    )
    return whole.select(
        "conv_id",
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(F.array_join(turns, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )

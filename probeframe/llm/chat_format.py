r"""Chat formatting with typed content parts (operator 12); DataFrame functions only.

A turn is a role and an array of parts (:data:`PART`).  A visitor flattens them:
texts are escaped, images, audio and documents leave an ordered placeholder, an
attachment reference and the number of tokens that the placeholder expands to.
Turns are marked as ``<|im_start|>role\ntext<|im_end|>\n``.  In texts and roles
``<``, any backslashes and ``|`` get one backslash more, so ``<|`` occurs in the
output only where the template put it, and the escape can be undone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probeframe.llm._shared import materialize

PART = "struct<kind: string, text: string, ref: string, width: long, height: long, seconds: double, pages: long>"
OPEN, CLOSE, NEWLINE = "<|im_start|>", "<|im_end|>\n", "<|n|>"
#: Kinds of part that leave a placeholder ``<|kind|>``; any other kind is a ``file``.
KINDS = ("image", "audio", "document", "file")
#: Roles whose texts are under the loss mask.
LOSS_ROLES = ("assistant",)


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


class Flatten:
    """The visitor of parts: for each kind what it shows in the text, and the tokens that it expands to, at least one for an attachment.

    ``patch`` is the edge in pixels of an image's token, ``rate`` the tokens of
    a second of audio, ``page`` those of a document's page; null sizes are 0.
    """

    def __init__(self, patch: int = 28, rate: float = 25.0, page: int = 256) -> None:
        self.patch, self.rate, self.page = patch, rate, page

    def text(self, part: Column) -> tuple[Column, Column]:
        return escape(F.coalesce(part["text"], F.lit(""))), F.lit(0).cast("long")

    def image(self, part: Column) -> tuple[Column, Column]:
        return F.lit("<|image|>"), F.ceil(part["width"] / self.patch) * F.ceil(part["height"] / self.patch)

    def audio(self, part: Column) -> tuple[Column, Column]:
        return F.lit("<|audio|>"), F.ceil(part["seconds"] * self.rate)

    def document(self, part: Column) -> tuple[Column, Column]:
        return F.lit("<|document|>"), part["pages"] * self.page

    def file(self, part: Column) -> tuple[Column, Column]:
        return F.lit("<|file|>"), F.lit(1).cast("long")

    def visit(self, part: Column) -> Column:
        """``shown, kind, ref, tokens`` of a part; a null kind is text, a null part an empty text."""
        kind = F.coalesce(part["kind"], F.lit("text"))
        shown, tokens = self.file(part)
        for name in ("text", *KINDS[:-1]):
            mine, cost = getattr(self, name)(part)
            shown = F.when(kind == name, mine).otherwise(shown)
            tokens = F.when(kind == name, cost if name == "text" else F.greatest(F.lit(1).cast("long"), F.coalesce(cost.cast("long"), F.lit(1).cast("long")))).otherwise(tokens)
        known = F.when(kind.isin("text", *KINDS), kind).otherwise(F.lit("file"))
        return F.struct(shown.alias("shown"), known.alias("kind"), part["ref"].alias("ref"), tokens.alias("tokens"))


def text_parts(text: Column) -> Column:
    """The parts of a turn that is one text; a null text is empty."""
    absent = {"ref": "string", "width": "long", "height": "long", "seconds": "double", "pages": "long"}
    return F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"), *[F.lit(None).cast(t).alias(c) for c, t in absent.items()]))


def format_chats(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts", loss_roles: tuple[str, ...] = LOSS_ROLES, visitor: Flatten | None = None) -> DataFrame:
    """A row for each conversation: ``conv_id, formatted, n_turns, loss, attachments, expanded_tokens``.

    ``loss`` lists the spans under the mask, ``start`` to ``stop`` in code points
    and ``start_byte`` to ``stop_byte`` in UTF-8; ``attachments`` has for every
    turn ``kind, ref, tokens`` of its placeholders, in their order;
    ``expanded_tokens`` sums them.  Turns are in the order of ``turn``, null
    first, then of role and text, so that ties and repeats have one result.  A
    null id is a conversation of its own, a null role is empty, a turn of null
    parts is empty; an empty table gives no rows; other columns aren't read.

    Offsets are running sums over a conversation's turns, before one grouping on
    the same key: the texts are shuffled once.  A conversation is one training
    sample and so one row: it must fit a task.
    """
    visited = F.transform(F.coalesce(F.col(parts), F.array().cast(f"array<{PART}>")), (visitor or Flatten()).visit)
    rows = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), visited.alias("visited"))
    head = F.concat(F.lit(OPEN), F.replace(escape(F.col("role")), F.lit("\n"), F.lit(NEWLINE)), F.lit("\n"))
    kept = F.filter("visited", lambda v: v["kind"] != "text")
    rows = rows.select(
        "conv_id", "turn", "role", head.alias("head"), F.array_join(F.transform("visited", lambda v: v["shown"]), "").alias("content"),
        F.transform(kept, lambda v: F.struct(v["kind"].alias("kind"), v["ref"].alias("ref"), v["tokens"].alias("tokens"))).alias("attached"),
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "content")
    before = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = lambda f, *of: sum((f(F.col(c)) for c in of), F.lit(len(CLOSE)).cast("long"))
    rows = rows.withColumn("nth", F.row_number().over(order))
    for unit, f in (("", F.char_length), ("_byte", F.octet_length)):
        rows = rows.withColumn(f"after{unit}", F.sum(size(f, "head", "content")).over(before))
        rows = rows.withColumn(f"stop{unit}", F.col(f"after{unit}") - len(CLOSE)).withColumn(f"start{unit}", F.col(f"stop{unit}") - f(F.col("content")))
    span = F.struct(*[F.col(c).cast("long").alias(c) for c in ("start", "stop", "start_byte", "stop_byte")])
    made = F.struct("nth", F.concat("head", "content", F.lit(CLOSE)).alias("piece"), F.col("role").isin(*loss_roles).alias("masked"), span.alias("span"), "attached")
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(made)).alias("turns"))
    tokens = F.aggregate("attachments", F.lit(0).cast("long"), lambda n, turn: n + F.aggregate(turn, F.lit(0).cast("long"), lambda m, a: m + a["tokens"]))
    return chats.select(
        "conv_id", F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"), F.size("turns").cast("long").alias("n_turns"),
        F.transform(F.filter("turns", lambda t: t["masked"]), lambda t: t["span"]).alias("loss"), F.transform("turns", lambda t: t["attached"]).alias("attachments"),
    ).withColumn("expanded_tokens", tokens)


def write_chats(chats: DataFrame) -> DataFrame:
    """The formatted conversations, written to the shared folder and scanned."""
    return materialize(chats, "chats")


def turns_of(formatted: Column) -> Column:
    """``role, content`` of every turn of a formatted conversation; ``content`` is still escaped."""
    chunks = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda c: c != "")

    def turn(chunk: Column) -> Column:
        role = F.substring_index(chunk, "\n", 1)
        start = F.char_length(role) + 2
        content = F.substring(chunk, start, F.char_length(chunk) - len(CLOSE) - start + 1)
        return F.struct(unescape(F.replace(role, F.lit(NEWLINE), F.lit("\n"))).alias("role"), content.alias("content"))

    return F.transform(chunks, turn)


def texts_of(content: Column) -> Column:
    """The texts between a content's placeholders, unescaped: one more than placeholders."""
    return F.transform(F.split(content, rf"<\|(?:{'|'.join(KINDS)})\|>"), unescape)


def parts_of(content: Column, attached: Column) -> Column:
    """The parts of a turn read back: ``kind, text, ref, tokens``; adjacent texts are one, empty texts are none."""
    text = lambda t: F.struct(F.lit("text").alias("kind"), t.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(0).cast("long").alias("tokens"))
    file = lambda a: F.struct(a["kind"].alias("kind"), F.lit(None).cast("string").alias("text"), a["ref"].alias("ref"), a["tokens"].alias("tokens"))
    pairs = F.transform(texts_of(content), lambda t, i: F.array(text(t), file(F.get(attached, i))))
    return F.filter(F.flatten(pairs), lambda p: p["kind"].isNotNull() & ~p["text"].eqNullSafe(F.lit("")))


def loss_text(formatted: Column, loss: Column) -> Column:
    """All text under the mask, unescaped, in order; read by byte offsets, so the cost is linear in the conversation."""
    raw = formatted.cast("binary")
    cut = lambda s: F.substring(raw, (s["start_byte"] + 1).cast("int"), (s["stop_byte"] - s["start_byte"]).cast("int")).cast("string")
    return F.array_join(F.transform(loss, lambda s: unescape(cut(s))), "")

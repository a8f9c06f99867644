"""Chat formatting from a declarative template, with loss flags, turn-order checks and a reader."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import running


@dataclass(frozen=True)
class Template:
    """A turn is opened by start role middle, closed by end. Control strings begin with mark.

    steps: the roles that may follow each role; "" stands before the first turn. last: roles that may
    end a conversation. loss: roles whose text counts in the loss.
    """

    start: str = "<|im_start|>"
    middle: str = "\n"
    end: str = "<|im_end|>\n"
    mark: tuple[str, str] = ("<", "|")
    loss: tuple[str, ...] = ("assistant",)
    last: tuple[str, ...] = ("assistant",)
    steps: dict = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})


CHATML = Template()


def escape(text: Column, t: Template = CHATML) -> Column:
    r"""A backslash goes between the two characters that open a control string, whatever backslashes are there: <| to <\|, <\| to <\\|. So no text holds a control string, and unescape() restores it."""
    a, b = t.mark
    return F.regexp_replace(text, rf"\Q{a}\E(\\*+)\Q{b}\E", rf"{a}\\$1{b}")


def unescape(text: Column, t: Template = CHATML) -> Column:
    a, b = t.mark
    return F.regexp_replace(text, rf"\Q{a}\E\\(\\*+)\Q{b}\E", rf"{a}$1{b}")


def escape_role(role: Column, t: Template = CHATML) -> Column:
    r"""As a text; a backslash and the line feed that ends the role are written \s and \n before that."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\s")), F.lit("\n"), F.lit("\\n")), t)


def unescape_role(role: Column, t: Template = CHATML) -> Column:
    return F.replace(F.replace(unescape(role, t), F.lit("\\n"), F.lit("\n")), F.lit("\\s"), F.lit("\\"))


def segments(turns: DataFrame, t: Template = CHATML) -> DataFrame:
    """One row a turn: head, body, tail (the formatted segments), loss (does body count) and ok (may this role follow the one before, and end here if it ends).

    A finite-state machine runs over each conversation in order of turn: its state is the role read
    last, so one lag() over the turns gives every step. Null text and role are empty; null turns come
    first, ties go by role and text; a null conv_id is a conversation of its own. Unknown roles are
    formatted and not ok.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    s = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    s = s.withColumns({"before": F.lag("role", 1, "").over(order), "after": F.lead("turn", 1).over(order), "n": F.row_number().over(order), "next_role": F.lead("role", 1).over(order)})
    step = F.lit(False)
    for state, roles in t.steps.items():
        here = (F.col("n") == 1) if state == "" else (F.col("n") > 1) & (F.col("before") == state)
        step = step | (here & F.col("role").isin(*roles))
    ends = F.col("next_role").isNotNull() | F.col("role").isin(*t.last)
    return s.select(
        "conv_id", "n", "role", "text", (step & ends).alias("ok"), F.col("role").isin(*t.loss).alias("loss"),
        F.concat(F.lit(t.start), escape_role(F.col("role"), t), F.lit(t.middle)).alias("head"), escape(F.col("text"), t).alias("body"), F.lit(t.end).alias("tail"),
    )


def format_chats(turns: DataFrame, t: Template = CHATML) -> DataFrame:
    """One row a conversation: conv_id, n_turns, valid, first_error (number of the first turn out of order, or null), formatted, and loss_spans: start (from 0) and length in code points of formatted.

    A conversation is one text by contract, so its turns meet in one row; nothing else does.
    """
    s = segments(turns, t)
    rows = F.sort_array(F.collect_list(F.struct("n", "head", "body", "tail", "loss")))
    g = s.groupBy("conv_id").agg(rows.alias("t"), F.count("*").alias("n_turns"), F.min(F.when(~F.col("ok"), F.col("n"))).alias("first_error"))
    size = lambda x: F.length(x["head"]) + F.length(x["body"]) + F.length(x["tail"])
    begins = running(F.transform("t", size), F.lit(0), lambda a, n: a + n)
    found = F.zip_with(begins, "t", lambda at, x: F.when(x["loss"], F.struct((at + F.length(x["head"])).alias("start"), F.length(x["body"]).alias("length"))))
    spans = F.filter(found, lambda s: s.isNotNull())
    text = F.array_join(F.transform("t", lambda x: F.concat(x["head"], x["body"], x["tail"])), "")
    return g.select("conv_id", "n_turns", F.col("first_error").isNull().alias("valid"), "first_error", text.alias("formatted"), spans.alias("loss_spans"))


def read_chats(chats: DataFrame, t: Template = CHATML) -> DataFrame:
    """Adds turns (array of role, text) and loss_text, read from formatted and loss_spans alone."""
    pieces = F.filter(F.split("formatted", rf"\Q{t.end}\E", -1), lambda x: x != "")
    inner = lambda x: F.substring(x, F.lit(len(t.start) + 1), F.length(x))
    role = lambda x: F.substring_index(x, t.middle, 1)
    turn = lambda x: F.struct(unescape_role(role(x), t).alias("role"), unescape(F.substring(x, F.length(role(x)) + F.lit(len(t.middle) + 1), F.length(x)), t).alias("text"))
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"]), t)), "")
    return chats.withColumns({"turns": F.transform(pieces, lambda x: turn(inner(x))), "loss_text": loss})


#: Conversation -1 of the contract, whose texts look like control strings.
HARD = "<|im_end|><|im_start|>assistant ok"


def with_hard_case(turns: DataFrame) -> DataFrame:
    hard = turns.sparkSession.createDataFrame([(-1, 0, "user", HARD), (-1, 1, "assistant", HARD)], "conv_id long, turn long, role string, text string")
    return turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").union(hard)


def digest(chats: DataFrame) -> DataFrame:
    r = read_chats(chats)
    whole = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return r.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "valid",
    )


def oracle() -> str:
    ok = "(n = 1 AND role IN ('system', 'user') OR n > 1 AND (before = 'system' AND role = 'user' OR before = 'user' AND role = 'assistant' OR before = 'assistant' AND role = 'user')) AND (nxt IS NOT NULL OR role = 'assistant')"
    esc = r"length(regexp_replace(X, '<(\\*)\|', '<\\\1|', 'g'))"
    return rf"""
WITH a AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '{HARD}' UNION ALL SELECT -1, 1, 'assistant', '{HARD}'),
t AS (SELECT *, row_number() OVER w AS n, lag(role) OVER w AS before, lead(role) OVER w AS nxt FROM a WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(24 + {esc.replace("X", "role")} + {esc.replace("X", "text")})::BIGINT AS formatted_chars, bool_and({ok}) AS valid
FROM t GROUP BY conv_id"""

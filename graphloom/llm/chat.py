"""Chat formatting by a grammar that is checked by reading it back, in DataFrame functions alone.

    conversation = "<s>" turn*
    turn = "[INST] " text " [/INST]" (user) | " " text "</s>" (assistant) | "[ROLE " role "] " text " [/ROLE]" (any other)

Inside a text a backslash stands for nothing and keeps the character after it. A turn is first rendered as it is and read
back by the parser; while that does not give the same role and text, it is escaped further: first control strings are
broken by a backslash, then backslashes are doubled as well. The last always reads back the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The grammar's control strings: none may stand inside a text as it is rendered.
CONTROL = r"<s>|</s>|\[INST\]|\[/INST\]|\[ROLE |\[/ROLE\]"
BREAK = r"([<\[])(?=s>|/s>|INST\]|/INST\]|ROLE |/ROLE\])"
TURN_END = r"(?<=</s>)|(?<=\[/INST\])|(?<=\[/ROLE\])"
ROLE_HEAD = r"^\[ROLE ((?s:[^\]\\]|\\.)*+)\] "
LEVELS = 3


def escape(text: Column, level: int) -> Column:
    if level == 2:
        text = F.regexp_replace(text, r"\\", r"\\\\")
    return F.regexp_replace(text, BREAK, r"$1\\") if level else text


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def render(role: Column, body: Column) -> Column:
    """One turn, its body escaped already."""
    named = F.regexp_replace(role, r"([\\\[\]<>])", r"\\$1")
    return (
        F.when(role == "user", F.concat(F.lit("[INST] "), body, F.lit(" [/INST]")))
        .when(role == "assistant", F.concat(F.lit(" "), body, F.lit("</s>")))
        .otherwise(F.concat(F.lit("[ROLE "), named, F.lit("] "), body, F.lit(" [/ROLE]")))
    )


def read_turn(turn: Column) -> Column:
    """struct(role, text) of one rendered turn; null if it is not a turn of the grammar."""
    n, head = F.length(turn), F.regexp_extract(turn, ROLE_HEAD, 0)
    role = F.when(turn.startswith("[INST] ") & turn.endswith(" [/INST]") & (n >= 15), F.lit("user")).when(turn.startswith(" ") & turn.endswith("</s>"), F.lit("assistant")).when((head != "") & turn.endswith(" [/ROLE]"), unescape(F.regexp_extract(turn, ROLE_HEAD, 1)))
    first = F.when(turn.startswith("[INST] "), F.lit(8)).when(turn.startswith(" "), F.lit(2)).otherwise(F.length(head) + 1)
    tail = F.when(turn.startswith(" "), F.lit(4)).otherwise(F.lit(8))
    body = turn.substr(first, F.greatest(n - first - tail + 1, F.lit(0)))
    return F.when(role.isNotNull() & ~body.rlike(CONTROL), F.struct(role.alias("role"), unescape(body).alias("text")))


def parse(formatted: Column) -> Column:
    """array of struct(role, text) of a rendered conversation; a part that is no turn gives a null."""
    parts = F.filter(F.split(F.substring(formatted, 4, 2**31 - 1), TURN_END, -1), lambda x: x != "")
    return F.when(formatted.startswith("<s>"), F.transform(parts, read_turn))


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, formatted, turns (read back), identical, max_level.

    Turns are ordered by turn, then role and text (so ties and repeated rows have a fixed order). Null text or role: empty.
    Null turn: first. Null conv_id: a conversation of its own. An empty table gives no rows.
    A conversation is one row of the result; only its own turns meet in a task. Texts of any length are whole. Only the four
    named columns are read, so others may have any name.
    """
    rows = turns.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )

    def reads_back(level: int) -> Column:
        read = parse(F.concat(F.lit("<s>"), render(F.col("role"), escape(F.col("text"), level))))
        return (F.size(read) == 1) & (read[0]["role"] == F.col("role")) & (read[0]["text"] == F.col("text"))

    level = F.lit(LEVELS - 1)
    for at in reversed(range(LEVELS - 1)):
        level = F.when(F.coalesce(reads_back(at), F.lit(False)), F.lit(at)).otherwise(level)
    rows = rows.withColumn("level", level)
    got = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "level"))).alias("source"))

    def rendered(t: Column) -> Column:
        body = F.when(t["level"] == 0, t["text"]).when(t["level"] == 1, escape(t["text"], 1)).otherwise(escape(t["text"], 2))
        return render(t["role"], body)

    got = got.select("conv_id", "source", F.concat(F.lit("<s>"), F.array_join(F.transform("source", rendered), "")).alias("formatted"))
    got = got.select("conv_id", "source", "formatted", parse(F.col("formatted")).alias("turns"))
    same = F.col("turns") == F.transform("source", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return got.select("conv_id", "formatted", "turns", F.coalesce(same, F.lit(False)).alias("identical"), F.array_max(F.transform("source", lambda t: t["level"])).alias("max_level"))


def loss_texts(turns: Column) -> Column:
    """The texts under the loss mask: the assistant's, in order."""
    return F.transform(F.filter(turns, lambda t: t["role"] == "assistant"), lambda t: t["text"])

"""Chat text from conversations: a role automaton, a declarative template, and segments with loss flags. No Python rows."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Letters written behind `\\` for the usual first characters of control strings; other ones get the next free letter.
_LETTERS = {"<": "l", "[": "b"}


@dataclass(frozen=True)
class Template:
    """What stands before and after a turn's text, by role; roles not listed are written out between `other` marks.

    `moves` lists the roles that may follow each state; a state is the last role, or `start`. Texts of `loss_roles` are
    trained on. Every mark, without white space at its ends, is a control string: inside texts its first character is
    escaped, so none occurs there. Templates are refused whose marks could arise where a text meets a mark, or could not
    be told apart: a mark may not be blank, hold `\\`, begin with a letter or digit, stand inside another one, or end as
    another one begins.
    """

    turns: Mapping[str, tuple[str, str]] = field(default_factory=lambda: {
        "system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST] ", " [/INST]"), "assistant": ("<s> ", " </s>"),
    })
    other: tuple[str, str, str] = ("<role>", "</role>", "</turn>")
    moves: Mapping[str, tuple[str, ...]] = field(default_factory=lambda: {
        "start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",),
    })
    loss_roles: tuple[str, ...] = ("assistant",)

    def __post_init__(self) -> None:
        opening, between, closing = self.other
        opens = [marks[0] for marks in self.turns.values()] + [opening, between]
        closes = {marks[1] for marks in self.turns.values()} | {closing}
        if len({m.strip() for m in opens}) < len(opens) or {m.strip() for m in opens} & {m.strip() for m in closes}:
            raise ValueError("marks of different meaning are equal")
        whole, controls = [*opens, *closes], self.controls()
        for mark in controls:
            if not mark or "\\" in mark or mark[0].isalnum():
                raise ValueError(f"{mark!r} can't be a mark")
            if any(mark in other for other in controls if other != mark):
                raise ValueError(f"{mark!r} stands inside another mark")
            for other in whole:
                if any(other.startswith(mark[k:]) or other.endswith(mark[:k]) for k in range(1, len(mark))):
                    raise ValueError(f"{mark!r} and {other!r} begin and end alike")

    def codes(self) -> dict[str, str]:
        """What is written for the first characters of control strings."""
        firsts = sorted({m[0] for m in self.controls()})
        free = iter("acdefghijkmnopqrstuvwxyz")
        return {first: "\\" + (_LETTERS.get(first) or next(free)) for first in firsts}

    def controls(self) -> list[str]:
        """Every control string, longest first."""
        marks = {m.strip() for pair in self.turns.values() for m in pair} | set(self.other)
        return sorted(marks, key=lambda m: (-len(m), m))

    def openings(self) -> dict[str, str]:
        return {role: marks[0] for role, marks in self.turns.items()}


def _quote(text: str) -> str:
    return "".join("\\" + c if c in "\\^$.|?*+()[]{}" else c for c in text)


def escape(text: Column, template: Template) -> Column:
    """The text with `\\` doubled, and `\\` and a letter for the first character of every control string."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for first, code in template.codes().items():
        tails = [_quote(m[1:]) for m in template.controls() if m[0] == first]
        out = F.regexp_replace(out, f"{_quote(first)}(?={'|'.join(tails)})", code.replace("\\", "\\\\"))
    return out


def unescape(text: Column, template: Template | None = None) -> Column:
    """The text that `escape` was given. Pairs of `\\` are cut out first, so a single one starts a code."""
    parts = F.split(text, r"\\\\", -1)
    codes = (template or Template()).codes()

    def single(part: Column) -> Column:
        for first, code in codes.items():
            part = F.replace(part, F.lit(code), F.lit(first))
        return part

    return F.array_join(F.transform(parts, single), "\\")


def _role_case(role: Column, template: Template, listed, other: Column) -> Column:
    out = None
    for name, marks in template.turns.items():
        out = F.when(role == name, listed(marks)) if out is None else out.when(role == name, listed(marks))
    return out.otherwise(other)


def format_chats(
    conversations: DataFrame, template: Template | None = None, id_col: str = "conv_id", turn_col: str = "turn",
    role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """One row per conversation: the id, n_turns, valid, first_fault, segments (text, loss) and formatted.

    Turns go by turn, then role and text; a null turn comes first, a null role or text is empty. `valid` tells whether
    the automaton accepts the order of roles, and `first_fault` is the position of the first turn that it doesn't;
    conversations with faults are formatted all the same. A null id is a conversation of its own. Repeated rows are
    turns like others, other columns are ignored, and no rows give no rows.
    """
    template = template or Template()
    rows = conversations.select(
        F.col(id_col).alias("conv"),
        F.struct(
            F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        ).alias("said"),
    )
    # The digests asked of a conversation are of its whole text, so a conversation is one row in the end.
    grouped = rows.groupBy("conv").agg(F.sort_array(F.collect_list("said")).alias("turns"))

    table = F.create_map(*[
        part for state, roles in template.moves.items() for part in (F.lit(state), F.array(*[F.lit(r) for r in roles]))
    ])
    step = lambda state, said: F.struct(
        said["role"].alias("state"),
        F.when(
            state["fault"].isNull() & ~F.coalesce(F.array_contains(F.element_at(table, state["state"]), said["role"]), F.lit(False)), state["at"]
        ).otherwise(state["fault"]).alias("fault"),
        (state["at"] + 1).alias("at"),
    )
    begin = F.struct(F.lit("start").alias("state"), F.lit(None).cast("int").alias("fault"), F.lit(0).alias("at"))
    fault = F.aggregate("turns", begin, step, lambda state: state["fault"])

    opening, between, closing = template.other
    before = lambda role: _role_case(
        role, template, lambda m: F.lit(m[0]), F.concat(F.lit(opening), escape(role, template), F.lit(between))
    )
    after = lambda role: _role_case(role, template, lambda m: F.lit(m[1]), F.lit(closing))
    segments = F.flatten(F.transform("turns", lambda said: F.array(
        F.struct(before(said["role"]).alias("text"), F.lit(False).alias("loss")),
        F.struct(escape(said["text"], template).alias("text"), said["role"].isin(*template.loss_roles).alias("loss")),
        F.struct(after(said["role"]).alias("text"), F.lit(False).alias("loss")),
    )))
    return grouped.select(
        "conv", F.size("turns").cast("long").alias("n_turns"), fault.isNull().alias("valid"), fault.alias("first_fault"),
        segments.alias("segments"),
    ).withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), "")).withColumnRenamed("conv", id_col)


def parse_turns(formatted: Column, template: Template | None = None) -> Column:
    """(role, text) of every turn, read back from formatted text: no mark occurs inside an escaped text."""
    template = template or Template()
    opening, between, closing = template.other
    closings = [m[1] for m in template.turns.values()] + [closing]
    pieces = F.split(formatted, "|".join(_quote(c) for c in sorted(closings, key=lambda c: -len(c))), -1)
    # Behind the last closing mark there is nothing.
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        role = F.split(F.substring_index(piece, between, 1), _quote(opening), -1)[1]
        rest = F.substr(piece, F.length(F.substring_index(piece, between, 1)) + len(between) + 1)
        out = None
        for name, (mark, _) in template.turns.items():
            body = F.substr(piece, F.lit(len(mark) + 1))
            found = F.struct(F.lit(name).alias("role"), unescape(body, template).alias("text"))
            out = F.when(piece.startswith(mark), found) if out is None else out.when(piece.startswith(mark), found)
        return out.otherwise(F.struct(unescape(role, template).alias("role"), unescape(rest, template).alias("text")))

    return F.transform(pieces, turn)


def chat_digests(chats: DataFrame, template: Template | None = None, id_col: str = "conv_id") -> DataFrame:
    """Digests of each conversation read back from its formatted text and from its segments under the loss flag."""
    turns = F.array_join(F.transform(
        parse_turns(F.col("formatted"), template), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    ), "")
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"], template)), "")
    return chats.select(
        F.col(id_col), F.col("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "valid",
    )

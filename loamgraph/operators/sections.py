"""Markdown texts as tables of sections, and drafts put together from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamgraph.functions import text as T
from loamgraph.operators.evidence import PREAMBLE_HEAD, TRACE_HEAD

#: The sections that a program writes, the one whose prerequisites are taken out, and what its goal is called by.
PREREQUISITES, TRACE = PREAMBLE_HEAD[3:], TRACE_HEAD[3:]
LEARNING, GOAL = "学习目标与先修前置", "学习目标"
GOAL_SIGN, NEED_SIGN, AFTER_SIGN = r"(?:\*\*)?学习目标(?:\*\*)?[：:]", r"(?:\*\*)?先修(?:知识|前置)?(?:\*\*)?[：:]", "学习完成后"
#: Patterns: white space within a line, where a section ends, and what is left of one after its heading. Possessive steps keep them linear in a text.
BLANK = f"[{T.WHITE_SPACE}&&[^\n]]"
END = r"(?=\n##\s|\z)"
REST = f".*?{END}"


def pieces(text: Column) -> Column:
    """A text cut before each line that begins a section (``## ``); the first piece is what comes before them and may be ''."""
    cut = F.split(F.concat(F.lit("\n"), text), r"(?md)(?=^##\s)")
    return F.transform(cut, lambda p, k: F.when(k == 0, F.substring(p, 2, 2**31 - 1)).otherwise(p))


def sections(texts: DataFrame, *, key: str = "doc") -> DataFrame:
    """``(key, text)`` -> ``(key, ord, heading, body)``: section 0 is what comes before the first heading, with heading ''. A null text gives no rows.

    The pieces of a text are cut in its row, so nothing is shuffled.
    """
    rows = texts.where("text is not null").select(key, F.posexplode(pieces(F.col("text"))).alias("ord", "piece"))
    first = F.col("ord") == 0
    name = F.when(first, "").otherwise(T.strip(F.regexp_extract("piece", r"(?s)\A##\s+([^\n]*)", 1)))
    body = F.when(first, F.col("piece")).otherwise(F.regexp_replace("piece", r"(?s)\A##[^\n]*\n?", ""))
    return rows.select(key, "ord", name.alias("heading"), T.strip(body).alias("body"))


def _head(title: str) -> str:
    """The line end and the line that begin a section of that title, as a pattern. The heading needs a line of its own that ends."""
    return rf"\n##\s++{BLANK}*+{title}{BLANK}*+(?=\n)"


def _without_trace(own: Column) -> Column:
    """A plain heading where the title is first named is cut off without a pattern over the text."""
    other = T.strip_long(F.regexp_replace(F.concat(F.lit("\n"), own), rf"(?s){_head(TRACE)}.*", ""))
    plain = lambda x: F.endswith(x[0], F.lit("\n## ")) & F.startswith(x[1], F.lit("\n"))
    return T.once(F.split(own, TRACE, 2), lambda x: F.when(F.size(x) < 2, own).when(plain(x), T.strip_long(T.without_end(x[0], 4))).otherwise(other))


def _without_preamble(own: Column) -> Column:
    # not one group for all sections: the possessive one is walked in a loop, however many there are
    gone = rf"(?s)\A.*?{_head(PREREQUISITES)}{REST}(?:\n##\s++{BLANK}*+{PREREQUISITES}(?U:\b)[^\n]*+(?=\n){REST})*+"
    both = own.startswith("#") & ~own.startswith("##") & F.contains(own, F.lit(PREREQUISITES)) & own.rlike(r"\A#\s+\S")
    return F.when(both, T.strip_long(F.regexp_replace(own, gone, ""))).otherwise(own)


def without_preamble(text: Column) -> Column:
    """A text without its title and prerequisites, if it has both: what follows them; '' if nothing does. Of several such sections in a row, all go."""
    return T.once(T.strip_long(text), _without_preamble)


def _without_title(own: Column) -> Column:
    return F.when(own.startswith("#"), T.strip_long(T.strip_first_title(own))).otherwise(own)


def goal_text(body: Column) -> Column:
    """What a section on goals and prerequisites says of goals: from the goal's sign up to that of prerequisites, if that follows."""

    def of(text: Column, goal: Column, need: Column, after: Column) -> Column:
        till = F.when((need > 0) & (goal < need), need - goal).otherwise(F.length(text))
        return T.strip(F.when(goal > 0, F.substring(text, goal, till)).when(after > 0, F.substring(text, after, F.length(text))).otherwise(text))

    signs = lambda t: F.struct(t.alias("t"), F.regexp_instr(t, F.lit(GOAL_SIGN)).alias("g"), F.regexp_instr(t, F.lit(NEED_SIGN)).alias("n"), F.instr(t, AFTER_SIGN).alias("a"))
    return T.once(T.once(body, signs), lambda x: of(x["t"], x["g"], x["n"], x["a"]))


def _normal_learning(own: Column) -> Column:
    first = rf"(?s)\A##[^\n]*(.*?){END}"
    head = T.once(goal_text(T.strip(F.regexp_extract(own, first, 1))), lambda g: F.when(g != "", F.concat(F.lit(f"## {GOAL}\n\n"), g, F.lit("\n\n"))).otherwise(""))
    new = T.strip_long(F.concat(head, F.ltrim(F.regexp_replace(own, first, ""), F.lit(T.WHITE_SPACE))))
    return F.when(own.startswith("##") & own.rlike(rf"\A{_head(LEARNING)[2:]}"), new).otherwise(own)


def normal_learning(text: Column) -> Column:
    """A text that begins with goals and prerequisites keeps its goals only, under their own heading."""
    return T.once(T.strip_long(text), _normal_learning)


def without_trace(text: Column) -> Column:
    """A text up to its trace of sources, which goes to the end."""
    return T.once(T.strip_long(text), _without_trace)


def formatted_draft(preamble: Column, body: Column, trace: Column) -> Column:
    """A draft as it is published: the preamble, the body without what a program had put around it, and the trace of sources.

    Formatting what has been formatted changes nothing. A null body is empty, a null or empty trace is left out, and a null preamble gives null.
    """
    own = F.coalesce(body, F.lit(""))
    for step in (T.strip_front_matter, _without_preamble, _without_title, _normal_learning, _without_trace):  # each takes and gives a stripped text
        own = T.once(own, step)
    return F.concat(preamble, F.lit("\n\n"), own, F.lit("\n"), F.when(F.coalesce(trace, F.lit("")) != "", F.concat(F.lit("\n"), trace, F.lit("\n"))).otherwise(""))


def drafts(preambles: DataFrame, bodies: DataFrame, traces: DataFrame) -> DataFrame:
    """``preambles(node, preamble)``, ``bodies(node, text)``, ``traces(node, trace)`` -> ``(node, text)`` of nodes with a preamble; each table has a node once."""
    rows = preambles.select("node", "preamble").join(bodies.select("node", F.col("text").alias("__body")), "node", "left").join(traces.select("node", "trace"), "node", "left")
    return rows.select("node", formatted_draft(F.col("preamble"), F.col("__body"), F.col("trace")).alias("text"))


def restored(current: Column, revised: Column) -> Column:
    """A revised text with the title, the prerequisites and the trace of sources that the current one has, whatever the revision made of them.

    A null text is empty.
    """
    now, new = T.strip(F.coalesce(current, F.lit(""))), T.strip(F.coalesce(revised, F.lit("")))
    title = T.strip(F.regexp_extract(now, r"\A(#\s+[^\n]+)", 1))
    need = T.strip(F.regexp_extract(F.concat(F.lit("\n"), now), rf"(?s){_head(PREREQUISITES)}{REST}", 0))
    trace = T.strip(F.regexp_extract(F.concat(F.lit("\n"), now), rf"(?s){_head(TRACE)}.*", 0))
    body = F.concat(F.lit("\n"), T.strip(F.regexp_replace(new, r"\A#\s+[^\n]+\n+", "")))
    body = T.strip(F.regexp_replace(F.regexp_replace(body, rf"(?s){_head(TRACE)}.*", "\n"), rf"(?s){_head(PREREQUISITES)}{REST}", ""))
    return F.concat(T.strip(F.array_join(F.filter(F.array(title, need, body, trace), lambda p: p != ""), "\n\n")), F.lit("\n"))

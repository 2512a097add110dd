"""Chat formatting by incremental black-box rendering.

A template is known only through what it renders. Successive prefixes of a conversation's turns are
rendered; where each output begins with the one before, what is new is the span of the turn. A prefix
whose output does not begin with the one before shows a template that rewrites history: such
conversations are reported, with the spans from where outputs part. Inside a turn's span the text is
found by rendering the same prefix with two unlike marks in its place: what both outputs share before
and after is the template's. The loss mask holds the texts of assistant turns, nothing between.

The chatml template escapes control strings inside texts reversibly, so that the output can be read
back turn by turn.

Rendering prefixes of a template that is a black box costs the square of the turns. Conversations of
more than `segment` turns are therefore cut: each segment renders the prefixes that end in it, in a task
of its own, with the turns up to there.

Defined cases: a null text or role is empty; turns are in order of turn (null first), role, text;
repeated rows are turns of their own; a null conv_id is one conversation; very long texts are rendered
whole; a text that a template does not show has no loss span; an empty table gives an empty result;
other columns are ignored. The output of a conversation is one text, which a task holds.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.common import batched, materialise

Turns = list[tuple[str, str]]


@dataclass(frozen=True)
class Template:
    """render gives the text of a whole conversation; unescape undoes what it does to texts and roles."""

    render: Callable[[Turns], str]
    unescape: Callable[[str], str]


def escape(s: str) -> str:
    return s.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(s: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], s, flags=re.S)


def unescape_text(s: str) -> str:
    return re.sub(r"\\(.)", r"\1", s, flags=re.S)


def render_chatml(turns: Turns) -> str:
    return "".join(f"<|im_start|>{escape(role).replace(chr(10), chr(92) + 'n')}\n{escape(text)}<|im_end|>\n" for role, text in turns)


CHATML = Template(render_chatml, unescape_text)


def parse_chatml(out: str) -> Turns:
    """The turns of an output of the chatml template."""
    turns = []
    for block in out.split("<|im_start|>")[1:]:
        role, _, rest = block.partition("\n")
        turns.append((unescape(role), unescape_text(rest[: rest.rindex("<|im_end|>")])))
    return turns


def shared(a: str, b: str) -> int:
    """Length of the common beginning."""
    if b.startswith(a):
        return len(a)
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[:mid] == b[:mid] else (lo, mid - 1)
    return lo


def between_marks(turns: Turns, i: int, template: Template) -> tuple[int, int] | None:
    """How many characters are before and after the text of turn i in the output of turns; None if it isn't shown."""
    x, y = (template.render([*turns[:i], (turns[i][0], mark), *turns[i + 1 :]]) for mark in ("\ue000", "\ue001"))
    head = shared(x, y)
    return None if x == y else (head, len(x) - head - 1)


def span_turns(turns: Turns, lo: int, template: Template, loss_role: str):
    """(output, spans, loss spans, rewritten) of the turns from lo on, each in the output of the turns up to it."""
    prefix, spans, loss, rewritten = template.render(turns[:lo]), [], [], False
    for i in range(lo, len(turns)):
        out = template.render(turns[: i + 1])
        at = shared(prefix, out)
        rewritten |= at < len(prefix)
        spans.append((at, len(out)))
        if turns[i][0] == loss_role and (found := between_marks(turns[: i + 1], i, template)):
            loss.append((found[0], len(out) - found[1]))
        prefix = out
    return prefix, spans, loss, rewritten


def locate(turns: Turns, template: Template = CHATML, loss_role: str = "assistant"):
    """(output, span of each turn, spans of the texts under the loss mask, whether history was rewritten)."""
    out, spans, loss, rewritten = span_turns(turns, 0, template, loss_role)
    if rewritten:  # what was found in prefixes has moved
        found = [between_marks(turns, i, template) for i, (role, _) in enumerate(turns) if role == loss_role]
        loss = [(f[0], len(out) - f[1]) for f in found if f]
    return out, spans, loss, rewritten


SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
OUT = "conv_id long, formatted string, turns array<struct<start:long,end:long>>, loss array<struct<start:long,end:long>>, rewritten boolean"


def _batch(conv, out, spans, loss, rewritten) -> pa.RecordBatch:
    as_list = lambda x: [{"start": s, "end": e} for s, e in x]
    return pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([out], pa.string()), pa.array([as_list(spans)], SPAN), pa.array([as_list(loss)], SPAN), pa.array([rewritten])], ["conv_id", "formatted", "turns", "loss", "rewritten"])


def _grouped(it, keys: list[str]):
    """The turns of each key of a sorted stream."""
    now, turns = None, []
    for b in it:
        cols = [b.column(c).to_pylist() for c in (*keys, "role", "text")]
        for *key, role, text in zip(*cols):
            if turns and key != now:
                yield now, turns
                turns = []
            now = key
            turns.append((role, text))
    if turns:
        yield now, turns


def format_conversations(rows: DataFrame, template: Template = CHATML, loss_role: str = "assistant", segment: int = 512) -> DataFrame:
    """conv_id, formatted, turns, loss (spans of code points), rewritten per conversation of rows (conv_id, turn, role, text)."""

    def whole(it):
        for (conv,), turns in _grouped(it, ["conv_id"]):
            yield _batch(conv, *locate(turns, template, loss_role))

    def part(it):
        for (conv, s, segments), turns in _grouped(it, ["conv_id", "s", "segments"]):
            out, spans, loss, rewritten = span_turns(turns, s * segment, template, loss_role)
            yield _batch(conv, out if s == segments - 1 else None, spans, loss, rewritten).append_column("s", pa.array([s], pa.int64()))

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    base = batched(rows).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    in_one = lambda df: df.repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(whole, OUT)
    long = base.groupBy("conv_id").agg(F.count("*").alias("n")).filter(F.col("n") > segment).select(F.col("conv_id").alias("long_id"), F.ceil(F.col("n") / segment).alias("segments"))
    if not long.limit(1).count():
        return in_one(base)
    same = F.col("conv_id").eqNullSafe(F.col("long_id"))
    place = F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role", "text")) - 1
    cut = base.join(long, same).withColumn("i", place).withColumn("s", F.explode(F.sequence(F.floor(F.col("i") / segment), F.col("segments") - 1)))
    cut = cut.repartition(n, "conv_id", "s").sortWithinPartitions("conv_id", "s", "i").select("conv_id", "s", "segments", "role", "text")
    parts = materialise(cut.mapInArrow(part, OUT + ", s long"), "segments")
    in_order = lambda c: F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("s", c))), lambda x: x[c])).alias(c)
    joined = parts.groupBy("conv_id").agg(F.max("formatted").alias("formatted"), in_order("turns"), in_order("loss"), F.bool_or("rewritten").alias("rewritten"))
    changed = joined.filter("rewritten").select(F.col("conv_id").alias("long_id"))
    short = in_one(base.join(long, same, "left_anti")).unionByName(joined.filter("not rewritten"))
    # spans in the whole output need all turns at once
    return short.unionByName(in_one(base.join(changed, same, "left_semi"))) if changed.limit(1).count() else short

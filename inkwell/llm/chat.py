"""Chat formatting in budgeted windows.

A conversation's turns are laid on a token axis by prefix sums, made in chunks of turns so that one long
conversation is not one task's work. Windows are spans of turns on that axis: a turn belongs to the
span of tokens in which it begins, and a turn of more than half a span stands alone. A turn's tokens are those of
its formatted, escaped text with role and marks, so a window has as many as its turns together. A conversation's
span shrinks to what its system turn leaves: one and a half spans and the system turn fit the budget. A window opens with
the system turn, repeats the last turns of the window before within a history budget and what room is
left, and then has its own turns. Only its own assistant turns are under the loss mask, so every
assistant text is a target once. A window exceeds the budget only if a turn of its own with the system turn
does, and says so.

Turns are written as ``<|im_start|>role\\ntext<|im_end|>\\n``. In texts, control strings get a backslash after
their first character (one more than they have); roles are percent-encoded. Both can be read back.

Defined cases: a null text or role is empty; turns are ordered by number, nulls before all numbers, repeated
numbers by the row's place; a conversation of a system turn alone is one window; a null conversation id is one
conversation; extra columns are left out; an empty table gives no windows.
"""

from __future__ import annotations

import hashlib
import re
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell.llm.common import Scratch, n_partitions, table, text_or_empty
from inkwell.llm.tokens import tokenizer_path, worker_pieces

BUDGET, SPAN, HISTORY = 2048, 1024, 256
#: Turns of a chunk of prefix sums.
CHUNK = 256
OPEN, MID, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"
# Control strings of common templates.
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_TAILS = "|".join(re.escape(c[1:]) for c in CONTROL)
_ESCAPE = re.compile(rf"([<\[])(\\*)(?={_TAILS})")
_UNESCAPE = re.compile(rf"([<\[])\\(\\*)(?={_TAILS})")


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2", text)


def format_turns(turns: list[tuple[str, str, bool]]) -> tuple[str, list[tuple[int, int]]]:
    """(formatted text, loss spans in code points) of (role, text, is a target)."""
    out, spans, at = [], [], 0
    for role, text, target in turns:
        head, body = OPEN + quote(role, safe="") + MID, escape(text)
        if target:
            spans.append((at + len(head), at + len(head) + len(body)))
        out.append(head + body + CLOSE)
        at += len(out[-1])
    return "".join(out), spans


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    out = []
    for part in formatted.split(OPEN)[1:]:
        role, _, body = part.partition(MID)
        out.append((unquote(role), unescape(body[: -len(CLOSE)])))
    return out


def _token_counts(path: str, keep: int):
    def run(batches):
        coder = worker_pieces(path, False)
        for b in batches:
            role, text = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("role", "text"))
            n = [coder.count(format_turns([(r, t, False)])[0]) for r, t in zip(role, text)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n, pa.int64())], names=[*b.schema.names, "tokens"])

    return run


_WINDOW = "conv_id {kind}, window long, formatted string, loss_spans array<struct<start:long,end:long>>, n_context int, n_tokens long, over_budget boolean"


def _formatting(budget: int, history: int, kind: pa.DataType):
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    types = (kind, pa.int64(), pa.string(), spans_type, pa.int32(), pa.int64(), pa.bool_())

    def run(batches):
        for b in batches:
            rows = []
            for r in b.to_pylist():
                turns = sorted(r["turns"], key=lambda t: (t["part"], t["before"], t["rid"]))
                own = [t for t in turns if t["part"] == 2]
                system = [t for t in turns if t["part"] == 0]
                held = sum(t["tokens"] for t in own + system)
                room, past = min(history, budget - held), []
                for t in reversed([t for t in turns if t["part"] == 1]):
                    if t["tokens"] > room:
                        break
                    room -= t["tokens"]
                    past.insert(0, t)
                shown = system + past + own
                text, spans = format_turns([(t["role"], t["text"], t["part"] == 2 and t["role"] == "assistant") for t in shown])
                first = r["window"] == 0
                rows.append((r["conv_id"], r["window"], text, [{"start": a, "end": z} for a, z in spans], len(past) + (0 if first else len(system)), sum(t["tokens"] for t in shown), held > budget))
            cols = list(zip(*rows)) if rows else [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["conv_id", "window", "formatted", "loss_spans", "n_context", "n_tokens", "over_budget"])

    return run


def windows(conversations: DataFrame, scratch: Scratch, path: str, budget: int = BUDGET, span: int = SPAN, history: int = HISTORY) -> DataFrame:
    """One row per window: conv_id, window (its place on the token axis), formatted, loss_spans, n_context
    (leading turns that are repeated), n_tokens, over_budget."""
    rows = conversations.select("conv_id", F.col("turn").isNotNull().alias("numbered"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"), text_or_empty("role").alias("role"), text_or_empty().alias("text")).withColumn("rid", F.monotonically_increasing_id())
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", tokens long"
    turns = scratch.cut(rows.mapInArrow(_token_counts(path, 0), schema), "turns")

    heads = turns.groupBy("conv_id").agg(F.min(F.struct("numbered", "turn", "rid", "role", "tokens")).alias("h"), F.count(F.lit(1)).alias("n"))
    heads = heads.filter((F.col("h.role") == "system") & (F.col("n") > 1)).select(F.col("conv_id").alias("sid"), F.col("h.rid").alias("srid"), F.col("h.tokens").alias("taken"))
    room = F.floor(2 * (budget - F.coalesce("taken", F.lit(0))) / 3)
    marked = turns.join(heads, turns["conv_id"].eqNullSafe(heads["sid"]), "left").withColumns({"is_system": F.coalesce(F.col("rid") == F.col("srid"), F.lit(False)), "span": F.greatest(F.lit(1), F.least(F.lit(span), room))}).drop("sid", "srid", "taken")
    width = F.when(F.col("is_system"), 0).otherwise(F.col("tokens"))
    big = (~F.col("is_system") & (2 * F.col("tokens") > F.col("span"))).cast("long")
    axis = marked.withColumns({"chunk": F.struct("numbered", F.floor(F.col("turn") / CHUNK).alias("k")), "width": width, "big": big})

    # two-level prefix sums: within chunks, and over the chunks of a conversation
    sums = axis.groupBy("conv_id", "chunk").agg(F.sum("width").alias("w"), F.sum("big").alias("b"))
    over = Window.partitionBy("conv_id").orderBy("chunk")
    bases = sums.select(F.col("conv_id").alias("cid"), F.col("chunk").alias("ck"), (F.sum("w").over(over) - F.col("w")).alias("w0"), (F.sum("b").over(over) - F.col("b")).alias("b0"))
    inside = Window.partitionBy("conv_id", "chunk").orderBy("turn", "rid")
    laid = axis.withColumns({"w1": F.sum("width").over(inside) - F.col("width"), "b1": F.sum("big").over(inside) - F.col("big")})
    laid = laid.join(bases, laid["conv_id"].eqNullSafe(bases["cid"]) & (F.col("chunk") == F.col("ck")))
    laid = laid.select("conv_id", "rid", "role", "text", "tokens", "span", "is_system", (F.col("w0") + F.col("w1")).alias("before"), (2 * (F.col("b0") + F.col("b1")) + F.col("big")).alias("group"))
    laid = scratch.cut(laid.withColumn("stretch", F.floor(F.col("before") / F.col("span"))), "laid")

    # a window is bounded by span + half a span, or is one turn
    mine = Window.partitionBy("conv_id", "stretch", "group")
    own = laid.filter(~F.col("is_system")).withColumns({"window": F.min("before").over(mine), "held": F.sum("tokens").over(mine)})
    own = scratch.cut(own.select("conv_id", "window", (F.col("window") + F.col("held")).alias("next"), "rid", "role", "text", "tokens", "before"), "own")
    turn = lambda part: F.struct(F.lit(part).alias("part"), "before", "rid", "role", "text", "tokens").alias("turn")
    target = own.select("conv_id", "window", turn(2))
    past = own.filter(F.col("next") - F.col("before") <= history).select("conv_id", F.col("next").alias("window"), turn(1))
    system = laid.filter("is_system").select(F.col("conv_id").alias("sid"), "before", "rid", "role", "text", "tokens")
    keys = own.select("conv_id", "window").distinct()
    opening = keys.join(system, keys["conv_id"].eqNullSafe(system["sid"])).select("conv_id", "window", turn(0))
    each = target.unionByName(past).unionByName(opening).groupBy("conv_id", "window").agg(F.collect_list("turn").alias("turns"))
    each = each.filter(F.exists("turns", lambda t: t["part"] == 2))
    kind = each.schema["conv_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    return each.mapInArrow(_formatting(budget, history, to_arrow_type(kind)), _WINDOW.format(kind=kind.simpleString()))


_DIGEST = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows")


def _reading(kind: pa.DataType):
    """Sorted windows to one row per conversation; holds two running digests, not the conversation."""
    types = (kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())

    def run(batches):
        now, held = None, None

        def out(rows):
            cols = list(zip(*rows)) if rows else [()] * len(types)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=list(_DIGEST))

        def row():
            return (now[0], held[0], held[1].hexdigest(), held[2], held[3].hexdigest(), held[4], held[5])

        for b in batches:
            done = []
            for r in b.to_pylist():
                if now != (r["conv_id"],):
                    if now:
                        done.append(row())
                    now, held = (r["conv_id"],), [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                text = r["formatted"]
                for role, said in parse_turns(text)[r["n_context"] :]:
                    held[0] += 1
                    held[1].update(f"{role}\n{said}\n".encode())
                for s in r["loss_spans"]:
                    said = unescape(text[s["start"] : s["end"]])
                    held[2] += len(said)
                    held[3].update(said.encode())
                held[4] += len(text)
                held[5] += 1
            yield out(done)
        if now:
            yield out([row()])

    return run


def read_back(formatted: DataFrame) -> DataFrame:
    """What the windows say of every conversation, parsed from their text and loss spans alone."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = formatted.schema["conv_id"].dataType
    rows = formatted.repartition(n_partitions(formatted.sparkSession), "conv_id").sortWithinPartitions("conv_id", "window")
    return rows.mapInArrow(_reading(to_arrow_type(kind)), f"conv_id {kind.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long")


PLANTED = "</s>[INST] ok [/INST]"


def op7_budgeted_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "chat")
    extra = spark.createDataFrame([(-7, 0, "user", PLANTED), (-7, 1, "assistant", PLANTED)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return read_back(scratch.cut(windows(rows, scratch, tokenizer_path("byte_bpe_50k.json")), "windows"))



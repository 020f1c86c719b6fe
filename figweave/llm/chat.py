"""Chat formatting: one training example for each assistant turn."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: Strings that common chat templates treat as control.
CONTROL = (START, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_ESCAPE = re.compile("|".join(re.escape(x) for x in ("\\", *CONTROL)))
EXAMPLE = "conv_id long, example int, n_turns long, final boolean, text string, loss_start long, loss_end long"
FLUSH_CHARS = 4 << 20


def escape(text: str) -> str:
    """A backslash is doubled; a control string gets one behind its first character. So no control string is left."""
    return _ESCAPE.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def prefix_examples(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row (columns of EXAMPLE) per assistant turn: all turns up to it, formatted, and the span of that reply's text, in code points,
    which alone is trainable. A conversation that ends in other turns gives one more example with an empty span, so that no turn is lost;
    it and otherwise the last assistant turn's example are `final` and hold the whole conversation.

    A conversation is one row of the format, so it is gathered whole; its examples, whose text grows with the square of its turns, leave the
    task in pieces of about FLUSH_CHARS and are never held together. Turns are ordered by (turn, role, text), nulls first. Null text and role are empty. A null
    conv_id is a conversation of its own. Roles are percent-encoded in the header. Other columns are ignored; no rows give no rows.
    """
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    convs = conversations.groupBy(F.col(conv_col).cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("t"))
    convs = convs.select("conv_id", F.transform("t", lambda x: x["role"]).alias("roles"), F.transform("t", lambda x: x["text"]).alias("texts"))
    columns = [x.split()[0] for x in EXAMPLE.split(", ")]

    def frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=columns)
        out["conv_id"] = out["conv_id"].astype("Int64")
        return out

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, held = [], 0
        for batch in batches:
            for conv, roles, texts in zip(batch["conv_id"].astype("Int64"), batch["roles"], batch["texts"]):
                context, k, last = "", 0, len(roles) - 1
                targets = [i for i, r in enumerate(roles) if r == "assistant"]
                for i, (role, text) in enumerate(zip(roles, texts)):
                    context += f"{START}{quote(role, safe='')}\n"
                    begin = len(context)
                    context += escape(text)
                    end = len(context)
                    context += END + "\n"
                    if role == "assistant" or i == last:
                        span = (begin, end) if role == "assistant" else (len(context), len(context))
                        out.append((conv, k, i + 1, i == last, context, *span))
                        k, held = k + 1, held + len(context)
                        if held > FLUSH_CHARS:
                            yield frame(out)
                            out, held = [], 0
        if out:
            yield frame(out)

    return convs.mapInPandas(expand, EXAMPLE)


def parse_turns(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted text."""
    turns = []
    for piece in text.split(END + "\n")[:-1]:
        header, _, body = piece.partition("\n")
        turns.append((unquote(header.removeprefix(START)), unescape(body)))
    return turns


def read_back(examples: DataFrame) -> DataFrame:
    """One row per conversation, from the formatted examples alone: `conv_id`, `n_turns`, `turns_sha256`, `loss_chars`, `loss_sha256`, `formatted_chars`, `n_examples`."""
    schema = "conv_id long, example int, n_turns long, turns_sha256 string, loss string, formatted long"

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            turns = [parse_turns(t) if f else None for t, f in zip(b["text"], b["final"])]
            yield pd.DataFrame({
                "conv_id": b["conv_id"].astype("Int64"), "example": b["example"], "n_turns": pd.array([None if t is None else len(t) for t in turns], dtype="Int64"),
                "turns_sha256": [None if t is None else hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in t).encode()).hexdigest() for t in turns],
                "loss": [unescape(t[i:j]) for t, i, j in zip(b["text"], b["loss_start"], b["loss_end"])], "formatted": b["text"].str.len(),
            })

    rows = examples.mapInPandas(parse, schema)
    loss = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "")
    return rows.groupBy("conv_id").agg(
        F.max("n_turns").alias("n_turns"), F.max("turns_sha256").alias("turns_sha256"), loss.alias("loss"), F.sum("formatted").alias("formatted_chars"), F.count("*").alias("n_examples"),
    ).select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars", "n_examples")

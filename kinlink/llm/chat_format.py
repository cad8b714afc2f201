"""Chat formatting with offset-aligned loss masks.

A conversation is rendered as one string in which markers enclose every turn. It is encoded once with offsets,
and the sorted character spans of the turns are intersected with the token spans by binary search, which gives
the mask of the tokens to learn from.

Control strings inside texts are escaped reversibly: after its first character an escape character is put, one
more than there already is, and reading back takes one away.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import byte_characters
from .common import few_rows, small_batches, tokenizer_path

TURN, SAID, END = "<|turn|>", "<|said|>", "<|end|>"
#: Strings that a text must not bring into the rendered conversation.
CONTROL = (TURN, SAID, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
ESCAPE = "\\"
#: Characters of rendered text after which a conversation is encoded in a further block, at a turn's end.
BLOCK_CHARS = 1_000_000

_PLAIN = re.compile("|".join(f"{re.escape(c[0])}{re.escape(ESCAPE)}*{re.escape(c[1:])}" for c in CONTROL))
_ESCAPED = re.compile("|".join(f"{re.escape(c[0])}{re.escape(ESCAPE)}+{re.escape(c[1:])}" for c in CONTROL))
_TURN = re.compile(f"{re.escape(TURN)}(.*?){re.escape(SAID)}(.*?){re.escape(END)}", re.DOTALL)


def escape(text: str) -> str:
    return _PLAIN.sub(lambda m: m[0][0] + ESCAPE + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[0][0] + m[0][2:], text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int, str]]]:
    """The rendered string, and for each turn the span of its text in it and its role."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{SAID}", escape(text)
        at += len(head)
        spans.append((at, at + len(body), role))
        parts += [head, body, END]
        at += len(body) + len(END)
    return "".join(parts), spans


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a rendered string."""
    return [(unescape(role), unescape(text)) for role, text in _TURN.findall(formatted)]


def token_mask(offsets: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which tokens overlap a span. ``offsets`` (n by 2) and ``spans`` are sorted and spans are disjoint."""
    mask = np.zeros(len(offsets), dtype=bool)
    full = [s for s in spans if s[1] > s[0]]
    if not full or not len(offsets):
        return mask
    starts, ends = np.array(full, dtype=np.int64).T
    which = np.searchsorted(ends, offsets[:, 0], side="right")  # the first span that ends after the token's start
    inside = which < len(full)
    mask[inside] = starts[which[inside]] < offsets[inside, 1]
    return mask & (offsets[:, 1] > offsets[:, 0])


class ChatEncoder:
    """Vocabulary with the markers added as tokens of their own."""

    def __init__(self, path: str):
        from tokenizers import AddedToken, Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.add_special_tokens([AddedToken(x, special=True, normalized=False) for x in (TURN, SAID, END)])
        back = {c: b for b, c in enumerate(byte_characters())}
        self.bytes_of = {}
        for piece, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.bytes_of[i] = bytes(back[c] for c in piece) if all(c in back for c in piece) else piece.encode()

    def encode(self, formatted: str) -> tuple[np.ndarray, np.ndarray]:
        found = self.tokenizer.encode(formatted, add_special_tokens=False)
        return np.array(found.ids, dtype=np.int32), np.array(found.offsets, dtype=np.int64).reshape(-1, 2)

    def masked_texts(self, ids: np.ndarray, mask: np.ndarray) -> list[str]:
        """The texts of the runs of masked tokens."""
        edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
        return [b"".join(self.bytes_of[i] for i in ids[a:b].tolist()).decode("utf-8") for a, b in edges.reshape(-1, 2)]


@lru_cache(maxsize=2)
def encoder(name: str = "byte_bpe_50k.json", folder: str | None = None) -> ChatEncoder:
    return ChatEncoder(tokenizer_path(name, folder))


_FORMATTED = "conv_id long, part long, last boolean, formatted string, ids array<int>, mask array<boolean>"


def format_conversations(turns: DataFrame, learn_role: str = "assistant", vocabulary: str = "byte_bpe_50k.json", folder: str | None = None) -> DataFrame:
    """conv_id, part, last, formatted, ids and mask (the tokens to learn from) of every conversation.

    Rows of ``turns`` (conv_id, turn, role, text) are ordered by turn, then role and text, so ties have one
    order; null texts and roles are empty; rows with a null conv_id make one conversation. A conversation is
    one row, but a very long one has a row for each block of turns of about BLOCK_CHARS characters, so that
    memory is bounded by that and the longest turn, also where one conv_id has a large part of all rows. Every character
    is encoded once: markers are tokens of their own, so ids and mask of the parts are those of one encoding of the whole
    (tested). Parts of a conversation are consecutive. One shuffle by conv_id.
    """
    small_batches(turns.sparkSession)
    text = lambda x: F.coalesce(F.col(x).cast("string"), F.lit(""))
    ordered = (
        turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"))
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
    )
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(turns.sparkSession.createDataFrame([], _FORMATTED).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chat = encoder(vocabulary, folder)
        conv, part, held, size, out = None, 0, [], 0, []
        started = False

        def block(last: bool) -> tuple:
            formatted, spans = render(held)
            ids, offsets = chat.encode(formatted)
            return conv, part, last, formatted, ids, token_mask(offsets, [s[:2] for s in spans if s[2] == learn_role])

        def table() -> pa.RecordBatch:
            cols = [pa.array([x[i] for x in out], type=schema.field(i).type) for i in range(4)]
            for i in (4, 5):
                offsets = pa.array(np.cumsum([0, *(len(x[i]) for x in out)], dtype=np.int32))
                cols.append(pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([x[i] for x in out]))))
            return pa.RecordBatch.from_arrays(cols, schema=schema)

        for batch in few_rows(batches):
            for c, role, said in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if started and c != conv:
                    out.append(block(True))
                    held, size, part = [], 0, 0
                elif size >= BLOCK_CHARS:
                    out.append(block(False))
                    held, size, part = [], 0, part + 1
                conv, started = c, True
                held.append((role, said))
                size += len(said) + len(role)
                if sum(len(x[4]) for x in out[-1:]) > 200_000 or len(out) >= 200:
                    yield table()
                    out = []
        if started:
            out.append(block(True))
            yield table()

    return ordered.mapInArrow(run, _FORMATTED)


def digests(formatted: DataFrame, learn_role: str = "assistant", vocabulary: str = "byte_bpe_50k.json", folder: str | None = None) -> DataFrame:
    """Counts and digests of each conversation, read back from its rendered string and masked tokens.

    ``formatted`` is the result of format_conversations; parts are joined as they follow each other.
    """
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, n_loss_tokens long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chat = encoder(vocabulary, folder)
        fresh = lambda: [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
        state = fresh()
        for batch in few_rows(batches):
            out = []
            for row in range(batch.num_rows):
                conv, _, last, text = (batch.column(i)[row].as_py() for i in range(4))
                ids, mask = batch.column(4)[row].values.to_numpy(zero_copy_only=False), batch.column(5)[row].values.to_numpy(zero_copy_only=False)
                for role, said in read_turns(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                for run_text in chat.masked_texts(ids, mask):
                    said = unescape(run_text)
                    state[2] += len(said)
                    state[3].update(said.encode("utf-8", "surrogatepass"))
                state[4] += len(text)
                state[5] += len(ids)
                state[6] += int(mask.sum())
                if last:
                    out.append([conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), *state[4:]])
                    state = fresh()
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(names, x)) for x in out], schema=target)

    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(formatted.sparkSession.createDataFrame([], schema).schema)
    names = target.names
    return formatted.mapInArrow(run, schema)


#: The further conversation of the query: its texts hold control strings.
EXTRA = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all conversations and of conversation -1, read back from their formatted output."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return digests(format_conversations(turns.unionByName(spark.createDataFrame(EXTRA, turns.schema))))

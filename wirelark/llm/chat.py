"""Chat formatting on the level of tokens.

Every text is encoded by itself; the marks of the template are reserved ids above the vocabulary,
spliced between the pieces, so no text can produce one. The mask of the tokens that count for the
loss is a prefix sum over marks of where such a piece begins and ends. Control strings that occur in
a text are escaped as well, so that the formatted text, too, can be read back.

Template: <s> then for each turn [INST]text[/INST] (user), [OUT]text[/OUT] (assistant),
[SYS]text[/SYS] (system) or [ROLE]role[SEP]text[/ROLE] (any other role), then </s>.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "[OUT]", "[/OUT]", "[SYS]", "[/SYS]", "[ROLE]", "[SEP]", "[/ROLE]"]
BEGIN, END = 0, 1
OPEN = {"user": 2, "assistant": 4, "system": 6}
ROLE, SEP, ROLE_END = 8, 9, 10
CHUNK = 65_536                     # tokens of an output row at most, about
_ESCAPED = re.compile(r"\\(\\?)")


def escape(text: str) -> str:
    """Doubles backslashes and puts one after the first character of every control string."""
    text = text.replace("\\", "\\\\")
    for c in CONTROL:
        text = text.replace(c, f"{c[0]}\\{c[1:]}")
    return text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


class Tokenizer:
    """A byte-level vocabulary file of ranks; the control strings get the ids after its last one."""

    def __init__(self, path: str, pattern: str):
        import tiktoken
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("chat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.first = max(ranks.values()) + 1

    def encode(self, text: str) -> list[int]:
        return self.encoding.encode_ordinary(text)

    def decode(self, ids: list[int]) -> str:
        return self.encoding.decode_bytes(ids).decode("utf-8")


_tokenizers: dict[str, Tokenizer] = {}


def tokenizer_of(path: str, pattern: str) -> Tokenizer:
    """One per Python worker and file."""
    if path not in _tokenizers:
        _tokenizers[path] = Tokenizer(path, pattern)
    return _tokenizers[path]


def encode_turn(tokenizer: Tokenizer, role: str, text: str) -> tuple[list[int], int, int]:
    """(ids, begin, end): a turn with its marks, and where the tokens of the text lie in it."""
    mark, first = OPEN.get(role), tokenizer.first
    head = [first + mark] if mark else [first + ROLE, *tokenizer.encode(escape(role)), first + SEP]
    body = tokenizer.encode(escape(text))
    return [*head, *body, first + (mark + 1 if mark else ROLE_END)], len(head), len(head) + len(body)


TURN = "conv_id long, turn long, ids array<int>, loss_from int, loss_to int, tie string"
OUT = "conv_id long, chunk long, at long, ids array<int>, loss array<boolean>"


@dataclass
class Template:
    """Which roles count for the loss, and the tokenizer file (it must exist on every executor)."""
    path: str
    pattern: str
    loss_roles: tuple[str, ...] = ("assistant",)


def encode_turns(conversations: DataFrame, template: Template) -> DataFrame:
    """Each row by itself, wherever it lies: its ids with marks, and the part that counts for the loss."""
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.md5(F.concat_ws("\n", "role", "text")))

    def run(batches):
        tokenizer = tokenizer_of(template.path, template.pattern)
        for batch in batches:
            step = 512
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                found = [(r, *encode_turn(tokenizer, r, t)) for r, t in zip(part.column("role").to_pylist(), part.column("text").to_pylist())]
                yield pa.RecordBatch.from_arrays([
                    part.column("conv_id"), part.column("turn"), pa.array([f[1] for f in found], pa.list_(pa.int32())),
                    pa.array([f[2] for f in found], pa.int32()), pa.array([f[3] if f[0] in template.loss_roles else f[2] for f in found], pa.int32()),
                    part.column("tie")], ["conv_id", "turn", "ids", "loss_from", "loss_to", "tie"])
    return rows.mapInArrow(run, TURN)


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        ids = batch.column("ids")
        for i, row in enumerate(zip(*[batch.column(c).to_pylist() for c in ("conv_id", "loss_from", "loss_to")])):
            yield row[0], ids[i].values.to_numpy(zero_copy_only=False), row[1], row[2]


def assemble(turns: DataFrame, template: Template) -> DataFrame:
    """(conv_id, chunk, at, ids, loss): the conversations' tokens in order, in chunks of whole turns.

    Conversations are dealt out by id and stream through their task sorted by turn (null first, ties
    by content), so a conversation of any length takes the memory of one chunk. The shuffle carries
    tokens only; encoding is done before it, in parallel whatever the size of a conversation.
    """
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "tie")

    def run(batches):
        first = tokenizer_of(template.path, template.pattern).first
        own, chunk, at, parts, deltas, size, begun = None, 0, 0, [], [], 0, False

        def out():
            ids = np.concatenate(parts).astype(np.int32)
            delta = np.zeros(len(ids) + 1, np.int32)
            for lo, hi in deltas:
                delta[lo] += 1
                delta[hi] -= 1
            loss = np.cumsum(delta[:-1]) > 0
            return pa.RecordBatch.from_arrays([
                pa.array([own], pa.int64()), pa.array([chunk], pa.int64()), pa.array([at], pa.int64()),
                pa.array([ids], pa.list_(pa.int32())), pa.array([loss], pa.list_(pa.bool_()))], ["conv_id", "chunk", "at", "ids", "loss"])

        for conv, ids, lo, hi in _turns(batches):
            if not begun or conv != own:
                if begun:
                    parts.append(np.array([first + END]))
                    yield out()
                own, chunk, at, parts, deltas, size, begun = conv, 0, 0, [np.array([first + BEGIN])], [], 1, True
            elif size >= CHUNK:
                yield out()
                chunk, at, parts, deltas, size = chunk + 1, at + size, [], [], 0
            parts.append(ids)
            if hi > lo:
                deltas.append((size + lo, size + hi))
            size += len(ids)
        if begun:
            parts.append(np.array([first + END]))
            yield out()
    return ordered.mapInArrow(run, OUT)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long"
_ROLES = {v: k for k, v in OPEN.items()}


class _Reader:
    """Reads one conversation back from its chunks, keeping hashes and counts only."""

    def __init__(self, conv, tokenizer: Tokenizer):
        self.conv, self.tokenizer = conv, tokenizer
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = self.tokens = 0

    def add(self, ids: np.ndarray, loss: np.ndarray) -> None:
        first, mark, role = self.tokenizer.first, None, ""
        control = np.flatnonzero(ids >= first)
        self.tokens += len(ids)
        for k, at in enumerate(control.tolist()):
            kind = int(ids[at]) - first
            self.chars += len(CONTROL[kind])
            if kind in (*_ROLES, ROLE, SEP):
                stop = int(control[k + 1])
                piece = self.tokenizer.decode(ids[at + 1:stop].tolist())
                self.chars += len(piece)
                text = unescape(piece)
                if kind == ROLE:
                    role = text
                    continue
                self._turn(_ROLES.get(kind, role), text, loss[at + 1:stop])

    def _turn(self, role: str, text: str, loss: np.ndarray) -> None:
        self.n_turns += 1
        self.turns.update(f"{role}\n{text}\n".encode())
        if len(loss) and loss.all():
            self.loss.update(text.encode())
            self.loss_chars += len(text)
        elif loss.any():
            raise ValueError("the loss mask cuts a text")

    def row(self) -> tuple:
        return self.conv, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.tokens


def read_back(chunks: DataFrame, template: Template) -> DataFrame:
    """Digests of conversations from assembled chunks, which must come as `assemble` gives them."""
    def run(batches):
        tokenizer, reader = tokenizer_of(template.path, template.pattern), None
        rows = []
        for batch in batches:
            ids, loss = batch.column("ids"), batch.column("loss")
            for i, (conv, chunk) in enumerate(zip(batch.column("conv_id").to_pylist(), batch.column("chunk").to_pylist())):
                if chunk == 0:
                    if reader:
                        rows.append(reader.row())
                    reader = _Reader(conv, tokenizer)
                reader.add(ids[i].values.to_numpy(zero_copy_only=False), loss[i].values.to_numpy(zero_copy_only=False))
            if len(rows) >= 1000:
                yield _digests(rows)
                rows = []
        if reader:
            rows.append(reader.row())
        if rows:
            yield _digests(rows)
    return chunks.mapInArrow(run, DIGEST)


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    names = [f.split()[0] for f in DIGEST.split(", ")]
    kinds = [pa.string() if f.endswith("string") else pa.int64() for f in DIGEST.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

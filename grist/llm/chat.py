r"""Chat formatting at token level.

Every turn becomes: reserved id of its role, ids of its text, reserved end id.
Texts are encoded segment by segment and the reserved ids, which lie beyond the
tokenizer's vocabulary, are spliced between them, so no text can produce one.
In rendered form a reserved id is its control string; a control string within
a text gets a backslash before it and a backslash is doubled, which ``unescape``
reverses.  The loss mask is the prefix sum of +1 where an assistant's text
begins and -1 where it ends; a turn's place in its conversation is the prefix
sum of the token counts before it.

A formatted conversation is a run of rows, one a turn, so its length is bounded
by disk only; it is read back as a stream in order, each token once.  Defined
cases: a null text is empty; a null role and an empty one are the empty role;
roles other than the three known ones are spelled out after a role id; null turns
come first; rows that tie on the turn follow in order of role and token ids;
repeated rows are repeated turns; all rows with a null conv_id are one conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import written
from .tokens import encoder as shared_encoder
from .tokens import tokenizer_path
from .words import slices

# Control strings in the order of their reserved ids.
CONTROL = ("### System: ", "### User: ", "### Assistant: ", "### Role: ", "</role> ", "</turn>\n")
ROLES = {"system": 0, "user": 1, "assistant": 2}
OTHER, ROLE_END, TURN_END = 3, 4, 5
LOSS_ROLE = "assistant"

_ESCAPED = re.compile("|".join([r"\\", *(re.escape(c.strip()) for c in CONTROL)]))
_UNESCAPED = re.compile(r"\\(.)", re.S)
_UNESCAPED_BYTES = re.compile(rb"\\(.)", re.S)  # what is escaped is ASCII


def escape(text: str) -> str:
    if "\\" not in text and "### " not in text and "</" not in text:  # how control strings begin
        return text
    return _ESCAPED.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _UNESCAPED.sub(r"\1", text) if "\\" in text else text


class Codec:
    """Turns to ids and mask, and back."""

    def __init__(self, path: str):
        self.encoder = shared_encoder(path, plain=True)
        self.base = self.encoder.tokenizer.get_vocab_size()
        self.heads = {role: np.array([self.base + i], dtype="<u4").tobytes() for role, i in ROLES.items()}
        self.other, self.role_end, self.turn_end = (np.array([self.base + i], dtype="<u4").tobytes() for i in (OTHER, ROLE_END, TURN_END))

    def flat(self, turns: list[tuple[str, str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids and the mask of all turns, one after the other, and where each begins (and the last ends)."""
        bodies = self.encoder.encode([escape(text) for _, text in turns])
        odd = [i for i, (role, _) in enumerate(turns) if role not in ROLES]
        names = dict(zip(odd, self.encoder.encode([escape(turns[i][0]) for i in odd])))
        heads = [self.heads.get(role) or self.other + names[i] + self.role_end for i, (role, _) in enumerate(turns)]
        ids = np.frombuffer(b"".join([x for head, body in zip(heads, bodies) for x in (head, body, self.turn_end)]), dtype="<u4")
        head, body = (np.array([len(x) // 4 for x in xs], dtype=np.int64) for xs in (heads, bodies))
        offsets = np.concatenate([[0], np.cumsum(head + body + 1)]).astype(np.int64)
        step = np.zeros(len(ids) + 1, dtype=np.int8)
        said = np.flatnonzero(np.array([role == LOSS_ROLE for role, _ in turns], dtype=bool) & (body > 0))
        step[offsets[said] + head[said]] += 1
        step[offsets[said] + head[said] + body[said]] -= 1
        return ids, np.cumsum(step[:-1], dtype=np.int8), offsets

    def turns(self, turns: list[tuple[str, str]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids, mask) of each (role, text)."""
        ids, mask, offsets = self.flat(turns)
        return [(ids[a:b], mask[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]

    def text(self, ids: np.ndarray) -> str:
        return self.encoder.tokenizer.decode(ids.tolist(), skip_special_tokens=False)

    def render(self, ids: np.ndarray) -> str:
        """The formatted text of ids, reserved ones as their control strings."""
        cut = np.flatnonzero(ids >= self.base)
        out, at = [], 0
        for i in cut.tolist():
            out += [self.text(ids[at:i]) if i > at else "", CONTROL[int(ids[i]) - self.base]]
            at = i + 1
        return "".join([*out, self.text(ids[at:]) if at < len(ids) else ""])

    def parse(self, ids: np.ndarray) -> list[tuple[str, str]]:
        """The (role, text) turns of whole formatted turns."""
        names, turns, role, at = {v: k for k, v in ROLES.items()}, [], None, 0
        for i in np.flatnonzero(ids >= self.base).tolist():
            kind = int(ids[i]) - self.base
            body = unescape(self.text(ids[at:i])) if i > at else ""
            if kind in names or kind == OTHER:
                role = names.get(kind)
            elif kind == ROLE_END:
                role = body
            else:
                turns.append((role or "", body))
            at = i + 1
        if at != len(ids):
            raise ValueError("a turn without its end")
        return turns


def format_conversations(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """(conv_id, part, start, ids, mask): the parts of each formatted conversation; start counts tokens before the part."""
    path = tokenizer or tokenizer_path()

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path)
        for batch in batches:
            roles, texts = ([x or "" for x in batch.column(i).to_pylist()] for i in (2, 3))
            for a, b in slices([len(t) for t in texts], 1_000_000):
                ids, mask, offsets = codec.flat(list(zip(roles[a:b], texts[a:b])))
                offsets = pa.array(offsets.astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (ids.view("<i4"), mask)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(1)[a:b], pa.array(roles[a:b], pa.string()), *lists], names=["conv_id", "turn", "role", "ids", "mask"])

    rows = rows.select(F.col(f"`{conv}`").cast("long").alias("conv_id"), F.col(f"`{turn}`").cast("long").alias("turn"), F.col(f"`{role}`").alias("role"), F.col(f"`{text}`").alias("text"))
    parts = rows.mapInArrow(encode, "conv_id long, turn long, role string, ids array<int>, mask array<tinyint>")
    order = W.partitionBy("conv_id").orderBy("turn", "role", "ids")
    before = F.sum(F.size("ids").cast("long")).over(order.rowsBetween(W.unboundedPreceding, -1))
    return parts.select("conv_id", F.row_number().over(order).cast("long").alias("part"), F.coalesce(before, F.lit(0)).alias("start"), "ids", "mask")


def read_back(formatted: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Per conversation what its ids and mask say: turns, text under the mask, lengths and digests."""
    path = tokenizer or tokenizer_path()

    class Sums:
        def __init__(self) -> None:
            self.turns, self.loss, self.n, self.loss_chars, self.chars, self.tokens = hashlib.sha256(), hashlib.sha256(), 0, 0, 0, 0

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, held, sums = Codec(path), None, None
        names = {codec.base + v: k for k, v in ROLES.items()}
        shown = {codec.base + i: len(c) for i, c in enumerate(CONTROL)}
        done: list[tuple] = []

        def close() -> None:
            done.append((held, sums.n, sums.turns.hexdigest(), sums.loss_chars, sums.loss.hexdigest(), sums.chars, sums.tokens))

        for batch in batches:
            ids, mask = batch.column(2).flatten().to_numpy().view("<u4"), batch.column(3).flatten().to_numpy().astype(bool)
            offsets = batch.column(2).offsets.to_numpy().astype(np.int64)
            offsets = (offsets - offsets[0]).tolist()
            raw, at_byte = codec.encoder.spell(ids, codec.base)
            cut = np.flatnonzero(ids >= codec.base)
            ends, kinds = cut.tolist(), ids[cut].tolist()
            loss = np.concatenate([[0], np.cumsum(mask)])  # masked ids before each place
            i = 0
            for key, start, a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), offsets[:-1], offsets[1:]):
                if sums is None or key != held:
                    if sums is not None:
                        close()
                    held, sums = key, Sums()
                if start != sums.tokens:
                    raise ValueError(f"conversation {key}: a part is missing")
                role, at = b"", a
                while i < len(ends) and ends[i] < b:
                    end, kind = ends[i], kinds[i]
                    i += 1
                    written = raw[at_byte[at] : at_byte[end]]
                    body = _UNESCAPED_BYTES.sub(rb"\1", written) if b"\\" in written else written
                    sums.chars += len(written.decode("utf-8", "replace")) + shown[kind]
                    masked = int(loss[end] - loss[at])
                    if masked:
                        said = body if masked == end - at else _UNESCAPED_BYTES.sub(rb"\1", codec.encoder.spell(ids[at:end][mask[at:end]], codec.base)[0])
                        sums.loss.update(said)
                        sums.loss_chars += len(said.decode("utf-8", "replace"))
                    if mask[end]:
                        raise ValueError(f"conversation {key}: the mask covers a reserved id")
                    if kind in names:
                        role = names[kind].encode()
                    elif kind == codec.base + ROLE_END:
                        role = body
                    elif kind == codec.base + TURN_END:
                        sums.turns.update(role + b"\n" + body + b"\n")
                        sums.n += 1
                        role = b""
                    at = end + 1
                if at != b:
                    raise ValueError(f"conversation {key}: a turn without its end")
                sums.tokens += b - a
            yield _summary(done)
            done.clear()
        if sums is not None:
            close()
            yield _summary(done)

    parts = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "part").select("conv_id", "start", "ids", "mask")
    return parts.mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long")


def _summary(rows: list[tuple]) -> pa.RecordBatch:
    names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens")
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_pydict({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(zip(names, kinds))})


def formatted_digests(rows: DataFrame, tokenizer: str | None = None, **columns: str) -> DataFrame:
    """Formats, writes the parts to the shared folder and reads them back."""
    return read_back(written(format_conversations(rows, tokenizer=tokenizer, **columns), "chat"), tokenizer)

"""Chat formatting by columnar byte assembly, with a loss mask and an exact way back."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyglass.llm.store import PIECE, pieces

#: A turn is TURN role SAYS text END. These and the control strings of common chat templates never
#: stand inside an escaped role or text.
TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>\n"
CONTROLS = ["<|turn|>", "<|says|>", "<|end|>", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<|im_start|>", "<|im_end|>", "<|endoftext|>"]
#: Roles whose texts carry loss.
LEARNT = ("assistant",)

_SPLIT = [(first, "|".join(re.escape(c[1:]) for c in CONTROLS if c[0] == first)) for first in sorted({c[0] for c in CONTROLS})]
_PARTS = re.compile(f"{re.escape(TURN)}(.*?){re.escape(SAYS)}(.*?){re.escape(END)}", re.S)


def escaped(texts: pa.Array) -> pa.Array:
    """Each backslash doubled, then a backslash after the first character of each control string: no control string is left."""
    texts = pc.replace_substring(texts, "\\", "\\\\")
    for first, rest in _SPLIT:
        texts = pc.replace_substring_regex(texts, rf"({re.escape(first)})({rest})", r"\1\\\2")
    return texts


def unescaped(text: str) -> str:
    """The inverse of escaped()."""
    return re.sub(r"\\(\\?)", r"\1", text) if "\\" in text else text


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and each text's offsets into them."""
    texts = pa.concat_arrays([texts.cast(pa.large_string())])  # offsets begin at 0
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), offsets


def assembled(conv: np.ndarray, roles: pa.Array, texts: pa.Array) -> tuple[pa.Array, list[list[tuple[int, int]]], np.ndarray]:
    """One formatted string for each run of equal numbers in conv, the byte spans of each that carry loss, and the runs' starts.

    Segments are the mark, role, mark, text and mark of each turn. Their lengths give cumulative offsets into one preallocated
    Arrow buffer; each column of segments is scattered there by indices, for as many rows at a time as hold PIECE bytes, which bounds the indices.
    """
    n = len(conv)
    learnt = pc.is_in(roles, pa.array(LEARNT)).to_numpy(zero_copy_only=False)
    (role_bytes, role_at), (text_bytes, text_at) = _bytes_of(escaped(roles)), _bytes_of(escaped(texts))
    marks = [np.frombuffer(m.encode(), np.uint8) for m in (TURN, SAYS, END)]
    lengths = np.empty((n, 5), np.int64)
    lengths[:, 0], lengths[:, 2], lengths[:, 4] = map(len, marks)
    lengths[:, 1], lengths[:, 3] = np.diff(role_at), np.diff(text_at)
    ends = np.cumsum(lengths.reshape(-1)).reshape(n, 5)
    starts = ends - lengths
    total = int(ends[-1, -1]) if n else 0
    buffer = pa.allocate_buffer(total)
    out = np.frombuffer(buffer, np.uint8)
    for k, mark in zip((0, 2, 4), marks, strict=True):
        out[(starts[:, k, None] + np.arange(len(mark))).reshape(-1)] = np.tile(mark, n)
    for k, data, at in ((1, role_bytes, role_at), (3, text_bytes, text_at)):
        lo = 0
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + PIECE, side="right")) - 1)
            if hi == lo + 1:
                out[starts[lo, k] : ends[lo, k]] = data[at[lo] : at[hi]]
            else:
                out[np.arange(at[lo], at[hi]) + np.repeat(starts[lo:hi, k] - at[lo:hi], lengths[lo:hi, k])] = data[at[lo] : at[hi]]
            lo = hi
    first = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]])) if n else np.zeros(0, np.int64)
    bounds = np.append(starts[first, 0], total)
    formatted = pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(bounds.astype(np.int64)), buffer])
    spans = []
    for run, (a, b) in enumerate(zip(first, np.append(first[1:], n)[: len(first)], strict=True)):
        rows = np.flatnonzero(learnt[a:b]) + a
        spans.append(list(zip((starts[rows, 3] - bounds[run]).tolist(), (ends[rows, 3] - bounds[run]).tolist(), strict=True)))
    return formatted, spans, first


_OUT = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("loss_starts", pa.list_(pa.int64())), ("loss_ends", pa.list_(pa.int64()))])


def _formatted_batches(batches):
    """Rows come sorted by group; the last conversation of a batch waits for the next, as it may go on there. Conversations are assembled some
    megabytes at a time."""

    def begins(b) -> np.ndarray:
        """Where a conversation begins; null is one of its own, beside the number that stands for it."""
        group, none = b.column("grp").to_numpy(), b.column("none").to_numpy(zero_copy_only=False)
        return np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (none[1:] != none[:-1])]))

    def parts(t: pa.Table):
        t = t.combine_chunks()
        b = t.to_batches()[0]
        starts = begins(b)
        sizes = np.cumsum(pc.binary_length(b.column("text")).to_numpy())
        lo = 0
        while lo < len(starts):
            base = sizes[starts[lo] - 1] if starts[lo] else 0
            fit = int(np.searchsorted(sizes, base + PIECE, side="right"))
            hi = max(lo + 1, int(np.searchsorted(starts, fit, side="right")) - 1) if fit < b.num_rows else len(starts)
            end = starts[hi] if hi < len(starts) else b.num_rows
            yield done(b.slice(starts[lo], end - starts[lo]))
            lo = hi

    def done(t: pa.RecordBatch):
        group = np.zeros(t.num_rows, np.int64)
        group[begins(t)] = 1
        group = np.cumsum(group)
        roles, texts = t.column("role"), t.column("text")
        formatted, spans, first = assembled(group, roles, texts)
        ids = t.column("conv_id").take(pa.array(first))
        starts, ends = ([[s[k] for s in x] for x in spans] for k in (0, 1))
        return pa.RecordBatch.from_arrays([ids, formatted.cast(pa.string()), pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64()))], schema=_OUT)

    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        cut = int(begins(b)[-1])
        if cut or (held and any(held[-1].column(c)[0].as_py() != b.column(c)[0].as_py() for c in ("grp", "none"))):
            yield from parts(pa.Table.from_batches([*held, b.slice(0, cut)] if cut else held))
            held = []
        held.append(b.slice(cut))
    if held:
        yield from parts(pa.Table.from_batches(held))


def formatted(rows: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_starts, loss_ends) for each conversation of rows (conv_id, turn, role, text).

    Turns are taken in order of turn, null turns first, ties by role and text; repeated rows are turns of their own. Null roles and texts are empty;
    rows with a null conv_id are one conversation, apart from all numbers. loss_starts and loss_ends bound, in bytes of the UTF-8, the escaped
    texts of learnt roles. A conversation is one cell of the result, so it must fit into one (2 GB). Empty tables give no
    rows; other columns are not read.
    """
    id_ = F.col("conv_id").cast("long")
    # Sorted by a number that is never null, and by whether it stands for null.
    group = F.coalesce(id_, F.lit(-(1 << 63)))
    rows = rows.select(id_.alias("conv_id"), group.alias("grp"), id_.isNull().alias("none"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartition("grp").sortWithinPartitions("grp", "none", "turn", "role", "text").select("conv_id", "grp", "none", "role", "text")
    return rows.mapInArrow(_formatted_batches, "conv_id long, formatted string, loss_starts array<long>, loss_ends array<long>")


def turns_of(formatted_text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn, read from a formatted conversation."""
    return [(unescaped(r), unescaped(t)) for r, t in _PARTS.findall(formatted_text)]


def _read_batches(batches):
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    for b in pieces(batches, "formatted"):
        rows = []
        for conv_id, text, starts, ends in zip(*(b.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_starts", "loss_ends")), strict=True):
            raw, turns = text.encode(), turns_of(text)
            loss = "".join(unescaped(raw[x:y].decode()) for x, y in zip(starts, ends, strict=True))
            said = "".join(f"{r}\n{t}\n" for r, t in turns)
            rows.append((conv_id, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
        columns = list(zip(*rows, strict=True)) if rows else [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def read_back(conversations: DataFrame) -> DataFrame:
    """Digests of what the rows of formatted() hold: turns, and the text under the loss mask."""
    return conversations.mapInArrow(_read_batches, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")

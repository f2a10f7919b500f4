"""Chat formatting with typed content parts.

A message is a list of parts: text, image, audio or document. A visitor goes through the parts in
order and flattens them: text is escaped, any other part becomes a placeholder with its number in
the message, with its reference and the number of tokens it will expand to on record. Formatting works on single messages, so
a conversation of any length needs no task that holds it.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankwright.session import write_table

PART = "struct<type: string, text: string, ref: string, width: long, height: long, seconds: double, pages: long>"
ATTACHMENT = "struct<number: long, type: string, ref: string, tokens: long>"

#: Control strings of the template and of other common ones. Fixed values.
CONTROLS = (
    "<|start|>", "<|message|>", "<|end|>", "<|image|>", "<|audio|>", "<|document|>", "<|im_start|>", "<|im_end|>",
    "<|endoftext|>", "<|startoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<|eot_id|>",
    "<s>", "</s>", "<unk>", "<pad>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]",
)

_REST = "|".join(re.escape(c[1:]) for c in sorted(CONTROLS, key=len, reverse=True))
_CONTROL = re.compile(rf"([<\[])(\\*)(?={_REST})")
_ESCAPED = re.compile(rf"([<\[])\\(\\*)(?={_REST})")


def escape(text: str) -> str:
    """Puts a backslash into every control string, behind its first character.

    A control string with backslashes there already gets one more, so ``unescape`` can undo it.
    """
    return _CONTROL.sub(r"\1\2\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


@dataclass(frozen=True)
class ChatSpec:
    """Token counts: an image has one token per patch, audio and documents a rate."""

    patch: int = 28
    audio_tokens_per_second: float = 25.0
    tokens_per_page: int = 256
    loss_roles: tuple[str, ...] = ("assistant",)


class _Flatten:
    """Visits the parts of one message."""

    def __init__(self, spec: ChatSpec) -> None:
        self.spec, self.out, self.attachments = spec, [], []

    def visit(self, part: dict) -> None:
        getattr(self, f"visit_{part['type']}", self.visit_other)(part)

    def visit_text(self, part: dict) -> None:
        self.out.append(escape(part["text"] or ""))

    def visit_image(self, part: dict) -> None:
        sides = [math.ceil((part.get(k) or 0) / self.spec.patch) for k in ("width", "height")]
        self._attach(part, max(1, sides[0] * sides[1]))

    def visit_audio(self, part: dict) -> None:
        self._attach(part, max(1, math.ceil((part.get("seconds") or 0) * self.spec.audio_tokens_per_second)))

    def visit_document(self, part: dict) -> None:
        self._attach(part, max(1, (part.get("pages") or 1) * self.spec.tokens_per_page))

    def visit_other(self, part: dict) -> None:
        raise ValueError(f"unknown part type {part['type']!r}")

    def _attach(self, part: dict, tokens: int) -> None:
        self.out.append(f"<|{part['type']}|>")
        self.attachments.append({"number": len(self.attachments), "type": part["type"], "ref": part.get("ref"), "tokens": tokens})


def _format(spec: ChatSpec, counter: Callable[[], Callable[[list[str]], list[int]]] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter() if counter else None
        for batch in batches:
            texts, attached, tokens, starts, ends = [], [], [], [], []
            for role, parts in zip(batch.column("role").to_pylist(), batch.column("parts").to_pylist()):
                visitor = _Flatten(spec)
                for part in parts or []:
                    visitor.visit(part)
                head, content = f"<|start|>{escape(role or '')}<|message|>", "".join(visitor.out)
                texts.append(f"{head}{content}<|end|>")
                learned = role in spec.loss_roles
                starts.append(len(head) if learned else None)
                ends.append(len(head) + len(content) if learned else None)
                attached.append(visitor.attachments)
                tokens.append(sum(a["tokens"] for a in visitor.attachments))
            if count:
                tokens = [a + b for a, b in zip(tokens, count(texts))]
            kind = pa.list_(pa.struct([("number", pa.int64()), ("type", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("turn"), pa.array(texts, pa.string()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(attached, kind), pa.array(tokens, pa.int64())],
                ["conv_id", "turn", "formatted", "loss_start", "loss_end", "attachments", "n_tokens"],
            )

    return run


def bpe_counter(path: str, pattern: str) -> Callable[[], Callable[[list[str]], list[int]]]:
    """Counts tokens by a tiktoken vocabulary file that every executor can open."""

    def make() -> Callable[[list[str]], list[int]]:
        import base64

        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(encoding.encode_ordinary(t)) for t in texts]

    return make


def text_parts(text: str | Column = "text") -> Column:
    """A message of one text part; a null text is an empty one."""
    value = F.col(text) if isinstance(text, str) else text
    kinds = ("ref", "string"), ("width", "long"), ("height", "long"), ("seconds", "double"), ("pages", "long")
    return F.array(
        F.struct(
            F.lit("text").alias("type"),
            F.coalesce(value.cast("string"), F.lit("")).alias("text"),
            *[F.lit(None).cast(kind).alias(name) for name, kind in kinds],
        )
    )


def format_messages(messages: DataFrame, spec: ChatSpec = ChatSpec(), counter=None) -> DataFrame:
    """``conv_id, turn, formatted, loss_start, loss_end, attachments, n_tokens`` for each message.

    Needs ``conv_id, turn, role`` and ``parts`` (an array of ``PART``); other columns are ignored.
    The formatted messages of a conversation, joined in order of turn, are its formatted text.
    The loss mask is from ``loss_start`` to ``loss_end``, in code points of ``formatted``, for the
    roles that are learned, and null for others.
    A null role or text is empty, null parts are none, and unknown part types raise an error.
    ``n_tokens`` has the tokens that attachments expand to, and those of the formatted text if
    ``counter`` makes a function that counts them. An empty table gives no rows.
    """
    kept = messages.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"), F.col("parts").cast(f"array<{PART}>").alias("parts"),
    )
    schema = f"conv_id long, turn long, formatted string, loss_start long, loss_end long, attachments array<{ATTACHMENT}>, n_tokens long"
    return kept.mapInArrow(_format(spec, counter), schema)


_MESSAGE = re.compile(r"<\|start\|>(.*?)<\|message\|>(.*?)<\|end\|>", re.S)


def _read():
    """Reads sorted formatted messages back, one conversation after another, none held whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}
        done: list[dict] = []

        def finish() -> None:
            if state:
                state["turns_sha256"] = state.pop("turns").hexdigest()
                state["loss_sha256"] = state.pop("loss").hexdigest()
                done.append(dict(state))

        def drain() -> pa.RecordBatch:
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens", "n_attachments"]
            kinds = [pa.string() if n.endswith("sha256") else pa.int64() for n in names]
            rows = pa.RecordBatch.from_arrays([pa.array([d[n] for d in done], k) for n, k in zip(names, kinds)], names)
            done.clear()
            return rows

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_start", "loss_end", "n_tokens", "n_attachments"))
            for conv, text, start, end, tokens, attached in zip(*columns):
                if not state or state["conv_id"] != conv:
                    finish()
                    state = {
                        "conv_id": conv, "n_turns": 0, "loss_chars": 0, "formatted_chars": 0, "n_tokens": 0,
                        "n_attachments": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(),
                    }
                for role, content in _MESSAGE.findall(text):
                    state["turns"].update(f"{unescape(role)}\n{unescape(content)}\n".encode())
                    state["n_turns"] += 1
                if start is not None:
                    learned = unescape(text[start:end])
                    state["loss"].update(learned.encode())
                    state["loss_chars"] += len(learned)
                state["formatted_chars"] += len(text)
                state["n_tokens"] += tokens
                state["n_attachments"] += attached
            if len(done) > 10_000:
                yield drain()
        finish()
        yield drain()

    return run


def read_back(formatted: DataFrame) -> DataFrame:
    """One row per conversation with what its formatted text says.

    Turns are in order of ``turn`` (null first), rows of one turn in order of their formatted text.
    A null conv_id is a conversation of its own.
    """
    slim = formatted.select("conv_id", "turn", "formatted", "loss_start", "loss_end", "n_tokens", F.size("attachments").alias("n_attachments"))
    sorted_rows = slim.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted")
    schema = (
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
        "formatted_chars long, n_tokens long, n_attachments long"
    )
    return sorted_rows.mapInArrow(_read(), schema)


def format_and_read(messages: DataFrame, spec: ChatSpec = ChatSpec(), counter=None) -> DataFrame:
    """Writes the formatted messages to the shared folder and reads them back."""
    return read_back(write_table(format_messages(messages, spec, counter), "chats"))

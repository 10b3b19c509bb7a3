"""Chat formatting with typed content parts, a reversible template and a loss mask."""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare

#: The role whose text is learnt.
LEARNT = "assistant"


def escape(text: str) -> str:
    """Afterwards no character of the text can be read as one of the template's."""
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def unescape(text: str) -> str:
    return text.replace("&gt;", ">").replace("&lt;", "<").replace("&amp;", "&")


#: Most tokens that an attachment, or a turn, counts.
MOST_TOKENS = 1 << 62


def _amount(x: object) -> int | float:
    """A finite number of at least 0; 0 for anything else."""
    return max(0, x) if isinstance(x, (int, float)) and (isinstance(x, int) or math.isfinite(x)) else 0


def _text(x: object) -> str:
    """A string that UTF-8 can hold: half surrogates become U+FFFD."""
    return ("" if x is None else x if isinstance(x, str) else str(x)).encode("utf-16", "surrogatepass").decode("utf-16", "replace")


@dataclass
class Flattened:
    """Parts of one turn as text with placeholders."""

    body: str = ""
    spans: list[tuple[int, int]] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)
    extra_tokens: int = 0


class Flatten:
    """Visitor over typed content parts; a part of kind K goes to ``visit_K``.

    text: {"type": "text", "text"}; image: {"type": "image", "ref", "width", "height"};
    audio: {"type": "audio", "ref", "seconds"}; document: {"type": "document", "ref",
    "pages"}. An attachment leaves a placeholder ``<kind n>``, n counting attachments of
    the turn from 0, and is recorded with its reference and the tokens that it expands to.
    A part of another kind, or without a kind, keeps its JSON as text. Sizes that are no
    finite numbers of at least 0 count as missing, and counts end at MOST_TOKENS.
    """

    def __init__(self, tile: int = 14, audio_per_second: float = 25.0, per_page: int = 256) -> None:
        self.tile, self.audio_per_second, self.per_page = tile, audio_per_second, per_page

    def visit(self, parts: list) -> Flattened:
        out = Flattened()
        for p in parts:
            kind = p.get("type") if isinstance(p, dict) else None
            getattr(self, f"visit_{kind}" if kind in ("text", "image", "audio", "document") else "visit_other")(p, out)
        return out

    def visit_text(self, part: dict, out: Flattened) -> None:
        self._text(_text(part.get("text")), out)

    def visit_other(self, part: object, out: Flattened) -> None:
        self._text(_text(part if isinstance(part, str) else json.dumps(part, ensure_ascii=False, sort_keys=True)), out)

    def visit_image(self, part: dict, out: Flattened) -> None:
        tiles = math.prod(-int(-_amount(part.get(side)) // self.tile) for side in ("width", "height"))
        self._attach("image", part, max(1, tiles), out)

    def visit_audio(self, part: dict, out: Flattened) -> None:
        self._attach("audio", part, max(1, math.ceil(min(_amount(part.get("seconds")), MOST_TOKENS) * self.audio_per_second)), out)

    def visit_document(self, part: dict, out: Flattened) -> None:
        self._attach("document", part, max(1, math.ceil(_amount(part.get("pages")))) * self.per_page, out)

    def _text(self, text: str, out: Flattened) -> None:
        safe = escape(text)
        out.spans.append((len(out.body), len(out.body) + len(safe)))
        out.body += safe

    def _attach(self, kind: str, part: dict, tokens: int, out: Flattened) -> None:
        tokens = min(tokens, MOST_TOKENS)
        out.body += f"<{kind} {len(out.attachments)}>"
        out.attachments.append({"kind": kind, "ref": _text(part.get("ref")), "tokens": tokens})
        out.extra_tokens = min(out.extra_tokens + tokens, MOST_TOKENS)


_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_ATTACHED = pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())]))
_TURNS = "conv_id long, turn long, role string, text string, formatted string, loss array<struct<start: int, end: int>>, attachments array<struct<kind: string, ref: string, tokens: long>>, extra_tokens long"


def format_turns(turns: DataFrame, parts: str | None = None, learnt: str = LEARNT, visitor: Flatten | None = None) -> DataFrame:
    """One row per row of ``turns`` with its piece of the formatted conversation.

    ``formatted`` is ``<turn ROLE>``, line break, body, ``</turn>``, line break. ``loss``
    holds the spans (code points of ``formatted``) that are learnt: the texts of ``learnt``
    turns, without placeholders. ``parts`` names a column with a JSON list of typed parts,
    used instead of ``text`` where it is one. Null role and null text count as empty.
    Each row is formatted alone, so no conversation is ever gathered here.
    """
    prepare(turns.sparkSession)
    visitor = visitor or Flatten()
    own = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit("")), (F.col(parts) if parts else F.lit(None)).cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pieces, spans, attached, extra = [], [], [], []
            for role, text, listed in zip(*(b.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                try:
                    given = json.loads(listed) if listed else None
                except (ValueError, RecursionError):
                    given = None
                flat = visitor.visit(given if isinstance(given, list) else [{"type": "text", "text": text}])
                head = f"<turn {escape(role)}>\n"
                pieces.append(f"{head}{flat.body}</turn>\n")
                spans.append([{"start": a + len(head), "end": e + len(head)} for a, e in flat.spans] if role == learnt else [])
                attached.append(flat.attachments)
                extra.append(flat.extra_tokens)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(4)), pa.array(pieces, pa.string()), pa.array(spans, _SPAN), pa.array(attached, _ATTACHED), pa.array(extra, pa.int64())], ["conv_id", "turn", "role", "text", "formatted", "loss", "attachments", "extra_tokens"])

    return own.mapInArrow(run, _TURNS)


def join_turns(pieces: DataFrame) -> DataFrame:
    """(conv_id, formatted): whole conversations, for those that fit in one row."""
    order = F.sort_array(F.collect_list(F.struct("turn", "role", "text", "formatted")))
    return pieces.groupBy("conv_id").agg(F.array_join(F.transform(order, lambda t: t["formatted"]), "").alias("formatted"))


_PLACEHOLDER = re.compile(r"<(image|audio|document) (\d+)>")


def split_piece(formatted: str) -> tuple[str, str]:
    """(role, body as it is in the template) of a formatted turn."""
    head, found, rest = formatted.partition(">\n")
    if not found or not head.startswith("<turn ") or not rest.endswith("</turn>\n") or "<" in head[1:] or "<" in _PLACEHOLDER.sub("", rest[:-8]):
        raise ValueError("not a formatted turn")
    return unescape(head[6:]), rest[:-8]


def parse_piece(formatted: str) -> tuple[str, str]:
    """(role, text) of a formatted turn. A turn with attachments has its body as it is in the template, so that a placeholder is no text."""
    role, body = split_piece(formatted)
    return role, body if "<" in body else unescape(body)


def parse_parts(formatted: str, attachments: list[dict]) -> tuple[str, list[dict]]:
    """(role, parts) of a formatted turn: the inverse of the visitor, texts joined between attachments."""
    role, body = split_piece(formatted)
    parts, at = [], 0
    for m in _PLACEHOLDER.finditer(body):
        if m.start() > at:
            parts.append({"type": "text", "text": unescape(body[at : m.start()])})
        a = attachments[int(m[2])]
        parts.append({"type": m[1], "ref": a["ref"], "tokens": a["tokens"]})
        at = m.end()
    if at < len(body):
        parts.append({"type": "text", "text": unescape(body[at:])})
    return role, parts


def read_back(pieces: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of each conversation, read from the formatted pieces.

    Turns stand in the order of turn, then role, then text; nulls come first. A task
    reads its conversations as a sorted stream and keeps the digests of one, so a
    conversation may have any number of turns. Turns without a conv_id are one
    conversation with a null id.
    """
    prepare(pieces.sparkSession)
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    own = pieces.select("conv_id", "turn", "role", "text", "formatted", "loss").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "formatted", "loss")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, done = object(), None, []

        def close() -> None:
            if state:
                n, turns, chars, loss, size = state
                done.append((now, n, turns.hexdigest(), chars, loss.hexdigest(), size))

        for b in batches:
            for conv, piece, spans in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if state is None or conv != now:
                    close()
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = parse_piece(piece)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                for s in spans:
                    learnt = unescape(piece[s["start"] : s["end"]])
                    state[2] += len(learnt)
                    state[3].update(learnt.encode())
                state[4] += len(piece)
            if done:
                yield pa.RecordBatch.from_pylist([dict(zip(names, d, strict=True)) for d in done], _READ)
                done = []
        close()
        if done:
            yield pa.RecordBatch.from_pylist([dict(zip(names, d, strict=True)) for d in done], _READ)

    return own.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


_READ = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

#: The same for DuckDB, with the conversation that is added.
SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, i, ['user', 'assistant'][i + 1], '\### Assistant: </turn> ok' FROM range(2) t(i)),
e AS (SELECT *, length(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) + length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) + 16 AS size,
             CASE WHEN role = 'assistant' THEN text ELSE '' END AS learnt FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(length(learnt)) AS BIGINT) AS loss_chars, sha256(string_agg(learnt, '' ORDER BY turn, role, text)) AS loss_sha256, CAST(sum(size) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

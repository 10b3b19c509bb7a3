"""Token counts with a whole-token shortcut: pre-tokens that are proven to be one token are only looked up."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_slices, prepare

_MARK = "▁"
#: Blanks with the word after them, blanks before a line break or the end, a line break.
_PRE_TOKEN = re.compile(r" *[^ \n]+| +|\n")
#: Pre-tokens whose counts a worker remembers.
_REMEMBERED = 1 << 20


class PieceCounter:
    """Counts the pieces of a sentencepiece BPE model.

    ``proven`` holds when pre-tokens cannot merge with each other: texts are taken as
    they are (identity normalisation, a blank put first, blanks kept), no piece has a
    blank behind another character, and no piece has a line break. Then a text's count
    is the sum over its pre-tokens. ``whole`` are the pre-tokens that the model itself
    encodes as one piece; every vocabulary string is tried, as merges need not reach
    each one. Without the proof texts are encoded whole.
    """

    def __init__(self, path: str) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        spec = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        norm = spec.normalizer_spec
        texts = [p.piece for p in spec.pieces if p.type in (1, 4)]
        special = [p.piece for p in spec.pieces if p.type == 4]
        self.proven = (
            norm.name == "identity" and not norm.precompiled_charsmap and norm.add_dummy_prefix and not norm.remove_extra_whitespaces and norm.escape_whitespaces
            and spec.trainer_spec.model_type == 2 and not spec.trainer_spec.treat_whitespace_as_suffix and not special
            and not any(_MARK in p.lstrip(_MARK) or "\n" in p or " " in p for p in texts)
        )
        self.break_size = len(self.model.encode("\n")) - 1
        self.whole: dict[str, int] = {"\n": self.break_size}
        if self.proven:
            tried = sorted({p.replace(_MARK, " ") for p in texts})
            self.whole |= {t: 1 for t, n in zip(tried, self._merged(tried), strict=True) if n == 1}
        self.known = dict(self.whole)

    def _merged(self, pre_tokens: list[str]) -> list[int]:
        """Piece counts of pre-tokens: the model puts one blank first, so one is taken away, or a line break shields the start."""
        given = [t[1:] if t[0] == " " and t != " " else "\n" + t if t != " " else t for t in pre_tokens]
        off = [0 if t[0] == " " else 1 + self.break_size for t in pre_tokens]
        out = [len(ids) - o for ids, o in zip(self.model.encode(given, num_threads=1), off, strict=True)]
        blank = len(self.model.encode("\n")) - self.break_size
        return [blank if t == " " else n for t, n in zip(pre_tokens, out, strict=True)]

    def counts(self, texts: list[str]) -> list[int]:
        if not self.proven:
            return [len(ids) for ids in self.model.encode(texts, num_threads=1)]
        split = [_PRE_TOKEN.findall(" " + t.replace(_MARK, " ")) if t else [] for t in texts]
        new = sorted(set().union(*split) - self.known.keys())
        if new:
            if len(self.known) + len(new) > _REMEMBERED:
                self.known = dict(self.whole)
                new = sorted(set().union(*split) - self.known.keys())
            self.known.update(zip(new, self._merged(new), strict=True))
        of = self.known.__getitem__
        return [sum(map(of, s)) for s in split]


class JsonCounter:
    """Counts tokens of a tokenizers file; texts are encoded whole."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()

    def counts(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.model.encode_batch(texts, add_special_tokens=False)]


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of ``docs``: the vocabulary's tokens of the whole text.

    ``vocabulary`` is the path of a .model or .json file, or the bare name of a file of
    ``public_tokenizers``, which each executor looks up in its own installation. Null
    counts as the empty text, which has no tokens. Other columns are ignored.
    """
    prepare(docs.sparkSession)
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = vocabulary
        if not os.path.dirname(path):
            import public_tokenizers

            path = public_tokenizers.path(path)
        counter = PieceCounter(path) if path.endswith(".model") else JsonCounter(path)
        for b in batches:
            for lo, hi, _, offs in column_slices(b.column(1)):
                texts = [t or "" for t in b.column(1).slice(lo, hi - lo).to_pylist()]
                n = pa.array(counter.counts(texts), pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(offs[1:] - offs[:-1], pa.int64()), n], ["doc_id", "n_bytes", "n_tokens"])

    out = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)

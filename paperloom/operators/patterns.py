"""The token pattern language: lexicons, patterns and the features that they give.

Pattern elements: ``@LEX`` a phrase of a lexicon (concepts first, then actions with a
verb tag; it may take several tokens), ``SELFCITATION`` the word itself, ``CITATION`` a
word that ends so, ``CREF`` a cardinal CREF, ``#X`` a tag that begins with X (``#J`` also
takes VBN), anything else a lemma. Lexicons and patterns are parameters: a user brings
their tables (see sources.readers.patterns); DEFAULT is a small set for English.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package

Token = dict
Phrase = tuple[str, ...]
#: Places of a sentence, in order, where an element of a pattern may fit; elements that are not in it fit nowhere.
Places = dict[str, list[int]]


@dataclass
class Tables:
    """Names to phrases (concepts, actions) and names to patterns (formulaic, agents)."""

    concepts: dict[str, list[Phrase]] = field(default_factory=dict)
    actions: dict[str, list[Phrase]] = field(default_factory=dict)
    formulaic: dict[str, list[Phrase]] = field(default_factory=dict)
    agents: dict[str, list[Phrase]] = field(default_factory=dict)

    @classmethod
    def of(cls, **tables: dict[str, str]) -> Tables:
        """From names to phrases separated by commas."""
        return cls(**{k: {n: [tuple(p.split()) for p in v.split(",")] for n, v in t.items()} for k, t in tables.items()})


DEFAULT = Tables.of(
    concepts={"SELF": "we, our, us, i, this paper, this work", "PROBLEM": "problem, difficulty, error, limitation, drawback", "WORK": "work, method, approach, system, model, algorithm", "CONTRAST_WORD": "however, but, unlike, whereas"},
    actions={"USE": "use, employ, apply, adopt", "PRESENT": "present, propose, introduce, describe", "IMPROVE": "improve, extend, outperform"},
    formulaic={"CONTRAST_FORMULAIC": "in contrast, unlike, however, on the other hand", "COMPARISON_FORMULAIC": "compare to, compare with, better than, similar to", "FUTURE_FORMULAIC": "in the future, future @WORK", "USING_FORMULAIC": "@USE CITATION, @USE the @WORK"},
    agents={"US_AGENT": "@SELF, the present @WORK", "THEM_AGENT": "CITATION, their @WORK", "PROBLEM_AGENT": "@PROBLEM"},
)


def in_lexicon(phrases: Sequence[Phrase], s: Sequence[Token], i: int, arg: str | None = None, pos: str | None = None) -> int:
    """M1: tokens that the first fitting phrase takes at place ``i``, or 0."""
    for p in phrases:
        part = s[i : i + len(p)]
        if len(part) == len(p) and all((t["lemma"] == x or t["word"] == x) and (pos is None or (t["pos"] or "")[:1] == pos) for t, x in zip(part, p, strict=True)):
            if arg is None or any(t.get("ArgType") == arg for t in part):
                return len(p)
    return 0


def anywhere(phrases: Sequence[Phrase], s: Sequence[Token]) -> bool:
    """M2."""
    return any(in_lexicon(phrases, s, i) for i in range(len(s)))


def _takes(tables: Tables, element: str, s: Sequence[Token], i: int) -> int:
    t = s[i]
    pos = t["pos"] or ""
    if element[0] == "@":
        name = element[1:]
        if name not in tables.concepts and name not in tables.actions:
            raise KeyError(f"no lexicon {name}")
        return in_lexicon(tables.concepts.get(name, ()), s, i) or in_lexicon(tables.actions.get(name, ()), s, i, pos="V")
    if element == "SELFCITATION":
        return int(t["word"] == element)
    if element == "CITATION":
        return int(t["word"].endswith(element))
    if element == "CREF":
        return int(t["word"] == "CREF" and pos == "CD")
    if element[0] == "#" and len(element) > 1:
        return int(pos[:1] == element[1] or (element[1] == "J" and pos == "VBN"))
    return int(t["lemma"] == element)


def find(tables: Tables, pattern: Phrase, s: Sequence[Token], subject: bool | None = None, places: Places | None = None) -> int:
    """M3: first place where the pattern fits, or -1. ``subject``: whether the span must have a subject, or must not. ``places``: see Starts."""
    for i in range(len(s) - len(pattern) + 1) if places is None else places.get(pattern[0], ()):
        if i + len(pattern) > len(s):
            break
        at = i
        for e in pattern:
            n = _takes(tables, e, s, at) if at < len(s) else 0
            if not n:
                break
            at += n
        else:
            if subject is None or any(t.get("ArgType") == "subj" for t in s[i:at]) == subject:
                return i
    return -1


def offset(at: int, size: int, cite: int) -> int:
    """Signed distance of a pattern from the citation; before it the pattern's length counts."""
    return at - cite if cite < at else at - size - cite


def lexicon_features(lexicons: dict[str, list[Phrase]], s: Sequence[Token], cite: int, pos: str | None = None, places: Places | None = None) -> dict[str, int]:
    """M4, M5: first place of each lexicon, relative to the citation."""
    out = {}
    for name, phrases in lexicons.items():
        at = next((i for i in (range(len(s)) if places is None else places.get(f"@{name}", ())) if in_lexicon(phrases, s, i, pos=pos)), None)
        if at is not None:
            out[name] = at - cite
    return out


def pattern_features(tables: Tables, s: Sequence[Token], cite: int, prefix: str = "", places: Places | None = None) -> dict[str, int]:
    """M6, M7: first fitting pattern of each name; agents as subjects, and apart from subjects with ``_AS_FORMULAIC``."""
    out = {}
    for group, subject, tail in ((tables.formulaic, None, ""), (tables.agents, False, "_AS_FORMULAIC"), (tables.agents, True, "")):
        for name, patterns in group.items():
            for p in patterns:
                at = find(tables, p, s, subject, places)
                if at >= 0:
                    out[f"{prefix}{name}{tail}"] = offset(at, len(p), cite)
                    break
    return out


def contrasts(tables: Tables, s: Sequence[Token], places: Places | None = None) -> bool:
    """M9: opens with ``in contrast``, or contrasts and speaks of the own work."""
    if len(s) < 2:
        return False
    if (s[0]["lemma"], s[1]["lemma"]) == ("in", "contrast"):
        return True
    marks = [*tables.formulaic.get("CONTRAST_FORMULAIC", ()), *tables.formulaic.get("CONTRAST2_FORMULAIC", ())]
    return any(find(tables, p, s, places=places) >= 0 for p in marks) and any(find(tables, p, s, places=places) >= 0 for p in tables.agents.get("US_AGENT", ()))


def compares(tables: Tables, s: Sequence[Token], places: Places | None = None) -> bool:
    """M10."""
    return any(find(tables, p, s, places=places) >= 0 for p in tables.formulaic.get("COMPARISON_FORMULAIC", ()))


def phrase_at(words: Sequence[str], phrase: Phrase) -> int:
    """Place of an exact run of words, or -1."""
    return next((i for i in range(len(words) - len(phrase) + 1) if tuple(words[i : i + len(phrase)]) == tuple(phrase)), -1)


def plain_tokens(text: Column) -> Column:
    """Tokens of a plain text, for tables without an annotator: the lemma is the lower-cased word, tags are empty."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"[A-Za-z]+|[0-9]+|[^\sA-Za-z0-9]"), F.lit(0)), lambda w: F.struct(w.alias("word"), F.lower(w).alias("lemma"), F.lit("").alias("pos"), F.lit(None).cast("string").alias("ArgType")))


class Coded(Sequence):
    """Tokens of one sentence, made from the codes of their columns when they are asked for."""

    def __init__(self, columns: dict[str, tuple[np.ndarray, list[str]]], start: int, end: int):
        self.columns = [(name, codes[start:end].tolist(), values) for name, (codes, values) in columns.items()]
        self.size = end - start

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, i):
        if isinstance(i, slice):
            return [self[k] for k in range(*i.indices(self.size))]
        return {name: values[codes[i]] for name, codes, values in self.columns}


class Starts:
    """Where elements and lexicons may fit, found once for each different word, lemma and tag of a batch.

    Only places are left out at which the first token rules out every phrase; what fits is
    decided by ``find`` and ``in_lexicon``. With an empty pattern or a lexicon that is not
    there, which these functions treat in their own way, nothing is left out (``usable``).
    """

    def __init__(self, tables: Tables, patterns: Sequence[Phrase] = ()):
        own = [p for group in (tables.formulaic, tables.agents) for ps in group.values() for p in ps]
        firsts = {p[0] if p else "" for p in (*own, *patterns)}
        names = {*tables.concepts, *tables.actions}
        self.usable = all(e and (e[0] != "@" or e[1:] in names) for e in firsts)
        self.either: dict[str, list[str]] = {}
        self.words: dict[str, list[str]] = {}
        self.lemmas: dict[str, list[str]] = {"in": ["in"]}  # contrasts
        self.tags: dict[str, list[str]] = {}
        self.ends = "CITATION" in firsts
        for name in names:
            for x in {p[0] for p in (*tables.concepts.get(name, ()), *tables.actions.get(name, ())) if p}:
                self.either.setdefault(x, []).append(f"@{name}")
        for e in firsts - {"CITATION", "in", ""}:
            if e[0] == "@":
                continue
            to, x = (self.words, e) if e in ("SELFCITATION", "CREF") else (self.tags, e[1]) if e[0] == "#" and len(e) > 1 else (self.lemmas, e)
            to.setdefault(x, []).append(e)

    def of_word(self, w: str | None) -> list[str]:
        return [*self.either.get(w, ()), *self.words.get(w, ()), *(["CITATION"] if self.ends and w and w.endswith("CITATION") else [])]

    def of_lemma(self, x: str | None) -> list[str]:
        return [*self.either.get(x, ()), *self.lemmas.get(x, ())]

    def of_tag(self, t: str | None) -> list[str]:
        t = t or ""
        return [*self.tags.get(t[:1], ()), *(self.tags.get("J", ()) if t == "VBN" else ())]

    def sentences(self, batch: pa.Array) -> Iterator[tuple[Sequence[Token], Places | None]]:
        """Each sentence of a list column with its places."""
        flat = batch.flatten()
        ends = np.cumsum(pc.fill_null(pc.list_value_length(batch), 0).to_numpy(zero_copy_only=False))
        parts = dict(zip((f.name for f in flat.type), flat.flatten(), strict=True))
        columns = {}
        for name in ("word", "lemma", "pos", "ArgType"):
            if name in parts:
                coded = pc.fill_null(parts[name].cast(pa.string()), "").dictionary_encode()
                columns[name] = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
        if not self.usable:
            for start, end in zip([0, *ends.tolist()], ends.tolist(), strict=False):
                yield Coded(columns, start, end), None
            return
        found = [(columns[name][0], [of(x) for x in columns[name][1]]) for name, of in (("word", self.of_word), ("lemma", self.of_lemma), ("pos", self.of_tag))]
        some = np.zeros(len(flat), bool)
        for codes, keys in found:
            if keys:
                some |= np.array([bool(k) for k in keys])[codes]
        at = np.flatnonzero(some)
        cuts = np.searchsorted(at, ends).tolist()
        at = at.tolist()
        start = low = 0
        for end, high in zip(ends.tolist(), cuts, strict=True):
            places: Places = {}
            for i in at[low:high]:
                for e in {e for codes, keys in found for e in keys[codes[i]]}:
                    places.setdefault(e, []).append(i - start)
            yield Coded(columns, start, end) if places else (), places
            start, low = end, high


def sentence_features(df: DataFrame, tables: Tables = DEFAULT, tokens: str = "tokens", cite: str = "cite_index") -> DataFrame:
    """``df`` with ``features``, a map of all pattern and lexicon features of each sentence around its citation.

    Tokens at which nothing may begin are told by their words, lemmas and tags a batch at a time.
    """
    ship_package(df.sparkSession)
    starts = Starts(tables)

    def one(s: Sequence[Token], c: int, at: Places | None) -> dict[str, int]:
        return {**pattern_features(tables, s, c, places=at), **lexicon_features(tables.concepts, s, c, places=at), **lexicon_features(tables.actions, s, c, "V", places=at), "contrast": int(contrasts(tables, s, at)), "compare": int(compares(tables, s, at))}

    @F.arrow_udf("map<string,int>")
    def run(sentences: pa.Array, cites: pa.Array) -> pa.Array:
        out = [list(one(s, int(c or 0), at).items()) for (s, at), c in zip(starts.sentences(sentences), cites.to_pylist(), strict=True)]
        return pa.array(out, pa.map_(pa.string(), pa.int32()))

    return df.withColumn("features", run(tokens, cite))

"""Text normalisation, similarity and form features, as Column expressions where Spark has the functions."""

from __future__ import annotations

import difflib
import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Sentence openers that connect discourse.
CONNECTORS = (
    "therefore", "however", "moreover", "in addition", "furthermore", "so", "also", "likewise", "accordingly", "hence", "consequent", "as a result", "therewise", "otherwise", "subsequently",
    "lastly", "next", "thus", "then", "wherefore", "similarly", "particular", "for instance", "special", "for example", "compare", "beside", "conclusion", "summar", "result", "analog",
)
# What stands before or after an example's citation.
EXAMPLE_ENDS = ("e.g.,", "e.g.", "for example", "for example,", "for instance", "for instance,", "see", "cf.", "cfXXX", "cf")
EXAMPLE_PARENS = ("(e.g.", "(cf.", "(cfXXX")
EXAMPLE_STARTS = (", for example,", ", for instance,")
# Entities outside HTML's own tables.
ENTITIES = {
    "&cacute;": "c", "&scedil;": "s", "&Scedil;": "S", "&Ccaron;": "C", "&ccaron;": "c", "&scaron;": "s", "&#scaron;": "s", "&ncaron;": "n", "&zcaron;": "z", "&slig;": "ss", "&nacute;": "n", "&Atilde;": "A", "&Sacute;": "S",
}


def clean_title(title: Column) -> Column:
    """lower case, trimmed, without ASCII punctuation."""
    return F.regexp_replace(F.lower(F.trim(title)), r"\p{Punct}", "")


def clean_reference(title: Column) -> Column:
    """cut stray endings, keep letters and digits with single blanks, drop a leading number."""
    for end in ("quot", " in", " corr"):
        title = F.when(title.endswith(end), F.left(title, F.length(title) - len(end))).otherwise(title)
    return F.regexp_replace(F.regexp_replace(title, "[^a-zA-Z0-9]+", " "), r"^[0-9\-]+[a-f]?", "")


@F.pandas_udf(T.StringType())
def fold(names: pd.Series) -> pd.Series:
    """entities and diacritics to ASCII; "Last, First" becomes "First Last"."""

    def one(x: str | None) -> str | None:
        if x is None:
            return None
        for k, v in ENTITIES.items():
            x = x.replace(k, v)
        x = unicodedata.normalize("NFKD", html.unescape(html.unescape(x))).encode("ascii", "ignore").decode()
        last, comma, first = x.partition(",")
        return f"{first.split(',')[0]} {last}".strip() if comma else x.strip()

    return names.map(one)


def author_key(name: Column) -> Column:
    """F4."""
    return F.translate(F.lower(name), " '~,\"\\`", "")


def prefix_share(a: Column, b: Column) -> tuple[Column, Column]:
    """length of the common prefix over each one's length, blanks removed; 0 where one is empty."""
    x, y = F.regexp_replace(a, " ", ""), F.regexp_replace(b, " ", "")
    shortest = F.least(F.length(x), F.length(y))
    common = F.size(F.filter(F.sequence(F.lit(1), F.greatest(shortest, F.lit(1))), lambda i: (i <= shortest) & (F.left(x, i) == F.left(y, i))))
    share = lambda t: F.when(shortest > 0, common / F.length(t)).otherwise(0.0)
    return share(x), share(y)


def real_quick_ratio(a: Column, b: Column) -> Column:
    """bound by lengths."""
    both = F.length(a) + F.length(b)
    return F.when(both > 0, 2.0 * F.least(F.length(a), F.length(b)) / both).otherwise(1.0)


def quick_ratio(a: Column, b: Column) -> Column:
    """bound by counts of characters."""
    common = F.aggregate(
        F.array_distinct(F.split(a, "")),
        F.lit(0),
        lambda n, c: n + F.when(c == "", 0).otherwise(F.least(F.length(a) - F.length(F.replace(a, c, F.lit(""))), F.length(b) - F.length(F.replace(b, c, F.lit(""))))),
    )
    both = F.length(a) + F.length(b)
    return F.when(both > 0, 2.0 * common / both).otherwise(1.0)


@F.pandas_udf(T.DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """share of matching blocks."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def _percent(x: str, y: str) -> int:
    return round(100 * difflib.SequenceMatcher(None, x, y).ratio())


@F.pandas_udf(T.IntegerType())
def fuzz_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """F8: whole percent."""
    return pd.Series([_percent(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="int32")


def _set_percent(x: str | None, y: str | None) -> int:
    """Best ratio among the shared words and each side's shared words with its own."""
    p, q = set((x or "").lower().split()), set((y or "").lower().split())
    both = " ".join(sorted(p & q))
    left, right = f"{both} {' '.join(sorted(p - q))}".strip(), f"{both} {' '.join(sorted(q - p))}".strip()
    pairs = [(left, right)] + ([(both, left), (both, right)] if both else [])
    return max(_percent(u, v) for u, v in pairs)


@F.pandas_udf(T.IntegerType())
def token_set_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """F8: see ``_set_percent``."""
    return pd.Series([_set_percent(x, y) for x, y in zip(a, b, strict=True)], dtype="int32")


def normalise_context(text: Column) -> Column:
    """protect ``cf.``, mark ``??``, join hyphenated words and lines."""
    text = F.replace(F.replace(text, F.lit("cf."), F.lit("cfXXX")), F.lit("??"), F.lit("XX"))
    return F.replace(F.replace(text, F.lit("- "), F.lit("")), F.lit("\n"), F.lit(" "))


def drop_footer(text: Column) -> Column:
    """F10."""
    return F.regexp_replace(text, r"[0-9]+ Computational Linguistics Volume [0-9]+, Number [0-9]+", "")


def plain_brackets(words: Column) -> Column:
    """bracket codes of the annotator to characters."""
    table = {"-LRB-": "(", "-RRB-": ")", "-LSB-": "[", "-RSB-": "]", "-LCB-": "{", "-RCB-": "}"}
    return F.transform(words, lambda w: F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), w), w))


def year_mentions(text: Column) -> Column:
    """four-digit runs."""
    return F.regexp_count(text, F.lit("[0-9][0-9][0-9][0-9]"))


def same_paren_years(text: Column, cite: Column) -> Column:
    """year mentions in the first parenthesis that has the citation; 0 without one."""
    hit = F.filter(F.regexp_extract_all(text, F.lit(r"\(.*?\)"), F.lit(0)), lambda p: p.contains(cite))
    return F.when(F.size(hit) > 0, year_mentions(F.element_at(hit, 1))).otherwise(0)


def cite_position(text: Column, cite: Column) -> Column:
    """share of the text before the citation; null where it is not in there."""
    at = F.position(cite, text)
    return F.when(at > 0, (at - 1) / F.length(text))


def before(text: Column, cite: Column) -> Column:
    """text before the first occurrence, trimmed, without an open parenthesis at its end."""
    return F.regexp_replace(F.trim(F.left(text, F.position(cite, text) - 1)), r"\s*\($", "")


def after(text: Column, cite: Column) -> Column:
    """text after the first occurrence, without a closing parenthesis at its start."""
    return F.regexp_replace(F.substring(text, F.position(cite, text) + F.length(cite), F.length(text)), r"^\s*\)", "")


def is_example(pre: Column, full_cite: Column, post: Column, in_parens: Column) -> Column:
    """F15."""
    ends, parens, starts = F.lit(False), F.lit(False), F.lit(False)
    for e in EXAMPLE_ENDS:
        ends = ends | pre.endswith(e)
    for e in EXAMPLE_PARENS:
        parens = parens | full_cite.startswith(e)
    for e in EXAMPLE_STARTS:
        starts = starts | post.startswith(e)
    return (ends | (in_parens & parens) | starts).cast("int")


def caps_before(pre: Column, kind: str) -> Column:
    """F16: whether one of up to three words before (stopping at one with , ) or ;) is in capitals, or begins with one."""
    words = F.split(F.trim(pre), r"\s+")
    tail = F.reverse(F.slice(words, F.greatest(F.size(words) - 2, F.lit(1)), F.lit(3)))
    upper = lambda w: (F.upper(w) == w) & (F.lower(w) != w)
    if kind == "all":
        hit = upper
    else:
        hit = lambda w: upper(F.left(w, F.lit(1))) & ~upper(w) & ~upper(F.substring(w, 2, 1000))
    start = F.struct(F.lit(0).alias("hit"), F.lit(False).alias("stop"))
    step = lambda s, w: F.struct(F.when(~s["stop"] & ~w.rlike("[,);]") & hit(w), 1).otherwise(s["hit"]).alias("hit"), (s["stop"] | w.rlike("[,);]")).alias("stop"))
    return F.aggregate(tail, start, step, lambda s: s["hit"])


def mask_citation(text: Column, cite: Column, own: Column) -> Column:
    """the citation becomes CITATION or SELFCITATION, parentheses with a year become CITANCE."""
    marked = F.replace(text, cite, F.when(own, F.lit("SELFCITATION")).otherwise(F.lit("CITATION")))
    return F.regexp_replace(marked, r"\([^()]*[0-9]{4}[a-f]?[^()]*\)", "CITANCE")


def is_self_citation(cite: Column, authors: Column) -> Column:
    """some author's words stand in the citing string, one after the other, as starts of its words."""
    words = F.split(F.lower(cite), " ")
    match = lambda name, i: F.forall(F.arrays_zip(F.split(F.lower(name), " ").alias("n"), F.slice(words, i, F.size(F.split(name, " "))).alias("w")), lambda z: F.coalesce(z["w"].startswith(z["n"]), F.lit(False)))
    return F.exists(authors, lambda a: F.exists(F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1))), lambda i: match(a, i)))


def connector_hit(sentence: Column, connector: str) -> Column:
    """whether the sentence opens with the connector."""
    return F.lower(sentence).startswith(connector)


def workshop_name(title: Column) -> Column:
    """what follows ``Workshop on``, without a year."""
    return F.regexp_replace(F.element_at(F.split(title, "Workshop on "), -1), " [0-9]{4}", "")


def scrub(text: Column) -> Column:
    """for topic models: ASCII only; years become blanks; brackets, commas and periods go; parts of et al. become blanks.

    The passes are one after the other, and a pass does not look again at what it has put.
    """
    text = F.regexp_replace(text, r"[^\x00-\x7F]", "")
    text = F.regexp_replace(text, " [0-9]{4} ", " ")
    text = F.regexp_replace(text, r"-lrb-|-rrb-|-lsb-|-rsb-|,|\.", "")
    return F.regexp_replace(text, " al. | al | et ", " ")


def indirect_name(text: Column) -> Column:
    """F27."""
    return F.trim(F.regexp_replace(text, "[0-9.,();]", ""))


def spaced_cite(text: Column) -> Column:
    """blanks around parentheses and before years."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"([()])", " $1 "), r"([^0-9 ])([0-9]{4})", "$1 $2"), " +", " "))


def odd_characters(text: Column) -> Column:
    """characters that are neither letters nor digits."""
    return F.regexp_count(text, F.lit("[^A-Za-z0-9]"))


def numbers_in(text: Column) -> Column:
    """F29."""
    return F.regexp_count(text, F.lit("[0-9]+"))


def without_rare(words: Column, dropped: Column) -> Column:
    """the words that are not dropped, or DUMMY where none is left."""
    kept = F.filter(words, lambda w: ~F.array_contains(dropped, w))
    return F.when(F.size(kept) == 0, F.array(F.lit("DUMMY"))).otherwise(kept)


def merge_maps(*maps: Column) -> Column:
    """the last one wins (needs spark.sql.mapKeyDedupPolicy=LAST_WIN)."""
    return F.map_concat(*maps)

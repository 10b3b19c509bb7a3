"""Classifiers of identifiers, titles and labels, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Section classes by the first group of substrings that a lower-cased title without blanks has.
SECTION_RULES = (
    ("InIntroduction", ("intro",)),
    ("InRelatedWork", ("related", "existing", "previous", "background")),
    ("InMotivation", ("motivation", "applications")),
    ("InMethology", ("method", "implementation", "approach", "model", "system", "algorithm")),
    ("InEvaluation", ("evalu", "experiment", "task", "data", "setup", "corpus", "problem")),
    ("InResults", ("results", "analysis")),
    ("InDiscussion", ("discussion",)),
    ("InConclusion", ("conclusion", "conclud")),
    ("InAcknowledgements", ("acknowl",)),
)

# Function codes of the second corpus.
FUNCTION_CODES = {
    "Weak": "CompareOrContrast", "CoCoGM": "CompareOrContrast", "CoCo-": "CompareOrContrast", "CoCoR0": "CompareOrContrast", "PSim": "CompareOrContrast", "PSup": "CompareOrContrast",
    "CoMetN": "CompareOrContrast", "CoGoaN": "CompareOrContrast", "CoMet-": "CompareOrContrast", "CoCoN": "CompareOrContrast", "CoCoM": "CompareOrContrast", "CoResN": "CompareOrContrast",
    "CoCoXY": "Background", "Neut": "Background", "PBas": "Extends", "PModi": "Extends", "PUse": "Uses", "PMot": "Motivation",
}

# Final classes, and those that are positional.
CLASSES = ("Background", "Uses", "CompareOrContrast", "Motivation", "Extends", "Future")
POSITIONAL = ("Background", "Motivation", "Future", "CoCo")

# First letters of paper ids and their venues; W is a workshop.
VENUES = {"C": "COLING", "P": "ACL", "N": "NAACL", "J": "Comp. Ling.", "Q": "TACL", "K": "CoNLL", "E": "EACL", "A": "ANLP", "L": "LREC", "I": "IJCNLP", "S": "SemEval"}


def _lookup(key: Column, table: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)


def year_from_id(paper_id: Column) -> Column:
    """Year from the second and third character of an id; below 50 means after 2000. Null where these are no digits."""
    two = F.when(is_paper_id(paper_id), F.substring(paper_id, 2, 2).cast("int"))
    return F.when(two < 50, two + 2000).otherwise(two + 1900)


def is_paper_id(paper_id: Column) -> Column:
    """P3."""
    return paper_id.rlike("^.[0-9]{2}")


def paper_key(paper_id: Column) -> Column:
    """The first eight characters; ids of external papers stay whole, as cutting would merge them."""
    return F.when(paper_id.contains("External"), paper_id).otherwise(F.substring(paper_id, 1, 8))


def is_external(paper_id: Column) -> Column:
    """P15."""
    return paper_id.contains("xternal")


def section_class(title: Column) -> Column:
    """Class of a section title, null where no rule fits. Rules are tried in order."""
    t = F.regexp_replace(F.lower(title), " ", "")
    out = F.when(t == "abstract", "InAbstract")
    for name, parts in SECTION_RULES:
        hit = t.contains(parts[0])
        for p in parts[1:]:
            hit = hit | t.contains(p)
        out = out.when(hit, name)
    return out.when(t.startswith("reference") | t.contains("bibliography"), "InReferences")


def section_of(sub_title: Column, title: Column) -> Column:
    """The subsection's class, else the section's, else OtherSection."""
    return F.coalesce(section_class(sub_title), section_class(title), F.lit("OtherSection"))


def section_from_flags(flags: dict[str, Column], default: str = "Other_Section") -> Column:
    """P10: name of the first flag column that is 1."""
    out = None
    for name, flag in flags.items():
        out = F.when(flag == 1, name) if out is None else out.when(flag == 1, name)
    return F.lit(default) if out is None else out.otherwise(default)


def canonical_label(label: Column) -> Column:
    """P5: Reference is Background; otherwise what stands before a dash, with Prior as Extends and Co... as CompareOrContrast. Unknown gives null."""
    head = F.split_part(label, F.lit("-"), F.lit(1))
    return F.when(label == "Reference", "Background").when(head == "Unknown", None).when(head == "Prior", "Extends").when(head.startswith("Co"), "CompareOrContrast").otherwise(head)


def function_of_code(code: Column) -> Column:
    """Class of a code of the second corpus; unknown codes compare or contrast."""
    return F.coalesce(_lookup(code, FUNCTION_CODES), F.lit("CompareOrContrast"))


def role_type(role: Column) -> Column:
    """P7."""
    return F.when(role.isin(*POSITIONAL), "Positional").otherwise("Essential")


def perfunctory_type(flag: Column) -> Column:
    """Flag is whatever a left join with the perfunctory marks gave."""
    return F.when(flag.isNotNull(), "Positional").otherwise("Essential")


def venue_kind(paper_id: Column) -> Column:
    """P12."""
    first = F.substring(paper_id, 1, 1)
    return F.when(first.isin("J", "Q"), "Journal").when(first.isin("S", "W"), "Workshop").otherwise("Conference")


def venue(paper_id: Column, workshop: Column | None = None, year: Column | None = None) -> Column:
    """Venue by first letter; the EMNLP workshops count as workshops before 2008."""
    first = F.substring(paper_id, 1, 1)
    out = F.when(first != "W", F.coalesce(_lookup(first, VENUES), F.lit("Other")))
    if workshop is not None and year is not None:
        out = out.when((workshop == "EMNLP") & (year >= 2008), "EMNLP")
    return out.otherwise("Workshop")


def reference_kind(text: Column) -> Column:
    r"""Kind of venue of a raw reference: Workshop, Proceedings or Proc., Journal, ``(n) n``, in that order."""
    return (
        F.when(text.contains("Workshop"), "WorkshopRef").when(text.contains("Proceedings") | text.contains("Proc."), "ConferenceRef")
        .when(text.contains("Journal") | text.rlike(r"\([0-9]+\)[0-9]"), "JournalRef").otherwise("UnknownRefType")
    )

"""Text functions: task tokens, lines, signatures, fingerprints and token estimates, as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

IDENTIFIER = "[A-Za-z_][A-Za-z0-9_]{1,63}"

# Words that carry no meaning in a task.
STOP_WORDS = ["fix", "issue", "problem", "bug", "the", "and", "for", "with", "that", "this", "from", "into", "make"]


def task_tokens(text: str | Column) -> Column:
    """Lower-case identifiers of a text, each once in order of first use, without stop words."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(IDENTIFIER), F.lit(0))
    return F.array_except(F.array_distinct(found), F.array(*[F.lit(w) for w in STOP_WORDS]))


def py_task_tokens(text: str) -> list[str]:
    """The same for a text on the driver."""
    return [w for w in dict.fromkeys(re.findall(IDENTIFIER, text.lower())) if w not in STOP_WORDS]


def lines(text: str | Column) -> Column:
    """Lines of a text, without an empty one after a final line break."""
    parts = F.split(text, "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)


def token_hits(text: str | Column, tokens: list[str]) -> Column:
    """How many of the tokens the text contains, anywhere and in any case."""
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit(0)
    for t in tokens:
        out = out + F.contains(low, F.lit(t)).cast("int")
    return out.cast("long")


def normalized_hits(hits: Column, n_tokens: int | Column, scale: float = 1.0) -> Column:
    """Hits per token, at most 1."""
    return F.least(F.lit(1.0), hits / (F.greatest(F.lit(1), F.lit(n_tokens) if isinstance(n_tokens, int) else n_tokens) * max(0.2, scale)))


def collapsed(text: str | Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def fingerprint(text: str | Column) -> Column:
    """SHA-1 of the lower-case text with blanks collapsed."""
    return F.sha1(collapsed(text))


def structural_signature(text: str | Column) -> Column:
    """The text's shape: identifiers become ``id``, then digits ``num``."""
    shape = F.regexp_replace(F.lower(text), "[A-Za-z_][A-Za-z0-9_]*", "id")
    return F.trim(F.regexp_replace(F.regexp_replace(shape, "[0-9]+", "num"), r"\s+", " "))


def semantic_tokens(text: str | Column, most: int | None = 400) -> Column:
    """Set of the first identifiers of a text, of all with ``most`` None."""
    found = F.regexp_extract_all(F.lower(text), F.lit(IDENTIFIER), F.lit(0))
    return F.array_distinct(found if most is None else F.slice(found, 1, most))


def jaccard(a: str | Column, b: str | Column, both_empty: float = 0.0) -> Column:
    """Jaccard similarity of two arrays as sets; with an empty side 0, with two ``both_empty``."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(both_empty)).otherwise(F.size(F.array_intersect(a, b)) / union)


def token_estimate(chars: Column, calibration: float = 1.0) -> Column:
    """Tokens of a text by its characters, four to a token."""
    return F.greatest(F.lit(1), F.bround(F.ceil(chars / 4.0) * F.lit(calibration)).cast("long"))


def reduction_ratio(context: Column, base: Column) -> Column:
    """Share of tokens saved; may be negative."""
    return F.when(base <= 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), 1 - context / base))

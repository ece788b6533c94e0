"""Text functions as column expressions.

White space is Unicode's plus U+001C to U+001F; patterns carry the flags they need.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\x1c-\x1f]"

# Lines of converted documents that carry no content, matched on the stripped line.
BOILERPLATE = [
    r"(?iU)^firefox\s*$",
    r"(?U)^\d{1,2}/\d{1,2}/\d{2,4},\s*\d{1,2}:\d{2}\s*$",
    r"(?U)^\d+\s+of\s+\d+\s*$",
    r"(?iU)^(https?://)?(www\.)?[a-zA-Z0-9.-]*gutenberg\.org\S*\s*$",
]

# Fixed value: white space that ends a sentence, but not after these abbreviations or an initial.
SENTENCE_END = r"(?<!\bMr\.)(?<!\bMrs\.)(?<!\bDr\.)(?<!\bSt\.)(?<!\bJr\.)(?<!\bSr\.)(?<!\s[A-Z]\.)(?<!^[A-Z]\.)(?<=[.!?])\s+"

# What marks shortened texts.
CONTEXT_SUFFIX = "\n...[truncated; call read_chunk for full text]"
DISPLAY_SUFFIX = "\n... (truncated for readability)"


def trim_ws(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U)^{SPACE}+|{SPACE}+\z", "")


def words(text: Column) -> Column:
    """The runs of characters between white space."""
    return F.filter(F.split(text, rf"(?U){SPACE}+", -1), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def title_case(text: Column) -> Column:
    """Upper case for the first letter of every run of letters, lower case for the others."""
    parts = F.regexp_extract_all(text, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, 1 << 30)))), "")


def title_of_path(path: Column) -> Column:
    """The file name without any ``.pdf``, in title case."""
    return title_case(F.replace(F.regexp_extract(path, r"([^/]*)$", 1), F.lit(".pdf"), F.lit("")))


def clean_lines(text: Column) -> Column:
    """The text without boilerplate lines; blank lines become empty, others stay as they are."""

    def dull(line: Column) -> Column:
        bare = trim_ws(line)
        found = F.lit(False)
        for pattern in BOILERPLATE:
            found = found | bare.rlike(pattern)
        return found

    kept = F.filter(F.split(text, "\n", -1), lambda x: ~dull(x))
    return F.array_join(F.transform(kept, lambda x: F.when(trim_ws(x) == "", "").otherwise(x)), "\n")


def sentences(text: Column) -> Column:
    """The array of a text's sentences, stripped, without empty ones."""
    return F.filter(F.transform(F.split(trim_ws(text), "(?U)" + SENTENCE_END, -1), trim_ws), lambda s: s != "")


def strip_context(text: Column) -> Column:
    """The content of a rendered chunk, without its heading path."""
    mark = "\nContent:"
    at = F.locate(mark, text)
    body = trim_ws(F.substr(text, at + len(mark)))
    return F.when(text.startswith("Context: ") & (at > 0), body).otherwise(text)


def clip(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def shorten(text: Column, n: int, suffix: str = CONTEXT_SUFFIX) -> Column:
    return F.when(F.char_length(text) <= n, text).otherwise(F.concat(F.substring(text, 1, n), F.lit(suffix)))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def similarity_band(similarity: Column) -> Column:
    return F.when(similarity > 0.5, "green").when(similarity > 0.3, "yellow").otherwise("red")


def percent(value: Column, digits: int = 2) -> Column:
    """For display only: rounds half up; null stays null."""
    return F.when(value.isNotNull(), F.format_string(f"%.{digits}f%%", value.cast("double") * 100))


def is_hit(title: Column, text: Column, wanted_title: Column, substrings: Column) -> Column:
    """Whether a chunk is of the wanted document and holds one of the substrings, in any case."""
    low = F.lower(text)
    return title.startswith(wanted_title) & F.exists(substrings, lambda s: F.contains(low, F.lower(s)))


def citations(answer: Column) -> Column:
    """The sorted distinct chunk ids that an answer cites."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(answer, F.lit("chk_[0-9a-f]{6,}"), F.lit(0))))


def chunk_id(file_id: Column, index: Column) -> Column:
    """A deterministic id in the form that citations have."""
    return F.concat(F.lit("chk_"), F.substring(F.sha2(F.concat_ws(":", file_id, index.cast("string")), 256), 1, 16))

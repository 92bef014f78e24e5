"""Text columns: white space, identifiers, titles, headings, sentence continuation, words. All are built-in expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a numbered heading, a sentence end and a continuation look like.
NUMBERED_HEADING = r"^(\d+(\.\d+)*|[IVXLC]+|[A-Z])[.)]?\s+\S"
SENTENCE_END = r"""[.!?]["')\]]*$"""
CONTINUATION_START = r"^[a-z,;:)\]\-]"
WORD = r"[A-Za-z0-9][A-Za-z0-9'-]*"


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value worked out once however often then uses it: an element of an array is not put in its place by the optimizer."""
    return F.get(F.transform(F.array(value), then), 0)


def collapse(text: Column) -> Column:
    """Runs of Unicode white space become one space, trimmed. Single spaces are no match, so most texts are not built anew."""
    return F.trim(F.regexp_replace(text, r"(?U) \s+|[\s&&[^ ]]\s*", " "))


def join_lines(lines: Column) -> Column:
    """Non-empty lines joined by spaces; a hyphen before a lower-case line start is taken out."""
    kept = F.filter(F.transform(lines, collapse), lambda x: x != "")
    return F.translate(F.regexp_replace(F.array_join(kept, "\n"), r"-\n(?=\p{Ll})", ""), "\n", " ")


def continues(previous: Column, following: Column) -> Column:
    """Whether a sentence goes on from one text to the next; false if either is blank."""
    before, after = F.trim(F.coalesce(previous, F.lit(""))), F.trim(F.coalesce(following, F.lit("")))
    return (
        F.when((before == "") | (after == ""), False)
        .when(before.rlike("-$"), True)
        .when(before.rlike(SENTENCE_END), False)
        .otherwise(after.rlike(CONTINUATION_START))
    )


def sentence_end(text: Column) -> Column:
    """What a text's end says of its sentence: 2 a hyphen, 1 open, 0 ended or blank."""
    trimmed = F.trim(F.coalesce(text, F.lit("")))
    return F.when(trimmed == "", 0).when(trimmed.rlike("-$"), 2).when(trimmed.rlike(SENTENCE_END), 0).otherwise(1)


def sentence_start(text: Column) -> Column:
    """What a text's start says of its sentence: 2 it goes on, 1 it may begin one, 0 blank."""
    trimmed = F.trim(F.coalesce(text, F.lit("")))
    return F.when(trimmed == "", 0).when(trimmed.rlike(CONTINUATION_START), 2).otherwise(1)


def goes_on(end: Column, start: Column) -> Column:
    """What continues() tells of two texts, from the end of one and the start of the other: over a hyphen to any text, else to one that goes on."""
    return ((end == 2) & (start > 0)) | ((end == 1) & (start == 2))


def numbered(text: Column) -> Column:
    """Whether a text begins like a numbered heading; a lone capital counts."""
    return F.trim(text).rlike(NUMBERED_HEADING)


def numbered_depth(text: Column) -> Column:
    """Depth of the number, null if there is none."""
    return once(F.regexp_extract(F.trim(text), NUMBERED_HEADING, 1), lambda prefix: F.when(prefix != "", F.length(prefix) - F.length(F.replace(prefix, F.lit("."), F.lit(""))) + 1))


def heading_like(text: Column) -> Column:
    """Not empty, at most 140 characters and 14 words, no final full stop, question or exclamation mark."""
    return once(collapse(text), lambda compact: (compact != "") & (F.length(compact) <= 140) & (F.size(F.split(compact, " ")) <= 14) & ~compact.rlike(r"[.?!]$"))


def heading_chunk(text: Column, semantic_type: Column, is_bold: Column, font_size: Column, body: Column) -> Column:
    strong = F.coalesce(is_bold, F.lit(False)) | (F.coalesce(font_size, F.lit(0.0)) >= body * 1.12)
    return F.coalesce(semantic_type == "heading", F.lit(False)) | numbered(text) | (heading_like(text) & strong)


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), 0))


def target_words(words: Column, ratio: float | Column) -> Column:
    """Words a summary should have: the share of the text's, at least 8."""
    share = ratio if isinstance(ratio, Column) else F.lit(float(ratio))
    return F.greatest(F.lit(8), F.ceil(words.cast("double") * share).cast("int"))


def short_title(text: Column, limit: int = 56) -> Column:
    return once(collapse(text), lambda compact: F.when(F.length(compact) <= limit, compact).otherwise(F.concat(F.rtrim(F.substring(compact, 1, limit - 3)), F.lit("..."))))


def preview(text: Column, limit: int) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 1), F.lit("..."))).otherwise(text)


def to_int(value: Column) -> Column:
    """A text as a whole number, null if it is none."""
    return F.when(F.trim(value).rlike(r"^[+-]?[0-9]+$"), F.trim(value).try_cast("int"))


def to_double(value: Column) -> Column:
    """A text as a number, null if it is none."""
    return F.when(F.trim(value).rlike(r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"), F.trim(value).try_cast("double"))


def stem(path: Column) -> Column:
    """A file's name without folders and its last ending."""
    return F.regexp_replace(F.regexp_extract(path, "([^/]*)/*$", 1), r"(?<=.)\.[^.]*$", "")


def artifact_name(value: Column) -> Column:
    safe = F.regexp_replace(value, r"[^A-Za-z0-9_.-]+", "-")
    return F.coalesce(F.nullif(F.regexp_replace(safe, r"^[.-]+|[.-]+$", ""), F.lit("")), F.lit("default"))


def block_id(value: Column, fallback: Column) -> Column:
    safe = F.regexp_replace(F.regexp_replace(value, r"[^\p{L}\p{N}_-]", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(safe, F.lit("")), fallback)


def path_segment(value: Column, limit: int = 96) -> Column:
    """A value as one part of a path: runs of other characters than letters, digits, `_`, `.` and `-` become one `-`; `unknown` if it is empty."""
    safe = F.regexp_replace(F.coalesce(F.nullif(value, F.lit("")), F.lit("unknown")), r"[^A-Za-z0-9_.-]+", "-")
    return F.left(safe, F.lit(limit))


def kind_label(kind: Column) -> Column:
    return F.initcap(F.lower(F.replace(kind, F.lit("_"), F.lit(" "))))


def elapsed(seconds: Column) -> Column:
    """m:ss of whole seconds."""
    return F.format_string("%d:%02d", F.floor(seconds / 60), F.pmod(seconds.cast("long"), F.lit(60)))


def percent(part: Column, total: Column) -> Column:
    return F.when(total > 0, F.round(100.0 * part / total).cast("int")).otherwise(0)


def clean_keywords(items: Column, limit: int | Column) -> Column:
    """Collapsed, stripped of ` .,:;`, without blanks, the first spelling of each kept, cut to the limit."""
    tidy = F.filter(F.transform(items, lambda k: F.btrim(collapse(k), F.lit(" .,:;"))), lambda k: k != "")

    def add(seen: Column, item: Column) -> Column:
        known = F.exists(seen, lambda s: F.lower(s) == F.lower(item))
        return F.when((F.size(seen) >= limit) | known, seen).otherwise(F.concat(seen, F.array(item)))

    return F.slice(F.aggregate(F.coalesce(tidy, F.array().cast("array<string>")), F.array().cast("array<string>"), add), 1, limit)


def cap_summary(text: Column, target: Column) -> Column:
    """Cut at the larger of target + 8 and 1.35 x target words, with `...`."""
    limit = F.greatest(target + 8, F.ceil(target.cast("double") * 1.35).cast("int"))

    def capped(s: Column) -> Column:
        cut = F.concat(F.rtrim(F.array_join(F.slice(s["words"], 1, limit), " "), F.lit(" ,;:")), F.lit("..."))
        return F.when(F.size(s["words"]) > limit, cut).otherwise(s["text"])

    return once(collapse(text), lambda compact: once(F.struct(compact.alias("text"), F.split(compact, " ").alias("words")), capped))


def alignment_tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0))


def lead_sentence(text: Column, limit: int = 120) -> Column:
    """The first sentence; a longer one is cut at the limit without its last partial word."""
    def lead(compact: Column) -> Column:
        return F.coalesce(F.nullif(F.regexp_extract(compact, r"^(.*?[.!?])\s", 1), F.lit("")), compact)

    def shown(first: Column) -> Column:
        cut = F.regexp_replace(F.substring(first, 1, limit), r"\s+\S*$", "")
        return F.when(first == "", "summary pending").when(F.length(first) <= limit, first).otherwise(F.concat(F.rtrim(cut, F.lit(" .,:;")), F.lit("...")))

    # arrays of one element keep each step from being worked out twice
    return F.get(F.transform(F.transform(F.array(collapse(F.coalesce(text, F.lit("")))), lead), shown), 0)

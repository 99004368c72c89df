"""Text expressions: answer normalisation, line parsing, rendering. Columns in, columns out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of a question that turn on the reverse containment check. Fixed values.
DOUBLE_CHECK_WORDS = ("when", "what year", "which year", "where", "sport", "what countr", "language", "nba finals", "world series")
#: Forms of an answer line that say there is none. Fixed values.
NOT_AVAILABLE = ("ans: not available", "ans: no information available")
#: Signs of explanations in an answer. Fixed values.
VERBOSE_MARKS = ("because", "therefore", "triples:", "reasoning", "analysis:")
PUNCTUATION = r"[!-/:-@\[-`{-~]"
#: White space and word characters as Python has them in texts of any language; those of Java's \s and \b differ.
SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
WORD = r"[\p{L}\p{N}_]"


def normalize(text: Column) -> Column:
    """Lower case, no ASCII punctuation, no articles, single blanks."""
    out = F.regexp_replace(F.lower(text), PUNCTUATION, "")
    out = F.regexp_replace(out, rf"(?<!{WORD})(a|an|the)(?!{WORD})", " ")
    return F.trim(F.regexp_replace(out, rf"{SPACE}+", " "))


def strip(text: Column) -> Column:
    """Trims all white space, not only blanks."""
    return F.regexp_replace(text, rf"\A{SPACE}+|{SPACE}+\z", "")


def safe_text(text: Column) -> Column:
    return F.coalesce(strip(text.cast("string")), F.lit(""))


def ensure_list(values: Column) -> Column:
    """Trimmed entries, empty and null ones dropped; order and repeats kept."""
    return F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), safe_text), lambda x: x != "")


def first_nonempty(*lists: Column) -> Column:
    """The first list with an entry; an empty list falls through like a null."""
    out = F.array().cast("array<string>")
    for c in reversed(lists):
        out = F.when(F.size(F.coalesce(c, F.array().cast("array<string>"))) > 0, c).otherwise(out)
    return out


def contains_normalized(prediction: Column, answer: Column) -> Column:
    """The normalised answer is part of the normalised prediction; an empty answer is part of anything."""
    return F.contains(normalize(prediction), normalize(answer))


def answer_lines(prediction: Column) -> Column:
    """Distinct lines with ``ans:`` that are not ``none`` and not one of the not-available forms, in order."""
    low = F.lower

    def wanted(line: Column) -> Column:
        keep = F.contains(line, F.lit("ans:")) & ~F.contains(low(line), F.lit("none"))
        for form in NOT_AVAILABLE:
            keep = keep & ~F.contains(low(line), F.lit(form))
        return keep

    return F.array_distinct(F.filter(F.split(F.coalesce(prediction, F.lit("")), "\n"), wanted))


def after_marker(line: Column) -> Column:
    """What follows the last ``ans:``."""
    return strip(F.element_at(F.split(line, "ans:"), -1))


def needs_double_check(question: Column) -> Column:
    return F.lower(F.coalesce(question, F.lit(""))).rlike("|".join(DOUBLE_CHECK_WORDS))


def no_answer(prediction: Column, any_case: bool = True) -> Column:
    """No parsed line, no ``ans:`` (in any case, or as written), or a not-available form."""
    text = F.coalesce(prediction, F.lit(""))
    out = (F.size(answer_lines(text)) == 0) | ~F.contains(F.lower(text) if any_case else text, F.lit("ans:"))
    for form in NOT_AVAILABLE:
        out = out | F.contains(F.lower(text), F.lit(form))
    return out


def date_to_year(text: Column) -> Column:
    year = F.regexp_extract(text, r"^(\d+)-", 1)
    return F.when(year != "", year).otherwise(text)


def order_answers(answers: Column, question: Column) -> Column:
    """Distinct answers, longest first and stable; dates become years where the question asks when."""
    distinct = F.array_distinct(answers)
    keyed = F.transform(distinct, lambda x, i: F.struct((-F.length(x)).alias("n"), i.alias("i"), x.alias("x")))
    ordered = F.transform(F.array_sort(keyed), lambda s: s["x"])
    asks = F.lower(F.coalesce(question, F.lit(""))).rlike("when|what year")
    return F.when(asks, F.transform(ordered, date_to_year)).otherwise(ordered)


def unique_trimmed(values: Column) -> Column:
    return F.array_distinct(ensure_list(values))


def strip_tagged(text: Column, tag: str = "think") -> Column:
    """Removes tagged blocks, over lines."""
    return strip(F.regexp_replace(F.coalesce(text, F.lit("")), rf"(?s)<{tag}>.*?</{tag}>", ""))


def reasoning_triples(text: Column, begin: str, end: str) -> Column:
    """Triples of a path ``a -> r -> b -> r -> c`` between two markers: windows of three, every second item."""
    body = F.element_at(F.split(F.element_at(F.split(text, begin), 2), end), 1)
    paths = F.filter(F.split(body, "\n"), lambda p: strip(p) != "")

    def windows(path: Column) -> Column:
        items = F.split(strip(path), " -> ")
        starts = F.when(F.size(items) >= 3, F.sequence(F.lit(1), F.size(items) - 2, F.lit(2))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.struct(F.get(items, i - 1).alias("head"), F.get(items, i).alias("relation"), F.get(items, i + 1).alias("tail")))

    return F.flatten(F.transform(paths, windows))


def format_reward(text: Column, lines: Column) -> Column:
    """0 for an empty or wrapped answer, .2 for explanations, 1 for one line, .8 up to five, else .4."""
    full = F.size(F.filter(lines, lambda x: strip(x) != ""))
    verbose = F.lit(False)
    for mark in VERBOSE_MARKS:
        verbose = verbose | F.contains(F.lower(text), F.lit(mark))
    return (
        F.when(safe_text(text) == "", 0.0)
        .when(F.contains(text, F.lit("<think>")) | F.contains(text, F.lit("```")), 0.0)
        .when(verbose, 0.2)
        .when(full == 1, 1.0)
        .when(full <= 5, 0.8)
        .otherwise(0.4)
    )


def question_mark(text: Column) -> Column:
    return F.when(F.endswith(text, F.lit("?")), text).otherwise(F.concat(text, F.lit("?")))


def indexed_text(idx: Column, head: Column, relation: Column, tail: Column) -> Column:
    return F.concat_ws("|", idx.cast("string"), head, relation, tail)


def triple_text(head: Column, relation: Column, tail: Column, separator: str = ", ") -> Column:
    return F.concat(F.lit("("), F.concat_ws(separator, head, relation, tail), F.lit(")"))


def render_answers(answers: Column) -> Column:
    return F.array_join(F.transform(answers, lambda a: F.concat(F.lit("ans: "), a)), "\n")


def prefer_original(original: Column, canonical: Column) -> Column:
    return first_nonempty(ensure_list(original), ensure_list(canonical))


def in_subgraph(line: Column, entities: Column) -> Column:
    """An entity is part of the line, or the line's answer part of an entity; lower case only."""
    answer, low = strip(F.element_at(F.split(F.lower(line), "ans:"), -1)), F.lower(line)
    return F.exists(entities, lambda e: F.contains(F.lower(e), answer) | F.contains(low, F.lower(e)))

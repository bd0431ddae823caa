"""Documents as sentences and paragraphs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import lemmas, sentences, strip


def is_boundary(sentence: Column) -> Column:
    """A heading or a blank line."""
    return F.startswith(sentence, F.lit("=")) | (strip(sentence, "\n ") == "")


def document_sentences(parts: Column) -> Column:
    return F.filter(parts, lambda s: ~is_boundary(s))


def paragraphs(lines: Column | str, *, closed_only: bool = False) -> Column:
    """array<array<string>>: what stands between headings and blank lines of an array of lines, within its row.

    closed_only leaves out a last paragraph that no boundary ends.
    """
    lines = F.col(lines) if isinstance(lines, str) else lines

    def cut_at(own: Column) -> Column:
        at = F.filter(F.transform(own, lambda s, i: F.when(is_boundary(s), i)), lambda i: i.isNotNull())
        ends = at if closed_only else F.array_append(at, F.size(own))
        return F.zip_with(F.slice(F.concat(F.array(F.lit(-1)), at), F.lit(1), F.size(ends)), ends, lambda a, b: F.slice(own, a + 2, b - a - 1))

    return F.filter(F.element_at(F.transform(F.array(lines), cut_at), 1), lambda p: F.size(p) > 0)


def sentence_objects(parts: Column) -> Column:
    """array<struct(raw, lemmas)>"""
    return F.transform(parts, lambda s: F.struct(s.alias("raw"), lemmas(s).alias("lemmas")))


def document(text: Column | str, split: Callable[[Column | str], Column] = sentences) -> Column:
    """struct(raw_text, text_lang, sentences). split: any function of a text column to an array of sentences.

    The language isn't looked at: it is always 'de', as long as no detector is given.
    """
    return F.struct((F.col(text) if isinstance(text, str) else text).alias("raw_text"), F.lit("de").alias("text_lang"), sentence_objects(document_sentences(split(text))).alias("sentences"))

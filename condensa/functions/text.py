"""Text as columns: lengths, tokens, sentences and what loaders do to strings. It runs in the JVM, but for given lemmatizers and counts of signs."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Runs of letters and digits, or one sign of its own; white space separates.
TOKEN = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"
WORD = r"[\p{L}\p{N}]+"
SENTENCE = r"[^.!?]+[.!?]*"
ENDINGS = (":", ".", "?", "!", '"', "'")
LANGUAGES = ("en", "de")
LENGTH_METRICS = ("char", "whitespace", "token")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(text: Column | str) -> Column:
    return F.regexp_extract_all(_col(text), F.lit(TOKEN), F.lit(0))


def index_tokens(text: Column | str) -> Column:
    """Without signs."""
    return F.regexp_extract_all(_col(text), F.lit(WORD), F.lit(0))


def lemmas(text: Column | str, lemmatizer: Callable[[list[str]], list[str]] | None = None) -> Column:
    """Lemmas of the tokens by a function of a list of tokens to as many lemmas; lower-cased tokens stand in where none is given."""
    if lemmatizer is None:
        return F.transform(tokens(text), F.lower)

    @F.arrow_udf("array<string>")
    def run(parts: pa.Array) -> pa.Array:
        return pa.array([None if p is None else list(lemmatizer(p)) for p in parts.to_pylist()], pa.list_(pa.string()))

    return run(tokens(text))


def dictionary_lemmas(entries: dict[str, str]) -> Callable[[list[str]], list[str]]:
    """A lemmatizer by a dictionary of forms, which goes to every worker; other words are lower-cased."""
    return lambda parts: [entries.get(p, p.lower()) for p in parts]


def sign_counts(texts: DataFrame, text: str = "text") -> DataFrame:
    """(ch, n) for every sign of all texts. A batch is counted where it is: a few distinct signs of each are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: Counter = Counter()
            for t in batch.column(0):
                total.update(t.as_py() or "")
            if total:
                yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array(list(total.values()), pa.int64())], ["ch", "n"])

    return texts.select(text).mapInArrow(run, "ch string, n long").groupBy("ch").agg(F.sum("n").alias("n"))


def length_of(text: Column | str, metric: str = "char") -> Column:
    """Code points, parts between single blanks ('' has one), or tokens."""
    text = _col(text)
    if metric == "char":
        return F.length(text)
    if metric == "whitespace":
        return F.size(F.split(text, " ", -1))
    if metric == "token":
        return F.size(tokens(text))
    raise ValueError(f"length metric must be one of {LENGTH_METRICS}")


def strip(text: Column | str, signs: str = "\n\t ") -> Column:
    return F.btrim(_col(text), F.lit(signs))


def non_blank(parts: Column, signs: str = "\n\t ") -> Column:
    return F.filter(F.transform(parts, lambda x: strip(x, signs)), lambda x: x != "")


def sentences(text: Column | str) -> Column:
    return non_blank(F.regexp_extract_all(_col(text), F.lit(SENTENCE), F.lit(0)))


def first_sentence(text: Column | str) -> Column:
    """The first of sentences(text), '' if there is none, without looking at the rest."""
    return strip(F.regexp_extract(_col(text), r"[^.!?]+[.!?]+|[^.!?]*[^.!?\n\t ][^.!?]*", 0))


def lacks_ending(sentence: Column | str) -> Column:
    sentence = _col(sentence)
    return ~reduce(lambda a, b: a | b, (F.endswith(sentence, F.lit(e)) for e in ENDINGS))


def ends_in_digit_period(sentence: Column | str) -> Column:
    """Like a year or an ordinal at a sentence's end; \\z, since $ also matches before a last line break."""
    return F.rlike(_col(sentence), F.lit(r"[0-9]\.\z"))


def is_fragment(sentence: Column, *, digit_endings: bool = False) -> Column:
    """Whether a sentence goes on in the next: no ending, or fewer than three words or ten signs."""
    short = (F.size(F.split(sentence, " ", -1)) < 3) | (F.length(sentence) < 10)
    out = F.endswith(sentence, F.lit(";")) | lacks_ending(sentence) | short
    return out | ends_in_digit_period(sentence) if digit_endings else out


def merged_sentences(parts: Column, *, digit_endings: bool = False) -> Column:
    """Fragments joined to the sentence that follows; those at the end stand together."""
    begin = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("open"), F.lit(False).alias("any"))

    def step(state: Column, part: Column) -> Column:
        s = strip(part, "\n ")
        return (
            F.when(is_fragment(s, digit_endings=digit_endings), F.struct(state["out"].alias("out"), F.concat(state["open"], s, F.lit(" ")).alias("open"), F.lit(True).alias("any")))
            .when(state["any"], F.struct(F.array_append(state["out"], strip(F.concat(state["open"], s), " ")).alias("out"), F.lit("").alias("open"), F.lit(False).alias("any")))
            .otherwise(F.struct(F.array_append(state["out"], s).alias("out"), F.lit("").alias("open"), F.lit(False).alias("any")))
        )

    return F.aggregate(parts, begin, step, lambda s: F.when(s["any"], F.array_append(s["out"], strip(s["open"], " "))).otherwise(s["out"]))


def ngrams(parts: Column, n: int = 2) -> Column:
    """Each n neighbours, joined by a blank; none if there are fewer."""
    if n < 1:
        raise ValueError("n is at least 1")
    count = F.greatest(F.size(parts) - F.lit(n - 1), F.lit(0))
    shifted = [F.slice(parts, F.lit(k + 1), count) for k in range(n)]
    return reduce(lambda a, b: F.zip_with(a, b, lambda x, y: F.concat(x, F.lit(" "), y)), shifted)


def normal_language(tag: Column | str) -> Column:
    """'de-AT' is 'de'; a language other than those known is an error."""
    lang = F.lower(F.split_part(_col(tag), F.lit("-"), F.lit(1)))
    return F.when(lang.isin(*LANGUAGES), lang).otherwise(F.raise_error(F.concat(F.lit("unknown language: "), lang)))


def is_known_language(tag: Column | str) -> Column:
    return F.lower(F.split_part(_col(tag), F.lit("-"), F.lit(1))).isin(*LANGUAGES)


def plain_spaces(text: Column | str) -> Column:
    """No-break spaces become spaces."""
    return F.replace(_col(text), F.lit("\u00a0"), F.lit(" "))


def one_line(text: Column | str) -> Column:
    return F.replace(_col(text), F.lit("\n"), F.lit(" "))


def fused(parts: Column, signs: str | None = None) -> Column:
    """Parts as lines; with signs, stripped of them and without empty ones."""
    return F.array_join(non_blank(parts, signs) if signs else parts, "\n")


def cut(text: Column | str, n: int | None) -> Column:
    return _col(text) if n is None else F.left(_col(text), F.lit(n))


def legal_reference(facts: Column, reasoning: Column) -> Column:
    return F.concat(F.array_join(facts, "\n"), F.lit("\n"), F.array_join(reasoning, "\n"))


def legal_summary(principles: Column) -> Column:
    """Each line of the two lists, closed by a line break."""
    return F.array_join(F.transform(F.flatten(principles), lambda x: F.concat(x, F.lit("\n"))), "")


def principle_part(principles: Column) -> Column:
    """Which of the two lists has lines; neither, or other than two lists, is an error."""
    first, second = F.size(principles[0]) > 0, F.size(principles[1]) > 0
    return (
        F.when(F.size(principles) != 2, F.raise_error(F.lit("two lists are needed")))
        .when(first & second, F.lit("both"))
        .when(first, F.lit("first"))
        .when(second, F.lit("second"))
        .otherwise(F.raise_error(F.lit("no principle is given")))
    )

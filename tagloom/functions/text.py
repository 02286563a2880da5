"""Functions on text: cleaning, tokens, n-grams, rendering and prompts."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagloom.constants import (
    PROMPT_HEAD,
    PROMPT_SEPARATOR,
    TOKEN_PATTERN,
    WORD_CLASS,
)
from tagloom.functions.values import ColumnOrName, as_column, part, strip


def clean_value(c: ColumnOrName) -> Column:
    """Delete newlines and square brackets, then strip both ends."""
    return strip(F.translate(as_column(c), "\n[]", ""))


def join_present(columns: Sequence[ColumnOrName], separator: str = " ") -> Column:
    """Clean every value and join those that are set and not empty."""
    cleaned = [F.when(as_column(c) != "", clean_value(c)) for c in columns]
    return F.concat_ws(separator, *cleaned)


def render_pairs(columns: Sequence[str], separator: str = ",") -> Column:
    """``name:value`` for every set column, in the given order."""
    shown = [F.concat(F.lit(f"{name}:"), as_column(name).cast("string")) for name in columns]
    return F.concat_ws(separator, *shown)


def render_values(columns: Sequence[str], separator: str = ",") -> Column:
    """The values alone, in the given order."""
    return F.concat_ws(separator, *[as_column(name).cast("string") for name in columns])


def render_map(attrs: ColumnOrName, separator: str = ",") -> Column:
    """``name:value`` for every entry of a map, ordered by name."""
    entries = F.array_sort(F.map_entries(as_column(attrs)))
    shown = F.transform(
        entries, lambda e: F.concat(e.getField("key"), F.lit(":"), e.getField("value"))
    )
    return F.array_join(shown, separator)


def prompt(rendered: ColumnOrName, categories: Iterable[str] | Column) -> Column:
    """Instruction, category list, separator and the rendered record. A column holds the list as one text."""
    listed = categories if isinstance(categories, Column) else F.lit(",".join(categories))
    return F.concat(F.lit(PROMPT_HEAD), listed, F.lit("\n" + PROMPT_SEPARATOR + "\n"), as_column(rendered), F.lit("."))


def record_prompt(raw: ColumnOrName, template: str) -> Column:
    """The record as stored, a blank line and the instruction."""
    return F.concat(as_column(raw), F.lit("\n\n" + template))


def prompt_payload(c: ColumnOrName) -> Column:
    """The part of a prompt behind the separator, on one line; null without a separator."""
    return part(strip(F.translate(as_column(c), "\n", " ")), PROMPT_SEPARATOR, 1)


def answer_category(c: ColumnOrName) -> Column:
    """Category named by a reply: the quoted words of a wordy one, else the whole reply."""
    c = as_column(c)
    quoted = F.regexp_extract(c, '"([^"]+)"', 1)
    plain = F.regexp_replace(strip(c), r"\.\z", "")
    return F.when(quoted != "", quoted).otherwise(plain)


def tokens(c: ColumnOrName, stop_words: Iterable[str] = ()) -> Column:
    """Lower-case words of at least two characters, without stop words."""
    words = F.regexp_extract_all(F.lower(as_column(c)), F.lit(TOKEN_PATTERN), F.lit(0))
    stop = sorted({w.lower() for w in stop_words})
    return F.filter(words, lambda w: ~w.isin(*stop)) if stop else words


def ngrams(words: ColumnOrName, low: int, high: int) -> Column:
    """All runs of ``low`` to ``high`` neighbouring words, joined by blanks.

    A null word breaks the run. Pass a column that is already computed (not an expression over
    text): the words are looked up once per position.
    """
    words = as_column(words)

    def runs(n: int) -> Column:
        return F.transform(words, lambda w, i: run_of_words(words, w, i, n))

    grams = F.concat(*[runs(n) for n in range(low, high + 1)])
    return F.filter(grams, lambda g: g.isNotNull())


def run_of_words(words: Column, first: Column, position: Column, n: int) -> Column:
    """``n`` words from a position on, null when there are not enough or one is null."""
    following = []
    for k in range(1, n):
        following += [F.lit(" "), F.get(words, position + k)]
    return F.concat(first, *following)


def pieces(c: ColumnOrName) -> Column:
    """Text cut into alternating runs of word and other characters; nothing is lost."""
    pattern = WORD_CLASS + "+|" + WORD_CLASS.replace("[", "[^") + "+"
    return F.regexp_extract_all(as_column(c), F.lit(pattern), F.lit(0))

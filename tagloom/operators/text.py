"""Text operators: assembling, prompts, answers, token tables."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.constants import ENGLISH_STOP_WORDS, TARGET_FIELDS
from tagloom.functions import text as fn
from tagloom.functions.arrays import unnest
from tagloom.functions.values import as_column, default_unknown
from tagloom.operators.joins import lookup_join


def assemble_text(
    df: DataFrame,
    fields: Sequence[str] = ("isolation_source",),
    separator: str = " ",
    name: str = "text",
) -> DataFrame:
    """Clean the fields that are set and join them."""
    return df.withColumn(name, fn.join_present(fields, separator))


def drop_empty_text(df: DataFrame, text: str = "text") -> DataFrame:
    return df.filter(as_column(text) != "")


def build_prompts(
    df: DataFrame,
    fields: Sequence[str],
    categories: Iterable[str] | DataFrame,
    sample_id: str = "sample_id",
) -> DataFrame:
    """One prompt per record: instruction, categories and the record's fields.

    Categories may be the first column of a frame; they are then put in order and joined by Spark, as many as there
    are, and each only once.
    """
    rendered = fn.render_pairs(list(fields))
    if not isinstance(categories, DataFrame):
        return df.select(as_column(sample_id).alias("sample_id"), fn.prompt(rendered, categories).alias("prompt"))
    names = F.array_join(F.array_sort(F.collect_set(as_column(categories.columns[0]).cast("string"))), ",")
    # one row with the text that every prompt holds
    shown = df.select(as_column(sample_id).alias("sample_id"), rendered.alias("__rendered")).join(
        F.broadcast(categories.agg(names.alias("__categories")))
    )
    return shown.select("sample_id", fn.prompt("__rendered", F.col("__categories")).alias("prompt"))


def extract_category(
    df: DataFrame, answer: str, categories: DataFrame, category: str = "category"
) -> DataFrame:
    """Adds the category a reply names and whether it is one of the allowed ones."""
    allowed = categories.select(as_column(category).alias("category")).distinct()
    read = df.withColumn("category", fn.answer_category(answer))
    known = allowed.withColumn("__known", F.lit(True))
    return lookup_join(read, known, ["category"], "left", keep=True).select(
        *[as_column(c) for c in df.columns],
        "category",
        F.coalesce(F.col("__known"), F.lit(False)).alias("is_allowed"),
    )


def fill_unknown(df: DataFrame, columns: Sequence[str] = TARGET_FIELDS) -> DataFrame:
    """Missing fields of a standardised record become ``Unknown``; absent columns are added."""
    have = set(df.columns)
    return df.withColumns(
        {c: default_unknown(c if c in have else F.lit(None)) for c in columns}
    )


def token_counts(
    df: DataFrame, sample_id: str, text: str, stop_words: Iterable[str] = ENGLISH_STOP_WORDS
) -> DataFrame:
    """(sample_id, token, n) of every text, without stop words and punctuation.

    A text is one row, so its tokens are counted inside it: nothing is shuffled.
    """
    sized = df.select(
        as_column(sample_id).alias("sample_id"), F.sort_array(fn.tokens(text, stop_words)).alias("__sorted")
    )
    begins = F.transform("__sorted", lambda w, i: F.when((i == 0) | (F.get("__sorted", i - 1) != w), i))
    begun = sized.withColumn("__begins", F.filter(begins, lambda i: i.isNotNull()))
    entries = F.transform(
        "__begins",
        lambda at, k: F.struct(
            F.get("__sorted", at).alias("token"),
            (F.coalesce(F.get("__begins", k + 1), F.size("__sorted")) - at).cast("bigint").alias("n"),
        ),
    )
    return unnest(begun, entries, ["sample_id"], "__entry").select("sample_id", "__entry.*")


def lemmatise(tokens: DataFrame, lemmas: DataFrame, token: str = "token") -> DataFrame:
    """Replace tokens by their lemma where a (token, lemma) table has one."""
    table = lemmas.groupBy(as_column(token)).agg(F.min("lemma").alias("__lemma"))
    joined = lookup_join(tokens, table, [token], "left", measured=lemmas)
    return joined.withColumn(token, F.coalesce(F.col("__lemma"), as_column(token))).select(
        *[as_column(c) for c in tokens.columns]
    )


def learn_lemma_rules(
    lemmas: DataFrame, token: str = "token", lemma: str = "lemma", longest: int = 5, min_tokens: int = 2, min_share: float = 0.5
) -> DataFrame:
    """Endings and what takes their place: (suffix, length, replacement, tokens, share).

    Every ending of a token of up to ``longest`` characters, with something before it that the lemma has too, is an
    example of its replacement by the rest of the lemma. An ending is a rule if its most frequent replacement (of equal ones
    the first in order) holds for ``min_tokens`` tokens, and for ``min_share`` of all tokens that end so.
    """
    pairs = lemmas.select(as_column(token).alias("token"), as_column(lemma).alias("lemma")).dropna().distinct()
    cuts = F.transform(
        F.sequence(F.lit(1), F.lit(longest)),
        lambda n: F.struct(
            n.alias("length"),
            F.when(F.length("token") > n, F.right("token", n)).alias("suffix"),
            F.when(
                F.left("token", F.length("token") - n) == F.left("lemma", F.length("token") - n),
                F.substr("lemma", F.length("token") - n + 1),
            ).alias("replacement"),
        ),
    )
    seen = unnest(pairs, F.filter(cuts, lambda c: c["suffix"].isNotNull()), [], "cut").select("cut.*")
    counted = seen.groupBy("suffix", "length", "replacement").agg(F.count(F.lit(1)).alias("n"))
    known = F.when(F.col("replacement").isNotNull(), F.struct((-F.col("n")).alias("n"), "replacement"))
    best = counted.groupBy("suffix", "length").agg(F.sum("n").alias("all"), F.min(known).alias("best"))
    tokens = (-F.col("best.n")).alias("tokens")
    rules = best.filter("best IS NOT NULL").select("suffix", "length", "best.replacement", tokens, (-F.col("best.n") / F.col("all")).alias("share"))
    return rules.filter((F.col("tokens") >= min_tokens) & (F.col("share") >= min_share))


def lemmatise_by_rules(
    tokens: DataFrame, lemmas: DataFrame, rules: DataFrame, token: str = "token", longest: int = 5
) -> DataFrame:
    """Replace tokens by their lemma: the one in the (token, lemma) table, else by the rule for the longest ending, else
    they stay. Each different token is looked up once."""
    distinct = tokens.select(as_column(token).alias("token")).filter("token IS NOT NULL").distinct()
    endings = F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda n: F.when(F.length("token") > n, F.right("token", n)))
    met = lookup_join(unnest(distinct, endings, ["token"], "suffix"), rules.select("suffix", "length", "replacement"), ["suffix"], keep=True)
    stem = F.concat(F.left("token", F.length("token") - F.col("length")), F.col("replacement"))
    ruled = met.groupBy("token").agg(F.max_by(stem, "length").alias("__ruled"))
    listed = lemmas.groupBy(as_column(token).alias("token")).agg(F.min("lemma").alias("__lemma"))
    found = lookup_join(lookup_join(distinct, listed, ["token"], "left", keep=True), ruled, ["token"], "left", keep=True)
    table = found.select("token", F.coalesce("__lemma", "__ruled", "token").alias("__lemma"))
    named = table.withColumnRenamed("token", token)
    joined = lookup_join(tokens, named, [token], "left", keep=True)
    return joined.withColumn(token, F.col("__lemma")).select(*[as_column(c) for c in tokens.columns])


def top_vocabulary(
    df: DataFrame, text: str, n: int, stop_words: Iterable[str] = ()
) -> DataFrame:
    """The ``n`` most frequent tokens, ties by token."""
    words = unnest(df, fn.tokens(text, stop_words), [], "token")
    counted = words.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(F.desc("n"), "token").limit(n)


def unrecognised_share(
    df: DataFrame, text: str, group: str, vocabulary: DataFrame, token: str = "token"
) -> DataFrame:
    """Per group: words, words outside the vocabulary and their share.

    Words are counted per group before the join, so a frequent word is one row per group.
    """
    counted = (
        unnest(df, fn.tokens(text), [group], token)
        .groupBy(as_column(group), as_column(token))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    known = vocabulary.select(as_column(token)).distinct().withColumn("__known", F.lit(True))
    flagged = lookup_join(counted, known, [token], "left", keep=True)
    unknown = F.sum(F.when(F.col("__known").isNull(), F.col("n")).otherwise(F.lit(0)))
    return (
        flagged.groupBy(as_column(group))
        .agg(F.sum("n").alias("words"), unknown.alias("unrecognised"))
        .withColumn("share", F.round(F.col("unrecognised") / F.col("words"), 6))
    )

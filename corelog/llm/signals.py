"""Per-document quality signals as integers, in JVM expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corelog.llm.common import fresh

#: Names of the signals, in the order in which they are stored.
SIGNALS = ("symbol_pm", "upper_pm", "digit_pm", "repeat_pm", "word_pm")

_WS = "[ \\t\\r\\n]+"


#: Hashed bags of words have so many buckets.
BAG = 512


def bag_of(word: Column) -> Column:
    """The bucket of a word, whatever its case: 0 to BAG - 1."""
    return F.pmod(F.xxhash64(F.lower(word)), F.lit(BAG)).cast("int")


def split_words(text: Column) -> Column:
    """Array of the words between white space."""
    stripped = F.trim(F.regexp_replace(text, _WS, " "))
    return F.when(stripped != "", F.split(stripped, " ")).otherwise(F.array().cast("array<string>"))


def with_signals(df: DataFrame, text: str = "text", weights: list[float] | None = None) -> tuple[DataFrame, str]:
    """df and one more column (its name is returned): array<bigint> in the order of SIGNALS, NULL where text is NULL.

    Shares are per mille and smoothed, so that a few characters of a short text don't count as a high share:
    symbols over characters + 100, upper-case letters and digits over characters + 400, words equal to the word before
    over words + 60, and mean word length as (letters + 100) / (words + 20). An empty text has 0, 0, 0, 0, 5000.
    weights: if given, BAG numbers, and the column is a struct of the signals and `bag`, the sum of the weights of all words'
    buckets over words + 20.
    """
    rest, words, signals = fresh(df, "rest", "words", "signals")
    c = F.col(text)

    def pm(n: Column, d: Column) -> Column:
        return F.floor(n * 1000 / d).cast("bigint")

    out = df.withColumns(
        {
            rest: F.regexp_replace(c, "[\\p{Ll} \\t\\r\\n]+", ""),
            words: split_words(c),
        }
    )
    n, w = F.length(c), F.size(words)
    same = F.aggregate(
        F.zip_with(F.col(words), F.slice(F.col(words), 2, F.greatest(w, F.lit(1))), lambda a, b: a == b),
        F.lit(0),
        lambda acc, x: acc + F.when(x, 1).otherwise(0),
    )
    symbols = F.length(F.regexp_replace(F.col(rest), "[\\p{L}\\p{N}]+", ""))
    upper = F.length(F.regexp_replace(F.col(rest), "[^\\p{Lu}]+", ""))
    digits = F.length(F.regexp_replace(F.col(rest), "[^0-9]+", ""))
    letters = F.aggregate(F.col(words), F.lit(0), lambda acc, x: acc + F.length(x))
    value = F.array(pm(symbols, n + 100), pm(upper, n + 400), pm(digits, n + 400), pm(same, w + 60), pm(letters + 100, w + 20))
    if weights is not None:
        table = F.array(*[F.lit(float(x)) for x in weights])
        total = F.aggregate(F.col(words), F.lit(0.0), lambda acc, x: acc + F.get(table, bag_of(x)))
        value = F.struct(value.alias("signals"), (total / (w + 20)).alias("bag"))
    # A generator of one row: filters and projections over the signals aren't moved below it, where they would compute them again.
    one = F.explode_outer(F.array(F.when(c.isNotNull(), value)))
    return out.select(*df.columns, one.alias(signals)), signals


#: The same in DuckDB: a CTE `signals` over documents, with doc_id, lang, source, text, n_chars and one column a signal.
SIGNALS_SQL = r"""
cut AS (
    SELECT *, regexp_replace(text, '[\p{Ll} \t\r\n]+', '', 'g') AS rest,
           trim(regexp_replace(text, '[ \t\r\n]+', ' ', 'g'), ' ') AS line
    FROM documents
), worded AS (
    SELECT *, CASE WHEN line = '' THEN [] ELSE string_split(line, ' ') END AS words FROM cut
), signals AS (
    SELECT doc_id, lang, source, text, n_chars,
           1000 * length(regexp_replace(rest, '[\p{L}\p{N}]+', '', 'g')) // (length(text) + 100) AS symbol_pm,
           1000 * length(regexp_replace(rest, '[^\p{Lu}]+', '', 'g')) // (length(text) + 400) AS upper_pm,
           1000 * length(regexp_replace(rest, '[^0-9]+', '', 'g')) // (length(text) + 400) AS digit_pm,
           1000 * len(list_filter(list_zip(words, words[2:]), lambda x: x[1] = x[2])) // (len(words) + 60) AS repeat_pm,
           1000 * (list_sum(list_transform(words, lambda x: length(x))) + 100)::BIGINT // (len(words) + 20) AS word_pm
    FROM worded
)"""

"""Text functions on columns, all planned by Catalyst."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Between sentences while a text is cut; in a text it counts as a space.
MARK = "\u0001"
# Leading words that names drop, each once and in this order.
ARTICLES = ("the", "a", "an")


# Fixed value: the word that scanning left.
SCANNED = "Ill"


def strip_marker(text: Column, marker: str = SCANNED) -> Column:
    """Delete a word that scanning left, with the white space after it."""
    return F.regexp_replace(text, rf"\b{marker}\b\s+", "")


def unify_newlines(text: Column) -> Column:
    """CRLF and CR become LF; an LF alone becomes a space, paragraph breaks stay."""
    return F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"(?<!\n)\n(?!\n)", " ")


def collapse_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def preprocess(text: Column, marker: str = SCANNED) -> Column:
    """Marker, newlines, then white space; the last step also joins paragraphs."""
    return collapse_spaces(unify_newlines(strip_marker(text, marker)))


def sentences(text: Column) -> Column:
    """The sentences of a text: cut after . ! ? before white space."""
    return F.split(F.regexp_replace(F.replace(text, F.lit(MARK), F.lit(" ")), r"([.!?])[ \t\r\n]+", "$1" + MARK), MARK)


def segment(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, sentence_id from 0, sentence) of every document."""
    return docs.select(id_col, F.posexplode(sentences(F.col("text"))).alias("sentence_id", "sentence"))


def normalize_name(name: Column) -> Column:
    """Lower case, marks . , " - deleted, white space collapsed, leading articles dropped; null gives ''."""
    out = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), '[.,"-]', ""), r"\s+", " "))
    for article in ARTICLES:
        out = F.regexp_replace(out, f"^{article} ", "")
    return out


def clean_tokens(name: Column, known: Column, titles: list[str], stop_words: list[str]) -> Column:
    """Words that are known, are titles, or are longer than two letters and no stop words."""
    title, stop = F.array(*map(F.lit, titles)), F.array(*map(F.lit, stop_words))
    kept = F.filter(F.split(name, " "), lambda t: F.array_contains(known, t) | F.array_contains(title, t) | (~F.array_contains(stop, t) & (F.length(t) > 2)))
    return F.array_join(kept, " ")


def gender_class(pronouns: Column) -> Column:
    """f, m or u from a pronoun group; 'she' and 'her' are looked for before 'he', 'him' and 'his'."""
    text = F.lower(F.coalesce(pronouns, F.lit("")))
    neutral = (text == "") | (text == "they/them/their")
    return F.when(neutral, "u").when(text.contains("she") | text.contains("her"), "f").when(text.contains("he") | text.contains("him") | text.contains("his"), "m").otherwise("u")


def int_list(column: str | Column) -> Column:
    """A list of integers from its literal; anything else gives an empty list."""
    return F.coalesce(F.from_json(F.col(column) if isinstance(column, str) else column, "array<int>", {"mode": "PERMISSIVE"}), F.array().cast("array<int>"))


def name_list(column: str | Column) -> Column:
    """A list of strings from its literal, with single or double quotes."""
    text = F.trim(F.col(column) if isinstance(column, str) else column)
    inner = F.regexp_extract_all(text, F.lit(r"""'((?:[^'\\]|\\.)*)'(?=\s*[,\]])|"((?:[^"\\]|\\.)*)"(?=\s*[,\]])"""), F.lit(0))
    return F.coalesce(F.when(text.rlike(r"^\[.*\]$"), F.transform(inner, lambda s: s.substr(F.lit(2), F.length(s) - 2))), F.array().cast("array<string>"))


def split_list(column: Column, sep: str = ";") -> Column:
    """Trimmed parts of a separated list, without empty ones; null gives an empty list."""
    return F.filter(F.transform(F.split(F.coalesce(column, F.lit("")), sep), lambda s: F.trim(s)), lambda s: s != "")


def sorted_tokens(name: Column) -> Column:
    return F.array_join(F.array_sort(F.split(F.trim(F.regexp_replace(name, r"\s+", " ")), " ")), " ")


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence, row by row in higher-order functions."""
    def row(previous: Column, x: Column) -> Column:
        def cell(done: Column, j: Column) -> Column:
            best = F.when(F.substring(b, j, F.lit(1)) == x, F.get(previous, j - 1) + 1).otherwise(F.greatest(F.get(previous, j), F.element_at(done, -1)))
            return F.array_append(done, best)

        return F.aggregate(F.sequence(F.lit(1), F.length(b)), F.array(F.lit(0)), cell)

    table = F.aggregate(F.split(a, ""), F.array_repeat(F.lit(0), F.length(b) + 1), row)
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0).otherwise(F.element_at(table, -1))


def token_sort_ratio(a: Column, b: Column) -> Column:
    """0 to 100: words of either side are sorted and joined, then 200 LCS / (both lengths); 100 for two empty texts."""
    x, y = sorted_tokens(a), sorted_tokens(b)
    total = F.length(x) + F.length(y)
    return F.when(total == 0, 100.0).otherwise(200.0 * lcs_length(x, y) / total)


def joined_words(tokens: DataFrame, by: list[str], order: str = "token_id", word: str = "word") -> DataFrame:
    """The words of each group in order, joined by spaces; null words are empty."""
    rows = F.sort_array(F.collect_list(F.struct(order, F.coalesce(word, F.lit("")).alias("w"))))
    return tokens.groupBy(*by).agg(F.array_join(F.transform(rows, lambda r: r["w"]), " ").alias("text"))


def token_range(text: str) -> tuple[int, int]:
    """(lo, hi) from 'lo,hi'."""
    lo, _, hi = text.partition(",")
    if not hi:
        raise ValueError(f"not a range of two numbers: {text!r}")
    return int(lo), int(hi)

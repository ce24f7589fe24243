"""Text scalars: tokenising, word counts, tags, n-grams, affixes.

Everything here returns a ``Column`` built from Spark built-ins so it stays
inside whole-stage code generation (or the interpreted higher-order
function path for arrays); no Python runs per row.

The regular expressions avoid engine-specific shorthands (``\\w``, ``\\s``
mean different things in Java and RE2), so the same pattern text is usable
from Spark and from an SQL oracle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values ---------------------------------------------------------------
# A word is a run of letters, marks, digits and underscore (Unicode aware).
WORD_RE = r"[\p{L}\p{M}\p{N}_]+"
# A token is a word or a single character that is neither a word character
# nor white space.
TOKEN_RE = r"[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_ \t\n\r\f\x0B]"
# A token is a word when its first character is a word character.
IS_WORD_RE = r"^[\p{L}\p{M}\p{N}_]"
# Sentence boundary: after any of ! ? . (zero width, delimiter kept).
SENTENCE_SPLIT_RE = r"(?<=[!?\.])"
# Tag of punctuation tokens.
PUNCT_TAG = "u"
# Separator of n-gram members.
NGRAM_SEP = "-"

# Stand-in part-of-speech rule used where no tagger is available.  One
# character per tag, in the tag set of the tagged corpora (n noun, v verb,
# a adjective, d adverb, l article, r preposition, c conjunction,
# u punctuation).  ``{t}`` is the lower-cased token, ``{w}`` a boolean
# "is a word".  The same text is valid Spark SQL and DuckDB SQL.
POS_RULE_SQL = (
    "CASE WHEN NOT {w} THEN 'u' "
    "WHEN length({t}) <= 2 THEN 'l' "
    "WHEN {t} LIKE '%ly' THEN 'd' "
    "WHEN {t} LIKE '%ing' OR {t} LIKE '%ed' THEN 'v' "
    "WHEN {t} LIKE '%tion' OR {t} LIKE '%ment' OR {t} LIKE '%ness' THEN 'n' "
    "WHEN {t} LIKE '%er' OR {t} LIKE '%est' THEN 'a' "
    "WHEN length({t}) <= 4 THEN 'r' "
    "WHEN length({t}) <= 6 THEN 'c' "
    "ELSE 'n' END"
)

# English function words used by the function-word operator on the stand-in
# corpus (the reference reads its own list from a JSON file, see
# ``sources.files.read_stopword_json``).
FUNCTION_WORDS = (
    "the of and to a in is it that was for on as with by he be at this from "
    "or an are which his her not but have were"
).split()


def pos_rule(token: str = "token", is_word: str = "is_word") -> Column:
    """Stand-in tagger as a column expression (see ``POS_RULE_SQL``)."""
    return F.expr(POS_RULE_SQL.format(t=token, w=is_word))


def pos_rule_lambda(var: str) -> str:
    """The rule as SQL text for a lambda variable holding a *word*."""
    return POS_RULE_SQL.format(t=var, w="true")


def sql_literal(pattern: str) -> str:
    """A regex ready to sit inside a Spark SQL string literal (escapes doubled)."""
    return pattern.replace("\\", "\\\\").replace("'", "\\'")


def word_count(text: Column) -> Column:
    """Number of words."""
    return F.regexp_count(text, F.lit(WORD_RE)).cast("bigint")


def words(text: Column, lower: bool = True) -> Column:
    """Array of words in text order (punctuation dropped)."""
    t = F.lower(text) if lower else text
    return F.regexp_extract_all(t, F.lit(WORD_RE), 0)


def tokens(text: Column, lower: bool = True) -> Column:
    """Array of tokens: words and single punctuation characters."""
    t = F.lower(text) if lower else text
    return F.regexp_extract_all(t, F.lit(TOKEN_RE), 0)


def is_word(token: Column) -> Column:
    return token.rlike(IS_WORD_RE)


def collapse_space(text: Column) -> Column:
    """C1 without NFKC: runs of 2+ white space or newlines -> one space, trim."""
    return F.trim(F.regexp_replace(text, r"[ \t\n\r\f\x0B]{2,}|\n+", " "))


def sentences(text: Column) -> Column:
    """C4: split after ! ? . keeping the delimiter, trim, drop empties."""
    parts = F.split(text, SENTENCE_SPLIT_RE)
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != F.lit(""))


def ngrams(arr: Column, n: int = 3, sep: str = NGRAM_SEP) -> Column:
    """Consecutive n-grams of an array joined by ``sep`` (empty if short)."""
    size = F.size(arr)
    idx = F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(0)))
    grams = F.transform(idx, lambda i: F.concat_ws(sep, *[F.element_at(arr, i + j) for j in range(n)]))
    return F.when(size >= n, grams).otherwise(F.array().cast("array<string>"))


def affixes(token: Column) -> Column:
    """The affix features of one token.

    len <= 3: the token itself; len >= 2: ``_`` + first two and last two
    + ``_``; len > 3: first three and last three.
    """
    n = F.length(token)
    parts = F.array(
        F.when(n <= 3, token),
        F.when(n >= 2, F.concat(F.lit("_"), F.substring(token, 1, 2))),
        F.when(n >= 2, F.concat(F.substring(token, -2, 2), F.lit("_"))),
        F.when(n > 3, F.substring(token, 1, 3)),
        F.when(n > 3, F.substring(token, -3, 3)),
    )
    return F.filter(parts, lambda x: x.isNotNull())


def underscore_text(tokens_text: Column) -> Column:
    """C10 frame: `` text `` with spaces turned into ``_``."""
    return F.replace(F.concat(F.lit(" "), F.trim(tokens_text), F.lit(" ")), F.lit(" "), F.lit("_"))


def count_non_overlapping(text: Column, needle: Column) -> Column:
    """Non-overlapping occurrences of ``needle`` in ``text``."""
    return ((F.length(text) - F.length(F.replace(text, needle, F.lit(""))))
            / F.length(needle)).cast("bigint")


def round6(c: Column) -> Column:
    return F.round(c.cast("double"), 6)


# Sentence delimiters of the document splitter (C14): . ; · ? !
SENTENCE_PUNCT_RE = r"[.;·?!]"


def sentence_tokens(text: Column) -> Column:
    """C14: sentences (split on . ; · ? !, commas removed) as arrays of
    whitespace tokens; empty sentences dropped."""
    parts = F.split(F.regexp_replace(text, ",", ""), SENTENCE_PUNCT_RE)
    toks = F.transform(parts, lambda s: F.filter(F.split(F.trim(s), r"\s+"),
                                                 lambda w: w != F.lit("")))
    return F.filter(toks, lambda s: F.size(s) > 0)


def windows(tokens_arr: Column, size: int = 25, stride: int | None = None) -> Column:
    """Windows of ``size`` tokens starting every ``stride`` tokens
    (default ``size``: consecutive, tail kept)."""
    stride = stride or size
    n = F.size(tokens_arr)
    starts = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(stride))
    return F.when(n > 0, F.transform(starts, lambda i: F.slice(tokens_arr, i + 1, size)))\
        .otherwise(F.array().cast("array<array<string>>"))


# Elision mark of the tokenised texts.
ELISION = "\u02b9"


def plain_words(text: Column) -> Column:
    """Elision mark to apostrophe, punctuation to spaces, split at white space.

    Case is kept.  Punctuation is ASCII punctuation and Unicode class P.
    """
    t = F.replace(text, F.lit(ELISION), F.lit("'"))
    t = F.regexp_replace(t, r"[\p{P}$+<=>^`|~]", " ")
    return F.filter(F.split(t, r"[ \t\n\r\f\x0B]+"), lambda w: w != F.lit(""))


def clean_text(text: Column) -> Column:
    """Unicode NFKC, runs of 2+ white space or newlines to one space, trim.

    NFKC has no built-in; it runs as an Arrow batch function, and only texts
    with a non-ASCII character can change by it.
    """
    @F.pandas_udf("string")
    def nfkc(texts):
        import unicodedata
        return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))
    t = F.when(text.rlike(r"[^\x00-\x7F]"), nfkc(text)).otherwise(text)
    return F.trim(F.regexp_replace(t, r"(?U)\s{2,}|\n+", " "))


def tag_string(tags: Column, start: int = 0, end: int | None = None) -> Column:
    """Tags from place ``start`` (0-based) to before ``end`` as one string."""
    length = F.size(tags) if end is None else F.lit(max(0, end - start))
    return F.array_join(F.slice(tags, start + 1, length), "")

"""Text expressions. All are built-in column functions; a null text gives null unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters with marks and what they fold to, one for one.
MARKED = "áàâãäåéèêëíìîïóòôõöúùûüçñýÿÁÀÂÃÄÅÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇÑÝ"
PLAIN = "aaaaaaeeeeiiiiooooouuuucnyyAAAAAAEEEEIIIIOOOOOUUUUCNY"


def squeeze(c: Column) -> Column:
    """White space as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def normalise(c: Column) -> Column:
    """The key texts are compared by: squeezed, no space before punctuation, lower case."""
    return F.lower(F.regexp_replace(squeeze(c), r" ([.,!?;:])", "$1"))


def fold_accents(c: Column) -> Column:
    return F.translate(c, MARKED, PLAIN)


def ws_words(c: Column) -> Column:
    """What stands between white space."""
    return F.filter(F.split(F.trim(F.regexp_replace(c, r"\s+", " ")), " "), lambda w: w != "")


def alpha_words(c: Column) -> Column:
    """Runs of letters of any script."""
    return F.regexp_extract_all(c, F.lit(r"(\p{L}+)"), F.lit(1))


def sentences(c: Column) -> Column:
    """A text cut after . ! ? or … followed by white space."""
    return F.filter(F.split(F.regexp_replace(F.trim(c), r"([.!?…])\s+", "$1\u0001"), "\u0001"), lambda s: s != "")


def terminal_mark(c: Column) -> Column:
    """The . ! ? or … that a text ends with, closing quotes and brackets aside; empty if none does."""
    return F.regexp_extract(F.regexp_replace(c, r"""[\s"'”’»)\]]+$""", ""), r"([.!?…])$", 1)


def strip_terminal(c: Column) -> Column:
    return F.regexp_replace(c, r"[.?!…,;:\s]+$", "")


TOKEN = r"(<\|[^|>]+\|>)"


def tokens(c: Column) -> Column:
    """Protocol tokens, <|name|>, in their order."""
    return F.regexp_extract_all(c, F.lit(TOKEN), F.lit(1))


def without_tokens(c: Column) -> Column:
    return squeeze(F.regexp_replace(c, TOKEN, " "))


def leading_token(c: Column) -> Column:
    """The token a text begins with; empty without one."""
    return F.regexp_extract(c, r"^\s*(<\|[^|>]+\|>)", 1)


def word_key(c: Column) -> Column:
    """What two transcripts' words are compared by: lower case, letters, digits, _ and ' alone."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_']", "")


def spoken(c: Column) -> Column:
    """A reply as it is read out: links as their text, no URLs, no emphasis marks, list marks or headings."""
    c = F.regexp_replace(c, r"\[([^\]]*)\]\([^)]*\)", "$1")
    c = F.regexp_replace(c, r"https?://\S+", "")
    c = F.regexp_replace(c, r"(?m)^[ \t]*(?:[-*+]|#+|[0-9]+\.)[ \t]+", "")
    return squeeze(F.regexp_replace(c, r"[*_`~]+", ""))


#: Hangul, Japanese, Chinese and Cyrillic letters (fixed values); marks that may stand before and after a stray token.
SCRIPTS = "[\uac00-\ud7af\u1100-\u11ff\u3040-\u30ff\u4e00-\u9fff\u0400-\u04ff]"
BEFORE_DRIFT, AFTER_DRIFT = r"""[\s!.,?…:;\-–—()\[\]"']*""", r"[ \t!.,?…:;—–]*"


def leading_drift(c: Column) -> tuple[Column, Column]:
    """A reply without the token of another script that it opens with, and the token; null if there is none."""
    token = F.nullif(F.regexp_extract(c, f"^{BEFORE_DRIFT}({SCRIPTS}+)", 1), F.lit(""))
    return F.when(token.isNull(), c).otherwise(F.regexp_replace(c, f"^{BEFORE_DRIFT}{SCRIPTS}+{AFTER_DRIFT}", "")), token


def degenerate_tail(c: Column) -> Column:
    """A reply without what it degenerates into: of a last word of one or two characters that repeats, one stays; and a last one with marked letters alone goes where a sentence has ended."""
    once = F.regexp_replace(squeeze(c), r"(^| )([^ ]{1,2})(?: \2)+$", "$1$2")
    return F.regexp_replace(once, r"(?<=[^\p{L}\p{N} ]) (?=\p{L}{1,2}$)(?=[^ ]*[^\x00-\x7F])\p{L}{1,2}$", "")


def emoji_only(c: Column) -> Column:
    """True if a text has nothing but symbols and white space; also if it is empty."""
    return F.regexp_replace(c, r"\s", "").rlike(r"^\p{So}*$")


def continuation(c: Column) -> Column:
    """A piece that goes on with a sentence, without the marks and spaces it begins with."""
    return F.regexp_replace(c, r"^[\s,;:.…—–-]+", "")


def add_punctuation(c: Column, mark: str = ".") -> Column:
    """A text that ends with ``mark`` alone instead of the marks and spaces it ended with; empty stays empty."""
    bare = strip_terminal(c)
    return F.when(bare == "", F.lit("")).otherwise(F.concat(bare, F.lit(mark)))


def repeated_run(c: Column, least: int = 6) -> Column:
    """True if some character stands ``least`` times in a row."""
    return c.rlike(rf"(.)\1{{{least - 1},}}")


def marker_count(words: Column, markers: list[str]) -> Column:
    """How many of a text's words are among the markers."""
    return F.size(F.filter(words, lambda w: w.isin(markers))).cast("bigint")


def rating(c: Column) -> tuple[Column, Column]:
    """The rating in a judge's answer and how it was found: by the sentence asked for (strict), after as or como (loose), the last digit from 0 to 5 of the last 200 characters (digits), or failed."""
    strict = F.regexp_extract(c, r"(?s)Analysis:\s*(.*?)\n\s*I would rate the AI's response as\s*(\d+)", 2)
    loose = F.regexp_extract(c, r"(?i)(?:as|como)\s*(\d)", 1)
    last = F.element_at(F.regexp_extract_all(F.right(c, F.lit(200)), F.lit(r"\b([0-5])\b"), F.lit(1)), -1)
    found = F.regexp_count(F.right(c, F.lit(200)), F.lit(r"\b[0-5]\b")) > 0
    how = F.when(strict != "", "strict").when(loose != "", "loose").when(found, "digits").otherwise("failed")
    value = F.when(strict != "", strict).when(loose != "", loose).when(found, last)
    return value.cast("bigint"), how


def signed(c: Column) -> Column:
    """A difference with its sign and three decimals."""
    return F.format_string("%+.3f", c)

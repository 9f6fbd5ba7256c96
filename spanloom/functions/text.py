"""Text cleaning, segmentation, tokens and stems as Column expressions (evaluated inside the row, without a shuffle)."""

from __future__ import annotations

import builtins
import keyword

from pyspark.sql import Column
from pyspark.sql import functions as F

# Prefixes of structural words; vocabulary of file kinds and classes.
STRUCTURAL = ("label", "fig", "tab", "table", "eq", "chap", "sec", "subsec", "ref", "cite")
#: Environments, inline and display math, commands, rules of LaTeX.
LATEX = ("(?s)\\\\begin\\{[^}]+\\}.*?\\\\end\\{[^}]+\\}", "\\$[^$]*\\$", "(?s)\\\\\\[.*?\\\\\\]", "\\\\[a-zA-Z]+(\\*?)\\s*(\\[[^\\]]*\\])?(\\{[^}]*\\})?", "(?m)^[-=]{3,}\\s*$")
KINDS = (("pdf", (".pdf",)), ("latex", (".tex", ".latex")), ("python", (".py",)), ("c_like", (".c", ".h", ".cpp", ".hpp", ".cc", ".java")), ("html", (".html", ".htm")))
CLASSES = (("theory", ("paper1", "paper2", "k-it", "epistemic", "methodology", "theory", "introduction")), ("case", ("connor", "reed", "case", "misinfo", "social", "covid")))
#: Names that Python itself has.
RESERVED = sorted({x for x in (*keyword.kwlist, *dir(builtins)) if x.isalpha() and x.islower() and len(x) > 2})
#: Names that say nothing in code, and short ones that do.
NOISE = ("self", "cls", "args", "kwargs", "tmp", "temp", "var", "val")
SHORT = ("df",)
#: Python's docstrings, its comments, and paths in code.
DOCSTRING, COMMENT, PATH = "(?s)\"\"\".*?\"\"\"|'''.*?'''", "#[^\\n]*", "([A-Za-z]:)?[\\\\/][A-Za-z0-9_./\\\\-]+"
SPACE, BLANKS = "[\\t-\\r \\x85\\xA0]", "\t\n\v\f\r \x85\xa0"
WORD = "[A-Za-z][A-Za-z-]{2,}"
#: A whole run of three letters or more with a vowel, not structural, in a text without hyphens.
TOKEN = f"(?<![A-Za-z])(?!(?i:{'|'.join(STRUCTURAL)}))(?=[A-Za-z]*[aeiouAEIOU])[A-Za-z]{{3,}}"
SUFFIXES = ("ing", "ers", "er", "ed")


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(BLANKS))


def squeeze(c: Column) -> Column:
    """Runs of blanks become one, runs of line breaks become one; both ends are stripped."""
    return strip(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "[ \\t]+", " "), "\\n{2,}", "\n"))


def strip_html(c: Column) -> Column:
    return squeeze(F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]+>", " "))


def strip_latex(c: Column) -> Column:
    """Environments, inline and display math, commands and rules are replaced by spaces."""
    for pattern in LATEX:
        c = F.regexp_replace(c, pattern, " ")
    return squeeze(c)


def latex_arguments(c: Column) -> Column:
    """Commands go, their arguments' text stays."""
    return squeeze(F.regexp_replace(F.regexp_replace(c, "\\\\[A-Za-z]+\\{([^}]*)\\}", "$1"), "\\\\[A-Za-z]+", " "))


def informative(span: Column) -> Column:
    """Enough letters: ten of a short span, three tenths of a longer one."""
    letters, n = F.length(F.regexp_replace(span, "[^\\p{L}]+", "")), F.length(span)
    return F.when(n < 20, letters >= 10).otherwise(letters / n >= 0.3)


def spans(c: Column) -> Column:
    """The informative lines of a text, stripped."""
    return F.filter(F.transform(F.split(squeeze(c), "\n"), strip), informative)


def normal_token(c: Column) -> Column:
    """Lower-case letters of a token; empty if too short, structural or without a vowel."""
    t = F.regexp_replace(F.lower(c), "[^a-z]+", "")
    return F.when((F.length(t) > 2) & ~t.rlike(f"^({'|'.join(STRUCTURAL)})") & t.rlike("[aeiou]"), t).otherwise("")


def tokens(c: Column) -> Column:
    """The normal tokens of the words (letter, then letters and hyphens) of a text, by one pattern.

    Without its hyphens a word is a run of letters, and no two runs become one that were not one word.
    """
    return F.transform(F.regexp_extract_all(F.replace(c, F.lit("-"), F.lit("")), F.lit(TOKEN), 0), lambda t: F.lower(t))


def bigrams(tokens_: str) -> Column:
    """Phrases of two tokens in a row."""
    return F.when(F.size(tokens_) > 1, F.transform(F.slice(F.col(tokens_), 1, F.size(tokens_) - 1), lambda t, i: F.concat(t, F.lit(" "), F.get(tokens_, i + 1)))).otherwise(F.array().cast("array<string>"))


def stem(t: Column) -> Column:
    """A light stemmer: ies to y, else ing, ers, er, ed, es or s off."""
    n = F.length(t)
    cut = lambda k: F.substring(t, F.lit(1), n - k)
    out = F.when(n <= 3, t).when((n > 4) & t.endswith("ies") & ~t.endswith("eies"), F.concat(cut(3), F.lit("y")))
    for suffix in SUFFIXES:
        out = out.when((n > len(suffix) + 2) & t.endswith(suffix), cut(len(suffix)))
    return out.when(t.endswith("es") & ~t.endswith("ses"), cut(2)).when(t.endswith("s") & ~t.endswith("ss"), cut(1)).otherwise(t)


def root_key(c: Column) -> Column:
    """The stems of an element's words."""
    return F.array_join(F.transform(F.split(c, " "), stem), " ")


def base_name(c: Column) -> Column:
    return F.regexp_extract(c, "([^/]*)$", 1)


def file_kind(c: Column) -> Column:
    suffix = F.lower(F.regexp_extract(base_name(c), "(\\.[^.]+)$", 1))
    out = F.when(suffix.isin(*KINDS[0][1]), KINDS[0][0])
    for kind, suffixes in KINDS[1:]:
        out = out.when(suffix.isin(*suffixes), kind)
    return out.otherwise("text")


def file_class(c: Column) -> Column:
    name = F.lower(base_name(c))
    return F.when(name.rlike("|".join(CLASSES[0][1])), CLASSES[0][0]).when(name.rlike("|".join(CLASSES[1][1])), CLASSES[1][0]).otherwise("other")


def slug(c: Column) -> Column:
    """A file name without a trailing number before the extension."""
    return F.regexp_replace(base_name(c), "-\\d+(\\.[^.]+)$", "$1")


def token_estimate(c: Column, most: int = 8192) -> Column:
    """White-space tokens of the first characters, extrapolated by bytes to the whole text."""
    chunk = F.substring(c, 1, most)
    n = F.size(F.filter(F.split(chunk, "[ \\t-\\r]+"), lambda x: x != ""))
    return F.greatest(F.floor(n / F.greatest(F.octet_length(chunk), F.lit(1)) * F.octet_length(c)), n).cast("long")


def short_label(c: Column, most: int = 24) -> Column:
    """At most 24 characters, cut at the last space."""
    head = F.substring(c, 1, most - 3)
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.regexp_replace(head, " [^ ]*$", ""), F.lit("...")))


def comments(c: Column, style: str = "python") -> Column:
    """Comment texts of source code: `#` lines and docstrings, or // and /* */."""
    patterns = ('(?m)#\\s*(.*)$', '(?s)"""(.*?)"""') if style == "python" else ("(?m)//\\s*(.*)$", "(?s)/\\*(.*?)\\*/")
    return F.concat(*[F.regexp_extract_all(c, F.lit(p), 1) for p in patterns])


def code_words(c: Column) -> Column:
    """Identifiers split at case changes and underscores, lower-cased, at least three letters."""
    parts = F.regexp_extract_all(F.regexp_replace(c, "([a-z])([A-Z])", "$1 $2"), F.lit("[A-Za-z]{3,}"), 0)
    return F.transform(parts, lambda x: F.lower(x))


def identifiers(c: Column) -> Column:
    """The words of names in code, lower-cased: split at underscores and changes of case, so that an acronym before a word is one of its own.

    Single letters and acronyms before a digit or an underscore are left out, unless they are all that a name has.
    Dropped are numbers, keywords and built-in names, noise, and what has under three characters but for known ones.
    """

    def words(name: Column) -> Column:
        found = F.regexp_extract_all(name, F.lit("[A-Za-z][a-z]+|[A-Z]+(?=[A-Z][a-z]|$)|[0-9]+"), 0)
        return F.when(F.size(found) > 0, found).otherwise(F.array(name))

    parts = F.transform(F.flatten(F.transform(F.regexp_extract_all(c, F.lit("[A-Za-z0-9_]+"), 0), words)), lambda x: F.lower(x))
    return F.filter(parts, lambda x: ((F.length(x) >= 3) | x.isin(*SHORT)) & ~x.isin(*RESERVED, *NOISE) & ~x.rlike("^[0-9]+$"))


def code_tokens(c: Column, language: str = "python") -> Column:
    """Words of docstrings, of comments, then of the code without them and without paths. Of other languages the whole text is code."""
    whole = F.coalesce(c, F.lit(""))
    if language not in ("python", "py"):
        return identifiers(F.regexp_replace(whole, PATH, " "))
    notes = F.array_join(F.concat(F.regexp_extract_all(whole, F.lit(DOCSTRING), 0), F.regexp_extract_all(whole, F.lit(COMMENT), 0)), "\n")
    body = F.regexp_replace(F.regexp_replace(F.regexp_replace(whole, DOCSTRING, " "), COMMENT, " "), PATH, " ")
    return F.concat(identifiers(notes), identifiers(body))


def word_characters(c: Column) -> Column:
    """Lower-cased runs of letters, digits, _ and -."""
    return F.regexp_extract_all(F.lower(c), F.lit("[\\p{L}\\p{N}_-]+"), 0)

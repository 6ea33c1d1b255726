"""Final answers in generated text: extraction, clean-up, numeric reading."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import as_column, replace_all, strip

# Literal rewrites of the answer clean-up, in order.
REWRITES = [
    ("an ", ""),
    ("a ", ""),
    (".$", "$"),
    ("\\$", ""),
    ("\\ ", ""),
    (" ", ""),
    ("mbox", "text"),
    (",\\text{and}", ","),
    ("\\text{and}", ","),
    ("\\text{m}", "\\text{}"),
    ("\\le", "<"),
]

# Literals deleted by the answer clean-up, in order.
DELETIONS = [
    "square", "ways", "integers", "dollars", "mph", "inches", "ft", "hours", "km", "units",
    "\\ldots", "sue", "points", "feet", "minutes", "digits", "cents", "degrees", "cm", "gm",
    "pounds", "meters", "meals", "edges", "students", "childrentickets", "multiples",
    "\\text{s}", "\\text{.}", "\\text{\ns}", "\\text{}^2", "\\text{}^3", "\\text{\n}", "\\text{}",
    "\\mathrm{th}", "^\\circ", "^{\\circ}", "\\;", ",\\!", "{,}", '"', "\\dots",
    "\n", "\r", "\f", "\\%",
]

# Wrappers whose content replaces them, in order. (?d) makes "."
# stop at line feeds only.
WRAPPERS = [
    r"(?d)\\text\{(.*?)\}",
    r"(?d)\\textbf\{(.*?)\}",
    r"(?d)\\overline\{(.*?)\}",
    r"(?d)\\boxed\{(.*)\}",
]

# Lead-ins of a final answer; the last match of each one wins.
# In front of each one a literal without which it cannot match.
LEAD_INS = [
    ("finalansweris", r"(?d)finalansweris(.*)"),
    ("answe", r"(?d)answer?is:?(.*)"),
    ("oxed{", r"(?d)oxed\{(.*?)\}"),
    ("$", r"(?d)\$(.*?)\$"),
]

# What Python's float() accepts, bar the infinities and NaN: those can never be
# rounded to an integer. Digits may be grouped by single underscores.
_DIGITS = r"[0-9]+(?:_[0-9]+)*"
NUMBER = rf"^[+-]?(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?\z"

# Digits of other scripts count as digits too: all of them in the answer
# clean-up, those with a decimal value where a number is read.
_OTHER = [chr(code) for code in range(128, sys.maxunicode + 1) if chr(code).isdigit()]
_OTHER_DECIMALS = [digit for digit in _OTHER if digit.isdecimal()]
_STARTS = [digit for digit in _OTHER if not chr(ord(digit) - 1).isdigit()]
_ENDS = [digit for digit in _OTHER if not chr(ord(digit) + 1).isdigit()]
DIGITS = r"^[0-9]+\z"
ALL_DIGITS = "^[0-9" + "".join(f"{first}-{last}" for first, last in zip(_STARTS, _ENDS)) + r"]+\z"
OTHER_SCRIPT = r"[^\x00-\x7F]"

# Texts the clean-up leaves as they are, most often a bare number.
CLEAN_ALREADY = r"^[0-9.]*\z"

NO_ANSWER = "-1"


def boxed_answer(text: Column | str) -> Column:
    r"""Content of the last ``\boxed{...}`` with balanced braces, else null.

    The text behind the last box is cut after every closing brace, so the scan
    visits one piece per brace instead of one character at a time.
    """
    text = as_column(text)
    tail = F.substring_index(text, r"\boxed", -1)

    def visit(seen: Column, piece: Column) -> Column:
        depth = seen["depth"] + F.length(piece) - F.length(F.replace(piece, F.lit("{"), F.lit("")))
        ends = F.endswith(piece, F.lit("}"))
        return F.when(seen["closed"], seen).otherwise(
            F.struct(
                F.when(ends, depth - 1).otherwise(depth).alias("depth"),
                (seen["size"] + F.length(piece)).alias("size"),
                (ends & (depth == 1)).alias("closed"),
            )
        )

    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("size"), F.lit(False).alias("closed"))
    inside = F.aggregate(
        F.split(tail, r"(?<=\})"),
        start,
        visit,
        lambda seen: F.when(seen["closed"], F.substr(tail, F.lit(2), seen["size"] - 2)),
    )
    return F.when(F.contains(text, F.lit(r"\boxed")) & F.startswith(tail, F.lit("{")), inside)


def _where(needed: Column, changed: Column, name: str) -> Column:
    """Spare the texts no pattern can match the cost of the pattern."""
    return F.when(needed, changed).otherwise(F.col(name))


def with_clean_answer(df: DataFrame, source: Column | str, target: str) -> DataFrame:
    """Add ``target``: the normalised form of the answer text in ``source``.

    Every lead-in needs its input twice, so the steps are separate columns;
    nested in one expression each step would double the work. The result passes
    through a one-element explode, a row-local step no later filter is pushed
    below: a pushed filter would repeat all of the work per use.
    """
    raw = as_column(source)
    text = F.substring_index(raw, "Problem:", 1)
    text = replace_all(text, REWRITES)
    text = replace_all(text, [(word, "") for word in DELETIONS])
    df = df.withColumn(target, F.when(raw.rlike(CLEAN_ALREADY), raw).otherwise(text))
    text = F.col(target)
    for wrapper in WRAPPERS:
        text = F.regexp_replace(text, wrapper, "$1")
    df = df.withColumn(target, _where(F.contains(target, F.lit("{")), text, target))
    for needed, lead_in in LEAD_INS:
        last = F.try_element_at(F.regexp_extract_all(target, F.lit(lead_in), F.lit(1)), F.lit(-1))
        found = F.coalesce(last, F.col(target))
        df = df.withColumn(target, _where(F.contains(target, F.lit(needed)), found, target))
    df = df.withColumn(target, strip(target))
    bare = F.contains(target, F.lit("rac")) & ~F.contains(target, F.lit(r"\frac"))
    text = F.when(bare, F.replace(target, F.lit("rac"), F.lit(r"\frac"))).otherwise(F.col(target))
    text = F.regexp_replace(text, r"(?d)frac([^{])(.)", "frac{$1}{$2}")
    text = F.regexp_replace(text, r"sqrt([^{])", "sqrt{$1}")
    rooted = F.contains(target, F.lit("rac")) | F.contains(target, F.lit("sqrt"))
    df = df.withColumn(target, F.replace(_where(rooted, text, target), F.lit("$"), F.lit("")))
    joined = F.replace(target, F.lit(","), F.lit(""))
    digits = joined.rlike(DIGITS) | (joined.rlike(OTHER_SCRIPT) & joined.rlike(ALL_DIGITS))
    clean = F.when(digits, joined).otherwise(F.col(target))
    return df.withColumn(target, F.explode(F.array(clean)))


def _ascii_digits(text: Column) -> Column:
    plain = "".join(str(unicodedata.decimal(digit)) for digit in _OTHER_DECIMALS)
    return F.when(text.rlike(OTHER_SCRIPT), F.translate(text, "".join(_OTHER_DECIMALS), plain)).otherwise(text)


def number_value(text: Column | str) -> Column:
    """The number a text states, as Python's float() reads it; null if it states none."""
    trimmed = _ascii_digits(strip(text))
    number = F.replace(trimmed, F.lit("_"), F.lit("")).try_cast("double")
    return F.when(trimmed.rlike(NUMBER), number)


def numeric_answer(text: Column | str) -> Column:
    """The answer as an integer in 0..999, or null where it does not count.

    Reads a floating point number, rounds half to even, drops negatives and
    unreadable text, and takes the rest modulo 1000.
    """
    rounded = F.rint(number_value(text))
    counts = (rounded >= 0) & (rounded < F.lit(float("inf")))
    return F.when(counts, (rounded % 1000).cast("int"))


def answer_class(answer: Column | str) -> Column:
    """An integer answer folded into 0..999; fractions are cut off first."""
    whole = as_column(answer).cast("bigint")
    return F.pmod(whole, F.lit(1000)).cast("int")

"""Strings as Python treats them, and answers found in free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What Python's str.strip and str.split take for white space.
SPACE = r"[\s\x1c-\x1f]"


def strip(c: Column) -> Column:
    """str.strip: Unicode white space and U+001C to U+001F at both ends."""
    return F.regexp_replace(c, rf"(?U)^{SPACE}+|{SPACE}+$", "")


def blank(c: Column) -> Column:
    """Null, empty or white space only."""
    return F.coalesce(F.length(strip(c)) == 0, F.lit(True))


def words(c: Column) -> Column:
    """str.split without arguments."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), rf"(?U){SPACE}+"), lambda w: w != "")


def has_think_marker(c: Column) -> Column:
    low = F.lower(F.coalesce(c, F.lit("")))
    return low.contains("<think>") | low.contains("</think>")


def stable_id(*parts: Column) -> Column:
    """md5 in hex of the parts joined; null if one is null."""
    return F.md5(F.concat(*[p.cast("string") for p in parts]).cast("binary"))


def falsy(c: Column) -> Column:
    """Null for an empty string, else the string."""
    return F.nullif(c, F.lit(""))


def whole_number(c: Column) -> Column:
    """A literal as Python source reads it: no leading zeros, null if it doesn't fit."""
    return F.when(F.rlike(c, F.lit(r"^(0+|[1-9][0-9]*)$")), c.try_cast("bigint"))


def last_integer(c: Column, otherwise: int = -9999999) -> Column:
    """The last run of digits, commas removed; ``otherwise`` if there is none or it has leading
    zeros."""
    found = F.regexp_extract_all(F.regexp_replace(F.coalesce(c, F.lit("")), ",", ""), F.lit(r"(?U)\d+"), F.lit(0))
    return F.coalesce(whole_number(F.try_element_at(found, F.lit(-1))), F.lit(otherwise).cast("bigint"))


def _last(c: Column, pattern: str, group: int) -> Column:
    return F.try_element_at(F.regexp_extract_all(c, F.lit(pattern), F.lit(group)), F.lit(-1))


def _cascade(*tries: Column) -> Column:
    """The first try that is neither null nor empty."""
    return F.coalesce(*[falsy(t) for t in tries])


#: Where answers stand in solutions.
BOXED = r"\\boxed\{([^}]+)\}"
BOXED_WORD = r"\\boxed\s+([^\s]+)"
BOXED_DIGITS = r"\\boxed\s+(\d+)"
SIGNED = r"[-+]?\d*\.?\d+"
ANSWER_SIGNED = r"(?i)(?:answer)[\s:]+([-+]?\d*\.?\d+)"
EQUALS_SIGNED = r"(?i)(?:is|equals?|=\s*)([-+]?\d*\.?\d+)\s*$"
ANSWER_DIGITS = r"(?i)(?:answer)[\s:]+(\d+)"
EQUALS_DIGITS = r"(?i)(?:is|equals?|=\s*)(\d+)\s*$"
CODE_LINE = r"(?s)```(?:python)?\n(.*?)```"
CODE_LOOSE = r"(?s)```(?:python)?\s*(.*?)\s*```"
DEFINITION = r"(?s)(def\s+\w+\([^)]*\):.*?)(?=\n\ndef\s+|\z)"


def math_answer(c: Column) -> Column:
    """Boxed, else the last number after a keyword, else the last number; null without any."""
    c = F.coalesce(c, F.lit(""))
    boxed = F.when(F.rlike(c, F.lit(BOXED)), strip(F.regexp_extract(c, BOXED, 1)))
    return F.coalesce(boxed, _cascade(F.regexp_extract(c, BOXED_WORD, 1), _last(c, ANSWER_SIGNED, 1), _last(c, EQUALS_SIGNED, 1), _last(c, SIGNED, 0)))


def contest_answer(c: Column, most: int = 999) -> Column:
    """The last digits of the box (or all of it), else those after a keyword, else the last
    integer of 0 to ``most``; null without any."""
    c = F.coalesce(c, F.lit(""))
    inside = strip(F.regexp_extract(c, BOXED, 1))
    boxed = F.when(F.rlike(c, F.lit(BOXED)), F.coalesce(_last(inside, r"\d+", 0), inside))
    small = F.filter(F.regexp_extract_all(c, F.lit(r"(?U)\b(\d+)\b"), F.lit(1)), lambda x: F.coalesce(x.try_cast("decimal(38,0)") <= most, F.lit(False)))
    return F.coalesce(boxed, _cascade(F.regexp_extract(c, BOXED_DIGITS, 1), _last(c, ANSWER_DIGITS, 1), _last(c, EQUALS_DIGITS, 1), F.try_element_at(small, F.lit(-1))))


def choice_letter(c: Column) -> Column:
    """A to D: alone, in brackets, after a label, else the first anywhere; null without any."""
    up = F.upper(strip(F.coalesce(c, F.lit(""))))
    tries = [r"(?U)\b([ABCD])\b", r"\(([ABCD])\)", r"\[([ABCD])\]", r"答案[：:]\s*([ABCD])", r"ANSWER[：:]\s*([ABCD])", r"([ABCD])"]
    return _cascade(*[F.regexp_extract(up, t, 1) for t in tries])


def option_letter(c: Column, options: Column | None = None) -> Column:
    """A letter alone, in brackets or after a label that is one of the options' (of A to D if
    they aren't given); a letter beyond them doesn't count, and the next place is tried."""
    up = F.upper(strip(F.coalesce(c, F.lit(""))))
    n = F.lit(4) if options is None else F.when(F.size(options) > 0, F.size(options)).otherwise(4)
    tries = [r"(?U)\b([A-Z])\b", r"\(([A-Z])\)", r"\[([A-Z])\]", r"答案[：:]\s*([A-Z])", r"ANSWER[：:]\s*([A-Z])", r"选择[：:]\s*([A-Z])"]
    found = [F.regexp_extract(up, t, 1) for t in tries]
    return F.coalesce(*[F.when((x != "") & (F.ascii(x) - 64 <= n), x) for x in found])


def code_block(c: Column, loose: bool = False) -> Column:
    """A fenced block's code, else the first function definition, else the whole, stripped; null
    for blank text. ``loose`` lets any white space follow the opening fence."""
    c = F.coalesce(c, F.lit(""))
    fence = CODE_LOOSE if loose else CODE_LINE
    fenced = F.when(F.rlike(c, F.lit(fence)), strip(F.regexp_extract(c, fence, 1)))
    defined = F.when(F.rlike(c, F.lit(DEFINITION)), strip(F.regexp_extract(c, DEFINITION, 1)))
    return F.coalesce(fenced, defined, falsy(strip(c)))


def marked_code(c: Column, begin: str = "[BEGIN]", end: str = "[DONE]") -> Column:
    """The code before ``end``, without a leading ``begin``; null for null."""
    cut = strip(F.substring_index(strip(c), end, 1))
    cut = F.when(F.startswith(cut, F.lit(begin)), strip(F.substr(cut, F.lit(len(begin) + 1)))).otherwise(cut)
    return F.when(c.isNotNull(), code_block(cut, loose=True))


def text_after(c: Column, marker: str = "Answer: ") -> Column:
    """Stripped text after the first marker up to the next; null without one."""
    return strip(F.get(F.split(c, rf"\Q{marker}\E"), F.lit(1)))


def redact(names: list[str], secret: tuple[str, ...] = ("key", "token", "password", "secret")) -> list[str]:
    """The column names that hold no secret."""
    return [n for n in names if not any(s in n.lower() for s in secret)]


def clean_model_name(c: Column, prefix: str) -> Column:
    """A model's name without ``prefix``: where it heads the name or a path's part and ``-`` or
    ``/`` follows, or heads the name alone. Repeated and leading slashes go; a name of nothing
    else stays."""
    p = rf"\Q{prefix}\E"
    out = F.regexp_replace(c, rf"(?i)(^|/){p}-", "$1")
    out = F.regexp_replace(out, rf"(?i)(^|/){p}/", "$1")
    out = F.regexp_replace(out, rf"(?i)^{p}(?![-/])", "")
    out = F.regexp_replace(out, "/+", "/")
    out = F.when(F.length(out) > 1, F.regexp_replace(out, "^/", "")).otherwise(out)
    return F.coalesce(falsy(out), c)

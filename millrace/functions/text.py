"""Text functions: code blocks, identifiers, error messages, prompt parts. All are column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = r"^[\s ﻿]+|[\s ﻿]+$"
#: The dialect flags make dots, line ends and classes behave as in most scripting languages: only \n ends a line.
_TICKS = "`{3}"
_FENCED, _BARE = (rf"(?sdU){_TICKS}{tag}\s*\n(.*?){_TICKS}" for tag in ("python", ""))
_FIRST_CODE_LINE = r"(?dmsU)^[^\S\n]*(?:from|import|class|def) [^\n]*\S.*"
_QUOTE = "[\"']"
_ID = rf"backtestId{_QUOTE}?\s*(?:=|:)\s*{_QUOTE}(\p{{XDigit}}+){_QUOTE}"
#: A message is what follows such a mark and blanks or colons, up to the end of the line.
_MESSAGES = tuple(rf"(?idU){mark}[\s:]+([^\n]+)" for mark in ("error", r"CS\d+", r"line \d+"))
CODE_HINTS = ("import ", "from ", "def ", "class ")
NO_ERROR_TEXT = "Compilation failed - no specific error extracted"
NO_ERROR_LIST = "Unknown compile error"
NO_INFO = "No additional info"


def strip(text: Column) -> Column:
    """text without white space at its ends (trim() takes blanks only)."""
    return F.regexp_replace(text, _SPACE, "")


def contains_any(text: Column, parts: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for p in parts:
        found = found | text.contains(p)
    return found


def looks_like_code(text: Column) -> Column:
    return contains_any(text, CODE_HINTS)


def extract_code(text: Column, markers: tuple[str, ...]) -> Column:
    """The program in a reply: the first python fence, even an empty one; else the first bare fence if it looks like code;
    else all from the first line that begins like code, if a platform marker is in it; else null."""
    bare = strip(F.regexp_extract(text, _BARE, 1))
    loose = strip(F.regexp_extract(text, _FIRST_CODE_LINE, 0))
    return (
        F.when(text.rlike(_FENCED), strip(F.regexp_extract(text, _FENCED, 1)))
        .when(text.rlike(_BARE) & looks_like_code(bare), bare)
        .when((loose != "") & contains_any(loose, markers), loose)
    )


def backtest_id(text: Column) -> Column:
    """The first quoted hexadecimal value after the name backtestId; null if there is none."""
    return F.nullif(F.regexp_extract(text, _ID, 1), F.lit(""))


def ordered_distinct(items: Column) -> Column:
    """Stripped non-empty items, each where it first occurs."""
    return F.array_distinct(F.filter(F.transform(items, strip), lambda x: x.isNotNull() & (x != "")))


def error_messages(text: Column) -> Column:
    """Messages that the patterns find, pattern by pattern; overlapping finds stay."""
    return ordered_distinct(F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in _MESSAGES]))


def with_default(items: Column, message: str) -> Column:
    """items, or the message alone where there are none."""
    return F.when(F.coalesce(F.size(items), F.lit(0)) < 1, F.array(F.lit(message))).otherwise(items)


def bullets(items: Column, most: int = 10) -> Column:
    """The first items as lines that begin with a dash."""
    return F.array_join(F.transform(F.slice(items, 1, most), lambda x: F.concat(F.lit("  - "), x)), "\n")


def preview(items: Column, most: int = 3) -> Column:
    """The first items in one line, with dots if there are more."""
    return F.concat(F.array_join(F.slice(items, 1, most), ", "), F.when(F.size(items) > most, "...").otherwise(""))


def shortened(text: Column, most: int, dots: str = "...") -> Column:
    """The first characters of a text, with dots if there are more; an empty text for null."""
    whole = F.coalesce(text, F.lit(""))
    return F.concat(F.substring(whole, 1, most), F.when(F.length(whole) > most, dots).otherwise(""))


def section(title: str, lines: tuple[str, ...]) -> str:
    """A titled, numbered list and an empty line; nothing if there are no lines."""
    return "".join([f"{title}:\n", *[f"{i}. {line}\n" for i, line in enumerate(lines, 1)], "\n"]) if lines else ""


def code_prompt(spec: Column, reference: str = "") -> Column:
    """reference: a text on the programming interface, which goes before the specification, if there is one."""
    return F.concat(F.lit(section("Interface", (reference,) if reference else ()) + "Write the algorithm for this specification:\n\n"), spec)


def retry_prompt(code: Column, errors: Column, reference: str = "", fixes: tuple[str, ...] = ()) -> Column:
    """The first errors, the program, and what is known about the interface and common fixes, where that is given."""
    known = section("\n\nInterface", (reference,) if reference else ()) + section("\n\nCommon fixes", fixes)
    return F.concat(F.lit("The build failed with:\n"), bullets(with_default(errors, NO_ERROR_LIST)), F.lit("\n\nRepair this program:\n\n"), code, F.lit(known))


def zero_trades_prompt(code: Column, info: Column, causes: tuple[str, ...] = (), fixes: tuple[str, ...] = ()) -> Column:
    """The report, the program, and likely causes and needed fixes, where these are given."""
    head = "The program made no trades. " + section("Likely causes", causes) + "Run report:\n"
    return F.concat(F.lit(head), F.coalesce(F.nullif(info, F.lit("")), F.lit(NO_INFO)), F.lit("\n\nRevise this program:\n\n"), code, F.lit(section("\n\nNeeded", fixes)))


def execution_prompt(code: Column, name: Column, project_id: Column) -> Column:
    """Goes by whether a project is there already."""
    there = F.coalesce(project_id, F.lit("")) != ""
    return F.concat(F.when(there, F.concat(F.lit("Use project "), project_id)).otherwise(F.concat(F.lit("Create project "), name)), F.lit(" and run:\n\n"), code)

"""Plain text and named sections of wiki pages: one lexer, a stack of open templates and links, one scan of section marks."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What the lexer tells apart, the first that fits; everything between two of these is text.
_LEXER = re.compile(
    r"(?P<hidden><!--[\s\S]*?-->|<noinclude>[\s\S]*?</noinclude>|<ref[^>]*/>|<ref[\s\S]*?</ref>)"
    r"|(?P<newline><br\s*/?>)|(?P<tag><[^>]+>)|(?P<open>\{\{)|(?P<close>\}\})|(?P<link>\[\[)|(?P<unlink>\]\])|(?P<bar>\|)|(?P<emphasis>'{2,3})|(?P<blank>&nbsp;)"
)
_NAMED = re.compile(r"\s*[\w-]+\s*=")
_BLANKS = re.compile("[ \t\u00a0]+")
# Broken vowel sign of scans; characters that are never shown.
_SCANNED = str.maketrans({"\ufeff": "", "\u200b": ""})
_BROKEN_SIGN = ("\u09be\u09c7", "\u09cb")


@dataclass(frozen=True)
class TemplateRules:
    """What templates stand for. Their names, compared in small letters.

    blank: names that begin so are one blank; margin: the last argument and a blank, a word set out in the margin;
    nothing: dropped with its arguments; heading: dropped where its argument is a number; newline: names that
    begin so are a line end. Any other template is its last unnamed argument, without arguments it is nothing.
    """

    blank: tuple[str, ...] = ("gap", "em", "nbsp", "ফাঁক")
    margin: tuple[str, ...] = ("overfloat left",)
    nothing: tuple[str, ...] = ("rh",)
    heading: tuple[str, ...] = ("c",)
    newline: tuple[str, ...] = ()

    def value(self, parts: list[str]) -> str:
        name = parts[0].strip().lower()
        unnamed = [p for p in parts[1:] if not _NAMED.match(p)]
        last = unnamed[-1] if unnamed else ""
        if self.newline and name.startswith(self.newline):
            return "\n"
        if name.startswith(self.blank):
            return " "
        if name in self.nothing or (name in self.heading and last.strip().isdecimal()):
            return ""
        return last + " " if name in self.margin else last


@dataclass
class _Open:
    """A template or link that is not closed yet; the page itself is the lowest one."""

    kind: str
    parts: list[list[str]] = field(default_factory=lambda: [[]])

    def put(self, text: str) -> None:
        self.parts[-1].append(text)

    def texts(self) -> list[str]:
        return ["".join(p) for p in self.parts]

    def left_open(self) -> str:
        """Text of something that is never closed: a link as typed, a template without its name."""
        name, *rest = self.texts()
        if self.kind == "link":
            return "[[" + "|".join([name, *rest])
        end = name.find("\n")
        return (name[end:] if end >= 0 else "") + ("|" if end >= 0 and rest else "") + "|".join(rest)


def _expanded(text: str, rules: TemplateRules) -> str:
    stack = [_Open("page")]

    def close(kind: str) -> bool:
        """Takes down to the latest open one of this kind; what stands open above it is text."""
        if all(o.kind != kind for o in stack):
            return False
        while stack[-1].kind != kind:
            inner = stack.pop().left_open()
            stack[-1].put(inner)
        done = stack.pop().texts()
        stack[-1].put(rules.value(done) if kind == "template" else "|".join(done[1:] or done))
        return True

    at = 0
    for m in _LEXER.finditer(text):
        stack[-1].put(text[at : m.start()])
        at = m.end()
        kind = m.lastgroup
        if kind == "newline":
            stack[-1].put("\n")
        elif kind == "blank":
            stack[-1].put(" ")
        elif kind in ("open", "link"):
            stack.append(_Open("template" if kind == "open" else "link"))
        elif kind == "close":
            close("template")
        elif kind == "unlink" and not close("link"):
            stack[-1].put("]]")
        elif kind == "bar":
            if stack[-1].kind == "page":
                stack[-1].put("|")
            else:
                stack[-1].parts.append([])
    stack[-1].put(text[at:])
    while len(stack) > 1:
        inner = stack.pop().left_open()
        stack[-1].put(inner)
    return "".join(stack[0].parts[0])


def strip_markup(text: str, rules: TemplateRules = TemplateRules()) -> str:
    """Plain lines of a page: comments, references, tags and emphasis out, templates by ``rules``, links by their label.

    Blanks are joined and stripped with colons at both ends of a line; two blank lines and more become one; numbers that
    stand alone on the first lines are left out. Templates nest to any depth and are expanded in one pass.
    """
    lines: list[str] = []
    for line in _expanded(text.translate(_SCANNED).replace(*_BROKEN_SIGN), rules).split("\n"):
        line = _BLANKS.sub(" ", line).strip(" :")
        if line or (lines and lines[-1]):
            lines.append(line)
    while lines and not lines[-1]:
        lines.pop()
    start = 0
    while start < len(lines) - 1 and (not lines[start] or lines[start].isdecimal()):
        start += 1
    return "\n".join(lines[start:]).strip()


@F.pandas_udf(T.StringType())
def clean_markup(values: pd.Series) -> pd.Series:
    """``strip_markup`` over Arrow batches: nested templates have no bound, so no chain of replacements is enough."""
    return values.map(lambda v: strip_markup(v) if isinstance(v, str) else None)


_RULED = TemplateRules(newline=("rule",))


@F.pandas_udf(T.StringType())
def clean_page(values: pd.Series) -> pd.Series:
    """``strip_markup`` of pages of lines, on which a drawn rule ends a line."""
    return values.map(lambda v: strip_markup(v, _RULED) if isinstance(v, str) else None)


_SECTION_MARK = re.compile(r'<section (?P<kind>begin|end)="?(?P<name>[^"<>]*?)"?\s*/>|(?m:^##\s*(?P<heading>[^#\n]+?)\s*##\s*$)')


def section_of(text: str, begin: str | None, end: str | None) -> str:
    """The part of a page between two named sections, marked by tags or by '## name ##' lines; a null name is the page's edge.

    A tag goes before a heading of the same name; a section under a heading ends at the next heading. A name that the page lacks is the page's edge too.
    """
    starts: dict[str, int] = {}
    headed: dict[str, int] = {}
    ends: list[tuple[str, int]] = []
    next_heading: dict[str, int] = {}
    waiting: list[str] = []
    for m in _SECTION_MARK.finditer(text):
        if m["heading"] is not None:
            for name in waiting:
                next_heading[name] = m.start()
            waiting = [m["heading"]] if m["heading"] not in headed else []
            headed.setdefault(m["heading"], m.end())
        elif m["kind"] == "begin":
            starts.setdefault(m["name"], m.end())
        else:
            ends.append((m["name"], m.start()))
    start = starts.get(begin, headed.get(begin, 0)) if begin else 0
    if not end:
        return text[start:]
    tagged = next((at for name, at in ends if name == end and at >= start), None)
    return text[start : next_heading.get(end, len(text)) if tagged is None else tagged]


@F.pandas_udf(T.StringType())
def section_text(texts: pd.Series, begins: pd.Series, ends: pd.Series) -> pd.Series:
    return pd.Series([section_of(t, b if isinstance(b, str) else None, e if isinstance(e, str) else None) if isinstance(t, str) else None for t, b, e in zip(texts, begins, ends)], dtype=object)

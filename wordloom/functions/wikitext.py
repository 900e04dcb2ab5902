"""Plain text of wiki mark-up: templates, tables, notes and files go, however they are nested; links leave their labels.

The mark-up is read once, with a stack of what is open; most of what is closed as it was opened needs no place there. A closing mark closes the nearest of its kind; what was opened inside it and not closed
counts as text. A closing mark without an opening one is dropped.
"""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What is closed as it was opened and has no open marks inside is read in one step: links, templates, parameters, and those around them. After the last brace
#: of a template there is none or at least two, as one more would belong to the same mark.
_TEXT, _RUN = r"[^{}\[\]<>]", r"(?!\}(?!\}))"
_LINK, _PARAMETER, _INNER = rf"\[\[{_TEXT}*+\]\]", rf"\{{\{{\{{{_TEXT}*+\}}\}}\}}", rf"\{{\{{{_TEXT}*+\}}\}}"
_TEMPLATE = rf"\{{\{{(?:{_TEXT}++|{_LINK}|{_INNER}|{_PARAMETER})*+\}}\}}"
_INSIDE = rf"{_TEXT}++|{_LINK}|{_TEMPLATE}|{_PARAMETER}"
_CELLS = rf"[^{{}}\[\]<>|]++|\|(?!\}})|{_LINK}|{_TEMPLATE}|{_PARAMETER}"
_TABLE = rf"\{{\|(?:{_CELLS})*+\|\}}(?!\}})"
_GONE = rf"<!--.*?(?:-->|\Z)|(?:{_TEMPLATE}|{_PARAMETER}){_RUN}|<ref>(?:{_INSIDE})*+</ref>|\{{\|(?:{_CELLS}|{_TABLE})*+\|\}}(?!\}})|\[\[\s*+[^\W\d_][\w ]*+:(?:{_INSIDE})*+\]\]"
MARKS = re.compile(rf"({_GONE})|\[\[({_TEXT}*+)\]\]|<nowiki>(.*?)</nowiki>|\{{{{2,}}|\}}{{2,}}|\{{\||\|\}}(?!\}})|\[\[|\]\]|<(/?)([A-Za-z][A-Za-z0-9]*)([^>]*)>", re.S | re.I)
#: Elements that go with their content.
DROPPED = frozenset("ref references math gallery timeline score syntaxhighlight source imagemap hiero chem table".split())
EXTERNAL = re.compile(r"\[(?:https?:)?//[^\s\]]+(?:[ \t]+([^\]\n]*))?\]")
QUOTES = re.compile("'{2,}")
HEADING = re.compile(r"^(={1,6})[ \t]*(.*?)[ \t]*\1[ \t]*$", re.M)
ITEM = re.compile(r"^[*#:;]+[ \t]*|^-{4,}", re.M)
MAGIC = re.compile(r"__[A-Z]+__")
NAMESPACE = re.compile(r"[^\W\d_][\w ]*:")
BAR = object()


class Frame:
    __slots__ = ("kind", "parts")

    def __init__(self, kind: str):
        self.kind = kind
        self.parts: list = []


def opened(run: int) -> list[str]:
    """Templates and parameters that so many braces open: parameters have three."""
    return ["template"] * ((run - 3) // 2) + ["parameter"] if run % 2 else ["template"] * (run // 2)


def label(parts: list) -> str:
    """What a link leaves: its last part, or nothing for files, categories and other pages of a namespace."""
    pieces: list[list[str]] = [[]]
    for p in parts:
        if p is BAR:
            pieces.append([])
        else:
            pieces[-1].append(p)
    target = "".join(pieces[0]).strip()
    if NAMESPACE.match(target):
        return ""
    return "".join(pieces[-1]) if len(pieces) > 1 else target.removeprefix(":")


def plain(source: str) -> str:
    """The text, with lines as they were; empty lines at the ends go."""
    stack = [Frame("page")]

    def put(text: str) -> None:
        stack[-1].parts.append(text)

    def source_text(text: str) -> None:
        """Only bars right inside a link part something."""
        if stack[-1].kind == "link" and "|" in text:
            head, *tail = text.split("|")
            put(head)
            for piece in tail:
                stack[-1].parts += BAR, piece
        else:
            put(text)

    def literal(frame: Frame) -> None:
        """An open frame that nothing closes."""
        for p in frame.parts:
            put("|" if p is BAR else p)

    def close(kind: str) -> bool:
        """Close the nearest frame of a kind; False without one."""
        at = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].kind == kind), 0)
        if not at:
            return False
        while len(stack) - 1 > at:
            literal(stack.pop())
        frame = stack.pop()
        if kind == "link":
            put(label(frame.parts))
        return True

    end = 0
    for m in MARKS.finditer(source):
        if end < m.start():
            source_text(source[end : m.start()])
        end = m.end()
        if m[1] is not None:
            continue
        if m[2] is not None:
            put(label([x for piece in m[2].split("|") for x in (BAR, piece)][1:]))
            continue
        if m[3] is not None:
            put(m[3])
            continue
        mark = m.group()
        if mark[0] == "{":
            stack.extend(Frame(kind) for kind in (["table"] if mark == "{|" else opened(len(mark))))
        elif mark[0] == "}":
            left = len(mark)
            while left >= 2:
                inner = next((f.kind for f in reversed(stack) if f.kind in ("template", "parameter")), "")
                size = 3 if left >= 3 and inner == "parameter" else 2
                if not close("parameter" if size == 3 else "template"):
                    break
                left -= size
        elif mark == "|}":
            if not close("table"):
                source_text(mark)
        elif mark == "[[":
            stack.append(Frame("link"))
        elif mark == "]]":
            close("link")
        else:
            tag = m[5].lower()
            if tag in DROPPED:
                if m[4]:
                    close(f"<{tag}")
                elif not m[6].rstrip().endswith("/"):
                    stack.append(Frame(f"<{tag}"))
            elif tag == "br":
                put("\n")
    source_text(source[end:])
    while len(stack) > 1:
        literal(stack.pop())
    text = "".join(p for p in stack[0].parts if p is not BAR)
    text = EXTERNAL.sub(lambda m: m[1] or "", text)
    text = ITEM.sub("", HEADING.sub(r"\2", MAGIC.sub("", QUOTES.sub("", text))))
    return html.unescape(text).strip("\n")


def plain_text(markup: Column) -> Column:
    """plain in Arrow batches; null stays null."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(plain, na_action="ignore")

    return run(markup)

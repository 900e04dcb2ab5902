"""Operators that need a state machine over characters: emoticons, spacing and the pipelines built on them, in Arrow batches.

The spacing rules work on marks, not on buffers: every character gets a flag that says whether a token starts before it. A small table of
character classes and states decides the flags; a point or comma at the end of a number or word is held as an index, so that its flag can still
be set when the next character is known.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import LENGTHENING, MARKS_FIRST, MARKS_LAST, SIMILAR, WORD_ENTITIES
from .text import moses_french as plain_moses_french

# Emoticons (each ends with a space) and the emoji they stand for.
EMOTICONS = {
    ":-) ": "🙂", ":) ": "🙂", ":-)) ": "🙂", ":)) ": "🙂",
    ":‑D ": "😀", ":D ": "😀", ":‑d ": "😀", ":d ": "😀",
    "x‑D ": "😆", "X‑D ": "😆", "xD ": "😆", "XD ": "😆",
    ":‑( ": "🙁", ":( ": "🙁",
    ':"‑) ': "😂", ':") ': "😂",
    ">:( ": "😠",
    ":-O ": "😮", ":-o ": "😮", ":O ": "😮", ":o ": "😮",
    ":‑3 ": "😸", ":3 ": "😸",
    ">:‑3 ": "😾", ">:3 ": "😾",
    ":-* ": "😗", ":* ": "😗", ":x ": "😗",
    ";-) ": "😉", ";) ": "😉",
    ";-P ": "😜", ";P ": "😜", ";-D ": "😜", ";D ": "😜",
    ";‑) ": "😉", "*-) ": "😉", "*) ": "😉",
    ":-P ": "😝", ":P ": "😝", ":-p ": "😝", ":p ": "😝",
    ":/ ": "😕", ":-/ ": "😕",
    ":| ": "😐", ":-| ": "😐",
    ":$ ": "😳",
    "://) ": "😔",
    "://3 ": "😖",
    ":-X ": "🤐", ":X ": "🤐", ":-# ": "🤐", ":# ": "🤐",
    "O:-) ": "😇", "O:) ": "😇",
    ">:‑) ": "😈", "3:‑) ": "😈", "3:) ": "😈",
    "B-) ": "😎", "|:) ": "😎",
    "<3 ": "❤️", "</3 ": "💔", "<\x03 ": "💔",
    "(>_<) ": "😣", ">_< ": "😣",
    "(X_X) ": "😵", "(x_x) ": "😵", "X_X ": "😵", "x_x ": "😵",
    "(O_O) ": "😳", "(o_o) ": "😳", "O_O ": "😳", "o_o ": "😳",
    "^^ ": "😄", "(^^) ": "😄", "^_^ ": "😄", "(^_^) ": "😄",
    "^^; ": "😅", "(^^;) ": "😅", "^_^; ": "😅", "(^_^;) ": "😅",
}

# Blocks of symbols, and punctuation that stands apart from words.
SYMBOL_RANGES = ((9984, 10175), (128512, 128591), (9728, 9983), (127744, 128511), (129648, 129782), (129280, 129535), (8192, 8303), (128640, 128764), (127232, 127487), (65039, 65039))
APART = "°\n!\"<>$%=&':()*+-,;[]^`{\\|}~/?؛،؟"
FLAG_LETTERS, SKIN_TONES = (127462, 127487), (127995, 127999)
JOINER, SELECTOR = "‍", "️"

_PREFIXES = {text[:n] for text in EMOTICONS for n in range(1, len(text) + 1)}
_SIMILAR = str.maketrans({c: group[0] for group in SIMILAR for c in group[1:]})
_MARKS = {*map(chr, range(MARKS_FIRST, MARKS_LAST + 1)), chr(LENGTHENING)}
_ENTITIES = [(re.compile(p), name) for p, name in WORD_ENTITIES]
_WEB_START = re.compile(r"http|htt.|ht.|h.", re.DOTALL)


def emoticons(elements: Iterable[str]) -> list[str]:
    """Replace emoticons by emoji. When a longer one fails, what was read of it is not read again."""
    out: list[str] = []
    read, meaning, rest = "", "", []
    for e in elements:
        if read + e not in _PREFIXES:
            out += [meaning, *rest] if meaning else rest
            read, meaning, rest = "", "", []
            if e not in _PREFIXES:
                out.append(e)
                continue
        read += e
        if read in EMOTICONS:
            meaning, rest = EMOTICONS[read], []
        else:
            rest.append(e)
    return out + ([meaning, *rest] if meaning else rest)


def kind(e: str) -> str:
    """digit, point, comma, flag letter, joiner or selector, skin tone, symbol, or other (by the first code point)."""
    code = ord(e[0])
    if e in "0123456789":
        return "digit"
    if e in (".", ","):
        return {".": "point", ",": "comma"}[e]
    if FLAG_LETTERS[0] <= code <= FLAG_LETTERS[1]:
        return "flag"
    if e in (JOINER, SELECTOR):
        return "join"
    if SKIN_TONES[0] <= code <= SKIN_TONES[1]:
        return "tone"
    return "symbol" if e[0] in APART or any(a <= code <= b for a, b in SYMBOL_RANGES) else "other"


#: What a state ends with that a joiner or skin tone may attach to.
_ATTACH = {"symbol", "joined", "toned", "flag", "number,"}


def _web_tail(part: list[str]) -> int:
    """Where the text after http begins, from which nothing is spaced any more; the part's length without one."""
    flat = "".join(e if len(e) == 1 else "\0" for e in part)
    return next((m.end() for m in _WEB_START.finditer(flat) if m.group() == "http"), len(part))


def space_part(part: list[str]) -> list[str]:
    """Tokens of elements without blanks."""
    tail = _web_tail(part)
    kept: list[str] = []
    starts: list[bool] = []
    state, held, size = "start", 0, 0  # held: index of a point or comma at the end; size: elements of the pending number

    def put(e: str, start: bool) -> None:
        kept.append(e)
        starts.append(start)

    def settle() -> None:
        """A held point or comma becomes a token of its own."""
        if state in ("point", "first point", "number,"):
            starts[held] = True

    for e in part[:tail]:
        k = kind(e)
        if k == "digit":
            if state in ("number", "number,", "point", "first point"):
                size = size + 1 if state in ("number", "number,") else 2 if state == "point" else 3
                put(e, False)
            else:
                size = 1
                put(e, state != "open")
            state = "number"
        elif k == "point":
            if state in ("point", "first point"):
                starts[held] = True
                put(e, False)
                state = "start"
            else:
                held = len(kept)
                put(e, state == "start")
                state = "first point" if state == "start" else "point"
        elif k == "comma":
            if state == "number":
                held, size = len(kept), size + 1
                put(e, False)
                state = "number,"
            else:
                settle()
                put(e, True)
                state = "start"
        elif k == "flag":
            if state == "flag":
                put(e, False)
                state = "start"
            else:
                settle()
                put(e, True)
                state = "flag"
        elif k in ("join", "tone"):
            if state in _ATTACH:
                put(e, False)
                state = "joined" if e == JOINER else "toned"
        elif k == "symbol":
            settle()
            put(e, state != "joined")
            state = "symbol"
        else:
            put(e, not (state in ("open", "point") or (state == "number" and size < 3)))
            state = "open"
    if tail == len(part):
        settle()
    for e in part[tail:]:
        put(e, False)
    out: list[str] = []
    for e, start in zip(kept, starts, strict=True):
        if start or not out:
            out.append(e)
        else:
            out[-1] += e
    return out


def space(elements: Iterable[str]) -> list[str]:
    """Tokens of a sequence of characters: words, numbers, symbols and line feeds apart."""
    out: list[str] = []
    part: list[str] = []
    for e in [*elements, " "]:
        if e in (" ", "\n"):
            out += space_part(part) if part else []
            out += ["\n"] if e == "\n" else []
            part = []
        elif e:
            part.append(e)
    return out


def squeeze(elements: Iterable[str], most: int = 2) -> list[str]:
    """At most max(1, most) equal neighbours; pieces of "0123456789" are exempt and end a run."""
    out: list[str] = []
    last, times = None, 0
    for e in elements:
        if e in "0123456789":
            last, times = None, 0
            out.append(e)
            continue
        last, times = e, times + 1 if e == last else 1
        if times <= max(1, most):
            out.append(e)
    return out


def blank_split(tokens: Iterable[str]) -> list[str]:
    return [x for t in tokens for x in re.split("[ \t]", t) if x]


def tag(token: str) -> str:
    for pattern, name in _ENTITIES:
        token = pattern.sub(name, token)
    return token


def preprocess(text: str, emoticon: bool = True, similar: bool = True, char_dup: int = 2, spacing: bool = True, word_dup: int = 2) -> list[str]:
    """Tokens of a text by the stages asked for; 0 turns a limit on repeats off."""
    elements: list[str] = emoticons(text) if emoticon else list(text)
    if similar:
        elements = [e.translate(_SIMILAR) if len(e) == 1 else e for e in elements]
    if char_dup:
        elements = squeeze(elements, char_dup)
    tokens = blank_split(space(elements)) if spacing else blank_split(["".join(elements)])
    return squeeze(tokens, word_dup) if word_dup else tokens


#: Parts and tokens whose results a Python worker keeps, at most; it starts anew beyond.
MEMO_LIMIT = 1 << 17
_EMOTICON = re.compile("|".join(re.escape(x) for x in sorted(EMOTICONS, key=len, reverse=True)))
_REPEATS = re.compile(r"([^0-9])\1{2,}", re.DOTALL)


class Memo(dict):
    """Results of a function, kept up to MEMO_LIMIT."""

    def __init__(self, f: Callable[[str], object]):
        super().__init__()
        self.f = f

    def __missing__(self, key: str) -> object:
        if len(self) >= MEMO_LIMIT:
            self.clear()
        self[key] = out = self.f(key)
        return out


def _unmarked(tokens: Iterable[str]) -> list[str]:
    return [y for t in tokens if (y := "".join(c for c in t if c not in _MARKS))]


_PLAIN = re.compile("([A-Za-zÀ-ÿ]+)([.,]?)")


def _part_tokens(part: str) -> list[str]:
    """As space_part, with a short way for a plain word."""
    if (m := _PLAIN.fullmatch(part)) and "http" not in part:
        return [x for x in m.groups() if x]
    return space_part(list(part))


_PARTS = Memo(lambda part: blank_split(_part_tokens(part)))
_UNMARKED_PARTS = Memo(lambda part: blank_split(_unmarked(_part_tokens(part))))
_TAGS = Memo(lambda token: token.lower() if token.isalpha() else tag(token.lower()))  # no tag is of letters alone


def _spaced(text: str, parts: Memo) -> list[str]:
    """Tokens of a text without emoticons: no rule but squeezing looks beyond a part without blanks, so each distinct part is spaced once."""
    flat = _REPEATS.sub(r"\1\1", text.translate(_SIMILAR))
    out: list[str] = []
    for i, line in enumerate(flat.split("\n")):
        if i:
            out.append("\n")
        for part in line.split(" "):
            if part:
                out += parts[part]
    return out


def notag(text: str) -> str:
    """Emoticons, similar characters, repeats and spacing; tokens joined by a space."""
    if _EMOTICON.search(text):
        return " ".join(preprocess(text))
    return " ".join(squeeze(_spaced(text, _PARTS)))


def tagged(text: str) -> str:
    """As notag, without Arabic marks, in lower case, with entities as tags."""
    if _EMOTICON.search(text):
        elements = squeeze([e.translate(_SIMILAR) if len(e) == 1 else e for e in emoticons(text)])
        tokens = blank_split(_unmarked(space(elements)))
    else:
        tokens = _spaced(text, _UNMARKED_PARTS)
    return " ".join(map(_TAGS.__getitem__, squeeze(tokens)))


def _strings(f: Callable[[str], str]) -> Callable[[Column], Column]:
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(f, na_action="ignore")

    return run


def notag_normalize(text: Column) -> Column:
    return _strings(notag)(text)


def tag_normalize(text: Column) -> Column:
    return _strings(tagged)(text)


def nfc(text: Column) -> Column:
    """Unicode normal form C, for which Spark has no function. ASCII text is in it, so it stays out of Python."""
    other = F.when(text.rlike("[^\\x00-\\x7F]"), text)
    return F.coalesce(_strings(lambda x: unicodedata.normalize("NFC", x))(other), text)


def moses_french(text: Column) -> Column:
    """text.moses_french of the normal form C."""
    return plain_moses_french(nfc(text))


def compared_starts(pieces: Column, words: Column, normalise: Callable[[str], str] = str.lower) -> Column:
    """Booleans: does a piece begin the next word? Words are taken one after another; a piece (without its </w>) that the normalised word begins with, or an
    unknown one, begins it. Pieces after the last word begin none. A null on either side gives null."""

    @F.pandas_udf("array<boolean>")
    def run(p: pd.Series, w: pd.Series) -> pd.Series:
        def starts(own: list[str] | None, text: list[str] | None) -> list[bool] | None:
            if own is None or text is None:
                return None
            out, at = [], 0
            for piece in own:
                hit = at < len(text) and (piece == "<unk>" or normalise(text[at]).startswith(piece.removesuffix("</w>")))
                out.append(hit)
                at += hit
            return out

        return pd.Series([starts(a, b) for a, b in zip(p, w, strict=True)], dtype=object)

    return run(pieces, words)


def preprocess_tokens(text: Column, **stages) -> Column:
    """preprocess as a column of token arrays."""

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: preprocess(x, **stages), na_action="ignore")

    return run(text)


def user_operator(f: Callable[[str], list[str]]) -> Callable[[Column], Column]:
    """A function from a text to a list, as an operator on columns of texts (Arrow batches)."""

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(f, na_action="ignore")

    return run

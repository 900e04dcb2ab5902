"""Text operators as native column expressions: all of them stay inside whole-stage code generation.

Every function takes and returns columns. Null texts stay null unless a docstring says otherwise.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tags that replace entities.
URL_TAG, MAIL_TAG, HASH_TAG, NUMBER_TAG, MENTION_TAG, BREAK_TAG = "<url>", "<mail>", "<hash>", "<nbr>", "<tag>", "<break>"

# Characters that look alike; the first of each stands for all.
SINGLE_QUOTES = "'‘’‚‛"
DOUBLE_QUOTES = '"«»“”„‟‹›❛❜❝❞❟❠❮❯⹂〝〞〟＂🙶🙷🙸'
HYPHENS = "-­֊᐀᠆‐‑‧⁃⸗⸚⹀゠﹣－"
DASHES = "‒–—┄┅┈┉╌╍⸻⹃〜〰﹘"
BARS = "|┆┇┊┋╎╏︱"
SPACES = "   "
SIMILAR = (SINGLE_QUOTES, DOUBLE_QUOTES, HYPHENS, DASHES, BARS, SPACES)

# Vowel marks and the lengthening mark of the Arabic script.
MARKS_FIRST, MARKS_LAST, LENGTHENING = 1611, 1630, 1600

# Whole-word entities, in the order in which they are tried.
WORD_ENTITIES = (
    (r"^https?://\w[\w\d.-]*\.\w{2,6}(/[^\s]*)?$", URL_TAG),
    (r"^\d[\d.,]*$", NUMBER_TAG),
    (r"^#.+$", HASH_TAG),
    (r"^.+@.+\..+$", MAIL_TAG),
    (r"^@.+$", MENTION_TAG),
    (r"[\n]", BREAK_TAG),
)

# Wiki and web markup, deleted in this order.
WEB_TAGS = (r"^\[\[[^\]]*(\]\])?$", r"\[\[", r"^=+", r"=+$", r"^[-\.]+", r"\|[^\]]*\]\]", r"\]\]", r"</?\w+[^>]*>")

# Letters and what stands for them in obfuscated words.
LEET = {"i": "1!", "a": "@4", "s": "$5", "o": "0", "e": "3", "t": "7+"}
LEET_BACK = ("1!î@â4$503éè7+", "iiiaaassoeeett")

# Digraphs of Latin-script Arabic and their spelling variants.
ARABIZI = {"7": ["h"], "kh": ["7'", "5"], "ch": ["sh"], "s": ["9"], "t": ["6"], "dh": ["6'"], "gh": ["3'"], "q": ["g"], "ou": ["o", "oo"], "y": ["i"]}

MAX_WORD_SIZE = 30


def chars(text: Column) -> Column:
    """Code points, in order."""
    return F.split(text, "")


def normalize_similar(text: Column) -> Column:
    """Quotes, hyphens, dashes, bars and spaces that look alike become the plain one."""
    pairs = [(c, group[0]) for group in SIMILAR for c in group[1:]]
    return F.translate(text, "".join(a for a, _ in pairs), "".join(b for _, b in pairs))


def squeeze_repeats(text: Column, most: int = 2) -> Column:
    """No character but a digit stands more than max(1, most) times in a row."""
    keep = max(1, most)
    return F.regexp_replace(text, r"(?s)([^0-9])\1{%d,}" % keep, "$1" * keep)


def squeeze_tokens(tokens: Column, most: int = 2) -> Column:
    """The same for equal neighbours of an array; pieces of "0123456789" are exempt and end a run."""
    keep = max(1, most)
    exempt = lambda x: F.instr(F.lit("0123456789"), x) > 0
    tail = lambda a, n: F.slice(a, -n, n)

    def step(kept: Column, x: Column) -> Column:
        enough = F.size(kept) >= keep
        full = F.when(enough, F.forall(tail(kept, keep), lambda y: y == x)).otherwise(False)
        return F.when(exempt(x) | ~full, F.concat(kept, F.array(x))).otherwise(kept)

    return F.aggregate(tokens, F.array().cast("array<string>"), step)


def drop_marks(text: Column, whole: bool = True) -> Column:
    """Delete vowel marks and the lengthening mark. whole=False leaves the last code of the range, as the half-open variant does."""
    last = MARKS_LAST if whole else MARKS_LAST - 1
    return F.regexp_replace(text, f"[{chr(MARKS_FIRST)}-{chr(last)}{chr(LENGTHENING)}]", "")


def delete_all(text: Column, patterns: list[str] | tuple[str, ...]) -> Column:
    """Delete the matches of each pattern, one pattern after the other."""
    return reduce(lambda c, p: F.regexp_replace(c, p, ""), patterns, text)


def tokens(text: Column) -> Column:
    """Parts between spaces and tabs; no empty ones. A line feed is part of a token."""
    return F.filter(split_keep(text), lambda x: x != "")


def split_keep(text: Column) -> Column:
    """Parts between single spaces and tabs, empty ones too."""
    return F.split(text, "[ \t]")


def join(parts: Column, by: str = " ") -> Column:
    """One string; empty parts in front leave no trace, an empty array gives ''."""
    started = F.filter(F.sequence(F.lit(1), F.size(parts)), lambda i: F.element_at(parts, i.cast("int")) != "")
    first = F.coalesce(F.array_min(started), F.size(parts) + 1).cast("int")
    return F.when(F.size(parts) == 0, F.lit("")).otherwise(F.array_join(F.slice(parts, first, F.size(parts)), by))


def tag_word(word: Column) -> Column:
    """A URL, number, hashtag, mail address, mention or line feed becomes its tag. The first pattern that fits decides."""
    return reduce(lambda c, e: F.regexp_replace(c, "(?Ud)" + e[0], e[1]), WORD_ENTITIES, word)


def tag_words(words: Column) -> Column:
    return F.transform(words, tag_word)


def tag_sentence(text: Column) -> Column:
    """URLs and numbers that stand between white space become tags inside a sentence (the intended behaviour; white space stays)."""
    url = F.regexp_replace(text, r"(?U)(?<=^|\s)https?://\w[\w\d.-]*\.\w{2,6}(/\S*)?(?=\s|$)", URL_TAG)
    return F.regexp_replace(url, r"(?U)(?<=^|\s)[+-]?\d[\d.,]*(?=%?\)?(\s|$))", NUMBER_TAG)


def tag_split(text: Column) -> Column:
    """Lower case, without marks, split at single blanks (empty parts stay), entities as tags."""
    return tag_words(split_keep(drop_marks(F.lower(text), whole=False)))


def respace(text: Column) -> Column:
    """Points in a row become one run apart from words, commas stand apart."""
    return F.regexp_replace(F.regexp_replace(text, r"\.{2,}", " .. "), r"\s*,\s*", " , ")


def strip_web_tags(text: Column, unescape: bool = False) -> Column:
    """Delete wiki and web markup. unescape turns the five basic character entities back as well."""
    out = delete_all(text, WEB_TAGS)
    if unescape:
        for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("nbsp", " "), ("amp", "&")):
            out = F.replace(out, F.lit(f"&{name};"), F.lit(char))
    return out


def underscores(text: Column) -> Column:
    return F.regexp_replace(text, "_+", " ")


def sentences(text: Column) -> Column:
    """Sentences end at . ! ? or the Arabic question mark, before white space."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?؟])\s+"), lambda x: F.trim(x)), lambda x: x != "")


def keep_line(line: Column, least: int = 20) -> Column:
    """Long enough, three parts between single spaces at least, no space in front."""
    return (F.char_length(line) >= least) & (F.size(F.split(line, " ")) >= 3) & ~F.startswith(line, F.lit(" "))


def wiki_lines(text: Column) -> Column:
    """Kept sentences of a page: markup gone, blank lines collapsed, cut into sentences, filtered by keep_line."""
    plain = F.regexp_replace(underscores(strip_web_tags(text)), r"\n\s*\n+", "\n")
    return F.filter(F.flatten(F.transform(F.split(plain, "\n"), sentences)), keep_line)


def pad(words: Column, n: int, filler: str = "") -> Column:
    """Exactly n entries: cut, or filled up at the end."""
    return F.slice(F.concat(words, F.array_repeat(F.lit(filler), n)), 1, n)


def clean_tweet(text: Column) -> Column:
    """No URLs, no mentions, white space squeezed."""
    plain = F.regexp_replace(F.regexp_replace(text, r"http\S+|www\S+|https\S+", ""), r"@\w+", "")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def deobfuscate(word: Column) -> Column:
    """Lower case with the letters that signs and digits stand for."""
    return F.trim(F.translate(F.lower(word), *LEET_BACK))


def leet_variants(word: Column) -> Column:
    """All spellings with signs for letters but the word itself; no spelling mixes both signs of a letter."""
    choices = F.create_map(*[F.lit(x) for k, v in LEET.items() for x in (k, ",".join([k, *v]))])
    alternatives = lambda c: F.split(F.coalesce(F.try_element_at(choices, c), c), ",")
    grow = lambda done, c: F.flatten(F.transform(done, lambda x: F.transform(alternatives(c), lambda y: F.concat(x, y))))
    every = F.aggregate(F.filter(F.split(word, ""), lambda c: c != ""), F.array(F.lit("")), grow)
    pure = lambda x: reduce(lambda a, b: a & b, [~(F.contains(x, F.lit(v[0])) & F.contains(x, F.lit(v[1]))) for v in LEET.values() if len(v) > 1])
    return F.array_sort(F.array_distinct(F.filter(every, lambda x: pure(x) & (x != word))))


def arabizi_variants(word: Column) -> Column:
    """The word with the first occurrence of one digraph replaced, once for each rule that applies; sorted."""
    made = []
    for old, news in ARABIZI.items():
        for new in news:
            at = F.instr(word, F.lit(old))
            made.append(F.when(at > 0, F.overlay(word, F.lit(new), at, F.lit(len(old)))))
    return F.when(word.isNotNull(), F.array_sort(F.array_distinct(F.filter(F.array(*made), lambda x: x.isNotNull()))))


def chomp(text: Column) -> Column:
    """Without the line feed at the end, with one space instead, tabs as spaces."""
    return F.concat(F.replace(F.regexp_replace(text, r"\n\z", ""), F.lit("\t"), F.lit(" ")), F.lit(" "))


def drop_words(words: Column, unwanted: list[str]) -> Column:
    """Without the exact words given."""
    return F.filter(words, lambda x: ~x.isin(unwanted)) if unwanted else words


def moses_french(text: Column) -> Column:
    """Quotation marks unified, Unicode punctuation plain, control characters gone, lower case."""
    plain = F.regexp_replace(F.replace(text, F.lit("``"), F.lit('"')), "''", '"')
    plain = F.translate(plain, "，。、”“∶：？《》）！（；１」「０３２５９～’…━〈〉【】％►", ",.,\"\"::?\"\")!(;1\"\"03259~'.-<>[]%-")
    return F.lower(F.regexp_replace(plain, r"\p{C}", ""))


def swap_mask(word: Column) -> Column:
    """Fixed masks use # instead of *."""
    return F.translate(word, "*", "#")


def affix(text: Column) -> Column:
    """An affix without its marker -."""
    return F.replace(text, F.lit("-"), F.lit(""))


def affix_parts(text: Column) -> Column:
    """Trimmed, non-empty parts of a list separated by semicolons."""
    return F.filter(F.transform(F.split(text, ";"), lambda x: F.trim(x)), lambda x: x != "")


def quote_field(text: Column) -> Column:
    """A CSV field: quoted, with quotes doubled, only where it has a quote or a line feed."""
    return F.when(text.rlike('["\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def encode_line(line: Column) -> Column:
    """Base64 of the trimmed line's UTF-8, on one line."""
    return F.regexp_replace(F.base64(F.encode(F.trim(line), "UTF-8")), "[\r\n]", "")


def decode_line(line: Column) -> Column:
    return F.decode(F.unbase64(line), "UTF-8")


def keyword_pattern(lines: list[str]) -> str | None:
    """One pattern of all keyword lines of more than one character (the line feed not counted); None without any."""
    kept = [x.rstrip("\n") for x in lines]
    kept = [x for x in kept if len(x) > 1]
    for x in kept:
        re.compile(x)
    return f"({'|'.join(kept)})" if kept else None


def without_keywords(text: Column, pattern: str | None) -> Column:
    """True where no keyword occurs; null counts as no text."""
    return ~F.coalesce(text, F.lit("")).rlike(pattern) if pattern else F.lit(True)


def sentiment_label(code: Column) -> Column:
    """0, 1 and 2 as negative, neutral and positive, anything else as unknown."""
    names = F.create_map(*[F.lit(x) for x in (0, "negative", 1, "neutral", 2, "positive")])
    return F.coalesce(F.try_element_at(names, code.cast("int")), F.lit("unknown"))

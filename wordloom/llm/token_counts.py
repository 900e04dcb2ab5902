"""Token counts with a SentencePiece BPE vocabulary, by the whole-token shortcut.

Offline, from the vocabulary alone, three facts are proven:

* no piece has the space mark after another character, so merges never cross from one ``(mark)word`` pre-token to the next;
* some characters (the line feed among them) are in no piece at all, so they stand for their own fallback bytes wherever they are
  and merges never cross them;
* a set of vocabulary strings, when encoded alone, gives one token.

A pre-token from that set counts as one without any merging; only the rest is merged, once per distinct pre-token of a worker.

Null and empty texts have no tokens; very long texts are counted whole. An empty table gives an empty result. Repeated rows give repeated rows. Rows keep their ids, null ids included. Other columns of the
input are not carried, so their names cannot clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, texts

MARK = "▁"
#: Bytes of text that are split into pre-tokens at a time.
BLOCK_BYTES = 4 << 20
#: Pre-tokens whose counts a Python worker keeps, about.
MEMO_LIMIT = 1 << 19


def load(model: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model)


def prove(sp) -> tuple[frozenset[str], bool]:
    """(words w for which mark + w alone is one token, whether pre-tokens can be counted apart) for a loaded model."""
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    apart = not any(MARK in p.lstrip(MARK) or "\n" in p or " " in p for p in pieces)
    # the model must add the mark in front, keep runs of spaces and leave letters as they are
    apart = apart and sp.encode("  a  \n b ", out_type=str) == sp.encode(f"{MARK}{MARK}a{MARK}{MARK}\n{MARK}b{MARK}", out_type=str)
    apart = apart and sp.encode("\n", out_type=str)[:1] == [MARK] and sp.encode("ﬁx Ａ", out_type=str) == sp.encode("ﬁx", out_type=str) + sp.encode("\n Ａ", out_type=str)[2:]
    words = [p[1:] for p in pieces if p.startswith(MARK) and len(p) > 1 and MARK not in p[1:]]
    return frozenset(w for w, ids in zip(words, sp.encode(words), strict=True) if len(ids) == 1), apart


class Counter:
    """Counts the tokens of texts; holds the proven set and a bounded memo of merged pre-tokens.

    A key is a pre-token without its first space mark; a key with a leading line feed stands for the bare letters after it.
    """

    def __init__(self, model: str):
        self.sp = load(model)
        whole, self.apart = prove(self.sp)
        self.whole = dict.fromkeys(whole, 1)
        self.feed = len(self.sp.encode("\n\n")) - len(self.sp.encode("\n"))
        self.mark = len(self.sp.encode("\n")) - self.feed
        self.memo: dict[str, int] = {}
        self.reset()

    def reset(self) -> None:
        self.memo = self.whole | {"": self.mark}

    def keys(self, text: str) -> tuple[int, list[str]]:
        """Tokens of the line feeds, and the keys of all pre-tokens."""
        lines = text.replace(MARK, " ").split("\n")
        out: list[str] = []
        for i, line in enumerate(lines):
            if not i:
                line = " " + line  # the mark that the model puts in front
            if "  " in line:
                out += [x[1:] if x[0] == " " else "\n" + x for x in RUNS.findall(line)]
            elif line:
                head, *words = line.split(" ")
                if head:
                    out.append("\n" + head)
                out += words
        return (len(lines) - 1) * self.feed, out

    def counts(self, texts: list[str]) -> list[int]:
        if not self.apart:
            return [len(x) for x in self.sp.encode(texts, num_threads=1)]
        if len(self.memo) > MEMO_LIMIT:
            self.reset()
        split = [self.keys(x) if x else (0, []) for x in texts]
        missing: set[str] = set()
        for _, keys in split:
            missing.update(keys)
        new = list(missing.difference(self.memo))
        n = [len(x) - (self.mark + self.feed if k.startswith("\n") else 0) for k, x in zip(new, self.sp.encode(new, num_threads=1), strict=True)] if new else []
        memo = self.memo
        memo.update(zip(new, n, strict=True))  # grows by one block's distinct pre-tokens beyond the limit at most
        return [feeds + sum(map(memo.__getitem__, keys)) for feeds, keys in split]


RUNS = re.compile(" +[^ ]*|[^ ]+")


@lru_cache(maxsize=2)
def counter(model: str) -> Counter:
    return Counter(model)


def token_counts(docs: DataFrame, model: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit)."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counter(model).counts
        for block in blocks(batches, BLOCK_BYTES):
            raw = texts(block.column("text"))
            n = counts([x.decode() for x in raw])
            yield from pa.table(
                [block.column("doc_id"), pa.array([len(x) for x in raw], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            ).to_batches()

    id_type = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {id_type}, n_bytes long, n_tokens long, over_limit boolean")

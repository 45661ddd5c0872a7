"""Token counts with a whole-token shortcut.

Offline, the strings of the vocabulary that the library encodes alone as one token
(and that the pattern takes as one pre-token) are proven one by one.  A text is split
into pre-tokens; those in the proven set count one each without any merging; only the
rest goes through the library, each distinct string once per worker while its cache
lasts.  The pattern's character classes are proven against the library's own splitting
too, character by character; a text with a character whose class is not proven is
counted by the library as a whole.

Defined results: null text equals empty text and has no tokens.  Rows are independent:
null and repeated doc_ids, ties and other columns don't matter.  Special strings inside
texts count as the library's default gives them: one token each.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import slices, text_col
from tideline.llm.pretokens import pieces

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
from tokenizers import Tokenizer  # noqa: E402

CACHE, CACHED_CHARS = 400_000, 48
#: Characters whose classes are proven: up to here, and the emoji blocks.  Others go to the library.
PROVEN = (range(0xD800), range(0xE000, 0x10000), range(0x1F300, 0x1FB00))


def byte_chars() -> dict[str, int]:
    """The printable character that byte-level BPE files write for each byte, by rule: visible Latin-1 stands for itself, the others follow from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + n): b for n, b in enumerate(others)}


class Counter:
    def __init__(self, path: str, pattern: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.pattern = regex.compile(pattern)
        self.special = regex.compile("|".join(regex.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or r"(?!)")
        self.whole = self.prove_tokens()
        self.unproven = self.prove_classes()
        self.cache: dict[str, int] = {}

    def prove_tokens(self) -> frozenset[str]:
        to, strings = byte_chars(), []
        for token in self.tokenizer.get_vocab(with_added_tokens=False):
            try:
                s = bytes(to[c] for c in token).decode("utf-8")
            except (KeyError, UnicodeDecodeError):
                continue
            if s and self.pattern.fullmatch(s) and self.pattern.match(s).end() == len(s) and not self.special.search(s):
                strings.append(s)
        found = self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)
        return frozenset(s for s, e in zip(strings, found, strict=True) if len(e.ids) == 1)

    def prove_classes(self) -> regex.Pattern:
        """Matches any character whose splitting differs, or wasn't looked at."""
        bad = []
        for c in (c for r in PROVEN for c in r):
            x = chr(c)
            s = f"a{x}1{x} {x}!{x}{x} b"
            if [m.span() for m in self.pattern.finditer(s)] != [span for _, span in self.tokenizer.pre_tokenizer.pre_tokenize_str(s)]:
                bad.append(x)
        ranges = "".join(f"\\U{r.start:08x}-\\U{r.stop - 1:08x}" for r in PROVEN)
        return regex.compile(f"[^{ranges}]" + (f"|[{''.join(map(regex.escape, bad))}]" if bad else ""))

    def merge(self, token: str) -> int:
        n = self.cache.get(token)
        if n is None:
            n = len(self.tokenizer.encode(token, add_special_tokens=False).ids)
            if len(token) <= CACHED_CHARS:
                if len(self.cache) >= CACHE:
                    self.cache.clear()
                self.cache[token] = n
        return n

    def count(self, text: str) -> int:
        if self.unproven.search(text):
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        n, at = 0, 0
        for m in self.special.finditer(text):
            n += self.plain(text[at : m.start()]) + 1
            at = m.end()
        return n + self.plain(text[at:] if at else text)

    def plain(self, text: str) -> int:
        n, whole, merge = 0, self.whole, self.merge
        for piece, one in pieces(text):
            tokens = [piece] if one else self.pattern.findall(piece)
            rest = [t for t in tokens if t not in whole]
            n += len(tokens) - len(rest) + sum(map(merge, rest))
        return n


@lru_cache(maxsize=2)
def counter(path: str, pattern: str) -> Counter:
    """Proven once in each worker process."""
    return Counter(path, pattern)


def count_tokens(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, text) -> doc_id, n_bytes, n_tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path, pattern)
        for b in slices(batches, 256):
            n = [c.count(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    text = text_col()
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes")).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")

"""Token counts by heap-and-linked-list byte-pair merging, without making ids.

A word's symbols form a doubly linked list.  A heap holds its adjacent pairs by
merge rank and place; the lowest is popped and merged again and again, and the
word's count is its symbols less its merges.  A batch's distinct words are
counted once each, and counts are kept from batch to batch in a bounded memo.

Null and empty texts have 0 bytes and 0 tokens.  Repeated rows and rows with a
null id are counted each time; texts of any length are counted whole; an empty
table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from tapeloom.llm.common import read_table
from tapeloom.llm.tokens import MEMO_CHARS, _byte_letters, split_words, text_slices, tokenizer_path

#: Distinct words kept per Python worker; the memo starts anew beyond it.
MEMO_WORDS = 300_000
#: White space as the tokenizer's patterns see it.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


class MergeCounter:
    """Counts the tokens of words for a byte-level BPE file with lower-casing and word-end symbols."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        ids = model["vocab"]
        letters = {b: chr(c) for b, c in _byte_letters().items()}
        end = model.get("end_of_word_suffix") or ""
        self.symbol = [ids[letters.get(b, chr(b))] for b in range(256)]
        self.last = [ids[letters.get(b, chr(b)) + end] for b in range(256)]
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merge[ids[a], ids[b]] = (rank, ids[a + b])
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")")
        self.pieces = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
        self.memo: dict[str, int] = {}

    def merged(self, raw: bytes) -> int:
        """Tokens of one pre-token: symbols less merges."""
        n = len(raw)
        if n < 2:
            return n
        symbols = [self.symbol[b] for b in raw]
        symbols[-1] = self.last[raw[-1]]
        merge = self.merge.get
        heap = [(m[0], i, m[1], symbols[i], symbols[i + 1]) for i in range(n - 1) if (m := merge((symbols[i], symbols[i + 1])))]
        if not heap:
            return n
        heapq.heapify(heap)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        count, pop, push = n, heapq.heappop, heapq.heappush
        while heap:
            _, i, made, a, b = pop(heap)
            j = after[i]
            if symbols[i] != a or j >= n or symbols[j] != b:
                continue  # one of the two has been merged since
            symbols[i], symbols[j] = made, -1
            count -= 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if m := merge((made, symbols[k])):
                    push(heap, (m[0], i, m[1], made, symbols[k]))
            h = before[i]
            if h >= 0 and (m := merge((symbols[h], made))):
                push(heap, (m[0], h, m[1], symbols[h], made))
        return count

    def pretoken(self, p: str) -> int:
        n = self.memo.get(p)
        if n is None:
            n = self.merged(p.encode())
            if len(p) <= MEMO_CHARS:
                self.memo[p] = n
        return n

    def normal(self, word: str) -> str:
        if word.isascii():
            return word.lower()
        return "".join([c.lower() for c in unicodedata.normalize("NFC", word)])  # by letter: no rule for a final sigma

    def word(self, word: str) -> int:
        """Tokens of a piece of text without spaces or line ends."""
        if word.isascii() and word.isalpha():
            return self.pretoken(word.lower())
        total = 0
        for k, part in enumerate(self.special.split(word)):
            if k % 2:
                total += 1
            elif part:
                total += sum(map(self.pretoken, self.pieces.findall(self.normal(part))))
        return total

    def count(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text; none may be null."""
        offsets, codes, words = split_words(texts)
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        each = np.fromiter(map(self.word, words), np.int64, len(words))
        sums = np.zeros(len(codes) + 1, np.int64)
        np.cumsum(each[codes], out=sums[1:])
        return sums[offsets[1:]] - sums[offsets[:-1]]


_COUNTERS: dict[str, MergeCounter] = {}


def _counter(path: str) -> MergeCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = MergeCounter(path)
    return _COUNTERS[path]


def token_counts(docs: DataFrame, tokenizer: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_bytes, n_tokens, over_limit`` of every text.  No shuffle."""
    schema = pa.schema([(id_col, pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def run(batches):
        counter = _counter(tokenizer)
        for b in text_slices(batches):
            text = pc.fill_null(b.column("text"), "")
            n = counter.count(text) if len(text) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column("id").cast(pa.int64()), pc.binary_length(text).cast(pa.int64()), pa.array(n), pa.array(n > limit)], schema=schema
            )

    cols = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return cols.mapInArrow(run, f"`{id_col}` long, n_bytes long, n_tokens long, over_limit boolean")


def op3_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(read_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), 2048)

"""Words and token ids of whole texts, a batch of documents at a time.

``split_words`` codes the words of a batch against the batch's own distinct
words, so that Python sees each distinct word once.  The encoders give token ids
by the tokenizers library: they cut a text only where the tokenizer's own
pre-tokenization always breaks, so that the ids of a text are those of its words
in order; a text for which the cut would not be safe goes to the library whole.
"""

from __future__ import annotations

import os
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct words kept per Python worker; the memo starts anew beyond it.
MEMO_WORDS = 800_000
#: Longer words are encoded each time.
MEMO_CHARS, MEMO_BYTES = 48, 96
#: Pieces that are encoded in one call.
TOGETHER = 8192
#: Text bytes worked on at a time.
SLICE_BYTES = 8 << 20


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def text_slices(batches, column: str = "text", most: int = SLICE_BYTES):
    """Cut Arrow batches so that each holds about ``most`` bytes of text, or one longer document."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        start, n = 0, batch.num_rows
        while start < n:
            done = size[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(size, done + most, side="right")))
            yield batch.slice(start, end - start)
            start = end


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Pieces between spaces and line ends: offsets by document, a code for each piece, the distinct pieces."""
    lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False), out=offsets[1:])
    coded = lists.flatten().dictionary_encode()
    return offsets, coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lay out the ``codes``-th runs of ``flat`` one after another; also returns where each begins, and the end."""
    n = lengths[codes]
    at = np.zeros(len(codes) + 1, np.int64)
    np.cumsum(n, out=at[1:])
    where = np.repeat(starts[codes] - at[:-1], n)
    where += np.arange(at[-1])
    return flat[where], at


def cut_pieces(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Cut texts where a pre-token begins whatever stands around: offsets by document, a code for each piece, the distinct pieces.

    Cuts are before a run of ASCII white space; after a run that is one line
    end; and between an ASCII letter and a full stop or comma that white space
    follows.
    """
    begins = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8)[begins[0] : begins[-1]] if data is not None else np.zeros(0, np.uint8)
    begins = begins - begins[0]
    space = _IS_SPACE[data]
    plain = ~space
    cut = space.copy()
    cut[1:] &= plain[:-1]
    cut[2:] |= plain[2:] & (data[1:-1] == 10) & plain[:-2]
    cut[1:-1] |= _IS_MARK[data[1:-1]] & _IS_LETTER[data[:-2]] & space[2:]
    cut[begins[:-1][begins[1:] > begins[:-1]]] = True
    at = np.flatnonzero(cut)
    bounds = np.append(at, len(data)).astype(np.int32)
    coded = pa.StringArray.from_buffers(len(at), pa.py_buffer(bounds), pa.py_buffer(data)).dictionary_encode()
    return np.searchsorted(at, begins), coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


_IS_SPACE, _IS_MARK, _IS_LETTER = np.zeros((3, 256), bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_IS_MARK[[ord("."), ord(",")]] = True
_IS_LETTER[65:91] = _IS_LETTER[97:123] = True


def _byte_letters() -> dict[int, int]:
    """Byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: 256 + i for i, b in enumerate(rest)}


#: Any white space, and what some count as such, as the inside of a class of RE2.
_ANY_SPACE = r"\t-\r\x1c-\x20\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: Blocks whose letters every edition of Unicode in use has; the one letter whose small form is two characters is left out.
_OLD_BLOCKS = r"^[\x00-\x{12f}\x{131}-\x{52f}\x{5d0}-\x{5ea}\x{620}-\x{64a}\x{904}-\x{939}\x{3041}-\x{30fa}\x{4e00}-\x{9fa5}\x{ac00}-\x{d7a3}]*$"


def _matches(pieces: pa.Array, pattern: str) -> np.ndarray:
    return pc.match_substring_regex(pieces, pattern).to_numpy(zero_copy_only=False)


class _Encoder:
    """Ids of pieces of text, kept from batch to batch in flat arrays beside an Arrow array of the pieces.

    A piece of letters only is one pre-token, which goes to the library's model;
    any other goes through the library's whole chain.  A text in which other
    white space than ASCII's touches a cut isn't cut.
    """

    def __init__(self, path: str):
        self.library = load_tokenizer(path)
        self.model = self.library.model
        self.letters = np.arange(256, dtype="<u4")
        for b, c in _byte_letters().items():
            self.letters[b] = c
        self.letters[10] = 10  # stands between words
        self.forget()

    def forget(self) -> None:
        self.pieces = pa.array([], pa.string())
        self.flat, self.starts, self.lengths, self.safe = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        self.kept = 0

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")

    def learn(self, new: pa.Array) -> None:
        """Add pieces to what is known."""
        letters = _matches(new, self.one_word) & _matches(new, _OLD_BLOCKS)
        inner = rf"[^{_ANY_SPACE}]"
        safe = letters | _matches(new, rf"^[\t-\r ]*({inner}(?s:.*{inner})?)?$")
        groups = [new.filter(pa.array(x)) for x in (letters, safe & ~letters, ~safe)]
        flat, counts = array("I"), array("q")
        if len(groups[0]):
            tokenize, add, count = self.model.tokenize, flat.extend, counts.append
            formed = self.form("\n".join(self.words(groups[0]).to_pylist())).encode()
            for w in self.letters[np.frombuffer(formed, np.uint8)].tobytes().decode("utf-32-le").split("\n"):
                ids = [t.id for t in tokenize(w)]
                add(ids)
                count(len(ids))
        for at in range(0, len(groups[1]), TOGETHER):
            for e in self.library.encode_batch_fast(groups[1].slice(at, TOGETHER).to_pylist(), add_special_tokens=False):
                flat.extend(e.ids)
                counts.append(len(e.ids))
        n = np.concatenate([np.frombuffer(counts, np.int64) if counts else np.zeros(0, np.int64), np.zeros(len(groups[2]), np.int64)])
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(n) - n])
        self.lengths = np.concatenate([self.lengths, n])
        self.flat = np.concatenate([self.flat, np.frombuffer(flat, "<u4") if flat else np.zeros(0, "<u4")])
        self.safe = np.concatenate([self.safe, np.arange(len(n)) < len(n) - len(groups[2])])
        self.pieces = pa.concat_arrays([self.pieces, *groups])

    def places(self, pieces: pa.Array) -> np.ndarray:
        """Where each piece stands among those known, after learning the new ones; long ones follow the others."""
        if len(self.pieces) > MEMO_WORDS:
            self.forget()
        at = pc.index_in(pieces, value_set=self.pieces)
        missing = at.null_count
        if not missing:
            return at.to_numpy(zero_copy_only=False)
        new = pieces.filter(pc.is_null(at))
        long = pc.greater(pc.binary_length(new), MEMO_BYTES)
        begin = len(self.pieces)
        self.learn(new.filter(pc.invert(long)))
        self.kept = len(self.pieces)
        if pc.any(long).as_py():
            self.learn(new.filter(long))
        out = pc.fill_null(at, -1).to_numpy(zero_copy_only=False).copy()
        out[out < 0] = begin + pc.index_in(new, value_set=self.pieces.slice(begin)).to_numpy(zero_copy_only=False)
        return out

    def drop_long(self) -> None:
        if self.kept < len(self.pieces):
            self.pieces = self.pieces.take(pa.array(range(self.kept), pa.int32()))
            self.flat = self.flat[: self.starts[self.kept]].copy()
            self.starts, self.lengths, self.safe = self.starts[: self.kept], self.lengths[: self.kept], self.safe[: self.kept]

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Unsigned 32-bit ids of each text; none may be null."""
        if not len(texts):
            return []
        offsets, codes, pieces = cut_pieces(texts)
        codes = self.places(pieces)[codes] if len(pieces) else codes
        ids, at = gather(self.flat, self.starts, self.lengths, codes)
        bad = np.zeros(len(codes) + 1, np.int64)
        np.cumsum(~self.safe[codes], out=bad[1:])
        bad = bad[offsets[1:]] > bad[offsets[:-1]]
        self.drop_long()
        cut = at[offsets].tolist()
        return [self.whole(texts[i].as_py()) if bad[i] else ids[cut[i] : cut[i + 1]] for i in range(len(texts))]


class SpacedEncoder(_Encoder):
    """For byte-level BPE whose pre-tokens may begin with one space."""

    one_word = r"^ ?\p{L}+$"

    def words(self, pieces: pa.Array) -> pa.Array:
        return pieces

    def form(self, words: str) -> str:
        return words


class WordEncoder(_Encoder):
    """For tokenizers that compose, lower-case and drop white space."""

    one_word = r"^[\t-\r ]*\p{L}+$"

    def words(self, pieces: pa.Array) -> pa.Array:
        return pc.ascii_ltrim_whitespace(pieces)

    def form(self, words: str) -> str:
        """Composed and lower-cased; a final sigma is like any other."""
        return unicodedata.normalize("NFC", words).replace("\u03a3", "\u03c3").lower()


_ENCODERS: dict[tuple[type, str], _Encoder] = {}


def encoder(kind: type, path: str):
    """One encoder per Python worker, kept for its later tasks."""
    if (kind, path) not in _ENCODERS:
        _ENCODERS[kind, path] = kind(path)
    return _ENCODERS[kind, path]

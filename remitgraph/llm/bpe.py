"""BPE encoding and decoding.

The encoder backtracks instead of merging. An Aho-Corasick automaton over the reversed tokens finds,
in one pass, the longest token that starts at every place of a word. The encoder takes the longest
one, or the next shorter one, whose boundary with the token before would also stand if merges were
made in their order; that is looked up in a pair-compatibility table filled as pairs occur. A place
from which the word cannot be finished is marked and never tried again, so the work is linear in the
length of the word. The result is exactly that of merging. Decoding gathers bytes by an offset table.

Texts are cut into words a batch at a time: code points become classes by a table, and a word begins
where the class changes. Each different word of a batch is encoded once, and each worker keeps the
latest words.

The vocabulary is a tokenizers file (kind BPE with word ends); its path must be readable by every
executor. Texts of any length are processed whole; null and empty texts have no tokens. Character
classes are those of the Unicode version of the Python in use.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from remitgraph.llm.arrow import pieces, prepare, texts

_END = "Ā"  # stands for the end of a word; bytes are the characters below it
_NEVER = 1 << 60
# How the vocabulary file splits texts, and the endings after an apostrophe in it.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
# Fixed value: white space beyond ASCII.
_WHITE = "\u0085                 　"
_SPACE, _LETTER, _NUMBER, _OTHER = range(4)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The class of every code point."""
    kinds = {"L": _LETTER, "N": _NUMBER}
    found = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    found[[*range(9, 14), 32, *map(ord, _WHITE)]] = _SPACE
    return found


def _byte_of() -> dict[str, str]:
    """The byte, as a character, for each printable character that stands for one: itself or from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): chr(b) for b in printable} | {chr(256 + i): chr(b) for i, b in enumerate(others)}


def _gather(blob: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches of ``blob`` one after the other."""
    before = np.cumsum(size) - size
    return blob[np.repeat(start - before, size) + np.arange(int(size.sum()))]


def _before(size: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(size)))


class Encoder:
    """A vocabulary with its tables, and up to ``cached`` words that were encoded lately."""

    def __init__(self, path: str, cached: int = 150_000) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self._suffix = model["end_of_word_suffix"] or ""
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        if pattern != _PATTERN:
            raise ValueError(f"another way to split: {pattern}")
        self._bytes = _byte_of()
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]

        size = 1 + max([*vocab.values(), *self.special.values()])
        self.rank = [-1] * size
        self.parts: list[tuple[int, int] | None] = [None] * size
        self.merge_rank: dict[tuple[int, int], int] = {}
        for rank, (a, b) in enumerate(merges):
            whole, pair = vocab[a + b], (vocab[a], vocab[b])
            if self.parts[whole] is not None:
                raise ValueError(f"two merges make {a + b!r}")
            self.rank[whole], self.parts[whole], self.merge_rank[pair] = rank, pair, rank
        names = [""] * size
        for name, i in [*vocab.items(), *self.special.items()]:
            names[i] = name
        self._compatible: dict[tuple[int, int], bool] = {}
        spelled = {self._spell(name): i for name, i in vocab.items() if self._reachable(i, name)}
        self._length = [0] * size
        self._shorter: list[int] = [-1] * size
        reverse = ahocorasick.Automaton()
        for s, i in spelled.items():
            self._length[i] = len(s)
            self._shorter[i] = next((spelled[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in spelled), -1)
            reverse.add_word(s[::-1], i)
        reverse.make_automaton()
        self._reverse = reverse
        self._cached = cached
        self._known: dict[bytes, tuple[int, ...]] = {}
        self._decimal = [b"%d" % i for i in range(size)]

        encoded = [(n + " ").encode() for n in names]
        self._size = np.array([len(e) for e in encoded], dtype=np.int64)
        self._offset = _before(self._size)
        self._blob = np.frombuffer(b"".join(encoded), dtype=np.uint8)

    def _spell(self, name: str) -> str:
        ends = self._suffix and name.endswith(self._suffix)
        return "".join([self._bytes[c] for c in name.removesuffix(self._suffix if ends else "")]) + _END * bool(ends)

    def _reachable(self, token: int, name: str) -> bool:
        """Whether merging the token's own text gives the token."""
        if (pair := self.parts[token]) is None:
            return len(self._spell(name).removesuffix(_END)) == 1
        return self._stands(*pair, self.rank[token])

    def _stands(self, left: int, right: int, before: int = _NEVER) -> bool:
        """Whether no merge made earlier than ``before`` crosses the boundary of two tokens.

        Goes back in time: the token merged last is undone first, of equal ones the right one, since
        equal merges go from left to right. At every step the two pieces next to the boundary must
        not have a merge that comes before the one that took the outer piece away.
        """
        while True:
            if self.merge_rank.get((left, right), before) < before:
                return False
            made_left, made_right = self.rank[left], self.rank[right]
            if made_left > made_right:
                before, left = made_left, self.parts[left][1]
            elif made_right >= 0:
                before, right = made_right + 1, self.parts[right][0]
            else:
                return True

    def compatible(self, left: int, right: int) -> bool:
        if len(self._compatible) >= self._cached:
            self._compatible.clear()
        found = self._compatible[left, right] = self._stands(left, right)
        return found

    def merge(self, word: bytes) -> tuple[int, ...]:
        """The tokens of one word."""
        text = word.decode("latin-1") + (_END if self._suffix else "")
        n = len(text)
        # All matches of one place come longest first; of equal keys a dict keeps the last.
        longest = dict([*self._reverse.iter(text[::-1])][::-1]).get
        length, shorter, table = self._length, self._shorter, self._compatible
        dead = {n - 1} if self._suffix else set()  # the end of a word is never a token of its own
        out: list[int] = []
        at, token, last = 0, longest(n - 1, -1), -1
        while at < n:
            while token >= 0:
                end = at + length[token]
                if end not in dead:
                    if last < 0:
                        break
                    fits = table.get((last, token))
                    if fits or fits is None and self.compatible(last, token):
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at, last = end, token
                token = longest(n - 1 - at, -1)
            elif last < 0:
                raise ValueError(f"not in the vocabulary: {word!r}")
            else:
                dead.add(at)
                token = out.pop()
                at -= length[token]
                last = out[-1] if out else -1
                token = shorter[token]
        return tuple(out)

    def _word(self, word: bytes) -> tuple[int, ...]:
        if len(self._known) >= self._cached:
            self._known.clear()
        ids = self._known[word] = self.merge(word)
        return ids

    @staticmethod
    def _normal(text: str) -> str:
        if text.isascii():
            return text.lower()
        # Letters are lowered one at a time, so a final sigma is like any other.
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    @staticmethod
    def _cut(strings: list[str]) -> tuple[np.ndarray, pa.Array]:
        """The words of texts without special tokens: where each text's begin (one more than texts), the words."""
        joined = "\n".join(strings)
        points = np.frombuffer(joined.encode("utf-32-le", "replace"), dtype=np.uint32)
        kind = _classes()[points]
        begins = np.ones(len(points), dtype=bool)
        begins[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _NUMBER)
        # An apostrophe alone between others and letters takes an ending with it.
        own = np.flatnonzero(points == 39)
        own = own[begins[own] & (own + 1 < len(points))]
        for i in own[kind[np.minimum(own + 1, len(points) - 1)] == _LETTER].tolist():
            for ending in _ENDINGS:
                if joined.startswith(ending, i + 1):
                    begins[i + 1] = False
                    after = i + 1 + len(ending)
                    if after < len(points):
                        begins[after] = True
                    break
        full = kind != _SPACE
        starts = np.flatnonzero(begins & full)
        raw = np.frombuffer(joined.encode("utf-8", "replace"), dtype=np.uint8)
        if len(raw) == len(points):
            kept = full.astype(np.int32)
            raw = raw[full]
        else:
            width = 1 + (points > 0x7F).astype(np.int32) + (points > 0x7FF) + (points > 0xFFFF)
            kept = np.where(full, width, 0)
            raw = raw[np.repeat(full, width)]
        place = np.cumsum(kept) - kept
        offsets = np.concatenate((place[starts], [len(raw)])).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
        ends = np.cumsum([len(s) + 1 for s in strings])
        return np.concatenate(([0], np.searchsorted(starts, ends))), words

    def batch(self, strings: list[str]) -> Batch:
        """The tokens of texts."""
        units: list[str] = []  # stretches without special tokens
        owner: list[int] = []
        plain = [self._special.search(s) is None for s in strings]
        for i, s in enumerate(strings):
            if plain[i]:
                units.append(self._normal(s))
                owner.append(i)
        bounds, words = self._cut(units)
        coded = words.dictionary_encode()
        known, word = self._known, self._word
        different = [known.get(w) or word(w) for w in coded.dictionary.to_pylist()]
        codes = coded.indices.to_numpy(zero_copy_only=False)
        parts: list[np.ndarray] = [codes[:0]] * len(strings)
        for i, a, b in zip(owner, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            parts[i] = codes[a:b]
        for i, s in enumerate(strings):
            if not plain[i]:
                mixed: list[int] = []
                at = 0
                for m in [*self._special.finditer(s), None]:
                    stretch = self._cut([self._normal(s[at:] if m is None else s[at:m.start()])])[1]
                    found = [known.get(w) or word(w) for w in stretch.to_pylist()]
                    if m is not None:
                        found.append((self.special[m[0]],))
                        at = m.end()
                    mixed += range(len(different), len(different) + len(found))
                    different += found
                parts[i] = np.array(mixed, dtype=codes.dtype)
        return Batch(self, parts, different)

    def encode(self, text: str | None) -> list[int]:
        return self.batch([text or ""]).ids()[0].tolist()

    def decode(self, ids: np.ndarray | list[int]) -> bytes:
        """The names of the tokens, joined by spaces, as UTF-8."""
        ids = np.asarray(ids, dtype=np.int64)
        return _gather(self._blob, self._offset[ids], self._size[ids]).tobytes()[:-1]


class Batch:
    """Encoded texts: for each the numbers of its words, and the tokens of every different word."""

    def __init__(self, own: Encoder, parts: list[np.ndarray], words: list[tuple[int, ...]]) -> None:
        self._own, self._parts, self._words = own, parts, words
        self._size = np.array([len(w) for w in words], dtype=np.int64)
        self._start = _before(self._size)
        self._flat = np.array([i for w in words for i in w], dtype=np.int64)

    def ids(self) -> list[np.ndarray]:
        return [_gather(self._flat, self._start[p], self._size[p]) for p in self._parts]

    def counts(self) -> list[int]:
        return [int(self._size[p].sum()) for p in self._parts]

    def _joined(self, names: list[bytes]) -> Iterator[bytes]:
        for part in self._parts:
            yield b" ".join([names[i] for i in part.tolist()])

    def decimal(self) -> Iterator[bytes]:
        """The tokens of each text as numbers joined by spaces."""
        digits = self._own._decimal
        return self._joined([b" ".join([digits[i] for i in w]) for w in self._words])

    def decoded(self) -> Iterator[bytes]:
        """Each text decoded; the tokens of every different word are looked up once."""
        own = self._own
        text = _gather(own._blob, own._offset[self._flat], own._size[self._flat]).tobytes()
        ends = _before(own._size[self._flat])[self._start].tolist()
        return self._joined([text[a:b - 1] for a, b in zip(ends[:-1], ends[1:], strict=True)])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each Python worker, kept between tasks."""
    return Encoder(path)


def _kind(df: DataFrame) -> str:
    return df.schema["doc_id"].dataType.simpleString()


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and the tokens of every text (``ids``, an array); none for a null or empty text.

    Repeated rows are encoded each; columns other than doc_id and text are not looked at.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in pieces(batches, most=4 << 20):
            found = own.batch(texts(batch).to_pylist()).ids()
            ends = _before(np.array([len(i) for i in found])).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {_kind(docs)}, ids array<int>")


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """doc_id and the text (``decoded``) of every array of tokens ``ids``; a null array gives an empty text."""
    prepare(tokens.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            text = [own.decode(x or []).decode() for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(text, pa.string())], ["doc_id", "decoded"])

    return tokens.select("doc_id", "ids").mapInArrow(run, f"doc_id {_kind(tokens)}, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Encode and decode every text in one pass: doc_id, n_tokens, ids_sha256, decoded_sha256.

    ``ids_sha256`` is of the decimal ids joined by one space. Null texts count as empty, with no
    tokens and the digest of nothing; repeated rows each have a row.
    """
    prepare(docs.sparkSession)
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in pieces(batches, most=4 << 20):
            found = own.batch(texts(batch).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(found.counts(), pa.int64()),
                 pa.array([hashlib.sha256(b).hexdigest() for b in found.decimal()], pa.string()),
                 pa.array([hashlib.sha256(b).hexdigest() for b in found.decoded()], pa.string())], names)

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {_kind(docs)}, n_tokens long, ids_sha256 string, decoded_sha256 string")

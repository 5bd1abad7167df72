"""Token ids by a public tokenizer, with a cache of white-space separated words.

For tokenizers whose pre-tokenizer never crosses white space, a text's ids are the ids
of its words in order. Words are found and hashed in numpy, over whole batches of
texts, and looked up in a table of fixed size. A word found by its hash is compared
byte by byte with the text, so that no collision, by chance or by design, gives another
word's ids. Only words that are not there are encoded, once for all their places in the
batch.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import chain

import numpy as np

MARK = "0"
SIGNS = ".,;:!?#$%&*|\"()[]{}<>/+=~^_@-"
#: Byte-level models name each byte by a printable character: those that are printable by themselves, the others in order from U+0100.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_NAMES = {b: 0x100 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
SEGMENT = 1 << 18  # bytes that are hashed at once
LARGEST = 1 << 25  # ids, or bytes, of words that are held


def _powers(base: int) -> tuple[np.ndarray, np.ndarray]:
    """base^k and base^-k modulo 2^64 for every place of a segment."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        steps = np.full(SEGMENT, b, np.uint64)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


def _lowered(text: str) -> str:
    """Lower case where that commutes with the tokenizer's own normalisation: Latin-1 has no combining marks."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text.lower()


class WordTable:
    """Hash table of words in numpy: their hash chooses one of two places. Newer words displace older ones."""

    def __init__(self, slots: int):
        self.mask = np.uint64(slots - 1)
        self.key = np.zeros(slots, np.uint64)
        self.entry = np.full(slots, -1, np.int32)

    def _places(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = key * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        return (x & self.mask).astype(np.int64), ((x >> np.uint64(32)) & self.mask).astype(np.int64)

    def find(self, key: np.ndarray) -> np.ndarray:
        """An entry whose word has this hash, or -1."""
        first, second = self._places(key)
        out = np.where(self.key[first] == key, self.entry[first], np.int32(-1))
        rest = np.flatnonzero(out < 0)
        at = second[rest]
        out[rest] = np.where(self.key[at] == key[rest], self.entry[at], np.int32(-1))
        return out

    def add(self, key: np.ndarray, entry: np.ndarray) -> None:
        first, second = self._places(key)
        at = np.where((self.entry[first] >= 0) & (self.entry[second] < 0), second, first)
        self.key[at], self.entry[at] = key, entry
        # Of words of one call with one place, the last one's parts were all written: assignment is in order.


class Flat:
    """Growing rows of values, one after the other."""

    def __init__(self, kind: type):
        self.values = np.zeros(1 << 16, kind)
        self.ends = np.zeros(1 << 14, np.int32)  # ends[i + 1]: where row i ends
        self.count = 0

    def add(self, values: np.ndarray, sizes: np.ndarray) -> None:
        base, n = int(self.ends[self.count]), self.count + len(sizes)
        while base + len(values) > len(self.values):
            self.values = np.concatenate([self.values, np.zeros_like(self.values)])
        while n + 1 > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.values[base : base + len(values)] = values
        self.ends[self.count + 1 : n + 1] = base + np.cumsum(sizes)
        self.count = n

    def rows(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of these rows, joined, and each row's size."""
        begin = self.ends[which]
        size = self.ends[which + 1] - begin
        stop = np.cumsum(size, dtype=np.int64)
        at = np.arange(stop[-1] if len(stop) else 0) + np.repeat(begin - (stop - size), size)
        return self.values[at], size


class WordTokenizer:
    """Encodes texts with a serialised tokenizer; ``capacity`` bounds the words that are held."""

    def __init__(self, serialised: str, capacity: int = 1_000_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(serialised)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.capacity = capacity
        self.slots = 1 << (2 * capacity - 1).bit_length()
        self.words: dict[str, list[int]] = {}
        self.signs: dict[str, list[int]] = {}
        found = self._ids(MARK)
        self.mark = found[0] if len(found) == 1 else -1
        self.power, self.inverse = _powers(0x9DDFEA08EB382D69)
        self._reset()
        probe = ["the", "wörter.", "é", "ñandú,.", "ça#$", "...", "ß"]
        if [list(x) for x in self.encode_batch([p.upper() if p != "ß" else p for p in probe])] != [self._ids(p) for p in probe]:
            raise ValueError("the tokenizer must be byte-level, lower-case, and part letters from signs")

    def _reset(self) -> None:
        self.table = WordTable(self.slots)
        self.ids_of, self.bytes_of = Flat(np.uint32), Flat(np.uint8)

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _learn(self, raw: list[bytes]) -> None:
        """Append entries. A lower-case Latin-1 word, with or without signs after it, needs the model alone; others the whole tokenizer."""
        words = [w.decode("utf-8", "replace") for w in raw]
        tokenize, memo, signs = self.tokenizer.model.tokenize, self.words, self.signs
        if len(memo) > 100_000:
            memo.clear()
        if len(signs) > 10_000:
            signs.clear()
        lists: list[list[int] | None] = []
        rest: list[int] = []
        for i, c in enumerate(words):
            word = c.rstrip(SIGNS)
            ids = memo.get(word)
            if ids is None:
                if word and not (word.isalpha() and word.islower() and (word.isascii() or max(word) < "Ā")):
                    lists.append(None)
                    rest.append(i)
                    continue
                name = word if word.isascii() else word.encode().decode("latin-1").translate(BYTE_NAMES)
                ids = memo[word] = [t.id for t in tokenize(name)] if word else []
            if len(word) < len(c):
                tail = c[len(word) :]
                more = signs.get(tail)
                if more is None:
                    more = signs[tail] = self._ids(tail)
                ids = ids + more
            lists.append(ids)
        # Words without the mark are encoded in one text, parted by the mark's id.
        plain = [i for i in rest if MARK not in words[i]]
        for at in range(0, len(plain), 2_000):
            part = plain[at : at + 2_000]
            ids = np.array(self._ids(f" {MARK} ".join([*(words[i] for i in part), ""])), np.uint32)
            marks = np.flatnonzero(ids == self.mark)
            if len(marks) == len(part):
                for i, own in zip(part, np.split(ids, marks + 1), strict=False):
                    lists[i] = own[:-1].tolist()
        for i in rest:
            if lists[i] is None:
                lists[i] = self._ids(words[i])
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        self.ids_of.add(np.fromiter(chain.from_iterable(lists), np.uint32, int(sizes.sum())), sizes)
        self.bytes_of.add(np.frombuffer(b"".join(raw), np.uint8), np.fromiter(map(len, raw), np.int64, len(raw)))

    def _segment(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Where the words of a segment begin, and their entries."""
        b = np.frombuffer(data, np.uint8)
        inside = ~((b == 32) | ((b >= 9) & (b <= 13)))
        edge = np.diff(inside.view(np.int8), prepend=0, append=0)
        start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if not len(start):
            return start, np.zeros(0, np.int64)
        v = (b.astype(np.uint64) + np.uint64(1)) * self.power[: len(b)]
        total = np.cumsum(v)
        key = (total[stop - 1] - total[start] + v[start]) * self.inverse[start]
        entry = self.table.find(key).astype(np.int64)
        self._compare(b[inside], stop - start, entry)
        missing = np.flatnonzero(entry < 0)
        if len(missing):
            base = self.ids_of.count
            new: dict[bytes, int] = {}
            words = [data[i:j] for i, j in zip(start[missing].tolist(), stop[missing].tolist(), strict=True)]
            entry[missing] = [base + new.setdefault(w, len(new)) for w in words]
            first = missing[np.unique(entry[missing], return_index=True)[1]]
            self._learn(list(new))
            self.table.add(key[first], entry[first].astype(np.int32))
        return start, entry

    def _compare(self, text: np.ndarray, size: np.ndarray, entry: np.ndarray) -> None:
        """Unset the entries whose words are not those of the text (its words' bytes, joined)."""
        known = entry >= 0
        its = np.where(known, entry, 0)
        known &= self.bytes_of.ends[its + 1] - self.bytes_of.ends[its] == size
        here = np.flatnonzero(known)
        if len(here):
            stored, sizes = self.bytes_of.rows(entry[here])
            differ = np.flatnonzero(stored != (text if len(here) == len(size) else text[np.repeat(known, size)]))
            known[here[np.searchsorted(np.cumsum(sizes), differ, "right")]] = False
        entry[~known] = -1

    def encode_batch(self, texts: Sequence[str | None]) -> list[np.ndarray]:
        """Ids (uint32) of each text; null counts as empty."""
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        held: list[bytes] = []
        owners: list[int] = []
        size = 0

        def run() -> None:
            nonlocal size
            if self.ids_of.count > self.capacity or max(self.ids_of.ends[self.ids_of.count], self.bytes_of.ends[self.bytes_of.count]) > LARGEST:
                self._reset()
            start, entry = self._segment(b"\n".join(held))
            ids, count = self.ids_of.rows(entry)
            stop = np.concatenate([[0], np.cumsum(count, dtype=np.int64)])
            bounds = stop[np.searchsorted(start, np.cumsum([0, *(len(h) + 1 for h in held)]))]
            for k, i in enumerate(owners):
                own = ids[bounds[k] : bounds[k + 1]]
                out[i] = own if not len(out[i]) else np.concatenate([out[i], own])
            held.clear()
            owners.clear()
            size = 0

        for i, text in enumerate(texts):
            if not text:
                continue
            for part in _parts(_lowered(text).encode("utf-8", "replace")):
                if part is None:  # a word longer than a segment
                    if held:
                        run()
                    out[i] = np.array(self._ids(text), np.uint32)
                    break
                if size + len(part) + 1 > SEGMENT:
                    run()
                held.append(part)
                owners.append(i)
                size += len(part) + 1
        if held:
            run()
        return out


def _parts(data: bytes) -> list[bytes | None]:
    """The text in parts that fit a segment, cut at white space; [None] where that can't be."""
    out: list[bytes | None] = []
    while len(data) >= SEGMENT:
        at = max(data.rfind(s, 0, SEGMENT - 1) for s in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
        if at <= 0:
            return [None]
        out.append(data[:at])
        data = data[at:]
    return [*out, data]


_tokenizers: dict[int, WordTokenizer] = {}


def tokenizer_of(serialised: str) -> WordTokenizer:
    """This worker's tokenizer and table, kept between tasks."""
    key = hash(serialised)
    if key not in _tokenizers:
        _tokenizers.clear()
        _tokenizers[key] = WordTokenizer(serialised)
    return _tokenizers[key]


def release() -> None:
    """Give up this worker's tokenizer and table, before work that needs the memory."""
    _tokenizers.clear()


def serialised_tokenizer(path: str | None = None) -> str:
    """The tokenizer file's content, read on the driver (a few MB, independent of the data)."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()

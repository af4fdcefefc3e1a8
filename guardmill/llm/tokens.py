"""Token ids of whole texts, with a bounded cache of parts.

A tokenizer that cuts a text at known places before anything else gives the ids of a text as
the ids of its parts, one after the other. Texts repeat their words, so each part is encoded by
the tokenizers library once and then looked up, whole batches at a time in Arrow.
"""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The cache keeps no more than this between batches. Bytes are those of the parts, their ids
#: and PART_BYTES for the rest of an entry (offsets, uses and its place in Arrow's table).
CACHE_PARTS = 400_000
CACHE_BYTES = 56 << 20
PART_BYTES = 64
#: New parts are encoded together, so many to a text.
TOGETHER = 256
PARTS_TOGETHER = 4096

#: A space as byte-level vocabularies write it.
SPACE = "\u0120"
#: The pattern of the word vocabulary whose parts are known here.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# Bytes by what both patterns see in them. Common text is ASCII but for most control characters,
# and the letters and two signs from U+00C0 to U+00FF: one code point each in NFC. All else is
# odd, and the words it stands in are left to the library.
_OTHER, _LETTER, _DIGIT, _BLANK = range(4)
_BLANKS = b"\t\n\x0b\x0c\r "
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
_SIGNS = (0x97, 0xB7)  # after 0xC3, the signs of multiplication and division
_ENDINGS = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")
# characters of two and three bytes that may be white space, for one Unicode version or another
_BLANKS_2 = (0xC285, 0xC2A0)
_BLANKS_3 = (0xE19A80, 0xE1A08E, *range(0xE28080, 0xE2808C), 0xE280A8, 0xE280A9, 0xE280AF,
             0xE2819F, 0xE38080)
_loaded: dict[str, PieceTokenizer] = {}


def load(path: str) -> PieceTokenizer:
    """The tokenizer of a file; loaded once per worker process."""
    if path not in _loaded:
        _loaded[path] = PieceTokenizer(path)
    return _loaded[path]


class PieceTokenizer:
    """Ids as `tokenizers` gives them for the whole text without special tokens added.

    Known parts are numbers into flat arrays of ids. When there are too many, the most used of
    them stay.
    """

    def __init__(self, path: str, cache_pieces: int = CACHE_PARTS,
                 cache_bytes: int = CACHE_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks already fill the cores
        import json

        from tokenizers import Tokenizer, pre_tokenizers

        self._tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self._special = [t["content"] for t in spec.get("added_tokens", [])]
        self._cut = _cutter(spec)
        self._between = " " if self._cut == "at blanks" else ""
        # ids that close a word, or in byte-level vocabularies those that open with a space
        suffix = spec["model"].get("end_of_word_suffix") or ""
        vocabulary = self._tokenizer.get_vocab()
        size = max(vocabulary.values(), default=0) + 1
        self._edge = np.zeros(size, dtype=bool)
        self._letters = np.zeros(size, dtype=np.int64)  # how many an id stands for
        for token, i in vocabulary.items():
            closes = bool(suffix) and token.endswith(suffix)
            self._edge[i] = closes if self._between else token.startswith(SPACE)
            self._letters[i] = len(token) - (len(suffix) if closes else 0)
        self._byte_letters = _byte_letters()
        self._kinds, self._odd = _byte_kinds(spec)
        # the model alone, for parts that are written in its letters already
        self._model = Tokenizer(self._tokenizer.model)
        self._model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self._pieces, self._bytes = cache_pieces, cache_bytes
        self._cache = pa.array([], pa.large_binary())
        self._ids = np.empty(0, dtype=np.uint32)
        self._ends = np.zeros(1, dtype=np.int64)
        self._uses = np.empty(0, dtype=np.int64)

    def encode(self, texts: Sequence[str] | pa.Array) -> list[np.ndarray]:
        """Unsigned 32-bit ids per text."""
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        if self._cut is None:
            return self._whole(column)
        column = column.fill_null("") if column.null_count else column
        special = np.zeros(len(column), dtype=bool)  # the library finds these anywhere
        for token in self._special:
            special |= pc.match_substring(column, token).to_numpy(zero_copy_only=False)
        if not special.any():
            return self._encode_cut(column)
        out: list[np.ndarray | None] = [None] * len(column)
        for chosen, encode in ((special, self._whole), (~special, self._encode_cut)):
            found = encode(column.filter(pa.array(chosen)))
            for i, ids in zip(np.flatnonzero(chosen).tolist(), found, strict=True):
                out[i] = ids
        return out

    def _encode_cut(self, column: pa.Array) -> list[np.ndarray]:
        parts, counts = self._split(column)
        ids, lengths = self._joined(self._entries(parts))
        self._shrink()
        before = np.concatenate([[0], np.cumsum(lengths)])
        cuts = before[np.concatenate([[0], np.cumsum(counts)])]
        return [ids[i:j] for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]

    def _split(self, column: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The parts of all texts one after the other, and how many each text has."""
        column = column.cast(pa.large_string())
        offsets = np.frombuffer(column.buffers()[1], np.int64)[
            column.offset:column.offset + len(column) + 1]
        chars = column.buffers()[2]
        if chars is None or offsets[0] == offsets[-1]:
            return pa.array([], pa.large_binary()), np.zeros(len(column), np.int64)
        data = np.frombuffer(chars, np.uint8)[offsets[0]:offsets[-1]]
        offsets = offsets - offsets[0]
        if self._between:  # the library lower-cases all letters
            data = _LOWER[data]
        padded = np.append(data, np.zeros(4, np.uint8))
        first = np.zeros(len(padded), dtype=bool)
        first[offsets] = True  # also behind the last text
        begins = np.flatnonzero(self._begins(padded, first)[:len(data)])
        parts = pa.Array.from_buffers(pa.large_binary(), len(begins), [
            None, pa.py_buffer(np.append(begins, len(data))), pa.py_buffer(data)])
        if self._between:
            kept = self._kinds[data[begins]] != _BLANK
            begins, parts = begins[kept], parts.filter(pa.array(kept))
        return parts, np.diff(np.searchsorted(begins, offsets))

    def _begins(self, data: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Where parts begin; `first` tells where texts begin.

        Letters, digits and other characters make runs. At blanks a byte-level vocabulary takes
        the last one of a run as a part of its own, or along with the run that follows if it is
        a space; the word vocabulary leaves them out and has every digit alone.
        """
        kinds = self._kinds[data]
        signs = np.flatnonzero(data == 0xC3)
        signs = signs[np.isin(data[signs + 1], _SIGNS)]
        kinds[signs] = kinds[signs + 1] = _OTHER
        begins = first.copy()
        begins[1:] |= kinds[1:] != kinds[:-1]
        blank = kinds == _BLANK
        if self._between:
            begins |= kinds == _DIGIT
        else:
            last = np.flatnonzero(blank[:-1] & ~blank[1:] & ~first[1:])
            begins[last] = True
            begins[last[data[last] == 0x20] + 1] = False
        self._cut_endings(data, first, begins)
        odd = np.flatnonzero(self._is_odd(data))
        if len(odd):
            whole = self._borders(data, first, blank)
            number = np.cumsum(whole)
            has_odd = np.zeros(int(number[-1]) + 1, dtype=bool)
            has_odd[number[odd]] = True
            begins = np.where(has_odd[number], whole, begins)
        return begins

    def _is_odd(self, data: np.ndarray) -> np.ndarray:
        odd = self._odd[data]
        if self._between:  # capital letters that are not lower-cased here
            odd[1:] |= (data[:-1] == 0xC3) & (data[1:] < 0x9F) & (data[1:] != _SIGNS[0])
        return odd

    def _cut_endings(self, data: np.ndarray, first: np.ndarray, begins: np.ndarray) -> None:
        """'s, 't, 're, 've, 'm, 'll and 'd are parts where one could begin."""
        quotes = np.flatnonzero((data == 0x27) & begins)
        for ending in _ENDINGS:
            hit = quotes
            for i, letter in enumerate(ending, 1):
                hit = hit[(data[hit + i] == letter) & ~first[hit + i]]
            begins[hit + 1] = False
            begins[hit + 1 + len(ending)] = True

    def _borders(self, data: np.ndarray, first: np.ndarray, blank: np.ndarray) -> np.ndarray:
        """Where texts may be cut whatever characters they have."""
        whole = first.copy()
        if self._between:
            whole[1:] |= blank[1:] != blank[:-1]
            return whole
        # before a space that something other than white space follows
        space = np.flatnonzero(data == 0x20)
        space = space[~first[space + 1]]
        one, two, three = (data[space + i].astype(np.int64) for i in (1, 2, 3))
        solid = (one > 0x20) & (one != 0x7F)
        far = np.flatnonzero(np.isin(one, (0xC2, 0xE1, 0xE2, 0xE3)))
        pair = one[far] << 8 | two[far]
        solid[far] = ~(np.isin(pair, _BLANKS_2) | np.isin(pair << 8 | three[far], _BLANKS_3))
        whole[space[solid]] = True
        return whole

    def _entries(self, parts: pa.Array) -> np.ndarray:
        """Numbers of the parts; new ones are learnt."""
        known = len(self._cache)
        listed = pa.concat_arrays([self._cache, parts]).dictionary_encode()
        entries = listed.indices.to_numpy(zero_copy_only=False)[known:].astype(np.int64)
        if len(listed.dictionary) > known:
            self._learn(listed.dictionary.slice(known))
            self._cache = listed.dictionary
            self._uses = np.append(self._uses, np.zeros(len(self._cache) - known, np.int64))
        self._uses += np.bincount(entries, minlength=len(self._cache))
        return entries

    def _shrink(self) -> None:
        """Leaves the most used half of the cache if it is too large."""
        offsets = np.frombuffer(self._cache.buffers()[1], np.int64) if len(self._cache) else [0]
        costs = PART_BYTES + 4 * np.diff(self._ends) + np.diff(
            offsets[self._cache.offset:self._cache.offset + len(self._cache) + 1])
        if len(self._cache) <= self._pieces and int(costs.sum()) <= self._bytes:
            return
        ranked = np.argsort(-self._uses, kind="stable")[:max(1, self._pieces // 2)]
        kept = np.sort(ranked[np.cumsum(costs[ranked]) <= self._bytes // 2])
        ids, lengths = self._joined(kept)
        self._cache = self._cache.take(pa.array(kept))
        self._ids, self._ends = ids, np.append(0, np.cumsum(lengths))
        self._uses = self._uses[kept] // 2

    def _joined(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all entries one after the other, and their numbers."""
        starts = self._ends[entries]
        lengths = self._ends[entries + 1] - starts
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        return self._ids[np.repeat(starts - (ends - lengths), lengths)
                         + np.arange(total)], lengths

    def _whole(self, texts: pa.Array) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.uint32) for e in self._tokenizer.encode_batch(
            [t or "" for t in texts.to_pylist()], add_special_tokens=False)]

    def _learn(self, parts: pa.Array) -> None:
        """Parts of common letters by the model, others as the library cuts them."""
        offsets = np.frombuffer(parts.buffers()[1], np.int64)[
            parts.offset:parts.offset + len(parts) + 1]
        data = np.frombuffer(parts.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
        offsets = offsets - offsets[0]
        odd = np.logical_or.reduceat(self._is_odd(data), offsets[:-1])
        ids = np.empty(0, dtype=np.uint32)
        lengths = np.zeros(len(parts), dtype=np.int64)
        plain = parts.filter(pa.array(~odd))
        if len(plain):
            ids, lengths[~odd] = self._learn_plain(plain)
        if odd.any():
            found: dict[str, np.ndarray] = {}
            names = [p.decode("utf-8") for p in parts.filter(pa.array(odd)).to_pylist()]
            self._learn_together(names, found)
            lengths[odd] = [len(found[p]) for p in names]
            joined = np.empty(int(lengths.sum()), dtype=np.uint32)
            from_odd = np.repeat(odd, lengths)
            joined[~from_odd] = ids
            joined[from_odd] = np.concatenate([found[p] for p in names])
            ids = joined
        self._ids = np.concatenate([self._ids, ids])
        self._ends = np.append(self._ends, self._ends[-1] + np.cumsum(lengths))

    def _learn_plain(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of parts that the tokenizer cuts no further, and how many each has."""
        ids, counts = [], []
        for at in range(0, len(parts), PARTS_TOGETHER):
            group = parts.slice(at, PARTS_TOGETHER)
            sizes = pc.binary_length(group).to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
            joined = np.frombuffer(b"".join(group.to_pylist()), np.uint8)
            letters = np.insert(self._byte_letters[joined], ends[:-1], ord(" "))
            text = letters.astype("<u4").tobytes().decode("utf-32-le")
            found = np.array(self._model.encode_batch_fast(
                [text], add_special_tokens=False)[0].ids, dtype=np.uint32)
            stands = np.cumsum(self._letters[found])
            last = np.searchsorted(stands, ends)
            if len(stands) and stands[-1] == ends[-1] and (stands[last] == ends).all():
                number = np.diff(last + 1, prepend=0)
            else:  # letters that the vocabulary lacks or writes like its suffix
                each = [[t.id for t in self._tokenizer.model.tokenize(w)]
                        for w in text.split(" ")]
                found = np.array([i for one in each for i in one], dtype=np.uint32)
                number = np.array([len(one) for one in each])
            ids.append(found)
            counts.append(number)
        return np.concatenate(ids), np.concatenate(counts)

    def _learn_together(self, plain: list[str], found: dict[str, np.ndarray]) -> None:
        """Encodes pieces, as many as may stand side by side in one text.

        A piece may follow any other if there is a border before it: after a blank, or where
        a space and a character open it.
        """
        joins = [bool(self._between) or (p[:1] == " " and not p[1:2].isspace()
                                         and len(p) > 1) for p in plain]
        words = [j and _is_word(p if self._between else p[1:])
                 for j, p in zip(joins, plain, strict=True)]
        for chosen, encode, share in (
                (words, self._tokenizer.encode_batch_fast, self._share_words),
                ([j and not w for j, w in zip(joins, words, strict=True)],
                 self._tokenizer.encode_batch, self._share)):
            side = [i for i, c in enumerate(chosen) if c]
            for at in range(0, len(side), 16 * TOGETHER):
                part = side[at:at + 16 * TOGETHER]
                groups = [part[i:i + TOGETHER] for i in range(0, len(part), TOGETHER)]
                texts = [self._between.join([plain[i] for i in g]) for g in groups]
                encoded = encode(texts, add_special_tokens=False)
                for group, one in zip(groups, encoded, strict=True):
                    share(group, plain, one, found)
        alone = [i for i, j in enumerate(joins) if not j]
        for at in range(0, len(alone), 4096):
            part = alone[at:at + 4096]
            for i, ids in zip(part, self._whole(pa.array([plain[i] for i in part])),
                              strict=True):
                found[plain[i]] = ids

    def _share_words(self, group: list[int], plain: list[str], encoded,
                     found: dict[str, np.ndarray]) -> None:
        """The same for pieces of one word each, by the ids that open or close a word."""
        ids = np.array(encoded.ids, dtype="<u4")
        edges = np.flatnonzero(self._edge[ids])
        if len(edges) != len(group):
            joined = self._between.join([plain[i] for i in group])
            return self._share(group, plain, self._tokenizer.encode(
                joined, add_special_tokens=False), found)
        ends = (edges + 1 if self._between else np.append(edges[1:], len(ids))).tolist()
        start = 0
        for i, end in zip(group, ends, strict=True):
            found[plain[i]] = ids[start:end]
            start = end

    def _share(self, group: list[int], plain: list[str], encoded,
               found: dict[str, np.ndarray]) -> None:
        """Gives the ids of a joined text to the pieces in which they begin."""
        ids = np.array(encoded.ids, dtype="<u4")
        begins = np.array([o[0] for o in encoded.offsets], dtype=np.int64)
        lengths = np.array([len(plain[i]) + len(self._between) for i in group])
        ends = np.searchsorted(begins, np.cumsum(lengths)).tolist()
        start = 0
        for i, end in zip(group, ends, strict=True):
            found[plain[i]] = ids[start:end]
            start = end


def _is_word(text: str) -> bool:
    """Letters that stay letters when they are normalised and lower-cased."""
    return text.isalpha() and (text.isascii() or (
        unicodedata.is_normalized("NFC", text) and text.lower().isalpha()))


def _cutter(spec: dict) -> str | None:
    """How texts may be cut without changing their ids; None if that is not known.

    The pattern of byte-level tokenizers takes one space along with the characters that
    follow, and longer runs of white space but for their last character. So there is always
    a border before a last space that a character follows.
    """
    before = spec.get("pre_tokenizer") or {}
    if spec.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get(
            "use_regex") and not before.get("add_prefix_space"):
        return "before spaces"
    steps = before.get("pretokenizers", [])
    if steps and steps[0].get("type") == "Split" and steps[0].get(
            "behavior") == "Removed" and steps[0].get("invert"):
        pattern = steps[0]["pattern"].get("Regex", "")
        if r"\s" in pattern and " " not in pattern:  # no match takes white space
            return "at blanks"
    return None


def _knows_parts(spec: dict) -> bool:
    """Whether the tokenizer's parts of common letters are those found here."""
    if _cutter(spec) == "before spaces":
        return True
    kinds = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    return (_cutter(spec) == "at blanks" and kinds == ["NFC", "Replace", "Lowercase"]
            and steps[0]["pattern"] == {"Regex": WORD_PATTERN}
            and [s.get("type") for s in steps] == ["Split", "ByteLevel"]
            and not steps[1].get("use_regex") and not steps[1].get("add_prefix_space"))


def _byte_kinds(spec: dict) -> tuple[np.ndarray, np.ndarray]:
    """What each byte is, and which ones are odd: all but blanks, if parts are not known."""
    kinds = np.full(256, _OTHER, dtype=np.uint8)
    kinds[0x80:] = _LETTER
    for i in range(128):
        if chr(i).isalpha():
            kinds[i] = _LETTER
        elif chr(i).isdigit():
            kinds[i] = _DIGIT
    kinds[list(_BLANKS)] = _BLANK
    odd = kinds != _BLANK
    if _knows_parts(spec):
        odd[0x21:0x7F] = False
        odd[0x80:0xC0] = False  # odd by the byte before
        odd[0xC3] = False
    return kinds, odd


def _byte_letters() -> np.ndarray:
    """The code points by which byte-level vocabularies write the bytes."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = np.zeros(256, dtype=np.uint32)
    letters[shown] = shown
    hidden = np.setdiff1d(np.arange(256), shown)
    letters[hidden] = 256 + np.arange(len(hidden))
    return letters


def slices_of_bytes(column: pa.Array, most: int) -> Iterator[pa.Array]:
    """Consecutive texts of about `most` bytes together."""
    sizes = pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    start = 0
    while start < len(column):
        before = int(ends[start - 1]) if start else 0
        end = min(len(column), int(np.searchsorted(ends, before + most)) + 1)
        yield column.slice(start, end - start)
        start = end

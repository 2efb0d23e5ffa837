"""Encoding of whole texts with a public tokenizer, fast and exact: pieces between safe boundaries, each encoded once.

The byte-level pattern lets a single space between two non-space characters belong only to what follows
it, so no token ever spans the place before such a space: a text may be cut there and the parts encoded on
their own with the same ids. Texts are cut at all such places; most pieces are words that come again and again, and
their ids are kept in a bounded table of the Python worker. Arrow cuts an array of texts, finds its distinct pieces and puts the ids of each text together, so Python meets a piece once an array.
Before a line end that follows a non-space character no token spans either, so texts are cut there too. Pieces that are not in the table go to the library in batches, many pieces joined by single spaces as one text, whose ids are cut
where a token begins with a space. A special string inside a text has no space in it, so it is never cut, and a piece with one goes to the library on its own
(``check_safe`` holds for tokenizers with that pattern, without normalizer and post-processor only; others encode whole texts).
"""

from __future__ import annotations

import json
import re
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

KEPT_PIECES = 600_000
KEPT_LENGTH = 40
BATCH_BYTES = 1 << 20
BATCH_PIECES = 1 << 14
#: What ``encode_array`` is best given at a time: the larger, the fewer pieces are met again.
SLICE_ROWS, SLICE_BYTES = 4000, 4 << 20


class PieceEncoder:
    """Ids of texts as little-endian bytes (2 a token if the vocabulary allows, else 4), by pieces."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.dtype = np.dtype(f"<u{self.width}")
        self.safe = check_safe(spec)
        self.kept: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        #: Whether an id's token begins with the byte-level vocabularies' sign for a space: in texts cut at safe boundaries, only the first token of a piece does.
        self.begins = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=bool)
        self.begins[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True
        #: Whether an id is a single line end.
        self.lines = np.zeros(len(self.begins), dtype=bool)
        self.lines[[i for token, i in vocabulary.items() if token == "\u010a"]] = True
        special = [t["content"] for t in spec.get("added_tokens", [])]
        #: Pieces that go to the library one by one: a space inside, or a special string's first two characters.
        begins = sorted({re.escape(x[:2]) for x in special})
        self.odd = re.compile("|".join([" ", *begins]))
        self.special = re.compile("|".join(begins)) if begins else None
        #: The vocabulary's own model on words that are cut already, in the byte-level alphabet: its first step, which looks for words in text, is left out.
        self.words = Tokenizer(self.tokenizer.model)
        self.words.pre_tokenizer = CharDelimiterSplit(" ")

    def encode_whole(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        batch, size = [], 0
        for i, text in enumerate(texts):
            batch.append(text)
            size += len(text)
            if size >= BATCH_BYTES or i == len(texts) - 1:
                out += [np.asarray(e.ids, dtype=self.dtype) for e in self.tokenizer.encode_batch_fast(batch, add_special_tokens=False)]
                batch, size = [], 0
        return out

    def encode_words(self, words: list[str], sign: str) -> np.ndarray:
        """The ids of words of letters, each after a space or a line's end (``sign``, as ``ALPHABET`` spells it)."""
        text = ALPHABET[np.frombuffer((sign + f" {sign}".join(words)).encode(), dtype=np.uint8)].tobytes().decode("utf-16-le")
        return np.asarray(self.words.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=self.dtype)

    def cut(self, pieces: list[str], encode, begins: np.ndarray, out: dict[str, bytes]) -> bool:
        """Puts the ids of ``pieces``, encoded many at a time, into ``out``; false where their boundaries (the ids that ``begins`` marks) are not clear."""
        for at in range(0, len(pieces), BATCH_PIECES):
            part = pieces[at : at + BATCH_PIECES]
            ids = encode(part)
            places = np.flatnonzero(begins[ids])
            if len(places) != len(part):
                return False
            data, ends = ids.tobytes(), [*(places[1:] * self.width).tolist(), len(ids) * self.width]
            out.update(zip(part, map(data.__getitem__, map(slice, [0, *ends[:-1]], ends))))
        return True

    def learn(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of distinct pieces, each as it stands after a space; those that begin with line ends have none before them."""
        out: dict[str, bytes] = {}
        kept, tails = self.kept, self.tails
        array = pa.array(pieces, pa.string())
        stripped = pc.ascii_rtrim(array, SIGNS)
        n_signs = pc.subtract(pc.binary_length(array), pc.binary_length(stripped)).to_numpy()
        usual = pc.match_substring_regex(stripped, LETTERS).to_numpy(zero_copy_only=False) & (n_signs <= 8)
        # one look at all pieces tells whether each has to be looked at
        if self.special is not None and self.special.search("\n".join(pieces)):
            odd = np.array([self.odd.search(p) is not None for p in pieces])
        else:
            odd = pc.match_substring(array, " ").to_numpy(zero_copy_only=False)
        usual &= ~odd
        cores = strings(stripped.filter(pa.array(usual)))
        # a word and the signs after it are tokens apart, and most words are known
        with_tail = [(pieces[i], core, pieces[i][len(core) :]) for i, core, n in zip(np.flatnonzero(usual).tolist(), cores, n_signs[usual].tolist()) if n]
        words = set(cores).difference(kept)
        after_space, after_line = [w for w in words if w[0] != "\n"], [w for w in words if w[0] == "\n"]
        plain = [p for p in strings(array.filter(pa.array(~usual & ~odd))) if p[0] != "\n"]
        new = list({tail for _, _, tail in with_tail}.difference(tails))
        tails.update(zip(new, (ids.tobytes() for ids in self.encode_whole(new))))
        # many pieces are one text to the library; a boundary stands before each, and each has one space or line end, its first character
        done = self.cut(after_space, lambda part: self.encode_words(part, "\x01"), self.begins, out)
        done = done and self.cut(after_line, lambda part: self.encode_words([w[1:] for w in part], "\x02 "), self.lines, out)
        if done and self.cut(plain, lambda part: self.encode_whole([" " + " ".join(part)])[0], self.begins, out):
            out.update([(piece, (out.get(core) or kept[core]) + tails[tail]) for piece, core, tail in with_tail])
        else:
            out.clear()
        whole = [p for p in pieces if p not in out]
        for piece, ids in zip(whole, self.encode_whole([p if p[0] == "\n" else " " + p for p in whole])):
            out[piece] = ids.tobytes()
        if len(tails) > 10_000:
            tails.clear()
        return out

    def encode_array(self, texts: pa.Array, end: bytes = b"") -> pa.Array:
        """The ids of each text and ``end`` after them, as binary values. Texts are cut and put together in Arrow; Python sees each distinct piece of the array once."""
        if not self.safe or not len(texts):
            return pa.array([ids.tobytes() + end for ids in self.encode_whole(texts.to_pylist())], pa.binary())
        odd = pc.match_substring_regex(texts, ODD_SPACES).to_numpy(zero_copy_only=False)
        parts, bounds = lists(pc.split_pattern(marked_lines(texts.filter(pa.array(~odd)) if odd.any() else texts), " "))
        if odd.any():
            more, more_bounds = lists(pa.array([[head, *pieces] for head, pieces in map(pieces_of, texts.filter(pa.array(odd)).to_pylist())], pa.list_(pa.string())))
            parts, bounds = pa.concat_arrays([parts, more]), np.concatenate([bounds, more_bounds[1:] + bounds[-1]])
        coded = parts.dictionary_encode()
        pieces, places = strings(coded.dictionary), coded.indices.to_numpy().astype(np.int64)
        starts = bounds[:-1]
        # a text's head is encoded without a space before it
        heads, head_of = np.unique(places[starts], return_inverse=True)
        body = np.ones(len(places), dtype=bool)
        body[starts] = False
        used = np.zeros(len(pieces), dtype=bool)
        used[places[body]] = True
        kept = self.kept
        got = list(map(kept.get, pieces))
        missing = [i for i, (ids, u) in enumerate(zip(got, used.tolist())) if u and ids is None]
        if missing:
            learnt = self.learn([pieces[i] for i in missing])
            for i in missing:
                got[i] = learnt[pieces[i]]
            # once the table is full, nothing goes in and nothing has to be taken out again
            kept.update(islice(((p, ids) for p, ids in learnt.items() if len(p) <= KEPT_LENGTH), KEPT_PIECES - len(kept)))
        places[starts] = len(pieces) + head_of
        values = [*got, *(ids.tobytes() for ids in self.encode_whole([pieces[i] for i in heads.tolist()])), end]
        if end:
            places, bounds = np.insert(places, bounds[1:], len(values) - 1), bounds + np.arange(len(bounds))
        joined = pa.array(values, pa.binary()).take(pa.array(places))
        ends = np.frombuffer(joined.buffers()[1], dtype=np.int32)[joined.offset :][bounds]
        out = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), joined.buffers()[2] or pa.py_buffer(b"")])
        return out.take(pa.array(np.argsort(np.concatenate([np.flatnonzero(~odd), np.flatnonzero(odd)])))) if odd.any() else out

    def ids(self, coded: pa.Array) -> np.ndarray:
        """All ids of what ``encode_array`` returned, one text's after the other's."""
        _, offsets, data = coded.buffers()
        bounds = np.frombuffer(offsets, dtype=np.int32)[coded.offset : coded.offset + len(coded) + 1]
        return np.frombuffer(data[int(bounds[0]) : int(bounds[-1])], dtype=self.dtype) if data is not None and len(coded) else np.zeros(0, dtype=self.dtype)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as bytes."""
        return self.encode_array(pa.array(texts, pa.string())).to_pylist()


def strings(array: pa.Array) -> list[str]:
    """The values of an array, many times as fast as ``to_pylist``."""
    return array.to_numpy(zero_copy_only=False).tolist()


def lists(array: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The values of a list array, and where each list begins and the last one ends."""
    bounds = array.offsets.to_numpy().astype(np.int64)
    return array.flatten(), bounds - bounds[0]


def marked_lines(texts: pa.Array) -> pa.Array:
    """Texts with a space more before each run of line ends, so that they are cut there too: no token spans the place between a non-space and a line end."""
    out = pc.replace_substring(texts, "\n", " \n")
    if pc.any(pc.match_substring(texts, "\n\n")).as_py():
        # the first time joins a run's line ends by twos, the second time these
        out = pc.replace_substring(pc.replace_substring(out, "\n \n", "\n\n"), "\n \n", "\n\n")
    return out


#: Pieces of letters (perhaps on a new line) with signs after them, which the published pattern takes for a word and one run of signs.
SIGNS = r"""!"#$%&()*+,./:;<=>?@[\]^_`{|}~-"""
LETTERS = "^\n?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f]+$"
#: How byte-level vocabularies spell the bytes of such letters that are no ASCII.
BYTE_LEVEL = {b: chr(b) if 0xA1 <= b <= 0xFF and b != 0xAD else chr(0x100 + 33 + b - 0x7F if b < 0xA1 else 0x143) for b in range(0x80, 0x100)}
#: The same as UTF-16 units by byte, with signs for a space and for a line's end.
ALPHABET = np.array([0, 0x120, 0x10A, *range(3, 0x80), *(ord(BYTE_LEVEL[b]) for b in range(0x80, 0x100))], dtype="<u2")
#: White space other than the space, beside which no boundary is.
OTHER_SPACES = "[\t\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
OTHER_SPACE = re.compile(OTHER_SPACES)
#: Texts with white space beside a space, which are cut by ``pieces_of``.
ODD_SPACES = "^ | $|  |\n | \n|" + OTHER_SPACES


def pieces_of(text: str) -> tuple[str, list[str]]:
    """The head (up to the first safe boundary) and the pieces after boundaries, without their leading space.

    A boundary is a space with a non-space before it and after it. Where white space stands beside the space, the parts stay joined.
    """
    parts = text.split(" ")
    if len(parts) == 1:
        return text, []
    if all(parts) and "\n " not in text and " \n" not in text and not OTHER_SPACE.search(text):
        return parts[0], parts[1:]
    out = [parts[0]]
    joined: list[str] = []
    for part in parts[1:]:
        before, after = (joined or out)[-1][-1:], part[:1]
        if before and after and not before.isspace() and not after.isspace():
            if joined:
                out[-1] = " ".join([out[-1], *joined])
                joined = []
            out.append(part)
        else:
            joined.append(part)
    if joined:
        out[-1] = " ".join([out[-1], *joined])
    return out[0], out[1:]


def check_safe(spec: dict) -> bool:
    """Whether the tokenizer cuts words by the byte-level pattern, so that ``pieces_of`` is exact."""
    pre = spec.get("pre_tokenizer") or {}
    plain = spec.get("normalizer") is None and spec.get("post_processor") is None and spec.get("truncation") is None and spec.get("padding") is None
    byte_level = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True)
    added = all(not t["lstrip"] and not t["rstrip"] and not any(c.isspace() for c in t["content"]) for t in spec.get("added_tokens", []))
    model = spec.get("model", {})
    return plain and byte_level and added and model.get("type") == "BPE" and not model.get("dropout")


@lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    """One encoder for each Python worker and vocabulary."""
    return PieceEncoder(path)

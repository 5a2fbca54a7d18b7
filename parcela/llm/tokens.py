"""Token ids of whole texts through a public tokenizer file, whose path is a parameter.

The tokenizer of ``word_bpe_49k.json`` lower-cases, never lets a token cross
white space, and its normaliser works on each stretch between ASCII white space
alone. A text is therefore split there and each distinct stretch, told by a
64-bit hash of its bytes with A-Z lower-cased, is encoded once, into a memo that
is emptied at ``MEMO`` stretches. A stretch of letters, perhaps with a run of
ASCII punctuation after it, is merged by the byte-pair core of tiktoken over the
same vocabulary (a word's end is a byte that UTF-8 never has, so that the
vocabulary's word ends are ordinary merges); any other goes through the
tokenizers library. The tests hold both against it.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from collections.abc import Iterator
from itertools import accumulate, chain, compress
from operator import not_
from string import punctuation

import numpy as np

from .wordhash import WordHasher

MEMO = 100_000
#: Texts are split and gathered in groups of about so many bytes.
GROUP_BYTES = 1 << 20
#: Longer stretches are left to the tokenizers library.
LONG = 64
WORD_BPE = "word_bpe_49k.json"
END_ID = 1
WORD_END = b"\xff"
#: Stretches that are known from the start: comma and full stop, by keys that stand for nothing else.
MARKS = {44: -1, 46: -2}
LETTER = np.array([chr(i).isalpha() and i < 128 for i in range(256)])


def tokenizer_path(name: str = WORD_BPE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write printable Latin-1 bytes as themselves and the others, in order, from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Encoder:
    """Encodes UTF-8 texts; make one for each task."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        of, ranks = _byte_of_char(), {}
        merged = {i for i in range(512)} | {model["vocab"]["".join(m.split() if isinstance(m, str) else m)] for m in model["merges"]}
        for token, i in model["vocab"].items():
            if i in merged:
                end = token.endswith("</w>")
                ranks[bytes(of[c] for c in (token[:-4] if end else token)) + WORD_END * end] = i
        self.merge = tiktoken.Encoding("word", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.hasher = WordHasher()
        self._clear()

    def _clear(self) -> None:
        self.number: dict[int, int] = {}
        self.flat, self.starts = array("I"), array("q", [0])

    def _learn(self, keys: list[int], stretches: list[bytes]) -> None:
        merge, rest = self.merge, []
        plain = [w.isalpha() and len(w) <= LONG for w in stretches]  # ASCII letters
        order = list(compress(keys, plain))
        found = [merge(w + WORD_END) for w in compress(stretches, plain)]
        for key, w in compress(zip(keys, stretches, strict=True), map(not_, plain)):
            s = w.decode("utf-8", "replace")
            word = s.rstrip(punctuation)
            low = word.lower()
            if not (word.isalpha() and low.isalpha() and len(w) <= LONG and "Σ" not in word and unicodedata.is_normalized("NFC", word)):
                rest.append((key, s))
                continue
            order.append(key)
            ids, tail = merge(low.encode() + WORD_END), s[len(word) :]
            found.append(ids + merge(tail.encode() + WORD_END) if tail else ids)
        if rest:
            order += [k for k, _ in rest]
            found += [e.ids for e in self.tokenizer.encode_batch([s for _, s in rest], add_special_tokens=False)]
        self.number.update(zip(order, range(len(self.number), len(self.number) + len(order)), strict=True))
        self.flat.extend(chain.from_iterable(found))
        self.starts.extend(accumulate(map(len, found), initial=self.starts.pop()))

    def _group(self, texts: list[bytes]) -> list[np.ndarray]:
        if not texts:
            return []
        if len(self.number) > MEMO:
            self._clear()
        joined = b"\n".join(texts)
        if not self.number:
            self._learn([MARKS[c] for c in MARKS], [bytes([c]) for c in MARKS])
        data = np.frombuffer(joined, np.uint8)
        starts, ends = self.hasher.bounds(data)
        # a comma or full stop after an ASCII letter is a token of its own
        last, before = data[ends - 1], data[ends - 2]
        marked = ((last == 44) | (last == 46)) & (ends - starts > 1) & LETTER[before]
        keys = self.hasher.hashes(data, starts, ends - marked)
        distinct, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        known = self.number
        fresh = [i for i, k in enumerate(distinct.tolist()) if k not in known]
        lower = joined.lower()
        at, to = starts[first], (ends - marked)[first]
        self._learn(distinct[fresh].tolist(), [lower[a:b] for a, b in zip(at[fresh].tolist(), to[fresh].tolist(), strict=True)])
        numbers = np.fromiter(map(known.__getitem__, distinct.tolist()), np.int64, len(distinct))
        shift = np.cumsum(marked) - marked
        units = np.empty(len(starts) + int(marked.sum()), np.int64)
        place = np.arange(len(starts)) + shift
        units[place] = numbers[inverse]
        for c, k in MARKS.items():
            units[place[marked & (last == c)] + 1] = known[k]
        flat, offsets = np.frombuffer(self.flat, np.uint32).copy(), np.array(self.starts, np.int64)
        begin = offsets[units]
        length = offsets[units + 1] - begin
        total = np.concatenate([[0], np.cumsum(length)])
        ids = flat[np.arange(total[-1]) + np.repeat(begin - total[:-1], length)]
        words = np.searchsorted(starts, np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]))
        cuts = total[np.append(place, len(units))[words]]
        return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def encode(self, texts: list[bytes | None]) -> Iterator[np.ndarray]:
        """uint32 ids of each text; a null text has none. Long texts are cut at white space, which no token crosses."""
        group, size = [], 0
        for t in texts:
            if t is not None and len(t) > GROUP_BYTES:
                yield from self._group(group)
                group, size = [], 0
                yield np.concatenate([self._group([part])[0] for part in _parts(t)])
                continue
            group.append(t or b"")
            size += len(group[-1])
            if size >= GROUP_BYTES:
                yield from self._group(group)
                group, size = [], 0
        yield from self._group(group)


def _parts(text: bytes) -> Iterator[bytes]:
    start = 0
    while start < len(text):
        end = start + GROUP_BYTES
        if end < len(text):
            spaces = [text.rfind(c, start, end) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")]
            end = max(spaces) + 1
            if end <= start:  # one stretch of over GROUP_BYTES: on to its end
                found = [x for x in (text.find(c, start + GROUP_BYTES) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")) if x >= 0]
                end = min(found) + 1 if found else len(text)
        yield text[start:end]
        start = end

"""Token ids of whole texts, equal to those of the tokenizers library on the whole text.

Both vocabularies cut a text into pretokens before any merge, so a pretoken's
ids are the same alone as within its text, and a worker lets the library encode
each distinct one once. Texts of plain Latin characters are cut into pretokens
here, by the vocabulary's own pattern. Others are cut at white space only,
where no pretoken crosses, and encoded whole if even that is not certain, or if they hold the
string of an added token, which the library finds before it cuts.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np

#: Pretokens, and bytes of them and their ids, after which a worker remembers no more; the others are
#: encoded each time, as are units longer than ``LONG``, which seldom come again.
REMEMBERED, REMEMBERED_BYTES, LONG = 400_000, 100_000_000, 64

# Latin-1 letters and numbers, and the vocabularies' pretoken patterns over them.
_L = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
_N = "0-9²³¹¼½¾"
_SHORT = "'(?:s|t|re|ve|m|ll|d)"
_BYTE_PRETOKEN = re.compile(rf"{_SHORT}| ?[{_L}]+| ?[{_N}]+| ?[^\s{_L}{_N}]+|\s+(?!\S)|\s+")
_WORD_PRETOKEN = re.compile(rf"{_SHORT}|[{_L}]+|[{_N}]|[^\s{_L}{_N}]+")
_BYTE_LETTERS = re.compile(f" [{_L}]+").fullmatch
_WORD_LETTERS = re.compile(f"[{_L}]+").fullmatch
#: Bytes of the Latin-1 texts that are cut into pretokens here.
_PLAIN = bytes([9, 10, 13, *range(32, 127), *range(161, 256)])

#: Coarser units of any text: a run without white space, with the one space before it.
_BYTE_UNIT = re.compile(r" ?[^\s]+|\s+(?!\S)|\s+")
#: Characters that Python and the library's patterns class differently as white space.
_ODD = re.compile("[\x1c-\x1f\x85\u180e\u200b\u2060\ufeff]")
#: Pretokens of letters that are encoded in one call, as one text.
JOINED = 200


def plain(text: str) -> bool:
    try:
        return not text.encode("latin-1").translate(None, _PLAIN)
    except UnicodeEncodeError:
        return False


@lru_cache(maxsize=4)
def tokenizer(name: str):
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


class Encoder:
    """Encodes texts; a remembered pretoken is encoded once."""

    def __init__(self, name: str):
        self.name = name
        self.by_word = name.startswith("word")
        self.letters = _WORD_LETTERS if self.by_word else _BYTE_LETTERS
        self.known: dict[str, bytes] = {}
        self.held = 0
        # the library looks for these in the whole text before it cuts it
        added = tokenizer(name).get_added_tokens_decoder().values()
        self.whole = re.compile("|".join(re.escape(t.content) for t in added), re.IGNORECASE)
        self.mark = "<" if all(t.content[0] == "<" for t in added) else ""
        vocabulary = tokenizer(name).get_vocab()
        #: Ids that end a pretoken of letters, or that begin one with its space.
        self.edge = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, number in vocabulary.items():
            self.edge[number] = token.endswith("</w>") if self.by_word else token[0] == "Ġ"

    def split(self, text: str) -> list[str]:
        if self.mark in text and self.whole.search(text):
            return [text]
        if plain(text):
            return (
                _WORD_PRETOKEN.findall(text.lower())
                if self.by_word
                else _BYTE_PRETOKEN.findall(text)
            )
        if _ODD.search(text):
            return [text]
        return text.split() if self.by_word else _BYTE_UNIT.findall(text)

    def _encode_each(self, units: list[str]) -> dict[str, bytes]:
        found = tokenizer(self.name).encode_batch_fast(units, add_special_tokens=False)
        return {u: np.array(x.ids, "<u4").tobytes() for u, x in zip(units, found)}

    def _encode_letters(self, units: list[str]) -> dict[str, bytes]:
        """Pretokens of letters, many to a text; their ids are told apart by the edges."""
        joint = (" " if self.by_word else "").join
        groups = [units[i : i + JOINED] for i in range(0, len(units), JOINED)]
        found = tokenizer(self.name).encode_batch_fast(
            [joint(g) for g in groups], add_special_tokens=False
        )
        out = {}
        for group, x in zip(groups, found):
            ids = np.array(x.ids, "<u4")
            edges = np.flatnonzero(self.edge[ids])
            edges = np.r_[0, edges + 1] if self.by_word else np.r_[edges, len(ids)]
            if len(edges) != len(group) + 1 or edges[0] != 0 or edges[-1] != len(ids):
                out |= self._encode_each(group)
                continue
            data, at = ids.tobytes(), (4 * edges).tolist()
            out |= {u: data[a:b] for u, a, b in zip(group, at, at[1:])}
        return out

    def _encode_units(self, units: list[str]) -> dict[str, bytes]:
        letters = [u for u in units if self.letters(u)]
        rest = [u for u in units if not self.letters(u)]
        return self._encode_letters(letters) | self._encode_each(rest)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of every text as little-endian unsigned 32-bit integers."""
        units = list(map(self.split, texts))
        flat = list(chain.from_iterable(units))
        ids = list(map(self.known.get, flat))
        holes = [i for i, x in enumerate(ids) if x is None]
        if holes:
            fresh = self._encode_units(sorted({flat[i] for i in holes}))
            for i in holes:
                ids[i] = fresh[flat[i]]
            if len(self.known) < REMEMBERED and self.held < REMEMBERED_BYTES:
                short = {u: x for u, x in fresh.items() if len(u) <= LONG}
                self.known.update(short)
                self.held += sum(200 + 2 * len(u) + len(x) for u, x in short.items())
        ends = list(accumulate(map(len, units)))
        return [b"".join(ids[a:b]) for a, b in zip([0, *ends], ends)]


@lru_cache(maxsize=4)
def encoder(name: str) -> Encoder:
    """The encoder that this worker process keeps."""
    return Encoder(name)

"""Token ids of whole texts, as the tokenizer file gives them, without special tokens.

The tokenizer drops white space and never looks across it. Text of plain Latin letters, digits, signs
and white space falls into words by the tokenizer's own pattern; the ids of a text are those of its
words, in order. Words are kept in two generations of bounded size per Python worker, and new ones
are encoded many at a time. Other text is cut at white space, and its parts that aren't plain are
encoded as they are."""

from __future__ import annotations

import gc
import json
import os
import re

import numpy as np

_FILE = "word_bpe_49k.json"
#: The white space that the tokenizer's normaliser replaces (Unicode White_Space).
_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: Characters that normalise to themselves or their lower case, and the tokenizer's pattern on them.
_PLAIN = re.compile("[\t-\r -~\xc0-\xd6\xd8-\xf6\xf8-\xff]*").fullmatch
_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^\\sa-z\xdf-\xf6\xf8-\xff0-9]+").findall
KEEP, LONGEST, SLICE, JOINED = 300_000, 48, 1 << 20, 1024
_END = "</w>"
_state: dict[str, Encoder] = {}


def plain(text: str) -> bool:
    return _PLAIN(text) is not None and "<|" not in text


def words(text: str, odd: set[str]) -> list[str]:
    """Words of plain text, and whole parts of other text, which are put into odd; no word equals
    such a part."""
    if plain(text):
        return _WORDS(text.lower())
    out = []
    for part in _SPACE.split(text):
        if plain(part):
            out += _WORDS(part.lower())
        else:
            out.append(part)
            odd.add(part)
    return out


class Kept:
    """A mapping of the last KEEP to 2 KEEP short keys that were used."""

    def __init__(self):
        self.new, self.old = {}, {}

    def fill(self, keys: set[str], make) -> dict[str, bytes]:
        """The mapping with all keys in it, those unknown made at once."""
        if len(self.new) > KEEP:
            self.new, self.old = {}, {k: v for k, v in self.new.items() if len(k) <= LONGEST}
        missing = []
        for k in keys.difference(self.new):
            v = self.old.get(k)
            if v is None:
                missing.append(k)
            else:
                self.new[k] = v
        if missing:
            self.new.update(make(missing))
        return self.new


class Encoder:
    """The tokenizer, and its model alone for words that are normal already."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path, self.tokenizer = path, None
        split = {"type": "WhitespaceSplit"}
        signs = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
        bare = spec | {"normalizer": None, "added_tokens": []}
        self.ascii = Tokenizer.from_str(json.dumps(bare | {"pre_tokenizer": split}))  # there a byte's sign is itself
        self.latin = Tokenizer.from_str(json.dumps(bare | {"pre_tokenizer": {"type": "Sequence", "pretokenizers": [split, signs]}}))
        vocab = spec["model"]["vocab"]
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[k for t, k in vocab.items() if t.endswith(_END)]] = True
        self.kept = Kept()

    def one_by_one(self, items: list[str]) -> dict[str, bytes]:
        if self.tokenizer is None:  # seldom needed, and 20 MB
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(self.path)
        got = self.tokenizer.encode_batch(items, add_special_tokens=False)
        return {p: np.array(e.ids, dtype="<u4").tobytes() for p, e in zip(items, got)}

    def joined(self, words: list[str], model) -> dict[str, bytes]:
        """Words encoded in lines. The last piece of a word, and no other, is one that ends words."""
        out = {}
        for c in range(0, len(words), JOINED):
            some = words[c : c + JOINED]
            ids = np.array(model.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.nonzero(self.ends[ids])[0] + 1
            if len(ends) != len(some):
                out |= self.one_by_one(some)
                continue
            raw, ends = ids.tobytes(), (4 * ends).tolist()
            out.update(zip(some, map(raw.__getitem__, map(slice, [0, *ends], ends))))
        return out

    def run(self, texts: list[str | None]) -> list[bytes]:
        odd: set[str] = set()
        split = [words(t, odd) if t else [] for t in texts]

        def make(items):
            out = self.one_by_one([p for p in items if p in odd]) if odd else {}
            rest = [p for p in items if p not in odd] if odd else items
            out |= self.joined([p for p in rest if p.isascii()], self.ascii)
            return out | self.joined([p for p in rest if not p.isascii()], self.latin)

        known = self.kept.fill(set().union(*split), make).__getitem__
        return [b"".join(map(known, s)) for s in split]

    def encode(self, texts: list[str | None]):
        for some in _slices(texts):
            on = gc.isenabled()
            gc.disable()  # strings and bytes alone, which hold no cycles, but their number sets it off
            try:
                out = self.run(some)
            finally:
                if on:
                    gc.enable()
            yield from out


def _slices(texts: list[str | None]):
    """Runs of texts with about SLICE characters, so that a batch's words aren't all held at once."""
    run, size = [], 0
    for t in texts:
        run.append(t)
        size += len(t or "")
        if size >= SLICE:
            yield run
            run, size = [], 0
    if run:
        yield run


def encode(texts: list[str | None], path: str | None = None):
    """Little-endian 32-bit ids of each text in turn; a null is an empty text."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(_FILE)
    if path not in _state:
        _state[path] = Encoder(path)
    return _state[path].encode(texts)

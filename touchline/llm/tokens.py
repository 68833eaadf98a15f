"""Token ids of whole texts by a public tokenizer, with each distinct part encoded once.

The ids are those of the library's plain call on the whole text. Text is cut where neither
the tokenizer's normaliser nor a match of its split pattern can reach over the cut:

* by default, and for byte-level BPE, where a character that is not white space meets a
  space or a line break;
* for the word tokenizer, at the matches of its own split pattern on the lower-cased text,
  as long as the text has only characters whose lower case and class are settled (Latin
  letters and common punctuation, ``_ODD``).

Texts with anything else, or with the string of a special token, are given to the library
whole. New parts of byte-level BPE are merged by rank, which is the same vocabulary; new
words go to the tokenizer's model without normaliser and pattern. What a part encodes to
is remembered by each Python worker, up to ``CACHE`` parts; beyond that, those used least
are forgotten.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Callable

import numpy as np

#: Parts that a worker remembers (some 150 MB).
CACHE = 900_000
#: Parts that stay when there are too many.
KEEP = 600_000
#: Parts that are turned into ids at a time.
STEP = 500_000
#: Longer parts go to the library; merging by rank has no bound on its stack.
LONG = 1_000

_OTHER_SPACE = re.compile(r"[^\S \n]")
_encoders: dict[tuple[str, bool, bool], Encoder] = {}

# The split patterns that the two kinds of tokenizers name.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WORD_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"""

#: Characters that words are not cut around: their texts are encoded whole.
_ODD = re.compile("[^\\t\\n\\r -~\u00a1-\u012f\u0131-\u017f\u2010-\u2027\u2030-\u205e\u20ac]")


def _class(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(0x180) if unicodedata.category(chr(c))[0] == kind)


#: ``WORD_SPLIT`` for texts without ``_ODD`` characters.
_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_class('L')}]+|[{_class('N')}]|"
                    f"[^ \\t\\n\\r{_class('L')}{_class('N')}]+")


def tokenizer(path: str, plain: bool = False):
    """The library's tokenizer; with ``plain``, strings of special tokens are plain text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    if plain:
        made.encode_special_tokens = True
    return made


class Encoder(dict):
    """part -> its number in the table of ids."""

    def __init__(self, encode_many: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], spaces: bool,
                 split: Callable[[str], list[str] | None] | None = None,
                 whole: Callable[[str], np.ndarray] | None = None):
        """``split`` gives a text's parts, or None if ``whole`` has to encode it."""
        super().__init__()
        self.encode_many = encode_many
        self.part = 1  # of CACHE and KEEP
        self.split = split or (lambda text: None if _OTHER_SPACE.search(text) else self.parts(text))
        self.whole = whole or (lambda text: encode_many([text])[0])
        # With spaces, a part keeps those before it; without, they are dropped.
        self.parts = re.compile(r"[ \n]*[^ \n]+|[ \n]+" if spaces else r"[^ \n]+").findall
        self.pending: list[str] = []
        self.ids = np.zeros(1 << 16, np.uint32)
        self.bounds = np.zeros(1 << 16, np.int64)
        self.uses = np.zeros(1 << 16, np.uint32)

    def forget(self) -> None:
        """Keep the parts that were used most; older uses count less each time."""
        parts, uses = list(self), self.uses[:len(self)]
        kept = np.sort(np.argsort(~uses, kind="stable")[:int(KEEP * self.part)])
        ids, bounds = self.gather(kept)
        self.clear()
        self.update((parts[k], number) for number, k in enumerate(kept.tolist()))
        self.ids[:ids.size], self.bounds[:bounds.size] = ids, bounds
        self.uses[:kept.size] = uses[kept] // 2
        self.uses[kept.size:] = 0

    def numbers(self, parts: list[str]) -> np.ndarray:
        """The number of each part, after new ones have been encoded."""
        if len(self) > CACHE * self.part:
            self.forget()
        found = np.fromiter(map(self.__getitem__, parts), np.int64, len(parts))
        if self.pending:
            self.settle()
        used = np.bincount(found)
        self.uses[:used.size] += used.astype(np.uint32)
        return found

    def __missing__(self, part: str) -> int:
        number = self[part] = len(self)
        self.pending.append(part)
        return number

    def settle(self) -> None:
        """Encode the parts met for the first time."""
        known = len(self) - len(self.pending)
        for at in range(0, len(self.pending), 10_000):
            ids, sizes = self.encode_many(self.pending[at:at + 10_000])
            bounds = np.cumsum(sizes) + self.bounds[known]
            while bounds[-1] > self.ids.size:
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            while known + sizes.size + 1 > self.bounds.size:
                self.bounds = np.concatenate([self.bounds, np.zeros_like(self.bounds)])
                self.uses = np.concatenate([self.uses, np.zeros_like(self.uses)])
            self.ids[self.bounds[known]:bounds[-1]] = ids
            self.bounds[known + 1:known + 1 + sizes.size] = bounds
            known += sizes.size
        self.pending = []

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of parts in a row, and how many there are before each part."""
        first = self.bounds[numbers]
        sizes = self.bounds[numbers + 1] - first
        ends = np.zeros(numbers.size + 1, np.int64)
        np.cumsum(sizes, out=ends[1:])
        # Steps of one inside a part, a jump where the next part begins.
        steps = np.ones(int(ends[-1]), np.int64)
        some = sizes > 0
        first, sizes, at = first[some], sizes[some], ends[:-1][some]
        if at.size:
            steps[at] = first
            steps[at[1:]] -= first[:-1] + sizes[:-1] - 1
        return self.ids[np.cumsum(steps)], ends

    def ids_of(self, parts: list[str]) -> np.ndarray:
        out = [self.gather(self.numbers(parts[at:at + STEP]))[0] for at in range(0, len(parts), STEP)]
        return np.concatenate(out) if out else np.zeros(0, np.uint32)


def _by_words(own) -> Callable:
    """Encode parts as the words of one sequence; word numbers tell the ids apart."""

    def encode_many(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, sizes = [], []
        for at in range(0, len(parts), 1_000):
            some = parts[at:at + 1_000]
            got = own.encode(some, is_pretokenized=True, add_special_tokens=False)
            ids.append(np.array(got.ids, np.uint32))
            sizes.append(np.bincount(np.array(got.word_ids, np.int64), minlength=len(some)))
        return np.concatenate(ids), np.concatenate(sizes)

    return encode_many


def _ranks(config: dict) -> dict[bytes, int] | None:
    """The vocabulary of byte-level BPE as bytes with ranks; None if its ids are not the
    ranks of its merges, or if it is of another kind."""
    step, model = config["pre_tokenizer"] or {}, config["model"]
    if (config["normalizer"] is not None or model["type"] != "BPE" or step.get("type") != "ByteLevel"
            or step["add_prefix_space"] or not step["use_regex"] or model.get("end_of_word_suffix")):
        return None
    vocab, byte_of = model["vocab"], byte_level_table()
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    if any(vocab.get(a + b) != 256 + k for k, (a, b) in enumerate(merges)):
        return None
    special = {t["content"] for t in config["added_tokens"]}
    return {bytes(byte_of[c] for c in token): k for token, k in vocab.items() if token not in special}


def byte_level_table() -> dict[str, int]:
    """Character -> byte in the entries of byte-level vocabularies: printable Latin-1 bytes
    are themselves, the others follow from U+0100 on in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, following = {chr(b): b for b in shown}, 256
    for b in range(256):
        if b not in shown:
            table[chr(following)] = b
            following += 1
    return table


def _by_ranks(ranks: dict[bytes, int], whole: Callable) -> Callable:
    """Encode parts of byte-level BPE. Those that begin with white space and end with none can
    follow one another in one text: what each encodes to is told by its bytes."""
    import tiktoken

    encode = tiktoken.Encoding("parts", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    width = np.zeros(max(ranks.values()) + 1, np.int64)
    width[list(ranks.values())] = [len(token) for token in ranks]

    def encode_many(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        easy = np.fromiter((len(p) <= LONG and p[0] in " \n" and not p[-1].isspace() for p in parts), bool, len(parts))
        sizes = np.zeros(len(parts), np.int64)
        several = [p for p, e in zip(parts, easy.tolist()) if e]
        ids = np.array(encode("".join(several)), np.uint32)
        ends = np.cumsum(np.fromiter((len(p.encode()) for p in several), np.int64, len(several)))
        last = np.searchsorted(np.cumsum(width[ids]), ends) + 1
        sizes[easy] = np.diff(last, prepend=0)
        if len(several) == len(parts):
            return ids, sizes
        each = np.split(ids, last)
        out, at = [], 0
        for k, (p, e) in enumerate(zip(parts, easy.tolist())):
            if e:
                out.append(each[at])
                at += 1
            else:
                out.append(whole(p) if len(p) > LONG else np.array(encode(p), np.uint32))
                sizes[k] = out[-1].size
        return np.concatenate(out), sizes

    return encode_many


def _is_word_tokenizer(config: dict) -> bool:
    """Lower case, white space dropped, cut by ``WORD_SPLIT``, with word ends."""
    normal, steps = config["normalizer"] or {}, config["pre_tokenizer"] or {}
    return (config["model"].get("end_of_word_suffix") == "</w>"
            and [n.get("type") for n in normal.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
            and [p.get("type") for p in steps.get("pretokenizers", [])] == ["Split", "ByteLevel"]
            and steps["pretokenizers"][0]["pattern"] == {"Regex": WORD_SPLIT}
            and not steps["pretokenizers"][1]["use_regex"])


def _by_model(path: str, config: dict, whole: Callable) -> Callable:
    """Encode words with the model alone; a word's last token, and no other, has a word end."""
    from tokenizers import normalizers, pre_tokenizers

    own = tokenizer(path)
    own.normalizer = normalizers.Sequence([])
    own.pre_tokenizer = pre_tokenizers.Sequence([
        pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    is_end = np.zeros(max(config["model"]["vocab"].values()) + 1, bool)
    is_end[[k for token, k in config["model"]["vocab"].items() if token.endswith("</w>")]] = True

    def encode_many(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lines = [" ".join(words[at:at + 500]) for at in range(0, len(words), 500)]
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in own.encode_batch_fast(lines, add_special_tokens=False)])
        ends = np.flatnonzero(is_end[ids])
        if ends.size != len(words):  # not a vocabulary with word ends everywhere
            each = [whole(w) for w in words]
            return np.concatenate(each), np.array([x.size for x in each])
        return ids, np.diff(ends, prepend=-1)

    return encode_many


def encoder(path: str, spaces: bool, plain: bool = False) -> Encoder:
    """The worker's encoder. ``spaces``: parts keep the white space before them, for
    tokenizers that encode it; ``plain``: strings of special tokens are plain text."""
    key = (path, spaces, plain)
    if key not in _encoders:
        own = tokenizer(path, plain)
        config = json.loads(own.to_str())
        special = [] if plain else [t["content"] for t in config["added_tokens"]]
        has_special = re.compile("|".join(map(re.escape, special))).search if special else lambda text: None

        def whole(text: str) -> np.ndarray:
            return np.array(own.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

        ranks = _ranks(config)
        if _is_word_tokenizer(config):
            made = Encoder(_by_model(path, config, whole), spaces, lambda text: None if _ODD.search(text)
                           or has_special(text) else _WORDS.findall(text.lower()), whole)
        else:
            made = Encoder(_by_ranks(ranks, whole) if ranks else _by_words(own), spaces, lambda text: None
                           if _OTHER_SPACE.search(text) or has_special(text) else made.parts(text), whole)
            # Its parts are cheap to encode again.
            made.part = 0.5 if ranks else 1
        made.library = own
        _encoders[key] = made
    return _encoders[key]


def encode_texts(texts: list[str], path: str, spaces: bool) -> tuple[np.ndarray, np.ndarray]:
    """The ids of several texts together, and each text's bounds among them."""
    return encode_with(encoder(path, spaces), texts)


def encode_with(own: Encoder, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    each = [own.split(t) for t in texts]
    if all(x is not None for x in each) and sum(map(len, texts)) < 4 * STEP:
        # One pass for all texts: a number per part, then all ids at once.
        parts, ends = [], [0]
        for some in each:
            parts += some
            ends.append(len(parts))
        ids, after = own.gather(own.numbers(parts))
        return ids, after[ends]
    each = [own.whole(t) if some is None else own.ids_of(some) for t, some in zip(texts, each)]
    bounds = np.zeros(len(each) + 1, np.int64)
    np.cumsum([x.size for x in each], out=bounds[1:])
    return (np.concatenate(each) if each else np.zeros(0, np.uint32)), bounds

"""Token ids of whole texts, by a tokenizer file that every executor has.

The byte-level pattern of the tokenizer never joins a character with white space after it. A text can so be cut before
every single space or newline that follows something else, and its ids are those of the parts, one after another. Parts
are words, which repeat: each distinct one is encoded once for a worker, and a batch is put together from them with numpy.
A text where white space follows white space is encoded as a whole, and so is one that holds the string of an added token, which
becomes that token's id as the tokenizer's own call does it. All this holds for tokenizers of one kind (`splits_at_spaces`): with any other file every
text is encoded as a whole.
"""

from __future__ import annotations

import json
import os
import re
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

END_ID = 2
#: Words that a worker remembers (about 200 bytes each); beyond that, new words are encoded anew in each batch.
REMEMBERED = 400_000
#: Text bytes encoded at once: in larger slices fewer words are new.
SLICE_BYTES = 6_000_000
_START = "\x00"
#: A word that the pattern cuts between letters and marks at most; all others go through the whole tokenizer.
_PLAIN = re.compile(r"(\n?)( ?)([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]*)([.,;:!?|%*$&()\"-]*)").fullmatch
#: Marks after a word of letters, and the end of the Latin letters whose class no Unicode version changes.
_MARKS, _LATIN_END = ".,;:!?", "\u0250"
_encoders: dict[str, "Encoder"] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoder(path: str | None = None, remembered: int = REMEMBERED) -> "Encoder":
    """One for each tokenizer file and worker; workers outlive tasks, and so do the words that they know. One that may know another number of words takes the place of the last, so a worker's memory doesn't depend on what ran in it before."""
    path = path or default_path()
    if path not in _encoders or _encoders[path].remembered != remembered:
        _encoders.pop(path, None)  # first, so that no two are there at a time
        _encoders[path] = Encoder(path, remembered)
    return _encoders[path]


def splits_at_spaces(path: str) -> bool:
    """Whether the file is byte-level pair encoding with the usual pattern, no normaliser, nothing added before or after and no random merges."""
    with open(path, encoding="utf-8") as f:
        x = json.load(f)
    before, model = x.get("pre_tokenizer") or {}, x.get("model") or {}
    usual = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    plain = not any(x.get(k) for k in ("normalizer", "truncation", "padding")) and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "unk_token", "byte_fallback"))
    return plain and {k: before.get(k) for k in usual} == usual and model.get("type") == "BPE"


class Encoder:
    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.fast = splits_at_spaces(path)
        self.model = self.tokenizer.model
        #: The byte-level alphabet: printable bytes stand for themselves, the others for the characters from 256 on.
        plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
        self.alphabet = [chr(b) for b in range(256)]
        for k, b in enumerate(b for b in range(256) if b not in plain):
            self.alphabet[b] = chr(256 + k)
        self.remembered = remembered
        self.known: dict[str, int] = {}
        self.pool = np.empty(1 << 16, np.uint32)
        self.used = 0
        #: Of each known part: where its ids are in the pool, how many they are, and whether it ends in white space, which may belong together with what follows.
        self.parts = np.empty((1 << 14, 3), np.int64)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _piece(self, piece: str) -> list[int]:
        if piece.isascii():
            piece = piece.replace(" ", self.alphabet[32]).replace("\n", self.alphabet[10])
        else:
            piece = "".join(map(self.alphabet.__getitem__, piece.encode()))
        return [t.id for t in self.model.tokenize(piece)]

    def _word(self, unit: str) -> list[int]:
        if not (m := _PLAIN(unit)):
            return self.tokenizer.encode(unit, add_special_tokens=False).ids
        line, space, letters, marks = m.groups()
        ids = self._piece(line) if line else []
        if letters:
            ids += self._piece(space + letters)
            return ids + self._piece(marks) if marks else ids
        return ids + self._piece(space + marks) if space or marks else ids

    def _learn(self, words: list[str]) -> None:
        known, flat, rows, used = self.known, [], [], self.used
        n, tokenize, alphabet = len(known), self.model.tokenize, self.alphabet
        space = alphabet[32]
        for word in words:
            core = word.rstrip(_MARKS)
            if core.isalpha() and ((plain := core.isascii()) or max(core) < _LATIN_END):  # nearly all words: a space, letters, marks
                ids = [t.id for t in tokenize(space + core if plain else space + "".join([alphabet[b] for b in core.encode()]))]
                if len(core) < len(word):
                    ids += self._piece(word[len(core) :])
                flat += ids
                known[word] = n
                n += 1
                rows.append((used, len(ids), False))
                used += len(ids)
                continue
            unit = word[1:] if word[:1] == _START else word if word[:1] == "\n" else " " + word
            ids = self._word(unit)
            flat += ids
            known[word] = n
            n += 1
            rows.append((used, len(ids), word != _START and not unit.strip() or unit[-1:].isspace()))
            used += len(ids)
        if used > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.empty(used, np.uint32)])
        if n > len(self.parts):
            self.parts = np.concatenate([self.parts[: n - len(rows)], np.empty((n, 3), np.int64)])
        self.pool[self.used : used] = flat
        self.parts[n - len(rows) : n] = np.array(rows, np.int64).reshape(-1, 3)
        self.used = used

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (no nulls), one after another, and the n + 1 offsets."""
        n = len(texts)
        if not n:
            return np.empty(0, np.uint32), np.zeros(1, np.int64)
        if not self.fast:
            own = self.whole(texts.to_pylist())
            return np.concatenate(own), np.concatenate([[0], np.cumsum([len(x) for x in own])])
        none = pa.scalar("", pa.large_string())
        lists = pc.split_pattern(pc.binary_join_element_wise(pa.scalar(_START, pa.large_string()), pc.replace_substring(texts, "\n", " \n"), none), " ")
        ends = np.asarray(lists.offsets).astype(np.int64)
        coded = lists.values.slice(ends[0], ends[-1] - ends[0]).dictionary_encode()
        ends, index = ends - ends[0], np.asarray(coded.indices)
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        place = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        new, n_known = np.flatnonzero(place < 0), len(self.known)
        self._learn([words[k] for k in new.tolist()])
        place[new] = np.arange(n_known, n_known + len(new))  # they are learned in order
        start, length, open_ = self.parts[place].T
        first = np.asarray(pc.starts_with(coded.dictionary, _START))
        lengths = length[index]
        odd = open_[index] > 0
        odd[ends[1:] - 1] = False  # nothing follows the last part
        late = first[index]
        late[ends[:-1]] = False
        odd |= late
        total = np.concatenate([[0], np.cumsum(lengths)])
        offsets = total[ends]
        ids = self.pool[np.repeat(start[index] - total[:-1], lengths) + np.arange(total[-1])]
        if len(self.known) > self.remembered:  # forget what this batch has brought
            for _ in range(len(self.known) - self.remembered):
                self.known.popitem()
            n_kept = len(self.known)
            self.used = int(self.parts[n_kept - 1, :2].sum())
        special = np.zeros(n, bool)
        for x in self.added:
            special |= np.asarray(pc.match_substring(texts, x))
        if odd.any() or special.any():
            slow = np.flatnonzero((np.add.reduceat(odd, ends[:-1]) > 0) | special)
            parts = [ids[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            for k, x in zip(slow, self.whole(texts.take(pa.array(slow)).to_pylist()), strict=True):
                parts[k] = x
            ids, offsets = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        return ids, offsets

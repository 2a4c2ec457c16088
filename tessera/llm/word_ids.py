"""Token ids of whole texts through a table of their pieces, in whole arrays.

For tokenizers that lower-case, drop white space and end each pre-token by a
token of its own kind (the last token tells where a pre-token ends). A batch of
texts becomes one array of code points. Words between blanks are cut where
letters turn into marks; each piece gets a 64-bit hash from running sums, and a
hash table in arrays gives the place and number of its ids. Only pieces that
are not in the table go to the tokenizers library, many in one call: plain ones
(letters or marks alone) as ready pre-tokens, words with digits, apostrophes
or code points from 0x300 on through the whole tokenizer. Texts that hold the
opening of a special token, and pieces of more than LONG code points, are
encoded by the library each time.
"""

from __future__ import annotations

import functools
import json
import os
import unicodedata

import numpy as np

from tessera.llm.files import tokenizer_path

#: Pieces a table holds before it starts anew; code points per batch; the longest piece in the table.
KEPT, BATCH, LONG = 1_200_000, 1_000_000, 64
P = 0x9E3779B97F4A7C15 | 1
BLANK, LETTER, MARK, ODD = range(4)
#: Blanks by code point below 0x300, as the tokenizers' own pattern engine has them.
BLANKS = {*range(9, 14), 0x20, 0x85, 0xA0}
LOW = 0x300


def kinds() -> tuple[np.ndarray, np.ndarray]:
    """Kind and lower case of each code point below LOW; the last entry stands for all others."""
    kind, lower = np.full(LOW + 1, ODD, np.int8), np.arange(LOW + 1, dtype=np.uint32)
    for c in range(LOW):
        category, low = unicodedata.category(chr(c)), chr(c).lower()
        if c in BLANKS:
            kind[c] = BLANK
        elif category[0] == "L" and len(low) == 1 and ord(low) < LOW:
            kind[c], lower[c] = LETTER, ord(low)
        elif category[0] not in "LN" and c != 0x27:
            kind[c] = MARK
    return kind, lower


class WordIds:
    def __init__(self, tokenizer: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.model = Tokenizer.from_file(tokenizer_path(tokenizer))
        self.model.no_truncation()
        self.model.no_padding()
        self.ready = Tokenizer(self.model.model)
        self.ready.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        end = json.loads(self.model.to_str())["model"]["end_of_word_suffix"]
        self.ends = np.zeros(self.model.get_vocab_size(), bool)
        self.ends[[i for t, i in self.model.get_vocab().items() if t.endswith(end)]] = True
        self.opening = os.path.commonprefix([t.content for t in self.model.get_added_tokens_decoder().values()] or ["\0"]) or "\0"
        self.kind, self.lower = kinds()
        n = 2 * BATCH
        with np.errstate(over="ignore"):
            self.powers, self.inverse = (np.cumprod(np.append(np.ones(1, np.uint64), np.full(n, x, np.uint64)), dtype=np.uint64) for x in (P, pow(P, -1, 1 << 64)))
        self.clear()

    def clear(self) -> None:
        size = 1 << (2 * KEPT + BATCH).bit_length()
        self.mask, self.shift = size - 1, np.uint64(64 - (size - 1).bit_length())
        self.keys, self.place, self.count = np.zeros(size, np.uint64), np.zeros(size, np.int64), np.zeros(size, np.int32)
        self.ids, self.used, self.held = np.empty(1 << 16, np.uint32), 0, 0

    def slot(self, keys: np.ndarray) -> np.ndarray:
        """Where each key lies, or the free slot where it would (keys are never 0)."""
        at = ((keys * np.uint64(P)) >> self.shift).astype(np.int64)
        left = np.flatnonzero((self.keys[at] != keys) & (self.keys[at] != 0))
        while len(left):
            at[left] = (at[left] + 1) & self.mask
            left = left[(self.keys[at[left]] != keys[left]) & (self.keys[at[left]] != 0)]
        return at

    def store(self, keys: np.ndarray, ids: list[np.ndarray] | np.ndarray, counts: np.ndarray) -> None:
        """New keys, each once, with their ids one after another."""
        total = int(counts.sum())
        while self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty(len(self.ids), np.uint32)])
        self.ids[self.used : self.used + total] = ids
        starts = self.used + np.cumsum(counts) - counts
        self.used += total
        self.held += len(keys)
        left = np.arange(len(keys))
        while len(left):
            at = self.slot(keys[left])
            _, first = np.unique(at, return_index=True)
            mine = left[first]
            self.keys[at[first]], self.place[at[first]], self.count[at[first]] = keys[mine], starts[mine], counts[mine]
            left = np.delete(left, first)

    def learn(self, keys: np.ndarray, pieces: list[str], odd: np.ndarray) -> None:
        plain = np.flatnonzero(~odd)
        for a in range(0, len(plain), 2000):
            part = plain[a : a + 2000]
            ids = np.array(self.ready.encode(" ".join([pieces[k] for k in part]), add_special_tokens=False).ids, np.uint32)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(part):
                raise ValueError("pre-tokens and their last tokens differ in number")
            self.store(keys[part], ids, np.diff(cuts, prepend=0))
        other = np.flatnonzero(odd)
        if len(other):
            found = [np.array(e.ids, np.uint32) for e in self.model.encode_batch_fast([pieces[k] for k in other], add_special_tokens=False)]
            self.store(keys[other], np.concatenate(found), np.array([len(x) for x in found]))

    def pieces(self, cp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and oddness of the pieces of an array of code points that begins and ends in a blank."""
        kind = self.kind[np.minimum(cp, LOW)]
        blank = kind == BLANK
        word = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
        stop = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
        odd_upto = np.concatenate([[0], np.cumsum(kind == ODD)])
        odd = odd_upto[stop] > odd_upto[word]
        inner = np.flatnonzero((kind[1:] != kind[:-1]) & ~blank[1:] & ~blank[:-1]) + 1
        inner = inner[~odd[np.searchsorted(word, inner, "right") - 1]]
        starts = np.sort(np.concatenate([word, inner]))
        ends = np.sort(np.concatenate([stop, inner]))
        return starts, ends, odd[np.searchsorted(word, starts, "right") - 1]

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain texts one after another, and how many each has."""
        cp = np.frombuffer((" " + " ".join(texts) + " ").encode("utf-32-le"), np.uint32)
        sizes = np.array([len(t) for t in texts])
        first = np.cumsum(sizes + 1) - sizes  # where each text begins
        starts, ends, odd = self.pieces(cp)
        low = np.where(cp < LOW, self.lower[np.minimum(cp, LOW)], cp)
        with np.errstate(over="ignore"):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((low.astype(np.uint64) + np.uint64(1)) * self.powers[: len(cp)], dtype=np.uint64)])
            keys = (sums[ends] - sums[starts]) * self.inverse[starts]
            keys = (keys ^ (keys >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93) + (ends - starts).astype(np.uint64)
        keys[keys == 0] = 1
        if self.held > KEPT:
            self.clear()
        long = ends - starts > LONG
        at = self.slot(keys)
        missing = np.flatnonzero((self.keys[at] != keys) & ~long)
        if len(missing):
            new, one = np.unique(keys[missing], return_index=True)
            whole = low.tobytes().decode("utf-32-le")
            one = missing[one]
            self.learn(new, [whole[a:b] for a, b in zip(starts[one].tolist(), ends[one].tolist(), strict=True)], odd[one])
            at[missing] = self.slot(keys[missing])
        places, counts = self.place[at], self.count[at].astype(np.int64)
        ids = self.ids
        if long.any():
            whole = low.tobytes().decode("utf-32-le")
            more, base = [], self.used
            for k in np.flatnonzero(long).tolist():
                own = np.array(self.model.encode(whole[starts[k] : ends[k]], add_special_tokens=False).ids, np.uint32)
                places[k], counts[k] = base, len(own)
                base += len(own)
                more.append(own)
            ids = np.concatenate([ids[: self.used], *more])
        total = int(counts.sum())
        upto = np.cumsum(counts)
        out = ids[np.repeat(places - (upto - counts), counts) + np.arange(total)]
        cut = np.append(np.searchsorted(starts, first), len(starts))
        tokens = np.concatenate([[0], upto])[cut]
        return out, np.diff(tokens)

    def encode(self, texts: list[str], end_id: int | None = None) -> list[np.ndarray]:
        """Ids of each whole text, with end_id after them."""
        out: list[np.ndarray | None] = [None] * len(texts)
        plain = [k for k, t in enumerate(texts) if self.opening not in t and len(t) < BATCH]
        for k in set(range(len(texts))).difference(plain):
            out[k] = np.array(self.model.encode(texts[k], add_special_tokens=False).ids, np.uint32)
        at = 0
        while at < len(plain):
            part, size = [], 0
            while at < len(plain) and (not part or size + len(texts[plain[at]]) < BATCH):
                part.append(plain[at])
                size += len(texts[plain[at]]) + 1
                at += 1
            ids, counts = self.encode_all([texts[k] for k in part])
            for k, own in zip(part, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
                out[k] = own
        end = np.array([] if end_id is None else [end_id], np.uint32)
        return [np.concatenate([x, end]) for x in out]


@functools.lru_cache(maxsize=1)
def loaded(tokenizer: str) -> WordIds:
    """A worker's table, which its later tasks find filled."""
    return WordIds(tokenizer)

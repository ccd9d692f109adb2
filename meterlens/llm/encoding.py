"""Token ids of whole texts, encoding every different part of a batch once."""

from __future__ import annotations

import os
import re
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The characters that the byte-level pattern takes as white space, as members of a class.
_SPACE = (
    r"\t\n\x0b\f\r \x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
_LOOSE = rf"[{_SPACE}] "

#: Letters in every version of Unicode, and what is no letter in any, as members of a class.
_LETTER = r"A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{217}\x{410}-\x{44F}\x{4E00}-\x{9FA5}\x{AC00}-\x{D7A3}"
_OTHER = r"!-@\[-`{-~\t\n\r"
#: Ends of parts: the end of a run of letters, and of a single line break between what is no white space.
_LETTERS_END = rf"([{_LETTER}])([{_OTHER}])"
_LINE_END = rf"([{_LETTER}!-~]\n)([{_LETTER}!-~])"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """Byte-level BPE ids as the `tokenizers` library gives them.

    A byte-level pattern never joins a character that isn't white space with the space behind it, so a text can be
    encoded word by word, the white space leading. Nor does it join a letter with what isn't a letter behind it, or a
    single line break with what follows, so words fall into parts, of which fewer differ. Texts with the string of a
    special token, or the mark that parts are split at, take the library's whole-text path. Ids of parts are kept; when
    the store holds `max_parts`, those that came in one batch only are dropped.
    """

    def __init__(self, path: str, max_parts: int = 400_000):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks run side by side already
        self.tokenizer = Tokenizer.from_file(path)
        self.max_parts = max_parts
        special = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = "|".join([r"\x{1f}", *special])
        self.slots: dict[str, int] = {}  # in the order of their slots
        self.starts = np.zeros(0, np.int64)
        self.counts = np.zeros(0, np.int32)
        self.seen = np.zeros(0, np.int32)  # batches
        self.ids = np.zeros(0, np.uint32)

    def _shrink(self) -> None:
        """Keep what came in two batches or more, at most half of the store: what came most often."""
        keep = np.flatnonzero(self.seen > 1)
        if len(keep) > self.max_parts // 2:
            keep = np.sort(keep[np.argsort(-self.seen[keep], kind="stable")[: self.max_parts // 2]])
        parts, seen, counts = list(self.slots), self.seen[keep], self.counts[keep].astype(np.int64)
        ids, _ = self._gather(keep)
        self.slots, self.starts, self.counts, self.ids = {}, self.starts[:0], self.counts[:0], self.ids[:0]
        self._append([parts[k] for k in keep.tolist()], counts, ids)
        self.seen = seen

    def _append(self, parts: list[str], counts: np.ndarray, ids: np.ndarray) -> None:
        self.slots.update(zip(parts, range(len(self.counts), len(self.counts) + len(parts))))
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(counts, dtype=np.int64) - counts])
        self.counts = np.concatenate([self.counts, counts.astype(np.int32)])
        self.seen = np.concatenate([self.seen, np.zeros(len(counts), np.int32)])
        self.ids = np.concatenate([self.ids, ids])

    def _gather(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these slots in a row, and where each ends."""
        counts = self.counts[slots]
        ends = np.cumsum(counts, dtype=np.int64)
        at = np.arange(ends[-1] if len(ends) else 0)
        at += np.repeat(self.starts[slots] - ends + counts, counts)
        return self.ids[at], ends

    def _learn(self, new: list[str]) -> None:
        for low in range(0, len(new), 10_000):
            some = new[low : low + 10_000]
            found = [e.ids for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
            ids = np.fromiter(chain.from_iterable(found), np.uint32)
            self._append(some, np.fromiter(map(len, found), np.int64, len(found)), ids)

    def _parts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number per text, for texts without the mark that parts are split at."""
        marked = pc.replace_substring(texts, " ", "\x1f ")
        loose = pc.match_substring_regex(texts, _LOOSE)
        if pc.any(loose).as_py():  # there, only spaces behind what is no white space begin a part
            spaced = pc.replace_substring_regex(texts.filter(loose), rf"([^{_SPACE}]) ", "\\1\x1f ")
            marked = pc.replace_with_mask(marked, loose, spaced)
        marked = pc.replace_substring_regex(marked, _LINE_END, "\\1\x1f\\2")
        marked = pc.replace_substring_regex(marked, _LETTERS_END, "\\1\x1f\\2")
        split = pc.split_pattern(marked, "\x1f")
        per_text = np.asarray(pc.list_value_length(split), np.int64)
        coded = split.flatten().dictionary_encode()
        del marked, split
        parts = coded.dictionary.to_pylist()
        if len(self.slots) + len(parts) > self.max_parts:
            self._shrink()
        slots = np.fromiter(map(self.slots.get, parts, repeat(-1)), np.int64, len(parts))
        unknown = np.flatnonzero(slots < 0)
        slots[unknown] = np.arange(len(self.slots), len(self.slots) + len(unknown))
        self._learn([parts[i] for i in unknown.tolist()])
        self.seen[slots] += 1
        ids, ends = self._gather(slots[np.asarray(coded.indices)])
        edges = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(per_text)])]
        return ids, np.diff(edges)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order and the number of ids of each text; null counts as empty."""
        texts = pc.fill_null(texts, "")
        special = np.asarray(pc.match_substring_regex(texts, self.special))
        if not special.any():
            return self._parts(texts)
        ids, counts = self._parts(texts.filter(pa.array(~special)))
        ends = np.cumsum(counts)
        parts, tight = [], 0
        total = np.zeros(len(texts), np.int64)
        whole = iter(self.tokenizer.encode_batch_fast(texts.filter(pa.array(special)).to_pylist(), add_special_tokens=False))
        for i, is_special in enumerate(special):
            if is_special:
                parts.append(np.array(next(whole).ids, np.uint32))
            else:
                parts.append(ids[ends[tight] - counts[tight] : ends[tight]])
                tight += 1
            total[i] = len(parts[-1])
        return np.concatenate(parts), total


def with_end(ids: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same ids with the id `end` behind each text."""
    out = np.empty(len(ids) + len(counts), np.uint32)
    ends = np.cumsum(counts + 1) - 1
    own = np.ones(len(out), bool)
    own[ends] = False
    out[own], out[ends] = ids, end
    return out, counts + 1

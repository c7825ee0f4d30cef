"""Token ids of whole texts, by the tokenizers library, with a bounded cache of the units between blanks."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Units kept at most, and the longest that is kept.
CACHED = 400_000
CACHED_LENGTH = 48
#: Bytes of text encoded at a time.
CHUNK = 1 << 22
#: A blank before other white space or the end, where blanks are no boundaries: such a text is encoded whole.
_RUNS = r" ([\s\x{b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|$)"
#: A unit of other characters is encoded by itself: normalising might change its length in bytes.
_EASY = re.compile("[\x21-\x7e\u00a1-\u012f]*")
#: Signs that begin a piece of their own behind a letter or digit: where blanks don't count, a unit that ends in one has its
#: stem's ids and the sign's.
SIGNS = ".,"
#: Units encoded in one text.
TOGETHER = 256


def public(name: str) -> str:
    """The path of a public tokenizer's file on this machine (driver or executor)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def gather(flat: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """flat[at : at + n] of each, in a row."""
    before = np.cumsum(n, dtype=np.int32) - n
    where = np.repeat(at - before, n)
    where += np.arange(len(where), dtype=np.int32)
    return flat[where]


def slices(batch: pa.RecordBatch, column: int, size: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about so many bytes of a text column, so that what is made of them stays small."""
    ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
        yield batch.slice(at, end - at)
        at = end


class Encoder:
    """Encodes texts as tokenizers does with add_special_tokens=False; a text that may hold a special token's string is encoded whole.

    A byte-level vocabulary (`blanks` kept) never joins across the boundary before a blank that stands
    between other characters, and one that drops white space never joins across any, so a text's ids are
    those of its units in a row. Arrow cuts a chunk of texts and finds its distinct units; those seen before
    are looked up, the others encoded together once. When the cache holds CACHED units, those that were
    looked up since the last time stay, if they are not too many, and the others go.
    """

    def __init__(self, path: str, blanks: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.blanks = blanks
        #: strings that the library takes out of a text before anything else
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.opening = os.path.commonprefix(self.special)
        names = self.tokenizer.get_vocab()
        #: bytes that each id stands for; byte-level vocabularies write one letter a byte, and one kind marks ends of words
        self.bytes = np.zeros(max(names.values()) + 1, np.int32)
        self.bytes[list(names.values())] = [len(n.removesuffix("</w>")) for n in names]
        self.size = self.tokenizer.get_vocab_size()
        self.sign = {c: self.tokenizer.encode(c, add_special_tokens=False).ids for c in SIGNS}
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.flat = np.empty(1 << 16, np.uint32)
        self.at = np.empty(1 << 14, np.int32)
        self.length = np.empty(1 << 14, np.int32)
        self.again = np.zeros(1 << 14, bool)
        self.used = self.count = 0

    def _thin(self) -> None:
        """Keep the units that were met again; start anew where even these fill most of the cache."""
        kept = [(u, k) for u, k in self.known.items() if self.again[k]]
        if len(kept) > CACHED * 3 // 4:
            return self._clear()
        old = np.fromiter((k for _, k in kept), np.int64, len(kept))
        ids, n = gather(self.flat, self.at[old], self.length[old]), self.length[old]
        self._clear()
        self.known = {u: i for i, (u, _) in enumerate(kept)}
        self._append(ids, n)

    def _append(self, ids: np.ndarray, n: np.ndarray) -> None:
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while self.count + len(n) > len(self.at):
            self.at, self.length, self.again = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.length, self.again))
        here = slice(self.count, self.count + len(n))
        self.flat[self.used : self.used + len(ids)] = ids
        self.at[here] = self.used + np.cumsum(n) - n
        self.length[here] = n
        self.again[here] = False
        self.used += len(ids)
        self.count += len(n)

    def _alone(self, strings: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)]

    def _each(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self._alone(strings)
        return np.array(list(chain.from_iterable(found)), np.uint32), np.fromiter(map(len, found), np.int32, len(found))

    def _together(self, strings: list[str], between: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all strings and how many each has, from texts of many strings: ids are dealt by the bytes that they stand for."""
        parts = [(np.empty(0, np.uint32), np.empty(0, np.int32))]
        groups = [strings[i : i + TOGETHER] for i in range(0, len(strings), TOGETHER)]
        for group, ids in zip(groups, self._alone([between.join(g) for g in groups]), strict=True):
            ids = np.array(ids, np.uint32)
            ends = np.cumsum([len(s.encode()) for s in group])
            have = np.cumsum(self.bytes[ids])
            last = np.searchsorted(have, ends)
            if len(ids) and have[-1] == ends[-1] and np.array_equal(have[last], ends):
                parts.append((ids, np.diff(last + 1, prepend=0).astype(np.int32)))
            else:
                parts.append(self._each(group))
        ids, n = zip(*parts, strict=True)
        return np.concatenate(ids), np.concatenate(n)

    def _learn(self, units: list[str], firsts: list[str]) -> np.ndarray:
        """Append the ids of units and firsts (that no blank precedes) to the cache's arrays; the place of each."""
        place = np.full(len(units) + len(firsts), -1, np.int32)
        signed = [] if self.blanks else [k for k, u in enumerate(units) if len(u) > 1 and u[-1] in SIGNS and u[-2].isalnum() and u.isprintable()]
        stems = [units[k][:-1] for k in signed]
        rest = np.ones(len(units), bool)
        rest[signed] = False
        whole = np.flatnonzero(rest).tolist()
        own = {units[k]: k for k in whole}
        more = list(dict.fromkeys(s for s in stems if s not in own and s not in self.known))
        at = self._encode([units[k] for k in whole] + more, firsts)
        place[whole] = at[: len(whole)]
        place[len(units) :] = at[len(whole) + len(more) :]
        fresh = dict(zip(more, at[len(whole) : len(whole) + len(more)].tolist(), strict=True))
        for c, ids in self.sign.items():
            mine = [(k, s) for k, s in zip(signed, stems, strict=True) if units[k][-1] == c]
            if mine:
                base = np.array([place[own[s]] if s in own else fresh[s] if s in fresh else self.known[s] for _, s in mine], np.int32)
                n = self.length[base]
                ends = np.cumsum(n)
                start = self.count
                self._append(np.insert(gather(self.flat, self.at[base], n), np.repeat(ends, len(ids)), np.tile(np.array(ids, np.uint32), len(mine))), n + len(ids))
                place[[k for k, _ in mine]] = np.arange(start, start + len(mine), dtype=np.int32)
        self.known.update((u, k) for u, k in zip([*units, *more], [*place[: len(units)].tolist(), *fresh.values()], strict=True) if len(u) <= CACHED_LENGTH)
        return place

    def _encode(self, units: list[str], firsts: list[str]) -> np.ndarray:
        strings = [" " + u for u in units] if self.blanks else units
        hard = [] if self.blanks else [k for k, s in enumerate(strings) if not (s.isascii() and s.isprintable()) and not _EASY.fullmatch(s)]
        odd = set(hard)
        easy = [k for k in range(len(strings)) if k not in odd] if odd else range(len(strings))
        start = self.count
        self._append(*self._together([strings[k] for k in easy], "" if self.blanks else " "))
        self._append(*self._each([strings[k] for k in hard] + firsts))
        place = np.empty(len(units) + len(firsts), np.int32)
        place[[*easy, *hard, *range(len(units), len(place))]] = np.arange(start, start + len(place), dtype=np.int32)
        return place

    def _some(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if self.count > CACHED:
            self._thin()
        checks = [pc.match_substring_regex(texts, _RUNS)] if self.blanks else []
        # what all of them begin with is looked for first, in one pass
        if self.special and (not self.opening or pc.any(pc.match_substring(texts, self.opening)).as_py()):
            checks += [pc.match_substring(texts, s) for s in self.special]
        whole = reduce(pc.or_, checks) if checks else None
        odd = [i for i, x in enumerate(whole.to_pylist()) if x] if whole is not None and pc.any(whole).as_py() else []
        if odd:
            alone = self._alone(texts.take(pa.array(odd)).to_pylist())
            texts = pc.if_else(whole, "", texts)
        # the other kind lower-cases anyway, and A-Z may be lowered first without a change
        parts = pc.split_pattern(texts, " ") if self.blanks else pc.ascii_split_whitespace(pc.ascii_lower(texts))
        coded = parts.values.dictionary_encode()
        units = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        index = coded.indices.to_numpy()
        offsets = parts.offsets.to_numpy()
        firsts: list[str] = []
        if self.blanks:
            first = offsets[:-1][np.diff(offsets) > 0]
            firsts = [units[k] for k in index[first]]
        place = np.fromiter(map(self.known.get, units, repeat(-1)), np.int32, len(units))
        new = np.flatnonzero(place < 0).tolist()
        self.again[place[place >= 0]] = True
        learnt = self._learn([units[k] for k in new], firsts)
        place[new] = learnt[: len(new)]
        which = place[index]
        if firsts:
            which[first] = learnt[len(new) :]
        n = self.length[which]
        before = np.zeros(len(n) + 1, np.int32)
        np.cumsum(n, out=before[1:])
        ids, ends = gather(self.flat, self.at[which], n), before[offsets]
        sizes = np.diff(ends).astype(np.int64)
        if odd:
            put = np.repeat(ends[odd], [len(x) for x in alone])
            ids = np.insert(ids, put, list(chain.from_iterable(alone)))
            sizes[odd] += [len(x) for x in alone]
        return ids, sizes

    def encode(self, texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row (uint32), and how many each text has; null as the empty text."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        batch = pa.RecordBatch.from_arrays([texts.cast(pa.string()).fill_null("")], names=["text"])
        parts = [(np.empty(0, np.uint32), np.empty(0, np.int64))]
        parts += [self._some(pa.concat_arrays([part.column(0)])) for part in slices(batch, 0)]
        ids, sizes = zip(*parts, strict=True)
        return np.concatenate(ids), np.concatenate(sizes)


@lru_cache(maxsize=2)
def encoder(name: str, blanks: bool) -> Encoder:
    """One encoder a worker process; name is a public tokenizer's file or a path."""
    return Encoder(name if os.path.sep in name else public(name), blanks)

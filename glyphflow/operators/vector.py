"""Matching, segmentation and conversion of whole Arrow batches as arrays of code points.

operators.matching defines what is computed, one text at a time; this computes
the same for many texts at once. A batch is one array of code points with the
positions at which segments begin ("cuts", every row's start among them). No
match may cross a cut, which is all that keeps rows and segments apart.

Matching takes the positions whose first two characters begin some key (one
look-up in a table of flags), lengthens them character by character in a hash
table of all keys' prefixes, and keeps the longest key of each position. Hits
are compared with the text character by character before they count, so a
collision of hashes can't change a result. Leftmost matches are then chosen
from left to right; all else has no loop over characters or rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from glyphflow.operators.matching import CONTEXT, Group, Layer, Ngrams, first_characters, segments

_M = np.uint64(0x9E3779B97F4A7C15)
_SPREAD = np.uint64(0xD6E8FEB86659FD93)
_A, _B = np.int64(0x5E3779B1), np.int64(0x45EBCA77)
#: Characters that tables have at least; all that is in common use, and few megabytes.
_COMMON = 0x30000
#: Bytes, and rows, that are worked on at once, at most, but that a row is never cut; arrays of so many stay in a core's cache.
CHARS, ROWS = 1 << 18, 1 << 13
#: A text of more bytes is walked character by character, as arrays of it would take some fifty times as many.
LONG = 1 << 25


def codes_of(text: str) -> np.ndarray:
    """Code points, as the integers that numpy takes for positions, so that look-ups need no cast."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def _flat(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions of many ranges, one range after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def _level(n: int) -> np.ndarray:
    """Tells the hashes of prefixes of n characters from those of other lengths."""
    return np.array([n], np.uint64) * _SPREAD


def _pair(a: np.ndarray, b: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """Places of pairs in a table of flags, whose size is a power of two; pairs may share one."""
    out = a * _A
    out += b * _B
    out >>= 15
    out &= np.int64(len(flags) - 1)
    return out


def _marked(size: int, *positions: np.ndarray) -> np.ndarray:
    """The positions, each once and in order."""
    flags = np.zeros(size, bool)
    for p in positions:
        flags[p] = True
    return np.flatnonzero(flags)


class Flat:
    """Strings as one array of code points."""

    def __init__(self, strings: list[str]):
        self.length = np.array([len(s) for s in strings], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.codes = codes_of("".join(strings))

    def take(self, which: np.ndarray) -> np.ndarray:
        return self.codes[_flat(self.start[which], self.length[which])]


class Index:
    """Keys of two characters or more, for matching at many positions at once."""

    def __init__(self, keys: list[str]):
        self.keys = Flat(keys)
        self.longest = int(self.keys.length.max(initial=0))
        bits = max(12, min(22, int(len(keys)).bit_length() + 5))
        self._begins = np.zeros(1 << bits, bool)
        hashes, found, more = [], [], []
        left = np.arange(len(keys))
        h = self.keys.codes[self.keys.start].astype(np.uint64) if len(keys) else np.zeros(0, np.uint64)
        for n in range(2, self.longest + 1):
            here = self.keys.length[left] >= n
            left, h = left[here], h[here]
            h = h * _M + self.keys.codes[self.keys.start[left] + n - 1].astype(np.uint64)
            if n == 2:
                self._begins[_pair(self.keys.codes[self.keys.start[left]], self.keys.codes[self.keys.start[left] + 1], self._begins)] = True
            mixed, at = np.unique(h + _level(n), return_inverse=True)
            key, goes_on = np.full(len(mixed), -1, np.int64), np.zeros(len(mixed), bool)
            whole = self.keys.length[left] == n
            key[at[whole]] = left[whole]
            goes_on[at[~whole]] = True
            hashes.append(mixed)
            found.append(key)
            more.append(goes_on)
        self.hash = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.key = np.concatenate(found) if found else np.zeros(0, np.int64)
        self.more = np.concatenate(more) if more else np.zeros(0, bool)
        size = max(4, int(len(self.hash)).bit_length() + 2)
        self._slot_shift, self._mask = np.uint64(64 - size), (1 << size) - 1
        self._table = np.full(1 << size, -1, np.int64)
        self.probes, pending = 0, np.arange(len(self.hash))
        while len(pending):  # linear probing; each round places one entry of every slot
            slot = (self._slot(self.hash[pending]) + self.probes) & self._mask
            free = self._table[slot] < 0
            _, first = np.unique(slot, return_index=True)
            place = np.zeros(len(pending), bool)
            place[first] = True
            place &= free
            self._table[slot[place]] = pending[place]
            pending = pending[~place]
            self.probes += 1

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return ((h * _SPREAD) >> self._slot_shift).astype(np.int64)

    def _entry(self, h: np.ndarray) -> np.ndarray:
        """Entries of the hashes; -1 where there is none."""
        slot = self._slot(h)
        out = self._table[slot]
        wrong = np.flatnonzero((out >= 0) & (self.hash[out] != h)) if len(self.hash) else np.zeros(0, np.int64)
        for probe in range(1, self.probes):
            if not len(wrong):
                break
            out[wrong] = self._table[(slot[wrong] + probe) & self._mask]
            wrong = wrong[(out[wrong] >= 0) & (self.hash[out[wrong]] != h[wrong])]
        out[wrong] = -1
        return out

    def search(self, codes: np.ndarray, room: np.ndarray, hidden: np.ndarray | None = None, every: bool = False):
        """(positions, keys) of the longest match at each position that has one, or of every match, in order of position.

        room has the position up to which a match at each position may reach.
        """
        if self.longest < 2 or len(codes) < 2:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(self._begins[_pair(codes[:-1], codes[1:], self._begins)])
        if hidden is not None:
            at = at[~hidden[at]]
        left = room[at] - at
        at, left = at[left >= 2], left[left >= 2]
        h = codes[at].astype(np.uint64)
        best, n = np.full(len(at), -1, np.int64), 2
        which, several = np.arange(len(at)), []
        while len(which):
            h = h * _M + codes[at[which] + n - 1].astype(np.uint64)
            entry = self._entry(h + _level(n))
            some = entry >= 0
            which, h, entry = which[some], h[some], entry[some]
            key = self.key[entry]
            hit = key >= 0
            if every:
                several.append((at[which[hit]], key[hit]))
            else:
                best[which[hit]] = key[hit]
            n += 1
            on = self.more[entry] & (left[which] >= n)
            which, h = which[on], h[on]
        if every:
            position, key = (np.concatenate(x) for x in zip(*several, strict=True)) if several else (np.zeros(0, np.int64),) * 2
            order = np.argsort(position, kind="stable")
            position, key = position[order], key[order]
        else:
            position, key = at[best >= 0], best[best >= 0]
        length = self.keys.length[key]
        if not np.array_equal(codes[_flat(position, length)], self.keys.take(key)):
            raise HashCollision
        return position, key


class HashCollision(Exception):
    """A text met a key's hash without its characters; such a batch goes text by text."""


def leftmost(position: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Which of the matches, in order of position, are taken from left to right."""
    if len(position) < 2:
        return np.arange(len(position))
    end = position + length
    clash = np.flatnonzero(position[1:] < end[:-1])
    if not len(clash):
        return np.arange(len(position))
    keep = np.ones(len(position), bool)
    starts, ends, decided = position.tolist(), end.tolist(), 0
    for k in clash.tolist():
        if k >= decided:  # else it was itself passed over, or lies within what was
            decided = k + 1
            while decided < len(starts) and starts[decided] < ends[k]:
                keep[decided] = False
                decided += 1
    return np.flatnonzero(keep)


@dataclass
class Batch:
    """Code points; where rows begin (and the end); where segments begin (rows' starts and the end among them)."""

    codes: np.ndarray
    rows: np.ndarray
    cuts: np.ndarray

    def room(self) -> np.ndarray:
        return np.repeat(self.cuts[1:], np.diff(self.cuts))

    def leading_ascii(self) -> np.ndarray:
        """Of each position whether its segment begins with an ASCII character."""
        return np.repeat(self.codes[self.cuts[:-1]] < 128, np.diff(self.cuts))


def batch_of(texts: pa.Array) -> Batch:
    """Of an array of strings without nulls' bytes."""
    if not len(texts):
        return Batch(np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64))
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = memoryview(texts.buffers()[2] or b"")[int(offsets[0]) : int(offsets[-1])]
    codes = codes_of(str(data, "utf-8"))
    if len(codes) == len(data):
        rows = offsets.astype(np.int64) - int(offsets[0])
    else:
        rows = np.concatenate([[0], np.cumsum(pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)])
    return Batch(codes, rows, _marked(len(codes) + 1, rows))


def strings_of(batch: Batch, texts: pa.Array) -> pa.Array:
    """The batch's rows as strings, null where texts is null."""
    c = batch.codes
    data = c.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
    if len(data) == len(c):
        offsets = batch.rows
    else:
        width = (c >= 0x80).view(np.int8) + (c >= 0x800).view(np.int8) + (c >= 0x10000).view(np.int8)
        offsets = batch.rows + np.concatenate([[0], np.cumsum(width, dtype=np.int64)])[batch.rows]
    valid = None if texts.null_count == 0 else pa.array(np.asarray(texts.is_valid())).buffers()[1]
    large = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data), valid)
    return large.cast(pa.string()) if len(data) < 1 << 31 else large


def flattened(group: Group) -> Layer:
    """One dictionary that matches as the group's layers do: a key that an earlier layer's key begins can't be reached."""
    if len(group.layers) == 1:
        return group.layers[0]
    out, before = Layer(), set()
    for layer in group.layers:
        lengths = sorted({len(k) for k in before})
        for key, value in layer.values.items():
            if not any(key[:n] in before for n in lengths if n <= len(key)):
                out.values[key] = value
                out.candidates[key] = layer.candidates[key]
        before |= layer.values.keys()
    return out


class Stage:
    """One group of dictionaries, compiled."""

    def __init__(self, group: Group, matched: frozenset[str] = frozenset()):
        values = flattened(group).values
        one = {k: v for k, v in values.items() if len(k) == 1}
        #: Single characters that become a single character, and those that are matched like longer keys: what they become is longer, or is asked for.
        self.plain = {k: v for k, v in one.items() if len(v) == 1 and k not in matched}
        self.odd = sorted(one.keys() - self.plain.keys())
        self.keys = sorted(k for k in values if len(k) > 1)
        self.index = Index(self.keys)
        self.values = Flat([values[k] for k in [*self.keys, *self.odd]])
        self.ones = sorted(map(ord, one))
        self._make_tables()
        #: Only where a key that begins with ASCII occurs it matters how a segment begins.
        self.ascii_single = any(k < "\x80" for k in one)
        self.ascii_index = Index([k for k in self.keys if k[0] < "\x80"])
        self.ascii_first = np.zeros(128 if self.ascii_index.longest else 0, bool)
        self.ascii_first[[ord(k[0]) for k in self.keys if k[0] < "\x80"]] = True

    def _make_tables(self) -> None:
        """By character: what it becomes, whether it is a key, and the number of its value if it is matched like longer keys."""
        self.size = max(_COMMON, (self.ones[-1] if self.ones else 0) + 2)  # the last place stands for all beyond
        self.table, self.single = np.arange(self.size), np.zeros(self.size, bool)
        for k, v in self.plain.items():
            self.table[ord(k)] = ord(v)
        self.single[self.ones] = True
        self.odd_at = np.full(self.size, -1, np.int32) if self.odd else None
        for n, k in enumerate(self.odd):
            self.odd_at[ord(k)] = len(self.keys) + n

    def __getstate__(self):
        return self.__dict__ | {"table": None, "single": None, "odd_at": None}  # large, and quickly made again

    def __setstate__(self, state):
        self.__dict__ = state
        self._make_tables()

    def _places(self, codes: np.ndarray) -> np.ndarray:
        """The codes as places in the tables."""
        return codes if not len(codes) or codes.max() < self.size else np.minimum(codes, self.size - 1)

    def _hidden(self, batch: Batch) -> np.ndarray | None:
        """Where ASCII is passed over without a look-up; None if no look-up there would find anything."""
        return batch.leading_ascii() & (batch.codes < 128) if self.meets_ascii(batch) else None

    def meets_ascii(self, batch: Batch) -> bool:
        """Whether the batch may have a key that begins with ASCII."""
        return self.ascii_single or bool(len(self.ascii_hits(batch)))

    def ascii_hits(self, batch: Batch) -> np.ndarray:
        """Where keys of several characters that begin with ASCII occur."""
        if not len(self.ascii_first) or not self.ascii_first[batch.codes[batch.codes < 128]].any():
            return np.zeros(0, np.int64)
        return self.ascii_index.search(batch.codes, batch.room())[0]

    def matched(self, batch: Batch, hidden: np.ndarray | None):
        """(positions, lengths, values) of the leftmost matches but for plain single characters."""
        position, key = self.index.search(batch.codes, batch.room(), hidden)
        length = self.index.keys.length[key]
        taken = leftmost(position, length)
        position, length, key = position[taken], length[taken], key[taken]
        if not self.odd:
            return position, length, key
        # A single character keeps no longer key from being taken, so those that are left after the longer keys are taken.
        value = self.odd_at[self._places(batch.codes)]
        if hidden is not None:
            value[hidden] = -1
        value[_flat(position, length)] = -1
        value[position] = key
        every = np.flatnonzero(value >= 0)
        sizes = np.ones(len(every), np.int64)
        sizes[np.searchsorted(every, position)] = length
        return every, sizes, value[every].astype(np.int64)

    def segmented(self, batch: Batch) -> tuple[Batch, np.ndarray]:
        """The batch with cuts around every match, single characters among them, and the matches' positions; ASCII isn't passed over here."""
        position, length, _ = self.matched(batch, None)
        alone = self.single[self._places(batch.codes)]
        alone[_flat(position, length)] = False
        alone = np.flatnonzero(alone)
        size = len(batch.codes) + 1
        cuts = _marked(size, batch.cuts, position, position + length, alone, alone + 1)
        return Batch(batch.codes, batch.rows, cuts), _marked(size, position, alone)

    def convert(self, batch: Batch, cut: bool = False) -> Batch:
        """Each segment converted; with cut, segments are cut around the matches too."""
        if not len(batch.codes):
            return batch
        hidden = self._hidden(batch)
        position, length, value = self.matched(batch, hidden)
        cuts = _marked(len(batch.codes) + 1, batch.cuts, position, position + length) if cut else batch.cuts
        return self.replaced(Batch(batch.codes, batch.rows, cuts), hidden, position, length, value)[0]

    def replaced(self, batch: Batch, hidden: np.ndarray | None, position: np.ndarray, length: np.ndarray, value: np.ndarray) -> tuple[Batch, np.ndarray]:
        """The batch with its matches and single characters replaced, and where the matches' values stand."""
        places = self._places(batch.codes)
        out = self.table[places]
        if places is not batch.codes:
            out = np.where(places < self.size - 1, out, batch.codes)
        if hidden is not None:
            out = np.where(hidden, batch.codes, out)
        if not len(position):
            return Batch(out, batch.rows, batch.cuts), position
        if np.array_equal(self.values.length[value], length):  # nothing moves
            out[_flat(position, length)] = self.values.take(value)
            return Batch(out, batch.rows, batch.cuts), position
        count = np.ones(len(out) + 1, np.int64)
        count[_flat(position, length)] = 0
        keep = np.flatnonzero(count[:-1])
        count[position] = self.values.length[value]
        at = np.cumsum(count) - count  # where each character, and the end, comes to stand
        moved = np.empty(int(at[-1]), np.int64)
        moved[at[keep]] = out[keep]
        moved[_flat(at[position], self.values.length[value])] = self.values.take(value)
        return Batch(moved, at[batch.rows], _marked(len(moved) + 1, at[batch.cuts])), at[position]


#: Rounds in which picks are decided for all rows at once, before the rows left are gone through one pick after the other.
_ROUNDS = 12


def _bytes_of(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each code point's UTF-8 as one number, and its length."""
    two, three, four = codes >= 0x80, codes >= 0x800, codes >= 0x10000
    last, third, second = (codes & 63) | 128, ((codes >> 6) & 63) | 128, ((codes >> 12) & 63) | 128
    out = np.where(two, (codes >> 6 | 0xC0) << 8 | last, codes)
    out = np.where(three, (codes >> 12 | 0xE0) << 16 | third << 8 | last, out)
    out = np.where(four, (codes >> 18 | 0xF0) << 24 | second << 16 | third << 8 | last, out)
    return out, 1 + two.astype(np.int64) + three + four


class Picking:
    """One stage in which a model picks among candidates by what was put out before.

    Everything is converted by default values at once. A pick differs from the
    default only after contexts that the model has, and these are few: contexts
    are numbers (their UTF-8 below a leading 1), looked up for all picks before
    which stands a character that ends one of their own. What a pick changes may be the context of the next
    ones, so these are decided again until nothing changes; the only such state
    is that of deciding from left to right. Serves where no pick changes a length.
    """

    def __init__(self, group: Group, model: Ngrams, mode: str):
        candidates = flattened(group).candidates
        choices = {k: c for k, c in candidates.items() if len(first_characters(c)) > 1}
        self.serves = all(len(v) == len(c[0]) > 0 for c in choices.values() for v in c)
        # Without a choice, too, it is the first candidate that counts here, even where a later row changed the default.
        first = Layer({k: c[0] for k, c in candidates.items()}, candidates)
        self.stage = Stage(Group([first]), frozenset(k for k in choices if len(k) == 1))
        self.limit = CONTEXT[mode]
        #: Candidates, by number of the value; empty where there is no choice.
        self.candidates = [choices.get(k, ()) for k in [*self.stage.keys, *self.stage.odd]]
        self.open = np.array([bool(c) for c in self.candidates], bool)
        if self.serves:
            self._know(model)

    def _know(self, model: Ngrams) -> None:
        """Contexts that lead away from a default, with the choices after them."""
        after: dict[str, set[str]] = {}
        for before, c in model.orders[2]:
            after.setdefault(c, set()).add(before)
        made: list[str] = [c[0] if c else "" for c in self.candidates]  # defaults, then what is picked instead of them
        special: dict[tuple[int, int], int] = {}
        for v, options in enumerate(self.candidates):
            firsts = first_characters(options)
            for before in set().union(*(after.get(f, ()) for f in firsts)) if options else ():
                picked = model.pick(before, firsts)
                if picked == options[0][:1]:
                    continue
                made.append(picked + next(o for o in options if o.startswith(picked))[1:])
                # No context at all is looked up as <s>, and so is that text.
                for text in {before, ""} if before == "<s>" else {before} - {""}:
                    data = text.encode("utf-8", "surrogatepass")
                    if len(data) <= self.limit:
                        special[int.from_bytes(b"\1" + data), v] = len(made) - 1
        self.made = Flat(made)
        self.contexts = np.array(sorted({c for c, _ in special}), np.int64)
        keys = np.array([int(np.searchsorted(self.contexts, c)) * len(self.candidates) + v for c, v in special], np.int64)
        order = np.argsort(keys)
        self.keys, self.values = keys[order], np.array(list(special.values()), np.int64)[order]
        # Without a whole character the last one has more bytes than the context may have; one stands for all of these.
        last = [ord(c.to_bytes(8, "big").lstrip(b"\0")[1:].decode("utf-8", "surrogatepass")[-1:] or "\U00010000") for c, _ in special]
        self.ends = np.zeros(1 << max(12, min(22, len(special).bit_length() + 5)), bool)
        self.ends[_pair(np.array(last, np.int64), np.array([v for _, v in special], np.int64), self.ends)] = True

    def _picked(self, codes: np.ndarray, at: np.ndarray, value: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """What is chosen at each pick, as a number in made, by what stands before it now."""
        out = value.copy()
        last = codes[np.maximum(at - 1, 0)]
        some = np.flatnonzero((at > begin) & self.ends[_pair(last if self.limit > 3 else np.minimum(last, 0x10000), value, self.ends)])
        if not len(some):
            return out
        at, begin = at[some], begin[some]
        context, size, fits = np.zeros(len(some), np.int64), np.zeros(len(some), np.int64), np.ones(len(some), bool)
        for k in range(1, self.limit + 1):
            fits &= at - k >= begin
            data, width = _bytes_of(codes[np.maximum(at - k, 0)])
            fits &= size + width <= self.limit
            if not fits.any():
                break
            context += np.where(fits, data << 8 * size, 0)
            size += np.where(fits, width, 0)
        context += np.int64(1) << 8 * size
        known = np.minimum(np.searchsorted(self.contexts, context), len(self.contexts) - 1)
        key = known * len(self.candidates) + value[some]
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = (self.contexts[known] == context) & (self.keys[place] == key)
        out[some[hit]] = self.values[place[hit]]
        return out

    def convert(self, batch: Batch) -> Batch:
        if not len(batch.codes):
            return batch
        position, length, value = self.stage.matched(batch, None)
        done, at = self.stage.replaced(batch, None, position, length, value)
        mine = np.flatnonzero(self.open[value])
        if len(mine) and len(self.keys):
            at, value = at[mine], value[mine]
            self._decide(done.codes, at, value, done.rows[np.searchsorted(done.rows, at, "right") - 1])
        return done

    def _decide(self, codes: np.ndarray, at: np.ndarray, value: np.ndarray, begin: np.ndarray) -> None:
        """Picks written into the codes, which have the defaults. A context has no more characters than bytes, so it has no more picks."""
        chosen, open_ = value.copy(), np.arange(len(at))
        for _ in range(_ROUNDS):
            picked = self._picked(codes, at[open_], value[open_], begin[open_])
            changed = picked != chosen[open_]
            open_, picked = open_[changed], picked[changed]
            if not len(open_):
                return
            chosen[open_] = picked
            codes[_flat(at[open_], self.made.length[picked])] = self.made.take(picked)
            near = _marked(len(at) + self.limit, *(open_ + k for k in range(1, self.limit + 1)))
            open_ = near[near < len(at)]
        # Long chains of picks that each hang on the last: from the first undecided one of each row on, one by one.
        known: dict[tuple, list[int]] = {}
        for start in open_[np.unique(begin[open_], return_index=True)[1]].tolist():
            row, end = int(begin[start]), int(np.searchsorted(begin, begin[start], "right"))
            to = int(at[end - 1] + self.made.length[value[end - 1]])
            out = codes[row:to].tolist()
            for p, v in zip((at[start:end] - row).tolist(), value[start:end].tolist(), strict=True):
                before = tuple(out[max(p - self.limit, 0) : p])
                if (picked := known.get((before, v))) is None:
                    one = self._picked(np.array([*before, 0], np.int64), np.array([len(before)]), np.array([v]), np.zeros(1, np.int64))
                    picked = known[before, v] = self.made.take(one).tolist()
                out[p : p + len(picked)] = picked
            codes[row:to] = out


SEGMENTS = pa.list_(pa.struct([("seg_no", pa.int32()), ("seg", pa.string()), ("matched", pa.bool_())]))


class Compiled:
    """A plan for whole batches: segmentation and stages."""

    def __init__(self, plan):
        self.plan = plan
        self.stages = [Stage(g) for g in plan.chain]
        picking = Picking(plan.chain[0], plan.model, plan.mode) if plan.mode != "off" and plan.model and len(plan.chain) == 1 else None
        self.picking = picking if picking and picking.serves else None
        self.segmentation = Stage(plan.segmentation) if plan.segmentation else None
        first = self.stages[0] if self.stages else None
        #: Whether the first stage's own matches are the segments' borders, so that one pass finds both; but for keys that begin with ASCII.
        self.fused = bool(
            self.segmentation and first and not first.ascii_single and not first.odd
            and self.segmentation.keys == first.keys and (len(self.stages) == 1 or not self.segmentation.single.any())
        )

    def batch(self, batch: Batch, fused: bool = False) -> Batch:
        if self.picking:
            return self.picking.convert(self.segmentation.segmented(batch)[0] if self.segmentation else batch)
        if self.segmentation and not fused:
            batch = self.segmentation.segmented(batch)[0]
        for k, stage in enumerate(self.stages):
            batch = stage.convert(batch, cut=fused and k == 0 and len(self.stages) > 1)
        return batch

    def convert(self, texts: pa.Array) -> pa.Array:
        """Whole texts converted; null stays null.

        In a text of ASCII alone every segment begins with ASCII, so nothing is
        looked up without a model; such texts stay as they are.
        """
        if self.plan.mode != "off" and self.plan.model:
            return self._whole(texts)
        return beyond_ascii(texts, self._whole)

    def _whole(self, texts: pa.Array) -> pa.Array:
        return joined((self._part(part) for part in parts_of(texts)), texts)

    def segments(self, texts: pa.Array) -> pa.Array:
        """Per text a list of seg_no, seg and whether it matched; null stays null."""
        return pa.concat_arrays([self._segments(part) for part in parts_of(texts)])

    def _segments(self, texts: pa.Array) -> pa.Array:
        if is_long(texts):
            found = segments(self.plan.segmentation, texts[0].as_py()) if self.plan.segmentation else [(texts[0].as_py(), False)]
            return pa.array([[{"seg_no": k, "seg": s, "matched": m} for k, (s, m) in enumerate(found)]], SEGMENTS)
        batch, hits = batch_of(texts), np.zeros(0, np.int64)
        if self.segmentation and len(batch.codes):
            batch, hits = self.segmentation.segmented(batch)
        starts = batch.cuts[:-1]
        first = np.searchsorted(starts, batch.rows)
        counts = np.diff(first)
        number = np.arange(len(starts)) - np.repeat(first[:-1], counts)
        strings = strings_of(Batch(batch.codes, batch.cuts, batch.cuts), pa.nulls(len(starts), pa.string()).fill_null(""))
        fields = pa.StructArray.from_arrays([pa.array(number, pa.int32()), strings, pa.array(np.isin(starts, hits))], fields=list(SEGMENTS.value_type))
        valid = None if texts.null_count == 0 else pa.array(np.asarray(texts.is_valid())).buffers()[1]
        return pa.Array.from_buffers(SEGMENTS, len(texts), [valid, pa.py_buffer(first.astype(np.int32))], children=[fields])

    def _part(self, texts: pa.Array) -> pa.Array:
        if (self.plan.mode == "off" or not self.plan.model or self.picking) and not is_long(texts):
            try:
                batch = batch_of(texts)
                hits = self.stages[0].ascii_hits(batch) if self.fused else ()
                if not len(hits):
                    return strings_of(self.batch(batch, self.fused), texts)
                # In the rows that have such a key, segments must be known before the first stage.
                apart = np.zeros(len(texts), bool)
                apart[np.searchsorted(batch.rows, hits, "right") - 1] = True
                if apart.all():
                    return strings_of(self.batch(batch), texts)
                mask = pa.array(apart)
                few, rest = texts.filter(mask), texts.filter(pc.invert(mask))
                parts = strings_of(self.batch(batch_of(few)), few), strings_of(self.batch(batch_of(rest), True), rest)
                order = np.argsort(np.concatenate([np.flatnonzero(apart), np.flatnonzero(~apart)]))
                return pa.concat_arrays(parts).take(pa.array(order))
            except HashCollision:
                pass
        return pa.array([None if t is None else self.plan.convert(t) for t in texts.to_pylist()], pa.string())


def beyond_ascii(texts: pa.Array, run) -> pa.Array:
    """The texts with run() over those that aren't ASCII alone."""
    plain = pc.fill_null(pc.string_is_ascii(texts), True)
    others = len(texts) - pc.sum(plain).as_py() if len(texts) else 0
    if not others:
        return texts if pa.types.is_string(texts.type) else texts.cast(pa.string())
    if 2 * others > len(texts):
        return run(texts)
    mask = pc.invert(plain)
    done = run(texts.filter(mask))
    return pc.replace_with_mask(texts if texts.type == done.type else texts.cast(done.type), mask, done)


def joined(parts, texts: pa.Array) -> pa.Array:
    """One array of the parts of strings, null where texts is null; no part stays once its bytes are copied, so that a batch's output is held once."""
    data, used, offsets = np.empty(texts.nbytes * 9 // 8 + 64, np.uint8), 0, [np.zeros(1, np.int64)]
    for part in parts:
        at = np.frombuffer(part.buffers()[1], np.int64 if pa.types.is_large_string(part.type) else np.int32)[part.offset : part.offset + len(part) + 1].astype(np.int64)
        size = int(at[-1] - at[0])
        if used + size > len(data):
            more = np.empty((used + size) * 3 // 2, np.uint8)
            more[:used] = data[:used]
            data = more
        if size:
            data[used : used + size] = np.frombuffer(part.buffers()[2], np.uint8)[at[0] : at[-1]]
        offsets.append(at[1:] - at[0] + used)
        used += size
    valid = None if texts.null_count == 0 else pa.array(np.asarray(texts.is_valid())).buffers()[1]
    kind, width = (pa.StringArray, np.int32) if used < 1 << 31 else (pa.LargeStringArray, np.int64)
    return kind.from_buffers(len(texts), pa.py_buffer(np.concatenate(offsets).astype(width)), pa.py_buffer(data[:used]), valid)


def is_long(texts: pa.Array) -> bool:
    """Whether this is one text too long for arrays of it; such a text is walked character by character."""
    return len(texts) == 1 and texts.nbytes > LONG


def parts_of(texts: pa.Array):
    """The array in slices of at most CHARS bytes (but for single rows) and ROWS rows; nulls have no bytes in any of them."""
    if texts.null_count:
        texts = _without_null_bytes(texts)
    if not len(texts):
        yield texts
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1]
    at = 0
    while at < len(texts):
        to = min(max(at + 1, int(np.searchsorted(offsets, int(offsets[at]) + CHARS, "right")) - 1), at + ROWS)
        yield texts.slice(at, to - at)
        at = to


def _without_null_bytes(texts: pa.Array) -> pa.Array:
    """The same strings, with nothing stored where they are null."""
    full = pa.concat_arrays([texts.fill_null("")])
    valid = pa.array(np.asarray(texts.is_valid())).buffers()[1]
    kind = pa.LargeStringArray if pa.types.is_large_string(texts.type) else pa.StringArray
    return kind.from_buffers(len(full), full.buffers()[1], full.buffers()[2], valid)

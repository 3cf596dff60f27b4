"""Prefix-free parsing: the suffix order of many texts from the suffix arrays of a dictionary and of a parse."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

from driftfield.llm.seeds import BASES, BYTES, U64, Rolling

#: Bytes of the rolling window, and one in how many windows is a trigger.
WINDOW, EVERY = 8, 16


def _ranked(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks from 1 of numbers, as 1 + how many are smaller, so that equal numbers share one; and which of them are not alone."""
    order = np.argsort(key)
    ordered = key[order]
    new = np.ones(len(order), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    begin = np.flatnonzero(new)
    sizes = np.diff(np.append(begin, len(order)))
    out = np.empty(len(order), np.int64)
    out[order] = np.repeat(begin + 1, sizes)
    return out, order[np.repeat(sizes > 1, sizes)]


def suffix_ranks(symbols: np.ndarray, ends: np.ndarray, width: int = 1, most: int | None = None) -> np.ndarray:
    """Ranks of all suffixes of strings laid end to end, by prefix doubling.

    ``symbols`` order the first ``width`` symbols of each suffix, ``ends`` has for
    each place where its string ends. Equal suffixes share a rank; a proper
    prefix comes first. Sorted by rank, the places are the suffix array. With
    ``most``, suffixes that agree in so many symbols may share a rank.

    A rank is 1 + how many suffixes are smaller by what has been read so far. It
    is final once no other suffix shares it, so each round sorts only the rest.
    """
    ranks, tied = _ranked(symbols)
    longest = int((ends - np.arange(len(ends))).max(initial=0))
    while width < min(longest, longest if most is None else most) and len(tied):
        following = tied + width
        inside = following < ends[tied]
        after = np.where(inside, ranks[np.where(inside, following, 0)], 0)
        order = np.argsort(ranks[tied] << 32 | after)
        tied, after = tied[order], after[order]
        group = ranks[tied]
        first = np.ones(len(tied), bool)  # of those that shared a rank
        first[1:] = group[1:] != group[:-1]
        new = first.copy()
        new[1:] |= after[1:] != after[:-1]
        place = np.arange(len(tied))
        start = place[new][np.cumsum(new) - 1] - place[first][np.cumsum(first) - 1]
        ranks[tied] = group + start
        sizes = np.diff(np.append(np.flatnonzero(new), len(tied)))
        tied = tied[np.repeat(sizes > 1, sizes)]
        width *= 2
    return ranks


def packed(symbols: np.ndarray, ends: np.ndarray, width: int = 7) -> np.ndarray:
    """``width`` symbols of under 9 bits as one number, so that doubling starts there; 0 stands past a string's end."""
    out = np.zeros(len(symbols), np.int64)
    at = np.arange(len(symbols))
    padded = np.append(symbols, np.zeros(width, symbols.dtype))
    for k in range(width):
        out = out << 9 | np.where(at + k < ends, padded[k : k + len(symbols)], 0)
    return out


class Parse:
    """A collection of texts, parsed into phrases.

    A phrase starts at a text's start or at a trigger (a window whose hash is 0
    modulo ``EVERY``) and ends with the next trigger's window, or the text. So
    no phrase's suffix longer than a window is a proper prefix of another's:
    each ends in the only trigger that it holds after its first byte, or in the
    text's end, which the dictionary marks.
    """

    def __init__(self, texts: Sequence[bytes]):
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        n = len(self.data)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.text_end = np.cumsum(lengths)
        self.text = np.repeat(np.arange(len(texts)), lengths)
        self.end = self.text_end[self.text]
        self.rolling = Rolling(BYTES[self.data], BASES[0])
        self.other = Rolling(BYTES[self.data], BASES[1])
        places = np.arange(max(0, n - WINDOW + 1))
        hashes = self.rolling(places, places + WINDOW)
        trigger = (hashes >> U64(40)) % U64(EVERY) == 0
        trigger &= places + WINDOW <= self.end[: len(places)]
        starts = np.zeros(n, bool)
        starts[(self.text_end - lengths)[lengths > 0]] = True
        starts[places[trigger]] = True
        self.phrase_start = np.flatnonzero(starts)
        following = np.append(self.phrase_start[1:], n)
        limit = self.end[self.phrase_start]
        self.final = following >= limit  # ends with the text
        self.phrase_end = np.where(self.final, limit, following + WINDOW)
        self.phrase = np.cumsum(starts) - 1  # of each place, the last phrase that starts by it

    def order(self, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Two keys for each place: by them, places stand in the order of the suffixes that start there.

        The first is the rank of the phrase's rest in the dictionary's suffix
        array; the second that of the following phrases in the parse's. With
        ``most``, suffixes that agree in so many bytes may stand in any order.
        """
        starts, ends = self.phrase_start, self.phrase_end
        content = np.rec.fromarrays([self.rolling(starts, ends), self.other(starts, ends) ^ self.final.astype(U64)])
        order = np.lexsort((content.f1, content.f0))
        new = np.ones(len(order), bool)
        new[1:] = content[order[1:]] != content[order[:-1]]
        first, which = order[new], np.empty(len(order), np.int64)
        which[order] = np.cumsum(new) - 1
        # The dictionary: each distinct phrase once; one that ends its text has a mark behind it, below all bytes.
        size = ends[first] - starts[first] + self.final[first]
        base = np.cumsum(size) - size
        entry = np.repeat(np.arange(len(first)), size)
        offset = np.arange(int(size.sum())) - base[entry]
        source = starts[first][entry] + offset
        mark = source >= ends[first][entry]  # ends of phrases, in the data
        symbols = np.where(mark, 1, self.data[np.where(mark, 0, source)].astype(np.int64) + 2)
        ends = (base + size)[entry]
        ranks = suffix_ranks(packed(symbols, ends), ends, 7, most)
        # The parse: phrases by rank in the dictionary, text by text.
        names = ranks[base][which]
        last = np.searchsorted(starts, self.end[starts])  # where the next text's phrases start
        parse = suffix_ranks(names, last, 1, most)
        # A place whose rest of the phrase is within the closing window belongs to the next phrase.
        at = np.arange(len(self.data))
        mine = self.phrase
        rest = ranks[base[which[mine]] + at - starts[mine]]
        after = np.append(parse, 0)[np.where(self.final[mine], len(parse), mine + 1)]
        return rest, after


def repeats_before(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Whether each place but the first of ``at`` has ``length`` bytes in common with the one ahead of it, read 8 at a time."""
    padded = np.append(data, np.zeros(8, np.uint8))
    words = np.ndarray(len(data), "<u8", padded, strides=(1,)).copy()  # the 8 bytes from each place on
    same = np.arange(1, len(at))
    for k in [*range(0, length - 7, 8), length - 8] if length >= 8 else range(length):
        a, b = at[same - 1] + k, at[same] + k
        same = same[words[a] == words[b] if length >= 8 else data[a] == data[b]]
    out = np.zeros(len(at), bool)
    out[same] = True
    return out


def earlier_runs(texts: Sequence[bytes], places: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, start) of each run of ``length`` bytes that also starts at a smaller place.

    ``places`` has a sortable number for each text's first byte; byte i stands i
    later. In the suffix order equal runs are neighbours: those with at least
    ``length`` bytes in common with the suffix ahead of them.
    """
    parse = Parse(texts)
    at = np.flatnonzero(np.arange(len(parse.data)) + length <= parse.end)
    if not len(at):
        return at, at
    rest, after = parse.order(length)
    at = at[np.argsort(rest[at] << 32 | after[at])]  # the suffix array, where a run fits
    new = ~repeats_before(parse.data, at, length)
    begin = np.flatnonzero(new)
    text_start = np.append(0, parse.text_end[:-1])
    place = places[parse.text[at]] + at - text_start[parse.text[at]]
    least = np.minimum.reduceat(place, begin)[np.cumsum(new) - 1]
    late = at[place > least]
    late.sort()
    return parse.text[late], late - text_start[parse.text[late]]

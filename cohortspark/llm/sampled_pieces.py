"""SentencePiece encoding and decoding: Gumbel top-k segmentations without replacement by perturbed A-star search."""

from __future__ import annotations

import functools
import math
import re
from array import array
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, islice, pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, spare, table, text_or_empty

MODEL = "piece_bpe_32k.model"
#: Segmentations per text, and what a piece's score counts: P(segmentation) ~ exp(INVERSE * sum of scores).
SAMPLES, INVERSE, SEED = 2, 0.002, 17
#: Scores below this are marks of the model, not ranks; such pieces count as the rarest.
_LEAST_SCORE = -32_000.0
#: The segmentations of words up to this length are listed; longer words are walked piece by piece.
WORD_CHARS = 16
#: Listed segmentations of less than this share of the word's mass are left out: a draw's grain is coarser.
_LOG_TINY = math.log(1e-13)
#: What is left out must not count beside what the last sample is drawn from, so all words are walked in texts
#: where the other samples could take more than this share of the mass.
_SHARE_LISTED = 0.999
_WORDS_HELD, _WAYS_HELD, _CHARS_AT_ONCE = 700_000, 6_000_000, 1_500_000
#: Words with the blanks before them, cut between letters and other signs: no piece of the model has
#: both, so the parts are independent.
_WORD = re.compile(r" *[^\W\d_²³]+| *(?:(?![^\W\d_²³])[^ ])+| +")
#: The same for texts in ASCII.
_ASCII_WORD = re.compile(r" *[A-Za-z]+| *[^A-Za-z ]+| +")
#: Words whose segmentations are listed together.
_WORDS_AT_ONCE = 2000
#: Cumulative shares of a word's segmentations are whole numbers of so many bits, so that a draw does not
#: depend on which words a worker has met before.
_CDF_BITS = 40
_ONE = 1 << _CDF_BITS
#: They are added up with so many bits more.
_MORE_BITS = 10
#: How the model writes a blank; in a text this character is an ordinary one, of no piece.
_MARK = "▁"


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.cache
def _processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


class _Column:
    """Numbers that more are added to in place."""

    def __init__(self, kind: type) -> None:
        self.held, self.size = np.empty(1024, kind), 0

    def add(self, values: np.ndarray) -> None:
        size = self.size + values.size
        if size > self.held.size:
            old, self.held = self.held, np.empty(max(size, self.held.size * 3 // 2), self.held.dtype)
            self.held[: self.size] = old[: self.size]
        self.held[self.size : size] = values
        self.size = size

    def all(self) -> np.ndarray:
        return self.held[: self.size]


class Options(NamedTuple):
    """Options of number t are start[t] … start[t] + count[t] - 1; limit[t] is the cdf of the first of them.

    ``others`` is the log-probability of the number's other options. The ids of option i are
    ids[first[i]] … ids[first[i] + width[i] - 1]. ``step`` counts the characters that an option of a walked word
    takes; it is 0 for a whole word.
    """

    start: np.ndarray
    count: np.ndarray
    limit: np.ndarray
    cdf: np.ndarray
    logp: np.ndarray
    others: np.ndarray
    step: np.ndarray
    first: np.ndarray
    width: np.ndarray
    ids: np.ndarray


_KINDS = Options(np.int64, np.int64, np.int64, np.int64, np.float64, np.float64, np.int64, np.int64, np.int64, np.uint32)


class Lattice:
    """All segmentations of single words into pieces of a model, with their log-probabilities."""

    def __init__(self, path: str, inverse: float) -> None:
        model = _processor(path)
        plain = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        self.pieces = {model.id_to_piece(i).replace(_MARK, " "): (array("I", [i]).tobytes(), inverse * max(model.get_score(i), _LEAST_SCORE)) for i in plain}
        self.bytes = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.begun = {p[:n] for p in self.pieces for n in range(1, len(p) + 1)}
        self.fallback = inverse * _LEAST_SCORE
        short = [p for p in self.pieces if len(p) <= WORD_CHARS]
        self.piece_ids = np.array([int(np.frombuffer(self.pieces[p][0], np.uint32)[0]) for p in short], np.uint32)
        self.piece_logs = np.array([self.pieces[p][1] for p in short])
        number = {p: i for i, p in enumerate(short)}
        #: Per length the sorted hashes of what pieces begin with, and the numbers of the pieces that are whole there (-1: none).
        self.levels = []
        for n in range(1, max(map(len, short)) + 1):
            begun = [p for p in self.begun if len(p) == n]
            points = np.frombuffer("".join(begun).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, n)
            hashes = np.zeros(len(begun), np.uint64)
            for i in range(n):
                hashes = _next_hash(hashes, points[:, i])
            order = np.argsort(hashes)
            self.levels.append((hashes[order], np.array([number.get(begun[i], -1) for i in order.tolist()], np.int64)))
        self.forget()

    def forget(self) -> None:
        """Empty the table of words.

        A word has a number; so has each place inside a walked word, from the word's number on. Per number there are
        options: segmentations of a word, or pieces that go on from a place.
        """
        self.words: defaultdict[str, int] = defaultdict()  # in the order met
        self.words.default_factory = self.words.__len__
        self.number, self.walk = _Column(np.int64), _Column(np.int64)  # per word, and its characters if it is walked, else 0
        self.options = Options(*map(_Column, _KINDS))

    def types(self, parts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """The words' numbers in the table, and their characters if they are walked (else 0); new words are added."""
        total, known = sum(map(len, parts)), len(self.words)
        at = np.fromiter(map(self.words.__getitem__, chain.from_iterable(parts)), np.int64, total)
        if len(self.words) > known > 0 and (len(self.words) > _WORDS_HELD or self.options.width.size > _WAYS_HELD):
            self.forget()
            known = 0
            at = np.fromiter(map(self.words.__getitem__, chain.from_iterable(parts)), np.int64, total)
        new = list(islice(reversed(self.words), len(self.words) - known))[::-1]
        sizes = np.fromiter(map(len, new), np.int64, len(new))
        number = np.empty(sizes.size, np.int64)
        long = np.flatnonzero(sizes > WORD_CHARS)
        number[long] = self.add_walked([new[i] for i in long.tolist()])
        short = np.flatnonzero(sizes <= WORD_CHARS)
        for i in range(0, short.size, _WORDS_AT_ONCE):
            part = short[i : i + _WORDS_AT_ONCE]
            number[part] = self._add_listed([new[j] for j in part.tolist()]) + np.arange(part.size)
        self.number.add(number)
        self.walk.add(np.where(sizes > WORD_CHARS, sizes, 0))
        return self.number.all()[at], self.walk.all()[at]

    def flat(self) -> Options:
        return Options(*(c.all() for c in self.options))

    def _add(self, count: np.ndarray, logp: np.ndarray, width: np.ndarray, ids: np.ndarray, step: np.ndarray) -> int:
        """The first of new numbers with so many options each; numbers do not depend on what is added together."""
        o = self.options
        number, options = o.count.size, o.logp.size
        begin, owner = np.cumsum(count) - count, np.repeat(np.arange(count.size), count)
        last = begin + count - 1
        share = np.cumsum((np.exp(logp) * (_ONE << _MORE_BITS)).astype(np.int64))  # differences stay right if it runs over
        share -= np.concatenate(([0], share[last[:-1]]))[owner]
        share = np.minimum(share >> _MORE_BITS, _ONE)
        share[last] = _ONE
        cdf = ((number + owner) << _CDF_BITS) + share
        o.start.add(options + begin)
        o.count.add(count)
        o.limit.add(cdf[begin])
        o.cdf.add(cdf)
        o.logp.add(logp)
        o.others.add(_others(logp, begin, owner))
        o.step.add(step)
        o.first.add(o.ids.size + np.cumsum(width) - width)
        o.width.add(width)
        o.ids.add(ids)
        return number

    def _add_listed(self, words: list[str]) -> int:
        """The number of the first of words of up to ``WORD_CHARS`` characters, which are walked together."""
        count, weight, width, ids = self._listed(words)
        begin, owner = np.cumsum(count) - count, np.repeat(np.arange(count.size), count)
        top = weight[begin]
        mass = top + np.log(np.add.reduceat(np.exp(weight - top[owner]), begin))
        logp = np.where(count[owner] == 1, 0.0, weight - mass[owner])
        keep = logp > _LOG_TINY
        return self._add(np.bincount(owner[keep], minlength=count.size), logp[keep], width[keep], ids[np.repeat(keep, width)], np.zeros(int(keep.sum()), np.int64))

    def add_walked(self, words: list[str]) -> np.ndarray:
        """The words' numbers; they are added to the table whether it has them or not."""
        if not words:
            return np.empty(0, np.int64)
        places = list(chain.from_iterable(map(self._walked, words)))
        logp, ids, step = zip(*chain.from_iterable(places), strict=True)
        width = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        first = self._add(np.fromiter(map(len, places), np.int64, len(places)), np.array(logp), width, np.frombuffer(b"".join(ids), "<u4"), np.array(step, np.int64))
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        return first + np.cumsum(sizes) - sizes

    def _walked(self, word: str) -> list[list[tuple[float, bytes, int]]]:
        """Per place the pieces that begin there: (log-probability, ids, characters), by sums over all segmentations from a place to the end."""
        n = len(word)
        rest, found = [0.0] * (n + 1), []
        for at in range(n - 1, -1, -1):
            options, j = [], at + 1
            while j <= n and (head := word[at:j]) in self.begun:
                if piece := self.pieces.get(head):
                    options.append((piece[1] + rest[j], piece[0], j - at))
                j += 1
            if word[at] not in self.pieces:
                data = word[at].encode("utf-8", "surrogatepass")
                options.append((self.fallback * len(data) + rest[at + 1], array("I", [self.bytes[b] for b in data]).tobytes(), 1))
            top = max(w for w, *_ in options)
            rest[at] = top + math.log(sum(math.exp(w - top) for w, *_ in options))
            found.append([(w - rest[at], ids, step) for w, ids, step in options])
        found.reverse()
        return found

    def _matches(self, points: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, length, piece's number): the pieces that begin at each place of words with ``rest`` characters left."""
        out, at, hashes = [], np.arange(points.size), np.zeros(points.size, np.uint64)
        for n, (known, pieces) in enumerate(self.levels[:WORD_CHARS]):
            if n:
                inside = np.flatnonzero(rest[at] > n)
                at, hashes = at[inside], hashes[inside]
            hashes = _next_hash(hashes, points[at + n])
            slot = np.minimum(np.searchsorted(known, hashes), known.size - 1)
            same = np.flatnonzero(known[slot] == hashes)
            at, hashes, slot = at[same], hashes[same], slot[same]
            whole = np.flatnonzero(pieces[slot] >= 0)
            out.append((at[whole], np.full(whole.size, n + 1), pieces[slot[whole]]))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))

    def _listed(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Segmentations per word, their log weights and numbers of ids, and the ids; of each word the likeliest first.

        All words are walked together, by the characters that are left (``d``): sums of the best ways to the end and from
        the beginning leave out the pieces of no way that counts, then the ways are listed from the ends on.
        What has less than the share ``_LOG_TINY`` of an end's likeliest way is left out, so it has less of the word's mass.
        """
        sizes = np.array(list(map(len, words)), np.int64)
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        first = np.cumsum(sizes) - sizes
        word = np.repeat(np.arange(sizes.size), sizes)
        rest = (first + sizes)[word] - np.arange(points.size)  # characters from a place to the word's end
        place, length, kind = self._matches(points, rest)
        ids, logs, width = self.piece_ids, self.piece_logs, np.ones(self.piece_ids.size, np.int64)
        plain = np.zeros(points.size, bool)
        plain[place[length == 1]] = True
        if (odd := np.flatnonzero(~plain)).size:  # a character that is no piece is its bytes
            chars, which = np.unique(points[odd], return_inverse=True)
            data = [bytes(np.array([c], "<u4")).decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass") for c in chars.tolist()]
            place, length, kind = (np.concatenate(c) for c in ((place, odd), (length, np.ones(odd.size, np.int64)), (kind, width.size + which)))
            width = np.concatenate((width, [len(d) for d in data]))
            ids = np.concatenate((ids, np.array([self.bytes[b] for d in data for b in d], np.uint32)))
            logs = np.concatenate((logs, [self.fallback * len(d) for d in data]))
        begin = np.cumsum(width) - width

        # from each state (characters left, word) to another; the state of a word's end is always there
        many = sizes.size
        source, target = rest[place] * many + word[place], (rest[place] - length) * many + word[place]
        order = np.argsort(source, kind="stable")
        source, target, kind = source[order], target[order], kind[order]
        weight = logs[kind]
        best, ahead = np.full((WORD_CHARS + 1) * many, -np.inf), np.full((WORD_CHARS + 1) * many, -np.inf)
        best[:many], ahead[sizes * many + np.arange(many)] = 0.0, 0.0
        _walk(best, source, target, weight, range(1, WORD_CHARS + 1), many)
        order = np.argsort(target, kind="stable")
        _walk(ahead, target[order], source[order], weight[order], range(WORD_CHARS - 1, -1, -1), many)
        least = best + _LOG_TINY
        whole = least[sizes * many + np.arange(many)] - 1e-6
        counts = np.flatnonzero(ahead[source] + weight + best[target] >= whole[source % many])
        source, target, kind = source[counts], target[counts], kind[counts]
        cuts = np.searchsorted(source, np.arange(WORD_CHARS + 2) * many)
        edges = [(source[i:j] % many, target[i:j] // many, kind[i:j]) for i, j in zip(cuts[1:], cuts[2:], strict=False)]
        least = least.reshape(-1, many).T
        start, count = np.zeros((sizes.size, WORD_CHARS + 1), np.int64), np.zeros((sizes.size, WORD_CHARS + 1), np.int64)
        start[:, 0], count[:, 0] = np.arange(sizes.size), 1
        total, piece, after = np.zeros(sizes.size), np.full(sizes.size, -1), np.full(sizes.size, -1)
        for d, (own, left, kind) in enumerate(edges, 1):
            n = count[own, left]
            edge = np.repeat(np.arange(own.size), n)
            more = (start[own, left] - np.cumsum(n) + n)[edge] + np.arange(edge.size)
            sums = logs[kind][edge] + total[more]
            keep = sums >= least[own[edge], d]
            edge, more, sums = edge[keep], more[keep], sums[keep]
            count[:, d] = np.bincount(own[edge], minlength=sizes.size)
            start[:, d] = total.size + np.cumsum(count[:, d]) - count[:, d]
            total, piece, after = np.concatenate((total, sums)), np.concatenate((piece, kind[edge])), np.concatenate((after, more))

        n, at = count[np.arange(sizes.size), sizes], start[np.arange(sizes.size), sizes]
        owner = np.repeat(np.arange(sizes.size), n)
        way = (at - np.cumsum(n) + n)[owner] + np.arange(owner.size)
        way = way[np.lexsort((-total[way], owner))]
        weights = total[way]
        parts, step = [], way
        while (piece[step] >= 0).any():
            parts.append(piece[step])
            step = np.where(after[step] >= 0, after[step], step)
        path = np.stack(parts, 1)
        tied = np.flatnonzero((np.diff(weights) == 0) & (np.diff(owner) == 0))
        for run in np.split(tied, np.flatnonzero(np.diff(tied) > 1) + 1) if tied.size else ():
            a, b = int(run[0]), int(run[-1]) + 2  # of equal weights the larger ids first
            spelt = [b"".join(ids[begin[p] : begin[p] + width[p]].tobytes() for p in row if p >= 0) for row in path[a:b].tolist()]
            path[a:b] = path[a:b][sorted(range(b - a), key=spelt.__getitem__, reverse=True)]
        taken = np.where(path >= 0, width[path], 0).sum(axis=1)
        path = path[path >= 0]
        long = width[path]
        return n, weights, taken, ids[np.repeat(begin[path] - np.cumsum(long) + long, long) + np.arange(int(long.sum()))]

    def _ways(self, words: list[str]) -> list[list[tuple[float, bytes]]]:
        """``_listed`` as one list per word: [(log weight, ids)]."""
        count, weight, width, ids = self._listed(words)
        upto = [0, *np.cumsum(width).tolist()]
        pairs = [(w, ids[a:b].tobytes()) for w, (a, b) in zip(weight.tolist(), pairwise(upto), strict=True)]
        return [pairs[a:b] for a, b in pairwise([0, *np.cumsum(count).tolist()])]


def _walk(best: np.ndarray, states: np.ndarray, others: np.ndarray, weight: np.ndarray, levels: range, many: int) -> None:
    """``best`` of each of the sorted ``states`` from those of the others; ``many`` states are of one level, walked in this order."""
    cuts = np.searchsorted(states, np.arange(max(levels) + 2) * many)
    for d in levels:
        own = slice(cuts[d], cuts[d + 1])
        if cuts[d] < cuts[d + 1]:
            first = np.flatnonzero(np.diff(states[own], prepend=-1))
            at = states[own][first]
            best[at] = np.maximum(best[at], np.maximum.reduceat(best[others[own]] + weight[own], first))


def _next_hash(hashes: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Hashes of strings that are longer by one character."""
    x = (hashes + points.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def _others(logp: np.ndarray, begin: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """log(1 - p) of options with the log-probabilities ``logp``, which begin at ``begin`` for each owner.

    For a likely option it is the sum of the others, so that it holds for shares far below a double's grain.
    """
    with np.errstate(divide="ignore", invalid="ignore"):
        out = np.log1p(-np.exp(np.minimum(logp, 0.0)))
        likely = np.flatnonzero(logp > -0.5)  # one for each owner at most
        rest = logp.copy()
        rest[likely] = -np.inf
        top = np.maximum.reduceat(rest, begin)
        sums = top + np.log(np.add.reduceat(np.exp(rest - top[owner]), begin))
    out[likely] = np.where(np.isneginf(top), -np.inf, sums)[owner[likely]]
    return out


def words_of(text: str) -> list[str]:
    """The parts of a text whose segmentations do not depend on each other: words with the blank before them."""
    return (_ASCII_WORD if text.isascii() else _WORD).findall(" " + text) if text else []


def _below(mass: np.ndarray, bound: float, rng: np.random.Generator) -> np.ndarray:
    """Gumbel variables with the locations ``mass``, each conditioned on being at most ``bound``."""
    return -np.logaddexp(-bound, np.log(rng.exponential(size=mass.size)) - mass)


def _log_sum(logs: np.ndarray) -> float:
    top = float(logs.max(initial=-np.inf))
    return top + math.log(float(np.exp(logs - top).sum())) if top > -np.inf else -np.inf


def search(flat: Options, types: np.ndarray, sizes: np.ndarray, k: int, rng: np.random.Generator) -> list[tuple]:
    """Up to ``k`` distinct segmentations of one text, by falling perturbed score.

    A-star over sets of segmentations: a set is all that share the choices before some place with a
    segmentation found earlier and differ from it there. Its log mass is known exactly from the
    lattice, so the largest perturbed score in the set can be drawn without looking inside. The set
    with the largest one is opened: its best segmentation is drawn and given out, and what is left
    of it falls apart by the place of the first difference, each part bounded by the score just
    found. A place is a word (its choices are segmentations), or in a walked word the end of a piece
    (its choices are the next pieces). Returns (choices, log-probability, perturbed score, log
    inclusion probability); the inclusion probability takes the next best score as the threshold.
    ``sizes`` holds the characters of walked words, and 0 for the others.
    """
    start, count, limit, cdf, logp, others, step = flat[:7]
    walked, every = np.flatnonzero(sizes), np.arange(types.size)

    def draw(kinds: np.ndarray) -> np.ndarray:
        point = (kinds << _CDF_BITS) + (rng.random(kinds.size) * _ONE).astype(np.int64)
        at = start[kinds]
        later = np.flatnonzero(point >= limit[kinds])  # few: of listed words the first option is the likeliest
        at[later] = np.searchsorted(cdf, point[later], "right")
        return at

    def tail(unit: int, kind: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers, choices and words of a draw from the word ``unit`` on, inside it from the number ``kind`` on."""
        if not walked.size:
            return types[unit:], draw(types[unit:]), every[unit:]
        parts = []
        for i in [*walked[np.searchsorted(walked, unit) :].tolist(), types.size]:
            if unit < i:
                parts.append((types[unit:i], draw(types[unit:i]), every[unit:i]))
                kind = -1
            if i < types.size:
                kind, end, kinds, choices = int(types[i]) if kind < 0 else kind, int(types[i] + sizes[i]), [], []
                while kind < end:
                    kinds.append(kind)
                    choices.append(int(draw(np.array([kind]))[0]))
                    kind += int(step[choices[-1]])
                parts.append((np.array(kinds, np.int64), np.array(choices, np.int64), np.full(len(kinds), i)))
            unit, kind = i + 1, -1
        return tuple(np.concatenate(c) for c in zip(*parts, strict=True)) if parts else (types[:0],) * 3

    path = tail(0, -1)
    score = -math.log(rng.exponential())
    out, frontier = [], []  # frontier: (scores, path, first place, options at the first place that are not taken)

    def options_without(kind: int, options: np.ndarray | None, choice: int) -> np.ndarray:
        options = np.arange(start[kind], start[kind] + count[kind]) if options is None else options
        return options[options != choice]

    def open_up(path: tuple, place: int, options: np.ndarray | None, score: float) -> None:
        """The parts left of the set (shares choices before ``place``) when ``path`` is taken out of it.

        ``options`` are those at ``place`` that the set still had, None for all.
        """
        kinds, choices, _ = path
        before = np.zeros(choices.size)
        np.cumsum(logp[choices[:-1]], out=before[1:])
        mass = before[place:] + others[choices[place:]]
        if options is not None:
            options = options_without(int(kinds[place]), options, int(choices[place]))
            mass[0] = before[place] + _log_sum(logp[options])
        frontier.append((_below(mass, score, rng), path, place, options))

    if path[0].size:
        open_up(path, 0, None, score)
    out.append((path[1], score))
    while len(out) < k:
        best = max(range(len(frontier)), key=lambda i: frontier[i][0].max(), default=None)
        if best is None or (score := float(frontier[best][0].max())) == -np.inf:
            break
        scores, (kinds, choices, units), place, options = frontier[best]
        at = int(scores.argmax())
        scores[at] = -np.inf
        at += place
        kind, unit = int(kinds[at]), int(units[at])
        if at > place or options is None:
            options = options_without(kind, None, int(choices[at]))
        weight = np.exp(logp[options] - logp[options].max())
        chosen = options[min(int(np.searchsorted(np.cumsum(weight), rng.random() * weight.sum(), "right")), options.size - 1)]
        inside = kind + int(step[chosen]) if sizes[unit] and kind + int(step[chosen]) < types[unit] + sizes[unit] else -1
        rest = tail(unit, inside) if inside >= 0 else tail(unit + 1, -1)
        path = tuple(np.concatenate(c) for c in zip((kinds[:at], choices[:at], units[:at]), ([kind], [chosen], [unit]), rest, strict=True))
        open_up(path, at, options, score)
        out.append((path[1], score))
    threshold = max((float(f[0].max()) for f in frontier), default=-np.inf)
    rows = []
    for path, score in out:
        total = float(logp[path].sum())
        gap = total - threshold
        rows.append((path, total, score, 0.0 if gap > 30 else float(math.log(max(-math.expm1(-math.exp(gap)), 1e-300)))))
    return rows


@functools.cache
def _lattice(path: str, inverse: float) -> Lattice:
    return Lattice(path, inverse)


def sample_texts(keys: list[int], texts: list[str], lattice: Lattice, k: int) -> list[list[tuple]]:
    """Per text its samples: (ids as little-endian 32-bit bytes, log-probability, perturbed score, log inclusion probability)."""
    parts = [words_of(t) for t in texts]
    types, sizes = lattice.types(parts)
    flat, most = lattice.flat(), math.log(_SHARE_LISTED / max(k - 1, 1)) if k > 1 else 0.0

    def spelt(path: np.ndarray) -> bytes:
        own = flat.width[path]
        return flat.ids[np.repeat(flat.first[path] - np.cumsum(own) + own, own) + np.arange(own.sum())].tobytes()

    out, end = [], 0
    for key, words in zip(keys, parts, strict=True):
        begin, end = end, end + len(words)
        own, walked = types[begin:end], sizes[begin:end]
        if words and float(np.where(walked, 0.0, flat.logp[flat.start[own]]).sum()) > most:
            distinct = list(dict.fromkeys(words))
            numbers = dict(zip(distinct, lattice.add_walked(distinct).tolist(), strict=True))
            own, walked = np.array([numbers[w] for w in words], np.int64), np.array([len(w) for w in words], np.int64)
            flat = lattice.flat()
        rng = np.random.Generator(np.random.Philox(key=key))
        out.append([(spelt(path), *rest) for path, *rest in search(flat, own, walked, k, rng)])
    return out


def encode_samples(
    docs: DataFrame, k: int = SAMPLES, inverse: float = INVERSE, seed: int = SEED, path: str | None = None
) -> DataFrame:
    """(doc_id, sample, ids, logp, perturbed, log_inclusion): up to ``k`` distinct segmentations per text.

    ``ids`` holds the piece ids as little-endian unsigned 32-bit numbers. Drawn without replacement
    with P ~ exp(inverse * sum of piece scores) over the text's whole lattice; ``log_inclusion`` is
    the log-probability that a segmentation is among the ``k`` given the threshold. Draws depend on
    the seed, the id and the text only, so a lost task gives the same rows again.

    Blanks join the word after them, as in the model. Words of more than ``WORD_CHARS`` characters are
    walked piece by piece over sums to their end, so all their segmentations can be drawn. Of shorter
    words those of less than 1e-13 of the word's mass are left out, less than the grain of a draw
    (2^-40); but where the first ``k`` - 1 samples could take more than 0.999 of a text's mass, so that
    what is left out would count in the next, all its words are walked. Defined cases: a null text counts as
    empty; an empty text has one segmentation, without pieces; a text with fewer than ``k``
    segmentations gives as many as it has; rows that repeat an id and text repeat their samples; an
    empty table gives no rows. Other columns are ignored.
    """
    path = path or model_path()
    small_batches(docs.sparkSession)
    kinds = (pa.int64(), pa.int32(), pa.binary(), pa.float64(), pa.float64(), pa.float64())
    names = ["doc_id", "sample", "ids", "logp", "perturbed", "log_inclusion"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = _lattice(path, inverse)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            at = 0
            while at < len(ids):
                upto, chars = at, 0
                while upto < len(ids) and chars < _CHARS_AT_ONCE:
                    chars += len(texts[upto])
                    upto += 1
                part = texts[at:upto]
                keys = [xxhash.xxh3_64_intdigest(f"{seed}:{i}:{t}".encode("utf-8", "surrogatepass")) for i, t in zip(ids[at:upto], part, strict=True)]
                rows = [
                    (i, n, *row) for i, found in zip(ids[at:upto], sample_texts(keys, part, lattice, k), strict=True) for n, row in enumerate(found)
                ]
                at = upto
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))
    return source.mapInArrow(run, "doc_id long, sample int, ids binary, logp double, perturbed double, log_inclusion double")


def decode(samples: DataFrame, path: str | None = None) -> DataFrame:
    """``samples`` with the column ``text`` (underscores if taken) that their ids spell. Null ids give a null text."""
    path = path or model_path()
    at, name = samples.columns.index("ids"), spare(samples, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _processor(path)
        for batch in batches:
            got = [None if b.as_py() is None else model.decode(np.frombuffer(b.as_py(), "<u4").tolist()) for b in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.string())], [*batch.schema.names, name])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in samples.schema.fields)
    return samples.mapInArrow(run, f"{fields}, `{name}` string")


def op4_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encode_samples(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "sample",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_pieces"),
        F.crc32("ids").alias("ids_crc32"),
        "logp",
        "perturbed",
        "log_inclusion",
    )

"""Texts decoded with the wrong character encoding: found, and restored where possible.

A smoothed character trigram model is trained on the clean words of all documents. Every distinct word with
characters beyond ASCII is scored as it stands and under each candidate chain (encode with the
encoding it was read in, decode with the one it was written in, once or twice). A chain is accepted
where its result is likelier than the word as it stands by more than a margin, and likely in itself.
Lost characters (U+FFFD, or a question mark between letters) are one more chain: the word with its gaps filled by the
likeliest characters must be likelier, by a margin of its own, than the word as it stands or parted in two at the question mark.

All limits are validated on the words of all documents: clean words as they stand against the same words garbled by every chain,
or robbed of characters, on purpose, against scraps of garbled text such as texts quote them, and against all pairs of words joined by a question mark.
Words decide, so a garbled stretch in a clean text is found.

Null, empty and plain ASCII texts are never cases, unless letters were lost in them.
The model has a fixed number of counters, whatever the corpus, and is counted over all documents.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

BUCKETS = 1 << 20  # counters of each order; the model has three orders
FILLINGS = 80  # characters tried where one was lost: the commonest beyond ASCII

#: Encodings a text may have been read in, by what it was written in.
READ_AS = {
    "utf-8": ("cp1252", "latin-1", "cp1250", "iso8859-2", "cp1251", "cp1254", "mac_roman", "cp437", "cp850", "koi8-r", "cp866", "gbk"),
    "cp1252": ("cp1250", "cp1251", "mac_roman", "cp437", "cp850", "cp1254", "koi8-r", "cp866"),
    "cp1250": ("cp1252", "cp1251", "mac_roman", "cp437", "iso8859-2"),
    "iso8859-2": ("cp1252", "cp1250"),
    "cp1254": ("cp1252", "cp1250", "cp1251", "mac_roman", "cp437"),
    "cp1251": ("cp1252", "koi8-r", "mac_roman", "cp437", "cp866", "cp1250", "mac_cyrillic"),
    "koi8-r": ("cp1252", "cp1251", "mac_roman", "cp866"),
    "cp866": ("cp1252", "cp1251", "koi8-r"),
    "mac_roman": ("cp1252", "cp1250"),
    "cp437": ("cp1252",),
    "cp850": ("cp1252",),
}
CHAINS: list[tuple[tuple[str, str], ...]] = [((w, t),) for t, ws in READ_AS.items() for w in ws]
UTF8_CHAINS = len(READ_AS["utf-8"])  # the first ones
CHAINS += [((w, "utf-8"),) * 2 for w in ("cp1252", "latin-1", "cp1250", "mac_roman")]
READ = list(dict.fromkeys(c[0][0] for c in CHAINS))
#: Where characters were lost: the replacement sign anywhere, a question mark between letters.
GAP = re.compile(r"�+|(?<=[^\W\d_])\?+(?=[^\W\d_])")
DIGITS = re.compile(r"[0-9]+")
#: Scripts and marks that running text is written in.
WRITTEN = regex.compile(r"[\p{Latin}\p{Greek}\p{Cyrillic}\p{Arabic}\p{Hebrew}\p{Devanagari}\p{Thai}\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}\x20-\x7e\xa0-¿‐-…€]*")
SPACE = 32


@dataclass(frozen=True)
class Limits:
    """What a word's repair must exceed: gain and mean log-likelihood, for chains and for lost characters."""

    margin: float
    likely: float
    lost_margin: float
    lost_likely: float


START = Limits(6.0, -5.5, 6.0, -5.5)


def _tables() -> tuple[dict[str, dict[str, int]], dict[str, list[str]]]:
    """Per single-byte encoding: byte by character and character by byte; bytes without a character stand for themselves."""
    encode, decode = {}, {}
    for name in {x for c in CHAINS for pair in c for x in pair} - {"utf-8", "gbk"}:
        chars = [bytes([b]).decode(name, "replace") for b in range(256)]
        chars = [chr(b) if c == "�" else c for b, c in enumerate(chars)]
        encode[name] = {c: b for b, c in reversed(list(enumerate(chars)))}
        if name in ("cp1252", "cp1254"):  # undefined bytes often came through as controls
            encode[name] |= {chr(b): b for b in range(0x80, 0xA0)}
        decode[name] = chars
    return encode, decode


ENCODE, DECODE = _tables()
UTF8 = re.compile(rb"(?:[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3})+")
def encoded(word: str, read: str) -> bytes | None:
    """The bytes that were read as ``word``, or None where that cannot be."""
    if read == "gbk":
        try:
            return word.replace("�", "?").encode("gb18030")
        except UnicodeEncodeError:
            return None
    table = ENCODE[read]
    try:
        return bytes([table[c] for c in word])
    except KeyError:
        return None


def decoded(raw: bytes | None, written: str) -> str | None:
    """Bytes decoded as they were written, or None where that cannot be."""
    if raw is None:
        return None
    if written != "utf-8":
        table = DECODE[written]
        return "".join([table[b] for b in raw])
    at, out, good, bad = 0, [], 0, 0
    for m in UTF8.finditer(raw):
        between = raw[at : m.start()]
        bad += sum(b > 127 for b in between)
        out += [between.decode("latin-1"), m.group().decode("utf-8", "replace")]
        good += len(m.group())
        at = m.end()
    rest = raw[at:]
    bad += sum(b > 127 for b in rest)
    if not good or bad * 4 > good:
        return None
    return "".join(out) + rest.decode("latin-1")


def step(word: str, read: str, written: str) -> str | None:
    """``word`` encoded as it was read and decoded as it was written, or None where that cannot be."""
    return decoded(encoded(word, read), written)


def apply(word: str, chain: tuple[tuple[str, str], ...]) -> str | None:
    for read, written in chain:
        word = step(word, read, written)
        if word is None:
            return None
    return word


def garble(word: str, chain: tuple[tuple[str, str], ...]) -> str | None:
    """The reverse: what ``word`` turns into when it is read wrongly, or None where that is impossible or changes nothing."""
    out = word
    for read, written in reversed(chain):
        try:
            raw = out.encode(written)
        except UnicodeEncodeError:
            return None
        out = raw.decode("gb18030", "replace") if read == "gbk" else "".join([DECODE[read][b] for b in raw])
    return None if out == word else out


def bucket(order: int, a, b, c):
    """The counter of an n-gram, for code points or arrays of them."""
    return order * BUCKETS + ((a * 0x9E3779B1 ^ b * 0x85EBCA77 ^ c * 0xC2B2AE3D) >> 5) % BUCKETS


def contexts(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points (a, b, c) of each character c of each word and the space behind it, after a and b; and the word's number."""
    code = np.frombuffer(("  " + "  ".join(words) + "  ").encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    a, b, c = code[:-2], code[1:-1], code[2:]
    real = (c != SPACE) | (b != SPACE)
    a, b, c = a[real], b[real], c[real]
    ends = c == SPACE
    return a, b, c, np.cumsum(ends) - ends


def trained_on(word: str) -> bool:
    """Whether a word may be taken as clean: no controls, no lost characters, and no UTF-8 behind it."""
    if word.isascii():
        return GAP.search(word) is None
    if any("\x7f" <= c <= "\x9f" or c == "�" for c in word) or GAP.search(word):
        return False
    for read in READ_AS["utf-8"]:
        got = step(word, read, "utf-8")
        if got and len(got) < len(word) and WRITTEN.fullmatch(got):
            return False
    return True


def suspects(text: str) -> list[str]:
    """The distinct words with characters beyond ASCII or a question mark between letters, digits made alike."""
    return list(dict.fromkeys(DIGITS.sub("0", w) for w in text.translate(BLANKS).split(" ") if not w.isascii() or "?" in w and GAP.search(w)))


BLANKS = str.maketrans("\t\r\n", "   ")


class Model:
    """Interpolated trigram model over hashed counters, with the search for the likeliest chain and for the likeliest filling of lost characters."""

    def __init__(self, counts: np.ndarray, limits: Limits = START) -> None:
        self.counts, self.limits = counts, limits
        self.total = float(counts[2 * BUCKETS :].sum()) or 1.0
        seen = [(self.counts[bucket(2, SPACE, SPACE, c)], c) for c in range(0xA0, 0x2200) if chr(c).isprintable()]
        self.fillings = np.array(sorted(c for n, c in sorted(seen, reverse=True)[:FILLINGS] if n > 0), dtype=np.int64)

    def __getstate__(self) -> tuple:
        """Only the counters in use travel to the workers."""
        at = np.flatnonzero(self.counts)
        return at.astype(np.int32), self.counts[at], self.limits

    def __setstate__(self, state: tuple) -> None:
        counts = np.zeros(3 * BUCKETS)
        counts[state[0]] = state[1]
        self.__init__(counts, state[2])

    def log_p(self, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Log-probability of each character ``c`` after ``a`` and ``b``."""
        counts, space = self.counts, np.full_like(b, SPACE)
        tri, bi, uni = counts[bucket(0, a, b, c)], counts[bucket(1, space, b, c)], counts[bucket(2, space, space, c)]
        one = counts[bucket(2, space, space, b)]
        two = np.where((a == SPACE) & (b == SPACE), one, counts[bucket(1, space, a, b)])
        one = np.where(one > 0, one, self.total)
        return np.log(0.7 * tri / np.maximum(np.maximum(two, tri), 1) + 0.2 * bi / np.maximum(one, bi) + 0.09 * uni / self.total + 1e-7)

    def scores(self, words: list[str], ends: bool = True) -> np.ndarray:
        """Log-likelihood of each word between spaces, or, without ``ends``, as the beginning of a longer word."""
        if not words:
            return np.zeros(0)
        a, b, c, owner = contexts(words)
        p = self.log_p(a, b, c)
        return np.bincount(owner, p if ends else np.where(c == SPACE, 0.0, p), len(words))

    def repaired(self, words: list[str]) -> list[tuple[float, float, int, str]]:
        """For each word (gain, mean log-likelihood, chain, result) of the likeliest chain; gain 0 where none applies."""
        tried, owner, chain = [], [], []
        for i, w in enumerate(words):
            if w.isascii():
                continue
            raw, seen = {x: encoded(w, x) for x in READ}, {w}
            for k, ch in enumerate(CHAINS):
                got = decoded(raw[ch[0][0]], ch[0][1])
                if got and len(ch) > 1:
                    got = apply(got, ch[1:])
                if got and got not in seen and got.isprintable() and (ch[0][1] == "utf-8" or sum(x.isalpha() for x in got) >= 3):
                    seen.add(got)  # of chains with the same result the first counts
                    tried.append(got)  # between single-byte encodings, one or two letters prove nothing
                    owner.append(i)
                    chain.append(k)
        own, new = self.scores(words), self.scores(tried)
        out = [(0.0, -99.0, -1, w) for w in words]
        for got, i, k, s in zip(tried, owner, chain, new.tolist()):
            if s - own[i] > out[i][0]:
                out[i] = (s - own[i], s / (len(got) + 1), k, got)
        return out

    def filled(self, words: list[str]) -> list[tuple[float, float, str]]:
        """For each word with lost characters (gain, mean log-likelihood around the gaps, filling) against the word as it stands or parted after a question mark.

        A lost sign stands for one character, or two for one. A word without any other letter or digit proves nothing.
        """
        out = [(0.0, -99.0, w) for w in words]
        plain, at, ways, owner = [], [], [], []
        for i, w in enumerate(words):
            gaps = list(GAP.finditer(w)) if any(c.isalnum() for c in w) else []
            if not gaps or not len(self.fillings):
                continue
            plain += [w] if "�" in w else [w, *[p for m in gaps for p in (w[: m.end()], w[m.end() :])]]
            at.append((i, len(plain)))
            for width in (1, 2):
                if all(len(m.group()) % width == 0 for m in gaps):
                    ways.append(GAP.sub(lambda m, width=width: "\0" * (len(m.group()) // width), w).split("\0"))
                    owner.append(i)
        if not at:
            return out
        own, standing, start = self.scores(plain).tolist(), {}, 0
        for i, end in at:
            x = own[start:end]
            standing[i] = max([x[0], *[x[k] + x[k + 1] for k in range(1, len(x) - 1, 2)]])
            start = end
        score, around, texts = self.fill(ways)
        for i, s, m, t in zip(owner, score, around, texts):
            if s - standing[i] > out[i][0] or out[i][1] == -99:
                out[i] = (s - standing[i], m, t)
        return out

    def fill(self, ways: list[list[str]], beam: int = 3) -> tuple[list[float], list[float], list[str]]:
        """For words given as the parts between their gaps: score of the likeliest filling, mean log-likelihood around the gaps, and the filling. Gaps are filled from left to right."""
        signs = [chr(c) for c in self.fillings]
        state = [[parts[0]] for parts in ways]
        for j in range(1, max(map(len, ways))):
            going = [i for i, parts in enumerate(ways) if j < len(parts)]
            tried = [p + f + ways[i][j] for i in going for p in state[i] for f in signs]
            score, start = self.scores(tried, False), 0
            for i in going:
                n = len(state[i]) * len(signs)
                state[i] = [tried[start + k] for k in np.argsort(-score[start : start + n], kind="stable")[:beam].tolist()]
                start += n
        every = [t for s in state for t in s]
        score, best, start = self.scores(every), [], 0
        for s in state:
            best.append(start + int(np.argmax(score[start : start + len(s)])))
            start += len(s)
        texts = [every[k] for k in best]
        a, b, c, owner = contexts(texts)
        near = np.zeros(len(c), dtype=bool)
        first = np.searchsorted(owner, np.arange(len(texts)))
        for i, parts in enumerate(ways):
            x = first[i]
            for part in parts[:-1]:
                x += len(part)
                near[x : min(x + 3, first[i] + len(texts[i]) + 1)] = True
                x += 1
        p = np.where(near, self.log_p(a, b, c), 0.0)
        around = np.bincount(owner, p, len(texts)) / np.maximum(1, np.bincount(owner, near, len(texts)))
        return score[best].tolist(), around.tolist(), texts

    def judge(self, words: list[str]) -> list[bool]:
        """Whether each word was garbled, or lost characters."""
        x = self.limits
        chained = self.repaired(words)
        gapped = [i for i, w in enumerate(words) if GAP.search(w)]
        lost = dict(zip(gapped, self.filled([words[i] for i in gapped])))
        return [(g > x.margin and m > x.likely) or (i in lost and lost[i][0] > x.lost_margin and lost[i][1] > x.lost_likely) for i, (g, m, _, _) in enumerate(chained)]

    def lost(self, text: str) -> bool:
        """Whether characters were lost inside words of the text."""
        words = [w for w in suspects(text) if GAP.search(w)]
        return any(g > self.limits.lost_margin and m > self.limits.lost_likely for g, m, _ in self.filled(words))

    def is_garbled(self, text: str) -> bool:
        return any(self.judge(suspects(text)))

    def restore(self, text: str) -> str:
        """The text with every word repaired for which the text's own chains are the likeliest. Lost characters stay lost."""
        if text.isascii():
            return text
        x = self.limits
        words = [w for w in suspects(text) if not w.isascii()]
        found = dict(zip(words, self.repaired(words)))
        chains = Counter(k for g, m, k, _ in found.values() if g > x.margin and m > x.likely)
        if not chains:
            return text
        main = CHAINS[chains.most_common(1)[0][0]]
        by_main = {w: got for w in words if (got := apply(w, main)) and got != w and got.isprintable()}
        better = dict(zip(by_main, self.scores(list(by_main.values())) > self.scores(list(by_main))))

        def fix(m: re.Match) -> str:
            word = m.group()
            key = DIGITS.sub("0", word)
            gain, mean, k, _ = found.get(key, (0.0, 0.0, -1, ""))
            if gain <= 0:
                return word
            if better.get(key):
                return apply(word, main) or word
            return (apply(word, CHAINS[k]) or word) if gain > x.margin and mean > x.likely else word

        return re.sub(r"[^ \t\r\n]+", fix, text)


def word_table(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, w``: the distinct words of each document, digits made alike. Only ASCII white space parts words: other kinds may be garbled bytes."""
    plain = F.regexp_replace(F.translate(F.col(f"`{text}`"), "\t\r\n", "   "), "[0-9]+", "0")
    words = F.array_distinct(F.filter(F.split(plain, " "), lambda w: w != ""))
    return docs.where(F.col(f"`{text}`").isNotNull()).select(F.col(f"`{key}`"), F.explode(words).alias("w"))


def suspicious(w: str = "w"):
    """Whether a word has characters beyond ASCII, or a question mark between letters."""
    return F.col(w).rlike(r"[^\x00-\x7f]|\p{L}\?+\p{L}")


def train(words: DataFrame) -> np.ndarray:
    """Counters of the clean words of ``words`` (w, n), each as often as documents hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(3 * BUCKETS)
        for batch in batches:
            pairs = [(w, n) for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if trained_on(w)]
            if pairs:
                a, b, c, owner = contexts([w for w, _ in pairs])
                weight, space = np.array([n for _, n in pairs], dtype=float)[owner], np.full_like(a, SPACE)
                for k in (bucket(0, a, b, c), bucket(1, space, b, c), bucket(2, space, space, c)):
                    counts += np.bincount(k, weight, 3 * BUCKETS)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(counts[at].astype(np.int64), pa.int64())], names=["k", "n"])

    found = words.mapInArrow(run, "k int, n bigint").groupBy("k").agg(F.sum("n").alias("n")).toArrow()  # at most 3 * BUCKETS rows
    counts = np.zeros(3 * BUCKETS)
    counts[found.column("k").to_numpy()] = found.column("n").to_numpy()
    return counts


GAINS = tuple(x / 4 for x in range(81))  # tried margins
MEANS = tuple(-8 + x / 4 for x in range(25))  # tried mean log-likelihoods


def pieces(words: list[str], most: int) -> Iterator[slice]:
    """Slices of ``words`` of at most ``most`` characters, or of one word."""
    start = held = 0
    for i, w in enumerate(words):
        if held and held + len(w) > most:
            yield slice(start, i)
            start, held = i, 0
        held += len(w)
    if words:
        yield slice(start, len(words))


def trials(model: Model, words: list[str], weights: list[int]) -> Counter[tuple[str, int, int]]:
    """How the repairs of clean words, and of what becomes of them on purpose, fall among the tried limits: (what, gain bin, mean bin) to number.

    ``clean``: each word as it stands, as often as documents hold it; ``garbled``: read by each chain; ``scrap``: each of its characters beyond ASCII alone,
    read by each chain of UTF-8, as texts quote them; ``lost``: those characters replaced by ``?``, and by U+FFFD.
    Words of ASCII letters are only counted, for :func:`joined`: (``end``, the last two characters) and (``start``, the first two), a space beside a single letter.
    """
    out: Counter = Counter()
    for part in pieces(words, 1 << 11):
        sets: dict[str, Counter] = {k: Counter() for k in ("clean", "garbled", "scrap", "lost")}
        for w, n in zip(words[part], weights[part]):
            if w.isascii():
                if w.isalpha():
                    for kind, (a, b) in (("end", f" {w}"[-2:]), ("start", f"{w} "[:2])):
                        out[kind, ord(a), ord(b)] += 1
                continue
            sets["clean"][w] += n
            sets["garbled"].update(got for chain in CHAINS if (got := garble(w, chain)) and not got.isascii())
            for c in {c for c in w if not c.isascii()}:
                for chain in CHAINS[:UTF8_CHAINS]:
                    if got := garble(c, chain):
                        sets["scrap"][got] += 1 / len(w)
            for sign in "?�":
                gone = "".join(c if c.isascii() else sign for c in w)
                if GAP.search(gone) and any(c.isalnum() for c in gone):
                    sets["lost"][gone] += 1
        for kind, found in sets.items():
            made, times = [*found], [*found.values()]
            for some in pieces(made, 1 << 14):
                for (gain, mean, *_), n in zip((model.filled if kind == "lost" else model.repaired)(made[some]), times[some]):
                    out[kind, bisect_left(GAINS, gain), bisect_left(MEANS, mean)] += n
    return out


def joined(model: Model, counts: dict[tuple[str, int, int], float]) -> Counter[tuple[str, int, int]]:
    """How all ordered pairs of words of ASCII letters, with a question mark and no blank between, fall among the tried limits, as ``joined`` in :func:`trials`.

    The gain of :meth:`Model.filled` and its mean around the gap depend on the two characters on either side alone, so pairs of ends and starts (2,756 each at most) stand for all pairs of words.
    """
    out: Counter = Counter()
    (ends, end_n), (starts, start_n) = [(np.array([k[1:] for k in counts if k[0] == kind], dtype=np.int64).reshape(-1, 2), np.array([n for k, n in counts.items() if k[0] == kind])) for kind in ("end", "start")]
    f, c1, c2, space, mark = model.fillings[:, None], starts[:, 0], starts[:, 1], np.full(1, SPACE), np.full(1, ord("?"))
    if not len(f) or not len(ends):
        return out
    single, behind, own = c2 == SPACE, model.log_p(f, c1[None], c2[None]), model.log_p(space, space, c1) + model.log_p(space, c1, c2)
    grid = np.zeros((len(GAINS) + 1, len(MEANS) + 1))
    for b in np.unique(ends[:, 1]):
        last = np.full(1, b)
        after = model.log_p(last[:, None], f, c1[None])
        standing = np.maximum(model.log_p(last, mark, c1) + model.log_p(mark, c1, c2), model.log_p(last, mark, space) + own)
        for (a, _), n in zip(ends[ends[:, 1] == b], end_n[ends[:, 1] == b]):
            before = np.full(1, a)
            score = model.log_p(before, last, f) + after
            best = (score + behind).max(0)
            if single.any():  # the search keeps three fillings before it meets the end of the word
                kept = np.argsort(-score[:, single], 0, kind="stable")[:3]
                best[single] = np.take_along_axis((score + behind)[:, single], kept, 0).max(0)
            gain = best - standing - model.log_p(before, last, mark)
            np.add.at(grid, (np.searchsorted(GAINS, gain), np.searchsorted(MEANS, best / 3)), n * start_n)
    for g, m in zip(*np.nonzero(grid)):
        out["joined", int(g), int(m)] = float(grid[g, m])
    return out


def best_limits(counts: dict[tuple[str, int, int], float], documents: int) -> Limits:
    """The limits with the fewest errors: garbled words missed (share), clean words taken (per document), scraps and joined words taken (shares). Ties go to the stricter limits."""

    def above(kind: str) -> tuple[np.ndarray, float]:
        grid = np.zeros((len(GAINS) + 1, len(MEANS) + 1))
        for (k, g, m), n in counts.items():
            if k == kind:
                grid[g, m] += n
        passed = grid[::-1, ::-1].cumsum(0).cumsum(1)[::-1, ::-1][1:, 1:]  # gain and mean above the tried ones
        return passed, grid.sum()

    (clean, _), (wrong, all_wrong), (scrap, all_scrap), (lost, all_lost), (joined, all_joined) = map(above, ("clean", "garbled", "scrap", "lost", "joined"))

    def least(errors: np.ndarray) -> tuple[float, float]:
        g, m = max(zip(*np.nonzero(errors <= errors.min() + 1e-12)))
        return GAINS[g], MEANS[m]

    x = least(-wrong / all_wrong + clean / max(1, documents) + scrap / max(1.0, all_scrap)) if all_wrong else (START.margin, START.likely)
    y = least(-lost / all_lost + joined / max(1.0, all_joined)) if all_lost else (START.lost_margin, START.lost_likely)
    return Limits(*x, *y)


def fitted(docs: DataFrame, key: str, text: str) -> tuple[Model, DataFrame, Broadcast]:
    """A model trained, and its limits validated, on the words of all documents; these words (w, n); and the model as a broadcast, without its limits.

    Words whose likeliest repair is a word that more documents hold are garbled rather than clean: the model is trained again without them.
    """
    spark = docs.sparkSession
    words = word_table(docs, key, text).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    words = cut(words.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "w"))  # few rows, but each is much work
    rough = spark.sparkContext.broadcast(Model(train(words)))

    def repairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ws, ns = (batch.column(i).to_pylist() for i in (0, 1))
            found = [(w, n, r[3]) for w, n, r in zip(ws, ns, rough.value.repaired(ws)) if r[0] > 0]
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in ((0, pa.string()), (1, pa.int64()), (2, pa.string()))], names=["w", "n", "got"])

    foreign = words.where(suspicious())
    doubtful = foreign.mapInArrow(repairs, "w string, n bigint, got string").withColumn("got", F.regexp_replace("got", "[0-9]+", "0"))
    doubtful = doubtful.join(words.select(F.col("w").alias("got"), F.col("n").alias("more")), "got").where("more > n").select("w")
    clean = cut(words.join(doubtful, "w", "left_anti").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "w"))
    rough.destroy()
    model = Model(train(clean))
    shared, documents = spark.sparkContext.broadcast(model), docs.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            pairs = [(w, n) for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if trained_on(w)]
            for k, n in trials(shared.value, [w for w, _ in pairs], [n for _, n in pairs]).items():
                counts[k] += n
        rows = list(counts.items())
        yield pa.RecordBatch.from_arrays([pa.array([r[0][0] for r in rows], pa.string()), *[pa.array([r[0][i] for r in rows], pa.int32()) for i in (1, 2)], pa.array([float(r[1]) for r in rows], pa.float64())], names=["what", "g", "m", "n"])

    tried = clean.mapInArrow(run, "what string, g int, m int, n double").groupBy("what", "g", "m").agg(F.sum("n").alias("n")).collect()  # at most 4 * 82 * 26 + 2 * 2756 rows
    counts = {(r["what"], r["g"], r["m"]): r["n"] for r in tried}
    model.limits = best_limits({**counts, **joined(model, counts)}, documents)
    return model, words, shared


def find_garbled(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key`` of each document with a garbled word. Each distinct word is judged once; documents meet the garbled words by a semi-join."""
    return _holding(docs, key, text, *fitted(docs, key, text))


def _holding(docs: DataFrame, key: str, text: str, model: Model, words: DataFrame, shared: Broadcast) -> DataFrame:
    limits = model.limits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        model.limits = limits
        for batch in batches:
            hit = model.judge(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(hit, pa.bool_()))], names=["w"])

    garbled = cut(words.where(suspicious()).select("w").mapInArrow(run, "w string"))
    return word_table(docs, key, text).where(suspicious()).join(garbled, "w", "left_semi").select(F.col(f"`{key}`")).distinct()


def restore_garbled(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, text, restored, lost`` of each document with a garbled word; ``lost`` tells that characters are gone for good. ``key`` identifies documents."""
    model, words, shared = fitted(docs, key, text)
    limits = model.limits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        model.limits = limits
        for batch in batches:
            rows = [(k, t, model.restore(t), model.lost(t)) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            columns = list(zip(*rows)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.column(0).type), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.bool_())], names=[key, "text", "restored", "lost"])

    kind = docs.schema[key].dataType.simpleString()
    cases = docs.select(F.col(f"`{key}`"), F.col(f"`{text}`")).join(_holding(docs, key, text, model, words, shared), key, "left_semi")
    return cases.mapInArrow(run, f"`{key}` {kind}, text string, restored string, lost boolean")

"""Text that was decoded with the wrong encoding: affected records, and the original where it can be restored.

A character model over the whole corpus (hashed counts of characters and pairs, of fixed size) says how
expected a text is. A text with an unexpected stretch is mapped back to bytes under each wrong encoding; an
automaton over the bytes (a compiled regular language of the true encoding) finds the maximal well-formed
multibyte spans; only those are decoded, and only where the decoded span is far more expected than what
stands there. Single letters within words of another script may be too few to tell each for itself: the gains of
all such spans of a pair of encodings in a text count together. The steps repeat, up to ``ROUNDS`` times, for
text garbled more than once. What is garbled often would be
expected: the pairs of encodings found in more than ``COMMON`` of all texts, searched without regard to how
expected the text is, and the texts they explain are left out of the counts that all texts are judged by. Replacement characters, and unexpected runs that no
pair of encodings explains, are affected without being restored.

The texts of a block are worked on together: bytes, spans and scores of all of them are arrays. Of the spans that
are searched without regard to how expected the text is, those are left out whose gain, by a bound from their
decoded characters one by one, can't be enough.

Defined results: null, empty and blank texts aren't affected; rare characters that are expected to be single
(symbols, variants, fractions) don't count; repeated rows get equal answers; an empty table gives an empty
one; only the named columns are read.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.blocks import blocks, code_points
from quire.llm.same_look import look_alikes, unify

ONE_BITS, TWO_BITS = 17, 21
RARE = 0x19000  # characters above those have slots of unassigned ones, 8,192 in all
#: A span is restored when its decoded form is more expected by this much (natural logarithm), in all and per character of the text.
GAIN, GAIN_EACH = 8.0, 1.0
BETTER_EACH = 0.5  # unless the rules of UTF-8 vouch for them, decoded characters must be more expected one by one, not only fewer
GAIN_SUM = 8.0  # of several spans of a pair of encodings, none of which is enough by itself
FOREIGN_EACH = 1.5  # least gain of each of these
GAIN_AGAIN = 1.0  # for a further span of a pair of encodings already found in the text
ODD = -9.3  # mean score of WINDOW characters below which a text is looked at
ODD_SPAN = -8.5  # mean score below which a span may be garbled
WINDOW = 3
ROUNDS = 3
COMMON = 0.01  # share of the texts from which a pair of encodings is common
COMMON_WIDTH, COMMON_EACH = 8, 0.3  # characters of a span, and its gain for each of them, that count there
LEAVING = 2  # times such texts are left out, as the model of the others gets clearer
UNEXPLAINED_RUN, UNEXPLAINED_MEAN = 12, -12.0

# True encodings by the wrong encoding that was used, and the well-formed multibyte spans of each.
PAIRS = {
    "western": ("utf-8", "gb18030", "euc_jp", "shift_jis", "big5", "cp1251", "koi8_r"),
    "mac_roman": ("utf-8", "gb18030"),
    "cp1251": ("utf-8", "gb18030", "western", "koi8_r"),
    "gb18030": ("utf-8", "big5", "shift_jis", "euc_jp"),
    "big5": ("gb18030", "utf-8", "shift_jis"),
    "shift_jis": ("utf-8", "gb18030", "euc_jp"),
    "koi8_r": ("utf-8", "cp1251"),
}
SPANS = {
    "utf-8": rb"(?:[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xef][\x80-\xbf]{2}|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3})+",
    "gb18030": rb"(?:[\xa1-\xf7][\xa1-\xfe]|[\x81-\xfe][\x40-\x7e\x80-\xfe])+",
    "big5": rb"(?:[\xa1-\xf9][\x40-\x7e\xa1-\xfe])+",
    "euc_jp": rb"(?:[\xa1-\xf4][\xa1-\xfe]|\x8e[\xa1-\xdf])+",
    "shift_jis": rb"(?:[\x81-\x9f\xe0-\xef][\x40-\x7e\x80-\xfc]|[\xa1-\xdf])+",
    "cp1251": rb"[\xa8\xb8\xc0-\xff]+",
    "koi8_r": rb"[\xa3\xb3\xc0-\xff]+",
    "western": rb"[\x80-\xff]+",
}
SPANS = {k: re.compile(v) for k, v in SPANS.items()}
LOST = re.compile("�|锟斤拷|ï¿½|烫烫烫|屯屯屯")


@lru_cache(1)
def _western() -> tuple[dict[int, int], str]:
    """cp1252, with the bytes it leaves open as control characters."""
    back, forth = {}, []
    for i in range(256):
        try:
            ch = bytes([i]).decode("cp1252")
        except UnicodeDecodeError:
            ch = chr(i)
        back[ord(ch)] = i
        forth.append(ch)
    for i in range(0x80, 0xA0):  # text read as Latin-1 has them too
        back.setdefault(i, i)
    return back, "".join(forth)


codecs.register_error("quire-gap", lambda e: (b"\xff" * (e.end - e.start), e.end))


def to_bytes(text: str, wrong: str) -> bytes:
    """text as bytes of the wrong encoding; 0xFF, which is in no span, for what it lacks."""
    if wrong == "western":
        return codecs.charmap_encode(text, "quire-gap", _western()[0])[0]
    return text.encode(wrong, "quire-gap")


def from_bytes(raw: bytes, true: str) -> str | None:
    try:
        return codecs.charmap_decode(raw, "strict", _western()[1])[0] if true == "western" else raw.decode(true)
    except UnicodeDecodeError:
        return None


class CharModel:
    """How expected each character is: the lower of its log-probability by itself and after the one before it.

    Garbled text of one kind follows its own regularities, so what follows what in it isn't unusual; its
    characters are. A wrong letter within a word is the other way round."""

    def __init__(self, one: np.ndarray, two: np.ndarray):
        total = max(float(one.sum()), 1.0)
        self.one = ((one + 0.2) / (total + 0.2 * len(one))).astype(np.float32)
        self.alone = np.log(self.one)
        self.count = one.astype(np.float32)
        self.two = two.astype(np.float32)

    @staticmethod
    def slots_of_one(flat: np.ndarray) -> np.ndarray:
        return np.where(flat >> ONE_BITS, np.uint32(RARE) + (flat & np.uint32(0x1FFF)), flat).astype(np.int64)

    @staticmethod
    def slots(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a = CharModel.slots_of_one(flat)
        h = (flat[:-1].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ flat[1:].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(0xD6E8FEB86659FD93)
        return a, (h >> np.uint64(64 - TWO_BITS)).astype(np.int64)

    def log_p(self, flat: np.ndarray) -> np.ndarray:
        if not len(flat):
            return np.zeros(0, np.float32)
        a, b = self.slots(flat)
        p = self.one[a]
        after = (self.two[b] + 8.0 * p[1:]) / (self.count[a[:-1]] + 8.0)
        return np.log(np.concatenate([p[:1], np.minimum(after, p[1:])]))


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    one, two = np.zeros(1 << ONE_BITS, np.int64), np.zeros(1 << TWO_BITS, np.int64)
    for b in blocks(batches, "text"):
        flat, _ = code_points([t + "\n" for t in b.column("text").to_pylist() if t])
        if len(flat):
            x, y = CharModel.slots(flat)
            one += np.bincount(x, minlength=len(one))
            two += np.bincount(y, minlength=len(two))
    both = np.concatenate([one, two])
    some = np.flatnonzero(both)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(both[some])], names=["slot", "n"])


def char_model(df: DataFrame) -> CharModel:
    """The model of the column text; what reaches the driver is at most one count per slot."""
    got = df.select("text").mapInArrow(_count_batches, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    both = np.zeros((1 << ONE_BITS) + (1 << TWO_BITS), np.int64)
    both[got["slot"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    return CharModel(both[: 1 << ONE_BITS], both[1 << ONE_BITS :])


@lru_cache(8)
def _codes(wrong: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of each character of the first plane as a number, whether they are two, and whether the encoding has it.

    Of four bytes the first two are enough, since the second, a digit, is in no span."""
    raw = to_bytes("\n".join(chr(i) for i in range(1 << 16) if i != 10), wrong).split(b"\n")
    raw.insert(10, b"\n")
    codes = np.array([int.from_bytes(r[:2]) for r in raw], np.uint16)
    has = codes != 0xFF
    if last := from_bytes(b"\xff", wrong):
        has[ord(last)] = True
    return codes, np.array([len(r) > 1 for r in raw]), has


def _encode(flat: np.ndarray, wrong: str) -> tuple[np.ndarray, np.ndarray | None]:
    """Characters as bytes of the wrong encoding, as in to_bytes, and where each begins; None if each is one byte."""
    codes, twos, _ = _codes(wrong)
    low = np.minimum(flat, np.uint32(0xFFFF))
    code, two = codes[low], twos[low]
    far = np.flatnonzero(flat > 0xFFFF)
    if len(far):
        kinds, which = np.unique(flat[far], return_inverse=True)
        raw = [to_bytes(chr(c), wrong) for c in kinds.tolist()]
        code[far] = np.array([int.from_bytes(r[:2]) for r in raw], np.uint16)[which]
        two[far] = np.array([len(r) > 1 for r in raw])[which]
    if not two.any():
        return code.astype(np.uint8), None
    kept = np.ones(2 * len(flat), bool)
    kept[::2] = two
    return code.astype(">u2").view(np.uint8)[kept], np.concatenate([[0], np.cumsum(two + np.int64(1))])


def _among(*ranges: int) -> np.ndarray:
    """Which bytes are in the ranges, given as first and last."""
    out = np.zeros(256, bool)
    for a, b in zip(ranges[::2], ranges[1::2]):
        out[a : b + 1] = True
    return out


#: Pairs of bytes: first and second ones, as in SPANS.
TWOS = {
    "gb18030": ((_among(0x81, 0xFE), _among(0x40, 0x7E, 0x80, 0xFE)),),
    "big5": ((_among(0xA1, 0xF9), _among(0x40, 0x7E, 0xA1, 0xFE)),),
    "euc_jp": ((_among(0xA1, 0xF4), _among(0xA1, 0xFE)), (_among(0x8E, 0x8E), _among(0xA1, 0xDF))),
}
ONES = {"cp1251": _among(0xA8, 0xA8, 0xB8, 0xB8, 0xC0, 0xFF), "koi8_r": _among(0xA3, 0xA3, 0xB3, 0xB3, 0xC0, 0xFF), "western": _among(0x80, 0xFF)}
JIS_LEAD, JIS_TRAIL, JIS_ONE = _among(0x81, 0x9F, 0xE0, 0xEF), _among(0x40, 0x7E, 0x80, 0xFC), _among(0xA1, 0xDF)


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From and to of the stretches where mask is true."""
    at = np.flatnonzero(np.diff(mask, prepend=False, append=False))
    return at[::2], at[1::2]


def byte_spans(raw: np.ndarray, true: str) -> tuple[np.ndarray, np.ndarray]:
    """From and to of the matches of SPANS[true], found over all bytes at once."""
    if true in ONES:
        return _runs(ONES[true][raw])
    if true in TWOS:  # a stretch of n starts of pairs holds every second of them, and goes on in a stretch right behind it
        ok = np.zeros(len(raw), bool)
        for lead, trail in TWOS[true]:
            ok[:-1] |= lead[raw[:-1]] & trail[raw[1:]]
        first, last = _runs(ok)
        last = first + (last - first + 1) // 2 * 2
        apart = first[1:] != last[:-1]
        return first[np.concatenate([[True], apart])[: len(first)]], last[np.concatenate([apart, [True]])[: len(last)]]
    if true == "shift_jis":  # in a stretch of lead bytes every second one is a trail byte
        at = np.flatnonzero(JIS_LEAD[raw])
        begins = np.diff(at, prepend=-2) != 1
        at = at[(at - at[np.maximum.accumulate(np.where(begins, np.arange(len(at)), 0))]) % 2 == 0]
        at = at[at + 1 < len(raw)]
        at = at[JIS_TRAIL[raw[at + 1]]]
        mask = JIS_ONE[raw]
        mask[at] = mask[at + 1] = True
        return _runs(mask)
    a, b, c, d = (np.concatenate([raw, np.zeros(3, np.uint8)])[k : len(raw) + k] for k in range(4))
    after = [(x & 0xC0) == 0x80 for x in (b, c, d)]
    two = (a >= 0xC2) & (a <= 0xDF) & after[0]
    three = ((a >= 0xE0) & (a <= 0xEF)) & after[0] & after[1] & ((a != 0xE0) | (b >= 0xA0))
    four = ((a >= 0xF0) & (a <= 0xF3)) & after[0] & after[1] & after[2] & ((a != 0xF0) | (b >= 0x90))
    mask = two | three | four
    mask[1:] |= mask[:-1]  # the second byte; no sequence begins there
    mask[2:] |= (three | four)[:-2]
    mask[3:] |= four[:-3]
    return _runs(mask)


class Block:
    """Texts one after the other, with a line break behind each, and sums up to each character: of its score, of
    characters beyond ASCII, of letters of another script."""

    def __init__(self, model: CharModel, texts: list[str]):
        self.texts = texts
        self.flat, self.bounds = code_points([t + "\n" for t in texts])
        starts, ends = self.bounds[:-1], self.bounds[1:] - 2
        scores = model.log_p(self.flat)
        scores[starts] = model.alone[CharModel.slots_of_one(self.flat[starts])]  # nothing is before them
        foreign = foreign_letters(self.flat)
        foreign[starts] = foreign[ends] = False
        self.sums = np.concatenate([[0.0], np.cumsum(scores, dtype=np.float64)])
        self.high, self.foreign = (np.concatenate([[0], np.cumsum(x)]) for x in (self.flat > 127, foreign))

    def beyond(self) -> np.ndarray:
        return np.diff(self.high[self.bounds])

    def owner(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, at, "right") - 1

    def spans(self, only: frozenset, least: int = 1, most_lack: bool = True) -> Iterator[tuple]:
        """For each of these pairs of encodings: wrong, true, all bytes, and of each span from and to in these, whether
        each character of its text is a byte, from and to in characters of the block.

        least: characters of a span. most_lack: also in texts of whose characters beyond ASCII the wrong encoding
        lacks more than half."""
        half = 0.5 * self.beyond()
        for wrong, trues in PAIRS.items():
            trues = [t for t in trues if (wrong, t) in only]
            if not trues:
                continue
            flat, chars, ends = self.flat, None, self.bounds
            if not most_lack:
                low = np.minimum(flat, np.uint32(0xFFFF))
                has = _codes(wrong)[2][low] & (flat > 127) | (flat > 0xFFFF)  # beyond the first plane taken as had
                some = np.flatnonzero((np.diff(np.concatenate([[0], np.cumsum(has)])[self.bounds]) >= half) & (half > 0))
                if not len(some):
                    continue
                size = np.diff(self.bounds)[some]
                ends = np.concatenate([[0], np.cumsum(size)])
                chars = self.bounds[some] - ends[:-1]  # from places in flat to those in the block
                flat = flat[np.repeat(chars, size) + np.arange(ends[-1])] if len(some) < len(half) else flat
            raw, begins = _encode(flat, wrong)
            thin = np.ones(len(ends) - 1, bool) if begins is None else np.diff(begins[ends]) == np.diff(ends)
            for true in trues:
                first, last = byte_spans(raw, true)
                if begins is not None:  # whole characters only
                    long = last - first >= least
                    first, last = np.searchsorted(begins, first[long], "left"), np.searchsorted(begins, last[long], "right") - 1
                long = last - first >= least
                first, last = first[long], last[long]
                k = np.searchsorted(ends, first, "right") - 1
                s, e = (first, last) if begins is None else (begins[first], begins[last])
                off = 0 if chars is None else chars[k]
                yield wrong, true, raw, s, e, thin[k], first + off, last + off

    def around(self, a: np.ndarray, b: np.ndarray, k: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray]:
        """A span with the character before and the one behind it, as far as there are any."""
        return np.maximum(self.bounds[k], a + (shift - 1)), np.minimum(self.bounds[k + 1] - 1, b + 1)

    def reach(self, model: CharModel, true: str, raw: np.ndarray, s: np.ndarray, e: np.ndarray, lo: np.ndarray, hi: np.ndarray, within: np.ndarray) -> np.ndarray:
        """The gain of each span's bytes, decoded, can't be above this; -inf where the mean of the characters can't gain enough.

        A character's score is at most that of itself, whatever is before it. Bytes that don't decode are left
        out; the last three characters, which may be cut off, and the first don't count."""
        size = e - s + 1
        ends = np.cumsum(size)
        piece = raw[np.repeat(s - (ends - size), size) + np.arange(ends[-1])]
        piece[ends - 1] = 10
        got = piece.tobytes()
        out = codecs.charmap_decode(got, "strict", _western()[1])[0] if true == "western" else got.decode(true, "ignore")
        flat = np.frombuffer(out.encode("utf-32-le", "surrogatepass"), np.uint32)
        stops = np.flatnonzero(flat == 10)
        begins = np.concatenate([[0], stops[:-1] + 1])
        sums = np.concatenate([[0.0], np.cumsum(model.alone[CharModel.slots_of_one(flat)], dtype=np.float64)])
        most = sums[np.maximum(stops - 3, begins + 1)] - sums[begins + 1]
        olds = self.sums[hi] - self.sums[lo + 1]
        gains = most - olds
        if true != "utf-8":
            gains[most / np.maximum(hi - lo - 1 - within + stops - begins, 1) - olds / np.maximum(hi - lo - 1, 1) <= COMMON_EACH] = -np.inf
        return gains


def _shifts(true: str, thin: bool) -> tuple[int, ...]:
    """Where decoding begins: at the first byte, and, if a character is a byte, also at the second one."""
    return (0, 1) if thin and true in ("gb18030", "euc_jp", "shift_jis", "big5") else (0,)


def worth_a_search(model: CharModel, texts: list[str]) -> np.ndarray:
    """Which texts may have a pair of encodings whose long spans, each with a gain, hold half of the characters beyond ASCII.

    No other text can be explained by a pair, nor by one whose wrong encoding lacks more than half of them."""
    worth = np.zeros(len(texts), bool)
    flat, bounds = code_points([t + "\n" for t in texts])
    if len(flat) < COMMON_WIDTH:
        return worth
    # a span of n characters has n / 2 beyond ASCII at least: other bytes only follow a lead byte
    high = np.concatenate([[0], np.cumsum(flat > 127)])
    dense = np.concatenate([[0], np.cumsum(high[COMMON_WIDTH:] - high[:-COMMON_WIDTH] >= COMMON_WIDTH // 2), np.zeros(COMMON_WIDTH, np.int64)])
    dense[-COMMON_WIDTH:] = dense[-COMMON_WIDTH - 1]
    some = np.flatnonzero(dense[bounds[1:]] > dense[bounds[:-1]])
    if not len(some):
        return worth
    block = Block(model, [texts[i] for i in some.tolist()])
    half = 0.5 * block.beyond()
    for _, true, raw, s, e, thin, a, b in block.spans(EVERY, COMMON_WIDTH, most_lack=False):
        k = block.owner(a)
        held = block.high[b] - block.high[a]
        ok = (np.bincount(k, held, len(half)) >= half)[k] & ~worth[some[k]]
        s, e, thin, a, b, k, held = (v[ok] for v in (s, e, thin, a, b, k, held))
        best = np.full(len(a), -np.inf)
        for shift in _shifts(true, bool(thin.any())):
            now = np.flatnonzero(thin) if shift else np.arange(len(a))
            if len(now):
                lo, hi = block.around(a[now], b[now], k[now], shift)
                best[now] = np.maximum(best[now], block.reach(model, true, raw, s[now] + shift, e[now], lo, hi, (b - a)[now] - shift))
        ok = best > GAIN_AGAIN
        sure = (np.bincount(k[ok], held[ok], len(half)) >= half) & (np.bincount(k[best > GAIN], minlength=len(half)) > 0)
        worth[some[sure]] = True
    return worth


def _pairs_of(shared):
    """Each text's pairs of encodings that explain half of its characters beyond ASCII."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text"):
            met: list[tuple[str, str]] = []
            texts = b.column("text").to_pylist()
            texts = [t for t, w in zip(texts, worth_a_search(shared.value, texts)) if w]
            for t, (_, spans) in zip(texts, repair_all(shared.value, texts, EVERY)):
                held: dict[tuple[str, str], int] = {}
                for x, y, *pair in spans:
                    held[tuple(pair)] = held.get(tuple(pair), 0) + sum(c > "\x7f" for c in t[x:y])
                met += [p for p, n in held.items() if n >= 0.5 * sum(c > "\x7f" for c in t)]
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in met], pa.string()) for i in (0, 1)], names=["wrong", "true"])

    return run


def common_pairs(rows: DataFrame, shared) -> frozenset:
    """The pairs of encodings by which more than COMMON of the texts are garbled, searched in all of them."""
    texts = rows.where(F.length("text") > 0).select("text")
    n = texts.count()
    got = texts.mapInArrow(_pairs_of(shared), "wrong string, true string").groupBy("wrong", "true").count().collect()
    return frozenset((r[0], r[1]) for r in got if r[2] >= max(3, COMMON * n))


def _without(shared, common: frozenset):
    """The texts that none of these pairs of encodings explains in any part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text"):
            texts = [t for t in b.column("text").to_pylist() if t]
            texts = [t for t, (_, spans) in zip(texts, repair_all(shared.value, texts, common)) if not spans]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])

    return run


def _scores(model: CharModel, texts: list[str]) -> np.ndarray:
    """Sum of the scores of the characters of each text after its first one."""
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    bounds = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))])
    lp = model.log_p(flat).astype(np.float64)
    starts = bounds[:-1][np.diff(bounds) > 0]
    lp[starts] = 0.0
    sums = np.concatenate([[0.0], np.cumsum(lp)])
    return sums[bounds[1:]] - sums[bounds[:-1]]


EVERY = frozenset((wrong, true) for wrong, trues in PAIRS.items() for true in trues)


def repair_once(model: CharModel, text: str, only: frozenset | None = None) -> tuple[str, list[tuple[int, int, str, str]]]:
    """The text with its best spans decoded, and those spans: (from, to, wrong, true)."""
    return repair_all(model, [text], only)[0]


def repair_all(model: CharModel, texts: list[str], only: frozenset | None = None) -> list[tuple[str, list[tuple[int, int, str, str]]]]:
    """Each text with its best spans decoded, and those spans: (from, to, wrong, true).

    only: these pairs of encodings, in long spans, however expected the text is."""
    if not texts:
        return []
    better, least_each = (BETTER_EACH, GAIN_EACH) if only is None else (COMMON_EACH, COMMON_EACH)
    block = Block(model, texts)
    sums, foreign = block.sums, block.foreign
    asked: list[tuple[int, int, int, int, int, str, str, str]] = []
    pieces: list[str] = []
    tried: set[tuple] = set()
    for wrong, true, raw, s, e, thin, first, last in block.spans(EVERY if only is None else only, 1 if only is None else COMMON_WIDTH):
        at = np.arange(len(first))
        if only is None:  # the rules of UTF-8 over single bytes say enough
            wide = last - first
            ok = ((sums[last] - sums[first]) / wide <= ODD_SPAN) | (foreign[last] > foreign[first]) | (thin if true == "utf-8" else False)
            at = at[ok & (wide > (0 if true in ONES or true == "utf-8" else 1))]
        k = block.owner(first[at])
        for shift in _shifts(true, bool(thin.any())):
            now = np.flatnonzero(thin[at]) if shift else np.arange(len(at))
            x, y, of, a, b = s[at[now]] + shift, e[at[now]], k[now], first[at[now]], last[at[now]]
            lo, hi = block.around(a, b, of, shift)
            if only is not None and len(now):
                far = block.reach(model, true, raw, x, y, lo, hi, b - a - shift) > GAIN_AGAIN
                x, y, of, a, b, lo, hi = (v[far] for v in (x, y, of, a, b, lo, hi))
            data = raw.tobytes() if len(x) else b""
            for x, y, of, a, b, lo, hi in zip(*(v.tolist() for v in (x, y, of, a, b, lo, hi))):
                piece = data[x:y]
                if (true, piece, a) in tried:
                    continue
                tried.add((true, piece, a))
                out = from_bytes(piece, true)
                for less in (1, 2, 3):  # the last sequence may be cut
                    out = from_bytes(piece[:-less], true) if out is None and len(piece) > less else out
                if not out and only is not None and true != "western":
                    out = piece.decode(true, "ignore")
                if not out:
                    continue
                t, base = texts[of], int(block.bounds[of])
                asked.append((of, lo, hi, a + shift, b, out, wrong, true))
                pieces.append(t[lo - base : a + shift - base] + out + t[b - base : hi - base])
    found: list[list[tuple[float, float, int, int, str, str, str]]] = [[] for _ in texts]
    if asked:
        news = _scores(model, pieces)
        lo, hi, a, b = (np.array(v, np.int64) for v in zip(*(x[1:5] for x in asked)))
        gains = news - (sums[hi] - sums[lo + 1])
        size = np.fromiter((len(x[5]) for x in asked), np.int64, len(asked))
        each = news / np.maximum(hi - lo - 1 - (b - a) + size, 1) - (news - gains) / np.maximum(hi - lo - 1, 1)
        vouched = np.array([x[7] == "utf-8" for x in asked], bool)
        hopeful = np.flatnonzero((gains > GAIN_AGAIN) & (vouched | (each > better))).tolist()
        bare = [texts[of][lo - block.bounds[of] : hi - block.bounds[of]].strip() for of, lo, hi, *_ in (asked[i] for i in hopeful)]
        eased = np.maximum(_scores(model, unify(bare)) - _scores(model, bare), 0.0) if bare else ()  # full-width or look-alike letters aren't garbled
        for i, ease in zip(hopeful, eased):
            of, _, _, a, b, out, wrong, true = asked[i]
            if (gain := gains[i] - ease) > GAIN_AGAIN:
                found[of].append((gain, least_each * (b - a), a, b, out, wrong, true))
    return [_restored(t, int(base), spans, foreign, only is None) for t, base, spans in zip(texts, block.bounds, found)]


def _restored(text: str, base: int, found: list[tuple], foreign: np.ndarray, letters: bool) -> tuple[str, list[tuple[int, int, str, str]]]:
    """The text, which begins at base, with those of the spans found that are sure."""
    sure = {(w, t) for gain, least, *_, w, t in found if gain > max(GAIN, least)}
    if letters:  # single letters within words of another script
        total: dict[tuple[str, str], float] = {}
        for gain, _, a, b, _, w, t in found:
            if gain >= FOREIGN_EACH and foreign[b] > foreign[a]:
                total[w, t] = total.get((w, t), 0.0) + gain
        sure |= {pair for pair, gain in total.items() if gain > GAIN_SUM}
    taken: list[tuple[int, int, str, str, str]] = []
    for _, _, a, b, out, wrong, true in sorted(found, reverse=True):
        if (wrong, true) in sure and all(b <= x or a >= y for x, y, *_ in taken):
            taken.append((a, b, out, wrong, true))
    taken.sort()
    parts, at = [], 0
    for a, b, out, *_ in taken:
        parts += [text[at : a - base], out]
        at = b - base
    return "".join([*parts, text[at:]]), [(a - base, b - base, w, t) for a, b, _, w, t in taken]


def examine(model: CharModel, text: str) -> tuple[bool, str, str | None]:
    """(affected, restored text, how): how lists the encodings, or says lost."""
    return examine_all(model, [text])[0]


def examine_all(model: CharModel, texts: list[str]) -> list[tuple[bool, str, str | None]]:
    """(affected, restored text, how) of each text: how lists the encodings, or says lost."""
    how: list[list[str]] = [[] for _ in texts]
    now = list(texts)
    open_ones = list(range(len(texts)))
    for _ in range(ROUNDS):
        changed = []
        for i, (text, spans) in zip(open_ones, repair_all(model, [now[i] for i in open_ones])):
            now[i] = text
            how[i] += [f"{w}<{t}" for _, _, w, t in spans]
            changed += [i] * bool(spans)
        open_ones = [i for i in changed if odd_texts(model, [now[i]])[0]]  # each by itself: its end isn't to be read with another's start
    lost = [bool(LOST.search(x)) or bool(LOST.search(t)) for x, t in zip(now, texts)]
    rest = [i for i in range(len(texts)) if not lost[i] and not how[i]]
    for i, other in zip(rest, unify([now[i] for i in rest]) if rest else ()):
        worst = []  # a run of unexpected characters that nothing explains, however they are written
        for x in (now[i], other):
            lp = model.log_p(code_points([x])[0])
            worst.append(float(np.convolve(lp, np.full(UNEXPLAINED_RUN, 1 / UNEXPLAINED_RUN), "valid").min()) if len(lp) >= UNEXPLAINED_RUN else 0.0)
        lost[i] = max(worst) < UNEXPLAINED_MEAN
    return [(bool(h or gone), x, ",".join(dict.fromkeys(h)) or ("lost" if gone else None)) for x, h, gone in zip(now, how, lost)]


@lru_cache(1)
def _utf8_signs() -> tuple[np.ndarray, np.ndarray]:
    """Which characters are a lead byte of UTF-8 read as western text, and which a byte that follows one."""
    lead, trail = np.zeros(1 << 16, bool), np.zeros(1 << 16, bool)
    for ch, byte in _western()[0].items():
        lead[ch], trail[ch] = 0xC2 <= byte <= 0xF4, 0x80 <= byte <= 0xBF
    for sign, after in zip("‚√", (b"\x80", bytes(range(0x80, 0xC0)))):  # the same as read with mac_roman: dashes, quotes, accents
        lead[ord(sign)] = True
        trail[[ord(c) for c in after.decode("mac_roman")]] = True
    return lead, trail


@lru_cache(1)
def _scripts() -> np.ndarray:
    """1: Latin letters; 2: Cyrillic letters that look like no other, and ideographs."""
    kind = np.zeros(1 << 16, np.uint8)
    kind[65:91] = kind[97:123] = kind[0xC0:0x250] = 1
    kind[0x400:0x460] = kind[0x3400:0xA000] = 2
    kind[[p for p in look_alikes() if p < 1 << 16]] = 0
    return kind


def foreign_letters(flat: np.ndarray) -> np.ndarray:
    """Which characters are letters of another script in the midst of Latin ones, or at the end of a word of these."""
    kind = _scripts()[np.minimum(flat, np.uint32(0xFFFF))]
    out = np.zeros(len(flat), bool)
    if len(flat) > 2:
        out[1:-1] = (kind[1:-1] == 2) & (kind[:-2] == 1) & (kind[2:] != 2)
    return out


def odd_texts(model: CharModel, texts: list[str]) -> np.ndarray:
    """Which texts hold a stretch that the model doesn't expect."""
    flat, bounds = code_points([t + "\n" for t in texts])
    lp = model.log_p(flat)
    sums = np.concatenate([[0.0], np.cumsum(lp, dtype=np.float64)])
    low = (sums[WINDOW:] - sums[:-WINDOW]) < ODD * WINDOW
    high = flat[: len(low)] > 127
    for i in range(1, WINDOW):
        high |= flat[i : i + len(low)] > 127
    at = np.flatnonzero(low & high)
    lead, trail = _utf8_signs()
    low_byte = np.minimum(flat, np.uint32(0xFFFF))
    pair = np.flatnonzero(lead[low_byte[:-1]] & trail[low_byte[1:]])
    odd = np.zeros(len(texts), bool)
    for where in (at, pair, np.flatnonzero(foreign_letters(flat))):
        odd[np.searchsorted(bounds, where, "right") - 1] = True
    return odd


def _repair_batches(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: CharModel = shared.value
        for b in blocks(batches, "text"):
            texts = [t or "" for t in b.column("text").to_pylist()]
            odd = odd_texts(model, texts)
            asked = list(dict.fromkeys(t for t, o in zip(texts, odd) if o or "�" in t))
            memo = dict(zip(asked, examine_all(model, asked)))
            out = [memo.get(t, (False, t, None)) for t in texts]
            cols = [pa.array([r[i] for r in out], k) for i, k in enumerate((pa.bool_(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([b.column("id"), *cols], names=["id", "affected", "restored", "how"])

    return run


def repair_encoding(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, affected, restored, how) of every row; restored is the text itself where nothing was wrong."""
    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    spread = df.sparkSession.sparkContext.broadcast
    shared = spread(char_model(rows))
    common = common_pairs(rows, shared)
    for _ in range(LEAVING if common else 0):
        shared = spread(char_model(rows.select("text").mapInArrow(_without(shared, common), "text string")))
    return rows.mapInArrow(_repair_batches(shared), "id string, affected boolean, restored string, how string")

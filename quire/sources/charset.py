"""The encoding of a text file, by its bytes: marks, strict UTF-8, then how much each legacy encoding explains."""

from __future__ import annotations

import codecs
import re
from functools import lru_cache

HEAD = 100_000  # bytes that are looked at
# Legacy encodings that are told apart, in the order that settles a tie, and names for one thing.
LEGACY = ("gb18030", "big5", "shift_jis", "euc_jp", "euc_kr", "cp1252")
SAME = {"gbk": "gb18030", "gb2312": "gb18030", "ascii": "utf-8", "utf-16-le": "utf-16", "utf-16-be": "utf-16", "latin-1": "cp1252"}
MARKS = ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16"))


@lru_cache(1)
def _usual() -> frozenset:
    """Ideographs of the first level of two standards, which texts consist of: rows 16 to 55 of one, 0xA4 to 0xC6 of the other."""
    first = {bytes([a, b]).decode("gb2312", "ignore") for a in range(0xB0, 0xD8) for b in range(0xA1, 0xFF)}
    other = {bytes([a, b]).decode("big5", "ignore") for a in range(0xA4, 0xC7) for b in (*range(0x40, 0x7F), *range(0xA1, 0xFF))}
    return frozenset("".join(first | other))


def score(raw: bytes, name: str) -> float:
    """How well the bytes read as name, for each character beyond ASCII: usual letters count, odd ones and errors count against it."""
    text = raw.decode(name, "replace")
    high = [c for c in text if c > "\x7f"]
    if not high:
        return 0.0
    usual = _usual()
    good = bad = 0.0
    kana = sum("ぁ" <= c <= "ヿ" for c in high)
    for c in high:
        if c == "�" or "" <= c <= "" or c < "\xa0":
            bad += 3
        elif c in usual or c in "，。！？；：、“”‘’（）《》「」『』…—·　":
            good += 1
        elif "ぁ" <= c <= "ヿ":
            good += 1 if kana > 0.3 * len(high) and name in ("shift_jis", "euc_jp") else -0.5
        elif "가" <= c <= "힣":
            good += 1 if name == "euc_kr" else -0.5
        elif "｡" <= c <= "ﾟ":
            bad += 1
        elif name == "cp1252" and c.isalpha():
            good += 0.4
        else:
            bad += 0.5
    return (good - bad) / len(high)


def detect(raw: bytes) -> str:
    """The encoding of a file from its first HEAD bytes. Plain ASCII counts as UTF-8."""
    head = raw[:HEAD]
    for mark, name in MARKS:
        if head.startswith(mark):
            return name
    if len(head) > 3 and head.count(0) > len(head) // 8:  # half of the bytes of Latin text are zero
        return "utf-16-le" if head[1::2].count(0) >= head[0::2].count(0) else "utf-16-be"
    try:
        codecs.getincrementaldecoder("utf-8")().decode(head, len(raw) <= HEAD)
        return "utf-8"
    except UnicodeDecodeError:
        pass
    if len(re.findall(rb"[\x80-\xff]", head)) == 0:
        return "utf-8"
    return max(LEGACY, key=lambda n: (round(score(head, n), 6), -LEGACY.index(n)))

"""Column expressions over texts. All stay in the JVM; offsets and lengths count code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space of any kind, ideographs, and the punctuation that counts as such, as parts of a class.
SPACE = r"\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
IDEOGRAPH = r"\x{4e00}-\x{9fff}"
PUNCTUATION = r"""，。、；：？！“”‘’（）【】《》—…·.,;:?!'"()\[\]{}"""


#: The same white space as single characters.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def count_of(c: Column, inside: str) -> Column:
    """How many characters of c are of the class."""
    return F.length(c) - F.length(F.regexp_replace(c, f"[{inside}]", ""))


def token_estimate(c: Column) -> Column:
    """1.5 tokens an ideograph, a quarter of one for any other character."""
    n = count_of(c, IDEOGRAPH)
    return F.floor(F.lit(1.5) * n + F.lit(0.25) * (F.length(c) - n)).cast("int")


def language_label(c: Column) -> Column:
    n = F.length(c)
    cn, en = count_of(c, IDEOGRAPH) / n, count_of(c, "A-Za-z") / n
    return F.when(F.coalesce(n, F.lit(0)) == 0, "未知").when(cn > 0.8, "中文").when(cn > 0.3, "中英混合").when(en > 0.3, "英文").otherwise("其他")


def content_type(c: Column) -> Column:
    share = count_of(c, IDEOGRAPH) / F.greatest(F.length(c), F.lit(1))
    return F.when(share > 0.8, "纯中文").when(share > 0.3, "中英混合").otherwise("英文/其他")


def summary(c: Column, longest: int = 200) -> Column:
    """Up to the first sentence sign, in the order 。！？ and line end, with at most 100 characters after it."""
    head = F.substring(c, 1, 500)
    out = None
    for sign in ("。", "！", "？", "\n"):
        parts = F.split(head, sign)
        one = F.substring(strip(F.concat(parts[0], F.lit(sign), F.substring(parts[1], 1, 100))), 1, longest)
        out = F.when(F.instr(head, sign) > 0, one) if out is None else out.when(F.instr(head, sign) > 0, one)
    return out.otherwise(strip(F.substring(c, 1, longest)))


def title(c: Column) -> Column:
    """The first of ten lines that isn't blank and has fewer than 50 characters."""
    lines = F.transform(F.slice(F.split(strip(c), "\n"), 1, 10), lambda x: F.btrim(x, F.lit("#" + SPACES)))
    return F.coalesce(F.get(F.filter(lines, lambda x: (F.length(x) > 0) & (F.length(x) < 50)), F.lit(0)), F.lit("未命名书籍"))


def category_of_path(c: Column) -> Column:
    """The parent folder, or the one above if the parent is a storage folder."""
    parts = F.split(c, "/")
    stores = ["raw_books", "books", "data", ""]
    up = lambda n: F.coalesce(F.get(parts, F.size(parts) - n), F.lit(""))
    return F.when(~up(2).isin(stores), up(2)).when(~up(3).isin(stores), up(3)).otherwise("未分类")


def size_bucket(n: Column) -> Column:
    k = 1024
    return F.when(n < 100 * k, "<100KB").when(n < 500 * k, "100-500KB").when(n < k * k, "500KB-1MB").when(n < 5 * k * k, "1-5MB").when(n < 10 * k * k, "5-10MB").otherwise(">10MB")


def safe_name(c: Column) -> Column:
    return F.translate(c, " /", "__")


def tokens(c: Column) -> Column:
    """Lower-case runs of letters and digits; a run of ideographs is one token."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}]+)"), 1)


def bigram_tokens(c: Column) -> Column:
    """The optional analyser: words as they are, ideographs in pairs."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"(?=([\x{4e00}-\x{9fff}]{2}))|([a-z0-9]+)"), 1)


def safe_file_name(name: str) -> str:
    return name.translate(str.maketrans(" /", "__"))


def file_size(n: Column) -> Column:
    """A number of bytes for a reader."""
    k = 1024
    return F.when(n < k, F.format_string("%dB", n.cast("long"))).when(n < k * k, F.format_string("%.1fKB", n / k)).otherwise(F.format_string("%.1fMB", n / (k * k)))


def heading(stack: Column) -> Column:
    """The innermost heading of a stack, '' for none."""
    return F.coalesce(F.try_element_at(stack, F.lit(-1)), F.lit(""))


def stable_id(*parts: Column) -> Column:
    """An id that a repeated run makes again."""
    return F.sha2(F.concat_ws("|", *(p.cast("string") for p in parts)), 256)


def short_summary(c: Column) -> Column:
    """The first two sentences, as one."""
    sentences = F.filter(F.split(c, "[。！？]"), lambda x: F.length(F.trim(x)) > 0)
    return F.array_join(F.slice(sentences, 1, 2), "")

"""Language of documents and of the segments of mixed ones, with a confidence.

A bidirectional gated recurrent network reads the bytes of each sentence in patches of ``PATCH`` bytes (a patch
is the sum of the embeddings of its byte trigrams) and labels every patch; the probabilities are pooled over
the sentence, over runs of sentences (segments) and over documents. It is trained here, in numpy, by
backpropagation through time on a bounded sample of labelled rows (``PER_LANGUAGE`` documents of each label,
chosen by a hash of their ids); sentences whose label the half-trained network strongly denies are left out
of the rest, since some labels are wrong. A class of its own, trained on sentences garbled on purpose, takes
unreadable text.

Defined results: null, empty and blank texts have no segments and no language; unreadable text counts for no
language; equal texts get equal answers; repeated rows count once per id; an empty table gives an empty one.
Without any labelled row nothing can be learnt, and no language is given.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.llm.blocks import BLOCK, blocks, code_points
from quire.llm.same_look import LOOK_ALIKES

LANGUAGES = ("zh", "en", "fr", "de", "es", "ru", "ja")
UNREADABLE = len(LANGUAGES)
PER_LANGUAGE = 120  # labelled documents of each language to train on
SENTENCES = 900  # training sentences of each language at most
PATCH, BUCKETS, EMBED, HIDDEN = 8, 8192, 16, 16
WINDOW = 48  # patches a sequence has at most; a longer sentence makes several
ROUNDS, BATCH, RATE = 12, 128, 0.014
# Signs that end a sentence wherever they stand, and those that do before white space.
ENDERS = np.array([ord(c) for c in "。！？!?\n\r；"], np.uint32)
STOPS = np.array([ord(c) for c in ".”\"»:;…"], np.uint32)


def plain(flat: np.ndarray) -> np.ndarray:
    """Full-width letters as plain ones; other code points as they are."""
    wide = (flat >= 0xFF01) & (flat <= 0xFF5E) & ~np.isin(flat, np.array([ord(c) for c in "，；！？：（）"], np.uint32))
    return np.where(wide, flat - np.uint32(0xFEE0), flat)


def sentence_bounds(flat: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Starts of the sentences, and the end of the last; none spans two texts."""
    n = len(flat)
    if not n:
        return np.zeros(1, np.int64)
    space = (flat == 32) | (flat == 10)
    after = np.zeros(n, bool)
    after[1:] = np.isin(flat[:-1], ENDERS)
    after[2:] |= space[1:-1] & np.isin(flat[:-2], STOPS)
    closing = np.isin(flat, np.array([ord(c) for c in "”’」』»\")\n "], np.uint32))
    after &= ~closing  # closing signs stay with what they close
    after[1:] |= closing[:-1] & ~closing[1:] & (np.isin(np.concatenate([[0], flat[:-2]]), ENDERS) | (flat[:-1] == 10))
    starts = np.flatnonzero(after)
    return np.unique(np.concatenate([bounds, starts]))


def _patches(flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket ids of the bytes in patches (n, PATCH), and of each sequence its first patch and number of patches."""
    width = 1 + (flat >= 0x80).astype(np.int64) + (flat >= 0x800) + (flat >= 0x10000)
    raw = np.frombuffer(flat.astype("<u4").tobytes().decode("utf-32-le", "replace").encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    at = np.concatenate([[0], np.cumsum(width)])[starts]
    grams = raw.copy()
    grams[1:] += raw[:-1] * np.uint32(257)
    grams[2:] += raw[:-2] * np.uint32(66047)
    grams = (grams * np.uint32(2654435761)) >> np.uint32(32 - 13)
    sizes = np.diff(at)
    n = -(-sizes // PATCH)
    first = np.concatenate([[0], np.cumsum(n)])
    ids = np.full(first[-1] * PATCH, BUCKETS, np.int32)
    ids[np.arange(len(raw)) - np.repeat(at[:-1] - first[:-1] * PATCH, sizes)] = grams[: at[-1]]
    return ids.reshape(-1, PATCH), first[:-1], n


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """The parameters, the forward pass and its gradient."""

    def __init__(self, seed: int = 5):
        g = np.random.default_rng(seed)
        f = lambda *s: (g.normal(size=s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"E": (0.1 * g.normal(size=(BUCKETS + 1, EMBED))).astype(np.float32), "O": f(2 * HIDDEN, UNREADABLE + 1), "o": np.zeros(UNREADABLE + 1, np.float32)}
        self.p["E"][BUCKETS] = 0
        for d in "fb":
            self.p |= {f"X{d}": f(EMBED, 3 * HIDDEN), f"x{d}": np.zeros(3 * HIDDEN, np.float32), f"U{d}": f(HIDDEN, 3 * HIDDEN)}

    def forward(self, ids: np.ndarray, mask: np.ndarray, keep: bool = False):
        """ids (batch, time, PATCH); mask (batch, time). Probabilities of every patch, and what the gradient needs."""
        p = self.p
        x = np.take(p["E"], ids[:, :, 0], axis=0)
        for i in range(1, PATCH):
            x += np.take(p["E"], ids[:, :, i], axis=0)
        states, kept = [], {}
        n, t = mask.shape
        for d in "fb":
            pre = np.ascontiguousarray((x @ p[f"X{d}"] + p[f"x{d}"]).transpose(1, 0, 2))
            short = not mask.all()
            u = p[f"U{d}"]
            h = np.zeros((n, HIDDEN), np.float32)
            hs = np.zeros((n, t, HIDDEN), np.float32)
            steps = []
            for i in range(t) if d == "f" else range(t - 1, -1, -1):
                hu = h @ u
                zr = _sigmoid(pre[i, :, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                c = np.tanh(pre[i, :, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
                new = c + z * (h - c)
                if short:
                    new *= mask[:, i, None]
                if keep:
                    steps.append((i, h, z, r, c, hu[:, 2 * HIDDEN :]))
                h = new
                hs[:, i] = h
            states.append(hs)
            kept[d] = steps
        both = np.concatenate(states, 2)
        logits = both @ p["O"] + p["o"]
        logits -= logits.max(2, keepdims=True)
        prob = np.exp(logits)
        prob /= prob.sum(2, keepdims=True)
        return (prob, x, both, kept) if keep else prob

    def gradient(self, ids, mask, labels):
        """Of the mean cross-entropy of the patches; labels (batch, time)."""
        p = self.p
        prob, x, both, kept = self.forward(ids, mask, True)
        d = prob.copy()
        n, t = mask.shape
        d[np.arange(n)[:, None], np.arange(t)[None], labels] -= 1
        d *= (mask / mask.sum())[:, :, None]
        g = {"O": np.einsum("ntk,ntc->kc", both, d), "o": d.sum((0, 1))}
        dboth = d @ p["O"].T
        dx = np.zeros_like(x)
        for k, way in enumerate("fb"):
            u = p[f"U{way}"]
            dpre = np.zeros((n, t, 3 * HIDDEN), np.float32)
            du = np.zeros_like(u)
            dh = np.zeros((n, HIDDEN), np.float32)
            for i, h, z, r, c, hc in reversed(kept[way]):
                dh = (dh + dboth[:, i, k * HIDDEN : (k + 1) * HIDDEN]) * mask[:, i, None]
                dc = dh * (1 - z) * (1 - c * c)
                dz = dh * (h - c) * z * (1 - z)
                dr = dc * hc * r * (1 - r)
                dhu = np.concatenate([dz, dr, dc * r], 1)
                dpre[:, i] = np.concatenate([dz, dr, dc], 1)
                du += h.T @ dhu
                dh = dh * z + dhu @ u.T
            g[f"U{way}"], g[f"x{way}"] = du, dpre.sum((0, 1))
            g[f"X{way}"] = np.einsum("nte,ntg->eg", x, dpre)
            dx += dpre @ p[f"X{way}"].T
        e = np.zeros_like(p["E"])
        where = ids.reshape(-1)
        for c in range(EMBED):
            e[:, c] = np.bincount(where, np.repeat(dx[:, :, c].reshape(-1), PATCH), BUCKETS + 1)
        e[BUCKETS] = 0
        return g | {"E": e}, prob


def _garbled(text: str, way: int) -> str:
    """text decoded with a wrong encoding."""
    wrong, true = (("cp1252", "utf-8"), ("gb18030", "utf-8"), ("latin-1", "gb18030"), ("big5", "gb18030"), ("cp1251", "gb18030"), ("mac_roman", "utf-8"), ("cp1251", "cp1252"), ("koi8_r", "cp1251"), ("utf-8", "gb18030"))[way]
    return text.encode(true, "ignore").decode(wrong, "replace")


def train(texts: list[tuple[str, str]], seed: int = 5) -> Network:
    """A network from (language, text) pairs."""
    g = np.random.default_rng(seed)
    sentences: dict[str, list[str]] = {}
    for lang, text in sorted(texts):
        flat, bounds = code_points([text])
        b = sentence_bounds(flat, bounds)
        sentences.setdefault(lang, []).extend(s for s in (text[i:j].strip() for i, j in zip(b[:-1], b[1:])) if len(s) >= (8 if lang in ("zh", "ja") else 16))
    alike: dict[str, list[str]] = {}
    for pairs in LOOK_ALIKES.values():
        for a in pairs.split():
            alike.setdefault(a[1], []).append(a[0])
    chosen: list[tuple[str, int]] = []
    for lang, own in sentences.items():
        g.shuffle(own)
        for s in own[:SENTENCES]:
            if lang not in ("zh", "ja", "ru") and g.random() < 0.12:
                s = "".join(alike[c][int(g.integers(len(alike[c])))] if c in alike and g.random() < 0.35 else c for c in s)
            chosen.append((s, LANGUAGES.index(lang)))
            if g.random() < 0.16:
                bad = _garbled(s, int(g.integers(9)))
                if bad != s and sum(a != b for a, b in zip(bad, s)) > 0.15 * len(s):
                    chosen.append((bad, UNREADABLE))
    network = Network(seed)
    if not chosen:
        return network
    # single sentences and pairs of different languages, so that a patch says its own language
    mixed = []
    for i in g.permutation(len(chosen))[: len(chosen) // 3]:
        mixed.append((int(i), int(g.integers(len(chosen)))))
    rows = [((i,)) for i in range(len(chosen))] + mixed
    ids, labels = [], []
    for row in rows:
        flat, bounds = code_points([chosen[i][0] + " " for i in row])
        patch, first, n = _patches(plain(flat), bounds)
        ids.append(patch[:WINDOW])
        labels.append(np.concatenate([np.full(k, chosen[i][1]) for i, k in zip(row, n)])[:WINDOW])
    order = np.argsort([len(x) for x in ids], kind="stable")
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in network.p.items()}
    trusted = np.ones(len(ids), bool)
    step = 0
    for round_ in range(ROUNDS):
        live = order[trusted[order]]
        starts = g.permutation(range(0, len(live), BATCH))
        rate = RATE * (1 - round_ / ROUNDS) ** 0.7
        for s in starts:
            part = live[s : s + BATCH]
            t = max(len(ids[i]) for i in part)
            a, m, y = np.full((len(part), t, PATCH), BUCKETS, np.int32), np.zeros((len(part), t), np.float32), np.zeros((len(part), t), np.int64)
            for r, i in enumerate(part):
                k = len(ids[i])
                a[r, :k], m[r, :k], y[r, :k] = ids[i], 1, labels[i]
            grads, prob = network.gradient(a, m, y)
            step += 1
            for k, v in network.p.items():
                m1, m2 = moments[k]
                m1 += 0.1 * (grads[k] - m1)
                m2 += 0.01 * (grads[k] ** 2 - m2)
                v -= rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-7)
            if round_ in (ROUNDS // 3, 2 * ROUNDS // 3):
                own = (np.take_along_axis(prob, y[:, :, None], 2)[:, :, 0] * m).sum(1) / m.sum(1)
                trusted[part[own < 0.25]] = False
    return network


def label_texts(network: Network, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every sentence: text number, start, end (code points in its text), and pooled probabilities."""
    flat, bounds = code_points(texts)
    starts = sentence_bounds(flat, bounds)
    if len(starts) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, UNREADABLE + 1), np.float32)
    ids, first, n = _patches(plain(flat), starts)
    windows = -(-n // WINDOW)
    sentence = np.repeat(np.arange(len(n)), windows)
    inner = np.arange(len(sentence)) - np.repeat(np.cumsum(windows) - windows, windows)
    begin = first[sentence] + inner * WINDOW
    size = np.minimum(n[sentence] - inner * WINDOW, WINDOW)
    pooled = np.zeros((len(n), UNREADABLE + 1), np.float64)
    order = np.argsort(size, kind="stable")
    at = 0
    while at < len(order):
        t = int(size[order[min(len(order) - 1, at + 2047)]])
        part = order[at : at + max(64, min(2048, 40_000 // max(t, 1)))]
        t = int(size[part[-1]])
        mask = np.arange(t)[None, :] < size[part][:, None]
        where = np.where(mask, begin[part][:, None] + np.arange(t)[None, :], 0)
        a = ids[where]
        a[~mask] = BUCKETS
        prob = network.forward(a, mask.astype(np.float32))
        np.add.at(pooled, sentence[part], (prob * mask[:, :, None]).sum(1))
        at += len(part)
    pooled /= np.maximum(n, 1)[:, None]
    text = np.searchsorted(bounds, starts[:-1], "right") - 1
    return text, starts[:-1] - bounds[text], starts[1:] - bounds[text], pooled


def _segment_batches(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network: Network = shared.value
        for b in blocks(batches, "text", BLOCK // 4):
            texts = [t or "" for t in b.column("text").to_pylist()]
            text, start, end, prob = label_texts(network, texts)
            lang = prob.argmax(1)
            # runs of sentences of one language in a text are a segment
            new = np.ones(len(text), bool)
            new[1:] = (text[1:] != text[:-1]) | (lang[1:] != lang[:-1])
            seg = np.flatnonzero(new)
            width = (end - start).astype(np.float64)
            sure = np.add.reduceat(prob[np.arange(len(lang)), lang] * width, seg) if len(seg) else np.zeros(0)
            total = np.add.reduceat(width, seg) if len(seg) else np.zeros(0)
            last = np.append(seg[1:], len(text)) - 1 if len(seg) else seg
            keep = lang[seg] != UNREADABLE
            seg, last, sure, total = seg[keep], last[keep], sure[keep], total[keep]
            at = text[seg]
            yield pa.RecordBatch.from_arrays(
                [b.column("id").take(pa.array(at)), b.column("owner").take(pa.array(at)), pa.array(start[seg]), pa.array(end[last]), pa.array([LANGUAGES[i] for i in lang[seg]], pa.string()), pa.array(sure / np.maximum(total, 1))],
                names=["id", "owner", "start", "end", "lang", "confidence"],
            )

    return run


def labelled_sample(df: DataFrame, id_col: str, text_col: str, lang_col: str) -> list[tuple[str, str]]:
    """At most PER_LANGUAGE (language, text) pairs of each language; texts of up to 4,000 characters serve to train."""
    rows = df.select(F.lower(F.trim(F.col(lang_col))).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col).cast("string"), F.lit(3)).alias("h"))
    rows = rows.where(F.col("lang").isin(*LANGUAGES) & F.length("text").between(40, 4000))
    some = rows.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy("h"))).where(F.col("r") <= PER_LANGUAGE)
    return [(r["lang"], r["text"]) for r in some.select("lang", "text").collect()]


def segments(df: DataFrame, labelled: list[tuple[str, str]], id_col: str, text_col: str, owner_col: str | None = None) -> DataFrame:
    """(id, owner, start, end, lang, confidence): the segments of every text, without those that can't be read."""
    rows = df.select(F.col(id_col).cast("string").alias("id"), (F.col(owner_col) if owner_col else F.lit(None)).cast("string").alias("owner"), F.col(text_col).alias("text"))
    rows = rows.where(F.length(F.trim("text")) > 0)
    schema = "id string, owner string, start long, end long, lang string, confidence double"
    if not labelled:
        return df.sparkSession.createDataFrame([], schema)
    return rows.mapInArrow(_segment_batches(df.sparkSession.sparkContext.broadcast(train(labelled))), schema)


LEAST = {"zh": 36, "ja": 36}
LEAST_OTHER = 62
SURE = 0.6


def mixed_languages(seg: DataFrame) -> DataFrame:
    """(id, lang, chars, confidence): texts with a long enough segment in two or more languages, a row per language; chars is the longest one's."""
    size = F.col("end") - F.col("start")
    per = seg.distinct().groupBy("id", "lang").agg(F.max(F.when(F.col("confidence") >= SURE, size).otherwise(0)).alias("chars"), (F.sum(F.col("confidence") * size) / F.sum(size)).alias("confidence"))
    least = F.coalesce(F.create_map(*[F.lit(x) for kv in LEAST.items() for x in kv])[F.col("lang")], F.lit(LEAST_OTHER))
    enough = per.where(F.col("chars") >= least)
    return enough.withColumn("n", F.count("*").over(W.partitionBy("id"))).where(F.col("n") > 1).drop("n")


def owner_languages(seg: DataFrame, most: float = 0.75, each: float = 0.25) -> DataFrame:
    """(owner, lang, confidence): the language of at least three quarters of an owner's readable text, or zh+en."""
    size = F.col("end") - F.col("start")
    per = seg.distinct().groupBy("owner", "lang").agg(F.sum(size).alias("chars"), F.sum(F.col("confidence") * size).alias("sure"))
    w = W.partitionBy("owner")
    shares = per.withColumn("total", F.sum("chars").over(w)).groupBy("owner").agg(F.max_by("lang", "chars").alias("top"), (F.max("chars") / F.max("total")).alias("share"), (F.max(F.when(F.col("lang") == "zh", F.col("chars"))) / F.max("total")).alias("zh"), (F.max(F.when(F.col("lang") == "en", F.col("chars"))) / F.max("total")).alias("en"), (F.sum("sure") / F.sum("chars")).alias("confidence"))
    lang = F.when(F.col("share") >= most, F.col("top")).when((F.col("zh") >= each) & (F.col("en") >= each), F.lit("zh+en"))
    return shares.select("owner", lang.alias("lang"), "confidence").where(F.col("lang").isNotNull())

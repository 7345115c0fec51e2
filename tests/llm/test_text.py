import base64
import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import cut_off as C
from quire.llm import leaks as L
from quire.llm import mojibake as M
from quire.llm.language import label_texts, mixed_languages, owner_languages, segments, train
from quire.llm.same_look import same_look, same_look_classes, same_look_pairs, unify
from quire.llm.token_ids import PATTERN, PairTable, token_ids

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def test_unify_equals_nfc_where_nothing_else_applies():
    g = random.Random(2)
    letters = "abcäéñöüçệ漢字かなЖ한글" + "̧̣́̈̃"
    for _ in range(200):
        t = "x" + "".join(g.choice(letters) for _ in range(12))
        assert unify([unicodedata.normalize("NFD", t)]) == unify([unicodedata.normalize("NFC", t)])
        assert unicodedata.normalize("NFC", unify([t])[0]) == unify([t])[0]


@pytest.mark.parametrize("a,b", [("ＡＢ１", "AB1"), ("é", "é"), ("ﬁn", "fin"), ("a​b﻿", "ab"), ("a b", "a b"), ("рaper", "paper"), ("⽔", "水"), ("ｶﾞ", "ガ"), ("a\r\nb", "a\nb"), (" x ", "x")])
def test_same_look(a, b):
    assert unify([a]) == unify([b])


@pytest.mark.parametrize("a,b", [("A", "a"), ("é", "e"), ("x²", "x2"), ("a.", "a"), ("①", "1"), ("a  b", "a b")])
def test_visible_differences_count(a, b):
    assert unify([a]) != unify([b])


def test_same_look_pairs(spark):
    rows = [("1", "ab"), ("2", "ａb"), ("3", "ab"), ("4", None), ("5", ""), ("6", "​"), (None, "ab"), ("1", "ab"), ("7", "Ab"), ("8", "ab" * 60_000), ("9", "ａb" * 60_000)]
    df = spark.createDataFrame([(i, t, "z") for i, t in rows], "id string, text string, same_look string")
    assert {tuple(r) for r in same_look_pairs(df, "id", "text").collect()} == {("1", "2"), ("2", "3"), ("8", "9")}
    assert same_look(df, "text").count() == len(rows)
    assert same_look_pairs(df.limit(0), "id", "text").count() == 0


def test_token_ids(spark):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    g = random.Random(3)
    texts = ["", None, "<|endoftext|> hello", "水" * 3000, "a" * 5000, "  \n\t x", "naïve café — 你好，世界！"] + ["".join(g.choice("abcde 漢字かな\n.é😀1") for _ in range(g.randrange(90))) for _ in range(150)]
    df = spark.createDataFrame([(i, t, "own") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = {r["doc_id"]: r["ids"] for r in token_ids(df).collect()}
    assert got == {i: enc.encode_ordinary(t or "") for i, t in enumerate(texts)}
    assert token_ids(df.limit(0)).count() == 0


def test_pair_table_against_a_plain_loop():
    table = PairTable(VOCABULARY)
    g = random.Random(5)
    for _ in range(60):
        piece = bytes(g.randrange(256) for _ in range(g.randrange(2, 40)))
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while True:
            best = min(((table.whole[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in table.whole), default=None)
            if best is None:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        assert table.encode([piece])[0].tolist() == [table.whole[p] for p in parts]


CLEAN = ["今天的天气很好，我们去河边散步。桥上的人很多，船也慢慢地走。", "The boat drifted down the river, and nobody reached for it.", "Où est passé le vieux métier à tisser ? a demandé Clévance, déjà vers midi."] * 150


def clean_model():
    flat, _ = M.code_points([t + "\n" for t in CLEAN])
    x, y = M.CharModel.slots(flat)
    return M.CharModel(np.bincount(x, minlength=1 << M.ONE_BITS), np.bincount(y, minlength=1 << M.TWO_BITS))


@pytest.mark.parametrize("true,wrong,k", [("utf-8", "latin-1", 0), ("utf-8", "latin-1", 2), ("gb18030", "latin-1", 0), ("utf-8", "mac_roman", 2)])
def test_round_trip_of_encodings(true, wrong, k):
    bad, now, how = M.examine(clean_model(), CLEAN[k].encode(true).decode(wrong))
    assert bad and now == CLEAN[k]


def test_clean_text_is_left(spark):
    model = clean_model()
    for t in CLEAN[:3] + ["我们去河边散步。角度约 30°±2，½ 份。"]:
        assert M.examine(model, t) == (False, t, None)
    rows = [("a", CLEAN[0]), ("b", None), ("c", ""), ("d", "天�"), ("a", CLEAN[0])] + [(str(i), t) for i, t in enumerate(CLEAN)]
    got = {r["id"]: r["affected"] for r in M.repair_encoding(spark.createDataFrame(rows, "id string, text string"), "id", "text").collect()}
    assert got["d"] and not got["a"] and not got["b"] and not got["c"] and sum(got.values()) == 1
    assert M.repair_encoding(spark.createDataFrame([], "id string, text string"), "id", "text").count() == 0


def smith_waterman(a, b):
    best, table = 0, [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            table[i][j] = max(0, table[i - 1][j - 1] + (L.MATCH if a[i - 1] == b[j - 1] else L.MISMATCH), table[i - 1][j] + L.GAP, table[i][j - 1] + L.GAP)
            best = max(best, table[i][j])
    return best


def test_align_against_the_table():
    g = np.random.default_rng(1)
    pairs = [(g.integers(0, 4, 20).astype(np.uint32), g.integers(0, 4, 30).astype(np.uint32)) for _ in range(60)]
    for (a, b), (a0, a1, b0, b1, score) in zip(pairs, L.align(pairs)):
        whole = smith_waterman(a, b)
        assert smith_waterman(a[a0:a1], b[b0:b1]) == whole == score


def test_leaks(spark):
    g = random.Random(1)
    words = ["".join(g.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(400)]
    passage = " ".join(words[:60])
    edited = " ".join(w if i % 10 else "changed" for i, w in enumerate(words[:60]))
    docs = [(1, "x " * 40 + passage.upper() + " y" * 30), (2, " ".join(words[100:200])), (3, edited), (4, " ".join(words[:9])), (5, " ".join(words[30:60] + words[:30])), (6, None), (7, ""), (8, " ".join(words[:34]) + " tail" * 5), (1, "x " * 40 + passage.upper() + " y" * 30), (9, "z" * 200_000 + passage)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame([(7, passage), (8, None), (9, ""), (7, passage)], "item_id long, passage string")
    assert {(r["doc_id"], r["item_id"]) for r in L.leaks(df, items).collect()} == {(1, 7), (3, 7), (5, 7), (8, 7), (9, 7)}
    assert L.leaks(df.limit(0), items).count() == 0 and L.leaks(df, items.limit(0)).count() == 0


def test_leaks_of_a_part_that_many_documents_hold(spark):
    g = random.Random(4)
    words = ["".join(g.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(60)]
    docs = [(i, f"number {i} " + " ".join(words[:32])) for i in range(400)] + [(i, f"{i} other") for i in range(400, 600)]
    items = spark.createDataFrame([(7, " ".join(words))], "item_id long, passage string")
    assert L.leaks(spark.createDataFrame(docs, "doc_id long, text string"), items).count() == 400


@pytest.mark.parametrize(("true", "wrong"), [("utf-8", "gb18030"), ("gb18030", "big5")])
def test_a_third_of_all_rows_garbled(spark, true, wrong):
    rows = __import__("duckdb").sql("select distinct content from '/root/testdata/sf0.1/chunks.parquet' where length(content) between 60 and 500 order by content").fetchall()
    rows = [r for r in rows if sum("\u4e00" <= c <= "\u9fff" for c in r[0]) > 0.75 * len(r[0])][:6000]
    texts, garbled = [], {}
    for i, (t,) in enumerate(rows):
        bad = t.encode(true, "ignore").decode(wrong, "ignore")
        if i % 3 == 0 and len(bad) > 30:
            garbled[str(i)] = t
        texts.append((str(i), bad if str(i) in garbled else t))
    assert 0.3 < len(garbled) / len(texts)
    got = {r["id"] for r in M.repair_encoding(spark.createDataFrame(texts, "id string, text string").repartition(8), "id", "text").where("affected").collect()}
    assert len(got & set(garbled)) > 0.9 * len(garbled) and len(got - set(garbled)) <= 0.02 * len(texts)


def test_common_pairs_come_from_all_texts_and_their_whole_length(spark):
    """What is garbled stands behind the first thousand characters, and in 1.2 % of more texts than a sample would hold."""
    bad = "The boat drifted down the river. " * 40 + CLEAN[0].encode().decode("latin-1")
    texts = [(str(i), CLEAN[i % 450] if i % 83 else bad) for i in range(4_000)]
    df = spark.createDataFrame(texts, "id string, text string")
    assert M.common_pairs(df, spark.sparkContext.broadcast(clean_model())) == {("western", "utf-8")}
    assert M.common_pairs(df.where("length(text) < 1000"), spark.sparkContext.broadcast(clean_model())) == frozenset()


def test_texts_worth_a_search_are_those_that_a_pair_explains():
    model = clean_model()
    pairs = sorted((w, t) for w, t in M.EVERY if w in ("western", "mac_roman", "gb18030", "big5") and t in ("utf-8", "gb18030"))
    texts = ["", "plain", *CLEAN[:3], "𠁁" * 9, "ÿ" * 20]
    for wrong, true in pairs:
        texts += ["x " * 30 + M.to_bytes(c, true).decode("latin-1" if wrong == "western" else wrong, "ignore") for c in CLEAN[:3]]
    worth = M.worth_a_search(model, texts)
    for t, w in zip(texts, worth):
        spans = M.repair_once(model, t, M.EVERY)[1]
        assert w or not any(sum(c > "\x7f" for a, b, *q in spans if tuple(q) == p for c in t[a:b]) >= 0.5 * sum(c > "\x7f" for c in t) for p in {tuple(x[2:]) for x in spans})
    assert worth.any() and not worth[:5].any()


def test_the_search_in_all_texts_costs_a_small_multiple_of_their_scores():
    texts = [t for (t,) in __import__("duckdb").sql("select content from '/root/testdata/sf0.1/chunks.parquet' where length(content) > 0 order by chunk_id limit 3000").fetchall()]
    flat, _ = M.code_points([t + "\n" for t in texts])
    x, y = M.CharModel.slots(flat)
    model = M.CharModel(np.bincount(x, minlength=1 << M.ONE_BITS), np.bincount(y, minlength=1 << M.TWO_BITS))
    clock = __import__("time").process_time

    def least(f):
        took = []
        for _ in range(3):
            began = clock()
            f()
            took.append(clock() - began)
        return min(took)

    assert least(lambda: M.worth_a_search(model, texts)) < 35 * least(lambda: model.log_p(flat))


def test_spans_of_all_bytes_at_once_are_those_of_the_patterns():
    rng = np.random.default_rng(4)
    for true, pattern in M.SPANS.items():
        for n in range(150):
            few = np.array([0x30, 0x41, 0x80, 0x8E, 0x90, 0x9F, 0xA0, 0xA1, 0xBF, 0xC2, 0xE0, 0xED, 0xEF, 0xF0, 0xF4, 0xFC, 0xFE, 0xFF])
            raw = rng.choice([few, np.arange(256), np.arange(0x78, 0x100)][n % 3], rng.integers(0, 200)).astype(np.uint8)
            first, last = M.byte_spans(raw, true)
            assert list(zip(first.tolist(), last.tolist())) == [m.span() for m in pattern.finditer(raw.tobytes())]
    for wrong in M.PAIRS:
        t = "aé€я漢字ｱ\U00020041\uffff\uffe6ÿˇЪ가\n~"
        raw, begins = M._encode(np.frombuffer(t.encode("utf-32-le"), np.uint32), wrong)
        assert [raw.tobytes()[a:b] for a, b in zip(begins, begins[1:])] == [M.to_bytes(c, wrong)[:2] for c in t] if begins is not None else raw.tobytes() == M.to_bytes(t, wrong)


def test_texts_repaired_together_are_repaired_as_each_by_itself():
    model = clean_model()
    texts = ["", "é", "ｱｲｳ abc", "𠁁" * 9, "я" * 30, *CLEAN[:3]]
    for wrong, true in sorted(M.EVERY):
        for c in [*CLEAN[:3], "Лодка медленно плыла вниз по реке, я и мы на мосту."]:
            texts.append((M.from_bytes(M.to_bytes(c, true), "western") if wrong == "western" else M.to_bytes(c, true).decode(wrong, "ignore")))
    for only in (None, M.EVERY, frozenset({("western", "utf-8"), ("gb18030", "big5")})):
        assert M.repair_all(model, texts, only) == [M.repair_once(model, t, only) for t in texts]
    assert M.examine_all(model, texts) == [M.examine(model, t) for t in texts]
    worth = M.worth_a_search(model, texts)
    for t, w in zip(texts, worth):
        held = {}
        for a, b, *pair in M.repair_once(model, t, M.EVERY)[1]:
            held[tuple(pair)] = held.get(tuple(pair), 0) + sum(c > "\x7f" for c in t[a:b])
        assert w or not held or max(held.values()) < 0.5 * sum(c > "\x7f" for c in t)


def test_single_letters_of_another_script_count_together(spark):
    rows = __import__("duckdb").sql("select distinct content from '/root/testdata/sf0.1/chunks.parquet' where length(content) between 150 and 400 order by content").fetchall()
    some = [t for (t,) in rows if sum(c in "éèàêíóñúüä" for c in t) > 4 and not any("\u0250" <= c < "\u2000" or c > "\u2100" or c in "ÃÂ√" for c in t)][:300]
    bad = {str(i): t.encode("cp1252", "ignore").decode("cp1251", "ignore") if i % 2 else t.encode().decode("gb18030", "ignore") for i, t in enumerate(some) if i % 20 < 2 and sum(c in "éèàêíóñúüä" for c in t) > 7}
    texts = [(str(i), bad.get(str(i), t)) for i, t in enumerate(some)] + [("alike", "Thе bоat had аlready lеft the hаrbour, nobody sаid a wоrd.")] + [(f"u{i}", "𠁁𠂢") for i in range(3)]
    got = {r["id"] for r in M.repair_encoding(spark.createDataFrame(texts, "id string, text string"), "id", "text").where("affected").collect()}
    assert len(got & set(bad)) > 0.9 * len(bad) > 5 and len(got - set(bad)) <= 3 and "alike" not in got
    a, _ = M.CharModel.slots(np.array([0x20041, 0x41], np.uint32))
    assert a[0] != a[1] and a[0] < 1 << M.ONE_BITS


def test_classes_are_what_the_pairs_connect(spark):
    rows = [("a", "ﬁre"), ("b", "fire"), ("b", "fire"), ("c", "fire"), ("d", "ｆｉｒｅ"), ("e", "Fire"), ("f", None), (None, "fire"), ("g", "x")]
    df = spark.createDataFrame(rows, "id string, look string")
    classes = {r["id"]: (r["class_id"], r["n_texts"], r["n_ids"]) for r in same_look_classes(df, "id", "look").collect()}
    assert classes == {i: ("a", 3, 4) for i in "abcd"}
    assert {(r[0], r[1]) for r in same_look_pairs(df, "id", "look").collect()} == {("a", "b"), ("a", "c"), ("a", "d"), ("b", "d"), ("c", "d")}


def covered(passage, text):
    p = L.Passages([(1, passage)])
    flat, bounds = L.code_points([text])
    found = L.bands(p, flat, bounds).get((0, 0), [])
    return L.coverage(len(passage), L.stretches([(p.texts[0], flat, x) for x in found])) if found else 0.0


def test_coverage_of_stretches_far_apart():
    g = random.Random(3)
    some = lambda n, letters: "".join(g.choice(letters) for _ in range(n))
    p = some(400, "abcdefghijklmnopqrstuvwxyz")
    for gap in (1_000, 126_000, 140_000, 400_000):
        for x, y in ((p[:120], p[200:320]), (p[200:320], p[:120])):
            assert 0.59 < covered(p, x + some(gap, "ABCDEFGHIJ") + y) < 0.62
    assert covered(p, some(90_000, "ABC") + p + p[:100]) == 1.0
    assert covered(p, p[:75] + some(5_000, "ABC")) < L.COVERED  # a quotation
    assert covered(p, (p[:30] + some(40, "ABC") + p[100:130] + some(900, "ABC") + p[300:330]) * 3) < L.COVERED


def test_leaks_keep_the_types_of_ids_and_need_no_rare_corpus_seeds(spark):
    g = random.Random(6)
    word = lambda: "".join(g.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    passages = [" ".join(word() for _ in range(40)) for _ in range(2)]
    far = " ".join(passages[1].split()[20:]) + " zzz" * 40_000 + " ".join(passages[1].split()[:16])
    docs = [("a", passages[0], 1), ("b", far, 2), ("c", "Answer in one sentence. " * 20, 3)]
    items = [("i", "Answer in one sentence. " + passages[0]), ("j", passages[1]), *((f"k{i}", "Answer in one sentence. " + " ".join(word() for _ in range(30))) for i in range(70))]
    got = L.leaks(spark.createDataFrame(docs, "doc_id string, text string, item long"), spark.createDataFrame(items, "item_id string, passage string"))
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == {("a", "i"), ("b", "j")}


def test_cut_off(spark):
    whole = "The boat had already left the harbour. Nobody said a word about the letter. The rain came back at night."
    docs = [(i, whole, "good") for i in range(40)] + [(100, whole[:-20], "bad"), (101, whole[:-9] + "…", "bad"), (102, "所以我们�", "bad"), (103, None, "bad"), (104, "", None), (105, "Things:\n* boat\n* letter", "good"), (106, "It rained.\n— Anna", "good"), (107, "  \n", "good")]
    got = {r["doc_id"]: r["is_cut"] for r in C.cut_off(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()}
    assert {i for i, x in got.items() if x} == {100, 101, 102} and len(got) == len(docs)
    shares = {r["source"]: r["share"] for r in C.cut_share(C.cut_off(spark.createDataFrame(docs, "doc_id long, text string, source string"))).collect()}
    assert shares["bad"] == 0.75 and shares["good"] == 0 and shares[None] == 0
    assert C.cut_off(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_cut_off_learns_what_ends_a_line(spark):
    """Shelf marks are no shape that the rules know: the model sees that lines end after such numbers."""
    docs = [(i, f"The boat left the harbour before noon {i}. Nobody said a word.\nshelf {1000 + 7 * i}", "s", "en") for i in range(60)]
    docs += [(100 + i, "Nobody said a word. " + t, "s", " EN ") for i, t in enumerate(("The boat left the har", "The boat le", "Nobody sai"))]
    docs += [(200, "Nobody said a word.\nshelf 1777", "s", None), (200, "Nobody said a word.\nshelf 1777", "s", None)]
    got = C.cut_off(spark.createDataFrame(docs, "doc_id long, text string, source string, lang string")).collect()
    assert len(got) == len(docs)
    assert {r["doc_id"] for r in got if r["is_cut"]} == {100, 101, 102}
    assert all(r["log_odds"] is not None and r["threshold"] is not None for r in got)


def test_cut_off_keeps_the_type_of_ids(spark):
    got = C.cut_off(spark.createDataFrame([("a", "It rained. The boat le", None)], "doc_id string, text string, source string")).collect()
    assert [(r["doc_id"], r["source"]) for r in got] == [("a", None)]


def test_cut_off_after_headings_in_lists_and_verses(spark):
    whole = "The boat had already left the harbour. Nobody said a word about the letter. The rain came back at night."
    cut = [whole[:n] for n in (34, 24, 10, 17)]  # each at another place: equal endings support each other
    docs = [(i, whole) for i in range(40)] + [(100, f"{whole}\n## 2.1 salt making\n{cut[0]}"), (101, f"{whole}\n- {cut[1]}"), (102, f"five spaces wide\n{cut[2]}"), (103, f"already left\nabout the letter\ncame back\n{cut[3]}"), (104, f"{whole}\nalready left the harbour\nabout the letter\ncame back at night"), (105, f"{whole}\n- about the letter")]
    got = C.cut_off(spark.createDataFrame([(*d, "s") for d in docs], "doc_id long, text string, source string"))
    assert {r["doc_id"] for r in got.where("is_cut").collect()} == {100, 101, 102, 103}


def labelled():
    return [tuple(r) for r in __import__("duckdb").sql("select lang, text from '/root/testdata/sf0.01/documents.parquet' where lang in ('zh','en','fr','de','es','ru','ja') and length(text) between 40 and 4000 order by doc_id").fetchall()]


def test_language(spark):
    rows = labelled()
    held = rows[::10]
    network = train([r for i, r in enumerate(rows) if i % 10])
    text, start, end, prob = label_texts(network, [t for _, t in held])
    votes = np.zeros((len(held), 8))
    np.add.at(votes, text, prob * (end - start)[:, None])
    from quire.llm.language import LANGUAGES

    right = [LANGUAGES[v[:7].argmax()] == lang for v, (lang, _) in zip(votes, held)]
    assert np.mean(right) > 0.88  # some labels are wrong on purpose
    zh = next(t for lang, t in rows if lang == "zh")[:90]
    en = "The boat drifted slowly down the river that night, and nobody in the village reached for the lantern. "
    df = spark.createDataFrame([("m", "b", zh + "\n" + en * 2), ("n", "b", zh), ("o", "c", None), ("p", "c", " "), ("n", "b", zh)], "id string, owner string, text string")
    seg = segments(df, rows, "id", "text", "owner")
    assert {(r["id"], r["lang"]) for r in mixed_languages(seg).collect()} == {("m", "zh"), ("m", "en")}
    assert {(r["owner"], r["lang"]) for r in owner_languages(seg).collect()} == {("b", "zh+en")}
    assert segments(df, [], "id", "text").count() == 0 and segments(df.limit(0), rows[:40], "id", "text").count() == 0

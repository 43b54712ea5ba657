"""Look-alikes, truncation, encodings, page content and leaks: small cases, nulls, long texts, ties and empty tables."""

import random

from pyspark.sql import functions as F

from gleanery.llm import encoding_repair as E
from gleanery.llm import eval_leaks as L
from gleanery.llm import lookalikes as A
from gleanery.llm import main_content as M
from gleanery.llm import truncation as T


# --- look-alikes


def test_skeleton_keeps_what_matters():
    same = ["Ｆｒｅｅ  tier ﬁne‑x ", "Fr​еe tier fine-x", "Free tier fine-x"]
    assert len({A.skeleton(s) for s in same}) == 1
    assert A.skeleton("café") == "café" and A.skeleton("⼩⽇") == "小日"
    for a, b in [("A", "a"), ("é", "e"), ("①", "1"), ("²", "2"), ("…", "..."), ("領", "领")]:
        assert A.skeleton(a) != A.skeleton(b)


def test_trie_budget():
    trie = A.VocabularyTrie(["paypal", "café", "сорок"])
    assert trie.find("pаypаl") == "paypal"  # Cyrillic а
    assert trie.find("pa­ypal") == "paypal"
    assert trie.find("café") == "café"
    assert trie.find("paypa1") is None and trie.find("paypa1", 1) == "paypal"
    assert trie.find("papal", 1) == "paypal" and trie.find("payppal", 1) == "paypal" and trie.find("pal", 1) is None
    assert trie.find("") is None


def test_zero_budget_is_equality_of_looks():
    rng = random.Random(2)
    letters = "abcосаé́​"
    words = ["".join(rng.choices(letters, k=rng.randint(1, 5))) for _ in range(200)]
    trie = A.VocabularyTrie(words)
    for _ in range(300):
        w = "".join(rng.choices(letters, k=rng.randint(1, 5)))
        brute = {x for x in words if x.translate(A._TABLE) == w.translate(A._TABLE)}
        assert (trie.find(w) in brute) if brute else trie.find(w) is None


def test_by_table_depends_on_the_look_alone():
    for a, b in [("сoрт", "cорт"), ("бесплaтно", "бecплатнo"), ("сор", "cop"), ("Soﬁ", "Sofi")]:
        assert A.by_table(a) == A.by_table(b)


def test_pairs_against_brute_force(spark):
    base = ["Free tier", "Бесплатно", "限免 开放", "café", None, "", "  "]
    looks = lambda s: s.translate(str.maketrans("еoс", "eоc")) if s else s
    rows, rng = [], random.Random(4)
    for i in range(60):
        s = rng.choice(base)
        rows.append((i, rng.choice([s, s and s.replace("e", "е"), s and s + " ", s and s.replace(" ", " "), looks(s)]), "x", "y"))
    df = spark.createDataFrame(rows, "log_seq int, title string, field string, raw string")
    got = {tuple(r) for r in A.lookalike_pairs(df, ["title"], "log_seq", copies=99).collect()}
    stated = [(i, t) for i, t, *_ in rows if t and t.strip()]
    want = {("title", i, j) for i, a in stated for j, b in stated if i < j and a != b and A.skeleton(a) == A.skeleton(b)}
    assert got == want and want
    few = {tuple(r) for r in A.lookalike_pairs(df, ["title"], "log_seq", copies=1).collect()}
    assert few < got
    spelling = {(A.skeleton(a), *sorted((a, b))) for i, a in stated for j, b in stated if a != b and A.skeleton(a) == A.skeleton(b)}
    text = dict(stated)
    assert {(A.skeleton(text[i]), *sorted((text[i], text[j]))) for _, i, j in few} == spelling  # no link between strings is lost


def test_self_evident_characters():
    """What stays in the JVM looks like itself, alone and among others, and no look-alike, joined or invisible character is taken for it."""
    held = {o for a, b in A.self_evident() for o in range(a, b + 1)}
    for o in held:
        assert A.skeleton(f"x{chr(o)}y") == f"x{chr(o)}y"
    for c in [*A._LOOKS, *map(chr, A._LIGATURES), "\u00ad", "\u200b", "\u3000"]:
        assert ord(c) not in held
    assert {0x41, 0xE9, 0x4E2D, 0x1F389} <= held


def test_pairs_of_rare_disguises(spark):
    texts = ["gpu credits", "ɡpu credits", "ijs", "ĳs", "plain", "ɑi", "ai", "ai"]
    df = spark.createDataFrame(list(enumerate(texts)), "log_seq int, title string")
    assert {tuple(r)[1:] for r in A.lookalike_pairs(df, ["title"], "log_seq").collect()} == {(0, 1), (2, 3), (5, 6), (5, 7)}
    got = {tuple(r)[1:] for r in A.lookalike_members(df, ["title"], "log_seq").collect()}
    assert got == {(0, 0, 0), (1, 0, 1), (2, 2, 2), (3, 2, 3), (5, 5, 5), (6, 5, 6), (7, 5, 6)}


def test_long_text(spark):
    df = spark.createDataFrame([(1, "Frее " * 50_000), (2, "Free " * 50_000)], "log_seq int, title string")
    assert A.lookalike_pairs(df, ["title"], "log_seq").count() == 1
    assert A.lookalike_pairs(df.limit(0), ["title"], "log_seq").count() == 0


# --- truncation


def test_endings():
    cases = {
        "A whole sentence.": "whole",
        "他说“好”。": "whole",
        "More at https://a.example/p/1": "whole",
        "More at https://www.": "cut",
        "Cut in a byte�": "cut",
        "Cut in an entity &#82": "cut",
        "Cut in a tag <a hre": "cut",
        "Cut and marked [...]": "cut",
        "Version Abc-2.": "cut",
        "An open end": "open",
        "<p>Whole.</p>": "whole",
    }
    assert {k: T.ending(k)[0] for k in cases} == cases


def test_openings_tell_closings_from_cuts(spark):
    texts = [f"Thing {i} is here. Thanks for reading" for i in range(30)] + [f"Starting this week, number {i} is free." for i in range(80)] + ["Thing. Starting this we", "Never seen before"]
    rows = [("s", i, t, 1, 0.0) for i, t in enumerate(texts)]
    looked = T.look(spark.createDataFrame(rows, "source string, h long, text string, copies long, p double")).cache()
    own = looked.where("kind = 'text'").select("source", "h", F.lit(1.0).alias("own"))
    lo = {r.h: r.lo for r in T.completeness(looked, own).collect()}
    assert lo[0] > 3 and lo[110] < -2 and lo[111] <= -2 and 40 not in lo


def at_a_limit():
    """Cut at 70 characters, always in a sentence that no text ever ends; and texts of other lengths."""
    names = ["".join(c) for c in __import__("itertools").product("bdfgklmnprst", "aeiou")][:60]
    cut = [f"Item {n} is listed here. Noted by our desk on a day that nobody of us recalls now"[:70] for n in names[:40]]
    whole = [f"Item {n} is listed here{', as told' * (i % 13)}." for i, n in enumerate(names)]
    return [(i, "s", t) for i, t in enumerate(cut)] + [(100 + i, "s", t) for i, t in enumerate(whole)]


def test_the_fit_decides(spark, monkeypatch):
    """Without the censoring fit the texts cut at the limit pass for complete ones, as no text ends their last sentence."""
    df = spark.createDataFrame(at_a_limit(), "log_seq int, source string, summary string")
    hits = spark.createDataFrame([], "hit_id int, source string, story_text string")
    assert {r.rec_id for r in T.truncated_records(df, hits).collect()} == set(range(40))
    monkeypatch.setattr(T, "censoring", lambda m: spark.createDataFrame([], "source string, unit string, length int, posterior double"))
    assert T.truncated_records(df, hits).count() == 0


def test_censored_fit():
    import numpy as np

    rng = np.random.default_rng(3)
    x = np.exp(rng.normal(5, 0.5, 4000)).astype(int) + 1
    x = np.minimum(x, 200)
    lengths, counts = np.unique(x, return_counts=True)
    found = dict(T.fit_censored(lengths, counts))
    assert list(found) == [200] and found[200] > 0.9
    assert T.fit_censored(np.array([10, 50]), np.array([1, 1])) == []


def test_truncated_records(spark):
    whole = ["This offer runs until the end of May, as long as stocks last.", "Each account gets ten builds. Thanks for reading"]
    cut = ["This offer runs until the end of May, as lo", "Each account gets ten bui…"]
    deals = [(i, "s", whole[i % 2], 1) for i in range(40)] + [(100 + i, "s", cut[i % 2], 1) for i in range(4)] + [(200, "s", None, 1), (201, None, " ", 1)]
    df = spark.createDataFrame(deals, "log_seq int, source string, summary string, state int")
    hits = spark.createDataFrame([], "hit_id int, source string, story_text string")
    assert {r.rec_id for r in T.truncated_records(df, hits).collect()} == {100, 101, 102, 103}
    share = T.truncation_by_source(df, hits).first()
    assert (share.texts, share.truncated) == (44, 4)
    assert T.truncated_records(df.limit(0), hits).count() == 0


def test_copies_of_a_cut_text_are_no_evidence(spark):
    deals = [(i, "s", f"This offer runs until day {'abcdefghij'[i]} of May, as long as stocks last.") for i in range(10)]
    deals += [(100 + i, "s", "Free builds. This offer runs until the e") for i in range(200)]
    df = spark.createDataFrame(deals, "log_seq int, source string, summary string")
    hits = spark.createDataFrame([], "hit_id int, source string, story_text string")
    assert {r.rec_id for r in T.truncated_records(df, hits).collect()} == set(range(100, 300))


# --- encodings

CLEAN = "Für jedes Konto gibt es 45 € — natürlich nur für neue Kunden."
DICTS = {"de": (CLEAN * 3).encode(), "en": b"every account gets free builds, counted from the day of sign-up.", "zh": "每个账号可领小时算力，数量有限。截至有网友反馈".encode(), "ru": "Каждый аккаунт получает бесплатно для новых клиентов".encode()}
COMMON = dict.fromkeys("üöäß€—" + "每个账号可领小时算力，数量有限。" + "абвгдежзийклмнопрстуфхцчшщъыьэюяКб", 300)


def test_restore_round_trips():
    r = E.Repairer(DICTS, COMMON, 1_000)
    for text, wrong, right in [
        (CLEAN, "cp1252", "utf-8"),
        (CLEAN, "latin-1", "utf-8"),
        ("Каждый аккаунт получает бесплатно", "cp866", "cp1251"),
        ("Каждый аккаунт получает бесплатно", "cp1251", "koi8-r"),
        ("每个账号可领小时算力，数量有限", "latin-1", "gbk"),
    ]:
        garbled = text.encode(right).decode(wrong)
        fixed, chain = r.text(f"plain line\n{garbled}")
        assert fixed == f"plain line\n{text}", (wrong, right, fixed)
        assert chain
    twice = CLEAN.encode().decode("latin-1").encode().decode("latin-1")
    assert r.text(twice)[0] == CLEAN


def test_right_texts_stay():
    r = E.Repairer(DICTS, COMMON, 1_000)
    for text in ["", "plain", CLEAN, "PROMOÇÃO até o fim, ÂGE MINIMUM", "無料トライアルは本日までです。", "Безкоштовний тариф діє до кінця", "繁體介面也可領取", "Καλημέρα", "trời ơi, được"]:
        assert r.text(text) == (text, [])
    assert r.text("lost � sign")[1] == ["?"]


def test_description_length_decides():
    """The dictionaries and the frequencies of characters decide: without either, or with the cost of a step raised, other lines change."""
    r = E.Repairer(DICTS, COMMON, 1_000)
    short = "每个账号".encode("gbk").decode("big5hkscs", "replace")
    assert "�" not in short and r.text(f"n/a | 25 {short} | ok")[0] == "n/a | 25 每个账号 | ok"
    bare = E.Repairer({}, {}, 1_000)
    assert bare.text(f"n/a | 25 {short} | ok") == (f"n/a | 25 {short} | ok", [])
    one = "a帽o"  # año, of which two bytes were read as one ideograph
    spanish = E.Repairer({**DICTS, "es": "este año los tokens del año".encode()}, {**COMMON, "ñ": 200, "帽": 1}, 1_000)
    assert spanish.text(f"gratis este {one} y otro {one}")[0] == "gratis este año y otro año"


def test_chain_of_least_length():
    """Two steps that pay together are taken, whatever the first alone would give."""
    r = E.Repairer(DICTS, COMMON, 1_000)
    for first, second in (("cp1252", "latin-1"), ("latin-1", "cp1252"), ("latin-1", "latin-1")):
        twice = CLEAN.replace("€", "Euro").encode().decode(first).encode().decode(second)
        fixed, chain = r.text(twice)
        assert fixed == CLEAN.replace("€", "Euro") and len(chain) == 2


def test_held_out_restoration(spark):
    """Texts that the dictionaries have not seen, garbled by each kind of mistake: how many are found and restored to the letter."""
    kinds = [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "gbk"), ("gbk", "latin-1"), ("gbk", "big5hkscs"), ("koi8-r", "cp1251"), ("cp1251", "cp866")]
    de, zh, ru = "Für jedes Konto gibt es {} Stunden, natürlich nur für neue Kunden.", "每个账号可领{}小时算力，数量有限。", "Каждый аккаунт получает {} часов бесплатно."
    good = [(i, t.format(i), lang) for i in range(150) for t, lang in ((de, "de"), (zh, "zh"), (ru, "ru"))]
    bad, want = [], {}
    for k, (right, wrong) in enumerate(kinds):
        for i in range(6):
            text = (ru if right in ("koi8-r", "cp1251") else zh if "gbk" == right else (zh, de)[i % 2] if right == "utf-8" and wrong == "latin-1" else de).format(900 + i)
            try:
                garbled = text.encode(right).decode(wrong)
            except UnicodeDecodeError:
                continue
            if garbled.encode(wrong).decode(right) == text:
                want[len(want) + 10_000] = text
                bad.append((len(want) + 9_999, garbled, None))
    rows = [(7_000 + n, *r[1:]) for n, r in enumerate(good)] + bad
    got = {r.doc_id: r.restored for r in E.repaired(spark.createDataFrame(rows, "doc_id int, text string, lang string")).collect()}
    assert got.keys() <= want.keys() and len(want) > 25
    assert sum(got.get(k) == v for k, v in want.items()) >= 0.95 * len(want)


def test_latin_read_as_latin(spark):
    fr = "L’été à côté, où la période d’essai coûte {} € — déjà prolongée."
    rows = [(i, fr.format(i), "fr") for i in range(60)] + [(100 + i, CLEAN + f" Nr. {i}", "de") for i in range(60)]
    bad = {
        200: fr.format(7).encode("cp1252").decode("mac_roman"),
        201: (CLEAN + " Nr. 7").encode("cp1252").decode("cp437"),
        202: "L’été à côté, " + "où la période d’essai coûte 7 € — déjà prolongée.".encode("cp1252").decode("mac_roman"),
        203: (CLEAN + " Nr. 8").encode("cp850", "replace").decode("latin-1").replace("?", "€"),
    }
    df = spark.createDataFrame(rows + [(k, v, "fr") for k, v in bad.items()], "doc_id int, text string, lang string")
    got = {r.doc_id: r.restored for r in E.repaired(df).collect()}
    assert got.keys() == bad.keys()
    assert got[200] == fr.format(7) and got[201] == CLEAN + " Nr. 7" and got[202] == fr.format(7)


def test_copies_of_a_garbled_text_are_found(spark):
    zh = "每个账号可领{}小时算力，数量有限。截至有网友反馈"
    good = [(i, zh.format(i), "zh") for i in range(400)]
    garbled = [zh[i : i + 2].encode().decode("gbk", "replace") for i in range(len(zh) - 1)]
    text = " ".join(g for g in garbled if all("㐀" <= c <= "鿿" for c in g))  # ideographs only
    assert len(text) > 12
    df = spark.createDataFrame(good + [(1000 + i, text, "zh") for i in range(200)], "doc_id int, text string, lang string")
    assert {r.doc_id for r in E.repaired(df).collect()} == set(range(1000, 1200))


def test_signs_side_by_side_stay():
    r = E.Repairer(DICTS, {**COMMON, "’": 300, "É": 300}, 1_000, {"’É": 1})
    for text in ["ÂGE MINIMUM : 18 ANS. À L’ÉTRANGER, SE RENSEIGNER.", "offert à l’été, même à l’étranger"]:
        assert r.text(text) == (text, [])


def test_repaired_tables(spark):
    good = [(i, CLEAN, "de", "x") for i in range(40)]
    rows = good + [(100, CLEAN.encode().decode("cp1252"), "de-DE", "x"), (101, None, None, "x"), (102, "", "de", "x"), (103, "a" * 100_000, "en", "x")]
    df = spark.createDataFrame(rows, "doc_id int, text string, lang string, chain string")
    got = E.repaired(df).collect()
    assert [(r.doc_id, r.restored) for r in got] == [(100, CLEAN)]
    assert E.repaired(df.limit(0)).count() == 0


# --- page content


def test_best_run_against_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        s = [rng.randint(-3, 3) for _ in range(rng.randint(0, 9))]
        a, b = M.best_run(s)
        best = max([sum(s[i:j]) for i in range(len(s)) for j in range(i, len(s) + 1)], default=0)
        assert sum(s[a:b]) == max(best, 0)


def test_regions_against_brute_force():
    rng = random.Random(2)
    for _ in range(300):
        s = [rng.randint(-3, 3) for _ in range(rng.randint(0, 8))]
        best = 0
        for mask in range(1 << len(s)):
            on = [mask >> i & 1 for i in range(len(s))]
            regions = sum(x and not y for x, y in zip(on, [0, *on]))
            best = max(best, sum(x for x, o in zip(s, on) if o) - 2 * max(0, regions - 1))
        got = M.best_regions(s, 2)
        assert sum(sum(s[a:b]) for a, b in got) - 2 * max(0, len(got) - 1) == best


def test_region_decides_not_the_segment():
    """A segment that scores as content stays out among furniture, and one that scores as furniture stays in within the body."""
    weights = {"body": 5.0, "menu": -5.0, "weak": 1.0, "odd": -1.0}
    page = [(t, None, "a.example") for t in "menu weak menu body odd body menu menu body body menu".split()]
    #                                        0    1    2    3    4   5    6    7    8    9    10
    assert [i for i, f in enumerate(M.furniture_of(page, weights, 2.0)) if not f] == [3, 4, 5, 8, 9]
    assert [i for i, f in enumerate(M.furniture_of(page, weights, 0.0)) if not f] == [1, 3, 5, 8, 9]  # the sign of each


def test_pages(spark):
    rows = []
    for p in range(60):
        body = [f"The plan number {w} drops to {p} credits a month, as long as stocks last." for w in ("one", "two", "three")]
        for pos, (text, href) in enumerate([("Home", "/0"), ("Pricing", "/1"), (f"Grab {p} credits now", None), *((b, "") for b in body), ("Log in to leave a comment", "#more"), ("Sitemap", "/about"), (None, None)]):
            rows.append((p, pos, text, href, "a.example", "x"))
    rows.append((60, 0, "Sitemap", None, "b.example", "x"))
    seg = spark.createDataFrame(rows, "page_id int, pos int, text string, href string, host string, rec string")
    deals = spark.createDataFrame(
        [(i, f"The plan number one drops to {i} credits a month, as long as stocks last.", "x") for i in range(50)] + [(90, "The plan drops to 3 credits a month. Log in to leave a comment", "x"), (91, None, "x"), (92, "", "x")],
        "log_seq int, summary string, rec string",
    )
    got = {tuple(r) for r in M.boilerplate(seg, deals).collect()}
    want = {("segment", p, pos) for p in range(60) for pos in (0, 1, 6, 7, 8)} | {("segment", 60, 0), ("deal", 90, -1)}
    assert got == want
    assert M.boilerplate(seg.limit(0), deals.limit(0)).count() == 0


# --- leaks

PASSAGE = "Reselling Sefarsabo keys on open markets leads Veponabo to freeze the balance. Whoever installs Sefarsabo on a shared workstation forfeits the whole rebate. Question: who pays?"


def test_leaks(spark):
    filler = "The archive can be downloaded without a login, as long as stocks last. "
    altered = PASSAGE.replace("open markets", "free markets").replace("whole ", "")
    rows = [
        (1, filler * 3 + PASSAGE + filler),
        (2, filler + altered.upper().replace(" ", "\n")),
        (3, filler * 20),
        (4, "Sefarsabo by Veponabo is a fine thing that we like to write about in other words than those."),
        (5, " ".join(PASSAGE.split()[:18])),
        (6, " ".join(PASSAGE.split()[:9])),
        (7, None),
        (8, ""),
        (9, filler * 5_000 + PASSAGE),
    ]
    items = [(1, PASSAGE), *((i, filler * 2 + f"What is item {i}?") for i in range(2, 6)), (9, None)]
    d = spark.createDataFrame([(*r, "x") for r in rows], "doc_id int, text string, item_id string")
    e = spark.createDataFrame(items, "item_id int, text string")
    assert {tuple(r) for r in L.leaks(d, e).collect()} == {(1, 1), (2, 1), (5, 1), (9, 1)}
    assert L.leaks(d.limit(0), e).count() == 0 and L.leaks(d, e.limit(0)).count() == 0


def test_chinese_leak(spark):
    p = "在公开市场转卖Sefarsabo密钥将被Veponabo冻结余额。在公用电脑上安装Sefarsabo的人不再享有返现。问：谁付费？"
    d = spark.createDataFrame([(1, "前文很多。" * 9 + p[:45] + "后文。" * 9), (2, p[:12])], "doc_id int, text string")
    e = spark.createDataFrame([(7, p)], "item_id int, text string")
    assert {tuple(r) for r in L.leaks(d, e).collect()} == {(1, 7)}


def test_alignment_counts_words_in_order():
    a, b = "x a b c d e y".split(), "a b q c d e".split()
    assert [a[i] for i, _ in L.aligned(a, b, -9, 9)] == list("abcde")
    assert L.aligned([], b, -3, 3) == []


def test_band_against_full_matrix():
    """The band on the diagonal of the region gives what the full matrix gives, wherever in the document the passage stands."""
    rng = random.Random(5)
    for _ in range(200):
        passage = [rng.choice("abcdefghijklmnop") for _ in range(40)]
        part = [w for w in passage[5:35] if rng.random() > 0.06]
        before = [rng.choice("uvw") for _ in range(rng.randint(0, 60))]
        doc = before + part + [rng.choice("uvw") for _ in range(30)]
        at = len(before) - 5
        full = L.aligned(doc, passage, -len(passage), len(doc))
        assert len(L.aligned(doc, passage, at - 6, at + 6)) == len(full) > 15


def test_lemma_bound():
    """No edit within the budget takes more q-grams than the lemma says; without a bound the bands would be no filter."""
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(L.MIN_WORDS)]
    least = L.least_grams(list(map(len, words)), L.MIN_WORDS)
    assert least > 5
    own = set(L.grams(L.letters(words)[0]).tolist())
    for _ in range(100):
        edited = list(words)
        for k in rng.sample(range(len(words)), L.EDITS):
            edited[k] = rng.choice(["", "zzzz"])
        assert len(own.intersection(L.grams(L.letters([w for w in edited if w])[0]).tolist())) >= least


def test_verbatim_runs_are_found(spark, sf):
    """Runs of 20 words of every item, or 45 characters of Chinese, that hold a word of its own, in documents of the table."""
    rng = random.Random(8)
    items = spark.read.parquet(f"{sf}/eval_items.parquet").select("item_id", "text").collect()
    known = L.Items([(r.item_id, r.text) for r in items])
    hosts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").where("text is not null").limit(60).collect()]
    texts, want = [], set()
    for n, us in enumerate(known.units):
        han = known.least[n] == L.least_grams([1] * L.MIN_HAN, L.MIN_HAN)
        size = 45 if han else 20
        at = rng.randrange(max(1, len(us) - size))
        run = us[at : at + size]
        if len(run) < size or known.own[n].isdisjoint(run):
            continue
        host = rng.choice(hosts)
        cut = rng.randrange(len(host) + 1)
        want.add((len(texts), n))
        texts.append(f"{host[:cut]} . {' '.join(run)} . {host[cut:]}")
    got = set(L.leaked(texts, known))
    assert len(want) > 200 and len(want - got) <= 0.005 * len(want)


def test_stock_phrases(spark):
    """A long phrase that many items share is no leak, unless every passage is asked for."""
    stock = "applications close at noon in every branch of the shop and households that rent are asked to hand in a form at the counter"
    items = [(i, f"The {n} offer ends soon and {n} is free. {stock}") for i, n in enumerate(["sefarsabo", "veponabo", "dakometa", "huhareta"])]
    e = spark.createDataFrame(items, "item_id int, text string")
    d = spark.createDataFrame([(1, f"Before it. {stock} after it"), (2, f"The sefarsabo offer ends soon and sefarsabo is free. {stock}")], "doc_id int, text string")
    assert {tuple(r) for r in L.leaks(d, e).collect()} == {(2, 0)}
    assert {tuple(r) for r in L.leaks(d, e, own=False).collect()} == {(k, i) for k in (1, 2) for i in range(4)}


def test_stretches_at_the_threshold(spark):
    """Runs joined across more edits than allowed, edits by the ends of a passage, and long words added: each stretch counts by itself."""
    ws = PASSAGE.replace(".", "").split()
    far = [f"x{'abcdefghijklmnopq'[k]}" for k in range(17)]
    end = [w if k not in (13, 15, 16) else "zz" for k, w in enumerate(ws[:18])]
    added = ws[:5] + ["extraordinarilylongword" * 3] + ws[5:10] + ["anotherratherlongword" * 3] + ws[10:16]
    item = " ".join(ws[:16] + ["shared", "words"] * 9 + ws[16:] + ["Sefarsabo", "again"])
    e = spark.createDataFrame([(1, PASSAGE), (2, item)], "item_id int, text string")
    rows = [(1, " ".join(end)), (2, " ".join(added)), (3, " ".join([*ws[:16], *far, *ws[16:], "Sefarsabo", "again"]))]
    got = {tuple(r) for r in L.leaks(spark.createDataFrame(rows, "doc_id int, text string"), e).collect()}
    assert {(1, 1), (2, 1), (3, 2)} <= got
    # alike on either side of other words, nothing long enough
    assert not L.leaks(spark.createDataFrame([(4, " ".join([*ws[:9], *far, *ws[9:17]]))], "doc_id int, text string"), e).count()


def test_items_without_words_of_their_own(spark):
    """Copies of an item, and items of common words only, are found; what they share with further items is not."""
    words = "every reader of these lines learns where old clocks were mended before river boats carried them along towards bigger towns whose people paid less than others".split()
    rng = random.Random(9)
    orders = [rng.sample(words, len(words)) for _ in range(5)]
    items = [(i, " ".join(o)) for i, o in enumerate(orders)] + [(10 + i, PASSAGE) for i in range(4)]
    d = spark.createDataFrame([(1, f"before {' '.join(orders[0])} after"), (2, f"before {PASSAGE} after"), (3, " ".join(rng.sample(words, len(words))))], "doc_id int, text string")
    e = spark.createDataFrame(items, "item_id int, text string")
    assert {tuple(r) for r in L.leaks(d, e).collect()} == {(1, 0), *((2, 10 + i) for i in range(4))}


def test_dictionaries_from_all_texts(spark):
    """Phrases are counted over all texts, long ones included and copies once; equally rare ones fill what room is left."""
    filler = "普通的一句话，"
    rows = [(i, f"第{i}号公告，每个账号可领小时算力。{filler * 900}", "zh") for i in range(30)]
    rows += [(100 + i, "只有这一份。" + "别的话。", "zh") for i in range(500)] + [(700 + i, f"Offer {i} ends soon, once for all", "en") for i in range(900)]
    short = "每个账号".encode("gbk").decode("big5hkscs", "replace")
    rows += [(5_000, f"n/a | 25 {short} | ok", None)]
    df = spark.createDataFrame(rows, "doc_id int, text string, lang string")
    texts = E.distinct_texts(df)
    got = {k: v.decode() for k, v in E.learn_dictionaries(texts, E.count_signs(texts)).items()}
    assert got["zh"].index("每个账号可领小时算力。") < got["zh"].index(filler) and "只有这一份。" not in got["zh"]  # one text, however many copies
    assert set(got["en"].split()) == set("Offer ends soon, once for all".split())
    assert {r.doc_id: r.restored for r in E.repaired(df).collect()} == {5_000: "n/a | 25 每个账号 | ok"}

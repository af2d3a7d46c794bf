import random
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
import regex

from scriptoria.llm import leaks, print_forms, text_quality, token_ids

SAME = [
    ("La niña", unicodedata.normalize("NFD", "La niña")), ("fin del día", "ﬁn  del día"), ("Año 1987!", "Ａño １９８７！"), ("cero", "c​erо"), ("Ⅷ tomo", "VIII tomo"),
    ("no­ta", "nota"), ("ẹ́x", "ẹ́x"), ("a b\tc", "a　b c"), (" borde ", "borde"), ("한국어", unicodedata.normalize("NFD", "한국어")), ("РОСА", "POCA"), ("a\r\nz", "a z"),
]
DIFFERENT = [("nina", "niña"), ("Nota", "nota"), ("uno, dos", "uno dos"), ("a b", "ab"), ("1987", "1988"), ("él", "el"), ("papá", "papà"), ("«a»", '"a"'), ("字", "宇"), ("1º", "1o"), ("x²", "x2"), ("½", "1/2"), ("①", "1"), ("№", "No")]


def form(x):
    return print_forms.forms(pa.array([x])).to_pylist()[0]


@pytest.mark.parametrize("a, b", SAME)
def test_same_print(a, b):
    assert form(a) == form(b)


@pytest.mark.parametrize("a, b", DIFFERENT)
def test_other_print(a, b):
    assert form(a) != form(b)


def test_form_is_stable_and_composed():
    own = ["", None, "niño", "a" * 100_000, "x\u0301" * 1000, "\u0301", "\u200b", "👩‍🏫", "漢字 テスト", "ﷺ"]
    once = print_forms.forms(pa.array(own))
    assert print_forms.forms(once).to_pylist() == once.to_pylist()
    assert once.to_pylist()[:3] == ["", None, "niño"] and once.to_pylist()[6] == ""
    r = random.Random(1)
    for _ in range(300):
        t = "".join(chr(r.choice([r.randrange(32, 127), r.randrange(160, 0x250), r.randrange(0x300, 0x340)])) for _ in range(12))
        same = unicodedata.normalize(r.choice(["NFC", "NFD"]), t)
        assert form(t) == form(same)


def test_print_pairs(spark, rows):
    texts = {k: p[0] for k, p in enumerate(SAME)} | {100 + k: p[1] for k, p in enumerate(SAME)} | {200 + k: p[0] for k, p in enumerate(SAME)} | {300: None, 301: "", 302: "\u200b", 303: "\u00a0"}
    data = [(k, t, "clash", 1) for k, t in texts.items()]
    df = spark.createDataFrame(data + data[:20], "row_id long, t string, form string, id int")
    want = sorted((min(a, b), max(a, b)) for k in range(len(SAME)) for a, b in ((k, 100 + k), (200 + k, 100 + k)))
    assert rows(print_forms.same_print(df, "row_id", "t")) == want
    assert print_forms.same_print(df.limit(0), "row_id", "t").count() == 0


def texts(seed):
    r = random.Random(seed)
    alphabet = ["la", "niña", "canción", "1987", "...", "\n\n", "  ", "\t", "漢字", "don't", "x" * 30, " ", "👩‍🏫", "<|endoftext|>", "é́", "\r\n", "—"]
    out = ["".join(r.choice(alphabet) + r.choice([" ", " ", "", "  "]) for _ in range(r.randrange(0, 400))) for _ in range(60)]
    return out + ["", None, "漢" * 5000, " " * 3000, "a" * 20_000, out[0] + " " + out[1], "x"]


@pytest.mark.parametrize("safe, loose", [(12, 4096), (1, 7), (10**9, 50)])
def test_token_ids(spark, monkeypatch, safe, loose):
    monkeypatch.setattr(token_ids, "SAFE", safe)
    monkeypatch.setattr(token_ids, "ANY", loose)
    monkeypatch.setattr(token_ids, "LONG", 20 if loose < 100 else 1 << 16)
    e, own = token_ids.encoder(), texts(2)
    own += [(t or "") + " y algo más" for t in own[:40]] + [own[3] + own[7], "algo " + own[5]]
    df = spark.createDataFrame([(k, t, "clash", 1) for k, t in enumerate(own)], "doc_id long, text string, key string, pos int")
    got = {r["doc_id"]: r["ids"] for r in token_ids.encoded(df, "doc_id", "text").collect()}
    assert got == {k: e.encode_ordinary(t or "") for k, t in enumerate(own)}


def test_token_ids_empty_table_and_hot_chunk(spark):
    assert token_ids.encoded(spark.createDataFrame([], "k long, t string"), "k", "t").count() == 0
    e, t = token_ids.encoder(), "Derechos reservados por el autor de la obra. " * 20
    df = spark.createDataFrame([(k, t) for k in range(50)], "k long, t string")
    assert {tuple(r["ids"]) for r in token_ids.encoded(df, "k", "t").collect()} == {tuple(e.encode_ordinary(t))}


def spelt(words, r):
    return "".join(r.choice([w, w.upper(), w.title(), unicodedata.normalize("NFD", w)]) + r.choice([" ", ", ", "\n", " — ", "... "]) for w in words)


def test_leaks(spark, rows, monkeypatch):
    r = random.Random(3)
    vocabulary = [f"pal{k}ábra" for k in range(200)]
    items = {k: [r.choice(vocabulary) for _ in range(r.randrange(10, 40))] for k in range(30)}
    docs = {}
    for k in range(120):
        w = [r.choice(vocabulary) for _ in range(60)]
        if k % 2:
            source = items[r.randrange(30)]
            n = r.choice([11, 12, 13, 40])
            w[20:20] = source[:n]
        docs[k] = w
    idx = {}
    for i, w in items.items():
        for p in range(len(w) - 11):
            idx.setdefault(tuple(w[p : p + 12]), set()).add(i)
    want = sorted({(d, i) for d, w in docs.items() for p in range(len(w) - 11) for i in idx.get(tuple(w[p : p + 12]), ())})
    df = spark.createDataFrame([(d, spelt(w, r), 1, "clash") for d, w in docs.items()] + [(500, None, 1, "x"), (501, "", 1, "x"), (502, "¡!", 1, "x")], "doc_id long, text string, item_id int, row string")
    ev = spark.createDataFrame([(i, spelt(w, r)) for i, w in items.items()] + [(90, None), (91, "")], "item_id long, text string")
    assert rows(leaks.leaked(df, "doc_id", "text", ev, "item_id", "text")) == want and len(want) > 20
    assert leaks.leaked(df.limit(0), "doc_id", "text", ev, "item_id", "text").count() == 0
    assert leaks.leaked(df, "doc_id", "text", ev.limit(0), "item_id", "text").count() == 0
    # in parts, whatever the bound
    monkeypatch.setattr(leaks, "MOST_CHARS", 700)
    assert rows(leaks.leaked(df, "doc_id", "text", ev, "item_id", "text")) == want
    # every span holds leaking windows and no more; without the spans nothing leaks that did before
    spans = leaks.leaked(df, "doc_id", "text", ev, "item_id", "text", spans=True)
    got, text = spans.collect(), {r["doc_id"]: r["text"] for r in df.collect()}
    split = lambda t: [w for w in regex.split(r"[^\p{L}\p{N}]+", regex.sub(r"\p{M}", "", unicodedata.normalize("NFKD", t.lower()))) if w]
    plain = {i: [unicodedata.normalize("NFKD", x).replace("\u0301", "") for x in w] for i, w in items.items()}
    assert {(r["doc_id"], r["item_id"]) for r in got} == set(want)
    for r in got:
        own, item = split(text[r["doc_id"]][r["start"] : r["end"]]), plain[r["item_id"]]
        windows = {tuple(item[p : p + 12]) for p in range(len(item) - 11)}
        assert len(own) >= 12 and tuple(own[:12]) in windows and tuple(own[-12:]) in windows
    left = leaks.cleaned(df, "doc_id", "text", spans)
    kept = {r["doc_id"]: (r["text"], r["removed"]) for r in left.collect()}
    assert leaks.leaked(left, "doc_id", "text", ev, "item_id", "text").count() == 0
    leaking = {d for d, _ in want}
    assert all(kept[d] == (t, 0) for d, t in text.items() if d not in leaking) and all(kept[d][1] > 0 for d in leaking if d in kept)
    assert len(leaks.cleaned(df, "doc_id", "text", spans, 0.01).filter("removed > 0").collect()) == 0


def test_leaks_are_verified(monkeypatch, spark):
    """Hashes that all collide give no false hit."""
    monkeypatch.setattr(leaks, "rolled", lambda code, window: np.zeros(max(0, len(code) - window + 1), np.uint64))
    own = " ".join(f"w{k % 5}" for k in range(40))
    df = spark.createDataFrame([(1, own), (2, " ".join(f"w{(k * k) % 5}" for k in range(40)))], "doc_id long, text string")
    ev = spark.createDataFrame([(7, own)], "item_id long, text string")
    assert [tuple(x) for x in leaks.leaked(df, "doc_id", "text", ev, "item_id", "text").collect()] == [(1, 7)]


def stats(t, common):
    b = r"\p{Z}\t\n\r"
    w = [x for x in regex.split(f"[{b}]+", t or "") if x]
    if not w:
        return (0, None, None, None, None)
    chars = sum(map(len, w))
    lines = [x for x in (regex.sub(f"[{b}]+$", "", x) for x in t.split("\n")) if x]
    ends = sum(regex.sub(r"""[»”"')\]]+$""", "", x)[-1:] in (".", "!", "?", "…") for x in lines)
    known = sum(regex.sub(r"^\P{L}+|\P{L}+$", "", x).lower() in common for x in w)
    return (len(w), chars / len(w), len(regex.findall(f"[^{b}\\p{{L}}\\p{{M}}\\p{{N}}]", t)) / chars, ends / len(lines), known / len(w))


def test_statistics(spark):
    own = texts(4) + ["Uno.»\n(dos?)  \r\n\ntres", "—De la casa, Y 'el' DE", " \n\t", " "]
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate(own)], "doc_id long, text string, word_count int")
    got = {r["doc_id"]: tuple(r)[1:] for r in text_quality.statistics(df, "doc_id", "text", ["la", "de", "el", "y"]).collect()}
    for k, t in enumerate(own):
        assert got[k] == pytest.approx(stats(t, {"la", "de", "el", "y"}), nan_ok=True), t
    assert text_quality.statistics(df.limit(0), "doc_id", "text", []).count() == 0


def test_votes_and_types(spark):
    df = spark.createDataFrame([(1, 0, None, None, None, None), (2, 40, 3.5, 0.1, 0.5, 0.2), (3, 2001, 8.1, 0.2, 0.4, 0.1)], "doc_id long, word_count long, mean_word_length double, symbol_ratio double, line_punctuation double, common_words double")
    got = {r["doc_id"]: r["votes"] for r in text_quality.votes(df).collect()}
    assert got == {1: ["word_count"], 2: [], 3: list(text_quality.STATS)}
    r = random.Random(5)
    prose = [r.random() < 0.7 for _ in range(2000)]
    votes = [(k, [s for s in text_quality.STATS if r.random() < (0.1 if p else 0.8)]) for k, p in enumerate(prose)]
    typed = text_quality.text_types(spark.createDataFrame(votes, "doc_id long, votes array<string>")).collect()
    assert sum((x["prose"] >= 0.5) == prose[x["doc_id"]] for x in typed) / 2000 > 0.94
    assert text_quality.text_types(spark.createDataFrame([], "doc_id long, votes array<string>")).count() == 0


def test_types_find_planted_prose(spark):
    """Planted truth: running prose and lists, told apart without a label."""
    r = random.Random(9)
    common, other = ["de", "la", "que", "y", "el", "en"], ["noche", "ventana", "escritura", "silencio", "lector", "memoria", "ciudad"]
    sentence = lambda: " ".join(r.choice(common if r.random() < 0.45 else other) for _ in range(r.randrange(6, 15))).capitalize() + r.choice([".", ".", "?", ","])
    entry = lambda: f"{r.choice(other).title()} {'.' * r.randrange(3, 12)} {r.randrange(1, 400)}"
    prose = [r.random() < 0.75 for _ in range(1500)]
    docs = [(k, "\n".join(sentence() for _ in range(r.randrange(4, 14))) if p else "\n".join(entry() for _ in range(r.randrange(4, 40)))) for k, p in enumerate(prose)]
    got = {x["doc_id"]: x["prose"] for x in text_quality.typed(text_quality.statistics(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text", common)).collect()}
    assert sum((got[k] >= 0.5) == p for k, p in enumerate(prose)) >= 0.97 * len(prose)


def test_public_confusables(spark):
    look = print_forms.look_alikes(spark)
    of = lambda x: print_forms.forms(pa.array([x]), look).to_pylist()[0]
    for a, b in (("\u03c1", "p"), ("\u0585", "o"), ("\u13aa", "A"), ("\u0251", "a"), ("\u0430", "a"), ("\u041e", "O")):
        assert of(a) == of(b) == b
    # case, accents, digits and marks never merge, nor do Latin letters with each other
    for a, b in (("\u041e", "o"), ("O", "0"), ("l", "1"), ("l", "I"), ("|", "l"), ("\u00e1", "a"), ("rn", "m"), ("c", "e"), (",", ".")):
        assert of(a) != of(b)
    plain = [chr(c) for c in range(32, 127)]
    assert [of(f"x{c}x") for c in plain] == [f"x{c}x" for c in plain]


def test_joiners_between_pictures_are_seen():
    woman, school, heart = "\U0001f469", "\U0001f3eb", "\u2764\ufe0f"
    assert form(f"{woman}\u200d{school}") != form(f"{woman}{school}")
    assert form(f"{heart}\u200d{woman}") != form(f"{heart}{woman}") and form(heart) == form("\u2764")
    assert form("a\u200db") == form("ab") and form(f"{woman}\u200d") == form(woman) and form(f"\u200d{woman}") == form(woman)


def test_form_of_a_batch_is_that_of_each_text():
    r = random.Random(8)
    alphabet = ["a", "é", "e\u0301", " ", "  ", "\u00a0", "\u200b", "н", "가", "ㄱ", "\u1100\u1161\u11a8", "ﬁ", "x", "\n", "½", "ｗ", "\u0327\u0301"]
    own = ["".join(r.choice(alphabet) for _ in range(r.randrange(0, 30))) for _ in range(300)] + ["plain", "dos palabras", None, ""]
    assert print_forms.forms(pa.array(own)).to_pylist() == [None if t is None else form(t) for t in own]


def test_print_pairs_of_split_classes(spark, rows, monkeypatch):
    data = [(k, "una nota") for k in range(40)] + [(100 + k, "una\u00a0nota") for k in range(7)] + [(200 + k, "una  nota") for k in range(7)] + [(300, "otra nota")]
    df = spark.createDataFrame(data, "row_id long, t string")
    kind = {k: t for k, t in data if k < 300}
    want = sorted((a, b) for a in kind for b in kind if a < b and kind[a] != kind[b])
    monkeypatch.setattr(print_forms, "SPLIT", 6)
    assert rows(print_forms.same_print(df, "row_id", "t")) == want

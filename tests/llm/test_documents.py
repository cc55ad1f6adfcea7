import os

import numpy as np
import pytest

from lumisift.llm import languages as L
from lumisift.llm.mixing import flight, land, mix, settle
from lumisift.llm.packing import pack, plan_slots
from lumisift.llm.tokens import VOCABULARY, encoder, token_counts

needs_vocabulary = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary file")
DOC = "doc_id long, text string, source string, lang string, n long, piece string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, None, 1, "x") for i, t, s in rows], DOC)


# Packing


def unplanned(rows, histogram, capacity):
    """(container -> [(offset, length)]) of a plan, after checking that every rank has one slot."""
    bins, seen = {}, {n: set() for n in histogram}
    for length, first, many, start, each, used in rows:
        for k in range(many):
            seen[length].add(first + k)
            bins.setdefault(start + k // each, []).append((used + k % each * length, length))
    assert seen == {n: set(range(c)) for n, c in histogram.items()}
    return bins


def best_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = [r for r in rooms if r >= n]
        if fit:
            rooms.remove(min(fit))
            rooms.append(min(fit) - n)
        else:
            rooms.append(capacity - n)
    return len(rooms)


def test_plan_is_best_fit_on_counts():
    rng = np.random.default_rng(6)
    for capacity in (7, 50, 2048):
        lengths = rng.integers(1, capacity + 1, 400).tolist() + [capacity // 3 + 1] * 200
        histogram = {n: lengths.count(n) for n in set(lengths)}
        bins = unplanned(plan_slots(histogram, capacity), histogram, capacity)
        for items in bins.values():
            items.sort()
            assert all(a + n <= b for (a, n), (b, _) in zip(items, items[1:])) and items[-1][0] + items[-1][1] <= capacity
        assert sorted(bins) == list(range(len(bins))) and len(bins) <= best_fit(lengths, capacity) + 1
    assert plan_slots({}, 10) == []


@needs_vocabulary
def test_packing_of_odd_documents(spark):
    rows = [(k, "word " * (k % 40), "s") for k in range(200)] + [(900, None, "s"), (901, "", "s"), (902, " ", "s"), (903, "ab " * 300, "s"), (904, "x" * 100_000, "s"), (None, "text", "s")]
    df = docs(spark, rows)
    counts = {r.id: r.n for r in token_counts(df, "doc_id", "text").collect()}
    enc = encoder(VOCABULARY)
    assert counts[903] == len(enc.encode_ordinary("ab " * 300)) and counts[900] == counts[901] == 0
    got = pack(df, "doc_id", "text", capacity=64).collect()
    total, bins = {}, {}
    for r in got:
        total[r.id] = total.get(r.id, 0) + r.n
        bins.setdefault(r.sequence_id, []).append((r.at, r.n))
    assert total == {i: n for i, n in counts.items() if n and i is not None}
    for items in bins.values():
        items.sort()
        assert all(a + n <= b for (a, n), (b, _) in zip(items, items[1:])) and items[-1][0] + items[-1][1] <= 64
    assert sum(total.values()) / (64 * len(bins)) > 0.97 and sorted(bins) == list(range(len(bins)))
    assert {r.id for r in got if r.piece > 0} == {i for i, n in counts.items() if n > 64 and i is not None}
    assert pack(df.limit(0), "doc_id", "text").count() == 0


# Mixing


def test_flight_keeps_both_totals():
    rng = np.random.default_rng(7)
    pi, n = np.full(500, 0.37), rng.integers(1, 900, 500).astype(float)
    out = flight(pi, n, np.random.default_rng(1))
    assert abs(out.sum() - pi.sum()) < 1e-6 and abs((out * n).sum() - (pi * n).sum()) < 1e-4
    assert ((out > 0) & (out < 1)).sum() <= 2 and set(np.unique(land(out, n))) <= {0.0, 1.0}
    # the flight keeps every inclusion probability on average; only landing gives that up
    mean = np.mean([flight(pi[:40], n[:40], np.random.default_rng(k)) for k in range(800)], axis=0)
    assert abs(mean - 0.37).max() < 0.08
    giants = np.r_[n, [50_000.0] * 3]
    s = settle(np.full(503, 0.5), giants, np.random.default_rng(3))
    assert abs((s * giants).sum() - 0.5 * giants.sum()) < n.max()  # not even one of the short ones
    assert flight(np.zeros(0), np.zeros(0), rng).size == 0


@needs_vocabulary
@pytest.mark.parametrize("block", [4096, 40])
def test_mix(spark, block):
    text = lambda k: "word " * (1 + k % 50)
    rows = [(k, text(k), ["Big ", "big", "small", None, "extra"][k % 5]) for k in range(1000)] + [(5000, None, "big"), (5001, "  ", "big"), (5002, "x", " ")]
    targets = spark.createDataFrame([("BIG", 0.5, 1), (" small", 0.4, 3), ("absent", 0.1, 5), (None, 0.2, 1)], "source string, target_share double, max_repeats int")
    draw, report = mix(docs(spark, rows), targets, "doc_id", "text", "source", block=block)
    rep = {r.source: r for r in report.collect()}
    uses = {r.id: (r.source, r.n, r.uses) for r in draw.collect()}
    total = sum(r.n for r in token_counts(docs(spark, [r for r in rows if r[2] is not None and r[1] and r[1].strip()]), "doc_id", "text").collect())
    assert set(rep) == {"big", "small", "absent"} and abs(rep["big"].need - 0.5 * total) < 1e-6
    assert {s: r.short for s, r in rep.items()} == {"big": rep["big"].available < 0.5 * total, "small": rep["small"].available < 0.4 * total, "absent": True}
    for s in ("big", "small"):
        mine = [u for u in uses.values() if u[0] == s]
        assert sum(n * k for _, n, k in mine) == rep[s].drawn and max(k for *_, k in mine) <= rep[s].max_repeats
        assert abs(rep[s].drawn - min(rep[s].need, rep[s].available)) <= 60
    assert abs(sum(r.actual_share for r in rep.values()) - 1) < 1e-9
    empty, none = mix(docs(spark, []), targets, "doc_id", "text", "source")
    assert empty.count() == 0 and {r.source: r.drawn for r in none.collect()} == {"big": 0, "small": 0, "absent": 0}


# Languages

TEXTS = {
    "en": ["The older picture shows a narrow street near the river.", "Nobody noticed that the light was missing from the corner.", "We kept the second copy because the first one was blurred.", "There are only a few drawings left in this folder."],
    "de": ["Das ältere Bild zeigt eine schmale Straße nahe dem Fluss.", "Niemand hat bemerkt, dass das Licht in der Ecke fehlt.", "Wir behielten die zweite Kopie, weil die erste unscharf war.", "In diesem Ordner sind nur noch wenige Zeichnungen übrig."],
    "fr": ["La vieille image montre une rue étroite près de la rivière.", "Personne n'a remarqué que la lumière manquait dans le coin.", "Nous avons gardé la deuxième copie car la première était floue.", "Il ne reste que quelques dessins dans ce dossier."],
    "es": ["La imagen antigua muestra una calle estrecha cerca del río.", "Nadie notó que faltaba la luz en la esquina.", "Guardamos la segunda copia porque la primera estaba borrosa.", "Solo quedan unos pocos dibujos en esta carpeta."],
    "zh": ["这张旧图画的是河边的一条小街。", "没有人注意到角落里少了灯光。", "我们保留了第二张，因为第一张很模糊。", "这个文件夹里只剩下几张图了。"],
    "ja": ["この古い絵には川の近くの細い道が描かれています。", "隅の明かりがないことに誰も気づきませんでした。", "一枚目がぼやけていたので二枚目を残しました。", "このフォルダーには絵が少ししか残っていません。"],
}


@pytest.fixture(scope="module")
def weights():
    rng = np.random.default_rng(5)
    texts, labels = [], []
    for lang, s in TEXTS.items():
        for k in range(30):
            texts.append(" ".join(rng.permutation(s)[:3]))
            labels.append("en" if k % 6 == 0 else lang)  # some labels are wrong
    return L.fit(texts, labels, list(TEXTS))


def test_ngrams_do_not_cross_texts():
    def of(texts):
        b, k = L.ngram_buckets(texts)
        return [sorted(b[k == i].tolist()) for i in range(len(texts))]

    alone = [of([t])[0] for t in ("abc", "x", "слово и", "字")]
    assert of(["abc", "x", "слово и", "字"]) == alone and len(alone[1]) == 4  # x, its blanks with it, and both


def test_stretches_against_all_splits():
    rng = np.random.default_rng(4)
    for n in (4, 5, 6, 7):
        score = rng.normal(0, 8, (n, 3))

        def best(lo, prev):
            if lo == n:
                return 0.0, []
            out = (-1e9, [])
            for hi in range(lo + 2, n + 1):
                for k in range(3):
                    if k != prev and not 0 < n - hi < 2:
                        rest = best(hi, k)
                        v = score[lo:hi, k].sum() + rest[0] - (6.0 if hi < n else 0)
                        out = max(out, (v, [(k, lo, hi), *rest[1]]))
            return out

        assert L.stretches(score) == best(0, -1)[1]


def test_documents_and_segments(spark, weights):
    mixed = " ".join(TEXTS["de"][:2]) + "\n\n" + "".join(TEXTS["zh"][:3]) + " ".join(TEXTS["en"][1:3])
    rows = [(1, TEXTS["fr"][0].upper(), "x"), (2, "img_123.png: <p>" + " ".join(TEXTS["es"][:3]).replace("á", "a").replace("í", "i") + "</p>\ntags: blue_sky, old_street", "x"), (3, mixed, "x"), (4, None, "x"), (5, "  ", "x"), (6, "img_1.png 12345 a_b <br>", "x"), (7, "".join(TEXTS["ja"]) * 3000, "x"), (8, "Nobody", "x")]
    got = {}
    for r in L.identify(docs(spark, rows), "doc_id", "text", *weights).orderBy("id", "segment_no").collect():
        assert 0 < r.confidence <= 1
        got.setdefault(r.id, []).append((r.segment_no, r.lang))
    assert got == {1: [(1, "fr")], 2: [(1, "es")], 3: [(1, "de"), (2, "zh"), (3, "en")], 7: [(1, "ja")], 8: [(1, "en")]}


def test_held_out_accuracy(weights):
    hit = sum(L._identify([0], [s], *weights).lang[0] == lang for lang, ss in TEXTS.items() for s in (x[: len(x) * 2 // 3] for x in ss))
    assert hit == sum(map(len, TEXTS.values()))


def test_labels_and_no_training_rows(spark):
    df = spark.createDataFrame([(1, "Nobody noticed it.", " EN-us ", "s"), (2, "x", "English", "s"), (3, None, "de", "s"), (4, "y", None, "s")], "doc_id long, text string, lang string, source string")
    assert L.labels_in_use(df, "lang") == ["de", "en"] and L.labels_in_use(df, "lang", 0.3) == []
    assert L.labelled_sample(df, "doc_id", "text", "lang", ["en"]) == (["Nobody noticed it."], ["en"])
    assert [r.lang for r in L.document_languages(df.limit(0).union(df.filter("doc_id = 2")), "doc_id", "text", "lang").collect()] == ["und"]
    assert L.document_languages(df.limit(0), "doc_id", "text", "lang").count() == 0


def test_classes_come_from_the_labels(spark, weights):
    texts = [(k, " ".join(TEXTS[lang]), lang) for k, lang in enumerate(("de", "fr", "es") * 4)]
    wrong = [(100 + k, " ".join(TEXTS[lang]), "xx") for k, lang in enumerate(("de", "fr"))]
    df = spark.createDataFrame(texts + wrong, "doc_id long, text string, lang string")
    got = {r.id: r.lang for r in L.document_languages(df, "doc_id", "text", "lang").collect()}
    assert got == {**{k: lang for k, _, lang in texts}, 100: "de", 101: "fr"}  # xx is no language
    other = docs(spark, [(1, "שלום לכולם ותודה רבה על הכול", "x")])
    assert [r.lang for r in L.identify(other, "doc_id", "text", *weights).collect()] == ["und"]


def test_markup_of_any_length_goes_and_text_stays():
    long = "x" * 5000
    assert L.sentences(f'<a href="{long}">Hallo Welt.</a>') == ["hallo welt"]
    assert L.sentences(f'[{long}] key="a b" Guten Tag, k=v; x=<b>alle</b>') == ["guten tag alle"]
    assert L.sentences("3 < 5 and 7 > 2. &amp; so on") == ["and", "so on"]
    assert L.sentences("see blue_sky_(old) at https://x.y/z?q=1 now") == ["see at now"]
    assert L.sentences("photo-1.PNG: gone\ntags: a, b\nEnde") == ["gone", "ende"]
    assert L.sentences("_" * 100_000 + "a" * 100_000 + "<" * 100_000) == []  # a tag, and no text

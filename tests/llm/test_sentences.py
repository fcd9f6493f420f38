"""Boundaries on a small corpus whose boundaries are known; units, wraps and scripts."""

import random

import pytest
from pyspark.sql import functions as F

from loomwright.llm import sentences, splitting

PARTS = ("Grind the valve.", "It took 5 h. to weld the cover (cf. Sec. 4.2) before noon.", 'The card says: "Do not force." and stays.', "Use approx. 3.5 ml of oil.", "See Fig. 7 for the seat.", "Is the hose dry?", "Lay out cloth, tape, etc.", "20 V must reach the lamp.", "Wait ... then weld it.")


def corpus(n=400, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lines, spans, at = [], [], 0
        for _ in range(rng.randint(1, 6)):
            line = [rng.choice(PARTS) for _ in range(rng.randint(1, 4))]
            for j, p in enumerate(line):
                spans.append((at, at + len(p)))
                at += len(p) + 1
            lines.append(" ".join(line))
        out.append((i, "\n".join(lines), "en", spans))
    return out


@pytest.fixture(scope="module")
def small(spark):
    return spark.createDataFrame([(i, t, lang) for i, t, lang, _ in corpus()], "doc_id long, text string, lang string")


def test_learned_boundaries(spark, small):
    got = {}
    for r in sentences.split_sentences(small).collect():
        got.setdefault(r.doc_id, set()).add((r.start_at, r.end_at))
    wanted = {(i, s) for i, _, _, spans in corpus() for s in spans}
    found = {(i, s) for i, spans in got.items() for s in spans}
    assert len(wanted & found) >= 0.97 * max(len(wanted), len(found))


def units(text, lang="en"):
    return [text[a:b] for a, b in sentences.sentences_of(sentences.Lexicon([]), lang, text)]


def test_units():
    assert units("# 1. Care of it\n\n- a. b! C\nx | y. Z | w\n a → b → c. D \n\n") == ["# 1. Care of it", "- a. b! C", "x | y. Z | w", "a → b → c. D"]
    assert units("1. Stop! Go now\n") == ["1. Stop!", "Go now"]
    assert units("停止。开始！他说：“好。”") == ["停止。", "开始！", "他说：“好。”"]
    assert units("") == [] and units(" \n\t ") == []
    long = "word " * 200_000
    assert units(long) == [long.strip()]


def test_wrapped_prose():
    import textwrap

    text = textwrap.fill("The quick fitter takes the old valve out of the housing and puts a new one in. " * 4, 72)
    assert all("\n" in u or len(u) < 79 for u in units(text)) and len(units(text)) == 4


def test_odd_rows(spark, small):
    rows = spark.createDataFrame([(1, None, "en", 1), (2, "", None, 1), (3, " \n", "xx", 1), (4, "Grind it. Weld it.", None, 1), (4, "Grind it. Weld it.", None, 1)], "doc_id long, text string, lang string, start_at int")
    got = [(r.doc_id, r.start_at, r.end_at) for r in sentences.split_sentences(rows).collect()]
    assert {g[0] for g in got} == {4} and sorted(got) == sorted(2 * list(dict.fromkeys(got)))
    assert sentences.split_sentences(rows.where("false")).collect() == []


def test_pieces(spark):
    text = " ".join(f"Grind the valve number {i} and weld cover {i} again." for i in range(120))
    table = "\n".join(f"valve {i} | {i} | ok" for i in range(120))
    rows = spark.createDataFrame([("t", text, "paragraph", 1), ("r", table, "Table", 1), ("x", "y" * 5000, None, 1), ("s", "short", "step", 1), ("n", None, "step", 1)], "item_id string, text string, unit_type string, piece int")
    corpus = spark.createDataFrame([(x,) for x in text.replace(". ", ".\n").split("\n")], "text string")
    cuts, valleys, parts = splitting.split_items(rows, rows.select("text").unionByName(corpus))
    by = {}
    for r in cuts.collect():
        by.setdefault(r.item_id, []).append(r.cut_at)
    assert sorted(by["r"]) == [m for m in range(1, len(table)) if table[m - 1] == "\n"] and len(by["t"]) == 119 and "x" not in by
    for name, whole in (("t", text), ("r", table), ("x", "y" * 5000)):
        found = sorted((r for r in parts.collect() if r.item_id == name), key=lambda r: r.piece)
        assert "".join(r.text[r.overlap :] for r in found) == whole
        assert all(len(r.text) <= 800 and r.overlap <= 80 and r.text == whole[r.start_at : r.end_at] for r in found)
        assert name == "x" or all(r.start_at + r.overlap in {0, *by[name]} for r in found)
    assert {r.item_id for r in parts.collect()} == {"t", "r", "x"}
    assert [d.where(F.lit(False)).count() for d in (cuts, valleys, parts)] == [0, 0, 0]
    depth = {(r.item_id, r.cut_at): r.depth for r in valleys.collect()}
    assert set(depth) == {(i, c) for i, cs in by.items() for c in cs}
    for r in parts.where("depth is not null").collect():
        begin = r.start_at + r.overlap
        room = r.start_at + splitting.LIMIT
        window = [d for (i, c), d in depth.items() if i == r.item_id and begin + max(1, int((room - begin) * (1 - splitting.WINDOW))) <= c <= room]
        assert r.depth == depth[r.item_id, r.end_at] and (not window or r.depth == max(window))


def test_peaks_and_long_lists():
    text = "valve seat. valve seat. valve seat. pump oil. pump oil. pump oil. "
    starts = [i for i in range(1, len(text)) if text[i - 1 : i] == " " and text[i - 2 : i - 1] == "."]
    valley = splitting.depths(text, starts)
    assert starts[valley.index(max(valley))] == text.index("pump")
    rng = random.Random(2)
    c = [rng.random() for _ in range(60)]
    for i, peak in enumerate(splitting._peaks(c)):
        want = c[i]
        for x in reversed(c[:i]):
            if x < want:
                break
            want = x
        assert peak == want
    many = "\n".join("word" for _ in range(20_000))
    assert len(splitting.unit_starts(many, "list")[0]) == 19_999


def test_verdicts_as_in_memory(spark, small):
    """The joined verdicts are those of a lexicon in memory, own language before all, longer keys before shorter."""
    scanned = sentences.scan(small, "doc_id", "text", "lang")
    cases, learned = sentences.learned_cases(scanned)
    lexicon = sentences.Lexicon([tuple(r) for r in learned.select("lang", "kind", "key", "score").collect()])
    more = spark.createDataFrame([("xx", ".", "5 h", "Use\tUse approx"), ("en", "!", "", "never"), ("", ".", "Fig", "# for the")], "lang string, mark string, word string, key string")
    got = sentences.verdicts(cases.select(*sentences.CASE).unionByName(more).distinct(), learned).collect()
    assert len(got) >= 10 and all(r.boundary == lexicon.boundary(r.lang, r.mark, r.word, r.key) for r in got)


def test_ratios(spark):
    import math

    row = spark.range(1).select(sentences.association_ratio(*[F.lit(float(x)) for x in (30, 40, 50, 1000)]).alias("a"), sentences.likelihood_ratio(F.lit(9.0), F.lit(1.0)).alias("b")).first()
    cells = ((30, 40 * 50), (10, 40 * 950), (20, 960 * 50), (940, 960 * 950))
    assert row.a == pytest.approx(2 * sum(o * math.log(o * 1000 / e) for o, e in cells))
    assert row.b == pytest.approx(2 * (9 * math.log(1.8) + math.log(0.2)))


def test_words_of_every_text_count(spark):
    """A closing quotation mark or a script without blanks somewhere in a text leaves none of its words out."""
    texts = ("Use approx. 3 ml of oil. Wait.", "The card says “go on” behind approx. Sec. four: Then stop.", "使用 approx. 三 oil 。 Then weld it.")
    rows = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    met = {}
    for r in sentences.scan(rows, "doc_id", "text", "lang").where("kind is not null").collect():
        met[r.kind, r.key] = met.get((r.kind, r.key), 0) + r.n
    assert met["n", "approx"] == met["w", "approx"] == 3 and met["n", "oil"] == 2 and met["q", "Then\tThen stop"] == 1
    assert sum(n for (kind, key), n in met.items() if kind == "n" and " " not in key) == sum(not w[0].isdigit() for t in texts for w in t.split())


def test_key_of_a_number_does_not_depend_on_others():
    """A number that begins with a point has the two words behind it in its key, whatever was read before."""
    keys = [sentences.first_key(text, 0, len(text))[1] for text in (".23 V on it", ".23 V must reach it", ".23 V")]
    assert keys == ["# V on", "# V must", "# V "]


def test_places_of_many_are_those_of_each():
    """What is found in many texts together is what going through each segment mark by mark finds."""
    rng = random.Random(4)
    parts = (*PARTS, ". ", " ", " ", "  ", "e.g. ", "p.m.)", "(cf. ", ") ", ".) ", ' "', '." ', "“", "” ", "„", ".“ ", "« ", "»", "?! ", "... ", "… ", "。", "使用", "ไทย ", "¿", ";", "\xa0❶", "a.b", "x.Y", "Bar ", "20 ", ".5 V ", "\n", "\u200b")
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 20))) for _ in range(3000)]
    held = [(t, b, e, bool(sentences.THAI.search(x, b, e))) for t, x in enumerate(texts) for _, e, b in sentences.segments(x) if b >= 0 and x[b:e].strip()]
    places, of = sentences.all_places(sentences.Words(texts, held))
    got = {}
    for i, r in zip(of.tolist(), places.to_pylist()):
        got.setdefault(i, []).append((r["start_at"], r["mark"], r["word"], r["key"], texts[held[i][0]][: r["ended"]]))
    for i, (t, b, e, _) in enumerate(held):
        assert sorted(got.get(i, [])) == sorted((at, mark, word, key, texts[t][:at].rstrip()) for mark, word, at, key in sentences.candidates(texts[t], b, e))


def test_blocks(spark, small, monkeypatch):
    """Results do not depend on how many texts are looked at together."""
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"id": list(range(6)), "text": ["ab", None, "", "x" * 50, "abc", "d"], "lang": [None] * 6})
    monkeypatch.setattr(sentences, "TOGETHER", 4)
    cut = [b.column(1).to_pylist() for b in sentences.blocks(iter([batch, batch.slice(0, 0)]))]
    assert cut == [["ab", None, ""], ["x" * 50], ["abc", "d"]]

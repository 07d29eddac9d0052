"""Operators for training text: brute force on small inputs, round trips, held-out accuracy, edges."""

import random
import unicodedata as U

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

llm = pytest.importorskip("lectern.llm")

from lectern.llm import language, leakage, normalform, packing, repetition, sentences, splitting, truncation  # noqa: E402
from lectern.llm.queries import QUERIES  # noqa: E402
from lectern.llm.sql import ORACLE  # noqa: E402

DDL_ITEMS = "item_kind string, item_id long, p_i int, text string"


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def items(spark, texts, kind="chunk"):
    return spark.createDataFrame([(kind, k, -1, t) for k, t in enumerate(texts)], DDL_ITEMS)


# Problem 1.


def test_viterbi_is_the_best_labelling():
    crf = repetition.field()
    rng = np.random.default_rng(3)
    sizes = [1, 7, 3, 7, 5, 2, 6] * 4
    of = np.repeat(np.arange(len(sizes)), sizes)
    found = repetition.Sequences(of, np.ones(len(of), int), rng.integers(0, 8, len(of)), rng.integers(0, 2, len(of)))
    labels = crf.decode(found)

    def score(mine, seen, joined):
        return sum(crf.scores()[s, l] for s, l in zip(seen, mine)) + sum(crf.transition[j, a, b] for j, a, b in zip(joined[1:], mine, mine[1:]))  # noqa: E741

    for k, size in enumerate(sizes):
        here = of == k
        parts = labels[here], found.seen[here], found.joined[here]
        assert score(*parts) == pytest.approx(max(score([n >> j & 1 for j in range(size)], *parts[1:]) for n in range(1 << size)))
    assert len(crf.decode(repetition.observe([]))) == 0 and len(crf.decode(repetition.observe([[], []]))) == 0


def test_field_on_held_out_texts():
    crf = repetition.field()
    found, gold = repetition.planted_texts(300, seed=99)
    labels = crf.decode(found)
    right = lambda x: np.mean(x == gold)
    assert right(labels) > 0.995
    # No feature alone is the answer, nor are the units without their neighbours.
    single = [right(x) for x in (found.joined, found.seen & 1, found.seen >> 1 & 1, found.seen >> 2)]
    assert max(single) < 0.97 and right(repetition.Crf(crf.state, np.zeros((2, 2, 2))).decode(found)) < 0.97


@settings(deadline=None, max_examples=100)
@given(st.lists(st.text(alphabet="ab ж早ก.\n", max_size=30), max_size=4))
def test_joins_against_brute_force(texts):
    lines = [repetition.lines_of(t) for t in texts]
    found = repetition.observe(lines)
    wanted = []
    for text in lines:
        units = [u for line in text for u in line]
        joined, seen = [False] * len(units), set()
        for a in range(len(units)):
            b, weight = a, 0
            while b < len(units) and weight < 4:
                weight += units[b][1]
                b += 1
            if weight >= 4:
                key = tuple(u for u, _ in units[a:b])
                if key in seen:
                    joined[a + 1 : b] = [True] * (b - a - 1)
                seen.add(key)
        wanted += joined
    assert found.joined.tolist() == wanted


def test_repetition(spark):
    once, thrice = "one two three four five", "and then it fell. And THEN it, fell 3 and then it fell"
    rows = [(1, once, None), (2, thrice, []), (3, None, ["a b c", None, "A b 1 c", "a, b c"]), (4, "", [""]), (5, "早く行こう早く行こう早く行こう", None), (6, "ตอนเย็น", None), (2, thrice, [])]
    df = spark.createDataFrame(rows, "check_id long, transcript string, reasons array<string>").withColumn("form", F.lit(1))
    out = {r["check_id"]: r for r in repetition.repetition(df).collect()}
    assert {k: r["retained"] for k, r in out.items()} == {1: True, 2: False, 3: False, 4: True, 5: False, 6: True}
    assert out[1]["transcript_share"] == 0 and out[4]["reasons_share"] == 0 and out[5]["transcript_letters"] == 15
    assert repetition.repetition(df.limit(0)).count() == 0
    letters, repeated = repetition.repeated_letters(["la " * 50_000, None, ""], repetition.field())
    assert letters.tolist() == [100_000, 0, 0] and repeated[0] >= 99_990


# Problem 2.


@settings(deadline=None, max_examples=150)
@given(st.text(alphabet="ab ,.\n。क़्ё", max_size=300), st.integers(2, 60), st.data())
def test_cutting(text, most, data):
    overlap = data.draw(st.integers(0, most - 1))
    pieces = splitting.cut(text, most, overlap)
    assert "".join(text[a:b][max(0, e - a) :] for (a, b), e in zip(pieces, [0, *(b for _, b in pieces)])) == text
    assert all(0 < b - a <= most for a, b in pieces)
    assert all(a < c <= b < d and b - c <= overlap for (a, b), (c, d) in zip(pieces, pieces[1:]))


def test_range_maximum():
    values = np.random.default_rng(1).integers(0, 5, 90)
    index = splitting.RangeMaximum(values)
    for a in range(90):
        for b in range(a, 90):
            top = values[a : b + 1].max()
            assert index.rightmost(a, b) == a + np.flatnonzero(values[a : b + 1] == top)[-1]


def test_split_items(spark):
    texts = ["short", None, "", "A first sentence here. Then a second one, with a clause.", "x" * 45]
    out = splitting.split_items(items(spark, texts).unionByName(items(spark, ["free" * 9], "other")), {"chunk": (30, 5)})
    assert sorted({(r["item_id"], r["n_pieces"]) for r in out.collect()}) == [(0, 1), (3, 3), (4, 2)]
    assert [r["piece"] for r in out.filter("item_id = 3").orderBy("piece_i").collect()] == ["A first sentence here. ", "Then a second one, ", "one, with a clause."]
    assert [r["cut_at"] for r in out.filter("item_id = 3").orderBy("piece_i").collect()] == ["sentence", "clause", "item"]
    ends = items(spark, ["a b", "a b", "c " * 20]).withColumn("ends_paragraph", F.expr("case item_id when 0 then true when 2 then true end"))
    assert [(r[1], r[3], r[7]) for r in collected(splitting.split_items(ends, {"chunk": (30, 5)}))] == [(0, 0, "paragraph"), (1, 0, "item"), (2, 0, "word"), (2, 1, "paragraph")]
    family = "👨‍👩‍👧" * 9
    assert all(family[a:b].startswith("👨") and family[a:b].endswith("👧") for a, b in splitting.cut(family, 12, 0))
    with pytest.raises(ValueError):
        splitting.cut("abc", 2, 2)


# Problem 3.


@settings(deadline=None, max_examples=150)
@given(st.lists(st.text(alphabet="aоoеeЁёíiїйй̈́​  \n…ﬁカｶﾞゝक़⼀ＡА", max_size=12), max_size=5))
def test_forms(texts):
    single = [normalform.comparison_form(t) for t in texts]
    assert normalform.comparison_forms(texts) == single
    for form in single:
        assert normalform.comparison_form(form) == form
        assert normalform.comparison_form(normalform.readable(form)) == form


@pytest.mark.parametrize(("a", "b"), [("Сосед", "Cоceд"), ("Ｚｗｅｉ．", "Zwei."), ("й", "й"), ("a b", "a b"), ("se­nt", "sent"), ("ガ", "ｶﾞ"), ("人", "⼈"), ("ﬁn", "fin"), ("ё", "ё"), ("a  b ", "a b")])
def test_same_look(a, b):
    assert normalform.comparison_form(a) == normalform.comparison_form(b)


@pytest.mark.parametrize(("a", "b"), [("А", "а"), ("ё", "е"), ("e", "é"), ("a.", "a"), ("a-b", "a b"), ("2", "²"), ("a\nb", "a b"), ("。", "."), ("l", "I")])
def test_other_look(a, b):
    assert normalform.comparison_form(a) != normalform.comparison_form(b)


def test_pairs_against_brute_force(spark):
    pick = random.Random(5)
    texts = ["".join(pick.choice("aа oо") for _ in range(pick.randint(0, 4))) for _ in range(120)] + [None, "​"]
    forms = [normalform.comparison_form(t) for t in texts]
    wanted = sorted(("chunk", a, -1, b, -1) for a in range(len(texts)) for b in range(a + 1, len(texts)) if forms[a] and forms[a] == forms[b] and texts[a] != texts[b])
    df = items(spark, texts).withColumn("key", F.lit("clash"))
    assert sorted(collected(normalform.same_looking_pairs(df))) == wanted
    assert sorted(collected(normalform.same_looking_pairs(df, most_per_task=3))) == wanted
    assert normalform.same_looking_pairs(df.limit(0)).count() == 0
    classes = [r.asDict() for r in normalform.look_classes(df).collect()]
    assert sorted(r["item_id"] for r in classes) == [k for k, f in enumerate(forms) if f]
    assert all((x["class_id"] == y["class_id"]) == (forms[x["item_id"]] == forms[y["item_id"]]) and (x["spelling"] == y["spelling"]) == (texts[x["item_id"]] == texts[y["item_id"]]) for x in classes for y in classes[:20])
    out = normalform.canonical_text(items(spark, ["Сoceд", None, ""])).orderBy("item_id").collect()
    assert [r["canonical"] for r in out] == ["Сосед", None, ""]


def test_hot_class(spark):
    """A hundred thousand copies and one variant are as many pairs, not the square of it."""
    import time

    rows = spark.range(100_001).select(F.lit("title").alias("item_kind"), F.col("id").alias("item_id"), F.lit(-1).alias("p_i"), F.when(F.col("id") == 7, "Cосед").otherwise("Сосед").alias("text"))
    began = time.perf_counter()
    assert normalform.same_looking_pairs(rows).agg(F.count("*"), F.sum(F.when((F.col("a_id") == 7) | (F.col("b_id") == 7), 1))).first()[:2] == (100_000, 100_000)
    assert time.perf_counter() - began < 60


# Problem 4.


@pytest.mark.parametrize(
    "marked",
    [
        "Он взял хлеб, соль и т. д. |Сосед ушёл... и вернулся! |«Стой. Ни шагу», — сказал он. |— Тише! — шепнул он. — тут кто-то есть. |А. П. Ким жил тут.",
        "В 1874 г. Цере купил дом на ул. Канатной за 3,5 тыс. рублей, см. стр. 48. |Да.",
        "Dr. Kim paid Mrs. Lee 3.5 crowns at 7 p.m. on the quay. |“Stay here. Do not move,” said Lalu. |The sign read “Keep out!” and she left. |He left. |“Where?” asked Ko.",
        "Er nahm Brot usw. |Am 3. Mai kam Hrn. Sacu. |„Wo ist sie?“, fragte er. |K. F. Ida wohnte dort, d. h. umsonst.",
        "« Où est-elle ? » demanda Léa. |M. Riri vint vers 19 h. 30 sur le quai. |J. B. vit là, c.-à-d. gratis. |Été fini.",
        "—¿Dónde está? —preguntó él. |El Sr. Ruiz llegó a las 7 p. m. en punto. |¿De verdad? |Sí.",
        "东温先生付了3.5个银币。|“我的灯笼在哪儿？”他头也不回地问。|“别动。等我。”她说。|好……|走吧！",
        "「動くな。すぐ戻る」と言った。|札には「止まれ！」とあり、足を止めた。|はい。",
        "डॉ. राजा ने 3.5 सिक्के दिए। |“कहाँ है?” जावोटा ने पूछा। |हाँ!",
        "ตอนเย็นลุงมา |กัปตันจ่ายเงิน3.5เหรียญ |At first light he left.",
        "Первая строка\n|Вторая строка",
        "Конец.|Начало. |Ｚｗｅｉ．|Eins.",
        "Նա գնաց։ |Նա եկավ։ |Վերջ։",
        "እሱ ሄደ። |እሷ መጣች፧ |አዎ።",
        "គាត់បានទៅ។ |នាងបានមក។",
        "သူသွားသည် ပြီး။ |သူမလာသည်။",
        "هو ذهب؟ |هي جاءت۔ |نعم",
        "ຂ້ອຍໄປ |ເຈົ້າມາ",
        "He gave it to me. |Then he left. |He took off his cap. |Then he sat. |He joined the rep. |Then Rep. Kim left.",
        "Он помог им. |Потом он ушёл. |Это было в 1990 г. |Потом он жил в г. Канатном. |Да.",
        "Er kam am 3. Mai und ging. |He was no. 3. |May came and the sun was out.",
        "So do I. |He left with J. R. Smith of the mill.",
    ],
)
def test_sentence_starts(marked):
    parts = marked.split("|")
    starts = [sum(map(len, parts[:k])) for k in range(1, len(parts))]
    assert sentences.sentence_starts("".join(parts)) == starts


def test_classes_are_those_of_the_property():
    import regex

    pick = random.Random(8)
    classes = sentences.break_classes()
    for code in [pick.randrange(0x3000) for _ in range(3000)]:
        if U.category(chr(code)) in ("Ps", "Pi", "Pd") or chr(code) in "…‥" or regex.match(r"\p{Line_Break=SA}", chr(code)):
            continue
        wanted = next((v for k, v in sentences.CLASSES.items() if regex.match(rf"\p{{Sentence_Break={k}}}", chr(code))), sentences.OTHER)
        assert chr(classes[code]) == wanted


def test_sentence_edges(spark):
    assert sentences.sentence_starts(None) == [] and sentences.sentence_starts("") == [] and sentences.sentence_starts(" . ! ") == []
    assert len(sentences.sentence_starts("Да. " * 20_000)) == 19_999
    found = collected(sentences.sentence_units(items(spark, [None, "", "Да. Нет.", "  Один"])))
    assert [(r[1], r[4], r[5]) for r in found] == [(2, 0, "Да."), (2, 4, "Нет."), (3, 2, "Один")]
    assert collected(sentences.sentence_boundaries(items(spark, ["Да. Нет.", None]))) == [("chunk", 0, -1, 4)]


@settings(deadline=None, max_examples=100)
@given(st.text(alphabet="Aб.!? «»“”„(\n。น​", max_size=60))
def test_sentences_cover_the_text(text):
    starts = sentences.sentence_starts(text)
    assert starts == sorted(set(starts)) and all(0 < s < len(text) for s in starts)
    joined = "".join(s for _, s in sentences.sentences(text))
    assert [c for c in joined if not c.isspace()] == [c for c in text if not c.isspace()]


# Problem 5.


@pytest.fixture(scope="module")
def labelled(sf_dir):
    import pyarrow.parquet as pq

    rows = pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "lang", "text"]).to_pylist()
    known = [(r["doc_id"], r["lang"].lower(), r["text"]) for r in rows if r["lang"] and r["text"]]
    return [x for x in known if x[0] % 3], [x for x in known if x[0] % 3 == 0]


@pytest.fixture(scope="module")
def model(labelled):
    return language.fit([(code, text) for _, code, text in labelled[0]])


def test_held_out_languages(model, labelled):
    right = total = 0
    for _, code, text in labelled[1]:
        found, codes, _, _ = language.judge(model, [text])
        for weight, guess in zip(found.weight, codes):
            if weight >= language.LEAST_WEIGHT and guess:
                right, total = right + (guess == code), total + 1
    assert total > 50 and right / total > 0.95


def test_languages_of_segments(spark, model):
    ru, en = "Старый лоцман громко хвалил ящик с картами в дальней кладовой.", "The old pilot twice counted the brass lantern in the warm kitchen."
    rows = [(1, 1, ru, "ru"), (2, 1, f"{ru} {en}", None), (3, 2, en, "xx"), (4, 1, None, None), (5, 9, "", "en"), (6, 1, "Staryy lotsman gromko khvalil yashchik s kartami v dalney kladovoy.", "EN"), (7, 1, ru.replace("о", "o").replace("а", "a"), "ru-RU")]
    chunks = spark.createDataFrame(rows, "chunk_id long, book_id long, text string, lang string")
    books = spark.createDataFrame([(1, "Russian"), (2, None)], "book_id long, language string")
    judged = language.with_book_label(language.segment_languages(chunks, model), books)
    assert collected(language.mislabelled(judged)) == [(2, "en"), (3, "en"), (6, "ru")]
    parts = [(r["seg_start"], r["seg_end"]) for r in judged.filter("chunk_id = 2").orderBy("seg_i").collect()]
    assert parts[0][0] == 0 and parts[-1][1] == len(rows[1][2]) and parts[0][1] == parts[1][0]
    assert language.segment_languages(chunks.limit(0), model).count() == 0


def test_languages_of_chunks(spark, model):
    ru, en = "Старый лоцман громко хвалил ящик с картами в дальней кладовой.", "The old pilot twice counted the brass lantern in the warm kitchen."
    rows = [(1, 1, ru, "ru"), (2, 1, f"{ru} {ru} {en}", None), (3, 2, en, "ru"), (4, 1, None, "ru"), (5, 9, "", "en"), (6, 1, "12 — 34!", "en")]
    chunks = spark.createDataFrame(rows, "chunk_id long, book_id long, text string, lang string")
    judged = language.segment_languages(chunks, model)
    out = {r["chunk_id"]: (r["lang"], r["confidence"]) for r in language.chunk_languages(chunks, judged).collect()}
    assert {k: v[0] for k, v in out.items()} == {1: "ru", 2: "ru", 3: "en", 4: None, 5: None, 6: None}
    assert out[4][1] == out[5][1] == out[6][1] == 0 and 0.5 < out[2][1] < out[1][1] <= 1


def test_fit_without_rows():
    found, codes, _, _ = language.judge(language.fit([]), ["Some text that no language is known for."])
    assert codes == [None] and language.segments([]).text.size == 0 and language.segments(["", "12"]).gram.size >= 0


# Problem 6.


def test_nnls_against_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(20):
        a, b = rng.random((6, 4)), rng.random(6)
        best = min(np.linalg.norm(a @ x - b) for mask in range(16) for x in [np.zeros(4)] for on in [[k for k in range(4) if mask >> k & 1]] for y in [np.linalg.lstsq(a[:, on], b, rcond=None)[0] if on else np.zeros(0)] if (y >= -1e-12).all() for _ in [x.__setitem__(on, y)])
        x = packing.nnls(a, b)
        assert (x >= 0).all() and np.linalg.norm(a @ x - b) <= best + 1e-8


@settings(deadline=None, max_examples=40)
@given(st.dictionaries(st.integers(1, 100), st.integers(1, 60), max_size=40))
def test_recipes(histogram):
    lengths = np.array(sorted(histogram), np.int64)
    counts = np.array([histogram[n] for n in sorted(histogram)], np.int64)
    made = packing.recipe(lengths, counts, 100)
    used = np.zeros(len(made.edges), int)
    for count, pattern in made.patterns:
        assert count > 0 and sum(made.edges[c] * n for c, n in pattern) <= 100
        for c, n in pattern:
            used[c] += count * n
    assert used.sum() == counts.sum()
    bins = sum(c for c, _ in made.patterns)
    assert bins <= 2 * (lengths * counts).sum() / 100 + 1


def test_packing(spark):
    sizes = [40, 60, 30, 70, 100, 1, 250, 99, None, 0] + [33] * 50
    df = spark.createDataFrame(list(enumerate(sizes)), "doc_id long, tokens long").withColumn("length", F.lit("clash"))
    out = packing.pack(df, {"a": 100, "b": 1000})
    rows = out.collect()
    for name, capacity in (("a", 100), ("b", 1000)):
        mine = [r for r in rows if r["pack_name"] == name]
        assert {k: sum(r["tokens"] for r in mine if r["doc_id"] == k) for k, s in enumerate(sizes) if s} == {k: s for k, s in enumerate(sizes) if s}
        load: dict = {}
        for r in mine:
            if r["container_id"] is not None:
                load[r["container_id"]] = load.get(r["container_id"], 0) + r["tokens"]
        assert max(load.values()) <= capacity and sorted(load) == list(range(len(load)))
        assert all((r["n_pieces"] > 1) == (sizes[r["doc_id"]] > capacity) for r in mine)
    report = {r["pack_name"]: r for r in packing.fill_report(out, {"a": 100, "b": 1000}).collect()}
    assert report["b"]["containers"] == 3 and report["a"]["containers"] <= 26
    assert packing.pack(df.limit(0), {"a": 10}).count() == 0


def test_capacities_above_the_bound(spark, monkeypatch):
    monkeypatch.setattr(packing, "MOST_LENGTHS", 64)
    sizes = [7 * k % 1003 + 1 for k in range(400)] + [1003, 1002, 2500]
    df = spark.createDataFrame(list(enumerate(sizes)), "doc_id long, tokens long")
    rows = packing.pack(df, {"a": 1003}).collect()
    load: dict = {}
    for r in rows:
        if r["container_id"] is not None:
            load[r["container_id"]] = load.get(r["container_id"], 0) + r["tokens"]
    assert {k: sum(r["tokens"] for r in rows if r["doc_id"] == k) for k in range(len(sizes))} == dict(enumerate(sizes))
    assert max(load.values()) <= 1003 and len(load) <= 1.12 * sum(sizes) / 1003


# Problem 7.


def brute_cover(item, document, least):
    marks = [False] * len(item)
    for k in range(len(item) - least + 1):
        if item[k : k + least] in document:
            marks[k : k + least] = [True] * least
    return sum(marks)


def test_leaks_against_brute_force(spark):
    pick = random.Random(4)
    word = lambda: "".join(pick.choice("абвгдежзик") for _ in range(pick.randint(2, 7)))
    passage = lambda n: " ".join(word() for _ in range(n))
    evals = [(k, passage(60)) for k in range(8)] + [(90, "short"), (91, None)]
    docs = []
    for k in range(60):
        _, source = evals[k % 8]
        a = pick.randint(0, len(source) // 2)
        part = source[a : a + pick.choice((40, 120, 200, 400))]
        if k % 3 == 0:
            part = f"<p>{part.upper()}</p>".replace("О", "O")
        if k % 4 == 0:
            part = part.replace(" ", "  \n", 3)
        docs.append((k, f"{passage(30)} {part} {passage(10)} {evals[(k + 1) % 8][1][:150] if k % 5 == 0 else ''}"))
    docs += [(100, None), (101, ""), (3, evals[2][1])]
    letters = lambda t: "".join(map(chr, leakage.letter_codes([t])[0]))
    wanted = sorted({(d, i) for d, t in docs if t for i, e in evals if e and len(letters(e)) >= 60 and 5 * brute_cover(letters(e), letters(t), 60) >= 2 * len(letters(e))})
    ddf, edf = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(1)), spark.createDataFrame(evals, "item_id long, text string")
    out = leakage.leaked_items(ddf, edf)
    assert len(wanted) > 20 and sorted({(r["doc_id"], r["item_id"]) for r in out.collect()}) == wanted
    assert leakage.leaked_items(ddf.limit(0), edf).count() == 0 and leakage.leaked_items(ddf, edf.limit(0)).count() == 0


def test_blocks(spark, monkeypatch):
    text = " ".join(f"слово{chr(1072 + k % 32)}{chr(1072 + k // 2)}" for k in range(60))
    evals = spark.createDataFrame([(k, text[k * 7 :]) for k in range(5)], "item_id long, text string")
    docs = spark.createDataFrame([(1, text), (2, "другое")], "doc_id long, text string")
    wanted = collected(leakage.leaked_items(docs, evals).select("doc_id", "item_id"))
    monkeypatch.setattr(leakage, "ITEMS_PER_BLOCK", 2)
    monkeypatch.setattr(leakage, "BROADCAST_BYTES", 0)
    assert len(wanted) == 5 and collected(leakage.leaked_items(docs, evals).select("doc_id", "item_id")) == wanted


def test_shared_prompt_does_not_grow_the_join(spark):
    """Items of a suite that open with one prompt, and documents that all hold the prompt but one item each."""
    pick = random.Random(6)
    passage = lambda n: " ".join("".join(pick.choice("абвгдежзик") for _ in range(6)) for _ in range(n))
    prompt = passage(13)
    evals = [(k, f"{prompt} {passage(50)}") for k in range(30)]
    docs = [(k, f"{passage(5)} {prompt} {passage(5)} {evals[k % 30][1][100:] if k % 3 == 0 else ''}") for k in range(90)] + [(500, prompt)]
    items = dict(zip((k for k, _ in evals), (leakage.letter_codes([t])[0] for _, t in evals)))
    rows = leakage._shingle_rows(items)
    assert sum(r[3] for r in rows) >= 30 and all(r[5] for r in rows)
    ddf, edf = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(evals, "item_id long, text string")
    assert sorted((r["doc_id"], r["item_id"]) for r in leakage.leaked_items(ddf, edf).collect()) == sorted((k, k % 30) for k in range(0, 90, 3))
    # Where the prompt alone covers enough of an item, its documents are found by it.
    short = spark.createDataFrame([(k, f"{prompt} {passage(3)}") for k in range(12)], "item_id long, text string")
    assert leakage.leaked_items(ddf, short).count() == 12 * 91


# Problem 8.


@pytest.mark.parametrize(
    ("text", "open_"),
    [("He gave it to me.", False), ("Она помогла им.", False), ("„" + "Er kam an den Hof und blieb. " * 9 + "“", False), ("Он сказал: «Стой. " + "Он ждал у ворот. " * 9 + "Да.", True), ("a" * 30 + "»" * 40 + ".", False), ("Он ушёл.", False), ("Он уш", True), ("Он сказал: «Стой.", True), ("Он сказал: «Стой».", False), ("Брал хлеб и т. д.", False), ("жил тогда, т.", True), ("the man and he said to see Dr.", True), ("he is in the gap of cap.", False), ("“Where is", True), ("„Halt!“, und er blieb.", False), ("fin 🙂", False), ("好。", False), ("好", True), ("a, b,", True)],
)
def test_unfinished(spark, text, open_):
    assert spark.createDataFrame([(text,)], "t string").select(truncation.unfinished(F.col("t"))).first()[0] is open_


def test_long_quotations(spark):
    long = "a b c d " * 40
    rows = [(1, f"„{long}“, sagte er."), (2, f"„Ja.“ {long}“, sagte er."), (3, f"{'Er kam. ' * 60}„{long}“, sagte er. „Ja.“"), (5, f"Er sagte: „{long}.\n\nEr kam."), (4, f"„{long}“, sagte er: „Nein.")]
    df = spark.createDataFrame([(k, t, None) for k, t in rows], "doc_id long, text string, source string")
    wanted = {1: False, 2: True, 3: False, 4: True, 5: False}
    assert {r[0]: r[1] for r in df.select("doc_id", truncation.unfinished(F.col("text"))).collect()} == wanted
    assert {r["doc_id"]: r["open"] for r in truncation.inspected(df).collect()} == wanted


def test_limits_and_cuts(spark):
    full = "Старый лоцман громко хвалил ящик с картами. " * 9
    rows = [(k, full[k % 9 :][: 40 + 7 * (k % 23)].rsplit(".", 1)[0] + ".", "whole") for k in range(80)]
    rows += [(100 + k, full[k * 3 :][:200], "cut200") for k in range(12)]
    rows += [(200 + k, full[k * 3 :].encode()[:256].decode("utf-8", "replace"), "bytes") for k in range(12)]
    rows += [(300 + k, full[k * 5 :][:150] + "...", "dots") for k in range(12)] + [(390, "Он ушёл...", "dots")]
    rows += [(400, None, "whole"), (401, "", "whole"), (402, "1. Песня\n2. Сказка\n3. Песня", None), (403, "Текст &am", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("trimmed", F.lit(0))
    out = {r["doc_id"]: r for r in truncation.truncated_documents(df).collect()}
    complete = {k for k, t, _ in rows if t and t.rstrip().endswith(".") and not t.endswith("...")}
    assert not any(out[k]["cut"] for k in complete) and not out[402]["cut"] and not out[390]["cut"] and out[403]["cut"]
    at_stop = {k for k, t, _ in rows if t and t.endswith("....")}  # cut where a sentence ends, then marked
    assert all(out[k]["cut"] for k in out if 100 <= k < 390 and k not in complete | at_stop)
    report = {r["source"]: r for r in truncation.truncation_by_source(truncation.truncated_documents(df)).collect()}
    assert {out[k]["step"] for k in out if 100 <= k < 390 and out[k]["cut"]} == {"limit"} and out[403]["step"] == "ending"
    assert report["bytes"]["n_at_limit"] == report["bytes"]["n_cut"] > 8
    assert report["whole"]["n_cut"] == 0 and report["bytes"]["n_docs"] == 12
    assert truncation.truncated_documents(df.limit(0)).count() == 0


def test_wrapped_prose_is_judged(spark):
    prose = "Старый лоцман громко хвалил ящик. Ученик часовщика\nдолго искал список пассажиров. Потом он ушёл домой и\nдолго молчал. Рыжий паромщик вернулся в тёплую"
    tagged = "<p>Он ушёл. Она ждала.</p>\n<p>Он пришёл. Она ушла.</p>\n<p>Он ждал. Она приш"
    rows = [(1, prose, "a"), (2, tagged, "b"), (3, prose + " кухню.", "a"), (4, "Соль и дёготь\nТретий паром\nПустой перрон", "a")]
    out = {r["doc_id"]: r["cut"] for r in truncation.truncated_documents(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert out == {1: True, 2: True, 3: False, 4: False}


def test_lists_and_thai_cut_off_limits(spark):
    song, thai = "Старый лоцман\nРыжий паромщик\nПустой перрон", "คนเฝ้าประภาคารพบกล่องกระดุมใกล้โรงสี"
    rows = [(k, f"{song}\nОстров {k % 7}{'аб'[k % 2]}", None) for k in range(20)] + [(100 + k, " ".join([thai] * (1 + k % 5)), None) for k in range(40)]
    rows += [(200, "Рыжий паромщик\nПустой перрон\nСтарый лоц", "x"), (201, f"{thai} {thai[:-10]}", "x"), (202, "Рыжий паромщик\nПустой перрон\nОстров Мулока", "x")]
    out = {r["doc_id"] for r in truncation.truncated_documents(spark.createDataFrame(rows, "doc_id long, text string, source string")).filter("cut").collect()}
    assert out == {200, 201}


def test_endings_are_relative(spark):
    songs = ["Соль и дёготь", "Третий паром", "Пустой перрон", "Зимний причал"]
    rows = [(k, "\n".join(songs[(k + j) % 4] for j in range(3 + k % 40)), "w") for k in range(60)]
    rows += [(100 + k, f"Он ушёл в дом. Она была в лесу. {'Мы ждали в саду. ' * 40}", "w") for k in range(60)]
    rows += [(200 + k, "Третий паром\nЖизнь в\nПустой перрон", "w") for k in range(2)]
    prose = "Старый лоцман громко хвалил ящик с картами. " * 9
    rows += [(300 + k, prose[k * 3 :][:200], "cut") for k in range(12)]
    end = "\nТретий паром\nМастер ждал в"
    rows += [(400, ("Пустой перрон\n" * 20)[: 200 - len(end)] + end, "cut")]
    documents = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = {r["doc_id"]: r for r in truncation.truncated_documents(documents).collect()}
    assert out[400]["at_limit"] and out[400]["cut"] and not any(out[k]["cut"] for k in (*range(60), 200, 201))


# Queries.


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_runs(spark, sf_dir, name):
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()  # every row and column is computed


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_agrees_with_sql(spark, sf_dir, name):
    from compare import connection, differences

    assert differences(QUERIES[name](spark, sf_dir), connection(sf_dir), ORACLE[name]) == ""


def test_nothing_else_imports_the_subpackage():
    from pathlib import Path

    root = Path(normalform.__file__).parents[1]
    others = [p for p in root.rglob("*.py") if "llm" not in p.relative_to(root).parts]
    assert others and not any("lectern.llm" in p.read_text(encoding="utf-8") for p in others)

"""Operators on small tables: nulls, empty tables, ties, repeated rows, clashing names, partitions, sources, streams."""

import json
import wave
import zipfile

import pytest
from pyspark.sql import functions as F

from lectern.operators import reports as R
from lectern.operators import structure as G
from lectern.operators import verify as V
from lectern.sources import epub, files
from lectern.streaming import events


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_verdicts(spark):
    rows = [(1, "Он ушёл.", "он ушел", "ru", "x"), (2, None, None, None, "y"), (3, "", "", "en", "z"), (4, "The cat sat down.", "dogs", "en", "w")]
    df = spark.createDataFrame(rows, "id int, text string, heard string, lang string, ok string")
    out = {r["id"]: r for r in V.verdicts(df).collect()}
    assert [out[k]["ok"] for k in (1, 2, 3, 4)] == [True, True, True, False]
    assert out[2]["cer"] is None and out[3]["cer"] == 0 and out[1]["reasons"] == []
    assert V.verdicts(df.limit(0)).count() == 0


def test_error_rates_of_any_script(spark, tmp_path):
    from lectern.functions import compare
    from lectern.plans.queries import QUERIES

    pairs = [
        ("Он пришёл в 5 часов.", "он пришел в пять часов", "ru"), ("Старый лоцман хвалил ящик", "старый лоцман хвалил", "ru"), ("Café — “très” bon", "cafe tres bon", "en"), ("老船长称赞箱子。", "老船长称赞", "en"),
        ("古い船乗り、箱。", "古い船乗り箱", "en"), ("पुराना नाविक", "पुराना", "en"), ("คนเรือเก่า", "คนเรือ", "en"), ("The U.S.A. grey cat", "usa gray cat", "en"), ("", "noise", "en"), (None, None, "en"), ("Two men", "", "en"), ("Наш кот", None, "ru"),
    ]
    spark.createDataFrame([(k, t) for k, (t, _, _) in enumerate(pairs)], "chunk_id long, text string").write.parquet(f"{tmp_path}/chunks.parquet")
    rows = [(k, k, 1, True, 0.5, h, 1) for k, (_, h, _) in enumerate(pairs)]
    spark.createDataFrame(rows, "check_id long, chunk_id long, attempt int, ok boolean, cer double, transcript string, loaded_at long").write.parquet(f"{tmp_path}/checks.parquet")
    rates = {r["check_id"]: r["cer"] for r in QUERIES["cer_all"](spark, str(tmp_path)).collect()}
    assert rates == {k: None if h is None else round(compare.cer(t, h, lang), 6) for k, (t, h, lang) in enumerate(pairs)}
    lost = {r["check_id"]: (r["numbers"], r["words"]) for r in QUERIES["missing_words_all"](spark, str(tmp_path)).collect()}
    assert lost == {k: (None, None) if h is None else tuple(" ".join(x) for x in compare.missing_words(t or "", h, lang)) for k, (t, h, lang) in enumerate(pairs)}
    assert lost[1] == ("", "ящик") and lost[10] == ("two", "men")


def test_close_words_of_any_script(spark, tmp_path):
    from lectern.functions import compare
    from lectern.plans.queries import QUERIES

    texts = ["Лоцман лоцмана 12 похвалил, красная красной.", "the café — cafe’s 2nd walk walking", "老船长 老船長", "पुराना पुराने", "คนเรือเก่า คนเรือ", "", None, "один"]
    spark.createDataFrame([(t,) for t in texts], "text string").write.parquet(f"{tmp_path}/chunks.parquet")
    canonical = [r[0] for r in spark.read.parquet(f"{tmp_path}/chunks.parquet").select(compare.canon_simple(F.col("text"))).collect()]
    words = [[w for w in (t or "").split(" ") if w] for t in canonical]
    wanted = {(a, b, compare.close(a, b)) for w in words for a, b in zip(w, w[1:])}
    found = collected(QUERIES["close_words"](spark, str(tmp_path)))
    assert found == sorted(wanted, key=repr) and {("лоцман", "лоцмана", True), ("12", "похвалил", False), ("the", "café", False)} <= wanted


def test_attempts(spark):
    rows = [(1, 1, False, 0.5), (1, 2, True, 0.1), (2, 1, False, 0.30), (2, 2, False, 0.33), (3, 1, False, None), (3, 2, None, 0.4), (4, 1, False, 0.2), (4, 2, False, 0.9), (1, 2, True, 0.1)]
    df = spark.createDataFrame(rows, "chunk_id int, attempt int, ok boolean, cer double")
    assert [(r[0], r[2]) for r in collected(V.classify_attempts(df))] == [(1, "ok"), (2, "unverifiable_text"), (3, "synthesis_failure"), (4, "synthesis_failure")]
    assert collected(V.kept_attempt(df))[:2] == [(1, 2, True), (2, 2, False)]
    assert V.classify_attempts(df.limit(0)).count() == 0


def test_rate(spark):
    rows = [("a", k, 60, 4.0 if k < 15 else 2.0) for k in range(40)] + [("a", 100, 3, 1.0), ("b", 1, 50, None)]
    out = {r["k"]: r["rate"] for r in V.rate_calibration(spark.createDataFrame(rows, "g string, k int, chars int, seconds double"), "g", ["k"]).collect()}
    assert out[0] == out[11] == 15.0 and out[12] == 15.0 and out[39] == 30.0 and out[100] == 30.0 and out[1] == 15.0 and len(out) == 41
    assert V.rate_calibration(spark.createDataFrame([], "g string, k int, chars int, seconds double"), "g", ["k"]).count() == 0


def test_reports(spark):
    rows = spark.createDataFrame([("a", 0.1, 0.0, 1.0, True), ("a", None, None, 0.5, False), ("a", 0.3, 2.0, 0.5, None)], "backend string, cer double, rtf double, peak double, ok boolean")
    assert collected(R.backend_summary(rows, 10.0)) == [("a", 0.2, 0.3, 2.0, 1, 1, 20.0)]
    assert R.backend_summary(rows.limit(0), 1.0).count() == 0
    cells = spark.createDataFrame([("c", "x", "old", 2), ("c", "x", "new", 1), ("d", None, "q", 1)], "`case` string, b string, s string, o int")
    assert collected(R.pivot_first(cells, "case", "b", ["x", "y"], "s", "o")) == [("c", "new", "-"), ("d", "-", "-")]
    runs = spark.createDataFrame([(1, k, v) for k, v in enumerate([1, 1, 9, 1, 1, 1, None])] + [(2, 0, 9)], "u int, k int, v int")
    assert collected(R.longest_runs(runs, "u", ["k"], F.col("v") < 5)) == [(1, 3), (2, 0)]
    marks = spark.createDataFrame([("b", 1, 0.0005), ("b", 2, 1.0), ("b", 3, None)], "book string, k int, seconds double")
    assert [(r["start_ms"], r["end_ms"]) for r in R.chapter_markers(marks, "book", "k").orderBy("k").collect()] == [(0, 0), (0, 1000), (1000, 1000)]
    spans = spark.createDataFrame([(1, 0, 200), (2, 0, 10)], "u int, a long, b long")
    assert collected(R.strided_windows(spans, "u", "a", "b", 10, 40, 20, 30)) == [(1, 10), (1, 130), (1, 50), (1, 90)]


def test_split_does_not_depend_on_partitions(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    a, b = (collected(R.train_val_split(df.repartition(n), "k", 100, 7)) for n in (1, 7))
    assert a == b and sum(r[1] == "val" for r in a) == 100
    assert collected(R.train_val_split(df.limit(0), "k", 5, 1)) == []


def test_edits(spark):
    chunks = spark.createDataFrame([(1, "Да, он.", 700), (2, "Нет.", 350), (3, None, None)], "chunk_id int, text string, pause_ms int")
    edits = spark.createDataFrame([(1, 1, "Да — он!", "long"), (1, 2, "Да. Он.", None), (2, 3, " ", "short"), (9, 4, "x", None), (2, 5, "Нет.", None), (2, 6, "Да.", None)], "chunk_id int, edit_i int, text string, pause string")
    assert [r["outcome"] for r in G.judge_edits(chunks, edits, ["chunk_id"]).orderBy("edit_i").collect()] == ["accepted", "accepted", "blank", "unknown", "unchanged", "rejected"]
    assert collected(G.apply_edits(chunks, edits.filter("edit_i < 3"), ["chunk_id"])) == [(1, "Да. Он.", 700), (2, "Нет.", 350), (3, None, None)]


def test_whole_tables(spark, sf_dir, tmp_path):
    from lectern.functions import narration
    from lectern.plans.queries import QUERIES

    rows = [(1, "EN", "Dr. May, e.g. etc."), (2, "en", "see Mr. Fox"), (3, "RU", "Хлеб и Т.Д. на стр. 5"), (4, "ru", "т. е. он"), (5, "de", "Dr. May"), (6, "en", None)]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    wanted = [(k, lang.lower(), narration.expand_abbreviations(t, lang.lower())) for k, lang, t in rows[:4]]
    assert collected(QUERIES["abbreviations"](spark, str(tmp_path))) == wanted
    chunks = spark.read.parquet(f"{sf_dir}/chunks.parquet")
    assert collected(QUERIES["judged_edits"](spark, sf_dir).select("chunk_id")) == collected(chunks.select("chunk_id"))
    assert QUERIES["cer_simple"](spark, sf_dir).count() == QUERIES["cer_all"](spark, sf_dir).count()


def test_edit_cache(spark):
    chunks = spark.createDataFrame([(1, "g", "Да."), (2, "g", "Нет."), (3, "h", "Да.")], "chunk_id int, chapter string, text string")
    edits = spark.createDataFrame([(1, 1, "Да!", "long"), (2, 2, "Да.", None)], "chunk_id int, edit_i int, text string, pause string")
    out = {r["chapter"]: json.loads(r["json"]) for r in G.edit_cache(G.judge_edits(chunks, edits, ["chunk_id"]), chunks, "chapter", "chunk_id", ["chunk_id"], "m").collect()}
    assert out["g"]["edits"] == [{"i": 1, "text": "Да!", "pause": "long"}] and out["g"]["rejected"] == [{"i": 2, "text": "Да."}] and out["g"]["chunks"] == 2
    assert out["h"]["chunks"] == 1 and "edits" not in out["h"]


def test_groups_in_order(spark):
    rows = [("a", k, "слово " * 10, k % 3 == 2) for k in range(9)] + [("b", 1, "x", None)]
    df = spark.createDataFrame(rows, "g string, k int, text string, is_paragraph_end boolean")
    assert [r[1] for r in collected(G.passage(df, "g", "k", 9.0).filter("g = 'a'"))] == [0, 1, 2]
    assert G.passage(df, "g", "k", 9.0).filter("g = 'b'").count() == 1
    assert collected(G.batches(df, "g", "k", 4).groupBy("g", "batch").count()) == [("a", 0, 4), ("a", 1, 4), ("a", 2, 1), ("b", 0, 1)]
    assert collected(G.ordered_digest(df.repartition(5), "g", "k")) == collected(G.ordered_digest(df.coalesce(1), "g", "k"))


def test_inspect_and_chunks(spark):
    df = spark.createDataFrame([(1, "ru", "Он пошёл. Да!\n\nчетыре."), (2, None, None), (3, "en", ""), (3, "en", "")], "doc_id long, lang string, text string")
    assert collected(G.inspect_by(df, ["lang"])) == [("en", 2, 0, 0, 0.0, 0.0), ("ru", 1, 21, 3, 21.0, round(21 / 54000, 6)), (None, 1, 0, 0, None, 0.0)]
    assert [(r["doc_id"], r["text"]) for r in G.chunk_documents(df, "doc_id").collect()] == [(1, "Он пошёл. Да! четыре.")]
    with pytest.raises(ValueError):
        G.chunk_documents(df, "doc_id", latin="no")


def test_dictionaries_and_corpora(spark, tmp_path):
    (tmp_path / "d.txt").write_text("# all\nИоган = Йоган # name\n\nx\na=b=c\nИоган = Ёган\n = z\n", encoding="utf-8")
    assert collected(files.key_value_file(spark, str(tmp_path / "d.txt"))) == [("a", "b=c"), ("Иоган", "Ёган")]
    (tmp_path / "c.txt").write_text("a.wav|hello|1\nbad\nb.wav| there \n", encoding="utf-8")
    assert collected(files.piped_corpus(spark, str(tmp_path / "c.txt"), "w/")) == [("w/a.wav", "hello"), ("w/b.wav", "there")]
    meta = spark.createDataFrame([("a", "x"), ("q", "y")], "stem string, text string")
    assert collected(files.corpus_by_stem(meta, spark.createDataFrame([("d/a.wav",)], "path string"))) == [("d/a.wav", "x")]
    assert collected(files.word_list(spark, None, ["a", "b"])) == [("a",), ("b",)]


def test_reports_audio_and_probes(spark, tmp_path):
    for k in (2, 1):
        (tmp_path / f"gen_{k}.json").write_text(json.dumps([{"backend": f"b{k}", "case": "c", "seconds": 1.0}]), encoding="utf-8")
    assert [(r["report"], r["backend"]) for r in files.json_reports(spark, f"{tmp_path}/gen_*.json").orderBy("report").collect()] == [("gen_1.json", "b1"), ("gen_2.json", "b2")]
    with wave.open(str(tmp_path / "x.wav"), "wb") as out:
        out.setnchannels(2)
        out.setsampwidth(2)
        out.setframerate(8)
        out.writeframes(b"\x00\x40\x00\x00" * 16)
    (tmp_path / "y.wav").write_bytes(b"nothing")
    found = {r["path"][-5:]: r for r in files.wav_files(spark, str(tmp_path)).collect()}
    assert found["x.wav"]["seconds"] == 2.0 and found["x.wav"]["audio"][0] == 0.25 and found["y.wav"]["audio"] is None
    probe = json.dumps({"format": {"duration": "9.5", "tags": {"MEDIA_TYPE": "2", "Title": "t"}}, "streams": [{"codec_type": "audio", "codec_name": "mp3"}]})
    df = spark.createDataFrame([("f", probe), ("g", None)], "file string, probe string")
    problems = [r[0] for r in df.orderBy("file").select(R.container_problems(files.probe_struct(F.col("probe")))).collect()]
    assert problems == [["no chapters", "audio codec is mp3, expected aac", "no cover art"], ["media_type is not 2", "no chapters", "no audio stream", "no title tag", "no cover art"]]
    assert collected(files.probe_chapters(df.filter("file = 'f'"))) == [("f", 0, 0.0, 9.5)]
    files.html_table(spark.createDataFrame([("<a>",), (None,)], "x string"), str(tmp_path / "table"))
    lines = sorted(r[0] for r in spark.read.text(str(tmp_path / "table")).collect())
    assert lines == ["<table><tr><th>x</th></tr>", '<tr><td class="">&lt;a&gt;</td></tr>', '<tr><td class=""></td></tr>'] or len(lines) == 3 and any("&lt;a&gt;" in x for x in lines)


def book(path, toc=True):
    ns = 'xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/"'
    items = '<item id="a" href="a.xhtml" media-type="application/xhtml+xml"/><item id="b" href="b.xhtml" media-type="application/xhtml+xml"/><item id="img" href="Cover.jpg" media-type="image/jpeg"/>'
    if toc:
        items += '<item id="n" href="toc.ncx" media-type="application/x-dtbncx+xml"/>'
    page = lambda body: f'<html xmlns="http://www.w3.org/1999/xhtml"><body>{body}</body></html>'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="o/c.opf"/></rootfiles></container>')
        z.writestr("o/c.opf", f'<package {ns}><metadata><dc:title>T  t</dc:title><dc:language>RU</dc:language></metadata><manifest>{items}</manifest><spine><itemref idref="a"/><itemref idref="b"/><itemref idref="none"/></spine></package>')
        z.writestr("o/a.xhtml", page('<h1 id="x">One</h1><div><p>First [1] text.</p></div><h1 id="y">Two</h1><p>Second.</p>'))
        z.writestr("o/b.xhtml", page(f"<p>{'long text ' * 60}</p>"))
        point = lambda name, src, inner="": f'<navPoint><navLabel><text>{name}</text></navLabel><content src="{src}"/>{inner}</navPoint>'
        z.writestr("o/toc.ncx", f'<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/"><navMap>{point("One", "a.xhtml#x", point("2", "a.xhtml#y"))}{point("Contents", "a.xhtml")}</navMap></ncx>')


def test_epub(spark, tmp_path):
    book(tmp_path / "k.epub")
    (tmp_path / "bad.epub").write_bytes(b"no zip")
    books = epub.read_epubs(spark, str(tmp_path))
    rows = {r["path"][-6:]: r for r in books.collect()}
    assert rows["k.epub"]["title"] == "T t" and rows["k.epub"]["language"] == "ru" and "not an EPUB" in rows["d.epub"]["warnings"][0]
    assert sorted(r["cover"] for r in epub.cover_of(books).collect()) == ["", "o/Cover.jpg"]
    found = [(r["chapter_index"], r["title"], r["paragraphs"][0][:10], len(r["warnings"])) for r in epub.chapters(books).orderBy("chapter_index").collect()]
    assert found == [(1, "One", "First text", 0), (2, "One — 2", "Two", 0), (3, "b", "long text ", 1)]


def test_covers_and_json(spark, tmp_path):
    book(tmp_path / "k.epub")
    assert [(r["cover"], r["content"]) for r in epub.cover_images(epub.archives(spark, str(tmp_path))).collect()] == [("o/Cover.jpg", None)]
    books = epub.read_epubs(spark, str(tmp_path))
    out = json.loads(epub.book_json(books, epub.chapters(books)).first()["json"])
    assert out["title"] == "T t" and [c["title"] for c in out["chapters"]] == ["One", "One — 2", "b"] and out["char_count"] == sum(c["char_count"] for c in out["chapters"])


def test_contracts(spark):
    from lectern.operators import contracts

    def voice():
        return lambda text, lang, seed: ([0.1 * seed, float("nan")] * len(text), 8000)

    def ears():
        return lambda audio, rate, lang: f"{len(audio)} {rate} {lang}"

    chunks = spark.createDataFrame([(1, "g", "да", "ru"), (2, "g", "", "ru")], "k int, g string, text string, lang string")
    made = contracts.synthesise(chunks, voice, retries=1)
    assert [(r["k"], r["attempt"], r["audio"][:2]) for r in made.orderBy("k", "attempt").collect()] == [(1, 1, [0.0, 0.0]), (1, 2, [100.0, 0.0]), (2, 1, []), (2, 2, [])]
    heard = [r["heard"] for r in contracts.transcribe(made.withColumn("sample_rate", F.lit(100)), ears).orderBy("k", "attempt").collect()]
    assert heard == ["10240 16000 ru", "10240 16000 ru", None, None]
    marked = contracts.mark(spark.createDataFrame([("да",), ("д+а",), (None,)], "text string"), lambda: lambda t: t + "!")
    assert [r["marked"] for r in marked.collect()] == ["да!", "д+а", None]

    def editor():
        def run(rows):
            if rows[0][0] == 2:
                raise RuntimeError
            return [(i, t.upper(), None) for i, t in rows]

        return run

    assert collected(contracts.edit(chunks, "g", "k", editor, size=1)) == [("g", 1, 0, "ДА", None, False), ("g", None, None, None, None, True)]


def fake_voice():
    def say(text, lang, seed):
        # The first attempt at a long text is silent.
        level = 0.0 if seed == 0 and len(text) > 100 else 0.3
        return [level, -level] * int(50 * (0.55 + len(text) / 15.0)), 100

    return say


def test_conversion(spark, tmp_path, monkeypatch, capsys):
    import lectern.__main__ as cli
    from lectern.operators import pipeline

    (tmp_path / "in").mkdir()
    book(tmp_path / "in" / "k.epub")
    books = epub.read_epubs(spark, str(tmp_path / "in"))
    made = pipeline.convert(books, str(tmp_path / "out"), fake_voice, None, pipeline.Options(retries=1, sample_rate=100))
    report = {r["chapter_index"]: r for r in made["report"].collect()}
    assert sorted(report) == [1, 2, 3] and report[1]["retries"] == 0 and report[3]["retries"] == report[3]["chunks"] > 1
    assert made["problems"].count() == 0 and "title=One — 2" in made["metadata"].first()["metadata"]
    assert [r[0] > 1.6 for r in made["chapters"].select("seconds").collect()] == [True] * 3
    monkeypatch.setattr(cli, "local_session", lambda: spark)
    assert cli.main(["inspect", str(tmp_path / "in"), "--chapters", "1-2"]) == 0
    assert cli.main(["convert", str(tmp_path / "in"), str(tmp_path / "two"), "--voice", "test_operators:fake_voice", "--chapters", "1", "--sample-rate", "100", "--retries", "0"]) == 0
    out = capsys.readouterr().out
    assert out.count("k.epub") >= 2
    (tmp_path / "none").mkdir()
    assert cli.main(["inspect", str(tmp_path / "none")]) == 2
    assert cli.main(["edit", str(tmp_path / "in"), str(tmp_path / "e"), "--editor", "test_operators:fake_editor"]) == 0 and "accepted" in capsys.readouterr().out
    assert cli.main(["edit", str(tmp_path / "in"), str(tmp_path / "e"), "--lang", "en", "--editor", "test_operators:fake_editor"]) == 2
    with pytest.raises(SystemExit) as wrong:
        cli.main(["convert", "x", "y", "--voice", "nothing:here"])
    assert wrong.value.code == 2


def fake_editor():
    return lambda rows: [(i, t.replace(".", "!"), None) for i, t in rows]


def test_marking_contracts(spark):
    from lectern.operators import contracts

    texts = spark.createDataFrame([("Дорога после дождя",), (None,)], "text string")
    marked = contracts.mark_stress(texts, lambda: (lambda t: t.replace("орога", "ор+ога"), lambda w: w.replace("о", "+о", 1)))
    assert [r["marked"] for r in marked.collect()] == ["Дор+ога п+осле д+ождя", None]
    acute = contracts.mark_acute(spark.createDataFrame([("ла\u0301мпа горела",), (None,)], "text string"), lambda: lambda t: t.replace("горела", "гор+ела"))
    assert [r["marked"] for r in acute.collect()] == ["ла\u0301мпа горе\u0301ла", None]
    said = contracts.phonemise(spark.createDataFrame([("Да... нет – ок, 5",), (None,)], "text string"), lambda: lambda w: "" if w == "ок" else w.upper())
    assert [r["phonemes"] for r in said.collect()] == ["ДА… НЕТ—,", None]


def test_assembly(spark):
    from lectern.operators import contracts

    rows = [("a", 2, [0.5] * 300, 100), ("a", 1, [0.0] * 50, 70), ("a", 3, None, 5), ("b", 1, None, None)]
    out = {r["g"]: r for r in contracts.assemble(spark.createDataFrame(rows, "g string, k int, audio array<double>, pause_ms int"), "g", "k", 1000).collect()}
    assert out["a"]["seconds"] == 2.0 and out["b"]["seconds"] == 1.6 and out["a"]["clamped"] == 0
    assert abs(out["a"]["rms_after"] + 20) < 0.01 and len(out["a"]["audio"]) == 2000 and max(out["b"]["audio"]) == 0
    assert contracts.assemble(spark.createDataFrame([], "g string, k int, audio array<double>, pause_ms int"), "g", "k", 1000).count() == 0


def test_headroom_is_linear(spark):
    import time

    from lectern.functions import arrays as A

    def seconds(n):
        rows = spark.range(4).select(A.headroom(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: F.sin(k * F.col("id")) * 3)).alias("x"))
        began = time.perf_counter()
        rows.write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    seconds(1000)
    assert seconds(160_000) < 15


def test_unicode(spark):
    from lectern.functions import unicode as U

    df = spark.createDataFrame([("e\u0301ß",), ("plain",), (None,)], "t string")
    assert [r[0] for r in df.select(U.normalized(F.col("t"))).collect()] == ["éß", "plain", None]
    assert [r[0] for r in df.select(U.casefolded(F.col("t"))).collect()] == ["e\u0301ss", "plain", None]


def test_epub_without_contents(spark, tmp_path):
    book(tmp_path / "k.epub", toc=False)
    found = [(r["chapter_index"], r["title"], len(r["paragraphs"])) for r in epub.chapters(epub.read_epubs(spark, str(tmp_path))).orderBy("chapter_index").collect()]
    assert found == [(1, "a", 4), (2, "b", 1)]
    assert epub.html_paragraphs("<p>a<b>b</b></p>") == ["ab"] and epub.html_paragraphs("<p>") == []


def test_stream_agrees_with_batch(spark, sf_dir, tmp_path):
    batch = spark.read.parquet(f"{sf_dir}/events.parquet")
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = events.windowed_counts(events.read_events(spark, str(tmp_path / "in")), late="3650 days")
    run = stream.writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "state")).start()
    run.processAllAvailable()
    run.stop()
    assert collected(spark.table("windows")) == collected(events.windowed_counts(batch))


def workers_in(df):
    """How often the plan of a query sends rows to Python, and how many joins it has."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return plan.count("MapIn") + plan.count("ArrowEvalPython"), plan.count("Join ")


def test_chapters_open_each_archive_once(spark, sf_dir, tmp_path):
    from lectern.plans import sources

    assert workers_in(sources.epub_chapters(spark, sf_dir)) == (1, 0)
    book(tmp_path / "k.epub")
    (tmp_path / "bad.epub").write_bytes(b"no zip")
    made = epub.chapters(epub.read_epubs(spark, str(tmp_path)))
    assert workers_in(made) == (2, 0)
    assert collected(epub.archive_chapters(epub.archives(spark, str(tmp_path)))) == collected(made) and made.count() == 3


def test_entries_are_looked_up_in_their_files():
    manifest = [{"id": i, "href": h} for i, h in (("a", "o/a"), ("b", "o/b"), ("b", "o/c"), ("d", ""), ("e", "o/e"))]
    toc = [{"nav_path": ["x"], "file": "o/a", "anchor": "x"}, {"nav_path": ["x again"], "file": "o/a", "anchor": "x"}, {"nav_path": ["lost"], "file": "o/a", "anchor": "z"}, {"nav_path": ["f"], "file": "o/f", "anchor": ""}]
    places = epub._Places("k", manifest, ["b", "a", "none", "b", "e"], toc)
    found = lambda file, page: [(r["loose"], r["position"], r["entry"], r["nav_path"], r["paragraphs"]) for r in places.rows(file, page)]
    assert found("o/a", [("", "before"), ("x", "1"), ("y", "2"), ("x", ""), ("x", "3")]) == [(False, 1, 0, ["x"], ["1", "3"]), (False, 1, 1, ["x again"], ["1", "3"])]
    assert found("o/f", [("", "t")]) == [(False, 1_000_000, 3, ["f"], ["t"])]  # outside the spine
    long = [("", "t" * 501)]
    assert found("o/c", long) == [(True, 0, 0, [], ["t" * 501])] and found("o/e", [("", "t" * 500)]) == [] and found("o/g", long) == []
    assert [r["nav_path"] for r in epub._Places("k", manifest, ["a"], []).rows("o/a", [("", "t")])] == [None]


def test_long_books_leave_the_worker_in_parts():
    row = {**dict.fromkeys(epub._FOUND.names), "book_id": "k", "paragraphs": ["t" * 100_000]}
    batches = list(epub._batched(iter([row] * 25)))
    assert len(batches) > 2 and sum(b.num_rows for b in batches) == 25


def test_records_open_each_archive_once(spark, sf_dir, tmp_path):
    from lectern.plans import sources

    assert workers_in(sources.epub_json(spark, sf_dir)) == (1, 0)
    book(tmp_path / "k.epub")
    book(tmp_path / "without.epub", toc=False)
    (tmp_path / "bad.epub").write_bytes(b"no zip")
    books = epub.read_epubs(spark, str(tmp_path))
    found = collected(epub.archive_json(epub.archives(spark, str(tmp_path))))
    assert found == collected(epub.book_json(books, epub.chapters(books))) and len(found) == 3
    none = next(json.loads(text) for path, text in found if path.endswith("bad.epub"))
    assert "chapters" not in none and "not an EPUB" in none["warnings"][0]

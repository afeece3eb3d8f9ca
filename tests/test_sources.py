import json

import pytest

from lociflow.operators import tablecipher, views
from lociflow.sources import conllu, ivtff, sinks, tei

FILE = """#=IVTFF Eva- 2.0
# a comment
<f1r>      <! $Q=A $L=A>
<f1r.1,@P0;H>  <%>da?in.chedy,{cth}y<->Qoky.[a:o]l.@130;
<f1r.2,+P0>  <@L=B>otal.<! note % >ol/
/aiin.d'y<$>

<f1r.3,+P0>  dal
<f1v> <! $Q=B>
<f1v.1,@Lf>  ar.3x
"""


def write(tmp_path, text, name="ZL_x.txt"):
    p = tmp_path / name
    p.write_text(text)
    return str(p)


def test_ivtff(spark, tmp_path):
    rows = ivtff.read_ivtff(spark, write(tmp_path, FILE)).orderBy("source_order").collect()
    got = [(r.locus, r.kind, r.transcriber, r.tokens, r.excluded_tokens, r.metadata, r.paragraph_start, r.paragraph_end) for r in rows]
    assert got == [
        ("f1r.1,@P0", "P0", "H", ["chedy", "cthy", "qoky"], 3, {"Q": "A", "L": "A"}, True, False),
        ("f1r.2,+P0", "P0", "ZL", ["otal", "olaiin"], 1, {"Q": "A", "L": "B"}, False, True),
        ("f1r.3,+P0", "P0", "ZL", ["dal"], 0, {"Q": "A", "L": "B"}, False, False),
        ("f1v.1,@Lf", "Lf", "ZL", ["ar"], 1, {"Q": "B"}, False, False),
    ]
    joined = ivtff.read_ivtff(spark, write(tmp_path, FILE), "join").orderBy("source_order").first()
    assert joined.tokens == ["chedycthy", "qoky"]
    with pytest.raises(ValueError):
        ivtff.filter_transcriber(ivtff.read_ivtff(spark, write(tmp_path, FILE)))


@pytest.mark.parametrize("bad", ["<f1r.1,@P0> a(b", "<f1r.1,@P0> a[b}:c]d", "<f1r.1,@P0> a{b{th}}", "<f1r.1,@P0> a{}b", "nonsense", "<f2r.1,@P0> ok", "/ alone"])
def test_ivtff_refuses(spark, tmp_path, bad):
    with pytest.raises(Exception, match="unexpected"):
        ivtff.read_ivtff(spark, write(tmp_path, f"#=IVTFF Eva- 2.0\n<f1r>\n{bad}\n")).collect()


CONLLU = """# newdoc id = d1
# sent_id = s1
1-2\tdelle\t_\t_\t_\t_\t_\t_\t_\t_
1\tdi\t_\tADP\t_\t_\t_\t_\t_\t_
2\tle\t_\tDET\t_\t_\t_\t_\t_\t_
2.1\tx\t_\t_\t_\t_\t_\t_\t_\t_
3\tcose\t_\tNOUN\t_\t_\t_\t_\t_\t_
4\t.\t_\tPUNCT\t_\t_\t_\t_\t_\t_

# newdoc id = d2
1\tsola\t_\tX\t_\t_\t_\t_\t_\t_
"""


def test_conllu(spark, tmp_path):
    rows = conllu.read_conllu(spark, write(tmp_path, CONLLU, "a.conllu")).orderBy("sentence").collect()
    assert [(r.document, r.words, r.surface, r.excluded, r.empty_nodes, r.components, r.multiword, r.punct) for r in rows] == [
        ("d1", ["delle", "cose"], ["delle", "cose", "."], 1, 1, 2, 1, 1),
        ("d2", ["sola"], ["sola"], 0, 0, 0, 0, 0),
    ]
    for bad in ("2-3", "1-1"):
        with pytest.raises(ValueError):
            list(conllu.sentences("1-2\ta" + "\t_" * 8 + f"\n{bad}\tb" + "\t_" * 8 + "\n"))
    assert next(conllu.sentences("# newdoc\n1\ta" + "\t_" * 8 + "\n"))[2] == "document-line-1"
    counts = conllu.extract_text(conllu.read_conllu(spark, write(tmp_path, CONLLU, "a.conllu")), str(tmp_path / "plain"))
    assert counts == {"sentences": 2, "surface": 4, "excluded": 1, "punct": 1}


def test_partitions_and_documents(spark, tmp_path):
    import hashlib

    row = lambda *words: "".join(f"{k}\t{w}" + "\t_" * 8 + "\n" for k, w in enumerate(words, 1)) + "\n"
    parts = {"train": "# newdoc id = a\n" + row("Āmō", ".") + row("x"), "validation": "# newdoc id = b\n" + row("amo") + row("novus"), "test": "# newdoc id = c\n" + row("novus") + row("amo", "te")}
    files = {}
    for split, text in parts.items():
        path = write(tmp_path, text, f"{split}.conllu")
        files[path] = (split, hashlib.sha256(text.encode()).hexdigest())
    got = sorted((r.split, tuple(r.words)) for r in conllu.load_partitions(spark, files).collect())
    assert got == [("test", ("amo", "te")), ("train", ("amo",)), ("train", ("x",)), ("validation", ("novus",))]
    with pytest.raises(ValueError):
        conllu.load_partitions(spark, {path: ("test", "0")})
    sents = spark.createDataFrame([(1, "x document_id='d 7' y", "OldItalian_Dante_Inferno-3"), (2, None, None)], "sentence long, reference string, sent_id string")
    assert sents.where("sentence = 1").select(conllu.reference_document("latin_llct"), conllu.reference_document("italian_old")).first()[:] == ("d 7", "Inferno")
    with pytest.raises(Exception, match="no document"):
        sents.select(conllu.reference_document("latin_llct")).collect()


TEI = """<TEI xmlns="http://www.tei-c.org/ns/1.0" xml:lang="la"><teiHeader><fileDesc><title>On things</title></fileDesc></teiHeader><text><body><div type="edition">
<div subtype="book" n="1"><head>B</head><div subtype="chapter" n="2"><head>H</head><pb/>
<p>One <choice><sic>wrd</sic><corr>word</corr></choice>  he<hi>re</hi><note>n</note>.</p><p> </p><p>T<choice><sic>v</sic><corr>w</corr></choice>o <foreign xml:lang="grc">x</foreign> <del>gone</del></p></div></div></div></body></text></TEI>"""


def test_tei(spark, tmp_path):
    path = write(tmp_path, TEI, "a.xml")
    rows = tei.read_tei(spark, path).collect()
    assert [(r.chapter_key, r.local_paragraph_ordinal, r.text) for r in rows] == [("1:2", 1, "One word here."), ("1:2", 2, "Two")]
    assert len(list(tei.project(TEI, empty_policy="include"))) == 3
    assert list(tei.project(TEI)) == list(tei.project_by_events(TEI)) and list(tei.project(TEI, "", "include")) == list(tei.project_by_events(TEI, "", "include"))
    for old, new in [("</hi><note>n</note>.", "</hi><note>n</note>re."), ("<pb/>", "<lb/>"), ('<head>B</head>', "<p>stray</p>"), ('<head>B</head>', "<note><p>stray</p></note>"), ('n="2"', ""), ('lang="grc"', 'lang="la"'), ("<corr>w</corr>", "")]:
        assert old in TEI
        with pytest.raises(ValueError):
            list(tei.project(TEI.replace(old, new)))
    counts = {(r.fate, r.tag): r.n for r in tei.projection_counts(spark, path).collect()}
    assert counts["agrees", ""] == 1 and counts["kept", "p"] == 3 and counts["dropped", "sic"] == 2 and counts["dropped", "foreign"] == 1
    audit = {r.tag: r for r in tei.audit_tags(spark, path).collect()}
    assert audit["p"].n == 3 and audit["p"].title == "On things" and audit["p"].language == "la" and audit["choice"].inside_words == 1
    many = spark.createDataFrame([("f", str(b), "1", f"{b}:1", k, "t") for b in (1, 2) for k in range(1, 41)], tei.SCHEMA)
    assert sorted((r.book_id, r.local_paragraph_ordinal) for r in tei.review_sample(many).collect()) == [("1", 1), ("1", 36), ("1", 40), ("2", 1), ("2", 32), ("2", 40)]


def test_files_to_queries(spark, tmp_path):
    from lociflow.plans import catalog, statistics

    text = "#=IVTFF Eva- 2.0\n<f1r> <! $I=H $L=A $H=1>\n<f1r.1,@P0> <%>fachys.ykal,ar.<!note>shol<$>\n<f1r.2,+P0> foo.[bar:baz].qu?x.okay.???\n<f1r.3,@Lf> y\u00a0kal.ol.dy\n<f1r.4,+P0> a.b<->c.d\n<f2v> <! $I=S>\n<f2v.1,@P0> kedy.kedy.kedy\n"
    records = ivtff.read_ivtff(spark, write(tmp_path, text))
    records.write.parquet(str(tmp_path / "loci.parquet"))
    run = lambda name: catalog.QUERIES[name](spark, str(tmp_path))
    r = run("inventory").first()
    assert (r.records, r.folios, r.tokens, r.excluded) == (5, 2, 16, 3)
    assert {(r.reason, r.records) for r in run("elig_context").collect()} == {("eligible", 2), ("excluded_tokens", 1), ("not_paragraph", 1), ("interrupted_line", 1)}
    assert {(r.label, r.value): r.tokens for r in run("inventory_by").collect()}["I", "H"] == 13
    assert statistics.ELIGIBLE and [r.tokens for r in records.where("source_order = 4").collect()] == [["ykal", "ol", "dy"]]
    both = ivtff.union_sources(spark, [write(tmp_path, text), write(tmp_path, text, "IT_x.txt")])
    assert both.count() == 10 and both.select("locus_id").distinct().count() == 10
    both.write.parquet(str(tmp_path / "both" / "loci.parquet"))
    assert catalog.QUERIES["key_unique"](spark, str(tmp_path / "both")).count() == 5


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0, "x"), ("b", float("inf"), "y")], "name string, v double, text string")
    assert {tuple(r) for r in sinks.export_public(df, ["name", "v"]).collect()} == {("a", 1.0), ("b", None)}
    with pytest.raises(ValueError):
        sinks.export_public(df, ["name", "text"])
    run = str(tmp_path / "run")
    sinks.write_run(df, {"b": 1, "a": 2}, "# Report\n", run)
    assert json.loads((tmp_path / "run" / "analysis.json").read_text()) == {"a": 2, "b": 1}
    with pytest.raises(FileExistsError):
        sinks.write_run(df, {}, "", run)
    sums = dict(reversed(x.split("  ")) for x in (tmp_path / "run" / "SHA256SUMS").read_text().splitlines())
    got = {r.file: r.matches for r in sinks.verify_hashes(spark, run + "/*", {**sums, "gone": "0"}).collect()}
    assert got == {"REPORT.md": True, "analysis.json": True, "gone": False}
    assert sinks.assert_schema(df, "name string, v double, text string").columns == ["name", "v", "text"]
    with pytest.raises(ValueError):
        sinks.assert_schema(df, "name string")
    assert "| a | 1.0 | x |" in sinks.render_table(df)
    assert sinks.render_report("T", {"A": df, "B": "words"}).startswith("# T\n\n## A\n\n| name")
    nested = spark.createDataFrame([(1, {"v": float("nan"), "text": "x", "path": "p"}, [("/abs/x", 1.0), ("rel", float("inf"))], {"tokens": 1, "n": 2})], "id long, s struct<v:double,text:string,path:string>, a array<struct<file:string,w:double>>, m map<string,int>")
    out = sinks.export_public(nested, ["id", "s", "a", "m"]).first()
    assert out.s.asDict() == {"v": None} and [tuple(x) for x in out.a] == [(None, 1.0), ("rel", None)] and out.m == {"n": 2}
    to = str(tmp_path / "public")
    first = sinks.export_runs(spark, {"one": df}, {"one": ["name", "v"]}, to)
    with pytest.raises(FileExistsError):
        sinks.export_runs(spark, {"one": df}, {"one": ["name"]}, to)
    assert sinks.export_runs(spark, {"one": df.orderBy("v")}, {"one": ["name", "v"]}, to, replace=True) == first


def test_freeze(spark, tmp_path):
    from lociflow.sources import freeze

    path = write(tmp_path, "words", "in.txt")
    manifest = freeze.freeze(spark, [path], {"seed": 408})
    freeze.verify_freeze(spark, manifest, {"seed": 408})
    for bad, settings in [(manifest, {"seed": 409}), ({**manifest, "settings": {"seed": 409}}, {"seed": 409}), ({"files": {}}, {})]:
        with pytest.raises(ValueError):
            freeze.verify_freeze(spark, bad, settings)
    write(tmp_path, "other", "in.txt")
    with pytest.raises(ValueError, match="changed files"):
        freeze.verify_freeze(spark, manifest, {"seed": 408})
    keys = spark.createDataFrame([("a", "b")], "u string, letter string")
    assert freeze.fit_before_test(keys, lambda k: k.where("u = 'a'")).count() == 1
    with pytest.raises(Exception, match="exist"):
        freeze.fit_before_test(keys, lambda k: k, str(tmp_path))
    assert freeze.supervise(spark, lambda: keys.count(), 60) == ("finished", 1)
    assert freeze.supervise(spark, lambda: 1 / 0, 60)[0] == "failed"
    from pyspark.sql import functions as F

    slow = spark.range(0, 40, 1, 40).where(F.expr("java_method('java.lang.Thread', 'sleep', 2000L) is null"))
    assert freeze.supervise(spark, slow.count, 1)[0] in ("timed_out", "failed")
    assert freeze.read_literals("import os\nX = {'f1r': {'B': 1}}\n", "X") == {"f1r": {"B": 1}}
    for bad in ("X = 1", "X = {}", "X = {1: 2}\nX = {3: 4}", "X = os.environ"):
        with pytest.raises(ValueError):
            freeze.read_literals(bad, "X")
    assert freeze.literal_rows(spark, "X: dict = {'f1r': {'B': 1}, 'f2': 'g'}", "X").count() == 2


def test_table_cipher_round_trip(spark, tmp_path):
    book = tablecipher.rule_book(spark)
    df = spark.createDataFrame([(1, "Ægri somnia, wæs Kïng"), (2, None), (3, "")], "id long, text string")
    tokens = tablecipher.encrypt(df, "id", "text", book)
    rows = tokens.orderBy("place").collect()
    assert "".join(r.plain for r in rows) == "aegrisomniauuaescing" and {r.id for r in rows} == {1}
    reads = {(r.w, r.plain) for r in tablecipher.readings(tokens.withColumnRenamed("token", "w"), book).collect()}
    assert all((r.token, r.plain) in reads for r in rows)
    again = tablecipher.encrypt(df, "id", "text", book, deck=tablecipher.DECK_78, policy="full").orderBy("place").collect()
    assert "".join(r.plain for r in again) == "aegrisomniauuaescing"
    import random

    codes = {(s, t, x): g for s, g in (("unigram", "ab"), ("prefix", "a"), ("suffix", "b")) for t in tablecipher.TABLES for x in "xy"}
    codes |= {("prefix", "gamma1", x): "p" + x for x in "xy"}
    bad = tablecipher.refused(codes, "unigram")
    assert bad == {"ab"} and "ab" in tablecipher.refused(codes, "full") and tablecipher.refused(codes, "none") == set()
    made = tablecipher.encrypt_text("xy" * 60, codes, random.Random(1), tablecipher.DECK, bad)
    assert "".join(p for _, p, _ in made) == "xy" * 60 and all(t.startswith("p") for t, p, _ in made if len(p) == 2)
    with pytest.raises(ValueError):
        tablecipher.encrypt_text("xy" * 60, codes, random.Random(1), tablecipher.DECK, {"ab", "pxb", "pyb"}, 50)
    csv = tmp_path / "book.csv"
    csv.write_text("code,glyphs\n" + "".join(f"{r.state}_{r.tbl}_{r.letter},{r.glyphs}\n" for r in book.collect()))
    assert tablecipher.read_book(spark, str(csv)).count() == 414
    csv.write_text("code,glyphs\nunigram_alpha_a,x\n")
    with pytest.raises(ValueError):
        tablecipher.read_book(spark, str(csv))


def test_views_handle_nulls(spark):
    schema = "locus_id long, source_order long, volume_id long, line_group string, folio string, locus string, kind string, transcriber string, scribe string, text_raw string, tokens array<string>, metadata map<string,string>, excluded_tokens int, grp string"
    rows = [(1, 1, 2, None, "fRos", "fRos.3", "+P0", None, None, None, ["A b", "Ab", None, ""], None, 0, "clash"), (1, 1, 2, None, "fRos", "fRos.3", "+P0", None, None, None, ["A b", "Ab", None, ""], None, 0, "clash"), (2, None, None, None, None, None, None, None, None, None, None, None, None, None), (None,) * 14]
    got = {r.locus_id: r for r in views.records(spark.createDataFrame(rows, schema)).collect()}
    assert got[1].words == ["ab"] and got[1].excluded == 1 and got[1].folio_no == 85 and got[1].grp == "2:85" and got[1].idx == 3
    assert got[2].nw == 0 and got[2].split is None and len(got) == 2


def test_strict_spans():
    from lociflow.operators.spans import source_letters, word_spans

    said = lambda t: [(s, r) for *_, s, r in word_spans(t)]
    assert said("foo,bar.baz") == [("foo", "uncertain_space"), ("bar", "uncertain_space"), ("baz", None)]
    assert said("<%>ab.c d.e[a:o]f.{cth}y.o?k.d'y.@130;a.Ab.x9") == [
        ("ab", "inline_control"), ("c d", "interior_whitespace"), ("e[a:o]f", "uncertain_reading"), ("{cth}y", "ligature"), ("o?k", "uncertain_reading"),
        ("d'y", "apostrophe"), ("@130;a", "high_ascii"), ("Ab", "uppercase"), ("x9", "other_construct"),
    ]
    assert said("ab<->cd.<~>.ef é") == [("ab<->cd", "diagram_marker"), ("ef é", "non_ascii")]
    assert said("ab <!note") == [("ab <!note", "incomplete_span")] and said("") == [] and said(" ab .") == [("ab", None)]
    assert [(a, b) for _, a, b, _, _ in word_spans(" ab .cd")] == [(1, 3), (5, 7)]
    assert source_letters("<%>fach{ys}.Ar,<!n>o") == [("fachys", [3, 4, 5, 6, 8, 9]), ("ar", [12, 13]), ("o", [19])] and source_letters("a?b") is None

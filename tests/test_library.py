import io
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliant.functions import text as tx
from foliant.operators import chunker, intake, layout
from foliant.sources import files
from foliant.sources.docx import amendment, guess_language, parse_docx
from foliant.sources.epub import matter_label, parse_epub
from foliant.sources.html_blocks import html_blocks
from foliant.sources.store import Store, export_paths


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def fold(blocks, sizes=chunker.Sizes()):
    f = chunker.Fold(sizes)
    out = [d for b in blocks for d in f.add(*b)]
    return out + list(f.end())


def words(n, start=0):
    return " ".join(f"w{i}" + ("." if i % 10 == 9 else "") for i in range(start, start + n))


def test_chunks_merge_and_split():
    assert [d.content for d in fold([("Title", "text", None, ("A",)), (words(200), "text", None, ("A",))])] == ["Title\n\n" + words(200)]
    parts = fold([("Title", "text", None, ("A",)), (words(1500), "text", None, ("A",))])
    assert parts[0].content.startswith("Title") and len(parts) > 1 and all(p.tokens <= 800 for p in parts[1:])
    assert len(fold([(words(350), "text", None, ("A",)), (words(650), "text", None, ("A",))])) == 1
    assert len(fold([(words(100), "text", None, ("A",)), (words(100), "text", None, ("B",))])) == 2
    carried = fold([("Head", "text", None, ("A",)), (words(100), "text", None, ("A", "B"))])
    assert len(carried) == 1 and carried[0].sections == ["A", "B"]
    assert fold([("  ", "text", None, ())]) == []


def test_listings_stay_whole():
    code = "\n".join(f"x{i} = {i}" for i in range(900))
    out = fold([("Here it is:", "text", None, ("A",)), (code, "code", "python", ("A",)), (words(100), "text", None, ("A",))])
    assert [d.kind for d in out] == ["code", "text"] and out[0].lead_in == len("Here it is:") and code in out[0].content
    mixed = fold([(words(50), "text", None, ("A",)), ("data", "code", None, ("A",)), (words(50), "text", None, ("A",))])
    assert len(mixed) == 1 and mixed[0].kind == "text" and mixed[0].language is None


@pytest.mark.parametrize("sizes", [(50, 800), (400, 90), (400, 2001), (500, 500)])
def test_bad_sizes(sizes):
    with pytest.raises(ValueError):
        chunker.Sizes(*sizes)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1200), st.sampled_from(["A", "B"])), max_size=8))
def test_chunk_sizes_and_order(blocks):
    made, at = [], 0
    for n, path in blocks:
        made.append((words(n, at), "text", None, (path,)))
        at += n
    out = fold(made)
    assert all(d.tokens < 800 + 400 + 1 for d in out)
    text = " ".join(d.content for d in out)
    places = [text.find(f"w{i}") for i in range(0, at, 97)]
    assert -1 not in places


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .!\n", max_size=400), st.integers(2, 20), st.integers(0, 30))
def test_split_ends_and_covers(text, most, overlap):
    parts = chunker.split(text, most, overlap)
    assert all(chunker.count_tokens(p) <= most for p in parts)
    assert bool(parts) == bool(chunker.count_tokens(text))


def test_chunk_table(spark):
    rows = [("b", i, f"Line {i}. " + words(30), "text", ["A"], None) for i in range(40)] + [(None, 0, None, "text", None, None)]
    blocks = spark.createDataFrame(rows, "book_id string, block_index int, content string, content_type string, section_path array<string>, language string")
    out = chunker.linked(chunker.chunk(blocks)).orderBy("sequence").collect()
    assert [r.sequence for r in out] == list(range(len(out))) and out[0].next_chunk_id == out[1].chunk_id and out[-1].next_chunk_id is None


def test_text_functions(spark):
    assert one(spark, tx.tokens(F.lit("Crème hello_world ABC-1"))) == ["creme", "hello", "world", "abc", "1"]
    assert one(spark, tx.split_authors(F.lit("Ann; Bo, Jr ;"))) == ["Ann", "Bo, Jr"]
    assert one(spark, tx.strip_edition(F.lit("Deep Things, 2nd Edition"))) == "Deep Things"
    assert one(spark, tx.strip_edition(F.lit("Deep Things Second Edition"))) == "Deep Things"
    assert one(spark, tx.find_year(F.lit("June 1999"))) == "1999" and one(spark, tx.find_year(F.lit("x"))) is None
    assert [one(spark, tx.isbn_valid(tx.isbn_clean(F.lit(x)))) for x in ("9780134685991", "0596007124", "9781234567890", "", None)] == [True, True, False, False, False]
    assert len(one(spark, tx.isbn_13(F.lit("0596007124")))) == 13
    assert one(spark, tx.boilerplate(F.array(F.lit("Part"), F.lit("Appendix A")))) and not one(spark, tx.boilerplate(F.array(F.lit("Building an Index"))))
    assert one(spark, tx.truncate_at_boundary(F.lit("One two. Three four five"), 12)) == "One two."
    assert one(spark, tx.truncate_at_boundary(F.lit("One two three four five"), 14)) == "One two three"
    assert one(spark, tx.truncate_at_boundary(F.lit("short"), 14)) == "short"
    assert one(spark, tx.dehyphenate(F.lit("exam-\nple"))) == "example"
    assert one(spark, tx.looks_like_file_name(F.lit("my_big-book_v2"))) and not one(spark, tx.looks_like_file_name(F.lit("My Big Book")))
    for font, fixed in (("ABCDEF+CourierNew", True), ("Lucida Console", True), ("NimbusMonL-Regu", True), ("SFTT1000", True), ("ABCDEF+txtt", True), ("CMTT10", True), ("FiraCode-Regular", True), ("Times", False), ("NimbusRomNo9L-Regu", False)):
        assert one(spark, tx.monospace(F.lit(font))) == fixed == tx.is_monospace(font)
    assert one(spark, tx.normalize_unicode(F.lit("Ÿ ﬁ É"))) == "y fi e"
    rows = F.array(F.array(F.lit("a"), F.lit("b|c")), F.array(F.lit("1"), F.lit("2")))
    assert one(spark, tx.table_text(rows)) == "| a | b\\|c |\n| --- | --- |\n| 1 | 2 |"
    assert one(spark, tx.code_language(F.lit("x language-python"))) == "python"


def test_html_blocks():
    page = "<head><title>no</title></head><h1>A</h1><p>One <b>two</b></p><h2>B</h2><pre class='language-sql'>select\n 1</pre><table><tr><th>x</th></tr><tr><td>y|z</td></tr></table><p>$$x$$</p>"
    assert html_blocks(page) == [
        ("A", "text", ("A",), None), ("One two", "text", ("A",), None), ("B", "text", ("A", "B"), None), ("select\n 1", "code", ("A", "B"), "sql"),
        ("| x |\n| --- |\n| y\\|z |", "table", ("A", "B"), None), ("$$x$$", "math", ("A", "B"), None),
    ]
    assert html_blocks(None) == []


def epub():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="o/c.opf"/></rootfiles></container>')
        z.writestr("o/c.opf", '<package xmlns:dc="d"><metadata><dc:title>T</dc:title><dc:creator>Ann; Bo</dc:creator><dc:identifier>urn:isbn:9780134685991</dc:identifier></metadata><manifest><item id="n" href="nav.xhtml" properties="nav"/><item id="c" href="c1.xhtml"/><item id="p" href="copyright.xhtml"/></manifest><spine><itemref idref="p"/><itemref idref="c"/></spine></package>')
        z.writestr("o/nav.xhtml", '<html xmlns:e="e"><nav e:type="toc"><ol><li><span>Part I</span><ol><li><a href="c1.xhtml">One</a></li></ol></li></ol></nav></html>')
        z.writestr("o/c1.xhtml", "<body><h1>One</h1><p>Hello.</p><h2>Sub</h2><p>World.</p></body>")
        z.writestr("o/copyright.xhtml", "<body><p>All rights.</p></body>")
    return out.getvalue()


def docx():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda text, style="": f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>'
    cell = lambda text: f"<w:tc>{p(text)}</w:tc>"
    body = p("Intro", "Heading1") + p("First.") + p("Second.") + p("def f():", "Code mono") + p("Deep", "Heading2") + f"<w:tbl><w:tr>{cell('a')}{cell('b')}</w:tr></w:tbl>" + f"<w:tbl><w:tr>{cell('[OBDRR046:  Replace the paragraph above with the following upon system implementation of NPRR1188:] New text')}</w:tr></w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


def test_epub():
    meta, blocks = parse_epub(epub())
    assert meta["authors"] == ["Ann", "Bo"] and meta["isbn"] == "9780134685991" and meta["structure_source"] == "toc"
    assert [(b[0], b[2]) for b in blocks] == [("All rights.", ("Copyright",)), ("One", ("Part I", "One")), ("Hello.", ("Part I", "One")), ("Sub", ("Part I", "One", "Sub")), ("World.", ("Part I", "One", "Sub"))]
    labels = {"my-notes": "My Notes", "title": "Title Page", "contents": "Table of Contents", "intro": "Introduction", "acknowledgments": "Acknowledgements", "preface_01": "Preface"}
    assert {k: matter_label(f"x/{k}.xhtml") for k in labels} == labels


def test_sections_inside_a_file():
    page = '<body><p>Start.</p><h2 id="a">Alpha</h2><p>One.</p><h3>Deep</h3><p>Two.</p><div id="b"><p>Three.</p></div><p id="fig">Four.</p></body>'
    got = [(c, p) for c, _, p, _ in html_blocks(page, ("Book",), {"a": ("Book", "Alpha"), "b": ("Book", "Beta")})]
    assert got == [("Start.", ("Book",)), ("Alpha", ("Book", "Alpha")), ("One.", ("Book", "Alpha")), ("Deep", ("Book", "Alpha", "Deep")), ("Two.", ("Book", "Alpha", "Deep")), ("Three.", ("Book", "Beta")), ("Four.", ("Book", "Beta"))]


def test_store_versions(spark, tmp_path):
    """A version counts when its file is complete, and a number is taken once."""
    one = Store(spark, f"{tmp_path}/lib")
    assert not one.exists() and one.write() and one.exists()
    (tmp_path / "lib/versions/0000000002").touch()
    assert one._current()[0] == 1
    with pytest.raises(Exception, match="(?i)exists"):
        one.write()


def test_layout_keeps_documents_apart(spark):
    rows = [("x", 1, 0.0, "Head 1", True), ("x", 2, 0.0, "Head 2", True), ("y", 1, 0.0, "Other", True), ("x", 3, 0.0, "Other", True), ("x", 2, 5.0, "Body", False)]
    boxes = spark.createDataFrame(rows, "doc string, page int, y double, text string, edge boolean")
    assert {(r.doc, r.text) for r in layout.without_furniture(boxes).collect()} == {("y", "Other"), ("x", "Other"), ("x", "Body")}
    marks = spark.createDataFrame([("x", 1, 0.0, "Part"), ("y", 9, 0.0, "Late")], "doc string, page int, y double, title string")
    assert {(r.doc, r.page, r.title) for r in layout.sections(boxes, marks).collect()} == {("x", 1, "Part"), ("x", 2, "Part"), ("x", 3, "Part"), ("y", 1, None)}


def test_docx():
    _, blocks = parse_docx(docx())
    assert [(b[1], b[2]) for b in blocks] == [("text", ("Intro",)), ("code", ("Intro",)), ("table", ("Intro", "Deep")), ("text", ("Intro", "Deep"))]
    assert blocks[0][0] == "First.\n\nSecond." and blocks[1][3] == "python" and blocks[3][0].startswith("[PENDING AMENDMENT — OBDRR046, effective upon NPRR1188]\nReplace the paragraph above with the following:\nNew text")
    assert amendment("nothing") is None and guess_language("Rust code", "x") == "rust" and guess_language("Code", "#!/bin/sh") == "shell" and guess_language("Code", "x\nimport y") is None


def test_files_store_backup_and_stream(spark, tmp_path):
    from foliant.streaming.intake import watch

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.epub").write_bytes(epub())
    (folder / "b.docx").write_bytes(docx())
    (folder / "c.epub").write_bytes(b"broken")
    (folder / "d.txt").write_bytes(b"x")
    parsed = files.read_folder(spark, str(folder))
    assert sorted(r.status for r in parsed.collect()) == ["parse_failed", "parsed", "parsed", "unsupported"]
    store = Store(spark, str(tmp_path / "lib"))
    watch(spark, str(folder), store.root, str(tmp_path / "ck")).awaitTermination()
    assert store.read("books").count() == 2 and store.read("chunks").count() >= 2
    assert export_paths(store.read("books"), str(tmp_path / "paths")) == 2
    manifest = store.backup(str(tmp_path / "bak"))
    assert manifest["counts"]["books"] == 2
    first = store.read("books").orderBy("title").first().book_id
    assert store.remove(first) and not store.remove("none") and store.read("books").count() == 1
    with pytest.raises(FileExistsError):
        store.restore(str(tmp_path / "bak"))
    store.restore(str(tmp_path / "bak"), force=True)
    assert store.read("books").count() == 2
    with pytest.raises(ValueError):
        store.restore(str(tmp_path / "nothing"), force=True)


def test_intake_rules(spark):
    new = spark.createDataFrame([("f1", "h1", "c9"), ("f2", "h9", "c1"), ("f3", "h8", "c8")], "f string, file_hash string, content_hash string")
    old = spark.createDataFrame([("b1", "h1", "c1", 1), ("b2", "h2", "c1", 2)], "book_id string, file_hash string, content_hash string, added_at int")
    got = intake.first_twins(new, old).withColumns({"exists": F.lit(True), "suffix": F.lit(".epub"), "parsed": F.lit(True)}).select("f", intake.intake_status().alias("s"), "text_twin")
    assert {r.f: r.s for r in got.collect()} == {"f1": "duplicate", "f2": "duplicate_content", "f3": "added"}
    with pytest.raises(ValueError):
        intake.intake_status("odd")
    with pytest.raises(ValueError):
        intake.update_metadata(old, "b1")
    books = spark.createDataFrame([("b", "Spark in Depth"), ("c", "Spark in Deptt"), ("d", "Other")], "book_id string, title string")
    assert {r.book_id for r in intake.similar_titles(books, "Spark in Depth").collect()} == {"b", "c"}


def test_layout(spark):
    lines = spark.createDataFrame([(1, 0, 10.0, 5.0, "def f():"), (1, 1, 30.0, 5.0, "pass")], "listing int, line int, x0 double, width double, text string")
    assert layout.listing(lines).first().text == "def f():\n    pass"
    boxes = spark.createDataFrame([(1, 5.0), (2, 1.0), (2, 9.0)], "page int, y double")
    marks = spark.createDataFrame([(1, 2.0, "A"), (2, 4.0, "B")], "page int, y double, title string")
    assert {(r.page, r.y): r.title for r in layout.sections(boxes, marks).collect()} == {(1, 5.0): "A", (2, 1.0): "A", (2, 9.0): "B"}


class Letters:
    """A provider that counts letters."""

    def embed(self, texts):
        return [[float(t.lower().count(c)) for c in "aeiou"] + [1.0] for t in texts]


def test_library_calls(spark, tmp_path):
    from foliant.api import Library
    from foliant.plans import render

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.epub").write_bytes(epub())
    (folder / "copy.epub").write_bytes(epub())
    (folder / "b.docx").write_bytes(docx())
    (folder / "d.txt").write_bytes(b"x")
    lib = Library(spark, str(tmp_path / "lib"), Letters())
    first = {r.path.rsplit("/", 1)[1]: r.status for r in lib.add(str(folder), collection="c").collect()}
    assert first["b.docx"] == "added" and first["d.txt"] == "unsupported" and lib.list("c").count() == 2
    again = {r.path.rsplit("/", 1)[1]: r.status for r in lib.add(str(folder)).collect()}
    assert again["a.epub"] == "duplicate" and lib.list().count() == 2
    assert {r.status for r in lib.add(str(folder), policy="replace").collect()} == {"replaced", "unsupported"} and lib.list().count() == 2
    hits = lib.search("hello", top_k=3, mode="keyword").results
    assert lib.search("hello", top_k=3).results
    assert hits and hits[0]["book_title"] == "T" and "Hello" in render.results(hits)
    book = hits[0]["book_id"]
    assert render.outline(r.asDict() for r in lib.structure(book).collect()).startswith("- ")
    assert lib.read(book, 0, 5).count() >= 1
    lib.update(book, title="New")
    assert lib.list().where("title = 'New'").count() == 1
    assert {r.status for r in lib.reindex().collect()} == {"success"}
    assert lib.remove(book) and lib.list().count() == 1 and lib.store.read("vectors").where(F.col("book_id") == book).count() == 0
    assert "| Id |" in render.book_table(r.asDict() for r in lib.list().collect())


def test_requests_and_enrichment(spark):
    from foliant.operators import embedding, enrich

    assert list(embedding.requests(["a b", "c d e", "f"], most=4)) == [["a b"], ["c d e", "f"]]
    assert list(embedding.requests(["a b c"], most=4, each=2)) == [["a b"]]
    cols = "isbn string, title string, authors array<string>, publisher string, year string, description string"
    books = spark.createDataFrame([("9780134685991", "Effective", ["J"], None, None, None), (None, "Deep Spark: A Tour", ["Ann"], None, None, None), (None, "Other", ["X"], None, None, None)], cols)
    one = spark.createDataFrame([("9780134685991", "Effective", ["J"], "AW", "2018", None)], cols)
    two = spark.createDataFrame([("0134685997", "Effective", ["J"], "XX", "1", "text"), (None, "Deep Spark", ["ann"], "P", "2020", "d")], cols)
    got = {r.title: r for r in enrich.enrich(books, one, two).collect()}
    assert (got["Effective"].publisher, got["Effective"].description, got["Effective"].source) == ("AW", "text", 0)
    assert (got["Deep Spark: A Tour"].year, got["Deep Spark: A Tour"].source, got["Other"].source) == ("2020", 1, None)

from functools import partial

import pytest
from pyspark.sql import functions as F

from pagemill.functions import text as ft
from pagemill.operators import chunking, cleaning, lines
from pagemill.sources.pages import chunk_block, dump, pages_from_table

PAGE = "source string, page int, id string, text string, printed_page int"


def page(text, number=1, source="book.pdf"):
    return (source, number, f"{source[:-4]}#seite-{number}", text, None)


def texts(df):
    return [r["text"] for r in df.orderBy("page").collect()]


@pytest.mark.parametrize(
    ("text", "number", "offset", "want", "printed"),
    [
        ("39\n3.3 Zählspiel\nZweck der Regel:", 41, -2, "3.3 Zählspiel\nZweck der Regel:", 39),
        ("Zweck der Regel:\n88\n9\nREGEL", 90, -2, "Zweck der Regel:\n9\nREGEL", 88),
        ("a\nb\nc\n40\nd\ne\nf\ng\nh", 42, -2, "a\nb\nc\nd\ne\nf\ng\nh", 40),
        ("40\nb\nc\nd\n40\nf\ng\nh\ni", 42, -2, "b\nc\nd\n40\nf\ng\nh\ni", 40),
        ("keine Zahl", 1, -2, "keine Zahl", None),
    ],
)
def test_printed_page(spark, text, number, offset, want, printed):
    row = cleaning.extract_printed_page(spark.createDataFrame([page(text, number)], PAGE), offset).first()
    assert (row["text"], row["printed_page"]) == (want, printed)


def test_hyphenation(spark):
    cases = {"zurückzu-\nlegen": "zurückzulegen", "versto- \nßen": "verstoßen", "Netto-\nErgebnisse": "Netto-Ergebnisse", "Ein-\nund Ausgang": "Ein- und Ausgang", "Regel:\nZählspiel": "Regel:\nZählspiel", "wer-\nundig": "werundig"}
    df = spark.createDataFrame([page(t, i) for i, t in enumerate(cases)], PAGE)
    assert texts(cleaning.clean_hyphenation(df)) == list(cases.values())


def test_line_patterns_and_whitespace(spark):
    patterns = [r"Regel \d+", "Regel x"]
    df = spark.createDataFrame([page("Regel 3\nSiehe Regel 3 für Details.\n Regel x ", 1), page("Regel 1\nRegel 2", 2)], PAGE)
    assert texts(cleaning.clean_line_patterns(df, patterns)) == ["Siehe Regel 3 für Details."]
    cases = {"  a\t\tb  c\n\n\n\n d ": "a b c\n\nd", "a\u00a0\u00a0b\u00a0\nc": "a b\nc", "a \rb\r\nc": "a\nb\nc"}
    df = spark.createDataFrame([page(t, i) for i, t in enumerate(cases)], PAGE)
    assert texts(cleaning.clean_whitespace(df)) == list(cases.values())


def test_line_patterns_keep_inner_line_ends(spark):
    df = spark.createDataFrame([page("a\n\nRegel 1", 1), page("a\n", 2), page("\n \n", 3)], PAGE)
    assert texts(cleaning.clean_line_patterns(df, [r"Regel \d+"])) == ["a\n", "a"]
    assert texts(cleaning.clean_line_patterns(df, [])) == ["a\n\nRegel 1", "a"]
    assert cleaning.clean_line_patterns(df, [], drop_blank=False).count() == 3


def test_composite(spark):
    steps = [partial(cleaning.extract_printed_page, offset=-2), partial(cleaning.clean_line_patterns, patterns=["Kopf"]), cleaning.clean_hyphenation, cleaning.clean_whitespace]
    df = spark.createDataFrame([page("39\nKopf\nEin-\nlochens  x", 41), page("22\nKopf", 24), page(None, 25), ("b.pdf", None, "i", "x", None)], PAGE)
    got = cleaning.clean(df, steps).orderBy("page").collect()
    assert [(r["text"], r["printed_page"]) for r in got] == [("x", None), ("Einlochens x", 39)]


def test_pages(spark):
    df = spark.createDataFrame([("a.PDF", 1, "x"), ("a.PDF", 2, " \n"), ("a.PDF", 3, "z"), ("a.PDF", 4, None)], "source string, page int, text string")
    assert [r["id"] for r in pages_from_table(df).orderBy("page").collect()] == ["a#seite-1", "a#seite-3"]
    assert [r["page"] for r in pages_from_table(df, first=2, last=3).collect()] == [3]
    with pytest.raises(ValueError):
        pages_from_table(df, first=5, last=3)


def sectioned(spark, pages, section="Regeln"):
    return spark.createDataFrame([page(t, i) for i, t in enumerate(pages, 1)], PAGE).withColumn("section", F.lit(section))


def test_lines(spark):
    got = lines.to_lines(sectioned(spark, ["eins\nzwei", "drei"])).orderBy("page", "line_idx").collect()
    assert [(r["text"], r["page"], r["line_idx"]) for r in got] == [("eins", 1, 0), ("zwei", 1, 1), ("drei", 2, 0)]
    got = lines.to_lines(sectioned(spark, ["den Ball zu-", "rück-", "legen\nEnde"])).orderBy("page", "line_idx").collect()
    assert [(r["text"], r["page"]) for r in got] == [("den Ball zurücklegen", 1), ("Ende", 3)]
    assert lines.to_lines(sectioned(spark, ["Netto-", "Ergebnisse"])).count() == 2


def test_sections(spark):
    df = spark.createDataFrame([page("x", i) for i in range(1, 6)], PAGE)
    s = spark.createDataFrame([("A", 1, 3), ("B", 3, 5)], "section string, first_page int, last_page int")
    got = lines.assign_sections(df, s, [4]).select("section", "page").collect()
    many = lines.assign_sections(df, s, [4], broadcast_sections=0)
    assert many.columns == lines.assign_sections(df, s, [4]).columns and sorted(map(tuple, many.select("section", "page").collect())) == sorted(map(tuple, got))
    assert sorted(map(tuple, got)) == [("A", 1), ("A", 2), ("A", 3), ("B", 3), ("B", 5)]


def test_term_chunks(spark):
    text = "Einleitung hier.\nAbschlag\nDer Bereich am Start.\nAus\nJenseits der Grenze.\nBewegliches Hemmnis\nEin Hemmnis."
    got = chunking.chunk_by_terms(lines.to_lines(sectioned(spark, [text], "Definitionen")), 1000).orderBy("n").collect()
    assert [r["number"] for r in got] == [None, "Abschlag", "Aus", "Bewegliches Hemmnis"]
    assert got[1]["text"] == "Definitionen › Abschlag\n\nDer Bereich am Start."
    assert got[1]["id"] == "book#definitionen-2"


def test_size_chunks_and_split(spark):
    one = chunking.chunk_by_size(lines.to_lines(sectioned(spark, ["kurz", "auch kurz"], "Vorwort")), 500).collect()
    assert [(r["text"], r["page"]) for r in one] == [("Vorwort\n\nkurz\nauch kurz", 1)]
    long = ["x" * 40, "y" * 40, "z" * 90]
    got = chunking.chunk_by_size(lines.to_lines(sectioned(spark, ["\n".join(long)], "S")), 60).orderBy("n").collect()
    assert [r["text"] for r in got] == [f"S\n\n{x}" for x in long]
    assert chunking.chunk_by_size(lines.to_lines(sectioned(spark, ["\n \n x"], "S")), 60).first()["text"] == "S\n\n x"


def test_process_by_strategy(spark):
    pages = sectioned(spark, ["kurz", "1.1 Titel\nText."], "A").unionByName(sectioned(spark, ["Wort.\nAus\nJenseits."], "B"))
    sections = spark.createDataFrame([("A", "headings", 2), ("B", "terms", 1)], "section string, strategy string, section_no int")
    got = chunking.process(lines.to_lines(pages), sections, 500, chunking.HeadingRules()).orderBy("pos").collect()
    assert [(r["pos"], r["section"], r["heading"], r["number"], r["page"]) for r in got] == [(0, "B", "B", None, 1), (1, "B", "B › Aus", "Aus", 1), (2, "A", "A", None, 1), (3, "A", "Regel 1 › 1.1 Titel", "1.1", 2)]


def test_heading_chunks(spark):
    rules = chunking.HeadingRules(titles={1: "Das Spiel", 2: "Der Platz"})
    pages = [
        "Zweck der Regel:\nErklärung.",
        "1.1 Das Spiel\nText eins.\n14.2d verlangt.\n1.1 Siehe oben.\n1.2 Verhalten\n1.2a Standards\nText a.\n1.2b Kodex\nText b.",
        "Zweck der Regel:\nZweiter Zweck.",
        "2.1 Grenzen\nText.",
    ]
    got = chunking.chunk_by_headings(lines.to_lines(sectioned(spark, pages)), 1000, rules).orderBy("n").collect()
    assert [(r["heading"], r["number"]) for r in got] == [
        ("Regel 1 – Das Spiel › Zweck der Regel", "1"),
        ("Regel 1 – Das Spiel › 1.1 Das Spiel", "1.1"),
        ("Regel 1 – Das Spiel › 1.2 Verhalten › 1.2a Standards", "1.2a"),
        ("Regel 1 – Das Spiel › 1.2 Verhalten › 1.2b Kodex", "1.2b"),
        ("Regel 2 – Der Platz › Zweck der Regel", "2"),
        ("Regel 2 – Der Platz › 2.1 Grenzen", "2.1"),
    ]
    assert "14.2d verlangt." in got[1]["text"] and "1.1 Siehe oben." in got[1]["text"]


def test_marker_after_heading_is_text(spark):
    got = chunking.chunk_by_headings(lines.to_lines(sectioned(spark, ["1.1 Das Spiel\nZweck der Regel:\nText."])), 1000, chunking.HeadingRules()).collect()
    assert [r["text"] for r in got] == ["Regel 1 › 1.1 Das Spiel\n\nZweck der Regel:\nText."]


def test_chunk_stats_and_dump(spark, tmp_path):
    df = spark.createDataFrame([(f"c{i}", 1, "x" * n, "S") for i, n in enumerate([5, 1, 3, 9])], "id string, page int, text string, section string")
    assert tuple(chunking.chunk_stats(df, 4).first()) == (4, 1, 5, 9, 2)
    s = spark.createDataFrame([("S",), ("T",)], "section string")
    assert sorted(map(tuple, chunking.section_counts(df, s).collect())) == [("S", 4), ("T", 0)]
    assert df.select(chunk_block(df)).first()[0].endswith("\nxxxxx")
    dump(df, chunk_block(df), str(tmp_path / "dump"))
    assert spark.read.text(str(tmp_path / "dump")).where("value like '=====%'").count() == 4


def test_columns(spark):
    df = spark.createDataFrame([("Wesentliche Änderungen 2023!", "Kopf\n\nZeile eins\nZeile zwei", "19.2a", "16.10")], "a string, b string, c string, d string")
    row = df.select(
        ft.slug(F.col("a")), ft.snippet(F.col("b")), ft.snippet(F.col("b"), 5), ft.number_matches(F.col("c"), F.lit("19")), ft.number_matches(F.col("c"), F.lit("19.2")), ft.number_matches(F.col("d"), F.lit("16.1")), ft.term_count_vector(F.col("b"), ["Zeile", "zz"])
    ).first()
    assert tuple(row) == ("wesentliche-aenderungen-2023", "Zeile eins Zeile zwei", "Zeile …", True, True, False, [2.0, 0.0])

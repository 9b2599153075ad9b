import random
import re

from pagemill.operators import checks, evaluation

PATTERN = r"Regel (\d{1,2}(?:\.\d{1,2})?[a-z]?)"


def answers(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "answer_id long, text string")


def sources(spark, answer_ids, *texts):
    return spark.createDataFrame([(a, i, t) for a in answer_ids for i, t in enumerate(texts, 1)], "answer_id long, source_no int, text string")


def test_citations(spark):
    a = answers(spark, "Nach Regel 21.1a [1].", "Regel 19.2c [1]", "Regel 11.2 [3][1]", "Regel 17.1d", "Regel 9.2 [2]", "Regel 2.1", "Regel 19.2 [9]", "Regel 1 [99999999999]")
    s = sources(spark, range(8), "21.1a Stableford", "19.2c Unspielbar", "11.2 und 17.1d und 12.1")
    found = checks.extract_citations(a, PATTERN)
    got = {r["answer_id"]: (r["quote"], r["reference"], list(r["cited"])) for r in found.collect()}
    assert got[2] == ("Regel 11.2 [3][1]", "11.2", [3, 1]) and got[3] == ("Regel 17.1d", "17.1d", []) and got[7][2] == []
    checked = checks.check_citations(found, s)
    assert {r["answer_id"]: r["supported"] for r in checked.collect()} == {0: True, 1: False, 2: True, 3: True, 4: False, 5: False, 6: False, 7: False}
    problems = {r["answer_id"]: r["problem"] for r in checks.citation_problems(checked).collect()}
    assert problems[1] == "„Regel 19.2c [1]“ steht nicht in der angegebenen Quelle" and problems[5] == "„Regel 2.1“ steht in keiner der Quellen"
    assert sorted(map(tuple, checks.citation_report(checked).collect()))[0] == (0, 1, 0, 1)


def test_forbidden_and_all_problems(spark):
    a = answers(spark, "Der STRAFSCHLAG im Wasserhindernis und Strafschlag", "gut")
    f = checks.forbidden_terms(a, "strafschlag|wasserhindernis", "Alt")
    assert [r["problem"] for r in f.orderBy("pos").collect()] == ["Alt: „STRAFSCHLAG“", "Alt: „Wasserhindernis“", "Alt: „Strafschlag“"]
    got = {r["answer_id"]: list(r["problems"]) for r in checks.all_problems(a, [f.limit(0), f]).collect()}
    assert len(got[0]) == 3 and got[1] == []


def test_rewrite_gate(spark):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(["keine", "Keine.", "„keine“", "", None, " Ball im Bunker "])], "query_id long, reply string")
    assert [r["search_text"] for r in checks.rewrite_gate(df).orderBy("query_id").collect()] == [None] * 5 + ["Ball im Bunker"]


def test_terms(spark):
    replies = spark.createDataFrame([(1, "„Hasenbau“, tierloch., Tierloch\nBunker"), (2, "nichts")], "query_id long, reply string")
    vocabulary = spark.createDataFrame([(0, "Tierloch"), (1, "Bunker"), (2, "Abschlag")], "pos int, term string")
    terms = checks.select_terms(replies, vocabulary, 5)
    assert [r["term"] for r in terms.orderBy("n").collect()] == ["Tierloch", "Bunker"]
    queries = spark.createDataFrame([(1, "Frage"), (2, "Andere")], "query_id long, question string")
    got = {r["query_id"]: r["search_text"] for r in checks.expand_query(queries, terms).collect()}
    assert got == {1: "Frage (Tierloch, Bunker)", 2: "Andere"}
    assert checks.select_terms(replies, vocabulary, 1).count() == 1


def test_status(spark):
    q = spark.createDataFrame([(1, "a", "s"), (2, "b", "s"), (3, "c", None), (4, "d", "s")], "query_id long, question string, search_text string")
    hits = spark.createDataFrame([(1, 0.2), (1, 0.8), (2, 0.4)], "query_id long, score double")
    got = {r["query_id"]: (r["status"], r["model_asked"], r["search_text"]) for r in checks.answer_status(q, hits, 0.5).collect()}
    assert got == {1: ("ask", True, "s"), 2: ("below_threshold", False, "s"), 3: ("off_topic", False, "c"), 4: ("below_threshold", False, "s")}


def test_correction(spark):
    first = answers(spark, "gut", "schlecht", "schlecht", "schlecht")
    second = spark.createDataFrame([(1, "besser"), (2, "immer noch")], "answer_id long, text string")
    kind = "answer_id long, problems array<string>"
    p1 = spark.createDataFrame([(0, []), (1, ["p", "q"]), (2, ["p"]), (3, ["p"])], kind)
    p2 = spark.createDataFrame([(1, []), (2, ["r"])], kind)
    prompts = dict(map(tuple, checks.correction_prompts(p1, "Bitte:\n%s").collect()))
    assert prompts[1] == "Bitte:\n- p\n- q" and 0 not in prompts
    final = checks.final_answers(first, p1, second, p2)
    got = {r["answer_id"]: (r["text"], list(r["problems"]), r["corrected"], r["clean"]) for r in final.collect()}
    # an answer counts as corrected when it was asked for again, whatever came of it
    assert got == {0: ("gut", [], False, True), 1: ("besser", [], True, True), 2: ("immer noch", ["r"], True, False), 3: ("schlecht", ["p"], True, False)}
    given = spark.createDataFrame([(0, "abc"), (1, "de")], "answer_id long, text string")
    row = evaluation.answer_summary(final.unionByName(final.limit(1).selectExpr("9L as answer_id", "cast(null as string) as text", "problems", "first_attempt_problems", "false as corrected", "clean")), given).first()
    assert (row["answers"], row["failures"], row["corrected"], list(row["corrected_ids"]), row["sources"], row["source_chars"]) == (5, 1, 3, [1, 2, 3], 2, 5)
    assert row["problems_left"] >= row["with_problems"] >= 2
    assert {tuple(r) for r in evaluation.source_sizes(given).collect()} == {(0, 1, 3), (1, 1, 2)}


def test_citation_pattern_with_branches(spark):
    a = answers(spark, "Regel 3 [1] und Punkt 4 [2]")
    found = checks.extract_citations(a, r"Regel (\d)|Punkt \d").orderBy("cit_no").collect()
    assert [(r["quote"], list(r["cited"])) for r in found] == [("Regel 3 [1]", [1]), ("Punkt 4 [2]", [2])]


def test_number_index_against_pattern(spark):
    rnd = random.Random(31)
    texts = ["".join(rnd.choice(["1", "7", "17", ".", "d", "ä", " ", "17.1", "x", "2b"]) for _ in range(rnd.randint(0, 14))) for _ in range(150)]
    sources = [(i // 5, i % 5 + 1, t) for i, t in enumerate(texts)] + [(3, 9, None)]
    references = ["1", "17", "17.1", "17.1d", "7.", "17.1ä", "2b", "1.7", "A1", "", "17.1dx", None]
    citations = [(a, n, "q", r, rnd.choice([[], [1], [2, 5], [77]])) for a in range(31) for n, r in enumerate(references)]
    rows = [(*c, bool(c[-1])) for c in citations]
    df = spark.createDataFrame(rows, "answer_id long, cit_no int, quote string, reference string, cited array<int>, has_sources boolean")
    got = {(r["answer_id"], r["cit_no"]): r["supported"] for r in checks.check_citations(df, spark.createDataFrame(sources, "answer_id long, source_no int, text string")).collect()}
    for a, n, _, r, cited in citations:
        own = [t for i, no, t in sources if i == a and t is not None and (not cited or no in cited)]
        assert got[a, n] == (r is not None and any(re.search(rf"(?<![\d.]){re.escape(r)}(?!\d)", t) for t in own)), (a, r, cited, own)
    assert len(got) == len(rows)

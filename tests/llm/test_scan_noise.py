import pytest

from codexloom.llm import scan_noise as sn

TEXT = "The Borrower shall deliver the applicable margin to each Lender and the Administrative Agent. Each short- and long-term debt schedule is kept with care. Any non-recurring charge of the Lender is paid in full at that time. The following obligations of the Borrower remain."
S = "id string, text string, document_id string, source string"


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(f"s{i}", TEXT * 6, f"d{i % 9}", "html") for i in range(40)]
    rows += [(f"h{i}", f"The Borrower shall deliver the\nNAME{i} FOODS CREDIT AGREEMENT\nmargin to each Lender.", f"d{i % 9}", "ocr") for i in range(6)]
    return sn.learn(spark.createDataFrame(rows, S))


def kinds(text, corpus):
    return {f.kind for f in sn.read(text, corpus)[0]}


def test_repair(corpus):
    noisy = "The Borrower shall deliver the appli-\ncable margin to each Lencler and the Adminis‐\ntrative Agent. Each short-\nand long-term debt schedule is kept\nPage 3 of 12\nOTHER FOODS CREDIT AGREEMENT\nwith care.\n\nThe fol1owing obligations of the Borrower rema-\n- 14 -\nin."
    found, clean = sn.read(noisy, corpus)
    assert {f.kind for f in found} == set(sn.KINDS)
    assert clean == "The Borrower shall deliver the applicable margin to each Lender and the Administrative Agent. Each short- and long-term debt schedule is kept with care.\nThe following obligations of the Borrower remain."


@pytest.mark.parametrize(
    "text, want",
    [
        (TEXT, set()), ("Each short-\nand long-term debt schedule is kept with care.", set()), ("Any non-\nrecurring charge of the Lender is paid.", set()),
        ("The charge of the Lender is paid in the full:\n2024\n$821,492,673\n3.50 to 1.00\n2025\n$1,000", set()),
        ("The charge of the Lender is paid in the full:\n" + "2024\n$821,492\n" * 12 + "67\n" + "2025\n$1,000\n" * 3, {"pageno"}),
        ("The margin of the Lender is\n[17]\npaid in full at that time.", {"pageno"}), ("The margin of the Lender is\nxxiv\npaid in full at that time.", {"pageno"}),
        ("The 1st and 2nd charge of v2 and Zubokari is paid in full.", set()), ("Each Lencler is paid.", {"misread"}), ("", set()), (None, set()), ("\n \n", set()), ("12", set()),
    ],
)
def test_cases(corpus, text, want):
    assert kinds(text, corpus) == want


def test_chunks_follow_their_sections(spark, corpus):
    section = "The Borrower shall deliver the\nOTHER FOODS CREDIT AGREEMENT\nmargin to each Len-\nder of the\n- 9 -\ncharge. Any charge is paid."
    joined = " ".join(section.split())
    cut = joined.index(" to each")
    secs = spark.createDataFrame([("a", section, "d", "html"), ("a", section, "d", "html"), ("e", None, "d", None)], S)
    chunks = spark.createDataFrame([("a::p1", joined[:cut]), ("a::p2", joined[cut + 1 :]), ("lost::p1", "the charge of each Lencler Page 3 of 9 is paid"), ("n", None)], "id string, text string")
    read = sn.read_sections(secs, corpus)
    got = {r.id: (set(r.kinds), r.repaired) for r in sn.read_chunks(chunks, read, corpus).collect()}
    assert got["a::p1"] == ({"header"}, "The Borrower shall deliver the margin")
    assert got["a::p2"] == ({"hyphen", "pageno"}, "to each Lender of the charge. Any charge is paid.")
    assert got["lost::p1"][0] == {"misread", "pageno"}
    assert got["n"] == (set(), "")


def test_long_lines_take_no_quadratic_time(corpus):
    assert kinds("x" * 300_000 + "\n" + "ab-" * 50_000, corpus) <= {"hyphen"}
    assert kinds("7" * 300_000 + "-\nab\n" + "a'" * 100_000 + "-\nb " + "rn" * 50_000, corpus) <= {"hyphen", "misread"}
    assert sn.read_chunk("7" * 300_000 + "- " + "x" * 300_000, None, corpus)[0] == set()


def test_a_broken_word_may_have_any_length(corpus):
    assert kinds("The " + "pre" * 100 + "-\nmargin of the Lender is paid in full at that time.", corpus) == {"hyphen"}


@pytest.mark.parametrize("word, target, most, want", [("Lencler", "lender", 3, (1, "Lender")), ("rnargln", "margin", 3, None), ("rnargm", "margin", 3, (2, "margin")), ("hh", "bb", 1, None), ("fu1I", "full", 3, (2, "full")), ("Lender", "lender", 3, (0, "Lender"))])
def test_exchanges_stand_side_by_side(word, target, most, want):
    assert sn.exchanged(word, target, most) == want


def test_no_rows(spark):
    empty = spark.createDataFrame([], S)
    corpus = sn.learn(empty)
    assert sn.read_sections(empty, corpus).count() == 0


def found_headers(corpus, sections):
    return {r.id: [f.item for f in r.findings if f.kind == "header"] for r in sn.read_sections(sections, corpus).collect()}


def test_a_filings_own_running_line_in_one_section(spark):
    long = "\n".join(["The Borrower shall deliver the\nZUBOKARI CINEMAS CONFORMED COPY\nmargin to each Lender."] * 4)
    rows = [("a", long, "d", "ocr"), ("b", long.replace("ZUBOKARI", "NOLIMAR").replace("CONFORMED COPY", "EXECUTION VERSION", 2), "e", "ocr")]
    df = spark.createDataFrame(rows, S)
    got = found_headers(sn.learn(df), df)
    assert len(got["a"]) == 4 and got["b"] == []
    # A section that is delivered three times repeats nothing.
    few = spark.createDataFrame([("c", "The Borrower shall deliver the\nZUBOKARI CINEMAS COPY\nmargin to each Lender.", "d", "ocr")] * 3, S)
    assert found_headers(sn.learn(few), few) == {"c": []}


def test_a_running_line_is_found_however_large_the_corpus(spark):
    own = [(f"s{i}", "The Borrower shall deliver the\nZUBOKARI CINEMAS CONFORMED COPY\nmargin to each Lender.", "d", "ocr") for i in range(3)]
    df = spark.createDataFrame(own + [(f"x{i}", f"Any charge of the\nQ{chr(97 + i // 26)}{chr(97 + i % 26)}KRUVO HOLDINGS LEASE\nLender is paid.", f"x{i}", "ocr") for i in range(60)], S)
    got = found_headers(sn.learn(df, line_share=0.2), df)
    assert all(len(got[f"s{i}"]) == 1 for i in range(3))


def test_a_recurring_sub_heading_is_no_header(spark):
    rows = [(f"s{i}", f"Any charge of the Lender is paid.\nMandatory Lender Charge\nThe Borrower shall deliver the\nMARGIN FOODS COPY\nmargin to each Lender.\nCHARGE {i} TIME\n- {i} -\nThe charge remains.", f"d{i}", "ocr") for i in range(4)]
    df = spark.createDataFrame(rows, S)
    got = found_headers(sn.learn(df), df)
    assert got == {f"s{i}": ["MARGIN FOODS COPY", f"CHARGE {i} TIME"] for i in range(4)}

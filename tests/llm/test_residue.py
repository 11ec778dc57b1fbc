import pytest

from codexloom.llm.residue import diagnose, placeholders, residue


@pytest.mark.parametrize("text", ["Dear {{ name }}, we agree.", "Paid to ${lender_name}.", "Due <%= date %>.", "As of [INSERT DATE]", "See [[Lender Name]].", "By <<AMOUNT>>", "Signed for «signatory».", "@@amount@@", "for %AGENT% only", "on XX/XX/20XX", "the [●] cap", "[TO COME]", "(enter amount)", "Section {0}", "Ask __AGENT__", "#{closing_date}", "<date to be confirmed>"])
def test_placeholders(text):
    assert diagnose(text) == "placeholder"


@pytest.mark.parametrize("text", ["printed [sic] on May 1", "Clause (c) is [intentionally omitted].", "marked [Reserved].", "[Signature pages follow]", "{the “Obligors”} are bound as the list in Section {sec} shows.", "[38]", "100% of the %", "a __init__ method", "(a) the agent (b) the lender", "Use ```{{ name }}``` in a template.", "In the syntax of the engine, the placeholder `{{ name }}` is replaced."])
def test_prose_brackets_and_code_are_no_placeholders(text):
    assert placeholders(text) == [] and diagnose(text) is None


@pytest.mark.parametrize(
    "text, kind",
    [
        ("404 Not Found", "error"), ("Annual Report\n\nInternal Server Error\nReference ID: 12ab34cd", "error"), ("Seite nicht gefunden", "error"),
        ("Please enable JavaScript to view this page.", "notice"), ("Votre navigateur n'exécute pas les scripts nécessaires.", "notice"),
        ("Lorem ipsum dolor sit amet. Dolor sit amet magna.", "filler"), ("Overview\nText goes here.", "filler"), ("Xxxxx xxx xx xxxx xxx.", "filler"), ("Asdf qwer jkl zxcv.", "filler"),
    ],
)
def test_pages_without_content(text, kind):
    assert diagnose(text) == kind


@pytest.mark.parametrize("text", ["No Lender is liable if a page is not found or access is denied, and each Lender shall pay on demand. The Borrower shall repay the loan.", "The platform may require that scripts be enabled.\nThe Borrower shall repay all loans on the due date without set-off.", "Home | Filings | Exhibits | Help", "Noted.", "", None, "   "])
def test_text_that_speaks_of_such_things_is_sound(text):
    assert diagnose(text) is None


def test_rows(spark):
    rows = [(1, "404 Not Found", "a"), (1, "404 Not Found", "b"), (2, None, "a"), (3, "", "a"), (4, "The Borrower shall pay. " * 20_000 + "{{ name }}", "a"), (None, "{{ x }}", "a")]
    got = {(r.doc_id, r.kind) for r in residue(spark.createDataFrame(rows, "doc_id long, text string, kind string")).collect()}
    assert got == {(1, "error"), (4, "placeholder"), (None, "placeholder")}
    assert residue(spark.createDataFrame([], "doc_id long, text string")).count() == 0


UNMARKED = ["Effective as of DD/MM/YYYY.", "Dated MM/DD/20XX", "[*]", "[...]", "[ ● ]", "[ Fill in name ]", "foo bar baz qux", "Uncaught exception: core dumped", "Segmentation fault", "NullPointerException: null", "ValueError: x", "Bad request", "The file no longer exists.", "Consectetur adipiscing elit sed do eiusmod"]


def test_rows_keep_all_that_diagnose_flags(spark):
    assert all(diagnose(t) for t in UNMARKED)
    got = residue(spark.createDataFrame(list(enumerate(UNMARKED)), "doc_id long, text string"))
    assert {r.doc_id: r.kind for r in got.collect()} == {i: diagnose(t) for i, t in enumerate(UNMARKED)}


@pytest.mark.parametrize("text", ["[Insert full legal name and jurisdiction of organization of each Subsidiary Guarantor]", "[insert the name (as in its charter) of each of the\nSubsidiary Guarantors [and its agent] that is party to this agreement]", "The parties agree as follows:\n    By: [Insert name]\n    Title: {{ title }}", "\tthe rate of [specify rate];\n\tthe amount of ${amount}."])
def test_long_instructions_and_indented_clauses(text):
    assert diagnose(text) == "placeholder"


@pytest.mark.parametrize("text", ["The page is built so, and nothing is missing in it.\n    <p>{{ name }}</p>\n    <b>${x}</b>", "The placeholder syntax of the engine is this, as the manual says:\n\n    Dear {{ name }}", "It then calls this function for every row that it reads.\n    total = rate({{ x }})"])
def test_indented_code_is_discounted(text):
    assert placeholders(text) == []


def test_open_instructions_take_no_quadratic_time():
    assert placeholders("[insert a " * 100_000 + "(add b " * 100_000 + "<enter c " * 100_000) == []


SOUND = "The Borrower shall pay each Lender on the due date without any set-off. "


@pytest.mark.parametrize(
    "text",
    [
        "Write ${name} where the borrower goes. " + SOUND * 200,
        "How to use our templates. In Jinja a variable is written {{ name }}. The engine then renders the letter, and nothing more has to be done.",
        "The merge fields of the letter are these: {{ name }}, {{ date }}. Each placeholder is replaced when the letter is printed, and the template engine escapes what it prints. Unknown placeholders stay as they are, and the syntax is checked first.",
        "In this mail merge «name» is replaced by the name of the client before any letter is sent to them.",
    ],
)
def test_tutorials_are_sound(text):
    assert diagnose(text) is None


@pytest.mark.parametrize("text", ["Notice to {{ name }}. " + SOUND * 300, SOUND * 3 + "Payable to ${lender_name} on demand.", "The template of this notice was agreed by the parties. It is sent to [[Lender Name]] on the date of the notice."])
def test_one_placeholder_is_residue_however_long_the_text(text):
    assert diagnose(text) == "placeholder"


def test_masked_words_after_a_title():
    assert diagnose("Bonasodon Logistics Credit Agreement Xxxx xxx xxx xxx xxx xx. Xxxx xxx xx xxx.") == "filler"

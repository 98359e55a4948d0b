from marginalia.llm.residue import found_residue

PROSE = "The careful heron crossed the canal. Nobody counted the lamps, so it was weighed twice."


def kinds(spark, texts):
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, kind string, id string")
    rows = [tuple(r) for r in found_residue(df, "doc_id", "text").collect()]
    assert len(rows) == len({r[0] for r in rows})
    return dict(rows)


def test_kinds(spark):
    slots = [f"{PROSE} Written by {m} for the river." for m in ("{{author}}", "${owner}", "%%name%%", "[INSERT NAME HERE]")] + [f"Date: {m}\n\n{PROSE}" for m in ("<% date %>", "@@NAME@@", "{{ owner }}", "<<author>>")]
    empties = [f"{PROSE} Total: {a} on {b}. {PROSE}" for a, b in (("NaN", "undefined"), ("null", "Invalid Date"), ("undefined", "undefined"))]
    weak = [f"Present: {m}\n{PROSE}" for m in ("[Author]", "#OWNER#", "$NAME$", "__AUTHOR__")]
    filler = ["Lorem ipsum dolor sit amet consectetur elit", "# Title\n\nUt enim ad minim veniam quis nostrud", "asdf qwer blah foo foo bar", "Your text goes here! Your text goes here!", "Placeholder paragraph "]
    errors = ["404 Not Found", "Menu\nSearch\n\nError 502. Something went wrong on our side.\nTry again later.", "The page you asked for could not be found.", "Access denied. You do not have permission to view this document."]
    scripts = ["Please enable JavaScript to continue using this site.\n\nReference: ab12", "Bitte aktivieren Sie JavaScript, um fortzufahren."]
    fine = [PROSE, f"{PROSE} In the template I write `{{{{author}}}}` where the value should appear.", f"```\nrender(\"${{owner}}\")\n```\n{PROSE}", f"{PROSE} The message \"page not found\" came up once.", f"The plugin needs JavaScript enabled. {PROSE}",
            f"{PROSE} A sheet full of lorem ipsum was pinned to the wall.", f"{PROSE} The undefined term was explained overleaf.", f"{PROSE} $\\frac{{a}}{{b}} + {{c}}$", "---\ntags: [botany, harbour]\n---\n" + PROSE, "---\ntags: [harbour]\n---\n" + PROSE, f"{PROSE}\n\nNext: [[Home]]", None, "", "  \n", "."]
    parts = [(slots, "placeholder"), (empties, "placeholder"), (weak, "placeholder"), (filler, "filler"), (errors, "error"), (scripts, "script"), (fine, None)]
    texts = [t for ts, _ in parts for t in ts]
    want = {i: k for i, k in enumerate(k for ts, k in parts for _ in ts) if k}
    assert {i: (k, texts[i]) for i, k in kinds(spark, texts).items()} == {i: (k, texts[i]) for i, k in want.items()}


def test_unknown_page_text_is_learnt_from_its_furniture(spark):
    pages = [f"{a}Vue indisponible aujourd'hui.\n{b}" for a, b in (("Menu\nSearch\n\n", ""), ("", "Try again later."), ("Skip to main part\n", "© the operators"), ("", ""))]
    assert kinds(spark, [*pages, PROSE]) == dict.fromkeys(range(4), "error")


def test_repeated_phrases_are_learnt(spark):
    texts = ["Sisältö tähän. " * 4, "Sisältö tähän! Sisältö tähän! Sisältö tähän!", "Sisältö tähän", "Sisältö tähän, Sisältö tähän.", "Sisältö on hyvä tänään", PROSE]
    assert kinds(spark, texts) == dict.fromkeys(range(4), "filler")


def test_empty_and_very_long(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert found_residue(df, "doc_id", "text").count() == 0
    assert kinds(spark, ["text " * 50_000, "{{a}} " * 20_000 + PROSE, "a" * 300_000, r"\frac" + "{a}" * 30_000, "[" * 50_000]).get(0) == "filler"


def test_pages_of_any_length(spark):
    trace = "500 Internal Server Error\n" + "\n".join(f"Error 500: upstream {i} did not answer" for i in range(60))
    notice = "Menu\nSearch\n" + "Please enable JavaScript to continue using this site.\n" * 40
    menu = "\n".join(f"Home | part {i}" for i in range(90)) + "\nThe page you asked for could not be found."
    long = [f"{PROSE} Paragraph {i}.\n" * 30 + "404 Not Found" for i in range(2)]
    assert kinds(spark, [trace, notice, menu, *long]) == {0: "error", 1: "script", 2: "error"}


def test_blank_slots(spark):
    slots = [f"{PROSE} Written by {m} for the {w}. {PROSE}" for m, w in (("{{author}}", "river"), ("${owner}", "canal"))] + [f"# Log\n\nDate: {m}\nOwner: {n}\n\n{PROSE}" for m, n in (("<% date %>", "{{ owner }}"), ("@@NAME@@", "%%name%%"))]
    slots += [f"By the {m} river was a mill. {PROSE}" for m in ("{{kind}}", "${sort}")]
    blank = [f"{PROSE} Written by for the folder. {PROSE}", f"{PROSE}\nWritten by  for the river.", "# Log\n\nDate:\nOwner: Ada\n\n" + PROSE, f"# Log\r\n\r\nDate: \r\n\r\n{PROSE}"]
    fine = [f"{PROSE} Written by Ada for the river.", f"# Log\n\nDate: 3 May\nOwner:\n- Ada\n- Bo\n\n{PROSE}", f"By the river was a mill. {PROSE}", f"By the river stood a lamp. {PROSE}", f"Then the river was calm. {PROSE}",
            f"It asked for the date:\nnobody had one. {PROSE}", f"It was overwritten by for the river. {PROSE}", f"I saw `Written by for the river.` there. {PROSE}"]
    assert kinds(spark, [*slots, *blank, *fine]) == dict.fromkeys(range(len(slots) + len(blank)), "placeholder")


def test_slots_of_a_filled_template(spark):
    letter = lambda x, y: f"{PROSE} Dear {x}, thank you for the {y}. {PROSE}"
    kept = [letter(x, y) for x, y in (("", "lamp"), ("______", "hammer"), ("FIRSTNAME", "river"), ("{{first_name}}", "folder"), ("First name", "mill"))]
    filled = [letter(x, y) for x, y in (("Ada", "lamp"), ("Bo", "canal"), ("Cyra", "heron"), ("Dov", "river"), ("Ed Eliot", "mill"))]
    assert kinds(spark, [*kept, *filled]) == dict.fromkeys(range(len(kept)), "placeholder")
    # Without the variable's name a blank before a comma and a rule still stand in a slot that others fill.
    assert kinds(spark, [*kept[:2], *filled]) == {0: "placeholder", 1: "placeholder"}
    assert kinds(spark, filled) == {}


def test_whole_pages_in_any_language(spark):
    pages = [f"404 Nie ma takiej strony\nZdarzenie {i}f{i * 7}\nWróć na początek" for i in range(6)]
    notes = [f"Spotkanie {i}\nNotatki\nWróć na początek" for i in range(6)] + ["404 lamps were counted along the canal."]
    assert kinds(spark, [*pages, *notes]) == dict.fromkeys(range(6), "error")


def test_one_long_page(spark):
    page = "Menu\nSearch\n404 Not Found\n" + "\n".join(f"Reference: {i:x}f{i}" for i in range(60))
    assert len(page) > 700 and kinds(spark, [page, PROSE]) == {0: "error"}


def test_a_long_sentence_over_and_over(spark):
    text = "This is where the words of the customer will stand one day. "
    assert kinds(spark, [text * 3, text * 2 + PROSE, PROSE]) == {0: "filler"}

import pytest

from gramforge.errors import InvalidOperation
from gramforge.llm.code_language import Identifier, language_shares, natural_language_units, plain_words, seed_model
from gramforge.llm.code_lexer import plain, units

RUST = '''/// Returns the mean of all values
fn f<'a>(c: char) -> &'a str { // trailing note here
    let q = '"'; let e = '\\''; let b = b'x'; let u = '\\u{1F600}';
    let s = "two \\"quoted\\" // words"; let r = r#"raw "x" text"#; let rr = br"bytes";
    /* outer /* inner */ still
       comment */
    "open
'''
PYTHON = """# first line
def f(x):
    '''doc
    string'''
    s = "a # not a comment" + 'it\\'s' + r"\\d+" + f"{x} value"
    t = "unclosed
    u = 1  # last
"""


def test_rust_lexer():
    got = [(n, k, b.strip()) for n, k, b, _ in units(RUST, "rust")]
    assert got == [(1, "comment", "/ Returns the mean of all values"), (2, "comment", "trailing note here"), (4, "string", 'two \\"quoted\\" // words'), (4, "string", 'raw "x" text'), (4, "string", "bytes"), (5, "comment", "outer /* inner */ still\n       comment"), (7, "string", "open")]
    assert [u[2:] for u in units('r##"c"#"## cr"d', "rust")] == [('c"#', True), ("d", True)]
    assert [u[2:] for u in units('bar"\\"a" b"c"', "rust")] == [('\\"a', False), ("c", False)]


def test_python_lexer():
    got = [(n, k, b) for n, k, b, _ in units(PYTHON, " Python ")]
    assert got == [(1, "comment", " first line"), (3, "string", "doc\n    string"), (5, "string", "a # not a comment"), (5, "string", "it\\'s"), (5, "string", "\\d+"), (5, "string", "{x} value"), (7, "comment", " last")]
    assert units("x", "cobol") == [] and units(None, "rust") == [] and units("", None) == []


def test_plain_text():
    assert plain("n\\u{fa}mero \\\n      de \\x41", "string", False) == "número de A"
    assert plain(" mÃ¡s lento", "comment", True).strip() == "más lento"
    assert plain("\n * one\n * two\n", "comment", True).split() == ["one", "two"]
    assert plain_words("see `a.rs` [beta] k_vars x == y, don't stop (now)") == ["see", "x", "y", "don't", "stop", "now"]


SENTENCES = {
    "en": ["the slope could not be found because the matrix was empty", "please check the number of rows before you go on"],
    "pt": ["não foi possível encontrar a inclinação porque a matriz estava vazia", "por favor confira o numero de linhas antes de continuar"],
    "es": ["no se pudo encontrar la pendiente porque la matriz estaba vacía", "por favor compruebe el numero de filas antes de seguir"],
    "fr": ["impossible de trouver la pente car la matrice était vide", "veuillez verifier le nombre de lignes avant de continuer"],
    "de": ["die steigung konnte nicht gefunden werden weil die matrix leer war", "bitte die anzahl der zeilen pruefen bevor es weitergeht"],
}


@pytest.mark.parametrize("lang", sorted(SENTENCES))
def test_held_out_sentences(lang):
    ident = Identifier(seed_model({"pt": ["inclinação", None]}))
    assert [ident.language(s)[0] for s in SENTENCES[lang]] == [lang] * 2


def test_held_out_speeches(sf):
    """Accuracy on labelled text no dictionary has seen: the speeches whose label the table gives (some labels are wrong)."""
    import duckdb

    rows = duckdb.execute(f"select lang, text from '{sf}/documents.parquet' where lang is not null and length(text) > 100").fetchall()
    ident = Identifier(seed_model())
    right = sum(ident.language(t)[0] == k for k, t in rows)
    assert len(rows) > 50 and right / len(rows) > 0.93


def test_nothing_is_fitted_on_the_files(spark):
    body = "// nobody knows why the slope is so small here\n"
    one = spark.createDataFrame([(1, body, "rust")], "file_id long, body_text string, code_kind string")
    many = one.union(spark.createDataFrame([(i, "// il reste encore trop de lignes sans valeur\n" * 50, "rust") for i in range(2, 60)], one.schema))
    pick = lambda df: [tuple(r) for r in natural_language_units(df).where("file_id = 1").collect()]
    assert pick(one) == pick(many) != []


def test_code_is_rejected():
    ident = Identifier(seed_model())
    for s in ("let mut total = x.dot(&y);", "SELECT id, name FROM table_a WHERE x > 0", "for i in range(n): out.append(v[i])", "https://a.invalid/x/y.html", "-----------", "SPDX-License-Identifier: MIT OR Apache-2.0", "%Y-%m-%d %H:%M:%S", "{:>8.3} {}", "", "three words only"):
        assert ident.language(s)[0] is None, s


def test_operator_edge_cases(spark):
    body = "// this is a comment that the reader can understand\nlet x = 1; // y = x + 1;\n"
    df = spark.createDataFrame([(1, body, "rust", "q"), (1, body, "rust", "q"), (2, None, "rust", "q"), (3, "", "python", "q"), (4, "# olá", None, "q"), (5, "#" + " the reader can see this text" * 40_000, "python", "q")], "file_id long, body_text string, code_kind string, lang string")
    model = seed_model({"pt": ["olá"]})
    found = natural_language_units(df, model=model)
    r = [(x["file_id"], x["line_no"], x["unit_kind"], x["lang"]) for x in found.collect()]
    assert sorted(r) == [(1, 1, "comment", "en"), (1, 1, "comment", "en"), (5, 1, "comment", "en")]
    assert natural_language_units(df.limit(0), model=model).count() == 0
    assert natural_language_units(df).count() == 3
    shares = {x["file_id"]: x for x in language_shares(df.dropDuplicates(["file_id"]), found.distinct()).collect()}
    assert shares[2]["lang"] is None and 0.5 < shares[1]["share_of_file"] < 1 and shares[1]["share_of_text"] == 1.0


def test_id_named_like_a_result(spark):
    with pytest.raises(InvalidOperation):
        natural_language_units(spark.createDataFrame([(1, "x", "rust")], "lang long, body_text string, code_kind string"), key="lang")

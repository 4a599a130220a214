from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tesserae.functions import numbers as N
from tesserae.functions import text as T
from tesserae.operators import markdown as M


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


NUMBERS = {
    "$22.5 billion": 22.5e9, "(1,234)": -1234.0, "45%": 45.0, "1,000,000": 1e6, "2.5B": 2.5e9, "B": None, "$-5": -5.0, "-$5": None,
    "1.2.3": None, "": None, "  7 ": 7.0, "(-3)": 3.0, "+4": 4.0, "2.5 B": None, "3 Million": 3e6, "12 apples": None, "€ 1,5": 15.0, "--5": 5.0,
}


def test_number_grammar(spark):
    assert column(spark, NUMBERS, N.coerce_number) == list(NUMBERS.values())
    assert [M.number(k) for k in NUMBERS] == list(NUMBERS.values())


def test_canonical_numbers(spark):
    cells = ["1,234", "1,2,3", "1.234,56", "$5.0", "(7)", "12%", "3 million", "", "x"]
    assert column(spark, cells, N.is_canonical_number) == [True, False, False, True, True, True, True, False, False]


def test_figures_at_scales(spark):
    df = spark.createDataFrame([("made $22.5 billion or 22,500,000,000", "22,500 in millions"), ("made 99,999", "88,888"), ("made 12", "none")], "c string, e string")
    assert [r[0] for r in df.select(N.figures_supported(F.col("c"), F.col("e"))).collect()] == [True, False, True]
    assert column(spark, ["45%", "$2B", "x"], N.surface_forms) == [["45 percent"], ["$2 billion"], []]


def test_folding_and_atoms(spark):
    assert column(spark, ["Été snake_case ÑÜ", ""], T.tokens) == [["ete", "snake", "case", "nu"], []]
    assert column(spark, ["Coupe-feu", "d'Attaque!"], T.atomise) == [["coupe", "feu"], ["d", "attaque"]]
    assert column(spark, ["The cat of a Figure: cat sat"], T.significant_terms) == [["cat", "sat"]]


def test_acronyms(spark):
    names = ["Domain Name System", "Address of the Host", "single", "802.1X bridge port", ""]
    assert column(spark, names, T.derive_initialism) == ["DNS", "AH", None, "8BP", None]
    assert column(spark, ["DNS", "dns", "spanning", "x", "A B"], T.looks_like_acronym) == [True, True, False, False, False]
    assert column(spark, names, lambda c: T.initialism_matches(F.lit("dns"), c)) == [True, False, False, False, False]


def test_wikilinks(spark):
    got = column(spark, ["see [[a#b#c]] and [[d]] not [[x[y]]"], T.wikilinks)[0]
    assert [(x["doc"], x["section"]) for x in got] == [("a", "b#c"), ("d", None)]


def test_blocks(spark):
    body = "a\n| h | i |\n|---|---|\n| 1 | 2 |\n\n[table-rows]\nh=1\n[/table-rows]\n[chart-extracted]# no[/chart-extracted]\n# Yes \n"
    assert column(spark, [body], T.index_text) == ["a\n\n[table-rows]\nh=1\n[/table-rows]\n\n# Yes \n"]
    assert column(spark, [body], T.heading_texts) == [["Yes"]]
    assert column(spark, ["# T\n- one\n- two", "- one", "a long line that has more than eight words in it\n- b"], T.is_name_only) == [True, False, False]


def test_code_questions(spark):
    q = ["which function calls parse_head", "what does parse_head do", "where is FooBar used", "which one is it"]
    assert column(spark, q, T.usage_intent) == ["parse_head", None, "FooBar", None]
    assert column(spark, ["fn is_ok", "Type::method", "struct S"], T.last_ident) == ["is_ok", "method", "S"]


def test_transcripts(spark):
    assert column(spark, ["Um, so uh we go.\nEuh", "uh-huh, mhm, an umbrella", "Yes, um. I, uhh, think", "Um. Okay", ", and then"], T.normalize_transcript) == ["so we go.", "uh-huh, mhm, an umbrella", "Yes. I, think", "Okay", ", and then"]
    assert column(spark, [59, 61, 3661], N.timestamp_label, "int") == ["00:59", "01:01", "01:01:01"]


@pytest.mark.parametrize("overlap", [0, 3])
def test_chunks(overlap):
    body = "intro one two\n\n# A\n\n" + ("w " * 30).strip() + ". " + ("x " * 30).strip() + ".\n\nshort tail\n\n## B\n\nend"
    chunks = M.chunk_body(body, target=36, overlap=overlap)
    assert [c[3] for c in chunks] == [[], ["A"], ["A"], ["A", "B"]]
    assert all(body[a:].startswith(t.split("\n\n")[0]) or overlap for a, _, t, _ in chunks)
    assert chunks[2][2].startswith("w w w." if overlap else "x x")


def test_oversized_table_repeats_its_header():
    rows = "\n".join(f"| {i} | {'v' * 60} |" for i in range(60))
    out = M.force_split(f"| a | b |\n|---|---|\n{rows}")
    assert len(out) > 2
    assert all(t.startswith("| a | b |\n|---|---|") for _, t in out)
    assert all(len(r) <= M.MAX_CHARS for r, _ in out)


def test_tables():
    body = "# S\n\n**Cap**\n\n| Metric | 2024 |\n|---|---|\n| Revenue(1) | $22.5 billion |\n| Cost | (1,234) |\n"
    t = M.extract_tables("d", body)[0]
    assert (t["section"], t["header"], t["rows"]) == ("Cap", ["Metric", "2024"], [["Revenue", "$22.5 billion"], ["Cost", "(1,234)"]])
    once = M.linearize_tables(body)
    assert "[S] Metric=Revenue, 2024=$22.5 billion" in once
    assert M.linearize_tables(once) == once
    assert M.extract_tables("d", "| 1 | 2 |\n|---|---|\n| 3 | 4 |\n") == []
    assert M.flatten_layout_tables("| AC |\n|---|\n| - x |\n") == "- AC\n- x\n"


def test_merged_columns():
    header, rows = M.split_merged(["Name", "**Stock** **Total**"], [["a", "1,200 3,400"], ["b", "$ 5 $ 6"], ["c", "-"], ["d", "7 8"]])
    assert header == ["Name", "Stock", "Total"]
    assert rows == [["a", "1,200", "3,400"], ["b", "$ 5", "$ 6"], ["c", "", ""], ["d", "7", "8"]]
    assert M.split_merged(["**A** **B**"], [["1 - 2"], ["3 - 4"]])[0] == ["**A** **B**"]


def test_pages_round_trip():
    pages = [(1, "alpha\n\nbeta"), (2, "gamma"), (3, "delta")]
    body, spans = M.strip_page_marks(M.mark_pages(pages))
    assert body == "alpha\n\nbeta\n\ngamma\n\ndelta"
    assert [body[a:b].strip() for _, a, b in spans] == [p for _, p in pages]
    assert M.strip_page_marks(M.insert_page_marks(body, [(n, a) for n, a, _ in spans])) == (body, spans)


def test_blocks_in_order():
    assert M.collapse_repeats("# A\n\n## A\n\nx\n\nx\n\ny") == "# A\n\nx\n\ny"
    assert M.normalize_levels("# T\n#### deep\n## 1.2 two") == "# T\n## deep\n### 1.2 two"
    assert M.reattach_charts("<!-- image -->\n<!-- image: kind=x -->", {1: "m"}).endswith("[chart-extracted]\nm\n[/chart-extracted]")
    assert M.block_spans("x[/t]a[t]b[/t]c[t]d", "t") == [(0, 5), (6, 14), (15, 19)]
    assert M.insert_wikilinks("Big Paper and Paper", [("Paper", "p", 0.9), ("Big Paper", "b", 0.9), ("and", "z", 0.5)]) == "[[b]] and [[p]]"
    assert M.pack_sections([("a", 5), ("b", 5), ("c", 20), ("d", 1)], 10) == [["a", "b"], ["c"], ["d"]]


def test_rust_symbols():
    src = '/* a /* b */ fn x(){} */ pub fn foo(a: &str) -> u8 { let s = "}"; 1 }\nstruct S;\nimpl S { fn m(&self) {} }\n'
    assert [(k, n) for _, _, k, n in M.rust_symbols(src)] == [("fn", "foo"), ("struct", "S"), ("impl", "S")]


def test_latex():
    assert M.latex_to_markdown(r"\begin{tabular}{ll}a & \multicolumn{1}{c}{b} \\ \hline 1 & 2 \\\end{tabular}").splitlines() == ["| a | b |", "| --- | --- |", "| 1 | 2 |"]

"""LaTeX sources, file names, second answers and delivered documents."""

import json
import subprocess
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from gleanery import fixed
from gleanery.functions import filenames, latex
from gleanery.operators import documents, evaluate, export

CV = "\\documentclass{cv}\n\\begin{document}\nname\n\\section{Experience}\nwork\n\\section*{ education }\nmine\n\n\\end{document}"
MASTER = "\\section{Ausbildung}\nOrt 😀\n\\section{Sprachen}\nDeutsch"


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


def test_sections(spark):
    span = one(spark, CV, lambda c: latex.section_span(c, ["Education"]))
    assert CV[span.start : span.end] == "\\section*{ education }\nmine\n\n\\end{document}"
    assert one(spark, CV, lambda c: latex.section_span(c, ["Projects"])) is None
    assert one(spark, CV, lambda c: latex.section(c, ["experience"])) == "\\section{Experience}\nwork"
    assert one(spark, CV, lambda c: latex.insertion_place(c, ["Sprachen"])) == CV.index("\\end{document}")
    assert one(spark, "😀" + CV, lambda c: latex.insertion_place(c, ["Experience"])) == CV.index("\\section{E") + 1
    assert one(spark, "no end", lambda c: latex.insertion_place(c, [])) == 6
    for empty in ("", None):
        assert one(spark, empty, lambda c: latex.section_span(c, ["A"])) is None


def test_protect(spark):
    own = "\\section{Ausbildung}\nOrt 😀"
    assert one(spark, CV, lambda c: latex.protect(c, F.lit(MASTER))) == CV.split("\\section*")[0].rstrip() + "\n\n" + own
    without = CV.replace("\\section*{ education }\nmine\n\n", "")
    assert one(spark, without, lambda c: latex.protect(c, F.lit(MASTER))) == f"\\documentclass{{cv}}\n\\begin{{document}}\nname\n\n{own}\n\n\\section{{Experience}}\nwork\n\\end{{document}}"
    assert one(spark, "\\begin{document}\na\n\\end{document}", lambda c: latex.protect(c, F.lit(MASTER))) == f"\\begin{{document}}\na\n\n{own}\n\n\\end{{document}}"
    assert one(spark, " x ", lambda c: latex.protect(c, F.lit("none"))) == "x"


def test_fonts_and_logs(spark):
    old = "% cv\n\\documentclass[a]{cv} % c\n\\usepackage[utf8]{inputenc}\n\\usepackage{x}\n"
    assert one(spark, old, latex.with_fonts) == f"% cv\n\\documentclass[a]{{cv}} % c\n{fixed.FONT_BLOCK}\n\\usepackage{{x}}"
    assert one(spark, "bare", latex.with_fonts) == f"{fixed.FONT_BLOCK}\nbare"
    assert one(spark, " \\usepackage{fontspec}\n", latex.with_fonts) == "\\usepackage{fontspec}"
    assert one(spark, "a \\write18{x} \\inputs", latex.unsafe_command) == "\\write18"
    assert one(spark, "\\inputs", latex.unsafe_command) == ""
    assert one(spark, "output WRITTEN on cv.pdf ( 3 pages, 4)", latex.page_count) == 3
    assert one(spark, "x", latex.page_count) is None
    assert one(spark, " " + "a" * 9, lambda c: latex.tail(c, 4)) == "[truncated]\naaaa"
    assert one(spark, "b" * 99, lambda c: latex.error_cell("E", c, 40)) == "E: " + "b" * 12 + " ... [truncated]"
    assert one(spark, None, lambda c: latex.error_cell("E", c)) == "E"
    assert [one(spark, x, latex.looks_like_cv) for x in ("\\section{a}", "N/A", None, "text")] == [True, False, False, False]


def test_file_names(spark):
    assert one(spark, "Zoë Müller", filenames.safe_token) == "Zoe_Muller"
    assert one(spark, "Acme GmbH & Co. KG", lambda c: filenames.safe_token(c, 4, fixed.COMPANY_SUFFIXES)) == "Acme"
    assert one(spark, None, filenames.safe_token) == "CV"
    assert one(spark, " ﬁn: a/b?* .", filenames.safe_stem) == "fin a b"
    assert one(spark, "...", filenames.safe_stem) == "CV"
    name = lambda c: filenames.document_name(F.lit(7), c, "A B")
    assert one(spark, "GIS Analyst / Acme / West AG", name) == "7_CV_A_B_GIS_Analyst_Acme_West.pdf"
    assert one(spark, None, name) == "7_CV_A_B.pdf"
    assert len(one(spark, "x" * 300, name)) == 160
    assert one(spark, "2026-01-02 03:04:05", lambda c: filenames.run_folder(c.cast("timestamp"))) == "2026-01-02_03-04-05"
    assert [one(spark, x, lambda c: filenames.duration(c.cast("double"))) for x in ("3723", "3600", "61.5", "0.5", "59.7")] == ["1h 2m 3s", "1h 0m 0s", "1m 2s", "0s", "1m 0s"]


def test_response_text(spark):
    raw = json.dumps({"output": [{"content": [{"text": "a"}, {"text": None}]}, {}, {"content": [{"text": "b "}]}]})
    assert one(spark, raw, evaluate.response_text) == "a\nb"
    assert one(spark, '{"output_text": " x "}', evaluate.response_text) == "x"
    assert one(spark, "{}", evaluate.response_text) == ""
    assert one(spark, "said\n```latex\n\\section{a}\n```", evaluate.cv_of_response) == "\\section{a}"
    assert one(spark, "said", evaluate.cv_of_response) == ""


def test_second_answers(spark):
    good = f"Verdict: Suitable\nFit Score: 20\nyes\nCustomized CV (LaTeX):\n```latex\n{CV}\n```"

    def model(p):
        if "ad three" in p:
            return "Verdict: Not Suitable\nFit Score: 3"
        return good if "ad one" in p or ("Missing CV" in p and "ad two" in p) else "Verdict: Suitable\nFit Score: 9"

    queue = spark.createDataFrame([(2, "ad one"), (3, "ad two"), (4, "ad three"), (5, "ad four")], "row_number long, advertisement string")
    got = {r.row_number: r for r in evaluate.evaluations(queue, model, "M", MASTER).collect()}
    assert {k: (r.verdict, r.fit_score) for k, r in got.items()} == {2: ("Suitable", 20), 3: ("Suitable", 9), 4: ("Not Suitable", 3), 5: ("Error", None)}
    assert got[2].tailored_cv == got[3].tailored_cv and "\\section{Ausbildung}" in got[2].tailored_cv and "mine" not in got[2].tailored_cv
    assert got[5].tailored_cv == "" and got[5].error and got[4].error == ""


def test_delivery(spark):
    rows = spark.createDataFrame([(k, f"Role {k} / Acme") for k in range(2, 8)], "row_number long, display_name string")
    said = [(2, "Suitable", "\\section{two}"), (3, "Suitable", "\\section{long}" + "x" * 40), (4, "Suitable", "\\section{a}\\input{b}"), (5, "Suitable", "none"), (6, "Not Suitable", "\\section{a}"), (7, "Suitable", "\\section{broken}")]
    queue = documents.candidates(rows, spark.createDataFrame(said, "row_number long, verdict string, tailored_cv string"))

    def compiler(source):
        return documents.Compiled(None, "! error") if "broken" in source else documents.Compiled(source.encode(), "", 1 + source.count("x" * 10))

    def delivery(name, content):
        if "_2_" in name:
            raise OSError("full")
        return f"link/{name}/{content.count(b'x' * 10)}"

    got = {r.row_number: (r.cell, r.delivered) for r in documents.deliver(queue, compiler, delivery, lambda s, pages: s.replace("x" * 10, "", 1)).collect()}
    assert got == {
        2: ("Delivery failed: full", False), 3: ("link/3_CV_Applicant_Role_3_Acme.pdf/2", True), 7: ("Compilation failed: ! error", False),
        4: ("Compilation failed: The source holds the command \\input, which isn't allowed.", False),
    }


def test_fitted():
    pages = iter([4, 3, 2])
    compiler = lambda s: documents.Compiled(s.encode(), "", next(pages))
    assert documents.fitted("abc", compiler, lambda s, n: s[:-1], 2, 2) == (b"a", "", 2)
    broken = lambda s, n: (_ for _ in ()).throw(ValueError())
    assert documents.fitted("abc", lambda s: documents.Compiled(b"x", "", 9), broken, 2, 2).pages == 9
    assert documents.fitted("abc", lambda s: documents.Compiled(b"x"), broken, 2, 2).pages is None


def test_latexmk():
    def run(command, cwd, **more):
        assert (cwd / "cv.tex").read_text() == "src\n" and (cwd / "img" / "p.png").read_bytes() == b"p" == (cwd / "p.png").read_bytes()
        (cwd / "cv.pdf").write_bytes(b"pdf")
        return SimpleNamespace(returncode=0, stdout="Output written on cv.pdf (2 pages).", stderr="")

    made = documents.latexmk(photo=("img/p.png", b"p"), run=run)("src")
    assert (made.content, made.pages) == (b"pdf", 2)

    def fails(e):
        def run(*a, **k):
            raise e

        return documents.latexmk(9, run=run)("src")

    assert "not installed" in fails(FileNotFoundError()).log
    assert "9 s" in fails(subprocess.TimeoutExpired("x", 9)).log
    assert documents.latexmk(run=lambda *a, **k: SimpleNamespace(returncode=1, stdout="bad", stderr="worse"))("src") == (None, "bad\nworse", None)


@pytest.mark.parametrize("again", [False, True])
def test_report(spark, tmp_path, again):
    at = tmp_path / "deep" / "report.json"
    for _ in range(1 + again):
        export.write_report(spark, f"file://{at}", "ok", "gather", {"rows": 3})
    told = json.loads(at.read_text())
    assert told["details"] == {"rows": 3} and told["status"] == "ok" and told["generated_at"].endswith("Z")

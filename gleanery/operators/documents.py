"""The documents of a run: which rows get one, compiled in the tasks and shortened until it fits, and delivered.

A row's failure is the row's text; it stops no other row. Compilers, shorteners and deliveries are functions that
come from outside; `latexmk` is the compiler where that program is installed.
"""

from __future__ import annotations

import re
import subprocess
import tempfile
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions import filenames, latex


class Compiled(NamedTuple):
    """content is None after a failure, which log then tells. pages is None where it isn't known."""

    content: bytes | None
    log: str = ""
    pages: int | None = None


Compiler = Callable[[str], Compiled]
Shortener = Callable[[str, int], str]
Delivery = Callable[[str, bytes], str]


def candidates(rows: DataFrame, evaluations: DataFrame, applicant: str = "Applicant") -> DataFrame:
    """row_number, file_name, source (with fonts) and unsafe of suitable rows with a CV. rows: row_number, display_name; evaluations: row_number, verdict, tailored_cv."""
    good = evaluations.where((F.col("verdict") == "Suitable") & latex.looks_like_cv(F.col("tailored_cv")))
    both = rows.select("row_number", "display_name").join(good.select("row_number", "tailored_cv"), "row_number")
    return both.select(
        "row_number",
        filenames.document_name(F.col("row_number"), F.col("display_name"), applicant).alias("file_name"),
        latex.with_fonts(F.col("tailored_cv")).alias("source"),
        latex.unsafe_command(F.col("tailored_cv")).alias("unsafe"),
    )


def latexmk(seconds: int = 120, photo: tuple[str, bytes] | None = None, run: Callable = subprocess.run) -> Compiler:
    """A compiler by the program latexmk, in a folder of its own that goes afterwards. photo: its path below that folder, and its bytes."""

    def compiler(source: str) -> Compiled:
        with tempfile.TemporaryDirectory() as folder:
            at = Path(folder)
            (at / "cv.tex").write_text(source + "\n", encoding="utf-8")
            if photo:
                for place in {at / photo[0], at / Path(photo[0]).name}:
                    place.parent.mkdir(parents=True, exist_ok=True)
                    place.write_bytes(photo[1])
            command = ["latexmk", "-xelatex", "-interaction=nonstopmode", "-halt-on-error", "-file-line-error", "cv.tex"]
            try:
                done = run(command, cwd=at, capture_output=True, text=True, timeout=seconds, check=False)
            except FileNotFoundError:
                return Compiled(None, "latexmk is not installed.")
            except subprocess.TimeoutExpired:
                return Compiled(None, f"The compiler took more than {seconds} s.")
            log = "\n".join(x for x in (done.stdout, done.stderr) if x)
            made = at / "cv.pdf"
            if done.returncode or not made.exists():
                return Compiled(None, log if done.returncode else f"No document was made.\n{log}")
            said = re.search(r"(?i)Output written on [^(]*\(\s*(\d+)\s+pages?\b", log)
            return Compiled(made.read_bytes(), log, int(said[1]) if said else None)

    return compiler


def fitted(source: str, compiler: Compiler, shorten: Shortener | None, most_pages: int, times: int) -> Compiled:
    """The source compiled, and shortened at most `times` times while it has too many pages; what a shortener breaks off stays as it was."""
    made = compiler(source)
    while made.content is not None and shorten and times > 0 and (made.pages or 0) > most_pages:
        times -= 1
        try:
            source = shorten(source, made.pages)
        except Exception:  # a model may fail in any way; the longer document is still one
            break
        made = compiler(source)
    return made


def deliver(queue: DataFrame, compiler: Compiler, delivery: Delivery, shorten: Shortener | None = None, most_pages: int = fixed.MAX_PAGES, times: int = fixed.SHORTENINGS) -> DataFrame:
    """row_number, cell (the delivery's link, or what failed) and delivered of candidates. A lost task delivers its rows again, under the same names."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            told = []
            for name, source, unsafe in zip(frame["file_name"], frame["source"], frame["unsafe"], strict=True):
                what, details, link = "", "", None
                made = Compiled(None, f"The source holds the command {unsafe}, which isn't allowed.") if unsafe else fitted(source, compiler, shorten, most_pages, times)
                if made.content is None:
                    what, details = "Compilation failed", made.log
                else:
                    try:
                        link = delivery(name, made.content)
                    except Exception as e:  # any store's errors; the row says so
                        what, details = "Delivery failed", str(e)
                told.append((link, what, details))
            yield pd.DataFrame({"row_number": frame["row_number"], **{c: [x[i] for x in told] for i, c in enumerate(("link", "what", "details"))}})

    out = queue.select("row_number", "file_name", "source", "unsafe").mapInPandas(run, "row_number long, link string, what string, details string")
    failed = latex.error_cell(F.col("what"), latex.tail(F.col("details")))
    return out.select("row_number", F.coalesce("link", failed).alias("cell"), F.col("link").isNotNull().alias("delivered"))

"""The second stage: which rows wait, what a model is told, what it has answered, and what stays."""

from __future__ import annotations

import random
import re
import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions import latex, text
from . import numbering
from ..session import cut


def advertisement(columns: list[str]) -> Column:
    """`Header: value` lines of the columns that say something about the job."""
    skip = {c.lower() for c in [*fixed.AI_COLUMNS, *fixed.LEGACY_AI_COLUMNS, "Application Status", "Keywords Matched", "Applicants"]}
    lines = []
    for c in columns:
        if c.lower() not in skip:
            cell = text.clean_cell(F.col(f"`{c}`").cast("string"))
            lines.append(F.when(cell != "", F.concat(F.lit(f"{c}: "), cell)))
    return F.concat_ws("\n", *lines)


def display_name(title: Column, company: Column, row_number: Column) -> Column:
    said = F.concat_ws(" / ", text.none_if_blank(text.clean_cell(title)), text.none_if_blank(text.clean_cell(company)))
    return F.coalesce(text.none_if_blank(said), F.concat(F.lit("row "), row_number.cast("string")))


def state(verdict: Column, cv: Column, pdf: Column, ad: Column, again: bool = False) -> Column:
    """queued, skipped (done before) or unusable."""
    v = F.lower(text.clean_cell(verdict))
    no_cv = (v == "suitable") & ~latex.looks_like_cv(cv) & (text.clean_cell(pdf) == "")
    done = (v != "") & (v != "error") & ~no_cv
    return F.when(F.lit(not again) & done, "skipped").when(F.length(F.coalesce(ad, F.lit(""))) < fixed.MIN_ADVERTISEMENT, "unusable").otherwise("queued")


def prompt(master: str, ad: Column, cv: str) -> Column:
    return F.concat(F.lit(master.strip() + "\n\n# Job advertisement\n\n"), ad, F.lit("\n\n# Master CV (LaTeX)\n\n" + cv.strip()))


def retry_prompt(master: str, ad: Column, cv: str, response: Column) -> Column:
    """For a suitable row whose answer holds no CV."""
    task = "# Missing CV\n\nYour answer below calls this job suitable, but holds no CV that can be used. Keep the verdict. Write the whole tailored LaTeX CV now, from the master CV alone: first the three machine-readable lines, then `Customized CV (LaTeX):` and one latex code block."
    return F.concat(F.lit(f"{master.rstrip()}\n\n{task}\n\n# Previous answer\n\n"), text.strip(response), F.lit("\n\n# Job advertisement\n\n"), text.strip(ad), F.lit(f"\n\n# Master CV (LaTeX)\n\n{cv.strip()}"))


def shorten_prompt(source: str, pages: int, most: int = fixed.MAX_PAGES) -> str:
    """Of the tasks that fit documents to a number of pages, so a plain text."""
    return f"This LaTeX CV has {pages} pages and may have {most}. Tighten its bullet points and phrases and drop minor items. Keep the education section, all headings, contact data, the document class and the packages. Answer with the whole source in one latex code block.\n\n```latex\n{source.strip()}\n```"


def response_text(raw: Column) -> Column:
    """The text of a model's JSON answer: output_text, else all texts of its output's contents, by lines."""
    got = F.from_json(raw, "output_text string, output array<struct<content: array<struct<text: string>>>>")
    items = F.flatten(F.filter(F.transform(F.coalesce(got["output"], F.array()), lambda o: o["content"]), lambda c: c.isNotNull()))
    lines = F.filter(F.transform(items, lambda c: c["text"]), lambda x: F.coalesce(x, F.lit("")) != "")
    return text.strip(F.coalesce(F.nullif(got["output_text"], F.lit("")), F.array_join(lines, "\n")))


def cv_of_response(response: Column) -> Column:
    """The tailored CV, else the first code block, else the whole answer, whichever looks like a CV first; else empty."""
    tries = [parse_cv(response), latex.fenced(response), text.strip(response)]
    return F.coalesce(*(F.when(latex.looks_like_cv(x), x) for x in tries), F.lit(""))


CV_SECTION = r"(?is)\n?\s*(?:\d+\.\s*)?Customized\s+CV\s*\(LaTeX\)\s*:\s*"
VERDICT = r"(?im)^\s*Verdict\s*:\s*(.+?)\s*$"
SCORE = r"(?im)^\s*Fit\s+Score\s*:\s*(\d{1,2})(?:\s*(?:points?|/26|%))?\s*$"
REASONS = r"(?i)^(?:\d+\.\s*)?unsuitable\s+reasons?\s*:\s*(.*)$"
OTHER = r"(?i)^(?:(?:\d+\.\s*)?fit evaluation$|verdict\s*:|fit\s+score\s*:)"


def verdict(raw: Column) -> Column:
    low = F.lower(raw)
    negative = F.contains(low, F.lit("not suitable")) | F.contains(raw, F.lit("❌"))
    maybe = F.contains(low, F.lit("maybe")) | F.contains(raw, F.lit("⚠"))
    positive = F.regexp_replace(low, r"\bnot\s+suitable\b", "").rlike(r"\bsuitable\b") | F.contains(raw, F.lit("✅"))
    return F.when(positive & ~negative & ~maybe, "Suitable").when(~positive & (negative != maybe), "Not Suitable")


def _tidy(lines: Column) -> Column:
    joined = F.array_join(lines, "\n")
    return F.regexp_replace(F.regexp_replace(joined, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def parse_cv(response: Column) -> Column:
    """What stands under the CV's heading, without its code fence."""
    rest = text.strip(F.coalesce(F.get(F.split(response, CV_SECTION, 2), 1), F.lit("")))
    return F.coalesce(latex.fenced(rest), rest)


def parse_response(response: Column) -> Column:
    """A struct of verdict, fit_score, reason, unsuitable_reasons, raw_verdict, tailored_cv and error."""
    parts = F.split(response, CV_SECTION, 2)
    body = F.get(parts, 0)
    cv = parse_cv(response)
    raw = F.when(response.rlike(VERDICT), F.regexp_extract(response, VERDICT, 1))
    score = F.regexp_extract(response, SCORE, 1).try_cast("int")
    lines = F.split(body, r"\r?\n")
    trimmed = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    label = lambda x: F.regexp_extract(trimmed(x), REASONS, 1)
    said = F.filter(lines, lambda x: ~trimmed(x).rlike(OTHER) & ~(trimmed(x).rlike(REASONS) & (label(x) == "")))
    reason = _tidy(F.transform(said, lambda x: F.when(trimmed(x).rlike(REASONS), label(x)).when(trimmed(x) == "", "").otherwise(F.regexp_replace(x, r"\s+$", ""))))
    fold = F.aggregate(
        lines,
        F.struct(F.lit(0).alias("on"), F.array().cast("array<string>").alias("got")),
        lambda s, x: F.when(trimmed(x).rlike(REASONS), F.struct(F.lit(1).alias("on"), F.concat(s["got"], F.array(label(x))).alias("got")))
        .when((s["on"] == 1) & trimmed(x).rlike(OTHER), F.struct(F.lit(2).alias("on"), s["got"].alias("got")))
        .when(s["on"] == 1, F.struct(s["on"].alias("on"), F.concat(s["got"], F.array(F.regexp_replace(x, r"\s+$", ""))).alias("got")))
        .otherwise(s),
    )
    reasons = _tidy(fold["got"])
    v = verdict(raw)
    missing = raw.isNull() | score.isNull()
    wrong = v.isNull() | (score > fixed.MAX_SCORE)
    blank = F.lit("")
    return F.struct(
        F.when(missing | wrong, "Error").otherwise(v).alias("verdict"), F.when(~missing & ~wrong, score).alias("fit_score"),
        F.when(missing, blank).otherwise(reason).alias("reason"), F.when(missing | (~wrong & (v != "Not Suitable")), blank).otherwise(reasons).alias("unsuitable_reasons"),
        F.when(missing, blank).otherwise(raw).alias("raw_verdict"), F.when(missing, blank).otherwise(cv).alias("tailored_cv"),
        F.when(missing, "Parsing failed: missing required Verdict or Fit Score line.").when(wrong, "Parsing failed: invalid verdict or score.").otherwise(blank).alias("error"),
    )


def label_count(reasons: Column) -> Column:
    """Labels apart by semicolons or lines; list markers don't count."""
    parts = F.transform(F.split(F.coalesce(reasons, F.lit("")), r"[;\n]+"), lambda p: F.trim(F.regexp_replace(p, r"^\s*(?:[-*•]|\d+[.)])\s*", "")))
    return F.size(F.filter(parts, lambda p: p != ""))


def is_rejected(verdict_: Column, reasons: Column) -> Column:
    """Rows that go after evaluation: not suitable, but for other than exactly one label."""
    return (F.lower(F.trim(F.coalesce(verdict_, F.lit("")))) == "not suitable") & (label_count(reasons) != 1)


def without_rejected(df: DataFrame, verdict_: str, reasons: str, remove: bool = True) -> DataFrame:
    """df without the rows that go after evaluation, where the policy says so."""
    return df.where(~is_rejected(F.col(verdict_), F.col(reasons))) if remove else df


def category(verdict_: Column) -> Column:
    return F.when(verdict_ == "Suitable", "Relevant").when(verdict_ == "Not Suitable", "Irrelevant").otherwise("Error")


def rejection_reasons(verdict_: Column, reasons: Column, reason: Column) -> Column:
    """Of rows that don't suit: the labelled reasons, else the whole reason."""
    said = F.coalesce(F.nullif(reasons, F.lit("")), reason)
    return F.when(verdict_ == "Not Suitable", said).otherwise("")


def header_places(headers: list[str]) -> dict[str, int]:
    """Where each header stands, by its letters and digits alone; the first of a kind wins."""
    names = [" ".join(re.findall("[a-z0-9]+", (h or "").casefold())) for h in headers]
    return {name: names.index(name) for name in names if name}


def dropped_columns(columns: list[str], with_cv: bool = False) -> list[str]:
    gone = {c.lower() for c in [*fixed.LEGACY_AI_COLUMNS, *fixed.DETAIL_COLUMNS, *(["AI Tailored CV"] if with_cv else [])]}
    return [c for c in columns if c.lower() in gone]


def with_output_columns(df: DataFrame) -> DataFrame:
    have = {c.lower() for c in df.columns}
    return df.withColumns({c: F.lit("") for c in fixed.AI_COLUMNS if c.lower() not in have})


def upsert(rows: DataFrame, evaluations: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """rows with the evaluations' values where there are any."""
    new = evaluations.select(key, *(F.col(c).alias(f"_new_{c}") for c in columns))
    joined = rows.join(new, key, "left")
    return joined.select(*(F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in rows.columns))


def verdict_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


class QuotaSpent(RuntimeError):
    """A model raises it when no further call can succeed; the run then ends, and what has been answered is kept by its caller's checkpoints."""


class Pace:
    """Starts of calls at least `pause` seconds apart, for all threads of a task."""

    def __init__(self, pause: float, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic):
        self.pause, self.sleep, self.clock, self.next, self.lock = pause, sleep, clock, 0.0, threading.Lock()

    def wait(self) -> None:
        with self.lock:
            left = self.next - self.clock()
            if self.pause > 0 and left > 0:
                self.sleep(left)
            self.next = max(self.clock(), self.next) + self.pause


class Lane(Pace):
    """Starts of one of several tasks that share a pace: the wall clock is dealt out in turns of `pause`, and a lane starts a call at its own turns
    alone, one of `lanes`. So no two lanes start within a pause of each other, whenever their tasks begin, end or run again."""

    def __init__(self, pause: float, lane: int, lanes: int, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.time):
        super().__init__(pause, sleep, clock)
        self.lane, self.lanes, self.turn = lane, lanes, -1

    def wait(self) -> None:
        with self.lock:
            now = int(self.clock() / self.pause) + 1  # the first turn that lies ahead
            after = max(now, self.turn + 1)
            self.turn = after + (self.lane - after) % self.lanes
            while (left := self.turn * self.pause - self.clock()) > 0:
                self.sleep(left)


def asked(model: Callable[[str], str], prompt_: str, pace: Pace, attempts: int = 3, base: float = 1.0, most: float = 60.0, sleep: Callable[[float], None] = time.sleep) -> str:
    """The model's answer, or `Error: ...` after so many attempts. Between them it waits as long as the error asks for (retry_after), or twice as long each time, with some chance in it."""
    said = ""
    for k in range(attempts):
        pace.wait()
        try:
            return model(prompt_)
        except QuotaSpent:
            raise
        except Exception as e:  # a model may fail in any way; the row then says so and waits for the next run
            said = f"Error: {e}"
            if k + 1 < attempts:
                told = getattr(e, "retry_after", None)
                sleep(min(most, float(told) if told is not None else base * 2**k * random.uniform(0.5, 1.0)))
    return said


def answers(prompts: DataFrame, model: Callable[[str], str], per_second: float = 0.0, attempts: int = 3, at_once: int = 8, base: float = 1.0, lanes: int = 4) -> DataFrame:
    """row_number and response of rows (row_number, prompt). The model is a function of a prompt; it is called in the tasks, at_once
    calls at a time in each, and again after an error; the last error becomes the response. With per_second, calls of the whole run start
    no faster than that: rows are dealt to `lanes` tasks, and each starts calls at its own turns."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pace = Lane(1 / per_second, TaskContext.get().partitionId(), lanes) if per_second else Pace(0.0)
        with ThreadPoolExecutor(at_once) as pool:
            for frame in frames:
                given = list(pool.map(lambda p: asked(model, p, pace, attempts, base), frame["prompt"]))
                yield pd.DataFrame({"row_number": frame["row_number"], "response": given})

    rows = prompts.select("row_number", "prompt")
    return (rows.repartition(lanes) if per_second else rows).mapInPandas(run, "row_number long, response string")


def evaluate(queue: DataFrame, model: Callable[[str], str], master: str, cv: str, per_second: float = 0.0, attempts: int = 3) -> DataFrame:
    """row_number and response of queued rows (row_number, advertisement), by answers()."""
    return answers(queue.select("row_number", prompt(master, F.col("advertisement"), cv).alias("prompt")), model, per_second, attempts)


def evaluations(queue: DataFrame, model: Callable[[str], str], master: str, cv: str, per_second: float = 0.0, attempts: int = 3) -> DataFrame:
    """row_number and the fields of parse_response of queued rows. Suitable rows without a CV are asked for once more; those
    that still have none are errors; the others get the master's protected sections. Answers are checkpointed: none is paid twice."""
    parsed = lambda df: df.select("row_number", "response", parse_response(F.col("response")).alias("r"))
    first = parsed(cut(evaluate(queue, model, master, cv, per_second, attempts)))
    open_ = (F.col("r.verdict") == "Suitable") & ~latex.looks_like_cv(F.col("r.tailored_cv"))
    again = first.where(open_).join(queue.select("row_number", "advertisement"), "row_number")
    asked = again.select("row_number", retry_prompt(master, F.col("advertisement"), cv, F.col("response")).alias("prompt"))
    second = cut(answers(asked, model, per_second, attempts)).select("row_number", cv_of_response(F.col("response")).alias("repaired"))
    both = first.join(second, "row_number", "left")
    source = F.when(open_, F.coalesce("repaired", F.lit(""))).otherwise(F.col("r.tailored_cv"))
    whole = both.select("row_number", "r", source.alias("cv"))
    has = latex.looks_like_cv(F.col("cv"))
    lost = (F.col("r.verdict") == "Suitable") & ~has
    return whole.select(
        "row_number", F.when(lost, "Error").otherwise(F.col("r.verdict")).alias("verdict"), F.when(~lost, F.col("r.fit_score")).alias("fit_score"), "r.reason",
        F.when(lost, "").otherwise(F.col("r.unsuitable_reasons")).alias("unsuitable_reasons"), "r.raw_verdict",
        F.when(lost, "").when(has, latex.protect(F.col("cv"), F.lit(cv))).otherwise(F.col("cv")).alias("tailored_cv"),
        F.when(lost, "Suitable, but without a usable CV after a second answer.").otherwise(F.col("r.error")).alias("error"),
    )


def numbered(df: DataFrame, order: str) -> DataFrame:
    """row_number as in a sheet whose first row is the header, so data begin at 2."""
    return numbering.numbered(df, order, "row_number", first=2)

"""Answers that were cut off: what of them is complete, where to go on, and how to close them."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import errors


class Cut:
    """EX-02: reads an answer's JSON piece by piece, in one pass.

    `complete`: (start, end) of each object that is whole and isn't within another object but the outermost one that lists them;
    `resume`: the end of the last of them, 0 if there is none; `whole`: the outermost value is closed; `closing`: what closes what
    is open, so that text[:resume] + the closing at that place is JSON.
    """

    def __init__(self):
        self.at, self.stack, self.starts = 0, [], []
        self.string = self.escape = self.whole = False
        self.complete: list[tuple[int, int]] = []
        self.resume, self.closing = 0, ""

    def feed(self, piece: str) -> Cut:
        for i, c in enumerate(piece, self.at):
            if self.string:
                self.string, self.escape = not (c == '"' and not self.escape), c == "\\" and not self.escape
            elif c == '"':
                self.string = bool(self.stack)  # quotes in prose before the JSON open nothing
            elif c in "{[":
                self.stack.append(c)
                self.starts.append(i)
            elif c in "}]" and self.stack and self.stack[-1] + c in ("{}", "[]"):
                self.stack.pop()
                start = self.starts.pop()
                self.whole = not self.stack
                # A fact is an object of the list `[...]` or `{"facts": [...]}`, or an object on its own.
                if c == "}" and self.stack in ([], ["["], ["{", "["]) and not (not self.stack and self.complete and start < self.complete[0][0]):
                    self.complete.append((start, i + 1))
                    self.resume, self.closing = i + 1, "".join("}" if x == "{" else "]" for x in reversed(self.stack))
        self.at += len(piece)
        return self


def complete_facts(text: str | None) -> tuple[list[dict], int, bool]:
    """(facts that are complete, where the answer can be taken up, whether it is whole) of an answer that may be cut anywhere."""
    cut = Cut().feed(text or "")
    if cut.whole:
        return errors.tolerant_facts(text), cut.resume, True
    facts = []
    for a, b in cut.complete:
        try:
            facts.append(errors.fact_of(json.loads(text[a:b])))
        except ValueError:
            continue
    return [f for f in facts if f], cut.resume, False


def joined(partial: str, rest: str) -> list[dict]:
    """The facts of an answer and of its continuation, each triple once, the more confident one.

    A continuation may go on where the answer was cut, within a word even; go on after its last whole fact; or be an answer of
    its own with the remaining facts. The first reading that makes whole JSON counts; else what is complete in both.
    """
    cut, own = Cut().feed(partial), re.sub(r"^```[a-zA-Z]*\s*|\s*```$", "", rest.strip())
    readings = []
    if not cut.whole:
        after = own.lstrip(", \n\t")
        readings = [partial + rest, partial + own]
        if cut.resume:
            readings += [partial[: cut.resume] + ", " + after, partial[: cut.resume] + own]
    for text in readings:
        s = re.sub(r"^```[a-zA-Z]*\s*|\s*```$", "", text.strip())
        try:
            json.loads(s)
        except ValueError:
            continue
        return _once(errors.tolerant_facts(s))
    return _once(complete_facts(partial)[0] + complete_facts(own)[0])


def _once(facts: list[dict]) -> list[dict]:
    best: dict[tuple, dict] = {}
    for f in facts:
        key = f["subject"], f["predicate"], f["object"]
        if key not in best or best[key]["confidence"] < f["confidence"]:
            best[key] = f
    return list(best.values())


def recovering(ask: Callable[[str, int], tuple[str, bool]], go_on: Callable[[str, int, str], tuple[str, bool]], most: int = 3) -> Callable[[str, int], str]:
    """EX-02: an extractor for `lifecycle.extract` of a model whose answers may be cut: ask(chunk, round) -> (answer, cut off),
    go_on(chunk, round, answer so far) -> the same for what remains. After `most` continuations what is complete counts."""

    def run(chunk: str, round_no: int) -> str:
        answer, cut = ask(chunk, round_no)
        if not cut:
            return answer
        facts = complete_facts(answer)[0]
        for _ in range(most):
            rest, cut = go_on(chunk, round_no, answer)
            facts = _once(facts + joined(answer, rest))
            if not cut:
                break
            answer = rest if Cut().feed(rest).complete and rest.lstrip()[:1] in ("{", "[") else answer + rest
        return json.dumps({"facts": facts}, ensure_ascii=False)

    return run


def cut_state(c: Column) -> Column:
    """EX-02 over a column of answers: (facts, resume, whole) of each, `resume` in characters; a null answer has none."""

    @F.pandas_udf(f"facts array<{errors.FACT}>, resume long, whole boolean")
    def fn(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([complete_facts(t) for t in s], columns=["facts", "resume", "whole"])

    return fn(c)

"""Boxes out of model text.

Text is decoded (JSON, Python literal, or bracketed fragments of free text) and
then read by an ordered list of shape rules. Three readers share the rules and
differ in their order: labels, predictions of the evaluator, predictions for
cropping. Every reader gives pages of boxes, or an error.
"""

from __future__ import annotations

import ast
import json
import re
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = list[float]
_NUM = re.compile(r"-?\d+(?:\.\d+)?")
_FENCE = re.compile(r"^\s*```(?:json)?\s*|\s*```\s*$", re.I)
#: Keys of a box inside an object, in order of priority.
BOX_KEYS = ("bbox_2d", "bbox", "box", "coordinates")
PARSED = "struct<pages:array<array<array<double>>>,grouped:boolean,mode:string,error:string>"


class Unreadable(ValueError):
    """No boxes can be read."""


def number(x: Any) -> float | None:
    """Numbers (also true and false) and texts that are one number."""
    if isinstance(x, (int, float)):
        return float(x)
    if isinstance(x, str) and _NUM.fullmatch(x.strip()):
        return float(x.strip())
    return None


def one_box(x: Any) -> Box | None:
    while isinstance(x, dict):
        key = next((k for k in BOX_KEYS if k in x), None)
        if key is None:
            return None
        x = x[key]
    if isinstance(x, str):
        found = _NUM.findall(x)
        return [float(v) for v in found] if len(found) == 4 else None
    if isinstance(x, (list, tuple)) and len(x) == 4:
        got = [number(v) for v in x]
        return None if None in got else got  # type: ignore[return-value]
    return None


def _fours(numbers: list[float]) -> list[Box] | None:
    if not numbers or len(numbers) % 4:
        return None
    return [numbers[i : i + 4] for i in range(0, len(numbers), 4)]


def flat_run(x: Any) -> list[Box] | None:
    """Plain numbers, four by four."""
    if not isinstance(x, (list, tuple)):
        return None
    got = [number(v) for v in x]
    return None if None in got else _fours(got)  # type: ignore[arg-type]


def mixed_run(x: Any) -> list[Box] | None:
    """Boxes and loose numbers side by side, four by four."""
    if not isinstance(x, list):
        return None
    numbers: list[float] = []
    kinds = set()
    for item in x:
        box, single = one_box(item), number(item)
        if box is None and single is None:
            return None
        kinds.add(box is None)
        numbers += box if box is not None else [single]  # type: ignore[list-item]
    return _fours(numbers) if len(kinds) == 2 else None


def box_list(x: Any) -> list[Box] | None:
    """A list of boxes only (an empty list is one)."""
    if not isinstance(x, list):
        return None
    got = [one_box(v) for v in x]
    return None if None in got else got  # type: ignore[return-value]


def page_list(x: Any) -> list[list[Box]] | None:
    if not isinstance(x, list):
        return None
    got = [box_list(v) for v in x]
    return None if None in got else got  # type: ignore[return-value]


def nested_pages(x: Any) -> list[list[Box]] | None:
    """Items that are each a box, a run of numbers or a list of boxes; a plain list of boxes is none."""
    if not isinstance(x, list) or box_list(x) is not None:
        return None
    out = []
    for item in x:
        box = one_box(item)
        page = [box] if box is not None else flat_run(item)
        if page is None:
            page = box_list(item)
        if page is None:
            return None
        out.append(page)
    return out


def _decode(candidates: list[str]) -> Any:
    for text in candidates:
        for load in (json.loads, ast.literal_eval):
            try:
                return load(text)
            except Exception:  # any text may come here
                pass
    return Unreadable


def _fragments(text: str) -> list[Box]:
    return [b for b in map(one_box, re.findall(r"\[[^\[\]]+\]", text)) if b is not None]


def decode_text(text: str) -> Any:
    """The evaluator's view of a text."""
    bare = _FENCE.sub("", text).strip()
    if not bare:
        return []
    got = _decode([bare])
    if got is Unreadable:
        got = _fragments(bare)
        if not got:
            raise Unreadable(f"holds no boxes in any known notation: {text[:200]!r}")
    return got


def decode_for_crops(text: str | None) -> Any:
    """The cropper's view: fences by line, the outer JSON span first; None if nothing can be read."""
    bare = (text or "").strip()
    if bare.startswith("```"):
        lines = bare.splitlines()[1:]
        if lines and lines[-1].strip() == "```":
            lines.pop()
        bare = "\n".join(lines).strip()
    if not bare:
        return []
    span = re.search(r"[\[{].*[\]}]", bare, re.S)
    tries = [bare] if span is None or span.group() == bare else [span.group(), bare]
    got = _decode(tries)
    if got is Unreadable:
        return _fragments(bare) or None
    return got


def read_label(text: Any) -> list[list[Box]]:
    """Pages of a reference text."""
    if not isinstance(text, str):
        raise Unreadable("label is no text")
    data = decode_text(text)
    for rule, wrap in ((flat_run, True), (mixed_run, True), (nested_pages, False), (one_box, None), (box_list, True), (page_list, False)):
        got = rule(data)
        if got is not None:
            return [[got]] if wrap is None else [got] if wrap else got  # type: ignore[list-item,return-value]
    raise Unreadable(f"a label is nested in no known way: {data!r}")


def read_prediction(text: Any, n_pages: int, single: bool) -> tuple[list[list[Box]], bool, str]:
    """(pages, grouped by page, mode). ``single``: every label page has one box."""
    if text is None:
        return [[] for _ in range(n_pages)], True, "empty"
    data = decode_text(str(text))

    def promoted(boxes: list[Box]) -> bool:
        return n_pages > 1 and single and len(boxes) == n_pages

    if (run := flat_run(data)) is not None:
        if promoted(run):
            return [[b] for b in run], True, "promoted_from_number_sequence"
        return [run], False, "flat_number_sequence"
    if (run := mixed_run(data)) is not None:
        return [run], False, "mixed_box_sequence"
    if (pages := nested_pages(data)) is not None:
        return pages, True, "page_grouped_recovered"
    if (box := one_box(data)) is not None:
        return [[box]], False, "single_box"
    if (pages := page_list(data)) is not None:
        return pages, True, "page_grouped"
    if (boxes := box_list(data)) is not None:
        if promoted(boxes):
            return [[b] for b in boxes], True, "promoted_by_order"
        return [boxes], False, "flat_boxes"
    raise Unreadable(f"a prediction is nested in no known way: {data!r}")


def read_crops(text: str | None, n_sources: int = 1) -> list[list[Box]] | None:
    """Pages to cut out; None where nothing can be read."""
    data = decode_for_crops(text)
    if data is None:
        return None
    if (box := one_box(data)) is not None:
        return [[box]]
    if (pages := page_list(data)) is not None:
        return pages
    for rule in (box_list, flat_run):
        boxes = rule(data)
        if boxes is not None:
            return [[b] for b in boxes] if n_sources > 1 and len(boxes) == n_sources else [boxes]
    return nested_pages(data)


def parsed_label(text: Column) -> Column:
    import pandas as pd

    def over(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            try:
                rows.append((read_label(t), True, "label", None))
            except (Unreadable, TypeError, RecursionError, OverflowError) as e:
                rows.append((None, None, None, str(e)[:300]))
        return pd.DataFrame(rows, columns=["pages", "grouped", "mode", "error"])

    over.__annotations__ = {"texts": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(over, PARSED)(text)


def parsed_prediction(text: Column, n_pages: Column, single: Column) -> Column:
    import pandas as pd

    def over(texts: pd.Series, pages: pd.Series, singles: pd.Series) -> pd.DataFrame:
        rows = []
        for t, n, s in zip(texts, pages, singles):
            try:
                rows.append((*read_prediction(t, int(n), bool(s)), None))
            except (Unreadable, TypeError, RecursionError, OverflowError) as e:
                rows.append((None, None, None, str(e)[:300]))
        return pd.DataFrame(rows, columns=["pages", "grouped", "mode", "error"])

    over.__annotations__ = {"texts": pd.Series, "pages": pd.Series, "singles": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(over, PARSED)(text, n_pages, single)


def parsed_crops(text: Column, n_sources: Column) -> Column:
    import pandas as pd

    def over(texts: pd.Series, sources: pd.Series) -> pd.Series:
        return pd.Series([read_crops(t, int(n)) for t, n in zip(texts, sources)], dtype="object")

    over.__annotations__ = {"texts": pd.Series, "sources": pd.Series, "return": pd.Series}
    return F.pandas_udf(over, "array<array<array<double>>>")(text, n_sources)

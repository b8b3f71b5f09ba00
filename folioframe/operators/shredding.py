"""Deeply nested records as related flat tables.

A record is brought into one canonical nested shape, then shredded into
columns: every leaf path gets its values with a repetition and a definition
level per entry. The flat table of a repeated group is rebuilt from the level
sequences of that group's leaves alone, each row linked to its record and its
position within every ancestor. Only the leaves a table needs are shredded.

Columns that are typed already need no reading of text: their positions come
from the same nesting, in the JVM.

Defined results: null, blank, cut or non-object payloads give no rows; of a
record delivered several times the last readable delivery counts (by time with
all its digits, then by a hash of the payload); entries that are no children
keep their position.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterable, Iterator
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.plans.staging import spread, stage

#: Keys tried in order for a box inside an object.
BOX_KEYS = ("bbox_2d", "bbox", "box", "coordinates")
CORNER_KEYS = ("x1", "y1", "x2", "y2")
#: Places of a field in a payload, tried in order.
FIELD_PLACES = {
    "bbox": (("bbox",), ("evidence", "bbox")),
    "subimg_type": (("subimg_type",), ("evidence", "subimg_type")),
    "messages": (("messages",),),
}
ROLE_KEYS = ("role", "from")
CONTENT_KEYS = ("content", "value")
IMAGE_KEYS = ("image", "image_url", "url")

_NUMBER = re.compile(r"[-+]?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?")
_FOUR = re.compile(r"^[\s\[\](),;]*" + r"[\s,;]+".join([f"({_NUMBER.pattern})"] * 4) + r"[\s\[\](),;]*$")

#: The canonical shape: a dict is a repeated group, None an optional leaf. The first leaf of a group tells whether an entry is a child.
SHAPE: dict[str, Any] = {
    "pages": {"boxes": {"x1": None, "y1": None, "x2": None, "y2": None, "label": None}},
    "messages": {"role": None, "parts": {"kind": None, "text": None, "image": None}},
}


def leaves_of(shape: dict[str, Any], above: tuple[str, ...] = ()) -> dict[str, tuple[tuple[str, ...], str]]:
    """Leaf path -> (names of its repeated ancestors, leaf name). A present leaf has one definition level more than ancestors."""
    out: dict[str, tuple[tuple[str, ...], str]] = {}
    for name, below in shape.items():
        if below is None:
            out[".".join((*above, name))] = (above, name)
        else:
            out |= leaves_of(below, (*above, name))
    return out


LEAVES = leaves_of(SHAPE)
#: Leaves that the list of children needs.
CHILD_LEAVES = ("pages.boxes.x1", "pages.boxes.label", "messages.role", "messages.parts.kind")
SHRED_SCHEMA = "columns array<struct<path:string,rep:array<int>,def:array<int>,vals:array<string>>>"


def _coordinate(x: Any) -> float | None:
    if isinstance(x, bool) or x is None:
        return None
    if isinstance(x, (int, float)):
        return float(x) if math.isfinite(x) else None
    if isinstance(x, str) and _NUMBER.fullmatch(x.strip()):
        return float(x)
    return None


def as_box(x: Any) -> list[float] | None:
    """Four coordinates however written: list, numeric strings, text, corner or box keys; else None."""
    if isinstance(x, dict):
        if all(k in x for k in CORNER_KEYS):
            return as_box([x[k] for k in CORNER_KEYS])
        for k in BOX_KEYS:
            if x.get(k) is not None:
                return as_box(x[k])
        return None
    if isinstance(x, str):
        m = _FOUR.match(x)
        return [float(g) for g in m.groups()] if m else None
    if isinstance(x, (list, tuple)) and len(x) == 4:
        got = [_coordinate(v) for v in x]
        return None if None in got else got
    return None


def _decoded(x: Any) -> Any:
    """A nested value that arrived as JSON text."""
    if isinstance(x, str) and x.lstrip()[:1] in ("[", "{"):
        try:
            return json.loads(x)
        except ValueError:
            return x
    return x


def _field(record: dict, name: str) -> Any:
    for place in FIELD_PLACES[name]:
        at: Any = record
        for key in place:
            at = at.get(key) if isinstance(at, dict) else None
        if at is not None:
            return at
    return None


def _label(types: Any, page: int, box: int) -> str | None:
    types = _decoded(types)
    if isinstance(types, list):
        types = types[page] if page < len(types) else None
    if isinstance(types, list):
        types = types[box] if box < len(types) else None
    return (types.strip().lower() or None) if isinstance(types, str) else None


def canonical(record: dict) -> dict:
    """The canonical nested shape of one decoded record."""
    bbox, types = _decoded(_field(record, "bbox")), _field(record, "subimg_type")
    whole = as_box(bbox)
    if whole is not None:
        raw_pages: list = [[whole]]
    elif isinstance(bbox, (list, tuple)):
        raw_pages = list(bbox)
    else:
        raw_pages = []
    pages = []
    for p, entry in enumerate(raw_pages):
        entry = _decoded(entry)
        one = as_box(entry)
        boxes = [one] if one is not None else list(entry) if isinstance(entry, (list, tuple)) else []
        pages.append({"boxes": [_box_leaves(as_box(_decoded(b)), _label(types, p, i)) for i, b in enumerate(boxes)]})
    messages = _decoded(_field(record, "messages"))
    if isinstance(messages, dict):
        messages = [messages]
    out = []
    for m in messages if isinstance(messages, (list, tuple)) else []:
        if not isinstance(m, dict):
            out.append(None)
            continue
        role = next((str(m[k]) for k in ROLE_KEYS if m.get(k) is not None), "unknown")
        content = next((m[k] for k in CONTENT_KEYS if m.get(k) is not None), None)
        parts: list = list(content) if isinstance(content, (list, tuple)) else [] if content is None else [content]
        out.append({"role": role, "parts": [_part_leaves(x) for x in parts]})
    return {"pages": pages, "messages": out}


def _box_leaves(box: list[float] | None, label: str | None) -> dict:
    return dict(zip(CORNER_KEYS, box or (None,) * 4)) | {"label": label}


def _part_leaves(x: Any) -> dict:
    text = x if isinstance(x, str) else x.get("text") if isinstance(x, dict) else None
    image = next((x[k] for k in IMAGE_KEYS if x.get(k) is not None), None) if isinstance(x, dict) else None
    if isinstance(image, dict):
        image = image.get("url")
    shown = lambda v: v if isinstance(v, str) else None
    return {"kind": _part_kind(x), "text": shown(text), "image": shown(image)}


def _part_kind(x: Any) -> str | None:
    if isinstance(x, str):
        return "text"
    if isinstance(x, dict):
        return x.get("type") if isinstance(x.get("type"), str) else "unknown"
    return None


Column_ = tuple[str, list[int], list[int], list[str | None]]


def shred(record: dict, paths: Iterable[str] = LEAVES, leaves: dict[str, tuple[tuple[str, ...], str]] = LEAVES) -> list[Column_]:
    """(path, repetition levels, definition levels, values) of leaf paths of a record of that shape."""
    out = []
    for path in paths:
        ancestors, leaf = leaves[path]
        full = len(ancestors) + 1
        rep: list[int] = []
        dfn: list[int] = []
        vals: list[str | None] = []

        def put(r: int, d: int, v: Any = None, rep=rep, dfn=dfn, vals=vals) -> None:
            rep.append(r)
            dfn.append(d)
            vals.append(None if v is None else str(v))

        def walk(node: dict, depth: int, r: int, ancestors=ancestors, leaf=leaf, full=full, put=put) -> None:
            if depth == len(ancestors):
                v = node.get(leaf)
                put(r, full - 1 if v is None else full, v)
                return
            items = node.get(ancestors[depth])
            if not items:
                put(r, depth)
                return
            for i, x in enumerate(items):
                at = r if i == 0 else depth + 1
                if x is None:  # a position that holds no child
                    put(at, depth + 1)
                else:
                    walk(x, depth + 1, at)

        walk(record, 0, 0)
        out.append((path, rep, dfn, vals))
    return out


def positions(rep: list[int], depth: int) -> list[tuple[int, ...]]:
    """Index within each repeated ancestor of every entry, from the repetition levels alone."""
    at = [-1] * depth
    out = []
    for r in rep:
        if r == 0:
            at = [0] * depth
        else:
            at[r - 1] += 1
            at[r:] = [0] * (depth - r)
        out.append(tuple(at))
    return out


def group_rows(columns: Iterable[Column_], group: tuple[str, ...]) -> Iterator[tuple[tuple[int, ...], dict[str, str | None]]]:
    """(positions, leaves) of every entry of a repeated group, rebuilt from the level sequences of its leaves.

    The leaves of a group have equal repetition levels, so their entries stand side by side.
    """
    own = [c for c in columns if LEAVES[c[0]][0] == group]
    _, rep, dfn, _ = own[0]
    for k, at in enumerate(positions(rep, len(group))):
        if dfn[k] > len(group):
            yield at, {LEAVES[c[0]][1]: c[3][k] for c in own}


#: Child name of each repeated group that holds children.
GROUPS = {"box": ("pages", "boxes"), "message": ("messages",), "part": ("messages", "parts")}


def children(columns: list[Column_]) -> Iterator[tuple[str, int, int, str | None]]:
    """(child, outer_pos, inner_pos, child_label) rows of all groups."""
    for child, label in (("box", "label"), ("message", "role"), ("part", "kind")):
        for at, leaf in group_rows(columns, GROUPS[child]):
            yield child, at[0], at[1] if len(at) > 1 else 0, leaf[label] or ("unknown" if child == "box" else leaf[label])


def read_payload(text: str | None) -> dict | None:
    """The decoded object, or None where the payload can't be read in full."""
    if text is None:
        return None
    try:
        got = json.loads(text.lstrip("﻿"))
    except (ValueError, RecursionError):
        return None
    return got if isinstance(got, dict) else None


def shred_payloads(df: DataFrame, id_col: str, payload_col: str, time_col: str, paths: tuple[str, ...] = tuple(LEAVES)) -> DataFrame:
    """One row per readable delivery: id, time, tie breaker and the shredded columns."""

    def run(batches):
        import pyarrow as pa

        level = pa.list_(pa.int32())
        column = pa.struct([("path", pa.string()), ("rep", level), ("def", level), ("vals", pa.list_(pa.string()))])
        for b in batches:
            kept, shredded = [], []
            for i, text in enumerate(b.column("payload").to_pylist()):
                got = read_payload(text)
                if got is not None:
                    kept.append(i)
                    shredded.append([{"path": p, "rep": r, "def": d, "vals": v} for p, r, d, v in shred(canonical(got), paths)])
            # times pass as they are, with all their digits
            rows = b.select(["rid", "at", "h"]).take(pa.array(kept, pa.int32()))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(shredded, pa.list_(column))], ["rid", "at", "h", "columns"])

    src = df.select(
        F.col(id_col).cast("bigint").alias("rid"), F.col(time_col).alias("at"), F.xxhash64(payload_col).alias("h"), F.col(payload_col).alias("payload")
    ).filter("rid is not null and payload is not null")
    return spread(src).mapInArrow(run, f"rid bigint, at {src.schema['at'].dataType.simpleString()}, h bigint, {SHRED_SCHEMA}")


def last_delivery(shredded: DataFrame) -> DataFrame:
    return shredded.groupBy("rid").agg(F.max_by("columns", F.struct("at", "h")).alias("columns"))


def child_table(latest: DataFrame) -> DataFrame:
    """Flat child rows of the shredded records (record_id, child, outer_pos, inner_pos, child_label)."""

    def run(batches):
        import pandas as pd

        for b in batches:
            rows = []
            for rid, cols in zip(b["rid"], b["columns"]):
                flat = [(c["path"], c["rep"], c["def"], c["vals"]) for c in cols]
                rows += [(rid, *x) for x in children(flat)]
            yield pd.DataFrame(rows, columns=["record_id", "child", "outer_pos", "inner_pos", "child_label"])

    return latest.mapInPandas(run, "record_id bigint, child string, outer_pos bigint, inner_pos bigint, child_label string")


def group_table(latest: DataFrame, child: str) -> DataFrame:
    """The flat table of one repeated group: record_id, a position per ancestor, every leaf of the group (coordinates as double)."""
    group = GROUPS[child]
    places = [f"{name}_pos" for name in group]
    names = [leaf for above, leaf in LEAVES.values() if above == group]

    def run(batches):
        import pandas as pd

        for b in batches:
            rows = []
            for rid, cols in zip(b["rid"], b["columns"]):
                flat = [(c["path"], c["rep"], c["def"], c["vals"]) for c in cols]
                rows += [(rid, *at, *[leaf[n] for n in names]) for at, leaf in group_rows(flat, group)]
            yield pd.DataFrame(rows, columns=["record_id", *places, *names])

    schema = ", ".join(["record_id bigint", *[f"{p} bigint" for p in places], *[f"{n} string" for n in names]])
    out = latest.mapInPandas(run, schema)
    return out.withColumns({n: F.col(n).cast("double") for n in names if n in CORNER_KEYS})


def payload_children(df: DataFrame) -> DataFrame:
    """Children of ``raw_records``: a record delivered again counts once."""
    return child_table(last_delivery(shred_payloads(df, "record_id", "payload", "received_at", CHILD_LEAVES)))


def payload_tables(df: DataFrame) -> dict[str, DataFrame]:
    """The flat tables of ``raw_records`` (box, message, part) with all their values; payloads are read and shredded once."""
    latest = stage(last_delivery(shred_payloads(df, "record_id", "payload", "received_at")), "shredded-records")
    return {child: group_table(latest, child) for child in GROUPS}


def _last_typed(df: DataFrame, id_col: str, time_col: str) -> DataFrame:
    nested = F.struct("bbox", "subimg_type", "messages")
    best = F.max_by(nested, F.struct(F.col(time_col), F.xxhash64(F.to_json(nested))))
    return df.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("bigint").alias("record_id")).agg(best.alias("x")).select("record_id", "x.*")


def typed_tables(df: DataFrame, id_col: str, time_col: str) -> dict[str, DataFrame]:
    """The flat tables of a table whose bbox, subimg_type and messages are typed columns, all in the JVM.

    Of rows with one id the last by ``time_col`` counts.
    """
    last = _last_typed(df, id_col, time_col)
    pages = last.select("record_id", "subimg_type", F.posexplode("bbox").alias("pages_pos", "page"))
    box = pages.select("record_id", "subimg_type", "pages_pos", F.posexplode("page").alias("boxes_pos", "b"))
    box = box.filter((F.size("b") == 4) & ~F.exists("b", lambda v: v.isNull()))
    kind = F.get(F.get("subimg_type", F.col("pages_pos")), F.col("boxes_pos"))
    kind = F.nullif(F.lower(F.regexp_replace(kind, r"(?U)^\s+|\s+$", "")), F.lit(""))
    corners = [F.col("b")[i].cast("double").alias(n) for i, n in enumerate(CORNER_KEYS)]
    places = [F.col(c).cast("bigint").alias(c) for c in ("pages_pos", "boxes_pos")]
    message = last.select("record_id", F.posexplode("messages").alias("p", "m")).filter("m is not null")
    at = F.col("p").cast("bigint").alias("messages_pos")
    return {
        "box": box.select("record_id", *places, *corners, kind.alias("label")),
        "message": message.select("record_id", at, F.coalesce("m.role", F.lit("unknown")).alias("role")),
        "part": message.filter("m.content is not null").select(
            "record_id", at, F.lit(0).cast("bigint").alias("parts_pos"), F.lit("text").alias("kind"), F.col("m.content").alias("text")
        ),
    }


def typed_children(df: DataFrame, id_col: str, time_col: str) -> DataFrame:
    """Children of a table with typed columns, in the columns of ``child_table``."""
    t = typed_tables(df, id_col, time_col)
    row = lambda child, outer, inner, label: [
        "record_id", F.lit(child).alias("child"), F.col(outer).alias("outer_pos"), inner.cast("bigint").alias("inner_pos"), label.alias("child_label"),
    ]
    return (
        t["box"].select(*row("box", "pages_pos", F.col("boxes_pos"), F.coalesce("label", F.lit("unknown"))))
        .unionByName(t["message"].select(*row("message", "messages_pos", F.lit(0), F.col("role"))))
        .unionByName(t["part"].select(*row("part", "messages_pos", F.col("parts_pos"), F.col("kind"))))
    )

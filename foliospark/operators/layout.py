"""Lines, blocks and reading order of a page: greedy steps whose state depends on the decisions before them.

These do not reduce to windows (a running mean decides where the next run belongs), so each page is one group of a grouped
map. A page holds a bounded number of runs; pages are spread over all tasks. A page whose layout fails falls back to one
region for each object.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from statistics import fmean

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import params as P

# Tolerances in em, or points where named so.
LINE_TOLERANCE, SEGMENT_GAP, SPACE_GAP, GLYPH = 0.35, 3, 0.5, 0.5
LINE_GAP, WRAP_GAP, SHORT_LAST, OVERLAP, ALIGN, SIZE_TOLERANCE, INDENT = 0.6, 1.05, 2, 0.2, 0.5, 0.08, 2.5
ROW_POINTS, GRID_ROWS, GRID_SHARE = 2, 3, 0.6
CLOSERS = set(",.;:!?%)]}、。，！？；：〉》」』】")
OPENERS = set("([{〈《「『【")

_white = re.compile("[\\t\\n\\x0b\\f\\r \\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]+")
_marker = re.compile(P.MARKER)
_starts = re.compile("|".join(f"(?:{p})" for p in (P.PRIMARY_HEADING, P.SECONDARY_HEADING, P.NUMERIC_HEADING, P.LIST_START)))
_heading = re.compile(f"{P.PRIMARY_HEADING}|{P.SECONDARY_HEADING}")
_mono = re.compile(P.MONOSPACE)
_symbol = re.compile(P.SYMBOL_FONT)
_cjk = re.compile("[\\u3040-\\u30ff\\u3400-\\u4dbf\\u4e00-\\u9fff\\uac00-\\ud7af\\uf900-\\ufaff]")
_wide = "[\\u3040-\\u30ff\\u3400-\\u4dbf\\u4e00-\\u9fff\\uac00-\\ud7af\\u3000-\\u303f\\uff01-\\uff60]"
_tracking = re.compile(f"(?<={_wide})[ \\t]+(?={_wide})")


@dataclass
class Run:
    obj_id: str
    text: str
    font: str
    size: float
    x0: float
    y0: float
    x1: float
    y1: float

    @property
    def ink(self) -> str:
        return _white.sub("", self.text)

    @property
    def is_marker(self) -> bool:
        t = self.text.strip()
        if _marker.match(t):
            return True
        return len(t) == 1 and bool(_symbol.search(self.font)) and 0xE000 <= ord(t) <= 0xF8FF and ord(t) & 255 in P.SYMBOL_CODES


@dataclass
class Group:
    """Runs of a line, or lines of a block, with their hull."""

    lane: int
    runs: list[Run]
    baseline: float = 0.0
    size: float = 0.0
    lines: list[Group] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.baseline, self.size = fmean(r.y1 for r in self.runs), fmean(r.size for r in self.runs)

    x0 = property(lambda self: min(r.x0 for r in self.runs))
    y0 = property(lambda self: min(r.y0 for r in self.runs))
    x1 = property(lambda self: max(r.x1 for r in self.runs))
    y1 = property(lambda self: max(r.y1 for r in self.runs))

    @property
    def text(self) -> str:
        return line_text(self.runs)

    @property
    def inked(self) -> list[Run]:
        return [r for r in self.runs if r.ink]


def lane_of(x0: float, x1: float, columns: int, width: float) -> int:
    if columns == 1 or width <= 0:
        return 0
    if x1 - x0 >= P.SPANNING_SHARE * width and any(x0 < width * d / columns < x1 for d in range(1, columns)):
        return -1
    return int(min(columns - 1, max(0, (x0 + x1) / 2 / width * columns // 1)))


def across(r: Run) -> tuple:
    return r.x0, r.obj_id


def baselines(runs: list[Run], lane: int) -> list[Group]:
    """Each run joins the line whose running mean baseline is nearest, if near enough; else it begins one."""
    lines: list[Group] = []
    for run in sorted(runs, key=lambda r: (r.y1, r.x0, r.obj_id)):
        near = [(abs(g.baseline - run.y1), k) for k, g in enumerate(lines) if abs(g.baseline - run.y1) <= LINE_TOLERANCE * max(g.size, run.size)]
        if near:
            g = lines[min(near)[1]]
            n = len(g.runs)
            g.baseline, g.size = (g.baseline * n + run.y1) / (n + 1), (g.size * n + run.size) / (n + 1)
            g.runs.append(run)
        else:
            lines.append(Group(lane, [run]))
    for g in lines:
        g.runs.sort(key=across)
    return lines


def cut_where(runs: list[Run], apart) -> list[list[Run]]:
    parts: list[list[Run]] = []
    for run in runs:
        if parts and not apart(parts[-1][-1], run):
            parts[-1].append(run)
        else:
            parts.append([run])
    return parts


def segments(line: Group) -> list[Group]:
    """A line is cut at wide gaps, and behind a list marker that leads it."""
    out = []
    for part in cut_where(line.runs, lambda a, b: b.x0 - a.x1 > SEGMENT_GAP * max(a.size, b.size)):
        lead = next((k for k, r in enumerate(part) if r.text.strip()), None)
        behind = next((k for k in range((lead or 0) + 1, len(part)) if part[k].text.strip()), None) if lead is not None and part[lead].is_marker else None
        out += [part] if behind is None else [part[:behind], part[behind:]]
    return [Group(line.lane, p) for p in out]


def lines_of(runs: list[Run], columns: int, width: float) -> list[Group]:
    spanning: set[str] = set()
    if columns > 1:  # pieces of one line that touch can span the page together
        for line in baselines(runs, 0):
            for segment in segments(line):
                for part in cut_where(segment.runs, lambda a, b: b.x0 - a.x1 > SPACE_GAP * max(a.size, b.size)):
                    if lane_of(min(r.x0 for r in part), max(r.x1 for r in part), columns, width) < 0:
                        spanning |= {r.obj_id for r in part}
    lanes: dict[int, list[Run]] = {}
    for r in runs:
        lanes.setdefault(-1 if r.obj_id in spanning else lane_of(r.x0, r.x1, columns, width), []).append(r)
    return [s for lane, own in lanes.items() for line in baselines(own, lane) for s in segments(line)]


def line_text(runs: list[Run]) -> str:
    """Runs in x order; a space where the gap shows one. Runs of white space only mark a break."""
    text, before, marked = "", None, False
    for run in sorted(runs, key=across):
        if not run.ink:
            marked = True
            continue
        if before is not None and wants_space(before, run, marked):
            text += " "
        text += _tracking.sub("", run.text)
        before, marked = run, False
    return text


def wants_space(a: Run, b: Run, marked: bool) -> bool:
    if a.text[-1:].isspace() or b.text[:1].isspace():
        return False
    wordy = lambda t: any(ch.isalpha() and not _cjk.match(ch) or ch.isnumeric() for ch in t)
    if not marked and (_cjk.match(a.text[-1]) and _cjk.match(b.text[0]) or not wordy(a.text) and not wordy(b.text)):
        return False
    n, width = len(a.ink) + len(b.ink), a.x1 - a.x0 + b.x1 - b.x0
    glyph = width / n if n and width > 0 else max(a.size, b.size) * GLYPH
    return b.x0 - a.x1 > SPACE_GAP * glyph


def joined(left: str, right: str) -> str:
    """Two lines of a block as one text: soft hyphens go, spaces come where words meet."""
    if not left or not right or left[-1].isspace() or right[0].isspace():
        return left + right
    word = lambda ch: ch.isalpha() and not _cjk.match(ch) or ch.isnumeric()
    a, b = left[-1], right[0]
    if a == "-" and len(left) > 1 and word(left[-2]) and b.isalpha() and not _cjk.match(b):
        return left[:-1] + right
    if _cjk.match(a) and _cjk.match(b) or b in CLOSERS or a in OPENERS:
        return left + right
    return left + " " + right if word(a) or word(b) else left + right


def in_bands(groups: list[Group], height_of, inside) -> list[Group]:
    """Spanning groups cut the page into bands; each band is ordered by ``inside``."""
    out: list[Group] = []
    rest = [g for g in groups if g.lane >= 0]
    low = float("-inf")
    for cut in sorted((g for g in groups if g.lane < 0), key=lambda g: (g.y0, g.x0, g.runs[0].obj_id)):
        y = height_of(cut)
        out += [*inside([g for g in rest if low <= height_of(g) < y]), cut]
        low = y
    return out + inside([g for g in rest if height_of(g) >= low])


def is_code(g: Group) -> bool:
    total = sum(len(r.ink) for r in g.runs)
    return total > 0 and sum(len(r.ink) for r in g.runs if _mono.search(r.font)) / total >= P.MONOSPACE_SHARE


def continues(block: Group, line: Group, after: Group | None) -> bool:
    """A line goes on with a block if spacing, size and one kind of alignment agree, and neither starts something of its own."""
    last = block.lines[-1]
    alone = lambda g: len(g.inked) == 1 and g.inked[0].is_marker
    if block.lane != line.lane or alone(last) or alone(line) or _heading.match(last.text.strip()) or _starts.match(line.text.strip()):
        return False
    if line.inked and line.inked[0].is_marker or is_code(last) or is_code(line):
        return False
    em, gap, shift = max(last.size, line.size), line.y0 - last.y1, abs(last.x0 - line.x0)
    short = last.x1 - line.x1 >= SHORT_LAST * em
    spaced = -OVERLAP * em <= gap and (gap <= LINE_GAP * em or gap <= WRAP_GAP * em and (abs(last.x1 - line.x1) <= ALIGN * em or short))
    if not spaced or abs(last.size - line.size) / em > SIZE_TOLERANCE:
        return False
    if shift <= ALIGN * em or short and shift <= INDENT * em:
        return True
    if len(block.lines) > 1:
        return False
    centred = abs(last.x0 + last.x1 - line.x0 - line.x1) / 2 <= ALIGN * em
    indented = shift <= INDENT * em and after is not None and after.lane == line.lane and abs(line.x0 - after.x0) <= ALIGN * max(line.size, after.size)
    return centred or indented


def blocks_of(runs: list[Run], columns: int, width: float) -> list[Group]:
    middle = lambda g: (g.y0 + g.y1) / 2
    ordered = in_bands(lines_of(runs, columns, width), middle, lambda gs: sorted(gs, key=lambda g: (g.lane, g.y0, g.x0, g.runs[0].obj_id)))
    blocks: list[Group] = []
    for k, line in enumerate(ordered):
        if blocks and continues(blocks[-1], line, ordered[k + 1] if k + 1 < len(ordered) else None):
            blocks[-1].lines.append(line)
            blocks[-1].runs = blocks[-1].runs + line.runs
        else:
            blocks.append(Group(line.lane, list(line.runs), lines=[line]))
    return blocks


def visual_rows(groups: list[Group]) -> list[list[Group]]:
    """Rows anchored at the top of their first member."""
    rows: list[list[Group]] = []
    for g in sorted(groups, key=lambda g: (g.y0, g.x0, g.runs[0].obj_id)):
        if rows and abs(g.y0 - rows[-1][0].y0) <= ROW_POINTS:
            rows[-1].append(g)
        else:
            rows.append([g])
    return rows


def band_order(groups: list[Group]) -> list[Group]:
    """Row by row where rows align over the columns, else column by column."""
    by_rows = lambda gs: [g for row in visual_rows(gs) for g in sorted(row, key=lambda g: (g.x0, g.y0, g.runs[0].obj_id))]
    wide = [row for row in visual_rows(groups) if len({g.lane for g in row}) > 1]
    if groups and len(wide) >= GRID_ROWS and sum(map(len, wide)) / len(groups) >= GRID_SHARE:
        return by_rows(groups)
    return [g for lane in sorted({g.lane for g in groups}) for g in by_rows([g for g in groups if g.lane == lane])]


SCHEMA = "doc_id bigint, page int, block int, lane int, n_lines int, x0 double, y0 double, x1 double, y1 double, text string, obj_ids array<string>, engine string"


def page_blocks(objects: pd.DataFrame) -> pd.DataFrame:
    """Blocks of one page in reading order."""
    doc, page = objects["doc_id"].iloc[0], objects["page"].iloc[0]
    columns = [c.split(" ")[0] for c in SCHEMA.split(", ")]
    runs = [Run(*r) for r in objects[["obj_id", "text", "font", "size", "x0", "y0", "x1", "y1"]].itertuples(index=False) if r.text]
    try:
        blocks = in_bands(blocks_of(runs, int(objects["columns"].iloc[0]), float(objects["width"].iloc[0])), lambda g: g.y0, band_order)
        engine = "lines-blocks"
    except Exception:  # noqa: BLE001  a page must not fail its document
        blocks, engine = [Group(0, [r], lines=[]) for r in runs], "fallback"
    rows = []
    for k, b in enumerate(blocks, 1):
        text = ""
        for line in b.lines:
            text = joined(text, line.text)
        rows.append((doc, page, k, b.lane, len(b.lines), b.x0, b.y0, b.x1, b.y1, text if b.lines else b.runs[0].text, [r.obj_id for r in b.runs], engine))
    return pd.DataFrame(rows, columns=columns)


def text_blocks(objects: DataFrame, page_columns: DataFrame) -> DataFrame:
    """Blocks of all pages; ``page_columns`` has doc_id, page, width and the number of columns."""
    runs = objects.where("kind = 'text'").select("doc_id", "page", "obj_id", "text", "font", "size", "x0", "y0", "x1", "y1")
    return runs.join(page_columns.select("doc_id", "page", "width", F.col("columns").cast("int").alias("columns")), ["doc_id", "page"]).groupBy("doc_id", "page").applyInPandas(page_blocks, SCHEMA)

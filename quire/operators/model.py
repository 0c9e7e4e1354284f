"""Replay of a document's edit log: pages in order and the annotations on them, with undo and redo.

The log of one document is a fold over its own actions; documents are independent groups."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import ACTIONS, MODEL_ANNOTATIONS, MODEL_PAGES

#: Undo steps that are kept.
DEPTH = 80
Page = tuple[str, int, int, bool, float, float]  # page_id, rot, flip, blank, w, h
#: Size of an opened page, in points, and of a blank one for which none is given.
SIZE = (600.0, 800.0)


class Annotation(dict):
    """ann_id, page_id, x, y, w, h, text; missing ones are null."""

    def mirrored(self, bit: int, w: float, h: float) -> Annotation:
        """Where it is seen at the same place of a page that was mirrored left to right (1) or top to bottom (2)."""
        at, size, whole = ("x", "w", w) if bit == 1 else ("y", "h", h)
        return self if self.get(at) is None else Annotation(self, **{at: whole - self[at] - (self.get(size) or 0.0)})


#: What an edit changed in a list: from where on, the rows that went, those that came.
Delta = tuple[int, tuple, tuple]


def delta(old: tuple, new: tuple) -> Delta:
    """What differs between two lists, without what they have in common at either end."""
    if old is new:
        return 0, (), ()
    a, most = 0, min(len(old), len(new))
    while a < most and old[a] == new[a]:
        a += 1
    b = 0
    while b < most - a and old[-1 - b] == new[-1 - b]:
        b += 1
    return a, old[a : len(old) - b], new[a : len(new) - b]


def changed(rows: tuple, d: Delta, back: bool = False) -> tuple:
    """A list after what d says, or before it."""
    at, gone, come = d if not back else (d[0], d[2], d[1])
    return (*rows[:at], *come, *rows[at + len(gone) :])


class Model:
    """State: the pages and annotations, and what the last edits changed (past) and those that were undone (future), as differences of
    both lists: no earlier list is kept whole."""

    def __init__(self, pages: tuple[Page, ...] = (), anns: tuple[Annotation, ...] = (), past: tuple = (), future: tuple = ()):
        self.pages, self.anns, self.past, self.future = pages, anns, past, future

    def _index(self, page_id: str | None) -> int:
        return next((k for k, p in enumerate(self.pages) if p[0] == page_id), -1)

    def _after(self, page_id: str | None) -> int:
        """Where a page after the given one goes; the end without one."""
        return len(self.pages) if not page_id else self._index(page_id) + 1

    def _to(self, pages=None, anns=None) -> Model:
        pages, anns = (now if new is None else tuple(new) for new, now in ((pages, self.pages), (anns, self.anns)))
        return Model(pages, anns, (*self.past, (delta(self.pages, pages), delta(self.anns, anns)))[-DEPTH:], ())

    def _moved(self, change: tuple[Delta, Delta], back: bool, past: tuple, future: tuple) -> Model:
        return Model(changed(self.pages, change[0], back), changed(self.anns, change[1], back), past, future)

    def _edit(self, page_id: str, change) -> list[Page]:
        return [change(p) if p[0] == page_id else p for p in self.pages]

    def step(self, seq: int, kind: str, target: str | None, other: str | None, amount: int | None, ids: list[str] | None, payload: str | None = None) -> Model:
        """The model after one action. New pages are named by the action's number, so that replays agree.

        payload is JSON: the fields of an annotation that is added or changed (annAdd, annUpd; target is its id for annUpd
        and annDel), or w and h of a blank page. What the model does not know leaves it as it is."""
        pages, at = self.pages, self._index(target)
        given = json.loads(payload) if payload else {}
        if kind == "open":
            return Model(tuple((i, 0, 0, False, *SIZE) for i in ids or ()))
        if kind == "merge":
            spot = self._after(target) if not target or at >= 0 else len(pages)
            return self if not ids else self._to((*pages[:spot], *((i, 0, 0, False, *SIZE) for i in ids), *pages[spot:]))
        if kind == "reorder":
            to = self._index(other)
            if at < 0 or to < 0 or at == to:
                return self
            left = [*pages[:at], *pages[at + 1 :]]
            left.insert(to, pages[at])
            return self._to(left)
        if kind == "rotate":
            return self._to(self._edit(target, lambda p: (p[0], (p[1] + (amount or 0)) % 360, *p[2:])))
        if kind == "flip":
            bits = (amount or 0) & 3
            anns = self.anns
            for bit in (1, 2):
                if at >= 0 and bits & bit:
                    anns = [a.mirrored(bit, *pages[at][4:]) if a.get("page_id") == target else a for a in anns]
            return self._to(self._edit(target, lambda p: (*p[:2], p[2] ^ bits, *p[3:])), anns)
        if kind == "setRots":
            chosen = set(ids or ())
            return self._to((p[0], (amount or 0) % 360, *p[2:]) if p[0] in chosen else p for p in pages)
        if kind == "delete":
            return self._to([p for p in pages if p[0] != target], [a for a in self.anns if a.get("page_id") != target])
        if kind == "duplicate":
            return self if at < 0 else self._to((*pages[: at + 1], (f"{target}+{seq}", *pages[at][1:]), *pages[at + 1 :]))
        if kind == "blank":
            spot = self._after(target)
            size = (float(given.get("w", SIZE[0])), float(given.get("h", SIZE[1])))
            return self._to((*pages[:spot], (f"blank{seq}", 0, 0, True, *size), *pages[spot:]))
        if kind == "annAdd":
            return self._to(anns=(*self.anns, Annotation({"ann_id": f"a{seq}", "page_id": target} | given)))
        if kind == "annUpd":
            return self._to(anns=[Annotation(a | given) if a["ann_id"] == target else a for a in self.anns])
        if kind == "annDel":
            return self._to(anns=[a for a in self.anns if a["ann_id"] != target])
        if kind == "undo" and self.past:
            return self._moved(self.past[-1], True, self.past[:-1], (self.past[-1], *self.future))
        if kind == "redo" and self.future:
            return self._moved(self.future[0], False, (*self.past, self.future[0]), self.future[1:])
        return self


def fold(pdf: pd.DataFrame, m: Model | None = None) -> Model:
    """The model m (an empty one) after actions of its document."""
    m = m or Model()
    for a in pdf.sort_values("seq", kind="stable").itertuples():
        ids = None if a.ids is None else list(a.ids)
        m = m.step(int(a.seq), a.type, a.target, a.other, None if pd.isna(a.amount) else int(a.amount), ids, a.payload)
    return m


def _actions(actions: DataFrame) -> DataFrame:
    names = ACTIONS.fieldNames()
    return actions.select(*(c if c in actions.columns else F.lit(None).cast("string").alias(c) for c in names)).groupBy("doc_id")


def replay(actions: DataFrame) -> DataFrame:
    """(doc_id, pos, page_id, rot, flip, blank, w, h): each document's pages after all its actions, by seq."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(key[0], k, *p) for k, p in enumerate(fold(pdf).pages, 1)], columns=MODEL_PAGES.fieldNames())

    return _actions(actions).applyInPandas(run, MODEL_PAGES)


def annotations(actions: DataFrame) -> DataFrame:
    """(doc_id, z, ann_id, page_id, x, y, w, h, text): each document's annotations after all its actions, in order."""
    fields = MODEL_ANNOTATIONS.fieldNames()[2:]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [(key[0], k, *(a.get(f) for f in fields)) for k, a in enumerate(fold(pdf).anns, 1)]
        return pd.DataFrame(rows, columns=MODEL_ANNOTATIONS.fieldNames())

    return _actions(actions).applyInPandas(run, MODEL_ANNOTATIONS)

"""Extension: the edit log replayed as a stream. A document's state is four lists: its pages, its annotations, and what its last edits
and undone edits changed, an entry each; neither the log nor an earlier list of pages is kept."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.model import Annotation, Delta, Model, fold
from ..schema import ACTIONS, MODEL_PAGES

#: Every batch of a document's actions gives its pages anew, marked with the last action.
OUTPUT = T.StructType([*MODEL_PAGES.fields, T.StructField("as_of", T.LongType())])
_PAGE = T.StructType(MODEL_PAGES.fields[2:])
_JSON = T.StructType([T.StructField("json", T.StringType())])


def _read_change(text: str) -> tuple[Delta, Delta]:
    (at, gone, come), (there, left, right) = json.loads(text)
    return (at, tuple(map(tuple, gone)), tuple(map(tuple, come))), (there, tuple(map(Annotation, left)), tuple(map(Annotation, right)))


class Replay(StatefulProcessor):
    """Folds each document's new actions, in order of seq within the micro-batch, into its lists."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pages = handle.getListState("pages", _PAGE)
        self.rest = {n: handle.getListState(n, _JSON) for n in ("anns", "past", "future")}

    def _load(self) -> Model:
        read = lambda name, make: tuple(make(r[0]) for r in self.rest[name].get())
        pages = tuple((r[0], int(r[1]), int(r[2]), bool(r[3]), float(r[4]), float(r[5])) for r in self.pages.get())
        return Model(pages, read("anns", lambda t: Annotation(json.loads(t))), read("past", _read_change), read("future", _read_change))

    def _keep(self, m: Model) -> None:
        for state, rows in ((self.pages, list(m.pages)), *((self.rest[n], [(json.dumps(x),) for x in getattr(m, n)]) for n in self.rest)):
            if rows:
                state.put(rows)
            else:
                state.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(rows)
        m = fold(new, self._load())
        self._keep(m)
        if m.pages:
            yield pd.DataFrame([(key[0], k, *p, int(new["seq"].max())) for k, p in enumerate(m.pages, 1)], columns=OUTPUT.fieldNames())

    def close(self) -> None:
        pass


def replay_stream(actions: DataFrame) -> DataFrame:
    """A streaming frame of actions as a stream of page lists, in append mode. State lives in RocksDB, which is set here if nothing else is:
    the default store has no lists."""
    conf = actions.sparkSession.conf
    name = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in conf.get(name, ""):
        conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return actions.select(*ACTIONS.fieldNames()).groupBy("doc_id").transformWithStateInPandas(statefulProcessor=Replay(), outputStructType=OUTPUT, outputMode="Append", timeMode="None")

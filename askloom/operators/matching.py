"""Which texts contain which passages."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as St
from pyspark.sql.pandas.types import to_arrow_type

from askloom.session import cut_lineage

#: Characters of a passage that the automaton holds; what follows them is compared at each hit.
HEAD_CHARS = 256
#: Characters of heads, and of whole passages, that one automaton goes by.
GROUP_HEADS, GROUP_CHARS = 1 << 20, 16 << 20
#: Pairs of a passage and a text that a worker holds before they leave; the last text's pairs come on top.
PAIR_ROWS = 1 << 16


class Passages:
    """An automaton over the heads of distinct passages."""

    def __init__(self, keys: list, texts: list[str], head: int = HEAD_CHARS) -> None:
        by_text: dict[str, set[int]] = {}
        for i, text in enumerate(texts):
            by_text.setdefault(text, set()).add(i)
        #: Numbers of the empty passages, which every text contains.
        self.always = by_text.pop("", set())
        self.keys = keys
        by_head: dict[str, list[tuple[str, set[int]]]] = {}
        for text, numbers in by_text.items():
            by_head.setdefault(text[:head], []).append((text[head:], numbers))
        self.automaton = ahocorasick.Automaton()
        for start, rests in by_head.items():
            self.automaton.add_word(start, rests)
        self.automaton.make_automaton()

    def inside(self, text: str) -> set[int]:
        """Numbers of the passages that ``text`` contains, found in one pass."""
        found = set(self.always)
        if len(self.automaton):
            for end, rests in self.automaton.iter(text):
                for rest, numbers in rests:
                    if not rest or text.startswith(rest, end + 1):
                        found |= numbers
        return found


#: The last automaton of this worker process, by the broadcast it came from.
_LAST: dict[str, Passages] = {}


def _automaton(sent) -> Passages:
    if sent.value[0] not in _LAST:
        _LAST.clear()
        _LAST[sent.value[0]] = Passages(*sent.value[1:])
    return _LAST[sent.value[0]]


def passage_groups(passages: DataFrame, key: str, text: str) -> Iterator[pd.DataFrame]:
    """The passages in groups that one automaton can hold, by a hash; one group at a time is on the driver."""
    rows = cut_lineage(passages.select(key, text).where(F.col(text).isNotNull()).distinct())
    size = F.length(text)
    total = rows.agg(
        F.coalesce(F.sum(F.least(size, F.lit(HEAD_CHARS))), F.lit(0)).alias("heads"), F.coalesce(F.sum(size), F.lit(0)).alias("chars")
    ).first()
    n = max(1, -(-total["heads"] // GROUP_HEADS), -(-total["chars"] // GROUP_CHARS))
    for i in range(n):
        yield rows.where(F.pmod(F.xxhash64(key, text), F.lit(n)) == i).toPandas()


def containing(
    bodies: DataFrame, passages: DataFrame, target: str = "target", body: str = "body", key: str = "query_id", text: str = "query"
) -> DataFrame:
    """(key, target): texts that contain a passage of any length, letter for letter; a row per passage and text.

    Every text is gone through once for a group of passages, whatever their number, and is not moved. Pairs
    leave in batches of bounded size. An empty passage is in every text; null texts and passages match nothing.
    """
    schema = St.StructType().add(key, passages.schema[key].dataType).add(target, bodies.schema[target].dataType)
    texts = bodies.select(target, body).where(F.col(body).isNotNull())
    found = None
    for group in passage_groups(passages, key, text):
        part = texts.mapInArrow(_search(bodies.sparkSession, group, schema, body, text), schema)
        found = part if found is None else found.unionByName(part)
    return found


def _search(spark: SparkSession, group: pd.DataFrame, schema: St.StructType, body: str, text: str):
    key, target = schema.names
    key_type = to_arrow_type(schema[key].dataType)
    # the name tells the automata of a worker process that is used again apart
    sent = spark.sparkContext.broadcast((uuid.uuid4().hex, group[key].tolist(), group[text].tolist()))

    def pairs(keys: list, targets: pa.Array, places: list[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys, key_type), targets.take(pa.array(places))], names=[key, target])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _automaton(sent)
        for batch in batches:
            keys, places = [], []
            for i, value in enumerate(batch[body]):
                hits = [known.keys[n] for n in known.inside(value.as_py())]
                keys += hits
                places += [i] * len(hits)
                if len(places) >= PAIR_ROWS:
                    yield pairs(keys, batch[target], places)
                    keys, places = [], []
            if places:
                yield pairs(keys, batch[target], places)

    return run

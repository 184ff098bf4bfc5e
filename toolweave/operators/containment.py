"""Names of a catalogue that texts contain, as a join of two tables: no pairs of a text and a name are made.

The catalogue is cut into blocks of names of at most ``BLOCK_CHARS`` characters,
about. A block's names are one automaton (Aho-Corasick) that every task builds
once; a text goes through it once, whatever the number of names. A catalogue of
one block needs no shuffle; more are read one after another, each with all texts,
and meet by text id.

Defined cases: a null text contains nothing, an empty name is in every other
text; null names are left out; of names that repeat the smallest docid counts;
text ids are unique where the catalogue has several blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from toolweave.sources.shared import materialize

#: Characters of the names that a task holds in one automaton.
BLOCK_CHARS = 1 << 21


def first_contained(texts: DataFrame, catalogue: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(key, docid, name, n): per row of ``texts`` the first name of ``catalogue`` (docid, name), by docid, that it contains, null if none, and how many names it contains."""
    names = materialize(catalogue.filter("name is not null").groupBy("name").agg(F.min("docid").cast("long").alias("docid")), "names")
    size = names.agg(F.coalesce(F.sum(F.length("name") + 1), F.lit(0))).first()[0]
    blocks = max(1, -(-size // BLOCK_CHARS))
    kind = texts.schema[key].dataType.simpleString()
    rows = texts.select(F.col(key).alias(key), F.col(text).alias("__text"))

    def scan(block: int) -> DataFrame:
        # names of one block, whose size is bounded
        given = [(r["docid"], r["name"]) for r in names.filter(F.pmod(F.xxhash64("name"), F.lit(blocks)) == block).collect()]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton, everywhere = ahocorasick.Automaton(), [g for g in given if not g[1]]
            for g in given:
                if g[1]:
                    automaton.add_word(g[1], g)
            automaton.make_automaton()
            for batch in batches:
                best, count = [], []
                for t in batch.column(1).to_pylist():
                    found = set(everywhere) if t is not None else set()
                    if t and len(automaton):
                        found.update(g for _, g in automaton.iter(t))
                    best.append(min(found, default=(None, None)))
                    count.append(len(found))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([b[0] for b in best], pa.int64()), pa.array([b[1] for b in best], pa.string()), pa.array(count, pa.int64())], [key, "docid", "name", "n"])

        return rows.mapInArrow(run, f"`{key}` {kind}, docid bigint, name string, n bigint")

    parts = [scan(b) for b in range(blocks)]
    if blocks == 1:
        return parts[0]
    first = F.min(F.when(F.col("docid").isNotNull(), F.struct("docid", "name")))
    return reduce(DataFrame.unionAll, parts).groupBy(key).agg(first.alias("first"), F.sum("n").alias("n")).select(key, "first.docid", "first.name", "n")

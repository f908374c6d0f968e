"""Facts of XML filing instances, read as a stream of markup.

An instance is read from its first to its last byte by an incremental parser that keeps no more
than the element it is in, so comments, CDATA sections, entities and character references mean
what XML says, and a filing of any size takes bounded memory. The parser leaves facts, contexts
and what the filing says of itself as rows; Spark joins facts with their contexts.

Files are read in pieces between closing brackets, so a large file is read by several tasks;
its pieces then meet in order in one task. Strings are parsed where they are, and their facts
leave together with the contexts they refer to.
"""

from __future__ import annotations

from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Subtrees without facts, and what is read of a context.
NO_FACTS = ("context", "unit", "footnoteLink")
CONTEXT_LEAVES = {"identifier": "entity", "startDate": "start_date", "endDate": "end_date", "instant": "instant_date"}

#: kind: fact, context, unit (its value is the measure) or broken (its value says why the reading ended there).
ROWS = "symbol string, filing_id string, kind string, ord long, tag string, value string, ref string, entity string, start_date string, end_date string, instant_date string"
_NAMES = [c.split()[0] for c in ROWS.split(", ")]
#: A slice of an instance: facts, place of the first of them, ids and leaves of the contexts they refer to; what the filing says of itself.
LISTS = ("symbol string, filing_id string, currency string, own_end string, context_end string, place int, "
         "facts array<struct<tag string, value string, ref string>>, refs array<string>, "
         "contexts array<struct<entity string, start_date string, end_date string, instant_date string>>")
#: Characters of a string that the parser gets at once, and rows (elements of lists) that leave a task together.
SLICE, BATCH = 1 << 16, 20_000


class InstanceReader:
    """Takes an instance in pieces; collects facts (tag, value, ref), contexts (ref and the leaves) and measures of units in document order."""

    def __init__(self):
        self.facts: list[tuple] = []
        self.contexts: list[tuple] = []
        self.units: list[str | None] = []
        self.fault: tuple[int, str] | None = None  # line and what is wrong there; nothing is read after it
        self.taken = [0, 0, 0]  # facts, contexts and units that have left as rows
        self.depth = 0
        self.leaf = False  # the element that was opened last is open and has had no child
        self.text: list[str] = []
        self.ref = None
        self.outer: tuple[str, int, dict] | None = None  # the subtree without facts that is open
        self.parser = expat.ParserCreate()
        self.parser.buffer_text = True
        self.parser.StartElementHandler, self.parser.EndElementHandler, self.parser.CharacterDataHandler = self.start, self.end, self.characters

    def feed(self, piece: str, last: bool = False) -> None:
        if self.fault is None:
            try:
                self.parser.Parse(piece, last)
            except expat.ExpatError as e:
                self.fault = (e.lineno, str(e))
        if last:  # parser and reader hold each other; without this they stay until the garbage collector comes
            self.parser.StartElementHandler = self.parser.EndElementHandler = self.parser.CharacterDataHandler = None

    def start(self, name: str, attributes: dict) -> None:
        self.depth += 1
        self.leaf, self.ref = True, attributes.get("contextRef")
        if self.text:
            self.text.clear()
        if self.outer is None:
            local = name.rpartition(":")[2]
            if local in NO_FACTS:
                self.outer = (local, self.depth, {"id": attributes.get("id") or None})

    def characters(self, data: str) -> None:
        if self.leaf:
            self.text.append(data)

    def end(self, name: str) -> None:
        if self.leaf:
            self.leaf = False
            local, value = name.rpartition(":")[2], "".join(self.text).strip() or None
            self.text.clear()
            if self.outer is not None:
                self.outer[2][local] = value
            elif value is not None and self.depth > 1:
                self.facts.append((local, value, self.ref or None))
        if self.outer is not None and self.outer[1] == self.depth:
            kind, _, found = self.outer
            self.outer = None
            if kind == "context" and found["id"] is not None:
                self.contexts.append((found["id"], *[found.get(x) for x in CONTEXT_LEAVES]))
            elif kind == "unit":
                self.units.append(found.get("measure"))
        self.depth -= 1

    def take(self, last: bool = False) -> Iterator[tuple]:
        """What was collected since the last call, as (kind, ord, tag, value, ref, entity, start, end, instant)."""
        none, (f, c, u) = (None,) * 4, self.taken
        yield from (("fact", f + i, *fact, *none) for i, fact in enumerate(self.facts))
        yield from (("context", c + i, None, None, *context) for i, context in enumerate(self.contexts))
        yield from (("unit", u + i, None, measure, None, *none) for i, measure in enumerate(self.units))
        if last and self.fault is not None:
            yield ("broken", self.fault[0], None, self.fault[1], None, *none)
        self.taken = [f + len(self.facts), c + len(self.contexts), u + len(self.units)]
        for found in (self.facts, self.contexts, self.units):
            found.clear()


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        columns = list(zip(*held))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if n == "ord" else pa.string()) for n, c in zip(_NAMES, columns)], _NAMES)

    for row in rows:
        held.append(row)
        if len(held) >= BATCH:
            yield batch()
            held.clear()
    if held:
        yield batch()


def _read_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for batch in batches:
            for symbol, filing, text in zip(*[batch.column(k) for k in range(3)]):
                text = text.as_py()
                if not text or not text.strip():
                    continue
                key, reader = (symbol.as_py(), filing.as_py()), InstanceReader()
                for piece, last in _slices(text):
                    reader.feed(piece, last)
                    for row in reader.take(last):
                        yield (*key, *row)

    return _batches(rows())


def _slices(text: str) -> Iterator[tuple[str, bool]]:
    return ((text[i : i + SLICE], i + SLICE >= len(text)) for i in range(0, len(text), SLICE))


def _facts_again(text: str) -> Iterator[list[tuple]]:
    reader = InstanceReader()
    for piece, last in _slices(text):
        reader.feed(piece, last)
        yield reader.facts
        reader.facts, reader.contexts, reader.units = [], [], []


def _parts(text: str) -> Iterator[tuple]:
    """Facts of an instance slice by slice: (currency, own end, context end, place of the first, facts, contexts they refer to).

    What the filing says of itself is known at its end, so a string of several slices is read
    twice, and no more than its contexts and the facts of a slice are held.
    """
    reader, own_end, place = InstanceReader(), None, 0
    for piece, last in _slices(text):
        reader.feed(piece, last)
        own_end = next((value for tag, value, _ in reversed(reader.facts) if tag == "endDate"), own_end)
        if len(text) > SLICE:
            reader.facts.clear()
    currency, known = reader.units[0] if reader.units else None, {c[0]: c for c in reader.contexts}
    context_end = next((c[3] for c in reversed(reader.contexts) if c[3] is not None), None)
    for facts in [reader.facts] if len(text) <= SLICE else _facts_again(text):
        if facts:
            yield currency, own_end, context_end, place, facts, [known[ref] for ref in {f[2] for f in facts} if ref in known]
            place += len(facts)


def _read_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per slice of an instance, in the columns of ``LISTS``."""
    rows: list[tuple] = []
    facts: list[tuple] = []
    contexts: list[tuple] = []
    ends: tuple[list, list] = ([0], [0])

    def strings(held: list[tuple], k: int) -> list[pa.Array]:
        return [pa.array(c, pa.string()) for c in (zip(*held) if held else [()] * k)]

    def batch() -> pa.RecordBatch:
        *keys, places = zip(*rows)
        found, known, (fact_ends, context_ends) = strings(facts, 3), strings(contexts, 5), [pa.array(e, pa.int32()) for e in ends]
        out = [*[pa.array(c, pa.string()) for c in keys], pa.array(places, pa.int32()),
               pa.ListArray.from_arrays(fact_ends, pa.StructArray.from_arrays(found, ["tag", "value", "ref"])), pa.ListArray.from_arrays(context_ends, known[0]),
               pa.ListArray.from_arrays(context_ends, pa.StructArray.from_arrays(known[1:], list(CONTEXT_LEAVES.values())))]
        for held in (rows, facts, contexts):
            held.clear()
        for e in ends:
            del e[1:]
        return pa.RecordBatch.from_arrays(out, ["symbol", "filing_id", "currency", "own_end", "context_end", "place", "facts", "refs", "contexts"])

    for given in batches:
        for symbol, filing, text in zip(*[given.column(k) for k in range(3)]):
            text = text.as_py()
            if not text or not text.strip():
                continue
            key = (symbol.as_py(), filing.as_py())
            for currency, own_end, context_end, place, found, known in _parts(text):
                rows.append((*key, currency, own_end, context_end, place))
                facts += found
                contexts += known
                for e, held in zip(ends, (facts, contexts)):
                    e.append(len(held))
                if len(facts) + len(contexts) >= BATCH:
                    yield batch()
    if rows:
        yield batch()


def _read_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in the order of their files; what stood between two pieces was a closing bracket."""

    def rows() -> Iterator[tuple]:
        reader, file, key, tail = None, None, None, ""

        def finish() -> Iterator[tuple]:
            if reader is not None:
                reader.feed(">" if "<" in tail else "", True)
                for row in reader.take(True):
                    yield (*key, *row)

        for batch in batches:
            for symbol, filing, own, piece in zip(*[batch.column(k).to_pylist() for k in range(4)]):
                if own != file:
                    yield from finish()
                    reader, file, key = InstanceReader(), own, (symbol, filing)
                    reader.feed(piece)
                else:
                    reader.feed(">" + piece)
                tail = piece
                if len(reader.facts) + len(reader.contexts) + len(reader.units) > 100:
                    for row in reader.take():
                        yield (*key, *row)
        yield from finish()

    return _batches(rows())


def read_instances(filings: DataFrame, xml: str = "xml") -> DataFrame:
    """Rows of instances that are strings of a table with ``symbol`` and ``filing_id``."""
    return filings.select("symbol", "filing_id", xml).mapInArrow(_read_strings, ROWS)


def read_instance_files(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the instances in files named <symbol>_<filing>.xml, of any size."""
    d = spark.read.option("lineSep", ">").text(path)
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.+)\.xml$", 1)
    d = d.select(F.split_part(name, F.lit("_"), F.lit(1)).alias("symbol"), name.alias("filing_id"), F.col("_metadata.file_path").alias("file"), F.col("value").alias("piece"),
                 F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"))
    d = d.repartition("file").sortWithinPartitions("file", "block", "place")
    return d.select("symbol", "filing_id", "file", "piece").mapInArrow(_read_pieces, ROWS)


def facts_of(rows: DataFrame) -> DataFrame:
    """Facts in document order: every leaf below the root with a text, by local name.

    Contexts, units and footnote links hold no facts. A context gives its facts their entity and
    dates; a later context of the same id replaces an earlier one. The period end is the last
    ``endDate`` fact, else the last context's; the currency is the first unit's measure. ``ord``
    is the fact's place; the catalog is joined afterwards, so unknown tags stay. An instance that
    isn't well-formed has the facts before the fault (``broken_instances``).
    """
    filing = ["symbol", "filing_id"]
    whole, same = Window.partitionBy(*filing), Window.partitionBy(*filing, "ref")
    is_ = lambda k: F.col("kind") == k
    last = lambda x, order: F.max_by(x, order)
    d = rows.withColumns({
        "_c": last(F.struct("entity", "start_date", "end_date", "instant_date"), F.when(is_("context"), F.col("ord"))).over(same),
        "_root_end": last("value", F.when(is_("fact") & (F.col("tag") == "endDate"), F.col("ord"))).over(whole),
        "_any_end": last("end_date", F.when(is_("context") & F.col("end_date").isNotNull(), F.col("ord"))).over(whole),
        "currency": F.min_by("value", F.when(is_("unit"), F.col("ord"))).over(whole)})
    return d.where(is_("fact")).select(
        *filing, F.coalesce("_root_end", "_any_end").try_cast("date").alias("period_end"), "currency", F.col("ord").cast("int").alias("ord"), "tag", "value", F.col("ref").alias("context_ref"),
        F.coalesce(F.when(F.col("ref").isNotNull(), F.col("_c.entity")), "symbol").alias("entity"),
        *[F.when(F.col("ref").isNotNull(), F.col(f"_c.{x}")).try_cast("date").alias(x) for x in ("start_date", "end_date", "instant_date")])


def broken_instances(rows: DataFrame) -> DataFrame:
    """Instances that aren't well-formed, with the line and the fault."""
    return rows.where("kind = 'broken'").select("symbol", "filing_id", F.col("ord").alias("line"), F.col("value").alias("fault"))


def parse_filings(filings: DataFrame, xml: str = "xml") -> DataFrame:
    """``facts_of`` for instances that are strings.

    A string is read by one task, so a slice of it leaves as one row with all that its facts need
    and nothing is shuffled. A fact looks through the contexts of its slice alone.
    """
    d = filings.select("symbol", "filing_id", xml).mapInArrow(_read_lists, LISTS)
    d = d.select("symbol", "filing_id", "currency", F.coalesce("own_end", "context_end").try_cast("date").alias("period_end"), "place", "refs", "contexts", F.posexplode("facts").alias("n", "f"))
    context = F.get("contexts", (F.array_position("refs", F.col("f.ref")) - 1).cast("int"))
    return d.select(
        "symbol", "filing_id", "period_end", "currency", (F.col("place") + F.col("n")).alias("ord"), "f.tag", "f.value", F.col("f.ref").alias("context_ref"),
        F.coalesce(context["entity"], "symbol").alias("entity"), *[context[x].try_cast("date").alias(x) for x in ("start_date", "end_date", "instant_date")])


def parse_filing_files(spark: SparkSession, path: str) -> DataFrame:
    return facts_of(read_instance_files(spark, path))

"""Event tables: projections of logs that are declared, not coded, and kept in step with their declaration."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom import schema
from ledgerloom.operators.coverage import Range, in_range
from ledgerloom.operators.ingest import add_new
from ledgerloom.storage import BucketTable, Versions

TYPES = ("address", "uint256", "bytes")
IMPLICIT = ("block_number", "tx_index", "log_index", "address")
IDENTIFIER = re.compile(r"[a-z_][a-z0-9_]*\Z")
SOURCE = re.compile(r"topic([123])\Z|data\[(\d+):(\d+)\]\Z")


def _hex(text: str, size: int, what: str) -> bytes:
    digits = text.removeprefix("0x")
    if not re.fullmatch(r"[0-9a-fA-F]*", digits) or len(digits) != 2 * size:
        raise ValueError(f"{what} must be {size} bytes of hex: {text}")
    return bytes.fromhex(digits)


@dataclass(frozen=True)
class EventColumn:
    """name, source (`topic1`..`topic3` or `data[from:to]` in bytes) and type (address, uint256 or bytes)."""

    name: str
    source: str
    type: str

    def __post_init__(self):
        m = SOURCE.match(self.source)
        if not IDENTIFIER.match(self.name) or self.name in IMPLICIT:
            raise ValueError(f"not a column name: {self.name}")
        if self.type not in TYPES:
            raise ValueError(f"{self.name}: no such type: {self.type}")
        if not m:
            raise ValueError(f"{self.name}: not a source: {self.source}")
        if m[1]:
            if self.type == "bytes":
                raise ValueError(f"{self.name}: a topic is an address or a uint256")
            return
        width = int(m[3]) - int(m[2])
        if width <= 0 or (self.type == "address" and width not in (20, 32)) or (self.type == "uint256" and width > 32):
            raise ValueError(f"{self.name}: {self.type} can't be {width} bytes wide")

    def value(self) -> Column:
        m = SOURCE.match(self.source)
        if m[1]:
            topic = F.col(f"topic{m[1]}")
            return F.substring(topic, 13, 20) if self.type == "address" else topic
        at, width = int(m[2]), int(m[3]) - int(m[2])
        if self.type == "address" and width == 32:
            return F.substring("data", at + 13, 20)
        cut = F.substring("data", at + 1, width)
        return F.lpad(cut, 32, F.lit(b"\0")) if self.type == "uint256" and width < 32 else cut


@dataclass(frozen=True)
class EventTable:
    """A declared table of one event: topic0, columns, and optionally the chains and emitters that it is limited to."""

    name: str
    topic0: str
    columns: tuple[EventColumn, ...]
    chains: tuple[int, ...] = ()
    addresses: tuple[str, ...] = field(default=())

    def __post_init__(self):
        if not IDENTIFIER.match(self.name) or self.name in schema.TABLES or self.name == "event_tables":
            raise ValueError(f"not a table name: {self.name}")
        if not self.columns:
            raise ValueError(f"{self.name} has no columns")
        names = [c.name for c in self.columns]
        if len(set(names)) < len(names):
            raise ValueError(f"{self.name} has a column twice")
        _hex(self.topic0, 32, "topic0")
        for a in self.addresses:
            _hex(a, 20, "an address")

    def fingerprint(self) -> Column:
        """A digest of topic0, the set of addresses and the order of columns; chains don't count."""
        parts = [self.topic0.removeprefix("0x").lower(), *sorted(a.removeprefix("0x").lower() for a in self.addresses), *(f"{c.name}|{c.source}|{c.type}" for c in self.columns)]
        return F.sha2(F.lit("\n".join(parts)).cast("binary"), 256)

    def applies_to(self, chain: int) -> bool:
        return not self.chains or chain in self.chains

    def where(self) -> Column:
        out = F.col("topic0") == F.lit(_hex(self.topic0, 32, "topic0"))
        return out & F.col("address").isin([_hex(a, 20, "an address") for a in self.addresses]) if self.addresses else out


def event_rows(logs: DataFrame, table: EventTable, r: Range | None = None) -> DataFrame:
    """The table's rows: one for each log of its event, in a block range if one is given."""
    df = logs if r is None else in_range(logs, r)
    return df.where(table.where()).select(*IMPLICIT, *[c.value().alias(c.name) for c in table.columns])


def on_chain(logs: DataFrame, table: EventTable) -> DataFrame:
    """Logs (with chain_id) of the chains that a table is limited to; a filter on the partition column."""
    return logs.where(F.col("chain_id").isin(list(table.chains))) if table.chains else logs


def populate(logs: DataFrame, table: EventTable, existing: DataFrame | None, r: Range) -> DataFrame:
    """The rows of a range that aren't in the table yet."""
    rows = event_rows(logs, table, r).dropDuplicates(["block_number", "log_index"])
    if existing is None:
        return rows
    return rows.join(in_range(existing, r).select("block_number", "log_index"), ["block_number", "log_index"], "left_anti").select(*rows.columns)


def several(logs: DataFrame, tables: list[EventTable]) -> DataFrame:
    """The logs that belong to any of the tables, each with the names of its tables: one scan for all of them.

    The topic is compared once for each log, by a lookup; emitters only in tables that are limited to some."""
    topics = {t.topic0.removeprefix("0x").lower() for t in tables}
    of = F.lower(F.hex("topic0"))
    by_topic = F.create_map(*[x for topic in sorted(topics) for x in (F.lit(topic), F.array(*[F.when(F.lit(True) if not t.addresses else F.col("address").isin([_hex(a, 20, "an address") for a in t.addresses]), F.lit(t.name)) for t in tables if t.topic0.removeprefix("0x").lower() == topic]))])
    wanted = logs.where(F.col("topic0").isin([_hex(x, 32, "topic0") for x in sorted(topics)]))
    named = wanted.withColumn("event_tables", F.array_compact(F.element_at(by_topic, of)))
    return named.where(F.size("event_tables") > 0)


def declarations(spark: SparkSession, tables: list[EventTable], chains: list[int]) -> DataFrame:
    """event_table, chain_id, topic0: a row for each table and each of the chains that it applies to."""
    rows = [(t.name, c, bytearray(_hex(t.topic0, 32, "topic0"))) for t in tables for c in chains if t.applies_to(c)]
    return spark.createDataFrame(rows, "event_table string, chain_id int, topic0 binary")


def declared_logs(logs: DataFrame, declared: DataFrame) -> DataFrame:
    """The logs (with chain_id, a partition column of a store) of declared tables, with event_table. The join prunes the folders of chains at run time."""
    return logs.join(declared, ["chain_id", "topic0"])


class EventStore:
    """Event tables in buckets of blocks under one root; the versions of the store have their declarations and generations."""

    def __init__(self, spark: SparkSession, root: str, versions: Versions | None = None, under: str = ""):
        self.spark, self.versions, self.under = spark, versions or Versions(spark, root), under

    def _key(self, name: str) -> str:
        return f"{self.under}{name}"

    def bucketed(self, table: str | EventTable, state: dict | None = None) -> BucketTable:
        """The folder of a table, with the columns of its declaration or, by name, of the tracked one."""
        if isinstance(table, EventTable):
            own = [c.name for c in table.columns]
        else:
            own = (state or self.versions.read()[1])["tables"][self._key(table)]["columns"]
        out = T.StructType()
        for name in [*IMPLICIT, *own]:
            out.add(name, T.LongType() if name in IMPLICIT and name != "address" else T.BinaryType())
        return BucketTable(self.versions, self._key(table if isinstance(table, str) else table.name), out)

    def tracked(self) -> dict[str, str]:
        """name -> fingerprint of the tables made here."""
        at = len(self.under)
        return {k[at:]: v["fingerprint"] for k, v in self.versions.read()[1].get("tables", {}).items() if k.startswith(self.under)}

    def table(self, name: str, chain: int | None = None, r: Range | None = None) -> DataFrame:
        """A table's rows, of all chains or of one."""
        state = self.versions.read()[1]
        t = self.bucketed(name, state)
        return t.read(state, r, chain).select(*t.kinds.fieldNames())

    def _fingerprint(self, table: EventTable) -> str:
        return self.spark.range(1).select(table.fingerprint()).first()[0]

    def sync(self, table: EventTable, logs: DataFrame, chain: int = 1) -> str:
        """`created` with all rows of a chain's logs, or `unchanged`; a changed or foreign table of that name raises ValueError."""
        number, state = self.versions.read()
        own, was = self._fingerprint(table), state.get("tables", {}).get(self._key(table.name))
        if was and was["fingerprint"] == own and chain in was["chains"]:
            return "unchanged"
        fs, path = self.versions.path(self.bucketed(table).folder)
        if was and was["fingerprint"] != own:
            raise ValueError(f"{table.name} is there with another declaration: rebuild it")
        if not was and fs.exists(path) and not all(x.getPath().getName().startswith(("chain_id=", "_", ".")) for x in fs.listStatus(path)):
            raise ValueError(f"{table.name}: something else stands there: rebuild it")
        gen = was["gen"] if was else number + 1  # what an attempt before has left is of no version
        self.bucketed(table).clear(chain, gen)
        self.bucketed(table).write(event_rows(logs, table), chain, gen)
        self.versions.commit(number + 1, self._with(state, table, own, gen, [*(was["chains"] if was else []), chain]))
        return "created"

    def _with(self, state: dict, table: EventTable, fingerprint: str, gen: int, chains: list[int]) -> dict:
        entry = {"gen": gen, "fingerprint": fingerprint, "columns": [c.name for c in table.columns], "chains": chains}
        gens = {k: v for k, v in state.get("gens", {}).items() if k != self._key(table.name)}
        return {**state, "tables": {**state.get("tables", {}), self._key(table.name): entry}, "gens": gens}

    def rebuild(self, tables: list[EventTable], logs: DataFrame | dict[int, DataFrame]) -> None:
        """Make the given tables anew, and drop all other tracked ones. logs: of chain 1, or by chain.

        The new tables stand beside the old ones until a version names them all at once; the old ones go after that."""
        number, state = self.versions.read()
        by_chain = logs if isinstance(logs, dict) else {1: logs}
        old = [k for k in state.get("tables", {}) if k.startswith(self.under)]
        after = {**state, "tables": {k: v for k, v in state.get("tables", {}).items() if k not in old}, "gens": {k: v for k, v in state.get("gens", {}).items() if k not in old}}
        for t in tables:
            chains = [c for c in by_chain if t.applies_to(c)]
            for c in chains:
                self.bucketed(t).clear(c, number + 1)
                self.bucketed(t).write(event_rows(by_chain[c], t), c, number + 1)
            after = self._with(after, t, self._fingerprint(t), number + 1, chains)
        self.versions.commit(number + 1, after)
        for t in tables:
            self.bucketed(t).sweep(after)
            self._unknown(t)
        for key in set(old) - set(after["tables"]):
            fs, path = self.versions.path(f"{self.versions.root}/{key}")
            fs.delete(path, True)

    def _unknown(self, table: EventTable) -> None:
        """Delete what stands in a table's folder without being of it."""
        fs, path = self.versions.path(self.bucketed(table).folder)
        for x in fs.listStatus(path):
            if not x.getPath().getName().startswith(("chain_id=", "_", ".")):
                fs.delete(x.getPath(), True)

    def append(self, table: EventTable, logs: DataFrame, r: Range, chain: int = 1) -> None:
        """Add the rows of a range of a chain's logs that aren't there."""
        state = self.versions.read()[1]
        t = self.bucketed(table)
        add_new(event_rows(logs, table, r), t.read(state, r, chain), ["block_number", "log_index"], lambda fresh: t.append(state, fresh, chain, r))

"""Following a growing folder of exports: each new block is indexed once, old blocks are dropped, gaps are filled."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerloom import schema
from ledgerloom.operators import events as ev
from ledgerloom.operators import coverage, ingest, traces
from ledgerloom.operators.coverage import Range, cutoff
from ledgerloom.sources.exports import NAME, manifest, read_export, read_range
from ledgerloom.storage import BUCKET, BucketTable, Versions

#: Transactions that one task of a backfill fills.
FILL_ROWS = 100_000

PROGRESS = "chain_id int, first long, last long, new_blocks long, cached_blocks long, batch long"


class LedgerStore:
    """One chain's side of the three tables and the event tables under one root, as Parquet in buckets of BUCKET blocks.

    Rows are appended without a new version: a block counts once its row in blocks is there, which comes last. Everything that takes rows away or
    writes buckets anew becomes visible at once, by a new version; see Versions."""

    def __init__(self, spark: SparkSession, root: str, chain: int = 1):
        self.spark, self.root, self.chain = spark, root.rstrip("/"), chain
        self.versions = Versions(spark, self.root)
        self.events = ev.EventStore(spark, self.root, self.versions, "events/")

    def on(self, chain: int) -> LedgerStore:
        """Another chain's side of the store."""
        return LedgerStore(self.spark, self.root, chain)

    def _table(self, name: str) -> BucketTable:
        return BucketTable(self.versions, name, schema.TABLES[name])

    def table(self, name: str, r: Range | None = None) -> DataFrame:
        """A table's rows on this chain; a block range prunes buckets."""
        return self._table(name).read(self.versions.read()[1], r, self.chain).select(*schema.TABLES[name].fieldNames())

    def all_chains(self, name: str) -> DataFrame:
        """A table's rows on every chain, with chain_id, by which folders are pruned."""
        return self._table(name).read(self.versions.read()[1])

    def progress(self) -> DataFrame:
        """A row for each batch and chain that brought blocks: chain_id, first, last, new_blocks, cached_blocks, batch."""
        return self.spark.read.schema(PROGRESS).option("basePath", f"{self.root}/_progress").json(f"{self.root}/_progress/*/*").select(*[c.split()[0] for c in PROGRESS.split(", ")])

    def report(self, batch: int, first: int, last: int, new: int, cached: int) -> None:
        """A batch's row in the progress table. It is kept by batch and chain: a batch that comes again changes nothing."""
        at = f"{self.root}/_progress/batch={batch}/chain={self.chain}"
        fs, path = self.versions.path(f"{at}/_SUCCESS")
        if not fs.exists(path):
            self.spark.createDataFrame([(self.chain, first, last, new, cached)], PROGRESS.removesuffix(", batch long")).coalesce(1).write.mode("overwrite").json(at)

    def append(self, name: str, rows: DataFrame, r: Range, reread: bool = False) -> None:
        """Add the rows whose key isn't there; rows: of blocks in r.

        reread: rows are of files and may be read twice. Their keys alone are shuffled first: whole rows are, but of blocks
        of which some rows are there and others aren't, or come twice."""
        there, table = self.table(name, r), self._table(name)
        add = lambda fresh: table.append(self.versions.read()[1], fresh, self.chain, r)
        if reread:
            ingest.add_new(rows, there, schema.KEYS[name], add)
        else:
            add(ingest.new_rows(rows, there, name))

    def _every(self, state: dict) -> list[BucketTable]:
        events = [self.events.bucketed(name.removeprefix("events/"), state) for name in state.get("tables", {})]
        return [*(self._table(name) for name in ("logs", "transactions", "blocks")), *events]

    def purge(self, keep: int) -> int | None:
        """Drop blocks older than the last `keep` from the tables and the event tables; returns the first block that is kept.

        The bucket at the border is written anew, as a generation that nobody reads yet. One new version then replaces it and hides what
        is older; after that the folders are deleted. Stopped anywhere, the store has all rows or those that are kept, and recover() ends the work."""
        self.recover()
        at = cutoff(self.table("blocks"), keep)
        if not at:
            return at
        number, state = self.versions.read()
        after = {**state, "floor": {**state.get("floor", {}), str(self.chain): at}}
        border = at // BUCKET
        for t in self._every(state):
            if at % BUCKET:
                t.write(t.read(state, (at, (border + 1) * BUCKET - 1), self.chain), self.chain, number + 1)
                after = t.moved(after, self.chain, [border], number + 1)
        for key, places in after.get("gens", {}).items():  # buckets that go need no entry
            after["gens"][key] = {p: g for p, g in places.items() if p.split("/")[0] != str(self.chain) or int(p.split("/")[1]) >= border}
        self.versions.commit(number + 1, after)
        self.recover()
        return at

    def recover(self) -> None:
        """End what a purge has left: delete the folders that the newest version hides, then forget the bound."""
        number, state = self.versions.read()
        if state.get("floor"):
            for t in self._every(state):
                t.sweep(state)
            self.versions.commit(number + 1, {k: v for k, v in state.items() if k != "floor"})

    def backfill(self, payments: DataFrame, r: Range) -> list[int]:
        """Fill coinbase_transfer of transactions in a block range where it is null and a payment (tx_hash, payment) is known.

        Only buckets with such rows are written anew, and they change at once. Payments are computed once and kept until these are there; rows
        that have a value aren't shuffled. Returns these buckets."""
        number, state = self.versions.read()
        t = self._table("transactions")
        bucket = F.floor(F.col("block_number") / BUCKET).alias("bucket")
        unknown = t.read(state, r, self.chain).where("coinbase_transfer IS NULL").select("tx_hash", bucket)
        found = payments.where("payment IS NOT NULL").select("tx_hash", "payment").join(unknown, "tx_hash").persist()
        try:
            touched = sorted(x.bucket for x in found.select("bucket").distinct().collect())  # a row a bucket
            if touched:
                rows = t.read(state, (touched[0] * BUCKET, (touched[-1] + 1) * BUCKET - 1), self.chain).where(bucket.isin(touched))
                empty = rows.where("coinbase_transfer IS NULL")
                parts = 1 + empty.count() // FILL_ROWS  # what is kept has partitions of its own, which AQE leaves as they are: each would make a file a bucket
                filled = traces.backfill(empty, found.repartition(parts, "tx_hash"))
                t.write(rows.where("coinbase_transfer IS NOT NULL").unionByName(filled), self.chain, number + 1)
                after = t.moved(state, self.chain, touched, number + 1)
                self.versions.commit(number + 1, after)
                t.sweep(after)
        finally:
            found.unpersist()
        return touched

    def rebuild_events(self, tables: list[ev.EventTable]) -> None:
        """Make the event tables of all chains anew from the stored logs."""
        logs = self.all_chains("logs")
        chains = [x.chain_id for x in logs.select("chain_id").distinct().collect()]  # a row a chain
        self.events.rebuild(tables, {c: logs.where(F.col("chain_id") == c) for c in chains})


def index_blocks(store: LedgerStore, exports: str, fresh_blocks: DataFrame, methods: DataFrame, events: DataFrame, tables: list[ev.EventTable], network: str | None = None) -> tuple | None:
    """Index the blocks of an export batch: logs, event tables, transactions, and blocks last, which marks them as there.

    network: whose files the folder's are, if it has several. Returns (first, last, new, cached)."""
    spark = store.spark
    low, high, total = fresh_blocks.agg(F.min("block_number"), F.max("block_number"), F.countDistinct("block_number")).first()
    if low is None:
        return None
    store.recover()
    r = Range(low, high)
    wanted = fresh_blocks.select("block_number").distinct()
    cached = store.table("blocks", r).join(wanted, "block_number", "left_semi").count()
    some = lambda dataset: read_range(spark, exports, dataset, low, high, network).join(wanted, "block_number", "left_semi")
    store.append("logs", ingest.logs(some("logs"), events), r, reread=True)
    for t in tables:
        if t.applies_to(store.chain) and store.events.sync(t, store.table("logs"), store.chain) == "unchanged":  # a table of another declaration raises
            store.events.append(t, store.table("logs", r), r, store.chain)
    store.append("transactions", ingest.transactions(some("transactions"), methods), r, reread=True)
    store.append("blocks", ingest.blocks(fresh_blocks), r)
    return low, high, total - cached, cached


def fill_gaps(store: LedgerStore, exports: str, methods: DataFrame, events: DataFrame, tables: list[ev.EventTable], keep: int | None = None, network: str | None = None) -> tuple | None:
    """Index the blocks that are missing between the first stored one, or the oldest kept one, and the last, as far as the exports have them.

    The runs of missing blocks are joined with the files' ranges, so that only files with such blocks are read. Returns what index_blocks() does."""
    runs = coverage.gap_fill(store.table("blocks"), keep).cache()  # a row a gap
    files = manifest(store.spark, exports).where("dataset = 'blocks'")
    files = files if network is None else files.where(F.col("network") == network)
    paths = [x.path for x in coverage.files_of_gaps(files, runs).select("path").collect()]  # a row a file
    try:
        if not paths:
            return None
        missing = runs.select(F.explode(F.sequence("first", "last")).alias("block_number"))
        found = read_export(store.spark, "blocks", paths).join(missing, "block_number", "left_semi")
        return index_blocks(store, exports, found, methods, events, tables, network)
    finally:
        runs.unpersist()


def prune_exports(store: LedgerStore, exports: str, r: Range, network: str | None = None) -> list[str]:
    """Delete the export files that overlap a range and whose blocks are all stored; returns their paths."""
    files = manifest(store.spark, exports)
    files = files if network is None else files.where(F.col("network") == network)
    paths = sorted(x.path for x in coverage.prunable(files, store.table("blocks"), r).select("path").collect())  # a row a file
    for at in paths:
        fs, path = store.versions.path(at)
        fs.delete(path, False)
    return paths


def follow(store: LedgerStore, exports: str, checkpoint: str, methods: DataFrame, events: DataFrame, tables: list[ev.EventTable] | None = None, keep: int | None = None, every: int = 1, files_per_batch: int = 16, available_now: bool = True, networks: dict[str, int] | None = None, prune: bool = False) -> StreamingQuery:
    """Index each new blocks file of a folder, with the transactions and logs of its blocks, whose files must be there first.

    A batch may come again and files in any order: rows that are there stay, others are added. keep: purge()
    after every `every` batches. Each batch leaves a row in the store's progress table. networks: names of the networks whose files the folder has, and the
    chains that they are; without it all files are the store's chain. prune: delete files whose blocks are all stored."""
    if keep is not None and keep < 1:
        raise ValueError("keep at least one block")

    def batch(df: DataFrame, number: int) -> None:
        for network, chain in (networks or {None: store.chain}).items():
            side = store.on(chain)
            own = df.drop("network") if network is None else df.where(F.col("network") == network).drop("network")
            done = index_blocks(side, exports, own, methods, events, tables or [], network)
            if done:
                side.report(number, *done)
            if keep is not None and number % every == 0:
                side.purge(keep)
            if done and prune:
                prune_exports(side, exports, Range(done[0], done[1]), network)

    stream = store.spark.readStream.schema(schema.BLOCK_EXPORT).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", "*__blocks__*.parquet").option("recursiveFileLookup", "true").parquet(exports)
    stream = stream.withColumn("network", F.regexp_extract("_metadata.file_path", NAME, 1))
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="3 seconds")).start()

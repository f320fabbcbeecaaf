"""A ledger stored as Parquet files with one committed snapshot per batch.

Layout under ``path``::

    rows/...      runs of rows, each sorted in ledger order
    ids/...       the same runs' object ids with their rows' places, by bucket and sorted
    blocks/...    nodes of whole blocks of 1,024 leaves
    incoming/...  the sealed rows of the batch that is being appended
    state/...     one row per batch: the root, and which runs are live after it
    history/...   runs of older snapshots

A reader takes the newest state row and reads the runs that it names.  So a batch
counts only once its state row exists, merging small runs is switched together with the
batch that does it, and what a failed attempt leaves is never read.  Folders that a
commit replaces are removed by the next one.  There is one writer per ledger.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timezone
from functools import partial

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from sealtrail import schema as S
from sealtrail.operators.ledger import known_ids, number_keys, valid_rows
from sealtrail.operators.merkle import BLOCK_LEVELS, MountainRange, perfect_trees
from sealtrail.operators.ordering import ensure_checkpoint_dir, with_dense_index
from sealtrail.sources import runs as R
from sealtrail.sources.scratch import dropping_shuffles

BLOCK = 1 << BLOCK_LEVELS
ROWS_PER_FILE = 1 << 17
# New rows are written in slices of so many files, or for each core, if that is more.
FILES_PER_SLICE = 16
FILES_PER_CORE = 2
MOST_SLICES = 8
IDS_PER_BUCKET = 1 << 16
# Snapshots are moved to the history by as many.
HISTORY_STEP = 16
# Of the snapshots that are prefixes, the newest stay, and of older ones ever fewer.
PREFIXES = 32
# Ids whose places may pass through the driver in a look-up.
LOOKUP_MOST = 1000

IDS_SCHEMA = "object_id string, created string, seq long"
BLOCKS_SCHEMA = "height int, block long, node string, created string, seq long"
_CREATED, _SEQ = S.LEDGER_ORDER


def utc_now() -> str:
    now = datetime.now(timezone.utc)
    return now.strftime("%Y-%m-%dT%H:%M:%S.") + f"{now.microsecond // 1000:03d}Z"


def _usable(state: Row) -> bool:
    return bool(state.merkle_root) and (state.leaf_count or 0) > 0


def _range_of(state: Row) -> MountainRange:
    return MountainRange(state.leaf_count, tuple(state.peaks))


def _plain(value):
    """Rows as dictionaries, for JSON."""
    if isinstance(value, Row):
        return {k: _plain(v) for k, v in value.asDict().items()}
    return [_plain(v) for v in value] if isinstance(value, (list, tuple)) else value


def buckets(rows: int) -> int:
    """Into how many buckets a run of ids is split: a power of two that grows with the run."""
    return 1 << max(0, (-(-rows // IDS_PER_BUCKET) - 1).bit_length())


def _bucket(of: int) -> Column:
    return F.xxhash64("object_id").bitwiseAND(F.lit(of - 1).cast("long"))


class LedgerTable:
    """Append-only ledger with an incrementally kept root."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")

    # --- reading ---------------------------------------------------------------------

    def _read(self, folders: Iterable[str], schema) -> DataFrame:
        paths = [f"{self.path}/{f}" for f in folders]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _newest(self) -> str | None:
        """Folder of the newest committed state row."""
        found = [int(n.split("=")[1]) for n in R.children(self.spark, f"{self.path}/state") if n.startswith("batch_no=")]
        for batch_no in sorted(found, reverse=True):
            folder = f"state/batch_no={batch_no}"
            if any(n.startswith("part-") for n in R.children(self.spark, f"{self.path}/{folder}")):
                return folder
        return None

    def state(self) -> DataFrame:
        """The newest snapshot, or no row."""
        newest = self._newest()
        return self._read([newest] if newest else [], S.STATE_SCHEMA)

    def _last(self) -> Row | None:
        newest = self._newest()
        return self._read([newest], S.STATE_SCHEMA).first() if newest else None

    def states(self) -> DataFrame:
        """All committed snapshots."""
        last = self._last()
        if last is None:
            return self.spark.createDataFrame([], S.SNAPSHOT_FIELDS)
        first = sum(r.rows for r in last.history_runs)
        singles = [f"state/batch_no={n}" for n in range(first, last.batch_no + 1)]
        older = self._read([r.folder for r in last.history_runs], S.SNAPSHOT_FIELDS)
        newer = self._read(singles, S.SNAPSHOT_FIELDS)
        return older.unionByName(newer) if last.history_runs else newer

    def _rows(self, last: Row | None) -> DataFrame:
        return self._read([] if last is None else [r.folder for r in last.row_runs], S.LEDGER_SCHEMA)

    def rows(self) -> DataFrame:
        """All committed ledger rows."""
        return self._rows(self._last()).select(*S.LEDGER_COLUMNS)

    def batch_rows(self, batch_no: int) -> DataFrame:
        """The rows that one committed batch added."""
        last = self._last()
        state = last if last.batch_no == batch_no else self.states().where(F.col("batch_no") == batch_no).first()
        first = state.next_seq - state.rows_added
        return self._rows(last).where(F.col(_SEQ).between(first, state.next_seq - 1))

    def root(self) -> DataFrame:
        """Stored root and leaf count, worked out from the rows if the state is of no use.

        The empty root if nothing is stored.
        """
        last = self._last()
        if last is None:
            row = (0, S.EMPTY_ROOT)
        elif _usable(last):
            row = (last.leaf_count, last.merkle_root)
        else:
            tail, size = self._indexed(self._rows(last))
            summary = MountainRange().extended(perfect_trees(tail, 0, size))
            row = (summary.leaf_count, summary.root)
        return self.spark.createDataFrame([row], "leaf_count long, merkle_root string")

    def lookup(self, ids: DataFrame) -> DataFrame:
        """Rows of all ids in a one-column table of object ids.

        Only the ids' own buckets are read for the rows' places.  Up to ``LOOKUP_MOST``
        places are then sought in the sorted runs, where row groups and pages that cannot
        have them are skipped; more ids than that are joined with all rows.
        """
        last = self._last()
        wanted = ids.select("object_id").distinct()
        if last is None or not last.id_runs:
            return self.rows().join(wanted, "object_id", "left_semi")
        places = self._ids(last, wanted).join(wanted, "object_id", "left_semi")
        found = places.limit(LOOKUP_MOST + 1).collect()
        if len(found) > LOOKUP_MOST:
            return self.rows().join(wanted, "object_id", "left_semi")
        by_time = F.col(_CREATED).isin(sorted({r.created for r in found}))
        return self.rows().where(by_time & F.col(_SEQ).isin([r.seq for r in found]))

    def _ids(self, last: Row, keys: DataFrame) -> DataFrame:
        """Stored ids of the buckets that the keys fall into.

        A run has the more buckets the larger it is; the bucket in a smaller run is given by the lower bits.
        The driver gets at most one number per bucket.
        """
        most = max(buckets(r.rows) for r in last.id_runs)
        wanted = [r[0] for r in keys.select(_bucket(most)).distinct().collect()] if most > 1 else [0]
        folders = []
        for run in last.id_runs:
            names = {f"bucket={n & (buckets(run.rows) - 1)}" for n in wanted}
            if buckets(run.rows) > 1:
                names &= set(R.children(self.spark, f"{self.path}/{run.folder}"))
            folders += [f"{run.folder}/{n}" for n in sorted(names)]
        return self._read(folders, IDS_SCHEMA)

    # --- writing ---------------------------------------------------------------------

    def replace_state(self, state: DataFrame) -> None:
        """Store a snapshot in place of the one of its batch."""
        row = state.first()
        self._write_state(**row.asDict())

    def _write_state(self, **values) -> None:
        """Commit a batch."""
        text = json.dumps({k: _plain(v) for k, v in values.items()})
        row = self.spark.range(1, numPartitions=1).select(F.from_json(F.lit(text), S.STATE_SCHEMA).alias("s"))
        row.select("s.*").write.mode("overwrite").parquet(f"{self.path}/state/batch_no={values['batch_no']}")

    def _repaired(self) -> Row | None:
        """The newest snapshot; one that is of no use is first made anew from the rows."""
        last = self._last()
        if last is None or _usable(last):
            return last
        rows = self._rows(last)
        found = rows.agg(F.max(F.struct(*S.LEDGER_ORDER)).alias("high"), F.max(_SEQ).alias("seq")).first()
        if found.seq is None:
            return last
        tail, size = self._indexed(rows)
        folded = self._fold(MountainRange(), (None, None), [], tail, size, f"blocks/repaired={last.batch_no}")
        values = last.asDict() | folded | {"last_created": found.high[0], "last_seq": found.high[1], "next_seq": found.seq + 1}
        values["prefixes"] = [self._prefix(values)]
        self._write_state(**values)
        return self._last()

    def append(
        self,
        batch: DataFrame,
        updated_at_utc: str | None = None,
        order: tuple[str, ...] = ("synced_at_utc", "created_locally_at_utc"),
        batch_key: str | None = None,
    ) -> MountainRange:
        """Add the batch's new rows and store the new root.

        A batch whose key the newest snapshot has is already stored, and nothing
        is done.

        The batch's sealed rows are worked out once and kept beside the ledger until the batch
        is stored.  Their keys alone meet the stored ids of their own buckets, are numbered and
        folded; whole rows move once more, to be written in order.
        """
        ensure_checkpoint_dir(self.spark)
        last = self._repaired()
        if last is not None and batch_key is not None and last.batch_key == batch_key:
            return _range_of(last)
        kept = f"incoming/batch_no={0 if last is None else last.batch_no + 1}"
        with dropping_shuffles(self.spark, batch.sparkSession):
            try:
                valid = valid_rows(batch.select(*S.LEDGER_TEXT_COLUMNS), order)
                self._write(valid.select(*[F.col(c).cast("string").alias(c) for c in S.LEDGER_TEXT_COLUMNS]), kept)
                fresh = self._read([kept], S.LEDGER_TEXT_SCHEMA)
                summary, count = self._commit(last, fresh, updated_at_utc or utc_now(), batch_key)
            finally:
                R.remove(self.spark, f"{self.path}/{kept}")
        if count > self._slice(count):
            # Spark removes the checkpoint of so many keys only once the driver has collected its garbage.
            self.spark._jvm.System.gc()
        return summary

    def _commit(self, last: Row | None, fresh: DataFrame, updated_at_utc: str, batch_key: str | None) -> tuple[MountainRange, int]:
        """The range after the batch, and how many rows it added."""
        batch_no = 0 if last is None else last.batch_no + 1
        first_seq = 0 if last is None else last.next_seq
        keys = fresh.select("object_id", _CREATED, "leaf_hash")
        if last is not None and last.id_runs:
            # Only ids that are in both meet the keys, so a small batch is sent to the stored ids.
            known = known_ids(self._ids(last, keys), keys.select("object_id"))
            keys = keys.join(known, "object_id", "left_anti")
        added, count, low, newest = number_keys(keys, first_seq)
        old = {} if last is None else last.asDict()
        values = {
            "batch_no": batch_no, "updated_at_utc": updated_at_utc, "batch_key": batch_key,
            "rows_added": count, "next_seq": first_seq + count, "min_created": None, "dropped": [],
            "merkle_root": S.EMPTY_ROOT, "leaf_count": 0, "peaks": [], "last_created": None, "last_seq": -1,
            "open_created": None, "open_seq": None,
        } | {k: old[k] for k in ("merkle_root", "leaf_count", "peaks", "last_created", "last_seq", "open_created", "open_seq") if old}
        lists = ("row_runs", "id_runs", "history_runs", "prefixes", "segments")
        values |= {k: list(map(_plain, old.get(k) or [])) for k in lists}
        if count:
            high = (newest, first_seq + count - 1)
            if last is not None and last.last_created is not None:
                high = max(high, (last.last_created, last.last_seq))
            ids = added.select("object_id", F.col(_CREATED).alias("created"), F.col(_SEQ).alias("seq"))
            writes = [
                partial(self._write_ids, ids, f"ids/batch_no={batch_no}", count),
                partial(self._write_rows, fresh, added, f"rows/batch_no={batch_no}", first_seq, count),
            ]
            fold = partial(self._new_range, last, batch_no, added, first_seq, count, low)
            if count > self._slice(count):
                # Each fills the cluster, so one follows the other and finds the disk free of its shuffles.
                folded = fold()
                for write in writes:
                    write()
            else:
                # The three jobs need only the numbered keys, so they share the cluster.
                with ThreadPoolExecutor(2) as side:
                    running = [side.submit(write) for write in writes]
                    folded = fold()
                    for write in running:
                        write.result()
            for part in ("row_runs", "id_runs"):
                values[part].append({"folder": f"{part[:-5]}s/batch_no={batch_no}", "rows": count})
            values |= {"min_created": low, "last_created": high[0], "last_seq": high[1]}
            values |= folded
            values["prefixes"] = [p for p in values["prefixes"] if p["last_created"] <= low]
            values["prefixes"] = self._thinned([*values["prefixes"], self._prefix(values)])
            self._merge(values)
        self._keep_history(values)
        self._write_state(**values)
        for folder in [] if last is None else last.dropped or []:
            R.remove(self.spark, f"{self.path}/{folder}")
        return MountainRange(values["leaf_count"], tuple(values["peaks"])), count

    def _write(self, rows: DataFrame, folder: str, mode: str = "overwrite", *by: str) -> None:
        rows.write.mode(mode).option("compression", R.CODEC).partitionBy(*by).parquet(f"{self.path}/{folder}")

    def _slice(self, count: int) -> int:
        """New rows that are written at once."""
        files = max(FILES_PER_SLICE, FILES_PER_CORE * self.spark.sparkContext.defaultParallelism)
        return ROWS_PER_FILE * max(files, -(-count // (ROWS_PER_FILE * MOST_SLICES)))

    def _write_rows(self, fresh: DataFrame, added: DataFrame, folder: str, first_seq: int, count: int) -> None:
        """Write new rows in their order, a run of numbers per file.

        Whole rows are shuffled twice for that, which would take more disk than the rows that
        are stored.  So they are written in slices of their order, at most ``MOST_SLICES``; each
        reads all fresh rows.
        """
        step = self._slice(count)
        place, order = F.col(_SEQ) - first_seq, F.struct(_CREATED, "object_id")
        starts = []
        if count > step:
            starts = added.where(place % step == 0).sort(_SEQ).select(_CREATED, "object_id").collect()
        for number in range(-(-count // step)):
            rows, keys = fresh, added
            first, size = number * step, min(step, count - number * step)
            if starts:
                keys = added.where(place.between(first, first + size - 1))
                low, *high = starts[number : number + 2]
                rows = rows.where((F.col(_CREATED) >= low[0]) & (order >= F.struct(*map(F.lit, low))))
                for end in high:
                    rows = rows.where((F.col(_CREATED) <= end[0]) & (order < F.struct(*map(F.lit, end))))
            wide = rows.join(keys.select("object_id", _SEQ), "object_id").select(*S.LEDGER_COLUMNS)
            part = F.floor((place - first) / ROWS_PER_FILE).cast("int")
            placed = wide.repartitionById(-(-size // ROWS_PER_FILE), part).sortWithinPartitions(_SEQ)
            self._write(placed, folder, "append" if number else "overwrite")

    def _write_ids(self, ids: DataFrame, folder: str, count: int) -> None:
        """Write ids by bucket; within one they are sorted, so pages hold ranges of ids."""
        number = buckets(count)
        bucketed = ids.withColumn("bucket", _bucket(number).cast("int"))
        placed = bucketed.repartitionById(number, F.col("bucket")).sortWithinPartitions("bucket", "object_id")
        self._write(placed, folder, "overwrite", "bucket")

    # --- root ------------------------------------------------------------------------

    def _indexed(self, rows: DataFrame) -> tuple[DataFrame, int]:
        return with_dense_index(rows.select(*S.LEDGER_ORDER, "leaf_hash"), list(S.LEDGER_ORDER))

    def _new_range(self, last: Row | None, batch_no: int, added: DataFrame, first_seq: int, count: int, low: str) -> dict:
        """Range after a batch, re-folding only the changed tail.

        A row dated in the past moves every later leaf, but leaves before it
        keep their places.  The fold restarts from the newest snapshot all of whose
        rows come before the batch's, or from the last block that begins before them,
        whichever is later.
        """
        folder = f"blocks/batch_no={batch_no}"
        before = [p for p in (last.prefixes if last is not None else []) if p.last_created <= low]
        kept = before[-1] if before else None
        base, opened = MountainRange(), (None, None)
        if kept is not None:
            base, opened = MountainRange(kept.leaf_count, tuple(kept.peaks)), (kept.open_created, kept.open_seq)
        segments = [] if last is None else list(map(_plain, last.segments))
        if last is None or base.leaf_count == last.leaf_count:
            # All of the batch comes last, and its numbers follow its order.
            tail = added.withColumn("leaf_index", F.col(_SEQ) + (base.leaf_count - first_seq))
            return self._fold(base, opened, segments, tail, count, folder)
        created, seq = F.col(_CREATED), F.col(_SEQ)
        rows, after = self._rows(last), None
        block = self._block_before(last, segments, low)
        if block is not None and block[0] * BLOCK > base.leaf_count:
            base, opened = self._up_to(base, segments, block[0]), (None, None)
            after = (created > block[1]) | (seq >= block[2]), block[1]
        elif kept is not None:
            after = (created > kept.last_created) | (seq > kept.last_seq), kept.last_created
        if after is not None:
            rows = rows.where((created >= after[1]) & after[0])
        columns = (*S.LEDGER_ORDER, "leaf_hash")
        tail, size = self._indexed(rows.select(*columns).unionByName(added.select(*columns)))
        tail = tail.withColumn("leaf_index", F.col("leaf_index") + base.leaf_count)
        return self._fold(base, opened, segments, tail, size, folder)

    def _fold(self, base: MountainRange, opened: tuple, segments: list[dict], tail: DataFrame, size: int, folder: str) -> dict:
        """Values of the state once ``size`` leaves follow the base; ``opened`` is the order of its unfinished block."""
        start, end = base.leaf_count, base.leaf_count + size
        first, last, split = start // BLOCK, end // BLOCK, start % BLOCK > 0
        inner = last - first - split > 0
        # One of 1,024 leaves; kept, as the tail itself is read anew by each job.
        firsts = tail.where(F.col("leaf_index") % BLOCK == 0).select("leaf_index", *S.LEDGER_ORDER)
        firsts = firsts.persist(StorageLevel.DISK_ONLY)

        def store(nodes: DataFrame) -> DataFrame:
            begun = firsts.select(
                F.lit(True).alias("whole"), F.shiftright("leaf_index", BLOCK_LEVELS).alias("block"),
                F.col(_CREATED).alias("created"), F.col(_SEQ).alias("seq"),
            )
            placed = nodes.withColumnRenamed("pos", "block").withColumn("whole", F.col("height") >= BLOCK_LEVELS)
            placed = placed.join(begun, ["whole", "block"], "left").select("height", "block", "node", "created", "seq")
            self._write(placed, folder)
            kept = self._read([folder], BLOCKS_SCHEMA)
            return kept.select("height", F.col("block").alias("pos"), "node", F.lit(False).alias("folded"))

        extra = {"keep": store} if inner else {}
        blocks: dict[int, str] = {}
        summary = base.extended(perfect_trees(tail, start, end, **extra), blocks)
        known = {}
        if last > first or not split:
            at = firsts.where(F.col("leaf_index").isin(start, last * BLOCK))
            known = {r.leaf_index: (r[_CREATED], r[_SEQ]) for r in at.collect()}
        firsts.unpersist()
        segments = [s | {"last": min(s["last"], first)} for s in segments if s["first"] < first]
        if last > first:
            key = opened if split else known[start]
            node = blocks[first] if split else None
            segments.append(
                {"folder": folder if inner else None, "first": first, "last": last, "created": key[0], "seq": key[1], "node": node}
            )
        after = known.get(last * BLOCK, opened if last == first else (None, None))
        return {
            "merkle_root": summary.root, "leaf_count": summary.leaf_count, "peaks": list(summary.peaks),
            "segments": segments, "open_created": after[0], "open_seq": after[1],
        }

    def _block_before(self, last: Row, segments: list[dict], low: str) -> tuple[int, str, int] | None:
        """The last block whose first leaf comes before all rows dated from ``low`` on, and that leaf's order."""
        if last.open_created is not None and last.open_created <= low:
            return last.leaf_count // BLOCK, last.open_created, last.open_seq
        before = [s for s in segments if s["created"] <= low]
        if not before:
            return None
        segment = before[-1]
        found = None
        if segment["folder"]:
            nodes = self._nodes([segment]).where(F.col("created") <= low)
            found = nodes.agg(F.max(F.struct("block", "created", "seq")).alias("m")).first().m
        return tuple(found) if found else (segment["first"], segment["created"], segment["seq"])

    def _nodes(self, segments: list[dict]) -> DataFrame:
        """Stored nodes of the segments' blocks."""
        block = F.col("block")
        parts = [
            self._read([s["folder"]], BLOCKS_SCHEMA).where(
                (F.col("height") >= BLOCK_LEVELS) & (block >= s["first"]) & (block < s["last"])
            )
            for s in segments if s["folder"]
        ]
        single = [(BLOCK_LEVELS, s["first"], s["node"], s["created"], s["seq"]) for s in segments if s["node"]]
        found = self.spark.createDataFrame(single, BLOCKS_SCHEMA)
        for part in parts:
            found = found.unionByName(part)
        return found

    def _up_to(self, base: MountainRange, segments: list[dict], block: int) -> MountainRange:
        """The range of all leaves before a block, from the base's whole blocks and the stored nodes."""
        first = base.leaf_count // BLOCK
        whole = MountainRange(first * BLOCK, base.peaks[: first.bit_count()])
        near = [s for s in segments if s["last"] > first and s["first"] < block]
        nodes = self._nodes(near).where(F.col("block").between(first, block - 1))
        trees = perfect_trees(nodes, first, block, index="block", leaf="node")
        return whole.extended([(height + BLOCK_LEVELS, node) for height, node in trees])

    @staticmethod
    def _prefix(values: dict) -> dict:
        return {k: values[k] for k in ("batch_no", "leaf_count", "last_created", "last_seq", "peaks", "open_created", "open_seq")}

    @staticmethod
    def _thinned(prefixes: list) -> list:
        """Any choice of them is right; a fold that restarts from an older one reads more rows."""
        if len(prefixes) <= 2 * PREFIXES:
            return prefixes
        return prefixes[:-PREFIXES][::2] + prefixes[-PREFIXES:]

    # --- merging ---------------------------------------------------------------------

    def _merged(self, values: dict, part: str, write) -> None:
        """Merge the newest runs of a kind if enough are of one size."""
        found = values[part]
        start = R.merge_from([r["rows"] for r in found])
        if start is None:
            return
        folder = f"{part.removesuffix('_runs').replace('row', 'rows').replace('id', 'ids')}/merged={values['batch_no']}"
        count = sum(r["rows"] for r in found[start:])
        write([r["folder"] for r in found[start:]], folder, count)
        values["dropped"] += [r["folder"] for r in found[start:]]
        values[part] = [*found[:start], {"folder": folder, "rows": count}]

    def _merge(self, values: dict) -> None:
        """Merge small runs; the batch's state row switches to the merged ones."""

        def rows(folders: list[str], folder: str, count: int) -> None:
            placed = self._read(folders, S.LEDGER_SCHEMA).repartitionByRange(-(-count // ROWS_PER_FILE), *S.LEDGER_ORDER)
            self._write(placed.sortWithinPartitions(*S.LEDGER_ORDER), folder)

        def ids(folders: list[str], folder: str, count: int) -> None:
            found = [f"{f}/{n}" for f in folders for n in R.children(self.spark, f"{self.path}/{f}") if n.startswith("bucket=")]
            self._write_ids(self._read(found, IDS_SCHEMA), folder, count)

        self._merged(values, "row_runs", rows)
        self._merged(values, "id_runs", ids)
        segments = values["segments"]
        start = R.merge_from([s["last"] - s["first"] for s in segments])
        if start is not None:
            folder = f"blocks/merged={values['batch_no']}"
            count = segments[-1]["last"] - segments[start]["first"]
            nodes = self._nodes(segments[start:])
            placed = nodes.repartitionByRange(-(-count // ROWS_PER_FILE), "block").sortWithinPartitions("block")
            self._write(placed, folder)
            values["dropped"] += [s["folder"] for s in segments[start:] if s["folder"]]
            values["segments"] = [*segments[:start], segments[start] | {"folder": folder, "last": segments[-1]["last"], "node": None}]

    def _keep_history(self, values: dict) -> None:
        """Move older snapshots to a run of the history, every few batches."""
        first = sum(r["rows"] for r in values["history_runs"])
        last = values["batch_no"]
        if last - first < HISTORY_STEP:
            return
        folder, singles = f"history/batch_no={last}", [f"state/batch_no={n}" for n in range(first, last)]

        def write(folders: list[str], folder: str, count: int) -> None:
            rows = self._read(folders, S.SNAPSHOT_FIELDS).coalesce(1).sortWithinPartitions("batch_no")
            rows.write.mode("overwrite").parquet(f"{self.path}/{folder}")

        write(singles, folder, last - first)
        values["dropped"] += singles
        values["history_runs"].append({"folder": folder, "rows": last - first})
        self._merged(values, "history_runs", write)

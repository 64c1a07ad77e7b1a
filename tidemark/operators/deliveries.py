"""Problem 7: messages delivered more than once, of which exactly one copy is kept.

A SeenLedger keeps, in a folder all executors share, an exact dictionary of message identifiers (identifier to shard and
dense code) and for each shard a compressed bitmap with one bit for each code. Deliveries are brought to their shard once
and come by there in order of arrival: their identifiers are encoded, an arrival whose bit is unset is kept and sets it,
any other is a repeat of the one kept. The new part of the dictionary and the united bitmaps are written as a draft that
takes effect by one exclusive claim of the next version.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import shared_path
from tidemark.tables import micros, need

ROWS_OF_SHARD, LEAST_SHARDS = 100_000, 12
MAX_HOT = 4096
SAMPLE_ROWS = 200_000  # of so many deliveries hot identifiers are looked for; what is missed there is only slower
COMPACT_AFTER = 8  # versions
ARRIVALS_AT_ONCE = 65_536

_LEDGER = "what string, shard int, key string, code bigint, delivery_id bigint, received_us bigint, digest binary, kept_id bigint, kind string, bits binary"
_NAMES = [f.split()[0] for f in _LEDGER.split(", ")]
_ARROW = pa.schema([("what", pa.string()), ("shard", pa.int32()), ("key", pa.string()), ("code", pa.int64()), ("delivery_id", pa.int64()), ("received_us", pa.int64()), ("digest", pa.binary()), ("kept_id", pa.int64()), ("kind", pa.string()), ("bits", pa.binary())])


class Conflict(RuntimeError):
    """Another batch was admitted meanwhile, or a known message came with another payload."""


def pack_bits(bits: np.ndarray) -> bytes:
    return zlib.compress(np.packbits(bits).tobytes(), 1)


def unpack_bits(data: bytes | None, size: int) -> np.ndarray:
    if data is None:
        return np.zeros(size, dtype=bool)
    known = np.unpackbits(np.frombuffer(zlib.decompress(data), dtype=np.uint8)).astype(bool)
    out = np.zeros(max(size, len(known)), dtype=bool)
    out[: len(known)] = known
    return out[:size]


@dataclass
class _Shard:
    """One shard while its deliveries come by."""

    number: int
    codes: dict = field(default_factory=dict)  # identifier -> code, of those that occur in this batch
    kept: dict = field(default_factory=dict)  # code -> (delivery_id, digest) of the arrival that was kept
    told: set = field(default_factory=set)
    size: int = 0
    bits: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))

    def restore(self, size: int, bits: bytes | None) -> None:
        self.size, self.bits = size, unpack_bits(bits, size)

    def know(self, key: str, code: int, delivery_id: int, digest: bytes | None) -> None:
        self.codes[key], self.kept[code] = code, (delivery_id, digest)

    def encode(self, keys: list[str]) -> np.ndarray:
        found, codes = self.codes, np.empty(len(keys), dtype=np.int64)
        for i, k in enumerate(keys):
            code = found.get(k)
            if code is None:
                code = found[k] = self.size
                self.size += 1
            codes[i] = code
        if self.size > len(self.bits):
            self.bits = np.concatenate((self.bits, np.zeros(max(self.size - len(self.bits), len(self.bits), 1024), bool)))
        return codes

    def pass_by(self, keys: list, ids: list, received: list, digests: list) -> tuple[list[tuple], list[tuple]]:
        """(kept, repeats) of arrivals in order: whose bit is unset is kept, once, and the bits are united."""
        codes = self.encode(keys)
        first = np.zeros(len(codes), bool)
        first[np.unique(codes, return_index=True)[1]] = True
        new = first & ~self.bits[codes]
        self.bits[codes] = True
        kept, repeats = [], []
        for i in np.flatnonzero(new).tolist():
            self.kept[int(codes[i])] = (ids[i], digests[i])
            kept.append((keys[i], int(codes[i]), ids[i], received[i], digests[i]))
        for i in np.flatnonzero(~new).tolist():
            kept_id, digest = self.kept[int(codes[i])]
            if kept_id == ids[i]:
                continue  # the same delivery again
            row = (keys[i], int(codes[i]), ids[i], received[i], digests[i], kept_id, "same" if digest == digests[i] else "differs")
            if row[2:3] + row[5:] not in self.told:
                self.told.add(row[2:3] + row[5:])
                repeats.append(row)
        return kept, repeats


def _table(what: str, shard: int, rows: list[tuple]) -> pa.RecordBatch:
    cols = dict(zip(_NAMES[2:], zip(*rows, strict=True), strict=False)) if rows else {}
    return pa.RecordBatch.from_arrays([pa.array([what] * len(rows), pa.string()), pa.array([shard] * len(rows), pa.int32()), *(pa.array(cols.get(f.name, [None] * len(rows)), f.type) for f in list(_ARROW)[2:])], schema=_ARROW)


def _admit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (shard, turn, arrival): the shard's bitmap (turn 0), known identifiers (1), deliveries (2)."""
    shard: _Shard | None = None

    def close() -> Iterator[pa.RecordBatch]:
        if shard is not None:
            yield _table("bitmap", shard.number, [(None, shard.size, None, None, None, None, None, pack_bits(shard.bits[: shard.size]))])

    for batch in batches:
        numbers, turns = batch.column("shard").to_numpy(), batch.column("turn").to_numpy()
        cuts = np.flatnonzero((np.diff(numbers) != 0) | (np.diff(turns) != 0)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(numbers)], strict=True):
            if a == b:
                continue
            if shard is None or shard.number != numbers[a]:
                yield from close()
                shard = _Shard(int(numbers[a]))
            part = batch.slice(a, b - a)
            keys, ids, digests = (part.column(c).to_pylist() for c in ("key", "delivery_id", "digest"))
            if turns[a] == 0:
                shard.restore(part.column("code")[0].as_py(), digests[0])
            elif turns[a] == 1:
                for row in zip(keys, part.column("code").to_pylist(), ids, digests, strict=True):
                    shard.know(*row)
            else:
                kept, repeats = shard.pass_by(keys, ids, part.column("received_us").to_pylist(), digests)
                if kept:
                    yield _table("admitted", shard.number, kept)
                if repeats:
                    yield _table("repeat", shard.number, repeats)
    yield from close()


@dataclass(frozen=True)
class Admission:
    """What one batch came to: first arrivals (key, code, delivery_id, received_us, digest) and repeats (key, delivery_id,
    kept_id, kind), of this batch only."""

    admitted: DataFrame
    repeats: DataFrame


@dataclass
class SeenLedger:
    """The identifiers seen so far, in `path`. shards is how many it begins with; compaction makes more where shards have
    grown. A version is the file commits/N, which names its folder and is made exclusively: by a hard link where the path
    is local or mounted, elsewhere by a rename that must not find a target."""

    spark: SparkSession
    path: str
    shards: int = 16

    def _hadoop(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _local(self, name: str) -> str | None:
        """The plain path of a name below the ledger's; None where the path is on another file system."""
        if self.path.startswith("file:"):
            return f"/{self.path[5:].lstrip('/')}/{name}"
        mounted = self.path.startswith("/") and self.spark._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///").startswith("file:")
        return f"{self.path}/{name}" if mounted else None

    def commits(self) -> list[dict]:
        """The versions in order: number, folder, shards, kind (delta or base) and tag."""
        out = []
        if (local := self._local("commits")) is not None:
            for name in sorted(n for n in (os.listdir(local) if os.path.isdir(local) else []) if n.isdigit()):
                with open(f"{local}/{name}") as f:
                    out.append(json.load(f) | {"number": int(name)})
            return out
        fs, folder = self._hadoop(f"{self.path}/commits")
        if not fs.exists(folder):
            return []
        for status in sorted(fs.listStatus(folder), key=lambda s: s.getPath().getName()):
            if status.getPath().getName().isdigit():
                lines = self.spark.sparkContext.wholeTextFiles(status.getPath().toString()).values().collect()  # one small file
                out.append(json.loads(lines[0]) | {"number": int(status.getPath().getName())})
        return out

    def _claim(self, number: int, commit: dict) -> bool:
        """Makes commits/number, whole and at once, unless it is there already."""
        name, text = f"{number:08d}", json.dumps(commit)
        draft = f"{name}-{uuid.uuid4().hex}"
        if (local := self._local("commits")) is not None:
            os.makedirs(local, exist_ok=True)
            with open(f"{local}/{draft}", "w") as f:
                f.write(text)
                f.flush()
                os.fsync(f.fileno())
            try:
                os.link(f"{local}/{draft}", f"{local}/{name}")
            except FileExistsError:
                return False
            finally:
                os.unlink(f"{local}/{draft}")
            return True
        fs, source = self._hadoop(f"{self.path}/commits/{draft}")
        out = fs.create(source, False)
        out.write(bytearray(text.encode()))
        out.close()
        _, target = self._hadoop(f"{self.path}/commits/{name}")
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(source.toUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark._sc._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(source, target, none)  # fails where the target is there
        except Exception:
            fs.delete(source, False)
            if fs.exists(target):
                return False
            raise
        return True

    def versions(self) -> list[str]:
        """The folders that hold the ledger, from the last compaction on."""
        return [f"{self.path}/{c['folder']}" for c in self._since_base(self.commits())]

    @staticmethod
    def _since_base(commits: list[dict]) -> list[dict]:
        bases = [i for i, c in enumerate(commits) if c["kind"] == "base"]
        return commits[bases[-1] :] if bases else commits

    def _read(self, folders: list[str], what: str) -> DataFrame:
        return self.spark.read.schema(_LEDGER).parquet(*folders).filter(F.col("what") == what)

    def admitted(self) -> DataFrame | None:
        """The dictionary: (shard, key, code, delivery_id, received_us, digest), one row for each identifier ever kept."""
        found = self.versions()
        return self._read(found, "admitted").select("shard", "key", "code", "delivery_id", "received_us", "digest") if found else None

    def _state(self, folders: list[str]) -> DataFrame:
        maps = self._read(folders, "bitmap")  # codes only grow: the latest has most
        return maps.groupBy("shard").agg(F.max_by(F.struct("code", "bits"), "code").alias("b")).select("shard", F.lit(0).alias("turn"), F.lit(None).cast("string").alias("key"), "b.code", F.lit(None).cast("bigint").alias("delivery_id"), F.lit(None).cast("bigint").alias("received_us"), F.col("b.bits").alias("digest"))

    def _shard_of(self, shards: int):
        return F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int")

    def _draft(self, arrivals: DataFrame, shards: int, folders: list[str]) -> str:
        """Lets arrivals (key, delivery_id, received_us, digest) pass by their shards, and gives the folder of the draft."""
        line = arrivals.select(self._shard_of(shards).alias("shard"), F.lit(2).alias("turn"), "key", F.lit(None).cast("bigint").alias("code"), "delivery_id", "received_us", "digest")
        if folders:  # of the dictionary only what occurs in this batch is shuffled
            asked = line.select("shard", "key").distinct()
            known = self._read(folders, "admitted").select("shard", F.lit(1).alias("turn"), "key", "code", "delivery_id", "received_us", "digest").join(asked, ["shard", "key"], "left_semi")
            line = line.unionByName(known).unionByName(self._state(folders))
        order = ["shard", "turn", F.col("received_us").asc_nulls_last(), "delivery_id"]
        width = max(shards, self.spark.sparkContext.defaultParallelism)
        rows = line.repartition(width, "shard").sortWithinPartitions(*order).mapInArrow(_admit, _LEDGER)
        folder = f"draft-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{folder}")
        return folder

    def admit(self, messages: DataFrame, tag: str | None = None) -> Admission:
        """Admits a batch (key, received_us, delivery_id, digest). Of an identifier that was unseen one arrival is kept, the
        earliest received, null last, then the smallest delivery_id; every other delivery repeats the one kept, in this
        batch or an earlier one. Rows with a null key are left out, the same delivery again repeats nothing.

        If another batch was admitted meanwhile, Conflict is raised, nothing was changed, and the batch may be tried again. A
        tag that was admitted before gives what it came to then, so that a batch run again after a failure changes nothing.
        """
        commits = self.commits()
        done = [c for c in commits if tag is not None and c["tag"] == tag]
        if not done:
            live = self._since_base(commits)
            shards = live[-1]["shards"] if live else self.shards
            folder = self._draft(messages.filter("key is not null"), shards, [f"{self.path}/{c['folder']}" for c in live])
            done = [{"folder": folder, "shards": shards, "kind": "delta", "tag": tag}]
            if not self._claim(len(commits), done[0]):
                fs, path = self._hadoop(f"{self.path}/{folder}")
                fs.delete(path, True)
                raise Conflict("another batch was admitted meanwhile")
        own = [f"{self.path}/{done[0]['folder']}"]
        out = Admission(self._read(own, "admitted").select("key", "code", "delivery_id", "received_us", "digest"), self._read(own, "repeat").select("key", "delivery_id", "kept_id", "kind"))
        if len(self._since_base(commits)) >= COMPACT_AFTER:
            self.compact()
        return out

    def compact(self) -> bool:
        """Writes the dictionary anew as one version, in as many shards as its size asks for; False if another came first."""
        commits = self.commits()
        live = self._since_base(commits)
        if not live:
            return False
        words = self._read([f"{self.path}/{c['folder']}" for c in live], "admitted").select("key", "delivery_id", "received_us", "digest")
        shards = max(live[-1]["shards"], words.count() // ROWS_OF_SHARD)
        folder = self._draft(words, shards, [])
        return self._claim(len(commits), {"folder": folder, "shards": shards, "kind": "base", "tag": None})

    def vacuum(self) -> None:
        """Removes folders that no version since the last compaction, nor the last tagged one, names; only while nobody
        else reads or writes."""
        commits = self.commits()
        kept = {c["folder"] for c in [*self._since_base(commits), *[c for c in commits if c["tag"] is not None][-1:]]}
        fs, root = self._hadoop(self.path)
        for status in fs.listStatus(root):
            name = status.getPath().getName()
            if name.startswith("draft-") and name not in kept:
                fs.delete(status.getPath(), True)


def canonical_json(column: str):
    """JSON text with members in one order, without white space, strings and numbers in one spelling; a text that is no
    JSON, or repeats a member, stays as it is. A number in exponent form equals only the same number in exponent form."""
    return F.coalesce(F.to_json(F.try_parse_json(column)), F.concat(F.lit("raw:"), F.col(column)))


def message_key(event_id: str, payload: str):
    """The identifier trimmed and in lower case, or if it is null or blank the event_id within the payload."""
    bare = lambda c: F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))
    own = bare(F.col(f"`{event_id}`"))
    inner = bare(F.try_variant_get(F.try_parse_json(f"`{payload}`"), "$.event_id", "string"))
    return F.when(own != "", own).otherwise(F.when(inner != "", inner))


def message_keys(df: DataFrame, delivery_id: str, received: str, event_id: str, payload: str) -> DataFrame:
    """(key, received_us, delivery_id, digest) of each delivery: its identifier, and the digest of the payload as JSON, null
    for null."""
    need(df, delivery_id, received, event_id, payload)
    rows = df.select(F.col(f"`{delivery_id}`").cast("bigint").alias("delivery_id"), micros(df, received).alias("received_us"), message_key(event_id, payload).alias("key"), F.col(f"`{payload}`").alias("payload"))
    return rows.select("key", "received_us", "delivery_id", F.unhex(F.sha2(canonical_json("payload"), 256)).alias("digest"))


def hot_keys(df: DataFrame, key, total: int, hot_rows: int) -> list[str]:
    """Identifiers that hold more than hot_rows deliveries, and a MAX_HOT-th of all, going by a sample; at most MAX_HOT."""
    if total <= hot_rows:
        return []
    share = min(1.0, SAMPLE_ROWS / total)
    counts = df.sample(share, 7).select(key.alias("key")).filter("key is not null").groupBy("key").count()
    found = counts.filter(F.col("count") > max(hot_rows, total // MAX_HOT) * share).orderBy(F.desc("count")).limit(MAX_HOT).collect()
    return [r["key"] for r in found]


def repeated_deliveries(df: DataFrame, delivery_id: str, received: str, event_id: str, payload: str, ledger: SeenLedger | None = None, hot_rows: int = ROWS_OF_SHARD) -> DataFrame:
    """(delivery_id, kept_id, kind) of every delivery that is a repeat of kept_id, kind `same` if its payload equals that
    of the kept one as JSON, `differs` if not (null equals null).

    Kept is for each event the delivery admitted by the ledger: in a new one the earliest received, null last, then the
    smallest delivery_id. A delivery without any identifier repeats nothing. Repeated rows of one delivery_id count as one
    delivery. Deliveries are read and digested once and pass by their shard. Events that would fill a shard of their own
    (going by a sample, at most MAX_HOT) send only their first arrival there, combined before the shuffle; their other
    deliveries are matched with it by a broadcast of one row for each such event.
    """
    spark = df.sparkSession
    keyed = message_keys(df, delivery_id, received, event_id, payload)
    total = df.count()
    hot = hot_keys(df, message_key(event_id, payload), total, hot_rows)
    if ledger is None:
        ledger = SeenLedger(spark, shared_path(spark, "seen"), max(LEAST_SHARDS, total // ROWS_OF_SHARD))
    if not hot:
        return ledger.admit(keyed).repeats.select("delivery_id", "kept_id", "kind")
    names = F.broadcast(spark.createDataFrame([(k,) for k in hot], "key string"))
    folder = shared_path(spark, "keyed")  # read twice, and dear to make
    keyed.filter("key is not null").write.parquet(folder)
    keyed = spark.read.schema(keyed.schema).parquet(folder)
    many = keyed.join(names, "key", "left_semi")
    first = F.min(F.struct(F.col("received_us").isNull().alias("late"), "received_us", "delivery_id", "digest")).alias("f")
    firsts = many.groupBy("key").agg(first).select("key", "f.received_us", "f.delivery_id", "f.digest")
    came = ledger.admit(keyed.join(names, "key", "left_anti").unionByName(firsts))
    kept = ledger.admitted().join(names, "key", "left_semi").select("key", F.col("delivery_id").alias("kept_id"), F.col("digest").alias("kept_digest"))
    kind = F.when(F.col("digest").eqNullSafe(F.col("kept_digest")), "same").otherwise("differs").alias("kind")
    others = many.join(F.broadcast(kept), "key").filter("delivery_id <> kept_id").select("delivery_id", "kept_id", kind).distinct()
    return came.repeats.join(names, "key", "left_anti").select("delivery_id", "kept_id", "kind").unionByName(others)

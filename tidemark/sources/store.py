"""Tables as lists of Parquet folders, of which numbered lists say which are current.

A folder has rows, or keys of older rows that are gone; a filter of a folder's keys tells which keys it cannot hold.

All folders of a run are written first and the list that names them last, under the next number and never over another file. The
highest list that is whole counts, so that readers see either the run or what was before it, whichever step a job dies at. One
writer at a time; two that meet cannot both take a number.
"""

from __future__ import annotations

import json
import tempfile
import time
import uuid
from datetime import timedelta
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schemas

#: The key of each table, tables whose folders have a filter of their keys, and its shape: keys for each block of words with a bit a key.
KEYS = {"sources": "id", "articles": "id", "chats": "article_id"}
FILTERED, KEYS_A_BLOCK, WORDS = ("articles",), 8, 8
_FILTER = "folder string, blocks int, block int, " + ", ".join(f"b{i} int" for i in range(WORDS))

#: Lists and notes that are kept behind the newest, for readers that are under way.
KEPT = 4


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or where that is unset and all tasks run on this machine a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return (root or tempfile.mkdtemp(prefix="tidemark-")).rstrip("/")


def _is(error: Py4JJavaError, *names: str) -> bool:
    return error.java_exception.getClass().getSimpleName() in names


class Fenced(RuntimeError):
    """A write by the holder of a lock that another has taken since."""


class Store:
    """Named tables below ``root``, on any file system that Spark writes to."""

    SCHEMAS = {"sources": schemas.SOURCES, "articles": schemas.ARTICLES, "chats": schemas.CHATS}

    def __init__(self, spark: SparkSession, root: str, token: int | None = None):
        self.spark, self.root, self.token = spark, root.rstrip("/"), token
        self.opened: list[str] = []
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # small files

    def create(self, name: str, text: str) -> bool:
        """Write a file that is not there; whether it was this call that made it."""
        try:
            stream = self._fs.create(self._path(f"{self.root}/{name}"), False)
        except Py4JJavaError as e:
            if _is(e, "FileAlreadyExistsException"):
                return False
            raise
        stream.write(bytearray(text.encode()))
        stream.close()
        return True

    def remove(self, name: str) -> bool:
        """Delete a file; whether it was this call that did it."""
        return self._fs.delete(self._path(f"{self.root}/{name}"), True)

    def content(self, name: str) -> str | None:
        """The text of a file; none if it is not there or its writer died."""
        try:
            stream = self._fs.open(self._path(f"{self.root}/{name}"))
            try:
                return bytes(stream.readAllBytes()).decode()
            finally:
                stream.close()
        except Py4JJavaError as e:
            if _is(e, "FileNotFoundException", "ChecksumException", "EOFException"):
                return None
            raise

    def numbers(self, name: str) -> list[int]:
        folder = self._path(f"{self.root}/{name}")
        found = (s.getPath().getName() for s in self._fs.listStatus(folder)) if self._fs.exists(folder) else ()
        return sorted((int(n) for n in found if n.isdigit()), reverse=True)

    def _newest(self, name: str):
        """The content of the highest whole file of a name, as JSON."""
        for number in self.numbers(name):
            try:
                return json.loads(self.content(f"{name}/{number:012d}") or "")
            except ValueError:
                continue
        return None

    def _try_put(self, name: str, value, number: int | None = None) -> bool:
        """Add a file with the next number, or this one; whether it was free. Those far behind go."""
        numbers = self.numbers(name)
        if not self.create(f"{name}/{number or (numbers[0] + 1 if numbers else 1):012d}", json.dumps(value)):
            return False
        for old in numbers[KEPT:]:
            self.remove(f"{name}/{old:012d}")
        return True

    def _put(self, name: str, value, number: int | None = None) -> None:
        if not self._try_put(name, value, number):
            raise RuntimeError(f"another writer changed {name} of {self.root}")

    def age(self, name: str, now: float) -> float | None:
        """Seconds since a file was last written; none if it is not there."""
        path = self._path(f"{self.root}/{name}")
        return now - self._fs.getFileStatus(path).getModificationTime() / 1000 if self._fs.exists(path) else None

    def read_note(self, name: str) -> str | None:
        """A small text that is kept beside the tables."""
        return self._newest(f"_{name}")

    def write_note(self, name: str, text: str) -> None:
        self._put(f"_{name}", text)

    # tables

    def _current(self) -> dict:
        """tables: pieces in the order they came, {"folder", "kind": rows or gone, "blocks": of the key filter}; fence: the highest token that counts."""
        return {"tables": {}, "batches": {}, "last": None, "fence": 0} | (self._newest("_current") or {})

    def version(self) -> int:
        """A number that rises with every write, for readers that wait for one."""
        return next(iter(self.numbers("_current")), 0)

    def fenced(self, token: int) -> Store:
        """This store for the holder of a lock: writes fail once a later holder has begun (see ``raise_fence``)."""
        return Store(self.spark, self.root, token)

    def raise_fence(self) -> None:
        """Let no write of an earlier token through from now on. A write that came first stays; the one that is under way fails."""
        while True:
            now = self._current()
            self._check(now)
            if now["fence"] == self.token or self._try_put("_current", now | {"fence": self.token}):
                return

    def _check(self, now: dict) -> None:
        if self.token is not None and self.token < now["fence"]:
            raise Fenced(f"the lock {self.token} of {self.root} went to {now['fence']}")

    def _load(self, table: str, pieces: list[dict], folders: list[str] | None = None) -> DataFrame:
        """Rows of the pieces, or of those in ``folders``, that no later piece took away (merge on read)."""
        rows = [f"{self.root}/{table}/{p['folder']}" for p in pieces if p["kind"] == "rows" and (folders is None or p["folder"] in folders)]
        gone = [f"{self.root}/_gone/{table}/{p['folder']}" for p in pieces if p["kind"] == "gone"]
        if not rows:
            return self.spark.createDataFrame([], self.SCHEMAS[table])
        found = self.spark.read.schema(self.SCHEMAS[table]).parquet(*rows)
        if not gone:
            return found
        key, turn = KEYS[table], F.regexp_extract("_metadata.file_path", r"/(\d{12})-[0-9a-f]{32}/", 1).cast("long")
        taken = self.spark.read.schema("gone string").parquet(*gone).select("gone", turn.alias("gone_in"))
        dated = found.select("*", turn.alias("came_in"))
        return dated.join(taken, (F.col(key) == F.col("gone")) & (F.col("came_in") < F.col("gone_in")), "left_anti").select(found.columns)

    def read(self, table: str) -> DataFrame:
        """The current rows; an empty table before the first write."""
        return self._load(table, self._current()["tables"].get(table, []))

    def lookup(self, table: str, ids: DataFrame) -> DataFrame:
        """The current rows of the folders that may hold one of ids(id), by the folders' key filters; ``opened`` names those folders.

        The filters are read first, 4 bytes a stored key; a folder without any of n keys is opened with a probability of about n * 2e-5.
        """
        pieces = self._current()["tables"].get(table, [])
        self.opened = self._folders_with(table, [p for p in pieces if p["kind"] == "rows"], ids)
        return self._load(table, pieces, self.opened)

    def _folders_with(self, table: str, pieces: list[dict], ids: DataFrame) -> list[str]:
        known = [p for p in pieces if p.get("blocks")]
        out = [p["folder"] for p in pieces if p.get("blocks") is None]  # without a filter: of another writer
        if known:
            filters = self.spark.read.schema(_FILTER).parquet(*(f"{self.root}/_keys/{table}/{p['folder']}" for p in known))
            sizes = F.explode(F.array(*(F.lit(n) for n in sorted({p["blocks"] for p in known}))))
            asked = ids.select(F.col("id").cast("string").alias("id")).where("id is not null").distinct().select("id", sizes.alias("blocks"))
            asked = asked.select("blocks", _block(F.col("id"), F.col("blocks")).alias("block"), *(b.alias(f"a{i}") for i, b in enumerate(_bits(F.col("id")))))
            fits = reduce(lambda a, b: a & b, (F.col(f"b{i}").bitwiseAND(F.col(f"a{i}")) != 0 for i in range(WORDS)))
            out += [r[0] for r in asked.join(filters, ["blocks", "block"]).where(fits).select("folder").distinct().collect()]
        return out

    def batch(self, writer: str | None = None) -> str | None:
        """The batch that a writer, or else anybody, wrote last."""
        now = self._current()
        return now["last"] if writer is None else now["batches"].get(writer)

    def _piece(self, table: str, rows: DataFrame, turn: int) -> dict:
        """Rows in a folder of their own, and the key filter of the folder."""
        name = f"{turn:012d}-{uuid.uuid4().hex}"
        rows.select([c.split()[0] for c in _columns(self.SCHEMAS[table])]).write.parquet(f"{self.root}/{table}/{name}")
        piece = {"folder": name, "kind": "rows"}
        if table in FILTERED:
            keys = self.spark.read.schema(self.SCHEMAS[table]).parquet(f"{self.root}/{table}/{name}").select(F.col(KEYS[table]).alias("id"))
            piece["blocks"] = blocks = 1 << max(0, (keys.count() - 1) // KEYS_A_BLOCK).bit_length()
            each = keys.where("id is not null").select(_block(F.col("id"), F.lit(blocks)).alias("block"), *(b.alias(f"b{i}") for i, b in enumerate(_bits(F.col("id")))))
            found = each.groupBy("block").agg(*(F.bit_or(f"b{i}").alias(f"b{i}") for i in range(WORDS)))
            columns = [c.split()[0] for c in _FILTER.split(", ")]
            found.withColumns({"folder": F.lit(name), "blocks": F.lit(blocks)}).select(columns).write.parquet(f"{self.root}/_keys/{table}/{name}")
        return piece

    def _gone(self, table: str, ids: DataFrame, turn: int) -> dict:
        name = f"{turn:012d}-{uuid.uuid4().hex}"
        ids.select(F.col(ids.columns[0]).cast("string").alias("gone")).where("gone is not null").write.parquet(f"{self.root}/_gone/{table}/{name}")
        return {"folder": name, "kind": "gone"}

    def write(self, batch: str | None = None, writer: str = "", *, append: dict[str, DataFrame] | None = None, upsert: dict[str, tuple[DataFrame, DataFrame]] | None = None, **tables: DataFrame) -> None:
        """Replace, append to and upsert tables, all at once.

        ``append`` rows are a new folder; what is there is not read. ``upsert`` is (rows, ids) by table: rows replace those of their id or are
        added, and ids go. Nothing that is stored is written anew: the rows are a new folder, and their ids and those that go a small one beside
        it, which readers hold against older folders until ``compact`` folds it in. A ``batch`` that was the last one of its ``writer`` is skipped,
        so that replays change nothing. A store that is ``fenced`` writes nothing once a later holder of the lock has begun.
        """
        turn, now = self.version() + 1, self._current()
        self._check(now)
        if batch is not None and now["batches"].get(writer) == batch:
            return
        lists = now["tables"]
        for table, rows in tables.items():
            lists[table] = [self._piece(table, rows, turn)]
        for table, rows in (append or {}).items():
            lists[table] = [*lists.get(table, []), self._piece(table, rows, turn)]
        for table, (rows, gone) in (upsert or {}).items():
            key = KEYS[table]
            new = self._piece(table, rows, turn)
            written = self.spark.read.schema(self.SCHEMAS[table]).parquet(f"{self.root}/{table}/{new['folder']}")
            lists[table] = [*lists.get(table, []), self._gone(table, written.select(key).union(gone.select(gone.columns[0])), turn), new]
        if batch is not None:
            now["batches"][writer] = now["last"] = batch
        self._put("_current", now, turn)

    def compact(self, *tables: str) -> None:
        """Write tables anew into one folder each, without the rows that are gone; many batches leave many."""
        turn, now = self.version() + 1, self._current()
        self._check(now)
        for table in tables:
            if len(now["tables"].get(table, [])) > 1:
                now["tables"][table] = [self._piece(table, self._load(table, now["tables"][table]), turn)]
        self._put("_current", now, turn)

    def vacuum(self, older_than: timedelta = timedelta(days=1)) -> None:
        """Delete folders that no current list names. Younger ones stay, since a write that is under way lists its folders last."""
        lists, before = self._current()["tables"], time.time() - older_than.total_seconds()
        for table in self.SCHEMAS:
            current = {p["folder"] for p in lists.get(table, [])}
            for place in (table, f"_gone/{table}", f"_keys/{table}"):
                folder = self._path(f"{self.root}/{place}")
                for status in self._fs.listStatus(folder) if self._fs.exists(folder) else ():
                    if status.getPath().getName() not in current and status.getModificationTime() / 1000 <= before:
                        self._fs.delete(status.getPath(), True)


def _block(key: Column, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(5)), blocks).cast("int")


def _bits(key: Column) -> list[Column]:
    """One bit of each of a block's WORDS words of 32."""
    h = F.xxhash64(key, F.lit(7))
    return [F.call_function("shiftleft", F.lit(1), F.shiftrightunsigned(h, 5 * i).bitwiseAND(F.lit(31)).cast("int")) for i in range(WORDS)]


def _columns(schema: str) -> list[str]:
    """The fields of a schema string, commas inside types aside."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(schema[at:i].strip())
            at = i + 1
    return [*out, schema[at:].strip()]


def merge(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Upsert: rows of ``new`` replace those of ``old`` with the same key."""
    return old.join(new.select(key), key, "left_anti").select(old.columns).unionByName(new.select(old.columns))


def append_new(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Insert the rows of ``new`` whose key is free."""
    return old.unionByName(new.join(old.select(key), key, "left_anti").select(old.columns))


def get(table: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Rows by key, one for each asked id; missing ones are null."""
    return ids.select(key).join(table, key, "left")

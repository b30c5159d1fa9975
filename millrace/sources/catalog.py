"""Versioned tables: Parquet segments, and a log of JSON snapshots whose atomic creation is the only commit point.

Columns are stored under field ids, so a rename writes nothing and a dropped name can return as another column. A delete adds a
tombstone that reads apply to older segments. Every snapshot stays readable until it is expired.
"""

from __future__ import annotations

import copy
import decimal
import json
import os
import shutil
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import DialectError
from .ingest import q

KEPT_SECONDS = 24 * 3600
OPERATORS = {"=": "__eq__", "<>": "__ne__", "<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__"}


class Store:
    """A folder of tables. One writer at a time; any number of readers."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.pending: dict | None = None  # the open transaction's snapshot
        self.base = 0
        os.makedirs(f"{path}/log", exist_ok=True)
        if not os.listdir(f"{path}/log"):
            self._publish({"version": 0, "next": 1, "tables": {}, "dropped": {}, "tokens": []})

    # snapshots

    def versions(self) -> list[int]:
        return sorted(int(f[:-5]) for f in os.listdir(f"{self.path}/log") if f.endswith(".json"))

    def snapshot(self, version: int | None = None) -> dict:
        if version is None and self.pending is not None:
            return self.pending
        with open(f"{self.path}/log/{self.versions()[-1] if version is None else version:012d}.json") as f:
            return json.load(f)

    def _publish(self, state: dict) -> None:
        target = f"{self.path}/log/{state['version']:012d}.json"
        part = f"{target}.{uuid.uuid4().hex}.part"
        with open(part, "w") as f:
            json.dump(state, f)
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(part, target)  # fails if another writer has this version
        finally:
            os.remove(part)

    def _commit(self, change) -> int:
        state = copy.deepcopy(self.snapshot())
        state["version"] += 1
        change(state)
        if self.pending is not None:
            self.pending = state
        else:
            self._publish(state)
        return state["version"]

    def begin(self) -> None:
        """Commits until commit() are one snapshot, seen by this store only before."""
        if self.pending is not None:
            raise DialectError("a transaction is open")
        self.pending = self.snapshot()
        self.base = self.pending["version"]

    def commit(self) -> None:
        state, self.pending = self._open(), None
        if self.versions()[-1] != self.base:
            raise DialectError("another writer committed meanwhile")
        if state["version"] != self.base:
            self._publish(state)

    def rollback(self) -> None:
        self._open()
        self.pending = None

    def _open(self) -> dict:
        if self.pending is None:
            raise DialectError("no transaction is open")
        return self.pending

    @staticmethod
    def _table(state: dict, name: str) -> dict:
        if name not in state["tables"]:
            raise DialectError(f"no such table: {name}")
        return state["tables"][name]

    @staticmethod
    def _id(state: dict) -> int:
        state["next"] += 1
        return state["next"] - 1

    # definitions

    def create(self, name: str, schema: T.StructType, if_not_exists: bool = False, **spec) -> None:
        """spec: engine (append or latest), key, version, order_by, partition_by, ttl."""
        engine = spec.setdefault("engine", "append")
        names = schema.names
        if len(set(names)) != len(names):
            raise DialectError("a column is named twice")
        if engine not in ("append", "latest"):
            raise DialectError(f"engine not built: {engine}")
        if engine == "latest" and not spec.get("key"):
            raise DialectError("engine latest needs KEY")
        for c in [*(spec.get("key") or []), *(spec.get("order_by") or []), *([spec["version"]] if spec.get("version") else [])]:
            if c not in names:
                raise DialectError(f"no such column: {c}")

        def change(state):
            if name in state["tables"]:
                if not if_not_exists:
                    raise DialectError(f"table exists: {name}")
                return
            state["tables"][name] = {"id": self._id(state), "fields": [{"id": self._id(state), "name": f.name, "type": f.dataType.jsonValue()} for f in schema], "segments": [], "tombstones": [], "spec": spec}

        self._commit(change)

    def drop(self, name: str, if_exists: bool = False) -> None:
        def change(state):
            if name not in state["tables"] and if_exists:
                return
            state["dropped"][name] = self._table(state, name) | {"dropped_at": time.time()}
            del state["tables"][name]

        self._commit(change)

    def undrop(self, name: str) -> None:
        def change(state):
            if name not in state["dropped"] or time.time() - state["dropped"][name]["dropped_at"] > KEPT_SECONDS:
                raise DialectError(f"nothing to restore: {name}")
            if name in state["tables"]:
                raise DialectError(f"table exists: {name}")
            state["tables"][name] = state["dropped"].pop(name)

        self._commit(change)

    def truncate(self, name: str) -> None:
        self._commit(lambda state: self._table(state, name).update(segments=[], tombstones=[]))

    def revert(self, name: str, version: int) -> None:
        """The table as it was at a version, as a new commit."""
        old = self._table(self.snapshot(version), name)
        self._commit(lambda state: state["tables"].update({name: copy.deepcopy(old)}))

    # columns

    def add_column(self, name: str, column: str, kind: T.DataType) -> None:
        def change(state):
            t = self._table(state, name)
            if any(f["name"] == column for f in t["fields"]):
                raise DialectError(f"column exists: {column}")
            t["fields"].append({"id": self._id(state), "name": column, "type": kind.jsonValue()})

        self._commit(change)

    def _field(self, t: dict, column: str) -> dict:
        for f in t["fields"]:
            if f["name"] == column:
                return f
        raise DialectError(f"no such column: {column}")

    def drop_column(self, name: str, column: str) -> None:
        def change(state):
            t = self._table(state, name)
            f = self._field(t, column)
            if any(p["field"] == f["id"] for x in t["tombstones"] for p in x["where"]):
                raise DialectError(f"a delete names the column: {column}; compact first")
            if column in [*(t["spec"].get("key") or []), *(t["spec"].get("order_by") or []), t["spec"].get("version")]:
                raise DialectError(f"the table's layout names the column: {column}")
            t["fields"].remove(f)

        self._commit(change)

    def rename_column(self, name: str, column: str, to: str) -> None:
        def change(state):
            t = self._table(state, name)
            if any(f["name"] == to for f in t["fields"]):
                raise DialectError(f"column exists: {to}")
            self._field(t, column)["name"] = to
            for k in ("key", "order_by"):
                t["spec"][k] = [to if c == column else c for c in t["spec"].get(k) or []]
            if t["spec"].get("version") == column:
                t["spec"]["version"] = to

        self._commit(change)

    def explain_alter(self, name: str, rewrites: bool) -> dict:
        """What a change touches: only a new order writes segments anew."""
        t = self._table(self.snapshot(), name)
        size = sum(map(self._bytes, t["segments"]))
        return {"segments": len(t["segments"]), "rewrites": len(t["segments"]) if rewrites else 0, "rewrite_bytes": size if rewrites else 0}

    # rows

    def schema(self, name: str, version: int | None = None) -> T.StructType:
        return T.StructType([T.StructField(f["name"], T._parse_datatype_json_string(json.dumps(f["type"]))) for f in self._table(self.snapshot(version), name)["fields"]])

    def insert(self, name: str, df: DataFrame, token: str | None = None) -> int:
        """Appends the columns of the same names; others are null. A token that was committed before changes nothing."""
        state = self.snapshot()
        if token and token in state["tokens"]:
            return 0
        t = self._table(state, name)
        if unknown := [c for c in df.columns if c not in {f["name"] for f in t["fields"]}]:
            raise DialectError(f"no such column: {unknown[0]}")
        rows = df.select(*[(F.col(q(f["name"])) if f["name"] in df.columns else F.lit(None)).cast(T._parse_datatype_json_string(json.dumps(f["type"]))).alias(f"f{f['id']}") for f in t["fields"]])
        if by := t["spec"].get("order_by"):
            rows = rows.sortWithinPartitions(*[f"f{self._field(t, c)['id']}" for c in by])
        path = f"t{t['id']}/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/data/{path}")
        count = self.spark.read.parquet(f"{self.path}/data/{path}").count()

        def change(s):
            self._table(s, name)["segments"].append({"path": path, "rows": count, "seq": s["version"]})
            if token:
                s["tokens"].append(token)

        self._commit(change)
        return count

    def delete(self, name: str, where: list[tuple[str, str, object]] = ()) -> int:
        """Deletes rows for which all (column, operator, value) hold; returns how many. A comparison with null holds for none."""
        t = self._table(self.snapshot(), name)
        named = [
            {"field": self._field(t, c)["id"], "op": op} | ({"value": str(v), "decimal": True} if isinstance(v, decimal.Decimal) else {"value": v})
            for c, op, v in where
        ]
        if any(p["value"] is None for p in named):
            raise DialectError("delete compares with NULL")
        hit = self.read(name, raw=True).filter(self._holds(t, named)).count()
        self._commit(lambda s: self._table(s, name)["tombstones"].append({"seq": s["version"], "where": named}))
        return hit

    @staticmethod
    def _holds(t: dict, where: list[dict]) -> Column:
        """Numbers of the log are text where they are decimals, which JSON would round."""
        out = F.lit(True)
        kinds = {f["id"]: T._parse_datatype_json_string(json.dumps(f["type"])) for f in t["fields"]}
        for p in where:
            kind, value = kinds[p["field"]], F.lit(p["value"])
            if p.get("decimal") and not isinstance(kind, T.DoubleType):
                value = F.lit(decimal.Decimal(p["value"]))
            else:
                value = value.cast(kind)
            out = out & getattr(F.col(f"f{p['field']}"), OPERATORS[p["op"]])(value)
        return F.coalesce(out, F.lit(False))

    def read(self, name: str, version: int | None = None, raw: bool = False) -> DataFrame:
        """The table at a version (the newest): one scan for segments that the same deletes concern. raw: field ids as names,
        and all rows of an engine that has several of a key."""
        t = self._table(self.snapshot(version), name)
        fields = [T.StructField(f"f{f['id']}", T._parse_datatype_json_string(json.dumps(f["type"]))) for f in t["fields"]]
        groups: dict[int, list[dict]] = {}
        for s in t["segments"]:
            groups.setdefault(sum(x["seq"] > s["seq"] for x in t["tombstones"]), []).append(s)
        newest = t["spec"]["engine"] == "latest" and not raw
        out = None
        for n, segments in groups.items():
            part = self.spark.read.schema(T.StructType(fields)).parquet(*[f"{self.path}/data/{s['path']}" for s in segments])
            if newest:  # which commit wrote a row, and where it stands in its file
                commits = F.create_map(*[F.lit(x) for s in segments for x in (s["path"].split("/")[-1], s["seq"])])
                folder = F.regexp_extract("_metadata.file_path", "/([0-9a-f]{32})/[^/]*$", 1)
                part = part.select("*", F.element_at(commits, folder).alias("commit__"), F.col("_metadata.row_index").alias("row__"))
            for x in t["tombstones"][len(t["tombstones"]) - n :]:
                part = part.filter(~self._holds(t, x["where"]))
            out = part if out is None else out.unionByName(part)
        if out is None:
            out = self.spark.createDataFrame([], T.StructType([*fields, *([T.StructField(c, T.LongType()) for c in ("commit__", "row__")] if newest else [])]))
        if raw:
            return out
        if newest:
            from ..operators.relational import latest

            inner = {f["name"]: f"f{f['id']}" for f in t["fields"]}
            version_ = t["spec"].get("version")
            out = latest(out, [inner[c] for c in t["spec"]["key"]], inner[version_] if version_ else None, ["commit__", "row__"])
        return out.select(*[F.col(f"f{f['id']}").alias(f["name"]) for f in t["fields"]])

    # upkeep

    def _bytes(self, segment: dict) -> int:
        return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(f"{self.path}/data/{segment['path']}") for f in fs)

    def compact(self, name: str, least: int = 4, file_bytes: int = 128 << 20) -> bool:
        """Merges runs of `least` or more neighbouring small segments, in files of about `file_bytes`. A run ends at a segment of that
        size and at a delete. Where there are deletes, all rows are written anew instead, without those they concern."""
        t = self._table(self.snapshot(), name)
        sizes = [self._bytes(s) for s in t["segments"]]
        files = lambda n: max(1, -(-n // file_bytes))
        if t["tombstones"] or t["spec"]["engine"] == "latest":
            if len(t["segments"]) < least and not t["tombstones"]:
                return False
            ids = {f["name"]: f"f{f['id']}" for f in t["fields"]}
            rows = self.read(name).withColumnsRenamed(ids) if t["spec"]["engine"] == "latest" else self.read(name, raw=True)
            self.replace(name, rows.repartition(files(sum(sizes))), t)
            return True
        runs: list[list[int]] = [[]]
        for i, n in enumerate(sizes):
            if n >= file_bytes:
                runs.append([])
            else:
                runs[-1].append(i)
        runs = [r for r in runs if len(r) >= max(2, least)]
        for r in runs:
            self._merge(name, t, [t["segments"][i] for i in r], files(sum(sizes[i] for i in r)))
            t = self._table(self.snapshot(), name)
        return bool(runs)

    def _merge(self, name: str, read: dict, segments: list[dict], files: int) -> None:
        """Puts one segment in place of neighbouring ones."""
        schema = T.StructType([T.StructField(f"f{f['id']}", T._parse_datatype_json_string(json.dumps(f["type"]))) for f in read["fields"]])
        rows = self.spark.read.schema(schema).parquet(*[f"{self.path}/data/{s['path']}" for s in segments]).repartition(files)
        if by := read["spec"].get("order_by"):
            rows = rows.sortWithinPartitions(*[f"f{self._field(read, c)['id']}" for c in by])
        path = f"t{read['id']}/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/data/{path}")
        one = {"path": path, "rows": sum(s["rows"] for s in segments), "seq": segments[-1]["seq"]}
        gone = [s["path"] for s in segments]

        def change(s):
            now = self._table(s, name)
            if now["id"] != read["id"] or now["fields"] != read["fields"] or [x["path"] for x in now["segments"] if x["path"] in gone] != gone or now["tombstones"] != read["tombstones"]:
                raise DialectError("the table changed while it was written anew")
            at = [x["path"] for x in now["segments"]].index(gone[0])
            now["segments"][at : at + len(gone)] = [one]

        self._commit(change)

    def table(self, name: str) -> dict:
        """The table's record in the newest snapshot."""
        return self._table(self.snapshot(), name)

    def replace(self, name: str, rows: DataFrame, read: dict, **spec) -> None:
        """Puts `rows` (field ids as names) in place of what the record `read` holds; spec: options that change with it."""
        path = f"t{read['id']}/{uuid.uuid4().hex}"
        if by := (read["spec"] | spec).get("order_by"):
            rows = rows.sortWithinPartitions(*[f"f{self._field(read, c)['id']}" for c in by])
        rows.write.parquet(f"{self.path}/data/{path}")
        count = self.spark.read.parquet(f"{self.path}/data/{path}").count()

        def change(s):
            now = self._table(s, name)
            if any(now[k] != read[k] for k in ("id", "fields", "segments", "tombstones")):
                raise DialectError("the table changed while it was written anew")
            now.update(segments=[{"path": path, "rows": count, "seq": s["version"]}], tombstones=[])
            now["spec"].update(spec)

        self._commit(change)

    def order_by(self, name: str, columns: list[str]) -> None:
        """Another order within the table's files; all its segments are written anew."""
        t = self.table(name)
        for c in columns:
            self._field(t, c)
        self.replace(name, self.read(name, raw=True), t, order_by=columns)

    def expire(self, keep: int = 10, grace_seconds: float = 3600) -> list[str]:
        """Forgets all but the newest snapshots and removes segments that none names and that are older than the grace."""
        versions = self.versions()
        for v in versions[:-keep]:
            os.remove(f"{self.path}/log/{v:012d}.json")
        used = {s["path"] for v in versions[-keep:] for t in [self.snapshot(v)] for part in ("tables", "dropped") for x in t[part].values() for s in x["segments"]}
        gone = []
        for table in os.listdir(f"{self.path}/data") if os.path.isdir(f"{self.path}/data") else []:
            for seg in os.listdir(f"{self.path}/data/{table}"):
                full = f"{self.path}/data/{table}/{seg}"
                if f"{table}/{seg}" not in used and time.time() - os.path.getmtime(full) >= grace_seconds:
                    shutil.rmtree(full)
                    gone.append(f"{table}/{seg}")
        return gone

    def backup(self, to: str) -> None:
        """The newest snapshot and its segments, as hard links."""
        state = self.snapshot()
        for part in ("tables", "dropped"):
            for t in state[part].values():
                for s in t["segments"]:
                    shutil.copytree(f"{self.path}/data/{s['path']}", f"{to}/data/{s['path']}", copy_function=os.link, dirs_exist_ok=True)
        os.makedirs(f"{to}/log", exist_ok=True)
        with open(f"{to}/log/{state['version']:012d}.json", "w") as f:
            json.dump(state, f)

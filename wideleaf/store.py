"""A store of wide tables: a catalogue in one JSON file, cells as Parquet in key order, writes as deltas.

A table is a base (cells sorted by key, so that ranges of keys prune files) and deltas (mutations, one folder for each batch of writes).
Reading folds only the rows that a delta touches; all others come from the base as they are.  Compaction folds everything,
collects garbage and writes a new base.  The catalogue names what is current, and is replaced in one piece, so a reader or a
restarted writer never sees half a write.  One writer at a time.
"""

from __future__ import annotations

import json
from dataclasses import asdict
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wideleaf.dialect import Catalog, Table, run
from wideleaf.errors import AlreadyExists, FailedPrecondition, InvalidArgument, NotFound
from wideleaf.functions import folders
from wideleaf.operators import collect, requests, rows, writes
from wideleaf.plans import views
from wideleaf.sources import cells as C
from wideleaf.streaming import changes

CELLS = "row_key binary, family string, fam_order int, qualifier binary, ts long, value binary, seq long"
#: How long a dropped table can be brought back, and how many materialised views there may be, in all and of a table.
UNDELETE, VIEWS, VIEWS_OF_TABLE = 7 * 86_400_000_000, 50, 5
_TOKENS = "row_key binary, token binary, expire_us long"
#: Up to as many touched rows are told by a broadcast.
TOUCHED = 1_000_000


def _rule(rule: collect.Rule | None) -> dict | None:
    if rule is None:
        return None
    if isinstance(rule, collect.Union | collect.Intersection):
        return {type(rule).__name__: [_rule(r) for r in rule.rules]}
    return {type(rule).__name__: asdict(rule)}


def _as_rule(stored: dict | None) -> collect.Rule | None:
    if stored is None:
        return None
    ((name, x),) = stored.items()
    kind = getattr(collect, name)
    return kind(tuple(map(_as_rule, x))) if isinstance(x, list) else kind(**x)


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._file = f"{self.path}/catalogue.json"
        empty = {"tables": {}, "views": {}, "materialised": {}, "authorised": {}, "backups": {}, "next": 1}
        self.state: dict = json.loads(folders.read_text(spark, self._file)) if folders.exists(spark, self._file) else empty

    def _save(self) -> None:
        folders.write_text(self.spark, self._file, json.dumps(self.state))

    def _number(self) -> int:
        self.state["next"] += 1
        return self.state["next"] - 1

    # tables --------------------------------------------------------------------------------------------------------------------

    def table(self, name: str) -> dict:
        found = self.state["tables"].get(name)
        if found is None or found["dropped"] is not None:
            raise NotFound(f"no table {name}")
        return found

    def tables(self) -> list[str]:
        return sorted(n for n, t in self.state["tables"].items() if t["dropped"] is None)

    def create_table(self, name: str, families: dict[str, str], *, gc: dict[str, collect.Rule] | None = None, key_fields: tuple = (), delimiter: bytes = b"#", micros: bool = False, keeps_changes: bool = True) -> None:
        """A table with families (name to kind: ``bytes``, ``int64`` or ``hll``) in this order."""
        if name in self.state["tables"]:
            raise AlreadyExists(f"there is a table {name}")
        for rule in (gc or {}).values():
            collect.check(rule)
        order = {f: {"kind": kind, "order": k, "gc": _rule((gc or {}).get(f))} for k, (f, kind) in enumerate(families.items())}
        number = self._number()
        self.state["tables"][name] = {"id": number, "families": order, "key_fields": [list(x) for x in key_fields], "delimiter": delimiter.decode("latin-1"), "micros": micros, "changes": keeps_changes, "base": None, "deltas": [], "version": 0, "seq": 1, "dropped": None, "protected": False}
        self._save()

    def alter_families(self, name: str, *, create: dict[str, str] | None = None, drop: list[str] = (), gc: dict[str, collect.Rule | None] | None = None) -> None:
        """All of it or nothing: new families, families that go with their data, and new rules."""
        t = self.table(name)
        families = json.loads(json.dumps(t["families"]))
        for f, kind in (create or {}).items():
            if f in families:
                raise AlreadyExists(f"there is a family {f}")
            families[f] = {"kind": kind, "order": 1 + max((x["order"] for x in families.values()), default=-1), "gc": None}
        for f in [*drop, *(gc or {})]:
            if f not in families:
                raise NotFound(f"no family {f}")
        for f, rule in (gc or {}).items():
            if rule is not None:
                collect.check(rule)
            families[f]["gc"] = _rule(rule)
        for f in drop:
            del families[f]
        t["families"] = families
        t["version"] += 1
        self._save()
        if drop:  # a family of the same name, made later, must not find the old cells
            self.compact(name)

    def drop_table(self, name: str, now: int) -> None:
        t = self.table(name)
        if t["protected"]:
            raise FailedPrecondition(f"{name} is protected from deletion")
        if any(m["table"] == name for m in self.state["materialised"].values()):
            raise FailedPrecondition(f"{name} has materialised views")
        t["dropped"] = now
        self._save()

    def undelete_table(self, name: str, now: int) -> None:
        t = self.state["tables"].get(name)
        if t is None or t["dropped"] is None or now - t["dropped"] > UNDELETE:
            raise NotFound(f"no dropped table {name}")
        t["dropped"] = None
        self._save()

    def purge_tables(self, now: int) -> list[str]:
        """Delete the data of tables that can't be brought back any more."""
        gone = [n for n, t in self.state["tables"].items() if t["dropped"] is not None and now - t["dropped"] > UNDELETE]
        old = [self.state["tables"].pop(n)["id"] for n in gone]
        self._save()
        for number in old:
            folders.delete(self.spark, f"{self.path}/tables/{number}")
        return gone

    def token(self, name: str) -> str:
        """What ``is_consistent`` takes: the writes so far."""
        return f"{name}@{self.table(name)['version']}"

    def is_consistent(self, token: str) -> bool:
        name, _, version = token.rpartition("@")
        if not version.isdigit() or self.table(name)["version"] < int(version):
            raise InvalidArgument("not a token of this table")
        return True

    # cells ---------------------------------------------------------------------------------------------------------------------

    def _folder(self, t: dict, name: str) -> str:
        return f"{self.path}/tables/{t['id']}/{name}"

    def _families(self, t: dict) -> requests.Families:
        order = sorted(t["families"], key=lambda f: (t["families"][f]["order"], f))
        return requests.Families(tuple(order), tuple(f for f in order if t["families"][f]["kind"] != "bytes"), t["micros"])

    def _rules(self, t: dict) -> dict[str, collect.Rule]:
        return {f: _as_rule(x["gc"]) for f, x in t["families"].items() if x["gc"] is not None}

    def stored(self, name: str) -> DataFrame:
        """The cells of a table, before garbage collection."""
        t = self.table(name)
        base = self.spark.read.schema(CELLS).parquet(self._folder(t, t["base"])) if t["base"] else self.spark.createDataFrame([], CELLS)
        known = F.col("family").isin(*t["families"]) if t["families"] else F.lit(False)
        base = base.where(known)
        if not t["deltas"]:
            return base
        deltas = reduce(DataFrame.unionByName, [self.spark.read.schema(writes.MUTATIONS).parquet(self._folder(t, d)) for d in t["deltas"]])
        keys = deltas.select("row_key").distinct()
        few = sum(t["sizes"].get(d, TOUCHED) for d in t["deltas"]) <= TOUCHED if "sizes" in t else False
        keys = F.broadcast(keys) if few else keys
        order = {f: x["order"] for f, x in t["families"].items()}
        touched = writes.fold(base.join(keys, "row_key", "left_semi"), deltas.where((F.col("op") == "del_row") | known), order)
        return base.join(keys, "row_key", "left_anti").unionByName(touched)

    def cells(self, name: str, now: int | None = None) -> DataFrame:
        """The cells that can be seen at ``now``: without what the families' rules take."""
        rules = self._rules(self.table(name))
        found = self.stored(name)
        return collect.survivors(found, rules, now) if rules and now is not None else found

    def load(self, name: str, cells: DataFrame) -> None:
        """Put cells into an empty table."""
        t = self.table(name)
        if t["base"] or t["deltas"]:
            raise FailedPrecondition(f"{name} isn't empty")
        self._rebase(t, C.settle(cells))

    def _rebase(self, t: dict, cells: DataFrame) -> None:
        made = f"base-{self._number()}"
        columns = ["row_key", "family", "qualifier"]
        cells.select(*C.COLUMNS).repartitionByRange("row_key").sortWithinPartitions(*columns, F.desc("ts")).write.parquet(self._folder(t, made))
        old = [t["base"], *t["deltas"]]
        t.update(base=made, deltas=[], sizes={})
        t["version"] += 1
        self._save()
        for x in filter(None, old):
            folders.delete(self.spark, self._folder(t, x))

    def compact(self, name: str, now: int | None = None) -> None:
        """Fold all deltas into a new base; at ``now`` garbage goes too, and is told to the change log."""
        t = self.table(name)
        rules = self._rules(t)
        if now is not None and rules and t["changes"]:
            changes.append(changes.of_collected(self.stored(name), rules, now), self._folder(t, "changes"))
        self._rebase(t, self.cells(name, now))

    def changes_path(self, name: str) -> str:
        return self._folder(self.table(name), "changes")

    # writes --------------------------------------------------------------------------------------------------------------------

    def _write(self, name: str, mutations: DataFrame, now: int) -> None:
        """``mutations`` as a delta, and their records."""
        t = self.table(name)
        delta = f"delta-{self._number()}"
        mutations.write.parquet(self._folder(t, delta))
        written = self.spark.read.schema(writes.MUTATIONS).parquet(self._folder(t, delta))
        size, last = written.agg(F.count("*"), F.max("seq")).first()
        if not size:
            return
        if t["changes"]:
            before = self.stored(name).join(written.select("row_key").distinct(), "row_key", "left_semi")
            changes.append(changes.of_mutations(written, before, now), self._folder(t, "changes"))
        t["deltas"].append(delta)
        t.setdefault("sizes", {})[delta] = size
        t["seq"] = last + 1
        t["version"] += 1
        self._save()

    def mutate(self, name: str, entries: DataFrame, now: int, *, view: str | None = None, tokens: DataFrame | None = None) -> DataFrame:
        """Apply the entries that are in order; entry_no, row_key and status of each.

        An entry with a token (``tokens``: entry_no, token) that its row has seen in the last fifteen minutes was applied then; it is
        in order and changes nothing."""
        t = self.table(name)
        if view is not None:
            self._check_view(name, view, entries)
        statuses = requests.validate(entries, self._families(t)).withColumn("apply", F.lit(True))
        kept, judged = self._folder(t, "tokens"), self._folder(t, f"judged-{self._number()}")
        if tokens is not None:
            seen = self.spark.read.schema(_TOKENS).parquet(kept) if folders.exists(self.spark, kept) else self.spark.createDataFrame([], _TOKENS)
            asked = statuses.select("entry_no", "row_key").join(tokens.select("entry_no", "token"), "entry_no", "left")
            told = requests.fresh(asked, seen, now).select("entry_no", "token", F.col("status").alias("of_token"))
            bad = F.col("of_token").startswith("INVALID")
            statuses = statuses.join(told, "entry_no").select("entry_no", "row_key", "token", F.when(bad, F.col("of_token")).otherwise(F.col("status")).alias("status"), (F.col("of_token") == "OK").alias("apply"))
        # Written down first: what the tokens say must not be asked again once they are kept.
        statuses.write.parquet(judged)
        statuses = self.spark.read.schema(statuses.schema).parquet(judged)
        good = entries.join(statuses.where("status = 'OK' and apply").select("entry_no"), "entry_no", "left_semi")
        self._write(name, requests.resolved(good, now, t["seq"]).select(*writes.MUTATIONS_COLUMNS), now)
        if tokens is not None:
            requests.remembered(statuses.where("apply"), now).write.mode("append").parquet(kept)
        return statuses.select("entry_no", "row_key", "status")

    def check_and_mutate(self, name: str, keys: DataFrame, predicate, on_true: DataFrame, on_false: DataFrame, now: int, *, view: str | None = None) -> DataFrame:
        """row_key, matched and status for each of ``keys``; see ``requests.check_and_mutate``."""
        t = self.table(name)
        seen = self.cells(name, now)
        if view is not None:
            for x in (on_true, on_false):
                self._check_view(name, view, x)
            seen = self.authorised(view, now)
        _, matched = requests.check_and_mutate(self.stored(name), keys, predicate, on_true, on_false, self._families(t), now, visible=seen)
        path = self._folder(t, f"matched-{self._number()}")
        matched.write.parquet(path)
        matched = self.spark.read.schema(matched.schema).parquet(path)
        chosen = on_true.join(matched.where("matched"), "row_key", "left_semi").unionByName(on_false.join(matched.where("not matched"), "row_key", "left_semi"))
        good = chosen.join(requests.validate(chosen, self._families(t)).where("status = 'OK'").select("entry_no"), "entry_no", "left_semi")
        self._write(name, requests.resolved(good, now, t["seq"]).select(*writes.MUTATIONS_COLUMNS), now)
        return matched

    def read_modify_write(self, name: str, rules: DataFrame, now: int) -> DataFrame:
        """The cells that rules write; see ``writes.read_modify_write``.  A row with an error is left as it was."""
        t = self.table(name)
        bad = rules.where(~F.col("family").isin(*[f for f in self._families(t).order if f not in self._families(t).aggregates])).limit(1).collect()
        if bad:
            raise InvalidArgument(f"no rules for the family {bad[0].family}")
        path = self._folder(t, f"ruled-{self._number()}")
        writes.read_modify_write(self.cells(name, now), rules, now).write.parquet(path)
        made = self.spark.read.parquet(path)
        failed = made.where("error is not null").select("row_key").distinct()
        good = made.join(failed, "row_key", "left_anti")
        seq = F.monotonically_increasing_id() + t["seq"]
        self._write(name, good.select("row_key", F.lit("set").alias("op"), "family", "qualifier", F.col("ts").alias("start_ts"), F.lit(None).cast("long").alias("end_ts"), "value", seq.alias("seq")).select(*writes.MUTATIONS_COLUMNS), now)
        return made

    def drop_row_range(self, name: str, prefix: bytes | None, now: int) -> None:
        t = self.table(name)
        kept, dropped = requests.drop_row_range(self.stored(name), prefix)
        if t["changes"]:
            changes.append(changes.of_dropped(dropped, now), self._folder(t, "changes"))
        self._rebase(t, kept)

    # views ---------------------------------------------------------------------------------------------------------------------

    def create_view(self, name: str, sql: str, *, replace: bool = False) -> None:
        """A logical view; its query must be one that can be prepared."""
        if not replace and self._taken(name):
            raise AlreadyExists(f"{name} is taken")
        catalog = self.catalog()
        catalog.views.pop(name, None)
        run(self.spark, catalog, sql, ordered=False)
        self.state["views"][name] = sql
        self._save()

    def drop_view(self, name: str) -> None:
        for kind in ("views", "materialised", "authorised"):
            if name in self.state[kind]:
                gone = self.state[kind].pop(name)
                self._save()
                if kind == "materialised" and gone["folder"]:
                    folders.delete(self.spark, f"{self.path}/{gone['folder']}")
                return
        raise NotFound(f"no view {name}")

    def _taken(self, name: str) -> bool:
        return any(name in self.state[k] for k in ("tables", "views", "materialised", "authorised"))

    def create_materialised(self, name: str, table: str, sql: str) -> None:
        """A view that is kept; it is computed when it is read and its table has changed since."""
        self.table(table)
        if self._taken(name):
            raise AlreadyExists(f"{name} is taken")
        kept = self.state["materialised"]
        if len(kept) >= VIEWS or sum(m["table"] == table for m in kept.values()) >= VIEWS_OF_TABLE:
            raise FailedPrecondition(f"there are {VIEWS} materialised views, or {VIEWS_OF_TABLE} of this table")
        views.plan(self.spark, self._tables(), sql)
        kept[name] = {"table": table, "sql": sql, "built": None, "folder": None, "keyed": False}
        self._save()

    def is_stale(self, name: str) -> bool:
        m = self.state["materialised"][name]
        return m["built"] != self.table(m["table"])["version"]

    def refresh(self, name: str) -> None:
        """Compute a materialised view again if its table has changed; what is stored is replaced as a whole."""
        m = self.state["materialised"][name]
        if not self.is_stale(name):
            return
        version, folder, old = self.table(m["table"])["version"], f"views/{name}-{self._number()}", m["folder"]
        definition = views.create(self.spark, self._tables(), name, m["sql"], f"{self.path}/{folder}")
        m.update(built=version, folder=folder, keyed="_key" in definition.columns, keys=list(definition.keys), values=list(definition.values))
        self._save()
        if old:
            folders.delete(self.spark, f"{self.path}/{old}")

    def view_cells(self, name: str) -> DataFrame:
        """A materialised view as cells, so that filters run on it."""
        self.refresh(name)
        m = self.state["materialised"][name]
        return views.as_cells(self.spark.read.parquet(f"{self.path}/{m['folder']}"), m["values"])

    def create_authorised(self, name: str, table: str, prefixes: list[bytes], subsets: dict[str, tuple[list[bytes], list[bytes]]]) -> None:
        """A part of a table: rows with one of the prefixes, and of its families the given qualifiers and prefixes of such."""
        t = self.table(table)
        if self._taken(name):
            raise AlreadyExists(f"{name} is taken")
        for f in subsets:
            if f not in t["families"]:
                raise NotFound(f"no family {f}")
        plain = lambda xs: [x.decode("latin-1") for x in xs]
        self.state["authorised"][name] = {"table": table, "prefixes": plain(prefixes), "subsets": {f: [plain(a), plain(b)] for f, (a, b) in subsets.items()}}
        self._save()

    def _part(self, view: str) -> tuple[str, list[bytes], dict]:
        if view not in self.state["authorised"]:
            raise NotFound(f"no view {view}")
        v = self.state["authorised"][view]
        raw = lambda xs: [x.encode("latin-1") for x in xs]
        return v["table"], raw(v["prefixes"]), {f: (raw(a), raw(b)) for f, (a, b) in v["subsets"].items()}

    def authorised(self, view: str, now: int | None = None) -> DataFrame:
        """The cells of an authorised part."""
        table, prefixes, subsets = self._part(view)
        return rows.restrict(self.cells(table, now), prefixes, subsets)

    def _check_view(self, name: str, view: str, entries: DataFrame) -> None:
        table, prefixes, subsets = self._part(view)
        if table != name:
            raise InvalidArgument(f"{view} is a part of {table}")
        requests.check_view(entries, prefixes, subsets)

    # queries -------------------------------------------------------------------------------------------------------------------

    def _tables(self, now: int | None = None) -> Catalog:
        made = {}
        for name in self.tables():
            t = self.table(name)
            order = sorted(t["families"], key=lambda f: (t["families"][f]["order"], f))
            made[name] = Table(self.cells(name, now), {f: t["families"][f]["kind"] for f in order}, tuple(map(tuple, t["key_fields"])), t["delimiter"].encode("latin-1"))
        return Catalog(made)

    def catalog(self, now: int | None = None) -> Catalog:
        """For queries: tables as seen at ``now``, logical views, and materialised views, which are computed again if need be."""
        made = self._tables(now)
        made.views.update(self.state["views"])
        for name, m in self.state["materialised"].items():
            self.refresh(name)
            made.relations[name] = self.spark.read.parquet(f"{self.path}/{m['folder']}")
            if m["keyed"]:
                made.keyed.add(name)
        return made

    def sql(self, query: str, params: dict | None = None, *, now: int | None = None, ordered: bool = True) -> DataFrame:
        return run(self.spark, self.catalog(now), query, params, ordered=ordered)

    # backups -------------------------------------------------------------------------------------------------------------------

    def backup(self, name: str, table: str, expires: int, now: int) -> None:
        """A copy of a table's cells and schema as they are now."""
        t = self.table(table)
        if name in self.state["backups"]:
            raise AlreadyExists(f"there is a backup {name}")
        if expires <= now:
            raise InvalidArgument("a backup must expire later than now")
        folder = f"backups/{name}-{self._number()}"
        self.stored(table).repartitionByRange("row_key").sortWithinPartitions("row_key").write.parquet(f"{self.path}/{folder}")
        schema = {k: t[k] for k in ("families", "key_fields", "delimiter", "micros", "changes")}
        self.state["backups"][name] = {"table": table, "folder": folder, "schema": json.loads(json.dumps(schema)), "made": now, "expires": expires}
        self._save()

    def copy_backup(self, name: str, to: str, expires: int, now: int) -> None:
        """Another copy of a backup, which outlives the first."""
        b = self._backup(name, now)
        if to in self.state["backups"]:
            raise AlreadyExists(f"there is a backup {to}")
        folder = f"backups/{to}-{self._number()}"
        self.spark.read.schema(CELLS).parquet(f"{self.path}/{b['folder']}").write.parquet(f"{self.path}/{folder}")
        self.state["backups"][to] = b | {"folder": folder, "made": now, "expires": expires}
        self._save()

    def _backup(self, name: str, now: int) -> dict:
        b = self.state["backups"].get(name)
        if b is None or b["expires"] <= now:
            raise NotFound(f"no backup {name}")
        return b

    def backups(self, now: int, table: str | None = None) -> list[str]:
        return sorted(n for n, b in self.state["backups"].items() if b["expires"] > now and table in (None, b["table"]))

    def restore(self, name: str, table: str, now: int) -> None:
        """A new table with the cells and the schema of a backup."""
        b = self._backup(name, now)
        if table in self.state["tables"]:
            raise AlreadyExists(f"there is a table {table}")
        self.create_table(table, {})
        self.state["tables"][table].update(json.loads(json.dumps(b["schema"])))
        self._rebase(self.state["tables"][table], self.spark.read.schema(CELLS).parquet(f"{self.path}/{b['folder']}"))

    def delete_backup(self, name: str) -> None:
        if name not in self.state["backups"]:
            raise NotFound(f"no backup {name}")
        folder = self.state["backups"].pop(name)["folder"]
        self._save()
        folders.delete(self.spark, f"{self.path}/{folder}")

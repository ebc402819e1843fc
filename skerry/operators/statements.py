"""Statements that change tables or the catalogue: DML with RETURNING, DDL, constraints, transactions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.plans import dialect
from skerry.plans.dialect import Token, closing, find_top, split_top, spark_type, text_of, tokens, unquoted
from skerry.sources.tables import ROW_ID, Catalog, Fields


class ConstraintError(ValueError):
    """A row breaks a constraint; the statement has changed nothing."""


def run(engine, text: str, params=None) -> DataFrame:
    return _Statement(engine, tokens(text), params).run()


class _Statement:
    def __init__(self, engine, parts: list[Token], params):
        self.engine, self.spark, self.catalog, self.parts, self.params, self.i = engine, engine.spark, engine.catalog, parts, params, 0

    # reading tokens
    def peek(self, *words: str) -> bool:
        return [t.low for t in self.parts[self.i : self.i + len(words)]] == list(words)

    def take(self, *words: str) -> bool:
        if self.peek(*words):
            self.i += len(words)
            return True
        return False

    def name(self) -> str:
        self.i += 1
        out = unquoted(self.parts[self.i - 1].text).lower()
        while self.i < len(self.parts) and self.parts[self.i].text in (".", "/"):
            out = (out if self.parts[self.i].text == "/" else "") + ("/" if self.parts[self.i].text == "/" else "") + unquoted(self.parts[self.i + 1].text).lower()
            self.i += 2
        return out

    def bracket(self) -> list[Token]:
        end = closing(self.parts, self.i)
        inner, self.i = self.parts[self.i + 1 : end], end + 1
        return inner

    def rest(self) -> list[Token]:
        return self.parts[self.i :]

    def done(self, n: int | None = None) -> DataFrame:
        return self.spark.createDataFrame([(n,)], "affected long") if n is not None else self.spark.createDataFrame([], "affected long")

    def sql(self, text: str) -> DataFrame:
        return self.engine.select(text, self.params)

    def run(self) -> DataFrame:
        verb = self.parts[0].low
        self.i = 1
        return getattr(self, f"_{verb}", self._other)()

    def _other(self) -> DataFrame:
        return self.sql(text_of(self.parts))

    # transactions and administration
    def _begin(self) -> DataFrame:
        self.catalog.begin()
        return self.done()

    _start = _begin

    def _commit(self) -> DataFrame:
        self.catalog.commit()
        return self.done()

    _end = _commit

    def _rollback(self) -> DataFrame:
        self.catalog.rollback()
        return self.done()

    def _checkpoint(self) -> DataFrame:
        return self.done()  # every commit is durable

    def _vacuum(self) -> DataFrame:
        return self.done(self.catalog.vacuum())

    def _set(self) -> DataFrame:
        if self.take("timezone") or self.take("time", "zone"):
            self.take("to") or self.take("=")
            self.engine.set_timezone(self.parts[self.i].text.strip("'"))
            return self.done()
        return self._other()

    # DDL
    def _create(self) -> DataFrame:
        self.take("or", "replace")
        if self.take("database"):
            missing_only = self.take("if", "not", "exists")
            name = self.name()
            if name in self.catalog.now["databases"]:
                if missing_only:
                    return self.done()
                raise ValueError(f"database {name} exists")
            self.catalog.change(lambda s: s["databases"].append(name))
        elif self.take("table"):
            return self._create_table()
        elif self.take("type"):
            return self._create_type()
        elif self.take("materialized", "view"):
            name = self.name()
            self.take("as")
            text = text_of(self.rest())
            self._materialise(name, text)
        elif self.take("view"):
            name = self.name()
            self.take("as")
            text, used = text_of(self.rest()), self._used(self.rest())
            self.catalog.change(lambda s: s["views"].__setitem__(name, {"sql": text, "uses": used}))
        elif self.take("sequence"):
            name = self.name()
            given = {"start": 1, "increment": 1, "minvalue": 1, "maxvalue": 2**63 - 1}
            while self.i < len(self.parts):
                word = self.parts[self.i].low
                self.i += 1
                self.take("with") or self.take("by")
                if word in given:
                    negative = self.take("-")
                    given[word] = int(self.parts[self.i].text) * (-1 if negative else 1)
                    self.i += 1
            self.catalog.change(lambda s: s["sequences"].__setitem__(name, given | {"next": given["start"]}))
        elif self.take("unique", "index") or self.take("index"):
            self.take("if", "not", "exists")
            name = self.name()
            self.take("on")
            table = self.name()
            kind = self.name() if self.take("using") else "btree"
            columns = [unquoted(c[0].text).lower() for c in split_top(self.bracket())]
            # Parquet statistics do the pruning; the index is recorded so that it can be listed and dropped.
            self.catalog.change(lambda s: s["indexes"].__setitem__(name, {"table": table, "columns": columns, "kind": kind}))
        elif self.take("function"):
            name = self.name()
            args = [text_of(a) if len(a) > 1 else f"{a[0].text} string" for a in split_top(self.bracket())]
            where = find_top(self.parts, "as", "return", start=self.i)
            body = self.parts[where + 1 :]
            text = body[0].text[1:-1].replace("''", "'") if body[0].kind == "str" else text_of(body)
            self.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({', '.join(args)}) RETURN {text}")
            self.catalog.change(lambda s: s["functions"].__setitem__(name, {"args": args, "sql": text}))
        return self.done()

    def _used(self, parts: list[Token]) -> list[str]:
        known = {*self.catalog.now["tables"], *self.catalog.now["views"], *self.catalog.now["matviews"]}
        return sorted({unquoted(t.text).lower() for t in parts if t.kind == "name"} & known)

    def _materialise(self, name: str, text: str) -> None:
        df = self.sql(text)
        path = self.catalog.write(df)
        columns = [{"name": n, "type": t} for n, t in df.dtypes]
        self.catalog.change(lambda s: s["matviews"].__setitem__(name, {"kind": "fixed", "sql": text, "columns": columns, "parts": [path], "uses": self._used(tokens(text))}))

    def _refresh(self) -> DataFrame:
        self.take("materialized", "view")
        name = self.name()
        self._materialise(name, self.catalog.table(name)["sql"])
        return self.done()

    def _create_type(self) -> DataFrame:
        name = self.name()
        self.take("as")
        if self.take("enum"):
            labels = [t.text[1:-1].replace("''", "'") for t in self.bracket() if t.kind == "str"]
            made = {"enum": labels}
        else:
            fields = [(unquoted(c[0].text).lower(), self._type(c[1:])[0]) for c in split_top(self.bracket())]
            made = {"struct": fields}
        self.catalog.change(lambda s: s["types"].__setitem__(name, made))
        return self.done()

    def _type(self, parts: list[Token]) -> tuple[str, dict]:
        """Spark type and what else holds for a column of it."""
        known = self.catalog.now["types"].get(parts[0].low)
        if known:
            if "enum" in known:
                return "string", {"enum": known["enum"]}
            return "struct<" + ",".join(f"{n}:{t}" for n, t in known["struct"]) + ">", {}
        kind, length = spark_type(parts)
        return kind, {"length": length} if length else {}

    def _create_table(self) -> DataFrame:
        missing_only = self.take("if", "not", "exists")
        name = self.name()
        if name in self.catalog.now["tables"]:
            if missing_only:
                return self.done()
            raise ValueError(f"table {name} exists")
        if self.take("as"):
            df = self.sql(text_of(self.rest()))
            meta = {"kind": "fixed", "columns": [{"name": n, "type": t} for n, t in df.dtypes], "checks": [], "keys": [], "fks": [], "parts": [self.catalog.write_rows(df)]}
        else:
            inner = self.bracket()
            meta = {"kind": "fixed" if inner else "dynamic", "columns": [], "fields": [], "checks": [], "keys": [], "fks": [], "parts": []}
            for item in split_top(inner):
                self._column_or_constraint(meta, item)
        self.catalog.change(lambda s: s["tables"].__setitem__(name, meta))
        return self.done()

    def _column_or_constraint(self, meta: dict, item: list[Token]) -> None:
        if item[0].low in ("constraint", "check", "primary", "unique", "foreign"):
            self._constraint(meta, item)
            return
        stop = find_top(item, "not", "null", "default", "check", "primary", "unique", "references", start=1)
        kind, other = self._type(item[1:stop])
        column = {"name": unquoted(item[0].text).lower(), "type": kind} | other
        meta["columns"].append(column)
        i = stop
        while i < len(item):
            word = item[i].low
            if word == "not":
                column["not_null"], i = True, i + 2
            elif word == "null":
                i += 1
            elif word == "default":
                end = find_top(item, "not", "null", "check", "primary", "unique", "references", start=i + 2)
                column["default"], i = text_of(item[i + 1 : end]), end
            elif word == "check":
                end = closing(item, i + 1)
                meta["checks"].append(text_of(item[i + 2 : end]))
                i = end + 1
            elif word == "primary":
                meta["keys"].append([column["name"]])
                column["not_null"], i = True, i + 2
            elif word == "unique":
                meta["keys"].append([column["name"]])
                i += 1
            else:
                self._constraint(meta, [Token("name", "foreign"), Token("name", "key"), Token("op", "("), item[0], Token("op", ")"), *item[i:]])
                break

    def _constraint(self, meta: dict, item: list[Token]) -> None:
        if item[0].low == "constraint":
            item = item[2:]
        word = item[0].low
        listed = lambda i: [unquoted(t.text).lower() for t in item[i + 1 : closing(item, i)] if t.kind == "name"]
        if word == "check":
            meta["checks"].append(text_of(item[2 : closing(item, 1)]))
        elif word in ("primary", "unique"):
            columns = listed(2 if word == "primary" else 1)
            meta["keys"].append(columns)
            for c in meta["columns"]:
                if word == "primary" and c["name"] in columns:
                    c["not_null"] = True
        else:
            at = find_top(item, "references")
            fk = {"columns": listed(2), "table": unquoted(item[at + 1].text).lower(), "full": False, "on_delete": "restrict"}
            has = at + 2 < len(item) and item[at + 2].text == "("
            fk["to"] = listed(at + 2) if has else fk["columns"]
            tail = [t.low for t in item[at:]]
            fk["full"] = "match" in tail and tail[tail.index("match") + 1] == "full"
            if "delete" in tail:
                action = tail[tail.index("delete") + 1 :]
                fk["on_delete"] = {"cascade": "cascade", "set": "set " + (action[1] if len(action) > 1 else "")}.get(action[0], "restrict")
            meta["fks"].append(fk)

    def _alter(self) -> DataFrame:
        self.take("table")
        name = self.name()
        meta = dict(self.catalog.table(name))
        if self.take("add", "constraint") or self.take("add", "check") or self.take("add", "foreign"):
            at = next(i for i in range(len(self.parts)) if self.parts[i].low == "add")
            new = {k: list(meta[k]) for k in ("checks", "keys", "fks")} | {"columns": [dict(c) for c in meta["columns"]]}
            self._constraint(new, self.parts[at + 1 :])
            _check(self, name, meta | new, self.catalog.read(meta))
            self.catalog.store(name, meta["parts"], **new)
        elif self.take("add", "column") or self.take("add"):
            self.take("if", "not", "exists")
            new = {k: list(meta[k]) for k in ("checks", "keys", "fks")} | {"columns": [dict(c) for c in meta["columns"]]}
            if meta["kind"] == "dynamic":
                return self.done()  # columns come with the rows
            self._column_or_constraint(new, self.rest())
            new["columns"][-1]["added_default"] = new["columns"][-1].get("default")
            new["columns"][-1]["stored"] = f"{new['columns'][-1]['name']}@{self.catalog.number + 1}"
            self.catalog.store(name, meta["parts"], **new)
        elif self.take("drop", "column") or self.take("drop"):
            self.take("if", "exists")
            column = self.name()
            if meta["kind"] == "dynamic":
                fields = [f | {"dropped": True} if f["name"] == column else f for f in meta["fields"]]
                self.catalog.store(name, meta["parts"], fields=fields)
            else:
                if column not in [c["name"] for c in meta["columns"]]:
                    raise ValueError(f"no column {column}")
                self.catalog.store(name, meta["parts"], columns=[c for c in meta["columns"] if c["name"] != column])
        elif self.take("rename", "column") or self.take("rename"):
            old = self.name()
            self.take("to")
            new_name = self.name()
            columns = [c | {"stored": c.get("stored", c["name"]), "name": new_name} if c["name"] == old else c for c in meta["columns"]]
            self.catalog.store(name, meta["parts"], columns=columns)
        return self.done()

    def _drop(self) -> DataFrame:
        kind = "matview" if self.take("materialized", "view") else self.name()
        lenient = self.take("if", "exists")
        name = self.name()
        cascade = self.take("cascade")
        group = {"table": "tables", "view": "views", "matview": "matviews", "type": "types", "sequence": "sequences", "index": "indexes", "function": "functions", "macro": "functions", "database": "databases"}[kind]
        if name not in self.catalog.now[group]:
            if lenient:
                return self.done()
            raise ValueError(f"no {kind} {name}")
        if group == "databases":
            self.catalog.change(lambda s: s[group].remove(name))
            return self.done()
        gone, found = {(group, name)}, True
        while found:  # what hangs on it, and on that
            names = {n for _, n in gone}
            found = [(g, n) for g in ("views", "matviews") for n, v in self.catalog.now[g].items() if (g, n) not in gone and names & set(v["uses"])]
            found += [("indexes", n) for n, v in self.catalog.now["indexes"].items() if v["table"] in names and ("indexes", n) not in gone]
            gone |= set(found)
        owners = [n for n, t in self.catalog.now["tables"].items() if n != name and any(f["table"] == name for f in t["fks"])] if group == "tables" else []
        if not cascade and (owners or any(g in ("views", "matviews") for g, n in gone if n != name)):
            raise ValueError(f"{name} is used by others; DROP ... CASCADE drops them too")

        def edit(state):
            for g, n in gone:
                state[g].pop(n, None)
            for t in state["tables"].values():
                t["fks"] = [f for f in t["fks"] if not (group == "tables" and f["table"] == name)]

        self.catalog.change(edit)
        return self.done()

    # DML
    def _insert(self) -> DataFrame:
        self.take("into")
        name = self.name()
        meta = self.catalog.table(name)
        listed = None
        if self.parts[self.i].text == "(" and self.parts[self.i + 1].low not in ("select", "with"):
            inner = self.bracket()
            listed = ["".join("/" if t.text in (".", "/") else unquoted(t.text) for t in c) for c in split_top(inner)]
        end = find_top(self.parts, "returning", start=self.i)
        source = text_of(self.parts[self.i : end])
        self.i = end
        source = f"SELECT * FROM ({source}) AS _src" if self.parts[self.i - 1].low != "default" else source
        df = self.sql(source)
        if meta["kind"] == "dynamic":
            return self._insert_dynamic(name, meta, df, listed)
        names = [c["name"] for c in meta["columns"]]
        targets = [c.lower() for c in listed] if listed else names[: len(df.columns)]
        if len(targets) != len(df.columns):
            raise ValueError(f"{len(targets)} columns are named and {len(df.columns)} given")
        if unknown := set(targets) - set(names):
            raise ValueError(f"no column {', '.join(sorted(unknown))}")
        given = df.toDF(*targets)
        rows = given.select(*[self._valued(c, F.col(c["name"]) if c["name"] in targets else F.expr(c.get("default", "NULL"))).alias(c.get("stored", c["name"])) for c in meta["columns"]])
        path = self.catalog.write_rows(rows)
        new = self.catalog.read(meta | {"parts": [path]})
        _check(self, name, meta, new, [*meta["parts"], path])
        self.catalog.store(name, [*meta["parts"], path])
        return self._returning(name, new)

    def _valued(self, column: dict, value):
        value = value.cast(column["type"])
        if "enum" in column:
            allowed = F.array(*[F.lit(x) for x in column["enum"]])
            value = F.when(value.isNull() | F.array_contains(allowed, value), value).otherwise(F.raise_error(F.concat(F.lit(f"{column['name']}: no such label: "), value)))
        if "length" in column:
            n = column["length"]
            padded = F.concat(value, F.array_repeat(F.lit(None).cast(column["type"][6:-1]), F.lit(n) - F.size(value)))
            value = F.when(F.size(value) > n, F.raise_error(F.lit(f"{column['name']}: more than {n} elements"))).otherwise(padded)
        return value

    def _insert_dynamic(self, name: str, meta: dict, df: DataFrame, listed: list[str] | None) -> DataFrame:
        """Each (name, type) is a column; a new one is added to the fields. Nested structs are flattened with slashes."""
        if listed:
            df = df.toDF(*listed)
        flat = flatten(df)
        fields = [dict(f) for f in meta["fields"]]
        columns = []
        for column, kind in flat.dtypes:
            if kind == "void":
                continue
            kind = "bigint" if kind in ("int", "smallint", "tinyint") else "double" if kind.startswith(("decimal", "float")) else kind
            known = [f for f in fields if f["name"] == column and f["type"] == kind]
            if not known:
                fields.append({"name": column, "type": kind})
            elif known[0].get("dropped"):
                known[0].pop("dropped")
            columns.append(F.col(f"`{column}`").cast(kind).alias(f"{column}#{kind}"))
        path = self.catalog.write_rows(flat.select(*columns))
        self.catalog.store(name, [*meta["parts"], path], fields=fields)
        return self._returning(name, self.catalog.read(meta | {"fields": fields, "parts": [path]}), Fields(fields))

    def _rewritten(self, name: str, meta: dict, df: DataFrame) -> str:
        """Write all rows of a table, with their row identifiers, under the names of the files."""
        if meta["kind"] == "dynamic":
            fields = Fields(meta["fields"])
            columns = [F.col(f"`{p}`").alias(f"{f['name']}#{f['type']}") for p, f in zip(fields.names(), fields.fields)]
        else:
            columns = [F.col(f"`{c['name']}`").alias(c.get("stored", c["name"])) for c in meta["columns"]]
        return self.catalog.write(df.select(*columns, ROW_ID))

    def _base(self, name: str, meta: dict) -> dict:
        self.catalog.read(meta, with_id=True).createOrReplaceTempView("_target")
        return {"_target": Fields(meta["fields"])} if meta["kind"] == "dynamic" else {}

    def _matched(self, name: str, alias: str, source: list[Token], where: list[Token], extra: list[str]) -> DataFrame:
        """Rows of the target that the predicate (with the source, if any) selects, each once, with extra expressions."""
        meta = self.catalog.table(name)
        dynamic = self.catalog.register([*source, *where, *tokens(" ".join(extra))])
        base = self._base(name, meta)
        if base:
            dynamic |= {"_target": base["_target"]}
        text = f"SELECT {alias}.*, {', '.join(extra + ['1 AS _one'])} FROM _target AS {alias}" + (f", {text_of(source)}" if source else "") + (f" WHERE {text_of(where)}" if where else "")
        ready = dialect.rewrite(text, dynamic)
        params = self.params
        if params and not isinstance(params, dict):
            args = {f"p{i + 1}": v for i, v in enumerate(params)} if ":p1" in ready else list(params)
        else:
            args = params
        out = self.spark.sql(ready, args=args) if args else self.spark.sql(ready)
        return out.dropDuplicates([ROW_ID]) if source else out

    def _update(self) -> DataFrame:
        name = self.name()
        alias = name
        if not self.peek("set"):
            self.take("as")
            alias = self.name()
        self.take("set")
        end = len(self.parts)
        at_from, at_where, at_ret = (find_top(self.parts, w, start=self.i) for w in ("from", "where", "returning"))
        sets = [(unquoted(s[0].text).lower() if find_top(s, "=") == 1 else "/".join(unquoted(t.text) for t in s[: find_top(s, "=")] if t.kind == "name"), dialect.operators(s[find_top(s, "=") + 1 :])) for s in split_top(self.parts[self.i : min(at_from, at_where, at_ret)])]
        source = self.parts[at_from + 1 : min(at_where, at_ret)] if at_from < end else []
        where = self.parts[at_where + 1 : at_ret] if at_where < end else []
        self.i = at_ret
        meta = self.catalog.table(name)
        kinds = {p: f["type"] for p, f in zip(Fields(meta["fields"]).names(), Fields(meta["fields"]).fields)} if meta["kind"] == "dynamic" else {c["name"]: c["type"] for c in meta["columns"]}
        if unknown := {c for c, _ in sets} - set(kinds):
            raise ValueError(f"no column {', '.join(sorted(unknown))}")
        hit = self._matched(name, alias, source, where, [f"({text_of(e)}) AS `_set_{c}`" for c, e in sets] + ([f"struct({self._source_alias(source)}.*) AS _src"] if source else []))
        saved = self.spark.read.parquet(self.catalog.write(hit.drop("_one")))
        by_name = {c["name"]: c for c in meta["columns"]}
        value = lambda c: self._valued(by_name[c], F.col(f"`_set_{c}`")) if c in by_name else F.col(f"`_set_{c}`").cast(kinds[c])
        news = saved.select(ROW_ID, *[(value(c) if c in dict(sets) else F.col(f"`{c}`")).alias(c) for c in kinds], *(["_src.*"] if source and self._returns() else []))
        before = self.catalog.read(meta, with_id=True)
        after = before.join(saved.select(ROW_ID), ROW_ID, "left_anti").unionByName(news.select(*[f"`{c}`" for c in kinds], ROW_ID))
        path = self._rewritten(name, meta, after)
        fresh = meta | {"parts": [path]}
        _check(self, name, meta, self.catalog.read(fresh), [path])
        _parents(self, name, meta, before, self.catalog.read(fresh))
        self.catalog.store(name, [path])
        return self._returning(alias, news.drop(ROW_ID), Fields(meta["fields"]) if meta["kind"] == "dynamic" else None, saved.count() if not self._returns() else None)

    def _source_alias(self, source: list[Token]) -> str:
        first = split_top(source)[0]
        return unquoted(first[-1].text)

    def _returns(self) -> bool:
        return self.peek("returning")

    def _delete(self) -> DataFrame:
        self.take("from")
        name = self.name()
        alias = name
        if self.i < len(self.parts) and self.parts[self.i].low not in ("using", "where", "returning"):
            self.take("as")
            alias = self.name()
        end = len(self.parts)
        at_using, at_where, at_ret = (find_top(self.parts, w, start=self.i) for w in ("using", "where", "returning"))
        source = self.parts[at_using + 1 : min(at_where, at_ret)] if at_using < end else []
        where = self.parts[at_where + 1 : at_ret] if at_where < end else []
        self.i = at_ret
        meta = self.catalog.table(name)
        hit = self._matched(name, alias, source, where, [f"struct({self._source_alias(source)}.*) AS _src"] if source else [])
        saved = self.spark.read.parquet(self.catalog.write(hit.drop("_one")))
        before = self.catalog.read(meta, with_id=True)
        path = self._rewritten(name, meta, before.join(saved.select(ROW_ID), ROW_ID, "left_anti"))
        opened = self.catalog.staged is None
        if opened:
            self.catalog.begin()
        try:
            self.catalog.store(name, [path])
            _cascade(self, name, saved)
        except Exception:
            if opened:
                self.catalog.rollback()
            raise
        if opened:
            self.catalog.commit()
        shown = saved.drop(ROW_ID, "_src") if not source or not self._returns() else saved.select(*[f"`{c}`" for c in saved.columns if c not in (ROW_ID, "_src")], "_src.*")
        return self._returning(alias, shown, Fields(meta["fields"]) if meta["kind"] == "dynamic" else None, saved.count() if not self._returns() else None)

    def _returning(self, name: str, rows: DataFrame, fields: Fields | None = None, n: int | None = None) -> DataFrame:
        if not self.take("returning"):
            return self.done(rows.count() if n is None else n)
        if len(set(rows.columns)) == len(rows.columns):
            rows.createOrReplaceTempView("_affected")
            items = [Token("name", "*") if t.text == "*" else t for t in self.rest()]
            return self.spark.sql(dialect.rewrite(f"SELECT {text_of(items)} FROM _affected AS {name}", {"_affected": fields} if fields else None))
        return rows


def flatten(df: DataFrame, arrays: bool = False) -> DataFrame:
    """Structs become columns a/b/c; arrays stay as they are."""
    from pyspark.sql.types import StructType

    def walk(schema: StructType, column, prefix: str):
        for f in schema.fields:
            inner = column(f.name)
            name = f"{prefix}{f.name}"
            if isinstance(f.dataType, StructType):
                yield from walk(f.dataType, lambda n, inner=inner: inner.getField(n), f"{name}/")
            else:
                yield inner.alias(name)

    return df.select(*walk(df.schema, lambda n: F.col(f"`{n}`"), ""))


def _first(df: DataFrame):
    return next(iter(df.limit(1).collect()), None)


def _check(st: _Statement, name: str, meta: dict, rows: DataFrame, parts: list[str] | None = None) -> None:
    """NOT NULL and CHECK on rows, keys on the whole table, foreign keys of rows. Raises before anything is published."""
    tests = [(f"{c['name']} is null", F.col(f"`{c['name']}`").isNull()) for c in meta["columns"] if c.get("not_null")]
    tests += [(f"check ({c})", ~F.coalesce(F.expr(dialect.rewrite(c)), F.lit(True))) for c in meta["checks"]]
    if tests:
        broken = F.coalesce(*[F.when(test, F.lit(what)) for what, test in tests])
        if found := _first(rows.select(broken.alias("broken")).where("broken is not null")):
            raise ConstraintError(f"{name}: {found[0]}")
    whole = st.catalog.read(meta | {"parts": parts}) if parts else rows
    for key in meta["keys"]:
        known = whole.where(" and ".join(f"`{c}` is not null" for c in key))
        if _first(known.groupBy(*key).count().where("count > 1")):
            raise ConstraintError(f"{name}: {', '.join(key)} is not unique")
    for fk in meta["fks"]:
        parent = whole if fk["table"] == name else st.catalog.read(st.catalog.table(fk["table"]))
        nulls = [F.col(f"`{c}`").isNull() for c in fk["columns"]]
        some, every = nulls[0], nulls[0]
        for x in nulls[1:]:
            some, every = some | x, every & x
        if fk["full"] and _first(rows.where(some & ~every)):
            raise ConstraintError(f"{name}: {', '.join(fk['columns'])} is null in part")
        keys = parent.select(*[F.col(f"`{c}`").alias(f"_p{i}") for i, c in enumerate(fk["to"])])
        on = [F.col(f"`{c}`") == F.col(f"_p{i}") for i, c in enumerate(fk["columns"])]
        if _first(rows.where(~some).join(keys, on, "left_anti")):
            raise ConstraintError(f"{name}: {', '.join(fk['columns'])} has no row in {fk['table']}")


def _children(st: _Statement, name: str):
    return [(n, t, fk) for n, t in st.catalog.now["tables"].items() for fk in t["fks"] if fk["table"] == name]


def _parents(st: _Statement, name: str, meta: dict, before: DataFrame, after: DataFrame) -> None:
    """An update must not take a key away that a child holds."""
    for child, t, fk in _children(st, name):
        if child == name:
            continue
        keys = after.select(*[F.col(f"`{c}`").alias(f"_p{i}") for i, c in enumerate(fk["to"])])
        rows = st.catalog.read(t).where(" and ".join(f"`{c}` is not null" for c in fk["columns"]))
        if _first(rows.join(keys, [F.col(f"`{c}`") == F.col(f"_p{i}") for i, c in enumerate(fk["columns"])], "left_anti")):
            raise ConstraintError(f"{child}: a key it holds would leave {name}")


def _cascade(st: _Statement, name: str, gone: DataFrame) -> None:
    """What deleted parents mean for their children, depth first, all within the open transaction."""
    for child, _, fk in _children(st, name):
        meta = st.catalog.table(child)
        left = st.catalog.read(st.catalog.table(name)).select(*[F.col(f"`{c}`").alias(f"_q{i}") for i, c in enumerate(fk["to"])])
        keys = gone.select(*[F.col(f"`{c}`").alias(f"_p{i}") for i, c in enumerate(fk["to"])]).distinct()
        keys = keys.join(left, [F.col(f"_p{i}") == F.col(f"_q{i}") for i in range(len(fk["to"]))], "left_anti")
        on = [F.col(f"`{c}`") == F.col(f"_p{i}") for i, c in enumerate(fk["columns"])]
        rows = st.catalog.read(meta, with_id=True)
        hit = rows.join(keys, on, "left_semi")
        if _first(hit) is None:
            continue
        if fk["on_delete"] == "restrict":
            raise ConstraintError(f"{child}: rows hold keys that would leave {name}")
        saved = st.spark.read.parquet(st.catalog.write(hit))
        rest = rows.join(saved.select(ROW_ID), ROW_ID, "left_anti")
        if fk["on_delete"] == "cascade":
            st.catalog.store(child, [st._rewritten(child, meta, rest)])
            _cascade(st, child, saved)
        else:
            kinds = {c["name"]: c for c in meta["columns"]}
            new = saved
            for c in fk["columns"]:
                value = kinds[c].get("default", "NULL") if fk["on_delete"] == "set default" else "NULL"
                new = new.withColumn(c, F.expr(value).cast(kinds[c]["type"]))
            path = st._rewritten(child, meta, rest.unionByName(new))
            _check(st, child, meta, st.catalog.read(meta | {"parts": [path]}), [path])
            st.catalog.store(child, [path])

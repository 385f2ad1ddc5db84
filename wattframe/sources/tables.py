"""Networks from tables of any store that Spark reads, through a TOML mapping compiled to column expressions.

The mapping has the sections substations, feeders, devices and connections, each once or several times. A section names
its ``file``, ``table`` or ``query``; a field is a column, a ``{column}`` template, or a table with ``column``,
``template`` or ``value`` and ``values``, ``unit`` and ``default``. Nothing is collected: first rows of an mRID, containers that
are only named, and ends of connections are found by grouped aggregates and joins.
"""

from __future__ import annotations

import re
import tomllib
from collections.abc import Callable
from functools import reduce
from urllib.parse import parse_qsl, unquote, urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattframe.errors import DataProblem, NameProblem
from wattframe.functions import vocabulary as V
from wattframe.network import COLUMNS, EXTRA, Network, normalized
from wattframe.operators.storage import stored

SECTIONS = ("substations", "feeders", "devices", "connections")
_PLACES = ("from_node", "to_node")
_FIELDS = {*COLUMNS, *_PLACES, "from_device", "to_device"}
_NOT_FIELDS = ("file", "table", "query", "extras", "partition")


def _lookup(values: dict) -> Column:
    return F.create_map(*[F.lit(str(x)) for pair in values.items() for x in pair])


def plain_text(c: Column, kind: str) -> Column:
    """A typed value as the text that a file's cell would hold: numbers without an exponent, times with a ``T``, bytes in hexadecimal, nested values as JSON."""
    if kind in ("double", "float"):
        text = c.cast("string")
        e = F.regexp_extract(text, r"E(-?\d+)$", 1).cast("int")
        digits = F.regexp_replace(F.regexp_replace(F.regexp_extract(text, r"^-?(\d+\.\d+)E", 1), r"\.?0*$", ""), r"\.", "")
        whole, size = F.rpad(digits, e + 1, "0"), F.length(digits)
        large = F.when(size > e + 1, F.concat(F.substring(digits, F.lit(1), e + 1), F.lit("."), F.substring(digits, e + 2, size))).otherwise(F.concat(whole, F.when(e < 16, ".0").otherwise("")))
        written = F.when(e >= 0, large).otherwise(F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), digits))
        return F.when(text.contains("E"), F.concat(F.when(text.startswith("-"), "-").otherwise(""), written)).otherwise(text)
    if kind == "timestamp" or kind == "timestamp_ntz":
        return F.regexp_replace(c.cast("string"), " ", "T")
    if kind == "binary":
        return F.lower(F.hex(c))
    return F.to_json(c) if re.match("array|map|struct", kind) else c.cast("string")


def bind(rule, columns: list[str] | dict[str, str], given: dict[str, str] | None = None) -> Column:
    """A field's text by its rule, over a table of these columns, which may come with their types; names match without case, and a column that is missing is an error."""
    if isinstance(rule, str):
        rule = {"template": rule} if "{" in rule else {"column": rule}
    lower = {c.lower(): c for c in columns}

    def column(name: str) -> Column:
        if name.lower() not in lower:
            raise NameProblem(f"the table has no column '{name}'", name, lower)
        own = lower[name.lower()]
        text = F.trim(plain_text(F.col(f"`{own}`"), columns[own] if isinstance(columns, dict) else "string"))
        return F.when(text != "", text)

    if "value" in rule:
        out = F.lit(str(rule["value"]))
    elif "template" in rule:
        parts = re.split(r"\{([^}]*)\}", rule["template"])
        out = F.concat(*(column(p) if k % 2 else F.lit(p) for k, p in enumerate(parts)))
    elif "column" in rule:
        out = column(rule["column"])
    else:
        raise DataProblem("a field needs a column, a template or a value")
    if "values" in rule:
        out = F.coalesce(_lookup(rule["values"])[out], _lookup({str(k).lower(): v for k, v in rule["values"].items()})[F.lower(out)], out)
    if "unit" in rule:
        out = F.when(out.rlike(r"^-?\d+(\.\d+)?$"), F.concat(out, F.lit(rule["unit"]))).otherwise(out)
    return F.coalesce(out, F.lit(str(rule["default"]))) if "default" in rule else out


def amount(text: Column, unit: str) -> Column:
    """A quantity's text in the canonical unit; null if it is none or of another dimension."""
    dimension, base = V.factor(unit)
    factors = F.create_map(*[F.lit(x) for u, f in V.DIMENSIONS[dimension].items() for x in (u, f / base)])
    n = F.regexp_extract(text, r"^\s*(-?\d+(?:\.\d+)?)\s*([A-Za-z]*)\s*$", 1).try_cast("double")
    word = F.lower(F.regexp_extract(text, r"^\s*(-?\d+(?:\.\d+)?)\s*([A-Za-z]*)\s*$", 2))
    return F.when(word == "", n).otherwise(n * factors[word])


def _section(rule: dict, df: DataFrame, rank: int) -> DataFrame:
    """Fields as text, and what the mapping does not use as extras of their own types."""
    fields = {k: r for k, r in rule.items() if k not in _NOT_FIELDS}
    for k in fields:
        if k not in _FIELDS:
            raise NameProblem(f"no field is called '{k}'", k, _FIELDS)
    used = {w.lower() for r in fields.values() for w in ([r] if isinstance(r, str) and "{" not in r else re.findall(r"\{([^}]*)\}", r if isinstance(r, str) else r.get("template", "")) + ([r["column"]] if isinstance(r, dict) and "column" in r else []))}
    out = {k: bind(r, dict(df.dtypes)) for k, r in fields.items()}
    if rule.get("extras", True):
        for c, t in df.dtypes:
            if c.lower() not in used and not re.match("binary|array|map|struct", t):
                kind = "boolean" if t == "boolean" else "long" if t in ("tinyint", "smallint", "int", "bigint") else "double" if re.match("float|double|decimal", t) else "string"
                out.setdefault(EXTRA + c.lower(), F.col(f"`{c}`").cast(kind))
    return df.select(*(v.alias(k) for k, v in out.items()), F.lit(rank).alias("_rank"), F.monotonically_increasing_id().alias("_at"))


def _union(frames: list[DataFrame]) -> DataFrame:
    """One table of all; a column whose types differ is text."""
    kinds: dict[str, set] = {}
    for df in frames:
        for c, t in df.dtypes:
            kinds.setdefault(c, set()).add(t)
    mixed = [c for c, t in kinds.items() if len(t) > 1]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (df.withColumns({c: F.col(c).cast("string") for c in mixed if c in df.columns}) for df in frames))


def assemble(spark: SparkSession, sections: dict[str, list[DataFrame]], source: str) -> Network:
    """A network from rows by section; counts of what was left out are in its ``notes``."""
    if not sections.get("devices"):
        raise DataProblem(f"{source} maps no devices")
    parts = []
    words = {**{w: t for t, ws in V.ALIASES.items() for w in ws.split() if t not in V.CONTAINERS}, **{c.lower(): t for t, c in V.CIM_CLASS.items() if t not in V.CONTAINERS}}
    kinds = {**{k: k for k in V.GENERATOR_CIM}, **V.KIND_SYNONYMS}
    for key in SECTIONS[:3]:
        for df in sections.get(key, []):
            if key != "devices":
                parts.append(df.withColumn("type", F.lit(key[:-1])))
                continue
            word = F.lower(F.coalesce(F.col("type"), F.lit("device"))) if "type" in df.columns else F.lit("device")
            known, kind = _lookup(words)[word], _lookup(kinds)[word]
            own = F.col("kind") if "kind" in df.columns else F.lit(None).cast("string")
            odd = {EXTRA + "source_type": F.when(known.isNull() & kind.isNull(), F.col("type"))} if "type" in df.columns else {}
            parts.append(df.withColumns({"kind": F.coalesce(own, F.when(known.isNull(), kind)), **odd}).withColumn("type", F.coalesce(known, F.when(kind.isNotNull(), "generator"), F.lit("device"))))
    every = stored(_union(parts), "mapped-rows")
    named = every.where("mrid is not null")
    place = F.struct("_rank", "_at")
    # A repeated mRID is rare, so a row is told from its first by a join with an aggregate, not by sorting all rows.
    first = named.groupBy("mrid").agg(F.min(place).alias("_first"), F.count("*").alias("_n"))
    kept = named.join(first, "mrid").where(place == F.col("_first")).drop("_first", "_n")
    fixed = {}
    for c, t in COLUMNS.items():
        if c not in kept.columns:
            fixed[c] = F.lit(None).cast(t)
        elif c in V.CANONICAL_UNIT:
            fixed[c] = amount(F.col(c), V.CANONICAL_UNIT[c])
        elif t == "boolean":
            fixed[c] = F.lower(c).isin("true", "yes", "y", "1", "t")
    for c in _PLACES:
        if c not in kept.columns:
            fixed[c] = F.lit(None).cast("string")
    bad = [F.count_if(F.col(c).isNotNull() & amount(F.col(c), u).isNull()).alias(c) for c, u in V.CANONICAL_UNIT.items() if c in every.columns]
    said = every.agg(F.count_if(F.col("mrid").isNull()).alias("_unnamed"), *bad).first().asDict()
    said["_twice"] = first.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0))).first()[0]
    kept = stored(kept.withColumns(fixed).drop("_rank", "_at"), "mapped-objects")
    have = kept.select("mrid")
    devices = kept.where(F.col("type").isin(*V.DEVICES))
    lost = devices.where("feeder is not null").groupBy(F.col("feeder").alias("mrid")).agg(F.min("substation").alias("substation")).join(have, "mrid", "left_anti").withColumn("type", F.lit("feeder"))
    named = kept.select("substation").unionByName(lost.select("substation")).where("substation is not null").select(F.col("substation").alias("mrid")).distinct()
    rows = kept.unionByName(lost, allowMissingColumns=True).unionByName(named.join(have, "mrid", "left_anti").withColumn("type", F.lit("substation")), allowMissingColumns=True)
    level = kept.where("type = 'substation' and voltage is not null").select(F.col("mrid").alias("substation"), F.col("voltage").alias("_v"))
    rows = rows.join(level, "substation", "left").withColumn("voltage", F.coalesce("voltage", F.when(F.col("type") == "feeder", F.col("_v")))).drop("_v")
    objects = stored(normalized(rows), "mapped-network")
    ends = devices.select("mrid", F.posexplode(F.array_distinct(F.array_compact(F.array(*_PLACES)))).alias("seq", "node"))
    links, notes = spark.createDataFrame([], "a string, b string"), []
    if sections.get("connections"):
        pairs = reduce(lambda a, b: a.unionByName(b), (df.select("from_device", "to_device") for df in sections["connections"]))
        there = devices.select("mrid")
        good = pairs.join(there, F.col("from_device") == there.mrid, "left_semi")
        good = stored(good.join(there, F.col("to_device") == there.mrid, "left_semi"), "mapped-links")
        said["_loose"] = pairs.count() - good.count()
        links = good.select(F.least("from_device", "to_device").alias("a"), F.greatest("from_device", "to_device").alias("b")).distinct()
    texts = {"_unnamed": "rows without mrid", "_twice": "rows that repeat an mrid", "_loose": "connections with an unknown end"}
    notes = [f"{n} {texts.get(k, f'values of {k} are no quantity')}" for k, n in said.items() if n]
    return Network(objects, stored(ends, "mapped-terminals"), links, source, notes).with_heads()


def read_mapped(spark: SparkSession, mapping: str, load: Callable[[dict], DataFrame], source: str = "") -> Network:
    """The network that a mapping (a TOML file, or its text) makes of the tables that ``load(section)`` returns."""
    try:
        if "\n" in mapping:
            plan = tomllib.loads(mapping)
        else:
            with open(mapping, "rb") as f:
                plan = tomllib.load(f)
    except (OSError, tomllib.TOMLDecodeError) as e:
        raise DataProblem(f"the mapping cannot be read: {e}") from e
    if unknown := sorted(set(plan) - set(SECTIONS)):
        raise DataProblem(f"a mapping has the sections {', '.join(SECTIONS)}, not {unknown[0]}")
    sections: dict[str, list[DataFrame]] = {}
    rank = 0
    for key in SECTIONS:
        rules = plan.get(key, [])
        for rule in rules if isinstance(rules, list) else [rules]:
            rank += 1
            sections.setdefault(key, []).append(_section(rule, load(rule), rank))
    return assemble(spark, sections, source or "a mapping")


def read_folder(spark: SparkSession, folder: str, mapping: str) -> Network:
    """Tables that are files of a folder in any store: ``file = "x.parquet"``, also csv, json or orc."""

    def load(rule: dict) -> DataFrame:
        if "file" not in rule:
            raise DataProblem("a section names no file")
        kind = rule["file"].rsplit(".", 1)[-1]
        return spark.read.format(kind if kind in ("parquet", "csv", "json", "orc") else "csv").options(**({"header": "true", "encoding": "UTF-8"} if kind not in ("parquet", "json", "orc") else {})).load(f"{folder}/{rule['file']}")

    return read_mapped(spark, mapping, load, folder)


def connection(conninfo: str) -> tuple[str, dict[str, str]]:
    """``(JDBC URL, properties)`` of a PostgreSQL URL or of ``key=value`` words."""
    if "://" in conninfo:
        u = urlsplit(conninfo)
        found = {"host": u.hostname or "localhost", "port": str(u.port or 5432), "dbname": u.path.strip("/"), "user": unquote(u.username or ""), "password": unquote(u.password or "")} | dict(parse_qsl(u.query))
    else:
        found = {"host": "localhost", "port": "5432", "dbname": ""} | {k: v.strip("'") for k, v in re.findall(r"(\w+)\s*=\s*('[^']*'|\S+)", conninfo)}
        if "service" in found:
            raise DataProblem("service files are not read; give host, dbname and user")
    url = f"jdbc:postgresql://{found.pop('host')}:{found.pop('port')}/{found.pop('dbname')}"
    return url, {k: v for k, v in found.items() if v}


def redact(conninfo: str) -> str:
    """The connection text without its password."""
    text = re.sub(r"(://[^:/@\s]*):[^@/\s]*@", r"\1:***@", conninfo)
    return re.sub(r"(\bpassword\s*=\s*)('[^']*'|[^\s&]+)", r"\1***", text, flags=re.I)


def has_password(conninfo: str) -> bool:
    return redact(conninfo) != conninfo


def read_postgres(spark: SparkSession, conninfo: str, mapping: str, driver: str = "org.postgresql.Driver") -> Network:
    """Tables of a PostgreSQL database by JDBC (its driver has to be on Spark's class path), 2,000 rows a fetch.

    A section's ``partition = {column, lower, upper, n}`` reads it in ``n`` ranges. Each section is one read of its own;
    for one moment across tables, read from a snapshot or replica that stands still.
    """
    url, properties = connection(conninfo)

    def load(rule: dict) -> DataFrame:
        r = spark.read.format("jdbc").options(url=url, driver=driver, fetchsize="2000", **properties)
        if ("query" in rule) == ("table" in rule):
            raise DataProblem("a section names a table or a query")
        table = f"({rule['query']}) q" if "query" in rule else rule["table"]
        if p := rule.get("partition"):
            r = r.options(partitionColumn=p["column"], lowerBound=str(p["lower"]), upperBound=str(p["upper"]), numPartitions=str(p["n"]))
        try:
            return r.option("dbtable", table).load()
        except Exception as e:
            raise DataProblem(f"{redact(conninfo)}: {str(e).splitlines()[0]}") from e

    return read_mapped(spark, mapping, load, redact(conninfo))
